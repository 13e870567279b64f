"""Guardrail screening of text corpora: injection, hidden base64 injection,
custom blocklists, personal data, and HTML sanitising.

Every check is a native Spark expression applied to the whole text column;
the 15 injection patterns are fused into one alternation at build time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import regex as rx

PHP_FLAG_MAP = {"i": "i", "m": "m", "s": "s", "x": "x", "u": "U"}
BRACKETS = {"(": ")", "{": "}", "[": "]", "<": ">"}


def injection_hit(text: Column) -> Column:
    hit = None
    for p in rx.injection_regexes():
        h = text.rlike(p)
        hit = h if hit is None else (hit | h)
    return F.coalesce(hit, F.lit(False))


def _decoded_hit(blob: Column) -> Column:
    return F.coalesce((F.octet_length(blob) > rx.BASE64_MIN_BYTES)
                      & injection_hit(blob.cast("string")), F.lit(False))


def base64_hit(text: Column) -> Column:
    """A base64 run anywhere -> strip every non-alphabet character from the
    whole text, strict-decode (bad input = no match) and re-test.  Column
    form; the DataFrame operators below decode once per row."""
    blob = F.try_to_binary(F.regexp_replace(text, rx.BASE64_STRIP, ""), F.lit("base64"))
    return F.when(text.rlike(rx.BASE64_RUN_SCAN), _decoded_hit(blob)).otherwise(F.lit(False))


def _decoded_text(text: Column) -> Column:
    """Whole-text base64 decode as a string, null unless a run is present and
    more than 20 bytes decode."""
    blob = F.try_to_binary(F.regexp_replace(text, rx.BASE64_STRIP, ""), F.lit("base64"))
    return F.when(text.rlike(rx.BASE64_RUN_SCAN) & (F.octet_length(blob) > rx.BASE64_MIN_BYTES),
                  blob.cast("string"))


def with_decoded(df: DataFrame, text_col: str, out: str = "_b64_text") -> DataFrame:
    """Materialise the decoded payload in its own projections (bytes, then
    text); the checks that read it reference the column, so the strip and
    decode run once per row."""
    text = F.col(text_col)
    blob = F.when(text.rlike(rx.BASE64_RUN_SCAN),
                  F.try_to_binary(F.regexp_replace(text, rx.BASE64_STRIP, ""), F.lit("base64")))
    d = df.withColumn("_b64_blob", blob)
    return d.withColumn(out, F.when(F.octet_length("_b64_blob") > rx.BASE64_MIN_BYTES,
                                    F.col("_b64_blob").cast("string"))).drop("_b64_blob")


def base64_screen(df: DataFrame, text_col: str = "text", out: str = "base64_injection") -> DataFrame:
    d = with_decoded(df, text_col)
    return d.withColumn(out, injection_hit(F.col("_b64_text"))).drop("_b64_text")


def base64_runs_hit(text: Column) -> Column:
    """Improved option: decode every run on its own."""
    runs = F.regexp_extract_all(text, F.lit(rx.BASE64_RUN), 0)
    return F.coalesce(F.exists(runs, lambda r: _decoded_hit(F.try_to_binary(r, F.lit("base64")))),
                      F.lit(False))


def parse_blocklist(text: str | None) -> list[str]:
    """Lines of a pattern list: trimmed; empty and ``"0"`` lines dropped."""
    if not text:
        return []
    lines = [ln.strip(rx.TRIM_CHARS) for ln in text.split("\n")]
    return [ln for ln in lines if ln not in ("", "0")]


# A word boundary over ASCII letters, digits and underscore.
ASCII_BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
ASCII_NO_BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<![A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_boundaries(body: str) -> str:
    """``\\b`` and ``\\B`` outside character classes, read as ASCII boundaries."""
    out, i, in_class = [], 0, False
    while i < len(body):
        c = body[i]
        if c == "\\" and i + 1 < len(body):
            pair = body[i:i + 2]
            # inside a class \\b is the backspace
            out.append(pair.replace("\\b", "\\x08") if in_class else {"\\b": ASCII_BOUNDARY, "\\B": ASCII_NO_BOUNDARY}.get(pair, pair))
            i += 2
            continue
        in_class = c == "[" or (in_class and c != "]")
        out.append(c)
        i += 1
    return "".join(out)


def to_java_regex(pattern: str) -> str | None:
    """``/body/flags`` (any delimiter) -> ``(?flags)body``; None if malformed."""
    if len(pattern) < 2 or pattern[0].isalnum() or pattern[0] == "\\" or pattern[0].isspace():
        return None
    end_delim = BRACKETS.get(pattern[0], pattern[0])
    end = pattern.rfind(end_delim)
    if end <= 0:
        return None
    body, flags = pattern[1:end], pattern[end + 1:]
    if not re.fullmatch(r"[imsxuADSUXJn]*", flags):
        return None
    if "u" not in flags:
        body = ascii_boundaries(body)
    java_flags = "".join(sorted({PHP_FLAG_MAP[f] for f in flags if f in PHP_FLAG_MAP}))
    if "A" in flags:   # anchored: match only at the start of the text
        body = f"\\G(?:{body})"
    return (f"(?{java_flags})" if java_flags else "") + body


def compile_blocklist(spark: SparkSession, text: str | None) -> tuple[list[str], list[str]]:
    """Return (valid Java patterns, rejected source lines).

    Each pattern is compiled once by the JVM regex engine with a one-row
    probe; invalid ones never match (and are reported).
    """
    valid, rejected = [], []
    for line in parse_blocklist(text):
        java = to_java_regex(line)
        if java is None:
            rejected.append(line)
            continue
        try:
            spark.range(1).select(F.lit("").rlike(java)).collect()
            valid.append(java)
        except Exception as exc:  # noqa: BLE001 - anything but a pattern error is raised again
            if "PatternSyntaxException" not in str(exc) and "INVALID_PARAMETER_VALUE.PATTERN" not in str(exc):
                raise
            rejected.append(line)
    return valid, rejected


def blocklist_hit(text: Column, patterns: list[str]) -> Column:
    if not patterns:
        return F.lit(False)
    hit = None
    for p in patterns:
        h = text.rlike(p)
        hit = h if hit is None else (hit | h)
    return F.coalesce(hit, F.lit(False))


def _reason(text: Column, decoded: Column, blocklist: list[str] | None) -> Column:
    return (F.when(injection_hit(text), F.lit(rx.REASON_INJECTION))
            .when(injection_hit(decoded), F.lit(rx.REASON_BASE64))
            .when(blocklist_hit(text, blocklist or []), F.lit(rx.REASON_BLOCKED))
            .otherwise(F.lit("")))


def validation_reason(text: Column, blocklist: list[str] | None = None, enabled: bool = True) -> Column:
    """The first failing check's reason ('' when safe): injection, then
    base64, then blocklist (Column form)."""
    if not enabled:
        return F.lit("")
    return _reason(text, _decoded_text(text), blocklist)


def validate(df: DataFrame, text_col: str = "text", blocklist: list[str] | None = None,
             enabled: bool = True) -> DataFrame:
    """Adds ``safe`` and ``reason``.  The decoded payload and the reason are
    each computed once in their own projection and ``safe`` is derived from
    the column, so no regex work is repeated when projections are collapsed."""
    if not enabled:
        return df.select(*df.columns, F.lit(True).alias("safe"), F.lit("").alias("reason"))
    d = with_decoded(df, text_col)
    with_reason = d.withColumn("reason", _reason(F.col(text_col), F.col("_b64_text"), blocklist))
    return with_reason.select(*df.columns, (F.col("reason") == "").alias("safe"), "reason")


def conversation_screen(messages: DataFrame, blocklist: list[str] | None = None,
                        enabled: bool = True) -> DataFrame:
    """Only user messages are screened; the first unsafe one (by turn) rejects
    the conversation.  One row per conversation, via partial aggregation."""
    users = messages.withColumn("text", F.when(F.col("role") == "user", F.col("text")))
    v = validate(users, "text", blocklist, enabled)
    bad_turn = F.when(F.col("role") == "user", F.when(~F.col("safe"), F.col("turn")))
    return v.groupBy("conv_id").agg(
        F.min(bad_turn).alias("rejected_turn"),
        F.min_by(F.col("reason"), bad_turn).alias("reason")) \
        .select("conv_id", F.col("rejected_turn").isNull().alias("safe"),
                F.coalesce("reason", F.lit("")).alias("reason"), "rejected_turn")


def sanitize_html_expr(html: Column) -> Column:
    out = html
    for pattern, repl in rx.sanitize_steps():
        out = F.regexp_replace(out, pattern, repl)
    return out


def _pii_hit(text: Column, name: str, pattern: str) -> Column:
    if name == "email":   # no '@', no e-mail address: a plain byte search first
        return text.contains("@") & text.rlike(rx.EMAIL_SCAN)
    return text.rlike(pattern)


def pii_types_expr(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(_pii_hit(text, name, p), F.lit(name))
                                     for name, p in rx.PII_PATTERNS]))


def pii_flag(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("pii_types", pii_types_expr(F.col(text_col))) \
        .withColumn("pii_flagged", F.size("pii_types") > 0)


def sanitize(df: DataFrame, text_col: str = "text", is_html: bool = False, sanitize_html: bool = True,
             detect_pii: bool = False) -> DataFrame:
    """HTML clean-up when the text is HTML and the setting is on; PII flags
    (on the cleaned text) when enabled."""
    out = df
    if is_html and sanitize_html:
        out = out.withColumn(text_col, sanitize_html_expr(F.col(text_col)))
    if detect_pii:
        out = pii_flag(out, text_col)
    return out


def pii_report(texts: DataFrame, text_col: str = "text", by: str = "source") -> DataFrame:
    """Texts flagged per PII type and ``by`` group: one flag column per type
    (each pattern evaluated once) and conditional counts, then one row per
    (type, group) with a non-zero count."""
    flags = texts.select(by, *[_pii_hit(F.col(text_col), n, p).alias(f"_{n}") for n, p in rx.PII_PATTERNS])
    counts = flags.groupBy(by).agg(*[F.count(F.when(F.col(f"_{n}"), 1)).alias(n) for n, _ in rx.PII_PATTERNS])
    stacked = counts.select(by, F.explode(F.array(*[F.struct(F.lit(n).alias("pii_type"),
                                                             F.col(n).alias("texts"))
                                                    for n, _ in rx.PII_PATTERNS])).alias("s"))
    return stacked.select("s.pii_type", by, "s.texts").where(F.col("texts") > 0)


def rejection_report(validated: DataFrame) -> DataFrame:
    """Rejected texts per reason (conditional count, so no filter has to be
    evaluated below the validator)."""
    return validated.groupBy("reason").agg(F.count(F.when(~F.col("safe"), 1)).alias("texts")) \
        .where(F.col("texts") > 0)
