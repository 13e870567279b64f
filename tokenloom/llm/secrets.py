"""Operator 4: secret scan with a randomness test battery.

Base spans come from three patterns (assign, access, hex).  The method adds
``random`` spans: every other token of at least ``MIN_LENGTH`` key characters
gets an inferred encoding and is tested against "its characters are drawn
uniformly from that alphabet" with

* a chi-squared test of alphabet uniformity,
* a Wald-Wolfowitz runs test around the alphabet's median, and
* a lag-1 serial correlation test.

Words and structured text fail at least one of them by a wide margin.  The
three p-values are combined (Bonferroni minimum) into the evidence against
randomness.  Which tokens are rejected is decided by Benjamini-Hochberg at
level ``FDR`` per (encoding, length class), over all tokens of the corpus: at
most that share of the rejected tokens is truly random.  Lengths too short for
the battery to reject an ordinary word are never called random
(``POWER_LENGTH`` per encoding).  Tokens that survive are ``random`` spans.

One pass reads the texts; the p-value histogram per stratum (fixed number of
strata and bins) is the only thing that is aggregated, so skew in documents or
tokens costs nothing.

Defined results: null text counts as empty: no spans, the sha-256 of ''.
Positions are code points, end exclusive.  Repeated rows are scanned each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import materialise, text_slices

# The base patterns, in the order that spans of equal start take.
ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")   # a greedy run of 24 or more is the run that the filter keeps
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])")
MIN_LENGTH = 20
FDR = 0.01
BINS = 400           # p-value histogram: -log10 p in steps of 0.05 up to 20
# Encoding: its alphabet in code order; fixed values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
# Shortest token for which the battery has the power to reject a word.
POWER_LENGTH = {"hex": 20, "HEX": 20, "base32": 24, "upper36": 20, "lower36": 24, "base62": 20,
                "base64": 24, "base64url": 24}
RANKS = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}
SETS = {name: frozenset(a) for name, a in ALPHABETS.items()}


def infer_encoding(token: str) -> str | None:
    """The smallest alphabet that holds the token's characters."""
    chars = set(token)
    return next((name for name, a in SETS.items() if chars <= a), None)


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi2_tail(x: float, df: int) -> float:
    """Upper tail by the Wilson-Hilferty cube root."""
    if x <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str, encoding: str) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation."""
    rank, size = RANKS[encoding], len(ALPHABETS[encoding])
    x = np.array([rank[c] for c in token], dtype=np.float64)
    n = len(x)
    # Neighbouring characters share a cell so that cells expect about 4 each;
    # the cells also separate digits, upper and lower case.
    cells = max(2, min(size, n // 4))
    seen = np.bincount((x * cells // size).astype(int), minlength=cells)
    width = np.bincount((np.arange(size) * cells // size).astype(int), minlength=cells) / size
    uniform = _chi2_tail(float(((seen - n * width) ** 2 / (n * width)).sum()), cells - 1)
    # Character classes have their own share of the alphabet.
    alphabet = ALPHABETS[encoding]
    kinds = [sum(map(f, alphabet)) / size for f in (str.isdigit, str.isupper, str.islower)]
    have = [sum(map(f, token)) for f in (str.isdigit, str.isupper, str.islower)]
    z = [(h - n * k) / math.sqrt(n * k * (1 - k)) for h, k in zip(have, kinds) if 0 < k < 1]
    uniform = min(1.0, 2 * min(uniform, *[len(z) * _normal_tail(v) for v in z])) if z else uniform
    high = x >= size / 2
    a, b = int(high.sum()), int((~high).sum())
    if a and b:
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = _normal_tail((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs = 2.0 ** (1 - n)
    d = x - (size - 1) / 2
    serial = _normal_tail(float((d[1:] * d[:-1]).sum()) / (math.sqrt(n - 1) * (size * size - 1) / 12))
    return uniform, runs, serial


def length_class(n: int) -> int:
    """0: 20-31, 1: 32-63, 2: 64-127, ..."""
    return max(0, n.bit_length() - 5) if n >= 32 else 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
    """(start, end, encoding, p) of tokens that no base span touches."""
    out = []
    for m in CANDIDATE.finditer(text):
        token = m[0].rstrip("=")
        if not MIXED.match(token) or any(s < m.end() and m.start() < e for s, _, e in taken):
            continue
        encoding = infer_encoding(token)
        if encoding and len(token) >= POWER_LENGTH[encoding]:
            out.append((m.start(), m.end(), encoding, min(1.0, 3 * min(battery(token, encoding)))))
    return out


CAND_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("stratum", pa.string()),
                                ("bin", pa.int32())]))
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))


def p_bin(p: float) -> int:
    """Histogram cell of a p-value; a larger cell is stronger evidence."""
    return min(BINS - 1, int(-math.log10(max(p, 1e-300)) / 0.05))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            base, cands = [], []
            for text in part.column("text").to_pylist():
                spans = sorted(base_spans(text))
                base.append([{"start": s, "kind": k, "stop": e} for s, k, e in spans])
                cands.append([{"start": s, "stop": e, "stratum": f"{enc}:{length_class(e - s)}", "bin": p_bin(p)}
                              for s, e, enc, p in candidates(text, spans)])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(base, SPAN_TYPE), pa.array(cands, CAND_TYPE)],
                names=["doc_id", "base", "cands"])


SCAN_SCHEMA = ("doc_id long, base array<struct<start:int,kind:int,stop:int>>, "
               "cands array<struct<start:int,stop:int,stratum:string,bin:int>>")


def rejected_from(histogram: dict[str, dict[int, int]], level: float = FDR) -> dict[str, int]:
    """Per stratum the smallest p-value cell that Benjamini-Hochberg rejects."""
    cut = {}
    for stratum, cells in histogram.items():
        total, seen, first = sum(cells.values()), 0, BINS + 1
        for b in sorted(cells, reverse=True):
            seen += cells[b]
            if 10 ** (-0.05 * b) <= level * seen / total:   # upper edge of the cell
                first = b
        cut[stratum] = first
    return cut


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and all spans (start, kind number, stop) by start, then kind."""
    found = materialise(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
                        .mapInArrow(_scan, SCAN_SCHEMA), "secret-spans")
    counted = found.select(F.explode("cands").alias("c")).groupBy("c.stratum", "c.bin").count().collect()
    histogram: dict[str, dict[int, int]] = {}       # at most encodings x length classes x BINS cells
    for r in counted:
        histogram.setdefault(r["stratum"], {})[r["bin"]] = r["count"]
    cut = rejected_from(histogram)
    # Without any candidate the map has one entry that is never looked up.
    table = F.create_map(*[F.lit(x) for pair in (cut or {"": 0}).items() for x in pair])
    keep = lambda c: c["bin"] < table[c["stratum"]]
    extra = F.transform(F.filter("cands", keep), lambda c: F.struct(
        c["start"].alias("start"), F.lit(3).alias("kind"), c["stop"].alias("stop")))
    return found.select("doc_id", "base", F.sort_array(F.concat("base", extra)).alias("spans"))


def op4(docs: DataFrame) -> DataFrame:
    """Contract columns; ``n_random`` counts the spans that the battery adds."""
    name = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scan(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
        count(3).alias("n_random"))

