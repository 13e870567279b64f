"""Operator 9: rule bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document.  The ledger keeps the measurements
and one ``failures`` integer whose bit ``b`` is set when rule ``b`` fails, so
a policy is a bit mask and applying, changing or ablating policies never reads
the texts again.  Documents are processed row by row: no shuffle, so neither
hot sources nor groups of copies matter.

Defined results: null text counts as empty, no words: all measurements 0 and
``too_few_words`` fails.  Repeated rows and ids are measured independently.
Extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import SPACE_CHARS, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_letters", "n_upper", "n_marks")

# Rule name -> SQL predicate over the measurements that is true on failure.
# The position in this mapping is the rule's bit; append only.
RULES = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "shouting": "100 * n_upper > 50 * n_letters",
    "few_letters": "100 * n_letters < 60 * word_chars",
    "marks": "n_marks > n_words",
}
# Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": tuple(RULES),
}


def policy_mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns plus the measurements of the whole text (all long)."""
    body = F.coalesce(F.col(text), F.lit(""))
    without = lambda chars: F.length(F.translate("_t", chars, ""))
    has_word = lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != ""
    d = docs.select(*[F.col(c) for c in keep], body.alias("_t"), words_of(body).alias("_w"),
                    F.filter(F.split(body, "\n"), has_word).alias("_lines"))
    windows = F.transform(
        F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2)))
    d = d.select(
        *keep, F.size("_w").cast("long").alias("n_words"),
        without(SPACE_CHARS).cast("long").alias("word_chars"),
        (F.length("_t") - without("#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count("_t", F.lit("\\p{L}")).cast("long").alias("n_letters"),
        F.regexp_count("_t", F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        (F.length("_t") - without("!?")).cast("long").alias("n_marks"),
        windows.alias("_h"))
    # Equal windows become neighbours after sorting (hash, position); only
    # texts that repeat a window at all are sorted.
    repeats = F.size("_h") > F.size(F.array_distinct("_h"))
    d = d.withColumn("_p", F.when(repeats, F.sort_array(
        F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: x["h"] == F.get(F.col("_p"), j)["h"]
    found = F.filter("_p", lambda x, j: F.coalesce(same(x, j - 1), F.lit(False))
                     | F.coalesce(same(x, j + 1), F.lit(False)))
    d = d.withColumn("_i", F.sort_array(F.transform(found, lambda x: x["i"])))
    covered = F.aggregate(
        "_i", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"])
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")) \
        .select(*keep, *MEASURES)


def failure_bits() -> Column:
    bits = [F.when(F.expr(rule), F.lit(1 << b)).otherwise(F.lit(0)) for b, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total.cast("long")


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per document: ``keep``, the measurements and ``failures``."""
    measured = measure(docs, keep, text).withColumn("failures", failure_bits())
    # A filter on the ledger would be pushed below its projections and evaluate
    # the measurements again inside their own lambdas; it stops at a generator.
    names = [*MEASURES, "failures"]
    return measured.select(*keep, F.inline_outer(F.array(F.struct(*names))).alias(*names))


def kept_by(policy: str, failures: Column | None = None) -> Column:
    """True where no rule of the policy fails."""
    failures = F.col("failures") if failures is None else failures
    return failures.bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents it fails, documents only it rejects and
    documents kept without it.  The ledger is first aggregated to one row per
    distinct failure mask (at most 2^rules), so the rules fan out over a
    handful of rows and a hot mask is combined before the shuffle."""
    mask = policy_mask(policy)
    masks = book.groupBy(F.col("failures").bitwiseAND(F.lit(mask).cast("long")).alias("m")) \
        .agg(F.count(F.lit(1)).alias("n"))
    bits = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit"))
                     for r in POLICIES[policy]])
    rows = masks.select("m", "n", F.explode(bits).alias("r")).select("m", "n", "r.*")
    count = lambda hit: F.sum(F.when(hit, F.col("n")).otherwise(0))
    rest = F.col("m").bitwiseAND(F.lit(mask).cast("long").bitwiseXOR(F.col("bit")))
    return rows.groupBy("rule").agg(
        count(F.col("m").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(F.col("m") == F.col("bit")).alias("n_only"),
        count(rest == 0).alias("n_kept_without"))


def filter_documents(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents (all their columns, unchanged) that the policy keeps.

    The ledger is computed beside each row, so duplicates of an id are judged
    one by one and nothing is joined."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    book = ledger(docs.select(F.col("text").alias("text"), row), ("_row",))
    return book.where(kept_by(policy)).select("_row.*")


def op9(docs: DataFrame) -> DataFrame:
    """Contract columns of the whole table (``failures`` and the rest follow)."""
    book = ledger(docs)
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~kept_by("base")).alias("base_failed"), kept_by("v1").alias("kept"),
        "n_lines", "n_letters", "n_upper", "n_marks", "failures")


ORACLE_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t from documents
), m as (
  select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from d
), wins as (
  select row_number() over () as k, doc_id, t, w, l from m
), pos as (
  select k, unnest(range(1, greatest(len(w) - 1, 1))) as i, w from wins
), grams as (
  select k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from pos
), many as (
  select k, i from (select k, i, count(*) over (partition by k, g) as n from grams) where n > 1
), covered as (
  select k, count(distinct p) as n from (select k, unnest([i, i + 1, i + 2]) as p from many) group by k
), b as (
  select doc_id, len(w)::bigint as n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines,
    len(regexp_extract_all(t, '\p{L}'))::bigint as n_letters,
    len(regexp_extract_all(t, '\p{Lu}'))::bigint as n_upper,
    (length(t) - length(regexp_replace(t, '[!?]', '', 'g')))::bigint as n_marks
  from wins left join covered c using (k)
), f as (
  select *, ((n_words < 50)::int * 1 + (100 * n_repeat_words > 50 * n_words)::int * 2
    + (word_chars < 2 * n_words or word_chars > 20 * n_words)::int * 4
    + (10 * n_symbols > n_words)::int * 8 + (100 * n_dup_lines > 50 * n_lines)::int * 16
    + (100 * n_upper > 50 * n_letters)::int * 32 + (100 * n_letters < 60 * word_chars)::int * 64
    + (n_marks > n_words)::int * 128)::bigint as failures from b
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failures & 3) <> 0 as base_failed, failures = 0 as kept,
  n_lines, n_letters, n_upper, n_marks, failures
from f
"""
