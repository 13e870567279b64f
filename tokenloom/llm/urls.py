"""Operator 10: URL filter by a character language-model ratio.

Host rules give the verdict of the URLs they fit.  Those URLs train two
smoothed variable-order Markov models over bytes (accepted and rejected), and
the remaining URLs are judged by their length-normalised log-likelihood
difference against a calibrated threshold.

n-gram counts cover every rule-labelled row and are exact: a Spark table with
one row per distinct context (of 0..ORDER bytes) and per distinct context with
its next byte, named by 64-bit hashes, that grows with the corpus.  URLs are
scored in chunks: a chunk's distinct n-grams are joined with the counts and meet
its URLs in one task, so a common n-gram costs one row per chunk.  The threshold
comes from a histogram over the calibration fold (crc32(url) mod 5 = 0), whose
rows the models don't train on.

Defined results: a null URL or one without ``://`` has empty host and path and
no rule; its whole text is scored (null: empty text, difference 0).  Without
labelled rows of both classes the difference is 0 and the verdict ``allow``.
Repeated rows and ids are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import materialise, mix64, text_slices, with_field

ORDER = 5            # longest context in bytes
CHUNK = 1 << 18      # bytes of text scored together
PRIOR = 3.0          # weight of the next shorter context
BINS, WIDTH = 2001, 0.01   # calibration histogram: differences -10 .. 10

# (verdict, host, path prefix)
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("block", "net", "/"), ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
)


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, text to score)."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    after = F.substr(rest, F.length(raw) + 1)
    path = F.regexp_extract(after, "^[^?#]*", 0)
    return host, path, F.when(at > 0, F.concat(host, after)).otherwise(url)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...], field: str) -> Column:
    """The longest fitting rule's ``name`` or ``verdict``, else null."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    picks = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                    F.lit(h + p if field == "name" else verdict)) for verdict, h, p in ranked]
    return F.coalesce(*picks, F.lit(None).cast("string"))


def apply_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    host, path, text = split_url(F.col("url"))
    d = pages.select("page_id", "url", host.alias("host"), path.alias("path"), text.alias("text"))
    return d.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules, "name")) \
        .withColumn("listed", rule_of(F.col("host"), F.col("path"), rules, "verdict"))


def _keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(joint keys, context keys) per order and byte, and the row of each byte."""
    column = column.cast(pa.binary())
    lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    data = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).astype(np.uint64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    index = np.arange(len(data))
    joint = np.empty((ORDER + 1, len(data)), dtype=np.int64)
    ctx = np.empty((ORDER + 1, len(data)), dtype=np.int64)
    h = np.zeros(len(data), dtype=np.uint64)
    for k in range(ORDER + 1):
        if k:
            inside = index - k >= start
            before = np.where(inside, data[np.maximum(index - k, 0)], np.uint64(256))
            h = mix64(h * np.uint64(257) + before + np.uint64(k))
        ctx[k] = mix64(h + np.uint64(977)).view(np.int64)
        joint[k] = mix64(h * np.uint64(31) + data + np.uint64(1)).view(np.int64)
    return joint, ctx, rows


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text", CHUNK):
            joint, ctx, rows = _keys(part.column("text"))
            label = np.tile(part.column("label").to_numpy(zero_copy_only=False)[rows], 2 * (ORDER + 1))
            key, at = np.unique(np.concatenate([joint.ravel(), ctx.ravel()]), return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), *(pa.array(np.bincount(at[label == c], minlength=len(key))) for c in (0, 1))],
                names=["key", "rejected", "accepted"])


def train(labelled: DataFrame) -> DataFrame:
    """key, rejected, accepted: the counts, written; ``labelled`` has text, label (1 accepted)."""
    return materialise(labelled.select("text", F.col("label").cast("int").alias("label"))
                       .mapInArrow(_count, "key long, rejected long, accepted long")
                       .groupBy("key").agg(F.sum("rejected").alias("rejected"), F.sum("accepted").alias("accepted")),
                       "url-counts")


def differences(key: np.ndarray, counts: np.ndarray, column: pa.Array) -> np.ndarray:
    """Mean log-likelihood difference per byte, accepted minus rejected; ``key``
    is sorted, ``counts`` [class, key]."""
    joint, ctx, rows = _keys(column)
    key, counts = np.r_[key, key[-1:] if len(key) else 0], np.c_[counts, np.zeros((2, 1))]   # last: not counted

    def looked_up(keys):
        at = np.searchsorted(key[:-1], keys)
        return np.where(key[at] == keys, at, len(key) - 1)

    at_joint, at_ctx = looked_up(joint), looked_up(ctx)
    ll = []
    for c in (0, 1):
        p = np.full(joint.shape[1], 1 / 256)
        for k in range(ORDER + 1):
            p = (counts[c][at_joint[k]] + PRIOR * p) / (counts[c][at_ctx[k]] + PRIOR)
        ll.append(np.bincount(rows, np.log(p), minlength=len(column)))
    size = np.maximum(np.bincount(rows, minlength=len(column)), 1)
    return (ll[1] - ll[0]) / size


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in text_slices(batch, "text", CHUNK):
            yield part.append_column("chunk", pa.array(np.full(part.num_rows, number), pa.int64()))
            number += 1


def _chunk_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text", CHUNK):
            joint, ctx, rows = _keys(part.column("text"))
            chunk = part.column("chunk").to_numpy()[rows]
            for c in np.unique(chunk):
                mine = chunk == c
                key = np.unique(np.concatenate([joint[:, mine].ravel(), ctx[:, mine].ravel()]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c)), pa.array(key)], names=["chunk", "key"])


def score(df: DataFrame, counts: DataFrame) -> DataFrame:
    """``df`` (with ``text``) plus ``difference``, written."""
    # Ids travel as text: pandas would turn a column with nulls into floats.
    wide = df.withColumn("page_id", F.col("page_id").cast("string"))
    dealt = materialise(wide.mapInArrow(_chunks, with_field(wide, "chunk", "long")), "url-chunks")
    keys = materialise(dealt.select("chunk", "text").mapInArrow(_chunk_keys, "chunk long, key long"), "url-keys")
    known = keys.join(counts, "key").select("chunk", "key", "rejected", "accepted")

    names = [*wide.columns, "difference"]

    def run(rows, found):
        found = found.drop_duplicates("key").sort_values("key")
        if not len(rows):
            return pd.DataFrame({c: [] for c in names})
        table = found[["rejected", "accepted"]].to_numpy(dtype=np.float64).T
        rows["difference"] = differences(found["key"].to_numpy(dtype=np.int64), table, pa.array(rows["text"], pa.string()))
        return rows.drop(columns="chunk")

    out = dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(run, with_field(wide, "difference", "double"))
    return materialise(out.withColumn("page_id", F.col("page_id").cast(df.schema["page_id"].dataType)), "url-scored")


def calibrate(scored: DataFrame) -> float:
    """Threshold with the best balanced accuracy on ``label``, ``difference``
    (of equals the one nearest 0); 0 if a class is missing."""
    half = BINS // 2
    bucket = F.greatest(F.lit(-half), F.least(F.lit(half), F.floor(F.col("difference") / WIDTH))).cast("int")
    got = scored.groupBy(bucket.alias("b"), F.col("label").cast("int").alias("label")).count().collect()
    hist = np.zeros((2, BINS))
    for r in got:   # at most 2 * BINS rows
        hist[r["label"], r["b"] + half] += r["count"]
    if not hist.sum(axis=1).all():
        return 0.0
    hist /= hist.sum(axis=1, keepdims=True)
    below = np.c_[np.zeros((2, 1)), np.cumsum(hist, axis=1)]   # share under each edge
    good = below[0] + (1 - below[1])
    best = np.flatnonzero(good >= good.max() - 1e-12)
    # Middle of the run of best edges nearest 0: the classes' gap is shared.
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    mids = [float((r[0] + r[-1]) / 2 - half) * WIDTH for r in runs]
    return min(mids, key=abs)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, difference, threshold, verdict."""
    ruled = apply_rules(pages, rules)
    label = (F.col("listed") == "allow").cast("int").alias("label")
    held = F.crc32(F.col("url").cast("binary")) % 5 == 0
    labelled = ruled.where(F.col("listed").isNotNull())
    counts = train(labelled.where(~held).select("text", label))
    both = counts.agg(F.max("rejected").alias("r"), F.max("accepted").alias("a")).first()
    if not (both["r"] and both["a"]):
        counts = counts.where(F.lit(False))
    scored = score(ruled, counts)
    threshold = calibrate(scored.where(F.col("listed").isNotNull() & held).select("difference", label))
    method = F.when(F.col("difference") >= threshold, "allow").otherwise("block")
    return scored.select(
        "page_id", "url", "host", "path", "rule", "difference", F.lit(threshold).alias("threshold"),
        F.coalesce("listed", method).alias("verdict"))


def op10(pages: DataFrame) -> DataFrame:
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "difference")
