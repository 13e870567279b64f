"""Entity vector table: encode/decode, keyed upsert, look-up, truncation and
health checks; vector kernels shared by the searches (``topk.py``, ``ann.py``)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.schemas import VECTOR_KEY

VECTOR_COLS = ["platform", "model", "dimensions", "vector", "updated_at"]


def encode_vectors(vectors: DataFrame) -> DataFrame:
    """array<float> -> JSON text, with ``dimensions`` = element count."""
    return vectors.withColumn("dimensions", F.size("vector").cast("bigint")) \
        .withColumn("vector", F.to_json("vector"))


def decode_vectors(vectors: DataFrame) -> DataFrame:
    """JSON text -> array<float>; missing or malformed JSON -> empty array."""
    dec = F.coalesce(F.from_json("vector", "array<float>"), F.array().cast("array<float>"))
    return vectors.withColumn("vector", dec)


def upsert_vectors(existing: DataFrame, batch: DataFrame, keep_seq: bool = False) -> DataFrame:
    """Keyed upsert on (entity_type, entity_id, store_id).

    The latest version (by ``updated_at``, then the batch sequence ``seq``)
    wins for platform, model, dimensions, vector and updated_at.  A stored key
    keeps its ``created_at`` whatever the batch says; a new key gets that of its
    first version.  One ``groupBy`` with ``max_by`` / ``min_by``: partial
    aggregation drops superseded versions before the shuffle.
    ``keep_seq`` keeps the winning sequence so later merges (streaming
    snapshots) order versions exactly regardless of arrival order.
    """
    def shaped(df: DataFrame, default_seq: int, arriving: bool) -> DataFrame:
        seq = F.col("seq") if "seq" in df.columns else F.lit(default_seq)
        return df.select(*VECTOR_KEY, *VECTOR_COLS, "created_at", seq.cast("bigint").alias("seq"),
                         F.lit(arriving).alias("arriving"))

    both = shaped(existing, -1, False).unionByName(shaped(batch, 0, True))
    latest = F.max_by(F.struct(*VECTOR_COLS, "seq"), F.struct("updated_at", "seq"))
    first = F.min_by("created_at", F.struct("arriving", "updated_at", "seq"))
    merged = both.groupBy(*VECTOR_KEY).agg(latest.alias("v"), first.alias("created_at"))
    extra = ["v.seq"] if keep_seq else []
    return merged.select(*VECTOR_KEY, "v.platform", "v.model", "v.dimensions", "v.vector",
                         "created_at", "v.updated_at", *extra)


def lookup_vectors(vectors: DataFrame, keys: DataFrame) -> DataFrame:
    """Batch look-up by key table (a join, not point reads)."""
    return vectors.join(keys.select(*VECTOR_KEY).distinct(), VECTOR_KEY, "inner")


def truncate_vectors(vectors: DataFrame, dims: int, renormalize: bool = True) -> DataFrame:
    """Keep the first ``dims`` values (0 = keep all); optionally rescale to unit
    length.  Vectors already within ``dims`` are left untouched."""
    if dims <= 0:
        return vectors
    cut = F.slice("vector", 1, dims)
    if renormalize:
        norm = F.sqrt(F.aggregate(cut, F.lit(0.0).cast("double"),
                                  lambda acc, x: acc + x.cast("double") * x.cast("double")))
        cut = F.when(norm > 0, F.transform(cut, lambda x: (x.cast("double") / norm).cast("float"))) \
            .otherwise(cut)
    v = F.when(F.size("vector") > dims, cut).otherwise(F.col("vector"))
    return vectors.withColumn("vector", v).withColumn("dimensions", F.size("vector").cast("bigint"))


def vector_health(vectors: DataFrame) -> DataFrame:
    """Per (entity_type, model, dimensions): counts, empty vectors, dimension
    mismatches, and how many models the entity type mixes."""
    per = vectors.groupBy("entity_type", "model", "dimensions").agg(
        F.count("*").alias("vectors"),
        F.count(F.when(F.coalesce(F.size("vector"), F.lit(0)) <= 0, 1)).alias("empty_vectors"),
        F.count(F.when(F.size("vector") != F.col("dimensions"), 1)).alias("dimension_mismatch"))
    models = per.groupBy("entity_type").agg(F.countDistinct("model").cast("int").alias("models_for_type"))
    return per.join(models, "entity_type")


def _falsy(c: Column) -> Column:
    return c.isNull() | (c == "") | (c == "0")


def save_condition(tasks: DataFrame) -> DataFrame:
    """Embedding results are stored only when the task context names a
    non-empty entity_type and entity_id ('0' and 0 count as empty)."""
    ctx = F.coalesce(F.from_json("context", "map<string,string>"), F.create_map().cast("map<string,string>"))
    et = F.try_element_at(ctx, F.lit("entity_type"))
    eid = F.try_element_at(ctx, F.lit("entity_id"))
    return tasks.where(F.col("task_type") == "embedding").select(
        "task_id", et.alias("entity_type"), eid.alias("entity_id"),
        (~_falsy(et) & ~_falsy(eid)).alias("save"))


def clear_vectors(vectors: DataFrame, predicate: Column | None) -> DataFrame:
    """Drop vectors matching ``predicate``; refuses to run without one."""
    if predicate is None:
        raise ValueError("clear_vectors needs an explicit predicate (use F.lit(True) to clear all)")
    return vectors.where(~F.coalesce(predicate, F.lit(False)))


# -- kernels of the searches ------------------------------------------------------------

def _by_dimension(vectors: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row indices and unit-length rows per vector dimension (zero/NULL/empty
    vectors are left out: they have no direction to compare)."""
    groups: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, v in enumerate(vectors):
        if v is None:
            continue
        m = np.asarray(v, dtype=np.float64)
        n = np.sqrt(np.dot(m, m)) if m.size else 0.0
        if n > 0:
            groups.setdefault(m.shape[0], []).append((i, m / n))
    return {d: (np.array([i for i, _ in rows]), np.vstack([r for _, r in rows])) for d, rows in groups.items()}


def _topk_indices(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) pairs of the best ``k`` per row by (score desc, id asc),
    vectorised; only rows with a tie at the k-th score take the exact path."""
    nq, nv = sims.shape
    if nv <= k:
        cand = np.tile(np.arange(nv), (nq, 1))
    else:
        cand = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    cs = np.take_along_axis(sims, cand, axis=1)
    order = np.lexsort((ids[cand], -cs), axis=1)
    cand = np.take_along_axis(cand, order, axis=1)
    rows = [np.repeat(np.arange(nq), cand.shape[1])]
    cols = [cand.reshape(-1)]
    if nv > k:
        kth = cs.min(axis=1)
        tied = np.nonzero((sims >= kth[:, None]).sum(axis=1) > k)[0]
        if len(tied):
            drop = np.isin(rows[0], tied)
            rows, cols = [rows[0][~drop]], [cols[0][~drop]]
            for r in tied:
                idx = np.nonzero(sims[r] >= kth[r])[0]
                best = idx[np.lexsort((ids[idx], -sims[r, idx]))[:k]]
                rows.append(np.full(len(best), r))
                cols.append(best)
    return np.concatenate(rows), np.concatenate(cols)


# -- k-means step of the approximate index (operators/ann.py) --------------------------

def _refine_centroids(v: DataFrame, cents: np.ndarray, iterations: int) -> np.ndarray:
    """Spherical k-means steps run by Spark: each Arrow batch assigns its unit
    vectors to the nearest centroid and emits one partial sum per centroid;
    Spark adds the partial sums per (centroid, position), and only the
    ``n_lists x dim`` result (bounded by the parameters) returns to the driver.
    A centroid that attracts no vector keeps its position."""
    dim = cents.shape[1]
    for _ in range(iterations):
        unit_c = cents / np.maximum(np.linalg.norm(cents, axis=1, keepdims=True), 1e-30)

        def run(batches, unit_c=unit_c):
            for pdf in batches:
                groups = _by_dimension(pdf["vector"])
                if dim not in groups:
                    continue
                _, unit = groups[dim]
                best = np.argmax(unit @ unit_c.T, axis=1)
                sums = np.zeros_like(unit_c)
                np.add.at(sums, best, unit)
                present = np.nonzero(np.bincount(best, minlength=len(unit_c)))[0]
                yield pd.DataFrame({"list_id": present.astype(np.int64),
                                    "s": [sums[i].tolist() for i in present]})

        partial = v.select("vector").mapInPandas(run, "list_id long, s array<double>")
        totals = partial.select("list_id", F.posexplode("s").alias("pos", "x")) \
            .groupBy("list_id", "pos").agg(F.sum("x").alias("x")).collect()
        new = cents.copy()
        for r in totals:
            new[r.list_id, r.pos] = r.x
        cents = new
    return cents


def stale_vectors(vectors: DataFrame, changes: DataFrame) -> DataFrame:
    """Vectors older than the latest change of their entity (re-embedding
    candidates).  ``changes``: (entity_type, entity_id, changed_at); the
    latest change per entity is found by partial aggregation first."""
    latest = changes.groupBy("entity_type", "entity_id").agg(F.max("changed_at").alias("changed_at"))
    return vectors.join(latest, ["entity_type", "entity_id"]) \
        .where(F.col("changed_at") > F.col("updated_at")) \
        .select("entity_type", "entity_id", "store_id", "updated_at", "changed_at")
