"""Operator 11: embedding whitening from the Cholesky factor of the scatter.

The fit list is each distinct grid vector ``x = floor(256 * c)`` once.  Three
passes over it, each a small partial per task: exact integer sums; the scatter of
the centred vectors (centred before multiplying); the covariance of the whitened
vectors.  The scatter's triangular factor comes from Cholesky with diagonal
pivots.  One-sided Jacobi turns the factor's columns until they are orthogonal:
then their squared norms are the covariance's eigenvalues and the normalised
columns, rows put back in place, its eigenvectors.  The covariance is never
diagonalised itself, so small eigenvalues keep their relative precision.

What leaves the tasks is bounded by the dimension d: sums (d), scatter rows
(d x d, merged row by row), components (d x components).

Defined results: vectors that are null or hold null or non-finite entries are
dropped.  Each vector length is a space of its own with its own n, sums and
components; empty vectors have no components and so no rows.  Components exist
only along directions with a positive eigenvalue (at most n - 1, none for a
single distinct vector).  Equal eigenvalues: any orthonormal basis, the same for
all rows.  Entries beyond 64-bit integers saturate; a deviation beyond them is
null.  Repeated rows and null or repeated ids each give their rows.  An empty
table gives no rows.  Rows travel as one struct, so extra columns of any name pass.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, LongType, StructField, StructType)

from tokenloom.llm.common import materialise

COMPONENTS = 4
GRID = 256
EPS = np.finfo(np.float64).eps
INT_MIN, INT_MAX = -(1 << 63), (1 << 63) - 1
HELD_CELLS = 8 << 20      # scatter cells that a task holds before it writes them
SWEEPS = 100

Batches = Iterator[pa.RecordBatch]


# --- the grid -------------------------------------------------------------

def grid_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of x) of a column's usable vectors, by length."""
    valid = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    lengths = pc.list_value_length(column).drop_null().to_numpy().astype(np.int64)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)   # null entries: nan
    starts = np.cumsum(lengths) - lengths
    bad = np.zeros(len(valid), dtype=bool)
    bad[np.repeat(np.arange(len(valid)), lengths)[~np.isfinite(flat)]] = True
    for d in np.unique(lengths[~bad]):
        rows = np.flatnonzero((lengths == d) & ~bad)
        with np.errstate(over="ignore"):
            y = np.floor(GRID * flat[starts[rows, None] + np.arange(d)])
        x = np.clip(y, -2.0 ** 63, 2.0 ** 62).astype(np.int64)
        high = y > 2.0 ** 62
        if high.any():
            x[high] = [min(int(v), INT_MAX) if np.isfinite(v) else INT_MAX for v in y[high]]
        yield valid[rows], x


def _keys(batches: Batches) -> Batches:
    """Grid vectors as bytes: entry width, then the entries in that width."""
    for batch in batches:
        for _, x in grid_rows(batch.column(0)):
            d = x.shape[1]
            if d == 0:
                continue
            low, high = x.min(axis=1), x.max(axis=1)
            width = np.select([(low >= -(1 << 8 * w - 1)) & (high < 1 << 8 * w - 1) for w in (1, 2, 4)], [1, 2, 4], 8)
            for w in np.unique(width):
                raw = x[width == w].astype(f"<i{w}").tobytes()
                head, step = bytes([w]), d * int(w)
                keys = [head + raw[i:i + step] for i in range(0, len(raw), step)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d] * len(keys), pa.int32()), pa.array(keys, pa.binary())], names=["dims", "key"])


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(length, matrix of x) of a batch of keys."""
    held: dict[tuple[int, int], list[bytes]] = defaultdict(list)
    for d, key in zip(batch.column("dims").to_pylist(), batch.column("key").to_pylist()):
        held[d, key[0]].append(key[1:])
    for (d, w), keys in held.items():
        yield d, np.frombuffer(b"".join(keys), f"<i{w}").reshape(-1, d).astype(np.int64)


def fit_list(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Each distinct grid vector once (dims, key), written and reread."""
    keys = vectors.select(F.col(column).cast("array<double>")).mapInArrow(_keys, "dims int, key binary")
    return materialise(keys.distinct(), "whitening-fit")


# --- statistics of the fit list -------------------------------------------

@dataclass
class Space:
    """Sums, and later components, of the vectors of one length."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray | None = None      # falling
    vectors: np.ndarray | None = None          # dims x components
    trace: float = 0.0
    identity_error: float = 0.0

    def scaled(self, x: np.ndarray) -> np.ndarray | None:
        """n*x - S, where 64-bit integers hold it."""
        reach = max(-int(x.min()), int(x.max()), 1)
        if self.n * reach + max(map(abs, self.sums)) > INT_MAX:
            return None
        return self.n * x - np.array(self.sums, dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n as doubles."""
        whole = self.scaled(x)
        if whole is not None:
            return whole / self.n
        return x.astype(np.float64) - np.array([float(Fraction(s, self.n)) for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n*x - S)^2 (None where 64 bits don't hold one)."""
        whole = self.scaled(x)
        if whole is not None:
            most = max(-int(whole.min()), int(whole.max()))
            if most * most * x.shape[1] <= INT_MAX:
                return (whole * whole).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v <= INT_MAX else None for v in exact]


def _sums(batches: Batches) -> Batches:
    count: dict[int, int] = defaultdict(int)
    total: dict[int, list[int]] = {}
    for batch in batches:
        for d, x in _matrices(batch):
            safe = int(np.abs(x.astype(np.float64)).max()) * len(x) < 1 << 62
            part = x.sum(axis=0).tolist() if safe else [sum(c) for c in x.T.tolist()]
            total[d] = [a + b for a, b in zip(total.get(d, [0] * d), part)]
            count[d] += len(x)
    for d, s in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d], pa.int32()), pa.array([count[d]], pa.int64()),
             pa.array([[Decimal(v) for v in s]], pa.list_(pa.decimal128(38, 0)))], names=["dims", "n", "s"])


def moments(fit: DataFrame) -> dict[int, Space]:
    """n and exact sums per vector length."""
    parts = fit.mapInArrow(_sums, "dims int, n long, s array<decimal(38,0)>")
    rows = parts.select("dims", "n", F.posexplode("s").alias("pos", "s")).groupBy("dims", "pos") \
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dims", "pos").collect()
    spaces: dict[int, Space] = {}
    for r in rows:
        spaces.setdefault(r["dims"], Space(r["n"], [])).sums.append(int(r["s"]))
    return spaces


def scatter(fit: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """Rows (dims, pos, row) of the centred scatter, merged over all tasks."""
    known = fit.sparkSession.sparkContext.broadcast(spaces)

    def partial(batches: Batches) -> Batches:
        held: dict[int, np.ndarray] = {}
        task = TaskContext.get().partitionId()

        def flush() -> Batches:
            for d, g in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([task] * d, pa.int32()),
                     pa.array(list(g), pa.list_(pa.float64()))], names=["dims", "pos", "task", "row"])
            held.clear()

        for batch in batches:
            for d, x in _matrices(batch):
                z = known.value[d].centred(x)
                g = z.T @ z
                held[d] = held[d] + g if d in held else g
                if sum(m.size for m in held.values()) > HELD_CELLS:
                    yield from flush()
        yield from flush()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack(group.sort_values("task", kind="stable")["row"].to_list())
        return pd.DataFrame({"dims": group["dims"].iloc[:1].to_numpy(), "pos": group["pos"].iloc[:1].to_numpy(),
                             "row": [rows.sum(axis=0)]})

    return fit.mapInArrow(partial, "dims int, pos int, task int, row array<double>") \
        .groupBy("dims", "pos").applyInPandas(merge, "dims int, pos int, row array<double>")


# --- Cholesky and Jacobi --------------------------------------------------

def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order) with v[order][:, order] = factor @ factor.T; the factor
    is lower triangular with as many columns as the numerical rank."""
    d = len(v)
    order, factor, left = np.arange(d), np.zeros((d, d)), v.diagonal().astype(np.float64).copy()
    least = d * EPS * left.max(initial=0.0)
    for k in range(d):
        p = k + int(np.argmax(left[k:]))
        if not left[p] > least:
            return factor[:, :k], order
        for a in (order, factor, left):
            a[[k, p]] = a[[p, k]]
        factor[k, k] = np.sqrt(left[k])
        below = v[order[k + 1:], order[k]] - factor[k + 1:, :k] @ factor[k, :k]
        factor[k + 1:, k] = below / factor[k, k]
        left[k + 1:] -= factor[k + 1:, k] ** 2
    return factor, order


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The factor turned from the right until its columns are orthogonal.

    A sweep meets every pair of columns once, in rounds of disjoint pairs (a
    round-robin), so one round's rotations are done together."""
    a = factor.copy()
    r = a.shape[1]
    seats = np.arange(r + r % 2)
    for _ in range(SWEEPS if r > 1 else 0):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            p, q = seats[:half], seats[half:][::-1]
            real = (p < r) & (q < r)
            p, q = p[real], q[real]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            scale = np.sqrt(alpha * beta)
            cosine = np.divide(np.abs(gamma), scale, out=np.zeros_like(scale), where=scale > 0)
            worst = max(worst, float(cosine.max(initial=0.0)))
            turn = cosine > EPS
            if turn.any():
                p, q, x, y = p[turn], q[turn], x[:, turn], y[:, turn]
                zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
            seats = np.r_[seats[:1], seats[-1:], seats[1:-1]]
        if worst <= EPS * len(a):
            break
    return a


def principal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, eigenvectors as columns) of a covariance matrix."""
    factor, order = pivoted_cholesky(v)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned * turned).sum(axis=0))
    rank = np.argsort(-norms, kind="stable")
    rank = rank[norms[rank] > 0]
    vectors = np.empty((len(v), len(rank)))
    vectors[order] = turned[:, rank] / norms[rank]
    if len(rank):   # the largest entry of each is positive
        vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(rank))] < 0, -1.0, 1.0)
    return norms[rank] ** 2, vectors


def components(rows: DataFrame, spaces: dict[int, Space], limit: int = COMPONENTS) -> None:
    """Fill in each space's trace and its first components (solved in one task
    per vector length; d x d values)."""
    known = rows.sparkSession.sparkContext.broadcast({d: s.n for d, s in spaces.items()})

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        d = int(group["dims"].iloc[0])
        v = np.stack(group.sort_values("pos")["row"].to_list()) / known.value[d]
        values, vectors = principal((v + v.T) / 2)
        k = min(limit, len(values))
        return pd.DataFrame({"dims": [d], "trace": [float(np.trace(v))], "eigenvalues": [values[:k]],
                             "vectors": [vectors[:, :k].ravel()]})

    solved = rows.groupBy("dims").applyInPandas(
        solve, "dims int, trace double, eigenvalues array<double>, vectors array<double>")
    for r in solved.collect():
        s = spaces[r["dims"]]
        s.trace, s.eigenvalues = r["trace"], np.array(r["eigenvalues"], dtype=np.float64)
        s.vectors = np.array(r["vectors"], dtype=np.float64).reshape(r["dims"], len(s.eigenvalues))


def check_identity(fit: DataFrame, spaces: dict[int, Space]) -> None:
    """Fill in the largest entry of (covariance of the whitened fit list - identity)."""
    known = fit.sparkSession.sparkContext.broadcast(spaces)

    def pool(parts: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
        """Merge (count, mean, centred products) of disjoint sets of rows."""
        n, mean, m2 = next(parts)
        for k, other, more in parts:
            gap, both = other - mean, n + k
            mean, m2, n = mean + gap * (k / both), m2 + more + np.outer(gap, gap) * (n * k / both), both
        return n, mean, m2

    schema = "dims int, task int, n long, mean array<double>, m2 array<double>"

    def partial(batches: Batches) -> Batches:
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for d, x in _matrices(batch):
                w = known.value[d].whitened(x)
                mean = w.mean(axis=0)
                now = (len(w), mean, (w - mean).T @ (w - mean))
                held[d] = pool(iter([held[d], now])) if d in held else now
        task = TaskContext.get().partitionId()
        for d, (n, mean, m2) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d], pa.int32()), pa.array([task], pa.int32()), pa.array([n], pa.int64()),
                 pa.array([mean], pa.list_(pa.float64())), pa.array([m2.ravel()], pa.list_(pa.float64()))],
                names=["dims", "task", "n", "mean", "m2"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("task", kind="stable")
        k = len(group["mean"].iloc[0])
        n, _, m2 = pool((int(r["n"]), np.asarray(r["mean"]), np.asarray(r["m2"]).reshape(k, k))
                        for r in group.to_dict("records"))
        error = np.abs(m2 / n - np.eye(k)).max(initial=0.0)
        return pd.DataFrame({"dims": group["dims"].iloc[:1].to_numpy(), "error": [float(error)]})

    for r in fit.mapInArrow(partial, schema).groupBy("dims").applyInPandas(merge, "dims int, error double").collect():
        spaces[r["dims"]].identity_error = r["error"]


# --- interface ------------------------------------------------------------

def fit(vectors: DataFrame, column: str = "embedding", limit: int = COMPONENTS) -> dict[int, Space]:
    """The whitening model: one space per vector length."""
    distinct = fit_list(vectors, column)
    spaces = moments(distinct)
    if spaces:
        components(scatter(distinct, spaces), spaces, limit)
        check_identity(distinct, spaces)
    return spaces


def whiten(vectors: DataFrame, spaces: dict[int, Space], column: str = "embedding") -> DataFrame:
    """``row`` (all columns but the vector, as a struct) and its whitening: n,
    deviation, whitened and explained (one entry per component), identity_error."""
    known = vectors.sparkSession.sparkContext.broadcast(spaces)
    carried = StructType([f for f in vectors.schema.fields if f.name != column])
    doubles = ArrayType(DoubleType())
    schema = StructType([
        StructField("row", carried), StructField("n", LongType()), StructField("deviation", LongType()),
        StructField("whitened", doubles), StructField("explained", doubles),
        StructField("identity_error", DoubleType())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for rows, x in grid_rows(batch.column("vector")):
                space = known.value.get(x.shape[1])
                if space is None:
                    continue
                m = len(rows)
                explained = space.eigenvalues / space.trace if space.trace else np.empty(0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(rows)), pa.array([space.n] * m, pa.int64()),
                     pa.array(space.deviations(x), pa.int64()),
                     pa.array(list(space.whitened(x)), pa.list_(pa.float64())),
                     pa.array([explained] * m, pa.list_(pa.float64())),
                     pa.array([space.identity_error] * m, pa.float64())], names=schema.names)

    row = F.struct(*[vectors[c] for c in carried.names])
    return vectors.select(row.alias("row"), vectors[column].cast("array<double>").alias("vector")) \
        .mapInArrow(run, schema)


def op11(embeddings: DataFrame) -> DataFrame:
    vectors = embeddings.select("vec_id", "embedding")
    out = whiten(vectors, fit(vectors))
    return out.select("row.vec_id", "n", "deviation", "identity_error",
                      F.posexplode(F.arrays_zip("whitened", "explained")).alias("pos", "c")) \
        .select("vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation",
                "c.whitened", "c.explained", "identity_error")
