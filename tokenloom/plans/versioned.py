"""Keyed tables in immutable snapshots, with a manifest per version.

Rows are hashed by their key into buckets.  A merge reads the buckets that it
touches, writes their new contents to a fresh folder and then commits: one small
Parquet file per version lists the folder of every bucket.  That file appears by
one rename, so readers see the old version or the new one, a killed merge leaves
an unlisted folder only, and earlier versions stay readable until ``vacuum``.
Several tables with the same key can share one history: they change together.

Buckets split as in extendible hashing: a bucket is named by the low bits of its
rows' hash ("b", "b0", "b01", ...), and one that would outgrow ``max_rows`` hands
its rows on to the buckets of one or more further bits.  The bucket list lives in
the manifest, so table size never shows in a parameter, and a merge rewrites no
more than the touched buckets.  The driver holds the bucket list (rows /
``max_rows`` entries), never rows.

New rows can be appended: they lie in a further folder of their bucket and what it
holds stays where it is.  A bucket takes ``MAX_FOLDERS`` folders and ``MAX_GROWTH`` times
``max_rows``; beyond that, or by the next merge, it is written anew and split.

A merge may carry (source, batch): a batch number up to the last one applied from
that source is skipped, which makes a replayed micro-batch a no-op.  One writer at
a time; a second one's commit is detected and raised.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tokenloom.operators.util import bounded_broadcast

MAX_ROWS = 200_000
MAX_FOLDERS = 8
MAX_GROWTH = 4
ROOT_BUCKET = "b"
BUCKET_COL = "_bucket"
MANIFEST = ("commit string, bucket string, rows long, folders map<string,string>, keys array<string>, max_rows long, "
            "schemas map<string,string>, applied map<string,long>")

Table = DataFrame | Callable[[dict[str, DataFrame]], DataFrame]


@dataclass
class State:
    """One version as its manifest lists it."""

    version: int
    keys: list[str]
    max_rows: int
    schemas: dict[str, StructType]
    applied: dict[str, int]
    rows: dict[str, int] = field(default_factory=dict)                  # bucket -> rows of the first table
    folders: dict[str, dict[str, str]] = field(default_factory=dict)    # bucket -> table -> folders, by line


def _leaf(slot: int, buckets) -> str:
    label = ROOT_BUCKET
    while label not in buckets:
        label += str(slot >> (len(label) - 1) & 1)
    return label


def _children(bucket: str, bits: int) -> list[str]:
    return [bucket + "".join(str(i >> b & 1) for b in range(bits)) for i in range(1 << bits)]


class VersionedStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # -- manifests -------------------------------------------------------------

    def _manifests(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST + ", version long").parquet(f"{self.root}/manifests")

    def state(self, version: int | None = None) -> State:
        listed = self._manifests()
        if version is None:
            version = listed.agg(F.max("version")).first()[0]
        rows = listed.where(F.col("version") == F.lit(version)).collect()
        head = next((r for r in rows if r["bucket"] is None), None)
        if head is None:
            raise ValueError(f"no version {version} in {self.root}")
        state = State(version, list(head["keys"]), head["max_rows"],
                      {t: StructType.fromJson(json.loads(s)) for t, s in head["schemas"].items()}, dict(head["applied"]))
        for r in rows:
            if r["bucket"] is not None:
                state.rows[r["bucket"]], state.folders[r["bucket"]] = r["rows"], dict(r["folders"])
        return state

    def history(self) -> DataFrame:
        """version, buckets and rows of every version still listed."""
        return self._manifests().where(F.col("bucket").isNotNull()).groupBy("version").agg(
            F.count("*").alias("buckets"), F.sum("rows").alias("rows"))

    def _commit(self, state: State) -> int:
        commit = uuid.uuid4().hex
        schemas = {t: s.json() for t, s in state.schemas.items()}
        rows = [(commit, None, None, None, state.keys, state.max_rows, schemas, state.applied)]
        rows += [(commit, b, state.rows[b], state.folders[b], None, None, None, None) for b in sorted(state.rows)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite") \
            .parquet(f"{self.root}/manifests/version={state.version}")
        now = self._manifests().where(F.col("version") == F.lit(state.version)).select("commit").distinct().collect()
        if [r[0] for r in now] != [commit]:
            raise RuntimeError(f"another writer committed version {state.version} of {self.root}")
        return state.version

    # -- buckets ---------------------------------------------------------------

    def _labelled(self, df: DataFrame, state: State) -> DataFrame:
        """``df`` with the bucket of each row's key (in the table's types)."""
        bits = max(map(len, state.rows)) - 1
        if bits == 0:
            return df.withColumn(BUCKET_COL, F.lit(ROOT_BUCKET))
        directory = self.spark.createDataFrame([(i, _leaf(i, state.rows)) for i in range(1 << bits)],
                                               f"_slot long, {BUCKET_COL} string")
        types = next(iter(state.schemas.values()))
        slot = F.xxhash64(*[F.col(k).cast(types[k].dataType) for k in state.keys]).bitwiseAND(F.lit((1 << bits) - 1))
        return df.withColumn("_slot", slot).join(bounded_broadcast(directory), "_slot").drop("_slot")

    def _scan(self, table: str, state: State, buckets=None) -> DataFrame:
        paths = [f"{folder}/{BUCKET_COL}={b}" for b in sorted(buckets or state.folders)
                 if table in state.folders[b] for folder in state.folders[b][table].splitlines()]
        schema = state.schemas[table]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _write(self, state: State, tables: dict[str, Table | None], buckets: list[str],
               current: dict[str, DataFrame] | None = None) -> None:
        """New contents of ``buckets``, entered into ``state`` (None: as before, ``current``)."""
        snapshot = f"{self.root}/data/{state.version}-{uuid.uuid4().hex}"
        main = next(iter(state.schemas))
        for b in buckets:
            kept = {t: f for t, f in state.folders.get(b, {}).items() if tables[t] is None}
            state.folders[b] = kept
            if tables[main] is not None:
                state.rows[b] = 0
        for table, bucket, folder, n in self._stored(state, snapshot, tables, current):
            state.folders[bucket][table] = folder
            if table == main:
                state.rows[bucket] = n

    def _stored(self, state: State, snapshot: str, tables: dict[str, Table | None],
                current: dict[str, DataFrame] | None = None) -> list[tuple]:
        """Write tables by bucket, those that follow from others last; (table, bucket,
        folder, rows) of all that was written."""
        counts, new = [], dict(current or {})
        for table, df in sorted(tables.items(), key=lambda item: callable(item[1])):
            if df is None:
                continue
            if callable(df):
                df = df(new)
            folder, schema = f"{snapshot}/{table}", state.schemas[table]
            typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
            self._labelled(typed, state).repartition(BUCKET_COL).write.option("compression", "zstd") \
                .partitionBy(BUCKET_COL).parquet(folder)
            stored = self.spark.read.schema(StructType([*schema.fields, StructField(BUCKET_COL, StringType())])) \
                .parquet(folder)
            new[table] = stored.drop(BUCKET_COL)
            counts.append(stored.groupBy(BUCKET_COL).count().select(
                F.lit(table), BUCKET_COL, F.lit(folder), "count"))
        return [tuple(r) for r in reduce(DataFrame.union, counts).collect()] if counts else []

    # -- interface -------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, root: str, tables: dict[str, DataFrame], keys: list[str],
               max_rows: int = MAX_ROWS) -> VersionedStore:
        """Version 1; the first table's rows set the number of buckets."""
        store = cls(spark, root)
        n = next(iter(tables.values())).count()
        bits = max(0, math.ceil(math.log2(max(n, 1) / max_rows)))
        state = State(1, list(keys), max_rows, {t: df.schema for t, df in tables.items()}, {})
        store._write(state, tables, _children(ROOT_BUCKET, bits))
        store._commit(state)
        return store

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self._scan(table, self.state(version))

    def stored(self, table: str, keys: DataFrame, version: int | None = None) -> DataFrame:
        """All rows of the buckets that can hold one of ``keys``."""
        state = self.state(version)
        wanted = keys.select(*state.keys).distinct()
        hit = [r[0] for r in self._labelled(wanted, state).select(BUCKET_COL).distinct().collect()]
        return self._scan(table, state, hit) if hit else self.spark.createDataFrame([], state.schemas[table])

    def lookup(self, table: str, keys: DataFrame, version: int | None = None) -> DataFrame:
        """Rows with one of ``keys``; only the buckets that can hold them are read."""
        state = self.state(version)
        wanted = keys.select(*state.keys).distinct()
        rows = self.stored(table, wanted, state.version)
        return rows.join(bounded_broadcast(wanted), state.keys, "left_semi")

    def merge(self, changed: DataFrame, combine: Callable[[dict[str, DataFrame]], dict[str, Table]],
              source: str | None = None, batch: int | None = None) -> int:
        """Replace the buckets that ``changed``'s keys fall into.

        ``combine`` gets every table's present rows of those buckets and returns
        their new rows (keys must stay within them); for a table that follows from
        others' new rows, a function of these as they are stored.  Returns the version."""
        state = self.state()
        if source is not None and state.applied.get(source, -1) >= batch:
            return state.version
        arriving = self._labelled(changed.select(*state.keys).distinct(), state) \
            .groupBy(BUCKET_COL).count().collect()
        if not arriving and source is None:
            return state.version
        current = {t: self._scan(t, state, [b for b, _ in arriving]) if arriving else None for t in state.schemas}
        state.version += 1
        if source is not None:
            state.applied[source] = batch
        buckets: list[str] = []
        for b, n in arriving:
            bits = max(0, math.ceil(math.log2((state.rows[b] + n) / state.max_rows)))
            buckets += _children(b, bits)
            if bits:
                del state.rows[b], state.folders[b]
        if arriving:
            tables = combine(current)
            if len(buckets) == len(arriving):   # none splits: tables given back as they are stay where they are
                tables = {t: None if df is current[t] else df for t, df in tables.items()}
            self._write(state, tables, buckets, current)
        return self._commit(state)

    def append(self, table: str, rows: DataFrame, keys: DataFrame) -> int:
        """Add ``rows`` to ``table``; none of their ``keys`` may be in it.

        What the buckets hold is neither read nor written, unless one would outgrow its
        bounds.  Returns the version."""
        state = self.state()
        arriving = self._labelled(keys.select(*state.keys), state).groupBy(BUCKET_COL).count().collect()
        full = [b for b, n in arriving if state.rows[b] + n > MAX_GROWTH * state.max_rows
                or len(state.folders[b].get(table, "").splitlines()) >= MAX_FOLDERS]
        if full:
            return self.merge(keys, lambda now: {**now, table: now[table].unionByName(rows.select(*now[table].columns))})
        state.version += 1
        snapshot = f"{self.root}/data/{state.version}-{uuid.uuid4().hex}"
        for _, bucket, folder, n in self._stored(state, snapshot, {table: rows}) if arriving else []:
            known = state.folders[bucket].get(table)
            state.folders[bucket][table] = f"{known}\n{folder}" if known else folder
            state.rows[bucket] += n
        return self._commit(state)

    def vacuum(self, keep: int = 2) -> None:
        """Forget all but the last ``keep`` versions and delete the folders that
        no kept version lists (those of killed merges included)."""
        versions = sorted(r[0] for r in self._manifests().select("version").distinct().collect())
        kept = versions[-keep:]
        used = {folder for v in kept for f in self.state(v).folders.values() for folder in f.values()}
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for v in versions[:-keep]:
            fs.delete(path(f"{self.root}/manifests/version={v}"), True)
        for status in fs.listStatus(path(f"{self.root}/data")):
            name = status.getPath().getName()
            if int(name.split("-")[0]) <= kept[-1] and not any(f"/{name}/" in f for f in used):
                fs.delete(status.getPath(), True)
