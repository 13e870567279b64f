"""Operator 12 against a row-by-row replay of every order."""

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from tokenloom.llm import interactions as op

SCHEMA = "doc_id long, source string, text string"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = {s or "" for _, s, _ in rows}
    out = Counter()
    for d, s, t in rows:
        s, t = s or "", t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": any((u or "") == t and e is not None and d is not None and e < d for e, _, u in rows)}
        for order in permutations("ABCDE"):
            gone = False
            for i, f in enumerate(order):
                at = (s, "".join(order), i + 1)
                if fails[f]:
                    out[at, "redundant" if gone else "removed"] += 1
                    out[at, "unique_fails"] += sum(fails.values()) == 1
                    if not gone:
                        out[at, "good_lost"] += d in good
                        out[at, "toxic_lost"] += d in toxic
                        out[s, f] += 1
                    gone = True
                out[at, "kept"] += not gone
    return {(p, "".join(o), i + 1): tuple(out[(p, "".join(o), i + 1), m] for m in op.MEASURES) + (out[p, f],)
            for p in parts for o in permutations("ABCDE") for i, f in enumerate(o)}


def rows_of(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[m] for m in (*op.MEASURES, "shapley"))
            for r in df.collect()}


def check(spark, rows, labels):
    got = op.op12(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(labels, LABELS))
    assert got.count() == 600 * len({s or "" for _, s, _ in rows})
    assert rows_of(got) == brute(rows, labels)


def test_every_mask_and_odd_rows(spark):
    plain = " ".join(f"word{i}" for i in range(60))
    repeated, upper, marked = "same " * 60, plain + " " + "A" * 60, plain + " # x"
    texts = [plain, repeated, upper, marked, "short", "SHORT", "a # b", repeated + "%", "word " * 20, "", None, " \t\n",
             " ".join(f"w{i % 977}x{i}" for i in range(20_000)), repeated + "A" * 50 + "&", "A B " * 40 + "|"]
    rows = [(i, ("s0", "s1", None, "")[i % 4], t) for i, t in enumerate(texts)]
    rows += [(50 + i, ("s0", "s1", None, "")[i % 3], t) for i, t in enumerate(texts)]      # later copies elsewhere
    rows += [(70, "s0", plain), (70, "s0", plain), (70, "s1", plain)]                         # repeated rows and ids
    rows += [(None, "s0", plain), (None, "s2", "only null ids"), (None, "s2", "only null ids")]
    rows += [(200 + i, "hot", "one text for all of a hot source") for i in range(60)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 80, 2)]
    labels += [(0, 1, 1), (0, 0, 0), (50, 1, None), (None, 1, 1), (999, 1, 1), (70, None, 1)]
    check(spark, rows, labels)


def test_smallest_copy_across_parts(spark):
    rows = [(9, "a", "t"), (8, "b", "t"), (8, "c", "t"), (10, "c", "t"), (-3, "d", "u"), (5, "a", "u")]
    check(spark, rows, [(8, 1, 0), (9, 0, 1)])


def test_empty_tables(spark):
    none, no_labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert op.op12(none, no_labels).collect() == []
    check(spark, [(1, None, None)], [])


def test_extra_columns_change_nothing(spark):
    docs = spark.createDataFrame([(1, "a", "x y"), (2, "a", "x y")], SCHEMA)
    labels = spark.createDataFrame([(2, 1, 1)], LABELS)
    odd = docs.withColumns({c: F.lit("?") for c in ("part", "mask", "digest", "n", "good", "toxic", "quality", "l_id")})
    assert rows_of(op.op12(odd, labels.withColumn("text", F.lit(1)))) == rows_of(op.op12(docs, labels))


def test_identities(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = op.op12(docs, spark.read.parquet(f"{small}/labels.parquet")).toPandas()
    size = dict(docs.groupBy("source").count().collect())
    for (part, _), g in got.sort_values("step").groupby(["part", "filter_order"]):
        assert g.removed.sum() + g.kept.iloc[-1] == size[part]
        # Shapley shares of the five filters add up to what any order removes.
        assert g.shapley.sum() == 120 * g.removed.sum()


def test_no_python_workers_in_the_plan(spark, small):
    got = op.op12(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
