"""Duplicate and leak stages of the pipeline against plain Python."""

import collections
import math
import random

import corpus_pipeline as p

from .test_pairs import brute, edited_copies


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def leaks(rows, items):
    """Documents with a window that holds 80 % of an item in order, or 55 % and its rarest words."""
    texts = {i: t.split() for i, t in rows}
    seen = collections.Counter(w for t in texts.values() for w in set(t))
    found = set()
    for _, text in items:
        w = text.split()
        rare = sorted(set(w), key=lambda x: seen[x])
        answer = set(rare[:-(-len(rare) // 5)])
        assert len(rare) == len(answer) or seen[rare[len(answer) - 1]] < seen[rare[len(answer)]]   # no ties
        size = 16
        while size < len(w) + 7:
            size = math.ceil(size * 1.5 / 8) * 8
        for i, t in texts.items():
            for k in range(0, len(t), 8):
                window = t[k:k + size]
                if len(set(w) & set(window)) >= 0.55 * len(set(w)):
                    share = lcs(w, window) / len(w)
                    if share >= 0.8 or share >= 0.55 and len(answer & set(window)) >= 0.75 * len(answer):
                        found.add(i)
    return found


def test_copies_and_paraphrases(spark, tmp_path):
    rng = random.Random(9)
    rows = edited_copies(300, 204, 4)
    items = [(i, " ".join([f"rare{i}x{k}" if k % 5 == 0 else f"item{i}x{k}" for k in range(40)])) for i in range(12)]
    for i, text in items:
        w = text.split()
        for share in (0.5, 0.6, 0.7, 0.85):
            kept = [x if k % 5 == 0 or rng.random() < (share - 0.2) / 0.8 else f"{rng.choice(items)[1].split()[k]}"
                    for k, x in enumerate(w)]
            fill = [f"fill{rng.randrange(10 ** 6)}" for _ in range(160)]
            rows.append((1000 + len(rows), " ".join(fill[:80] + kept + fill[80:])))
    # The rare words of an item occur in fewer documents than its other words.
    rows += [(5000 + i, " ".join(x for x in text.split() if x.startswith("item")) + " " + " ".join(f"tail{i}x{k}" for k in range(40)))
             for i, text in items]
    rows += [(6000 + 10 * i + n, " ".join(f"alone{i}x{n}x{k} {x}" + f" gap{n}x{i}x{k}" * 6 for k, x in enumerate(text.split()) if k % 5))
             for i, text in items for n in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(p.STAGES)
    kept = stages["n-gram Jaccard join"](spark, docs, str(tmp_path))
    want = {i for i, (c, _) in brute(rows).items() if i == c}
    assert {r.doc_id for r in kept.collect()} == want
    left = stages["benchmark decontamination"](spark, kept.select("doc_id", "text"), str(tmp_path))
    gone = leaks([r for r in rows if r[0] in want], items)
    assert len(gone) > 20 and {r.doc_id for r in left.collect()} == want - gone
