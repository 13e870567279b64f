import math
import random
import re
from collections import defaultdict

from tokenloom.llm import jaccard as j


def brute(rows):
    sets = defaultdict(set)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    ids = sorted(sets)
    label = {i: i for i in ids}
    links = {i: 0 for i in ids}
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            u = len(sets[a] | sets[b])
            if sets[a] == sets[b] or (u and len(sets[a] & sets[b]) >= 0.8 * u):
                links[a] += 1
                links[b] += 1
                low, high = sorted((label[a], label[b]))
                label = {i: low if v == high else v for i, v in label.items()}
    return {i: (label[i], links[i]) for i in ids}


def test_classes_and_links_match_brute_force(docs):
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.class_id, r.n_links) for r in j.near_duplicates(docs).collect()}
    assert got == want


def test_dense_group_of_near_copies_is_one_class(spark):
    base = [f"word{i}" for i in range(120)]
    rows = [(n, " ".join(base[:n % 100] + [f"new{n}"] + base[n % 100 + 1:])) for n in range(150)]
    rows += [(1000 + n, " ".join(f"other{n}x{i}" for i in range(60))) for n in range(30)]
    got = {r.doc_id: r for r in j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[n].class_id for n in range(150)} == {0}
    assert all(got[1000 + n].class_id == 1000 + n and got[1000 + n].n_links == 0 for n in range(30))


def test_odd_rows(odd_docs, no_docs):
    got = {r.doc_id: (r.class_id, r.n_links) for r in j.near_duplicates(odd_docs).collect()}
    assert got[1] == got[2] == got[3] == (1, 2)
    assert got[6] == got[7] == (6, 1) and got[4] == (4, 0) and got[5] == (5, 0)
    assert got[None] == (None, 0)
    kept = j.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 5, 6, 8]
    assert j.near_duplicates(no_docs).count() == 0 and j.deduplicate(no_docs).count() == 0


def edited_copies(copies, words, edits):
    """An original (doc_id 0) and copies with random words of it replaced, all differently."""
    rng = random.Random(5)
    base = [f"word{i}" for i in range(words)]
    rows = [(0, " ".join(base))]
    for n in range(1, copies + 1):
        w = list(base)
        for k in rng.sample(range(words // 6), edits):
            w[6 * k + 2] = f"new{n}x{k}"
        rows.append((n, " ".join(w)))
    return rows


def test_original_with_600_edits_matches_brute_force(spark):
    # 4 edits x 5 shingles of 200: copies at 180/220 = 0.82 to the original, below 0.8 to most others.
    rows = edited_copies(600, 204, 4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in
           j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert want[0] == (0, 600) and got == want


def test_dense_group_counts_every_link(spark):
    # 2 edits of 200 shingles: nearly all copies reach 0.8 to each other.
    rows = edited_copies(600, 204, 2)
    got = {r.doc_id: (r.class_id, r.n_links) for r in
           j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    short = {i for i in want if got[i] != want[i]}
    assert want[0] == (0, 600) and sum(n for _, n in got.values()) >= 0.999 * sum(n for _, n in want.values()), short


def test_screen_is_part_of_the_recall():
    need = math.ceil(j.SCREEN * j.COORDS)
    passes = sum(math.comb(j.COORDS, k) * 0.8 ** k * 0.2 ** (j.COORDS - k) for k in range(need, j.COORDS + 1))
    assert passes > 1 - 1e-6 and j.recall(j.RUNS) >= j.RECALL
