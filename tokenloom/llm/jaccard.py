"""Operator 2: n-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles (white-space words, case folded; a
text of one to four words is a single shingle).  Pairs of similarity 0.8 or
more are found as follows.

1. Documents with the same shingle set are one *text*, represented by their
   smallest doc_id; copies are never paired with each other.
2. Each text gets ``COORDS`` minhash coordinates.  Two sets agree in a
   coordinate with probability equal to their similarity, so the coordinates
   stand for tokens that similar sets share.
3. Chosen-path recursion, ``RUNS`` independent runs: a node's texts are split
   by the value of a coordinate sampled from (run, path); with 1/similarity
   branches per node on average (one always, a second now and then).  A bucket
   of at most ``SMALL`` texts leaves the recursion and is compared all against
   all; larger ones are split again, up to ``DEPTH`` levels.
4. Pairs of small buckets whose sizes and coordinates rule out the threshold
   (``SCREEN``) are dropped; the rest are verified exactly on the shingle sets.
5. What is larger than ``SMALL`` after the last split is a hot bucket.  Its
   texts are dealt into hashed blocks and each block meets each block in a
   group of its own, with the exact shingle sets and no screen.  A pair that
   shares hot buckets is counted in the first of them only, so the groups add
   up links per text and write no pairs, only who is connected to whom.

``RUNS`` follows from the recall of a pair at the threshold over all ``DEPTH``
splits, the screen and the shared coordinates included.

The result has one row per document: its class (smallest doc_id of the
connected component) and its number of links: verified linked texts, counted
with their copies, plus its own copies.

Defined results: null and blank texts have no shingles: they are copies of
each other (one class).  Rows that repeat a doc_id are judged as rows of one
document: equal rows collapse; a doc_id with different texts belongs to the
class of each, so these classes join.  A null doc_id is an id, the smallest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import materialise, mix64, smallest_row, words_of

SHINGLE = 5
THRESHOLD = 0.8
COORDS = 64
SMALL = 64
DEPTH = 3
RECALL = 0.9999
SCREEN = 0.5         # share of equal coordinates; a pair at the threshold falls below it once in 10^7
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 1 << 18   # of one block of a hot bucket
NO_ID = -(1 << 63)    # stands for a null doc_id inside the operator


def recall(runs: int) -> float:
    """Recall of a pair at the threshold: over the number of coordinates it
    shares, the chance that a run's branching reaches the last level."""
    found, extra = 0.0, 1 / THRESHOLD - 1
    for same in range(math.ceil(SCREEN * COORDS), COORDS + 1):
        p, lost = same / COORDS, 0.0
        for _ in range(DEPTH):
            gone = 1 - p + p * lost
            lost = (1 - extra) * gone + extra * gone ** 2
        found += math.comb(COORDS, same) * THRESHOLD ** same * (1 - THRESHOLD) ** (COORDS - same) * (1 - lost ** runs)
    return found


RUNS = next(r for r in range(1, 100) if recall(r) >= RECALL)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * COORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:COORDS] | np.uint64(1), seeds[COORDS:]


def shingle_hashes(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, flat and sorted per row, and their offsets."""
    offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
    flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    n_words = np.diff(offsets)
    n = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, (n_words > 0).astype(np.int64))
    size = len(flat)
    short = np.repeat(n_words < SHINGLE, n_words)
    h = np.zeros(size, dtype=np.uint64)
    row_end = np.repeat(offsets[1:], n_words)
    index = np.arange(size)
    for k in range(SHINGLE):
        at = np.minimum(index + k, size - 1) if size else index
        w = np.where(index + k < row_end, flat[at], np.uint64(0)) if size else flat
        h = h * np.uint64(0x100000001B3) + mix64(w + np.uint64(k + 1))
    h = mix64(h)
    first = np.zeros(size, dtype=bool)
    first[offsets[:-1][n_words > 0]] = True
    keep = np.where(short, first, index + SHINGLE <= row_end)
    rows = np.repeat(np.arange(len(n_words)), n)
    h = h[keep]
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    h, rows = h[fresh], rows[fresh]
    return h, np.r_[0, np.cumsum(np.bincount(rows, minlength=len(n_words)))]


def _row_slices(batch: pa.RecordBatch, max_words: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    lengths = pa.compute.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False)
    group = (np.cumsum(lengths) - lengths) // max_words
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
    for a, b in zip(starts, [*starts[1:], len(lengths)]):
        yield batch.slice(int(a), int(b - a))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mult, add = _coefficients()
    for batch in batches:
        for part in _row_slices(batch):
            h, off = shingle_hashes(part.column("words"))
            n = np.diff(off)
            sketch = np.full((part.num_rows, COORDS), 0xFFFFFFFF, dtype=np.uint32)
            some = np.flatnonzero(n)
            digest = _set_key(h, off)
            if len(some):
                for c in range(COORDS):
                    v = (h * mult[c] + add[c]) >> np.uint64(32)
                    sketch[some, c] = np.minimum.reduceat(v, off[:-1][some]).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                 pa.array([r.tobytes() for r in np.c_[sketch, n.astype(np.uint32)]], pa.binary())],
                names=["doc_id", "n", "d1", "d2", "sketch"])


def ident() -> Column:
    return F.coalesce("doc_id", F.lit(NO_ID))


def word_hashes(docs: DataFrame) -> DataFrame:
    words = words_of(F.lower("text"))
    return docs.select(ident().alias("doc_id"), F.transform(words, lambda w: F.xxhash64(w)).alias("words"))


def texts_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id -> text id, texts with sketch and copy count), written."""
    sketched = materialise(word_hashes(docs).mapInArrow(
        _sketch, "doc_id long, n long, d1 long, d2 long, sketch binary"), "jaccard-sketches")
    key = ["n", "d1", "d2"]
    ids = sketched.select("doc_id", *key).distinct()
    texts = ids.groupBy(*key).agg(F.min("doc_id").alias("text_id"), F.count(F.lit(1)).alias("copies"))
    # A doc_id may stand for several texts, so a text is named by its number.
    texts = materialise(texts.select(*key, "text_id", "copies", F.xxhash64(*key).alias("t")), "jaccard-texts")
    members = materialise(ids.join(texts.select(*key, "t"), key).select("doc_id", "t"), "jaccard-members")
    sketch = sketched.where("n > 0").select(F.xxhash64(*key).alias("t"), "sketch")
    return members, texts.select("t", "text_id", "copies", "n"), sketch


def _matrix(column: pa.Array) -> np.ndarray:
    """Coordinates of each row, the last column is the set's size."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDS + 1)


def _children(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """Rows of the next level: (bucket, t) for each sampled coordinate of a
    node, with the sketch from the second level on."""
    extra = 1 / THRESHOLD - 1
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sketch = _matrix(batch.column("sketch"))
        t = batch.column("t").to_numpy()
        if level == 0:
            nodes = [np.full(len(t), np.uint64(r + 1)) for r in range(RUNS)]
        else:
            nodes = [batch.column("bucket").to_numpy().view(np.uint64)]
        for node in nodes:
            seed = mix64(node * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level))
            first = seed % np.uint64(COORDS)
            more = mix64(seed + np.uint64(1))
            second = (first + np.uint64(1) + more % np.uint64(COORDS - 1)) % np.uint64(COORDS)
            branch = (mix64(more) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53 < extra
            for coord, on in ((first, np.ones(len(t), dtype=bool)), (second, branch)):
                rows = np.flatnonzero(on)
                if not len(rows):
                    continue
                value = sketch[rows, coord[rows].astype(np.int64)].astype(np.uint64)
                bucket = mix64(mix64(node[rows] + value * np.uint64(31)) + coord[rows] + np.uint64(level * 131 + 1))
                columns = [pa.array(bucket.view(np.int64)), pa.array(t[rows])]
                if level:
                    columns.append(batch.column("sketch").take(pa.array(rows)))
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "t", "sketch"][:len(columns)])


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs whose sizes allow the threshold and whose coordinates promise it."""
    small, large = np.minimum(a[..., -1], b[..., -1]), np.maximum(a[..., -1], b[..., -1])
    return (small >= THRESHOLD * large) & ((a[..., :-1] == b[..., :-1]).mean(axis=-1) >= SCREEN)


def _pair_batch(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of one batch, smaller number first."""
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _pairs_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Promising pairs of a small bucket's members (at most SMALL of them)."""
    for batch in batches:
        left, right = [], []
        for members in batch.column("members"):
            ids = members.values.field("t").to_numpy()
            sketch = _matrix(members.values.field("sketch"))
            i, j = np.triu_indices(len(ids), 1)
            near = _near(sketch[i], sketch[j])
            left.append(ids[i[near]])
            right.append(ids[j[near]])
        yield from _pair_batch(left, right)


def candidate_pairs(sketch: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Distinct promising pairs of text numbers (a < b) of small buckets, and
    the rows (bucket, t) of hot ones if there are any.

    ``sketch``: t, sketch, one row per text."""
    rows = sketch.mapInArrow(lambda it: _children(it, 0), "bucket long, t long")
    found = hot = None
    for level in range(1, DEPTH + 1):
        rows = materialise(rows, f"jaccard-level{level}")
        # Written before the join, so that Spark may split a hot bucket's rows there.
        size = materialise(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"),
                           f"jaccard-size{level}")
        live = rows.join(size, "bucket")
        if level == 1:
            # Most buckets hold one text; only members of shared ones get their sketch.
            live = live.join(sketch, "t")
        live = materialise(live.select("bucket", "t", "sketch", "size"), f"jaccard-live{level}")
        pairs = live.where(F.col("size") <= SMALL).groupBy("bucket") \
            .agg(F.collect_list(F.struct("t", "sketch")).alias("members")) \
            .select("members").mapInArrow(_pairs_within, "a long, b long")
        found = pairs if found is None else found.unionByName(pairs)
        large = live.where(F.col("size") > SMALL)
        if large.isEmpty():
            break
        if level == DEPTH:
            hot = large.select("bucket", "t")
        rows = large.select("bucket", "t", "sketch") \
            .mapInArrow(lambda it, level=level: _children(it, level), "bucket long, t long, sketch binary")
    return found.distinct(), hot


def _set_key(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Two independent sums over each set; with its size they identify it."""
    digest = np.zeros((len(off) - 1, 2), dtype=np.uint64)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        digest[some, 0] = np.add.reduceat(mix64(h + np.uint64(11)), off[:-1][some])
        digest[some, 1] = np.add.reduceat(mix64(h * np.uint64(3) + np.uint64(7)), off[:-1][some])
    return digest.view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _row_slices(batch):
            h, off = shingle_hashes(part.column("words"))
            raw, key = h.tobytes(), _set_key(h, off)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.diff(off), pa.int64()), pa.array(key[:, 0]), pa.array(key[:, 1]),
                 pa.array([raw[8 * a:8 * b] for a, b in zip(off[:-1], off[1:])], pa.binary())],
                names=["n", "d1", "d2", "shingles"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sims = []
        for x, y in zip(batch.column("sa"), batch.column("sb")):
            p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            both = np.sort(np.concatenate([p, q]))
            inter = int((both[1:] == both[:-1]).sum())
            sims.append(inter / (len(p) + len(q) - inter))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())],
                                         names=["a", "b", "similarity"])


def sets_of(docs: DataFrame, texts: DataFrame, needed: DataFrame) -> DataFrame:
    """t, shingles of the texts in ``needed``, written."""
    needed = materialise(needed.distinct(), "jaccard-needed")
    # Only documents that stand for a text of some pair are read again.
    stand = materialise(texts.join(needed, "t", "left_semi").select(F.col("text_id").alias("doc_id")).distinct(),
                        "jaccard-standins")
    keyed = docs.select(ident().alias("doc_id"), "text").join(stand, "doc_id", "left_semi")
    sets = word_hashes(keyed).select("words") \
        .mapInArrow(_sets, "n long, d1 long, d2 long, shingles binary") \
        .select(F.xxhash64("n", "d1", "d2").alias("t"), "shingles").dropDuplicates(["t"])
    return materialise(sets, "jaccard-sets")


def verified_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with their exact similarity where it reaches the threshold."""
    checked = pairs.join(sets.select(F.col("t").alias("a"), F.col("shingles").alias("sa")), "a") \
        .join(sets.select(F.col("t").alias("b"), F.col("shingles").alias("sb")), "b") \
        .select("a", "b", "sa", "sb").mapInArrow(_verify, "a long, b long, similarity double")
    return checked.where(F.col("similarity") >= THRESHOLD)


def _common(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Number of values that each set of ``left`` shares with each of ``right``."""
    count = np.zeros((len(left), len(right)), dtype=np.float32)
    x, y = np.concatenate(left), np.concatenate(right)
    vocab = np.intersect1d(x, y)
    if left is right and len(vocab):
        values, times = np.unique(x, return_counts=True)
        vocab = values[times > 1]
    cells = []
    for flat, sets in ((x, left), (y, right)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(vocab, flat)
        hit = np.flatnonzero(at < len(vocab))
        hit = hit[vocab[at[hit]] == flat[hit]]
        order = hit[np.argsort(at[hit], kind="stable")]
        cells.append((row[order], at[order]))
    for low in range(0, len(vocab), width):
        dense = []
        for (row, at), sets in zip(cells, (left, right)):
            a, b = np.searchsorted(at, [low, low + width])
            m = np.zeros((len(sets), width), dtype=np.float32)
            m[row[a:b], at[a:b] - low] = 1
            dense.append(m)
        count += dense[0] @ dense[1].T
    if left is right:
        np.fill_diagonal(count, [len(s) for s in left])
    return count


def _linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    both = _common(left, right).astype(np.float64)
    union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - both
    return both / union >= THRESHOLD


def _heads(linked: np.ndarray) -> np.ndarray:
    """The first member of each member's connected component."""
    head = np.full(len(linked), -1)
    for i in range(len(linked)):
        edge = np.array([i]) if head[i] < 0 else np.array([], dtype=np.int64)
        while len(edge):
            head[edge] = i
            edge = np.flatnonzero(linked[edge].any(axis=0) & (head < 0))
    return head


def _block_pair(key, pdf):
    """One block against another (or itself): rows (a, a, its links here) and
    (a, b, 0) for members of one component."""
    import pandas as pd
    bucket, p, q = key
    t = pdf["t"].to_numpy()
    sets = [np.frombuffer(s, "<u8") for s in pdf["shingles"]]
    earlier = [np.asarray(h, dtype=np.int64) for h in pdf["hot"]]
    earlier = [h[h < bucket] for h in earlier]
    block = pdf["block"].to_numpy()
    x, y = np.flatnonzero(block == p), np.flatnonzero(block == q)
    linked = np.zeros((len(t), len(t)), dtype=bool)
    if len(x) and len(y):
        pick = lambda rows, of: [of[i] for i in rows]
        sx, ex = pick(x, sets), pick(x, earlier)
        sy, ey = (sx, ex) if p == q else (pick(y, sets), pick(y, earlier))
        linked[np.ix_(x, y)] = _linked(sx, sy) & (_common(ex, list(ey)) == 0)
    linked |= linked.T
    np.fill_diagonal(linked, False)
    links = linked @ pdf["copies"].to_numpy().astype(np.float64)
    some, head = np.flatnonzero(links), _heads(linked)
    tied = np.flatnonzero(head != np.arange(len(t)))
    return pd.DataFrame({"a": np.r_[t[some], t[tied]], "b": np.r_[t[some], t[head[tied]]],
                         "links": np.r_[links[some], np.zeros(len(tied))].astype(np.int64)})


def hot_links(hot: DataFrame, lists: DataFrame, texts: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, links) of all hot buckets, see ``_block_pair``; ``lists``: t, hot."""
    rows = materialise(hot.join(texts.select("t", "copies", "n"), "t"), "jaccard-hot")
    size = materialise(rows.groupBy("bucket").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("blocks")),
        "jaccard-hot-blocks")
    rows = materialise(rows.join(size, "bucket").select(
        "bucket", "t", "copies", "blocks", F.pmod(F.xxhash64("t", F.lit(5)), F.col("blocks")).alias("block")),
        "jaccard-hot-rows")
    dealt = rows.join(lists, "t").join(sets, "t") \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.select("bucket", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"),
                        "block", "t", "copies", "hot", "shingles") \
        .groupBy("bucket", "p", "q").applyInPandas(_block_pair, "a long, b long, links long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """t -> label: the smallest ``text_id`` that links reach.

    Smallest labels travel along links and along labels (pointer jumping);
    every round is written, and rounds stop when no label changes."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both, "jaccard-links")
    touched = both.select(F.col("a").alias("t")).distinct()
    labels = materialise(touched.select("t", F.col("t").alias("label")), "jaccard-labels")
    while True:
        near = both.join(labels, both["b"] == labels["t"]).groupBy("a").agg(F.min("label").alias("low"))
        step = labels.join(near, labels["t"] == near["a"], "left") \
            .select("t", "label", F.least("label", "low").alias("new"))
        jump = labels.select(F.col("t").alias("via"), F.col("label").alias("far"))
        step = step.join(jump, step["new"] == jump["via"], "left") \
            .select("t", F.least("new", "far").alias("label"),
                    (F.least("new", "far") < F.col("label")).alias("changed"))
        step = materialise(step, "jaccard-labels")
        moved = step.where("changed").isEmpty()
        labels = step.select("t", "label")
        if moved:
            break
    return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per doc_id: class_id, n_links, text_copies."""
    members, texts, sketch = texts_of(docs)
    sketch = materialise(sketch.groupBy("t").agg(F.min("sketch").alias("sketch")), "jaccard-coordinates")
    pairs, hot = candidate_pairs(sketch)
    pairs = materialise(pairs, "jaccard-candidates")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("t"))
    if hot is not None:
        lists = materialise(hot.groupBy("t").agg(F.sort_array(F.collect_list("bucket")).alias("hot")),
                            "jaccard-hot-lists")
        needed = needed.unionByName(lists.select("t"))
        # Pairs that share a hot bucket are counted there.
        of = lambda c: lists.select(F.col("t").alias(c), F.col("hot").alias(f"hot_{c}"))
        pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left") \
            .where(~F.coalesce(F.arrays_overlap("hot_a", "hot_b"), F.lit(False))).select("a", "b")
    sets = sets_of(docs, texts, needed)
    links = materialise(verified_links(pairs, sets), "jaccard-verified")
    near = links.select("a", "b")
    if hot is not None:
        dense = materialise(hot_links(hot, lists, texts, sets), "jaccard-hot-links")
        near = near.unionByName(dense.where("a != b").select("a", "b"))
    # Rows of one doc_id with different texts tie those texts together.
    first = members.groupBy("doc_id").agg(F.min("t").alias("a"), F.max("t").alias("z")).where("a < z")
    ties = members.join(first, "doc_id").where("t > a").select("a", F.col("t").alias("b"))
    labels = components(texts, near.unionByName(ties).distinct())
    named = texts.join(labels, "t", "left").withColumn("label", F.coalesce("label", "t"))
    low = named.groupBy("label").agg(F.min("text_id").alias("class_id"))
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.join(texts.select(F.col("t").alias("b"), F.col("copies").alias("far")), "b") \
        .select(F.col("a").alias("t"), "far")
    if hot is not None:
        degree = degree.unionByName(dense.where("a = b").select(F.col("a").alias("t"), F.col("links").alias("far")))
    degree = degree.groupBy("t").agg(F.sum("far").alias("links"))
    per_text = materialise(named.join(low, "label").join(degree, "t", "left").select(
        "t", "class_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "jaccard-texts-out")
    named_id = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return members.join(per_text, "t").groupBy("doc_id").agg(
        F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"), F.max("copies").alias("text_copies")) \
        .select(named_id("doc_id"), named_id("class_id"), "n_links", "text_copies")


def deduplicate(docs: DataFrame) -> DataFrame:
    """All columns (of any name and type) of the documents that are their class's
    smallest doc_id; rows that repeat a doc_id give one row, the smallest.  An
    empty table gives an empty one."""
    classes = materialise(near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(
        ident().alias("_keep")), "jaccard-keep")
    rows = docs.select(ident().alias("_ident"), F.struct("*").alias("row"))
    kept = rows.join(classes, F.col("_ident") == F.col("_keep"), "left_semi").select("row.*")
    return kept.groupBy(ident().alias("_group")).agg(smallest_row(kept).alias("_row")).select("_row.*")


def op2(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
