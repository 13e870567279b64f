"""Operator 6: benchmark decontamination by latent semantic retrieval.

1. Documents become word-hash sequences (letters and digits, case folded),
   written once.  Document frequencies are counted over all of them.
2. TF-IDF passages (``PASSAGE`` words) span a latent space: a randomised SVD
   with ``RANK + OVERSAMPLE`` random directions.  Tasks add up A'(A G) over
   their passages, Spark sums these per term, and the small factorisation of
   the sum (Nystroem form of the one-pass randomised eigenproblem of A'A) gives
   the right singular vectors.  Terms are the benchmark's words, so matrices on
   the driver are bounded by the benchmark block, not by the corpus.
3. Windows come in a few sizes and items are compared with the size that fits
   their length.  A window's cosine with an item in the latent space makes it a
   candidate from ``MIN_COSINE`` on.  Cosines are only taken where an inverted
   list of the item's rarest words says that the answer check of step 4 can hold;
   this drops no window that the checks accept, so a window without such words costs
   nothing.
4. A candidate is a leak if the longest common subsequence of item and window
   covers ``VERBATIM`` of the item, or ``PARAPHRASE`` of it and the answer
   check holds: ``ANSWER`` of the item's rarest words (its informative fifth)
   occur in the window.
5. Verbatim passages and short items don't hang on the cosine: of any 2m + 1
   rare words of an item a window that misses at most m words holds m + 1, and every
   such window is read too, but only a ``VERBATIM`` share counts there.

The benchmark is a stated query set, read in blocks of ``BLOCK`` items; each
block meets all documents.  Candidates are verified where they arise, so only
matches leave a task and nothing is shuffled but per-term sums.

Defined results: null or wordless texts and items match nothing; an item of
fewer than ``MIN_ITEM`` words is only matched verbatim in full; repeated
documents match each; an empty benchmark matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import materialise

PASSAGE = 64
RANK, OVERSAMPLE = 64, 16
STEP = 8                     # windows start every STEP words
BLOCK = 2000
MIN_ITEM = 6
CELLS = 1 << 18              # (word, item) hits held at a time
MIN_COSINE = 0.1             # measured recall with 200 items: 0.97 or more at every length and kept share
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.55, 0.75
SEED = 7


def word_sequences(docs: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """ident, words: 32-bit hashes of the text's words in order."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+")
    return docs.select(ident, F.transform(F.array_remove(parts, ""), lambda w: F.hash(w)).alias("words"))


class Items:
    """A block of benchmark items with their vocabulary."""

    def __init__(self, ids: list, words: list[np.ndarray]) -> None:
        self.ids, self.words = ids, words
        self.vocab = np.unique(np.concatenate(words)) if words else np.array([], dtype=np.int32)

    def terms(self, flat: np.ndarray) -> np.ndarray:
        """Vocabulary index of each word, -1 for others."""
        at = np.searchsorted(self.vocab, flat)
        at[at == len(self.vocab)] = 0
        return np.where(self.vocab[at] == flat, at, -1)


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    ids, words = [], []
    for r in word_sequences(benchmark.where(F.col("text").isNotNull()), "item_id").orderBy("item_id").toLocalIterator():
        if r["words"]:
            ids.append(r["item_id"])
            words.append(np.array(r["words"], dtype=np.int32))
        if len(ids) == BLOCK:
            yield Items(ids, words)
            ids, words = [], []
    if ids:
        yield Items(ids, words)


def _sequences(batch: pa.RecordBatch, max_words: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, flat words, row offsets) of slices of about ``max_words``."""
    n = pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(n):
        return
    group = (np.cumsum(n) - n) // max_words
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(n)]):
        part = batch.slice(a, b - a)
        flat = part.column("words").flatten().to_numpy(zero_copy_only=False)
        yield part, flat, np.r_[0, np.cumsum(n[a:b])]


def document_frequency(seqs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """Documents that contain each term, and the number of documents."""
    shared = seqs.sparkSession.sparkContext.broadcast(items)
    size = len(items.vocab)

    def run(batches):
        it = shared.value
        df, docs = np.zeros(size, dtype=np.int64), 0
        for batch in batches:
            for part, flat, off in _sequences(batch, 1 << 18):
                term = it.terms(flat)
                row = np.repeat(np.arange(part.num_rows), np.diff(off))
                hit = term >= 0
                df += np.bincount(np.unique(row[hit] * size + term[hit]) % size, minlength=size)
                docs += part.num_rows
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, used]), pa.array(np.r_[docs, df[used]])],
                                         names=["term", "n"])

    got = seqs.select("words").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df, docs = np.zeros(size), 0
    for r in got:      # one row per term of the block
        if r["term"] < 0:
            docs = r["n"]
        else:
            df[r["term"]] = r["n"]
    return df, docs


def _passages(off: np.ndarray, size: int) -> np.ndarray:
    """Start offsets of consecutive passages, none crossing a row."""
    n = np.diff(off)
    per = -(-n // size)
    first = np.repeat(off[:-1], per)
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    return first + k * size


def latent_space(seqs: DataFrame, items: Items, idf: np.ndarray) -> np.ndarray:
    """Right singular vectors (terms x RANK) of the TF-IDF passage matrix, each
    divided by its singular value."""
    size, width = len(items.vocab), min(RANK + OVERSAMPLE, len(items.vocab))
    random = np.random.default_rng(SEED).standard_normal((size, width))
    shared = seqs.sparkSession.sparkContext.broadcast(
        (items, idf.astype(np.float32), random.astype(np.float32)))

    def run(batches):
        it, weight, g = shared.value
        total = np.zeros((size, width))
        for batch in batches:
            for _, flat, off in _sequences(batch, 1 << 15):
                if not len(flat):
                    continue
                term = it.terms(flat)
                hit = np.flatnonzero(term >= 0)
                starts = _passages(off, PASSAGE)
                passage = np.searchsorted(starts, hit, side="right") - 1
                t = term[hit]
                if not len(t):
                    continue
                # tf-idf cells of the sparse rows, scaled to unit rows
                cell, tf = np.unique(passage * size + t, return_counts=True)
                p, t = cell // size, cell % size
                v = tf.astype(np.float32) * weight[t]
                norm = np.sqrt(np.bincount(p, v.astype(np.float64) ** 2, minlength=len(starts)))
                v = (v / np.maximum(norm[p], 1e-9)).astype(np.float32)
                bounds = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                y = np.add.reduceat(g[t] * v[:, None], bounds, axis=0)
                y = np.repeat(y, np.diff(np.r_[bounds, len(p)]), axis=0) * v[:, None]
                order = np.argsort(t, kind="stable")
                ts = t[order]
                cut = np.flatnonzero(np.r_[True, ts[1:] != ts[:-1]])
                total[ts[cut]] += np.add.reduceat(y[order], cut, axis=0)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *(pa.array(total[used, i]) for i in range(width))],
            names=["term", *(f"z{i}" for i in range(width))])

    columns = [f"z{i}" for i in range(width)]
    got = seqs.select("words").mapInArrow(run, "term long, " + ", ".join(f"{c} double" for c in columns)) \
        .groupBy("term").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()   # one row per term
    z = np.zeros((size, width))
    z[got["term"].to_numpy(dtype=np.int64)] = got[columns].to_numpy()
    # The items are passages too, so even a tiny corpus has a space that holds them.
    for words in items.words:
        t, tf = np.unique(items.terms(words), return_counts=True)
        v = tf * idf[t]
        v = v / max(float(np.linalg.norm(v)), 1e-9)
        z[t] += np.outer(v, v @ random[t])
    # Nystroem: A'A is about Z (G'Z)^-1 Z' with Z = A'A G.
    shift = 1e-8 * max(1.0, np.linalg.norm(z))
    z = z + shift * random
    core = random.T @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-10
    half = z @ vectors[:, good] / np.sqrt(values[good])
    left, strength, _ = np.linalg.svd(half, full_matrices=False)
    # Directions are scaled to equal variance: otherwise the few that tell
    # languages and common words apart would decide every cosine.
    keep = strength > strength.max() * 1e-6
    return (left[:, keep] / strength[keep])[:, :RANK]


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = where.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def window_words(n: int) -> int:
    """Window length (a multiple of STEP) for items of ``n`` words: the item
    fits into some window wherever it starts; lengths grow by halves."""
    size = 2 * STEP
    while size < n + STEP - 1:
        size = -(-size * 3 // (2 * STEP)) * STEP
    return size


class Postings:
    """Windows that hold at least ``need`` of an item's listed words.

    Hits of one (row, item) in order of position: ``need`` consecutive ones must
    fit into a window.  Repeats of a word count, so the windows found are a
    superset.  Work and memory follow the hits, ``CELLS`` at a time, also
    within one long row."""

    def __init__(self, lists: list[np.ndarray], need: list[int], chunks: list[int], terms: int) -> None:
        term = np.concatenate(lists)
        item = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        self.posts = item[np.argsort(term, kind="stable")]
        self.per_term = np.bincount(term, minlength=terms + 1)      # term -1 has no list
        self.first = np.cumsum(self.per_term) - self.per_term
        self.need, self.chunks = np.array(need), np.array(chunks)

    def windows(self, term: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Sorted (row, item, first chunk) triples, one per row of the result."""
        hit = np.flatnonzero(self.per_term[term])
        part = np.cumsum(self.per_term[term[hit]]) // CELLS
        cuts = hit[np.flatnonzero(np.r_[True, part[1:] != part[:-1]])] if len(hit) else hit
        reach = int(self.chunks.max()) * STEP
        found = [self._windows(term, off, hit, int(a), int(b), reach) for a, b in zip(cuts, [*cuts[1:], len(term)])]
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), dtype=np.int64)

    def _windows(self, term, off, hit, begin: int, end: int, reach: int) -> np.ndarray:
        """Windows whose first hit lies in [begin, end)."""
        pos = hit[np.searchsorted(hit, begin):np.searchsorted(hit, end + reach)]
        per = self.per_term[term[pos]]
        at = np.arange(per.sum()) + np.repeat(self.first[term[pos]] - (np.cumsum(per) - per), per)
        item, pos = self.posts[at], np.repeat(pos, per)
        row = np.searchsorted(off, pos, side="right") - 1
        key = row * len(self.need) + item
        order = np.argsort(key, kind="stable")
        key, pos, item, row = key[order], pos[order], item[order], row[order]
        k = np.arange(len(key))
        last = np.minimum(k + self.need[item] - 1, len(key) - 1)
        low, high = (pos - off[row]) // STEP, (pos[last] - off[row]) // STEP
        length = self.chunks[item]
        good = np.flatnonzero((k + self.need[item] <= len(key)) & (key[last] == key) & (high - low < length)
                              & (pos < end))
        first = np.maximum(high[good] - length[good] + 1, 0)
        n = low[good] - first + 1
        chunk = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        return np.unique(np.stack([np.repeat(row[good], n), np.repeat(item[good], n), chunk], axis=1), axis=0)


class Searcher:
    def __init__(self, items: Items, idf: np.ndarray, space: np.ndarray) -> None:
        self.items = items
        self.project = (space * idf[:, None]).astype(np.float32)
        self.lists = [w.tolist() for w in items.words]
        self.chunks = [window_words(len(w)) // STEP for w in items.words]
        queries, rare_words, rare_need, answers, answer_need = [], [], [], [], []
        for w in items.words:
            t = items.terms(w)
            q = self.project[t].sum(axis=0)
            queries.append(q / max(float(np.linalg.norm(q)), 1e-9))
            distinct = np.unique(t)
            rare = distinct[np.argsort(-idf[distinct], kind="stable")]
            missed = len(w) - int(np.ceil(len(w) * VERBATIM - 1e-9)) if len(w) >= MIN_ITEM else 0
            rare_words.append(rare[:2 * missed + 1])
            rare_need.append(max(1, len(rare_words[-1]) - missed))
            answers.append(rare[:max(1, -(-len(rare) // 5))])
            answer_need.append(max(1, int(np.ceil(len(answers[-1]) * ANSWER - 1e-9))))
        self.queries = np.array(queries, dtype=np.float32)
        self.answers = [set(items.vocab[a].tolist()) for a in answers]
        self.answer_windows = Postings(answers, answer_need, self.chunks, len(items.vocab))
        self.rare_windows = Postings(rare_words, rare_need, self.chunks, len(items.vocab))

    def leak(self, item: int, window: list[int]) -> tuple[bool, float]:
        words = self.lists[item]
        share = lcs(words, window) / len(words)
        if share >= self.verbatim(item):
            return True, share
        if share < PARAPHRASE or len(words) < MIN_ITEM:
            return False, share
        answer = self.answers[item]
        return len(answer & set(window)) >= ANSWER * len(answer), share

    def verbatim(self, item: int) -> float:
        return VERBATIM if len(self.lists[item]) >= MIN_ITEM else 1.0

    def cosine(self, item: int, term: np.ndarray) -> float:
        v = self.project[term[term >= 0]].sum(axis=0)
        return float(v @ self.queries[item]) / max(float(np.linalg.norm(v)), 1e-9)

    def candidates(self, flat: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int, float, bool]]:
        """(row, item, first word, end word, cosine, whether the cosine chose it) of
        all windows to check; the others may hold the item verbatim."""
        term = self.items.terms(flat)
        answers, rare = self.answer_windows.windows(term, off), self.rare_windows.windows(term, off)
        cells, which = np.unique(np.concatenate([answers, rare]), axis=0, return_inverse=True)
        by_answer, by_rare = np.zeros(len(cells), dtype=bool), np.zeros(len(cells), dtype=bool)
        by_answer[which.ravel()[:len(answers)]] = True
        by_rare[which.ravel()[len(answers):]] = True
        for (row, item, chunk), informative, exact in zip(cells.tolist(), by_answer.tolist(), by_rare.tolist()):
            a = int(off[row]) + chunk * STEP
            b = min(a + self.chunks[item] * STEP, int(off[row + 1]))
            cos = self.cosine(item, term[a:b])
            near = informative and cos >= MIN_COSINE
            if near or exact:
                yield row, item, a, b, cos, near

    def leaks(self, flat: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int, float, float]]:
        """(row, item, first word, end word, cosine, share) of all leaks."""
        for row, item, a, b, cos, near in self.candidates(flat, off):
            hit, share = self.leak(item, flat[a:b].tolist())
            if hit and (near or share >= self.verbatim(item)):
                yield row, item, a, b, cos, share


MATCH_SCHEMA = "doc_id long, item_id long, cosine double, overlap double, start int, stop int"


def block_matches(seqs: DataFrame, items: Items) -> DataFrame:
    """Leaks of one block of items: doc_id, item_id and the best window."""
    df, docs = document_frequency(seqs, items)
    idf = np.log((1 + docs) / (1 + df)) + 1e-3
    shared = seqs.sparkSession.sparkContext.broadcast(Searcher(items, idf, latent_space(seqs, items, idf)))

    def run(batches):
        s = shared.value
        for batch in batches:
            for part, flat, off in _sequences(batch, 1 << 16):
                best: dict[tuple[int, int], tuple[float, float, int, int]] = {}
                for r, item, a, b, cos, share in s.leaks(flat, off):
                    if (share, cos) > best.get((r, item), (-1.0, 0.0))[:2]:
                        best[r, item] = (share, cos, a - int(off[r]), b - int(off[r]))
                if best:
                    ids = part.column("doc_id").to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[r] for r, _ in best], pa.int64()),
                         pa.array([s.items.ids[i] for _, i in best], pa.int64()),
                         pa.array([v[1] for v in best.values()]), pa.array([v[0] for v in best.values()]),
                         pa.array([v[2] for v in best.values()], pa.int32()),
                         pa.array([v[3] for v in best.values()], pa.int32())],
                        names=["doc_id", "item_id", "cosine", "overlap", "start", "stop"])

    return seqs.mapInArrow(run, MATCH_SCHEMA)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All leaks: one row per document row and item with its best window."""
    spark = docs.sparkSession
    seqs = materialise(word_sequences(docs, "doc_id"), "decontam-words")
    found = None
    for items in item_blocks(benchmark):
        block = materialise(block_matches(seqs, items), "decontam-matches")
        found = block if found is None else found.unionByName(block)
    return found if found is not None else spark.createDataFrame([], MATCH_SCHEMA)


def op6(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: whether it leaks an item, and which."""
    found = matches(docs, benchmark).where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("n_items"), F.min("item_id").alias("first_item"),
        F.max("overlap").alias("overlap"))
    found = materialise(found, "decontam-documents").withColumnRenamed("doc_id", "_id")
    return docs.select("doc_id").join(found, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", F.col("_id").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "first_item", "overlap")


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents (all columns, of any name) that leak no item; a doc_id with
    any leaking row goes with all its rows, rows without an id stay.  An empty
    table gives an empty one."""
    found = materialise(matches(docs, benchmark).select(F.col("doc_id").alias("_id")).distinct(), "decontam-ids")
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(found, F.col("row.doc_id") == F.col("_id"), "left_anti").select("row.*")
