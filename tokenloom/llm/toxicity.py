"""Operator 3: toxicity by compression distance.

Two zstandard dictionaries are built from labelled text.  The ordinary one
holds frequent ordinary words and, first of all, ordinary words that contain
the same letter groups as toxic segments; the toxic one holds the segments that
mark toxic text in front of the same ordinary content.  Every text is cut into
windows of ``WINDOW`` words and each window is compressed with both; a window
that is shorter under the toxic dictionary contains toxic segments.  The
document's distance is the sum of its three largest window differences.  The
threshold is calibrated on labelled documents that the dictionaries have not
seen; ``score`` is a logistic curve through 0.5 at the threshold.

Training uses a bounded sample: at most ``TRAIN_TOXIC`` and ``TRAIN_CLEAN``
labelled rows whose crc32(doc_id as text) mod 5 is not 0, of at most
``TRAIN_CHARS`` characters each, smallest hash of doc_id first; every third of
them calibrates.  Scoring reads every whole text, row by row, without shuffle.

Defined results: null text counts as empty, empty texts have distance 0; a
document labelled twice is toxic if any of its labels is; without labels of
both classes every score is 0; a null doc_id is not held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import text_slices

TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 1500, 3000, 20_000
WINDOW = 8
GRAMS = (6, 7, 8, 9, 10)   # letter groups (with word edges) that can mark toxic text, beside whole words
COVER = (6, 7, 8, 9)       # letter groups that ordinary words have to cover
SEEN = 0.3                 # a training text with more known five-word shingles is a copy
MIN_SHARE, MIN_RATIO = 0.01, 20.0
BACKGROUND_BYTES = 4096
LEVEL, MIN_MATCH = 5, 6
# Both dictionaries end in this text and every window starts with it, so each
# window has one long match and its length counts bytes rather than whether a
# block is worth compressing at all.
LEAD = bytes(range(1, 9)) + bytes(range(14, 32))

MARKS = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\n\x0b\x0c\r"})


def words_in(text: str) -> list[str]:
    return text.lower().translate(MARKS).split()


def _grams(word: str, sizes: tuple[int, ...]) -> set[str]:
    v = f" {word} "
    return {v[i:i + n] for n in sizes for i in range(len(v) - n + 1)}


def _marks_of(word: str) -> set[str]:
    return _grams(word, GRAMS) | {f" {word} "}


def without_copies(rows: list[str]) -> list[str]:
    """The texts that aren't mostly made of earlier ones: a group of copies
    would make its own words look typical of its class."""
    seen: set[int] = set()
    out = []
    for text in rows:
        w = words_in(text)
        shingles = {hash(tuple(w[i:i + 5])) for i in range(max(1, len(w) - 4))}
        if len(shingles & seen) <= SEEN * len(shingles):
            out.append(text)
        seen |= shingles
    return out


def _segments(word: str, marks: set[str]) -> list[str]:
    """The parts of a word (with its edges) that marking groups cover."""
    v = f" {word} "
    if v in marks:
        return [v]
    on = [False] * len(v)
    for n in GRAMS:
        for i in range(len(v) - n + 1):
            if v[i:i + n] in marks:
                on[i:i + n] = [True] * n
    return [m[0] for m in re.finditer(r"[^\0]+", "".join(c if o else "\0" for c, o in zip(v, on)))]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    threshold: float


def build_dictionaries(toxic: list[str], clean: list[str]) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionary contents."""
    toxic_words = [set(words_in(t)) for t in toxic]
    clean_words: Counter[str] = Counter()
    in_clean: Counter[str] = Counter()
    for t in clean:
        distinct = set(words_in(t))
        clean_words.update(distinct)
        in_clean.update(set().union(*map(_marks_of, distinct)) if distinct else ())
    in_toxic: Counter[str] = Counter()
    for distinct in toxic_words:
        in_toxic.update(set().union(*map(_marks_of, distinct)) if distinct else ())
    least = max(3, MIN_SHARE * len(toxic))
    marks = {g for g, n in in_toxic.items()
             if n >= least and n / len(toxic) >= MIN_RATIO * (in_clean[g] + 0.5) / len(clean)}
    segments: Counter[str] = Counter()
    for distinct in toxic_words:
        for w in distinct:
            segments.update(_segments(w, marks))
    toxic_part = "\n".join(s for s, _ in sorted(segments.items(), key=lambda x: (x[1], x[0])))
    need = set()
    for s in segments:
        need |= {s[i:i + n] for n in COVER for i in range(len(s) - n + 1)}
    ordinary: list[str] = []
    size = 0
    marked = {w for distinct in toxic_words for w in distinct if _segments(w, marks)}
    for w, _ in sorted(clean_words.items(), key=lambda x: (-x[1], x[0])):
        if w in marked:
            continue
        new = _grams(w, COVER) & need
        if new or size < BACKGROUND_BYTES:
            need -= new
            ordinary.append(w)
            size += len(w.encode()) + 1
    background = (" " + " ".join(reversed(ordinary)) + " ").encode()
    return toxic_part.encode() + b"\n" + background + LEAD, background + LEAD


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, min_match=MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.toxic, self.ordinary = compressor(model.toxic), compressor(model.ordinary)

    def distance(self, text: str) -> float:
        """Sum of the three largest window differences of the whole text."""
        words = words_in(text)
        top = [0, 0, 0]
        toxic, ordinary = self.toxic.compress, self.ordinary.compress
        for i in range(0, len(words), WINDOW):
            window = LEAD + f" {' '.join(words[i:i + WINDOW])} ".encode("utf-8", "replace")
            gain = len(ordinary(window)) - len(toxic(window))
            if gain > top[2]:
                top = sorted([*top, gain], reverse=True)[:3]
        return float(sum(top))

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.distance(text) - self.model.threshold))))


def fit(toxic: list[str], clean: list[str]) -> Model | None:
    """Dictionaries from two thirds of the sample, threshold from the rest."""
    pick = lambda rows, held: [t for i, t in enumerate(rows) if (i % 3 == 2) == held]
    if not toxic or not clean:
        return None
    toxic, clean = without_copies(toxic), without_copies(clean)
    model = Model(*build_dictionaries(pick(toxic, False), pick(clean, False)), 0.5)
    scorer = Scorer(model)
    t = sorted(scorer.distance(x) for x in (pick(toxic, True) or toxic))
    c = sorted(scorer.distance(x) for x in (pick(clean, True) or clean))
    best = (-1.0, 0.5)
    for cut in sorted({x + 0.5 for x in (*t, *c)}):
        good = sum(x > cut for x in t) / len(t) + sum(x < cut for x in c) / len(c)
        best = max(best, (good, cut), key=lambda b: (b[0], -b[1]))
    model.threshold = best[1]
    return model


def held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[str]]:
    """The bounded labelled sample, (toxic, clean), in a fixed order."""
    known = labels.where(~held_out("doc_id") & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    out = []
    for label, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN)):
        ids = known.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(most).select("doc_id")
        rows = docs.where(F.length("text") <= TRAIN_CHARS).select("doc_id", "text") \
            .join(F.broadcast(ids), "doc_id", "left_semi").collect()   # at most `most` ids
        out.append([r["text"] for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))])
    return out[0], out[1]


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out("doc_id").alias("held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            for part in text_slices(batch, "text"):
                scores = [scorer.score(t) if scorer else 0.0 for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64())],
                    names=["doc_id", "held_out", "score"])

    return d.mapInArrow(run, "doc_id long, held_out boolean, score double") \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, fit(*training_texts(docs, labels)))
