"""Operator 8: token ids as static-range ANS frames.

Documents are dealt by range of doc_id, tokenized partition by partition and
cut into blocks of about ``BLOCK_TOKENS`` ids.  All blocks share one static
frequency table (counted over every id of the corpus, normalised to
2^SCALE).  Each block is an independent frame: ``LANES`` interleaved range-ANS
coders over one word stream, with the coders' states repeated at checkpoints
every ``CHECK_STEPS`` steps, so segments of one frame and all frames decode in
parallel, and checksums of the header, stream and ids that decoding verifies.

File format (little endian), one frame per block, stored through Spark's
writer beside the ids' documents:

    magic "RNS1", u16 lanes, u16 check steps, u32 n ids, u32 n words,
    u32 n checkpoints, u32 crc32(ids as u32), u32 crc32(rest of the frame),
    rest: per checkpoint u32 word offset + lanes x u64 states (the first at
    word 0), then the words (u32) in decoding order

Defined results: null text counts as empty: only the end id.  Rows are in
ascending doc_id order, null first, and rows that repeat an id by text, so
each row has its own span.  Ids must be below 65,536.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import materialise, text_slices

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
BLOCK_TOKENS = 1 << 18
LANES = 1024
CHECK_STEPS = 128
SCALE = 20           # frequencies sum to 2^SCALE
CACHE_WORDS = 350_000
SLICE_BYTES = 8 << 20  # text tokenized at a time: the more, the fewer distinct chunks per byte
IDS = 1 << 16


# --- tokenizing -----------------------------------------------------------

# A chunk of plain letters and a run of other ASCII marks: the tokenizer's
# split pattern always cuts between the two.  Other chunks are encoded whole.
LETTERS = r"[A-Za-zÀ-ÖØ-öø-ÿ]+"
PLAIN = rf"\A(?P<word>{LETTERS})(?P<tail>[.,!?;:#*$%&|<>()\[\]{{}}=+/_~^@\"-]*)\z"


class WordEncoder:
    """Ids of space-separated chunks, remembered across batches.

    The tokenizer drops white space and its split pattern never crosses it, so
    a text's ids are its chunks' ids in order, and a plain chunk's ids those of
    its lower-case word and of its tail.  New words are encoded together in one
    call; every plain word ends in exactly one id with a word end, which gives
    the cuts back.  Words, tails and other chunks of fewer than 100 bytes are
    remembered in one Arrow table: at 2 x ``CACHE_WORDS`` rows it shrinks to the
    ``CACHE_WORDS`` used latest.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > IDS:
            raise ValueError("the format holds ids below 65,536")
        self.ends = np.zeros(IDS, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.known = pa.array([""])
        self.known_ids = id_lists([], [0])
        self.used = np.zeros(1, dtype=np.int64)     # the call that used a known part last
        self.call = 0

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u2")

    def learn(self, parts: pa.Array) -> pa.LargeListArray:
        """Ids of new parts, plain lower-case words in joined runs."""
        plain = pc.match_substring_regex(parts, rf"\A{LETTERS}\z").to_numpy(zero_copy_only=False)
        words = parts.filter(pa.array(plain))
        runs = pa.array([*range(0, len(words), 4096), len(words)], pa.int32())
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        for at, run in enumerate(pc.binary_join(pa.ListArray.from_arrays(runs, words), " ").to_pylist()):
            got = self.encode(run)
            cuts = np.flatnonzero(self.ends[got]) + 1
            run_words = words.slice(4096 * at, 4096)
            if len(cuts) == len(run_words) and cuts[-1] == len(got):
                ids.append(got)
                sizes.append(np.diff(cuts, prepend=0))
            else:
                ids += map(self.encode, run_words.to_pylist())
                sizes.append(np.array([len(i) for i in ids[-len(run_words):]]))
        others = [self.encode(part) for part in parts.filter(pa.array(~plain)).to_pylist()]
        lists = id_lists([*ids, *others], np.concatenate([*sizes, [len(i) for i in others]]))
        return lists.take(pa.array(np.argsort(np.argsort(~plain, kind="stable"))))

    def parts(self, parts: pa.Array) -> pa.LargeListArray:
        """Ids of each of some distinct parts."""
        at = pc.index_in(parts, value_set=self.known)
        new = at.is_null().to_numpy(zero_copy_only=False)
        known, ids, used = self.known, self.known_ids, self.used
        at = at.fill_null(0).to_numpy().astype(np.int64)
        if new.any():
            fresh = parts.filter(pa.array(new))
            at[new] = len(known) + np.arange(len(fresh))
            known = pa.concat_arrays([known, fresh])
            ids = pa.concat_arrays([ids, self.learn(fresh)])
            used = np.concatenate([used, np.zeros(len(fresh), dtype=np.int64)])
        got = ids.take(pa.array(at))
        self.call += 1
        used[at] = self.call
        keep = np.flatnonzero(pc.binary_length(known).to_numpy() < 100)
        if len(keep) > 2 * CACHE_WORDS:
            keep = keep[np.argpartition(-used[keep], CACHE_WORDS)[:CACHE_WORDS]]
        if len(keep) < len(known):
            known, ids, used = known.take(pa.array(keep)), ids.take(pa.array(keep)), used[keep]
        self.known, self.known_ids, self.used = known, ids, used
        return got

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids with END_ID after each text, ids per text)."""
        lists = pc.split_pattern(pc.replace_substring(column.cast(pa.string()), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary
        plain = pc.extract_regex(chunks, PLAIN)
        word = pc.coalesce(pc.utf8_lower(pc.struct_field(plain, "word")), chunks)
        tail = pc.coalesce(pc.struct_field(plain, "tail"), "")
        parts = pa.concat_arrays([word, tail]).dictionary_encode()
        ids = self.parts(parts.dictionary)
        # One list of ids per distinct chunk and one for the end of a text, taken in text order.
        pairs = parts.indices.to_numpy().reshape(2, -1).T.ravel()
        size = np.append(ids.value_lengths().to_numpy()[pairs].reshape(-1, 2).sum(axis=1), 1)
        table = id_lists([ids.take(pa.array(pairs)).flatten().to_numpy(), [END_ID]], size)
        bounds = np.cumsum(pc.list_value_length(lists).to_numpy())
        order = np.insert(coded.indices.to_numpy(), bounds, len(chunks))
        ends = np.cumsum(size[order])[bounds + np.arange(len(bounds))]
        return table.take(pa.array(order)).flatten().to_numpy(), np.diff(ends, prepend=0)


def id_lists(ids: list, sizes) -> pa.LargeListArray:
    """Lists of the given sizes over the joined ids."""
    return pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int64)),
                                         pa.array(np.concatenate([np.empty(0, "<u2"), *ids]).astype("<u2")))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder (and word cache) per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


BLOCK_SCHEMA = ("part int, block int, start_in_part long, n_tokens long, doc_ids array<long>, "
                "lengths array<long>, ids binary")


def tokenize_blocks(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Blocks of whole documents' ids (u16) in ascending doc_id order."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        part, block, start = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal block, start, held
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()),
                 pa.array([held], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())),
                 pa.array([np.concatenate(lengths)], pa.list_(pa.int64())),
                 pa.array([np.concatenate(ids).tobytes()], pa.binary())],
                names=["part", "block", "start_in_part", "n_tokens", "doc_ids", "lengths", "ids"])
            block, start, held = block + 1, start + held, 0
            doc_ids.clear()
            lengths.clear()
            ids.clear()
            return row

        for batch in batches:
            for piece in text_slices(batch, "text", SLICE_BYTES):
                got, sizes = words.texts(piece.column("text"))
                ends = np.cumsum(sizes)
                a = at = 0
                while a < len(sizes):
                    b = min(len(sizes), int(np.searchsorted(ends, at + BLOCK_TOKENS - held)) + 1)
                    doc_ids += piece.column("doc_id").slice(a, b - a).to_pylist()
                    lengths.append(sizes[a:b])
                    ids.append(got[at:ends[b - 1]])
                    held += int(ends[b - 1]) - at
                    a, at = b, int(ends[b - 1])
                    if held >= BLOCK_TOKENS:
                        yield flush()
        if doc_ids:
            yield flush()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit("")).alias("text")
    ordered = docs.select("doc_id", text).repartitionByRange(parts, "doc_id", F.xxhash64("text")) \
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(run, BLOCK_SCHEMA)


# --- range ANS ------------------------------------------------------------

LOW = np.uint64(1 << 31)
WORD = np.uint64(32)


class Table:
    """Static frequencies that sum to 2^SCALE, at least 1 for every id that occurs."""

    def __init__(self, counts: np.ndarray) -> None:
        counts = np.asarray(counts, dtype=np.float64)
        total = 1 << SCALE
        freq = np.zeros(len(counts), dtype=np.int64)
        if counts.sum():
            used = counts > 0
            spare = total - int(used.sum())
            freq[used] = 1 + np.floor(counts[used] / counts.sum() * spare).astype(np.int64)
            freq[np.argmax(freq)] += total - int(freq.sum())   # what rounding left over
        self.freq = freq.astype(np.uint64)
        self.base = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq)), freq).astype(np.uint16)


def encode_frame(ids: np.ndarray, table: Table, lanes: int = LANES, check: int = CHECK_STEPS) -> bytes:
    n = len(ids)
    freq, base = table.freq[ids], table.base[ids]
    if n and not freq.all():
        raise ValueError("an id is missing from the frequency table")
    scale = np.uint64(SCALE)
    limit = freq << np.uint64(63 - SCALE)
    x = np.full(lanes, LOW, dtype=np.uint64)
    steps = -(-n // lanes)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    emitted = 0
    for step in range(steps - 1, -1, -1):
        here = slice(step * lanes, (step + 1) * lanes)
        f = freq[here]
        y = x[:len(f)]
        full = np.flatnonzero(y >= limit[here])
        if len(full):
            w = y[full]
            words.append(w.astype(np.uint32))
            emitted += len(w)
            y[full] = w >> WORD
        q = y // f
        # y = (q << scale) + y % f + base
        y -= q * f
        q <<= scale
        y += q
        y += base[here]
        if step % check == 0:
            marks.append((emitted, x.copy()))
    if not marks:
        marks.append((0, x.copy()))
    words.reverse()
    stream = np.concatenate(words).astype("<u4").tobytes() if words else b""
    rest = b"".join(struct.pack("<I", emitted - at) + s.astype("<u8").tobytes() for at, s in reversed(marks)) + stream
    crc = zlib.crc32(np.asarray(ids).astype("<u4").tobytes())
    return struct.pack("<4sHHIIIII", b"RNS1", lanes, check, n, emitted, len(marks), crc, zlib.crc32(rest)) + rest


HEAD = struct.calcsize("<4sHHIIIII")


def decode_segment(frame: bytes, table: Table, segment: int) -> np.ndarray:
    """Ids from one checkpoint to the next, read on their own."""
    _, lanes, check, n, n_words, n_marks, _, _ = struct.unpack_from("<4sHHIIIII", frame)
    width = 4 + 8 * lanes
    at = HEAD + segment * width
    word = struct.unpack_from("<I", frame, at)[0]
    x = np.frombuffer(frame, "<u8", lanes, at + 4).astype(np.uint64)
    stream = np.frombuffer(frame, "<u4", n_words, HEAD + n_marks * width)
    first, last = segment * check * lanes, min(n, (segment + 1) * check * lanes)
    out = np.empty(max(0, last - first), dtype=np.uint16)
    mask, scale = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for start in range(0, len(out), lanes):
        y = x[:min(lanes, len(out) - start)]
        slot = y & mask
        s = table.symbol.take(slot.view(np.int64))
        out[start:start + len(y)] = s
        # y = freq * (y >> scale) + slot - base
        y >>= scale
        y *= table.freq.take(s)
        slot -= table.base.take(s)
        y += slot
        low = np.flatnonzero(y < LOW)
        if len(low):
            y[low] = (y[low] << WORD) | stream[word:word + len(low)]
            word += len(low)
    return out


def decode_frame(frame: bytes, table: Table) -> np.ndarray:
    magic, _, _, n, _, n_marks, crc, rest = struct.unpack_from("<4sHHIIIII", frame)
    if magic != b"RNS1" or zlib.crc32(frame[HEAD:]) != rest:
        raise ValueError("damaged frame")
    ids = np.concatenate([decode_segment(frame, table, i) for i in range(n_marks)])
    if len(ids) != n or zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("decoded ids don't match their checksum")
    return ids


# --- files ----------------------------------------------------------------

def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(IDS, dtype=np.int64)
    for batch in batches:
        for raw in batch.column("ids"):
            counts += np.bincount(np.frombuffer(raw.as_buffer(), dtype="<u2"), minlength=IDS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], names=["id", "n"])


def write_frames(docs: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames, frequency table), both written and reread."""
    spark = docs.sparkSession
    blocks = materialise(tokenize_blocks(docs, tokenizer), "token-blocks")
    counts = materialise(blocks.select("ids").mapInArrow(_histogram, "id int, n long")
                         .groupBy("id").agg(F.sum("n").alias("n")), "token-counts")
    table = spark.sparkContext.broadcast(load_table(counts))

    def run(batches):
        for batch in batches:
            frames = [encode_frame(np.frombuffer(raw.as_buffer(), dtype="<u2"), table.value)
                      for raw in batch.column("ids")]
            keep = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(frames, pa.binary())],
                                             names=[*keep, "frame"])

    frames = blocks.mapInArrow(run, BLOCK_SCHEMA.replace("ids binary", "frame binary"))
    return materialise(frames, "token-frames"), counts


def load_table(counts: DataFrame) -> Table:
    """The shared table; at most 65,536 rows whatever the corpus."""
    dense = np.zeros(IDS, dtype=np.int64)
    for r in counts.collect():
        dense[r["id"]] = r["n"]
    return Table(dense)


def read_frames(frames: DataFrame, counts: DataFrame) -> DataFrame:
    """Decoded documents: doc_id, start, n_tokens, ids_crc32, ids (u16 bytes)."""
    spark = frames.sparkSession
    table = spark.sparkContext.broadcast(load_table(counts))
    # One row per range partition: ids before it.
    parts = frames.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(parts.select(F.col("part").alias("_part"),
                                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")), "token-starts")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = decode_frame(batch.column("frame")[i].as_buffer().to_pybytes(), table.value)
                doc_ids = batch.column("doc_ids")[i].values
                lengths = batch.column("lengths")[i].values.to_numpy()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                wide = ids.astype("<u4")
                crcs = [zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                base = batch.column("start")[i].as_py()
                raw = ids.astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(starts + base, pa.int64()), pa.array(lengths, pa.int64()),
                     pa.array(crcs, pa.int64()),
                     pa.array([raw[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    placed = frames.join(offsets, F.col("part") == F.col("_part"), "left").select(
        (F.col("start_in_part") + F.col("_before")).alias("start"), "doc_ids", "lengths", "frame")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op8(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    frames, counts = write_frames(docs, tokenizer)
    return read_frames(frames, counts).select("doc_id", "start", "n_tokens", "ids_crc32")
