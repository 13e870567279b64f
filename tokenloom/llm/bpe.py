"""Operator 13: exact BPE ids by dynamic programming over prefixes, and back.

BPE replays its merges in order of rank.  For every prefix of a symbol string
there is exactly one token that ends its encoding, so the encoding of a whole
string is a chain of such last tokens.  They are found left to right: an
automaton over all tokens reports those that end at each position, longest
first; a match is the prefix's last token if it stands next to the last token
of the prefix before it, i.e. if running the merges over both tokens leaves the
cut between them in place (:meth:`Codec.compatible`).  Back-pointers (the
tokens' lengths) then give the ids.  The work is linear in the text, also for
one run of letters of any length, and no merge queue is needed.

Symbols are the bytes of a word, its last byte in an alphabet of its own
(byte + 256), as the vocabulary has word ends.  So no token reaches over a word
and the words of a whole batch can stand in one string.

Normalising and cutting into words is the tokenizer's own for chunks with
non-ASCII characters and a rule for ASCII ones; both are local to chunks
between spaces and line breaks, and chunks are encoded once per worker while they
stay in a two-generation memory of ``CACHE_CHUNKS`` entries.

Defined results: null text counts as empty; an empty or blank text has no ids
and decodes to an empty string.  Special tokens' strings in a text become their
ids.  Every row is encoded by itself: repeated rows and ids (null ones too) stay,
there are no ties, and columns other than those named are not looked at.  An
empty table gives no rows.  Texts are never cut; one text's ids are held at once.
Ids outside the vocabulary decode to nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tokenloom.llm.common import text_slices

TOKENIZER = "word_bpe_49k.json"
CACHE_CHUNKS = 250_000
MEMO_PAIRS = 500_000
SLICE_BYTES = 4 << 20
NEVER = 1 << 30
WORD_END = [chr(256 + byte) for byte in range(256)]

# The tokenizer's word pattern on lower-case text of ASCII characters
# and the composed letters of Latin-1 (normalising leaves both as they are).
EASY = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
EASY_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x20\x09-\x0d0-9a-zß-öø-ÿ]+")


def byte_characters() -> dict[str, int]:
    """Byte of each character that byte-level vocabularies write for it:
    printable bytes stand for themselves, the others for 256, 257, ..."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Codec:
    """Encoder and decoder of one tokenizer file (BPE with word ends)."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["continuing_subword_prefix"]:
            raise ValueError("a BPE vocabulary with word ends is needed")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}

        names = [self.strings.get(i) for i in range(max(self.strings) + 1)]
        self.known = np.array([n is not None for n in names])
        self.string_table = pa.array(names, pa.large_string())

        # Every token as a symbol string, from the base symbols up the merges.
        self.byte_of = byte_characters()
        self.as_bytes = {ord(char): byte for char, byte in self.byte_of.items()}
        symbols: dict[int, str] = {}
        for char, byte in self.byte_of.items():
            symbols[vocab[char]] = chr(byte)
            symbols[vocab[char + suffix]] = chr(256 + byte)
        size = max(vocab.values()) + 1
        self.made = [-1] * size           # rank of the merge that makes a token
        self.parts = [(0, 0)] * size
        self.ranks: dict[int, int] = {}   # (left << 20 | right) -> rank
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if not isinstance(pair, str) else pair.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            if whole in symbols or a not in symbols or b not in symbols:
                raise ValueError("each token must come from one merge of earlier tokens")
            symbols[whole] = symbols[a] + symbols[b]
            self.made[whole], self.parts[whole], self.ranks[a << 20 | b] = rank, (a, b), rank
        self.memo: dict[int, bool] = {}
        self.length = [0] * size
        self.ends = np.zeros(size, dtype=bool)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        occurs = [True] * size
        for token, s in symbols.items():
            self.length[token] = len(s)
            self.ends[token] = ord(s[-1]) >= 256
            if len(s) > 1:   # a token that its own merges don't give back never occurs
                a, b = self.parts[token]
                occurs[token] = occurs[a] and occurs[b] and self.standing(a, b, self.made[token])
            if occurs[token]:
                self.automaton.add_word(s, token)
        self.closes = self.ends.tolist()
        self.automaton.make_automaton()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def standing(self, left: int, right: int, until: int) -> bool:
        """Whether the cut between two neighbouring tokens stands while all
        merges below rank ``until`` are replayed over both.

        The neighbours of the cut are followed back in time, latest merge undone
        first.  Their own merge would have crossed the cut if its rank came
        before the merge that took up the left one, or up to (the left place
        wins a tie) the one that took up the right one."""
        left_until = right_until = until
        while True:
            rank = self.ranks.get(left << 20 | right, NEVER)
            if rank < left_until and (rank < right_until or rank == right_until < until):
                return False
            if self.made[left] < 0 and self.made[right] < 0:
                return True
            if self.made[left] > self.made[right]:
                left_until = self.made[left]
                left = self.parts[left][1]
            else:
                right_until = self.made[right]
                right = self.parts[right][0]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= MEMO_PAIRS:
                self.memo.clear()
            known = self.memo[key] = self.standing(left, right, NEVER)
        return known

    def last_tokens(self, symbols: str) -> list[int]:
        """The last token of every prefix's encoding."""
        last = [-1] * len(symbols)
        length, closes, memo, compatible = self.length, self.closes, self.memo, self.compatible
        for end, token in self.automaton.iter(symbols):
            if last[end] >= 0:
                continue
            before = end - length[token]
            if before >= 0:
                neighbour = last[before]
                if neighbour < 0:
                    continue
                if not closes[neighbour]:   # no merge reaches over a word's end
                    fits = memo.get(neighbour << 20 | token)
                    if fits is None:
                        fits = compatible(neighbour, token)
                    if not fits:
                        continue
            last[end] = token
        return last

    def words(self, words: list[str]) -> list[bytes]:
        """Ids (i32, little endian) of each (non-empty) word, one character a byte."""
        joined = "".join([w[:-1] + WORD_END[ord(w[-1])] for w in words])
        last, length = self.last_tokens(joined), self.length
        ids, at = [], len(joined) - 1
        while at >= 0:
            token = last[at]
            ids.append(token)
            at -= length[token]
        flat = np.array(ids[::-1], dtype="<i4")
        raw = flat.tobytes()
        stops = (4 * (np.flatnonzero(self.ends[flat]) + 1)).tolist()
        return [raw[i:j] for i, j in zip([0, *stops], stops)]

    def cut(self, chunk: str) -> list[str | int]:
        """Words (one character a byte) and special ids of a chunk."""
        if self.special_cut is not None and "<" in chunk:
            pieces = self.special_cut.split(chunk)
            if len(pieces) > 1:
                return [x for i, p in enumerate(pieces) if p
                        for x in ([self.special[p]] if i % 2 else self.cut(p))]
        if chunk.isascii():
            return EASY_WORDS.findall(chunk.lower())
        if EASY.fullmatch(chunk):
            return [w.encode().decode("latin-1") for w in EASY_WORDS.findall(chunk.lower())]
        normal = self.normalizer.normalize_str(chunk)
        return [piece.translate(self.as_bytes) for piece, _ in self.pre_tokenizer.pre_tokenize_str(normal)]

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids (i32) of each chunk, remembered across calls."""
        out = [self.young.get(chunk) for chunk in chunks]
        fresh: list[tuple[int, list[str | int]]] = []
        number: dict[str, int] = {}
        for at, (chunk, ids) in enumerate(zip(chunks, out)):
            if ids is not None:
                continue
            ids = self.old.get(chunk)
            if ids is not None:
                out[at] = ids
                self.keep(chunk, ids)
                continue
            pieces = self.cut(chunk)
            for p in pieces:
                if p not in number and isinstance(p, str):
                    number[p] = len(number)
            fresh.append((at, pieces))
        coded = self.words(list(number))
        for at, pieces in fresh:
            got = b"".join([coded[number[p]] if isinstance(p, str) else p.to_bytes(4, "little") for p in pieces])
            out[at] = got
            if len(chunks[at]) < 100:
                self.keep(chunks[at], got)
        return out

    def keep(self, chunk: str, ids: bytes) -> None:
        if len(self.young) >= CACHE_CHUNKS:
            self.old, self.young = self.young, {}
        self.young[chunk] = ids

    def encode_column(self, column: pa.Array) -> pa.ListArray:
        """Ids of each text (null: empty)."""
        text = pc.replace_substring(pc.fill_null(column, ""), "\n", " ")
        lists = pc.split_pattern(text, " ")
        coded = lists.flatten().dictionary_encode()
        ids = self.chunks(coded.dictionary.to_pylist())
        size = np.array([len(x) for x in ids], dtype=np.int64) // 4
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(ids), dtype="<i4")
        which = coded.indices.to_numpy()
        per_chunk = size[which]
        ends = np.r_[0, np.cumsum(per_chunk)]
        source = np.arange(int(ends[-1])) + np.repeat(start[which] - ends[:-1], per_chunk)
        bounds = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
        return pa.ListArray.from_arrays(pa.array(ends[bounds].astype(np.int32)), pa.array(flat[source]))

    def encode(self, text: str) -> list[int]:
        return self.encode_column(pa.array([text], pa.string()))[0].as_py()

    def decode_column(self, ids: pa.Array) -> pa.Array:
        """The tokens' strings of each list, joined by spaces (the file names no
        decoder); null lists and ids outside the vocabulary give nothing."""
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())]
        known = (flat >= 0) & (flat < len(self.known))
        known[known] = self.known[flat[known]]
        ends = np.r_[0, np.cumsum(known)][ends]
        return joined(self.string_table, flat[known], ends)

    def decode(self, ids: list[int]) -> str:
        return self.decode_column(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


def joined(table: pa.Array, index: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Entries of a string table, joined by spaces per list (``ends``: offsets)."""
    lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), table.take(pa.array(index, pa.int64())))
    return pc.binary_join(lists, pa.scalar(" ", table.type))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec (and chunk memory) per Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


Batches = Iterator[pa.RecordBatch]


def _encoded(batches: Batches, path: str) -> Batches:
    """(id, text) batches -> (id, ids)."""
    c = codec(path)
    for batch in batches:
        for piece in text_slices(batch, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([piece.column(0), c.encode_column(piece.column("text"))],
                                             names=[batch.schema.names[0], "ids"])


def _decoded(batches: Batches, path: str) -> Batches:
    """(id, ids) batches -> (id, ids, decoded)."""
    c = codec(path)
    for batch in batches:
        yield batch.append_column("decoded", c.decode_column(batch.column("ids")).cast(pa.string()))


def _sha256(column: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column.cast(pa.large_binary())], pa.string())


def _digests(batches: Batches) -> Batches:
    """(id, ids, decoded) batches -> the query's columns."""
    decimals: list[str] = []
    for batch in batches:
        ids = batch.column("ids")
        flat, n = ids.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(ids).to_numpy()
        if len(flat) and flat.max() >= len(decimals):
            decimals = list(map(str, range(int(flat.max()) + 1)))
            table = pa.array(decimals, pa.large_string())
        listed = joined(table, flat, np.r_[0, np.cumsum(n)]) if len(flat) else pa.array([""] * len(n), pa.large_string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), _sha256(listed), _sha256(batch.column("decoded"))],
            names=[batch.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per document: ``key`` and ``ids`` (array<int>)."""
    path = tokenizer or default_tokenizer()
    schema = StructType([docs.schema[key], StructField("ids", ArrayType(IntegerType()))])
    return docs.select(docs[key], docs[text].alias("text")) \
        .mapInArrow(lambda batches: _encoded(batches, path), schema)


def decode(encoded: DataFrame, key: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """One row per encoded document: ``key``, ``ids`` and ``decoded`` (null ids: empty)."""
    path = tokenizer or default_tokenizer()
    schema = StructType([encoded.schema[key], encoded.schema["ids"], StructField("decoded", StringType())])
    return encoded.select(key, "ids").mapInArrow(lambda batches: _decoded(batches, path), schema)


def op13(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Digests of every document's ids and decoded text, in one pass over the texts."""
    path = tokenizer or default_tokenizer()
    schema = StructType([docs.schema["doc_id"], StructField("n_tokens", LongType()),
                         StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _digests(_decoded(_encoded(batches, path), path)), schema)
