"""Operator 13 against the tokenizers library and against merging by rank."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tokenloom.llm import bpe

PATH = bpe.default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe.Codec(PATH)


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = CODEC.encode(text)
    assert got == want, repr(text)[:200]
    assert CODEC.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", [
    "", " ", "\t\n\x0b\x0c\r", "it's don't'll've \"'s 's's '", "Hello\x0bworld a\x85b c d a\x1cb",
    "ΑΣ ς İx ẞ é é é ́x", "日本語 テスト ...", "x<|endoftext|>Y<|startoftext|><|endoftext|", "123 4½ ٣",
    "a‍b \U0001f468‍\U0001f469", "aaaaaaaaaaaaaaaaaaaa", "the the The THE</w>", "\x00\x7f�"])
def test_literal_texts(text):
    same(text)


def test_random_texts():
    random.seed(1)
    alphabets = ["ab", "thein ", "aeiou lnrst'", "é́ßΣσ a1,.<|>'sS日本‍", "".join(map(chr, range(32, 127)))]
    for _ in range(1500):
        letters = random.choice(alphabets)
        same("".join(random.choice(letters) for _ in range(random.randint(1, 80))))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    same(text)


def merged(symbols):
    """Plain BPE: the lowest-ranked pair, leftmost first, until none is left."""
    while len(symbols) > 1:
        rank, at = min((CODEC.ranks.get(a << 20 | b, bpe.NEVER), i)
                       for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
        if rank == bpe.NEVER:
            break
        whole = next(t for t in (CODEC.made.index(rank),))
        symbols[at:at + 2] = [whole]
    return symbols


def test_last_token_of_every_prefix():
    """The stored token is the last one of plain BPE on that prefix alone."""
    base = {s: i for i, s in CODEC.strings.items()}
    of_byte = {b: c for c, b in CODEC.byte_of.items()}
    random.seed(2)
    for _ in range(40):
        word = "".join(random.choice("theinarsd") for _ in range(14))
        ids = [base[of_byte[b]] for b in word.encode()]
        last = CODEC.last_tokens(word)
        for n in range(1, len(ids) + 1):
            assert merged(ids[:n])[-1] == last[n - 1]


def test_long_runs_are_linear_and_exact():
    random.seed(3)
    for text in ("a" * 100_000, "".join(random.choice("abcdefghijklmnop") for _ in range(100_000))):
        same(text)


def expected(rows):
    out = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_on_whole_table(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, bpe.op13(docs).collect()), key=str) == expected(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    odd = odd_docs.withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1))
    assert sorted(map(tuple, bpe.op13(odd).collect()), key=str) == expected(rows)
    assert bpe.op13(no_docs).collect() == []


def test_interface_round_trip(spark, odd_docs):
    encoded = bpe.encode(odd_docs)
    back = {(r["doc_id"], r["decoded"]) for r in bpe.decode(encoded).collect()}
    want = {(r["doc_id"], LIBRARY.decode(LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids,
                                         skip_special_tokens=False)) for r in odd_docs.collect()}
    assert back == want
    missing = spark.createDataFrame([(1, None), (2, [99999, 320])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(missing).collect()} == {1: "", 2: CODEC.strings[320]}


def test_memories_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 50)
    monkeypatch.setattr(bpe, "MEMO_PAIRS", 20)
    codec = bpe.Codec(PATH)
    random.seed(5)
    text = " ".join("".join(random.choice("abcdeor") for _ in range(7)) for _ in range(2000))
    assert codec.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == CODEC.encode(text)
    assert len(codec.young) <= 50 and len(codec.old) <= 50 and len(codec.memo) <= 20
