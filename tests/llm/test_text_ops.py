import collections
import hashlib
import re
import sys
import zlib
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import decontam, mixing, secrets, tokens, toxicity

ASSIGN = re.compile(r"((?a:(?i:password|passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base(text):
    text = text or ""
    s = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(s))


def test_secret_base_spans(docs, odd_docs, no_docs):
    for d in (docs, odd_docs):
        want = sorted((r.doc_id or 0, hashlib.sha256(base(r.text).encode()).hexdigest()) for r in d.collect())
        assert sorted((r.doc_id or 0, r.base_sha256) for r in secrets.op4(d).collect()) == want
    assert secrets.op4(no_docs).count() == 0


def test_randomness_battery(spark):
    rng = np.random.default_rng(3)
    alphabet = secrets.ALPHABETS["base62"]
    keys = ["".join(alphabet[i] for i in rng.integers(0, 62, 40)) for _ in range(60)]
    plain = [f"{w}{n:03d}thisisordinarytextwithoutsecrets" for n, w in enumerate(["internationalisation", "documentation"] * 30)]
    rows = [(i, f"a {k} b") for i, k in enumerate(keys)] + [(100 + i, f"a {k} b") for i, k in enumerate(plain)]
    got = {r.doc_id: r.n_random for r in secrets.op4(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(60)) >= 55
    assert sum(got[100 + i] for i in range(60)) == 0


def test_decontamination(spark, docs, odd_docs, no_docs, small):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {r.doc_id: sum(t in r.text for _, t in items) for r in docs.collect()}
    got = {r.doc_id: r.n_items for r in decontam.op6(docs, bench).collect()}
    assert got == want
    left = {r.doc_id for r in decontam.remove_leaks(docs, bench).collect()}
    assert left == {i for i, n in want.items() if not n}
    words = next(t for _, t in items if len(t.split()) > 30).split()
    loose = " ".join(w for n, w in enumerate(words) if n % 6)      # a paraphrase drops every sixth word
    d = spark.createDataFrame([(10 ** 6, "filler " * 90 + loose + " filler" * 90), (10 ** 6 + 1, "filler " * 200)],
                              "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = {r.doc_id: r.contaminated for r in decontam.op6(d, bench).collect()}
    assert got[10 ** 6] and not got[10 ** 6 + 1]
    assert not any(r.contaminated for r in decontam.op6(odd_docs, bench).collect())
    assert decontam.op6(no_docs, bench).count() == 0
    assert decontam.remove_leaks(docs, bench.where("false")).count() == docs.count()


def test_candidate_search_recall(spark, small, docs):
    """Windows that hold an item whole are candidates (recall of the index)."""
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    seqs = decontam.word_sequences(docs, "doc_id")
    items = next(decontam.item_blocks(bench))
    df, n = decontam.document_frequency(seqs, items)
    idf = np.log((1 + n) / (1 + df)) + 1e-3
    s = decontam.Searcher(items, idf, decontam.latent_space(seqs, items, idf))
    rng = np.random.default_rng(5)
    pool = np.concatenate([np.array(r.words, dtype=np.int32) for r in seqs.collect()])
    hits = total = 0
    for i, w in enumerate(items.words):
        at = int(rng.integers(0, len(pool) - 400))
        flat = np.concatenate([pool[at:at + 150], w, pool[at + 150:at + 300]])
        found = {item for _, item, *_ in s.candidates(flat, np.array([0, len(flat)]))}
        hits, total = hits + (i in found), total + 1
    assert hits >= 0.9 * total


def test_planted_paraphrases_match_brute_force(spark):
    """55 to 80 % kept words at every item length, in a text of the benchmark's own
    vocabulary: all leaks that the checks accept, over every window, and short items verbatim."""
    rng = np.random.default_rng(11)
    weight = 1 / np.arange(20, 3020)
    pool = [f"w{k}" for k in rng.choice(3000, 40_000, p=weight / weight.sum())]
    items = [(i, " ".join(pool[100 * i:100 * i + 16 + i % 44])) for i in range(200)]
    items += [(10 ** 6, "quokka zebu ibex numbat")]
    common = collections.Counter(pool)
    rows = []
    for i, text in items:
        w = text.split()
        rare = sorted(range(len(w)), key=lambda k: common[w[k]])     # the answer's words stay
        for share in (0.56, 0.6, 0.7, 0.8):
            n = len(w) if len(w) < 6 else max(-(-len(w) // 3), int(np.ceil(share * len(w))))
            keep = {*rare[:-(-len(w) // 3)]}
            keep |= {int(k) for k in rng.permutation([k for k in range(len(w)) if k not in keep])[:n - len(keep)]}
            kept = [x if k in keep else pool[int(rng.integers(len(pool)))] for k, x in enumerate(w)]
            at = int(rng.integers(20_000, len(pool) - 400))
            rows.append((len(rows), " ".join(pool[at:at + 40] + kept + pool[at + 40:at + 80])))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    seqs = decontam.word_sequences(d, "doc_id")
    block = next(decontam.item_blocks(b))
    df, n = decontam.document_frequency(seqs, block)
    s = decontam.Searcher(block, np.log((1 + n) / (1 + df)) + 1e-3, np.zeros((len(block.vocab), 1)))
    want = set()
    for r in seqs.collect():
        for i, w in enumerate(block.words):
            size = decontam.window_words(len(w))
            if any(s.leak(i, r.words[k:k + size])[0] for k in range(0, len(r.words), decontam.STEP)):
                want.add((r.doc_id, block.ids[i]))
    got = {(r.doc_id, r.item_id) for r in decontam.matches(d, b).collect()}
    assert len(want) > len(rows) / 2 and len(got & want) == len(want) and got == want


def test_paraphrases_come_through_the_latent_space(spark, docs, small):
    """Recall of the cosine at every item length and share of kept words; with a space of
    zeros only verbatim passages are found."""
    items = next(decontam.item_blocks(spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")))
    seqs = decontam.word_sequences(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    df, n = decontam.document_frequency(seqs, items)
    idf = np.log((1 + n) / (1 + df)) + 1e-3
    s = decontam.Searcher(items, idf, decontam.latent_space(seqs, items, idf))
    blind = decontam.Searcher(items, idf, np.zeros((len(items.vocab), 1)))
    rng = np.random.default_rng(3)
    pool = np.concatenate([np.array(r.words, dtype=np.int32) for r in seqs.collect()])
    found, total = {}, {}
    for i, w in enumerate(items.words):
        rare = np.argsort(-idf[items.terms(w)], kind="stable")
        for share in (0.56, 0.65, 0.75, 1.0):
            k = -(-len(w) // 5) + 1
            more = int(np.ceil(share * len(w))) - k
            keep = {*rare[:k].tolist(), *rng.permutation(rare[k:])[:more].tolist()}
            body = [x if at in keep else pool[rng.integers(len(pool))] for at, x in enumerate(w)]
            at = int(rng.integers(len(pool) - 300))
            flat = np.concatenate([pool[at:at + 77], np.array(body, dtype=np.int32), pool[at + 77:at + 200]])
            off = np.array([0, len(flat)])
            size = decontam.window_words(len(w))
            want = [s.leak(i, flat[b:b + size].tolist()) for b in range(0, len(flat), decontam.STEP)]
            if max((x for hit, x in want if hit), default=0) < (0.55 if share < 1 else 0.8):
                continue
            verbatim = any(hit and x >= s.verbatim(i) for hit, x in want)
            key = (share, len(w) // 15)
            total[key] = total.get(key, 0) + 1
            got = any(item == i for _, item, *_ in s.leaks(flat, off))
            found[key] = found.get(key, 0) + got
            assert got or not verbatim
            assert verbatim == any(item == i for _, item, *_ in blind.leaks(flat, off))
    assert len(total) >= 12 and all(found[k] >= 0.9 * total[k] for k in total), (found, total)


def test_long_rows_in_parts(monkeypatch):
    """Hits taken a few at a time give the same windows."""
    rng = np.random.default_rng(4)
    words = [rng.integers(0, 60, 20).astype(np.int32) for _ in range(8)] + [np.array([70, 71], dtype=np.int32)]
    items = decontam.Items(list(range(9)), words)
    flat, off = rng.integers(0, 90, 5000).astype(np.int32), np.array([0, 0, 7, 3000, 5000])
    s = decontam.Searcher(items, np.arange(len(items.vocab)) + 1.0, np.zeros((len(items.vocab), 1)))
    whole = [p.windows(items.terms(flat), off) for p in (s.answer_windows, s.rare_windows)]
    monkeypatch.setattr(decontam, "CELLS", 50)
    parts = [p.windows(items.terms(flat), off) for p in (s.answer_windows, s.rare_windows)]
    assert all(len(a) and (a == b).all() for a, b in zip(whole, parts))


def test_lcs():
    assert decontam.lcs([1, 2, 3, 4], [2, 9, 4, 4]) == 2 and decontam.lcs([1], []) == 0


@pytest.fixture(scope="module")
def label_rows(spark, medium):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id"), "doc_id", "left_semi")
    return d, spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def test_toxicity_held_out(label_rows, spark, odd_docs, no_docs):
    d, labels = label_rows
    got = toxicity.op3(d, labels).join(labels.select("doc_id", "toxic").distinct(), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    toxic = [r.score for r in held if r.toxic]
    clean = [r.score for r in held if not r.toxic]
    auc = np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean])
    assert auc >= 0.9
    odd = toxicity.op3(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count()
    assert all(r.score == 0 for r in toxicity.op3(odd_docs, labels.where("false")).collect())
    assert toxicity.op3(no_docs, labels).count() == 0


def test_mixing_targets(docs, odd_docs, no_docs):
    for d in (docs, odd_docs):
        got = [(r, s) for r, s in zip(*[mixing.assign(d).orderBy("doc_id", "key").collect()] * 2)]
        rows = [r for r, _ in got]
        sizes = {}
        for r in rows:
            sizes[r.source] = sizes.get(r.source, 0) + r.size
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
        target, free, left = {}, set(order), sum(sizes.values())
        while free:
            level = left / sum(weight[s] for s in free)
            over = {s for s in free if weight[s] * level > 3 * sizes[s]}
            for s in over or free:
                target[s] = 3 * sizes[s] if over else weight[s] * level
            free -= over or free
            left -= sum(target[s] for s in over)
        for s in order:
            mine = [r for r in rows if r.source == s]
            assert all(r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 for r in mine)
            taken = sum(p.words for r in mine for p in r.pieces)
            assert abs(taken - floor(target[s] + 1e-9)) <= 1
            assert all(sum(p.words for p in r.pieces) <= 3 * r.size for r in mine)
            at = sorted((p.epoch, p.position) for r in mine for p in r.pieces)
            assert all(0 <= p <= 1 for _, p in at)
    again = mixing.op7(docs).collect()
    assert again == mixing.op7(docs).collect()
    assert mixing.op7(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_mix_returns_whole_documents(docs, odd_docs):
    known = {tuple(r) for r in docs.collect()}
    out = mixing.mix(docs).collect()
    assert {tuple(r) for r in out} <= known
    words = sum(len(r.text.split()) for r in out)
    assert abs(words - sum(len(r[1].split()) for r in known)) <= 0.2 * words
    assert mixing.mix(odd_docs).columns == odd_docs.columns


def test_demand_inversion(spark):
    for knots in mixing.SCHEDULES.values():
        got = spark.range(101).select("id", mixing.invert_demand(mixing.F.col("id") / 100.0, knots).alias("t")).collect()
        xs = np.linspace(0, 1, 20001)
        w = np.interp(xs, [k[0] for k in knots], [k[1] for k in knots])
        area = np.r_[0, np.cumsum((w[1:] + w[:-1]) / 2)]
        area /= area[-1]
        for r in got:
            assert abs(np.interp(r.t, xs, area) - r.id / 100) < 1e-6


def test_token_files_round_trip(docs, odd_docs, no_docs):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokens.default_tokenizer())
    for d in (docs, odd_docs):
        rows = sorted(d.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        got = sorted(tokens.op8(d).collect(), key=lambda r: (r.start, r.doc_id or 0))
        start = 0
        for r, g in zip(rows, got, strict=True):
            ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
            assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    assert tokens.op8(no_docs).count() == 0


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 400_000])
def test_frames(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 60_000).astype("<u2")
    table = tokens.Table(np.bincount(ids, minlength=tokens.IDS) + (np.arange(tokens.IDS) == 7))
    frame = tokens.encode_frame(ids, table)
    assert (tokens.decode_frame(frame, table) == ids).all()
    if n > tokens.LANES * tokens.CHECK_STEPS:
        second = tokens.decode_segment(frame, table, 1)     # from a checkpoint, without the first segment
        a = tokens.LANES * tokens.CHECK_STEPS
        assert (second == ids[a:2 * a]).all()
        assert len(frame) < 2 * n
    if n:
        bad = bytearray(frame)
        bad[-1] ^= 1
        with pytest.raises(ValueError):
            tokens.decode_frame(bytes(bad), table)


def test_word_encoder_equals_the_library():
    enc = tokens.encoder(tokens.default_tokenizer())
    texts = ["", " ", "a  b\tc\nd", "Don't stop, it's 42% <|endoftext|> ok", "ÄÖ ß İstanbul Σίσυφος éte", "x" * 500 + "..",
             "THE!! end.,;: a_b 3.14 \x1f z", "日本語 テスト \U0001f600\U0001f600", "it'S WE'LL 'd"]
    import pyarrow as pa
    flat, sizes = enc.texts(pa.array(texts))
    at = 0
    for t, n in zip(texts, sizes):
        assert flat[at:at + n].tolist() == [*enc.tokenizer.encode(t, add_special_tokens=False).ids, 2], t
        at += n


def test_known_chunks_take_no_python_step():
    """Chunks are split, looked up and joined in columns, not one by one."""
    import pyarrow as pa
    enc = tokens.WordEncoder(tokens.default_tokenizer())
    rng = np.random.default_rng(5)
    words = ["".join(w) for w in rng.choice(list("abcdeéTß"), (8000, 6))]
    texts = [" ".join(w + rng.choice(["", ",", "!!", "***"]) for w in rng.permutation(words)) for _ in range(2)]
    for text in texts:
        calls = [0]

        def count(frame, event, arg):
            calls[0] += event in ("call", "c_call")

        sys.setprofile(count)
        try:
            flat, sizes = enc.texts(pa.array([text]))
        finally:
            sys.setprofile(None)
        assert flat.tolist() == [*enc.tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert calls[0] < 2000


def test_encoder_memory_is_bounded(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(tokens, "CACHE_WORDS", 20)
    enc = tokens.WordEncoder(tokens.default_tokenizer())
    for turn in range(6):
        texts = [f"the {'abcdefg'[turn]}{'hijk'[i % 4]}{'lmnop'[i % 5]}. don't{i}\n " + "y" * 200 for i in range(20)]
        flat, sizes = enc.texts(pa.array(texts))
        want = [[*enc.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert flat.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))
        assert len(enc.known) == len(enc.known_ids) == len(enc.used) <= 40
        assert "y" * 200 not in enc.known.to_pylist()


def test_blocks_end_after_block_tokens(spark):
    """A block ends with the document that reaches BLOCK_TOKENS, however much text is tokenized at a time."""
    docs = spark.range(2400).select(F.col("id").alias("doc_id"), F.lit("a b " * 1000).alias("text"))
    got = tokens.tokenize_blocks(docs).collect()
    assert sum(r.n_tokens for r in got) == 2400 * 2001
    assert sorted(i for r in got for i in r.doc_ids) == list(range(2400))
    assert all(r.n_tokens == sum(r.lengths) == len(r.ids) // 2 < tokens.BLOCK_TOKENS + 2001 for r in got)
    by_part = {}
    for r in sorted(got, key=lambda r: (r.part, r.block)):
        assert r.start_in_part == by_part.get(r.part, 0)
        by_part[r.part] = r.start_in_part + r.n_tokens
