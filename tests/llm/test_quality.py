import re
from collections import Counter

from tokenloom.llm import quality as q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(wins)
    inside = {p for i, x in enumerate(wins) if n[x] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def test_measures_match_brute_force(docs, odd_docs):
    for d in (docs, odd_docs):
        want = sorted((r.doc_id or 0, *brute(r.text)) for r in d.select("doc_id", "text").collect())
        got = sorted((r.doc_id or 0, *r[1:]) for r in q.measure(d).select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
        assert got == want


def test_policies_and_ablation_read_only_the_ledger(docs):
    book = q.ledger(docs).cache()
    rows = book.collect()
    for policy in q.POLICIES:
        mask = q.policy_mask(policy)
        for r in q.ablation(book, policy).collect():
            bit = 1 << list(q.RULES).index(r["rule"])
            assert r["n_failed"] == sum(bool(x.failures & bit) for x in rows)
            assert r["n_only"] == sum(x.failures & mask == bit for x in rows)
            assert r["n_kept_without"] == sum(x.failures & mask & ~bit == 0 for x in rows)


def test_filter_keeps_rows_whole(odd_docs, docs, no_docs):
    odd = {r.doc_id for r in q.op9(odd_docs).where("kept").collect()}
    assert {r.doc_id for r in q.filter_documents(odd_docs).collect()} == odd
    kept = {r.doc_id: r for r in q.filter_documents(docs).collect()}
    want = {r.doc_id for r in q.op9(docs).where("kept").collect()}
    assert set(kept) == want
    assert all(kept[r.doc_id] == r for r in docs.collect() if r.doc_id in kept)
    assert q.filter_documents(no_docs).count() == 0 and q.op9(no_docs).count() == 0


def test_no_python_in_the_plan(docs):
    plan = q.op9(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
