import random
import time

from pyspark.sql import functions as F

from tokenloom.operators import entities as en


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).collect()[0][0]


def test_strip_tags_edges(spark):
    cases = {
        "a < b": "a < b",
        '<a title=">">x</a>': "x",
        "<!-- c -->y": "y",
        "keep <div": "keep ",
        "<script>var t=1;</script>z": "var t=1;z",
        "<p>one</p><br/>two": "onetwo",
        # a '<' opens markup unless white space follows
        "a <3 b> c": "a  c",
        "I <3 you": "I ",
        "price <5 EUR": "price ",
        "price < 5 EUR > 3": "price < 5 EUR > 3",
        "tab <\tx>": "tab <\tx>",
        "ends in <": "ends in ",
        "a<>b": "ab",
        # tags within tags
        "<a <b> c> d": " d",
        "<a <b <c>> x>y<i>z</i>": "yz",
        "<a < b>x": "x",
        "<<b>>x": "x",
        "a <b <c> d": "a ",
        # quotes
        "<a t='>' u=\">\">x": "x",
        "<a t='\">'>x": "x",
        "<a t=\"<b>\">x": "x",
        "<it's>x": "",
        "it's <b>\"bold\"</b> > all": "it's \"bold\" > all",
        # comments, declarations, code
        "a<!-- <b> \" ' > -->c": "ac",
        "a<!-->b<!--->c": "abc",
        "a<!-- open > b": "a",
        "<b t='<!--'>x</b>-->y": "x-->y",
        "<!DOCTYPE d [<!ENTITY e \">\">]>x": "x",
        "<!x \">\" >y": "y",
        "<?php if (1 > 0) echo '?>'; ?>z": "z",
        "<?xml version='1.0'?>z": "z",
        "nul\x00l": "null",
        "": "",
    }
    df = spark.createDataFrame(list(cases.items()), "src string, exp string")
    for r in df.withColumn("got", en.strip_tags(F.col("src"))).collect():
        assert r.got == r.exp, r.src
    assert _one(spark, en.strip_tags, None) is None


def test_strip_tags_equals_a_plain_scanner(spark):
    """Random texts of markup characters against a loop with depth and quote."""
    def scan(text):
        out, i = [], 0
        while i < len(text):
            if text[i] != "<" or text[i + 1:i + 2].isspace():
                out.append(text[i])
                i += 1
                continue
            depth, quote = 0, None
            while i < len(text):
                c = text[i]
                if quote:
                    quote = None if c == quote else quote
                elif c in "\"'":
                    quote = c
                elif c == "<" and not text[i + 1:i + 2].isspace():
                    depth += 1
                elif c == ">":
                    depth -= 1
                i += 1
                if depth == 0:
                    break
        return "".join(out)

    rng = random.Random(7)
    texts = ["".join(rng.choice("<<>>ab \"'") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", en.strip_tags(F.col("t")).alias("got")).collect():
        assert r.got == scan(r.t), r.t


def test_strip_tags_is_linear_on_broken_markup(spark):
    n = 300_000
    texts = {"<a " * n: "", "x <b \"" * n: "x ", "<b>" * n + "t": "t", "a < b " * n: "a < b " * n,
             "<p>" + "y" * n + "<" + "z" * n: "y" * n, "<!-- " * n + "-->q": "q", "<" * n + ">" * n + "k": ""}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    start = time.monotonic()
    got = {r.i: r.s for r in df.select("i", en.strip_tags(F.col("t")).alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
    assert time.monotonic() - start < 30


def test_entity_text_filters_falsy_and_trims(spark):
    rows = [(1, "0", "<b>short</b>", "", 1), (2, "", "", "", 1), (3, "  ", "\t", "", 1),
            (4, "\x0bname\x00", None, "<p>desc</p>", 1), (5, "off", "", "", 2)]
    df = spark.createDataFrame(rows, "entity_id long, name string, short_description string, "
                                     "description string, status int")
    got = {r.entity_id: r.text for r in en.product_text(en.enabled_products(df)).collect()}
    # '0' dropped; only the ends of the joined text are trimmed, inner NUL stays
    assert got == {1: "short", 4: "name\x00 desc"}


def test_normalize_messages_roles_and_system_prompt(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "customer", "a"), (1, 2, "system", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    msgs = en.normalize_messages(df, "sys").collect()[0].messages
    assert [(m.role, m.content) for m in msgs] == [("system", "sys"), ("user", "a"), ("assistant", "b"),
                                                    ("system", "")]
    assert en.first_prompt(df).collect()[0].first_prompt == "a"


def test_parse_call_log_roundtrip_and_rejects(spark):
    lines = spark.createDataFrame(
        [("[2024-01-02 03:04:05] consumer=_direct platform=openai model=gpt-4o in=10 out=20 cost=$0.000225",),
         ("garbage",)], "value string")
    rows = en.parse_call_log(lines).collect()
    assert rows[0].parsed and rows[0].input_tokens == 10 and str(rows[0].estimated_cost) == "0.000225"
    assert not rows[1].parsed and rows[1].rejected_line == "garbage"


def test_call_log_files_roundtrip(spark, small):
    from tokenloom.catalog import priced_calls
    from tokenloom.session import scratch_path
    from tokenloom.sources.logs import read_call_log, write_call_log
    calls = priced_calls(spark, small)
    path = scratch_path(spark, "log-files")
    write_call_log(calls, path)
    spark.createDataFrame([("not a log line",)], "value string").write.mode("append").text(path)
    parsed, rejects = read_call_log(spark, path)
    cols = ["called_at", "consumer", "platform", "model", "input_tokens", "output_tokens", "estimated_cost"]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted(map(tuple, parsed.select(*cols).collect()), key=key)
    assert got == sorted(map(tuple, calls.select(*cols).collect()), key=key)
    assert [r.value for r in rejects.collect()] == ["not a log line"]
