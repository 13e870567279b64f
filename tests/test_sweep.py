"""The whole sweep: effects once, crashes picked up, models that really answered."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import infer as inf
from tokenloom.plans import sweep as sw
from tokenloom.plans import tasklog as tl
from tokenloom.plans import vectorstore as vs
from tokenloom.session import scratch_path
from tokenloom.sources import fixtures as fx
from tokenloom.sources.dims import price_dim

AS_OF = fx.AS_OF
REGISTRY = {"Shop_Model_Callback": {"onDone": lambda task_id, response: None}}


@pytest.fixture
def some_tasks(spark, small):
    return fx.task_log(spark, small).where("task_id < 300")


def started(spark, tasks):
    log = tl.TaskLog.create(spark, scratch_path(spark, "log"), tasks)
    empty = fx.vectors(spark, "/root/testdata/sf0.001").where("false")
    return log, vs.create_vectors(spark, scratch_path(spark, "vec"), empty)


def content(df):
    return sorted(map(str, df.collect()))


def test_a_sweep_that_dies_anywhere_ends_like_one_that_does_not(spark, some_tasks, monkeypatch):
    prices = price_dim(spark)
    whole = started(spark, some_tasks)
    sw.sweep(*whole, inf.StubProvider, REGISTRY, prices, AS_OF, 1)
    broken = started(spark, some_tasks)
    calls = spark.sparkContext.accumulator(0)

    class Counting(inf.StubProvider):
        def complete(self, messages, options):
            calls.add(1)
            return super().complete(messages, options)

    fired = spark.sparkContext.accumulator(0)
    counted = {"Shop_Model_Callback": {"onDone": lambda task_id, response: fired.add(1)}}
    for step in ("fold", "save_embeddings", "call_back"):
        with monkeypatch.context() as m:
            target = tl.TaskLog if step == "fold" else sw
            m.setattr(target, step, lambda *a, **k: (_ for _ in ()).throw(RuntimeError(step)))
            with pytest.raises(RuntimeError, match=step):
                sw.sweep(*broken, Counting, counted, prices, AS_OF, 1)
    sw.sweep(*broken, Counting, counted, prices, AS_OF, 1)
    assert content(broken[0].tasks()) == content(whole[0].tasks())
    assert content(broken[0].effects()) == content(whole[0].effects())
    assert content(vs.read_vectors(broken[1])) == content(vs.read_vectors(whole[1]))
    done = broken[0].effects().where("kind = 'callback'").count()
    assert done > 0 and fired.value == done
    text = some_tasks.where("task_type = 'completion'").select("task_id")
    ran = broken[0].ledger().join(text, "task_id").count()
    assert calls.value == ran                                    # one provider call per task in four runs


def test_callback_claimed_by_a_dead_sweep_is_not_made_again(spark, some_tasks, monkeypatch):
    log, table = started(spark, some_tasks)
    with monkeypatch.context() as m:
        m.setattr(sw, "fire", lambda rows, registry: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError, match="gone"):
            sw.sweep(log, table, inf.StubProvider, REGISTRY, price_dim(spark), AS_OF, 1)
    claimed = log.effects().where("kind = 'callback' AND state = 'claimed'").count()
    fired = spark.sparkContext.accumulator(0)
    sw.sweep(log, table, inf.StubProvider, {"Shop_Model_Callback": {"onDone": lambda t, r: fired.add(1)}},
             price_dim(spark), AS_OF, 1)
    assert claimed > 0 and fired.value == 0
    assert log.effects().where("kind = 'callback' AND state = 'claimed'").count() == claimed


def test_later_outcomes_do_not_repeat_effects(spark, some_tasks):
    log, table = started(spark, some_tasks)
    sw.sweep(log, table, inf.StubProvider, REGISTRY, price_dim(spark), AS_OF, 1)
    before = content(log.effects())
    outcomes = spark.read.parquet(f"{log.store.root}/outcomes/1")
    log.fold(outcomes, price_dim(spark), AS_OF)                                        # the same again
    log.fold(outcomes.withColumn("attempt", F.lit(0)), price_dim(spark), AS_OF)        # an earlier success turns up
    assert [e.split("attempt")[0] for e in content(log.effects())] == [e.split("attempt")[0] for e in before]


def test_answers_are_booked_under_the_model_that_gave_them(spark):
    class Router(inf.Provider):
        def complete(self, messages, options):
            if "two" in messages[-1]["content"]:
                self.last_model, self.last_platform = "gpt-4o-mini", "openai"
            return "ok", 1000, 1000

        def embed(self, texts, options):
            self.last_model = "text-embedding-3-large"
            return [[1.0] for _ in texts], len(texts)

    rows = [(1, "completion", "mistral", "wanted", '[{"role":"user","content":"one"}]', 0),
            (2, "completion", "mistral", "wanted", '[{"role":"user","content":"two"}]', 0),
            (3, "completion", "mistral", "wanted", '[{"role":"user","content":"three"}]', 0),
            (4, "embedding", None, None, '[{"role":"user","content":"x"}]', 0)]
    t = spark.createDataFrame(rows, "task_id long, task_type string, platform string, model string, messages string, "
                                    "retries int").coalesce(1)
    for size in (1, 64):
        got = {r.task_id: (r.platform, r.model) for r in inf.infer_batch(t, Router, embed_batch_size=size).collect()}
        assert got == {1: ("mistral", "wanted"), 2: ("openai", "gpt-4o-mini"), 3: ("mistral", "wanted"),
                       4: ("openai", "text-embedding-3-large")}


def test_only_text_answers_are_sanitised(spark, some_tasks):
    t = some_tasks.limit(30)
    html = "<p onclick=x()>hi</p><script>alert(1)</script>"
    out = t.select("task_id", F.lit(1).alias("attempt"), F.lit(True).alias("ok"), F.lit(html).alias("response"))
    kinds = dict(t.select("task_id", "task_type").collect())
    for r in sw.sanitised(out, t, is_html=True).collect():
        assert (r.response == html) == (kinds[r.task_id] != "completion")


def test_batch_size_next_sweep_and_unknown_callbacks(spark, some_tasks):
    log, table = started(spark, some_tasks)
    for number in (1, 2):
        sw.sweep(log, table, inf.StubProvider, {}, price_dim(spark), AS_OF + dt.timedelta(minutes=number), number,
                 batch_size=7)
        assert log.ledger().count() == 7 * number
    assert {r.detail for r in log.effects().where("kind = 'callback'").collect()} <= {"unknown class"}


def test_few_outcomes_are_held_at_a_time():
    made = []

    def outcomes():
        for i in range(3 * inf.OUTCOME_ROWS + 1):
            made.append(i)
            yield {"task_id": i}

    sizes = []
    for frame in inf._frames(outcomes(), ["task_id"]):
        sizes.append(len(frame))
        assert len(made) == sum(sizes)
    assert sizes == [inf.OUTCOME_ROWS] * 3 + [1]
