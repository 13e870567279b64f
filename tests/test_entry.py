import pytest

import __spark_entry__ as entry_mod


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert "request_count" in df.columns


def test_every_query_has_oracle_or_is_listed():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q)
    missing = set(entry_mod.QUERIES) - set(o)
    assert missing <= {"ann_topk"}, missing   # approximate: checked for recall in test_vectors


def test_checkpoint_root_when_unset():
    from tokenloom.session import FALLBACK_KEY, checkpoint_root

    class Conf(dict):
        def get(self, k, d=None):
            return dict.get(self, k, d)

        def set(self, k, v):
            if k.startswith("spark.") and k != FALLBACK_KEY:
                raise AssertionError("core settings must not be changed at runtime")
            self[k] = v

    class SC:
        dir = None
        master = "local[4]"

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, d):
            self.dir = d

    class S:
        conf = Conf()
        sparkContext = SC()

    s = S()
    root = checkpoint_root(s)
    assert s.sparkContext.dir == root and s.conf[FALLBACK_KEY] == root
    assert checkpoint_root(s) == root
    cluster = S()
    cluster.conf, cluster.sparkContext = Conf(), SC()
    cluster.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError):
        checkpoint_root(cluster)
