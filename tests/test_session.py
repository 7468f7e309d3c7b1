"""Materialised intermediates: same rows, written under the session's checkpoint directory."""

import pytest

from lcarank import session
from lcarank.session import ensure_checkpoint_dir, materialize


class _Cluster:
    """What ensure_checkpoint_dir asks of a session whose master is a cluster and whose folder is unset."""

    master = "spark://host:7077"

    def __init__(self):
        self.sparkContext = self.conf = self

    def getCheckpointDir(self):
        return None

    def getConf(self):
        return self

    def get(self, key, default=None):
        return default


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_Cluster())


def test_materialize_round_trip_under_checkpoint_dir(spark):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, None, [])], "id int, s string, xs array<int>")
    m = materialize(df)
    assert sorted(m.collect()) == sorted(df.collect())
    base = ensure_checkpoint_dir(spark).rstrip("/").replace("file:", "")
    assert m.inputFiles() and all(base in f for f in m.inputFiles())
    assert "Scan parquet" in m._jdf.queryExecution().executedPlan().toString()   # columnar re-read
