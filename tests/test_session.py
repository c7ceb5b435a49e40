"""The scratch folder: shared where configured, local only on one machine."""

import pytest

from ledgerlens import session


class _Context:
    def __init__(self, master):
        self.master = master
        self.dir = None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class _Spark:
    def __init__(self, master, conf=None):
        self.sparkContext = _Context(master)
        self.conf = conf or {}


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"])
def test_cluster_without_shared_folder_is_refused(master):
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        session.scratch_path(_Spark(master), "t")


def test_configured_folder_is_used_on_any_master():
    s = _Spark("yarn", {"spark.checkpoint.dir": "hdfs://nn/ck"})
    assert session.scratch_path(s, "t").startswith("hdfs://nn/ck/")


def test_local_master_gets_its_own_folder():
    assert session.ensure_checkpoint_dir(_Spark("local[2]"))
    assert session.ensure_checkpoint_dir(_Spark("local"))


def test_drop_scratch_deletes_only_scratch(spark, tmp_path):
    other = spark.newSession()
    old = other.sparkContext.getCheckpointDir()
    try:
        other.sparkContext.setCheckpointDir(str(tmp_path))
        path = session.scratch_path(other, "t")
        other.range(3).write.parquet(path)
        other.range(3).write.parquet(str(tmp_path / "kept"))
        session.drop_scratch(other)
        assert other.read.parquet(str(tmp_path / "kept")).count() == 3
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            other.read.parquet(path)
    finally:
        other.sparkContext._jsc.sc().setCheckpointDir(old.rsplit("/", 1)[0])
