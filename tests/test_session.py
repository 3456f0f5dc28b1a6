"""The checkpoint folder: a private one is for local masters only."""

import pytest

from territory_engine.session import ensure_checkpoint_dir


class _Context:
    def __init__(self, master):
        self.master, self.dir = master, None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Session:
    def __init__(self, master, **conf):
        self.sparkContext, self.conf = _Context(master), _Conf({k.replace("_", "."): v for k, v in conf.items()})


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://x", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Session(master))
    assert ensure_checkpoint_dir(_Session(master, spark_checkpoint_dir="hdfs:///shared")) == "hdfs:///shared"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_a_local_master_gets_a_folder(master):
    assert ensure_checkpoint_dir(_Session(master))
