"""Session settings: nothing forced on a cluster, scratch only in a shared folder."""

import types

import pytest

from itemlens import session as S


class FakeBuilder:
    def __init__(self):
        self.conf, self.masters = {}, []

    def appName(self, name):
        return self

    def master(self, m):
        self.masters.append(m)
        return self

    def config(self, k, v):
        self.conf[k] = v
        return self

    def getOrCreate(self):
        return types.SimpleNamespace(sparkContext=types.SimpleNamespace(setLogLevel=lambda level: None))


def test_master_and_shuffle_partitions_are_left_to_the_environment(monkeypatch):
    fake = FakeBuilder()
    monkeypatch.setattr(S, "SparkSession", types.SimpleNamespace(builder=fake))
    S.build_session(None, None)
    assert fake.masters == [] and "spark.sql.shuffle.partitions" not in fake.conf


def fake_session(master, configured=None):
    state = {"dir": None}
    conf = types.SimpleNamespace(get=lambda k, d=None: configured)
    context = types.SimpleNamespace(
        master=master,
        getCheckpointDir=lambda: state["dir"],
        setCheckpointDir=lambda d: state.update(dir=d),
        getConf=lambda: conf,
    )
    return types.SimpleNamespace(sparkContext=context, conf=conf)


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.ensure_checkpoint_dir(fake_session(master))
    assert S.ensure_checkpoint_dir(fake_session(master, "hdfs://x/ckpt")) == "hdfs://x/ckpt"


def test_a_local_master_gets_a_temporary_folder():
    assert "itemlens-ckpt-" in S.ensure_checkpoint_dir(fake_session("local[2]"))


def test_scratch_is_cleared(spark, tmp_path, monkeypatch):
    root = tmp_path / "shared" / "itemlens-scratch"
    monkeypatch.setattr(S, "_scratch_root", lambda session: str(root))
    assert S.materialize(spark.range(3), "to-clear").count() == 3
    assert list(root.glob("to-clear-*/*.parquet"))
    S.clear_scratch(spark)
    assert not root.exists() and root.parent.exists()
