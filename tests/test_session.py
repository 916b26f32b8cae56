from types import SimpleNamespace

import pytest

from lexigrove.session import scratch, shared_folder


def bare(master, checkpoint=None, **conf):
    """A session that knows only its settings and its checkpoint folder."""
    folder = [checkpoint]
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder[0], setCheckpointDir=lambda path: folder.__setitem__(0, path))
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError):
        shared_folder(bare("local-cluster[2,1,1024]"))
    with pytest.raises(RuntimeError):
        shared_folder(bare("yarn"))


def test_given_folders_come_first():
    assert shared_folder(bare("yarn", **{"spark.checkpoint.dir": "store:/a"})) == "store:/a"
    assert shared_folder(bare("yarn", "store:/b")) == "store:/b"


def test_a_local_session_keeps_one_folder():
    spark = bare("local[2]")
    assert shared_folder(spark) == shared_folder(spark)


def test_a_real_session_writes_there(spark):
    path = scratch(spark, "session-test")
    spark.range(3).write.parquet(path)
    assert path.startswith(shared_folder(spark)) and spark.read.parquet(path).count() == 3
