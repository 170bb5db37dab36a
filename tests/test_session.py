from types import SimpleNamespace

import pytest

from rolegrid.session import checkpoint_dir


def session(master, setting=None):
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master=master, applicationId=f"app-{master}", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: setting), sparkContext=context)


def test_the_configured_folder_rules():
    assert checkpoint_dir(session("spark://m:7077", "hdfs://n/c/")) == "hdfs://n/c"


def test_a_single_machine_gets_one_folder_of_its_own():
    one = session("local[2]")
    assert checkpoint_dir(one) == checkpoint_dir(one) != checkpoint_dir(session("local[3]"))


@pytest.mark.parametrize("master", ["spark://m:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_the_setting(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(session(master))
