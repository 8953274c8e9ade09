from types import SimpleNamespace

import pytest

from lumenar.session import cut_lineage, clear_cuts, shared_dir


def fake(master, where=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: where or default, set=lambda key, value: None), sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1000]"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(fake(master))
    assert shared_dir(fake(master, "hdfs://x/y")) == "hdfs://x/y"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]", "local[2,3]"])
def test_a_single_process_may_make_one(master):
    assert "lumenar-shared-" in shared_dir(fake(master))


def test_cuts_are_deleted(spark, tmp_path):
    df = cut_lineage(spark.range(5))
    path = df.inputFiles()[0].removeprefix("file:").removeprefix("//")
    assert df.count() == 5
    clear_cuts(spark)
    import os

    assert not os.path.exists(path)
