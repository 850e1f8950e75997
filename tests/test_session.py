import os
from types import SimpleNamespace

import pytest
from conftest import rows

from triagelake.session import cut_lineage, intermediates, new_path, shared_dir


def fake(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_shared_folder_is_the_one_the_cluster_names():
    assert shared_dir(fake("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"
    assert shared_dir(fake("local[2]", "hdfs://x/y/")) == "hdfs://x/y"


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[2,1,1024]", "yarn"])
def test_a_cluster_without_the_setting_is_an_error(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        new_path(fake(master))


def test_a_single_process_gets_its_own_folder():
    local = shared_dir(fake("local[2]"))
    assert os.path.isdir(local) and local == shared_dir(fake("local"))


def test_cut_table_has_the_same_rows(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, None, None)], "i int, s string, a array<double>")
    cut = cut_lineage(df)
    assert rows(cut) == rows(df) and cut.schema == df.schema
    assert "LocalTableScan" not in cut._jdf.queryExecution().toString()


def test_a_scope_leaves_no_folder_behind(spark):
    before = set(os.listdir(shared_dir(spark)))
    with intermediates(spark):
        assert cut_lineage(spark.range(3)).count() == 3
        assert set(os.listdir(shared_dir(spark))) > before
    assert set(os.listdir(shared_dir(spark))) == before
