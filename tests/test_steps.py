from __future__ import annotations

import os

import pytest

from guardlake.functions import steps


def test_steps_stand_in_the_shared_folder_until_removed(spark):
    rows = steps.written(spark.range(3), "x")
    path = rows.inputFiles()[0]
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and spark.sparkContext.applicationId in path
    other = steps.new_path(spark, "x")
    spark.range(2).write.parquet(other)
    steps.remove_path(spark, other)
    steps.remove_path(spark, other)
    assert not os.path.exists(other.removeprefix("file://")) and rows.count() == 3


class _Context:
    def __init__(self, master, base=None):
        self.master, self.base, self.set = master, base, None

    def getConf(self):  # noqa: N802
        return {"spark.checkpoint.dir": self.base} if self.base else {}

    def getCheckpointDir(self):  # noqa: N802
        return self.set

    def setCheckpointDir(self, path):  # noqa: N802
        self.set = path


class _Session:
    def __init__(self, *a):
        self.sparkContext = _Context(*a)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError):
        steps.shared_dir(_Session(master))
    assert steps.shared_dir(_Session(master, "hdfs://x/y/")) == "hdfs://x/y"


def test_a_local_session_may_do_without():
    assert steps.shared_dir(_Session("local[2]")).startswith("file:///")


def test_spread_deals_out_small_tables_only(spark):
    one = spark.range(100).coalesce(1)
    assert steps.spread(one).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 50)
    assert steps.spread(many) is many


def test_a_stages_steps_go_and_its_result_stays(spark):
    with steps.stage_steps(spark) as keep:
        inner = steps.written(spark.range(5), "inner")
        out = keep(inner.filter("id > 1"), "result")
        path = inner.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert out.count() == 3 and not os.path.exists(path)
    assert "stage-" not in steps.new_path(spark, "x")
