"""Shared folder rules."""

from types import SimpleNamespace

import pytest

from sweeplens.session import pin, shared_dir, spread


def fake(master, configured=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: configured),
        sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_configured_folder_wins():
    assert shared_dir(fake("spark://host:7077", "hdfs:///shared")) == "hdfs:///shared"


def test_cluster_without_folder_fails():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(fake("spark://host:7077"))


def test_local_fallback_is_stable():
    assert shared_dir(fake("local[2]")) == shared_dir(fake("local[2]"))


def test_pin_and_spread(spark):
    df = spread(spark.range(100, numPartitions=1))
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert pin(df).count() == 100 and spread(df) is df
