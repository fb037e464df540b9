"""Scratch tables: where they go, and that they go away."""

import os

import pytest

from freightloom.operators import scratch


class Named:
    """A session that only has settings."""

    def __init__(self, **settings):
        self.conf = self
        self.settings = settings

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value


def test_a_cluster_must_name_a_shared_folder():
    with pytest.raises(ValueError):
        scratch.folder(Named(**{"spark.master": "spark://host:7077"}))
    assert scratch.folder(Named(**{"spark.master": "spark://host:7077", "spark.checkpoint.dir": "s3://a/b/", "spark.app.id": "app-1"})) == "s3://a/b/freightloom-app-1"
    local = Named(**{"spark.master": "local[2]"})
    assert os.path.isdir(os.path.dirname(scratch.folder(local))) and scratch.folder(local) == scratch.folder(local)


def test_tables_are_written_and_dropped(spark):
    df = scratch.written(spark.range(10).toDF("n"))
    folder = scratch.folder(spark)
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir")) and sorted(r.n for r in df.collect()) == list(range(10))
    name = df.inputFiles()[0].split("://")[-1].rsplit("/", 1)[0]
    name = "/" + name.lstrip("/")
    assert os.path.isdir(name) and folder in name
    scratch.dropped(df, spark.range(3).toDF("n"))
    assert not os.path.exists(name) and os.path.isdir(folder)


def test_written_leaves_no_shuffle_files(spark):
    import time

    from pyspark.sql import functions as F

    from freightloom.operators.scratch import written

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(k).getName() for k in range(files.size())) if n.startswith("shuffle_")}

    before = shuffled()
    written(spark.range(1000).repartition(3, F.col("id") % 7))
    for _ in range(50):  # executors delete them a moment later
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left
