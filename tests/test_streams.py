"""Each stream, fed the files of a folder, gives what its batch form gives."""

import pytest
from pyspark.sql import functions as F

from freightloom.streaming import events

ROWS = [(k, f"2024-01-01 {k // 4:02d}:{15 * (k % 4):02d}:00", k % 3, "error" if k % 5 == 0 else "view", float(k), "{}") for k in range(60)]


@pytest.fixture
def folder(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def run(stream, mode, tmp_path, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_tumbling(spark, folder, tmp_path):
    batch = events.tumbling(spark.read.parquet(folder), "1 hour")
    stream = run(events.tumbling(events.read(spark, folder), "1 hour"), "complete", tmp_path, "tumbling")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_cooldown_keeps_state(spark, folder, tmp_path):
    got = run(events.cooled_down(events.read(spark, folder, 100), 4), "append", tmp_path, "cooled").collect()
    times = {}
    for r in sorted(got, key=lambda r: r["ts"]):
        times.setdefault(r["user_id"], []).append(r["ts"].hour + r["ts"].minute / 60)
    assert times and all(b - a >= 4 for ts in times.values() for a, b in zip(ts, ts[1:]))


def test_dedup(spark, folder, tmp_path):
    twice = spark.read.parquet(folder)
    assert events.deduplicated(twice.union(twice)).count() == len(ROWS)
