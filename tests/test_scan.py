"""Sorted scans whose state crosses batches, and greedy filling, against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from freightloom.operators import decide as D

START = datetime.date(2000, 1, 1)


@pytest.fixture
def small_batches(spark):
    """Batches of 64 rows, so that a key's state crosses many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "64")
    yield
    spark.conf.set(name, before)


def days(spark, n, keys):
    rnd = random.Random(n)
    rows = [(rnd.choice(keys), START + datetime.timedelta(days=k), rnd.choice([rnd.gauss(0.2, 1), None])) for k in range(n)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "lane string, day date, z double").repartition(5)


def test_cusum_carries_its_state(spark, small_batches):
    rows, df = days(spark, 3000, ["hot"] * 8 + ["a", None])
    got = {(r["lane"], r["day"]): (r["s"], r["alarm"]) for r in D.cusum(df, ["lane"], "day", "z", 0.25, 3.0).collect()}
    want, state = {}, {}
    for lane, day, z in sorted(rows, key=lambda r: r[1]):
        s = state.get(lane, 0.0)
        if z is not None:
            s = max(0.0, s + z - 0.25)
        want[lane, day] = (s, s >= 3.0)
        state[lane] = 0.0 if s >= 3.0 else s
    assert got == want and any(a for _, a in want.values())


def test_cooldown_carries_its_last_action(spark, small_batches):
    rows, df = days(spark, 2000, ["hot"] * 5 + ["a", "b"])
    twice = df.unionByName(df.limit(300)).unionByName(spark.createDataFrame([("a", None, 1.0)], df.schema))
    got = sorted((r["lane"], r["day"]) for r in D.cooled_down(twice, ["lane"], "day", 7).collect())
    want, last = [], {}
    for lane, day, _ in sorted(rows, key=lambda r: r[1]):
        if lane not in last or (day - last[lane]).days >= 7:
            last[lane] = day
            want.append((lane, day))
    assert got == sorted(want)


def test_a_key_of_a_million_days_is_no_array(spark):
    """All of one key; the scan's plan collects nothing."""
    df = spark.range(1_000_000).select(F.lit("one").alias("lane"), F.date_add(F.lit(START), F.col("id").cast("int")).alias("day"), (F.col("id") % 7 - 3).cast("double").alias("z"))
    out = D.cusum(df, ["lane"], "day", "z", 0.0, 2.5)
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    state, alarms = 0.0, 0
    for k in range(1_000_000):
        state = max(0.0, state + k % 7 - 3)
        if state >= 2.5:
            alarms, state = alarms + 1, 0.0
    assert out.agg(F.count("*"), F.count_if("alarm")).first()[:] == (1_000_000, alarms)


@pytest.mark.parametrize("seed,costs,budget,parts", [(1, [8.0, 40.0, 120.0], 777.0, 4), (2, None, 60.0, 8), (3, None, 5.0, 1024), (4, [1.0], 10.0, 3), (5, [0.0, 5.0], 12.0, 2), (6, None, 1e9, 16), (7, [3.0, 7.0], 0.0, 16)])
def test_greedy_fill_equals_the_serial_scan(spark, seed, costs, budget, parts):
    rnd = random.Random(seed)
    rows = [(k, None if rnd.random() < 0.03 else rnd.choice(costs) if costs else rnd.uniform(0.01, 10), rnd.randint(0, 50)) for k in range(400)]
    left, want = budget, set()
    for k, cost, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        if cost is not None and cost <= left:
            left -= cost
            want.add(k)
    df = spark.createDataFrame(rows, "k int, cost double, worth int").repartition(3)
    got = D.greedy_fill(df, [F.desc("worth"), F.col("k")], "cost", budget, parts).collect()
    assert len(got) == len(want) and {r["k"] for r in got} == want


def test_greedy_fill_of_odd_tables(spark):
    assert D.greedy_fill(spark.createDataFrame([], "k int, cost double"), [F.col("k")], "cost", 5.0).count() == 0
    with pytest.raises(ValueError):
        D.greedy_fill(spark.createDataFrame([(1, -1.0)], "k int, cost double"), [F.col("k")], "cost", 5.0)
