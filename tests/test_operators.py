"""Small worked examples, and what the DuckDB comparison doesn't reach."""

import json
import random

import pytest
from pyspark.sql import functions as F

from freightloom.functions import scalar as S
from freightloom.functions import text as T
from freightloom.operators import clean as C
from freightloom.operators import decide as D
from freightloom.operators import joins as J
from freightloom.operators import models as M
from freightloom.operators import ranked as R
from freightloom.operators import routes as RT
from freightloom.operators import windows as W
from freightloom.sources import files


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_scalars(spark):
    n = F.lit(None).cast("double")
    got = one(
        spark, S.clipped(n, 0, 1), S.clipped(F.lit(2.0), 0, 1), S.is_usable(F.lit(float("nan"))), S.is_usable(F.lit(1.0)), S.even_rounded(F.lit(2.5)), S.product([F.lit(2.0), n]),
        S.clock(F.lit(1501.0)), S.any_of([F.lit(None).cast("boolean"), F.lit(True)]), S.nearest_signed_days(F.lit("2024-01-03").cast("date"), ["2024-01-01", "2024-01-05"], 30),
        S.in_season(F.lit("2024-01-03").cast("date"), (11, 20), (1, 5)), S.first_largest({"a": F.lit(1), "b": F.lit(2), "c": F.lit(2)}), S.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)),
    )
    assert got[:11] == (None, 1.0, False, True, 2.0, 2.0, "01:01", True, 2, True, "b")
    assert got[11] == pytest.approx(3958.8 * 3.141592653589793)


def test_text(spark):
    got = one(
        spark, T.phonetic(F.lit("Robert")), T.swapped_once(F.lit("1324"), F.lit("1234")), T.swapped_once(F.lit("1423"), F.lit("1234")), T.swapped_once(F.lit("12"), F.lit("12")), T.jaccard(F.array(), F.array()),
        T.token_overlap(F.lit("apt #4 b"), F.lit("4 b c")), T.sorted_chars(F.lit("2110")), T.label(F.lit(" Late Scan ")),
    )
    assert got == ("RBRT", True, False, False, 1.0, 0.5, "0112", "late_scan")


def test_cleaning_rules_and_audit(spark):
    df = spark.createDataFrame([(1, 5.0, " A"), (1, 4.0, "a"), (2, 999.0, "b"), (3, None, "b"), (4, 8.0, None)], "k int, v double, c string")
    rules = C.Rules(keys=["k"], order=["v"], labels=["c"], bounds={"v": (0, 100)}, medians=["v"])
    got = {r["k"]: (r["v"], r["c"], r["v__was_missing"]) for r in C.cleaned(df, rules).collect()}
    assert got == {1: (4.0, "a", 0), 2: (6.0, "b", 1), 3: (6.0, "b", 1), 4: (8.0, None, 0)}
    assert {r["step"]: r["rows_affected"] for r in C.audit(df, rules).collect()} == {"duplicates": 1, "label:c": 0, "bounds:v": 1}
    with pytest.raises(C.SchemaError):
        C.require_columns(df, ["k", "absent"])
    with pytest.raises(C.SchemaError):
        C.forbid_columns(df, ["v"])


def test_causal_history(spark):
    df = spark.createDataFrame([(1, k, y) for k, y in enumerate([1, 0, 1, 0])], "c int, t int, y int")
    got = W.causal_history(df, ["c"], ["t"], F.col("y"), "h").orderBy("t").collect()
    assert [r["h_count"] for r in got] == [0, 1, 2, 3] and [r["h_rate"] for r in got] == pytest.approx([0, 1, 0.5, 2 / 3])


def test_running_rank_over_many_ranges(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.randint(0, 50)) for k in range(2000)]
    got = R.running(spark.createDataFrame(rows, "k int, v int"), [F.desc("v"), F.col("k")], {"s": F.col("v")}).collect()
    total = 0
    for r, (k, v) in zip(sorted(got, key=lambda r: r["rank"]), sorted(rows, key=lambda r: (-r[1], r[0]))):
        total += v
        assert (r["k"], r["s"]) == (k, total)
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 2001))
    assert R.running(spark.createDataFrame([], "k int"), [F.col("k")]).count() == 0


def test_greedy_fill_passes_over_misfits(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.choice([8.0, 40.0, 120.0]), rnd.random()) for k in range(300)]
    left, want = 777.0, set()
    for k, cost, _ in sorted(rows, key=lambda r: (-r[2] / r[1], r[0])):
        if cost <= left:
            left -= cost
            want.add(k)
    df = spark.createDataFrame(rows, "k int, cost double, gain double")
    got = D.greedy_fill(df, [F.desc(F.col("gain") / F.col("cost")), F.col("k")], "cost", 777.0)
    assert {r["k"] for r in got.collect()} == want
    assert D.greedy_fill(df, [F.col("k")], "cost", 1.0).count() == 0


def test_cooldown_counts_from_the_last_action(spark):
    df = spark.createDataFrame([("a", f"2024-01-{k:02d}") for k in (1, 3, 6, 8, 11)], "u string, day string").withColumn("day", F.to_date("day"))
    assert sorted(str(r["day"]) for r in D.cooled_down(df, ["u"], "day", 5).collect()) == ["2024-01-01", "2024-01-06", "2024-01-11"]


def test_coupled_cusum_takes_shared_shocks_out(spark):
    rows = [(f"2024-01-{k:02d}", lane, (3.0 if k > 5 else 0.0) + (2.0 if lane == "x" and k > 8 else 0.0)) for k in range(1, 15) for lane in "uvwx"]
    df = spark.createDataFrame(rows, "day string, lane string, z double").withColumn("w", F.lit(1.0))
    got = D.coupled_cusum(df, "day", "lane", "z", "w", 0.25, 4.0, 1.0).where("alarm").collect()
    assert got and {r["lane"] for r in got} == {"x"}


def test_lookback_and_asof(spark):
    left = spark.createDataFrame([("a", "2024-02-01"), ("b", "2024-02-01")], "k string, d string").withColumn("d", F.to_date("d"))
    right = spark.createDataFrame([("a", "2024-01-18"), ("a", "2024-01-20"), ("a", "2024-01-02"), ("a", "2024-02-01"), ("a", "2024-03-01")], "k string, f string").withColumn("f", F.to_date("f"))
    assert {r["k"]: str(r["f"]) for r in J.lookback_first(left, right, ["k"], "d", "f", 1, 14).collect()} == {"a": "2024-01-18", "b": "None"}
    assert {r["k"]: str(r["f"]) for r in J.asof_after(left, right, ["k"], "d", "f").collect()} == {"a": "2024-02-01", "b": "None"}


def test_checked_join_raises(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="more than one row"):
        J.checked_left(left, right, ["k"]).collect()


def test_routes_are_valid_and_bounded(spark):
    rnd = random.Random(3)
    rows = [(f"i{k % 2}", k, rnd.random() - 0.5, rnd.random() - 0.5, float(rnd.randint(1, 9))) for k in range(60)]
    stops = spark.createDataFrame(rows, "instance string, stop long, x double, y double, packages double")
    miles = {}
    for method in ("zones", "nearest", "savings", "savings_2opt"):
        routes = RT.solved(stops, 40.0, method)
        assert RT.route_problems(routes, stops, 40.0).count() == 0
        miles[method] = routes.select("instance", "truck", "miles").distinct().agg(F.sum("miles")).first()[0]
    assert miles["savings_2opt"] <= miles["savings"] + 1e-9 <= miles["nearest"] + 1
    assert RT.route_problems(RT.solved(stops, 40.0).where("stop <> 5"), stops, 40.0).first()["problem"] == "stop 5"


def test_quantile_leaves_are_in_order(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(float(k % 5), rnd.gauss(k % 5, 1 + k % 3)) for k in range(600)], "x double, y double")
    for r in M.quantile_leaves(df, df, ["x"], "y", [0.1, 0.5, 0.9]).collect():
        assert r["q_10"] <= r["q_50"] <= r["q_90"]


def test_csv_with_a_mark_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Id,Speed [rpm],Leak\n1,5.5,x\n2,bad,y\n", encoding="utf-8")
    got = files.csv_renamed(spark, str(tmp_path / "a.csv"), {"Id": "id", "Speed [rpm]": "speed"}, {"id": "int", "speed": "double"})
    assert [tuple(r) for r in got.collect()] == [(1, 5.5), (2, None)]
    with pytest.raises(C.SchemaError):
        files.csv_renamed(spark, str(tmp_path / "a.csv"), {"Absent": "x"}, {})
    with pytest.raises(FileNotFoundError, match="b.csv"):
        files.star(spark, str(tmp_path), {"a": "a.csv", "b": "b.csv"}, lambda s, p: s.read.csv(p))
    got = files.records(spark, [{"id": 1, "day": "2024-01-02"}, {"id": 2, "day": "soon"}], "id int, day date", ["day"]).collect()
    assert [str(r["day"]) for r in got] == ["2024-01-02", "None"]
    assert json.loads(files.to_json({"a": float("nan"), "b": [1, {"c": 2.5}]})) == {"a": None, "b": [1, {"c": 2.5}]}
    assert files.to_markdown(spark.createDataFrame([("x", 1.0), ("y", 2.0)], "n string, v double")).splitlines()[-1] == "| mean | 1.500 |"


def test_routing_files(spark, tmp_path):
    (tmp_path / "t.vrp").write_text("NAME : toy\r\nCAPACITY : 10\r\nNODE_COORD_SECTION\r\n1\t0 0\r\n2 3 4\r\n3 6 8\r\nDEMAND_SECTION\r\n1 0\r\n2 4\r\n3 5\r\nDEPOT_SECTION\r\n 1\r\n -1\r\nEOF\r\n")
    got = files.routing_instances(spark, str(tmp_path / "t.vrp")).orderBy("node").collect()
    assert [(r["name"], r["capacity"], r["node"], r["x"], r["demand"], r["is_depot"]) for r in got] == [("toy", 10.0, 1, 0.0, 0.0, True), ("toy", 10.0, 2, 3.0, 4.0, False), ("toy", 10.0, 3, 6.0, 5.0, False)]
    assert files.stop_frame(files.routing_instances(spark, str(tmp_path / "t.vrp"))).count() == 2
    (tmp_path / "t.sol").write_text("Route #1: 2 3\nRoute #2: 4\nCost 27\n")
    assert [(r["route"], r["seq"], r["node"], r["cost"]) for r in files.routing_solutions(spark, str(tmp_path / "t.sol")).orderBy("route", "seq").collect()] == [(1, 0, 2, 27.0), (1, 1, 3, 27.0), (2, 0, 4, 27.0)]
