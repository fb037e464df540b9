"""Queries over made events: values that the given tables don't have."""

from datetime import datetime, timedelta

import duckdb
import pytest

from freightloom.plans import QUERIES

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def tables(spark, folder, files):
    """A folder with a table of events (user, day, value), a list for each of its files, and its view in DuckDB."""
    start, at = datetime(2024, 1, 1), 0
    for rows in files:
        data = [(k, start + timedelta(days=day, seconds=k), user, "view", value, "{}") for k, (user, day, value) in enumerate(rows, at)]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
        at += len(rows)
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM (SELECT * FROM '{folder}/events.parquet/*.parquet' ORDER BY event_id)")
    return str(folder), con


def test_a_trend_of_nothing_is_no_error(spark, tmp_path):
    from oracle import assert_equal

    folder, con = tables(spark, tmp_path, [[(1, 0, 0.0), (1, 1, 3.0), (2, 0, 0.0), (2, 1, -1.0), (2, 2, 1.0), (3, 0, None), (3, 1, 2.0)]])
    assert_equal(QUERIES["win_trend_pct"].build(spark, folder), con, QUERIES["win_trend_pct"].sql)


@pytest.mark.parametrize("name", ["card_dispatch_fleet", "win_rank_topfrac_daily", "agg_capacity_metrics"])
def test_sums_that_rank_dont_depend_on_how_rows_are_dealt(spark, tmp_path, name):
    """0.1 + 0.2 + 0.3 is more than 0.6 from left to right, and not if the last two are added first."""
    from oracle import assert_equal

    users = range(1, 40)
    firsts = [(user, 0, 0.1) for user in users]
    lasts = [(user, 0, v) for user in users for v in (0.2, 0.3)] + [(user, 1, 0.6) for user in users]
    single = [(user, day, 0.6) for user in range(-40, 0) for day in (0, 1)]
    folder, con = tables(spark, tmp_path, [firsts, lasts + single])
    assert_equal(QUERIES[name].build(spark, folder), con, QUERIES[name].sql)
