"""Operators that several packages of the inventory have, once for each package's constants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightloom.functions import scalar as S
from freightloom.operators import clean as C
from freightloom.operators import metrics as M
from freightloom.operators import ranked as R
from freightloom.operators import windows as W
from freightloom.plans.panels import TYPE_DAYS, USER_DAYS, type_days, user_days
from freightloom.plans.registry import query, rounded, table
from freightloom.plans.scores import _FORECAST, SCORED, forecasts, scored


def named(name: str, sql: str | None, build: Callable) -> None:
    build.__name__ = name
    query(sql)(build)


# Required columns, and rows outside of a column's domain.
VALIDATED = {
    "validate_schema": ("orders", "o_orderkey", ["o_orderkey", "o_custkey", "o_orderdate"], "o_orderstatus", ["F", "O"]),
    "validate_schema_eta": ("lineitem", "l_orderkey", ["l_orderkey", "l_shipdate"], "l_returnflag", ["A", "N"]),
    "validate_schema_tickets": ("customer", "c_custkey", ["c_custkey", "c_mktsegment"], "c_mktsegment", ["BUILDING", "AUTOMOBILE", "MACHINERY"]),
    "validate_schema_lanes": ("supplier", "s_suppkey", ["s_suppkey", "s_nationkey"], "s_nationkey", list(range(20))),
    "validate_schema_orders": ("part", "p_partkey", ["p_partkey", "p_brand", "p_type"], "p_size", list(range(1, 46))),
}


def _validated(name: str) -> None:
    source, key, needed, column, domain = VALIDATED[name]

    def build(spark, d) -> DataFrame:
        return C.outside_domain(C.require_columns(table(spark, d, source), needed), column, domain).select(key, F.col(column).cast("string").alias("value"))

    named(name, f"SELECT {key}, CAST({column} AS VARCHAR) AS value FROM {source} WHERE {column} NOT IN ({', '.join(map(repr, domain))})", build)


for _name in VALIDATED:
    _validated(_name)


# One model matrix for each package: numbers as they are or logged, flags, one-hot levels; nothing else gets in.
MATRICES = {
    "whitelist_matrix_eta": ("lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], {"l_quantity": False, "l_extendedprice": True}, {"l_linestatus": ["F", "O"]}),
    "whitelist_matrix_ticket": ("orders", ["o_orderkey"], {"o_totalprice": True}, {"o_orderpriority": ["1-URGENT", "2-HIGH", "5-LOW"]}),
    "whitelist_matrix_order": ("part", ["p_partkey"], {"p_retailprice": True, "p_size": False}, {"p_type": ["ECONOMY", "PROMO"]}),
    "whitelist_matrix_pilot": ("customer", ["c_custkey"], {"c_acctbal": False}, {"c_mktsegment": ["BUILDING", "HOUSEHOLD"]}),
    "whitelist_matrix_volume": ("events", ["event_id"], {"value": False}, {"event_type": ["click", "view", "error"]}),
    "whitelist_matrix_lane": ("supplier", ["s_suppkey"], {"s_acctbal": False, "s_nationkey": False}, {}),
    "whitelist_matrix_fleet": ("nation", ["n_nationkey"], {"n_regionkey": False}, {"n_name": ["NATION_0", "NATION_7"]}),
}


def _matrix(name: str) -> None:
    source, keys, numbers, levels = MATRICES[name]
    flat = [(f"{c}_{v}".replace("-", "_"), c, v) for c, vs in levels.items() for v in vs]

    def build(spark, d) -> DataFrame:
        df = C.require_columns(table(spark, d, source), [*keys, *numbers, *levels])
        shown = [(F.log1p(c) if logged else F.col(c).cast("double")).alias(f"x_{c}") for c, logged in numbers.items()]
        return rounded(df.select(*keys, *shown, *[(F.col(c) == v).cast("double").alias(a) for a, c, v in flat]))

    said = [f"round({f'ln(1 + {c})' if logged else f'CAST({c} AS DOUBLE)'}, 4) AS x_{c}" for c, logged in numbers.items()]
    named(name, f"SELECT {', '.join([*keys, *said, *[f'CAST({c} = {v!r} AS DOUBLE) AS {a}' for a, c, v in flat]])} FROM {source}", build)


for _name in MATRICES:
    _matrix(_name)


# The columns of training in their order; an absent one is 0.
ALIGNED = {
    "align_columns_eta": ("lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_tax", "gone", "l_quantity"]),
    "align_columns_ticket": ("orders", ["o_orderkey"], ["gone", "o_totalprice"]),
    "align_columns_order": ("part", ["p_partkey"], ["p_size", "p_retailprice", "gone"]),
    "align_columns_volume": ("events", ["event_id"], ["value", "gone"]),
    "align_columns_lane": ("supplier", ["s_suppkey"], ["s_nationkey", "gone", "s_acctbal"]),
    "align_columns_price": ("customer", ["c_custkey"], ["gone", "c_acctbal", "c_nationkey"]),
    "align_columns_fleet": ("nation", ["n_nationkey"], ["n_regionkey", "gone"]),
}


def _aligned(name: str) -> None:
    source, keys, want = ALIGNED[name]

    def build(spark, d) -> DataFrame:
        df = table(spark, d, source)
        return rounded(df.select(*keys, *[(F.col(c).cast("double") if c in df.columns else F.lit(0.0)).alias(f"x_{c}") for c in want]))

    said = [f"{'0.0::DOUBLE' if c == 'gone' else f'round(CAST({c} AS DOUBLE), 4)'} AS x_{c}" for c in want]
    named(name, f"SELECT {', '.join([*keys, *said])} FROM {source}", build)


for _name in ALIGNED:
    _aligned(_name)


# A test part behind a quantile of time.
SPLITS = {
    "time_split_quantile_eta": ("lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_shipdate", 0.75),
    "time_split_quantile_ticket": ("events", ["event_id"], "ts", 0.8),
    "time_split_quantile_order": ("orders", ["o_orderkey"], "o_orderdate", 0.7),
    "time_split_quantile_quote": ("orders", ["o_orderkey"], "o_orderdate", 0.9),
}


def _split(name: str) -> None:
    source, keys, at, q = SPLITS[name]

    def build(spark, d) -> DataFrame:
        df = table(spark, d, source).withColumn("at", F.unix_micros(F.col(at).cast("timestamp")))
        return df.select(*keys, (F.col("at") > F.lit(R.quantiles(df, "at", [q])[0])).alias("is_test"))

    named(name, f"WITH c AS (SELECT quantile_cont(epoch_us({at}), {q}) AS cut FROM {source}) SELECT {', '.join(keys)}, epoch_us({at}) > cut AS is_test FROM {source}, c", build)


for _name in SPLITS:
    _split(_name)


@query(f"WITH {TYPE_DAYS} SELECT event_type, day, day > (SELECT max(day) FROM u) - 7 AS is_test FROM u")
def time_split_days_volume(spark, d):
    u = type_days(spark, d)
    end = u.agg(F.date_sub(F.max("day"), 7).alias("cut"))
    return u.crossJoin(F.broadcast(end)).select("event_type", "day", (F.col("day") > F.col("cut")).alias("is_test"))


# Features to levers: by name, by beginning, or the rest; strengths are sums of mean sizes.
LEVERS = {
    "feature_group_map_eta": ("lineitem", ["l_quantity", "l_extendedprice", "l_tax"], {"l_tax": "terms"}, ("l_ext", "price")),
    "feature_group_map_ticket": ("orders", ["o_totalprice", "o_custkey"], {"o_custkey": "customer"}, ("o_total", "value")),
    "feature_group_map_order": ("part", ["p_size", "p_retailprice"], {"p_size": "size"}, ("p_ret", "price")),
    "feature_group_map_fleet": ("events", ["value", "user_id"], {"user_id": "usage"}, ("val", "load")),
    "feature_group_map_volume": ("customer", ["c_acctbal", "c_nationkey"], {}, ("c_nation", "place")),
}


def _levers(name: str) -> None:
    source, columns, named_levers, (begin, lever) = LEVERS[name]

    def build(spark, d) -> DataFrame:
        sizes = table(spark, d, source).agg(*[F.avg(F.abs(F.col(c).cast("double"))).alias(c) for c in columns])
        long = sizes.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("m")) for c in columns])))
        f = F.col("feature")
        of = S.looked_up(f, named_levers, "") if named_levers else F.lit("")
        return rounded(long.groupBy(F.when(of != "", of).when(F.startswith(f, F.lit(begin)), lever).otherwise("other").alias("lever")).agg(F.sum("m").alias("strength")))

    rows = " UNION ALL ".join(f"SELECT '{named_levers.get(c) or (lever if c.startswith(begin) else 'other')}' AS lever, avg(abs(CAST({c} AS DOUBLE))) AS m FROM {source}" for c in columns)
    named(name, f"SELECT lever, round(sum(m), 4) AS strength FROM ({rows}) GROUP BY 1", build)


for _name in LEVERS:
    _levers(_name)


@query(f"WITH {_FORECAST} SELECT event_type, day, round(list_sort([mean, naive, actual * 0.9::DOUBLE])[1], 4) AS low, round(list_sort([mean, naive, actual * 0.9::DOUBLE])[2], 4) AS middle, round(list_sort([mean, naive, actual * 0.9::DOUBLE])[3], 4) AS high FROM g")
def monotone_rearrange_volume(spark, d):
    s = F.array_sort(F.array("mean", F.col("naive").cast("double"), F.col("actual") * 0.9))
    return rounded(forecasts(spark, d).select("event_type", "day", s[0].alias("low"), s[1].alias("middle"), s[2].alias("high")))


@query("SELECT s_suppkey, round(list_sort([s_acctbal, 1000.0::DOUBLE, s_nationkey * 100.0::DOUBLE])[1], 4) AS low, round(list_sort([s_acctbal, 1000.0::DOUBLE, s_nationkey * 100.0::DOUBLE])[2], 4) AS middle, round(list_sort([s_acctbal, 1000.0::DOUBLE, s_nationkey * 100.0::DOUBLE])[3], 4) AS high FROM supplier")
def monotone_rearrange_lane(spark, d):
    s = F.array_sort(F.array("s_acctbal", F.lit(1000.0), F.col("s_nationkey") * 100.0))
    return rounded(table(spark, d, "supplier").select("s_suppkey", s[0].alias("low"), s[1].alias("middle"), s[2].alias("high")))


_WEEKS = "w AS (SELECT o_custkey % 20 AS lane, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS n FROM orders GROUP BY 1, 2)"


def lane_weeks(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy((F.col("o_custkey") % 20).alias("lane"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).agg(F.count("*").alias("n"))


@query(f"WITH {_WEEKS} SELECT a.lane, a.week, b.n AS naive FROM w a LEFT JOIN w b ON a.lane = b.lane AND b.week = a.week - 364")
def fn_seasonal_naive_lane(spark, d):
    return W.calendar_lag(lane_weeks(spark, d), ["lane"], "week", "n", 364, "naive").select("lane", "week", "naive")


@query(f"WITH {_WEEKS} SELECT a.lane, a.week, round(CASE WHEN count(b.n) >= 2 THEN avg(b.n) END, 4) AS mean_4 FROM w a LEFT JOIN w b ON a.lane = b.lane AND b.week BETWEEN a.week - 28 AND a.week - 7 GROUP BY 1, 2")
def win_trailing_mean_week(spark, d):
    return rounded(W.trailing_mean(lane_weeks(spark, d), ["lane"], "week", "n", 28, 2, "mean_4").select("lane", "week", "mean_4"))


@query(f"WITH {_WEEKS}, a AS (SELECT a.lane, a.week, CASE WHEN count(b.n) >= 2 THEN avg(b.n) END AS m, max(a.n) AS n FROM w a LEFT JOIN w b ON a.lane = b.lane AND b.week BETWEEN a.week - 28 AND a.week - 7 GROUP BY 1, 2) SELECT lane, week, round(coalesce(m, n), 4) AS anchor FROM a")
def fn_anchor(spark, d):
    """The recent mean, or what is known of the week itself."""
    w = W.trailing_mean(lane_weeks(spark, d), ["lane"], "week", "n", 28, 2, "mean_4")
    return rounded(w.select("lane", "week", F.coalesce("mean_4", F.col("n").cast("double")).alias("anchor")))


@query(f"""WITH {_WEEKS}, a AS (SELECT a.lane, a.n AS actual, avg(b.n) AS f FROM w a JOIN w b ON a.lane = b.lane AND b.week BETWEEN a.week - 28 AND a.week - 7 GROUP BY a.lane, a.week, a.n HAVING count(b.n) >= 2)
SELECT lane, round(avg(greatest(0.9::DOUBLE * (actual - f), -0.1::DOUBLE * (actual - f))), 4) AS p90 FROM a GROUP BY 1""")
def agg_pinball_lane(spark, d):
    w = W.trailing_mean(lane_weeks(spark, d), ["lane"], "week", "n", 28, 2, "f").where("f IS NOT NULL")
    return rounded(w.groupBy("lane").agg(M.pinball(F.col("f"), F.col("n"), 0.9).alias("p90")))


@query(f"WITH {SCORED} SELECT arg_max(o_orderkey, value * p) AS o_orderkey, round(max(value * p), 2) AS worth FROM s WHERE y = 0")
def idxmax_row_quote(spark, d):
    worth = F.col("value") * F.col("p")
    return scored(spark, d).where("y = 0").agg(F.max_by("o_orderkey", worth).alias("o_orderkey"), F.round(F.max(worth), 2).alias("worth"))


# Cleaning under each package's rules.
_ORDER_RULES = C.Rules(keys=["o_custkey", "o_orderdate"], order=["o_totalprice", "o_orderkey"], labels=["o_orderpriority"], bounds={"o_totalprice": (5000, 400000)}, medians=["o_totalprice"])


@query("""
WITH f AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_totalprice, o_orderkey) = 1), b AS (SELECT o_orderkey, lower(trim(o_orderpriority)) AS priority, CASE WHEN o_totalprice BETWEEN 5000 AND 400000 THEN o_totalprice END AS p FROM f)
SELECT o_orderkey, priority, round(coalesce(p, (SELECT quantile_cont(p, 0.5) FROM b)), 4) AS price, CAST(p IS NULL AS INTEGER) AS missing FROM b""")
def clean_tickets(spark, d):
    out = C.cleaned(table(spark, d, "orders"), _ORDER_RULES)
    return rounded(out.select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), F.col("o_totalprice__was_missing").alias("missing")))


@query("""
WITH b AS (SELECT c_custkey, lower(trim(c_mktsegment)) AS segment, CASE WHEN c_acctbal BETWEEN -500 AND 9500 THEN c_acctbal END AS b FROM customer)
SELECT c_custkey, segment, round(coalesce(b, (SELECT quantile_cont(b, 0.5) FROM b)), 4) AS balance FROM b""")
def clean_pilot(spark, d):
    rules = C.Rules(keys=["c_custkey"], order=["c_name"], labels=["c_mktsegment"], bounds={"c_acctbal": (-500, 9500)}, medians=["c_acctbal"])
    return rounded(C.cleaned(table(spark, d, "customer"), rules).select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")))


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE AS days, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
f AS (SELECT * FROM t WHERE days > 0 AND days <= 30 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY days, l_partkey, l_suppkey, l_quantity) = 1)
SELECT l_orderkey, l_linenumber, round(days, 4) AS days, l_quantity FROM f""")
def clean_transit(spark, d):
    """Transit times in (0, 30] days, the shortest of each line."""
    t = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    days = (F.unix_micros(F.col("l_shipdate").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 86400000000.0
    t = t.withColumn("days", days).where("days > 0 AND days <= 30")
    return rounded(C.keep_first(t, ["l_orderkey", "l_linenumber"], ["days", "l_partkey", "l_suppkey", "l_quantity"]).select("l_orderkey", "l_linenumber", "days", "l_quantity"))


@query(f"WITH {_WEEKS} SELECT lane, week, least(n, 12) AS n FROM w WHERE n > 1")
def clean_lane_week(spark, d):
    return lane_weeks(spark, d).where("n > 1").withColumn("n", F.least("n", F.lit(12)))


@query(f"""
WITH {USER_DAYS}, b AS (SELECT user_id, day, CASE WHEN total BETWEEN 20 AND 400 THEN total END AS v FROM u),
g AS (SELECT *, v IS NOT NULL AND v IS NOT DISTINCT FROM lag(v) OVER w AS same FROM b WINDOW w AS (PARTITION BY user_id ORDER BY day)), h AS (SELECT *, sum(CAST(NOT same AS INTEGER)) OVER (PARTITION BY user_id ORDER BY day) AS run FROM g),
k AS (SELECT user_id, day, CASE WHEN count(*) OVER (PARTITION BY user_id, run) < 5 THEN v END AS v FROM h),
n AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS v0, last_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER a AS d0, first_value(v IGNORE NULLS) OVER z AS v1, first_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER z AS d1 FROM k
  WINDOW a AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT user_id, day, CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (day - d0) / (d1 - d0) END AS v FROM n)
SELECT user_id, day, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM i)), 4) AS total FROM i""")
def clean_fleet(spark, d):
    """Bounds, runs of five equal readings or more out, gaps filled between a vehicle's neighbours, then the median."""
    v = F.col("v")
    by = Window.partitionBy("user_id").orderBy("day")
    b = user_days(spark, d).select("user_id", "day", F.when(F.col("total").between(20, 400), F.col("total")).alias("v"))
    g = b.withColumn("same", v.isNotNull() & v.eqNullSafe(F.lag("v").over(by)))
    g = g.withColumn("run", F.sum((~F.col("same")).cast("int")).over(by))
    g = g.withColumn("v", F.when(F.count("*").over(Window.partitionBy("user_id", "run")) < 5, v))
    before, after = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(v.isNotNull(), F.col("day"))
    g = g.select("user_id", "day", "v", F.last("v", True).over(before).alias("v0"), F.last(at, True).over(before).alias("d0"), F.first("v", True).over(after).alias("v1"), F.first(at, True).over(after).alias("d1"))
    between = F.col("v0") + (F.col("v1") - F.col("v0")) * F.datediff("day", "d0") / F.datediff("d1", "d0")
    filled = F.when(v.isNotNull(), v).when(F.col("v0").isNull(), F.col("v1")).when(F.col("v1").isNull(), F.col("v0")).otherwise(between)
    return rounded(C.impute_medians(g.select("user_id", "day", filled.alias("total")), ["total"]).select("user_id", "day", "total"))
