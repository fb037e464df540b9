"""Joins: star, roles, semi and anti, as-of, look-back, blocking, grids, neighbours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from freightloom.functions import scalar as S
from freightloom.functions import text as T
from freightloom.operators import joins as J
from freightloom.plans.panels import USER_DAYS, user_days
from freightloom.plans.registry import query, rounded, table


@query("""
SELECT o_orderkey, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS price, round(sum(l_quantity), 4) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def join_inner_equi(spark, d):
    """Lines are summed by order before the join, so the join moves a row for each order."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum("l_extendedprice").alias("price"), F.sum("l_quantity").alias("quantity"))
    return rounded(table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "n_lines", F.round("price", 2).alias("price"), "quantity"))


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice, p_brand, s_name, c_mktsegment FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey
LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey""")
def join_left_chain(spark, d):
    t = lambda n: table(spark, d, n)
    df = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey"), "left").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    df = df.join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return df.select("l_orderkey", "l_linenumber", "l_extendedprice", "p_brand", "s_name", "c_mktsegment")


@query("""
SELECT c.n_name AS customer_nation, s.n_name AS supplier_nation, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation c ON c.n_nationkey = c_nationkey JOIN nation s ON s.n_nationkey = s_nationkey GROUP BY 1, 2""")
def join_left_two_role(spark, d):
    """One dimension in two roles. Lanes are summed by key; names come last."""
    t = lambda n: table(spark, d, n)
    df = t("lineitem").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    lanes = df.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    role = lambda key, name: t("nation").select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name))
    return rounded(lanes.join(role("c_nationkey", "customer_nation"), "c_nationkey").join(role("s_nationkey", "supplier_nation"), "s_nationkey").drop("c_nationkey", "s_nationkey"))


@query(f"""
WITH {USER_DAYS}, e AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1, 2)
SELECT user_id, day, n, errors FROM u LEFT JOIN e USING (user_id, day)""")
def join_left_multikey(spark, d):
    errors = table(spark, d, "events").where("event_type = 'error'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("errors"))
    return user_days(spark, d).join(errors, ["user_id", "day"], "left").select("user_id", "day", "n", "errors")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, b.size FROM lineitem JOIN (SELECT p_partkey, max(p_size) AS size FROM part WHERE p_type = 'ECONOMY' GROUP BY 1) b ON p_partkey = l_partkey""")
def join_inner_dedup_dim(spark, d):
    dim = table(spark, d, "part").where("p_type = 'ECONOMY'").groupBy("p_partkey").agg(F.max("p_size").alias("size"))
    return table(spark, d, "lineitem").join(dim, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "size")


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def join_one_to_one_checked(spark, d):
    right = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    return J.checked_left(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation")), right, ["nation"]).select("c_custkey", "n_name")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS status, CASE o_orderpriority WHEN '1-URGENT' THEN 1.0::DOUBLE WHEN '2-HIGH' THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END AS weight FROM orders")
def join_lookup_map(spark, d):
    """Small dimensions as literals: an unmatched value gives null, or a default."""
    return table(spark, d, "orders").select("o_orderkey", S.looked_up(F.col("o_orderstatus"), {"F": "finished", "O": "open"}).alias("status"), S.looked_up(F.col("o_orderpriority"), {"1-URGENT": 1.0, "2-HIGH": 0.5}, 0.1).alias("weight"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_semi_domain(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 400000")
    return table(spark, d, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_acctbal")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_anti_leftout(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query(f"""
WITH {USER_DAYS}, f AS (SELECT user_id, day FROM u WHERE failed = 1), g AS (SELECT user_id, day FROM u WHERE n > 3)
SELECT f.user_id, f.day, min(g.day) AS first_flag FROM f LEFT JOIN g ON g.user_id = f.user_id AND g.day BETWEEN f.day - 14 AND f.day - 1 GROUP BY 1, 2""")
def join_range_lookback(spark, d):
    u = user_days(spark, d)
    failures, flags = u.where("failed = 1").select("user_id", "day"), u.where("n > 3").select("user_id", F.col("day").alias("first_flag"))
    return J.lookback_first(failures, flags, ["user_id"], "day", "first_flag", 1, 14)


@query(f"""
WITH {USER_DAYS}, f AS (SELECT user_id, day FROM u WHERE failed = 1), g AS (SELECT user_id, day FROM u WHERE n > 3)
SELECT f.user_id, f.day, (SELECT min(g.day) FROM g WHERE g.user_id = f.user_id AND g.day >= f.day) AS first_after FROM f""")
def join_asof_first_after(spark, d):
    u = user_days(spark, d)
    onsets, alarms = u.where("failed = 1").select("user_id", "day"), u.where("n > 3").select("user_id", F.col("day").alias("first_after"))
    return J.asof_after(onsets, alarms, ["user_id"], "day", "first_after")


@query("""
WITH g AS (SELECT unnest([0.8, 0.9, 1.0, 1.1, 1.2]::DOUBLE[]) AS m)
SELECT o_orderkey, m, round(o_totalprice * m, 4) AS price FROM orders CROSS JOIN g""")
def join_cross_grid(spark, d):
    df = J.with_grid(table(spark, d, "orders"), [0.8, 0.9, 1.0, 1.1, 1.2], "m")
    return rounded(df.select("o_orderkey", "m", (F.col("o_totalprice") * F.col("m")).alias("price")))


@query("""
WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
r AS (SELECT a.vec_id, b.vec_id AS neighbour, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.vec_id) AS rank FROM p a JOIN p b ON a.vec_id <> b.vec_id)
SELECT vec_id, neighbour, round(distance, 4) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def join_knn_k20(spark, d):
    """Twenty nearest other points, by cells of bounded numbers of points."""
    p = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return rounded(J.nearest(p, "vec_id", "x", "y", 20).withColumnRenamed("key", "vec_id"))


@query("""
SELECT p_partkey, p_name, upper(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS unit, list_aggregate(list_sort(string_split(p_name, '')), 'string_agg', '') AS sorted, length(p_name) - length(replace(p_name, 'e', '')) AS n_e,
  starts_with(p_name, 'small') AS is_small, CAST(levenshtein(p_name, 'red widget') AS INTEGER) AS gap FROM part""")
def fn_text_keys(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", "p_name", T.alphanumeric(name).alias("unit"), T.sorted_chars(name).alias("sorted"), T.occurrences(name, "e").cast("long").alias("n_e"), F.startswith(name, F.lit("small")).alias("is_small"), F.levenshtein(name, F.lit("red widget")).alias("gap"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round(sum(l_quantity) OVER w, 4) AS running, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 4) AS share FROM lineitem
WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def agg_group_share(spark, d):
    """A running sum along a group and each row's share of its group."""
    w = Window.partitionBy("l_orderkey")
    run = w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.sum("l_quantity").over(run).alias("running"), (F.col("l_extendedprice") / F.sum("l_extendedprice").over(w)).alias("share")))
