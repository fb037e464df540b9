"""Misread records and the ones that they mean: candidates whose number doesn't grow with the table, scores, matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightloom.functions import scalar as S
from freightloom.operators import joins as J
from freightloom.plans.registry import query, rounded, table
from freightloom.plans.scores import U

_U = U.format("c_custkey", "misread")


def _keys(name: str) -> str:
    """The number of a name, and it without one of its digits."""
    n = f"substr({name}, 10)"
    return f"unnest(list_distinct(list_append(list_transform(range(1, length({n}) + 1), lambda i: substr({n}, 1, i - 1) || substr({n}, i + 1)), {n})))"


#: Customers with what was read of their names: two digits swapped, one lost, one or two misread, or all right.
_READ = f"""k AS (SELECT c_custkey, c_nationkey AS z, c_name, CASE WHEN ({_U}) < 0.3 THEN substr(c_name, 1, 16) || substr(c_name, 18) || substr(c_name, 17, 1) WHEN ({_U}) < 0.5 THEN substr(c_name, 1, 15) || substr(c_name, 17)
  WHEN ({_U}) < 0.6 THEN substr(c_name, 1, 14) || '9' || substr(c_name, 16) WHEN ({_U}) < 0.65 THEN substr(c_name, 1, 12) || '77' || substr(c_name, 15) ELSE c_name END AS said FROM customer)"""


def _candidates_sql(points: str = "TRUE") -> str:
    return f"""{_READ}, lk AS (SELECT c_custkey AS label, z, said, {_keys("said")} AS q FROM k), pk AS (SELECT c_custkey AS point, z, c_name, {_keys("c_name")} AS q FROM k WHERE {points}),
c AS (SELECT DISTINCT label, point, CAST(levenshtein(said, c_name) AS BIGINT) AS gap FROM lk JOIN pk USING (z, q))"""


#: Every sixtieth customer is an orphan: it isn't among the points, and should stay unmatched.
PAIRS = _candidates_sql("c_custkey % 60 <> 0")


def customers(spark, d) -> DataFrame:
    u, name = S.uniform(F.col("c_custkey"), "misread"), F.col("c_name")
    part = lambda a, n=99: F.substring(name, a, n)
    said = F.when(u < 0.3, F.concat(part(1, 16), part(18), part(17, 1))).when(u < 0.5, F.concat(part(1, 15), part(17)))
    said = said.when(u < 0.6, F.concat(part(1, 14), F.lit("9"), part(16))).when(u < 0.65, F.concat(part(1, 12), F.lit("77"), part(15))).otherwise(name)
    return table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("z"), "c_name", said.alias("said"))


def number(name: str) -> Column:
    return F.substring(F.col(name), 10, 99)


def pairs(spark, d, points: Column | None = None) -> DataFrame:
    """(label, point, gap): what was read, with the customers of its nation whose number is a slip away."""
    k = customers(spark, d)
    labels, known = k.select(F.col("c_custkey").alias("label"), "z", "said"), k.where(F.lit(True) if points is None else points).select(F.col("c_custkey").alias("point"), "z", "c_name")
    return J.near_pairs(labels, known, "label", "point", number("said"), number("c_name"), [(F.col("z"), F.col("z"))], (F.col("said"), F.col("c_name")))


def matched_pairs(spark, d) -> DataFrame:
    """`pairs` without the orphans among the points."""
    return pairs(spark, d, F.col("c_custkey") % 60 != 0)


@query(f"WITH {_candidates_sql()} SELECT label AS left_key, point AS right_key FROM c")
def join_blocking(spark, d):
    """Candidates that share a key; a pair that several keys find is one row. Keys are shared by few, so candidates of a
    row don't grow with the table."""
    return pairs(spark, d).select(F.col("label").alias("left_key"), F.col("point").alias("right_key"))


@query(f"WITH {_candidates_sql()}, h AS (SELECT label, max(CAST(label = point AS INTEGER)) AS hit, count(*) AS n FROM c GROUP BY 1) SELECT round(sum(coalesce(hit, 0)) / count(*)::DOUBLE, 4) AS recall, round(sum(coalesce(n, 0)) / count(*)::DOUBLE, 4) AS pairs_per_row FROM k LEFT JOIN h ON label = c_custkey")
def agg_blocking_recall(spark, d):
    """The share of what was read whose true customer is among its candidates, and how many candidates it has."""
    by = pairs(spark, d).groupBy(F.col("label").alias("c_custkey")).agg(F.max((F.col("label") == F.col("point")).cast("int")).alias("hit"), F.count("*").alias("n"))
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0))) / F.count("*")
    return rounded(customers(spark, d).select("c_custkey").join(by, "c_custkey", "left").agg(zero("hit").alias("recall"), zero("n").alias("pairs_per_row")))


@query(f"WITH {_candidates_sql()} SELECT label AS key, point AS other, gap FROM c WHERE label <> point QUALIFY row_number() OVER (PARTITION BY label ORDER BY gap, point DESC) = 1")
def win_argmax_per_group(spark, d):
    """The best other candidate of each label; on equal scores the last one."""
    best = J.best_match(pairs(spark, d).where("label <> point").withColumn("score", -F.col("gap")), "label", "score", [F.desc("point")])
    return best.select(F.col("label").alias("key"), F.col("point").alias("other"), "gap")


@query(f"WITH {_READ}, q AS (SELECT c_custkey, z, {_keys('c_name')} AS q FROM k) SELECT DISTINCT a.c_custkey AS left_key, b.c_custkey AS right_key FROM q a JOIN q b ON a.z = b.z AND a.q = b.q AND a.c_custkey < b.c_custkey")
def join_self_pairs_upper(spark, d):
    """Pairs i < j of a nation whose numbers are a slip apart."""
    k = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name")
    a, b = k.withColumnRenamed("c_custkey", "left_key"), k.withColumnRenamed("c_custkey", "right_key")
    return J.near_pairs(a, b, "left_key", "right_key", number("c_name"), number("c_name"), [(F.col("c_nationkey"), F.col("c_nationkey"))]).where("left_key < right_key")


@query(f"WITH {PAIRS} SELECT label, point, gap FROM c")
def join_build_pairs(spark, d):
    return matched_pairs(spark, d)


@query(f"WITH {PAIRS} SELECT label, point, CAST(label = point AS INTEGER) AS y FROM c")
def join_pair_truth(spark, d):
    truth = table(spark, d, "customer").select(F.col("c_custkey").alias("label"), F.col("c_custkey").alias("true_point"))
    return matched_pairs(spark, d).join(truth, "label", "left").select("label", "point", (F.col("point") == F.col("true_point")).cast("int").alias("y"))


@query(f"WITH {PAIRS} SELECT label AS truth, point AS matched, gap, label = point AS hit FROM c WHERE gap <= 2 QUALIFY row_number() OVER (PARTITION BY label ORDER BY gap, point DESC) = 1")
def match_run(spark, d):
    """What was read to what was meant: candidates by keys, the best by distance, kept under a threshold."""
    best = J.best_match(matched_pairs(spark, d).where("gap <= 2").withColumn("score", -F.col("gap")), "label", "score", [F.desc("point")])
    return best.select(F.col("label").alias("truth"), F.col("point").alias("matched"), "gap", (F.col("label") == F.col("point")).alias("hit"))
