"""Cards that are picked: the costliest first, one for each archetype, with the reason in words."""

from __future__ import annotations

from pyspark.sql import functions as F

from freightloom.operators.ranked import running
from freightloom.plans.bundles import _CONFIDENT
from freightloom.plans.evaluations import _BOOKED, _booked, _match_sql, _matches, card_incident
from freightloom.plans.panels import USER_DAYS
from freightloom.plans.registry import query, rounded
from freightloom.plans.scores import _ROUTED, routed


@query(f"""
WITH {USER_DAYS}, a AS (SELECT user_id, day, n, count(*) FILTER (WHERE n <= 3) OVER (PARTITION BY user_id ORDER BY day) AS run FROM u), r AS (SELECT user_id, run, min(day) AS first, max(day) AS last, sum(n - 3) AS excess FROM a WHERE n > 3 GROUP BY 1, 2),
w AS (SELECT user_id, first, last, round(excess * 7.0::DOUBLE / (last - first + 1), 4) AS weekly FROM r)
SELECT row_number() OVER (ORDER BY weekly DESC, user_id, first) AS place, user_id, concat('user ', CAST(user_id AS VARCHAR), ': ', CAST(first AS VARCHAR), ' to ', CAST(last AS VARCHAR), ', ', CAST(CAST(floor(weekly) AS BIGINT) AS VARCHAR), ' a week over') AS card FROM w""")
def card_incident_write(spark, d):
    """Incidents as text, the costliest a week first."""
    text = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(": "), F.col("first").cast("string"), F.lit(" to "), F.col("last").cast("string"), F.lit(", "), F.floor("weekly").cast("string"), F.lit(" a week over"))
    return running(card_incident(spark, d), [F.desc("weekly"), F.col("user_id"), F.col("first")], rank="place").select("place", "user_id", text.alias("card"))


@query(_match_sql("""SELECT kind, label, point, round(score, 4) AS score FROM (SELECT *, CASE WHEN hit AND score < 1 AND score >= 0.5 THEN 'matched through a slip' WHEN orphan AND score < 0.5 THEN 'orphan sent to review' WHEN NOT hit AND NOT orphan THEN 'stopped near miss' END AS kind FROM m)
WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind ORDER BY score DESC, label) = 1"""))
def card_match_write(spark, d):
    """One label for each archetype, the one with the best score: a match through a slip, an orphan that was sent to review,
    a near miss."""
    sure = F.col("score")
    kind = F.when(F.col("hit") & (sure < 1) & (sure >= 0.5), "matched through a slip").when(F.col("orphan") & (sure < 0.5), "orphan sent to review").when(~F.col("hit") & ~F.col("orphan"), "stopped near miss")
    best = F.max_by(F.struct("label", "point", "score"), F.struct("score", -F.col("label"))).alias("b")
    return rounded(_matches(spark, d).withColumn("kind", kind).where("kind IS NOT NULL").groupBy("kind").agg(best).select("kind", "b.label", "b.point", "b.score"))


_WHY = f"""{_BOOKED}, k AS (SELECT lane, month, demand, max(booked) FILTER (WHERE policy = 'habit') AS habit, max(booked) FILTER (WHERE policy = 'high') AS high FROM c GROUP BY 1, 2, 3),
l AS (SELECT lane, avg(demand) AS mean, stddev_pop(demand) / avg(demand) AS unrest, avg(greatest(demand - habit, 0)) AS short, avg(greatest(habit - demand, 0)) AS spare, max(high - habit) AS step FROM k GROUP BY 1)"""


@query(f"""
WITH {_WHY}, p AS (SELECT 'big and steady' AS role, arg_min(lane, (unrest, lane)) AS lane FROM l WHERE mean >= (SELECT quantile_cont(mean, 0.5) FROM l) UNION ALL SELECT 'runs short', arg_max(lane, (short, -lane)) FROM l UNION ALL SELECT 'moves air', arg_max(lane, (spare, -lane)) FROM l)
SELECT role, p.lane, CASE role WHEN 'big and steady' THEN concat('book ', CAST(CAST(step AS BIGINT) AS VARCHAR), ' over the habit, not more: the lane hardly moves') WHEN 'runs short' THEN concat('the habit leaves ', CAST(round(short, 2) AS VARCHAR), ' a month to the spot market') ELSE concat('the habit books ', CAST(round(spare, 2) AS VARCHAR), ' a month that stay empty') END AS why FROM p JOIN l ON l.lane = p.lane""")
def card_capacity_why(spark, d):
    """Three lanes and why their booking is what it is."""
    from freightloom.operators.ranked import quantile_edges

    of = lambda p: F.max(F.when(F.col("policy") == p, F.col("booked")))
    k = _booked(spark, d).groupBy("lane", "month", "demand").agg(of("habit").alias("habit"), of("high").alias("high"))
    gap = F.col("demand") - F.col("habit")
    zero = F.lit(0.0)
    lanes = k.groupBy("lane").agg(F.avg("demand").alias("mean"), (F.stddev_pop("demand") / F.avg("demand")).alias("unrest"), F.avg(F.greatest(gap, zero)).alias("short"), F.avg(F.greatest(-gap, zero)).alias("spare"), F.max(F.col("high") - F.col("habit")).alias("step"))
    middle = quantile_edges(lanes, "mean", [0.5])
    told = F.struct("lane", "short", "spare", "step")
    first = lambda by: F.max_by(told, F.struct(by, -F.col("lane")))
    big = F.max_by(F.when(F.col("mean") >= F.col("q1"), told), F.when(F.col("mean") >= F.col("q1"), F.struct(-F.col("unrest"), -F.col("lane"))))
    one = lanes.crossJoin(F.broadcast(middle)).agg(big.alias("a"), first(F.col("short")).alias("b"), first(F.col("spare")).alias("c"))
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("x")) for r, c in (("big and steady", "a"), ("runs short", "b"), ("moves air", "c"))])))
    said = lambda c: F.round(c, 2).cast("string")
    why = F.when(F.col("role") == "big and steady", F.concat(F.lit("book "), F.col("x.step").cast("long").cast("string"), F.lit(" over the habit, not more: the lane hardly moves"))).when(F.col("role") == "runs short", F.concat(F.lit("the habit leaves "), said("x.short"), F.lit(" a month to the spot market"))).otherwise(F.concat(F.lit("the habit books "), said("x.spare"), F.lit(" a month that stay empty")))
    return rows.select("role", F.col("x.lane").alias("lane"), why.alias("why"))


@query(f"""
WITH {_ROUTED.replace('AS predicted FROM', 'AS predicted, o_orderkey FROM')}, s AS (SELECT *, {_CONFIDENT} AS sure FROM r)
SELECT verdict, ticket, queue, round(sure, 4) AS sure FROM (
  SELECT 'goes by itself' AS verdict, max_by(o_orderkey, (sure, -o_orderkey)) FILTER (WHERE actual = predicted) AS ticket, max_by(predicted, (sure, -o_orderkey)) FILTER (WHERE actual = predicted) AS queue, max(sure) FILTER (WHERE actual = predicted) AS sure FROM s
  UNION ALL SELECT 'goes to a person', min_by(o_orderkey, (sure, o_orderkey)), min_by(predicted, (sure, o_orderkey)), min(sure) FROM s)""")
def card_ticket_pick(spark, d):
    """Two tickets: the surest one that is right, and the least sure one of all."""
    from freightloom.functions import scalar as S

    s = routed(spark, d).withColumn("sure", S.uniform(F.col("o_orderkey"), "sure"))
    told = F.struct(F.col("o_orderkey").alias("ticket"), F.col("predicted").alias("queue"), "sure")
    right = F.col("actual") == F.col("predicted")
    one = s.agg(F.max_by(F.when(right, told), F.when(right, F.struct("sure", -F.col("o_orderkey")))).alias("a"), F.min_by(told, F.struct("sure", "o_orderkey")).alias("b"))
    return rounded(one.select(F.inline(F.array(F.struct(F.lit("goes by itself").alias("verdict"), F.col("a").alias("x")), F.struct(F.lit("goes to a person").alias("verdict"), F.col("b").alias("x"))))).select("verdict", "x.*"))
