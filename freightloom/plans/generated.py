"""Made rows over the tables' keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from freightloom.plans.panels import TYPE_DAYS, type_days
from freightloom.plans.registry import query, rounded, table
from freightloom.plans.scores import U
from freightloom.sources import generate as G


def u(key: str, salt: str) -> str:
    return U.format(key, salt)


_SHIP = f"s AS (SELECT o_orderkey, 50 + 1950 * ({u('o_orderkey', 'distance')}) AS distance, CAST(floor(1 + 4 * ({u('o_orderkey', 'handoffs')})) AS BIGINT) AS handoffs, CAST(floor(1 + 5 * ({u('o_orderkey', 'promise')})) AS BIGINT) AS promised_days FROM orders)"


@query(f"""
WITH {_SHIP}, r AS (SELECT *, 1 / (1 + exp(-(-3.2::DOUBLE + 0.0011::DOUBLE * distance + 0.45::DOUBLE * handoffs - 0.3::DOUBLE * promised_days))) AS risk FROM s)
SELECT o_orderkey, round(distance, 4) AS distance, handoffs, promised_days, round(risk, 4) AS risk, CAST(({u('o_orderkey', 'miss')}) < risk AS INTEGER) AS missed FROM r""")
def gen_shipments(spark, d):
    return rounded(G.shipments(table(spark, d, "orders"), "o_orderkey"))


_NOISE = "(" + " + ".join(f"({u('o_orderkey', f'noise{k}')})" for k in range(6)) + " - 3) * sqrt(2.0::DOUBLE)"


@query(f"""
WITH s AS (SELECT o_orderkey, CASE WHEN ({u('o_orderkey', 'service')}) < 0.3 THEN 'express' ELSE 'ground' END AS service, 50 + 1950 * ({u('o_orderkey', 'distance')}) AS distance FROM orders)
SELECT o_orderkey, service, round(distance, 4) AS distance, round(greatest(0.25::DOUBLE, 0.8::DOUBLE + distance / CASE service WHEN 'express' THEN 900.0::DOUBLE ELSE 500.0::DOUBLE END + CASE service WHEN 'express' THEN 0.2::DOUBLE ELSE 0.6::DOUBLE END * ({_NOISE})), 4) AS days FROM s""")
def gen_transit(spark, d):
    return rounded(G.transit(table(spark, d, "orders"), "o_orderkey"))


_HIT = u("c_custkey", "mess")


@query(f"""
WITH b AS (SELECT c_custkey, CASE WHEN ({_HIT}) < 0.03 THEN NULL WHEN ({_HIT}) < 0.05 THEN 9999.0::DOUBLE ELSE c_acctbal END AS c_acctbal, CASE WHEN ({u('c_custkey', 'case')}) < 0.1 THEN concat(' ', upper(c_mktsegment)) ELSE c_mktsegment END AS c_mktsegment FROM customer)
SELECT * FROM b UNION ALL SELECT * FROM b WHERE ({u('c_custkey', 'twice')}) < 0.02""")
def gen_shipments_mess(spark, d):
    return G.defects(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), "c_custkey", "c_acctbal", "c_mktsegment")


@query(f"""
SELECT o_orderkey, CASE WHEN ({u('o_orderkey', 'tier')}) < 0.7::DOUBLE THEN 'standard' WHEN ({u('o_orderkey', 'tier')}) < 0.92::DOUBLE THEN 'premium' ELSE 'contract' END AS tier,
  round(least(greatest((o_totalprice - 50000) / 250000, 0), 1), 4) AS ramp FROM orders""")
def gen_ramp(spark, d):
    k = F.col("o_orderkey")
    tier = G.chosen(k, "tier", {"standard": 0.7, "premium": 0.22, "contract": 0.08})
    return rounded(table(spark, d, "orders").select("o_orderkey", tier.alias("tier"), G.ramp(F.col("o_totalprice"), 50000, 300000).alias("ramp")))


_KEY = "concat(event_type, CAST(day AS VARCHAR))"


@query(f"""
WITH {TYPE_DAYS} SELECT event_type, day, round(100 + sum((({u(_KEY, 'walk')}) - 0.5::DOUBLE) * 4) OVER (PARTITION BY event_type ORDER BY day), 4) AS level FROM u""")
def gen_quotes(spark, d):
    """A market index for each type: a walk along its days."""
    key = F.concat("event_type", F.col("day").cast("string"))
    return rounded(G.random_walk(type_days(spark, d), ["event_type"], "day", key, 4.0).select("event_type", "day", "level"))
