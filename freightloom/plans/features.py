"""Features, made effects, matrices and single functions over the tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightloom.functions import scalar as S
from freightloom.functions import text as T
from freightloom.operators import clean as C
from freightloom.plans.registry import query, rounded, table


def orders(spark, d) -> DataFrame:
    return table(spark, d, "orders")


@query("""
SELECT o_orderkey, CAST(o_totalprice > 200000 AS DOUBLE) AS high_value, CAST(o_orderstatus = 'F' AS DOUBLE) AS closed, CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS DOUBLE) AS pressing,
  CAST(isodow(o_orderdate) >= 6 AS DOUBLE) AS weekend, CAST(month(o_orderdate) IN (11, 12) AS DOUBLE) AS peak FROM orders""")
def gen_ticket_terms(spark, d):
    """Named yes/no terms as doubles."""
    o = orders(spark, d)
    terms = {
        "high_value": F.col("o_totalprice") > 200000, "closed": F.col("o_orderstatus") == "F", "pressing": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
        "weekend": S.weekday(F.col("o_orderdate")) >= 5, "peak": F.month("o_orderdate").isin(11, 12),
    }
    return o.select("o_orderkey", *[v.cast("double").alias(k) for k, v in terms.items()])


@query("""
WITH t AS (SELECT o_orderkey, CAST(o_totalprice > 200000 AS DOUBLE) AS a, CAST(o_orderstatus = 'F' AS DOUBLE) AS b, CAST(month(o_orderdate) IN (11, 12) AS DOUBLE) AS c FROM orders)
SELECT o_orderkey, round(0.2::DOUBLE + 1.1::DOUBLE * a - 0.4::DOUBLE * b, 4) AS carrier, round(-0.3::DOUBLE + 0.9::DOUBLE * b + 0.5::DOUBLE * c, 4) AS address, CASE WHEN a = 1 THEN round(0.7::DOUBLE * c, 4) END AS customs FROM t""")
def gen_ticket_logits(spark, d):
    """Weighted sums of terms for each class; a class outside its domain has none."""
    t = gen_ticket_terms(spark, d)
    a, b, c = F.col("high_value"), F.col("closed"), F.col("peak")
    return rounded(t.select("o_orderkey", (0.2 + 1.1 * a - 0.4 * b).alias("carrier"), (-0.3 + 0.9 * b + 0.5 * c).alias("address"), F.when(a == 1, 0.7 * c).alias("customs")))


@query("""
SELECT o_orderkey, CASE WHEN month(o_orderdate) = 12 AND day(o_orderdate) = 25 THEN 0.2::DOUBLE WHEN month(o_orderdate) = 12 AND day(o_orderdate) BETWEEN 18 AND 24 THEN 1.0::DOUBLE + (day(o_orderdate) - 17) * 0.1::DOUBLE
  WHEN month(o_orderdate) = 11 AND day(o_orderdate) >= 20 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS multiplier FROM orders""")
def gen_holiday_mult(spark, d):
    m, day = F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    mult = F.when((m == 12) & (day == 25), 0.2).when((m == 12) & day.between(18, 24), 1.0 + (day - 17) * 0.1).when((m == 11) & (day >= 20), 1.3).otherwise(1.0)
    return orders(spark, d).select("o_orderkey", mult.alias("multiplier"))


@query("""
SELECT p_partkey, round(12 + 0.8::DOUBLE * greatest(p_size, p_retailprice / 60), 4) AS base_rate, CASE WHEN p_size > 40 THEN 'weather' WHEN p_size > 25 THEN 'distance' ELSE 'plain' END AS segment,
  round(1 / (1 + exp(-(1.5::DOUBLE - 0.002::DOUBLE * p_retailprice * CASE p_type WHEN 'ECONOMY' THEN 1.4::DOUBLE ELSE 0.8::DOUBLE END))), 4) AS accept FROM part""")
def gen_base_rate(spark, d):
    """A rate from billable weight, a segment by overwriting order, and an acceptance by segment."""
    p = table(spark, d, "part")
    price, size = F.col("p_retailprice"), F.col("p_size")
    slope = S.looked_up(F.col("p_type"), {"ECONOMY": 1.4}, 0.8)
    return rounded(p.select("p_partkey", (12 + 0.8 * F.greatest(size, price / 60)).alias("base_rate"), F.when(size > 40, "weather").when(size > 25, "distance").otherwise("plain").alias("segment"), S.sigmoid(1.5 - 0.002 * price * slope).alias("accept")))


@query("""
WITH z AS (SELECT n_nationkey AS zip, n_nationkey // 5 AS i, n_nationkey % 5 AS j FROM nation)
SELECT a.zip, b.zip AS neighbour FROM z a JOIN z b ON abs(a.i - b.i) + abs(a.j - b.j) = 1""")
def gen_adjacent_zips(spark, d):
    """Codes on a grid five wide; the four neighbours of each come from its own place, without pairing all."""
    z = table(spark, d, "nation").select(F.col("n_nationkey").alias("zip"), F.floor(F.col("n_nationkey") / 5).alias("i"), (F.col("n_nationkey") % 5).alias("j"))
    steps = F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).cast("long").alias("j")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    around = z.select("zip", F.inline(steps))
    return around.join(z.withColumnRenamed("zip", "neighbour").withColumn("j", F.col("j").cast("long")), ["i", "j"]).select("zip", "neighbour")


@query("SELECT s_suppkey, s_nationkey // 5 AS i, s_nationkey % 5 AS j, abs(s_nationkey // 5 - 2) + abs(s_nationkey % 5 - 2) AS distance FROM supplier")
def gen_zip_distance(spark, d):
    k = F.col("s_nationkey")
    i, j = F.floor(k / 5).cast("int"), k % 5
    return table(spark, d, "supplier").select("s_suppkey", i.alias("i"), j.alias("j"), (F.abs(i - 2) + F.abs(j - 2)).alias("distance"))


@query("""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, day, round(CASE user_id % 3 WHEN 0 THEN CASE WHEN day >= DATE '2024-01-15' THEN 0.1::DOUBLE ELSE 0 END WHEN 1 THEN least(greatest((day - DATE '2024-01-10') * 0.01::DOUBLE, 0), 0.08::DOUBLE) ELSE CASE WHEN day = DATE '2024-01-20' THEN 0.5::DOUBLE ELSE 0 END END, 4) AS added FROM d""")
def gen_anomaly_pp(spark, d):
    """Step, capped ramp or one-day spike added by the day."""
    from freightloom.plans.panels import user_days

    day, kind = F.col("day"), F.col("user_id") % 3
    ramp = S.clipped(F.datediff(day, F.lit("2024-01-10")) * 0.01, 0.0, 0.08)
    added = F.when(kind == 0, F.when(day >= "2024-01-15", 0.1).otherwise(0.0)).when(kind == 1, ramp).otherwise(F.when(day == "2024-01-20", 0.5).otherwise(0.0))
    return rounded(user_days(spark, d).select("user_id", "day", added.alias("added")))


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def gen_clean_lanes(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id").distinct().join(e.where("event_type = 'error'"), "user_id", "left_anti")


@query("SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderdate FROM orders WHERE o_totalprice > 2000 AND o_totalprice <= 450000 AND o_orderpriority <> '4-NOT SPECIFIED'")
def clean_quotes(spark, d):
    """An impossible price is dropped, never imputed; labels outside the domain go."""
    o = orders(spark, d).where("o_totalprice > 2000 AND o_totalprice <= 450000")
    return o.where(F.col("o_orderpriority") != "4-NOT SPECIFIED").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate")


@query("""
WITH u AS (SELECT c_nationkey AS lane, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS volume, count(*) FILTER (WHERE o_orderstatus = 'F') + count(*) FILTER (WHERE o_totalprice > 450000) AS misses FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT lane, month, volume, misses FROM u WHERE misses <= volume""")
def clean_lane_feed(spark, d):
    """Rows with more misses than volume are dropped, not clipped."""
    o = orders(spark, d).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    u = o.groupBy(F.col("c_nationkey").alias("lane"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"))
    return u.agg(F.count("*").alias("volume"), (F.count_if(F.col("o_orderstatus") == "F") + F.count_if(F.col("o_totalprice") > 450000)).alias("misses")).where("misses <= volume")


@query("""
SELECT o_orderkey, concat_ws(', ', CASE WHEN o_totalprice > 300000 THEN 'price' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END) AS reason,
  CAST(o_totalprice > 300000 AS BIGINT) + CAST(o_orderstatus = 'P' AS BIGINT) + CAST(o_orderpriority = '1-URGENT' AS BIGINT) AS n_reasons FROM orders""")
def review_reason(spark, d):
    why = {"price": F.col("o_totalprice") > 300000, "pending": F.col("o_orderstatus") == "P", "urgent": F.col("o_orderpriority") == "1-URGENT"}
    reason = F.concat_ws(", ", *[F.when(v, k) for k, v in why.items()])
    return orders(spark, d).select("o_orderkey", reason.alias("reason"), sum((v.cast("long") for v in why.values()), F.lit(0).cast("long")).alias("n_reasons"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount > 0.05 AND l_quantity > 30 AS overstrain, l_tax < 0.02 AND l_extendedprice > 50000 AS power, l_quantity >= 45 AS wear,
  l_discount > 0.05 AND l_quantity > 30 OR l_tax < 0.02 AND l_extendedprice > 50000 OR l_quantity >= 45 AS any_zone FROM lineitem""")
def physics_zones(spark, d):
    zones = {"overstrain": (F.col("l_discount") > 0.05) & (F.col("l_quantity") > 30), "power": (F.col("l_tax") < 0.02) & (F.col("l_extendedprice") > 50000), "wear": F.col("l_quantity") >= 45}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[v.alias(k) for k, v in zones.items()], S.any_of(list(zones.values())).alias("any_zone"))


@query("""
SELECT o_orderkey, round(ln(1 + o_totalprice), 4) AS log_price, CAST(o_orderpriority = '1-URGENT' AS DOUBLE) AS priority_1, CAST(o_orderpriority = '5-LOW' AS DOUBLE) AS priority_5, CAST(o_orderstatus = 'F' AS DOUBLE) AS was_missing FROM orders""")
def whitelist_matrix(spark, d):
    """Whitelisted numbers, flags and one-hot levels; anything else stays out."""
    o = C.forbid_columns(orders(spark, d).drop("o_custkey"), ["o_custkey"])
    p = F.col("o_orderpriority")
    return rounded(o.select("o_orderkey", F.log1p("o_totalprice").alias("log_price"), (p == "1-URGENT").cast("double").alias("priority_1"), (p == "5-LOW").cast("double").alias("priority_5"), (F.col("o_orderstatus") == "F").cast("double").alias("was_missing")))


@query("""
WITH g AS (SELECT unnest([0.9, 1.0, 1.1]::DOUBLE[]) AS m) SELECT p_partkey, m, round(m * p_retailprice / 1000, 9) AS to_market, round(m, 4) AS to_cost, CAST(p_type = 'ECONOMY' AS DOUBLE) AS economy FROM part CROSS JOIN g""")
def price_matrix(spark, d):
    """Model features at candidate prices."""
    from freightloom.operators.joins import with_grid

    p = with_grid(table(spark, d, "part"), [0.9, 1.0, 1.1], "m")
    return rounded(p.select("p_partkey", "m", F.round(F.col("m") * F.col("p_retailprice") / 1000, 9).alias("to_market"), F.col("m").alias("to_cost"), (F.col("p_type") == "ECONOMY").cast("double").alias("economy")), 9)


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) > (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 112 AS is_test FROM orders")
def time_split_weeks(spark, d):
    o = orders(spark, d).withColumn("day", F.to_date("o_orderdate"))
    end = o.agg(F.date_sub(F.max("day"), 7 * 16).alias("cut"))
    return o.crossJoin(F.broadcast(end)).select("o_orderkey", (F.col("day") > F.col("cut")).alias("is_test"))


@query("""
SELECT p_partkey, CAST(floor(p_size / 7) AS BIGINT) AS floored, CAST(round_even(p_retailprice, 0) AS BIGINT) AS dollars, round(least(greatest(p_retailprice - 1000, -50), 50), 4) AS clipped, round(p_retailprice / greatest(p_size - 3, 1), 9) AS ratio,
  round(ln(1 + p_size), 4) AS log_size, round(1 / (1 + exp(-(p_size - 25) / 10.0::DOUBLE)), 4) AS squashed, p_retailprice = p_retailprice AND p_size <> 0 AS usable FROM part""")
def fn_round_int(spark, d):
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", F.floor(size / 7).alias("floored"), S.even_rounded(price).cast("long").alias("dollars"), F.round(S.clipped(price - 1000, -50, 50), 4).alias("clipped"), F.round(S.safe_ratio(price, size - 3, 1), 9).alias("ratio"),
        F.round(F.log1p(size), 4).alias("log_size"), F.round(S.sigmoid((size - 25) / 10), 4).alias("squashed"), (S.is_usable(price) & (size != 0)).alias("usable"),
    )


@query("SELECT o_orderkey, 1 + date_diff('day', (SELECT min(CAST(o_orderdate AS DATE)) FROM orders), CAST(o_orderdate AS DATE)) AS day_index, CAST(date_trunc('day', o_orderdate) AS DATE) AS day FROM orders")
def fn_day_index(spark, d):
    o = orders(spark, d).withColumn("day", F.to_date("o_orderdate"))
    first = o.agg(F.min("day").alias("first"))
    return o.crossJoin(F.broadcast(first)).select("o_orderkey", (1 + F.datediff("day", "first")).cast("long").alias("day_index"), "day")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_sort([l_discount, l_tax, 0.03::DOUBLE])[1] AS low, list_sort([l_discount, l_tax, 0.03::DOUBLE])[2] AS middle, list_sort([l_discount, l_tax, 0.03::DOUBLE])[3] AS high FROM lineitem""")
def monotone_rearrange(spark, d):
    """Predicted quantiles of a row put in order."""
    s = F.array_sort(F.array("l_discount", "l_tax", F.lit(0.03)))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", s[0].alias("low"), s[1].alias("middle"), s[2].alias("high"))


@query("""
SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS digits, CAST(levenshtein(c_mktsegment, 'MACHINERY') + levenshtein(c_name, 'Customer#000000010') AS INTEGER) AS gap FROM customer""")
def fn_field_edit_distance(spark, d):
    """Edit distances summed over fields."""
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.regexp_extract("c_name", "([0-9]+)", 1).alias("digits"), (F.levenshtein("c_mktsegment", F.lit("MACHINERY")) + F.levenshtein("c_name", F.lit("Customer#000000010"))).alias("gap"))


@query("SELECT p_partkey, concat(upper(p_brand), ' ', CASE WHEN p_size > 30 THEN 'LARGE ' ELSE '' END, p_type, ', unit ', CAST(p_size AS VARCHAR)) AS address FROM part")
def card_address_text(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.upper("p_brand"), F.lit(" "), F.when(F.col("p_size") > 30, "LARGE ").otherwise(""), "p_type", F.lit(", unit "), F.col("p_size").cast("string")).alias("address"))


@query("SELECT p_brand, p_size, max_by(p_partkey, p_partkey) AS p_partkey FROM part GROUP BY 1, 2")
def join_exact_5key(spark, d):
    """One point for each exact key: on duplicates the last wins."""
    return table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.max("p_partkey").alias("p_partkey"))


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth, CASE WHEN o_orderstatus = 'F' THEN u * 0.5::DOUBLE ELSE 0.5::DOUBLE + u * 0.5::DOUBLE END AS draw
FROM (SELECT *, CAST(concat('0x', substr(md5(concat(CAST(o_orderkey AS VARCHAR), ':world')), 1, 8)) AS UBIGINT) / 4294967296.0::DOUBLE AS u FROM orders)""")
def conditional_uniforms(spark, d):
    """One draw for each row that agrees with what has happened: below the risk where it came true, above elsewhere."""
    u, risk = S.uniform(F.col("o_orderkey"), "world"), 0.5
    draw = F.when(F.col("o_orderstatus") == "F", u * risk).otherwise(risk + u * (1 - risk))
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")
    return orders(spark, d).select("o_orderkey", nth.alias("nth"), draw.alias("draw"))


@query("SELECT c_custkey, replace(lower(trim(c_mktsegment)), ' ', '_') AS segment, length(c_name) - length(replace(c_name, '0', '')) AS zeros, ends_with(c_name, '7') AS ends_in_7 FROM customer")
def fn_count_substring(spark, d):
    c = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", T.label(F.col("c_mktsegment")).alias("segment"), T.occurrences(c, "0").cast("long").alias("zeros"), F.endswith(c, F.lit("7")).alias("ends_in_7"))
