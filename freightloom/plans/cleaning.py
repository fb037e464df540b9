"""Cleaning, projection, splits and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from freightloom.functions import scalar as S
from freightloom.functions import text as T
from freightloom.operators import clean as C
from freightloom.operators import ranked as R
from freightloom.plans.registry import query, rounded, table

ALL_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_KEYS = ["l_orderkey", "l_linenumber"]
LINE_RULES = C.Rules(
    keys=LINE_KEYS, order=ALL_LINE, labels=["l_returnflag"], sentinels={"l_tax": [0.08]},
    bounds={"l_quantity": (3, 48), "l_extendedprice": (1000, 90000)}, essential=["l_shipdate"], medians=["l_quantity", "l_extendedprice"],
)

_FIRST = "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem) WHERE n = 1"


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL AND o_totalprice IS NOT NULL")
def filter_eq_notnull(spark, d):
    return C.drop_nulls(table(spark, d, "orders").where("o_orderstatus = 'F'"), ["o_custkey", "o_totalprice"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE c_acctbal < 0) AS dropped FROM customer")
def dropna_subset(spark, d):
    df = table(spark, d, "customer").withColumn("balance", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.col("balance").isNull()).alias("dropped"))


@query("SELECT p_partkey, CASE WHEN p_size NOT IN (1, 50) THEN p_size END AS size FROM part")
def sentinel_to_null(spark, d):
    return table(spark, d, "part").select("p_partkey", S.sentinel_or_null(F.col("p_size"), [1, 50]).alias("size"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity BETWEEN 5 AND 45 THEN l_quantity END AS quantity, CASE WHEN l_discount BETWEEN 0.01 AND 0.09 THEN l_discount END AS discount FROM lineitem")
def bounds_to_null(spark, d):
    q = {"quantity": ("l_quantity", 5, 45), "discount": ("l_discount", 0.01, 0.09)}
    return table(spark, d, "lineitem").select(*LINE_KEYS, "l_partkey", *[S.between_or_null(F.col(c), a, b).alias(n) for n, (c, a, b) in q.items()])


@query("SELECT lower(trim(c_mktsegment)) AS segment, count(*) AS n, count(*) FILTER (WHERE c_mktsegment <> lower(trim(c_mktsegment))) AS changed FROM customer GROUP BY 1")
def normalise_categorical(spark, d):
    tidy = T.tidy(F.col("c_mktsegment"))
    return table(spark, d, "customer").groupBy(tidy.alias("segment")).agg(F.count("*").alias("n"), F.count_if(F.col("c_mktsegment") != tidy).alias("changed"))


@query("SELECT o_orderkey, replace(lower(trim(o_orderpriority)), ' ', '_') AS queue FROM orders")
def normalise_queue_label(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.label(F.col("o_orderpriority")).alias("queue"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def drop_unknown_labels(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")).select("o_orderkey", "o_orderpriority")


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def validate_domain_hubs(spark, d):
    """Rows whose nation a domain lacks; the check itself raises."""
    known = table(spark, d, "nation").where("n_regionkey < 3")
    return table(spark, d, "supplier").join(known, F.col("s_nationkey") == F.col("n_nationkey"), "left_anti").select("s_suppkey", "s_nationkey")


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity BETWEEN 5 AND 45 THEN l_quantity END AS quantity FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(quantity, (SELECT quantile_cont(quantity, 0.5) FROM b)) AS quantity, CAST(quantity IS NULL AS INTEGER) AS quantity__was_missing FROM b""")
def impute_median_flag(spark, d):
    return C.impute_medians(bounds_to_null(spark, d).select(*LINE_KEYS, "l_partkey", "quantity"), ["quantity"])


@query("SELECT s_suppkey, CAST(coalesce(CASE WHEN s_acctbal >= 0 THEN 1 END, 0) AS INTEGER) AS in_credit, CAST(s_acctbal < 0 AS INTEGER) AS in_credit__was_missing FROM supplier")
def impute_zero_flag(spark, d):
    df = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") >= 0, 1).alias("in_credit"))
    return C.impute_zero(df, ["in_credit"])


@query(f"""
WITH f AS ({_FIRST}), b AS (
  SELECT l_orderkey, l_linenumber, lower(trim(l_returnflag)) AS flag, CASE WHEN l_tax <> 0.08 THEN l_tax END AS tax,
         CASE WHEN l_quantity BETWEEN 3 AND 48 THEN l_quantity END AS q, CASE WHEN l_extendedprice BETWEEN 1000 AND 90000 THEN l_extendedprice END AS p FROM f)
SELECT l_orderkey, l_linenumber, flag, tax, coalesce(q, (SELECT quantile_cont(q, 0.5) FROM b)) AS quantity, round(coalesce(p, (SELECT quantile_cont(p, 0.5) FROM b)), 4) AS price,
       CAST(q IS NULL AS INTEGER) AS q_missing, CAST(p IS NULL AS INTEGER) AS p_missing FROM b""")
def clean_shipments(spark, d):
    out = C.cleaned(table(spark, d, "lineitem"), LINE_RULES)
    return rounded(out.select(*LINE_KEYS, F.col("l_returnflag").alias("flag"), F.col("l_tax").alias("tax"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_quantity__was_missing").alias("q_missing"), F.col("l_extendedprice__was_missing").alias("p_missing")))


@query(f"""
WITH f AS ({_FIRST})
SELECT 'duplicates' AS step, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM f) AS rows_affected
UNION ALL SELECT 'label:l_returnflag', count(*) FILTER (WHERE l_returnflag <> lower(trim(l_returnflag))) FROM f
UNION ALL SELECT 'sentinel:l_tax', count(*) FILTER (WHERE l_tax = 0.08) FROM f
UNION ALL SELECT 'bounds:l_quantity', count(*) FILTER (WHERE NOT l_quantity BETWEEN 3 AND 48) FROM f
UNION ALL SELECT 'bounds:l_extendedprice', count(*) FILTER (WHERE NOT l_extendedprice BETWEEN 1000 AND 90000) FROM f""")
def cleaning_audit(spark, d):
    return C.audit(table(spark, d, "lineitem"), LINE_RULES)


@query("""
SELECT o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_totalprice, o_orderkey) AS n FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 400000) WHERE n = 1""")
def clean_orders(spark, d):
    """Label range (low exclusive, high inclusive), then the smallest of each customer's day."""
    df = table(spark, d, "orders").where("o_totalprice > 1000 AND o_totalprice <= 400000")
    return C.keep_first(df, ["o_custkey", "o_orderdate"], ["o_totalprice", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("""
WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)
SELECT vec_id, round(least(greatest(x, -0.2), 0.2), 4) AS x, round(y, 4) AS y FROM p WHERE NOT (x = 0 AND y = 0) AND abs(x) <= 0.3 AND abs(y) <= 0.3""")
def clean_stops(spark, d):
    """Null island and the bounding box out, then clipped."""
    p = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    p = p.where("NOT (x = 0 AND y = 0) AND abs(x) <= 0.3 AND abs(y) <= 0.3")
    return rounded(p.withColumn("x", S.clipped(F.col("x"), -0.2, 0.2)))


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN '1-URGENT' WHEN o_orderstatus = 'F' AND o_totalprice > 150000 THEN '2-HIGH'
  WHEN month(o_orderdate) = 12 THEN '3-MEDIUM' WHEN o_orderstatus = 'P' THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS predicted FROM orders""")
def rules_route(spark, d):
    """An ordered cascade of rules: the first that holds decides."""
    p, s = F.col("o_totalprice"), F.col("o_orderstatus")
    rule = F.when(p > 300000, "1-URGENT").when((s == "F") & (p > 150000), "2-HIGH").when(F.month("o_orderdate") == 12, "3-MEDIUM").when(s == "P", "4-NOT SPECIFIED").otherwise("5-LOW")
    return table(spark, d, "orders").select("o_orderkey", rule.alias("predicted"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity > 25 AS INTEGER) AS heavy, round(l_extendedprice / greatest(l_quantity, 1), 9) AS unit_price,
       round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS paid, CAST(isodow(l_shipdate) >= 6 AS INTEGER) AS weekend, CAST(1 + floor(l_extendedprice / 20000) AS BIGINT) AS legs FROM lineitem""")
def engineer_shipment(spark, d):
    price = F.col("l_extendedprice")
    return rounded(
        table(spark, d, "lineitem").select(
            *LINE_KEYS, "l_partkey", (F.col("l_quantity") > 25).cast("int").alias("heavy"), F.round(S.safe_ratio(price, F.col("l_quantity"), 1), 9).alias("unit_price"),
            F.round(price * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 6).alias("paid"), (S.weekday(F.col("l_shipdate")) >= 5).cast("int").alias("weekend"), (1 + F.floor(price / 20000)).alias("legs"),
        ), 9
    )


@query("""
SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal, CAST(c_mktsegment = 'AUTOMOBILE' AS DOUBLE) AS segment_AUTOMOBILE, CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS segment_BUILDING,
       CAST(c_mktsegment = 'HOUSEHOLD' AS DOUBLE) AS segment_HOUSEHOLD, 0.0::DOUBLE AS segment_UNSEEN FROM customer""")
def onehot_pivot(spark, d):
    """One column for each level of a fixed list, in the order of training; a level not seen is 0."""
    levels = ["AUTOMOBILE", "BUILDING", "HOUSEHOLD", "UNSEEN"]
    return rounded(table(spark, d, "customer").select("c_custkey", "c_acctbal", *[(F.col("c_mktsegment") == v).cast("double").alias(f"segment_{v}") for v in levels]))


@query("SELECT 0.0::DOUBLE AS p_missing, round(p_retailprice, 4) AS p_retailprice, CAST(p_size AS DOUBLE) AS p_size, p_partkey FROM part")
def align_columns(spark, d):
    """The training columns in their order; an absent one is 0."""
    df, want = table(spark, d, "part"), ["p_missing", "p_retailprice", "p_size"]
    return rounded(df.select(*[F.col(c).cast("double").alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in want], "p_partkey"))


@query("""
WITH c AS (SELECT quantile_cont(epoch_us(o_orderdate), 0.8) AS cut FROM orders)
SELECT o_orderkey, epoch_us(o_orderdate) > cut AS is_test FROM orders, c""")
def time_split_quantile(spark, d):
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    df = table(spark, d, "orders").withColumn("at", at)
    cut = R.quantiles(df, "at", [0.8])[0]
    return df.select("o_orderkey", (F.col("at") > F.lit(cut)).alias("is_test"))


@query("SELECT o_orderkey, o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY AS is_test FROM orders")
def time_split_days(spark, d):
    df = table(spark, d, "orders")
    end = df.agg((F.max("o_orderdate") - F.expr("interval 90 days")).alias("cut"))
    return df.crossJoin(F.broadcast(end)).select("o_orderkey", (F.col("o_orderdate") > F.col("cut")).alias("is_test"))


@query("SELECT c_custkey, CAST(concat('0x', substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8)) AS UBIGINT) % 1000 < 700 AS is_train FROM customer")
def hash_split_md5(spark, d):
    h = F.conv(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 8), 16, 10).cast("long")
    return table(spark, d, "customer").select("c_custkey", (h % 1000 < 700).alias("is_train"))


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::UBIGINT)), lambda v, z: xor(v >> 1, CASE WHEN v & 1::UBIGINT = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::UBIGINT)), lambda c, b: {bits}), 4294967295::UBIGINT)"


@query(f"SELECT c_custkey, {_crc32_sql('CAST(c_custkey AS VARCHAR)')} % 100 < 70 AS is_train FROM customer")
def hash_split_crc32(spark, d):
    return table(spark, d, "customer").select("c_custkey", (F.crc32(F.col("c_custkey").cast("string").cast("binary")) % 100 < 70).alias("is_train"))


@query("""
WITH u AS (SELECT c_custkey, c_mktsegment, CAST(concat('0x', substr(md5(concat(CAST(c_custkey AS VARCHAR), ':split')), 1, 8)) AS UBIGINT) / 4294967296.0::DOUBLE AS draw FROM customer)
SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY draw, c_custkey) <= round_even(count(*) OVER (PARTITION BY c_mktsegment) * 0.25, 0) AS is_test FROM u""")
def stratified_split(spark, d):
    return C.stratified_test(table(spark, d, "customer"), "c_mktsegment", ["c_custkey"], 0.25, S.uniform(F.col("c_custkey"), "split")).select("c_custkey", "c_mktsegment", "is_test")


@query("""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.7) AS a, quantile_cont(o_totalprice, 0.92) AS b FROM orders)
SELECT o_orderkey, CASE WHEN o_totalprice <= a THEN 'standard' WHEN o_totalprice <= b THEN 'premium' ELSE 'contract' END AS tier FROM orders, q""")
def tier_by_quantile(spark, d):
    df = table(spark, d, "orders")
    a, b = R.quantiles(df, "o_totalprice", [0.7, 0.92])
    p = F.col("o_totalprice")
    return df.select("o_orderkey", F.when(p <= F.lit(a), "standard").when(p <= F.lit(b), "premium").otherwise("contract").alias("tier"))


@query("""
SELECT lever, round(sum(m), 4) AS strength FROM (
  SELECT CASE WHEN feature LIKE 'l\\_%price' ESCAPE '\\' THEN 'price' WHEN feature IN ('l_tax', 'l_discount') THEN 'terms' ELSE 'other' END AS lever, avg(abs(value)) AS m
  FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem) GROUP BY feature)
GROUP BY 1""")
def feature_group_map(spark, d):
    """Features to levers by pattern, list or default; a lever's strength is the sum of its features' mean sizes."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    long = table(spark, d, "lineitem").select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names])))
    c = F.col("feature")
    lever = F.when(F.startswith(c, F.lit("l_")) & F.endswith(c, F.lit("price")), "price").when(c.isin("l_tax", "l_discount"), "terms").otherwise("other")
    by = long.groupBy("feature").agg(F.avg(F.abs("value")).alias("m"))
    return rounded(by.groupBy(lever.alias("lever")).agg(F.sum("m").alias("strength")))


@query("SELECT c_nationkey AS nation, 'customer' AS role, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 'supplier', count(*) FROM supplier GROUP BY 1")
def union_all(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n")).withColumn("role", F.lit("customer"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n")).withColumn("role", F.lit("supplier"))
    return a.unionByName(b)


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_rows(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@query("SELECT DISTINCT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_policies(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersect_leak(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
def set_difference_missing(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("nation")).subtract(table(spark, d, "supplier").where("s_acctbal > 8000").select("s_nationkey"))


@query("""
SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error,
       count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1""")
def pivot_wide(spark, d):
    out = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).pivot("event_type", ["click", "error", "view"]).count()
    return out.na.fill(0)


@query("""
SELECT s_suppkey, unnest(['balance', 'nation']) AS field, unnest([round(s_acctbal, 4), CAST(s_nationkey AS DOUBLE)]) AS value FROM supplier""")
def melt_long(spark, d):
    df = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return rounded(df.unpivot("s_suppkey", ["balance", "nation"], "field", "value"))


@query("""
SELECT f.flag, coalesce(n, 0) AS n FROM (VALUES ('A'), ('N'), ('R'), ('X')) f(flag) LEFT JOIN (SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1) USING (flag)""")
def reindex_domain_fill(spark, d):
    domain = spark.createDataFrame([(f,) for f in "ANRX"], "flag string")
    counts = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))
    return F.broadcast(domain).join(counts, "flag", "left").na.fill(0)


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def explode_tags(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE CAST(concat('0x', substr(md5(concat(CAST(o_orderkey AS VARCHAR), ':sample')), 1, 8)) AS UBIGINT) / 4294967296.0::DOUBLE < 0.1")
def sample_frac(spark, d):
    """A seeded sample by key: the same rows however the table is split."""
    return table(spark, d, "orders").where(S.uniform(F.col("o_orderkey"), "sample") < 0.1).select("o_orderkey")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, list_aggregate([l_discount > 0.09, l_tax > 0.07, l_quantity < 2], 'bool_or') AS any_flag,
       CASE greatest(l_discount * 10, l_tax * 12, l_quantity / 50) WHEN l_discount * 10 THEN 'discount' WHEN l_tax * 12 THEN 'tax' ELSE 'quantity' END AS largest FROM lineitem""")
def fn_bool_row_any(spark, d):
    flags = S.any_of([F.col("l_discount") > 0.09, F.col("l_tax") > 0.07, F.col("l_quantity") < 2])
    most = S.first_largest({"discount": F.col("l_discount") * 10, "tax": F.col("l_tax") * 12, "quantity": F.col("l_quantity") / 50})
    return table(spark, d, "lineitem").select(*LINE_KEYS, "l_partkey", flags.alias("any_flag"), most.alias("largest"))


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def win_dedup_keep_first(spark, d):
    return C.keep_first(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_orderkey", "o_totalprice")


@query("""
SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_shipdate) AS n FROM lineitem) WHERE n = 1""")
def win_dedup_keep_smallest(spark, d):
    order = ["l_quantity", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    return C.keep_first(table(spark, d, "lineitem"), LINE_KEYS, order).select(*LINE_KEYS, "l_quantity")


@query("SELECT l_orderkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS place FROM lineitem")
def win_cumcount(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", (F.row_number().over(w).cast("long") - 1).alias("place"))
