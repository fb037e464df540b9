"""Text functions over names."""

from __future__ import annotations

from pyspark.sql import functions as F

from freightloom.functions import text as T
from freightloom.plans.registry import query, rounded, table

_GRAMS = "list_distinct(list_transform(generate_series(1, length({0}) + 2), lambda i: substr(concat('##', {0}, '##'), i, 3)))"


@query(f"SELECT p_partkey, len({_GRAMS.format('p_name')}) AS n_grams FROM part")
def fn_trigrams(spark, d):
    return table(spark, d, "part").select("p_partkey", F.size(T.trigrams(F.col("p_name"))).cast("long").alias("n_grams"))


@query(f"""
WITH g AS (SELECT p_partkey, {_GRAMS.format('p_name')} AS a, {_GRAMS.format("concat(lower(p_type), ' widget')")} AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 4) AS jaccard FROM g""")
def fn_jaccard(spark, d):
    """Of two texts of a row."""
    other = F.concat(F.lower("p_type"), F.lit(" widget"))
    return rounded(table(spark, d, "part").select("p_partkey", T.jaccard(T.trigrams(F.col("p_name")), T.trigrams(other)).alias("jaccard")))


@query("""
WITH t AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, string_split('red widget', ' ') AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 4) AS overlap FROM t""")
def fn_token_overlap(spark, d):
    return rounded(table(spark, d, "part").select("p_partkey", T.token_overlap(F.col("p_name"), F.lit("red #widget")).alias("overlap")))


@query("""
WITH l AS (SELECT p_partkey, string_split(regexp_replace(upper(p_name), '[^A-Z]', '', 'g'), '') AS c FROM part), k AS (SELECT p_partkey, list_filter(c, lambda x, i: i = 1 OR NOT list_contains(['A', 'E', 'I', 'O', 'U'], x)) AS k FROM l)
SELECT p_partkey, array_to_string(list_filter(k, lambda x, i: i = 1 OR x <> k[i - 1])[1:4], '') AS phonetic FROM k""")
def fn_phonetic(spark, d):
    return table(spark, d, "part").select("p_partkey", T.phonetic(F.col("p_name")).alias("phonetic"))


@query("""
SELECT c_custkey, FALSE AS same, substr(c_name, 1, 9) || substr(c_name, 11, 1) || substr(c_name, 10, 1) || substr(c_name, 12) <> c_name AS swapped FROM customer""")
def fn_adjacent_transposition(spark, d):
    name = F.col("c_name")
    swapped = F.concat(F.substring(name, 1, 9), F.substring(name, 11, 1), F.substring(name, 10, 1), F.substring(name, 12, 99))
    return table(spark, d, "customer").select("c_custkey", T.swapped_once(name, name).alias("same"), T.swapped_once(name, swapped).alias("swapped"))


@query("SELECT n_nationkey, upper(trim(regexp_replace(n_name, '\\s+', ' ', 'g'))) AS name, CAST(string_split(n_name, '_')[2] AS BIGINT) AS number FROM nation")
def fn_normalize_address(spark, d):
    """White space and case in order, and the first all-digit token."""
    name = F.col("n_name")
    return table(spark, d, "nation").select("n_nationkey", T.upper_words(name).alias("name"), F.regexp_extract(name, r"(\d+)", 1).cast("long").alias("number"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def scan_json_records(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def fn_to_datetime_coerce(spark, d):
    said = F.when(F.col("o_orderkey") % 3 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", F.to_date(F.try_to_timestamp(said, F.lit("yyyy-MM-dd"))).alias("day"))
