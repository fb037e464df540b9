"""Evaluation tables, policy comparisons, files written and read back, and small functions of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightloom.functions import scalar as S
from freightloom.functions import text as T
from freightloom.operators import decide as D
from freightloom.operators import metrics as M
from freightloom.operators import ranked as R
from freightloom.operators.scratch import new_path
from freightloom.plans.decisions import _ACTED, acted
from freightloom.plans.further import _TOUR, _legs
from freightloom.plans.panels import TYPE_DAYS, USER_DAYS, summed_days, type_days, user_days
from freightloom.plans.matching import PAIRS, matched_pairs
from freightloom.plans.registry import query, rounded, table
from freightloom.plans.routing import _STOPS, stops
from freightloom.plans.runs import _DEMAND, _demand
from freightloom.plans.scores import _FORECAST, _ROUTED, SCORED, TIED, U, forecasts, routed, scored, tied
from freightloom.sources import files

# --- Sources and sinks


@query("SELECT o_orderkey, c_mktsegment AS segment, n_name AS nation FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def scan_multi_file_star(spark, d):
    """A star of three CSV files, read by one call and joined."""
    folder = new_path(spark)
    for name, columns in {"orders": ["o_orderkey", "o_custkey"], "customer": ["c_custkey", "c_mktsegment", "c_nationkey"], "nation": ["n_nationkey", "n_name"]}.items():
        files.write_csv(table(spark, d, name).select(*columns), f"{folder}/{name}.csv")
    schemas = {"orders": "o_orderkey long, o_custkey long", "customer": "c_custkey long, c_mktsegment string, c_nationkey int", "nation": "n_nationkey int, n_name string"}
    read = files.star(spark, folder, {n: f"{n}.csv" for n in schemas}, lambda s, path: files.csv_typed(s, path, schemas[path.rsplit("/", 1)[1].removesuffix(".csv")]))
    out = read["orders"].join(read["customer"], F.col("c_custkey") == F.col("o_custkey")).join(read["nation"], F.col("n_nationkey") == F.col("c_nationkey"))
    return out.select("o_orderkey", F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 0")
def scan_multi_file_star_eta(spark, d):
    folder = new_path(spark)
    schemas = {"lineitem": "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double", "part": "p_partkey long, p_brand string"}
    for name, schema in schemas.items():
        files.write_csv(table(spark, d, name).select(*[c.split()[0] for c in schema.split(", ")]), f"{folder}/{name}.csv")
    read = files.star(spark, folder, {n: f"{n}.csv" for n in schemas}, lambda s, path: files.csv_typed(s, path, schemas[path.rsplit("/", 1)[1].removesuffix(".csv")]))
    return read["lineitem"].where("l_quantity > 0").join(read["part"], F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_brand")


def _instances(spark, d) -> DataFrame:
    """Stops written as one sectioned text file for each instance, and read again; coordinates in thousandths."""
    path = new_path(spark)
    s = stops(spark, d).select("instance", "stop", F.floor(F.col("x") * 1000).alias("x"), F.floor(F.col("y") * 1000).alias("y"), F.col("packages").cast("int").alias("q"))
    g = s.groupBy("instance").agg(F.array_sort(F.collect_list(F.struct("stop", "x", "y", "q"))).alias("a"))  # of a block of stops
    lines = lambda *cs: F.array_join(F.transform("a", lambda r: F.concat_ws(" ", *[r[c].cast("string") for c in cs])), "\n")
    text = F.concat(F.lit("NAME : "), "instance", F.lit("\nCAPACITY : 60\nNODE_COORD_SECTION\n"), lines("stop", "x", "y"), F.lit("\nDEMAND_SECTION\n"), lines("stop", "q"), F.lit("\nDEPOT_SECTION\n"), F.array_min(F.transform("a", lambda r: r["stop"])).cast("string"), F.lit("\n-1\nEOF"))
    g.select("instance", text.alias("value")).write.partitionBy("instance").text(path)
    return files.routing_instances(spark, f"{path}/*/*")


@query(f"WITH {_STOPS} SELECT instance AS name, 60.0::DOUBLE AS capacity, CAST(stop AS INTEGER) AS node, floor(x * 1000) AS x, floor(y * 1000) AS y, packages AS demand, stop = min(stop) OVER (PARTITION BY instance) AS is_depot FROM s")
def scan_tsplib_vrp(spark, d):
    return _instances(spark, d)


@query(f"WITH {_STOPS} SELECT instance AS name, CAST(stop AS INTEGER) AS node, floor(x * 1000) AS x, floor(y * 1000) AS y, packages, 0.0::DOUBLE AS service_min FROM s QUALIFY stop > min(stop) OVER (PARTITION BY instance)")
def adapter_cvrp_frame(spark, d):
    return files.stop_frame(_instances(spark, d))


@query(f"WITH {_STOPS} SELECT CAST(instance AS INTEGER) AS instance, CAST(1 + stop % 2 AS INTEGER) AS route, CAST(row_number() OVER (PARTITION BY instance, stop % 2 ORDER BY stop) - 1 AS INTEGER) AS seq, CAST(stop AS INTEGER) AS node, sum(packages) OVER (PARTITION BY instance) AS cost FROM s")
def scan_tsplib_sol(spark, d):
    """Solutions of two routes an instance, written as text and read again."""
    path = new_path(spark)
    s = stops(spark, d).groupBy("instance", (1 + F.col("stop") % 2).alias("route")).agg(F.array_sort(F.collect_list("stop")).alias("a"), F.sum("packages").alias("q"))
    line = F.concat(F.lit("Route #"), F.col("route").cast("string"), F.lit(": "), F.array_join(F.col("a").cast("array<string>"), " "))
    text = F.concat(F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\nCost "), F.sum("q").cast("string"))
    s.groupBy("instance").agg(text.alias("value")).write.partitionBy("instance").text(path)
    out = files.routing_solutions(spark, f"{path}/*/*")
    return out.select(F.regexp_extract("file", r"instance=(\d+)", 1).cast("int").alias("instance"), "route", "seq", "node", "cost")


files.SOURCES |= {
    "own": lambda spark, folder, most=None: table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("label")),
    "star": lambda spark, folder, most=None: table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.round(F.sum("l_extendedprice"), 2).alias("label")),
}
#: The largest label that a source may hold.
LABEL_CAPS = {"own": 300000.0, "star": 200000.0}


@query("SELECT o_orderkey AS key, round(o_totalprice, 4) AS label FROM orders")
def scan_source_switch(spark, d):
    return rounded(files.source("own", folder=d)(spark))


@query("SELECT l_orderkey AS key, round(sum(l_extendedprice), 2) AS label FROM lineitem GROUP BY 1")
def scan_source_switch_eta(spark, d):
    return files.source("star", folder=d)(spark)


@query("WITH a AS (SELECT 'own' AS source, o_orderkey AS key, round(o_totalprice, 2) AS label FROM orders WHERE o_totalprice <= 300000 UNION ALL SELECT 'star', l_orderkey, round(sum(l_extendedprice), 2) FROM lineitem GROUP BY 2 HAVING round(sum(l_extendedprice), 2) <= 200000) SELECT source, key, label FROM a")
def source_label_cap(spark, d):
    """Each source under its own cap on labels."""
    parts = [files.source(n, folder=d)(spark).where(F.col("label") <= cap).select(F.lit(n).alias("source"), "key", F.round("label", 2).alias("label")) for n, cap in LABEL_CAPS.items()]
    return parts[0].unionByName(parts[1])


@query("SELECT c_custkey, c_mktsegment, c_nationkey FROM customer")
def sink_csv(spark, d):
    path = new_path(spark)
    files.write_csv(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), path)
    return files.csv_typed(spark, path, "c_custkey long, c_mktsegment string, c_nationkey int")


@query(f"WITH {SCORED} SELECT priority, count(*) AS n, round(avg(pow(p - y, 2)), 4) AS brier FROM s GROUP BY 1")
def sink_json_metrics(spark, d):
    """A table of metrics as JSON lines, read back."""
    path = new_path(spark)
    rounded(scored(spark, d).groupBy("priority").agg(F.count("*").alias("n"), M.brier(F.col("p"), F.col("y")).alias("brier"))).write.json(path)
    return spark.read.schema("priority string, n long, brier double").json(path)


@query(f"WITH {SCORED}, {_ACTED} SELECT action, count(*) AS n, round(sum(cost), 2) AS spend FROM b GROUP BY 1")
def sink_policy_table(spark, d):
    path = new_path(spark)
    files.write_csv(acted(spark, d).groupBy("action").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 2).alias("spend")), path, one_file=True)
    return files.csv_typed(spark, path, "action string, n long, spend double")


@query(f"WITH {_STOPS} SELECT instance AS policy, CAST(stop % 3 AS INTEGER) AS truck, CAST(row_number() OVER (PARTITION BY instance, stop % 3 ORDER BY stop) - 1 AS INTEGER) AS seq, stop, packages FROM s")
def sink_routes_long(spark, d):
    """Nested routes as one row for each stop."""
    s = stops(spark, d)
    truck = s.groupBy("instance", (F.col("stop") % 3).alias("truck")).agg(F.array_sort(F.collect_list("stop")).alias("route"))
    nested = truck.groupBy(F.col("instance").alias("policy")).agg(F.transform(F.array_sort(F.collect_list(F.struct("truck", "route"))), lambda r: r["route"]).alias("routes"))
    return files.routes_long(nested, s.select("stop", "packages")).select("policy", "truck", "seq", "stop", "packages")


@query("SELECT n_regionkey AS region, concat('| ', CAST(n_regionkey AS VARCHAR), ' | ', CAST(count(*) AS VARCHAR), ' |') AS line FROM nation GROUP BY 1")
def sink_markdown_table(spark, d):
    """Lines of a Markdown table, one for each row, made where the rows are."""
    g = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"))
    return g.select("region", files.markdown_line(g).alias("line"))


@query(f"WITH {_FORECAST}, m AS (SELECT event_type, round(sum(abs(naive - actual)) / sum(actual)::DOUBLE, 4) AS naive, round(sum(abs(mean - actual)) / sum(actual)::DOUBLE, 4) AS mean FROM g GROUP BY 1) SELECT event_type, 'naive' AS method, naive AS wape FROM m UNION ALL SELECT event_type, 'mean', mean FROM m")
def sink_bench_reports(spark, d):
    """A report for each method, written to its own folder and read back."""
    path, a = new_path(spark), F.col("actual")
    m = forecasts(spark, d).groupBy("event_type").agg(M.wape(F.col("naive"), a).alias("naive"), M.wape(F.col("mean"), a).alias("mean"))
    m.unpivot("event_type", ["naive", "mean"], "method", "wape").withColumn("wape", F.round("wape", 4)).write.partitionBy("method").json(path)
    return spark.read.schema("event_type string, wape double, method string").json(path).select("event_type", "method", "wape")


# --- Rows and functions


@query("SELECT vec_id, round(least(greatest(CAST(embedding[3] AS DOUBLE), -0.1), 0.1), 4) AS x FROM embeddings")
def clip_values(spark, d):
    return rounded(table(spark, d, "embeddings").select("vec_id", S.clipped(F.col("embedding")[2].cast("double"), -0.1, 0.1).alias("x")))


@query("SELECT vec_id FROM embeddings WHERE NOT (round(CAST(embedding[1] AS DOUBLE), 1) = 0 AND round(CAST(embedding[2] AS DOUBLE), 1) = 0)")
def null_island_filter(spark, d):
    near = [F.round(F.col("embedding")[k].cast("double"), 1) == 0 for k in (0, 1)]
    return table(spark, d, "embeddings").where(~(near[0] & near[1])).select("vec_id")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS score FROM part")
def rank_rule_score(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("score"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount), 4) AS paid, CAST(round_even(l_tax * l_quantity * 10, 0) AS BIGINT) AS returns FROM lineitem")
def engineer_order(spark, d):
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid"), S.even_rounded(F.col("l_tax") * F.col("l_quantity") * 10).cast("long").alias("returns")))


@query("SELECT c_custkey, round(c_acctbal, 4) AS x_balance, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS y FROM customer")
def to_xy(spark, d):
    """Features and label; a feature that is the label would raise."""
    from freightloom.operators.clean import forbid_columns

    both = table(spark, d, "customer").select("c_custkey", F.round("c_acctbal", 4).alias("x_balance"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"))
    forbid_columns(both.drop("y"), ["c_mktsegment"])
    return both


@query("SELECT p_partkey, upper(substr(replace(p_name, '_', ' '), 1, 1)) || substr(replace(p_name, '_', ' '), 2) AS shown FROM part")
def pretty_names(spark, d):
    return table(spark, d, "part").select("p_partkey", T.shown(F.col("p_name")).alias("shown"))


@query("SELECT o_orderkey, o_totalprice, l.n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def join_positional_concat(spark, d):
    """Columns of two frames side by side: by their key, because rows have no positions."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(n, "o_orderkey")


@query("SELECT p_brand || '|' || CAST(p_size AS VARCHAR) AS block, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1")
def join_block_index(spark, d):
    block = F.concat_ws("|", "p_brand", F.col("p_size").cast("string"))
    return table(spark, d, "part").groupBy(block.alias("block")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query(f"WITH {_STOPS} SELECT a.instance, a.stop AS a, b.stop AS b, CAST(floor(10000 * sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) + 0.5::DOUBLE) AS BIGINT) AS miles FROM s a JOIN s b ON a.instance = b.instance AND a.stop <> b.stop")
def join_cross_matrix_int(spark, d):
    """Whole distances, half up, inside blocks of a fixed number of stops."""
    s = stops(spark, d)
    b = s.select("instance", F.col("stop").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return s.withColumnRenamed("stop", "a").join(b, "instance").where("a <> b").select("instance", "a", "b", F.floor(10000 * S.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) + 0.5).alias("miles"))


@query("SELECT o_custkey, o_orderdate, o_orderkey FROM orders")
def sort_multi(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey").orderBy("o_custkey", "o_orderdate", "o_orderkey")


@query(f"WITH {SCORED} SELECT o_orderkey, round(p, 4) AS p, row_number() OVER (ORDER BY p DESC, o_orderkey) AS rank FROM s")
def sort_desc_rank_output(spark, d):
    """The scored output with its rank; the rank says the order."""
    return rounded(R.running(scored(spark, d).select("o_orderkey", "p"), [F.desc("p"), F.col("o_orderkey")]).select("o_orderkey", "p", "rank"))


@query("SELECT s_suppkey, s_acctbal FROM supplier")
def shuffle_rows(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.md5(F.col("s_suppkey").cast("string")), "s_suppkey")


@query("SELECT o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), ':background')), o_orderkey) <= 400")
def sample_background(spark, d):
    """A drawn background of a fixed number of rows: sampling is the feature."""
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(":background"))), "o_orderkey").limit(400)


@query("SELECT p_brand, p_size, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY p_brand ORDER BY p_size) - count(*) AS BIGINT) AS starts FROM part GROUP BY 1, 2")
def win_group_starts(spark, d):
    """Where each group starts among its brand's rows in order."""
    g = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return g.withColumn("starts", F.sum("n").over(Window.partitionBy("p_brand").orderBy("p_size")) - F.col("n"))


@query(f"WITH {SCORED} SELECT o_orderkey, round(p - 0.5::DOUBLE, 4) AS contribution FROM s QUALIFY row_number() OVER (ORDER BY abs(p - 0.5::DOUBLE) DESC, o_orderkey) <= 8")
def topk_abs(spark, d):
    c = F.col("p") - 0.5
    return rounded(scored(spark, d).orderBy(F.desc(F.abs(c)), "o_orderkey").limit(8).select("o_orderkey", c.alias("contribution")))


@query("SELECT p_partkey, upper(p_name) AS raw, upper(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS name, try_cast(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS number FROM part")
def fn_normalize_labels(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", F.upper(name).alias("raw"), T.upper_words(name).alias("name"), F.expr("try_cast(regexp_extract(p_brand, '(\\\\d+)', 1) AS BIGINT)").alias("number"))


@query("""
WITH p AS (SELECT vec_id, CAST(embedding[5] AS DOUBLE) AS a, CAST(embedding[6] AS DOUBLE) AS b, CAST(embedding[7] AS DOUBLE) AS c, CAST(embedding[8] AS DOUBLE) AS e FROM embeddings)
SELECT vec_id, round(1.15::DOUBLE * 2 * 3958.8::DOUBLE * asin(sqrt(pow(sin(radians(c * 10 - a * 10) / 2), 2) + cos(radians(35 + a * 10)) * cos(radians(35 + c * 10)) * pow(sin(radians(e * 10 - b * 10) / 2), 2))), 4) AS road_miles FROM p""")
def fn_haversine_eta(spark, d):
    """Road miles: the great circle by a detour factor."""
    e = [F.col("embedding")[k].cast("double") * 10 for k in range(4, 8)]
    return rounded(table(spark, d, "embeddings").select("vec_id", (1.15 * S.haversine(35 + e[0], -90 + e[1], 35 + e[2], -90 + e[3])).alias("road_miles")))


@query("SELECT p_partkey, i, round(p_retailprice * (1.02::DOUBLE + i * 0.58::DOUBLE / 29), 4) AS price FROM part CROSS JOIN (SELECT unnest(generate_series(0, 29)) AS i)")
def fn_grid(spark, d):
    """Thirty prices of each part, evenly spaced multipliers of its cost."""
    i = F.col("i")
    return rounded(table(spark, d, "part").select("p_partkey", "p_retailprice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))).alias("i")).select("p_partkey", "i", (F.col("p_retailprice") * (1.02 + i * 0.58 / 29)).alias("price")))


@query("SELECT p_partkey, round(p_retailprice * 1.25::DOUBLE, 4) AS price FROM part")
def fn_flat_price(spark, d):
    return rounded(table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 1.25).alias("price")))


@query(f"WITH {_TOUR} SELECT instance, round(sum(leg) + arg_max(back, seq), 4) AS miles FROM m GROUP BY 1")
def fn_route_miles(spark, d):
    return rounded(_legs(spark, d).groupBy("instance").agg((F.sum("leg") + F.max_by("back", "seq")).alias("miles")))


@query(f"WITH {_TOUR} SELECT instance, round((sum(leg) + arg_max(back, seq)) / 25 * 60 + count(*) * 3, 4) AS minutes FROM m GROUP BY 1")
def fn_route_minutes(spark, d):
    return rounded(_legs(spark, d).groupBy("instance").agg(((F.sum("leg") + F.max_by("back", "seq")) / 25 * 60 + F.count("*") * 3).alias("minutes")))


@query(f"WITH {_TOUR}, r AS (SELECT instance, sum(leg) + arg_max(back, seq) AS miles FROM m GROUP BY 1) SELECT round(sum(miles), 4) AS cost, count(*) AS routes FROM r")
def fn_solution_cost(spark, d):
    r = _legs(spark, d).groupBy("instance").agg((F.sum("leg") + F.max_by("back", "seq")).alias("miles"))
    return rounded(r.agg(F.sum("miles").alias("cost"), F.count("*").alias("routes")))


@query(f"WITH {_TOUR} SELECT instance, sum(packages) <= 65 AND (sum(leg) + arg_max(back, seq)) / 25 * 60 + count(*) * 3 <= 480 AS feasible FROM m GROUP BY 1")
def fn_feasible(spark, d):
    minutes = (F.sum("leg") + F.max_by("back", "seq")) / 25 * 60 + F.count("*") * 3
    return _legs(spark, d).groupBy("instance").agg(((F.sum("packages") <= 65) & (minutes <= 480)).alias("feasible"))


@query("SELECT s_suppkey, concat(CAST(s_nationkey AS VARCHAR), ' prior exception', CASE WHEN s_nationkey = 1 THEN '' ELSE 's' END) AS phrase FROM supplier")
def fn_phrase(spark, d):
    n = F.col("s_nationkey")
    return table(spark, d, "supplier").select("s_suppkey", F.concat(n.cast("string"), F.lit(" prior exception"), F.when(n == 1, "").otherwise("s")).alias("phrase"))


@query("SELECT s_suppkey, round(s_acctbal / nullif(s_nationkey, 0), 9) AS ratio, coalesce(round(s_acctbal / nullif(s_nationkey, 0), 9), 0) AS filled FROM supplier")
def fn_safe_divide(spark, d):
    ratio = F.round(F.try_divide("s_acctbal", "s_nationkey"), 9)
    return table(spark, d, "supplier").select("s_suppkey", ratio.alias("ratio"), F.coalesce(ratio, F.lit(0.0)).alias("filled"))


@query("SELECT p_partkey, starts_with(p_name, 'red') AS starts, ends_with(p_name, 'widget') AS ends FROM part")
def fn_startswith_endswith(spark, d):
    return table(spark, d, "part").select("p_partkey", F.startswith("p_name", F.lit("red")).alias("starts"), F.endswith("p_name", F.lit("widget")).alias("ends"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 3.0::DOUBLE WHEN 'O' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM orders")
def fn_map_default(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.looked_up(F.col("o_orderstatus"), {"F": 3.0, "O": 2.0}, 1.0).alias("weight"))


# --- Forecasts


def _fm(where: str = "TRUE") -> str:
    return f"round(sum(abs(mean - actual)) FILTER (WHERE {where}) / sum(actual) FILTER (WHERE {where})::DOUBLE, 4) AS wape, round(avg(greatest(0.9::DOUBLE * (actual - mean * 1.2::DOUBLE), -0.1::DOUBLE * (actual - mean * 1.2::DOUBLE))) FILTER (WHERE {where}), 4) AS pinball, round(avg(CAST(actual BETWEEN mean * 0.8::DOUBLE AND mean * 1.2::DOUBLE AS INTEGER)) FILTER (WHERE {where}), 4) AS coverage, round(avg(mean * 0.4::DOUBLE) FILTER (WHERE {where}), 4) AS width"


@query(f"WITH {_FORECAST} SELECT 'all' AS part, {_fm()} FROM g UNION ALL SELECT 'peak', {_fm('isodow(day) >= 6')} FROM g")
def agg_fm_metrics(spark, d):
    """Overall and on peak days, from one pass over rows that say which parts they are in."""
    m, a = F.col("mean"), F.col("actual")
    parts = F.array_compact(F.array(F.lit("all"), F.when(S.weekday(F.col("day")) >= 5, "peak")))
    f = forecasts(spark, d).select("*", F.explode(parts).alias("part")).groupBy("part")
    return rounded(f.agg(M.wape(m, a).alias("wape"), M.pinball(m * 1.2, a, 0.9).alias("pinball"), M.coverage(m * 0.8, m * 1.2, a).alias("coverage"), F.avg(m * 0.4).alias("width")))


@query(f"WITH {_FORECAST} SELECT unnest(['naive', 'mean']) AS method, unnest([round(avg(abs(naive - actual)), 4), round(avg(abs(mean - actual)), 4)]) AS mae FROM g")
def agg_comparison_table(spark, d):
    a = F.col("actual")
    wide = forecasts(spark, d).agg(M.mae(F.col("naive"), a).alias("naive"), M.mae(F.col("mean"), a).alias("mean"))
    return rounded(wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("method"), F.col(c).alias("mae")) for c in ("naive", "mean")]))))


@query(f"""
WITH {TYPE_DAYS}, f AS (SELECT event_type, day, n AS actual, avg(n) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 3650 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS forecast FROM u)
SELECT event_type, day, actual, round(forecast, 4) AS forecast FROM f WHERE day > (SELECT max(day) FROM u) - 10""")
def rolling_origin(spark, d):
    """Each test day's forecast from all days strictly before it."""
    from freightloom.operators.windows import trailing_mean

    u = type_days(spark, d)
    end = u.agg(F.date_sub(F.max("day"), 10).alias("cut"))
    f = trailing_mean(u, ["event_type"], "day", "n", 3650, 1, "forecast")
    return rounded(f.crossJoin(F.broadcast(end)).where("day > cut").select("event_type", "day", F.col("n").alias("actual"), "forecast"))


@query(f"""
WITH {_FORECAST} SELECT event_type, round(sum(abs(mean - actual)) / sum(actual)::DOUBLE, 4) AS wape, round(sum(mean - actual) / sum(actual)::DOUBLE, 4) AS bias, round(avg(greatest(0.8::DOUBLE * (actual - mean), -0.2::DOUBLE * (actual - mean))), 4) AS pinball,
  round(avg(CAST(actual > ceil(mean * 1.1::DOUBLE) AS INTEGER)), 4) AS short_days, round(1 - sum(abs(mean - actual)) / sum(abs(naive - actual))::DOUBLE, 4) AS skill FROM g GROUP BY 1""")
def eval_volume(spark, d):
    """Accuracy, quantile loss, staffing and skill over the naive forecast, by hub."""
    m, a = F.col("mean"), F.col("actual")
    skill = 1 - F.sum(F.abs(m - a)) / F.sum(F.abs(F.col("naive") - a))
    return rounded(forecasts(spark, d).groupBy("event_type").agg(M.wape(m, a).alias("wape"), M.bias(m, a).alias("bias"), M.pinball(m, a, 0.8).alias("pinball"), F.avg((a > F.ceil(m * 1.1)).cast("int")).alias("short_days"), skill.alias("skill")))


# --- Classifiers and matches


@query(f"""
WITH {SCORED}, r AS (SELECT *, CAST(ceil(row_number() OVER (ORDER BY p DESC, o_orderkey) / (SELECT count(*) FROM s)::DOUBLE * 10) AS BIGINT) AS decile FROM s)
SELECT decile, count(*) AS n, round(avg(y), 4) AS rate, round(sum(y * value), 2) AS dollars, round(sum(y * value * 0.1::DOUBLE - 5), 2) AS net FROM r GROUP BY 1""")
def eval_returns(spark, d):
    """Ranking, dollars and what an intervention on each decile would net."""
    worth = F.col("y") * F.col("value")
    g = R.deciles(scored(spark, d), [F.desc("p"), F.col("o_orderkey")]).groupBy("decile")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("y"), 4).alias("rate"), F.round(F.sum(worth), 2).alias("dollars"), F.round(F.sum(worth * 0.1 - 5), 2).alias("net"))


_FLEET = f"""{USER_DAYS}, f AS (SELECT user_id, day FROM u WHERE failed = 1), p AS (SELECT 'often' AS policy, user_id, day FROM u WHERE n > 3 UNION ALL SELECT 'costly', user_id, day FROM u WHERE total > 150),
q AS (SELECT x.policy, f.user_id, f.day, max(f.day - p.day) AS lead FROM f CROSS JOIN (SELECT unnest(['often', 'costly']) AS policy) x LEFT JOIN p ON p.policy = x.policy AND p.user_id = f.user_id AND p.day BETWEEN f.day - 14 AND f.day - 1 GROUP BY 1, 2, 3)"""


@query(f"WITH {_FLEET} SELECT policy, count(*) AS failures, round(avg(CAST(lead IS NOT NULL AS INTEGER)), 4) AS caught, round(avg(lead), 4) AS mean_lead, sum(CASE WHEN lead IS NOT NULL THEN 900.0::DOUBLE ELSE -1400.0::DOUBLE END) AS money FROM q GROUP BY 1")
def eval_fleet(spark, d):
    """For each flagging policy: failures with a flag in the fourteen days before, lead times and money."""
    from freightloom.operators.joins import lookback_first

    u = user_days(spark, d)
    failures, out = u.where("failed = 1").select("user_id", "day"), None
    for name, flag in (("often", F.col("n") > 3), ("costly", F.col("total") > 150)):
        met = lookback_first(failures, u.where(flag).select("user_id", F.col("day").alias("flagged")), ["user_id"], "day", "flagged", 1, 14).withColumn("policy", F.lit(name))
        out = met if out is None else out.unionByName(met)
    lead = F.datediff("day", "flagged")
    return rounded(out.groupBy("policy").agg(F.count("*").alias("failures"), F.avg(lead.isNotNull().cast("int")).alias("caught"), F.avg(lead).alias("mean_lead"), F.sum(F.when(lead.isNotNull(), 900.0).otherwise(-1400.0)).alias("money")))


def _match_sql(tail: str) -> str:
    return f"WITH {PAIRS}, b AS (SELECT label, point, gap, 1.0::DOUBLE / (1 + gap) AS score FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, point) AS n FROM b), m AS (SELECT label, point, score, label = point AS hit, label % 60 = 0 AS orphan FROM o WHERE n = 1) " + tail


def _matches(spark, d) -> DataFrame:
    """Each label's best point with a score; every sixtieth label is an orphan, which should stay unmatched."""
    b = matched_pairs(spark, d).withColumn("score", 1.0 / (1 + F.col("gap")))
    n = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "point"))
    return b.withColumn("n", n).where("n = 1").select("label", "point", "score", (F.col("label") == F.col("point")).alias("hit"), (F.col("label") % 60 == 0).alias("orphan"))


def _at(t: str) -> str:
    return f"round(avg(CAST(score >= {t} AS INTEGER)), 4) AS coverage, round(coalesce(avg(CAST(hit AND NOT orphan AS INTEGER)) FILTER (WHERE score >= {t}), 1), 4) AS \"precision\", round(10000.0::DOUBLE * count(*) FILTER (WHERE score >= {t} AND (orphan OR NOT hit)) / count(*), 4) AS false_per_10k, round(avg(CAST(score < {t} AS INTEGER)) FILTER (WHERE orphan), 4) AS orphan_recall"


def _operating(m: DataFrame, t: float) -> list:
    taken = F.col("score") >= t
    right = F.col("hit") & ~F.col("orphan")
    return [
        F.avg(taken.cast("int")).alias("coverage"), F.coalesce(F.avg(F.when(taken, right.cast("int"))), F.lit(1.0)).alias("precision"),
        (10000.0 * F.count_if(taken & ~right) / F.count("*")).alias("false_per_10k"), F.avg(F.when(F.col("orphan"), (~taken).cast("int"))).alias("orphan_recall"),
    ]


@query(_match_sql(f"SELECT {_at('0.9')} FROM m"))
def agg_threshold_metrics(spark, d):
    """At one threshold: coverage, precision (1 if none is taken), false matches in 10,000, orphans left alone."""
    m = _matches(spark, d)
    return rounded(m.agg(*_operating(m, 0.9)))


@query(_match_sql(" UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, {_at(str(t))} FROM m" for t in (0.2, 0.5, 0.9))))
def eval_match(spark, d):
    """Operating points; each row is read once for all thresholds."""
    m, ts = _matches(spark, d), (0.2, 0.5, 0.9)
    wide = m.agg(*[c.alias(f"{n}_{k}") for k, t in enumerate(ts) for c, n in zip(_operating(m, t), ("coverage", "precision", "false_per_10k", "orphan_recall"))])
    return rounded(wide.select(F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), *[F.col(f"{n}_{k}").alias(n) for n in ("coverage", "precision", "false_per_10k", "orphan_recall")]) for k, t in enumerate(ts)]))))


@query(f"WITH {SCORED}, {TIED}, g AS (SELECT score, count(*) AS n, sum(y) AS pos FROM t GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) - pos AS above FROM g), h AS (SELECT round({U.format('o_orderkey', 'b')}, 2) AS score, count(*) AS n, sum(y) AS pos FROM s GROUP BY 1), e AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) - pos AS above FROM h) SELECT 'model' AS model, round(sum((n - pos) * (above + pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(n - pos)), 4) AS auc FROM c UNION ALL SELECT 'noise', round(sum((n - pos) * (above + pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(n - pos)), 4) FROM e")
def agg_model_quality(spark, d):
    """The areas of two scores."""
    s = tied(spark, d).withColumn("noise", F.round(S.uniform(F.col("o_orderkey"), "b"), 2))
    parts = [R.roc_auc(s, c, F.col("y")).select(F.lit(n).alias("model"), "auc") for n, c in (("model", "score"), ("noise", "noise"))]
    return rounded(parts[0].unionByName(parts[1]))


# --- Policies


@query(f"WITH {SCORED} SELECT o_orderkey, 'do_nothing' AS action, 0.0::DOUBLE AS cost FROM s")
def alloc_none(spark, d):
    return scored(spark, d).select("o_orderkey", F.lit("do_nothing").alias("action"), F.lit(0.0).alias("cost"))


@query(f"WITH {SCORED} SELECT o_orderkey, 'upgrade' AS action, 40.0::DOUBLE AS cost, round(p * 0.6::DOUBLE * (15 + least(0.002::DOUBLE * value, 200)) - 40, 4) AS saving FROM s")
def alloc_upgrade_frame(spark, d):
    saving = F.col("p") * 0.6 * (15 + F.least(0.002 * F.col("value"), F.lit(200.0))) - 40
    return rounded(scored(spark, d).select("o_orderkey", F.lit("upgrade").alias("action"), F.lit(40.0).alias("cost"), saving.alias("saving")))


_TRUE = f"{SCORED}, o AS (SELECT o_orderkey, y * 0.6::DOUBLE * (15 + least(0.002::DOUBLE * value, 200)) - 40 AS saving FROM s), k AS (SELECT *, row_number() OVER (ORDER BY saving DESC, o_orderkey) AS i FROM o WHERE saving > 0)"


def _true_savings(spark, d) -> DataFrame:
    saving = F.col("y") * 0.6 * (15 + F.least(0.002 * F.col("value"), F.lit(200.0))) - 40
    return scored(spark, d).withColumns({"saving": saving, "cost": F.lit(40.0)})


@query(f"WITH {_TRUE} SELECT o_orderkey, round(saving, 4) AS saving FROM k WHERE i <= floor(3000 / 40)")
def alloc_oracle(spark, d):
    """The budget spent where it saves most once outcomes are known."""
    s = _true_savings(spark, d).where("saving > 0").select("o_orderkey", "saving", "cost")
    return rounded(D.within_budget(s, [F.desc("saving"), F.col("o_orderkey")], "cost", 3000.0).select("o_orderkey", "saving"))


@query(f"""
WITH {_TRUE}, r AS (SELECT s.o_orderkey, saving, row_number() OVER (ORDER BY p DESC, s.o_orderkey) AS i, row_number() OVER (ORDER BY value DESC, s.o_orderkey) AS j FROM s JOIN o USING (o_orderkey))
SELECT 'none' AS policy, 0 AS acted, 0.0::DOUBLE AS net UNION ALL SELECT 'risk', count(*), round(sum(saving), 2) FROM r WHERE i <= 75 UNION ALL SELECT 'value', count(*), round(sum(saving), 2) FROM r WHERE j <= 75 UNION ALL SELECT 'oracle', count(*), round(sum(saving), 2) FROM k WHERE i <= 75""")
def alloc_run_policies(spark, d):
    """Four policies on the same rows and outcomes."""
    s = _true_savings(spark, d)
    orders = {"risk": (s, [F.desc("p"), F.col("o_orderkey")]), "value": (s, [F.desc("value"), F.col("o_orderkey")]), "oracle": (s.where("saving > 0"), [F.desc("saving"), F.col("o_orderkey")])}
    out = s.limit(1).select(F.lit("none").alias("policy"), F.lit(0).cast("long").alias("acted"), F.lit(0.0).alias("net"))
    for name, (rows, order) in orders.items():
        top = D.within_budget(rows, order, "cost", 3000.0)
        out = out.unionByName(top.agg(F.lit(name).alias("policy"), F.count("*").alias("acted"), F.round(F.sum("saving"), 2).alias("net")))
    return out


_PRICES = f"{SCORED}, x AS (SELECT o_orderkey, value, p, y, {U.format('o_orderkey', 'buys')} AS u FROM s), q AS (SELECT x.*, policy, value * m AS price, 1 / (1 + exp(8 * (m - 1.2::DOUBLE) - p)) AS win FROM x CROSS JOIN (SELECT unnest(['cost_plus', 'flat', 'rich']) AS policy, unnest([1.1, 1.25, 1.4]::DOUBLE[]) AS m))"


def _priced(spark, d) -> DataFrame:
    """Each row under three price policies: price, chance of a win, and one draw that all share."""
    s = scored(spark, d).withColumn("u", S.uniform(F.col("o_orderkey"), "buys"))
    policies = [("cost_plus", 1.1), ("flat", 1.25), ("rich", 1.4)]
    rows = F.array(*[F.struct(F.lit(n).alias("policy"), (F.col("value") * m).alias("price"), (1 / (1 + F.exp(F.lit(8 * (m - 1.2)) - F.col("p")))).alias("win")) for n, m in policies])
    return s.select("o_orderkey", "value", "p", "u", F.inline(rows))


@query(f"WITH {_PRICES} SELECT o_orderkey, policy, round(price, 4) AS price FROM q")
def price_all_policies(spark, d):
    return rounded(_priced(spark, d).select("o_orderkey", "policy", "price"))


@query(f"WITH {_PRICES} SELECT policy, round(sum(win * (price - value * 0.9::DOUBLE)), 2) AS expected, round(sum(CAST(u < win AS INTEGER) * (price - value * 0.9::DOUBLE)), 2) AS realised, round(avg(CAST(u < win AS INTEGER)), 4) AS win_rate FROM q GROUP BY 1")
def agg_policy_metrics(spark, d):
    """Expected and realised margin and the share won."""
    margin, won = F.col("price") - F.col("value") * 0.9, (F.col("u") < F.col("win")).cast("int")
    return _priced(spark, d).groupBy("policy").agg(F.round(F.sum(F.col("win") * margin), 2).alias("expected"), F.round(F.sum(won * margin), 2).alias("realised"), F.round(F.avg(won), 4).alias("win_rate"))


@query(f"WITH {_PRICES}, e AS (SELECT policy, sum(win * (price - value * 0.9::DOUBLE)) AS m FROM q GROUP BY 1) SELECT policy, round(m, 2) AS margin, round(m / (SELECT m FROM e WHERE policy = 'cost_plus') - 1, 4) AS over_cost_plus, round(m / (SELECT max(m) FROM e), 4) AS of_best FROM e")
def price_evaluate(spark, d):
    """Policies against the habit and the best of them."""
    e = _priced(spark, d).groupBy("policy").agg(F.sum(F.col("win") * (F.col("price") - F.col("value") * 0.9)).alias("m"))
    whole = e.agg(F.max("m").alias("best"), F.max(F.when(F.col("policy") == "cost_plus", F.col("m"))).alias("habit"))
    return e.crossJoin(F.broadcast(whole)).select("policy", F.round("m", 2).alias("margin"), F.round(F.col("m") / F.col("habit") - 1, 4).alias("over_cost_plus"), F.round(F.col("m") / F.col("best"), 4).alias("of_best"))


_BOOKED = f"{_DEMAND}, b AS (SELECT lane, avg(demand) AS habit, quantile_cont(demand, 0.8) AS high FROM w GROUP BY 1), c AS (SELECT lane, month, unnest(['habit', 'high', 'oracle']) AS policy, unnest([ceil(habit), ceil(high), demand]) AS booked, demand FROM w JOIN b USING (lane))"
_COST = "booked * 1000 + greatest(demand - booked, 0) * {} - greatest(booked - demand, 0) * 300"


def _booked(spark, d) -> DataFrame:
    """Each lane's month under three booking policies."""
    w = _demand(spark, d)
    b = w.groupBy("lane").agg(F.avg("demand").alias("habit"), F.percentile("demand", 0.8).alias("high"))
    rows = F.array(*[F.struct(F.lit(n).alias("policy"), c.cast("double").alias("booked")) for n, c in (("habit", F.ceil("habit")), ("high", F.ceil("high")), ("oracle", F.col("demand")))])
    return w.join(b, "lane").select("lane", "month", "demand", F.inline(rows))


def _spent(spot: float):
    return D.booking_costs(F.col("demand"), F.col("booked"), 1000.0, spot, 300.0)["total"]


@query(f"WITH {_BOOKED}, t AS (SELECT policy, month, sum({_COST.format(1900)}) AS cost FROM c GROUP BY 1, 2) SELECT policy, round(avg(cost), 2) AS monthly FROM t GROUP BY 1")
def agg_cost_policy(spark, d):
    """A policy's mean over months of its cost over lanes."""
    t = _booked(spark, d).groupBy("policy", "month").agg(F.sum(_spent(1900.0)).alias("cost"))
    return t.groupBy("policy").agg(F.round(F.avg("cost"), 2).alias("monthly"))


def _comparison(costs: DataFrame, keys: list[str]) -> DataFrame:
    of = lambda p: F.max(F.when(F.col("policy") == p, F.col("cost")))
    whole = costs.groupBy(*keys).agg(of("habit").alias("habit"), of("oracle").alias("oracle"))
    joined = costs.join(whole, keys) if keys else costs.crossJoin(F.broadcast(whole))
    return joined.select(*keys, "policy", F.round("cost", 2).alias("cost"), F.round(1 - F.col("cost") / F.col("habit"), 4).alias("saved"), F.round(F.col("cost") / F.col("oracle") - 1, 4).alias("excess"))


@query(f"WITH {_BOOKED}, t AS (SELECT policy, sum({_COST.format(1900)}) AS cost FROM c WHERE month(month) >= 10 GROUP BY 1) SELECT policy, round(cost, 2) AS cost, round(1 - cost / (SELECT cost FROM t WHERE policy = 'habit'), 4) AS saved, round(cost / (SELECT cost FROM t WHERE policy = 'oracle') - 1, 4) AS excess FROM t")
def agg_cost_comparison(spark, d):
    """In a mask of months: savings against the habit, excess over the oracle."""
    return _comparison(_booked(spark, d).where(F.month("month") >= 10).groupBy("policy").agg(F.sum(_spent(1900.0)).alias("cost")), [])


@query(f"""
WITH {_BOOKED}, t AS (SELECT 'base' AS scenario, policy, sum({_COST.format(1900)}) AS cost FROM c GROUP BY 2 UNION ALL SELECT 'peak', policy, sum({_COST.format(1900)}) FROM c WHERE month(month) >= 10 GROUP BY 2 UNION ALL SELECT 'tight', policy, sum({_COST.format(2800)}) FROM c GROUP BY 2)
SELECT scenario, policy, round(cost, 2) AS cost, round(1 - cost / max(CASE WHEN policy = 'habit' THEN cost END) OVER (PARTITION BY scenario), 4) AS saved, round(cost / max(CASE WHEN policy = 'oracle' THEN cost END) OVER (PARTITION BY scenario) - 1, 4) AS excess FROM t""")
def newsvendor_evaluate(spark, d):
    """All policies in three scenarios; each booking is read once for all of them."""
    peak = F.when(F.month("month") >= 10, _spent(1900.0))
    rows = F.array(F.struct(F.lit("base").alias("scenario"), _spent(1900.0).alias("c")), F.struct(F.lit("peak").alias("scenario"), peak.alias("c")), F.struct(F.lit("tight").alias("scenario"), _spent(2800.0).alias("c")))
    return _comparison(_booked(spark, d).select("policy", F.inline(rows)).groupBy("scenario", "policy").agg(F.sum("c").alias("cost")), ["scenario"])


# --- Detectors and incidents

_ALARMS = f"{USER_DAYS}, o AS (SELECT user_id, min(day) AS onset FROM u WHERE failed = 1 GROUP BY 1), a AS (SELECT o.user_id, onset, (SELECT min(day) FROM u WHERE u.user_id = o.user_id AND n > 3 AND day >= onset) AS found, (SELECT min(day) FROM u WHERE u.user_id = o.user_id AND n > 4 AND day >= onset) AS late FROM o)"


def _delays(spark, d) -> DataFrame:
    from freightloom.operators.joins import asof_after

    u = user_days(spark, d)
    onsets = u.where("failed = 1").groupBy("user_id").agg(F.min("day").alias("onset"))
    for name, most in (("found", 3), ("late", 4)):
        onsets = asof_after(onsets, u.where(F.col("n") > most).select("user_id", F.col("day").alias(name)), ["user_id"], "onset", name)
    return onsets


@query(f"WITH {_ALARMS} SELECT user_id, found - onset AS delay, late - onset AS monthly FROM a WHERE found IS NOT NULL")
def agg_delay_comparison(spark, d):
    """Found onsets by their delay; the second detector's delay may be null."""
    out = _delays(spark, d).dropna(subset=["found"])
    return out.select("user_id", F.datediff("found", "onset").cast("long").alias("delay"), F.datediff("late", "onset").cast("long").alias("monthly")).orderBy("delay", "user_id")


@query(f"WITH {_ALARMS} SELECT user_id % 3 AS kind, count(*) AS onsets, round(avg(CAST(found IS NOT NULL AS INTEGER)), 4) AS caught, round(avg(CAST(late IS NOT NULL AS INTEGER)), 4) AS caught_late, round(avg(found - onset), 4) AS delay FROM a GROUP BY 1")
def eval_network(spark, d):
    out = _delays(spark, d).groupBy((F.col("user_id") % 3).alias("kind"))
    share = lambda c: F.avg(F.col(c).isNotNull().cast("int"))
    return rounded(out.agg(F.count("*").alias("onsets"), share("found").alias("caught"), share("late").alias("caught_late"), F.avg(F.datediff("found", "onset")).alias("delay")))


@query(f"WITH {USER_DAYS}, m AS (SELECT user_id, sum(failed)::DOUBLE / sum(n) AS rate FROM u GROUP BY 1) SELECT user_id, day, n, round(rate - 1.96::DOUBLE * sqrt(rate * (1 - rate) / n), 4) AS low, round(rate + 1.96::DOUBLE * sqrt(rate * (1 - rate) / n), 4) AS high FROM u JOIN m USING (user_id)")
def agg_lane_band(spark, d):
    """A 95 % band of each day around the lane's rate, by the normal approximation."""
    u = user_days(spark, d)
    rate = u.groupBy("user_id").agg((F.sum("failed") / F.sum("n")).alias("rate"))
    half = 1.96 * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n"))
    return rounded(u.join(rate, "user_id").select("user_id", "day", "n", (F.col("rate") - half).alias("low"), (F.col("rate") + half).alias("high")))


@query(f"WITH {USER_DAYS}, k AS (SELECT user_id, CASE WHEN max(n) > 5 THEN 0 WHEN max(failed) = 1 THEN 1 ELSE 2 END AS kind FROM u GROUP BY 1) SELECT user_id, day, kind, round(least(greatest(total / 100, 0), 3), 4) AS shade FROM u JOIN k USING (user_id)")
def agg_heatmap_order(spark, d):
    """Cells of a heatmap with the order of its lanes; values clipped."""
    u = user_days(spark, d)
    kind = u.groupBy("user_id").agg(F.when(F.max("n") > 5, 0).when(F.max("failed") == 1, 1).otherwise(2).alias("kind"))
    return rounded(u.join(kind, "user_id").select("user_id", "day", "kind", S.clipped(F.col("total") / 100, 0, 3).alias("shade")).orderBy("kind", "user_id", "day"))


@query(f"""
WITH {_FLEET}, l AS (SELECT user_id, day, lead FROM q WHERE policy = 'often' AND lead IS NOT NULL), r AS (SELECT *, row_number() OVER (ORDER BY lead DESC, user_id, day) AS i FROM l)
SELECT u.user_id, u.day, u.n, u.failed, u.day = r.day - CAST(r.lead AS INTEGER) AS first_flag FROM r JOIN u ON u.user_id = r.user_id AND u.day BETWEEN r.day - 56 AND r.day + 5 WHERE i = 2""")
def agg_vehicle_trace(spark, d):
    """The days around the failure with the second-longest lead time."""
    from freightloom.operators.joins import lookback_first

    u = user_days(spark, d)
    met = lookback_first(u.where("failed = 1").select("user_id", "day"), u.where("n > 3").select("user_id", F.col("day").alias("flagged")), ["user_id"], "day", "flagged", 1, 14).where("flagged IS NOT NULL")
    second = met.orderBy(F.desc(F.datediff("day", "flagged")), "user_id", "day").limit(2).orderBy(F.datediff("day", "flagged"), F.desc("user_id"), F.desc("day")).limit(1)
    second = second.select("user_id", F.col("day").alias("failure"), "flagged")
    near = F.col("day").between(F.date_sub("failure", 56), F.date_add("failure", 5))
    return u.join(second, "user_id").where(near).select("user_id", "day", "n", "failed", (F.col("day") == F.col("flagged")).alias("first_flag"))


@query(f"WITH {_TOUR}, v AS (SELECT instance, sum(leg) + arg_max(back, seq) AS tour, 2 * sum(back) AS apart FROM m GROUP BY 1), g AS (SELECT unnest(['apart', 'tour']) AS stage, unnest([round(sum(apart), 2), round(sum(tour), 2)]) AS miles, unnest([1, 2]) AS i FROM v) SELECT stage, miles, round(lag(miles) OVER (ORDER BY i) - miles, 2) AS saved FROM g")
def agg_dispatch_attribution(spark, d):
    """Miles of each stage of dispatch and what it saves on the one before: rounded first, so that they add up."""
    t = _legs(spark, d).groupBy("instance").agg((F.sum("leg") + F.max_by("back", "seq")).alias("tour"), (2 * F.sum("back")).alias("apart"))
    s = t.agg(F.round(F.sum("apart"), 2).alias("apart"), F.round(F.sum("tour"), 2).alias("tour"))
    rows = s.select(F.inline(F.array(*[F.struct(F.lit(k).alias("i"), F.lit(n).alias("stage"), F.col(n).alias("miles")) for k, n in enumerate(("apart", "tour"))])))
    return rows.select("stage", "miles", F.round(F.lag("miles").over(Window.orderBy("i")) - F.col("miles"), 2).alias("saved"))  # of two rows


# --- Cards


@query(f"WITH {SCORED}, {_ACTED} SELECT action, max_by(o_orderkey, (saving, -o_orderkey)) AS example, round(max(saving), 4) AS saving, count(*) AS n FROM b GROUP BY 1")
def card_intervention(spark, d):
    """An example of each decision: the one that saves most."""
    key = F.col("o_orderkey")
    return rounded(acted(spark, d).groupBy("action").agg(F.max_by("o_orderkey", F.struct("saving", -key)).alias("example"), F.max("saving").alias("saving"), F.count("*").alias("n")))


@query(f"WITH {_BOOKED} SELECT lane, concat('lane ', CAST(lane AS VARCHAR), ': book ', CAST(CAST(max(booked) AS BIGINT) AS VARCHAR), ' of ', CAST(CAST(max(demand) AS BIGINT) AS VARCHAR)) AS card FROM c WHERE policy = 'high' GROUP BY 1")
def card_capacity(spark, d):
    text = F.concat(F.lit("lane "), F.col("lane").cast("string"), F.lit(": book "), F.max("booked").cast("long").cast("string"), F.lit(" of "), F.max("demand").cast("long").cast("string"))
    return _booked(spark, d).where("policy = 'high'").groupBy("lane").agg(text.alias("card"))


@query(f"WITH {_PRICES}, b AS (SELECT o_orderkey, arg_max(policy, win * (price - value * 0.9::DOUBLE)) AS policy, max(win * (price - value * 0.9::DOUBLE)) AS margin FROM q GROUP BY 1) SELECT policy, max_by(o_orderkey, (margin, -o_orderkey)) AS example, round(max(margin), 2) AS margin FROM b GROUP BY 1")
def card_pricing(spark, d):
    """For each policy the row where it is best by most."""
    margin = F.col("win") * (F.col("price") - F.col("value") * 0.9)
    b = _priced(spark, d).groupBy("o_orderkey").agg(F.max_by("policy", margin).alias("policy"), F.max(margin).alias("margin"))
    return b.groupBy("policy").agg(F.max_by("o_orderkey", F.struct("margin", -F.col("o_orderkey"))).alias("example"), F.round(F.max("margin"), 2).alias("margin"))


@query(_match_sql("SELECT label, concat('label ', CAST(label AS VARCHAR), CASE WHEN score < 0.5 THEN ': left for review' WHEN hit THEN ': matched' ELSE concat(': matched to ', CAST(point AS VARCHAR)) END) AS card FROM m"))
def card_match(spark, d):
    said = F.when(F.col("score") < 0.5, ": left for review").when(F.col("hit"), ": matched").otherwise(F.concat(F.lit(": matched to "), F.col("point").cast("string")))
    return _matches(spark, d).select("label", F.concat(F.lit("label "), F.col("label").cast("string"), said).alias("card"))


@query(f"WITH {USER_DAYS}, a AS (SELECT user_id, day, n, count(*) FILTER (WHERE n <= 3) OVER (PARTITION BY user_id ORDER BY day) AS run FROM u), r AS (SELECT user_id, run, min(day) AS first, max(day) AS last, count(*) AS days, sum(n - 3) AS excess FROM a WHERE n > 3 GROUP BY 1, 2) SELECT user_id, first, last, days, CAST(excess AS BIGINT) AS excess, round(excess * 7.0::DOUBLE / (last - first + 1), 4) AS weekly FROM r")
def card_incident(spark, d):
    """Runs of days over the limit: their ends, length and excess a week."""
    by = Window.partitionBy("user_id").orderBy("day")
    a = user_days(spark, d).withColumn("run", F.count_if(F.col("n") <= 3).over(by)).where("n > 3")
    r = a.groupBy("user_id", "run").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days"), F.sum(F.col("n") - 3).alias("excess"))
    return rounded(r.select("user_id", "first", "last", "days", "excess", (F.col("excess") * 7.0 / (F.datediff("last", "first") + 1)).alias("weekly")))


@query(f"WITH {_ROUTED} SELECT predicted, concat('queue ', lower(predicted), ': ', CAST(count(*) AS VARCHAR), ' tickets, ', CAST(count(*) FILTER (WHERE actual = predicted) AS VARCHAR), ' of its own') AS card FROM r GROUP BY 1")
def card_ticket(spark, d):
    own = F.count_if(F.col("actual") == F.col("predicted")).cast("string")
    text = F.concat(F.lit("queue "), F.lower(F.first("predicted")), F.lit(": "), F.count("*").cast("string"), F.lit(" tickets, "), own, F.lit(" of its own"))
    return routed(spark, d).groupBy("predicted").agg(text.alias("card"))


@query(f"WITH {USER_DAYS} SELECT user_id, arg_max(day, (total, day)) AS day, round(max(total), 4) AS risk FROM u GROUP BY 1")
def card_dispatch_fleet(spark, d):
    """Each vehicle's riskiest day."""
    return rounded(summed_days(spark, d).groupBy("user_id").agg(F.max_by("day", F.struct("total", "day")).alias("day"), F.max("total").alias("risk")))
