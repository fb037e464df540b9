"""Sources and sinks: typed CSV, stars of several files, section files of routing instances, JSON, reports."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freightloom.operators.clean import require_columns

BOM = "﻿"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any store that Spark reads has the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def csv_typed(spark: SparkSession, path: str, schema: str | T.StructType, timestamps: str | None = None) -> DataFrame:
    """CSV with a header and declared types: nothing is inferred."""
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    return (reader.option("timestampFormat", timestamps) if timestamps else reader).csv(path)


def csv_renamed(spark: SparkSession, path: str, names: Mapping[str, str], types: Mapping[str, str]) -> DataFrame:
    """CSV whose header may start with a byte-order mark: required columns are checked, renamed, cast; the rest, leaks
    included, stays at the door. `names` maps headers to names, `types` names to types (string by default)."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.removeprefix(BOM).strip() for c in raw.columns])
    require_columns(raw, list(names))
    return raw.select(*[F.expr(f"try_cast(`{old}` as {types.get(new, 'string')})").alias(new) for old, new in names.items()])


def star(spark: SparkSession, folder: str, files: Mapping[str, str], read: Callable[[SparkSession, str], DataFrame]) -> dict[str, DataFrame]:
    """Several files of one source; missing ones are named before anything is read."""
    missing = [f for f in files.values() if not exists(spark, f"{folder}/{f}")]
    if missing:
        raise FileNotFoundError(f"missing in {folder}: {', '.join(sorted(missing))}")
    return {name: read(spark, f"{folder}/{f}") for name, f in files.items()}


#: Sources by name: each takes (spark, **options).
SOURCES: dict[str, Callable[..., DataFrame]] = {}


def source(name: str, **options) -> Callable[[SparkSession], DataFrame]:
    if name not in SOURCES:
        raise KeyError(f"no source {name!r}; there are {sorted(SOURCES)}")
    return lambda spark: SOURCES[name](spark, **options)


def routing_instances(spark: SparkSession, path: str) -> DataFrame:
    """(name, capacity, node, x, y, demand, is_depot) of files in the sectioned text format of routing benchmarks.

    A file is a row of its own; sections are found by pattern, their lines cut into numbers, so that many files are
    read side by side.
    """
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\r", "").alias("t"))
    head = lambda key: F.trim(F.regexp_extract("t", rf"(?m)^{key}[ \t]*:[ \t]*(.*)$", 1))
    lines = lambda key: F.filter(F.split(F.regexp_extract("t", rf"(?s){key}[^\n]*\n(.*?)(?:[A-Z]+_SECTION|EOF|$)", 1), "\n"), lambda x: F.trim(x) != "")
    cells = lambda key: F.transform(lines(key), lambda x: F.split(F.trim(x), r"\s+"))
    demand = F.map_from_entries(F.transform(cells("DEMAND_SECTION"), lambda c: F.struct(c[0].cast("int").alias("k"), c[1].cast("double").alias("v"))))
    depots = F.transform(lines("DEPOT_SECTION"), lambda x: F.trim(x).cast("int"))
    nodes = raw.select(head("NAME").alias("name"), head("CAPACITY").cast("double").alias("capacity"), demand.alias("demands"), depots.alias("depots"), F.explode(cells("NODE_COORD_SECTION")).alias("c"))
    node = F.col("c")[0].cast("int")
    return nodes.select("name", "capacity", node.alias("node"), F.col("c")[1].cast("double").alias("x"), F.col("c")[2].cast("double").alias("y"), F.try_element_at("demands", node).alias("demand"), F.array_contains("depots", node).alias("is_depot"))


def routing_solutions(spark: SparkSession, path: str) -> DataFrame:
    """(file, route, seq, node, cost) from lines `Route #k: a b c` and `Cost n`."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"\r", "").alias("t"))
    raw = raw.withColumn("cost", F.regexp_extract("t", r"(?mi)^cost\s+([\d.]+)", 1).cast("double"))
    routes = raw.select("file", "cost", F.explode(F.filter(F.split("t", "\n"), lambda x: x.rlike(r"(?i)^route\s*#"))).alias("line"))
    route = F.regexp_extract("line", r"#\s*(\d+)", 1).cast("int")
    stops = F.split(F.trim(F.regexp_extract("line", r":(.*)$", 1)), r"\s+")
    return routes.select("file", "cost", route.alias("route"), F.posexplode(stops).alias("seq", "node")).withColumn("node", F.col("node").cast("int"))


def stop_frame(instances: DataFrame) -> DataFrame:
    """Customers as stops: demand in packages, no service time."""
    return instances.where(~F.col("is_depot")).select("name", "node", "x", "y", F.col("demand").alias("packages"), F.lit(0.0).alias("service_min"))


def records(spark: SparkSession, rows: Sequence[Mapping], schema: str, dates: Sequence[str] = ()) -> DataFrame:
    """A request's records; a date that can't be read is null."""
    text = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    wide = ", ".join(f"{f.name} string" if f.name in dates else f"{f.name} {f.dataType.simpleString()}" for f in T._parse_datatype_string(schema))
    out = text.select(F.from_json("value", wide).alias("r")).select("r.*")
    return out.withColumns({c: F.to_date(F.try_to_timestamp(F.col(c))) for c in dates}) if dates else out


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def to_json(metrics: object) -> str:
    """Indented JSON; NaN and infinities are null."""

    def plain(v):
        if isinstance(v, float) and not math.isfinite(v):
            return None
        if isinstance(v, Mapping):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    return json.dumps(plain(metrics), indent=2)


def to_markdown(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A table of a report, its means in a last row. Reports are small: more than `most` rows raise ValueError."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    say = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    body = [[say(r[c]) for c in df.columns] for r in rows]
    if rows and numeric:
        means = [[r[c] for r in rows if r[c] is not None] for c in df.columns]
        body.append([say(float(sum(m) / len(m))) if c in numeric and m else "mean" if k == 0 else "" for k, (c, m) in enumerate(zip(df.columns, means))])
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *body])


def markdown_line(df: DataFrame) -> Column:
    """A row as a line of a Markdown table, for reports of any length."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))


def routes_long(routes: DataFrame, stops: DataFrame) -> DataFrame:
    """(policy, truck, seq, stop) and the stop's columns, from a row for each policy with nested routes."""
    flat = routes.select("policy", F.posexplode("routes").alias("truck", "route")).select("policy", "truck", F.posexplode("route").alias("seq", "stop"))
    return flat.join(stops, "stop")
