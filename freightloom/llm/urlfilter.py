"""URL filters by a cascade of Bloom filters.

The universe is every key that the corpus has; some of its keys are listed. The first filter holds the listed keys.
The second holds the other keys of the universe that the first wrongly accepts, the third the listed keys that the
second accepts, and so on until a level accepts nothing wrongly. A key of the universe is listed exactly if the first
level that refuses it has an odd number (counted from 0: it passed an odd number of levels), or if it passes them all
and their number is odd. Rows need no join with the list.

A filter is cut into shards of bounded size by a hash of the key. Rows are dealt by shard; a task reads a shard's
bitmaps ahead of its rows, from the same stream. So no filter is gathered anywhere, however long the list. A shard
with many rows (a host with a third of all pages) is cut further by salts, each with a copy of the bitmaps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightloom.llm.common import fresh, written

#: Bits of a level for each key in it, and probes: about 1 % false positives.
BITS, PROBES = 10, 7


#: Keys of a level in one shard, about: bitmaps of about 160 kB.
SHARD_KEYS = 1 << 17


def _hashes(key: Column, level: int) -> tuple[Column, Column]:
    """Two hashes of a key, the second odd, both non-negative and under 2 ** 31."""
    h = F.xxhash64(key, F.lit(level))
    return F.shiftrightunsigned(h, 33), F.shiftrightunsigned(F.shiftleft(h, 31), 33).bitwiseOR(F.lit(1).cast("long"))


def _places(key: Column, level: int, n_bits: int) -> Column:
    a, b = _hashes(key, level)
    return F.array(*[F.pmod(a + b * k, F.lit(n_bits).cast("long")) for k in range(PROBES)])


def _shard(key: Column, n_shards: int) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(n_shards)), F.lit(0)).cast("int")


@dataclass
class Cascade:
    """Bitmaps (shard int, level int, bitmap binary) of all levels, and the number of bits in a shard of each level."""

    bitmaps: DataFrame
    n_bits: list[int]
    n_shards: int


def _level(keys: DataFrame, n_bits: int, level: int) -> DataFrame:
    """The bitmaps of a level from rows (shard, key): words of 32 bits are made by an aggregate, a shard's then joined."""
    place = F.col("p")
    bits = keys.select("shard", F.explode(_places(F.col("key"), level, n_bits)).alias("p")).groupBy("shard", F.floor(place / 32).alias("at"))
    words = bits.agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (place % 32).cast("int"))).alias("bits"))

    def run(table: pa.Table) -> pa.Table:
        bitmap = np.zeros(-(-n_bits // 32), "<i4")
        bitmap[table.column("at").to_numpy()] = table.column("bits").to_numpy()
        return pa.table({"shard": table.column("shard")[:1].cast(pa.int32()), "level": pa.array([level], pa.int32()), "bitmap": pa.array([bitmap.tobytes()], pa.binary())})

    return words.groupBy("shard").applyInArrow(run, "shard int, level int, bitmap binary")


def cascade(universe: DataFrame, listed: DataFrame, shard_keys: int = SHARD_KEYS) -> Cascade:
    """The cascade for the keys in column `key`; `listed` keys outside the universe are left out, null keys too, and
    repeated ones count once. No listed key: no level."""
    here = universe.where(F.col("key").isNotNull()).select("key").distinct()
    marks = listed.where(F.col("key").isNotNull()).select("key").distinct().withColumn("on", F.lit(True))
    rows = written(here.join(marks, "key", "left").select("key", F.coalesce("on", F.lit(False)).alias("on")))
    n_on, n_all = rows.agg(F.count_if("on"), F.count("*")).first()
    n_shards = max(1, -(-n_on // shard_keys), -(-(n_all - n_on) // (50 * shard_keys)))
    rows = rows.withColumn("shard", _shard(F.col("key"), n_shards))
    found = Cascade(rows.sparkSession.createDataFrame([], "shard int, level int, bitmap binary"), [], n_shards)
    members, others = rows.where("on").drop("on"), rows.where(~F.col("on")).drop("on")
    while most := members.groupBy("shard").count().agg(F.max("count")).first()[0]:
        level = len(found.n_bits)
        n_bits = max(64, 32 * math.ceil(most * BITS / 32))
        bitmaps = written(_level(members, n_bits, level))
        # What the new level wrongly accepts of the other side is what the next one holds.
        wrong = depths(others, "key", Cascade(bitmaps, [*found.n_bits, n_bits], n_shards), "_n", level).where(F.col("_n") > 0).drop("_n")
        found = Cascade(found.bitmaps.unionByName(bitmaps), [*found.n_bits, n_bits], n_shards)
        members, others = written(wrong), members
    return found


def _tested(bitmaps: dict[int, np.ndarray], n_bits: list[int], first: int, hashes: np.ndarray) -> np.ndarray:
    """The number of levels from `first` on that each key passes before one refuses it; a missing bitmap is empty."""
    out, still = np.zeros(len(hashes), np.int64), np.ones(len(hashes), bool)
    for level in range(first, len(n_bits)):
        bitmap = bitmaps.get(level)
        if bitmap is None:
            break
        a, b = hashes[:, 2 * (level - first)], hashes[:, 2 * (level - first) + 1]
        for k in range(PROBES):
            p = (a + b * k) % n_bits[level]
            still &= (bitmap[p >> 3] >> (p & 7) & 1).astype(bool)
        out += still
    return out


def depths(rows: DataFrame, key: str, levels: Cascade, out: str, first: int = 0, rows_each: int = 1 << 20) -> DataFrame:
    """All rows with a long column `out`: how many levels from `first` on accept the key in turn (0 for null).

    A shard with more than `rows_each` rows is cut by salts. A column `out` is replaced.
    """
    carry = [c for c in rows.columns if c.lower() != out.lower()]
    rows = rows.select(*carry)
    if len(levels.n_bits) <= first:
        return rows.withColumn(out, F.lit(0).cast("long"))
    shard, salt, level, bitmap, hashed = (fresh(rows, f"_{c}") for c in ("shard", "salt", "level", "bitmap", "hashes"))
    dealt = rows.withColumn(shard, _shard(F.col(key), levels.n_shards))
    most = dealt.groupBy(shard).count().agg(F.max("count")).first()[0] or 0
    salts = -(-most // rows_each) or 1
    # Parts of the input are salts: equal rows spread, and a task that runs again deals as before.
    dealt = dealt.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(salts)))
    used = range(first, len(levels.n_bits))
    dealt = dealt.withColumn(hashed, F.when(F.col(key).isNotNull(), F.array(*[h for k in used for h in _hashes(F.col(key), k)])))
    maps = levels.bitmaps.where(F.col("level") >= first).select(F.col("shard").alias(shard), F.col("level").alias(level), F.col("bitmap").alias(bitmap), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(salt))
    both = dealt.unionByName(maps, allowMissingColumns=True).repartition(shard, salt).sortWithinPartitions(shard, salt, F.col(level).asc_nulls_last())
    both = both.select(*carry, shard, salt, level, bitmap, hashed)
    schema = rows.withColumn(out, F.lit(0).cast("long")).schema
    n_bits, wide = levels.n_bits, len(carry)

    def run(batches):
        held: dict[int, np.ndarray] = {}
        at = None
        for batch in batches:
            shards, salted = np.asarray(batch.column(wide)), np.asarray(batch.column(wide + 1))
            starts = np.flatnonzero(np.concatenate(([True], (shards[1:] != shards[:-1]) | (salted[1:] != salted[:-1]))))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                part = batch.slice(a, b - a)
                if at != (at := (int(shards[a]), int(salted[a]))):
                    held = {}
                n = len(part) - part.column(wide + 2).null_count
                for k in range(n):  # bitmaps come first
                    held[part.column(wide + 2)[k].as_py()] = np.frombuffer(part.column(wide + 3)[k].as_py(), np.uint8)
                part = part.slice(n)
                if not len(part):
                    continue
                hashes = part.column(wide + 4)
                known = np.asarray(pc.is_valid(hashes))
                found = np.zeros(len(part), np.int64)
                flat = np.asarray(hashes.filter(pa.array(known)).flatten()).reshape(-1, 2 * len(used))
                found[known] = _tested(held, n_bits, first, flat)
                yield pa.RecordBatch.from_arrays([*part.columns[:wide], pa.array(found)], names=[*carry, out])

    return both.mapInArrow(run, schema)


def flagged(rows: DataFrame, key: str, levels: Cascade, out: str = "listed") -> DataFrame:
    """All rows and columns, with a boolean `out`: is the key listed? Exact for keys of the cascade's universe; a
    null key is not listed; without levels nothing is. Repeated rows come out as often as they went in, an empty
    table stays empty, an input column `out` is replaced."""
    return depths(rows, key, levels, out).withColumn(out, F.col(out) % 2 == 1)


def listed(rows: DataFrame, key: str, universe: DataFrame, keys: DataFrame, out: str = "listed", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """`flagged` by a cascade built here from `keys` (column `key`) over the complete `universe` (column `key`)."""
    return flagged(rows, key, cascade(universe, keys, shard_keys), out)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits. A rule (verdict, `host/path`) fits its host
    and all subdomains where the path starts with its own."""
    name = verdict = F.lit(None).cast("string")
    for v, rule in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


#: The rules of the query, and labels of hosts that its list blocks.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
BAD_LABELS = ["cheap-pills", "casino-win", "ads-track", "spam-farm", "free-bets", "adult-x"]


def op6_urls(spark, sf_dir: str) -> DataFrame:
    """Hosts are the keys: the list has every host of the pages with a bad label among its names. A null url has an
    empty host and path, and is allowed; long urls are taken whole; repeated rows get equal verdicts; an empty table
    stays empty."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = rows.select(F.col("host").alias("key")).distinct()
    bad = F.arrays_overlap(F.split("key", r"\."), F.lit(BAD_LABELS))
    rule, verdict = ruled(F.col("host"), F.col("path"), RULES)
    rows = listed(rows, "host", hosts, hosts.where(bad))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


OP6_SQL = """
WITH a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a
), c AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM b
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN list_has_any(string_split(host, '.'), ['cheap-pills', 'casino-win', 'ads-track', 'spam-farm', 'free-bets', 'adult-x']) THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""
