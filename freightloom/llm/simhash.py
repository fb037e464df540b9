"""SimHash near-duplicates by multi-index hashing.

Fingerprints are made in one pass over the texts. Distinct fingerprints are cut into two 32-bit segments. Two
fingerprints that differ in three bits at most differ in one bit at most within one of the segments; so each
segment's Hamming ball of radius one is enumerated, table matches are fetched by a join, and whole distances are
verified. Links are resolved to components by alternating large-star and small-star steps.

Rows of a segment value that more than `crowd` fingerprints share (hot rows) are kept apart before that join: cold
rows probe for all rows, hot rows for cold ones only. Hot rows are linked to each other by the balls of the other
segment, where each ball centre links its members to one of them: the same components, with rows in proportion to
the members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightloom.llm.common import dropped, fresh, written

MASK = 0xFFFFFFFF


def shingle_hashes(text: bytes | None, shingle: int) -> list[int]:
    """XXH64 (seed 42) of each word shingle of a UTF-8 text in order, A-Z lower-cased, words joined by one space.
    Fewer words than a shingle: the whole sequence is one. No word, or null: none."""
    words = text.lower().split() if text else []  # of bytes: ASCII letters and white space only
    if not words:
        return []
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return [xxhash.xxh64_intdigest(line, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text: A-Z lower-cased, word shingles hashed by XXH64 with seed 42,
    repeats included. A bit is set if more than half of the hashes set it. Fewer words than a shingle: the whole
    sequence is one. No word, or null: 0."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: list[int]) -> int:
    """The 64 bits that more than half of the hashes set; 0 for none."""
    if not hashes:
        return 0
    n = len(hashes)
    array = np.array(hashes, dtype=">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        ones += np.unpackbits(array[k : k + 65536].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", carry: list[str] | None = None, shingle: int = 3) -> DataFrame:
    """The columns in `carry` (default: all) of every row and a column `fp`: the fingerprint as a signed long.
    An input column `fp` is replaced."""
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() != "fp"]
    t = fresh(docs.select(*carry), "_text")
    source = docs.select(*carry, F.col(text).cast("binary").alias(t))
    schema = source.select(*carry, F.lit(0).cast("long").alias("fp")).schema

    def run(batches):
        for batch in batches:
            found = [fingerprint(x, shingle) for x in batch.column(batch.num_columns - 1).to_pylist()]
            fps = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fps], names=[*carry, "fp"])

    return source.mapInArrow(run, schema)


def _ball(radius: int) -> list[tuple[int, int]]:
    """(mask, bits) of every 32-bit mask with `radius` bits at most."""
    one = [1 << i for i in range(32)]
    out = [(0, 0)] + [(m, 1) for m in one]
    if radius > 1:
        out += [(one[i] | one[j], 2) for i in range(32) for j in range(i)]
    return out


def _masks(radius: int) -> Column:
    return F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(d).alias("d")) for m, d in _ball(radius)])


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _cut(fps: DataFrame) -> DataFrame:
    """Rows (s, key, rest, fp) for both segments of each fingerprint."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(MASK))
    parts = [F.struct(F.lit(s).alias("s"), a.alias("key"), b.alias("rest")) for s, a, b in ((0, high, low), (1, low, high))]
    return fps.select("fp", F.inline(F.array(*parts)))


def links(fps: DataFrame, crowd: int = 512) -> DataFrame:
    """Pairs (a, b) of distinct longs in column `fp` at three or fewer differing bits: all such pairs, but among hot
    rows enough of them to keep every component.
    """
    table = written(_cut(fps))
    crowds = table.groupBy("s", "key").count().where(F.col("count") > crowd).select("s", "key", F.lit(True).alias("hot"))
    table = written(table.join(crowds, ["s", "key"], "left").withColumn("hot", F.coalesce("hot", F.lit(False))))
    # Hot rows are a table of their own, most often empty or small, which Spark then joins as such.
    cold, hot = table.where(~F.col("hot")), written(table.where("hot"))

    def met(probing: DataFrame, probed: DataFrame, flips: Column, both: bool) -> DataFrame:
        probes = probing.select("s", F.col("fp").alias("a"), "key", F.explode(flips).alias("flip"))
        probes = probes.select("s", "a", "flip", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
        found = probes.join(probed.select("s", "key", F.col("fp").alias("b")), ["s", "key"]).where(_distance("a", "b") <= 3)
        return found.where((F.col("flip") != 0) | (F.col("a") < F.col("b"))) if both else found

    # Of two cold keys that differ in a bit, the one that has the bit probes for the other; a hot one is probed by
    # all its neighbours, in place of probing for them.
    bits = F.lit(_one_bits())
    own = F.concat(F.array(F.lit(0).cast("long")), F.filter(bits, lambda m: F.col("key").bitwiseAND(m) != 0))
    pairs = met(cold, cold, own, True).select("s", "a", "b").unionByName(met(cold, hot, bits, False).select("s", "a", "b"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.unionByName(_within(hot)).unionByName(_across(hot)).distinct()


def _one_bits() -> list[int]:
    return [m for m, d in _ball(1) if d]


def _within(hot: DataFrame) -> DataFrame:
    """Links between members of one crowded key, whose other segments differ in three bits at most: any two of
    them meet at a point within one bit of the first and two bits of the second."""
    at = hot.select("s", "key", "fp", "rest", F.explode(_masks(2)).alias("m")).select("s", "key", "fp", F.col("rest").bitwiseXOR(F.col("m.mask")).alias("point"), F.col("m.d").alias("d"))
    centre = at.where("d <= 1").groupBy("s", "key", "point").agg(F.min("fp").alias("a"))
    met = at.join(centre, ["s", "key", "point"]).where((F.col("a") != F.col("fp")) & (_distance("a", "fp") <= 3))
    return met.select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")).distinct()


def _across(hot: DataFrame) -> DataFrame:
    """Links between two crowded keys that differ in one bit; the other segments differ in two bits at most, so any
    two such members meet at a point within one bit of both."""
    keys = hot.select("s", "key").distinct()
    pairs = keys.select("s", "key", F.explode(F.lit(_one_bits())).alias("bit"))
    pairs = pairs.join(keys.select("s", F.col("key").alias("other")), (F.col("other") == F.col("key").bitwiseXOR(F.col("bit"))) & (pairs["s"] == keys["s"])).select(pairs["s"], "key", "bit")
    at = hot.join(pairs, ["s", "key"]).select("s", "fp", F.col("key").bitwiseAND(F.bitwise_not("bit")).alias("low"), "bit", (F.col("key").bitwiseAND(F.col("bit")) != 0).alias("side"), F.col("rest"), F.explode(_masks(1)).alias("m"))
    at = at.select("s", "low", "bit", "side", "fp", F.col("rest").bitwiseXOR(F.col("m.mask")).alias("point"))
    centre = at.groupBy("s", "low", "bit", "point", (~F.col("side")).alias("side")).agg(F.min("fp").alias("a"))
    met = at.join(centre, ["s", "low", "bit", "point", "side"]).where(_distance("a", "fp") <= 3)
    return met.select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the pairs (a, b): root is the smallest node that can be reached.

    Alternates large-star and small-star steps until a round changes nothing; each round's edges are written to the
    shared folder in place of the last one's. A null end is dropped.
    """
    edges = pairs.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        old, edges = edges, written(small.where(F.col("u") != F.col("v")).distinct())
        dropped(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, crowd: int = 512) -> DataFrame:
    """Columns (key, print, fp, group, component) of every row: component is the smallest key among all rows that can
    be reached by links of three differing bits or fewer, itself included; group, a fingerprint, names the same
    component; print is the text's hash, which with the key tells rows apart.

    Texts without a word have fingerprint 0 and link like any other. Rows with a null key take part; a component
    with null keys alone has a null component. Repeated rows come out as often as they went in. An empty table
    gives an empty result. Other columns don't matter.
    """
    source = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    rows = written(fingerprints(source, "text", ["key", "print"], shingle))
    reps = written(rows.groupBy("fp").agg(F.min("key").alias("rep")))
    found = components(links(reps.select("fp"), crowd))
    # Fingerprints in links, with their component's root; every other fingerprint stands alone.
    grouped = reps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("group"))
    grouped = written(grouped)
    # Only groups of two fingerprints or more need a smallest key; summed up before the shuffle, joined by itself, so
    # that Spark can split a large group.
    shared = written(grouped.groupBy("group").agg(F.min("rep").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n"))
    labels = grouped.join(shared, "group", "left").select("fp", "group", F.coalesce("low", "rep").alias("component"))
    # Written, so that the join shuffles both sides by itself and Spark can split a fingerprint that many rows share.
    return rows.join(written(labels), "fp").select(F.col("key").alias(key), "print", "fp", "group", "component")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, by `grouped`: null and empty texts have the fingerprint zero and are
    linked like any other, whole texts are read however long, repeated rows get equal results, an empty table gives no
    rows; other columns don't matter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
