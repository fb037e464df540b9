"""Near-duplicates by the exact Jaccard similarity of word shingles.

A text is the set of its shingles' hashes. Under any fixed order of values, sets at similarity t share a value among
the first n - ceil(t n) + 1 of each (its prefix), so pairs are found by a join of prefixes and none is missed. Up to
the smaller of the two prefixes' last values both sets are known whole, which bounds what a pair can share before its
sets are fetched.

First come the links of SimHash fingerprints at three bits or fewer (at 0.8, sets of equal size differ in about ten);
then, in a few rounds, sets are compared with one that shares one of their smallest values: first with the most typical
one, then with a member of the largest component. Whole sets are compared. This links most copies with rows in proportion to the sets. What is left to find are links between different components. Values that many sets of
different components share (common passages) then go to the end of the order, so that they leave the prefixes of all
but sets made of them; which values these are changes the work, never the result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightloom.llm import simhash
from freightloom.llm.common import dropped, written
from freightloom.llm.simhash import components, majority, shingle_hashes

#: Allowance for rounding in bounds.
EPSILON = 1e-9
#: Values of a set, the smallest, by which it is first compared with others.
HEADS = 4
#: Rounds of such comparisons, at most; fewer once one finds nothing.
ROUNDS = 2
#: A value is common if so many sets have it in their prefixes; so many of the commonest are put last.
COMMON, MOST_COMMON = 32, 1 << 16


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """The distinct shingle hashes of a text as sorted signed longs; a text without a word has the one value 0."""
    return _distinct(shingle_hashes(text, width))


def _distinct(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes, np.uint64).view(np.int64)) if hashes else np.zeros(1, np.int64)


def _named(values: np.ndarray) -> int:
    """A set's name: the hash of its values."""
    return int(np.uint64(xxhash.xxh64_intdigest(values.tobytes(), 42)).view(np.int64))


def _sketches(source: DataFrame, width: int, similarity: float, common: np.ndarray) -> DataFrame:
    """(key, print, set, n, fp, last, prefix) of rows (key, print, text); `last` is the place of the prefix's last value,
    `common` the sorted values that come last in the order."""
    schema = source.select("key", "print", *[F.lit(0).cast("long").alias(c) for c in ("set", "n", "fp", "last")], F.array().cast("array<long>").alias("prefix")).schema

    def run(batches):
        for batch in batches:
            names, sizes, fps, prefixes, lasts = [], [], [], [], []
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py(), width)
                values = _distinct(hashes)
                fps.append(majority(hashes))
                names.append(_named(values))
                n = len(values)
                sizes.append(n)
                late = np.isin(values, common, assume_unique=True) if len(common) else np.zeros(n, bool)
                prefix = np.concatenate([values[~late], values[late]])[: n - math.ceil(similarity * n - EPSILON) + 1]
                prefixes.append(prefix)
                # Early places are below zero, late ones above: the order of places is that of their halves.
                lasts.append(int(prefix[-1] >> 1) + (1 << 62 if late.sum() and len(prefix) > n - late.sum() else -(1 << 62)))
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            flat = np.concatenate([*prefixes, np.zeros(0, np.int64)])
            columns = [pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(lasts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def _similar(pairs: DataFrame, sets: DataFrame, source: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets reach the similarity; `pairs` is a written table, which goes. Texts are
    moved, which compress, not hashes; pairs come sorted by b, whose set is made once for all its pairs in a row."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    prints = sets.join(ends, "set", "left_semi").select("set", "print")
    texts = written(source.select("print", "text").join(prints, "print").select("set", "text").dropDuplicates(["set"]))
    met = pairs.join(texts.select(F.col("set").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("set").alias("b"), F.col("text").alias("y")).hint("merge"), "b")

    def run(batches):
        at, held = None, np.zeros(0, np.int64)
        for batch in batches:
            kept = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if b != at:
                    at, held = b, shingle_set(y.as_py(), width)
                found = shingle_set(x.as_py(), width)
                both = len(np.intersect1d(found, held, assume_unique=True))
                kept.append(both >= similarity * (len(found) + len(held) - both) - EPSILON)
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    found = written(met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
    dropped(pairs, texts)
    return found


def _typical(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """(set, typical): which share of a set's prefix other sets have in theirs, for sets in a crowd at one of their heads."""
    crowds = written(heads.groupBy("value").count().where(F.col("count") > COMMON).select("value"))
    crowded = heads.join(crowds, "value").select("set").distinct()
    values = written(rows.select("set", "prefix").join(crowded, "set").dropDuplicates(["set"]).select("set", F.explode("prefix").alias("value")))
    times = written(values.groupBy("value").agg(F.count("*").alias("times")).where("times > 1"))
    out = written(values.join(times, "value", "left").groupBy("set").agg(F.avg(F.when(F.col("times") > 1, 1.0).otherwise(0.0)).alias("typical")))
    dropped(crowds, values, times)
    return out


def _sociable(met: DataFrame, sets: DataFrame, source: DataFrame, width: int, similarity: float) -> DataFrame:
    """(set, others) of those sets of `met` that may have a link in it: how many of a set's values any other of them has.

    A linked set shares at least `similarity` of its values with one other, so a set with more values of its own is left
    out, as are edited copies that are far from each other; what only it shared with one more set is own to that one then,
    so this is done in a few rounds. Whole sets are counted, with rows in proportion to them.
    """
    prints = sets.join(met.select("set").distinct(), "set").select("set", "n", "print")
    texts = source.select("print", "text").join(prints, "print").select("set", "n", "text").dropDuplicates(["set"])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                values = shingle_set(batch.column(2)[k].as_py(), width)
                rows = pa.array(np.full(len(values), k))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(values)], names=["set", "n", "value"])

    values = written(texts.mapInArrow(run, "set long, n long, value long"))
    kept, before = None, None
    for _ in range(ROUNDS + 1):
        times = written(values.groupBy("value").agg(F.count("*").alias("times")).where("times > 1").select("value"))
        found = written(values.join(times, "value").groupBy("set", "n").agg(F.count("*").alias("others")).where(F.col("others") >= similarity * F.col("n") - EPSILON))
        dropped(times)
        n = found.count()
        kept = found.select("set", "others")
        if n == before:
            break
        before = n
        old, values = values, written(values.join(kept.select("set"), "set"))
        dropped(old)
    dropped(values)
    return kept


def links(source: DataFrame, rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of set names at the similarity or above: enough of them to keep every component. `rows` are the
    sketches of `source`."""
    sets = written(rows.groupBy("set").agg(F.min("print").alias("print"), F.min("n").alias("n"), F.min("fp").alias("fp")))
    fits = lambda a, b: F.least(a, b) >= similarity * F.greatest(a, b) - EPSILON
    heads = written(rows.select("set", "n", F.explode(F.slice("prefix", 1, HEADS)).alias("value")).distinct())
    # Fingerprints: each set with the first one of its fingerprint, and these with each other.
    first = written(sets.groupBy("fp").agg(F.min(F.struct("set", "n")).alias("c")))
    end = lambda side: first.select(F.col("fp").alias(side), F.col("c").alias(f"{side}_c"))
    near = simhash.links(first.select("fp")).join(end("a"), "a").join(end("b"), "b")
    stars = [sets.join(first, "fp"), near.select("a_c.set", "a_c.n", F.col("b_c").alias("c"))]
    apart = lambda x: x.where((F.col("c.set") != F.col("set")) & fits(F.col("n"), F.col("c.n"))).select(F.col("set").alias("a"), F.col("c.set").alias("b"))
    starred = _similar(written(reduce(DataFrame.unionByName, map(apart, stars)).distinct()), sets, source, width, similarity)
    # Then rounds of stars: sets that share one of their smallest values are compared with one of them, a centre. In the
    # first round that is the one most of whose values others have, too: what many texts were copied from has none of its
    # own, while its copies may all be too far from each other. Later those outside the largest component are compared with
    # one of its members, another one for each value and round.
    weighed = _typical(rows, heads)
    for turn in range(ROUNDS):
        roots = written(components(starred).withColumnRenamed("node", "set"))
        held = written(heads.join(roots, "set", "left").join(weighed, "set", "left").withColumns({"root": F.coalesce("root", "set"), "typical": F.coalesce("typical", F.lit(0.0))}))
        dropped(roots)
        if turn == 0:
            centre = held.groupBy("value").agg(F.max_by(F.struct("set", "n", "root"), F.struct("typical", "set")).alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("value", "c", F.col("c.root").alias("own"))
        else:
            by = held.groupBy("value", "root").agg(F.min(F.struct(F.xxhash64("set", "value", F.lit(turn)), "set", "n")).alias("c"), F.count("*").alias("m"))
            centre = by.groupBy("value").agg(F.max_by(F.struct("root", "c"), F.struct("m", F.xxhash64("root", "value"))).alias("major"), F.count("*").alias("k")).where("k > 1").select("value", "major.c", F.col("major.root").alias("own"))
        stars = held.join(centre, "value").where(F.col("root") != F.col("own")).select("set", "n", "c")
        found = _similar(written(apart(stars).distinct()), sets, source, width, similarity)
        dropped(held)
        if turn and found.isEmpty():
            break
        old, starred = starred, written(starred.unionByName(found))
        dropped(old, found)
    dropped(first, heads, weighed)
    roots = written(components(starred).withColumnRenamed("node", "set"))

    def shared(some: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The sets' prefixes with their roots, and the values that sets of different components share."""
        rooted = some.dropDuplicates(["set"]).join(roots, "set", "left").select("set", F.coalesce("root", "set").alias("root"), "n", "last", "prefix")
        rooted = written(rooted)
        by = rooted.select("root", F.explode("prefix").alias("value")).groupBy("value")
        by = by.agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m"))
        return rooted, written(by.where("low <> high").select("value", "m"))

    rooted, values = shared(rows)
    # A bounded number of values is collected, as one Arrow column: picked by tasks, not from all that they send to the
    # driver. They only change the order.
    common = np.sort(values.where(F.col("m") > COMMON).orderBy(F.desc("m"), "value").limit(MOST_COMMON).select("value").toArrow()["value"].to_numpy())
    if len(common):
        dropped(rooted, values)
        late = written(_sketches(source, width, similarity, common))
        rooted, values = shared(late)
        dropped(late)
    met = written(rooted.select("set", "root", "n", F.posexplode("prefix").alias("at", "value")).join(values, "value"))
    # Where a value still has a crowd, only those of it that may have a link in the crowds take part.
    crowd = met.where(F.col("m") > COMMON)
    met = written(met.where(F.col("m") <= COMMON).withColumn("others", F.col("n")).unionByName(crowd.join(_sociable(crowd, sets, source, width, similarity), "set")).drop("m"))
    major = met.groupBy("value", "root").agg(F.count("*").alias("m")).groupBy("value").agg(F.max_by("root", F.struct("m", "root")).alias("major"))
    old, met = met, written(met.join(major, "value").withColumn("minor", F.col("root") != F.col("major")).drop("major"))
    dropped(old)
    left = met.where("minor").select("value", F.col("set").alias("a"), F.col("root").alias("a_root"), F.col("n").alias("a_n"), F.col("at").alias("a_at"), F.col("others").alias("a_others"))
    right = met.select("value", F.col("set").alias("b"), F.col("root").alias("b_root"), F.col("n").alias("b_n"), F.col("at").alias("b_at"), F.col("others").alias("b_others"), "minor")
    least = similarity / (1 + similarity)
    # At the first value that a pair shares, no more can be shared than either set has from there on. So sets made of a
    # common text and something of their own, which come first in the order, meet nobody here.
    # Nor can it share a value that only one of them has.
    can = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"), "a_others", "b_others") >= least * (F.col("a_n") + F.col("b_n")) - EPSILON
    pairs = left.join(right, "value").where((F.col("a_root") != F.col("b_root")) & (~F.col("minor") | (F.col("a") < F.col("b"))) & can)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda s: rooted.select(F.col("set").alias(s), F.col("n").alias(f"{s}_n"), F.col("last").alias(f"{s}_last"), (F.col("n") - F.size("prefix")).alias(f"{s}_rest"), F.col("prefix").alias(f"{s}_prefix"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("a_prefix", "b_prefix")))
    most = F.col("common") + F.when(F.col("a_last") <= F.col("b_last"), F.col("a_rest")).otherwise(F.col("b_rest"))
    # Halved places may tie: then either rest may bound.
    most = F.when(F.col("a_last") == F.col("b_last"), F.col("common") + F.greatest("a_rest", "b_rest")).otherwise(most)
    pairs = written(pairs.where(most >= least * (F.col("a_n") + F.col("b_n")) - EPSILON).select("a", "b"))
    dropped(roots, rooted, values, met)
    return starred.unionByName(_similar(pairs, sets, source, width, similarity))


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Columns (key, print, group) of every row: rows of one group can be reached from each other by links of texts
    whose shingle sets have the Jaccard similarity or more. print is the text's hash. Words are as in SimHash; a text
    with fewer than `width` words is one shingle, texts without a word are alike, texts are taken whole. Rows with a
    null key take part, repeated rows come out as often as they went in, an empty table gives no rows, other columns
    don't matter.
    """
    source = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("print"), F.col(text).cast("binary").alias("text"))
    rows = written(_sketches(source, width, similarity, np.zeros(0, np.int64)))
    found = components(links(source, rows, width, similarity))
    # Written, so that the join shuffles both sides by itself and Spark can split a set that many rows share.
    out = rows.select("key", "print", "set").join(written(found.withColumnRenamed("node", "set")), "set", "left")
    return out.select(F.col("key").alias(key), "print", F.coalesce("root", "set").alias("group"))
