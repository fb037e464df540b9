"""Exact top-k by inner product with no-random-access aggregation.

Vectors are dealt into blocks of bounded size. A block keeps one list per dimension, sorted by component. For a
query, the lists are read in step from their favourable ends; every vector met has a lower bound (what was read of
it, and the worst of the rest) and an upper bound (what was read, and the lists' frontiers), in whole numbers. Reading
for all ends once no outsider's upper bound reaches the k-th lower bound; then the lists are read on in order for those
left alone, until their scores are whole. A block gives its k best for every query, and the k best of those are the answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightloom.llm.common import written

#: Shares of the lists that are read before the bounds are compared.
READS = (0.25, 0.4, 0.55, 0.7, 0.85)


class Block:
    """Vectors (rows of whole numbers) with their ids, and their sorted lists."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.order = np.argsort(self.rows, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(self.rows.T, self.order, axis=1)

    def _part(self, largest: bool, at: int, to: int) -> slice:
        """Entries `at` to `to` of a list, counted from its largest or smallest end."""
        n = len(self.ids)
        return slice(n - to, n - at) if largest else slice(at, to)

    def best(self, query: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, without ids equal to `own`; ties to smaller ids."""
        n, dims = self.rows.shape
        skip = np.flatnonzero(self.ids == own) if own is not None else np.zeros(0, int)
        left = np.arange(n)
        use = np.flatnonzero(query)
        read = np.zeros(n, np.int64)  # sums of what was read
        at = 0
        if len(use) and n - len(skip) > k:
            worst = np.array([(self.sorted[d, 0] if query[d] > 0 else self.sorted[d, -1]) * query[d] for d in use])
            rest_low = np.full(n, worst.sum())
            last = np.zeros(len(use), np.int64)  # the lists' frontiers
            # What the frontiers still allow a vector: their sum, without those of lists that it was met in.
            for share in READS:
                if at == n:
                    break
                to = max(at + 1, int(n * share))
                for j, d in enumerate(use):
                    part = self._part(query[d] > 0, at, to)
                    met = self.order[d, part]
                    gained = self.sorted[d, part] * query[d]
                    read[met] += gained
                    rest_low[met] -= worst[j]
                    last[j] = gained[0] if query[d] > 0 else gained[-1]
                at = to
                low, high = read + rest_low, read + last.sum()
                for j, d in enumerate(use):
                    high[self.order[d, self._part(query[d] > 0, 0, at)]] -= last[j]
                low[skip] = high[skip] = np.iinfo(np.int64).min
                bar = np.partition(low, n - k)[n - k]
                left = np.flatnonzero(high >= bar)
                if len(left) <= 4 * k:
                    break
        wanted = np.zeros(n, bool)
        wanted[left] = True
        if at < n:
            for d in use:
                part = self._part(query[d] > 0, at, n)
                hit = np.flatnonzero(wanted[self.order[d, part]])
                read[self.order[d, part][hit]] += self.sorted[d, part][hit] * query[d]
        scores = read[left]
        keep = ~np.isin(left, skip)
        left, scores = left[keep], scores[keep]
        pick = np.lexsort((self.ids[left], -scores))[:k]
        return self.ids[left][pick], scores[pick]


def whole(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, as longs; null where the vector or a component is null or not finite."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(embedding.isNotNull() & F.coalesce(sound, F.lit(False)), F.transform(x, lambda v: F.floor(v * scale)))


def _matrix(batch: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to `dims`."""
    column = batch.column(name)
    out = np.zeros((len(column), dims), np.int64)
    flat, offsets = np.asarray(column.flatten()), np.concatenate(([0], np.cumsum(np.asarray(column.value_lengths()))))
    for k in range(len(column)):
        row = flat[offsets[k] : offsets[k + 1]]
        out[k, : len(row)] = row
    return out


def top(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 8192, query_rows: int = 16384) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k best vectors, or all if fewer, not the one with its own id.

    Both inputs have columns `id` and `v` (an array of longs); rows with a null id or vector take no part, shorter
    vectors count as padded with zeros. Score: inner product. Ties go to smaller ids; repeated rows of `vectors` are
    separate answers, repeated rows of `queries` one query. Queries are cut into groups of about `query_rows`, which
    meet every block once: work is queries times vectors, memory a block and a group, and a vector is copied once for
    each group of queries, a query once for each block. An empty table gives an empty result; other columns don't
    matter. Scores must fit 64 bits.
    """
    sound = written(vectors.where(F.col("id").isNotNull() & F.col("v").isNotNull()).select("id", "v"))
    asked = written(queries.where(F.col("id").isNotNull() & F.col("v").isNotNull()).select("id", "v").dropDuplicates(["id"]))
    n, widest = sound.agg(F.count("*"), F.max(F.size("v"))).first()
    m, wide = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = max(widest or 0, wide or 0, 1)
    n_blocks, n_groups = max(1, -(-n // block_rows)), max(1, -(-m // query_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    group = F.pmod(F.xxhash64("id"), F.lit(n_groups)).cast("int")
    # A pair of a block and a group is one task's work; both sides are dealt to it by its number.
    pairs = lambda rows, own, other, count: rows.select("id", "v", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(other))
    left = pairs(sound, block, "grp", n_groups).select(F.col("own").alias("blk"), "grp", "id", "v", F.lit(False).alias("asks"))
    right = pairs(asked, group, "blk", n_blocks).select("blk", F.col("own").alias("grp"), "id", "v", F.lit(True).alias("asks"))
    both = left.unionByName(right)

    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        asks, ids = np.asarray(batch.column("asks")), np.asarray(batch.column("id"))
        rows = _matrix(batch, "v", dims)
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        if asks.any() and not asks.all():
            held = Block(ids[~asks], rows[~asks])
            for q, v in zip(ids[asks], rows[asks]):
                out.append((q, *held.best(v, k, q)))
        return pa.table(
            {
                "query_id": np.repeat(np.array([o[0] for o in out], np.int64), [len(o[1]) for o in out]),
                "vec_id": np.concatenate([o[1] for o in out]) if out else np.zeros(0, np.int64),
                "score": np.concatenate([o[2] for o in out]) if out else np.zeros(0, np.int64),
            }
        )

    found = both.groupBy("blk", "grp").applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    """The ten best vectors for every hundredth one, by `top`: null vectors and such with null, NaN or infinite components
    take no part, ties go to smaller ids, repeated rows are separate answers, an empty table gives no rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), whole(F.col("embedding")).alias("v"))
    return top(rows, rows.where(F.col("id") % 100 == 0))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
