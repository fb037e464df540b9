"""Packing by lexical retrieval: windows are filled with documents that resemble their seed.

Documents are tokenized once and laid out by a lexical key (the least hashed ids of a text, so that texts alike lie
together). Ranges of that order go to tasks, and a task cuts its range into shards of bounded size. Each shard has a
BM25 inverted index over its documents; a seed's terms query it, and the unused neighbours that it returns
fill the seed's window, the last one cut at the window's end. The rest of a cut document seeds the next window; where
nothing was cut or found, the next unused document does. What is left at the end of a shard is cut into powers of two,
which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightloom.llm.common import unit_encoder, written

K1, B = 1.2, 0.75


class Index:
    """BM25 over the documents of a shard, given as arrays of ids."""

    def __init__(self, docs: list[np.ndarray]):
        self.n = len(docs)
        found = [np.unique(d, return_counts=True) for d in docs]
        self.doc_terms = [f[0] for f in found]
        sizes = np.array([len(f[0]) for f in found])
        term = np.concatenate(self.doc_terms)
        doc = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        tf = np.concatenate([f[1] for f in found]).astype(np.float32)
        length = np.array([len(d) for d in docs], np.float32)
        df = np.bincount(term)
        self.idf = np.log1p((self.n - df + 0.5) / (df + 0.5)).astype(np.float32)
        norm = K1 * (1 - B + B * length / max(length.mean(), 1))
        weight = tf * (K1 + 1) / (tf + norm[doc]) * self.idf[term]
        order = np.argsort(term, kind="stable")
        # In the types that sums by document take as they are.
        self.posting_docs, self.posting_weights = doc[order].astype(np.intp), weight[order].astype(np.float64)
        self.starts = np.concatenate(([0], np.cumsum(df))).tolist()

    def neighbours(self, doc: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with `doc`, best score first, ties to the earlier one."""
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in self.doc_terms[doc].tolist()]
        if not spans:
            return np.zeros(0, np.int64)
        docs = np.concatenate([self.posting_docs[s] for s in spans])
        scores = np.bincount(docs, np.concatenate([self.posting_weights[s] for s in spans]), minlength=self.n)
        some = np.flatnonzero((scores > 0) & unused)
        return some[np.argsort(-scores[some], kind="stable")]


def filled(docs: list[np.ndarray], size: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length); all have `size` ids but the last ones, which have powers of
    two (if `size` is one). Every id lies in exactly one piece."""
    index = Index(docs)
    unused = np.ones(len(docs), bool)
    lengths = [len(d) for d in docs]
    window: list[tuple[int, int, int]] = []
    room, following = size, 0
    current, at = -1, 0  # the document being laid out, and how far it is

    queue: list[int] = []
    while True:
        if current < 0:
            while queue and not unused[queue[-1]]:
                queue.pop()
            if queue:
                current = queue.pop()
            else:
                while following < len(docs) and not unused[following]:
                    following += 1
                if following == len(docs):
                    break
                current = following
            at, unused[current] = 0, False
            if not window:
                queue = []
        if not window and lengths[current] - at < size:
            # The window's seed: its neighbours are queued, the best last.
            queue = index.neighbours(current, unused)[::-1].tolist()
        take = min(room, lengths[current] - at)
        if take:
            window.append((current, at, take))
        at, room = at + take, room - take
        if at == lengths[current]:
            current = -1
        if not room:
            yield window
            window, room = [], size
    # Leftovers: cut at powers of two.
    rest = size - room
    while rest:
        part = 1 << (rest.bit_length() - 1)
        out, need = [], part
        while need:
            d, a, n = window.pop(0)
            out.append((d, a, min(n, need)))
            if n > need:
                window.insert(0, (d, a + need, n - need))
            need -= min(n, need)
        yield out
        rest -= part


#: Units that a worker remembers; a worker stays when its stage is over, so this is memory that later stages miss.
ROOM = 1 << 19
#: Two odd factors that mix ids, for the lexical key.
MIX = np.array([0x9E3779B1, 0x85EBCA77], np.uint32)


def tokenized(docs: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids, n, near): n ids as little-endian unsigned integers of 16 or 32 bits with `end` behind them, and
    near, the lexical key. A null text is an empty one."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = rows.select("key", F.lit(b"").alias("ids"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("near")).schema

    def run(batches):
        encode = unit_encoder(tokenizer, ROOM)
        close = np.array([end], encode.dtype).tobytes()
        for batch in batches:
            found, near = [], []
            for got in encode.many((t.as_py() for t in batch.column(1)), 2_000_000):
                found.append(got + close)
                ids = np.frombuffer(found[-1], encode.dtype).astype(np.uint32)
                near.append((int((ids * MIX[0]).min()) << 31) + (int((ids * MIX[1]).min()) >> 1))
            n = [len(f) // len(close) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array(n, pa.int64()), pa.array(near, pa.int64())], names=["key", "ids", "n", "near"])

    return rows.mapInArrow(run, schema)


def packed(docs: DataFrame, tokenizer: str, end: int, size: int = 2048, key: str = "doc_id", text: str = "text", shard_ids: int = 1 << 18, part_ids: int = 1 << 22, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows: key, start (ids of its document before it), length, ids_crc32 (of its ids as little-endian
    unsigned 32-bit integers), doc_tokens (of its document, with `end`), sequence_id, offset (in its sequence), and
    on request ids.

    A null text is an empty one: `end` alone. A long text is cut into many pieces. Repeated rows are packed as often as
    they come; rows of one key are told apart by order alone. An empty table gives no pieces; other columns don't
    matter. Sequences have `size` ids, but for the leftovers of a shard, which are powers of two. A shard ends before
    its documents exceed `shard_ids` ids, but has one at least. A task's part has about `part_ids`, or more where that
    would make over 20,000 parts: memory is a shard's, whatever the part.
    """
    spark = docs.sparkSession
    rows = written(tokenized(docs, tokenizer, end, key, text))
    order = ["near", "key", F.xxhash64("ids")]
    total = rows.agg(F.sum("n")).first()[0] or 0
    n = max(1, min(20_000, -(-total // part_ids)), -(-total // (16 * part_ids)))
    laid = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.spark_partition_id().cast("long").alias("part"), "key", "ids", "n")
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = laid.select("key", *[F.lit(0).cast("long").alias(c) for c in names], *[F.array().cast("array<int>").alias("ids")] * with_ids).schema

    def run(batches):
        part = count = held = 0
        keys: list[pa.Scalar] = []
        docs: list[np.ndarray] = []

        def pack() -> Iterator[pa.RecordBatch]:
            nonlocal count, held
            out: list[tuple] = []
            owners: list[int] = []
            pieces: list[np.ndarray] = []
            for sequence in filled(docs, size):
                offset = 0
                for d, start, length in sequence:
                    ids = docs[d][start : start + length]
                    out.append((start, length, zlib.crc32(ids.astype("<u4").tobytes()), len(docs[d]), (part << 36) + count, offset))
                    owners.append(d)
                    if with_ids:
                        pieces.append(ids.astype(np.int32))
                    offset += length
                count += 1
            columns = [pa.array([keys[d] for d in owners], key_type), *[pa.array(c, pa.int64()) for c in zip(*out)]]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(pieces, pa.list_(pa.int32()))] * with_ids, names=["key", *names, *["ids"] * with_ids])
            keys.clear()
            docs.clear()
            held = 0

        for batch in batches:
            key_type = batch.schema.field("key").type
            for p, k, ids, m in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3)):
                part, ids = p.as_py(), ids.as_py()
                new = np.frombuffer(ids, f"<u{len(ids) // m.as_py()}")
                if docs and held + len(new) > shard_ids:
                    yield from pack()
                keys.append(k.as_py())
                docs.append(new)
                held += len(new)
        if docs:
            yield from pack()

    return laid.mapInArrow(run, schema).withColumnRenamed("key", key)


def op8_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents, by `packed`: a null or empty text is its end id alone, long texts are cut into many
    pieces, repeated rows are packed as often as they come, an empty table gives no rows."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end=1)
