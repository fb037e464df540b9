"""Token ids in compressed byte or bit planes.

The format is a table of chunks, written and read by Spark (so that a lost task is written again and half-written
files never show). A chunk holds whole documents. Its ids are cut into blocks of a fixed number; a block is
transposed into byte planes (all low bytes, then the next ones) or bit planes; each plane of all blocks of the chunk
is compressed with zstandard. The chunk's index gives the documents and their lengths, the planes and their sizes.

Columns: part int (ranges of documents in order), chunk int (within its part), n_ids long, doc_ids array<long>,
doc_lengths array<long>, width int (bytes of an id), bits boolean (bit planes), block int (ids of a block),
plane_sizes array<int>, planes binary.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freightloom.llm.common import unit_encoder, written
from freightloom.operators.scratch import new_path

SCHEMA = "part int, chunk int, n_ids long, doc_ids array<long>, doc_lengths array<long>, width int, bits boolean, block int, plane_sizes array<int>, planes binary"
BLOCK = 1 << 14


def to_planes(ids: np.ndarray, bits: bool = False, block: int = BLOCK, level: int = 1) -> tuple[int, list[bytes]]:
    """The width of an id in bytes, and the compressed planes, lowest first."""
    ids = np.asarray(ids, "<u4")
    width = 1 if not len(ids) else max(1, -(-int(ids.max()).bit_length() // 8))
    width = 4 if width == 3 else width
    raw = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    planes: list[list[bytes]] = [[] for _ in range(8 * width if bits else width)]
    for k in range(0, len(raw), block):
        part = raw[k : k + block]
        if bits:
            for j in range(width):
                row = np.packbits(np.unpackbits(part[:, j, None], axis=1, bitorder="little"), axis=0, bitorder="little")
                for i in range(8):
                    planes[8 * j + i].append(row[:, i].tobytes())
        else:
            for j in range(width):
                planes[j].append(part[:, j].tobytes())
    pack = zstandard.ZstdCompressor(level=level).compress
    return width, [pack(b"".join(p)) for p in planes]


def from_planes(planes: list[bytes], n: int, width: int, bits: bool, block: int) -> np.ndarray:
    """The ids that `to_planes` was given."""
    unpack = zstandard.ZstdDecompressor().decompress
    plain = [np.frombuffer(unpack(p, max_output_size=max(1, n)) if n else b"", np.uint8) for p in planes]
    out = np.zeros((n, width), np.uint8)
    if not bits:
        for j, p in enumerate(plain):
            out[:, j] = p
    else:
        at = 0
        for k in range(0, n, block):
            m = min(block, n - k)
            rows = -(-m // 8)
            for j in range(width):
                stacked = np.stack([plain[8 * j + i][at : at + rows] for i in range(8)], axis=1)
                some = np.unpackbits(stacked, axis=0, count=m, bitorder="little")
                out[k : k + m, j] = np.packbits(some, axis=1, bitorder="little")[:, 0]
            at += rows
    return out.view(f"<u{width}")[:, 0].astype(np.uint32) if n else np.zeros(0, np.uint32)


def encoded(docs: DataFrame, tokenizer: str, end: int | None, key: str = "doc_id", text: str = "text", parts: int | None = None, chunk_ids: int = 1 << 18, bits: bool = False, part_chars: int = 1 << 24) -> DataFrame:
    """Chunks of all rows in ascending order of key (null first; rows with one key in order of their texts' hashes).

    A null text is encoded as an empty one; `end`, if given, follows every text. Long texts are taken whole, repeated
    rows come as often as they are there, an empty table gives no chunk, other columns don't matter. `parts` ranges
    of keys are encoded side by side (default: as many as hold about `part_chars` bytes each, or more bytes where that
    would make over 20,000: memory is a chunk's, whatever the part).
    """
    spark = docs.sparkSession
    order = [F.col("key"), F.xxhash64("text")]
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if not parts:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(1, min(20_000, -(-total // part_chars)), -(-total // (16 * part_chars)))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = unit_encoder(tokenizer)
        wide = np.dtype(encode.dtype).itemsize
        close = b"" if end is None else np.array([end], encode.dtype).tobytes()
        held: list[bytes] = []
        keys: list[int | None] = []
        part = chunk = size = 0

        def out() -> pa.RecordBatch:
            nonlocal chunk, size
            ids = np.frombuffer(b"".join(held), encode.dtype)
            width, planes = to_planes(ids, bits)
            row = [part, chunk, len(ids), list(keys), [len(h) // wide for h in held], width, bits, BLOCK, [len(p) for p in planes], b"".join(planes)]
            chunk, size = chunk + 1, 0
            held.clear()
            keys.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.int32()), pa.binary()))], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            found = encode.many(t.as_py() for t in batch.column(2))
            for p, k, ids in zip(batch.column(0), batch.column(1), found):
                part = p.as_py()
                ids += close
                if held and size + len(ids) // wide > chunk_ids:
                    yield out()
                held.append(ids)
                keys.append(k.as_py())
                size += len(ids) // wide
        if held:
            yield out()

    return rows.mapInArrow(run, SCHEMA)


def write(chunks: DataFrame, path: str) -> None:
    """The planes are compressed already."""
    chunks.write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_documents(chunks: DataFrame, with_ids: bool = False) -> DataFrame:
    """Rows (key, start, n_tokens, ids_crc32) and, on request, ids: each document of the chunks in their order.

    start: ids of all documents before. ids_crc32: of the ids as little-endian unsigned 32-bit integers. The index
    columns alone give the chunks' starts: a sum over the parts' totals, then one within each part.
    """
    index = chunks.groupBy("part", "chunk").agg(F.sum("n_ids").alias("n"))
    index = written(index)
    totals = index.groupBy("part").agg(F.sum("n").alias("n"))
    bases = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    ahead = F.sum("n").over(Window.partitionBy("part").orderBy("chunk")) - F.col("n")
    starts = index.withColumn("ahead", ahead).join(bases, "part").select("part", "chunk", (F.col("base") + F.col("ahead")).alias("chunk_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                cuts = np.cumsum([0, *r["plane_sizes"]])
                ids = from_planes([r["planes"][a:b] for a, b in zip(cuts, cuts[1:])], r["n_ids"], r["width"], r["bits"], r["block"])
                ends = np.cumsum([0, *r["doc_lengths"]])
                docs = [ids[a:b] for a, b in zip(ends, ends[1:])]
                columns = {
                    "part": pa.array([r["part"]] * len(docs), pa.int32()),
                    "chunk": pa.array([r["chunk"]] * len(docs), pa.int32()),
                    "key": pa.array(r["doc_ids"], pa.int64()),
                    "local": pa.array(ends[:-1], pa.int64()),
                    "n_tokens": pa.array(r["doc_lengths"], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in docs], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([d.astype(np.int64) for d in docs], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "part int, chunk int, key long, local long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    found = chunks.mapInArrow(run, schema).join(starts, ["part", "chunk"])
    return found.select("key", (F.col("chunk_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op9_tokens(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Every document's place and digest, read back from written files: a null or empty text is its end id alone, long
    texts are taken whole, repeated rows come as often as they are there, an empty table gives no rows."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = new_path(spark)
    write(encoded(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), end=0), path)
    return read_documents(read(spark, path)).withColumnRenamed("key", "doc_id")
