"""Product codes of vectors, by Lloyd's rounds that compare active entries only.

A vector of whole numbers is cut into parts; each part gets the number of the nearest entry of its position's codebook.
A round assigns the parts and moves the entries to their parts' mean, rounded down. The next round knows which entries
moved: a part whose own entry stayed where it was keeps its exact distance and looks at the moved entries alone, for none of
the others has become nearer; a part whose entry moved looks at all. Equal distances go to the lower number.

Vectors, their codes and their distances are a table that each round reads and writes; its tasks also write partial sums
of their parts, which Spark adds up. Only codebooks, whose size is fixed, come to the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freightloom.llm.common import dropped, fresh, written
from freightloom.llm.topk import whole

PARTS, ENTRIES, ROUNDS = 4, 256, 4
_ROWS = 4096


def is_small(most: int, width: int) -> bool:
    """Whether squared distances of rows of components up to `most` are whole in doubles; else Python's integers serve."""
    return 4 * most * most * width < 1 << 52


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows from all entries, exact: rows are doubles of small whole numbers, or Python's integers."""
    b = entries.astype(rows.dtype)
    return (rows * rows).sum(1)[:, None] - 2 * (rows @ b.T) + (b * b).sum(1)[None, :]


def _nearest(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first smallest column of each row, and its value."""
    best = d.argmin(1)
    return best, d[np.arange(len(d)), best]


def assigned(rows: np.ndarray, entries: np.ndarray, code: np.ndarray | None = None, dist: np.ndarray | None = None, moved: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entries of the rows, exact squared distances, and how many pairs were compared.

    With the codes and distances of the round before and a flag for each entry that has moved since, only what can have
    changed is compared; the result is that of a whole scan.
    """
    if code is None:
        return *_nearest(distances(rows, entries)), rows.shape[0] * len(entries)
    code, dist = code.copy(), dist.copy()
    lost, active = np.flatnonzero(moved[code]), np.flatnonzero(moved)
    stay = np.flatnonzero(~moved[code])
    if len(lost):
        code[lost], dist[lost] = _nearest(distances(rows[lost], entries))
    if len(stay) and len(active):
        best, least = _nearest(distances(rows[stay], entries[active]))
        best = active[best]
        nearer = (least < dist[stay]) | ((least == dist[stay]) & (best < code[stay]))
        code[stay[nearer]], dist[stay[nearer]] = best[nearer], least[nearer]
    return code, dist, len(lost) * len(entries) + len(stay) * len(active)


@dataclass
class Codebooks:
    """For each part position its entries, as rows of Python's or numpy's integers."""

    entries: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all entries' decimal components in order of part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for book in self.entries for row in book for x in row).encode()).hexdigest()

    @property
    def width(self) -> int:
        return self.entries[0].shape[1]


@dataclass
class Fitted:
    """Codebooks, and a written table of what was coded: the carried columns, `code` (binary, a byte for each part)
    and `error`. `compared` is how many pairs each assignment compared."""

    books: Codebooks
    rows: DataFrame
    compared: list[int]


def _cut(raw: pa.Array, n: int, dims: int) -> np.ndarray:
    """Rows of little-endian 64-bit numbers, padded with zeros."""
    out = np.zeros((n, dims), np.int64)
    for k, x in enumerate(raw):
        row = np.frombuffer(x.as_py(), "<i8")
        out[k, : len(row)] = row
    return out


def _packed(dists: np.ndarray) -> list[bytes]:
    """The distances of each row: 64-bit numbers, or decimal ones where they may be larger."""
    if dists.dtype == object:
        return [",".join(str(int(x)) for x in r).encode() for r in dists]
    return [r.tobytes() for r in dists.astype("<i8")]


def _unpacked(raw: list[bytes], dtype: type) -> np.ndarray:
    if dtype == object:
        return np.array([[int(x) for x in r.split(b",")] for r in raw], object)
    return np.frombuffer(b"".join(raw), "<i8").reshape(len(raw), -1).astype(dtype)


def fitted(vectors: DataFrame, key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Fitted:
    """Codes of all rows whose column `v` (array of longs) isn't null, with all their other columns.

    Codebooks start as the parts of the `entries` (at most 256) rows that are first by key (nulls last), then by vector;
    fewer rows give fewer entries. Each of `rounds` rounds assigns, then moves each used entry to its parts' mean, rounded
    down; a last assignment follows. Vectors are padded with zeros to the longest, that to a multiple of `parts`. Repeated
    rows count and are coded each; an empty table gives none. Distances are whole at any size of components, errors
    beyond 64 bits are given as the largest long.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    sound = vectors.where(F.col("v").isNotNull())
    carry = [c for c in sound.columns if c != "v"]
    body, code, dist, error, slot, total, pairs = (fresh(sound, c) for c in ("_body", "_code", "_dist", "_error", "_slot", "_total", "_pairs"))
    ends = [F.array_max("v"), F.array_min("v")]
    widest, high, low = sound.agg(F.max(F.size("v")), F.max(ends[0]), F.min(ends[1])).first()
    widest = widest or 0
    width = max(1, -(-widest // parts))
    dims = width * parts
    first = sound.orderBy(F.col(key).asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.zeros((len(first), dims), np.int64)
    for k, r in enumerate(first):
        start[k, : len(r["v"])] = r["v"]
    books = Codebooks([start[:, p * width : (p + 1) * width].copy() for p in range(parts)])
    many = len(first)
    dtype = np.float64 if is_small(max(high or 0, -(low or 0)), width) else object

    def laid(batches):
        for batch in batches:
            v = batch.column(len(carry))
            packed = pa.array([np.asarray(x.values, dtype="<i8").tobytes() for x in v], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=[*carry, body])

    plain = T.StructType([T.StructField(f.name, f.dataType) for f in sound.select(*carry).schema])
    state = written(sound.select(*carry, "v").mapInArrow(laid, T.StructType([*plain, T.StructField(body, T.BinaryType())])))
    # Rows of vectors have a body, rows of sums a slot: (part * entries + entry) * (width + 1) + place, the last place counts.
    schema = T.StructType([*plain, *[T.StructField(c, t) for c, t in ((body, T.BinaryType()), (code, T.BinaryType()), (dist, T.BinaryType()), (error, T.LongType()), (slot, T.LongType()), (total, T.DecimalType(38, 0)), (pairs, T.LongType()))]])
    compared: list[int] = []
    moved: list[np.ndarray] | None = None
    for turn in range(rounds + 1):

        def run(batches, books=books, moved=moved):
            sums = np.zeros((parts, many, width + 1), np.int64 if dtype != object else object)
            names, types, n_pairs = [], [], 0
            for batch in batches:
                names = [*carry, body, code, dist, error, slot, total, pairs]
                types = [*batch.schema.types[: len(carry) + 1], pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.decimal128(38, 0), pa.int64()]
                for at in range(0, batch.num_rows, _ROWS):
                    own = batch.slice(at, _ROWS)
                    n = own.num_rows
                    rows = _cut(own.column(len(carry)), n, dims)
                    codes, dists = np.zeros((n, parts), np.int64), np.zeros((n, parts), dtype)
                    if moved is not None:
                        codes[:] = np.frombuffer(b"".join(own.column(len(carry) + 1).to_pylist()), np.uint8).reshape(n, parts)
                        dists[:] = _unpacked(own.column(len(carry) + 2).to_pylist(), dtype)
                    for p in range(parts):
                        mine = rows[:, p * width : (p + 1) * width]
                        before = () if moved is None else (codes[:, p], dists[:, p], moved[p])
                        codes[:, p], dists[:, p], k = assigned(mine.astype(dtype), books.entries[p], *before)
                        n_pairs += k
                        order = np.argsort(codes[:, p], kind="stable")
                        used, begin, times = np.unique(codes[order, p], return_index=True, return_counts=True)
                        sums[p, used, :width] += np.add.reduceat(mine[order].astype(sums.dtype), begin)
                        sums[p, used, width] += times
                    errors = [min(int(x), (1 << 63) - 1) for x in dists.astype(sums.dtype).sum(1)]
                    new = [pa.array([bytes(r) for r in codes.astype(np.uint8)], pa.binary()), pa.array(_packed(dists), pa.binary()), pa.array(errors, pa.int64())]
                    yield pa.RecordBatch.from_arrays([*own.columns[: len(carry) + 1], *new, *[pa.nulls(n, t) for t in types[-3:]]], names=names)
            if names:
                some = np.flatnonzero(np.repeat((sums[:, :, width] > 0).reshape(-1), width + 1))
                values = pa.array([int(x) for x in sums.reshape(-1)[some]], pa.decimal128(38, 0))
                told = pa.array([n_pairs] + [None] * (len(some) - 1), pa.int64())
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(some), t) for t in types[:-3]], pa.array(some), values, told], names=names)

        source = state if turn == 0 else state.where(F.col(slot).isNull()).select(*carry, body, code, dist)
        after = written(source.mapInArrow(run, schema))
        dropped(state)
        state = after
        found = state.where(F.col(slot).isNotNull()).groupBy(slot).agg(F.sum(total).alias("total"), F.sum(pairs).alias("pairs")).collect()
        compared.append(sum(r["pairs"] or 0 for r in found))
        if turn == rounds or not many:
            continue
        sums = np.zeros(parts * many * (width + 1), object)
        for r in found:
            sums[r[slot]] = int(r["total"])
        sums = sums.reshape(parts, many, width + 1)
        moved, next_books = [], []
        for p in range(parts):
            book = books.entries[p].copy()
            for e in np.flatnonzero(sums[p, :, width] > 0):
                book[e] = [x // sums[p, e, width] for x in sums[p, e, :width]]
            moved.append((book != books.entries[p]).any(1))
            next_books.append(book)
        books = Codebooks(next_books)
    plain_of = sound.select(*carry)
    coded = state.where(F.col(slot).isNull()).select(*carry, F.col(code).alias(fresh(plain_of, "code")), F.col(error).alias(fresh(plain_of, "error")))
    return Fitted(books, coded, compared)


def with_label_errors(coded: DataFrame, label: str = "label", error: str = "error") -> DataFrame:
    """All rows, with `label_error`: the sum of errors over equal labels, nulls together. Sums are made before the
    join, which Spark may split where a label has very many rows."""
    known, name, out = fresh(coded, "_known"), fresh(coded, "_label"), fresh(coded, "label_error")
    keyed = coded.withColumns({known: F.col(label).isNotNull(), name: F.coalesce(F.col(label), F.lit(0))})
    sums = written(keyed.groupBy(known, name).agg(F.sum(error).alias(out)))
    return keyed.join(sums, [known, name]).drop(known, name)


def op13_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of every vector of whole components, by `fitted`: null vectors and such with null, NaN or infinite components
    are dropped, ties go to lower entries, repeated rows are coded each, an empty table gives no rows. Other columns don't
    matter."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("label"), whole(F.col("embedding")).alias("v"))
    done = fitted(rows)
    out = with_label_errors(done.rows)
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(done.books.digest()).alias("codebooks_sha256"))
