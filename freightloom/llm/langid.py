"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed byte n-grams (two and three bytes of lower-cased letters, other
runs as one space). A language has several centroids, clustered by spherical k-means. A text takes the language of
the centroid with the largest cosine; where that cosine is far below what texts of its length reach, it is rejected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightloom.llm.common import fresh

SIZE_BITS = 12
SIZE = 1 << SIZE_BITS
_LETTER = regex.compile(r"\p{L}")
#: ASCII letters and all bytes beyond ASCII are kept, anything else is a space.
_KEEP = np.array([c if chr(c).isalpha() and c < 128 or c > 127 else 32 for c in range(256)], np.uint8)
_CHUNK = 1 << 20
#: Rows of counts that are made vectors together.
_BLOCK = 256
#: A text is rejected under this share of the cosine that all but one in a hundred texts of its length reach.
REJECT = 0.6


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def grams(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text."""
    raw = _KEEP[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    blank = raw == 32
    raw = raw[np.concatenate(([True], ~(blank[1:] & blank[:-1])))[: len(raw)]]
    raw = np.concatenate(([32], raw, [32])).astype(np.uint32)
    out = np.zeros(SIZE, np.int64)
    shift = np.uint32(32 - SIZE_BITS)
    for k in range(0, len(raw) - 1, _CHUNK):
        part = raw[k : k + _CHUNK + 2]
        two = part[:-1] * np.uint32(0x9E3779B1) + part[1:] * np.uint32(0x85EBCA77)
        out += np.bincount((two[:_CHUNK] * np.uint32(0x27D4EB2F)) >> shift, minlength=SIZE)
        if len(part) > 2:
            three = (two[:-1] + part[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x165667B1)
            out += np.bincount(three >> shift, minlength=SIZE)
    return out


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray  # by n-gram
    centroids: np.ndarray  # rows of length one
    owners: np.ndarray  # the language of each row, as an index of langs
    floors: np.ndarray  # by the length's power of two: cosines below are rejected

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows of counts: the language's index, its cosine, and whether it is rejected."""
        cosines = vectors(counts, self.idf) @ self.centroids.T
        best = cosines.argmax(1)
        score = np.clip(cosines[np.arange(len(best)), best], 0.0, 1.0)
        return self.owners[best], score, score < self.floors[buckets(counts)]


def buckets(counts: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(counts.sum(1), 1)).astype(int).clip(0, 39)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = counts.astype(np.float32)
    np.log1p(v, out=v)
    v *= idf
    for part in np.array_split(v, len(v) // _BLOCK + 1):  # in place: the driver calls this with all examples of a language
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return v


def clustered(v: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means; starts from rows far apart, ties to the earlier row, so that it is deterministic."""
    mean = v.sum(0)
    picked = [int((v @ mean).argmax())]
    while len(picked) < min(k, len(v)):
        near = (v @ v[picked].T).max(1)
        picked.append(int(near.argmin()))
    centres = v[picked]
    for _ in range(rounds):
        own = (v @ centres.T).argmax(1)
        sums = np.stack([v[own == i].sum(0) if (own == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres


def learned(rows: Iterable[tuple[str, np.ndarray]], per_language: int = 4) -> Model:
    """The model from (language, counts) rows; the order of rows doesn't matter.

    The driver runs this: it holds the counts once, in the type that they come in, the vectors of one language, and
    predicts a block of rows at a time.
    """
    rows = sorted(rows, key=lambda r: (r[0], r[1].tobytes()))
    langs = sorted({r[0] for r in rows})
    owner = np.array([langs.index(r[0]) for r in rows])
    counts = np.stack([r[1] for r in rows])
    del rows
    idf = (np.log((1 + len(counts)) / (1 + np.count_nonzero(counts, 0))) + 1).astype(np.float32)
    centres = [clustered(vectors(counts[owner == i], idf), per_language) for i in range(len(langs))]
    model = Model(langs, idf, np.concatenate(centres).astype(np.float32), np.repeat(np.arange(len(langs)), [len(c) for c in centres]), np.zeros(40))
    found = [(*model.predict(part)[:2], buckets(part)) for part in np.array_split(counts, len(counts) // _BLOCK + 1)]
    own, score, lengths = map(np.concatenate, zip(*found))
    right = own == owner
    for b in range(40):
        # Lengths with few examples take in their neighbours, as far as it needs, so that every length rejects.
        away = np.abs(lengths[right] - b)
        for reach in range(40):
            of = score[right][away <= reach]
            if len(of) >= 20 or reach == 39 and len(of):
                model.floors[b] = REJECT * np.quantile(of, 0.01)
                break
    return model


def fitted(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = 2400, per_language: int = 4, most_languages: int = 200) -> Model | None:
    """The model learned from rows where `train` holds, the language isn't null and the text has a letter.

    Fitted on a bounded sample: about `sample` rows, as many from each language where it has them, chosen by a hash
    of the key; of more than `most_languages` languages the most frequent ones (ties in order of name). None where
    there are no such rows.
    """
    counts = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(lang).alias("lang")).count()
    found = counts.orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not found:
        return None
    each = max(1, sample // len(found))
    share = F.lit(0.0)
    for r in found:
        share = F.when(F.col(lang) == r["lang"], min(1.0, each / r["count"])).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 20)) / float(1 << 20)

    def run(batches):
        for batch in batches:
            kept = [(a, zlib.compress(grams(t).clip(0, 65535).astype("<u2").tobytes(), 1)) for a, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in kept], pa.string()), pa.array([b for _, b in kept], pa.binary())], names=["lang", "counts"])

    drawn = docs.where(train & (draw < share)).where(F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    # Most n-grams of a text are missing: compressed, its counts take a fraction of the driver's memory.
    got = drawn.mapInArrow(run, "lang string, counts binary").limit(2 * sample).collect()
    return learned(((r["lang"], np.frombuffer(zlib.decompress(r["counts"]), "<u2")) for r in got), per_language) if got else None


def identified(docs: DataFrame, model: Model | None, text: str = "text", carry: list[str] | None = None, unknown: str = "und") -> DataFrame:
    """The columns in `carry` (default: all) of every row, with `lang_pred`, `score` (cosine, 0 to 1) and `rejected`.

    A null text and one without a letter are `unknown`, with score 0, and rejected; so is every text without a
    model. Ties go to the language first in order. Texts are taken whole, however long; repeated rows get equal
    results; an empty table stays empty. Input columns with those names are replaced.
    """
    new = ["lang_pred", "score", "rejected"]
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
    t = fresh(docs.select(*carry), "_text")
    source = docs.select(*carry, F.col(text).alias(t))
    schema = source.select(*carry, F.lit("").alias(new[0]), F.lit(0.0).alias(new[1]), F.lit(True).alias(new[2])).schema

    def run(batches):
        for batch in batches:
            n, column = batch.num_rows, batch.column(batch.num_columns - 1)
            langs, scores, rejected = [unknown] * n, np.zeros(n), np.ones(n, bool)
            for start in range(0, n, 512):
                at, counts = [], []
                for k in range(start, min(n, start + 512)):
                    if model is not None and has_letter(x := column[k].as_py()):
                        at.append(k)
                        counts.append(grams(x))
                if at:
                    own, score, refused = model.predict(np.stack(counts))
                    scores[at], rejected[at] = score, refused
                    for k, o in zip(at, own):
                        langs[k] = model.langs[o]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], names=[*carry, *new])

    return source.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_langid(spark, sf_dir: str) -> DataFrame:
    """Language of every document, by `identified` with a model learned from those that aren't held out: a null text
    and one without a letter are `und`, long texts are taken whole, repeated rows get equal results, an empty table
    stays empty. Languages are those with labels; extra columns don't matter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fitted(docs, ~held_out())
    out = identified(docs, model, carry=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
