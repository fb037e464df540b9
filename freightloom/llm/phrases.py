"""Frequent phrases and their cohesion, by Rabin-Karp fingerprints.

Texts are byte arrays: prefix sums of byte values times powers of an odd base give every word's fingerprint, prefix sums
of word fingerprints that of every n-gram, each by one subtraction and one product (64 bits, wrapping). A shuffle adds up
fingerprints, level by level: words, then pairs of frequent words, then longer n-grams whose pairs are all frequent. What is
frequent reaches the tasks as a filter of bounded size, which may let more through, never less; a last pass reads the
texts again and materialises the phrases of frequent fingerprints alone. There every occurrence is compared word by word with
the first one that its fingerprint points to, and phrases are counted once more by their words, so that collisions
change no count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightloom.llm.common import added, sliced, written

LONGEST = 5
BASE = np.uint64(0x9E3779B97F4A7C15)
#: The base's inverse modulo 2 ** 64.
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Marks that end a piece, and white space between words; A-Z are lower-cased, tabs are spaces.
PIECE_MARKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else c for c in range(256))
#: 0 for a byte of a word, 1 for a blank, 2 for a mark.
_KIND = np.array([2 if c in PIECE_MARKS else 1 if c in BLANKS else 0 for c in range(256)], np.uint8)
_BATCH = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads what 64-bit numbers differ in over all their bits."""
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


#: A coefficient for each byte.
BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64))


def prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomials of the values (one more than them) and the powers that `spans` needs."""
    n = len(values)
    back, powers = np.full(n, BACK), np.full(n, BASE)
    back[:1] = powers[:1] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * np.cumprod(back), out=sums[1:])
    return sums, np.cumprod(powers)


def spans(held: tuple[np.ndarray, np.ndarray], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Fingerprints of the values from each start to before its stop: equal for equal values, wherever they are."""
    sums, powers = held
    return (sums[stop] - sums[start]) * powers[stop - 1] if len(start) else np.zeros(0, np.uint64)


@dataclass
class Tokens:
    """Words of several texts: places of their bytes, fingerprints, and the piece that each is in."""

    buf: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    word: np.ndarray
    piece: np.ndarray
    text: np.ndarray
    salt: np.ndarray  # by word: what tells languages apart
    offset: np.ndarray  # by text: where it starts

    @classmethod
    def of(cls, texts: list[bytes], salts: np.ndarray) -> Tokens:
        """The words of folded texts; a text's language is a number."""
        buf = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
        kind = _KIND[buf]
        inside = kind == 0
        edge = np.diff(np.concatenate(([False], inside)).astype(np.int8))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        word = mixed(spans(prefixes(BYTE_VALUE[buf]), start, stop))
        piece = np.cumsum(kind == 2)[start] if len(start) else np.zeros(0, np.int64)
        ends = np.cumsum([len(t) + 1 for t in texts])
        text = np.searchsorted(ends, start, side="right")
        offset = np.concatenate(([0], ends))
        return cls(buf, start, stop, word, piece, text, salts[text], offset)

    def grams(self, n: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts (numbers of words) and fingerprints of the n-grams inside pieces; `among` are the starts to look at."""
        at = np.arange(max(0, len(self.word) - n + 1)) if among is None else among[among + n <= len(self.word)]
        at = at[self.piece[at] == self.piece[at + n - 1]] if len(at) else at.astype(np.int64)
        keys = spans(self._prefixes(), at, at + n)
        return at, mixed(keys ^ self.salt[at] ^ np.uint64(n)) if len(at) else keys

    def _prefixes(self) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_held"):
            self._held = prefixes(self.word)
        return self._held

    def fitting(self, pairs: Sieve) -> np.ndarray:
        """For each word whether it and the next one are a pair that the sieve lets through."""
        at, keys = self.grams(2)
        out = np.zeros(len(self.word), bool)
        out[at[pairs(keys)]] = True
        return out

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words number a and b have equal bytes, pair by pair."""
        size = self.stop[a] - self.start[a]
        out = size == self.stop[b] - self.start[b]
        a, b, size = a[out], b[out], size[out]
        first = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(first, size)
        equal = self.buf[np.repeat(self.start[a], size) + step] == self.buf[np.repeat(self.start[b], size) + step]
        out[out] = np.logical_and.reduceat(equal, first) if len(first) else True
        return out

    def identities(self) -> np.ndarray:
        """A number for each word, equal for equal bytes and no others."""
        _, first, own = np.unique(self.word, return_index=True, return_inverse=True)
        if self.same(np.arange(len(self.word)), first[own]).all():
            return own
        raw = self.buf.tobytes()
        numbers: dict[bytes, int] = {}
        return np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(self.start, self.stop)])

    def phrases(self, at: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The words from each start, joined by one space."""
        raw = self.buf.tobytes()
        start, stop = self.start[at], self.stop[at + n - 1]
        # Most lie in the text as they are told: words and single spaces alone.
        letters = np.concatenate(([0], np.cumsum(self.stop - self.start)))
        plain = stop - start == letters[at + n] - letters[at] + n - 1
        out = [raw[a:b] for a, b in zip(start.tolist(), stop.tolist())]
        for k in np.flatnonzero(~plain):
            out[k] = b" ".join(out[k].split())
        return out


def grouped(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place and the count of each distinct row of `rows`, told apart by its key where keys don't collide."""
    _, first, own, times = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    if not (rows == rows[first[own]]).all():
        _, first, times = np.unique(rows, axis=0, return_index=True, return_counts=True)
    return first, times


class Sieve:
    """A set of 64-bit keys as two bits each of a table; it may hold others, it misses none."""

    #: At least so many bits for a key, up to so many bits in all (32 MB).
    EACH, MOST = 32, 1 << 28

    def __init__(self, table: np.ndarray):
        self.table = table
        self.bits = np.uint64(len(table) * 64 - 1)

    def _has(self, at: np.ndarray) -> np.ndarray:
        return self.table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        return (self._has(keys & self.bits) & self._has(keys >> np.uint64(32) & self.bits)).astype(bool)

    @classmethod
    def of(cls, keys: DataFrame) -> Sieve:
        """From the column `key`. What comes to the driver is the table's words that aren't zero: MOST / 64 at most."""
        n = keys.count()
        size = min(cls.MOST, max(1 << 12, 1 << (cls.EACH * n - 1).bit_length() if n else 0))
        key = F.col("key")
        places = keys.select(F.explode(F.array(key.bitwiseAND(size - 1), F.shiftrightunsigned(key, 32).bitwiseAND(size - 1))).alias("at"))
        words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(at & 63)))").alias("bits")).toArrow()
        table = np.zeros(size // 64, np.int64)
        table[np.asarray(words.column("word"))] = np.asarray(words.column("bits"))
        return cls(table.view(np.uint64))


def read(docs: DataFrame, text: str, lang: str, key: str) -> DataFrame:
    """Rows (key, lang, salt, body): what the passes read of a text; a null language is `und`."""
    told = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    return docs.select(F.col(key).alias("key"), told.alias("lang"), F.xxhash64(told).alias("salt"), F.col(text).cast("binary").alias("body"))


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """Rows of about `_BATCH` bytes of text each (or one longer text), with their words."""
    for batch in batches:
        body, salts = batch.column("body"), np.asarray(batch.column("salt")).view(np.uint64)
        for some in sliced([n + 1 for n in pc.binary_length(body).fill_null(0).to_pylist()], _BATCH):
            texts = [(t.as_py() or b"").translate(_FOLD) for t in body.slice(some.start, len(some))]
            yield batch.slice(some.start, len(some)), Tokens.of(texts, salts[some.start : some.stop])


def counts(rows: DataFrame, keys_of: Callable[[Tokens], list[np.ndarray]], room: int = 1 << 20) -> DataFrame:
    """Rows (key, times): how often the fingerprints that `keys_of` picks occur. Tasks add up before the shuffle, and
    hand on what they have when it passes `room` fingerprints."""

    def run(batches):
        def told(parts):
            keys, times = added(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            for k in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 18)].view(np.int64)), pa.array(times[k : k + (1 << 18)])], names=["key", "times"])

        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for _, tokens in batches_of(batches):
            for keys in keys_of(tokens):
                parts.append(np.unique(keys, return_counts=True))
            size = sum(len(p[0]) for p in parts)
            if size > room or size > 2 * len(parts[0][0]) + _BATCH:
                merged = [added(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
                if len(merged[0][0]) > room // 2:
                    yield from told(merged)
                    merged = []
                parts = merged
        if parts:
            yield from told(parts)

    return rows.mapInArrow(run, "key long, times long").groupBy("key").agg(F.sum("times").alias("times"))


def totals(rows: DataFrame) -> DataFrame:
    """Rows (lang, n): how many words the texts of a language have."""

    def run(batches):
        for batch, tokens in batches_of(batches):
            n = np.bincount(tokens.text, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(n.astype(np.int64))], names=["lang", "n"])

    return rows.mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def linked(fit: np.ndarray, n: int) -> np.ndarray:
    """The starts at which n things in a row fit."""
    runs = np.cumsum(np.concatenate(([0], fit)))
    return np.flatnonzero(runs[n:] - runs[:-n] == n) if len(fit) >= n else np.zeros(0, np.int64)


def sieves(rows: DataFrame, least: int, longest: int) -> list[Sieve]:
    """What may be frequent: of words, of pairs, of longer n-grams together."""

    def words(t: Tokens) -> list[np.ndarray]:
        return [t.grams(1)[1]]

    found = [Sieve.of(_frequent(rows, words, least))]
    if longest > 1:
        known = found[0]

        def pairs(t: Tokens) -> list[np.ndarray]:
            return [t.grams(2, linked(known(t.grams(1)[1]), 2))[1]]

        found.append(Sieve.of(_frequent(rows, pairs, least)))
    if longest > 2:
        paired = found[1]

        def longer(t: Tokens) -> list[np.ndarray]:
            fit = t.fitting(paired)
            return [t.grams(n, linked(fit, n - 1))[1] for n in range(3, longest + 1)]

        found.append(Sieve.of(_frequent(rows, longer, least)))
    return found


def _frequent(rows: DataFrame, keys_of: Callable[[Tokens], list[np.ndarray]], least: int) -> DataFrame:
    return written(counts(rows, keys_of).where(F.col("times") >= least).select("key"))


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", least: int = 100, longest: int = LONGEST) -> DataFrame:
    """Rows (lang, phrase, words, times, seen_in, seen_at): every phrase of 1 to `longest` words that the texts of a
    language (null: `und`) hold `least` times or more, with an occurrence: the text's key and the byte where it starts.

    A-Z are lower-cased; words are what lies between blanks (space, tab) and marks (`.,;:!?`, line feed to carriage
    return), phrases don't pass marks and are joined by one space; overlapping occurrences count. A null text holds
    none; whole texts are read, however long; repeated rows count again; an empty table gives no rows; other columns
    don't matter.
    """
    rows = read(docs, text, lang, key)
    held = sieves(rows, least, longest)

    def run(batches):
        names = ["lang", "phrase", "words", "times", "seen_in", "seen_at"]
        for batch, tokens in batches_of(batches):
            if not len(tokens.word):
                continue
            own = tokens.identities()
            of_lang = np.unique(tokens.salt, return_inverse=True)[1]
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            pairs = tokens.fitting(held[1]) if longest > 1 else None
            for n in range(1, longest + 1):
                at, keys = tokens.grams(n) if n == 1 else tokens.grams(n, linked(pairs, n - 1))
                if n != 2:
                    fits = held[0 if n == 1 else 2](keys)
                    at, keys = at[fits], keys[fits]
                if len(at):
                    first, times = grouped(keys, np.stack([of_lang[at], *[own[at + j] for j in range(n)]], axis=1))
                    out.append((at[first], np.full(len(first), n, np.int32), times))
            if not out:
                continue
            places, sizes, times = map(np.concatenate, zip(*out))
            texts = tokens.text[places]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang").take(pa.array(texts)),
                    pa.array(tokens.phrases(places, sizes), pa.binary()).cast(pa.string()),
                    pa.array(sizes),
                    pa.array(times),
                    batch.column("key").take(pa.array(texts)),
                    pa.array((tokens.start[places] - tokens.offset[texts]).astype(np.int64)),
                ],
                names=names,
            )

    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(run, f"lang string, phrase string, words int, times long, seen_in {kind}, seen_at long")
    seen = F.min(F.struct("seen_in", "seen_at")).alias("seen")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("times").alias("times"), seen).where(F.col("times") >= least).select("lang", "phrase", "words", "times", "seen.*")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", least: int = 100, longest: int = LONGEST, percent: int = 100, top: int = 2000) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score, seen_in, seen_at): the `top` most cohesive phrases of each language.

    Candidates: phrases of 2 to `longest` words with a = their occurrences, `least` or more, as `frequent` counts. A cut
    gives l and r, the occurrences of its parts, and floor(1000 a n / (l r)), n the language's words; the cut with the
    smallest score counts, ties to the one that is first. A candidate inside a longer one that has at least `percent`
    per cent of its occurrences is dropped. Order: score, then a, both falling, then the phrase's bytes. Numbers are
    exact up to products of 38 digits. Null and empty texts hold no words, repeated rows count again, an empty table gives
    no rows.
    """
    found = written(frequent(docs, text, lang, key, least, longest))
    candidates = found.where("words > 1")
    part = lambda a, n: F.array_join(F.slice(F.split("phrase", " "), a, n), " ")
    cuts = candidates.select("lang", "phrase", "words", F.col("times").alias("a"), "seen_in", "seen_at", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumns({"one": part(F.lit(1), F.col("k")), "two": part(F.col("k") + 1, F.col("words") - F.col("k"))})
    counted = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("times").alias(count))
    cuts = cuts.join(counted("one", "l"), ["lang", "one"]).join(counted("two", "r"), ["lang", "two"]).join(totals(read(docs, text, lang, key)), "lang")
    big = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumns({"over": F.lit(1000).cast("decimal(4,0)") * (big("a") * big("n")), "under": big("l") * big("r")}).withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"), *[F.first(c).alias(c) for c in ("a", "n", "seen_in", "seen_at")])
    # All shorter phrases inside a candidate, with its count.
    inside = F.expr("flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), i -> array_join(slice(split(phrase, ' '), i, n), ' '))))")
    longer = candidates.where("words > 2").select("lang", F.explode(inside).alias("phrase"), "times").groupBy("lang", "phrase").agg(F.max("times").alias("most"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score", "seen_in", "seen_at")
    # First the best of each of many parts of a language, so that no task sorts all its phrases.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    share = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "seen_in", "seen_at")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    """The 2,000 most cohesive phrases of each language of all documents, by `collocations`: null and empty texts hold
    no words, long texts are read whole, repeated rows count again, ties go as there, an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return collocations(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces
), total AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), lengths AS (
  SELECT unnest(range(1, 6)) AS words
), f AS (
  SELECT lang, words, phrase, count(*) AS a FROM (
    SELECT lang, words, unnest(list_transform(range(1, len(w) - words + 2), lambda i: array_to_string(w[i : i + words - 1], ' '))) AS phrase
    FROM w, lengths WHERE len(w) >= words
  ) GROUP BY lang, words, phrase HAVING count(*) >= 100
), cuts AS (
  SELECT lang, words, phrase, a, unnest(range(1, words)) AS k FROM f WHERE words > 1
), scored AS (
  SELECT c.lang, c.words, c.phrase, c.a, c.k, x.a AS l, y.a AS r, t.n, CAST((1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts c JOIN total t ON t.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.words = c.k AND x.phrase = array_to_string(string_split(c.phrase, ' ')[1 : c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.words = c.words - c.k AND y.phrase = array_to_string(string_split(c.phrase, ' ')[c.k + 1 : c.words], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT f.lang, f.a, unnest(list_transform(range(1, f.words - s.words + 2), lambda i: array_to_string(string_split(f.phrase, ' ')[i : i + s.words - 1], ' '))) AS phrase
    FROM f JOIN lengths s ON s.words >= 2 AND s.words < f.words
  ) GROUP BY lang, phrase
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.most IS NULL OR 100 * i.most < 100 * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
) WHERE rank <= 2000
"""
