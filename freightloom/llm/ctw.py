"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; a decision sees the bits of its byte so far and the `depth` bytes before it. For
each run of bits and each depth there is a node with its counts of zeros and ones in the training texts, and a
Krichevsky-Trofimov estimate from them. A node's weighted probability is the mean of its own estimate's and the product
of its children's (the nodes that see one byte more); the ratio of the two is the weight of its estimate when it
predicts. Texts get the log probability of all their bytes, lower-cased (A-Z), and an end.

The tree is two Spark aggregates and joins a level over all distinct (depth + 1)-byte windows of the corpus; those of
scored texts that training lacks are nodes with counts of zero. Texts are dealt into chunks of bounded size; a chunk
asks for the windows and words that it has, and gets back each one's value. Words are told apart by 64-bit fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freightloom.llm.common import WORD_SEPARATORS, added, dropped, fresh, sliced, written
from freightloom.llm.phrases import BYTE_VALUE, mixed, prefixes, spans

DEPTH = 5
#: The bytes for the end of a text and for what lies before its start; UTF-8 has neither.
END, BEFORE = 0xFE, 0xFF
#: Lower-cases A-Z and turns the two marks, which only broken texts hold, into another byte that UTF-8 lacks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 0xFD if c >= END else c for c in range(256))
_BATCH = 1 << 20
_SEPARATES = np.isin(np.arange(256), np.frombuffer(WORD_SEPARATORS.encode(), np.uint8))
#: Kinds of a chunk's rows.
DOCUMENT, WINDOW, WORD = 0, 1, 2
#: What stands for the ends of texts among the words.
END_KEY = np.uint64(0)


def folded(text: bytes | None) -> bytes:
    return (text or b"").translate(_FOLD)


def byte_windows(texts: list[bytes], depth: int) -> np.ndarray:
    """For every byte of folded texts and every text's end: it and the `depth` bytes before it, as one number."""
    before = bytes([BEFORE]) * depth
    buf = np.frombuffer(before + b"".join(t + bytes([END]) + before for t in texts), np.uint8)
    n = depth + 1
    wide, width, done, out = buf.astype(np.uint64), 1, 0, None
    while width <= n:
        if n & width:
            # The lower bits of n come first: this part is what lies `done` bytes before the end.
            part = wide[: len(wide)]
            shifted = part << np.uint64(8 * done)
            out = shifted if out is None else shifted[: len(shifted) - done] | out[width:]
            done += width
        width *= 2
        if width <= n:
            half = width // 2
            wide = wide[:-half] << np.uint64(8 * half) | wide[half:]
    return out[buf[depth:] != BEFORE]


def _sizes(texts: pa.Array | pa.ChunkedArray) -> list[int]:
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of folded texts, one after the other, and the number of the text that each is in."""
    buf = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
    edge = np.diff(np.concatenate(([False], ~_SEPARATES[buf])).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return mixed(spans(prefixes(BYTE_VALUE[buf]), start, stop)), np.searchsorted(ends, start, side="right")


class Tally:
    """Counts of windows and words of one chunk; what is only scored counts zero."""

    def __init__(self, depth: int):
        self.depth = depth
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {WINDOW: [], WORD: []}

    def add(self, texts: list[bytes], train: bool) -> None:
        words = np.concatenate((word_keys(texts)[0], np.full(len(texts), END_KEY)))
        for kind, keys in ((WINDOW, byte_windows(texts, self.depth)), (WORD, words)):
            found, times = np.unique(keys, return_counts=True)
            parts = self.parts[kind]
            parts.append((found, times if train else np.zeros_like(times)))
            if sum(len(p[0]) for p in parts[1:]) > len(parts[0][0]) + 2 * _BATCH:
                self.parts[kind] = [self.counts(kind)]

    def counts(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        return added(np.concatenate([p[0] for p in self.parts[kind]]), np.concatenate([p[1] for p in self.parts[kind]]))


def chunked(docs: DataFrame, train: Column, text: str, carry: list[str], depth: int, chunk_bytes: int) -> tuple[DataFrame, list[str]]:
    """Written rows of three kinds: a document with its columns, a window of its chunk, a word of its chunk, with counts
    over the training texts. The new columns' names are given, too."""
    new = [fresh(docs.select(*carry), c) for c in ("_body", "_train", "_chunk", "_kind", "_item", "_times")]
    body, learns, *rest = new
    rows = docs.select(*carry, F.col(text).cast("binary").alias(body), F.coalesce(train, F.lit(False)).alias(learns))
    typed = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(rest, ("long", "int", "long", "long"))]).schema
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in typed])  # other kinds of rows hold nulls

    def run(batches):
        names, types = [], {}

        def filled(kind: int, chunk: int, **columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            columns |= {rest[0]: pa.array(np.full(n, chunk)), rest[1]: pa.array(np.full(n, kind, np.int32))}
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, types[c]) for c in names], names=names)

        def told(chunk: int, tally: Tally) -> Iterator[pa.RecordBatch]:
            for kind in (WINDOW, WORD):
                keys, times = tally.counts(kind)
                for k in range(0, len(keys), 1 << 18):
                    yield filled(kind, chunk, **{rest[2]: pa.array(keys[k : k + (1 << 18)].view(np.int64)), rest[3]: pa.array(times[k : k + (1 << 18)])})

        chunk, tally, size = TaskContext.get().partitionId() << 32, None, 0
        for batch in batches:
            if not names:
                names = [*batch.schema.names, *rest]
                types = dict(zip(names, [*batch.schema.types, pa.int64(), pa.int32(), pa.int64(), pa.int64()]))
            teaches = batch.column(len(carry) + 1).to_pylist()
            for some in sliced(_sizes(batch.column(len(carry))), _BATCH):
                texts = {k: folded(batch.column(len(carry))[k].as_py()) for k in some}
                if tally is None:
                    chunk, tally, size = chunk + 1, Tally(depth), 0
                for learn in (True, False):
                    if mine := [texts[k] for k in some if teaches[k] == learn]:
                        tally.add(mine, learn)
                own = batch.slice(some.start, len(some))
                yield filled(DOCUMENT, chunk, **dict(zip(own.schema.names, own.columns)))
                size += sum(map(len, texts.values()))
                if size >= chunk_bytes:
                    yield from told(chunk, tally)
                    tally = None
        if tally is not None:
            yield from told(chunk, tally)

    return written(rows.mapInArrow(run, schema)), new


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x > 0, by Stirling's series eight steps on."""
    y = x + 8
    steps = x
    for k in range(1, 8):
        steps = steps * (x + k)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7))) - F.log(steps)


def log_kt(zeros: Column, ones: Column) -> Column:
    """The logarithm of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _decisions(windows: DataFrame) -> DataFrame:
    """Eight rows for each window: its node (the bytes before, then the byte's bits so far behind a one) and the bit."""
    bits = F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: k)).alias("k")
    rows = windows.select("*", bits)
    byte = F.col("window").bitwiseAND(255)
    so_far = F.expr("shiftleft(1, k)").cast("long").bitwiseOR(F.expr("shiftright(window & 255, 8 - k)"))
    bit = F.expr("shiftright(window & 255, 7 - k)").bitwiseAND(1)
    return rows.withColumns({"node": (F.col("window") - byte).bitwiseOR(so_far), "bit": bit}).drop("k")


def weighted(windows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Rows (window, log2_p): for each distinct window its last byte's log probability behind the bytes before it.

    `windows` has (window, times), each window once, with its count in the training texts (0 for one that is only
    scored). Levels are written as they are made: one aggregate a level on the way up, one join on the way down.
    """
    leaf = _decisions(windows).groupBy("node").agg(F.sum(F.when(F.col("bit") == 0, F.col("times")).otherwise(0)).alias("zeros"), F.sum(F.when(F.col("bit") == 1, F.col("times")).otherwise(0)).alias("ones"))
    own, kids = F.col("own"), F.col("kids")
    levels = [written(leaf.withColumn("log_w", log_kt(F.col("zeros"), F.col("ones"))).withColumn("share", F.lit(1.0)))]
    for d in range(depth - 1, -1, -1):
        # The parent sees one byte less: the node's number without its highest byte.
        parent = F.col("node").bitwiseAND((1 << (8 * d + 8)) - 1)
        level = levels[-1].groupBy(parent.alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_w").alias("kids"))
        level = level.withColumn("own", log_kt(F.col("zeros"), F.col("ones")))
        gap = kids - own
        mixed = F.greatest(own, kids) + F.log1p(F.exp(-F.abs(gap))) - math.log(2)
        levels.append(written(level.select("node", "zeros", "ones", mixed.alias("log_w"), (1 / (1 + F.exp(F.least(gap, F.lit(700.0))))).alias("share"))))
    estimate = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
    down = None
    for d, level in enumerate(reversed(levels)):
        mine = level.select("node", estimate.alias("p"), "share")
        if down is None:
            down = mine.select("node", (F.col("share") * F.col("p")).alias("one"), (1 - F.col("share")).alias("left"))
        else:
            up = down.select(F.col("node").alias("up"), "one", "left")
            both = mine.join(up, mine["node"].bitwiseAND((1 << (8 * d)) - 1) == up["up"])
            down = both.select("node", (F.col("one") + F.col("left") * F.col("share") * F.col("p")).alias("one"), (F.col("left") * (1 - F.col("share"))).alias("left"))
    # Of the same bytes before there are 255 nodes at most: they go to their windows together.
    context = lambda c: F.shiftright(c, 8)
    nodes = down.groupBy(context("node").alias("context")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("node").bitwiseAND(255), "one"))).alias("ones"))
    both = windows.select("window", context("window").alias("context")).join(nodes, "context")
    byte = F.col("window").bitwiseAND(255)

    def decided(k: int) -> Column:
        one = F.element_at("ones", F.shiftright(byte, 8 - k).bitwiseOR(1 << k))
        return F.log2(F.when(F.shiftright(byte, 7 - k).bitwiseAND(1) == 1, one).otherwise(1 - one))

    out = written(both.select("window", sum((decided(k) for k in range(1, 8)), decided(0)).alias("log2_p")))
    dropped(*levels)
    return out


class Lookup:
    """Values of distinct 64-bit keys: one guess by a hash, a search for the keys that it misses."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(4, int(4 * max(len(keys), 1)).bit_length()))
        self.guess = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.guess[self._slot(self.keys)] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ keys >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.guess[self._slot(keys)]
        missed = np.flatnonzero(self.keys[at] != keys)
        at[missed] = np.searchsorted(self.keys, keys[missed])
        return self.values[at]


def scored(docs: DataFrame, train: Column, text: str = "text", carry: list[str] | None = None, depth: int = DEPTH, chunk_bytes: int = 48 << 20) -> DataFrame:
    """The columns in `carry` (default: all) of every row, with `n_tokens`, `n_known`, `train_tokens` (long),
    `base_score`, `score` and `bits_per_byte` (double), learned from the rows where `train` holds (null: not).

    score: log10 of the probability that the context trees give the whole text and its end; bits_per_byte is the same
    as code length for each byte and the end. n_tokens: words and one end; n_known: those that training has; base_score:
    log10 of the tokens by their counts alone, (c + 0.1) / (N + 0.1 * (V + 1)). A null text is an empty one: an end.
    Without training rows every bit costs one bit, and each token's base is 1. Long texts are taken whole, repeated rows
    get equal scores, an empty table stays empty; input columns with the new names are replaced. depth: 1 to 7 bytes.
    A chunk holds about `chunk_bytes`, or one longer text.
    """
    if not 1 <= depth <= 7:
        raise ValueError("depth must be 1 to 7")
    found = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in found]
    table, (body, _, chunk, kind, item, times) = chunked(docs, train, text, carry, depth, chunk_bytes)
    asked = lambda k: table.where(F.col(kind) == k).select(F.col(chunk).alias("chunk"), F.col(item).alias("item"), F.col(times).alias("times"))
    windows = written(asked(WINDOW).groupBy(F.col("item").alias("window")).agg(F.sum("times").alias("times")))
    # A word's rows are one for each chunk that has it, the first of them stands for the word.
    by_word = Window.partitionBy("item")
    words = written(asked(WORD).select("chunk", "item", F.sum("times").over(by_word).alias("times"), (F.row_number().over(by_word.orderBy("chunk")) == 1).alias("first")))
    total, distinct = words.where("first AND times > 0").agg(F.coalesce(F.sum("times"), F.lit(0)), F.count("*")).first()
    values = weighted(windows, depth)
    told = asked(WINDOW).select("chunk", F.col("item").alias("window")).join(values, "window").select("chunk", F.lit(True).alias("is_window"), F.col("window").alias("item"), F.col("log2_p").alias("value"))
    told = told.unionByName(words.select("chunk", F.lit(False).alias("is_window"), "item", F.col("times").cast("double").alias("value")))
    texts = table.where(F.col(kind) == DOCUMENT).select(F.col(chunk).alias(chunk), *carry, F.col(body).alias(body))
    result = docs.select(*carry)
    schema = result.select("*", *[F.lit(0).cast("long").alias(c) for c in found[:3]], *[F.lit(0.0).alias(c) for c in found[3:]]).schema
    floor = total + 0.1 * (distinct + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        is_window, item, value = (np.asarray(right.column(c)) for c in ("is_window", "item", "value"))
        item = item.view(np.uint64)
        of_window, of_word = Lookup(item[is_window], value[is_window]), Lookup(item[~is_window], value[~is_window])
        ends = float(of_word(np.array([END_KEY]))[0])
        out = np.zeros((3, left.num_rows))
        sums = np.zeros((2, left.num_rows), np.int64)
        del right, item, value, is_window
        texts = left.column(left.num_columns - 1)
        sizes = np.array(_sizes(texts), np.int64) + 1
        for some in sliced(sizes.tolist(), _BATCH):
            mine, at = [folded(texts[k].as_py()) for k in some], slice(some.start, some.stop)
            logs = of_window(byte_windows(mine, depth))
            bits = np.add.reduceat(logs, np.concatenate(([0], np.cumsum(sizes[at])[:-1])))
            keys, of_text = word_keys(mine)
            c, n = of_word(keys), len(mine)
            sums[:, at] = np.bincount(of_text, minlength=n) + 1, np.bincount(of_text[c > 0], minlength=n) + (ends > 0)
            base = np.bincount(of_text, np.log10((c + 0.1) / floor), n) + math.log10((ends + 0.1) / floor)
            out[:, at] = base, bits * math.log10(2), -bits / sizes[at]
        got = [*sums, np.full(left.num_rows, total, np.int64), *out]
        return pa.table([*left.columns[1:-1], *map(pa.array, got)], names=[*carry, *found])

    return texts.groupBy(chunk).cogroup(told.groupBy("chunk")).applyInArrow(run, schema)


def op11_ctw(spark, sf_dir: str) -> DataFrame:
    """Scores of every document, by `scored`, learned from those whose crc32(doc_id as text) mod 10 isn't 0. A document
    without an id teaches nothing and counts as held out. Null and empty texts are an end alone, long texts are taken
    whole, repeated rows get equal scores, an empty table gives no rows; other columns don't matter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))
    out = scored(docs.withColumn("held_out", held_out), ~held_out, carry=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
