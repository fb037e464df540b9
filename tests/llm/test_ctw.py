"""Context-tree weighting against a tree that is walked node by node."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightloom.llm import ctw


def symbols(text, depth):
    """(context, byte) of each byte of a text and of its end."""
    b = [ctw.BEFORE] * depth + list(ctw.folded(text.encode() if text else b"")) + [ctw.END]
    return [(tuple(b[i - depth : i]), b[i]) for i in range(depth, len(b))]


def kt(a, b):
    """The estimate's probability of a zeros and b ones, one after the other."""
    p = 1.0
    for k in range(a):
        p *= (k + 0.5) / (k + 1)
    for k in range(b):
        p *= (k + 0.5) / (a + k + 1)
    return p


class Tree:
    """One tree for each run of bits, by plain recursion over contexts."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.below = depth, collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
        for text in texts:
            for context, byte in symbols(text, depth):
                for k in range(8):
                    prefix, bit = (1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1
                    for d in range(depth + 1):
                        self.counts[prefix, context[depth - d :]][bit] += 1
                        if d:
                            self.below[prefix, context[depth - d + 1 :]].add(context[depth - d :])
        self.memo = {}

    def product(self, prefix, context):
        return math.prod(self.weighted(prefix, c) for c in self.below[prefix, context])

    def weighted(self, prefix, context):
        if (prefix, context) not in self.memo:
            own = kt(*self.counts[prefix, context])
            self.memo[prefix, context] = own if len(context) == self.depth else (own + self.product(prefix, context)) / 2
        return self.memo[prefix, context]

    def predict(self, prefix, context, bit, d=0):
        own = context[self.depth - d :]
        a, b = self.counts.get((prefix, own), (0, 0))
        estimate = ((b if bit else a) + 0.5) / (a + b + 1)
        if d == self.depth:
            return estimate
        mine, theirs = kt(a, b), self.product(prefix, own)
        return (mine * estimate + theirs * self.predict(prefix, context, bit, d + 1)) / (mine + theirs)

    def log10(self, text):
        total = 0.0
        for context, byte in symbols(text, self.depth):
            for k in range(8):
                total += math.log10(self.predict((1 << k) | (byte >> (8 - k)), context, byte >> (7 - k) & 1))
        return total


def base(texts, text):
    tokens = collections.Counter(w for t in texts for w in (*ctw.folded((t or "").encode()).split(), b""))
    n, v = sum(tokens.values()), len(tokens)
    mine = [*ctw.folded((text or "").encode()).split(), b""]
    return len(mine), sum(tokens[w] > 0 for w in mine), n, sum(math.log10((tokens[w] + 0.1) / (n + 0.1 * (v + 1))) for w in mine)


@pytest.mark.parametrize("depth", (1, 2, 5, 7))
def test_scores_equal_the_plain_tree(spark, depth):
    rnd = random.Random(depth)
    made = ["".join(rnd.choice(["ab", "Ab ", "c", "\n", " d", "é", "日"]) for _ in range(rnd.randint(0, 25))) for _ in range(12)]
    rows = [(k, t, "mine", k % 3 > 0) for k, t in enumerate([None, "", "a", "A", "ab ab ab ab", *made])] + [(1, "", "mine", True), (None, "ab", "mine", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, learns boolean")
    # Chunks of a few texts each, so that windows meet again in several.
    got = ctw.scored(docs, F.col("learns"), depth=depth, chunk_bytes=40).collect()
    taught = [t for _, t, _, learns in rows if learns]
    tree = Tree(taught, depth)
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "learns", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"}
    for r in got:
        want = base(taught, r["text"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3]
        assert r["base_score"] == pytest.approx(want[3], abs=1e-9)
        assert r["score"] == pytest.approx(tree.log10(r["text"]), abs=1e-6)
        assert r["bits_per_byte"] == pytest.approx(-r["score"] / math.log10(2) / (len((r["text"] or "").encode()) + 1))


def test_nothing_learned_costs_a_bit_for_each_bit(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ctw.scored(docs, F.lit(False)).collect()}
    assert got[1]["bits_per_byte"] == pytest.approx(8) and got[2]["score"] == pytest.approx(8 * math.log10(0.5))
    assert got[1]["train_tokens"] == got[1]["n_known"] == 0 and got[1]["base_score"] == pytest.approx(0)
    assert ctw.scored(docs.limit(0), F.lit(True)).collect() == []


def test_gamma_and_windows():
    assert ctw.byte_windows([b"ab", b""], 1).tolist() == [0xFF61, 0x6162, 0x62FE, 0xFFFE]
    for depth in range(1, 8):
        texts = [b"", b"x", b"hello there", bytes(range(91, 120))]
        want = [int.from_bytes(bytes([*c, b]), "big") for t in texts for c, b in symbols(t.decode(), depth)]
        assert ctw.byte_windows(texts, depth).tolist() == want
    rnd = np.random.default_rng(3)
    keys = rnd.integers(0, 1 << 64, 5000, np.uint64)
    found = ctw.Lookup(keys, np.arange(5000.0))
    assert (found(keys[::-1]) == np.arange(5000.0)[::-1]).all()


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 7.25, 1e3, 1e9]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(ctw.log_gamma(F.col("x"))).collect()
    for x, r in zip(xs, got):
        assert r[0] == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-10)


def test_learning_helps_held_out_texts(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("aeiou") + rnd.choice("bdfgklmnprst") for _ in range(rnd.randint(1, 3))) for _ in range(60)]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(80))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = [r for r in ctw.scored(docs, ~held).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0]
    assert got and all(r["bits_per_byte"] < 2.5 for r in got)
