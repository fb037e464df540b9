"""Operators that compare rows: SimHash, line dedup, top-k search."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from freightloom.llm import linededup, simhash, topk

ODD = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "x"), (4, "x"), (5, "word " * 20000), (6, "Ab c"), (7, "aB c")]


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def reach(nodes, linked):
    """The smallest member of each node's component."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {n: root(n) for n in nodes}


def near(a, b):
    return (a ^ b).bit_count() <= 3


def test_fingerprints():
    rnd = random.Random(1)
    texts = [None, "", " \n", "One", "one two", "A b C d", "é É ß \x0b x"] + ["".join(rnd.choice("ab \né") for _ in range(200)) for _ in range(30)]
    for t in texts:
        assert simhash.fingerprint(t.encode() if t is not None else None) == slow_fingerprint(t)


def test_groups_equal_brute_force(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("abcdefghij") * 3 + str(rnd.randint(0, 50)) for _ in range(150)) for _ in range(12)]
    texts = [" ".join(w if rnd.random() > 0.004 else "new" for w in rnd.choice(base).split()) for _ in range(120)]
    rows = ODD + list(enumerate(texts, 10))
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, fp string")
    got = simhash.grouped(docs).collect()
    assert len(got) == len(rows)
    prints = defaultdict(list)
    for i, t in rows:
        prints[slow_fingerprint(t)].append(i)
    groups = reach(prints, near)
    low = defaultdict(list)
    for f, g in groups.items():
        low[g] += [i for i in prints[f] if i is not None]
    want = sorted(((i, min(low[groups[f]])) for f, ids in prints.items() for i in ids), key=str)
    assert sorted(((r["doc_id"], r["component"]) for r in got), key=str) == want
    assert len({c for _, c in want}) < len(want) - 20
    assert simhash.grouped(docs.limit(0)).collect() == []


@pytest.mark.parametrize("crowd", [1000, 4])
def test_crowded_segments_keep_components(spark, crowd):
    rnd = random.Random(7)
    fps = set()
    for _ in range(2):
        base = rnd.getrandbits(64)
        for _ in range(90):
            x = base
            for _ in range(rnd.randint(0, 8)):
                x ^= 1 << rnd.randrange(64 if rnd.random() < 0.3 else 32)
            fps.add(x)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(simhash.links(df, crowd)).collect()}
    want, mine = defaultdict(set), defaultdict(set)
    for x, g in reach(fps, near).items():
        want[g].add(x)
        mine[got.get(x, x)].add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, mine.values()))


def test_one_segment_shared_by_thousands(spark):
    rnd = random.Random(12)
    low = [rnd.getrandbits(32) for _ in range(4000)]
    low += [x ^ (1 << rnd.randrange(32)) ^ (1 << rnd.randrange(32)) for x in low[:1000]]
    fps = {5 << 32 | x for x in low} | {7 << 32 | x for x in low[:50]} | {4 << 32 | x for x in low[:600]}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    arrays = np.array(sorted(fps), np.uint64)
    root = {int(x): int(x) for x in arrays}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in arrays:
        for y in arrays[np.bitwise_count(arrays ^ x) <= 3]:
            a, b = sorted((find(int(x)), find(int(y))))
            root[b] = a
    assert all(got.get(x, x) == find(x) for x in root)


def slow_deduped(rows):
    said = {k: [(i, line) for i, line in enumerate((t or "").split("\n")) if line.strip(" \t\n\x0b\x0c\r")] for k, t in rows}
    seen, gone = set(), defaultdict(set)
    for k in sorted(said):
        for p in range(max(1, len(said[k]) - 2) if said[k] else 0):
            window = said[k][p : p + 3]
            lines = tuple(x for _, x in window)
            if lines in seen:
                gone[k].update(i for i, _ in window)
            seen.add(lines)
    return {k: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) for k, t in rows}


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = [(k, "\n".join(rnd.choice(["a", "b", "c c", "", "  "]) for _ in range(rnd.randint(0, 14)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "only once"), (103, "x1\nx2\nx3\nx4"), (104, "y\nx1\nx2\nx3\nx4\nz"), (105, "\n".join(map(str, range(3000))))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lines_removed int")
    got = {r["doc_id"]: r for r in linededup.deduped(docs).collect()}
    assert {k: r["text"] for k, r in got.items()} == slow_deduped(rows)
    assert got[104]["text"] == "y\nz" and got[104]["lines_removed"] == 4 and got[103]["lines_removed"] == 0


def test_line_dedup_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "n1\nn2\nn3"), (1, "n1\nn2\nn3"), (2, "r1\nr2\nr3"), (2, "r1\nr2\nr3")], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["text"]) for r in linededup.deduped(docs).collect()), key=str) == [(1, ""), (2, "r1\nr2\nr3"), (2, "r1\nr2\nr3"), (None, "n1\nn2\nn3")]
    assert linededup.deduped(docs.limit(0)).collect() == []


@pytest.mark.parametrize("blocks", [8192, 40])
def test_top_k_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=6).round(1) / 4]) for i in range(150)]
    rows += [(200, None), (201, [0.1, None]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [0.5] * 6), (204, []), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select(F.col("vec_id").alias("id"), topk.whole(F.col("embedding")).alias("v"))
    got = sorted(map(tuple, topk.top(df, df.where("id % 10 = 0"), k=5, block_rows=blocks, query_rows=blocks // 8).collect()))
    sound = [(i, np.floor(np.array([*v, *[0.0] * (6 - len(v))]) * 1024).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in dict(sound).items():
        if q % 10 == 0:
            best = sorted((-int(v @ c), i) for i, c in sound if i != q)[:5]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert topk.top(df.limit(0), df.limit(0)).collect() == []
    assert topk.top(df.where("id = 10"), df.where("id = 10")).collect() == []


def test_reading_stops_early():
    rng = np.random.default_rng(2)
    rows = rng.integers(-100, 100, (2000, 3))
    rows[7] = 1000
    block = topk.Block(np.arange(2000), rows)
    ids, scores = block.best(np.array([5, 4, 3]), 1)
    assert list(ids) == [7] and list(scores) == [12000]


def test_whole_numbers_stay_exact():
    big = 1 << 30
    rows = np.array([[big, 1], [big, 0], [big - 1, 5], [-big, 7], [0, 0]])
    for k in (1, 2, 3, 4):
        ids, scores = topk.Block(np.arange(5), rows).best(np.array([big, 1]), k)
        want = sorted(((-int(r[0] * big + r[1]), i) for i, r in enumerate(rows)))[:k]
        assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == want
