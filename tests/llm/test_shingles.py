"""Near-duplicates of the pipeline's stage against brute-force Jaccard similarity."""

import random

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
from freightloom.llm import shingles  # noqa: E402
from test_groups import near, reach, slow_fingerprint  # noqa: E402


def slow_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def texts(seed, bases, copies):
    rnd = random.Random(seed)
    out = [None, "", " \n", "One", "one", "a b C d", "a b c d", "a b c d e", "a b c d e f"]
    for size in bases:
        base = [f"w{rnd.randrange(400)}" for _ in range(size)]
        for _ in range(copies):
            done = list(base)
            for _ in range(rnd.randint(0, max(1, size // 30))):
                done[rnd.randrange(size)] = f"new{rnd.randrange(10**6)}"
            out.append(" ".join(done))
    return out + ["shared phrase of five words " + f"{k} and then other words {k * k}" for k in range(90)]


def components(rows):
    ids = {}
    for k, t in rows:
        ids.setdefault(slow_set(t), []).append(k)
    numbered = list(ids)
    root = reach(range(len(numbered)), lambda i, j: alike(numbered[i], numbered[j]))
    out = {}
    for i, s in enumerate(numbered):
        out.setdefault(root[i], []).extend(ids[s])
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("common,most", [(32, 1 << 16), (2, 50)])
def test_groups_equal_brute_force(spark, monkeypatch, common, most):
    monkeypatch.setattr(shingles, "COMMON", common)
    monkeypatch.setattr(shingles, "MOST_COMMON", most)
    rows = list(enumerate(texts(1, [8, 30, 31, 120, 200, 400], 20)))
    got = {}
    for r in shingles.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["group"], []).append(r["doc_id"])
    assert sorted(map(sorted, got.values())) == components(rows)
    assert shingles.grouped(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_stage_drops_copies_beyond_three_bits(spark):
    rows = list(enumerate(texts(2, [100, 300, 301], 12)))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {g[0] for g in components(rows)}
    said = [t for _, t in rows]
    assert any(alike(slow_set(a), slow_set(b)) and not near(slow_fingerprint(a), slow_fingerprint(b)) for a in said for b in said)
