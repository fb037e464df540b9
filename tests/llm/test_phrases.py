"""Phrase mining against counting every n-gram of every text."""

import collections
import random
import re

import numpy as np
import pytest

from freightloom.llm import phrases


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def counted(rows, least, longest):
    """{lang: {phrase: count}} of frequent phrases, words counted, and where a phrase occurs."""
    times, words, seen = collections.defaultdict(collections.Counter), collections.Counter(), collections.defaultdict(set)
    for key, text, lang in rows:
        for piece in re.finditer("[^.,;:!?\x0a-\x0d]+", fold(text)):
            found = list(re.finditer("[^\x20\x09]+", piece[0]))
            words[lang or "und"] += len(found)
            for n in range(1, longest + 1):
                for i in range(len(found) - n + 1):
                    phrase = " ".join(m[0] for m in found[i : i + n])
                    times[lang or "und"][phrase] += 1
                    seen[lang or "und", phrase].add((key, len(fold(text)[: piece.start() + found[i].start()].encode())))
    return {a: {p: n for p, n in c.items() if n >= least} for a, c in times.items()}, words, seen


def ranked(rows, least, longest, percent, top):
    frequent, words, _ = counted(rows, least, longest)
    out = []
    for lang, f in frequent.items():
        kept = []
        for phrase, a in f.items():
            w = phrase.split(" ")
            if len(w) < 2:
                continue
            longer = [q for q in f if len(q.split(" ")) > len(w) and any(q.split(" ")[i : i + len(w)] == w for i in range(len(q.split(" "))))]
            if any(100 * f[q] >= percent * a for q in longer):
                continue
            score, k = min(((1000 * a * words[lang]) // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w)))
            kept.append((-score, -a, phrase.encode(), f[" ".join(w[:k])], f[" ".join(w[k:])]))
        out.extend((lang, rank, p.decode(), -a, left, right, words[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1))
    return sorted(out)


def made(seed, n):
    rnd = random.Random(seed)
    vocabulary = ["a", "B", "cd", "é", "日本", "e-f", "''", "Zz"]
    gaps = [" "] * 8 + ["  ", "\t", ", ", ".", "\n", " \x0b"]
    texts = ["".join(rnd.choice(vocabulary) + rnd.choice(gaps) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    return [(k, t, rnd.choice(["en", "fr", None])) for k, t in enumerate(texts)] + [(900, None, "en"), (901, "", None), (902, " \t.,", "fr"), (None, "a b a b a b", "en"), (7, "cd cd cd cd cd cd", "en"), (7, "cd cd cd cd cd cd", "en")]


@pytest.mark.parametrize("least,longest,percent,top", [(4, 5, 100, 2000), (3, 3, 60, 7), (2, 2, 100, 10), (3, 6, 100, 50)])
def test_collocations_equal_brute_force(spark, least, longest, percent, top):
    rows = made(least, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).selectExpr("*", "1 AS phrase", "2 AS score", "3 AS key")
    got = phrases.collocations(docs, least=least, longest=longest, percent=percent, top=top)
    want = ranked(rows, least, longest, percent, top)
    assert want and sorted(tuple(r)[:8] for r in got.collect()) == want


def test_frequent_phrases_and_their_places(spark):
    rows = made(1, 80)
    frequent, _, seen = counted(rows, 3, 4)
    got = phrases.frequent(spark.createDataFrame(rows, "doc_id long, text string, lang string"), least=3, longest=4).collect()
    assert {(r["lang"], r["phrase"]): r["times"] for r in got} == {(a, p): n for a, f in frequent.items() for p, n in f.items()}
    assert all((r["seen_in"], r["seen_at"]) in seen[r["lang"], r["phrase"]] and r["words"] == r["phrase"].count(" ") + 1 for r in got)
    assert phrases.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_small_batches_change_nothing(spark):
    """Fingerprints of one phrase are the same wherever it stands."""
    texts = [b"x y z", b"aa x y z. x y z", b"", b"y z x y z"]
    salts = np.zeros(4, np.uint64)
    one = phrases.Tokens.of(texts, salts)
    at, keys = one.grams(3)
    said = collections.defaultdict(set)
    for i, k in zip(at, keys):
        said[one.phrases(np.array([i]), np.array([3]))[0]].add(int(k))
    for k in range(4):
        alone = phrases.Tokens.of(texts[k : k + 1], salts[:1])
        for i, key in zip(*alone.grams(3)):
            said[alone.phrases(np.array([i]), np.array([3]))[0]].add(int(key))
    assert said.keys() >= {b"x y z", b"aa x y", b"z x y"} and b"z x" not in said and all(len(v) == 1 for v in said.values())


def test_collisions_are_told_apart_by_text():
    t = phrases.Tokens.of([b"one two one three two", b"one"], np.zeros(2, np.uint64))
    t.word[:] = 5
    own = t.identities()
    assert [len({a == b for a, b in zip(own, x)}) for x in [own]] == [1]
    assert own[0] == own[2] == own[5] and own[1] == own[4] and len(set(own.tolist())) == 3
    first, times = phrases.grouped(np.zeros(6, np.uint64), own[:, None])
    assert sorted(zip(t.phrases(first, np.ones(3, int)), times.tolist())) == [(b"one", 3), (b"three", 1), (b"two", 2)]
    assert t.same(np.array([0, 0, 0]), np.array([2, 1, 3])).tolist() == [True, False, False]


def test_a_sieve_misses_nothing(spark):
    keys = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 3000)
    held = phrases.Sieve.of(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert held(keys.view(np.uint64)).all()
    others = np.random.default_rng(3).integers(0, 1 << 64, 30000, np.uint64)
    assert held(others).mean() < 0.02
    assert not phrases.Sieve.of(spark.createDataFrame([], "key long"))(others).any()


def test_texts_are_read_in_small_parts():
    """A worker's memory follows the bytes that it looks at together: about a megabyte, and one longer text."""
    import pyarrow as pa

    from freightloom.llm import phrases

    body = [b"one two three " * 20_000, None, b"four " * 200_000, b"five " * 10]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 4, pa.int64()), pa.array(body, pa.binary())], names=["salt", "body"])
    parts = list(phrases.batches_of(iter([batch])))
    assert sum(p.num_rows for p, _ in parts) == 4 and sum(len(t.word) for _, t in parts) == 60_000 + 200_000 + 10
    assert all(len(t.buf) <= 1 << 20 or p.num_rows == 1 for p, t in parts)
