"""Product codes against plain Lloyd rounds in Python's integers."""

import hashlib
import random

import numpy as np
import pytest

from freightloom.llm import codes


def plain(rows, parts, entries, rounds):
    """Rows (vector) in order of key: codes and errors by row, and the books' digest."""
    width = max(1, -(-max((len(v) for v in rows), default=0) // parts))
    rows = [v + [0] * (width * parts - len(v)) for v in rows]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda a, book: min((far(a, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(c[p], books[p])[1] for c in cut]
            books[p] = [[sum(x) // len(x) for x in zip(*mine)] if (mine := [c[p] for c, o in zip(cut, own) if o == k]) else e for k, e in enumerate(books[p])]
    last = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    text = ",".join(str(x) for b in books for e in b for x in e)
    return [(bytes(k for _, k in r).hex(), min(sum(d for d, _ in r), (1 << 63) - 1)) for r in last], hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("n,dims,most,parts,entries,rounds", [(150, 8, 6, 4, 16, 4), (60, 7, 1000, 4, 256, 3), (90, 3, 2, 2, 8, 5), (40, 4, 1 << 45, 4, 5, 4), (1, 4, 9, 4, 256, 4), (50, 8, 3, 1, 7, 0)])
def test_codes_equal_plain_rounds(spark, n, dims, most, parts, entries, rounds):
    rnd = random.Random(n)
    vectors = [[rnd.randint(-most, most) for _ in range(rnd.choice([dims, dims, dims - 1]))] for _ in range(n)]
    vectors[n // 2] = list(vectors[0])
    rows = [(k, v, "own", 5) for k, v in enumerate(vectors)]
    rnd.shuffle(rows)
    done = codes.fitted(spark.createDataFrame([*rows, (n, None, "null", 1)], "vec_id long, v array<long>, code string, error long").repartition(3), parts=parts, entries=entries, rounds=rounds)
    want, digest = plain(vectors, parts, entries, rounds)
    got = {r["vec_id"]: (bytes(r["_code"]).hex(), r["_error"]) for r in done.rows.collect()}
    assert got == dict(enumerate(want)) and done.books.digest() == digest
    assert done.compared[0] == n * parts * min(n, entries) and all(c <= done.compared[0] for c in done.compared)


def test_active_entries_give_the_whole_scan(spark):
    """What is compared falls when entries come to rest, and nothing else changes."""
    rng = np.random.default_rng(4)
    rows, old = rng.integers(-9, 9, (400, 3)).astype(float), rng.integers(-9, 9, (12, 3))
    code, dist, _ = codes.assigned(rows, old)
    for flags in ([], [3], [0, 5, 11], list(range(12))):
        new, moved = old.copy(), np.zeros(12, bool)
        moved[flags] = True
        new[flags] += rng.integers(-2, 3, (len(flags), 3))
        want = codes.assigned(rows, new)
        got = codes.assigned(rows, new, code, dist, moved)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
        assert got[2] <= want[2] and (got[2] == 0) == (not flags)


def test_repeated_and_null_keys_and_label_errors(spark):
    rows = [(1, [0, 0, 0, 0], None), (1, [9, 9, 9, 9], 1), (None, [8, 8, 8, 8], 1), (2, [1, 0, 0, 0], 2)]
    done = codes.fitted(spark.createDataFrame(rows, "vec_id long, v array<long>, label int"), entries=2, rounds=0)
    got = sorted(((r["vec_id"], r["label"], bytes(r["code"]).hex(), r["error"], r["label_error"]) for r in codes.with_label_errors(done.rows).collect()), key=str)
    assert got == sorted([(1, None, "00000000", 0, 0), (1, 1, "01010101", 0, 4), (None, 1, "01010101", 4, 4), (2, 2, "00000000", 1, 1)], key=str)
    empty = codes.fitted(spark.createDataFrame([], "vec_id long, v array<long>, label int"))
    assert empty.rows.collect() == [] and empty.books.digest() == hashlib.sha256(b"").hexdigest()
