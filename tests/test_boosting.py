"""Boosted trees, their Shapley values and quantiles of groups, against enumeration and truths that are known."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightloom.functions import scalar as S
from freightloom.operators import boosting as B
from freightloom.operators import models as M
from freightloom.operators import ranked as R
from freightloom.operators import shapley as H


@pytest.fixture(scope="module")
def rows(spark):
    """A chance that is high in the middle of a and falls in b by steps; three classes by a ring; a value with noise."""
    key = F.col("id")
    df = spark.range(4000).select("id", *[S.uniform(key, c).alias(c) for c in "abc"], S.uniform(key, "draw").alias("u"))
    odds = F.when(F.abs(F.col("a") - 0.5) < 0.25, 2.0).otherwise(-2.0) + F.when(F.col("b") > 0.6, -1.5).otherwise(0.5)
    df = df.withColumn("y", (F.col("u") < 1 / (1 + F.exp(-odds))).cast("double"))
    far = F.sqrt(F.pow(F.col("a") - 0.5, F.lit(2)) + F.pow(F.col("b") - 0.5, F.lit(2)))
    df = df.withColumn("class", F.when(far < 0.22, 0.0).when(far < 0.4, 1.0).otherwise(2.0))
    return df.withColumn("value", 4 * F.abs(F.col("a") - 0.5) + (F.col("u") - 0.5)).cache()


def auc(df, score, label="y"):
    return R.roc_auc(df.withColumn(score, F.round(score, 4)), score, F.col(label)).first()[0]


def test_logistic_boosting_beats_a_line_on_a_curve(rows):
    train, test = rows.where("id < 3000"), rows.where("id >= 3000")
    model = B.fit(train, ["a", "b", "c"], "y", rounds=8, depth=3)
    said = test.withColumn("p", model.chances()[0])
    line = M.probability(M.logistic(train, ["a", "b", "c"], "y"), test)
    assert auc(said, "p") > auc(line, "p") + 0.1
    assert model.rounds == 8 and all(a[0] > b[0] for a, b in zip(model.curve, model.curve[1:]))
    again = B.Ensemble.from_json(model.to_json())
    assert test.withColumn("q", again.chances()[0]).withColumn("p", model.chances()[0]).where("p <> q").isEmpty()


def tree_sum(model, row, output=0):
    total = model.start[output]
    for o, t in model.trees:
        if o == output:
            k = 0
            while t.feature[k] >= 0:
                x = row[t.feature[k]]
                k = t.low[k] if x is not None and x <= t.cut[k] else t.high[k]
            total += t.value[k]
    return total


def test_margins_are_walks_and_covers_are_counts(rows):
    model = B.fit(rows, ["a", "b"], "y", rounds=3, depth=2, every=2)
    got = rows.select("a", "b", model.margins()[0].alias("m")).limit(200).collect()
    assert all(math.isclose(r["m"], tree_sum(model, (r["a"], r["b"])), abs_tol=1e-12) for r in got)
    for _, t in model.trees:
        assert t.cover[0] == 4000
        for k in range(len(t.feature)):
            if t.feature[k] >= 0:
                assert t.cover[k] == t.cover[t.low[k]] + t.cover[t.high[k]]
    # The first tree's first split is the best of all by plain search over the same cuts.
    data = [(r["a"], r["b"], r["y"]) for r in rows.select("a", "b", "y").collect()]
    p = sum(r[2] for r in data) / len(data)

    def gain(f, cut):
        low, high = ([r[2] for r in data if (r[f] <= cut) == side] for side in (True, False))
        part = lambda ys: sum(p - y for y in ys) ** 2 / (len(ys) * p * (1 - p) + 1)
        return part(low) + part(high)

    cuts = B.bin_cuts(rows, ["a", "b"], 32)
    t = model.trees[0][1]
    assert gain(t.feature[0], t.cut[0]) == pytest.approx(max(gain(f, c) for f in range(2) for c in cuts[f]))


def test_monotone_on_a_grid_for_every_row(rows):
    free = B.fit(rows, ["a", "b"], "y", rounds=6)
    bound = B.fit(rows, ["a", "b"], "y", rounds=6, signs={"b": -1, "a": 1})
    grid = [k / 50 for k in range(51)]
    some = rows.select("a", "b").limit(60).collect()
    falls = lambda m: all(x >= y - 1e-12 for r in some for x, y in itertools.pairwise(tree_sum(m, (r["a"], g)) for g in grid))
    rises = lambda m: all(x <= y + 1e-12 for r in some for x, y in itertools.pairwise(tree_sum(m, (g, r["b"])) for g in grid))
    assert falls(bound) and rises(bound) and not rises(free)


def test_monotone_trees_beat_a_bounded_line_on_a_curve(rows):
    train, test = rows.where("id < 3000"), rows.where("id >= 3000")
    bound = test.withColumn("p", B.fit(train, ["a", "b"], "y", rounds=6, signs={"b": -1}).chances()[0])
    line = M.probability(M.monotone_logistic(train, ["a", "b"], "y", {"b": -1}), test)
    assert auc(bound, "p") > auc(line, "p") + 0.1


def test_softmax_beats_a_multinomial_line(rows):
    train, test = rows.where("id < 3000"), rows.where("id >= 3000")
    model = B.fit(train, ["a", "b", "c"], "class", loss="softmax", classes=3, rounds=6)
    chances = test.withColumn("chance", model.chances())
    assert chances.where(F.abs(F.aggregate("chance", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).isEmpty()
    said = chances.withColumn("said", F.array_position("chance", F.array_max("chance")) - 1)
    line = M.logistic(train, ["a", "b", "c"], "class").transform(test).withColumn("said", F.col("prediction"))

    def macro_f1(df):
        pairs = [(int(r["class"]), int(r["said"]), r["count"]) for r in df.groupBy("class", "said").count().collect()]
        out = []
        for k in range(3):
            hit, mine, theirs = (sum(n for c, s, n in pairs if f(c, s)) for f in (lambda c, s: c == s == k, lambda c, s: s == k, lambda c, s: c == k))
            out.append(2 * hit / (mine + theirs))
        return sum(out) / 3

    assert macro_f1(said) > macro_f1(line) + 0.2 and macro_f1(said) > 0.8


def test_rounds_from_a_validation_curve(rows):
    model, probe = B.fit_counted(rows.where("id < 3000"), ["a", "c"], "y", F.col("id") >= 2400, most=10, rate=0.8)
    best = B.best_rounds(probe)
    told = [c[1] for c in probe.curve]
    assert len(told) == 11 and told[best] == min(told) and model.rounds == max(1, best)
    assert model.trees[0][1].cover[0] == 3000 and probe.trees[0][1].cover[0] == 2400
    # What the curve says is the loss on the rows set apart.
    apart = rows.where("id between 2400 and 2999").select("y", probe.first(best).margins()[0].alias("m"))
    assert apart.agg(F.avg(F.log1p(F.exp(-F.col("m") * (2 * F.col("y") - 1))))).first()[0] == pytest.approx(told[best])


def test_pinball_quantiles_cover(rows):
    train, test = rows.where("id < 3000"), rows.where("id >= 3000")
    model = B.fit(train, ["a", "b"], "value", loss="pinball", alphas=[0.1, 0.5, 0.9], rounds=5, rate=0.6)
    q = test.withColumn("q", model.chances())
    covered, width, crossed = q.agg(F.avg(F.col("value").between(F.col("q")[0], F.col("q")[2]).cast("int")), F.avg(F.col("q")[2] - F.col("q")[0]), F.count_if(F.col("q")[0] > F.col("q")[1])).first()
    plain = R.quantiles(train, "value", [0.1, 0.9])
    assert 0.73 < covered < 0.87 and width < 0.8 * (plain[1] - plain[0]) and crossed == 0


def test_odd_rows(spark):
    schema = "a double, b double, y double"
    assert B.fit(spark.createDataFrame([], schema), ["a", "b"], "y").trees == []
    same = B.fit(spark.createDataFrame([(1.0, None, 1.0)] * 50, schema), ["a", "b"], "y", rounds=2)
    assert same.rounds == 2 and all(len(t.feature) == 1 for _, t in same.trees)
    rows = [(float(k % 7), float("nan") if k % 3 else None, float(k % 7 > 3)) for k in range(200)] + [(3.0, 1.0, None)]
    model = B.fit(spark.createDataFrame(rows, schema), ["a", "b"], "y", rounds=2, depth=1)
    assert model.trees[0][1].cover[0] == 200 and model.trees[0][1].feature[0] == 0


# ---- Shapley values --------------------------------------------------------------------------------------------------


def worth(tree, row, known, node=0):
    """A tree's mean value of a row whose features in `known` are known, by plain recursion."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    low, high = tree.low[node], tree.high[node]
    if f in known:
        return worth(tree, row, known, low if row[f] is not None and row[f] <= tree.cut[node] else high)
    n = tree.cover[low] + tree.cover[high]
    return (tree.cover[low] * worth(tree, row, known, low) + tree.cover[high] * worth(tree, row, known, high)) / n


def enumerated(model, row, width, output=0):
    out = []
    for i in range(width):
        others, total = [k for k in range(width) if k != i], 0.0
        for size in range(width):
            weight = math.factorial(size) * math.factorial(width - size - 1) / math.factorial(width)
            for known in itertools.combinations(others, size):
                total += weight * sum(worth(t, row, {*known, i}) - worth(t, row, set(known)) for o, t in model.trees if o == output)
        out.append(total)
    return out


def random_tree(rnd, width, depth):
    t = B.Tree()

    def grow(left, cover):
        k = t.add(rnd.gauss(0, 1), cover)
        if left and rnd.random() < 0.85 and cover >= 2:
            own = rnd.randint(1, int(cover) - 1)
            f, cut = rnd.randrange(width), rnd.choice([0.2, 0.4, 0.5, 0.8])
            sides = grow(left - 1, float(own)), grow(left - 1, cover - own)
            t.feature[k], t.cut[k], t.low[k], t.high[k] = f, cut, *sides
        return k

    grow(depth, 100.0)
    return t


@pytest.mark.parametrize("seed,width,depth,trees", [(1, 3, 3, 4), (2, 5, 4, 3), (3, 2, 6, 2), (4, 4, 5, 1), (5, 1, 2, 2)])
def test_shapley_values_equal_enumeration(spark, seed, width, depth, trees):
    rnd = random.Random(seed)
    names = [f"f{k}" for k in range(width)]
    model = B.Ensemble("softmax", names, [0.5, -1.0], [(k % 2, random_tree(rnd, width, depth)) for k in range(2 * trees)])
    data = [tuple(rnd.choice([0.1, 0.2, 0.45, 0.5, 0.9, None, float("nan")]) for _ in names) for _ in range(25)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(data)], "id long, " + ", ".join(f"{n} double" for n in names))
    got = {(r["id"], r["output"], r["feature"]): r["contribution"] for r in H.shapley(model, df, "id", ["one", "two"]).collect()}
    bases = H.base_values(model)
    for k, row in enumerate(data):
        plain = [None if x is None or math.isnan(x) else x for x in row]
        for o, name in enumerate(("one", "two")):
            want = enumerated(model, plain, width, o)
            mine = [got[k, name, f] for f in names]
            assert np.allclose(mine, want, atol=1e-12)
            assert sum(mine) + bases[o] == pytest.approx(tree_sum(model, plain, o))
    assert len(got) == len(data) * 2 * width and H.shapley(model, df.limit(0), "id").collect() == []


def test_shapley_values_of_fitted_models_add_up(rows):
    features = ["a", "b", "c"]
    own = B.fit(rows, features, "class", loss="softmax", classes=3, rounds=2)
    spark_model = M.boosted_value(rows, features, "value", trees=4)
    for model, margins in ((own, own.margins()), (H.of_pipeline(spark_model, features), None)):
        total = H.shapley(model, rows, "id").groupBy("id").pivot("output", [str(k) for k in range(len(model.start))]).agg(F.sum("contribution"))
        out = (rows if margins else spark_model.transform(rows)).join(total, "id")
        said = margins or [F.col("prediction")]
        for k, (m, base) in enumerate(zip(said, H.base_values(model))):
            assert out.agg(F.max(F.abs(m - F.col(str(k)) - base))).first()[0] < 1e-9
    # The base is the mean over the training rows where covers count them.
    mean = spark_model.transform(rows).agg(F.avg("prediction")).first()[0]
    assert H.base_values(H.of_pipeline(spark_model, features))[0] == pytest.approx(mean, abs=0.05)


# ---- quantiles of groups ---------------------------------------------------------------------------------------------


def test_group_quantiles_are_exact(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([0, 1]), rnd.choice([rnd.gauss(0, 5), 1.0, 2.0, None])) for _ in range(900)] + [("only", 0, None), ("one", 1, 7.5)]
    df = spark.createDataFrame(rows, "g string, h int, v double")
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["h"]): [r[f"q{k}"] for k in range(5)] for r in R.group_quantiles(df, ["g", "h"], "v", qs, [f"q{k}" for k in range(5)]).collect()}
    groups = {}
    for g, h, v in rows:
        groups.setdefault((g, h), []).extend([v] if v is not None else [])
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        if vs:
            assert np.allclose(got[k], np.quantile(vs, qs))
        else:
            assert got[k] == [None] * 5


def test_rows_of_the_same_bins_are_counted_once(spark, monkeypatch):
    """However many rows there are, classes are learned from a table of bins and classes, with the same trees."""
    sizes = []
    plain = B.written
    monkeypatch.setattr(B, "written", lambda df: (out := plain(df), sizes.append((set(df.columns), out.count())))[0])
    df = spark.range(600).select((F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 5 > 2).cast("double").alias("y"))
    once = B.fit(df, ["a"], "y", rounds=2, least_rows=1)
    many = B.fit(df.unionAll(df), ["a"], "y", rounds=2, least_rows=1, l2=2.0)
    assert [n for columns, n in sizes if "m0" in columns] == [5, 5]
    assert [t.cut for _, t in once.trees] == [t.cut for _, t in many.trees]
    assert many.trees[0][1].cover == [2 * c for c in once.trees[0][1].cover]
    assert many.curve[-1][0] == pytest.approx(once.curve[-1][0])
