"""Reports of fitted models against plain figures of the same predictions, and queries without SQL by their values."""

import collections
import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightloom.operators import boosting as B
from freightloom.operators import models as M
from freightloom.operators import stored as K
from freightloom.operators.scratch import new_path
from freightloom.plans import QUERIES, bundles
from freightloom.plans.models import FEATURES, _split

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def rows(spark, name):
    return QUERIES[name].build(spark, FOLDER).collect()


def figures(got):
    return {(r["section"], r["part"], r["metric"]): r["value"] for r in got}


def plain_binary(scores):
    """(p, y, key) by falling p: area under the curve, average precision, Brier score, top tenth, deciles."""
    ordered = sorted(scores, key=lambda r: (-r[0], r[2]))
    y = np.array([r[1] for r in ordered])
    p = np.array([r[0] for r in ordered])
    n, pos = len(y), y.sum()
    by = collections.defaultdict(lambda: [0, 0])
    for a, b in zip(p, y):
        by[a][int(b)] += 1
    above, pairs, seen, hits, ap = 0, 0.0, 0, 0, 0.0
    for score in sorted(by, reverse=True):
        no, yes = by[score]
        pairs += no * (above + yes / 2)
        above += yes
        seen, hits = seen + no + yes, hits + yes
        ap += yes * hits / seen
    top = y[: max(1, round(n * 0.1))]
    decile = np.ceil(np.arange(1, n + 1) / n * 10).astype(int)
    out = {"roc_auc": pairs / (pos * (n - pos)), "pr_auc": ap / pos, "brier": ((p - y) ** 2).mean(), "rate": y.mean(), "n": n, "precision": top.mean(), "capture": top.sum() / pos, "lift": top.mean() / y.mean()}
    return out, {k: y[decile == k].mean() for k in range(1, 11)}


def test_eval_commit(spark):
    got = figures(rows(spark, "eval_commit"))
    scores = bundles.commit_scores(spark, FOLDER).collect()
    for part in ("line_p", "trees_p"):
        want, deciles = plain_binary([(r[part], r["returned"], r["line"]) for r in scores])
        for metric, value in want.items():
            section = "top" if metric in ("precision", "capture", "lift") else "ranks"
            assert got[section, part, metric] == pytest.approx(value, abs=1e-4), (part, metric)
        assert all(got["decile", f"{part}:{k}", "rate"] == pytest.approx(v, abs=1e-4) for k, v in deciles.items())


def test_eval_conformal(spark):
    got = figures(rows(spark, "eval_conformal"))
    late, later = (df.collect() for df in bundles.conformal_scores(spark, FOLDER))
    for part in ("raw", "calibrated"):
        assert got["brier", part, "score"] == pytest.approx(np.mean([(r[part] - r["returned"]) ** 2 for r in later]), abs=1e-4)
    hits = sorted(r["calibrated"] for r in late if r["returned"] == 1)
    for a in (0.05, 0.1, 0.2):
        k = math.floor((len(hits) + 1) * a - 1)
        t = hits[k] if k >= 0 else -math.inf
        flagged = [r["calibrated"] >= t for r in later]
        caught = [f for f, r in zip(flagged, later) if r["returned"] == 1]
        assert got["threshold", str(a), "flag_rate"] == pytest.approx(np.mean(flagged), abs=1e-4)
        assert got["threshold", str(a), "capture"] == pytest.approx(np.mean(caught), abs=1e-4)


def test_eval_uplift(spark):
    got = figures(rows(spark, "eval_uplift"))
    scores = bundles.uplift_table(spark, FOLDER).collect()

    def gain(some):
        arms = [[r["returned"] for r in some if r["treated"] == t] for t in (0, 1)]
        return np.mean(arms[0]) - np.mean(arms[1]) if all(arms) else 0.0

    for name in M.UPLIFT:
        ordered = sorted(scores, key=lambda r: (-r[name], r["line"]))
        for share in (0.1, 0.2, 1 / 3):
            top = ordered[: round(len(ordered) * share)]
            part = f"{name}:{share:.2f}"
            assert got["policy", part, "treated"] == len(top)
            assert got["policy", part, "net"] == pytest.approx(gain(top) * len(top) * bundles.SAVED - len(top) * bundles.SPENT, abs=1e-3)
        for k in range(5):
            some = [r for i, r in enumerate(ordered, 1) if math.ceil(i / len(ordered) * 5) == k + 1]
            assert got["calibration", f"{name}:{k + 1}", "said"] == pytest.approx(np.mean([r[name] for r in some]), abs=1e-4)
            assert got["calibration", f"{name}:{k + 1}", "did"] == pytest.approx(gain(some), abs=1e-4)
    assert all(math.isfinite(got["area", name, "auuc"]) for name in M.UPLIFT)


def test_stored_models_score_in_another_session(spark):
    train, test = _split(spark, FOLDER)
    trees = B.fit(train, FEATURES, "returned", rounds=2)
    line = M.logistic(train, FEATURES, "returned")
    other = spark.newSession()
    for model, said in ((trees, test.withColumn("p", trees.chances()[0])), (line, M.probability(line, test))):
        path = K.save(model, new_path(spark), train, FEATURES, "returned", {"who": "test"})
        back = K.load(other, path)
        assert back.features == {f: "double" for f in FEATURES} and back.label == "returned" and back.notes == {"who": "test"}
        again = {r["line"]: r["p"] for r in back.score(_split(other, FOLDER)[1]).select("line", "p").collect()}
        assert again == {r["line"]: r["p"] for r in said.select("line", "p").collect()}
        with pytest.raises(ValueError, match="no column price"):
            back.score(test.drop("price"))
        with pytest.raises(ValueError, match="price is string"):
            back.score(test.withColumn("price", F.col("price").cast("string")))


def test_loop_queries(spark):
    contract = rows(spark, "loop_train")
    assert [r["name"] for r in sorted(contract, key=lambda r: r["place"]) if r["part"] == "feature"] == FEATURES
    both = rows(spark, "ml_save_load")
    line = {r["line"]: r["p"] for r in rows(spark, "ml_logistic")}
    assert {r["line"]: r["p_line"] for r in both} == line and all(0 < r["p_trees"] < 1 for r in both)
    day = {r["line"]: r for r in rows(spark, "loop_score_day")}
    assert day.keys() == line.keys()
    # The loop spends its money on the first rows that fit, in order of each policy.
    got = {r["policy"]: (r["acted"], r["caught"]) for r in rows(spark, "alloc_run_loop")}
    for name, worth in (("risk", lambda r: r["p"]), ("value", lambda r: r["p"] * r["price"])):
        top = sorted(day.values(), key=lambda r: (-worth(r), r["line"]))[:100]
        assert got[name] == (len(top), sum(r["returned"] for r in top))


def test_driver_ranking(spark):
    parts = collections.defaultdict(list)
    train, test = _split(spark, FOLDER)
    for r in M.contributions(M.logistic(train, FEATURES, "returned"), test, "line", FEATURES).collect():
        parts[r["feature"]].append(abs(r["contribution"]))
    total = sum(np.mean(v) for v in parts.values())
    got = {r["feature"]: (r["strength"], r["share"]) for r in rows(spark, "agg_driver_ranking")}
    assert got.keys() == parts.keys()
    assert all(got[f] == (pytest.approx(np.mean(v), abs=1e-4), pytest.approx(np.mean(v) / total, abs=1e-4)) for f, v in parts.items())


def test_hash_split(spark):
    got = rows(spark, "hash_split_crc32")
    key = next(c for c in got[0].asDict() if c.endswith("key"))
    sides = {r[key]: tuple(v for k, v in sorted(r.asDict().items()) if k != key) for r in got}
    by = collections.defaultdict(set)
    for k, side in sides.items():
        by[zlib.crc32(str(k).encode()) % 100].add(side)
    assert sides and all(len(s) == 1 for s in by.values())


def test_coupled_detector_and_its_score(spark):
    from freightloom.plans.decisions import standardised
    from freightloom.plans.panels import user_days

    days = collections.defaultdict(list)
    for r in standardised(spark, FOLDER).collect():
        days[r["day"]].append((str(r["user_id"]), r["z"], r["weight"]))
    state, want = collections.defaultdict(float), {}
    for day in sorted(days):
        votes = [(max(-3.0, min(3.0, z)), w) for lane, z, w in days[day] if state[lane] < 1.0]
        total = sum(w for _, w in votes)
        shared = sum(z * w for z, w in votes) / total if total else 0.0
        for lane, z, _ in days[day]:
            s = max(0.0, state[lane] + z - shared - 0.25)
            want[day, lane] = s
            state[lane] = 0.0 if s >= 2.0 else s
    got = {(r["day"], r["lane"]): r["s"] for r in rows(spark, "cusum_detect")}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-4) for k, v in want.items())
    onsets = {}
    for r in user_days(spark, FOLDER).where("failed = 1").collect():
        onsets[r["user_id"]] = min(onsets.get(r["user_id"], r["day"]), r["day"])
    found = {u: min((d for (d, lane), s in want.items() if lane == str(u) and d >= day and s >= 2.0), default=None) for u, day in onsets.items()}
    delays = [(d - onsets[u]).days for u, d in found.items() if d]
    score = rows(spark, "score_detector")[0]
    assert (score["onsets"], score["found"]) == (len(onsets), len(delays)) and score["mean_delay"] == (pytest.approx(np.mean(delays), abs=1e-4) if delays else None)


def test_policies_and_uplift_scores_have_a_row_each(spark):
    uplift = rows(spark, "ml_uplift_score")
    by = collections.defaultdict(list)
    for r in uplift:
        by[r["method"]].append((r["rank"], r["score"]))
    assert set(by) == set(M.UPLIFT)
    for some in by.values():
        some.sort()
        assert [k for k, _ in some] == list(range(1, len(some) + 1)) and all(a[1] >= b[1] for a, b in zip(some, some[1:]))
    maint = rows(spark, "ml_gbt_maint")
    assert maint and len({r["trees"] for r in maint}) == 1 and 1 <= maint[0]["trees"] <= 8
    scores = rows(spark, "ml_score_policies")
    assert {(r["user_id"], r["day"]) for r in scores} == {(r["user_id"], r["day"]) for r in maint}
    assert all(0 < r["line"] < 1 and 0 < r["trees"] < 1 for r in scores)


def test_monotone_prices(spark):
    by = collections.defaultdict(dict)
    for r in rows(spark, "ml_monotone_price"):
        by[r["line"]][r["m"]] = r["p"]
    assert by and all(p[0.9] >= p[1.0] >= p[1.1] for p in by.values())


def test_contributions_add_up_in_queries(spark):
    """Shapley values of a row add up to its margin less one base, the same for all rows."""
    from freightloom.operators import shapley as H

    train, test = _split(spark, FOLDER)
    model = M.boosted_value(train, ["l_quantity", "l_discount", "weekday"], "price", trees=6)
    said = {r["line"]: r["prediction"] for r in model.transform(test).collect()}
    sums = collections.defaultdict(float)
    for r in rows(spark, "ml_contrib_eta"):
        sums[r["line"]] += r["contribution"]
    base = H.base_values(H.of_pipeline(model, ["l_quantity", "l_discount", "weekday"]))[0]
    assert sums.keys() == said.keys() and all(sums[k] + base == pytest.approx(said[k], abs=1e-3) for k in said)
