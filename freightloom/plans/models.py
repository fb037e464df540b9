"""Models fitted and applied on the tables. Estimates have no SQL: engines' optimisers differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightloom.functions import scalar as S
from freightloom.operators import boosting as B
from freightloom.operators import models as M
from freightloom.operators import ranked as R
from freightloom.operators import shapley as H
from freightloom.operators import stored as K
from freightloom.operators.scratch import new_path, written
from freightloom.plans.registry import query, rounded, table

FEATURES = ["l_quantity", "price", "l_discount", "l_tax", "weekday", "is_open"]


def lines(spark, d) -> DataFrame:
    """Lines with model features and labels; the last fifth by ship date is the test part."""
    df = table(spark, d, "lineitem").withColumn("at", F.unix_micros(F.col("l_shipdate").cast("timestamp")))
    cut, late = R.quantiles(df, "at", [0.8, 0.68], laid=True)
    returned = (F.col("l_returnflag") == "R").cast("double")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return df.select(
        key.alias("line"), "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"), "l_discount", "l_tax", S.weekday(F.col("l_shipdate")).cast("double").alias("weekday"),
        (F.col("l_linestatus") == "O").cast("double").alias("is_open"), returned.alias("returned"), (F.col("at") > F.lit(cut)).alias("is_test"), (F.col("at") > F.lit(late)).alias("is_late"),
        (S.uniform(key, "arm") < 0.5).cast("double").alias("treated"),
    )


def _split(spark, d) -> tuple[DataFrame, DataFrame]:
    df = lines(spark, d)
    return df.where("NOT is_test"), df.where("is_test")


@query()
def ml_logistic(spark, d):
    train, test = _split(spark, d)
    return rounded(M.probability(M.logistic(train, FEATURES, "returned"), test).select("line", "returned", "p"))


@query()
def ml_gbt_binary(spark, d):
    train, test = _split(spark, d)
    return rounded(M.probability(M.boosted(train, FEATURES, "returned", F.col("is_late"), trees=8), test).select("line", "returned", "p"))


@query()
def ml_linear(spark, d):
    train, test = _split(spark, d)
    features = [f for f in FEATURES if f != "price"]
    return rounded(M.predicted(M.linear(train, features, "price"), test, "forecast").select("line", "price", "forecast"))


@query()
def ml_quantile_gbt(spark, d):
    """Quantiles of the price by boosted trees, in order."""
    train, test = _split(spark, d)
    return rounded(M.boosted_quantiles(train, test.select("line", "l_quantity", "l_discount", "weekday", "price"), ["l_quantity", "l_discount", "weekday"], "price", [0.1, 0.5, 0.9]).select("line", "price", "q_10", "q_50", "q_90"))


@query()
def ml_quantile_lane(spark, d):
    """Quantiles of a lane's week from its recent mean and season, by boosted trees."""
    from freightloom.operators.windows import trailing_mean
    from freightloom.plans.variants import lane_weeks

    w = trailing_mean(lane_weeks(spark, d), ["lane"], "week", "n", 28, 2, "mean_4").where("mean_4 IS NOT NULL")
    w = w.select("lane", "week", F.col("n").cast("double").alias("n"), "mean_4", F.weekofyear("week").cast("double").alias("season"))
    late = F.col("week") >= F.lit(_day_at(w, "week", 0.8))
    return rounded(M.boosted_quantiles(w.where(~late), w.where(late), ["mean_4", "season"], "n", [0.1, 0.5, 0.9], rounds=2).select("lane", "week", "n", "q_10", "q_50", "q_90"))


def _day_at(df: DataFrame, day: str, share: float):
    """The day up to which that share of the rows lies."""
    from datetime import date, timedelta

    number = R.quantiles(df.select(F.unix_date(day).alias("n")), "n", [share])[0]
    return date(1970, 1, 1) + timedelta(days=round(number or 0))


SENSORS = ["n", "total", "failed"]


def sensor_days(spark, d) -> DataFrame:
    """User-days with what they show, and whether one with an error follows within a week; the last third of the rows is
    the test part, the last sixth before it is late."""
    from freightloom.operators.joins import asof_after
    from freightloom.plans.panels import user_days

    u = user_days(spark, d)
    fails = u.where("failed = 1").select("user_id", F.date_sub("day", 1).alias("next"))
    df = asof_after(u, fails, ["user_id"], "day", "next")
    soon = F.coalesce(F.datediff("next", "day") < 7, F.lit(False)).cast("double")
    df = df.select("user_id", "day", F.col("n").cast("double").alias("n"), "total", F.col("failed").cast("double").alias("failed"), soon.alias("soon"))
    return df.withColumns({"is_test": F.col("day") > F.lit(_day_at(df, "day", 2 / 3)), "is_late": F.col("day") > F.lit(_day_at(df, "day", 0.55))})


@query()
def ml_gbt_maint(spark, d):
    """Does a user-day with an error follow within a week? As many trees as serve on the late part, fitted on both."""
    df = sensor_days(spark, d)
    model, probe = B.fit_counted(df.where("NOT is_test"), SENSORS, "soon", F.col("is_late"), most=8, rate=0.4)
    out = df.where("is_test").withColumns({"risk": model.chances()[0], "trees": F.lit(model.rounds), "probe_loss": F.lit(float(probe.curve[B.best_rounds(probe)][1] or 0.0))})
    return rounded(out.select("user_id", "day", "soon", "risk", "trees", "probe_loss"))


@query()
def ml_score_policies(spark, d):
    """A score for each policy on the same rows: by age of the last error, by use, by a line, by trees."""
    df = sensor_days(spark, d)
    train, test = df.where("NOT is_test"), df.where("is_test")
    trees = B.fit(train, SENSORS, "soon", rounds=4)
    scored = M.probability(M.logistic(train, SENSORS, "soon"), test, "line").withColumn("trees", trees.chances()[0])
    return rounded(scored.select("user_id", "day", "soon", F.col("failed").alias("rule"), F.col("n").alias("use"), "line", "trees"))


@query()
def ml_pair_scorer(spark, d):
    """Candidate pairs scored by how likely they are the same, from their distances."""
    from freightloom.plans.matching import matched_pairs

    pairs = matched_pairs(spark, d).select("label", "point", F.col("gap").cast("double").alias("gap"), F.pmod(F.abs(F.col("label") - F.col("point")), F.lit(7)).cast("double").alias("apart"), (F.col("label") == F.col("point")).cast("double").alias("y"))
    pairs = written(pairs)  # the fit reads them many times
    return rounded(M.probability(M.logistic(pairs, ["gap", "apart"], "y"), pairs, "score").select("label", "point", "y", "score"))


@query()
def ml_predict_accept(spark, d):
    """The chance of a return at three prices of each line."""
    train, test = _split(spark, d)
    model = M.logistic(train, FEATURES, "returned")
    priced = test.select("line", *[f for f in FEATURES if f != "price"], F.col("price").alias("own"), F.explode(F.lit([0.9, 1.0, 1.1])).alias("m")).withColumn("price", F.col("own") * F.col("m"))
    return rounded(M.probability(model, priced).select("line", "m", "p"))


@query()
def ml_isotonic_apply(spark, d):
    """Calibration learned on early lines and applied to late ones."""
    train, test = _split(spark, d)
    model = M.logistic(train, FEATURES, "returned")
    early, late = M.probability(model, train), M.probability(model, test)
    return rounded(M.isotonic(early, "p", "returned", late).select("line", "p", "calibrated"))


@query()
def ml_isotonic(spark, d):
    train, test = _split(spark, d)
    model = M.logistic(train.where("NOT is_late"), FEATURES, "returned")
    late = M.probability(model, train.where("is_late"))
    return rounded(M.isotonic(late, "p", "returned", M.probability(model, test)).select("line", "p", "calibrated"))


@query()
def ml_contrib_linear(spark, d):
    train, test = _split(spark, d)
    return rounded(M.largest_contributions(M.contributions(M.logistic(train, FEATURES, "returned"), test, "line", FEATURES), "line", 3))


@query()
def agg_driver_ranking(spark, d):
    train, test = _split(spark, d)
    return rounded(M.driver_ranking(M.contributions(M.logistic(train, FEATURES, "returned"), test, "line", FEATURES)))


@query()
def ml_uplift_fit(spark, d):
    df = lines(spark, d)
    out = M.uplift_scores(df, ["l_quantity", "price", "l_discount", "l_tax"], "treated", "returned", F.pmod(F.xxhash64("line"), F.lit(4)))
    return rounded(out.select("line", "treated", *M.UPLIFT))


@query()
def ml_uplift_score(spark, d):
    """Each row's score by each way of saying who should be treated, and its place among all by that score."""
    out = M.uplift_scores(lines(spark, d), ["l_quantity", "price", "l_discount", "l_tax"], "treated", "returned", F.pmod(F.xxhash64("line"), F.lit(4)))
    long, out = None, written(out.select("line", *M.UPLIFT))  # ranked four times
    for name in M.UPLIFT:
        ranked = R.running(out.select("line", F.col(name).alias("score")), [F.desc("score"), F.col("line")]).select("line", F.lit(name).alias("method"), "score", "rank")
        long = ranked if long is None else long.unionByName(ranked)
    return rounded(long)


def _parts(model, df: DataFrame, features: list[str]) -> DataFrame:
    """Exact Shapley values of the trees at the end of a pipeline."""
    return H.shapley(H.of_pipeline(model, features), df, "line").drop("output")


def _tree_parts(spark, d, label: str, features: list[str], value: bool) -> DataFrame:
    train, test = _split(spark, d)
    model = M.boosted_value(train, features, label, trees=6) if value else M.boosted(train, features, label, trees=6)
    return rounded(_parts(model, test, features))


@query()
def ml_contrib_tree(spark, d):
    """What each feature adds to a line's margin in boosted trees."""
    return _tree_parts(spark, d, "returned", FEATURES, False)


@query()
def ml_contrib_eta(spark, d):
    return _tree_parts(spark, d, "price", ["l_quantity", "l_discount", "weekday"], True)


@query()
def ml_contrib_order(spark, d):
    return _tree_parts(spark, d, "is_open", ["l_quantity", "price", "l_discount"], False)


@query()
def ml_contrib_volume(spark, d):
    return _tree_parts(spark, d, "l_quantity", ["price", "weekday"], True)


@query()
def ml_contrib_fleet(spark, d):
    """What each sensor adds to a user-day's margin."""
    from freightloom.plans.panels import user_days

    u = user_days(spark, d).select(F.concat_ws("-", "user_id", "day").alias("line"), F.col("n").cast("double").alias("n"), "total", F.col("failed").cast("double").alias("failed"))
    return rounded(_parts(M.boosted(u, ["n", "total"], "failed", trees=6), u, ["n", "total"]))


def _class_parts(spark, d) -> DataFrame:
    """Shapley values of each class's score in trees boosted for three classes."""
    train, test = _split(spark, d)
    of = F.when(F.col("returned") == 1, 0.0).when(F.col("is_open") == 1, 1.0).otherwise(2.0)
    features = ["l_quantity", "price", "l_discount"]
    model = B.fit(train.withColumn("class", of), features, "class", loss="softmax", classes=3, rounds=3)
    return H.shapley(model, test, "line", ["returned", "open", "closed"]).withColumnRenamed("output", "class")


@query()
def ml_contrib_multi(spark, d):
    return rounded(_class_parts(spark, d))


@query()
def agg_push_ranking(spark, d):
    """For each class its features by how much they push towards it."""
    from pyspark.sql import Window

    pushes = _class_parts(spark, d).groupBy("class", "feature").agg(F.avg(F.greatest("contribution", F.lit(0.0))).alias("push"))
    return rounded(pushes.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("push"), "feature"))))


@query()
def ml_monotone_price(spark, d):
    """A chance that can only fall as the price rises, at three prices: boosted trees whose splits keep the direction."""
    train, test = _split(spark, d)
    model = B.fit(train, FEATURES, "returned", rounds=6, signs={"price": -1})
    priced = test.select("line", *[f for f in FEATURES if f != "price"], F.col("price").alias("own"), F.explode(F.lit([0.9, 1.0, 1.1])).alias("m")).withColumn("price", F.col("own") * F.col("m"))
    return rounded(priced.select("line", "m", model.chances()[0].alias("p")))


def _trained(spark, d) -> tuple[str, DataFrame]:
    """A folder with the loop's model, learned on the days before, and the last part's lines."""
    train, test = _split(spark, d)
    model = B.fit(train, FEATURES, "returned", rounds=5, apart=F.col("is_late"))
    best = model.first(max(1, B.best_rounds(model)))
    return K.save(best, new_path(spark), train, FEATURES, "returned", {"rows": str(train.count()), "rounds": str(best.rounds)}), test


@query()
def loop_train(spark, d):
    """The contract of the loop's stored model, as it is read back."""
    path, _ = _trained(spark, d)
    back = K.load(spark, path)
    rows = [("feature", f, t, k) for k, (f, t) in enumerate(back.features.items(), 1)] + [("label", back.label, None, 0)] + [("note", k, v, 0) for k, v in sorted(back.notes.items())]
    return spark.createDataFrame(rows, "part string, name string, value string, place int")


@query()
def ml_save_load(spark, d):
    """A scaled line and boosted trees, stored, read back, and scored by what was read."""
    train, test = _split(spark, d)
    line = K.save(M.logistic(train, FEATURES, "returned"), new_path(spark), train, FEATURES, "returned")
    trees = K.save(B.fit(train, FEATURES, "returned", rounds=3), new_path(spark), train, FEATURES, "returned")
    out = K.load(spark, trees).score(K.load(spark, line).score(test, "p_line"), "p_trees")
    return rounded(out.select("line", "returned", "p_line", "p_trees"))


@query()
def loop_score_day(spark, d):
    """The last part's lines scored by the stored model of the days before."""
    path, test = _trained(spark, d)
    return rounded(K.load(spark, path).score(test).select("line", "price", "returned", "p"))


@query()
def alloc_run_loop(spark, d):
    """Train, score, spend the budget by risk or by value, and count what each policy caught."""
    from freightloom.operators.decide import within_budget

    day = loop_score_day(spark, d).withColumn("cost", F.lit(40.0))
    out = None
    for name, order in (("risk", F.desc("p")), ("value", F.desc(F.col("p") * F.col("price")))):
        top = within_budget(day, [order, F.col("line")], "cost", 4000.0).agg(F.lit(name).alias("policy"), F.count("*").alias("acted"), F.sum("returned").alias("caught"))
        out = top if out is None else out.unionByName(top)
    return out


def _example(parts: DataFrame, rows: DataFrame, score: str) -> DataFrame:
    """The row of the largest score and what it is made of, largest parts first."""
    top = rows.agg(F.max_by("line", F.struct(score, "line")).alias("line"))
    return rounded(M.largest_contributions(parts.join(F.broadcast(top), "line"), "line", 3))


@query()
def card_example_eta(spark, d):
    train, test = _split(spark, d)
    features = ["l_quantity", "l_discount", "weekday"]
    model = M.boosted_value(train, features, "price", trees=6)
    return _example(_parts(model, test, features), M.predicted(model, test, "forecast"), "forecast")


@query()
def card_example_order(spark, d):
    train, test = _split(spark, d)
    model = M.boosted(train, FEATURES, "returned", trees=6)
    return _example(_parts(model, test, FEATURES), M.probability(model, test), "p")
