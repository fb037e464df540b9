"""Whole evaluation bundles: every figure of a report as rows (section, part, metric, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightloom.operators import boosting as B
from freightloom.operators import decide as D
from freightloom.operators import metrics as ME
from freightloom.operators import models as M
from freightloom.operators import ranked as R
from freightloom.operators.scratch import dropped, written
from freightloom.plans.models import FEATURES, _split, lines
from freightloom.plans.registry import query, rounded
from freightloom.plans.scores import _FORECAST, _ROUTED, QUEUES, forecasts, routed


def told(df: DataFrame, section: str, part: str | Column, metrics: dict[str, Column]) -> DataFrame:
    """Aggregates of all rows, or of the groups of a column, one row for each."""
    by = df.groupBy(F.lit(part).alias("part") if isinstance(part, str) else part.cast("string").alias("part")).agg(*[c.cast("double").alias(n) for n, c in metrics.items()])
    return by.select(F.lit(section).alias("section"), "part", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics])))


def told_sql(section: str, part: str, metrics: dict[str, str], source: str) -> str:
    """The same in SQL; `part` is an expression."""
    names, values = ", ".join(f"'{n}'" for n in metrics), ", ".join(f"CAST({c} AS DOUBLE)" for c in metrics.values())
    return f"SELECT '{section}' AS section, part, metric, round(value, 4) AS value FROM (SELECT CAST({part} AS VARCHAR) AS part, unnest([{names}]) AS metric, unnest([{values}]) AS value FROM {source} GROUP BY {part})"


def together(parts: list[DataFrame]) -> DataFrame:
    return rounded(reduce(DataFrame.unionByName, parts))


# --- Arrival times: points, quantiles, intervals before and after calibration, promises

_ETA = f"""{_FORECAST}, cut AS (SELECT min(day) + CAST((max(day) - min(day)) // 2 AS INTEGER) AS c FROM g),
e AS (SELECT e, row_number() OVER (ORDER BY e) AS i, count(*) OVER () AS n FROM (SELECT greatest(mean * 0.8::DOUBLE - actual, actual - mean * 1.2::DOUBLE) AS e FROM g, cut WHERE day <= c)),
q AS (SELECT e AS qhat FROM e WHERE i = least(ceil((n + 1) * 0.8::DOUBLE), n)),
t0 AS (SELECT event_type, day, actual, naive, mean, mean * 0.8::DOUBLE AS low, mean * 1.2::DOUBLE AS high, greatest(mean * 0.8::DOUBLE - qhat, 0.05::DOUBLE) AS clow, mean * 1.2::DOUBLE + qhat AS chigh, qhat FROM g, cut, q WHERE day > c),
w AS (SELECT quantile_cont(mean, 1 / 3.0::DOUBLE) AS a, quantile_cont(mean, 2 / 3.0::DOUBLE) AS b FROM t0), t AS (SELECT *, CASE WHEN mean <= a THEN 0 WHEN mean <= b THEN 1 ELSE 2 END AS tercile, strftime(day, '%Y-%m') AS month FROM t0, w)"""


def _share_sql(condition: str) -> str:
    return f"avg(CAST({condition} AS INTEGER))"


def _point_sql(f: str) -> dict[str, str]:
    return {"mae": f"avg(abs({f} - actual))", "rmse": f"sqrt(avg(pow({f} - actual, 2)))", "within_1": _share_sql(f"abs({f} - actual) <= 1"), "bias": f"avg({f} - actual)"}


def _interval_sql(a: str, b: str) -> dict[str, str]:
    return {"coverage": _share_sql(f"actual BETWEEN {a} AND {b}"), "below": _share_sql(f"actual < {a}"), "above": _share_sql(f"actual > {b}"), "width": f"avg({b} - {a})"}


_SHARES = {"low": 0.1, "mean": 0.5, "high": 0.9}
_ETA_SQL = " UNION ALL ".join(
    [told_sql("point", f"'{f}'", _point_sql(f), "t") for f in ("naive", "mean")]
    + [told_sql("pinball", f"'{f}'", {"loss": f"avg(greatest({a}::DOUBLE * (actual - {f}), {a - 1}::DOUBLE * (actual - {f})))"}, "t") for f, a in _SHARES.items()]
    + [told_sql("interval", "'raw'", _interval_sql("low", "high"), "t"), told_sql("interval", "'calibrated'", _interval_sql("clow", "chigh") | {"qhat": "max(qhat)"}, "t")]
    + [told_sql("tercile", "tercile", _interval_sql("low", "high") | {"n": "count(*)"}, "t"), told_sql("month", "month", {"raw": _share_sql("actual BETWEEN low AND high"), "calibrated": _share_sql("actual BETWEEN clow AND chigh"), "n": "count(*)"}, "t")]
    + [told_sql("promise", f"'{f}'", {"kept": _share_sql(f"actual <= ceil({f})"), "mean_promised": f"avg(ceil({f}))"}, "t") for f in ("mean", "high")]
    + [told_sql("promise", "'extra'", {"mean_promised": "avg(ceil(high)) - avg(ceil(mean))"}, "t")]
)


@query(f"WITH {_ETA} {_ETA_SQL}")
def eval_eta(spark, d):
    """Point errors, quantile losses, intervals raw and calibrated on the days before, coverage by tercile and month, and
    what promises keep and cost."""
    g = written(forecasts(spark, d).withColumns({"low": F.col("mean") * 0.8, "high": F.col("mean") * 1.2}))
    first, last = g.agg(F.min("day"), F.max("day")).first()
    cut = F.lit(first + (last - first) // 2 if first else None).cast("date")
    widening = ME.interval_widening(g.where(F.col("day") <= cut), "low", "high", "actual", 0.8).select(F.col("widening").alias("qhat"))
    t = g.where(F.col("day") > cut).crossJoin(F.broadcast(widening))
    t = t.withColumns({"clow": F.greatest(F.col("low") - F.col("qhat"), F.lit(0.05)), "chigh": F.col("high") + F.col("qhat")})
    edges = R.quantile_edges(t, "mean", [1 / 3, 2 / 3])
    t = t.crossJoin(F.broadcast(edges)).withColumns({"tercile": F.when(F.col("mean") <= F.col("q1"), 0).when(F.col("mean") <= F.col("q2"), 1).otherwise(2), "month": F.date_format("day", "yyyy-MM")})
    a = F.col("actual")
    share = lambda c: F.avg(c.cast("int"))
    point = lambda f: {"mae": ME.mae(F.col(f), a), "rmse": ME.rmse(F.col(f), a), "within_1": share(F.abs(F.col(f) - a) <= 1), "bias": F.avg(F.col(f) - a)}
    interval = lambda x, y: {"coverage": share(a.between(F.col(x), F.col(y))), "below": share(a < F.col(x)), "above": share(a > F.col(y)), "width": F.avg(F.col(y) - F.col(x))}
    parts = [told(t, "point", f, point(f)) for f in ("naive", "mean")] + [told(t, "pinball", f, {"loss": ME.pinball(F.col(f), a, s)}) for f, s in _SHARES.items()]
    parts += [told(t, "interval", "raw", interval("low", "high")), told(t, "interval", "calibrated", interval("clow", "chigh") | {"qhat": F.max("qhat")})]
    parts += [told(t, "tercile", F.col("tercile"), interval("low", "high") | {"n": F.count("*")}), told(t, "month", F.col("month"), {"raw": share(a.between(F.col("low"), F.col("high"))), "calibrated": share(a.between(F.col("clow"), F.col("chigh"))), "n": F.count("*")})]
    parts += [told(t, "promise", f, {"kept": share(a <= F.ceil(f)), "mean_promised": F.avg(F.ceil(f))}) for f in ("mean", "high")]
    return together([*parts, told(t, "promise", "extra", {"mean_promised": F.avg(F.ceil("high")) - F.avg(F.ceil("mean"))})])


# --- Tickets: policies, queues, and how much may go by itself

_WAIT = "CASE WHEN actual = {0} THEN 0.0::DOUBLE WHEN actual = '1-URGENT' THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END"
_CONFIDENT = "(abs(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':sure'), 1, 8))::UBIGINT / 4294967296.0::DOUBLE))"
_TRIAGE = f"""{_ROUTED.replace('AS predicted FROM', 'AS predicted, o_orderkey FROM')}, p AS (SELECT *, mode_all FROM r, (SELECT actual AS mode_all FROM r GROUP BY 1 ORDER BY count(*) DESC, actual LIMIT 1)), u AS (SELECT *, {_CONFIDENT} AS u FROM p),
v AS (SELECT o_orderkey, actual, predicted AS rules, mode_all AS most, CASE WHEN u < 0.7 THEN actual ELSE predicted END AS model, CASE WHEN u < 0.7 THEN 1 - u / 2 ELSE 1.35::DOUBLE - u END AS sure FROM u),
taus AS (SELECT unnest([0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS tau), sw AS (SELECT tau, avg(CAST(sure >= tau AS INTEGER)) AS auto, avg(CAST(model = actual AS INTEGER)) FILTER (WHERE sure >= tau) AS accuracy, avg(CASE WHEN sure >= tau THEN {_WAIT.format('model')} ELSE 0.0 END) AS delay FROM v, taus GROUP BY 1)"""


def _macro_sql(c: str) -> str:
    return f"""SELECT 'policy' AS section, '{c}' AS part, 'macro_f1' AS metric, round(avg(CASE WHEN a + b = 0 THEN 0 ELSE 2.0::DOUBLE * hit / (a + b) END), 4) AS value FROM (SELECT q, count(*) FILTER (WHERE actual = q) AS a, count(*) FILTER (WHERE {c} = q) AS b, count(*) FILTER (WHERE actual = q AND {c} = q) AS hit FROM v, (SELECT unnest({QUEUES!r}) AS q) GROUP BY 1)"""


_TRIAGE_SQL = " UNION ALL ".join(
    [told_sql("policy", f"'{c}'", {"accuracy": _share_sql(f"actual = {c}"), "delay": f"avg({_WAIT.format(c)})"}, "v") for c in ("rules", "most", "model")] + [_macro_sql(c) for c in ("rules", "most", "model")]
    + [told_sql("queue", "actual", {"recall": _share_sql("model = actual"), "support": "count(*)"}, "v"), told_sql("flagged", "model", {"precision": _share_sql("model = actual"), "flagged": "count(*)"}, "v")]
    + [told_sql("sweep", "tau", {"auto": "max(auto)", "accuracy": "max(accuracy)", "delay": "max(delay)"}, "sw"), told_sql("operating", "'chosen'", {"tau": "max(tau)", "auto": "max(auto)"}, "(SELECT * FROM sw WHERE accuracy >= 0.9 OR (SELECT max(accuracy) FROM sw) < 0.9 ORDER BY CASE WHEN accuracy >= 0.9 THEN auto ELSE tau END DESC, tau LIMIT 1)")]
)


@query(f"WITH {_TRIAGE} {_TRIAGE_SQL}")
def eval_triage(spark, d):
    """Three policies (rules, the commonest queue, a made model that is sure where it is right), each queue, and what share
    may go by itself at which accuracy."""
    r = routed(spark, d).select("o_orderkey", "actual", F.col("predicted").alias("rules"))
    most = r.groupBy("actual").count().orderBy(F.desc("count"), "actual").limit(1).select(F.col("actual").alias("most"))
    from freightloom.functions import scalar as S

    u = S.uniform(F.col("o_orderkey"), "sure")
    v = written(r.crossJoin(F.broadcast(most)).withColumns({"model": F.when(u < 0.7, F.col("actual")).otherwise(F.col("rules")), "sure": F.when(u < 0.7, 1 - u / 2).otherwise(1.35 - u)}))
    a = F.col("actual")
    share = lambda c: F.avg(c.cast("int"))
    wait = lambda c: F.when(a == F.col(c), 0.0).when(a == "1-URGENT", 2.0).otherwise(0.5)
    parts = [told(v, "policy", c, {"accuracy": share(a == F.col(c)), "delay": F.avg(wait(c))}) for c in ("rules", "most", "model")]
    for c in ("rules", "most", "model"):
        by = v.select(F.explode(F.array(*[F.struct(F.lit(q).alias("q"), (a == q).cast("int").alias("a"), (F.col(c) == q).cast("int").alias("b"), ((a == q) & (F.col(c) == q)).cast("int").alias("hit")) for q in QUEUES])).alias("x")).groupBy("x.q").agg(F.sum("x.a").alias("a"), F.sum("x.b").alias("b"), F.sum("x.hit").alias("hit"))
        parts.append(told(by, "policy", c, {"macro_f1": F.avg(F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("a") + F.col("b")), F.lit(0.0)))}))
    parts += [told(v, "queue", a, {"recall": share(F.col("model") == a), "support": F.count("*")}), told(v, "flagged", F.col("model"), {"precision": share(F.col("model") == a), "flagged": F.count("*")})]
    taus = [0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
    goes = lambda t: F.col("sure") >= t
    one = v.agg(F.array(*[F.struct(F.lit(t).alias("tau"), share(goes(t)).alias("auto"), F.avg(F.when(goes(t), (F.col("model") == a).cast("int"))).alias("accuracy"), F.avg(F.when(goes(t), wait("model")).otherwise(0.0)).alias("delay")) for t in taus]).alias("s"))
    sweep = written(one.select(F.inline("s")))
    parts.append(told(sweep, "sweep", F.col("tau"), {n: F.max(n) for n in ("auto", "accuracy", "delay")}))
    good = F.col("accuracy") >= 0.9
    chosen = sweep.orderBy(F.desc(F.coalesce(good, F.lit(False))), F.desc(F.when(good, F.col("auto")).otherwise(F.col("tau"))), "tau").limit(1)
    return together([*parts, told(chosen, "operating", "chosen", {"tau": F.max("tau"), "auto": F.max("auto")})])


# --- Fitted models: their reports are tested against plain figures of the same predictions


def binary_report(df: DataFrame, p: str, y: str, key: str, part: str, share: float = 0.1) -> list[DataFrame]:
    """A probability's ranks, calibration and worth at the top `share` of the rows; and the rate, lift and capture of its
    deciles. `df` should be written: it is read once for each figure."""
    top = R.top_fraction(df.select(key, p, y), [F.desc(p), F.col(key)], share)
    base, total = F.lit(df.agg(F.avg(y)).first()[0]), F.lit(df.agg(F.sum(y)).first()[0])
    one = lambda frame, column, metric: frame.select(F.lit("ranks").alias("section"), F.lit(part).alias("part"), F.lit(metric).alias("metric"), F.col(column).cast("double").alias("value"))
    lift = R.lift(df.select(key, p, y), [F.desc(p), F.col(key)], F.col(y))
    return [
        one(R.roc_auc(df, p, F.col(y)), "auc", "roc_auc"), one(R.average_precision(df, p, F.col(y)), "ap", "pr_auc"),
        told(df, "ranks", part, {"brier": ME.brier(F.col(p), F.col(y)), "rate": F.avg(y), "n": F.count("*")}),
        told(top, "top", part, {"precision": F.avg(y), "capture": F.sum(y) / total, "lift": F.avg(y) / base}),
        told(lift, "decile", F.concat_ws(":", F.lit(part), "decile"), {"rate": F.max("rate"), "lift": F.max("lift"), "capture": F.max("capture")}),
    ]


def commit_scores(spark, d) -> DataFrame:
    """Test lines with the chances of a line and of boosted trees, fitted before them."""
    train, test = _split(spark, d)
    trees = B.fit(train, FEATURES, "returned", rounds=5)
    return written(M.probability(M.logistic(train, FEATURES, "returned"), test, "line_p").withColumn("trees_p", trees.chances()[0]).select("line", "returned", "line_p", "trees_p"))


@query()
def eval_commit(spark, d):
    """Both models' ranks, calibration, top tenth and deciles on rows after their training time."""
    scores = commit_scores(spark, d)
    return together([part for p in ("line_p", "trees_p") for part in binary_report(scores, p, "returned", "line", p)])


def conformal_scores(spark, d) -> tuple[DataFrame, DataFrame]:
    """Late training lines and test lines with a raw and a calibrated chance: fitted before, calibrated on the late ones."""
    train, test = _split(spark, d)
    model = B.fit(train.where("NOT is_late"), FEATURES, "returned", rounds=5)
    late, later = (df.withColumn("raw", model.chances()[0]).select("line", "returned", "raw") for df in (train.where("is_late"), test))
    return tuple(written(M.isotonic(late, "raw", "returned", df, "calibrated")) for df in (late, later))


@query()
def eval_conformal(spark, d):
    """Brier scores raw and calibrated, and for each share of misses that may be lost: the threshold from late training
    rows, what it catches of the test rows' and how many it flags."""
    late, later = conformal_scores(spark, d)
    y = F.col("returned")
    parts = [told(later, "brier", c, {"score": ME.brier(F.col(c), y)}) for c in ("raw", "calibrated")]
    for a in (0.05, 0.1, 0.2):
        t = ME.conformal_threshold(late, "calibrated", y == 1, a).select("threshold")
        hit = (F.col("calibrated") >= F.col("threshold")).cast("int")
        parts.append(told(later.crossJoin(F.broadcast(t)), "threshold", str(a), {"threshold": F.max("threshold"), "capture": F.avg(F.when(y == 1, hit)), "flag_rate": F.avg(hit)}))
    return together(parts)


#: What a prevented loss is worth, and what a treatment costs.
SAVED, SPENT = 25.0, 4.0


def uplift_table(spark, d) -> DataFrame:
    df = lines(spark, d)
    scores = M.uplift_scores(df, ["l_quantity", "price", "l_discount", "l_tax"], "treated", "returned", F.pmod(F.xxhash64("line"), F.lit(4)))
    return written(scores.select("line", "treated", "returned", *M.UPLIFT))


@query()
def eval_uplift(spark, d):
    """For each way of choosing: the area of its curve, what treating the top tenth, fifth and third by it would net (the
    arms' rates among those, times what a loss is worth), and by fifths of the score what it says against what it did."""
    scores, parts = uplift_table(spark, d), []
    t, y = F.col("treated"), F.col("returned")
    gain = F.coalesce(F.avg(F.when(t == 0, y)) - F.avg(F.when(t == 1, y)), F.lit(0.0))
    size = scores.count()
    for name in M.UPLIFT:
        # One ranking serves the curve, the shares and the fifths, and goes as soon as its few figures are written.
        arms = {"nt": t, "yt": t * y, "nc": 1 - t, "yc": (1 - t) * y}
        ranked = R.running(scores, [F.desc(name), F.col("line")], {k: v.cast("long") for k, v in arms.items()}, keep=["treated", "returned", name])
        own = [told(D.area_over_diagonal(D.gains(ranked)), "area", name, {"auuc": F.max("area")})]
        for k in (0.1, 0.2, 1 / 3):
            top = ranked.where(F.col("rank") <= max(round(size * k), 1))
            own.append(told(top, "policy", f"{name}:{k:.2f}", {"treated": F.count("*"), "prevented": gain * F.count("*"), "net": gain * F.count("*") * SAVED - F.count("*") * SPENT}))
        fifths = ranked.withColumn("decile", F.ceil(F.col("rank") / size * 5).cast("long"))
        own.append(told(fifths, "calibration", F.concat_ws(":", F.lit(name), "decile"), {"said": F.avg(name), "did": gain}))
        parts.append(written(reduce(DataFrame.unionByName, own)))
        dropped(ranked)
    return together(parts)
