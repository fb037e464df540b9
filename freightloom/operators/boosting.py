"""Boosted trees grown from histograms that Spark counts.

Features are cut into bins once. A level of all the trees of a round is one aggregate: for each tree, node, feature and
bin the sums of the loss's slope and curvature. Its rows are bounded by trees, nodes, features and bins, whatever the table
holds; from them the driver picks the splits. Rows find their node by column expressions over their bins.

Losses: `logistic` (0/1 labels), `softmax` (labels 0, 1, ...: one tree for each class and round, all from one
histogram), `squared`, and `pinball` (quantiles: one tree for each share and round, whose leaves are quantiles by counting).
Chances or values can be bound to rise or fall in a feature.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightloom.operators.ranked import group_quantiles, quantiles
from freightloom.operators.scratch import dropped, written


@dataclass
class Tree:
    """Nodes by number, the root is 0. A row goes to `low` where its feature is at most `cut`, else (also where it is
    null or NaN) to `high`; a leaf has feature -1. `cover` is how many training rows came by."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for column, x in zip((self.feature, self.cut, self.low, self.high, self.value, self.cover), (-1, 0.0, -1, -1, value, cover)):
            column.append(x)
        return len(self.feature) - 1

    def pick(self, goes_low, at_leaf, node: int = 0) -> Column:
        """A column: what `at_leaf` gives for the leaf of a row, ways chosen by `goes_low` of a node."""
        if self.feature[node] < 0:
            return at_leaf(node)
        return F.when(goes_low(node), self.pick(goes_low, at_leaf, self.low[node])).otherwise(self.pick(goes_low, at_leaf, self.high[node]))

    def predicted(self, features: Sequence[str]) -> Column:
        return self.pick(lambda k: F.col(features[self.feature[k]]) <= self.cut[k], lambda k: F.lit(self.value[k]))

    def leaf(self, features: Sequence[str]) -> Column:
        """The number of a row's leaf."""
        return self.pick(lambda k: F.col(features[self.feature[k]]) <= self.cut[k], lambda k: F.lit(k))

    @classmethod
    def of_model(cls, model, weight: float = 1.0) -> Tree:
        """A fitted tree of Spark's, values times the weight, with the covers that fitting counted."""
        own = cls()

        def walk(node) -> int:
            k = own.add(weight * node.prediction(), float(node.impurityStats().count()))
            if node.getClass().getSimpleName() != "LeafNode":
                split = node.split()
                low, high = walk(node.leftChild()), walk(node.rightChild())
                own.feature[k], own.cut[k], own.low[k], own.high[k] = split.featureIndex(), split.threshold(), low, high
            return k

        walk(model._call_java("rootNode"))
        return own


@dataclass
class Ensemble:
    """`start` has a value for each output; a tree adds to the output named with it. `curve` has the loss on the rows that
    learn and on those set apart, after 0, 1, ... rounds."""

    loss: str
    features: list[str]
    start: list[float]
    trees: list[tuple[int, Tree]] = field(default_factory=list)
    curve: list[tuple[float, float | None]] = field(default_factory=list)
    alphas: list[float] = field(default_factory=list)

    @property
    def rounds(self) -> int:
        return len(self.trees) // len(self.start)

    def first(self, rounds: int) -> Ensemble:
        """The model after so many rounds."""
        return Ensemble(self.loss, self.features, self.start, self.trees[: rounds * len(self.start)], self.curve[: rounds + 1], self.alphas)

    def margins(self) -> list[Column]:
        """The sum of start and trees, for each output."""
        return [reduce(lambda a, b: a + b, [t.predicted(self.features) for o, t in self.trees if o == k], F.lit(self.start[k])) for k in range(len(self.start))]

    def chances(self) -> Column:
        """An array: the chance of 1, or of each class, or the values (for shares: in order)."""
        m = self.margins()
        if self.loss == "logistic":
            return F.array(1 / (1 + F.exp(-m[0])))
        if self.loss == "softmax":
            top = F.greatest(*m) if len(m) > 1 else m[0]
            up = [F.exp(x - top) for x in m]
            return F.array(*[u / reduce(lambda a, b: a + b, up) for u in up])
        return F.array_sort(F.array(*m)) if self.loss == "pinball" else F.array(*m)

    def to_json(self) -> str:
        return json.dumps({"loss": self.loss, "features": self.features, "start": self.start, "trees": [[k, vars(t)] for k, t in self.trees], "curve": self.curve, "alphas": self.alphas})

    @classmethod
    def from_json(cls, text: str) -> Ensemble:
        d = json.loads(text)
        return cls(d["loss"], d["features"], d["start"], [(k, Tree(**t)) for k, t in d["trees"]], [tuple(c) for c in d["curve"]], d["alphas"])


def bin_cuts(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Up to bins - 1 distinct cuts for each feature, at about equal shares of its finite values."""
    shares = [k / bins for k in range(1, bins)]
    plain = df.select(*[F.when(F.abs(F.col(f).cast("double")) < float("inf"), F.col(f).cast("double")).alias(f"c{k}") for k, f in enumerate(features)])
    found = plain.approxQuantile([f"c{k}" for k in range(len(features))], shares, 1 / (16 * bins))
    return [sorted(set(c)) for c in found]


@dataclass
class _Node:
    """A node that may be split: its tree's number, its own, its sums, and the bounds that monotone splits above set."""

    tree: int
    node: int
    low: float
    high: float


def _weight(g: float, h: float, l2: float, low: float, high: float) -> float:
    return min(high, max(low, -g / (h + l2))) if h + l2 > 0 else min(high, max(low, 0.0))


def _gain(g: float, h: float, l2: float, w: float) -> float:
    """How much a leaf of weight w lowers the loss (twice)."""
    return -(2 * g * w + (h + l2) * w * w)


Sums = dict[tuple[int, int, int], dict[int, tuple[float, float, int]]]


def best_split(node: _Node, sums: Sums, cuts: Sequence[Sequence[float]], signs: Sequence[int], l2: float, least_rows: int, least_curve: float):
    """(gain, feature, bin, (low's g, h, n), (high's), weights) of the best split of a node, or None; ties to the first."""
    best = None
    for f in range(len(cuts)):
        by = sums.get((node.tree, node.node, f), {})
        total = [sum(v[k] for v in by.values()) for k in range(3)]
        parent = _gain(total[0], total[1], l2, _weight(total[0], total[1], l2, node.low, node.high))
        left = [0.0, 0.0, 0]
        for b in range(len(cuts[f])):
            left = [x + y for x, y in zip(left, by.get(b, (0.0, 0.0, 0)))]
            right = [t - x for t, x in zip(total, left)]
            if min(left[2], right[2]) < least_rows or min(left[1], right[1]) < least_curve:
                continue
            w = [_weight(s[0], s[1], l2, node.low, node.high) for s in (left, right)]
            if signs[f] * (w[1] - w[0]) < 0:
                continue
            gain = _gain(left[0], left[1], l2, w[0]) + _gain(right[0], right[1], l2, w[1]) - parent
            # Sums differ in their last digits from run to run; gains that are equal but for those are ties.
            if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                best = (gain, f, b, left, right, w)
    return best


def slopes(loss: str, margins: list[Column], label: Column, alphas: Sequence[float]) -> tuple[list[tuple[Column, Column]], Column]:
    """For each output the loss's slope and curvature, and the loss."""
    y = label.cast("double")
    if loss == "logistic":
        p = 1 / (1 + F.exp(-margins[0]))
        value = F.greatest(margins[0], F.lit(0.0)) - margins[0] * y + F.log1p(F.exp(-F.abs(margins[0])))
        return [(p - y, p * (1 - p))], value
    if loss == "softmax":
        top = F.greatest(*margins) if len(margins) > 1 else margins[0]
        up = [F.exp(m - top) for m in margins]
        all_up = reduce(lambda a, b: a + b, up)
        own = F.get(F.array(*margins), label.cast("int"))
        return [(u / all_up - (label == k).cast("double"), u / all_up * (1 - u / all_up)) for k, u in enumerate(up)], F.log(all_up) + top - own
    if loss == "squared":
        return [(margins[0] - y, F.lit(1.0))], F.pow(margins[0] - y, F.lit(2.0)) / 2
    if loss == "pinball":
        each = [(F.when(y < m, 1 - a).otherwise(-a), F.lit(1.0)) for m, a in zip(margins, alphas)]
        return each, reduce(lambda a, b: a + b, [F.greatest(a * (y - m), (a - 1) * (y - m)) for m, a in zip(margins, alphas)])
    raise ValueError(f"no loss {loss}")


def fit(
    train: DataFrame, features: Sequence[str], label: str, loss: str = "logistic", classes: int = 2, rounds: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0,
    least_rows: int = 20, least_curve: float = 1e-3, signs: Mapping[str, int] | None = None, apart: Column | None = None, alphas: Sequence[float] = (), every: int = 4,
) -> Ensemble:
    """Boosted trees for `label` (rows without one are left out).

    signs: 1 where the output may only rise with a feature, -1 where it may only fall: a split against that is never made,
    and the halves' later leaves stay on their side of the middle between its two weights. apart: rows that don't learn,
    whose loss the curve tells. classes: for softmax. alphas: for pinball. Margins are written every `every` rounds. No
    rows give a model without trees.
    """
    outputs = {"softmax": classes, "pinball": len(alphas)}.get(loss, 1)
    features, directions = list(features), [(signs or {}).get(f, 0) for f in features]
    held = F.coalesce(apart, F.lit(False)) if apart is not None else F.lit(False)
    rows = train.where(F.col(label).isNotNull()).select(*[F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)], F.col(label).cast("double").alias("y"), (~held).alias("learns"))
    rows = written(rows)
    own = [f"x{k}" for k in range(len(features))]
    learning = rows.where("learns")
    cuts = bin_cuts(learning, own, bins)
    n, mean = learning.agg(F.count("*"), F.avg("y")).first()
    if not n:
        return Ensemble(loss, features, [0.0] * outputs, alphas=list(alphas))
    if loss == "logistic":
        p = min(1 - 1e-6, max(1e-6, mean))
        start = [math.log(p / (1 - p))]
    elif loss == "softmax":
        seen = {int(r["y"]): r["count"] for r in learning.groupBy("y").count().collect()}
        start = [math.log(max(seen.get(k, 0), 0.5) / n) for k in range(outputs)]
    else:
        start = [mean] if loss == "squared" else quantiles(learning, "y", alphas)
    model = Ensemble(loss, features, [float(s) for s in start], alphas=list(alphas))
    over = lambda x, c: reduce(lambda a, b: a + b, [F.when(F.col(x) <= v, 0).otherwise(1) for v in c], F.lit(0)).cast("tinyint")
    bins_of = [f"b{k}" for k in range(len(features))]
    binned = rows.select("y", "learns", *[over(x, c).alias(b) for b, x, c in zip(bins_of, own, cuts)])
    # Trees see bins alone, so rows of the same bins and class are one from here on: their number is bounded by bins and
    # classes, not by the table.
    classed = loss in ("logistic", "softmax")
    binned = binned.groupBy("y", "learns", *bins_of).agg(F.count("*").alias("n")) if classed else binned.withColumn("n", F.lit(1).cast("long"))
    binned = written(binned.select("*", *[F.lit(s).alias(f"m{k}") for k, s in enumerate(model.start)]))
    dropped(rows)
    pending: list[tuple[int, Tree, dict[int, int]]] = []  # trees since the margins were written, with their splits' bins

    def bin_low(tree: Tree, at: dict[int, int]):
        return lambda k: F.col(f"b{tree.feature[k]}") <= at[k]

    def margins() -> list[Column]:
        return [reduce(lambda a, b: a + b, [t.pick(bin_low(t, at), lambda k, t=t: F.lit(t.value[k])) for o, t, at in pending if o == k], F.col(f"m{k}")) for k in range(outputs)]

    def told(now: list[Column]) -> tuple[Column, Column]:
        value = slopes(loss, [F.col(f"m{k}") for k in range(outputs)], F.col("y"), alphas)[1]
        return F.sum(F.when(F.col("learns"), value * F.col("n"))), F.sum(F.when(~F.col("learns"), value * F.col("n")))

    def noted(learn: float | None, other: float | None, counts: tuple[int, int]) -> None:
        model.curve.append(((learn or 0.0) / max(1, counts[0]), other / counts[1] if counts[1] else None))

    counts = binned.agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in (F.col("learns"), ~F.col("learns"))]).first()

    def moved() -> DataFrame:
        """The rows with the margins that all trees so far give."""
        return binned.select("y", "learns", "n", *bins_of, *[m.alias(f"m{k}") for k, m in enumerate(margins())])

    for turn in range(rounds):
        now = moved()
        each, value = slopes(loss, [F.col(f"m{k}") for k in range(outputs)], F.col("y"), alphas)
        learns, n = F.col("learns"), F.col("n")
        told_of = {f"{c}{k}": F.when(learns, x * n).otherwise(0.0) for k, pair in enumerate(each) for c, x in zip("gh", pair)}
        told_of |= {"rows": F.when(learns, n).otherwise(0), "here": F.when(learns, value * n).otherwise(0.0), "there": F.when(learns, F.lit(0.0)).otherwise(value * n)}
        if classed:
            cells = now.select(*bins_of, *[x.alias(c) for c, x in told_of.items()])
        else:  # one pass over the rows serves all levels of the round
            cells = written(now.groupBy(*bins_of).agg(*[F.sum(x).alias(c) for c, x in told_of.items()]))
        trees, splits = [Tree() for _ in range(outputs)], [dict() for _ in range(outputs)]
        open_nodes = [_Node(k, 0, -math.inf, math.inf) for k in range(outputs)]
        for level in range(depth + 1):
            # Of a root only its sums are known once the first histogram is there.
            at = [t.pick(bin_low(t, s), lambda k: F.lit(k)) if t.feature else F.lit(0) for t, s in zip(trees, splits)]
            wanted = {(o.tree, o.node) for o in open_nodes}
            if level == depth or not open_nodes:
                break
            parts = F.inline(F.array(*[F.struct(F.lit(k).alias("tree"), at[k].alias("node"), F.col(f"g{k}").alias("g"), F.col(f"h{k}").alias("h")) for k in range(outputs)]))
            seen = cells.select("rows", "here", "there", F.array(*bins_of).alias("bins"), parts)
            if level:
                keep = reduce(lambda a, b: a | b, [(F.col("tree") == t) & (F.col("node") == k) for t, k in sorted(wanted)])
                seen = seen.where("rows > 0").where(keep)
            by = seen.select("*", F.posexplode("bins").alias("f", "bin")).groupBy("tree", "node", "f", "bin")
            got = by.agg(*[F.sum(c).alias(a) for c, a in (("g", "g"), ("h", "h"), ("rows", "n"), ("here", "here"), ("there", "there"))]).collect()
            if level == 0:
                first = [r for r in got if r["tree"] == 0 and r["f"] == 0]
                noted(math.fsum(r["here"] or 0.0 for r in first), math.fsum(r["there"] or 0.0 for r in first), counts)
            sums: Sums = {}
            for r in got:
                sums.setdefault((r["tree"], r["node"], r["f"]), {})[r["bin"]] = (r["g"] or 0.0, r["h"] or 0.0, r["n"])
            after = []
            for o in open_nodes:
                tree, by_node = trees[o.tree], sums.get((o.tree, o.node, 0), {})
                g, h, rows_here = (sum(v[k] for v in by_node.values()) for k in range(3))
                if not tree.feature:
                    tree.add(rate * _weight(g, h, l2, o.low, o.high), float(rows_here))
                found = best_split(o, sums, cuts, directions, l2, least_rows, least_curve)
                if not found:
                    continue
                _, f, b, left, right, w = found
                sides = [tree.add(rate * w[k], float(s[2])) for k, s in enumerate((left, right))]
                tree.feature[o.node], tree.cut[o.node], tree.low[o.node], tree.high[o.node] = f, cuts[f][b], *sides
                splits[o.tree][o.node] = b
                middle = (w[0] + w[1]) / 2
                bounds = [(o.low, o.high), (o.low, o.high)]
                if directions[f] > 0:
                    bounds = [(o.low, middle), (middle, o.high)]
                elif directions[f] < 0:
                    bounds = [(middle, o.high), (o.low, middle)]
                after.extend(_Node(o.tree, s, *bd) for s, bd in zip(sides, bounds))
            open_nodes = after
        if not classed:
            dropped(cells)
        if loss == "pinball":
            _quantile_leaves(now, trees, splits, bin_low, alphas, rate)
        pending.extend((k, t, s) for k, (t, s) in enumerate(zip(trees, splits)))
        model.trees.extend(enumerate(trees))
        if (turn + 1) % every == 0 and turn + 1 < rounds:
            old, binned = binned, written(moved())
            dropped(old)
            pending = []
    now = moved()
    noted(*now.agg(*told(margins())).first(), counts)
    dropped(binned)
    return model


def _quantile_leaves(now: DataFrame, trees: list[Tree], splits: list[dict[int, int]], bin_low, alphas: Sequence[float], rate: float) -> None:
    """Leaves of the trees take the share's quantile of what is left of the labels in them."""
    for k, (tree, at, a) in enumerate(zip(trees, splits, alphas)):
        left = now.where("learns").select(tree.pick(bin_low(tree, at), lambda n: F.lit(n)).alias("leaf"), (F.col("y") - F.col(f"m{k}")).alias("left"))
        for r in group_quantiles(left, ["leaf"], "left", [a], ["q"]).collect():  # a row for each leaf
            tree.value[r["leaf"]] = rate * r["q"]


def best_rounds(model: Ensemble) -> int:
    """The number of rounds at which the loss on the rows set apart is smallest; the first of equals."""
    told = [c[1] for c in model.curve]
    return min(range(len(told)), key=lambda k: (told[k] if told[k] is not None else math.inf, k))


def fit_counted(train: DataFrame, features: Sequence[str], label: str, apart: Column, most: int = 40, least: int = 1, **options) -> tuple[Ensemble, Ensemble]:
    """(model, probe): a probe learns without the rows `apart`, whose loss says how many rounds serve; the model is
    fitted with so many (`least` or more) on all rows."""
    probe = fit(train, features, label, rounds=most, apart=apart, **options)
    return fit(train, features, label, rounds=max(least, best_rounds(probe)), **options), probe
