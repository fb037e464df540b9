"""Exact Shapley values of tree ensembles.

The game of a row: a set of features is known, and a tree's value is the mean over the ways that the unknown ones leave
open, weighed by how many training rows took each (the nodes' covers). A leaf matters only through the features on its way;
each is either met by the row or not. So a leaf has a table: for each pattern of met features, the Shapley value of each of
them. Rows look up their pattern, leaf by leaf, in batches of numpy arrays; values add up to the model's output less its mean.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from freightloom.operators.boosting import Ensemble, Tree


@dataclass
class Leaf:
    """The features on the way (each once), the open interval below and closed above that each must lie in, and the
    Shapley values by pattern (bit j: feature j is met)."""

    features: list[int]
    over: np.ndarray
    upto: np.ndarray
    values: np.ndarray


def pattern_values(value: float, shares: Sequence[float]) -> np.ndarray:
    """For each pattern and feature its Shapley value in the game whose worth of a known set is `value`, times 1 or 0 for
    each known feature that is met or not, times its share for each unknown one."""
    u = len(shares)
    met = (np.arange(1 << u)[:, None] >> np.arange(u)[None, :] & 1).astype(float)
    out = np.zeros((1 << u, u))
    weights = [math.factorial(s) * math.factorial(u - s - 1) / math.factorial(u) for s in range(u)]
    for i in range(u):
        # Coefficient s: sets of s of the others, the known ones met, the unknown ones by their shares.
        line = np.zeros((1 << u, u))
        line[:, 0] = 1.0
        for j in range(u):
            if j != i:
                line[:, 1:] = line[:, 1:] * shares[j] + line[:, :-1] * met[:, j : j + 1]
                line[:, 0] *= shares[j]
        out[:, i] = value * (met[:, i] - shares[i]) * (line @ weights)
    return out


def leaves(tree: Tree) -> list[Leaf]:
    found: list[Leaf] = []

    def walk(node: int, way: dict[int, tuple[float, float, float]]) -> None:
        f = tree.feature[node]
        if f < 0:
            fs = list(way)
            found.append(Leaf(fs, np.array([way[k][0] for k in fs]), np.array([way[k][1] for k in fs]), pattern_values(tree.value[node], [way[k][2] for k in fs])))
            return
        low, high, share = way.get(f, (-math.inf, math.inf, 1.0))
        all_rows = tree.cover[tree.low[node]] + tree.cover[tree.high[node]]
        for child, bounds in ((tree.low[node], (low, min(high, tree.cut[node]))), (tree.high[node], (max(low, tree.cut[node]), high))):
            part = tree.cover[child] / all_rows if all_rows else 0.5
            walk(child, way | {f: (*bounds, share * part)})

    walk(0, {})
    return found


def mean_value(tree: Tree, node: int = 0) -> float:
    """The tree's value of a row of which nothing is known."""
    if tree.feature[node] < 0:
        return tree.value[node]
    a, b = tree.low[node], tree.high[node]
    n = tree.cover[a] + tree.cover[b]
    share = tree.cover[a] / n if n else 0.5
    return share * mean_value(tree, a) + (1 - share) * mean_value(tree, b)


def base_values(model: Ensemble) -> list[float]:
    """What the model says of a row of which nothing is known, for each output."""
    return [s + sum(mean_value(t) for o, t in model.trees if o == k) for k, s in enumerate(model.start)]


def values(parts: Sequence[Sequence[Leaf]], x: np.ndarray, width: int) -> np.ndarray:
    """Shapley values of the rows of `x` (NaN for unknown: such go with the larger ones), summed over the trees."""
    out = np.zeros((len(x), width))
    filled = np.where(np.isnan(x), np.inf, x)
    for tree in parts:
        for leaf in tree:
            if leaf.features:
                mine = filled[:, leaf.features]
                met = ((mine > leaf.over) | (leaf.over == -np.inf)) & ((mine <= leaf.upto) | (leaf.upto == np.inf))
                out[:, leaf.features] += leaf.values[met @ (1 << np.arange(len(leaf.features)))]
    return out


def shapley(model: Ensemble, df: DataFrame, key: str, outputs: Sequence[str] | None = None) -> DataFrame:
    """(key, output, feature, contribution) for each row, output (by its number, or its name in `outputs`) and feature.

    Contributions of a row and an output add up to its margin less `base_values`. Null features count as NaN. Features are
    given once each; repeated rows get equal values; an empty table gives no rows.
    """
    names = [str(k) for k in range(len(model.start))] if outputs is None else list(outputs)
    width = len(model.features)
    by_output = [[leaves(t) for o, t in model.trees if o == k] for k in range(len(names))]
    kind = df.schema[key]
    schema = T.StructType([T.StructField(key, kind.dataType), T.StructField("output", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("contribution", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own = batch.slice(at, 4096)
                n = own.num_rows
                x = np.stack([own.column(1 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(width)], axis=1) if width else np.zeros((n, 0))
                for name, parts in zip(names, by_output):
                    got = values(parts, x, width)
                    rows = pa.array(np.repeat(np.arange(n), width))
                    yield pa.RecordBatch.from_arrays([own.column(0).take(rows), pa.array([name] * (n * width), pa.string()), pa.array(model.features * n, pa.string()), pa.array(got.reshape(-1))], names=[key, "output", "feature", "contribution"])

    from pyspark.sql import functions as F

    return df.select(key, *[F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(model.features)]).mapInArrow(run, schema)


def of_pipeline(model, features: Sequence[str]) -> Ensemble:
    """The trees of a fitted pipeline that ends in Spark's boosted trees, with the covers that fitting counted. The output
    is the sum of the trees' values by their weights."""
    last = model.stages[-1]
    out = Ensemble("squared", list(features), [0.0])
    out.trees.extend((0, Tree.of_model(tree, weight)) for tree, weight in zip(last.trees, last.treeWeights))
    return out
