"""Sorted scans: rows of a key in order, with a state that is carried from row to row.

For what each row does to depend on what rows before it did (a reset, an action that silences later ones), no window
serves. Rows are dealt out by key, sorted by Spark (which spills), and read batch by batch; only the state of the current
key crosses from one batch to the next, so a key of any length takes bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

#: From a state (None where a key starts) and the values of a run of rows to the state after it and the outputs: columns of
#: values, and which rows of the run they belong to.
Fold = Callable[[Any, list[list]], tuple[Any, list[int], list[list]]]


def runs(keys: list[tuple]) -> Iterator[tuple[int, int]]:
    """Where runs of equal keys start and end."""
    start = 0
    for k in range(1, len(keys) + 1):
        if k == len(keys) or keys[k] != keys[start]:
            yield start, k
            start = k


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str], fold: Fold, added: Sequence[tuple[str, T.DataType]]) -> DataFrame:
    """Rows that `fold` keeps, in columns `keys`, `values` and those of `added`."""
    names = [*keys, *values]
    rows = df.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*[T.StructField(c, rows.schema[c].dataType) for c in names], *[T.StructField(c, t) for c, t in added]])
    types = {"double": pa.float64(), "boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32()}

    def run(batches):
        last, state = None, None
        for batch in batches:
            own = list(zip(*[batch.column(c).to_pylist() for c in range(len(keys))])) if batch.num_rows else []
            columns = [batch.column(len(keys) + c).to_pylist() for c in range(len(values))]
            kept: list[int] = []
            new: list[list] = [[] for _ in added]
            for a, b in runs(own):
                if last != own[a]:
                    last, state = own[a], None
                state, some, out = fold(state, [c[a:b] for c in columns])
                kept.extend(a + k for k in some)
                for column, part in zip(new, out):
                    column.extend(part)
            left = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*left.columns, *[pa.array(c, types[t.simpleString()]) for c, (_, t) in zip(new, added)]], names=[*names, *[c for c, _ in added]])

    return rows.mapInArrow(run, schema)
