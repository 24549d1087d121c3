"""Order-dependent state over a table: one pass over each key's rows in order, in bounded memory.

Rows are hashed by key, sorted within partitions and streamed through the step function, so a key with very
many rows is never held as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def scan_in_order(df: DataFrame, keys: list[str], order: list[str], step: Callable, schema: T.StructType) -> DataFrame:
    """step(state, row) gives the new state and a dict of the output columns, or None for no row; state is None at each key's first row."""
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target, key, state = to_arrow_schema(schema), None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                now = tuple(row[k] for k in keys)
                if now != key:
                    key, state = now, None
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)

    return rows.mapInArrow(run, schema)


def fields(df: DataFrame, *names: str, **more: T.DataType) -> T.StructType:
    """The named columns of df, and new ones."""
    return T.StructType([*[df.schema[n] for n in names], *[T.StructField(n, t) for n, t in more.items()]])
