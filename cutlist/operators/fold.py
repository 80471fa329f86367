"""Order-dependent state over the rows of a key, as one sorted pass with constant memory."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], begin: Callable, step: Callable, schema: str, names: list[str]) -> DataFrame:
    """Rows of each key in order through step(state, row) -> (state, output rows).

    `begin()` gives a key's first state; outputs are tuples in the order of `names`. Rows of a key
    stream through one task but are never held, so that long keys cost time and not memory; callers
    feed only the rows that can change state. Rows with equal order must be interchangeable.

    Rows are dealt by a hash of their own: where `df` comes out of a join by the same keys, Spark takes a plain deal by them for
    done, and reads the join's rows as mappers left them once it turns into a broadcast.
    """

    def run(batches):
        key, state = None, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                now = tuple(row[k] for k in keys)
                if now != key:
                    key, state = now, begin()
                state, made = step(state, row)
                out += made
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=wanted)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = to_arrow_schema(StructType.fromDDL(schema))
    return df.repartition(F.xxhash64(*keys, F.lit(1))).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
