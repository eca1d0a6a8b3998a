"""Ordered folds over groups, with one transition function for batch and stream.

A fold is ``step(state, row) -> (state, outputs)`` in plain Python.  In batch the
rows of a group come to one task, sorted, and stream through it: the task
holds one state, not one group, so a key with a third of all rows needs time
there but no memory.  In a stream the same step runs over kept state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship

Step = Callable[[Any, dict], tuple[Any, list[tuple]]]
BATCH = 4096


def fold(rows: DataFrame, keys: list[str], order: list[str], step: Step, schema: StructType | str, start: Callable[[], Any] = lambda: None, finish: Callable[[tuple, Any], list[tuple]] | None = None) -> DataFrame:
    """The outputs of ``step`` over each group in order; ``finish`` may add some at a group's end.

    The grouping is one exchange by hash; the sort is inside the partitions, so
    it spills like any sort.
    """
    spark = rows.sparkSession
    ship(spark)
    want = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    types = to_arrow_schema(want)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        state: Any = None
        out: list[tuple] = []

        def full(force: bool = False) -> Iterator[pa.RecordBatch]:
            if out and (force or len(out) >= BATCH):
                cols = [pa.array(c, f.type) for c, f in zip(zip(*out), types)]
                out.clear()
                yield pa.RecordBatch.from_arrays(cols, schema=types)

        for b in batches:
            names = b.schema.names
            for values in zip(*(c.to_pylist() for c in b.columns)):
                row = dict(zip(names, values))
                key = tuple(row[k] for k in keys)
                if key != now:
                    if now is not None and finish:
                        out.extend(finish(now, state))
                    now, state = key, start()
                state, new = step(state, row)
                out.extend(new)
            yield from full()
        if now is not None and finish:
            out.extend(finish(now, state))
        yield from full(True)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, want)


def ordered(column: str) -> Any:
    """Ascending, nulls first: the order in which folds take rows."""
    return F.col(column).asc_nulls_first()
