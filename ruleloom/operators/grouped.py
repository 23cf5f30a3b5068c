"""Functions over the rows of one group, for many small groups in a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS_OUT = 5000


def by_group(rows: DataFrame, keys: list[str], order: list, run: Callable[[list[dict]], list[dict]], schema: StructType) -> DataFrame:
    """run for the rows of each group in their order. Groups stream through a task one after another, so that a small one costs no call of its own into a worker; a task holds one group at a time."""
    arrow = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if held and key != now:
                    out += run(held)
                    held = []
                    if len(out) >= ROWS_OUT:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out = []
                now = key
                held.append(row)
        out += run(held) if held else []
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(each, schema)
