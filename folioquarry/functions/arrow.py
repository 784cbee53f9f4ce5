"""Arrow-batched Python over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_batches(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str, chunk: int = 512) -> DataFrame:
    """Map rows in small chunks. ``make`` runs once a task and returns a function of the chunk's columns (as lists) to output rows.

    Rows leave in chunks too, so a task holds one chunk at a time however many rows its partition has.
    """
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                piece = batch.slice(at, chunk)
                rows = list(work(*(c.to_pylist() for c in piece.columns)))
                if rows:
                    columns = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return df.mapInArrow(run, schema)
