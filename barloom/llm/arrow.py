"""Arrow-batch mapping that keeps the columns of its input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object]], fields: list[T.StructField], keep: bool = False) -> DataFrame:
    """One row out per row in: the columns fn returns; with keep, those of df before them.

    fn gets each Arrow batch and returns a dict of arrays in the order of fields.
    """
    schema = T.StructType([*(df.schema.fields if keep else []), *fields])
    types = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch)
            cols = [x if isinstance(x, pa.Array) else pa.array(x, types.field(n).type) for n, x in made.items()]
            kept = batch.columns if keep else []
            yield pa.RecordBatch.from_arrays([*kept, *cols], names=[*(batch.schema.names if keep else []), *made])

    return df.mapInArrow(run, schema)
