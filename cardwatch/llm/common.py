"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cardwatch.session import fresh_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_folder(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def lower_ascii(text: str) -> str:
    """Lower-cases A to Z and nothing else."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


#: Rows whose texts are Python objects at the same time in a task.
ROWS_AT_ONCE = 1000


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The Arrow batches in smaller ones, without copying."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[list[tuple]]:
    """The named columns as lists of row tuples, some rows at a time."""
    for batch in slices(batches):
        columns = [batch.column(batch.schema.get_field_index(name)).to_pylist() for name in names]
        yield list(zip(*columns, strict=True))
