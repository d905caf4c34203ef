"""What the operators of this subpackage share: tables, and Arrow maps in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.sources.shared import release, shared_dir, stored

__all__ = ["arrow_map", "first_rows", "release", "shared_dir", "slices", "stored", "table"]

def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Rows and bytes of texts that are turned into Python objects at once.
SLICE_ROWS, SLICE_BYTES = 2048, 8 << 20


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of at most ``rows`` rows and about ``size`` bytes of texts, one row at least."""
    held = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            held += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(held), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, end - at)
        at = end


def arrow_map(df: DataFrame, schema: str, columns: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """Apply ``columns`` (lists by name in, lists by name out) to each Arrow batch, in slices of bounded rows and bytes."""
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = columns({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows of smallest hash of ``key``: a sample that is the same for every partitioning."""
    return df.orderBy(F.xxhash64(key), key).limit(n)
