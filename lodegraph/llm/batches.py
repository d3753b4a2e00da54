"""Shared helpers: map-side Arrow operators over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """Round-robin rows over the cluster when the scan yields fewer tasks than cores (one small file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def map_rows(df: DataFrame, make: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """`make` turns the columns of a batch (lists) into output columns (lists of any equal length). No shuffle."""
    out = _arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = make({n: batch.column(n).to_pylist() for n in batch.schema.names})
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def latest(df: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """One row a key: of redelivered rows the one with the latest `stamp` (nulls first, so any stamp beats none)."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.coalesce(F.col(stamp), F.timestamp_seconds(F.lit(0)))).alias("_r"))
    return best.select(*keys, "_r.*")
