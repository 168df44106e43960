"""Shared helpers: tables kept in the cluster's shared folder, and batches of (id, text)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Only where that setting is missing (tests on one machine) a folder of our own stands in.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = getattr(spark, "_quarry_shared", None) or "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark._quarry_shared = at
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def mapped(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow in small batches: whole texts differ in length, and an executor holds several batches per task."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1024), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(key, str(most))
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that what Python holds at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(column: pa.Array) -> list[str]:
    """Whole texts; null is empty."""
    return ["" if t is None else t for t in column.to_pylist()]
