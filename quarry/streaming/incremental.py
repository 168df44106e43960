"""An index that grows with a stream of documents: each micro-batch replaces its documents' postings.

Batches are versions: a batch writes its postings and document ids under its own number, so one that is run again
overwrites itself, and a reader takes of each document the newest version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quarry.operators import index


def run(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Reads new Parquet files of documents until none is left."""

    def put(batch: DataFrame, number: int) -> None:
        latest = batch.dropDuplicates(["doc_id"])
        index.build(latest).write.mode("overwrite").parquet(f"{target}/postings/batch={number}")
        latest.select("doc_id").write.mode("overwrite").parquet(f"{target}/docs/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, removed: DataFrame | None = None) -> DataFrame:
    """Postings of every document's newest version, without removed ids."""
    newest = spark.read.parquet(f"{target}/docs").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    postings = spark.read.parquet(f"{target}/postings").join(newest, ["doc_id", "batch"], "left_semi").drop("batch")
    return postings if removed is None else index.without_docs(postings, removed)


def compact(spark: SparkSession, target: str, into: str) -> None:
    """Every document's newest version as one batch in a new folder, numbered as the newest, where the stream can go on.

    Batches are small and many; this is the merge of partial indexes. The old folder stays as it is, so a reader of it, or a
    compaction that is run again, sees no half-done state.
    """
    newest = spark.read.parquet(f"{target}/docs").agg(F.max("batch")).first()[0]
    if newest is None:
        return
    current(spark, target).write.mode("overwrite").parquet(f"{into}/postings/batch={newest}")
    spark.read.parquet(f"{target}/docs").select("doc_id").distinct().write.mode("overwrite").parquet(f"{into}/docs/batch={newest}")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type in event-time windows; works on a stream or a table. An addition of Spark's own."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
