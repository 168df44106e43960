"""Reading and writing documents, indexes and results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(uri, text, n_bytes, modified) of every file under a path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("uri"), F.decode("content", "UTF-8").alias("text"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"))


def converted(spark: SparkSession, path: str, convert: Callable[[bytes], str | None], pattern: str = "*") -> DataFrame:
    """(uri, text) of files in a format that Spark doesn't read (PDF and the like): `convert` makes text of a file's bytes.

    It runs on the executors, one file at a time; a file that it can't read gives null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for content in b.column(1).to_pylist():
                try:
                    texts.append(convert(content))
                except ValueError:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["uri", "text"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("uri"), "content").mapInArrow(run, "uri string, text string")


def write_index(postings: DataFrame, docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Postings by context, near words in a file sorted so that prefixes prune row groups; documents beside them.

    A beginning that a large share of all postings has ("th") is more than one task's work: the rebalancing shuffle lets
    adaptive execution cut it at the advisory size.
    """
    near = postings.withColumn("beginning", F.substring("word_lc", 1, 2)).hint("rebalance", "context", "beginning").drop("beginning")
    near.sortWithinPartitions("context", "word_lc").write.mode(mode).partitionBy("context").parquet(f"{path}/postings")
    docs.write.mode(mode).parquet(f"{path}/docs")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs")


def write_xml(rows: DataFrame, path: str, root: str, row: str) -> None:
    rows.write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", row).save(path)


def read_xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def write_sitemap(pages: DataFrame, path: str) -> None:
    write_xml(pages.select(F.col("url").alias("_href"), F.col("title").alias("_title")), path, "urlset", "url")


def upsert_text(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """(doc_id, context, content): fresh rows replace those with the same key."""
    return cache.join(fresh, ["doc_id", "context"], "left_anti").unionByName(fresh)
