"""The corpus pipeline: documents without toxic ones, one of each group of near copies, without personal data, packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. run() writes what a stage
returns as Parquet in the shared folder and reads it again for the next, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import packing, pii, simhash, toxicity
from quarry.llm.common import stored

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that operator 1 predicts to be toxic; labels are only learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject_toxic(docs.select(*DOCUMENT), toxicity.train(docs, labels))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies (5-word Jaccard of 0.8 or more), that of the smallest id.

    Of repeated ids, rows of other texts are other documents; a row without an id stays.
    """
    texts = simhash.near_copies(docs).where("doc_id is not null").groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    keep = texts.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash", "rows")).alias("one")).select("one.*")
    kept = docs.select(*DOCUMENT).withColumn("text_hash", F.xxhash64("text")).join(keep, ["doc_id", "text_hash"])
    once = kept.where("rows = 1").select(*DOCUMENT)
    again = kept.where("rows > 1").groupBy("doc_id", "text_hash").agg(F.min(F.struct(*DOCUMENT)).alias("row")).select("row.*")
    return once.unionByName(again).unionByName(docs.where("doc_id is null").select(*DOCUMENT))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces what operator 3 finds by its kind in brackets."""
    return pii.redact(docs.select(*DOCUMENT))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of operator 5."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("simhash_near_dedup", near_copies), ("pii", private), ("packing", packed)]

#: No stage is expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
