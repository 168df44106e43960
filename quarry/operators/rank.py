"""Scores, facets, completions and pages of query results: rows (doc_id, context, word, terms, positions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weight(weights: dict[str, float]) -> Column:
    """A context's weight over the greatest one; contexts without one count nothing. Weights are a few literals of the plan."""
    top = max(weights.values())
    return reduce(lambda c, kv: F.when(F.col("context") == kv[0], F.lit(kv[1] / top)).otherwise(c), weights.items(), F.lit(0.0))


def by_count(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.groupBy(key).agg(F.sum(F.size("positions")).cast("long").alias("score"))


def weighted(rows: DataFrame, weights: dict[str, float], key: str = "doc_id") -> DataFrame:
    return rows.groupBy(key).agg(F.sum(weight(weights) * F.size("positions")).alias("score"))


def best(scored: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The n best by score, ties to greater keys."""
    return scored.orderBy(F.desc("score"), F.desc(key)).limit(n)


def page(scored: DataFrame, number: int, per_page: int = 10, key: str = "doc_id") -> DataFrame:
    return scored.orderBy(F.desc("score"), F.desc(key)).offset((number - 1) * per_page).limit(per_page)


def word_hits(rows: DataFrame) -> DataFrame:
    """Words found, their terms and where; words that only negation brought in are left out."""
    hits = rows.groupBy("word").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"), F.count("*").alias("places"), F.sum(F.size("positions")).cast("long").alias("score"))
    return hits.where(F.array_join("terms", " ") != "")


def completions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("word").agg(F.count("*").alias("hits"))


def facets(values: DataFrame, column: Column) -> DataFrame:
    return values.groupBy(column.alias("facet")).agg(F.count("*").alias("hits"))


def one_per(scored: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """The best row of each value."""
    rank = F.row_number().over(Window.partitionBy(column).orderBy(F.desc("score"), F.desc(key)))
    return scored.withColumn("_n", rank).where("_n = 1").drop("_n")


def documents(scored: DataFrame, docs: DataFrame) -> DataFrame:
    """Scores with their documents; an unknown one is empty."""
    return scored.join(docs, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("uri", "title") if c in docs.columns})


def as_json(scored: DataFrame, n: int = 100) -> DataFrame:
    """One JSON object per hit, best first, at most n."""
    return best(scored, n).select("doc_id", F.to_json(F.struct(*sorted(scored.columns))).alias("json"))
