"""A crawl as rounds of batches over a frontier table, and its rules for levels, redirects and status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import frontier, stored


def with_redirects(fetched: DataFrame) -> DataFrame:
    """(uri) of all that a fetch settles: what was asked for and, after a redirect, where it led."""
    return fetched.select(F.explode(F.array_distinct(F.array_compact(F.array("uri", "location")))).alias("uri")).distinct()


def usable(fetched: DataFrame) -> DataFrame:
    return fetched.where("status = 200")


def stale(cache: DataFrame, now: Column, days: int) -> DataFrame:
    """What a refresh fetches again: cached rows (uri, fetched) that are older than their validity, or were never fetched."""
    return cache.where(F.col("fetched").isNull() | (F.col("fetched") < now - F.expr(f"INTERVAL {int(days)} DAYS")))


def crawl(starts: DataFrame, links: Callable[[DataFrame], DataFrame], max_level: int, max_docs: int = -1, per_round: int | None = None) -> DataFrame:
    """(uri, level): start URIs and what links from them lead to, within max_level clicks; -1 documents: no limit.

    links maps (uri, level) rows to (src, uri) links. A round takes the next per_round URIs in order (all, if None), so
    rounds are bounded by the depth or by the number of batches; each is stored, and the crawl can go on from there.
    """
    seen = stored(starts.select("uri").distinct().withColumn("level", F.lit(0)), "seen")
    todo = seen
    while not todo.isEmpty() and max_docs != 0:
        batch = todo if per_round is None else stored(todo.orderBy("uri").limit(per_round), "batch")
        found = step(batch.where(F.col("level") < max_level), links)
        fresh = stored(frontier(found, seen, max_level), "fresh")
        seen = stored(seen.unionByName(fresh), "seen")
        rest = todo.join(batch.select("uri"), "uri", "left_anti") if per_round is not None else todo.where("false")
        todo = stored(rest.unionByName(fresh), "todo")
        if max_docs > 0 and seen.count() >= max_docs:
            return seen.orderBy("level", "uri").limit(max_docs)
    return seen


def step(batch: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(uri, level) one click further."""
    out = links(batch).withColumnRenamed("uri", "to")
    return out.join(batch.select(F.col("uri").alias("src"), "level"), "src").select(F.col("to").alias("uri"), (F.col("level") + 1).alias("level"))
