"""Positional inverted indexes and document tables as DataFrames.

postings(context, word, word_lc, doc_id, positions), one row per context, word and document; docs(doc_id, uri, title).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as X

KEY = ["context", "word", "doc_id"]


@dataclass(frozen=True)
class Context:
    """One part of the index: where its text is, how it is split, and which words are left out (after positions are given)."""

    name: str
    source: Callable[[], Column]
    split: Callable[[Column], Column] = X.words
    dull: Callable[[Column], Column] | None = X.dull


DOCUMENTS = (
    Context("content", lambda: F.col("text")),
    Context("lang", lambda: F.col("lang"), lambda c: F.array(c), None),
    Context("source", lambda: F.col("source"), lambda c: F.array(c), None),
)
PAGES = (
    Context("title", lambda: X.title(F.col("html"))),
    Context("headline", lambda: X.headline(F.col("html"))),
    Context("body", lambda: X.plain(F.col("html"))),
    Context("uri", lambda: F.col("url"), X.url_words, lambda w: w.isin(*X.DULL_URL_PARTS)),
)


def spread(docs: DataFrame, bytes_a_core: int = 16 << 20) -> DataFrame:
    """Dealt out to all cores if the planner knows that it is small: such inputs are often a single row group, and so one task.

    What is moved is at most bytes_a_core a core; larger inputs, and those of unknown size, stay as they are read.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(cores) if size <= cores * bytes_a_core else docs


def tokens(docs: DataFrame, contexts: tuple[Context, ...] = DOCUMENTS, key: str = "doc_id") -> DataFrame:
    """(context, word, doc_id, pos): positions from 1, given before dull words go. All contexts in one scan."""
    docs = spread(docs)
    parts = F.array(*[F.struct(F.lit(c.name).alias("context"), c.split(c.source()).alias("words")) for c in contexts])
    each = docs.select(F.col(key).alias("doc_id"), F.explode(parts).alias("part")).select("doc_id", "part.context", F.posexplode("part.words").alias("pos", "word"))
    return each.where(kept(contexts)).select("context", "word", "doc_id", (F.col("pos") + 1).alias("pos"))


def kept(contexts: tuple[Context, ...]) -> Column:
    """Whether a word is none of those that its context leaves out; null is no word."""
    keep = F.col("word").isNotNull()
    for c in contexts:
        if c.dull:
            keep = keep & ((F.col("context") != c.name) | ~c.dull(F.col("word")))
    return keep


def with_lower(postings: DataFrame) -> DataFrame:
    return postings.select("context", "word", F.lower("word").alias("word_lc"), "doc_id", "positions")


def grouped(tokens: DataFrame) -> DataFrame:
    """Postings from (context, word, doc_id, pos): one shuffle."""
    return with_lower(tokens.groupBy(*KEY).agg(F.array_sort(F.collect_set("pos")).alias("positions")))


def gathered(names: list[str], rows: int = 512) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (key, words of each context) to (context, word, key, positions), a few documents at a time.

    Words become codes; one stable sort of (document, code) brings a document's equal words together, positions in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                for name, words in zip(names, part.columns[1:], strict=True):
                    length = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    total = int(length.sum())
                    if not total:
                        continue
                    doc = np.repeat(np.arange(len(length)), length)
                    pos = np.arange(1, total + 1) - np.repeat(np.cumsum(length) - length, length)
                    coded = words.flatten().dictionary_encode(null_encoding="encode")
                    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                    key = doc * len(coded.dictionary) + code
                    order = np.argsort(key, kind="stable")
                    key = key[order]
                    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                    first = order[begins]
                    positions = pa.ListArray.from_arrays(pa.array(np.append(begins, total).astype(np.int32)), pa.array(pos[order].astype(np.int32)))
                    found = [pa.repeat(name, len(first)), coded.dictionary.take(pa.array(code[first])), part.column(0).take(pa.array(doc[first])), positions]
                    yield pa.RecordBatch.from_arrays(found, [*KEY, "positions"])

    return run


def build(docs: DataFrame, contexts: tuple[Context, ...] = DOCUMENTS, key: str = "doc_id", unique: bool = True) -> DataFrame:
    """Postings of whole documents, all contexts in one scan.

    A document's words are gathered within its row, in time n log n, so where `key` is the documents' key nothing is
    shuffled. Built-in functions split the words; gathering them by lambdas costs several times as much as over Arrow
    batches. With unique=False rows that share a key are merged.
    """
    docs = spread(docs)
    conf = docs.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1024), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):  # texts differ in length
        now = conf.get(name)
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(name, str(most))
    rows = docs.select(F.col(key).alias("doc_id"), *[c.split(c.source()).alias(f"words{k}") for k, c in enumerate(contexts)])
    found = rows.mapInArrow(gathered([c.name for c in contexts]), f"context string, word string, doc_id {rows.schema['doc_id'].dataType.simpleString()}, positions array<int>")
    found = found.where(kept(contexts))
    return with_lower(found) if unique else merge(found)


def merge(*postings: DataFrame) -> DataFrame:
    """Position union per context, word and document. Ids come first in the key: they tell rows apart soonest where keys are sorted."""
    all_ = postings[0].select(*KEY, "positions")
    for p in postings[1:]:
        all_ = all_.unionByName(p.select(*KEY, "positions"))
    return with_lower(joined(all_))


def joined(rows: DataFrame) -> DataFrame:
    """One row a key; its `positions`, and `terms` where rows have them, are the union of all its rows'.

    Most keys have one row, so nothing would be combined before the shuffle: a window sees each row once, after one sort.
    """
    key = Window.partitionBy(*KEY[::-1]).orderBy("doc_id")
    whole = lambda name: F.array_distinct(F.flatten(F.collect_list(name).over(key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    unions = {"positions": F.sort_array(whole("positions"))} | ({"terms": whole("terms")} if "terms" in rows.columns else {})
    names = [c for c in rows.columns if c not in unions]
    first = rows.select(*names, *[c.alias(name) for name, c in unions.items()], F.row_number().over(key).alias("_n"))
    return first.where("_n = 1").select(*rows.columns)


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left without right's positions; what has none left goes."""
    r = right.where(F.size("positions") > 0).select(*KEY, F.col("positions").alias("gone"))
    rest = left.join(r, KEY[::-1], "left").withColumn("positions", F.when(F.col("gone").isNull(), F.col("positions")).otherwise(F.array_except("positions", "gone")))
    return with_lower(rest.where(F.size("positions") > 0))


def occurrences(spark: SparkSession, rows: list[tuple[str, str, int, list[int]]]) -> DataFrame:
    """A few (context, word, doc_id, positions) given by hand, to be merged into an index or subtracted from it."""
    return with_lower(spark.createDataFrame(rows, "context string, word string, doc_id long, positions array<int>"))


def listed(postings: DataFrame, span: int = 1024) -> DataFrame:
    """(context, word, chunk, docs, occurrences): a word's documents and positions in id order, a row for each `span` ids.

    No list is longer than span, whatever share of all documents holds the word.
    """
    one = F.struct("doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.array_join("positions", " ")).alias("o"))
    chunk = F.floor(F.col("doc_id") / span).cast("long").alias("chunk")
    lists = postings.groupBy("word", chunk, "context").agg(F.count("*").alias("docs"), F.array_join(F.sort_array(F.collect_list(one))["o"], ",").alias("occurrences"))
    return lists.select("context", "word", "chunk", "docs", "occurrences")


def deltas(positions: Column) -> Column:
    """Each position less the one before it."""
    return F.transform(positions, lambda x, i: x - F.coalesce(F.get(positions, i - 1), F.lit(0)))


def from_deltas(gaps: Column) -> Column:
    """Running sums in log n rounds: each adds to every item the one 1, 2, 4, ... places before it."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda step: step < F.size(gaps))
    return F.aggregate(steps, gaps, lambda sums, step: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - step), F.lit(0))))


def without_docs(postings: DataFrame, ids: DataFrame) -> DataFrame:
    return postings.join(ids.select("doc_id"), "doc_id", "left_anti")


def with_ids(postings: DataFrame, mapping: Column) -> DataFrame:
    """Postings under new document ids; ids that become equal are merged."""
    return merge(postings.withColumn("doc_id", mapping))


def dense(ids: DataFrame) -> DataFrame:
    """(doc_id, dense_id) with 1..n in id order, by ranges: counts per range are offsets, so no task ranks all ids."""
    ranged = ids.select("doc_id").distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())
    local = ranged.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("doc_id")))
    sizes = local.groupBy("part").agg(F.max("n").alias("size"))
    offsets = sizes.select("part", (F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))  # a row per range
    return local.join(F.broadcast(offsets), "part").select("doc_id", (F.col("n") + F.coalesce("before", F.lit(0))).alias("dense_id"))


def defragment(postings: DataFrame) -> DataFrame:
    ids = dense(postings)
    return with_lower(postings.join(ids, "doc_id").select("context", "word", F.col("dense_id").alias("doc_id"), "positions"))


def shifted_union(left_docs: DataFrame, left: DataFrame, right_docs: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and postings of both; the right's ids move up past the left's greatest."""
    top = left_docs.agg(F.max("doc_id").alias("top"))
    low = right_docs.agg(F.min("doc_id").alias("low"))
    by = top.crossJoin(low).select((F.coalesce("top", F.lit(0)) - F.coalesce("low", F.lit(1)) + 1).alias("by"))  # one row
    move = lambda df: df.crossJoin(F.broadcast(by)).withColumn("doc_id", F.col("doc_id") + F.col("by")).drop("by")
    return left_docs.unionByName(move(right_docs)), left.unionByName(move(right))


def merged_docs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(old_id, doc_id) for the right's documents: a known URI takes the left's id, others go past its greatest in id order."""
    top = left.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("top"))
    known = right.join(left.select("uri", F.col("doc_id").alias("new")), "uri", "left").select(F.col("doc_id").alias("old_id"), "new")
    fresh = dense(known.where("new is null").select(F.col("old_id").alias("doc_id")))
    fresh = fresh.crossJoin(F.broadcast(top)).select(F.col("doc_id").alias("old_id"), (F.col("dense_id") + F.col("top")).alias("doc_id"))
    return known.where("new is not null").select("old_id", F.col("new").alias("doc_id")).unionByName(fresh)


def insert_docs(docs: DataFrame, more: DataFrame) -> DataFrame:
    """Documents whose URI is new are added; known ones stay as they are."""
    return docs.unionByName(more.join(docs.select("uri"), "uri", "left_anti").select(*docs.columns))


def update_docs(docs: DataFrame, changed: DataFrame) -> DataFrame:
    return docs.join(changed.select("doc_id"), "doc_id", "left_anti").select(*docs.columns).unionByName(changed.select(*docs.columns))


def indexed_docs(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """Documents that have at least one word in some context."""
    return docs.join(postings.select("doc_id"), "doc_id", "left_semi")


def disjoint(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether no document id is in both."""
    return a.select("doc_id").join(b.select("doc_id"), "doc_id", "left_semi").limit(1).agg((F.count("*") == 0).alias("disjoint"))


def sizes(postings: DataFrame, by: str) -> DataFrame:
    """(piece, size) for splitting: words per context, or positions per document or word."""
    size = F.countDistinct("word") if by == "context" else F.sum(F.size("positions"))
    return postings.groupBy(F.col({"context": "context", "document": "doc_id", "word": "word"}[by]).cast("string").alias("piece")).agg(size.cast("long").alias("size"))


def allotted(pieces: list[tuple[str, int]], n: int) -> dict[str, int]:
    """Each piece's part of n: largest first, always to the part that holds least."""
    load, part = [0] * n, {}
    for name, size in sorted(pieces, key=lambda p: (-p[1], p[0])):
        k = load.index(min(load))
        load[k] += size
        part[name] = k
    return part


def split(postings: DataFrame, by: str, n: int, buckets: int = 1024) -> DataFrame:
    """Postings with `part`, 0..n-1, of about equal sizes; a context, document or word is never divided.

    Contexts are allotted by name. Documents and words are first hashed into a fixed number of buckets, so only so many
    sizes reach the driver.
    """
    piece = {"context": F.col("context"), "document": F.col("doc_id").cast("string"), "word": F.col("word")}[by]
    bucket = F.pmod(F.xxhash64(piece), F.lit(buckets))
    if by != "context":
        piece = bucket.cast("string")
    size = F.countDistinct("word") if by == "context" else F.sum(F.size("positions"))
    found = postings.groupBy(piece.alias("piece")).agg(size.cast("long").alias("size")).collect()  # a row per context or bucket
    part = allotted([(r.piece, r.size) for r in found], n)
    if by != "context":  # looked up by place, not by going through a map's keys
        return postings.withColumn("part", F.get(F.array(*[F.lit(part.get(str(k))).cast("int") for k in range(buckets)]), bucket.cast("int")))
    by_part = F.create_map(*[F.lit(x) for kv in part.items() for x in kv]) if part else F.create_map().cast("map<string,int>")
    return postings.withColumn("part", by_part[piece])


def statistics(postings: DataFrame) -> DataFrame:
    """Documents, words, postings and positions, of each context and of all (context null)."""
    return postings.rollup("context").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("word").alias("words"), F.count("*").alias("postings"), F.sum(F.size("positions")).cast("long").alias("positions"))
