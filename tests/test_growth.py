"""That steps cost no more than their input asks for: scans, shuffles and rounds, and the same rows as the plain way."""

import time

import pytest
from pyspark.sql import functions as F

from quarry import queries
from quarry.operators import index as I
from quarry.operators import mapreduce as M
from quarry.plans.evaluate import Evaluator, QueryConfig
from quarry.plans.fuzzy import GERMAN, FuzzyConfig
from quarry.plans.language import optimize, parse

SCHEMA = "context string, word string, doc_id long, positions array<int>"
SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final(df):
    """The plan as it ran, with what adaptive execution has reused."""
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def rows(df):
    return sorted(repr((r.doc_id, r.context, r.word, sorted(r.terms), list(r.positions))) for r in df.collect())


@pytest.fixture(scope="module")
def postings(spark, tmp_path_factory):
    """With a key in two rows, unsorted positions and rows without an id."""
    found = [("c", "Theta", 1, [3]), ("c", "theta", 1, [5, 1]), ("c", "den", 1, [2]), ("d", "the", 1, [1]), ("c", "den", 2, [1]), ("c", "of", 2, [2]), ("c", "theta", 3, [4]), ("c", "theta", 3, [9, 4]), ("d", "x", 3, [1]), ("c", "that", 4, [1]), ("d", "of", 4, [1])]
    found += [("c", "y", 5, [1]), ("c", "theta", None, [7]), ("c", "of", None, [8]), ("e", "thb", 6, [1])]
    path = f"{tmp_path_factory.mktemp('postings')}/p"
    I.with_lower(spark.createDataFrame(found, SCHEMA)).write.parquet(path)
    return spark.read.parquet(path)


QUERIES = [
    "th", "!Th", "th de", "th OR den", "th AND NOT de", "NOT th", "NOT (NOT th)", "c: (NOT de)", "d: th", "c,d: (of th)", "NOT th OR den", "(th OR den) (of OR that)", "th (NOT of)", "(NOT th) (NOT y)",
    "(th AND NOT de) OR (of AND NOT th)", "~xthat", "~theta", "~thv OR ~of", "d: (~xof) OR th", "~nothing", "c: (NOT d: of)", "th OR theta OR Theta",
]


@pytest.mark.parametrize("query", QUERIES)
def test_one_scan(postings, query):
    """One scan a tree, one more where words are fuzzy; the same rows as by a plan for each node."""
    e = Evaluator(postings, QueryConfig(fuzzy=FuzzyConfig(pairs=GERMAN, limit=1.0)))
    assert rows(e(query)) == rows(I.joined(e.node(optimize(parse(query)), None)))
    assert plan(e(query)).count("FileScan") == (2 if "~" in query else 1)


def test_phrases_and_limits_in_a_tree(postings):
    assert [(r.doc_id, r.word) for r in Evaluator(postings)('"theta den" OR y').orderBy("doc_id").collect()] == [(1, "theta den"), (5, "y")]
    assert {r.word for r in Evaluator(postings, QueryConfig(word_limit=1))("th").collect()} == {"theta", "the", "thb"}


def test_build_has_no_lambdas(spark):
    """gathering a document's words by lambdas cost three times the rest of a build."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert "lambda" not in plan(I.build(docs)) and "MapInArrow" in plan(I.build(docs))
    long = spark.createDataFrame([(k, ("bb aa " * 4000 if k == 600 else f"w{k} ä b-c 7 w{k}"), None, "s") for k in range(1300)], "doc_id long, text string, lang string, source string").coalesce(1)
    got = {(r.doc_id, r.context, r.word): tuple(r.positions) for r in I.build(long).collect()}
    assert got == {(r.doc_id, r.context, r.word): tuple(r.positions) for r in I.grouped(I.tokens(long)).collect()}
    assert got[600, "content", "bb"] == tuple(range(1, 8000, 2)) and got[7, "content", "w7"] == (1, 5)


def test_merge_sorts_by_id_first(spark, postings):
    """Nothing is combined before the shuffle, and ids are the first key of the sort."""
    p = postings.where("doc_id is not null")
    merged = I.merge(p, I.occurrences(spark, [("c", "den", 1, [7]), ("c", "den", 1, [2, 9])]))
    found = {(r.context, r.word, r.doc_id): list(r.positions) for r in merged.collect()}
    assert found["c", "den", 1] == [2, 7, 9] and found["c", "theta", 1] == [1, 5] and found["c", "theta", 3] == [4, 9] and len(found) == p.select(*I.KEY).distinct().count()
    assert "Aggregate" not in plan(merged) and "hashpartitioning(doc_id" in plan(merged)


def test_subtract_joins_only_what_takes_away(spark, postings):
    """a right row without positions isn't shuffled."""
    right = postings.withColumn("positions", F.filter("positions", lambda x: x > 8))
    shuffled = [line for line in plan(I.subtract(postings, right)).splitlines() if "Filter" in line and "size(" in line and "> 0" in line]
    assert len(shuffled) >= 2
    got = {(r.context, r.word, r.doc_id): list(r.positions) for r in I.subtract(postings.where("doc_id = 4"), right).collect()}
    assert got == {("c", "that", 4): [1], ("d", "of", 4): [1]}


@pytest.mark.parametrize("name", ["maint_split_words", "maint_split_documents"])
def test_split_reads_twice(spark, name):
    """the split postings are read once for both sums, after the sizes."""
    df = queries.QUERIES[name](spark, SF)
    assert "ReusedExchange" in final(df) and "map_from" not in plan(df) and "keys: [" not in plan(df)


def test_parts_take_many_tasks(spark):
    """with four parts, four tasks read everything."""
    pairs = spark.range(4000).select(F.concat(F.lit("k"), F.col("id") % 500).alias("key"))
    dealt = M.partitioned(pairs, F.lit(0), 4)
    spread = dealt.select("part", "key", F.spark_partition_id().alias("task"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = spread.groupBy("key").agg(F.countDistinct("task").alias("n"), F.first("task").alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.n for r in found} == {1} and len({r.task for r in found}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r.part for r in dealt.select("part").distinct().collect()} == {0}


def test_lists_are_sorted_without_lambdas(spark, postings):
    """lists in id order, by built-in sorting."""
    assert "lambda" not in plan(I.listed(postings))
    many = I.with_lower(spark.createDataFrame([("c", "w", k, [k + 1, k + 9]) for k in (3000, 10, 9, 1023, 1024)], SCHEMA))
    assert [tuple(r) for r in I.listed(many).orderBy("chunk").collect()] == [("c", "w", 0, 3, "9:10 18,10:11 19,1023:1024 1032"), ("c", "w", 1, 1, "1024:1025 1033"), ("c", "w", 2, 1, "3000:3001 3009")]


def test_gaps_of_a_long_list(spark):
    """running sums in n log n; by a sum for each place this took minutes."""
    n = 100_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: (x * 3).cast("int")).alias("p"))
    begin = time.time()
    one = df.select("p", I.deltas(F.col("p")).alias("g")).select(F.size("g").alias("n"), (I.from_deltas(F.col("g")) == F.col("p")).alias("same")).first()
    assert (one.n, one.same) == (n, True) and time.time() - begin < 60
    assert [r.x for r in spark.createDataFrame([([],), ([5],), ([5, 1],), ([1, 2, 3, 4, 5],)], "g array<int>").select(I.from_deltas(F.col("g")).alias("x")).collect()] == [[], [5], [5, 6], [1, 3, 6, 10, 15]]
