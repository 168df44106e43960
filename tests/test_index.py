import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import graph as G
from quarry.operators import index as I
from quarry.operators import mapreduce as M
from quarry.operators import rank as R
from quarry.plans.evaluate import Evaluator, QueryConfig, limited
from quarry.sources import tables
from quarry.streaming import incremental

ROWS = [
    ("c1", "word1", 1, [12, 23, 43]), ("c1", "word1", 2, [2, 4, 10]), ("c1", "word2", 2, [1, 32, 94]), ("c1", "word2", 3, [15, 33, 45]), ("c1", "word3", 1, [18, 64, 82]), ("c1", "word3", 3, [15, 18, 43]),
    ("c2", "word2", 1, [29, 63, 73]), ("c2", "word2", 2, [28, 45, 51]), ("c2", "word4", 2, [5, 47, 65]), ("c2", "word4", 3, [13, 14, 32]), ("c2", "Word5", 3, [8, 48, 55]), ("c3", "word2", 1, [24, 60, 77]), ("c3", "word2", 3, [21, 25, 26]), ("c3", "Word5", 3, [35, 78, 86]),
]
SCHEMA = "context string, word string, doc_id long, positions array<int>"


@pytest.fixture(scope="module")
def sample(spark):
    return I.with_lower(spark.createDataFrame(ROWS, SCHEMA)).cache()


def ids(df):
    return sorted({r.doc_id for r in df.select("doc_id").collect()})


def rows(df):
    return sorted((r.context, r.word, r.doc_id, tuple(r.positions)) for r in df.collect())


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("word1", [1, 2]), ("word", [1, 2, 3]), ("WORD5", [3]), ("!word5", []), ("!Word5", [3]), ("word1 word4", [2]), ("word1 OR word5", [1, 2, 3]), ("word2 AND NOT word1", [3]), ("NOT word1", [3]), ("c3: NOT", []),
        ("c3: word2", [1, 3]), ("c1,c3: word3", [1, 3]), ("c2: (word2 OR word4)", [1, 2, 3]), ("(NOT word1) word3", [3]), ('"word2 word3"', []), ("missing", []), ("~wrod1", [1, 2]), ("~word1", [1, 2]), ("NOT missing", [1, 2, 3]),
    ],
)
def test_queries(sample, query, expected):
    assert ids(Evaluator(sample)(query)) == expected


def test_rows_hold_all_hit_words(sample):
    found = rows(Evaluator(sample)("word1 word4"))
    assert found == [("c1", "word1", 2, (2, 4, 10)), ("c2", "word4", 2, (5, 47, 65))]


def test_phrase_is_anchored_at_its_first_word(spark):
    docs = spark.createDataFrame([(1, "aa bb cc"), (2, "aa bb xx aa yy cc"), (3, "aa xx bb"), (4, "AA bb cc")], "doc_id long, text string")
    p = I.build(docs, I.DOCUMENTS[:1])
    assert ids(Evaluator(p)('"aa bb cc"')) == [1, 2, 4]  # each later word follows some first word
    assert ids(Evaluator(p)('!"aa bb cc"')) == [1, 2]
    assert rows(Evaluator(p)('"aa bb"'))[1] == ("content", "aa bb", 2, (1, 4))


def test_limits(spark):
    p = I.with_lower(spark.createDataFrame([("c", w, k, [1]) for w, n in (("a", 1), ("ab", 5), ("ac", 2), ("abc", 9)) for k in range(n)], SCHEMA))
    words = lambda df: sorted({r.word for r in df.collect()})
    assert words(limited(p, 0, 7)) == ["a", "ab", "ac"] and words(limited(p, 0, 6)) == ["a", "ab"]
    assert words(limited(p, 2, 0)) == ["ab", "abc"]
    assert words(limited(p, 1, 7)) == ["ab"]
    assert words(Evaluator(p, QueryConfig(word_limit=1))("a")) == ["abc"]


def test_build_needs_no_shuffle(spark, tmp_path):
    docs = spark.createDataFrame([(1, "b a b", "en", "s"), (2, None, None, None), (3, "", "de", "s"), (4, "1 - a", "de", "t")], "doc_id long, text string, lang string, source string")
    assert rows(I.build(docs)) == rows(I.grouped(I.tokens(docs)))
    assert "Exchange" not in I.build(docs)._jdf.queryExecution().executedPlan().toString()
    twice = docs.unionByName(spark.createDataFrame([(1, "a c", "en", "s")], docs.schema))
    assert rows(I.build(twice, unique=False)) == rows(I.grouped(I.tokens(twice)))
    docs.coalesce(1).write.parquet(f"{tmp_path}/one")  # small, and read as one task: dealt out to all cores
    small = I.spread(spark.read.parquet(f"{tmp_path}/one"))
    assert small.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and rows(I.build(small)) == rows(I.build(docs))
    assert I.spread(spark.read.parquet(f"{tmp_path}/one"), bytes_a_core=0).rdd.getNumPartitions() == 1


def test_merge_and_subtract_laws(sample):
    left, right = sample.where("doc_id < 3"), sample.where("doc_id > 1")
    assert rows(I.merge(left, right)) == rows(sample)
    assert rows(I.merge(sample, sample)) == rows(sample)
    assert rows(I.subtract(sample, right)) == rows(sample.where("doc_id = 1"))
    assert rows(I.subtract(sample, sample)) == []
    one = sample.sparkSession.createDataFrame([("c1", "word1", 1, [23])], SCHEMA)
    assert ("c1", "word1", 1, (12, 43)) in rows(I.subtract(sample, one))
    assert rows(I.merge(I.subtract(sample, one), one)) == rows(sample)
    assert rows(I.without_docs(sample, sample.where("doc_id = 2"))) == rows(sample.where("doc_id <> 2"))


def test_ids(sample):
    assert ids(I.with_ids(sample, F.col("doc_id") * 10)) == [10, 20, 30]
    assert len(rows(I.with_ids(sample, F.lit(7)))) == 8
    moved = I.defragment(I.with_ids(sample, F.col("doc_id") * 100 + 5))
    assert rows(moved) == rows(sample)


def test_documents(spark):
    a = spark.createDataFrame([(1, "u1", "t"), (2, "u2", "t")], "doc_id long, uri string, title string")
    b = spark.createDataFrame([(1, "u2", "x"), (5, "u5", "x")], "doc_id long, uri string, title string")
    assert sorted(r.uri for r in I.insert_docs(a, b).collect()) == ["u1", "u2", "u5"]
    assert sorted((r.old_id, r.doc_id) for r in I.merged_docs(a, b).collect()) == [(1, 2), (5, 3)]
    assert sorted(r.doc_id for r in I.shifted_union(a, a, b, b)[0].collect()) == [1, 2, 3, 7]
    assert sorted((r.doc_id, r.title) for r in I.update_docs(a, b.where("doc_id = 1")).collect()) == [(1, "x"), (2, "t")]
    assert not I.disjoint(a, b).first().disjoint and I.disjoint(a, b.where("doc_id = 5")).first().disjoint


def test_split(sample):
    pieces = [(r.piece, r.size) for r in I.sizes(sample, "document").collect()]
    assert dict(pieces) == {"1": 12, "2": 12, "3": 18}
    assert I.allotted(pieces, 2) == {"3": 0, "1": 1, "2": 1}


def test_rank(sample):
    found = Evaluator(sample)("word1 OR word5")
    assert {r.doc_id: r.score for r in R.by_count(found).collect()} == {1: 3, 2: 3, 3: 6}
    assert {r.doc_id: r.score for r in R.weighted(found, {"c1": 0.5, "c2": 1.0}).collect()} == {1: 1.5, 2: 1.5, 3: 3.0}
    assert [r.doc_id for r in R.best(R.by_count(found), 2).collect()] == [3, 2]
    assert [r.doc_id for r in R.page(R.by_count(found), 2, 2).collect()] == [1]
    assert R.word_hits(Evaluator(sample)("NOT word1")).count() == 0
    known = sample.sparkSession.createDataFrame([(1, "u1", "t1")], "doc_id long, uri string, title string")
    assert {r.doc_id: r.uri for r in R.documents(R.by_count(found), known).collect()} == {1: "u1", 2: "", 3: ""}


def test_text(spark):
    def one(c, **columns):
        return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns)).select(c.alias("x")).first().x

    t = F.col("t")
    assert one(X.spaced_capitals(t), t="fooBarBAZ_x") == "foo Bar BAZ x"
    assert one(X.dashed(t), t="a-b-c") == ["a-b-c", "b", "c"]
    assert one(X.url_words(t), t="http://a.de/mitarbeiter/xy/p.html") == ["~xy", "http", "a", "de", "mitarbeiter", "xy", "p", "html"]
    assert one(X.words(t), t="a_b, ç-d  1!") == ["a_b", "ç-d", "1"]
    assert one(X.shortened(t, 6), t="abcdefgh") == "abc..." and one(X.shortened(t, 8), t="abcdefgh") == "abcdefgh"
    assert one(X.chunks(F.split(t, " "), 2), t="a b c") == [["a", "b"], ["c"]]
    assert one(X.last_words(t, 2), t=" a b  c ") == "b c"


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "z"), ("b", "a"), ("c", "a")], "src string, dst string")
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "uri string")
    rank = dict.fromkeys("abc", 0.0)
    for _ in range(7):
        rank = {"a": 0.5 * (rank["b"] + rank["c"]) + 0.5, "b": 0.5 * (rank["a"] * 2 / 3) + 0.5, "c": 0.5}
    assert {r.uri: r.rank for r in G.pagerank(e, docs, 7, cut_every=3).collect()} == pytest.approx(rank)
    dag = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (2, 4)], "src long, dst long")
    assert {r.node: r.rank for r in G.dag_rank(dag).collect()} == {1: 1.0, 2: 1.5, 3: 2.25, 4: 1.75}
    assert G.acyclic([(1, 2), (2, 3), (3, 1), (3, 4)]) == [(1, 2), (2, 3), (3, 4)]
    assert G.robots_rules(["User-agent: other", "Disallow: /x", "", "User-agent: *  # all", "Disallow: /a", "Allow: /b", "User-agent: last", "Disallow: /"], "me") == [(0, "/a", "disallow"), (1, "/b", "allow")]


def test_mapreduce(spark):
    t = spark.createDataFrame([("1", "aaa bb c dd dd"), ("2", "aaa bb"), ("3", "aaa dd dd")], "k string, text string")
    assert {r.key: r.value for r in M.word_frequency(t, F.col("text")).collect()} == {"aaa": 3, "bb": 2, "c": 1, "dd": 4}
    lines = spark.createDataFrame([("Foo NoFoo",), ("x Foo Foo",), ("",)], "line string")
    assert M.count_term(lines, F.col("line"), "Foo").first().n == 3
    assert abs(M.pi(spark, 200_000).first().pi - 3.1416) < 0.05
    dropped = M.reduce_groups(spark.createDataFrame([(1, 2), (1, 3), (2, 1)], "key long, value long"), lambda k, v: int(v.sum()) if k == 1 else None, "long")
    assert [(r.key, r.value) for r in dropped.collect()] == [(1, 5)]


def test_sources_and_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat", "en", "s", 7), (2, "a dog", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    p = I.build(docs)
    tables.write_index(p, docs, f"{tmp_path}/ix")
    assert rows(tables.read_index(spark, f"{tmp_path}/ix")[0]) == rows(p)
    tables.write_xml(docs.select("doc_id", "text"), f"{tmp_path}/xml", "docs", "doc")
    assert tables.read_xml(spark, f"{tmp_path}/xml", "doc", "doc_id long, text string").count() == 2
    (tmp_path / "files/sub").mkdir(parents=True)
    (tmp_path / "files/sub/a.txt").write_text("hé")
    assert [r.text for r in tables.files(spark, f"{tmp_path}/files", "*.txt").collect()] == ["hé"]
    cache = spark.createDataFrame([(1, "c", "old"), (2, "c", "keep")], "doc_id long, context string, content string")
    assert sorted(r.content for r in tables.upsert_text(cache, spark.createDataFrame([(1, "c", "new")], cache.schema)).collect()) == ["keep", "new"]
    docs.write.parquet(f"{tmp_path}/in")
    go = lambda: incremental.run(spark, f"{tmp_path}/in", docs.schema, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    go()
    assert rows(incremental.current(spark, f"{tmp_path}/out")) == rows(p)
    docs.where("doc_id = 1").withColumn("text", F.lit("the cow")).write.mode("append").parquet(f"{tmp_path}/in")
    go()
    words = {r.word for r in incremental.current(spark, f"{tmp_path}/out").where("doc_id = 1").collect()}
    assert "cow" in words and "cat" not in words
    assert ids(incremental.current(spark, f"{tmp_path}/out", docs.where("doc_id = 2"))) == [1]


def test_compacted_stream_goes_on(spark, tmp_path):
    docs = spark.createDataFrame([(1, "old words here", "en", "s"), (2, "more words", "de", "s")], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/in")
    go = lambda out: incremental.run(spark, f"{tmp_path}/in", docs.schema, out, f"{tmp_path}/cp").awaitTermination()
    go(f"{tmp_path}/out")
    incremental.compact(spark, f"{tmp_path}/out", f"{tmp_path}/one")
    assert rows(incremental.current(spark, f"{tmp_path}/one")) == rows(I.build(docs))
    docs.where("doc_id = 1").withColumn("text", F.lit("fresh text")).write.mode("append").parquet(f"{tmp_path}/in")
    go(f"{tmp_path}/one")
    assert {r.word for r in incremental.current(spark, f"{tmp_path}/one").where("context = 'content'").collect()} == {"fresh", "text", "more", "words"}
