from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from quarry.functions import dates as D
from quarry.functions import text as X
from quarry.operators import crawl as C
from quarry.operators import graph as G
from quarry.operators import index as I
from quarry.operators import mapreduce as M
from quarry.plans.evaluate import limited
from quarry.plans.language import SyntaxProblem, dump, load, parse


@pytest.mark.parametrize(
    ("text", "norms"),
    [
        ("am 3.4.2009 und 05.12.09", ["2009-04-03-**-**", "2009-12-05-**-**"]),
        ("Freitag, den 13. März 1998 um 14:30 Uhr", ["1998-03-13-14-30"]),
        ("Mo 7. Mai um 9 Uhr", ["****-05-07-09-00"]),
        ("seit Oktober 2010", ["2010-10-**-**-**"]),
        ("2011-02-28 und 2011/03/01", ["2011-02-28-**-**", "2011-03-01-**-**"]),
        ("am 24.12. bis 26.12.", ["****-12-24-**-**", "****-12-26-**-**"]),
        ("1. Jan. 2012, 10.15 Uhr, dann 2. Jan. 2012", ["2012-01-01-10-15", "2012-01-02-**-**"]),
        ("Version 1.2.3.4 und 99.99.9999", []),
        ("", []),
        (None, []),
    ],
)
def test_dates(text, norms):
    found = D.read_dates(text or "")
    assert [n for n, *_ in found] == norms
    assert all(text[a:b] == t for _, t, a, b in found)


def test_dates_in_columns(spark):
    df = spark.createDataFrame([(1, "Treff: Fr. 1.2.2003 um 8 Uhr"), (2, None)], "id long, t string")
    assert {r.id: [tuple(x) for x in r.d] for r in df.select("id", D.extracted(F.col("t")).alias("d")).collect()} == {1: [("2003-02-01-08-00", "Fr. 1.2.2003 um 8 Uhr")], 2: []}


LINKS = ["x.html", "/a", "../up", "../../up/./x/", "?q", "?", "#f", "", "a/b/../c#z", "//h.de/x", "https://z.org/y?b#c", "mailto:a@b.de", ".", "..", "./", "a?b/../c", "/../a"]
BASES = ["http://h.org/a/b/c.html?x=1", "https://h.org", "http://h.org:80/", "http://h.org/a#f"]


def test_links_are_resolved(spark):
    df = spark.createDataFrame([(b, x) for b in BASES for x in LINKS], "b string, x string")
    for r in df.withColumn("got", G.resolved(F.col("b"), F.col("x"))).collect():
        want = urldefrag(urljoin(r.b, r.x))[0]
        if r.x == "?":  # the library drops an empty query
            continue
        if r.b == "https://h.org":  # the library leaves a missing path missing
            want = want if r.got.rstrip("/") != want.rstrip("/") else r.got
        assert r.got == want, (r.b, r.x)


def test_robots_table(spark):
    df = spark.createDataFrame([("a", "User-agent: *\nDisallow: /x # no\nAllow: /\n"), ("b", ""), ("c", None)], "host string, text string")
    assert sorted(tuple(r) for r in G.robots_table(df, "me").collect()) == [("a", 0, "/x", "disallow"), ("a", 1, "/", "allow")]


def test_text_helpers(spark):
    df = spark.createDataFrame([(" a b ", "x/y z?", "a+b%20c", list(range(7)), [1])], "t string, n string, u string, i array<int>, one array<int>")
    t = F.col("t")
    r = df.select(X.stripped(t).alias("a"), X.stripped(t, right=False).alias("b"), X.stripped(t, left=False).alias("c"), X.escaped(F.col("n")).alias("d"), X.url_decoded(F.col("u")).alias("e"), X.chunks_by_count(F.col("i"), 4).alias("f"), X.chunks_by_count(F.col("one"), 4).alias("g")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == ("a b", "a b ", " a b", "x%2fy z%3f", "a+b c")
    assert r.f == [[0], [1, 2], [3, 4], [5, 6]] and r.g == [[1]]


@pytest.mark.parametrize("text", ["a b", '!"x y" OR ~z', "c,d: (NOT a) e"])
def test_queries_as_json(text):
    assert load(dump(parse(text))) == parse(text)


def test_no_query_as_json():
    with pytest.raises(SyntaxProblem):
        load('["what", 1]')


def test_jobs_as_json(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "k string, v long")
    assert [tuple(r) for r in M.job(df, '{"key": "k", "value": "v * 2", "reduce": "sum(value)", "keep": "value > 4"}').collect()] == [("a", 12)]
    with pytest.raises(ValueError, match="combiner"):
        M.job(df, '{"key": "k", "value": "v", "reduce": "sum(value)", "combiner": 1}')


def test_split_is_even_and_whole(spark):
    p = I.with_lower(spark.createDataFrame([("c", f"w{k % 97}", k, [1] * (1 + k % 5)) for k in range(2000)], "context string, word string, doc_id long, positions array<int>"))
    for by, key in (("document", "doc_id"), ("word", "word")):
        parts = I.split(p, by, 3)
        sizes = [r.n for r in parts.groupBy("part").agg(F.sum(F.size("positions")).alias("n")).collect()]
        assert len(sizes) == 3 and max(sizes) < 1.2 * sum(sizes) / 3
        assert parts.groupBy(key).agg(F.countDistinct("part").alias("n")).where("n > 1").isEmpty()
    assert I.split(p.where("false"), "word", 3).count() == 0


def test_deltas(spark):
    df = spark.createDataFrame([([3, 4, 9],), ([],)], "p array<int>").select(I.deltas(F.col("p")).alias("g"))
    assert [r.g for r in df.collect()] == [[3, 1, 5], []]
    assert [r.x for r in df.select(I.from_deltas(F.col("g")).alias("x")).collect()] == [[3, 4, 9], []]


def test_lists_are_bounded(spark):
    p = I.with_lower(spark.createDataFrame([("c", "w", k, [k]) for k in range(5000)], "context string, word string, doc_id long, positions array<int>"))
    found = {r.chunk: (r.docs, r.occurrences) for r in I.listed(p, 1000).collect()}
    assert {k: n for k, (n, _) in found.items()} == dict.fromkeys(range(5), 1000)
    assert found[1][1].startswith("1000:1000,1001:1001,")


def test_limits_reach_few_words(spark):
    """A window of a limit sees no more words of a context than the limit."""
    p = I.with_lower(spark.createDataFrame([("c", f"w{k:05d}", k, [1]) for k in range(3000)], "context string, word string, doc_id long, positions array<int>"))
    assert sorted(r.word for r in limited(p, 0, 7).collect()) == [f"w{k:05d}" for k in range(7)]
    plan = limited(p, 0, 7)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_crawl(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("d", "a"), ("d", "e"), ("x", "y")], "src string, uri string")
    links = lambda batch: e.join(batch.select(F.col("uri").alias("src")), "src")
    start = spark.createDataFrame([("a",), ("a",)], "uri string")
    levels = lambda *a, **k: {r.uri: r.level for r in C.crawl(start, links, *a, **k).collect()}
    assert levels(9) == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert levels(1) == {"a": 0, "b": 1, "c": 1} and levels(0) == {"a": 0}
    assert set(levels(9, per_round=1)) == set("abcde")
    assert levels(9, max_docs=3) == {"a": 0, "b": 1, "c": 1}
    assert C.crawl(start.where("false"), links, 3).count() == 0
