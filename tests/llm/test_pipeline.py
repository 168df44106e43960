import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quarry.llm import packing, pii, queries, toxicity
from quarry.llm.tokens import FastBpe, default_vocabulary

SF = "/root/testdata/sf0.001"


def test_run_is_brute_force(spark):
    """Near copies by the rule of stages: five words, all pairs, a Jaccard similarity of 0.8 or more."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scorer = toxicity.Scorer(toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    kept = {r.doc_id: r.text for r in docs.collect() if scorer.score(r.text or "") < 0.5}
    ids = sorted(kept)

    def fives(t):
        w = [x for x in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: fives(kept[i]) for i in ids}
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if b < a and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    one = {i: pii.masked(kept[i] or "") for i in ids if root[i] == i}
    bpe = FastBpe(default_vocabulary())
    out = P.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all")).collect()
    assert {r.doc_id: (r.n, r.all) for r in out} == {i: (len(bpe.encode(t)) + 1,) * 2 for i, t in one.items()}


def test_stages(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "packing"]
    rows = [(1, "same words here again", "en", "s", 21, 9), (2, "same words here again", "en", "s", 21, 9), (2, "same words here again", "en", "s", 21, 9), (None, "no id", "en", "s", 5, 9), (3, None, None, None, None, 9), (4, "ip 10.1.2.3 in it", "en", "s", 17, 9), (5, "five", "en", "s", 4, 9), (5, "five", "en", "s", 4, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rows int")
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, SF)
        if k < 3:
            assert docs.columns == names
        if k == 1:
            assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 1, 3, 4, 5]
        if k == 2:
            assert not [r for r in docs.collect() if re.search(r"[0-9]", r.text or "")]
    assert docs.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_stage_drops_edited_copies(spark):
    """Near copies of 5-word Jaccard 0.8 that differ in more than two bits of the operator's fingerprint."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id in (2383, 9234, 3612, 3818, 7743, 9710)")
    assert sorted(r.doc_id for r in P.near_copies(spark, docs, SF).collect()) == [2383, 3612, 7743]


def test_stage_keeps_other_texts_of_an_id(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(1, a), (1, b), (4, c), (5, c), (5, d), (6, b), (7, a), (1, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in P.near_copies(spark, docs, SF).collect()) == [(1, a), (1, b), (4, c), (5, d)]


@pytest.mark.parametrize("name", ["op6_urls", "op8_quotes"])
def test_oracle(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    r = c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(row[c] for c in names)) for row in df.collect()) == sorted(map(repr, r.fetchall()))


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries() if n != "pipeline") == list(range(1, 11))
    assert packing.SIZE == 2048
