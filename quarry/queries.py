"""The engine's own queries by name, each with the same in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import dates as D
from quarry.functions import signatures as S
from quarry.functions import text as X
from quarry.operators import crawl as C
from quarry.operators import graph as G
from quarry.operators import index as I
from quarry.operators import mapreduce as M
from quarry.operators import rank as R
from quarry.plans import dialects, language
from quarry.plans.evaluate import Evaluator, QueryConfig, limited
from quarry.plans.fuzzy import GERMAN, FuzzyConfig, fuzz
from quarry.sources.tables import converted, files, read_index, read_xml, table, upsert_text, write_index, write_sitemap, write_xml

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TOK = r"""tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[^\p{L}\p{Nd}_-]', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents))"""
POST = TOK + r""", postings AS (
  SELECT 'content' AS context, word, lower(word) AS word_lc, doc_id, list_sort(list(DISTINCT CAST(pos AS INT))) AS positions FROM tok WHERE length(word) > 1 AND regexp_matches(word, '\p{L}') GROUP BY word, doc_id
  UNION ALL SELECT 'lang', lang, lower(lang), doc_id, [1] FROM documents UNION ALL SELECT 'source', source, lower(source), doc_id, [1] FROM documents)"""
FLAT = "doc_id, context, word, array_to_string(positions, ',') AS positions"
#: Rows of one leaf, by condition.
LEAF = "SELECT doc_id, context, word, positions FROM postings WHERE {}"
MERGED = "SELECT doc_id, context, word, array_to_string(list_sort(list_distinct(flatten(list(positions)))), ',') AS positions FROM ({}) GROUP BY doc_id, context, word"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


def post(spark: SparkSession, d: str) -> DataFrame:
    return I.build(docs(spark, d))


def flat(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "context", "word", F.array_join("positions", ",").alias("positions"))


def asked(text: str, sql: str | None, name: str, config: QueryConfig | None = None) -> None:
    """Registers a query of the language; sql gives its rows before they are merged."""
    query(f"WITH {POST} {MERGED.format(sql)}" if sql else None, name)(lambda s, d: flat(Evaluator(post(s, d), config)(text)))


# Index construction and scans


@query(f"WITH {POST} SELECT {FLAT} FROM postings")
def idx_build(s: SparkSession, d: str) -> DataFrame:
    return flat(post(s, d))


@query(f"WITH {POST} SELECT {FLAT} FROM postings WHERE context = 'source'")
def idx_scan_context(s: SparkSession, d: str) -> DataFrame:
    return flat(post(s, d).where("context = 'source'"))


@query(f"WITH {POST} SELECT context, word, doc_id // 1024 AS chunk, count(*) AS docs, string_agg(doc_id || ':' || array_to_string(positions, ' '), ',' ORDER BY doc_id) AS occurrences FROM postings GROUP BY context, word, doc_id // 1024")
def idx_to_list(s: SparkSession, d: str) -> DataFrame:
    return I.listed(post(s, d))


@query(f"WITH {POST} SELECT DISTINCT context FROM postings")
def idx_contexts(s: SparkSession, d: str) -> DataFrame:
    return post(s, d).select("context").distinct()


@query(f"WITH {TOK} SELECT doc_id, word, CAST(pos AS INT) AS pos FROM tok WHERE length(word) > 1 AND regexp_matches(word, '\\p{{L}}')")
def idx_positions(s: SparkSession, d: str) -> DataFrame:
    """Positions are given before dull words go."""
    return I.tokens(docs(s, d), I.DOCUMENTS[:1]).select("doc_id", "word", "pos")


PAGE_POST = r"""parts AS (
  SELECT page_id, 'title' AS context, list_filter(string_split(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '[^\p{L}\p{Nd}_-]', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM pages
  UNION ALL SELECT page_id, 'headline', list_filter(string_split(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '[^\p{L}\p{Nd}_-]', ' ', 'g'), ' '), lambda x: x <> '') FROM pages
  UNION ALL SELECT page_id, 'body', list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[^\p{L}\p{Nd}_-]', ' ', 'g'), ' '), lambda x: x <> '') FROM pages
  UNION ALL SELECT page_id, 'uri', regexp_extract_all(url, '[^:/#?=.]+') FROM pages
), page_tok AS (SELECT page_id, context, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM parts)"""


@query(f"""WITH {PAGE_POST} SELECT page_id AS doc_id, context, word, array_to_string(list_sort(list(DISTINCT CAST(pos AS INT))), ',') AS positions FROM page_tok
WHERE CASE WHEN context = 'uri' THEN word NOT IN ('http', 'www', 'de', 'html', 'htm', 'pdf') ELSE length(word) > 1 AND regexp_matches(word, '\\p{{L}}') END GROUP BY page_id, context, word""")
def idx_pages(s: SparkSession, d: str) -> DataFrame:
    return flat(I.build(pages(s, d), I.PAGES, "page_id"))


# Leaves and combinations of the query language

asked("th", LEAF.format("starts_with(word_lc, 'th')"), "q_prefix_nocase")
asked("!Th", LEAF.format("starts_with(word, 'Th')"), "q_prefix_case")
asked("source: src1", LEAF.format("context = 'source' AND starts_with(word_lc, 'src1')"), "q_context")
asked("lang,source: (de OR src2)", LEAF.format("context IN ('lang', 'source') AND (starts_with(word_lc, 'de') OR starts_with(word_lc, 'src2'))"), "q_contexts")


@query(f"WITH {POST} SELECT {FLAT} FROM postings WHERE word = 'The'")
def q_exact_case(s: SparkSession, d: str) -> DataFrame:
    return flat(post(s, d).where("word = 'The'"))


@query(f"WITH {POST} SELECT {FLAT} FROM postings WHERE word_lc = 'the'")
def q_exact_nocase(s: SparkSession, d: str) -> DataFrame:
    return flat(post(s, d).where("word_lc = 'the'"))


A, B = "starts_with(word_lc, 'th')", "starts_with(word_lc, 'de')"
HAS = "doc_id IN (SELECT doc_id FROM postings WHERE {})"
asked("th de", LEAF.format(f"({A} AND {HAS.format(B)}) OR ({B} AND {HAS.format(A)})"), "q_and")
asked("th OR den", LEAF.format(f"{A} OR starts_with(word_lc, 'den')"), "q_or")
asked("th AND NOT de", LEAF.format(f"{A} AND NOT {HAS.format(B)}"), "q_but")
asked("NOT th", LEAF.format(f"NOT {HAS.format(A)}"), "q_not")
asked("content: (NOT de)", LEAF.format(f"context = 'content' AND doc_id NOT IN (SELECT doc_id FROM postings WHERE context = 'content' AND {B})"), "q_not_in_context")
asked("NOT th OR den", f"{LEAF.format('NOT ' + HAS.format(A))} UNION ALL {LEAF.format(chr(115) + 'tarts_with(word_lc, ' + chr(39) + 'den' + chr(39) + ')')}", "q_not_or")
asked("(th OR den) (of OR that)", LEAF.format("((starts_with(word_lc, 'th') OR starts_with(word_lc, 'den')) AND doc_id IN (SELECT doc_id FROM postings WHERE starts_with(word_lc, 'of') OR starts_with(word_lc, 'that'))) OR ((starts_with(word_lc, 'of') OR starts_with(word_lc, 'that')) AND doc_id IN (SELECT doc_id FROM postings WHERE starts_with(word_lc, 'th') OR starts_with(word_lc, 'den')))"), "q_nested")
asked("the th", LEAF.format("starts_with(word_lc, 'the')"), "q_optimize_and")
asked("the OR th", LEAF.format("starts_with(word_lc, 'th')"), "q_optimize_or")

PHRASE = """, firsts AS (SELECT context, doc_id, list_distinct(flatten(list(positions))) AS p FROM postings WHERE {a} GROUP BY context, doc_id),
later AS (SELECT context, doc_id, list_distinct(flatten(list(positions))) AS p FROM postings WHERE {b} GROUP BY context, doc_id)
SELECT doc_id, context, '{text}' AS word, array_to_string(list_sort(firsts.p), ',') AS positions FROM firsts JOIN later USING (context, doc_id) WHERE list_has_any(list_transform(firsts.p, lambda x: x + 1), later.p)"""
query(f"WITH {POST}" + PHRASE.format(a="word_lc = 'of'", b="word_lc = 'the'", text="of the"), "q_phrase")(lambda s, d: flat(Evaluator(post(s, d))('"of the"')))
query(f"WITH {POST}" + PHRASE.format(a="word = 'The'", b="word = 'and'", text="The and"), "q_case_phrase")(lambda s, d: flat(Evaluator(post(s, d))('!"The and"')))

#: An asked word that nothing begins with, so that spelling variants are tried in order.
FUZZY = FuzzyConfig(pairs=GERMAN, limit=1.0)
TRIES = ["xthat", *(w for w, _ in fuzz(FUZZY, "xthat"))]
query(
    f"WITH {POST}, tries(rank, t) AS (VALUES {', '.join(f'({k}, {chr(39)}{w}{chr(39)})' for k, w in enumerate(TRIES))}), hits AS (SELECT p.*, rank FROM postings p JOIN tries ON starts_with(word_lc, t)) "
    + MERGED.format("SELECT * FROM hits WHERE rank = (SELECT min(rank) FROM hits)"),
    "q_fuzzy",
)(lambda s, d: flat(Evaluator(post(s, d), QueryConfig(fuzzy=FUZZY))("~xthat")))

VOCAB = f"WITH {POST}, v AS (SELECT context, word, count(DISTINCT doc_id) AS df FROM postings WHERE starts_with(word_lc, 'th') GROUP BY context, word)"


def th(s: SparkSession, d: str) -> DataFrame:
    return post(s, d).where("startswith(word_lc, 'th')")


@query(VOCAB + ", k AS (SELECT *, coalesce(sum(df) OVER (PARTITION BY context ORDER BY length(word), word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v) SELECT context, word FROM k WHERE before < 500")
def limit_docs(s: SparkSession, d: str) -> DataFrame:
    return limited(th(s, d), 0, 500).select("context", "word").distinct()


@query(VOCAB + ", k AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY df DESC, length(word), word) AS r FROM v) SELECT context, word FROM k WHERE r <= 100")
def limit_words(s: SparkSession, d: str) -> DataFrame:
    return limited(th(s, d), 100, 0).select("context", "word").distinct()


@query(VOCAB + """, k AS (SELECT *, coalesce(sum(df) OVER (PARTITION BY context ORDER BY length(word), word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v),
m AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY df DESC, length(word), word) AS r FROM k WHERE before < 500) SELECT context, word FROM m WHERE r <= 20""")
def limit_both(s: SparkSession, d: str) -> DataFrame:
    return limited(th(s, d), 20, 500).select("context", "word").distinct()


# Ranking, results and pages

TH = f"WITH {POST}, hits AS (SELECT * FROM postings WHERE {A} AND NOT {HAS.format(B)})"
WEIGHTS = {"content": 0.4, "source": 0.2, "lang": 0.8}


def hits(s: SparkSession, d: str) -> DataFrame:
    return Evaluator(post(s, d))("th AND NOT de")


SCORED = TH + ", scored AS (SELECT doc_id, CAST(sum(len(positions)) AS BIGINT) AS score FROM hits GROUP BY doc_id)"


@query(SCORED + " SELECT * FROM scored")
def rank_count(s: SparkSession, d: str) -> DataFrame:
    return R.by_count(hits(s, d))


@query(SCORED + " SELECT doc_id, score, 'doc:' || doc_id AS uri, lang AS title FROM scored JOIN documents USING (doc_id) ORDER BY score DESC, doc_id DESC LIMIT 20")
def rank_flagship(s: SparkSession, d: str) -> DataFrame:
    """Documents for `th AND NOT de`, the 20 best by occurrences, with their table entries."""
    known = docs(s, d).select("doc_id", F.concat(F.lit("doc:"), "doc_id").alias("uri"), F.col("lang").alias("title"))
    return R.documents(R.best(R.by_count(hits(s, d)), 20), known)


ANY = f"WITH {POST}, hits AS (SELECT * FROM postings WHERE starts_with(word_lc, 'de') OR starts_with(word_lc, 'src1'))"
WEIGHT = "CASE context WHEN 'content' THEN 0.5 WHEN 'source' THEN 0.25 WHEN 'lang' THEN 1.0 ELSE 0.0 END"


def any_hits(s: SparkSession, d: str) -> DataFrame:
    return Evaluator(post(s, d))("de OR src1")


@query(ANY + f" SELECT doc_id, round(sum(CAST({WEIGHT} AS DOUBLE) * len(positions)), 6) AS score FROM hits GROUP BY doc_id")
def rank_weighted(s: SparkSession, d: str) -> DataFrame:
    return R.weighted(any_hits(s, d), WEIGHTS).select("doc_id", F.round("score", 6).alias("score"))


@query(ANY + " SELECT word, CAST(sum(len(positions)) AS BIGINT) AS score FROM hits GROUP BY word")
def rank_words(s: SparkSession, d: str) -> DataFrame:
    return R.by_count(any_hits(s, d), "word")


@query(ANY + f" SELECT word, round(sum(CAST({WEIGHT} AS DOUBLE) * len(positions)), 6) AS score FROM hits GROUP BY word")
def rank_words_weighted(s: SparkSession, d: str) -> DataFrame:
    return R.weighted(any_hits(s, d), WEIGHTS, "word").select("word", F.round("score", 6).alias("score"))


@query(SCORED + """, ranked AS (SELECT s.doc_id, score / (1 + length(d.source)) * CASE WHEN d.lang = 'en' THEN 2 ELSE 1 END * CASE WHEN d.source = 'src1' THEN 4 ELSE 1 END AS score FROM scored s JOIN documents d USING (doc_id))
SELECT doc_id, round(score, 6) AS score FROM ranked""")
def rank_custom(s: SparkSession, d: str) -> DataFrame:
    """A score by formula: count over depth, more for one language, more for an exact source."""
    out = R.by_count(hits(s, d)).join(docs(s, d).select("doc_id", "lang", "source"), "doc_id")
    boost = F.when(F.col("lang") == "en", 2).otherwise(1) * F.when(F.col("source") == "src1", 4).otherwise(1)
    return out.select("doc_id", F.round(F.col("score") / (1 + F.length("source")) * boost, 6).alias("score"))


@query(SCORED + ", r(source, rank) AS (VALUES ('src1', 2.5), ('src2', 1.5)) SELECT doc_id, CAST(coalesce(rank, 1.0) AS DOUBLE) AS score FROM scored JOIN documents USING (doc_id) LEFT JOIN r USING (source)")
def rank_table(s: SparkSession, d: str) -> DataFrame:
    """By a table of ranks, 1.0 where it has none."""
    ranks = s.createDataFrame([("src1", 2.5), ("src2", 1.5)], "source string, rank double")
    return R.by_count(hits(s, d)).join(docs(s, d), "doc_id").join(F.broadcast(ranks), "source", "left").select("doc_id", F.coalesce("rank", F.lit(1.0)).alias("score"))


@query(SCORED + " SELECT split_part(source, 'c', 1) || lang AS facet, count(*) AS hits FROM scored JOIN documents USING (doc_id) GROUP BY 1")
def rank_facets(s: SparkSession, d: str) -> DataFrame:
    return R.facets(R.by_count(hits(s, d)).join(docs(s, d), "doc_id"), F.concat(F.split_part("source", F.lit("c"), F.lit(1)), "lang"))


@query(ANY + " SELECT word, CASE WHEN context = 'source' THEN 'src1' ELSE 'de' END AS terms, count(*) AS places, CAST(sum(len(positions)) AS BIGINT) AS score FROM hits GROUP BY 1, 2")
def result_words(s: SparkSession, d: str) -> DataFrame:
    return R.word_hits(any_hits(s, d)).withColumn("terms", F.array_join("terms", " "))


@query(ANY + " SELECT word, count(*) AS hits FROM hits GROUP BY word")
def result_completions(s: SparkSession, d: str) -> DataFrame:
    return R.completions(any_hits(s, d))


@query(SCORED + " SELECT count(*) AS docs, max(score) AS best, (SELECT count(DISTINCT word) FROM hits) AS words FROM scored")
def result_sizes(s: SparkSession, d: str) -> DataFrame:
    rows = hits(s, d)
    return R.by_count(rows).agg(F.count("*").alias("docs"), F.max("score").alias("best")).crossJoin(rows.agg(F.countDistinct("word").alias("words")))  # one row each


@query(SCORED + " SELECT * FROM scored ORDER BY score DESC, doc_id DESC LIMIT 100")
def result_top(s: SparkSession, d: str) -> DataFrame:
    return R.best(R.by_count(hits(s, d)), 100)


@query(SCORED + " SELECT * FROM scored ORDER BY score DESC, doc_id DESC LIMIT 10 OFFSET 20")
def result_page(s: SparkSession, d: str) -> DataFrame:
    return R.page(R.by_count(hits(s, d)), 3)


@query(SCORED + ", n AS (SELECT s.*, lang AS title, row_number() OVER (PARTITION BY lang, source ORDER BY score DESC, doc_id DESC) AS r, source FROM scored s JOIN documents USING (doc_id)) SELECT doc_id, score, title || source AS title FROM n WHERE r = 1")
def result_one_per_title(s: SparkSession, d: str) -> DataFrame:
    titled = R.by_count(hits(s, d)).join(docs(s, d).select("doc_id", F.concat("lang", "source").alias("title")), "doc_id")
    return R.one_per(titled, "title")


@query(SCORED + " SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"score\":' || score || '}' AS json FROM scored ORDER BY score DESC, doc_id DESC LIMIT 100")
def result_json(s: SparkSession, d: str) -> DataFrame:
    return R.as_json(R.by_count(hits(s, d)))


@query(f"WITH {POST} SELECT DISTINCT word FROM postings WHERE context = 'content' ORDER BY word")
def result_word_list(s: SparkSession, d: str) -> DataFrame:
    return post(s, d).where("context = 'content'").select("word").distinct().orderBy("word")


# Statistics


@query(f"WITH {POST} SELECT context, count(DISTINCT doc_id) AS docs, count(DISTINCT word) AS words, count(*) AS postings, CAST(sum(len(positions)) AS BIGINT) AS positions FROM postings GROUP BY ROLLUP (context)")
def stats_contexts(s: SparkSession, d: str) -> DataFrame:
    return I.statistics(post(s, d))


@query(f"WITH {POST} SELECT context, min(length(word)) AS shortest, max(length(word)) AS longest, round(avg(length(word)), 6) AS mean_length, max(len(positions)) AS most, CAST(round(quantile_cont(CAST(len(positions) AS DOUBLE), 0.9), 6) AS DOUBLE) AS p90 FROM postings GROUP BY context")
def stats_shape(s: SparkSession, d: str) -> DataFrame:
    n, size = F.length("word"), F.size("positions")
    return post(s, d).groupBy("context").agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean_length"), F.max(size).alias("most"), F.round(F.percentile(size, 0.9), 6).alias("p90"))


@query(f"WITH {POST} SELECT count(*) AS words FROM (SELECT DISTINCT context, word FROM postings)")
def stats_words(s: SparkSession, d: str) -> DataFrame:
    return post(s, d).agg(F.countDistinct("context", "word").alias("words"))


@query(f"WITH {POST} SELECT doc_id, count(*) AS words, CAST(sum(len(positions)) AS BIGINT) AS positions FROM postings GROUP BY doc_id")
def stats_docs(s: SparkSession, d: str) -> DataFrame:
    return post(s, d).groupBy("doc_id").agg(F.count("*").alias("words"), F.sum(F.size("positions")).cast("long").alias("positions"))


# Maintenance


def halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping indexes: two languages each, one shared."""
    p = docs(s, d)
    return I.build(p.where("lang in ('en', 'de')")), I.build(p.where("lang in ('de', 'fr')"))


def in_langs(*langs: str) -> str:
    return "doc_id IN (SELECT doc_id FROM documents WHERE lang IN (" + ", ".join(f"'{x}'" for x in langs) + "))"


@query(f"WITH {POST} SELECT {FLAT} FROM postings WHERE {in_langs('en', 'de', 'fr')}")
def maint_merge(s: SparkSession, d: str) -> DataFrame:
    return flat(I.merge(*halves(s, d)))


@query(f"WITH {POST} SELECT {FLAT} FROM postings WHERE {in_langs('en')}")
def maint_subtract(s: SparkSession, d: str) -> DataFrame:
    return flat(I.subtract(*halves(s, d)))


@query(f"WITH {POST}, cut AS (SELECT context, word, doc_id, list_filter(positions, lambda p: p > 10) AS positions FROM postings WHERE context = 'content') SELECT {FLAT} FROM cut WHERE len(positions) > 0")
def maint_subtract_positions(s: SparkSession, d: str) -> DataFrame:
    p = post(s, d).where("context = 'content'")
    return flat(I.subtract(p, p.withColumn("positions", F.filter("positions", lambda x: x <= 10))))


@query(f"WITH {POST} SELECT {FLAT} FROM postings WHERE NOT {in_langs('es')}")
def maint_remove(s: SparkSession, d: str) -> DataFrame:
    return flat(I.without_docs(post(s, d), docs(s, d).where("lang = 'es'")))


@query(f"WITH {POST} SELECT doc_id // 2 AS doc_id, context, word, array_to_string(list_sort(list_distinct(flatten(list(positions)))), ',') AS positions FROM postings GROUP BY doc_id // 2, context, word")
def maint_map_ids(s: SparkSession, d: str) -> DataFrame:
    return flat(I.with_ids(post(s, d), F.floor(F.col("doc_id") / 2)))


@query(f"WITH {POST}, p AS (SELECT * FROM postings WHERE {in_langs('de', 'fr')}), n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM (SELECT DISTINCT doc_id FROM p)) SELECT n.k AS doc_id, context, word, array_to_string(positions, ',') AS positions FROM p JOIN n USING (doc_id)")
def maint_defragment(s: SparkSession, d: str) -> DataFrame:
    return flat(I.defragment(halves(s, d)[1]))


def doc_table(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.concat(F.lit("doc:"), "doc_id").alias("uri"), F.col("lang").alias("title"))


@query("SELECT doc_id, 'doc:' || doc_id AS uri, lang AS title FROM documents WHERE lang IN ('en', 'de') UNION ALL SELECT doc_id + t - m + 1, 'doc:' || doc_id, lang FROM documents, (SELECT (SELECT max(doc_id) FROM documents WHERE lang IN ('en', 'de')) AS t, (SELECT min(doc_id) FROM documents WHERE lang IN ('de', 'fr')) AS m) WHERE lang IN ('de', 'fr')")
def maint_shifted_union(s: SparkSession, d: str) -> DataFrame:
    t = doc_table(s, d)
    left, right = t.where("title in ('en', 'de')"), t.where("title in ('de', 'fr')")
    return I.shifted_union(left, left, right, right)[0]


@query("""WITH l AS (SELECT doc_id, 'doc:' || doc_id AS uri FROM documents WHERE lang IN ('en', 'de')), r AS (SELECT doc_id, 'doc:' || doc_id AS uri FROM documents WHERE lang IN ('de', 'fr'))
SELECT r.doc_id AS old_id, l.doc_id AS doc_id FROM r JOIN l USING (uri) UNION ALL
SELECT doc_id, (SELECT max(doc_id) FROM l) + row_number() OVER (ORDER BY doc_id) FROM r WHERE uri NOT IN (SELECT uri FROM l)""")
def maint_merge_docs(s: SparkSession, d: str) -> DataFrame:
    t = doc_table(s, d)
    return I.merged_docs(t.where("title in ('en', 'de')"), t.where("title in ('de', 'fr')"))


@query("SELECT doc_id, 'doc:' || doc_id AS uri, lang AS title FROM documents WHERE lang IN ('en', 'de', 'fr')")
def maint_insert_docs(s: SparkSession, d: str) -> DataFrame:
    t = doc_table(s, d)
    return I.insert_docs(t.where("title in ('en', 'de')"), t.where("title in ('de', 'fr')"))


@query("SELECT doc_id, 'doc:' || doc_id AS uri, CASE lang WHEN 'de' THEN 'DE' ELSE lang END AS title FROM documents")
def maint_update_docs(s: SparkSession, d: str) -> DataFrame:
    t = doc_table(s, d)
    return I.update_docs(t, t.where("title = 'de'").withColumn("title", F.upper("title")))


@query("SELECT doc_id, 'doc:' || doc_id AS uri, upper(lang) AS title FROM documents WHERE n_chars > 1000")
def maint_filter_docs(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).where("n_chars > 1000").select("doc_id", F.concat(F.lit("doc:"), "doc_id").alias("uri"), F.upper("lang").alias("title"))


@query(f"WITH {TOK} SELECT doc_id, 'doc:' || doc_id AS uri, lang AS title FROM documents WHERE doc_id IN (SELECT doc_id FROM tok WHERE length(word) > 1 AND regexp_matches(word, '\\p{{L}}'))")
def maint_indexed_docs(s: SparkSession, d: str) -> DataFrame:
    return I.indexed_docs(doc_table(s, d), I.build(docs(s, d), I.DOCUMENTS[:1]))


@query("SELECT NOT EXISTS (SELECT 1 FROM documents a JOIN documents b USING (doc_id) WHERE a.lang IN ('en', 'de') AND b.lang IN ('de', 'fr')) AS disjoint")
def maint_disjoint(s: SparkSession, d: str) -> DataFrame:
    t = docs(s, d)
    return I.disjoint(t.where("lang in ('en', 'de')"), t.where("lang in ('de', 'fr')"))


@query("SELECT doc_id, 'doc:' || doc_id AS uri, sha1('doc:' || doc_id) AS digest FROM documents")
def maint_lookup(s: SparkSession, d: str) -> DataFrame:
    """Documents by URI, through the digests that hashed ids are made of."""
    t = doc_table(s, d)
    return t.join(t.select("uri", F.sha1("uri").alias("digest")), "uri").select("doc_id", "uri", "digest")


for _by, _piece, _size in (("context", "context", "count(DISTINCT word)"), ("document", "doc_id", "sum(len(positions))"), ("word", "word", "sum(len(positions))")):
    query(f"WITH {POST} SELECT CAST({_piece} AS VARCHAR) AS piece, CAST({_size} AS BIGINT) AS size FROM postings GROUP BY {_piece}", f"maint_split_{_by}")(lambda s, d, by=_by: I.sizes(post(s, d), by))


# Text functions


def tokens_sql(expr: str) -> str:
    return f"SELECT doc_id, array_to_string({expr}, '|') AS w FROM documents"


def per_doc(fn: Callable[[Column], Column]) -> Query:
    return lambda s, d: docs(s, d).select("doc_id", F.array_join(fn(F.col("text")), "|").alias("w"))


query(tokens_sql(r"list_filter(string_split(regexp_replace(text, '[^\p{L}\p{Nd}_-]', ' ', 'g'), ' '), lambda x: x <> '')"), "fn_words")(per_doc(X.words))
query(tokens_sql(r"regexp_extract_all(text, '[\p{L}\p{Nd}.\-_''@]+')"), "fn_address_words")(per_doc(X.address_words))
query(tokens_sql("regexp_extract_all(text, '[A-Za-z][-A-Za-z0-9.@]*[A-Za-z0-9]')"), "fn_description_words")(per_doc(lambda c: X.matches(c, X.DESCRIPTION_WORD)))


@query(f"WITH {TOK} SELECT DISTINCT word, (length(word) < 2 OR NOT regexp_matches(word, '\\p{{L}}')) AS dull FROM tok")
def fn_dull_words(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select(F.explode(X.words(F.col("text"))).alias("word")).distinct().withColumn("dull", X.dull(F.col("word")))


@query(r"SELECT doc_id, regexp_full_match(source, 'src[0-9]') AS whole, regexp_replace(text, '[aeiou]+', '*', 'g') AS replaced, len(regexp_split_to_array(text, '\s+')) AS parts FROM documents")
def fn_patterns(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return docs(s, d).select("doc_id", X.whole_match(F.col("source"), "src[0-9]").alias("whole"), F.regexp_replace(t, "[aeiou]+", "*").alias("replaced"), F.size(F.split(t, r"\s+")).cast("long").alias("parts"))


@query("SELECT page_id, array_to_string(regexp_extract_all(url, '[^:/#?=.]+'), '|') AS w, array_to_string(list_filter(regexp_extract_all(url, '[^:/#?=.]+'), lambda x: x NOT IN ('', 'http', 'www', 'de', 'html', 'htm', 'pdf')), '|') AS kept FROM pages")
def fn_url_words(s: SparkSession, d: str) -> DataFrame:
    w = X.url_words(F.col("url"))
    return pages(s, d).select("page_id", F.array_join(w, "|").alias("w"), F.array_join(F.filter(w, lambda x: ~x.isin(*X.DULL_URL_PARTS)), "|").alias("kept"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS headline, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages")
def fn_html_parts(s: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return pages(s, d).select("page_id", X.title(h).alias("title"), X.headline(h).alias("headline"), X.plain(h).alias("body"))


@query(r"""WITH w AS (SELECT page_id, html, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+'), lambda x: x <> '') AS w FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Ada Lore' WHEN 1 THEN 'Cy Dell' ELSE CASE WHEN page_id % 4 = 2 AND page_id % 3 = 0 THEN 'Bo Berg' END END AS author,
CASE WHEN page_id % 2 = 0 THEN '05. März 2010, 14:30 Uhr' ELSE 'Juni 2010' END AS modified, array_to_string(w[1:50], ' ') || CASE WHEN len(w) > 50 THEN ' ...' ELSE '' END AS teaser FROM w""")
def fn_page_info(s: SparkSession, d: str) -> DataFrame:
    """A page's author by its address or its template, when it was changed, and how it begins."""
    k = F.col("page_id")
    user = F.when(k % 4 == 0, "/~al/").when((k % 4 == 2) & (k % 3 == 0), "/~bo/x").otherwise("/~zz/")
    box = F.when(k % 4 == 1, '<div class="author"><b>Cy</b>\nDell</div>').otherwise("")
    changed = F.when(k % 2 == 0, "2010-03-05-14-30").otherwise("2010-06-**-**-**")
    p = pages(s, d).select("page_id", "html", F.concat(F.lit("http://h.org"), user).alias("at"), F.concat(F.lit('<meta name="date" content="'), changed, F.lit('">'), box).alias("head"))
    author = F.coalesce(X.owner(F.col("at"), {"al": "Ada Lore", "bo": "Bo Berg"}), X.class_text(F.col("head"), "div", "author"))
    return p.select("page_id", author.alias("author"), D.displayed(X.meta(F.col("head"), "date")).alias("modified"), X.teaser(X.plain(F.col("html"))).alias("teaser"))


@query("SELECT page_id, CASE WHEN regexp_extract(html, '(?s)<title>(.*?)</title>', 1) = '' THEN string_split(url, '/')[-1] ELSE trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')) END AS title FROM pages")
def fn_title_or_name(s: SparkSession, d: str) -> DataFrame:
    return pages(s, d).select("page_id", F.coalesce(F.nullif(X.title(F.col("html")), F.lit("")), F.substring_index("url", "/", -1)).alias("title"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS tidy, CASE WHEN length(text) > 40 THEN substr(text, 1, 37) || '...' ELSE text END AS short FROM conversations")
def fn_tidy(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(s, d, "conversations").select("conv_id", "turn", X.tidy(t).alias("tidy"), X.shortened(t, 40).alias("short"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(text, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'), 'ß', 'ss') AS text FROM documents")
def fn_umlauts(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", X.without_umlauts(F.col("text")).alias("text"))


@query("SELECT p_partkey, replace(regexp_replace(p_type, '([A-Z]+)', ' \\1', 'g'), '_', ' ') AS spaced, array_to_string(list_concat([p_brand], string_split(p_brand, '#')[2:]), '|') AS dashed FROM part")
def fn_camel_dash(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", X.spaced_capitals(F.col("p_type")).alias("spaced"), F.array_join(F.concat(F.array("p_brand"), F.slice(X.dashed(F.replace("p_brand", F.lit("#"), F.lit("-"))), 2, 100)), "|").alias("dashed"))


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:5], ' ') AS first, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[-5:], ' ') AS last FROM documents")
def fn_first_last_words(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", X.first_words(F.col("text"), 5).alias("first"), X.last_words(F.col("text"), 5).alias("last"))


@query(r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, k // 100 AS chunk, string_agg(word, ' ' ORDER BY k) AS words FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS k FROM w) GROUP BY doc_id, k // 100")
def fn_chunks(s: SparkSession, d: str) -> DataFrame:
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return docs(s, d).select("doc_id", F.posexplode(X.chunks(w, 100)).alias("chunk", "c")).select("doc_id", F.col("chunk").cast("long"), F.array_join("c", " ").alias("words"))


@query("SELECT page_id, md5(html) AS md5, sha1(url) AS sha1 FROM pages")
def fn_digests(s: SparkSession, d: str) -> DataFrame:
    return pages(s, d).select("page_id", F.md5("html").alias("md5"), F.sha1("url").alias("sha1"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def fn_json(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/?#:]*)', 1) AS host, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site FROM pages")
def fn_hosts(s: SparkSession, d: str) -> DataFrame:
    return pages(s, d).select("page_id", F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("host"), G.site(F.col("url")).alias("site"))


@query(r"SELECT page_id, k AS section, words FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<p>([^<]*)', 1)) AS words, generate_subscripts(regexp_extract_all(html, '(?s)<p>([^<]*)', 1), 1) AS k FROM pages)")
def fn_sections(s: SparkSession, d: str) -> DataFrame:
    """A page as many virtual documents, one per paragraph."""
    parts = F.regexp_extract_all("html", F.lit(r"(?s)<p>([^<]*)"), F.lit(1))
    return pages(s, d).select("page_id", F.posexplode(parts).alias("k", "words")).select("page_id", (F.col("k") + 1).alias("section"), "words")


# Dates


@query("SELECT o_orderkey, printf('%04d-%02d-%02d-**-**', year(o_orderdate), month(o_orderdate), day(o_orderdate)) AS norm FROM orders")
def date_normal(s: SparkSession, d: str) -> DataFrame:
    o, none = F.col("o_orderdate"), F.lit(None).cast("int")
    return table(s, d, "orders").select("o_orderkey", D.normal(F.year(o), F.month(o), F.dayofmonth(o), none, none).alias("norm"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '-**-**' AS found FROM orders")
def date_found(s: SparkSession, d: str) -> DataFrame:
    """Numeric dates found in text and brought to normal form."""
    text = F.concat(F.lit("am "), F.date_format("o_orderdate", "d.M.yyyy"), F.lit(" um"))
    return table(s, d, "orders").select("o_orderkey", F.array_join(D.found(text), ",").alias("found"))


@query("""WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), m AS (SELECT day, day + CAST(day(last_day(day)) AS INT) AS later FROM o), spans AS (
SELECT day, 'today' AS alias, day AS a, day AS b FROM o UNION ALL SELECT day, 'tomorrow', day + 1, day + 1 FROM o
UNION ALL SELECT day, 'this week', CAST(date_trunc('week', day) AS DATE), CAST(date_trunc('week', day) AS DATE) + 6 FROM o UNION ALL SELECT day, 'next week', CAST(date_trunc('week', day) AS DATE) + 7, CAST(date_trunc('week', day) AS DATE) + 13 FROM o
UNION ALL SELECT day, 'this month', CAST(date_trunc('month', day) AS DATE), last_day(day) FROM o UNION ALL SELECT day, 'next month', CAST(date_trunc('month', later) AS DATE), last_day(later) FROM m)
SELECT CAST(day AS VARCHAR) AS day, alias, CAST(a AS VARCHAR) AS first, CAST(b AS VARCHAR) AS last, CAST(b - a + 1 AS BIGINT) AS days FROM spans""")
def date_alias(s: SparkSession, d: str) -> DataFrame:
    days = table(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    names = ["today", "tomorrow", "this week", "next week", "this month", "next month"]
    each = days.select("day", F.explode(F.array(*[F.struct(F.lit(n).alias("alias"), D.alias(n, F.col("day")).alias("days")) for n in names])).alias("x")).select("day", "x.*")
    return each.select(F.col("day").cast("string"), "alias", F.array_min("days").cast("string").alias("first"), F.array_max("days").cast("string").alias("last"), F.size("days").cast("long").alias("days"))


@query("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= strftime(DATE '1998-08-02' - 365, '%Y-%m-%d')")
def date_newer(s: SparkSession, d: str) -> DataFrame:
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(s, d, "orders").where(D.newer_than(text, F.lit("1998-08-02").cast("date"), 365)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') LIKE '1996-02-%' OR strftime(o_orderdate, '%Y-%m-%d') LIKE '1996-03-%'")
def date_query(s: SparkSession, d: str) -> DataFrame:
    """Dates in a query become an OR of normal-form prefixes."""
    norm = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(s, d, "orders").where(norm.startswith("1996-02-") | norm.startswith("1996-03-")).select("o_orderkey")


# Links, crawl rules and graphs

LINKS = """links AS (SELECT url AS src, unnest(regexp_extract_all(html, '<(?:a|frame|iframe)\\s[^>]*?(?:href|src)="([^"]*)"', 1)) AS dst FROM pages)"""


@query(f"WITH {LINKS} SELECT src, dst FROM links")
def graph_links(s: SparkSession, d: str) -> DataFrame:
    return G.page_links(pages(s, d))


@query(f"WITH {LINKS} SELECT DISTINCT src, regexp_extract(src, '^(https?://[^/?#]*)', 1) || dst AS dst FROM links WHERE starts_with(dst, '/')")
def graph_absolute(s: SparkSession, d: str) -> DataFrame:
    e = G.page_links(pages(s, d)).where(F.col("dst").startswith("/"))
    return e.select("src", G.absolute(F.col("src"), F.col("dst")).alias("dst")).distinct()


@query(f"WITH {LINKS} SELECT dst, string_agg(DISTINCT src, ',' ORDER BY src) AS srcs FROM links GROUP BY dst")
def graph_reverse(s: SparkSession, d: str) -> DataFrame:
    return G.reverse_links(G.page_links(pages(s, d))).select("dst", F.array_join("srcs", ",").alias("srcs"))


@query("SELECT page_id, (regexp_full_match(url, 'https://.*') OR regexp_full_match(url, 'http://.*/en/.*')) AND NOT regexp_full_match(url, '.*[?].*') AS followed, regexp_matches(url, '/en/') AND NOT regexp_matches(url, '[#?]') AS older FROM pages")
def graph_follow(s: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return pages(s, d).select("page_id", G.followed(u, ["https://.*", "http://.*/en/.*"], [".*[?].*"]).alias("followed"), G.followed_within(u, ["/en/"], ["[#?]"]).alias("older"))


RULES = [("[?]", "dynamic"), ("[.]html$", "file"), ("/$", "folder")]


@query("SELECT page_id, CASE WHEN regexp_matches(url, '[?]') THEN 'dynamic' WHEN regexp_matches(url, '[.]html$') THEN 'file' WHEN regexp_matches(url, '/$') THEN 'folder' ELSE 'other' END AS class, CASE WHEN regexp_matches(url, '/en/') THEN true WHEN regexp_matches(url, 'example') THEN false ELSE true END AS crawled FROM pages")
def graph_classes(s: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return pages(s, d).select("page_id", G.first_rule(u, RULES, "other").alias("class"), G.first_rule(u, [("/en/", True), ("example", False)], True).alias("crawled"))


@query("""WITH hosts AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#:]*)', 1) AS host FROM pages), rules AS (SELECT host, seq, prefix, action FROM hosts, (VALUES (0, '/en/1', 'allow'), (1, '/en/', 'disallow'), (2, '/de', 'disallow'), (3, '', 'disallow')) r(seq, prefix, action)),
u AS (SELECT DISTINCT url, regexp_extract(url, '^https?://([^/?#:]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) AS path FROM pages)
SELECT url, coalesce((SELECT arg_min(action, seq) FROM rules WHERE rules.host = u.host AND prefix <> '' AND starts_with(path, prefix)), 'allow') <> 'disallow' AS allowed FROM u""")
def graph_robots(s: SparkSession, d: str) -> DataFrame:
    u = pages(s, d).select("url").distinct()
    rows = F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(p).alias("prefix"), F.lit(a).alias("action")) for k, (p, a) in enumerate([("/en/1", "allow"), ("/en/", "disallow"), ("/de", "disallow"), ("", "disallow")])])
    rules = u.select(F.regexp_extract("url", r"^https?://([^/?#:]*)", 1).alias("host")).distinct().select("host", F.inline(rows))
    return G.robots_allowed(u, rules)


@query("SELECT page_id, len(list_filter(regexp_split_to_array(lower(regexp_extract(html, '(?is)<meta\\s+name=[\"'']robots[\"'']\\s+content=[\"'']([^\"'']*)[\"'']', 1)), '[^a-z]+'), lambda w: w IN ('noindex', 'none'))) > 0 AS noindex FROM pages")
def graph_meta_robots(s: SparkSession, d: str) -> DataFrame:
    return pages(s, d).select("page_id", G.meta_robots(F.col("html"), "noindex").alias("noindex"))


@query("SELECT md5(html) AS digest, first(url ORDER BY length(url), url) AS url, count(*) AS copies FROM pages GROUP BY md5(html)")
def graph_copies(s: SparkSession, d: str) -> DataFrame:
    return G.shortest_copies(pages(s, d))


@query(f"WITH {LINKS} SELECT dst AS uri, min(length(src) % 5) AS level FROM links WHERE dst NOT IN (SELECT dst FROM links WHERE src LIKE 'https:%' AND dst IS NOT NULL) GROUP BY dst HAVING min(length(src) % 5) <= 3")
def graph_frontier(s: SparkSession, d: str) -> DataFrame:
    e = G.page_links(pages(s, d))
    found = e.select(F.col("dst").alias("uri"), (F.length("src") % 5).cast("long").alias("level"))
    return G.frontier(found, e.where("src like 'https:%'").select(F.col("dst").alias("uri")), 3)


@query(f"WITH {LINKS} SELECT DISTINCT dst AS uri FROM links ORDER BY uri LIMIT 50")
def graph_next(s: SparkSession, d: str) -> DataFrame:
    return G.page_links(pages(s, d)).select(F.col("dst").alias("uri")).distinct().orderBy("uri").limit(50)


def trade(s: SparkSession, d: str) -> DataFrame:
    """A link graph over customers, made from orders, repeats and unknown targets included."""
    o = table(s, d, "orders")
    targets = F.array(((F.col("o_custkey") * 7 + 1) % 2000).cast("string"), ((F.col("o_orderkey") * 13 + 5) % 2000).cast("string"))
    return o.select(F.col("o_custkey").cast("string").alias("src"), F.explode(targets).alias("dst"))


def rank_sql(rounds: int) -> str:
    out = """WITH edges AS (SELECT CAST(o_custkey AS VARCHAR) AS src, CAST(unnest([(o_custkey * 7 + 1) % 2000, (o_orderkey * 13 + 5) % 2000]) AS VARCHAR) AS dst FROM orders), docs AS (SELECT CAST(c_custkey AS VARCHAR) AS uri FROM customer),
flow AS (SELECT src, dst, 1.0::DOUBLE * count(*) / (SELECT count(*) FROM edges e WHERE e.src = f.src) AS share FROM edges f WHERE src IN (SELECT uri FROM docs) AND dst IN (SELECT uri FROM docs) GROUP BY src, dst), r0 AS (SELECT uri, 0.0::DOUBLE AS rank FROM docs)"""
    for k in range(rounds):
        out += f", r{k + 1} AS (SELECT uri, 0.5 * coalesce((SELECT sum(rank * share) FROM flow JOIN r{k} ON r{k}.uri = flow.src WHERE dst = docs.uri), 0) + 0.5 AS rank FROM docs)"
    return out + f" SELECT uri, round(rank, 6) AS rank FROM r{rounds}"


@query(rank_sql(5))
def graph_pagerank(s: SparkSession, d: str) -> DataFrame:
    known = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("uri"))
    return G.pagerank(trade(s, d), known, rounds=5).select("uri", F.round("rank", 6).alias("rank"))


@query("""WITH RECURSIVE edges AS (SELECT DISTINCT l_orderkey % 40 + 40 AS src, l_partkey % 40 AS dst FROM lineitem UNION SELECT DISTINCT l_suppkey % 40 + 80, l_orderkey % 40 + 40 FROM lineitem), nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
top AS (SELECT node FROM nodes WHERE node NOT IN (SELECT dst FROM edges)), r2 AS (SELECT dst AS node, 1 + 0.5 * count(*) AS rank FROM edges WHERE src >= 80 GROUP BY dst),
rank AS (SELECT node, coalesce((SELECT rank FROM r2 WHERE r2.node = nodes.node), 1 + 0.5 * (SELECT coalesce(sum(r2.rank), 0) FROM edges JOIN r2 ON r2.node = edges.src WHERE edges.dst = nodes.node)) AS rank FROM nodes)
SELECT CAST(node AS BIGINT) AS node, CAST(CASE WHEN node >= 80 THEN 1.0 ELSE round(rank, 6) END AS DOUBLE) AS rank FROM rank""")
def graph_dag_rank(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    a = li.select((F.col("l_orderkey") % 40 + 40).alias("src"), (F.col("l_partkey") % 40).alias("dst"))
    b = li.select((F.col("l_suppkey") % 40 + 80).alias("src"), (F.col("l_orderkey") % 40 + 40).alias("dst"))
    return G.dag_rank(a.union(b).distinct()).select("node", F.round("rank", 6).alias("rank"))


@query(f"WITH {LINKS} SELECT src, dst FROM links WHERE dst IN (SELECT dst FROM links GROUP BY dst HAVING count(*) > 1)")
def graph_known_targets(s: SparkSession, d: str) -> DataFrame:
    """Links to known documents only."""
    e = G.page_links(pages(s, d))
    return e.join(e.groupBy("dst").count().where("count > 1"), "dst", "left_semi").select("src", "dst")


# MapReduce


@query(r"SELECT word AS key, count(*) AS value FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS word FROM documents) GROUP BY word")
def mr_word_frequency(s: SparkSession, d: str) -> DataFrame:
    return M.word_frequency(docs(s, d), F.col("text"))


@query("SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[02468]$')")
def mr_grep(s: SparkSession, d: str) -> DataFrame:
    return M.grep(table(s, d, "customer"), "c_name", "[02468]$").select("c_custkey", "c_name")


@query(r"SELECT CAST(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x = 'the'))) AS BIGINT) AS n FROM documents")
def mr_count(s: SparkSession, d: str) -> DataFrame:
    return M.count_term(docs(s, d), F.col("text"), "the")


@query("SELECT l_returnflag AS key, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem GROUP BY l_returnflag")
def mr_sum(s: SparkSession, d: str) -> DataFrame:
    return M.map_reduce(table(s, d, "lineitem"), M.pair(F.col("l_returnflag"), F.col("l_quantity").cast("long")), F.sum("value"), splits=8, reducers=4)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey")
def mr_sort(s: SparkSession, d: str) -> DataFrame:
    return M.sorted_by(table(s, d, "customer").select("c_custkey", "c_name"), "c_name", "c_custkey")


@query("SELECT user_id AS key, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY user_id HAVING count(*) > 5")
def mr_optional(s: SparkSession, d: str) -> DataFrame:
    """A reducer may drop keys."""
    return M.map_reduce(table(s, d, "events"), M.pair(F.col("user_id"), F.lit(1)), F.count("value"), keep=F.col("value") > 5)


@query("SELECT o_orderpriority AS key, CAST(max(o_orderkey) - min(o_orderkey) AS BIGINT) AS value FROM orders GROUP BY 1")
def mr_python(s: SparkSession, d: str) -> DataFrame:
    """A Python reducer, on values combined by key and slice before they meet."""
    combined = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("key"), (F.col("o_orderkey") % 64).alias("slice")).agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
    rows = combined.select("key", F.explode(F.array("low", "high")).alias("value"))
    return M.reduce_groups(rows, lambda _, v: int(v.max() - v.min()), "long")


@query()
def mr_pi(s: SparkSession, d: str) -> DataFrame:
    return M.pi(s, 2_000_000)


@query("""WITH RECURSIVE grid AS (SELECT x, y, x * 3.0::DOUBLE / 60 - 2.25 AS cr, y * 2.5::DOUBLE / 40 - 1.25 AS ci FROM range(60) a(x), range(40) b(y)),
z(x, y, cr, ci, r, i, n, k) AS (SELECT x, y, cr, ci, 0.0::DOUBLE, 0.0::DOUBLE, 0, 0 FROM grid UNION ALL SELECT x, y, cr, ci, CASE WHEN r * r + i * i <= 4 THEN r * r - i * i + cr ELSE r END, CASE WHEN r * r + i * i <= 4 THEN 2 * r * i + ci ELSE i END, n + CASE WHEN r * r + i * i <= 4 THEN 1 ELSE 0 END, k + 1 FROM z WHERE k < 40)
SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(n AS INT) AS steps FROM z WHERE k = 40""")
def mr_mandelbrot(s: SparkSession, d: str) -> DataFrame:
    return M.mandelbrot(s, 60, 40)


# Streaming: an addition of Spark's own


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(s: SparkSession, d: str) -> DataFrame:
    from quarry.streaming.incremental import windowed_counts

    return windowed_counts(table(s, d, "events"))


@query(f"WITH {POST} SELECT {FLAT} FROM postings")
def stream_index(s: SparkSession, d: str) -> DataFrame:
    """The index after a stream of all documents has been read, micro-batch by micro-batch."""
    import uuid

    from quarry.streaming import incremental

    base = f"{(s.conf.get('spark.checkpoint.dir', None) or '/tmp/checkpoints').rstrip('/')}/quarry/stream-{uuid.uuid4().hex}"
    incremental.run(s, f"{d}/documents.parquet*", docs(s, d).schema, base, f"{base}/checkpoint").awaitTermination()
    return flat(incremental.current(s, base))


# Further operators: crawl rounds, dictionaries, shards, dialects, codecs


@query("""WITH RECURSIVE e AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS src, CAST(unnest([(o_custkey * 7 + 1) % 2000, (o_orderkey * 13 + 5) % 2000]) AS VARCHAR) AS dst FROM orders),
b(uri, level) AS (SELECT '7', 0 UNION SELECT dst, level + 1 FROM b JOIN e ON e.src = b.uri WHERE level < 4) SELECT uri, CAST(min(level) AS INT) AS level FROM b GROUP BY uri""")
def crawl_levels(s: SparkSession, d: str) -> DataFrame:
    """Clicks from a start, by rounds over a frontier."""
    e = trade(s, d).distinct().select("src", F.col("dst").alias("uri"))
    return C.crawl(s.createDataFrame([("7",)], "uri string"), lambda batch: e.join(batch.select(F.col("uri").alias("src")), "src"), 4)


@query("SELECT DISTINCT u AS uri FROM (SELECT unnest([url, CASE WHEN page_id % 10 = 0 THEN url || '/moved' END]) AS u FROM pages WHERE page_id % 7 <> 0) WHERE u IS NOT NULL")
def crawl_redirects(s: SparkSession, d: str) -> DataFrame:
    """URIs settled by usable answers, redirects included. Status and target are made up from the id."""
    p = pages(s, d).select(F.col("url").alias("uri"), F.when(F.col("page_id") % 7 == 0, 404).otherwise(200).alias("status"), F.when(F.col("page_id") % 10 == 0, F.concat("url", F.lit("/moved"))).alias("location"))
    return C.with_redirects(C.usable(p))


@query(f"WITH {PAGE_POST}, t AS (SELECT DISTINCT word FROM page_tok WHERE context = 'title' AND length(word) > 1 AND regexp_matches(word, '\\p{{L}}')), {TOK}, c AS (SELECT DISTINCT word FROM tok) SELECT word, word IN (SELECT word FROM c) AS shared FROM t")
def dict_cut(s: SparkSession, d: str) -> DataFrame:
    """A dictionary split by another: words of page titles, and whether documents have them too."""
    t = I.tokens(pages(s, d), I.PAGES[:1], "page_id").select("word").distinct()
    c = docs(s, d).select(F.explode(X.words(F.col("text"))).alias("word")).distinct().withColumn("shared", F.lit(True))
    return t.join(c, "word", "left").select("word", F.coalesce("shared", F.lit(False)).alias("shared"))


def sharded(s: SparkSession, d: str) -> DataFrame:
    """A query over document-partitioned shards: each answers by itself, and the answers' union is the whole answer."""
    p = post(s, d)
    parts = [Evaluator(p.where(F.col("doc_id") % 3 == k))("th AND NOT de") for k in range(3)]
    return flat(parts[0].unionByName(parts[1]).unionByName(parts[2]))


query(SQL["q_but"], "q_sharded")(sharded)


@query(SQL["q_optimize_and"].replace("starts_with(word_lc, 'the')", "starts_with(word_lc, 'the') OR starts_with(word_lc, 'src3')"))
def q_dialect(s: SparkSession, d: str) -> DataFrame:
    """Plain words of the API dialect are fuzzy; these two have hits of their own."""
    return flat(Evaluator(post(s, d))(dialects.api("the OR src3")))


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-26' AND DATE '1996-03-03' OR CAST(o_orderdate AS DATE) = DATE '1997-01-05'")
def date_rewrite(s: SparkSession, d: str) -> DataFrame:
    """A query with a date and an alias, rewritten and asked of an index of normal forms."""
    import datetime as dt

    o = table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("dates").alias("context"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("word"), F.array(F.lit(1)).alias("positions"))
    text = dialects.dated("5.1.1997 OR this week", dt.date(1996, 2, 29))
    return Evaluator(I.with_lower(o))(text).select(F.col("doc_id").alias("o_orderkey")).distinct()


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '-**-**' AS found FROM orders")
def date_named(s: SparkSession, d: str) -> DataFrame:
    """Dates with month names, found and brought to normal form."""
    months = F.array(*[F.lit(m.capitalize()) for m in D.MONTHS])
    text = F.concat(F.lit("am "), F.date_format("o_orderdate", "d"), F.lit(". "), F.element_at(months, F.month("o_orderdate")), F.lit(" "), F.date_format("o_orderdate", "yyyy"), F.lit(" um"))
    return table(s, d, "orders").select("o_orderkey", F.array_join(D.named(text), ",").alias("found"))


@query("SELECT p_partkey, 'b' || p_size || ' -> ' || 'c' AS shown, 'a -> b' AS norm, true AS told FROM part")
def fn_signatures(s: SparkSession, d: str) -> DataFrame:
    """Signatures brought to forms without blanks and with type variables named in order."""
    t = F.concat(F.lit("b"), F.col("p_size"), F.lit("  ->c"))
    return table(s, d, "part").select("p_partkey", S.stripped_udf(t).alias("shown"), S.normal_udf(t).alias("norm"), S.is_signature(t).alias("told"))


@query("SELECT page_id, url_encode(url) AS coded, url AS back FROM pages")
def fn_url_codec(s: SparkSession, d: str) -> DataFrame:
    return pages(s, d).select("page_id", F.url_encode("url").alias("coded"), F.url_decode(F.url_encode("url")).alias("back"))


@query(r"SELECT doc_id, pos AS at, array_to_string(w[greatest(pos - 5, 1):pos - 1], ' ') AS before, array_to_string(w[pos + 1:pos + 5], ' ') AS after FROM (SELECT doc_id, w, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'the')) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents))")
def fn_around(s: SparkSession, d: str) -> DataFrame:
    """Five words before and after each place of a word."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    at = docs(s, d).select("doc_id", w.alias("w")).select("doc_id", "w", F.posexplode("w").alias("pos", "word")).where("word = 'the'")
    before = F.expr("slice(w, greatest(pos - 4, 1), pos - greatest(pos - 4, 1) + 1)")
    return at.select("doc_id", (F.col("pos") + 1).cast("long").alias("at"), F.array_join(before, " ").alias("before"), F.array_join(F.expr("slice(w, pos + 2, 5)"), " ").alias("after"))


@query("SELECT max(len(regexp_split_to_array(text, '\\s+'))) AS value FROM documents")
def mr_map_fold(s: SparkSession, d: str) -> DataFrame:
    return M.map_fold(docs(s, d), F.size(F.split("text", r"\s+")).cast("long"), F.max)


@query(r"SELECT CAST(length(word) % 4 AS INT) AS part, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS word FROM documents) GROUP BY 1")
def mr_partition(s: SparkSession, d: str) -> DataFrame:
    """Keys dealt to parts by a partitioner of one's own: word length."""
    words = docs(s, d).select(F.explode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("key"))
    combined = words.groupBy("key").agg(F.count("*").alias("value"))
    return M.partitioned(combined, F.length("key"), 4).groupBy("part").agg(F.sum("value").alias("n"))


@query("SELECT doc_id, '{\"cmd\":\"insert\",\"uri\":\"doc:' || doc_id || '\",\"lang\":\"' || lang || '\"}' AS command FROM documents")
def result_commands(s: SparkSession, d: str) -> DataFrame:
    """Insert commands for another search server, one JSON object per document."""
    return docs(s, d).select("doc_id", F.to_json(F.struct(F.lit("insert").alias("cmd"), F.concat(F.lit("doc:"), "doc_id").alias("uri"), "lang")).alias("command"))


@query("SELECT doc_id, sha1(unhex(lpad(to_hex(strlen('doc:' || doc_id)), 16, '0')) || encode('doc:' || doc_id)) AS digest FROM documents")
def idx_hashed_ids(s: SparkSession, d: str) -> DataFrame:
    """The digest that hashed document ids are the low 64 bits of: over the length in eight bytes, then the URI."""
    uri = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    return docs(s, d).select("doc_id", F.sha1(F.concat(F.unhex(F.lpad(F.hex(F.octet_length(uri)), 16, "0")), F.encode(uri, "UTF-8"))).alias("digest"))


# Further maintenance, input and output, functions and jobs

MERGE = "SELECT doc_id, context, word, array_to_string(list_sort(list_distinct(flatten(list(positions)))), ',') AS positions FROM ({}) GROUP BY doc_id, context, word"


@query(f"WITH {POST} {MERGE.format('SELECT doc_id, context, word, positions FROM postings UNION ALL VALUES (1, ' + chr(39) + 'content' + chr(39) + ', ' + chr(39) + 'zebra' + chr(39) + ', [7, 9])')}")
def maint_insert_occurrences(s: SparkSession, d: str) -> DataFrame:
    return flat(I.merge(post(s, d), I.occurrences(s, [("content", "zebra", 1, [7]), ("content", "zebra", 1, [9, 7])])))


@query(f"WITH {POST} SELECT {FLAT} FROM postings WHERE NOT (context = 'source' AND word = 'src1' AND doc_id < 100)")
def maint_delete_occurrences(s: SparkSession, d: str) -> DataFrame:
    """An occurrence that has no position left is gone, and so is its word."""
    return flat(I.subtract(post(s, d), I.occurrences(s, [("source", "src1", k, [1]) for k in range(100)])))


@query(f"WITH {POST}, z AS (SELECT context, count(DISTINCT word) AS size FROM postings GROUP BY context), r AS (SELECT *, row_number() OVER (ORDER BY size DESC, context) AS r FROM z) SELECT context, CAST(CASE r WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE CASE WHEN (SELECT size FROM r WHERE r = 1) <= (SELECT size FROM r WHERE r = 2) THEN 0 ELSE 1 END END AS INT) AS part FROM r")
def maint_split_contexts(s: SparkSession, d: str) -> DataFrame:
    """Contexts allotted to two parts, largest first to the part that holds least."""
    return I.split(post(s, d), "context", 2).select("context", "part").distinct()


for _by2 in ("document", "word"):

    @query(f"WITH {POST} SELECT 4 AS parts, CAST(sum(len(positions)) AS BIGINT) AS positions, true AS even, true AS whole FROM postings", f"maint_split_{_by2}s")
    def _split(s: SparkSession, d: str, by: str = _by2) -> DataFrame:
        """Four parts of like size, none of which divides a document or word unless one piece alone is larger than a part."""
        p = I.split(post(s, d), by, 4)
        key = "doc_id" if by == "document" else "word"
        pieces = p.groupBy(key, "part").agg(F.sum(F.size("positions")).alias("n"))  # shuffled once for both
        sizes = pieces.groupBy("part").agg(F.sum("n").alias("n"))
        most = pieces.groupBy(key).agg(F.sum("n").alias("n"), F.count("part").alias("in"))
        whole = most.agg((F.max("in") == 1).alias("whole"), F.max("n").alias("top"))
        total = sizes.agg(F.count("*").cast("int").alias("parts"), F.sum("n").cast("long").alias("positions"), F.max("n").alias("largest"))
        return total.crossJoin(whole).select("parts", "positions", (F.col("largest") <= F.col("positions") * 0.3 + F.col("top")).alias("even"), "whole")  # one row each


@query("SELECT doc_id, 'content' AS context, CASE WHEN lang = 'de' THEN upper(source) ELSE source END AS content FROM documents")
def maint_text_cache(s: SparkSession, d: str) -> DataFrame:
    """A table of texts by document and context; fresh ones replace what is there."""
    t = docs(s, d).select("doc_id", F.lit("content").alias("context"), F.col("source").alias("content"), "lang")
    fresh = t.where("lang = 'de'").withColumn("content", F.upper("content"))
    return upsert_text(t.drop("lang"), fresh.drop("lang"))


@query("SELECT doc_id, '{\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || '}' AS custom FROM documents")
def maint_simplify(s: SparkSession, d: str) -> DataFrame:
    """A document's own payload as text."""
    return docs(s, d).select("doc_id", F.to_json(F.struct("lang", "n_chars")).alias("custom"))


@query(f"WITH {POST}, g AS (SELECT doc_id, context, word, positions, list_transform(positions, lambda x, i: x - coalesce(positions[i - 1], 0)) AS gaps FROM postings) SELECT doc_id, context, word, array_to_string(gaps, ',') AS gaps, array_to_string(positions, ',') AS positions FROM g")
def idx_deltas(s: SparkSession, d: str) -> DataFrame:
    """Positions as gaps, and back."""
    p = post(s, d).select("doc_id", "context", "word", I.deltas(F.col("positions")).alias("steps"))
    return p.select("doc_id", "context", "word", F.array_join("steps", ",").alias("gaps"), F.array_join(I.from_deltas(F.col("steps")), ",").alias("positions"))


def own_folder(s: SparkSession, name: str) -> str:
    import uuid

    return f"{(s.conf.get('spark.checkpoint.dir', None) or '/tmp/checkpoints').rstrip('/')}/quarry/{name}-{uuid.uuid4().hex}"


@query(f"WITH {POST} SELECT {FLAT} FROM postings")
def io_index(s: SparkSession, d: str) -> DataFrame:
    """A whole index that was written and is read again."""
    at = own_folder(s, "index")
    write_index(post(s, d), doc_table(s, d), at)
    return flat(read_index(s, at)[0])


@query(f"WITH {POST} SELECT {FLAT} FROM postings WHERE context = 'content' AND starts_with(word_lc, 'th')")
def io_index_probe(s: SparkSession, d: str) -> DataFrame:
    """A prefix of a stored index, which reads one context's row groups."""
    at = own_folder(s, "index")
    write_index(post(s, d), doc_table(s, d), at)
    return flat(read_index(s, at)[0].where("context = 'content' and startswith(word_lc, 'th')"))


@query("SELECT doc_id, 'doc:' || doc_id AS uri FROM documents")
def io_index_docs(s: SparkSession, d: str) -> DataFrame:
    """The document table of a stored index."""
    at = own_folder(s, "index")
    write_index(post(s, d), doc_table(s, d), at)
    return read_index(s, at)[1].select("doc_id", "uri")


@query("SELECT doc_id, lang, source FROM documents")
def io_xml(s: SparkSession, d: str) -> DataFrame:
    at = own_folder(s, "xml")
    write_xml(docs(s, d).select("doc_id", "lang", "source"), at, "docs", "doc")
    return read_xml(s, at, "doc", "doc_id long, lang string, source string")


@query("SELECT url AS href FROM pages")
def io_sitemap(s: SparkSession, d: str) -> DataFrame:
    at = own_folder(s, "sitemap")
    write_sitemap(pages(s, d).select("url", F.lit("page").alias("title")), at)
    return read_xml(s, at, "url", "_href string, _title string").select(F.col("_href").alias("href"))


@query("SELECT doc_id, lang FROM documents")
def io_json(s: SparkSession, d: str) -> DataFrame:
    """Records that were written as JSON lines, with those parts that are read."""
    at = own_folder(s, "json")
    docs(s, d).select("doc_id", "lang", "source").write.json(at)
    return s.read.schema("doc_id long, lang string").json(at)


@query("SELECT lang || '|' || upper(lang) AS text FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def io_converted(s: SparkSession, d: str) -> DataFrame:
    """Files of a format that a given function makes text of; here compressed ones."""
    import gzip

    at = own_folder(s, "packed")
    one = docs(s, d).where("lang is not null").select(F.concat_ws("|", "lang", F.upper("lang")).alias("value"), F.col("lang").alias("part")).distinct()
    one.repartition(1, "part").write.partitionBy("part").option("compression", "gzip").text(at)
    return converted(s, at, lambda raw: gzip.decompress(raw).decode().strip(), "*.gz").select("text")


@query("SELECT count(*) AS files, true AS sized FROM (SELECT DISTINCT lang FROM documents)")
def io_files(s: SparkSession, d: str) -> DataFrame:
    """Files under a folder with their sizes: one folder for each language."""
    at = own_folder(s, "files")
    docs(s, d).select("lang", "source").distinct().repartition(1, "lang").write.partitionBy("lang").json(at)
    return files(s, at, "*.json").agg(F.count("*").alias("files"), F.min((F.col("n_bytes") > 0) & F.col("modified").isNotNull() & (F.octet_length("text") == F.col("n_bytes"))).alias("sized"))


@query("""SELECT doc_id, array_to_string(list_transform(range(4), lambda k: array_to_string(w[len(w) * k // 4 + 1:len(w) * (k + 1) // 4], ' ')), '|') AS parts FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) >= 4
UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) < 4""")
def fn_chunks_by_count(s: SparkSession, d: str) -> DataFrame:
    w = docs(s, d).select("doc_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w"))
    return w.select("doc_id", F.array_join(F.transform(X.chunks_by_count(F.col("w"), 4), lambda c: F.array_join(c, " ")), "|").alias("parts"))


@query(r"SELECT doc_id, regexp_replace(t, '^\s+', '') AS l, regexp_replace(t, '\s+$', '') AS r, regexp_replace(t, '^\s+|\s+$', '', 'g') AS b, regexp_replace(source, '^[src]+|[src]+$', '', 'g') AS w FROM (SELECT doc_id, source, '  ' || lang || ' ' AS t FROM documents)")
def fn_strip(s: SparkSession, d: str) -> DataFrame:
    t = docs(s, d).select("doc_id", "source", F.concat(F.lit("  "), "lang", F.lit(" ")).alias("t"))
    c = F.col("t")
    return t.select("doc_id", X.stripped(c, right=False).alias("l"), X.stripped(c, left=False).alias("r"), X.stripped(c).alias("b"), X.stripped(F.col("source"), of="[src]").alias("w"))


@query(r"SELECT page_id, array_to_string(list_transform(string_split(url, ''), lambda c: CASE WHEN regexp_matches(c, '[\p{L}\p{N}\s]') THEN c ELSE '%' || lower(to_hex(unicode(c))) END), '') AS name, url_decode(replace(url || '+%C3%A4', '+', '%2B')) AS plain FROM pages")
def fn_escape(s: SparkSession, d: str) -> DataFrame:
    """A URL as the name of a file, and percent escapes undone."""
    u = F.col("url")
    return pages(s, d).select("page_id", X.escaped(u).alias("name"), X.url_decoded(F.concat(u, F.lit("+%C3%A4"))).alias("plain"))


@query("SELECT page_id, page_id % 3 = 0 AS page, page_id % 3 = 1 AS pdf FROM pages")
def fn_mime(s: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("text/html"), F.lit("application/pdf"), F.lit("image/png")), (F.col("page_id") % 3 + 1).cast("int"))
    return pages(s, d).select("page_id", kind.isin(*X.PAGE_TYPES).alias("page"), kind.isin(*X.PDF_TYPES).alias("pdf"))


@query(f"WITH {POST} SELECT doc_id, context, word, CAST(len(positions) AS INT) AS n, list_contains(positions, 3) AS third, array_to_string(list_sort(list_distinct(list_concat(positions, [0, 3]))), ',') AS more, CAST(list_sum(positions) AS BIGINT) AS total FROM postings")
def fn_positions(s: SparkSession, d: str) -> DataFrame:
    """Sets of positions: size, membership, union and a fold."""
    p = F.col("positions")
    return post(s, d).select("doc_id", "context", "word", F.size(p).alias("n"), F.array_contains(p, 3).alias("third"), F.array_join(F.array_sort(F.array_union(p, F.array(F.lit(0), F.lit(3)))), ",").alias("more"), F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT url AS src, unnest(regexp_extract_all(html, '<(?:img|input|link|script|applet)\\s[^>]*?(?:src|href|code)=\"([^\"]*)\"', 1)) AS dst FROM pages")
def graph_references(s: SparkSession, d: str) -> DataFrame:
    """What pages load, beside what they link to."""
    return pages(s, d).select(F.col("url").alias("src"), F.explode(X.references(F.col("html"))).alias("dst"))


ASKED = ("x.html", "/top?a=b", "//h.org/a", "?q=1", "#f", "http://z.de/y", "./s/../t/", "../../../../../u")


@query("""WITH u AS (SELECT DISTINCT url, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS top, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, string_split(url, '#')[1] AS bare FROM pages),
f AS (SELECT *, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*/)', 1) ELSE '/' END AS folder FROM u)
SELECT url, 'x.html' AS link, top || folder || 'x.html' AS resolved FROM f UNION ALL SELECT url, '/top?a=b', top || '/top?a=b' FROM f UNION ALL SELECT url, '//h.org/a', regexp_extract(url, '^(https?:)', 1) || '//h.org/a' FROM f
UNION ALL SELECT url, '?q=1', top || path || '?q=1' FROM f UNION ALL SELECT url, '#f', bare FROM f UNION ALL SELECT url, 'http://z.de/y', 'http://z.de/y' FROM f UNION ALL SELECT url, './s/../t/', top || folder || 't/' FROM f UNION ALL SELECT url, '../../../../../u', top || '/u' FROM f""")
def graph_resolved(s: SparkSession, d: str) -> DataFrame:
    """Links of every form against the pages they stand on."""
    u = pages(s, d).select("url").distinct().select("url", F.explode(F.array(*map(F.lit, ASKED))).alias("link"))
    return u.select("url", "link", G.resolved(F.col("url"), F.col("link")).alias("resolved"))


@query("""WITH h AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#:]*)', 1) AS host FROM pages) SELECT host, seq, prefix, action FROM h, LATERAL (SELECT 0 AS seq, '/' || host AS prefix, 'disallow' AS action UNION ALL SELECT 1, '/en/', 'allow' UNION ALL SELECT 2, '', 'disallow')""")
def graph_robots_files(s: SparkSession, d: str) -> DataFrame:
    """Rules out of robots.txt files: comments, other agents' blocks and other directives left out."""
    text = F.concat(F.lit("# rules\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /"), "host", F.lit("  # ours\nCrawl-delay: 3\nAllow: /en/\nDisallow:\n\nUser-agent: last\nDisallow: /x\n"))
    hosts = pages(s, d).select(F.regexp_extract("url", r"^https?://([^/?#:]*)", 1).alias("host")).distinct()
    return G.robots_table(hosts.select("host", text.alias("text")), "quarry")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '-14-30' AS norm FROM orders")
def date_extracted(s: SparkSession, d: str) -> DataFrame:
    """Dates with weekday, month name and time out of free text."""
    months = F.array(*[F.lit(m.capitalize()) for m in D.MONTHS])
    text = F.concat(F.lit("Treffen am Freitag, den "), F.date_format("o_orderdate", "d"), F.lit(". "), F.element_at(months, F.month("o_orderdate")), F.lit(" "), F.date_format("o_orderdate", "yyyy"), F.lit(" um 14:30 Uhr im Haus 3"))
    each = table(s, d, "orders").select("o_orderkey", F.explode(D.extracted(text)).alias("x"))
    return each.select("o_orderkey", "x.norm")


@query("SELECT l_returnflag AS key, CAST(max(l_partkey) AS BIGINT) AS value FROM lineitem GROUP BY l_returnflag HAVING max(l_partkey) > 10")
def mr_job(s: SparkSession, d: str) -> DataFrame:
    """A job that JSON describes."""
    return M.job(table(s, d, "lineitem"), '{"key": "l_returnflag", "value": "l_partkey", "reduce": "max(value)", "keep": "value > 10", "splits": 4, "reducers": 2}')


@query(SQL["q_but"])
def q_sent(s: SparkSession, d: str) -> DataFrame:
    """A query that was sent as JSON."""
    return flat(Evaluator(post(s, d))(language.load(language.dump(language.parse("th AND NOT de")))))


@query(f"WITH {POST} SELECT {FLAT} FROM postings WHERE NOT {in_langs('es')}")
def stream_removed(s: SparkSession, d: str) -> DataFrame:
    """The streamed index while some documents are taken out."""
    from quarry.streaming import incremental

    base = own_folder(s, "stream")
    incremental.run(s, f"{d}/documents.parquet*", docs(s, d).schema, base, f"{base}/checkpoint").awaitTermination()
    left = incremental.current(s, base, docs(s, d).where("lang = 'es'"))
    return flat(left)


@query(f"WITH {POST} SELECT {FLAT} FROM postings")
def stream_compacted(s: SparkSession, d: str) -> DataFrame:
    """The streamed index after its batches have been merged into one."""
    from quarry.streaming import incremental

    base, merged = own_folder(s, "stream"), own_folder(s, "merged")
    incremental.run(s, f"{d}/documents.parquet*", docs(s, d).schema, base, f"{base}/checkpoint").awaitTermination()
    incremental.compact(s, base, merged)
    return flat(incremental.current(s, merged))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS uri FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' OR o_orderkey % 7 = 0")
def crawl_stale(s: SparkSession, d: str) -> DataFrame:
    """Cached pages whose validity of a year is over, or that were never fetched."""
    o = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("uri"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("fetched"))
    return C.stale(o, F.lit("1998-01-01 00:00:00").cast("timestamp"), 365).select("uri")
