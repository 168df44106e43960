"""From a query tree to one lazy DataFrame plan over postings(context, word, word_lc, doc_id, positions).

Every node gives rows (doc_id, context, word, terms, positions): which words of a document hit. A tree of words costs one
scan of the postings, whatever its size: each posting is marked with the leaves that it fits, a window over its document
knows the marks of all of them, and both together say which nodes it is a row of (`marked`). A fuzzy word costs one scan
more, for its best spelling. With phrases or prefix limits each node is a plan of its own, and boolean nodes filter or append
rows by document (`node`); prefix limits come from word counts of the matching words alone. What lands on the same word is
merged once, at the end.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.index import joined
from quarry.plans.fuzzy import FuzzyConfig, fuzz
from quarry.plans.language import In, Leaf, Node, Not, Pair, leaves, optimize, parse

ROWS = ["doc_id", "context", "word", "terms", "positions"]


@dataclass(frozen=True)
class QueryConfig:
    """Limits of 0 are off."""

    fuzzy: FuzzyConfig = field(default_factory=FuzzyConfig)
    optimize: bool = True
    word_limit: int = 0
    doc_limit: int = 0


def limited(rows: DataFrame, word_limit: int, doc_limit: int) -> DataFrame:
    """Rows of the words that limits leave, for each context.

    doc_limit: shortest words first, words are kept while those before them hold fewer documents than the limit.
    word_limit: if more are left, the most frequent ones.
    """
    if not (word_limit or doc_limit):
        return rows
    vocab = rows.groupBy("context", "word").agg(F.countDistinct("doc_id").alias("df"))
    if doc_limit:
        # Every word holds a document, so at most doc_limit words are kept: a bounded number of a context's words meet in a window.
        shortest = Window.partitionBy("context").orderBy(F.length("word"), "word")
        vocab = vocab.withColumn("rank", F.row_number().over(shortest)).where(F.col("rank") <= doc_limit).drop("rank")
        before = F.sum("df").over(shortest.rowsBetween(Window.unboundedPreceding, -1))
        vocab = vocab.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < doc_limit)
    if word_limit:
        rank = F.row_number().over(Window.partitionBy("context").orderBy(F.desc("df"), F.length("word"), "word"))
        vocab = vocab.withColumn("rank", rank).where(F.col("rank") <= word_limit)
    return rows.join(vocab.select("context", "word"), ["context", "word"], "left_semi")


class Evaluator:
    def __init__(self, postings: DataFrame, config: QueryConfig | None = None):
        self.postings, self.config = postings, config or QueryConfig()

    def __call__(self, query: str | Node) -> DataFrame:
        q = parse(query) if isinstance(query, str) else query
        q = optimize(q) if self.config.optimize else q
        apart = self.config.word_limit or self.config.doc_limit or any("phrase" in x.kind for x in leaves(q))
        rows = self.node(q, None) if apart else self.marked(q)
        return joined(rows.select(*ROWS))

    def marked(self, q: Node) -> DataFrame:
        """The rows of a tree without phrases and limits: one scan, one shuffle by document, which the merge can use too."""
        tests: list[Column] = []  # a mark each: does a posting fit?
        best: list[Column] = []  # a fuzzy word each: the rank of the nearest spelling that has any hit

        def mark(fits: Column) -> int:
            tests.append(F.coalesce(fits, F.lit(False)))
            return len(tests) - 1

        on = lambda k: F.get("own", F.lit(k))
        held = lambda k: F.get("held", F.lit(k))

        def walk(q: Node, contexts: tuple[str, ...] | None) -> tuple[list[tuple[Column, Column]], Column]:
            """By which leaves a posting is a row of the node (condition, terms), and whether its document has any row of it."""
            scope = F.col("context").isin(*contexts) if contexts is not None else F.lit(True)
            match q:
                case Leaf("fuzzy", text):
                    tries = [text, *(w for w, _ in fuzz(self.config.fuzzy, text))]
                    rank = F.coalesce(*[F.when(F.col("word_lc").startswith(w.lower()), F.lit(k)) for k, w in enumerate(tries)])
                    at = F.col(f"best{len(best)}")
                    best.append(F.min(F.when(scope, rank)).alias(f"best{len(best)}"))
                    m = mark(scope & F.startswith("word_lc", F.get(F.array(*[F.lit(w.lower()) for w in tries]), at)))
                    return [(on(m), F.array(F.get(F.array(*[F.lit(w) for w in tries]), at)))], held(m)
                case Leaf(kind, text):
                    m = mark(scope & (F.col("word").startswith(text) if kind == "case_word" else F.col("word_lc").startswith(text.lower())))
                    return [(on(m), F.array(F.lit(text)))], held(m)
                case In(names, of):
                    return walk(of, names)
                case Not(of):
                    out = ~walk(of, contexts)[1]
                    m = mark(scope)
                    return [(on(m) & out, F.array(F.lit("")))], held(m) & out
                case Pair("or", left, right):
                    (a, in_a), (b, in_b) = walk(left, contexts), walk(right, contexts)
                    return a + b, in_a | in_b
                case Pair("but", left, right):
                    (a, in_a), (_, in_b) = walk(left, contexts), walk(right, contexts)
                    return [(c & ~in_b, t) for c, t in a], in_a & ~in_b
                case Pair(_, left, right):
                    (a, in_a), (b, in_b) = walk(left, contexts), walk(right, contexts)
                    known = F.col("doc_id").isNotNull()
                    return [(c & in_b & known, t) for c, t in a] + [(c & in_a & known, t) for c, t in b], in_a & in_b

        hits, _ = walk(q, None)
        rows = self.postings.select("doc_id", "context", "word", "word_lc", "positions")
        if best:
            rows = rows.crossJoin(F.broadcast(self.postings.agg(*best)))  # one row
        rows = rows.select("doc_id", "context", "word", "positions", F.array(*tests).alias("own"), *[f"best{k}" for k in range(len(best))]).where(F.array_contains("own", True))
        document = Window.partitionBy("doc_id")
        rows = rows.select("*", F.array(*[F.bool_or(on(k)).over(document) & F.col("doc_id").isNotNull() for k in range(len(tests))]).alias("held"))  # a null id is no document's
        terms = F.flatten(F.array(*[F.when(c, t).otherwise(F.array().cast("array<string>")) for c, t in hits]))
        return rows.select("doc_id", "context", "word", terms.alias("terms"), "positions").where(F.size("terms") > 0)

    def scope(self, contexts: tuple[str, ...] | None) -> DataFrame:
        return self.postings.where(F.col("context").isin(*contexts)) if contexts is not None else self.postings

    def node(self, q: Node, contexts: tuple[str, ...] | None) -> DataFrame:
        match q:
            case Leaf("phrase" | "case_phrase" as kind, text):
                return self.phrase(text, kind == "case_phrase", contexts)
            case Leaf("fuzzy", text):
                return self.fuzzy(text, contexts)
            case Leaf(kind, text):
                return self.word(text, kind == "case_word", contexts)
            case In(names, of):
                return self.node(of, names)
            case Not(of):
                everything = self.scope(contexts).select("doc_id", "context", "word", F.array(F.lit("")).alias("terms"), "positions")
                return everything.join(self.node(of, contexts).select("doc_id"), "doc_id", "left_anti")
            case Pair("or", left, right):
                return self.node(left, contexts).unionByName(self.node(right, contexts))
            case Pair("but", left, right):
                return self.node(left, contexts).join(self.node(right, contexts).select("doc_id"), "doc_id", "left_anti")
            case Pair(_, left, right):
                a, b = self.node(left, contexts), self.node(right, contexts)
                return a.join(b.select("doc_id"), "doc_id", "left_semi").unionByName(b.join(a.select("doc_id"), "doc_id", "left_semi"))

    def word(self, text: str, case: bool, contexts: tuple[str, ...] | None) -> DataFrame:
        fits = F.col("word").startswith(text) if case else F.col("word_lc").startswith(text.lower())
        rows = limited(self.scope(contexts).where(fits), self.config.word_limit, self.config.doc_limit)
        return rows.select("doc_id", "context", "word", F.array(F.lit(text)).alias("terms"), "positions")

    def exactly(self, text: str, case: bool, contexts: tuple[str, ...] | None) -> DataFrame:
        fits = F.col("word") == text if case else F.col("word_lc") == text.lower()
        rows = self.scope(contexts).where(fits)
        return rows if case else rows.groupBy("context", "doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))

    def phrase(self, text: str, case: bool, contexts: tuple[str, ...] | None) -> DataFrame:
        """Each later word must follow some occurrence of the first at its distance; all the first's positions are kept."""
        words = text.split()
        if not words:
            return self.scope(contexts).where("false").select("doc_id", "context", "word", F.array(F.lit(text)).alias("terms"), "positions")
        rows = self.exactly(words[0], case, contexts).select("context", "doc_id", "positions")
        for k, w in enumerate(words[1:], 1):
            other = self.exactly(w, case, contexts).select("context", "doc_id", F.expr(f"transform(positions, p -> p - {k})").alias("shifted"))
            rows = rows.join(other, ["context", "doc_id"]).where(F.arrays_overlap("positions", "shifted")).drop("shifted")
        return rows.select("doc_id", "context", F.lit(text).alias("word"), F.array(F.lit(text)).alias("terms"), "positions")

    def fuzzy(self, text: str, contexts: tuple[str, ...] | None) -> DataFrame:
        """The word itself, else the nearest spelling that has any hit: one scan, the candidates' ranks in the plan."""
        tries = [text, *(w for w, _ in fuzz(self.config.fuzzy, text))]
        fits: Column | None = None
        for w in tries:
            one = F.col("word_lc").startswith(w.lower())
            fits = one if fits is None else fits | one
        ranked = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(w).alias("try")) for k, w in enumerate(tries)])
        hits = self.scope(contexts).where(fits).withColumn("hit", F.explode(F.filter(ranked, lambda r: F.col("word_lc").startswith(F.lower(r["try"])))))
        best = hits.agg(F.min("hit.rank").alias("best"))
        rows = hits.join(F.broadcast(best), F.col("hit.rank") == F.col("best"))  # one row
        rows = limited(rows.select("context", "word", "doc_id", "positions", F.array(F.col("hit.try")).alias("terms")), self.config.word_limit, self.config.doc_limit)
        return rows.select(*ROWS)
