"""Links between pages, crawl rules, copies, and ranks over link and dependency graphs."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) as written, repeats included."""
    return pages.select(F.col("url").alias("src"), F.explode(X.links(F.col("html"))).alias("dst"))


def site(url: Column) -> Column:
    """Scheme, host and port."""
    return F.regexp_extract(url, r"^(https?://[^/?#]*)", 1)


def absolute(base: Column, link: Column) -> Column:
    """A link against its page, without fragment."""
    bare = F.substring_index(link, "#", 1)
    return F.when(bare.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), bare).when(bare.startswith("/"), F.concat(site(base), bare)).otherwise(F.concat(F.regexp_extract(base, r"^(https?://[^/?#]*(?:/[^?#]*)?/)", 1), bare))


def resolved(base: Column, link: Column) -> Column:
    """A link against a base element or its page: other schemes and hosts, bare queries, folders, and . and .. on the way."""
    bare = F.substring_index(link, "#", 1)
    top = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "^(.*/)", 1)).otherwise(F.lit("/"))
    told = F.when(bare.startswith("/"), bare).otherwise(F.concat(folder, bare))
    way, asked = F.regexp_extract(told, r"^([^?]*)", 1), F.regexp_extract(told, r"^[^?]*(.*)$", 1)
    parts = F.split(way, "/")
    ends_open = F.element_at(parts, -1).isin("", ".", "..")
    none = F.array().cast("array<string>")

    def walk(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part.isin(".", ""), done).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(parts, none, walk)
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends_open & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))
    return (
        F.when(bare.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), bare)
        .when(bare.startswith("//"), F.concat(F.substring_index(base, "//", 1), bare))
        .when(bare == "", F.substring_index(base, "#", 1))
        .when(bare.startswith("?"), F.concat(top, path, bare))
        .otherwise(F.concat(top, joined, asked))
    )


def followed(url: Column, allow: list[str], deny: list[str]) -> Column:
    """Any allow pattern (or none given) and no deny pattern matches as a whole."""
    a = F.lit(True) if not allow else any_of(url, [f"^(?:{p})$" for p in allow])
    return a & ~any_of(url, [f"^(?:{p})$" for p in deny])


def followed_within(url: Column, allow: list[str], deny: list[str]) -> Column:
    """The older rule: patterns match anywhere, and with no allow pattern nothing is followed."""
    return any_of(url, allow) & ~any_of(url, deny)


def any_of(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def first_rule(c: Column, rules: list[tuple[str, object]], default: object) -> Column:
    """The value of the first pattern that matches somewhere."""
    out = F.lit(default)
    for pattern, value in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(url) with `allowed`: the first rule of the host, (host, seq, prefix, action), whose prefix begins the path."""
    u = urls.withColumn("host", F.regexp_extract("url", r"^https?://([^/?#:]*)", 1)).withColumn("path", F.regexp_extract("url", r"^https?://[^/?#]*(.*)$", 1))
    hit = u.join(rules.where("prefix <> ''"), "host").where(F.col("path").startswith(F.col("prefix"))).groupBy("url").agg(F.min_by("action", "seq").alias("action"))
    return urls.join(hit, "url", "left").select("url", (F.coalesce("action", F.lit("allow")) != "disallow").alias("allowed"))


def robots_rules(lines: Iterable[str], agent: str) -> list[tuple[int, str, str]]:
    """(seq, prefix, action) of the first block for * or a beginning of our name."""
    rules, ours, done = [], False, False
    for raw in lines:
        key, _, value = raw.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if rules or done:
                break
            ours = ours or value == "*" or bool(value) and agent.lower().startswith(value.lower())
        elif ours and key in ("allow", "disallow"):
            rules.append((len(rules), value, key))
            done = True
    return rules


def robots_table(files: DataFrame, agent: str) -> DataFrame:
    """(host, seq, prefix, action) from (host, text) of robots.txt files, each read whole by itself."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(host, *rule) for host, text in zip(f["host"], f["text"], strict=True) for rule in robots_rules((text or "").splitlines(), agent)]
            yield pd.DataFrame(rows, columns=["host", "seq", "prefix", "action"])

    return files.select("host", "text").mapInPandas(run, "host string, seq long, prefix string, action string")


def meta_robots(html: Column, directive: str) -> Column:
    """Whether a robots meta element holds noindex, nofollow or none."""
    content = F.lower(F.regexp_extract(html, r"(?is)<meta\s+name=[\"']robots[\"']\s+content=[\"']([^\"']*)[\"']", 1))
    return F.exists(F.split(content, "[^a-z]+"), lambda w: w.isin(directive, "none"))


def reverse_links(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("srcs"))


def shortest_copies(pages: DataFrame) -> DataFrame:
    """(digest, url, copies): of pages with equal markup the one with the shortest URL, ties in order."""
    return pages.groupBy(F.md5("html").alias("digest")).agg(F.min(F.struct(F.length("url").alias("n"), F.col("url"))).getField("url").alias("url"), F.count("*").alias("copies"))


def frontier(found: DataFrame, seen: DataFrame, most: int | None = None) -> DataFrame:
    """(uri, level) not seen yet, each at its least level."""
    out = found.groupBy("uri").agg(F.min("level").alias("level")).join(seen.select("uri"), "uri", "left_anti")
    return out if most is None else out.where(F.col("level") <= most)


def pagerank(edges: DataFrame, docs: DataFrame, rounds: int = 20, d: float = 0.5, cut_every: int = 5) -> DataFrame:
    """(uri, rank): rank = d * sum over links u -> v of rank(u) / links(u) + 1 - d, from 0.

    links(u) counts all links, repeats and unknown targets included; what flows to unknown documents is lost. Edges carry
    1 / links(u), summed per pair once; each round is one join and one partial aggregate on the target. Every `cut_every` rounds the ranks are
    written out, so plans stay short.
    """
    degree = edges.groupBy("src").agg(F.count("*").alias("links"))
    flow = edges.groupBy("src", "dst").agg(F.count("*").alias("n")).join(docs.select(F.col("uri").alias("dst")), "dst", "left_semi").join(docs.select(F.col("uri").alias("src")), "src", "left_semi")
    flow = stored(flow.join(degree, "src").select("src", "dst", (F.col("n") / F.col("links")).alias("share")), "flow")
    ranks = docs.select("uri", F.lit(0.0).alias("rank"))
    for k in range(rounds):
        sent = flow.join(ranks.select(F.col("uri").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("uri")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        ranks = docs.select("uri").join(sent, "uri", "left").select("uri", (d * F.coalesce("got", F.lit(0.0)) + (1 - d)).alias("rank"))
        if (k + 1) % cut_every == 0 and k + 1 < rounds:
            ranks = stored(ranks, "ranks")
    return ranks


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the folder that executors share."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"
    path = f"{at.rstrip('/')}/quarry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dag_rank(edges: DataFrame, w: float = 0.5, depth: int = 50) -> DataFrame:
    """(node, rank) over uses(src, dst) without cycles: 1 + w * sum of the ranks of a node's users.

    Each round sends every user's last gain on; a DAG is done after as many rounds as its longest path.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    total = gain = nodes.select("node", F.lit(1.0).alias("rank"))
    for _ in range(depth):
        gain = stored(edges.join(gain.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg((w * F.sum("rank")).alias("rank")), "gain")
        if gain.isEmpty():
            return total.groupBy("node").agg(F.sum("rank").alias("rank"))
        total = total.unionByName(gain)
    raise ValueError(f"a path of over {depth} edges, or a cycle")


def published(rank: Column) -> Column:
    """One decimal of 1 + log2, halves to even."""
    return F.bround(10 * (1 + F.log2(rank))) / 10


def acyclic(edges: list[tuple]) -> list[tuple]:
    """A small edge list without those that would close a cycle, in input order."""
    reach: dict = {}
    kept = []
    for a, b in edges:
        seen, todo = set(), [b]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += reach.get(x, ())
        if a not in seen:
            reach.setdefault(a, []).append(b)
            kept.append((a, b))
    return kept
