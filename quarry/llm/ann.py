"""Operator 10: approximate nearest neighbours by adaptive dimension scan of inverted lists.

Fitting: k-means on a bounded sample (`sample` vectors, chosen by a hash of the id) gives at most `max_lists` centroids.
Where they would hold over `fill` vectors each, k-means on what the sample's vectors differ from their centroids by gives at
most `max_cuts` more, which cut every list alike; so lists stay short up to max_lists * max_cuts * fill vectors. Centroids and a random
rotation go to every task. Every vector is in the list of its nearest centroid. How many of the nearest
lists a query scans is learned from the sample too: as many as hold the share `recall` of true neighbours there, and at least
FLOOR vectors. The first lists, of some NEAR vectors, are scanned before the rest, which need only return what isn't
farther than the k-th best there. In a list, rotated vectors are read in
blocks of columns: after each block, a candidate whose partial distance is too large, by a hypothesis test, for its whole
distance to be below the k-th best so far is abandoned. Survivors are measured exactly, on the original vectors.

Equal vectors are one entry with their smallest k + 1 ids, which are all that ties can return; equal queries are one query.
So copies of a vector, however many, cost one. A list is dealt in parts of about PART vectors, and its queries in blocks, so
no task holds a whole list.

Cases: null, zero, or wrongly sized vectors (the commonest size counts), and those with null or non-finite components, take
no part. Rows without an id take no part. With fewer than k candidates, all are returned. Repeated rows of an id count
once. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import mapped, slices, stored

PART, QUERY_BLOCK = 4000, 4000
COLUMNS = 16
FLOOR = 4000
NEAR = 500
EPSILON = 2.1
#: Of lists that are cut, a query looks at the parts of so many nearest ones.
NEAR_LISTS = 32


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n nearest rows of c, nearest first."""
    out = np.empty((len(x), n), np.int64)
    half = (c * c).sum(axis=1) / 2
    for at in range(0, len(x), 2048):
        d = half - x[at : at + 2048] @ c.T
        out[at : at + 2048] = d.argmin(axis=1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n]
    return out


def rotation(d: int, seed: int = 11) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]


class Lists:
    """Centroids of a sample; with cuts > 1 each one's list is cut by the centroids of the sample's differences from theirs."""

    def __init__(self, x: np.ndarray, lists: int, cuts: int = 1):
        self.centers, self.cuts = kmeans(x, lists), None
        if cuts > 1:
            self.cuts = kmeans(x - self.centers[nearest(x, self.centers, 1)[:, 0]], cuts, seed=6)
        self.n = lists * cuts

    def of(self, x: np.ndarray) -> np.ndarray:
        """Each row's list."""
        near = nearest(x, self.centers, 1)[:, 0]
        return near if self.cuts is None else near * len(self.cuts) + nearest(x - self.centers[near], self.cuts, 1)[:, 0]

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """For each row the lists that it may look at, nearest first."""
        if self.cuts is None:
            return nearest(x, self.centers, len(self.centers))
        top, m = nearest(x, self.centers, min(NEAR_LISTS, len(self.centers))), len(self.cuts)
        out, half = np.empty((len(x), top.shape[1] * m), np.int64), (self.cuts * self.cuts).sum(axis=1) / 2
        for i, (q, one) in enumerate(zip(x, top, strict=True)):
            r = q - self.centers[one]
            d = (r * r).sum(axis=1)[:, None] / 2 - r @ self.cuts.T + half
            out[i] = (one[:, None] * m + np.arange(m)).ravel()[np.argsort(d, axis=None, kind="stable")]
        return out


def probes(x: np.ndarray, lists: Lists, k: int, recall: float, queries: int = 200) -> int:
    """How many nearest lists hold the share `recall` of the k nearest neighbours that sample vectors have in the sample."""
    near = lists.of(x)
    asked = np.linspace(0, len(x) - 1, min(queries, len(x)), dtype=np.int64)
    found = nearest(x[asked], x, min(k + 1, len(x)))
    each = []
    for q, order, f in zip(asked, lists.ranked(x[asked]), found, strict=True):
        rank = np.full(lists.n, len(order) - 1)
        rank[order] = np.arange(len(order))
        each.append(rank[near[f[f != q]]])
    each = np.concatenate(each)
    return 1 + int(np.quantile(each, recall, method="higher")) if len(each) else 1


def scan(q: np.ndarray, rotated_q: np.ndarray, x: np.ndarray, blocks: list[np.ndarray], ids: np.ndarray, k: int, bound: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids) of the k nearest within `bound` in one part, ties to smaller ids."""
    d, n = len(q), len(x)
    exact = lambda rows: np.sqrt(((x[rows] - q) ** 2).sum(axis=1))
    alive, first = np.arange(n), np.arange(0)
    if bound == math.inf and n > 4 * k:
        first, alive = alive[: 2 * k], alive[2 * k :]
        bound = np.partition(exact(first), k - 1)[k - 1]
    if bound < math.inf:
        part, seen = np.zeros(len(alive)), 0
        for b in blocks:
            part = part + ((b[alive] - rotated_q[seen : seen + b.shape[1]]) ** 2).sum(axis=1)
            seen += b.shape[1]
            limit = bound * bound * (1 if seen == d else seen / d * (1 + EPSILON / math.sqrt(seen)) ** 2)
            keep = part <= limit * (1 + 1e-9)
            alive, part = alive[keep], part[keep]
    alive = np.concatenate([first, alive])
    dist = exact(alive)
    alive, dist = alive[dist <= bound], dist[dist <= bound]
    order = np.lexsort((ids[alive], dist))[:k]
    return dist[order], ids[alive][order]


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def search(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.97, sample: int = 20_000, max_lists: int = 1024, fill: int = 1000, max_cuts: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row that the condition `queries` picks."""
    spark = vectors.sparkSession
    nothing = "query_id long, rank int, vec_id long, score double"
    v = F.col("v")
    good = vectors.where(queries.isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), queries.alias("is_query"))
    good = good.where("v is not null and size(v) > 0").where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], nothing)
    d, most = sizes[0][0], k + 1
    good = good.where(F.size("v") == d)
    # The smallest ids of equal vectors; the limit on ranks is applied before the shuffle too.
    few = good.select("id", "v").distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= most)
    entries = stored(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0]), "vectors")
    asked = stored(good.where("is_query").select("id", "v").distinct().join(entries.select("v", "rep"), "v").select(F.col("id").alias("query_id"), "rep"), "asked")
    total = entries.count()
    picked = entries.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").toPandas()["v"]  # at most `sample` vectors
    x = np.array([np.asarray(r, np.float64) for r in picked])
    lists = max(1, min(max_lists, total // 100, len(x)))
    index, turn = Lists(x, lists, min(max_cuts, len(x), -(-total // (lists * fill)))), rotation(d)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(index.of(matrix(b.column(1), d)), pa.int32())], ["rep", "v", "list"])

    kind = entries.schema["v"].dataType.simpleString()
    placed = stored(mapped(entries.select("rep", "v"), place, f"rep long, v {kind}, list int"), "placed")
    held = np.zeros(index.n, np.int64)
    for r in placed.groupBy("list").count().collect():  # a row per list, of which max_lists * max_cuts bounds the number
        held[r[0]] = r[1]
    parts = np.maximum(1, -(-held // PART))
    share = probes(x, index, k, recall)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            if not b.num_rows:
                continue
            order = index.ranked(matrix(b.column(1), d))
            upto = np.cumsum(held[order], axis=1)
            enough = np.maximum(share, 1 + (upto < max(most, FLOOR)).sum(axis=1)).clip(max=order.shape[1])
            before = upto - held[order]
            rows, found, part, first = [], [], [], []
            for i, n in enumerate(enough.tolist()):
                for one, earlier in zip(order[i, :n].tolist(), before[i].tolist(), strict=False):
                    if held[one]:
                        times = int(parts[one])
                        rows += [i] * times
                        found += [one] * times
                        first += [earlier < NEAR] * times
                        part += range(times)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(taken), b.column(1).take(taken), pa.array(found, pa.int32()), pa.array(part, pa.int32()), pa.array(first, pa.bool_())], ["rep", "v", "list", "part", "first"])

    looked = asked.select("rep").distinct().join(placed.select("rep", "v"), "rep")
    probed = mapped(looked, choose, f"rep long, v {kind}, list int, part int, first boolean")
    n_asked = np.zeros(index.n, np.int64)
    for r in probed.where("part = 0").groupBy("list").count().collect():  # a row per list
        n_asked[r[0]] = r[1]
    blocks = np.maximum(1, -(-n_asked // QUERY_BLOCK))
    some = np.flatnonzero((held > 0) | (n_asked > 0))
    deal = F.broadcast(spark.createDataFrame(pd.DataFrame({"list": some.astype(np.int32), "parts": parts[some], "blocks": blocks[some]})))  # a row per list
    probed = probed.join(deal, "list").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    dealt = placed.join(deal, "list").withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))).drop("parts", "blocks")

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = [([], [], [])]
        if left.num_rows and right.num_rows:
            x, ids = matrix(left["v"].combine_chunks(), d), left["rep"].to_numpy()
            order = np.argsort(ids)
            x, ids = x[order], ids[order]
            turned = x @ turn
            columns = [np.ascontiguousarray(turned[:, a : a + COLUMNS]) for a in range(0, d, COLUMNS)]
            q = matrix(right["v"].combine_chunks(), d)
            for (rep, bound), a, b in zip(zip(right["rep"].to_pylist(), right["bound"].to_pylist(), strict=True), q, q @ turn, strict=True):
                dist, near = scan(a, b, x, columns, ids, most, bound)
                out.append((np.full(len(near), rep), near, dist))
        return pa.table({n: pa.array(np.concatenate([o[i] for o in out]), t) for i, (n, t) in enumerate((("rep", pa.int64()), ("near", pa.int64()), ("score", pa.float64())))})

    def met(asking: DataFrame) -> DataFrame:
        by = ["list", "part", "block"]
        return dealt.groupBy(*by).cogroup(asking.select("rep", "v", *by, "bound").groupBy(*by)).applyInArrow(match, "rep long, near long, score double")

    def nearest_of(found: DataFrame) -> DataFrame:
        return found.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("score", "near"))).where(F.col("n") <= most).drop("n")

    first = stored(nearest_of(met(probed.where("first").withColumn("bound", F.lit(math.inf)))), "first")
    bounds = first.groupBy("rep").agg(F.when(F.count("*") == most, F.max("score")).alias("bound"))
    rest = met(probed.where("not first").join(bounds, "rep", "left").withColumn("bound", F.coalesce("bound", F.lit(math.inf))))
    best = nearest_of(first.unionByName(rest))
    ids = best.join(entries.select(F.col("rep").alias("near"), "ids"), "near").select("rep", "score", F.explode("ids").alias("vec_id"))
    top = ids.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("score", "vec_id"))).where(F.col("n") <= most)
    top = top.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found"))  # at most k + 1
    each = asked.join(top, "rep").select("query_id", F.slice(F.filter("found", lambda s: s["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return each.select("query_id", F.posexplode("found").alias("rank", "hit")).select("query_id", (F.col("rank") + 1).alias("rank"), "hit.vec_id", "hit.score")
