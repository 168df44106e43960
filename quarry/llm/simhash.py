"""Operator 7: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within `radius` bits share a variant within radius / 2 bits of each. So every distinct fingerprint emits
all its variants within half the radius (65 for radius 2), these meet in a shuffle on the variant, and neighbours there are
linked once their distance has been verified. A variant has at most 65 distinct fingerprints near it, so no group is large
however many copies there are: copies share a fingerprint, which is counted before anything is shuffled on it. Neighbours
in order link a whole meeting without its pairs, since all that meet in half the radius are within the radius.

near_copies() is what the pipeline uses: Jaccard of 0.8 or more of 5-word shingles. Texts that alike differ in some 10 of 64
bits, which no ball reaches that is small enough to emit, so a text has PRINTS fingerprints, as short as the number of
texts allows: each emits its ball, what meets is verified on all bits and then on all shingles. What no ball joins, since
the bits of a pair fall as chance has it, is sought among texts with a MinHash band in common.

Cases: a null or blank text has fingerprint 0 and links as any other. One or two words are one shingle. Null ids keep
their row; they give no component id, which is null where no member has one. Repeated rows keep their rows. Other columns
are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import mapped, slices, stored, texts_of
from quarry.llm.graph import components

#: For each byte, its bits as eight counters of eight bits.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
#: A fingerprint that more than one row in HEAVY has is joined by broadcast: there are fewer than HEAVY of these.
HEAVY = 1000


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes, along the last axis, have each of the 64 bits set."""
    n = hashes.shape[-1]
    packed = np.add.reduceat(SPREAD[hashes.view(np.uint8).reshape(*hashes.shape, 8)], np.arange(0, n, 255), axis=-2)
    return packed.view(np.uint8).reshape(*hashes.shape[:-1], -1, 64).sum(axis=-2, dtype=np.int64)


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Majority of the bits of XXH64 over word shingles."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[:-1]))
    k = min(words, len(found))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts[: len(found) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)
    return int(np.packbits(ones(hashes) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            found = np.array([fingerprint(t, words) for t in texts_of(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, fp long")


def variants(radius: int, bits: int = 64) -> list[int]:
    """Masks, as signed longs, of at most `radius` bits."""
    masks = {0}
    for _ in range(radius):
        masks |= {m | 1 << b for m in masks for b in range(bits)}
    return [m - (1 << 64) if m >> 63 else m for m in sorted(masks)]


def links(prints: DataFrame, radius: int = 2, bits: int = 64) -> DataFrame:
    """(src, dst) between distinct fingerprints `fp`: enough of the pairs within the radius to give its components.

    Only the lowest `bits` may differ.
    """
    if radius % 2:
        raise ValueError("the radius is even: half of it on either side")
    masks = F.array(*[F.lit(m) for m in variants(radius // 2, bits)])
    ball = prints.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    met = ball.withColumn("before", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")))
    near = met.where(F.col("before").isNotNull() & (F.bit_count(F.col("fp").bitwiseXOR(F.col("before"))) <= radius))
    return near.select(F.col("before").alias("src"), F.col("fp").alias("dst"))


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach, itself included)."""
    prints = stored(fingerprints(docs, words), "prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    roots = components(links(classes.select("fp"), radius))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = stored(rooted.join(least, "root").select("fp", "component_id", "n"), "members")
    total = classes.agg(F.sum("n")).first()[0] or 0
    heavy = members.where(F.col("n") > total // HEAVY)  # fewer than HEAVY rows
    out = prints.join(F.broadcast(heavy.select("fp", F.col("component_id").alias("hot"), F.lit(True).alias("is_hot"))), "fp", "left")
    hot = out.where("is_hot").select("doc_id", "fp", F.col("hot").alias("component_id"))
    rest = out.where("is_hot is null").select("doc_id", "fp").join(members.where(F.col("n") <= total // HEAVY).select("fp", "component_id"), "fp")
    return hot.unionByName(rest).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprints of 64 bits that near_copies takes of a text. Their hashes are the shingles' own, mixed with a salt each.
PRINTS = 8
SALTS = np.random.default_rng(7).integers(0, 1 << 63, (PRINTS, 1), np.uint64)
#: MinHash bands of near_copies: BANDS keys, each of ROWS minima. A pair of Jaccard 0.8 shares none with a chance of 0.0006.
BANDS, ROWS = 40, 8
FACTORS = np.random.default_rng(42).integers(0, 1 << 31, BANDS * ROWS, np.uint32) * 2 + 1
MIX = np.uint64(0x9E3779B97F4A7C15)
ROW = 512
PRODUCTS = np.empty((BANDS * ROWS, ROW), np.uint32)


def shingles(text: str, words: int = 5) -> np.ndarray:
    """The set of a text's word shingles as sorted 64-bit hashes; a text of fewer words is one, a blank text has none."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    k = min(words, len(found))
    n = len(each) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ each[i : i + n]) * MIX
        out ^= out >> np.uint64(29)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are equal."""
    c = np.concatenate((a, b))
    c.sort()
    both = int((c[1:] == c[:-1]).sum())
    return both / (len(c) - both) if len(c) else 1.0


def majorities(hashes: np.ndarray) -> np.ndarray:
    """PRINTS fingerprints of a set of shingles, as signed longs."""
    counts = np.zeros((PRINTS, 64), np.int64)
    for at in range(0, len(hashes), 255 * 8):
        mixed = (hashes[at : at + 255 * 8] ^ SALTS) * MIX
        mixed ^= mixed >> np.uint64(32)
        mixed *= MIX
        mixed ^= mixed >> np.uint64(29)
        counts += ones(mixed)
    return np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").view("<i8").ravel()


def signature(text: str, words: int = 5) -> tuple[int, int, list[int], list[int]]:
    """A hash of the set of shingles, its size, its fingerprints and a key per band (none of a blank text), as signed longs."""
    hashes = shingles(text, words)
    if not len(hashes):
        return 0, 0, [], []
    low = hashes.astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), ROW):
        part = low[at : at + ROW]
        np.minimum(least, np.multiply.outer(FACTORS, part, out=PRODUCTS[:, : len(part)]).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))]
    same, size = np.array([xxhash.xxh64_intdigest(hashes.tobytes()), len(hashes)], np.uint64).view(np.int64).tolist()
    return same, size, majorities(hashes).tolist(), np.array(keys, np.uint64).view(np.int64).tolist()


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, text_hash, same, size, prints, keys): `same` is equal where the sets of shingles are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            found = [signature(t, words) for t in texts_of(b.column(2))]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "text_hash", "same", "size", "prints", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), run, f"doc_id {kind}, text_hash long, same long, size long, prints array<long>, keys array<long>")


def width(nodes: int) -> int:
    """Bits of a fingerprint at which at most one of `nodes` others in two is within two bits of a given one by chance."""
    bits = 16
    while bits < 56 and nodes * (1 + bits + bits * (bits - 1) // 2) > 1 << (bits - 1):
        bits += 1
    return bits


def met(nodes: DataFrame, least: float = 0.8, drawn: int = 12) -> DataFrame:
    """(x, y) of nodes (same, size, prints) whose balls meet: candidates of SimHash, up to `drawn` of each x, the closest ones.

    Each fingerprint is cut to as many bits as the number of nodes needs. As in near_duplicates, the distinct ones emit
    their balls and links() tells which of them are close; two nodes of each, drawn by lot, stand for it. A pair that is
    close by chance in one fingerprint is told by the bits of all: alike ones differ in 0.15 of them, others in half.
    """
    bits = width(nodes.where("size > 0").count())
    cut = F.col("print").bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.shiftleft(F.col("which").cast("long"), 56))
    each = nodes.select("same", F.posexplode("prints").alias("which", "print")).select("same", cut.alias("fp"))
    lot = lambda seed: F.struct(F.xxhash64("fp", "same", F.lit(seed)).alias("lot"), "same")
    classes = stored(each.groupBy("fp").agg(F.min(lot(1)).alias("one"), F.min(lot(2)).alias("two")), "classes")
    stand = lambda end, name: classes.select(F.col("fp").alias(end), F.col("one.same").alias(name))
    inside = each.join(classes, "fp").select(F.col("same").alias("x"), F.explode(F.array("one.same", "two.same")).alias("y"))
    across = links(classes.select("fp"), 2, bits).distinct().join(stand("src", "x"), "src").join(stand("dst", "y"), "dst").select("x", "y")
    pairs = inside.union(across).where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    of = lambda end: nodes.select(F.col("same").alias(end), F.col("size").alias(f"size_{end}"), F.col("prints").alias(f"prints_{end}"))
    differ = F.aggregate(F.zip_with("prints_x", "prints_y", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    fits = F.least("size_x", "size_y") + 1e-9 >= least * F.greatest("size_x", "size_y")
    close = pairs.join(of("y"), "y").join(of("x"), "x").where(fits).select("x", F.struct(differ.alias("differ"), "y").alias("other")).where(F.col("other.differ") <= 16 * PRINTS)
    return close.groupBy("x").agg(F.slice(F.array_sort(F.collect_list("other")), 1, drawn).alias("some")).select("x", F.inline("some")).select("x", "y")


def unsettled(rooted: DataFrame) -> DataFrame:
    """The rows (key, same, size, root) of keys whose nodes are not all in one component."""
    ends = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return rooted.join(ends, "key")


def lifted(rooted: DataFrame, roots: DataFrame) -> DataFrame:
    """The same rows, whose `root` is replaced by the root of its component in (node, root)."""
    tops = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return rooted.join(tops, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")


def sets(texts: DataFrame, words: int) -> DataFrame:
    """(same, hashes) from (same, text): the set of shingles, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            found = [shingles(t, words).tobytes() for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["same", "hashes"])

    return mapped(texts.select("same", "text"), run, "same long, hashes binary")


def alike(pairs: DataFrame, hashed: DataFrame, least: float) -> DataFrame:
    """(src, dst) from (x, y, src, dst): those whose sets x and y have a Jaccard similarity of `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            each = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            keep = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) + 1e-9 >= least for x, y in each]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    of = lambda name: hashed.select(F.col("same").alias(name), F.col("hashes").alias(f"set_{name}"))
    both = pairs.join(of("y"), "y").join(of("x"), "x")
    return mapped(both.select("src", "dst", "set_x", "set_y"), run, "src long, dst long").distinct()


def prefixes(apart: DataFrame, hashed: DataFrame, least: float) -> DataFrame:
    """(h, at, same, root, size): the rarest shingles h of each node (same, root, size), of which nodes that are alike share one.

    Shingles are ordered by how many of these nodes have them, then by hash; at is a shingle's place in that order. Two
    sets of Jaccard `least` share a shingle among the first size - ceil(least * size) + 1 of each. What nodes have in
    common only because many have it (a passage that a third of them quote) stands last and brings no pairs about.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            found = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            if found:
                whose = np.repeat(b.column(0).to_numpy(), [len(x) for x in found])
                yield from slices([pa.RecordBatch.from_arrays([pa.array(whose), pa.array(np.concatenate(found))], ["same", "h"])], 1 << 16)

    held = mapped(hashed.join(apart.select("same"), "same").select("same", "hashes"), each, "same long, h long")
    common = held.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    # Shingles that no other node has come first and bring no pairs, so places are counted from the end.
    last = F.row_number().over(Window.partitionBy("same").orderBy(F.desc("df"), F.desc("h")))
    rows = held.join(common, "h").select("same", "h", last.alias("last")).join(apart, "same")
    first = F.col("size") - F.ceil(F.col("size") * least - 1e-6) + 1
    return rows.select("h", (F.col("size") - F.col("last")).alias("at"), "same", "root", "size").where(F.col("at") < first)


def near_copies(docs: DataFrame, least: float = 0.8, words: int = 5, drawn: int = 12) -> DataFrame:
    """doc_id, text_hash, component_id (the smallest doc_id that links reach), root (differs by component), linked by Jaccard of word shingles.

    Texts of one set of shingles are one node. Nodes that SimHash balls bring together are verified on all their shingles
    and linked. What these links leave in several components is a candidate where it shares a band, and verified alike.
    First every such band draws two nodes by lot, and a node is held against up to `drawn` of those that its bands have
    drawn, so that large groups of copies join without their pairs; a band whose nodes are in one component then is done.
    Nodes of the other bands are joined exactly, by their rarest shingles. Null and blank texts are copies of each other;
    null ids link but give no component id.
    """
    prints = stored(signatures(docs, words), "signatures")
    member = F.struct("doc_id", "text_hash")
    chosen = F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), member)), F.min(member))
    once = [F.first(name).alias(name) for name in ("size", "prints", "keys")]
    nodes = stored(prints.groupBy("same").agg(*once, chosen.alias("chosen"), F.min("doc_id").alias("least")), "nodes")
    balls = stored(met(nodes, least, drawn), "met")
    entries = nodes.select("same", "size", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    live = stored(entries.join(shared, "key"), "bands")
    held = live.select("same").union(balls.select("x")).union(balls.select("y")).distinct()
    at = held.join(nodes.select("same", "chosen"), "same").select("same", F.col("chosen.doc_id").alias("id"), F.col("chosen.text_hash").alias("h"))
    text = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    found = text.join(at, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")))
    hashed = stored(sets(found.dropDuplicates(["same"]), words), "sets")
    close = stored(components(stored(alike(balls.select("x", "y", F.col("x").alias("src"), F.col("y").alias("dst")), hashed, least), "alike")), "roots")
    live = stored(unsettled(lifted(live.withColumn("root", F.col("same")), close)), "bands")
    fits = F.least("size", "other.size") + 1e-9 >= least * F.greatest("size", "other.size")
    lot = lambda seed: F.struct(F.xxhash64("key", "same", F.lit(seed)).alias("lot"), "same", "size", "root")
    two = live.groupBy("key").agg(F.array(F.min(lot(1)), F.min(lot(2))).alias("two"))
    drew = live.join(two, "key").select("same", "size", "root", F.explode("two").alias("other")).where("root <> other.root").where(fits)
    some = F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("other.same").alias("lot"), F.col("other.same").alias("y"), F.col("other.root").alias("dst")))), 1, drawn)  # of at most 2 * BANDS
    pairs = drew.groupBy(F.col("same").alias("x"), F.col("root").alias("src")).agg(some.alias("some")).select("x", "src", F.inline("some")).select("x", "y", "src", "dst")
    drawn_roots = stored(components(stored(alike(pairs, hashed, least), "alike")), "roots")
    apart = stored(unsettled(lifted(live, drawn_roots)).select("same", "root", "size").distinct(), "apart")
    first = stored(prefixes(apart, hashed, least), "prefixes")
    other = first.select("h", F.struct("at", "same", "root", "size").alias("other"))
    rest = F.least(F.col("size") - F.col("at"), F.col("other.size") - F.col("other.at"))  # what may be common from here on
    enough = rest + 1e-6 >= least / (1 + least) * (F.col("size") + F.col("other.size"))
    pairs = first.join(other, "h").where("root < other.root").where(fits & enough).select(F.col("same").alias("x"), F.col("other.same").alias("y"), F.col("root").alias("src"), F.col("other.root").alias("dst")).distinct()
    tops = components(stored(alike(pairs, hashed, least), "alike"))
    rooted = nodes.select("same", "least", F.col("same").alias("root"))
    for roots in (close, drawn_roots, tops):
        rooted = lifted(rooted, roots)
    rooted = stored(rooted, "rooted")
    members = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("same", "component_id", "root")
    return prints.select("doc_id", "text_hash", "same").join(stored(members, "copies"), "same").select("doc_id", "text_hash", "component_id", "root")
