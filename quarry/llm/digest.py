"""Operator 9: quartile bucket digests of documents, and a bounded difference score between them.

A digest counts hashed byte triplets in BUCKETS buckets and writes, for each bucket, the quartile of its count among the
text's own buckets in two bits, after one byte for the length's logarithm. Two digests differ by the steps between their
quartiles (opposite ends count double) and their lengths; likeness is one minus that over its greatest value.

Comparing each document with the next one by id needs neighbours together, at any size: ids alone give at most
4 x spark.sql.shuffle.partitions ranges of about equal size; each row goes to its range, compressed, with its own digest
already made; the first row of a range also goes to the range before it, and that of the first range to the last. No task
holds more than a range of compressed texts, and only a few ids per range reach the driver.

Cases: a null text is empty; texts of under three bytes are padded with zero bytes. Null ids come first. Rows that share an
id follow each other in the order of their texts' hashes. A single row is its own next. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import mapped, slices, texts_of

BUCKETS = 1024
FAR_LENGTH = 16
NO_ID = -(1 << 63)


def codes(text: str) -> np.ndarray:
    """The length's code, then each bucket's quartile."""
    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw if len(raw) > 2 else raw.ljust(3, b"\0"), np.uint8).astype(np.uint32)
    k = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    k ^= k >> 15
    k *= np.uint32(2246822519)
    k ^= k >> 13
    count = np.bincount(k % BUCKETS, minlength=BUCKETS)
    ranked = np.sort(count)
    out = np.empty(BUCKETS + 1, np.uint8)
    out[0] = min(255, round(6 * np.log2(len(raw) + 1)))
    out[1:] = sum((count > ranked[BUCKETS * i // 4 - 1]).astype(np.uint8) for i in (1, 2, 3))
    return out


def packed(c: np.ndarray) -> bytes:
    q = c[1:].reshape(-1, 4)
    return bytes(c[:1]) + (q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    return np.concatenate([b[:1], (b[1:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel()])


def written(c: np.ndarray) -> str:
    return packed(c).hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests, 0 for the most different ones."""
    d = np.abs(a.astype(np.int16) - b)
    far = 12 * min(int(d[0]), FAR_LENGTH)
    steps = d[1:]
    return 1.0 - float(steps.sum() + 3 * (steps == 3).sum() + far) / (6 * BUCKETS + 12 * FAR_LENGTH)


def edited(text: str, after: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    n = len(text) // 2
    return text[: len(text) - n] + after[:n]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([written(codes(t)) for t in texts_of(b.column(1))], pa.string())], [id_col, "fingerprint"])

    return mapped(docs.select(id_col, text_col), run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's digest and its edited text's, and how near they and the next document's are."""
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = ids.approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    bounds = np.unique(np.array([int(x) for x in found], np.int64))

    def first_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}
        for b in batches:
            keys = b.column(0).to_numpy()
            for r, key in zip(np.searchsorted(bounds, keys, "right").tolist(), keys.tolist(), strict=True):
                if key < least.get(r, 1 << 63):
                    least[r] = key
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.int64())], ["r", "key"])

    firsts = sorted(mapped(ids, first_of, "r int, key long").groupBy("r").agg(F.min("key")).collect())  # a row per range at most
    before = {r[0]: firsts[i - 1][0] for i, r in enumerate(firsts)}
    first = {r[0]: r[1] for r in firsts}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in slices(batches, 512):
            rows = []
            for key, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                r = int(np.searchsorted(bounds, key, "right"))
                raw = text.encode()
                row = (key, xxhash.xxh64_intdigest(raw) >> 1, pack(raw), packed(codes(text)))
                rows.append((r, 0, *row))
                if key == first[r]:
                    rows.append((before[r], 1, *row))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = ["r", "halo", "key", "h", "z", "codes"]
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), "text")
    dealt = mapped(keyed, deal, "r int, halo int, key long, h long, z binary, codes binary")
    near = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "r").sortWithinPartitions("r", "halo", "key", "h")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last = zstandard.ZstdDecompressor().decompress, None
        for b in slices(batches, 512):
            rows = []
            for r, halo, key, _, z, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                now = (r, halo, key, unpack(z).decode(), unpacked(c))
                if last and last[0] == r and not last[1]:
                    text = edited(last[3], now[3])
                    own, other = last[4], codes(text)
                    rows.append((last[2] if last[2] != NO_ID else None, len(last[3]), hashlib.sha256(text.encode()).hexdigest(), written(own), written(other), likeness(own, other), likeness(own, now[4])))
                last = now
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out_kinds, strict=True)], out_names)

    out_kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    out_names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return mapped(near, pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
