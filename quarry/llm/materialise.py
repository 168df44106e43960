"""Operator 2: training-order materialisation of token sequences by a keyed Feistel permutation.

Documents' tokens, each with an end token, are laid end to end in each task and cut into sequences of `length`; the last of
a task is padded. Sequence k of N goes to slot P(k): a four-round Feistel network on the smallest even number of bits that
hold N, walked on until the slot is below N. P is a bijection of 0..N-1 that needs no table, can be inverted, and is known
from (key, N) alone. Slots are dealt in ranges to shards; each task sorts a shard's sequences by slot and writes them with a
fixed stride, so slot s is at byte (s mod per_shard) * stride of shard s // per_shard, and reading may stop and go on
anywhere. A shard is written beside its place and then renamed, and its bytes depend on the input alone, so a task that runs
again does no harm.

Only the number of sequences of each task reaches the driver. Ids take two bytes where the vocabulary allows, else four.

The shards' folder must be one that executors share; a path without a scheme is one of the default file system. Python
writes where the folder is mounted (file:). In a store that only Spark reaches, a shard is a Parquet file in that folder
with the same bytes per slot, sorted by slot, so that reading from a slot on skips the row groups before it.

Cases: a null or empty text is its end token alone. Repeated rows are documents of their own. No rows make no shards. Other
columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import mapped, shared_dir, slices, stored, texts_of
from quarry.llm.tokens import default_vocabulary, fast_encoder

LENGTH, END, PAD, KEY = 2048, 50256, 50256, 0x9E3779B97F4A7C15
ROUNDS = 4
#: Neighbouring sequences that are kept compressed together until they are dealt out.
TOGETHER = 1024


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def _network(x: np.ndarray, half: int, key: int, back: bool) -> np.ndarray:
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> h, x & mask
    for r in range(ROUNDS)[:: -1 if back else 1]:
        k = key * (2 * r + 1) + r
        if back:
            left, right = right ^ (_mix(left, k) & mask), left
        else:
            left, right = right, left ^ (_mix(right, k) & mask)
    return left << h | right


def permuted(index: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The slot of each index below n; with back, the index of each slot. Walks on while outside 0..n-1."""
    x = np.asarray(index).astype(np.uint64)
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    out = _network(x, half, key, back)
    while (far := out >= n).any():
        out[far] = _network(out[far], half, key, back)
    return out.astype(np.int64)


def sequences(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end: int = END, pad: int = PAD) -> DataFrame:
    """(task, k, z, n_tokens, first_doc, first_start): z holds the ids of sequences k, k + 1, ..., as many as the arrays
    have entries, compressed together."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pack = fast_encoder(path), zstandard.ZstdCompressor(level=5).compress
        width = "<u2" if len(bpe.bytes) <= 1 << 16 else "<u4"
        task, k = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        made: list[tuple[np.ndarray, int, tuple]] = []  # ids, how many aren't padding, where the first comes from
        n, at = 0, (None, 0)  # tokens held, and where the first of them comes from

        def batch() -> pa.RecordBatch:
            z = pack(np.concatenate([m[0] for m in made]).astype(width).tobytes())
            columns = [[task], [k], [z], [[m[1] for m in made]], [[m[2][0] for m in made]], [[m[2][1] for m in made]]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for b in slices(batches, 256):
            for doc_id, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                ids = np.append(bpe.encode(text), np.uint32(end))
                if not n:
                    at = (doc_id, 0)
                held.append(ids)
                n += len(ids)
                if n >= length:
                    all_ids = np.concatenate(held)
                    before = n - len(ids)
                    for s in range(0, n - length + 1, length):
                        made.append((all_ids[s : s + length], length, at))
                        at = (doc_id, s + length - before)
                        if len(made) == TOGETHER:
                            yield batch()
                            k, made = k + len(made), []
                    held, n = [all_ids[n - n % length :]], n % length
        if n:
            made.append((np.pad(np.concatenate(held), (0, length - n), constant_values=pad), n, at))
        if made:
            yield batch()

    names = ["task", "k", "z", "n_tokens", "first_doc", "first_start"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3]
    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "task long, k long, z binary, n_tokens array<long>, first_doc array<long>, first_start array<long>")


def shard_size(n: int, least: int = 4096, most_shards: int = 20_000) -> int:
    """Sequences of a shard: at least `least`, and more where there would be over `most_shards` shards to shuffle to."""
    return max(least, -(-n // most_shards))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: that of the default file system where it names none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def materialise(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, key: int = KEY, per_shard: int | None = None, to: str | None = None) -> DataFrame:
    """Writes the shards and returns a row per sequence: slot, shard, byte_offset, n_tokens, first_doc, first_start, crc32,
    and the folder, which read_shards() takes.

    per_shard: sequences of a shard, shard_size() of their number if None. Each range of slots is one shuffle partition.
    """
    spark = docs.sparkSession
    made = stored(sequences(docs, vocabulary, length), "sequences")
    counts = sorted((r[0], r[1]) for r in made.groupBy("task").agg(F.sum(F.size("n_tokens"))).collect())  # a row per task
    base, n = {}, 0
    for task, c in counts:
        base[task] = n
        n += c
    per_shard = per_shard or shard_size(n)
    to = qualified(spark, to or f"{shared_dir(spark)}/quarry/shards-{uuid.uuid4().hex}")
    local = "/" + to.removeprefix("file:").lstrip("/") if to.startswith("file:") else None

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        for b in slices(batches, 1):
            for task, k, z, *told in zip(*(c.to_pylist() for c in b.columns), strict=True):
                slot = permuted(base[task] + k + np.arange(len(told[0])), n, key)
                raw = unpack(z)
                stride = len(raw) // len(slot)
                each = [pack(raw[a : a + stride]) for a in range(0, len(raw), stride)]
                columns = [pa.array(slot), pa.array(slot // per_shard), *(pa.array(c, pa.int64()) for c in told), pa.array(each, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["slot", "shard", "n_tokens", "first_doc", "first_start", "z"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, out, shard, temporary = zstandard.ZstdDecompressor().decompress, None, None, ""
        attempt = TaskContext.get().taskAttemptId()

        def close() -> None:
            if out:
                out.close()
                os.replace(temporary, f"{local}/shard-{shard:08d}.bin")

        for b in slices(batches, 512):
            rows = []
            for slot, s, n_tokens, doc, start, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = unpack(z)
                if local and s != shard:
                    close()
                    os.makedirs(local, exist_ok=True)
                    shard, temporary = s, f"{local}/.shard-{s:08d}-{attempt}"
                    out = open(temporary, "wb")  # noqa: SIM115
                if out:
                    out.write(raw)
                rows.append((slot, s, (slot - s * per_shard) * len(raw), n_tokens, doc, start, zlib.crc32(raw), None if local else raw))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        close()

    names = ["slot", "shard", "byte_offset", "n_tokens", "first_doc", "first_start", "crc32", "ids"]
    kinds = [*[pa.int64()] * 7, pa.binary()]
    placed = mapped(made, place, "slot long, shard long, n_tokens long, first_doc long, first_start long, z binary")
    shards = max(1, -(-n // per_shard))
    dealt = placed.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("slot")
    rows = mapped(dealt, write, "slot long, shard long, byte_offset long, n_tokens long, first_doc long, first_start long, crc32 long, ids binary")
    if local:
        rows = stored(rows.drop("ids"), "index")  # the shards are written once, here
    else:
        schema = rows.schema
        rows.write.mode("overwrite").parquet(to)
        rows = spark.read.schema(schema).parquet(to).drop("ids")
    return rows.withColumn("folder", F.lit(to))


def read_shards(folder: str, first: int, count: int, length: int = LENGTH, per_shard: int = 4096, width: str = "<u2", spark: SparkSession | None = None) -> Iterator[np.ndarray]:
    """Sequences of slots first, first + 1, ... by seeking; goes on from any slot. A folder that is not mounted is read
    by `spark`, shard by shard."""
    if not folder.startswith(("file:", "/")):
        for shard in range(first // per_shard, (first + count - 1) // per_shard + 1):
            low, high = max(first, shard * per_shard), min(first + count, (shard + 1) * per_shard)
            rows = spark.read.parquet(folder).where(F.col("slot").between(low, high - 1)).select("slot", "ids")
            for r in sorted(rows.collect()):  # at most a shard
                yield np.frombuffer(r.ids, width)
        return
    stride = length * np.dtype(width).itemsize
    at = "/" + folder.removeprefix("file:").lstrip("/")
    for slot in range(first, first + count):
        with open(f"{at}/shard-{slot // per_shard:08d}.bin", "rb") as f:
            f.seek(slot % per_shard * stride)
            yield np.frombuffer(f.read(stride), width)


def inverse_check(n: int, key: int = KEY) -> bool:
    """Whether P and its inverse undo each other on 0..n-1."""
    x = np.arange(n)
    return bool((permuted(permuted(x, n, key), n, key, back=True) == x).all())
