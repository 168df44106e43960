"""Operator 5: order-preserving packing by dynamic programming with a monotone queue.

Each task lays its documents' tokens end to end in the order it reads them and cuts this stream into windows of at most
`size` tokens. Cuts may lie after a document (free), after a sentence (cheap), or on a grid between these (dear), and the
program minimises, over all ways to cut, the sum of padding, cut penalties and a fixed cost per window:

    f(j) = fixed + penalty(j) + min over i with b(j) - b(i) <= size of f(i) + size - (b(j) - b(i))

f(i) + b(i) is all that depends on i, so a queue whose values rise from its head keeps the minimum in constant time per
cut. The stream is solved a block at a time; a block's last windows are left to the next. What remains at a task's end is
cut into powers of two where that costs less than padding.

Nothing is shuffled. A task's work depends on its input alone, so a task run again gives the same pieces, and sequence ids
hold the partition's number. Memory is bounded by a block plus one document.

Cases: a null or empty text is a document of the end token alone. Null ids stay null. Repeated rows are documents of their
own. No rows give no pieces. Other columns are not read. A text of any length is cut as often as needed.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quarry.llm.common import mapped, slices, texts_of
from quarry.llm.tokens import default_vocabulary, fast_encoder

SIZE, END = 2048, 1
GRID = 24
AFTER_SENTENCE, ON_GRID, PER_WINDOW = 2.0, 10.0, 16.0
BLOCK = 1 << 18
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(bounds: np.ndarray, penalty: np.ndarray, size: int = SIZE, last: bool = True) -> list[int]:
    """Indices into bounds (rising, the first is the start) at which the cheapest windows end.

    Neighbouring bounds are at most `size` apart. Unless `last`, the final windows may be left open: the best cut within
    the last `size` tokens ends the solution, by cost less the window share of what it covers.
    """
    n = len(bounds)
    at, pen = bounds.tolist(), penalty.tolist()
    f, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(float(at[0]), 0)])
    for j in range(1, n):
        b = at[j]
        while at[queue[0][1]] < b - size:
            queue.popleft()
        best, i = queue[0]
        f[j] = cost = best + size - b + pen[j] + PER_WINDOW
        back[j] = i
        key = cost + b
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    j = n - 1
    if not last:
        first = int(np.searchsorted(bounds, at[-1] - size, "right"))
        j = min(range(max(1, first), n), key=lambda k: f[k] - PER_WINDOW * at[k] / size)
    ends = []
    while j:
        ends.append(j)
        j = back[j]
    return ends[::-1]


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts may lie (0 and the end included), and what each costs."""
    n = len(ids)
    kind = np.zeros(n + 1, np.int8)  # 3: document, 2: sentence, 1: grid
    kind[1:][sentence[ids]] = 2
    kind[doc_ends] = 3
    kind[0] = kind[n] = 3
    natural = np.flatnonzero(kind)
    gaps = np.diff(natural)
    wide = np.flatnonzero(gaps > GRID)
    for k in wide.tolist():
        kind[natural[k] + GRID : natural[k + 1] : GRID] = 1
    at = np.flatnonzero(kind)
    return at, np.array([0.0, ON_GRID, AFTER_SENTENCE, 0.0])[kind[at]]


def powers(n: int) -> list[int]:
    """n as a sum of falling powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Documents in, pieces out, for one task."""

    def __init__(self, base: int, sentence: np.ndarray, size: int = SIZE, end: int = END):
        self.sequence, self.sentence, self.size, self.end = base, sentence, size, end
        self.ids: list[np.ndarray] = []
        self.docs: list[list] = []  # id, tokens before the stream's start, tokens in the stream, tokens in all
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        ids = np.append(ids, np.uint32(self.end)).astype("<u4")
        self.ids.append(ids)
        self.docs.append([doc_id, 0, len(ids), len(ids)])
        self.held += len(ids)
        if self.held >= BLOCK:
            yield from self.flush(False)

    def flush(self, last: bool = True) -> Iterator[tuple]:
        if not self.held:
            return
        ids = np.concatenate(self.ids)
        ends = np.cumsum([d[2] for d in self.docs])
        at, pen = boundaries(ids, ends, self.sentence)
        windows = at[cut(at, pen, self.size, last)].tolist()
        if last:
            start = windows[-2] if len(windows) > 1 else 0
            parts = powers(rest := windows[-1] - start)
            if len(parts) * (PER_WINDOW + ON_GRID) < self.size - rest:
                windows[-1:] = (start + np.cumsum(parts)).tolist()
        starts = ends - [d[2] for d in self.docs]
        done, d, window = 0, 0, 0
        for stop in windows:
            while done < stop:
                while ends[d] <= done:
                    d += 1
                doc_id, before, _, total = self.docs[d]
                upto = min(stop, int(ends[d]))
                yield doc_id, before + done - int(starts[d]), upto - done, zlib.crc32(ids[done:upto].tobytes()), total, self.sequence, done - window
                done = upto
            self.sequence += 1
            window = done
        if last:
            self.ids, self.docs, self.held = [], [], 0
            return
        while d < len(self.docs) and ends[d] <= done:
            d += 1
        kept = self.docs[d:]
        if kept:
            passed = done - int(starts[d])
            kept[0] = [kept[0][0], kept[0][1] + passed, kept[0][2] - passed, kept[0][3]]
        self.ids, self.docs, self.held = [ids[done:]], kept, len(ids) - done


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: which document's tokens from where, and which sequence they fill from which offset."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = fast_encoder(path)
        sentence = np.array([t[-1:] in (b".", b"!", b"?") or b"\n" in t for t in bpe.bytes])
        packer = Packer(TaskContext.get().partitionId() << 33, sentence, size, end)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]], [id_col, *(c.split()[0] for c in SCHEMA.split(", "))])

        kind = pa.int64()
        for b in slices(batches, 256):
            kind, rows = b.column(0).type, []
            for doc_id, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                rows.extend(packer.add(doc_id, bpe.encode(text)))
            if rows:
                yield out(rows)
        if rows := list(packer.flush()):
            yield out(rows)

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, {SCHEMA}")
