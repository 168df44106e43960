"""Operator 4: byte-level BPE encoding and decoding, by prefix-sharing trie traversal (see tokens.py).

A row gives a row: nothing is shuffled, and a lost task is run again from its input. Each Python worker keeps a cache of
bounded size, so memory doesn't grow with the input.

Cases: a null or empty text has no tokens and decodes to "". Null ids stay null. Repeated rows give repeated rows. Other
columns are not read, whatever they are called. A special token's string inside a text counts as that token.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import mapped, slices, texts_of
from quarry.llm.tokens import default_vocabulary, encoder

ROWS = 512


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the whole text's tokens."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in slices(batches, ROWS):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode(texts_of(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids); bytes that aren't UTF-8 become replacement characters. Null ids: an empty text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in slices(batches, ROWS):
            texts = [bpe.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return mapped(tokens.select(id_col, "ids"), run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them, in one pass."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        names = [str(i) for i in range(len(bpe.bytes))]
        sha = hashlib.sha256
        for b in slices(batches, ROWS):
            n, ids_sha, text_sha = [], [], []
            for packed in bpe.encode(texts_of(b.column(1))):
                ids = np.frombuffer(packed, "<u4")
                n.append(len(ids))
                ids_sha.append(sha(",".join(map(names.__getitem__, ids.tolist())).encode()).hexdigest())
                text_sha.append(sha(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
