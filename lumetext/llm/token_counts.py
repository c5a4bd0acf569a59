"""Token counts: batch encoding in Arrow functions that return lengths only.

Rows of a partition are gathered into batches of about ``batch_bytes`` of text, however many rows that takes; long
texts are cut at boundaries that the tokenizer can't join across (see ``pieces``), so no call gets an unbounded
text unless it has no such boundary. Null and empty texts count 0 tokens. Repeated rows and rows without doc_id each
get a row. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import byte_slices, id_and_text, lean, record_batch
from .pieces import SentencePieceCounts, TokenizerPieces, loaded

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def by_bytes(batches: Iterator[pa.RecordBatch], batch_bytes: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of about ``batch_bytes`` each, in order."""
    held, size = [], 0

    def taken() -> tuple[pa.Array, pa.Array]:
        return pa.concat_arrays([b.column(0) for b in held]), pa.concat_arrays([b.column(1).cast(pa.large_string()) for b in held])

    for batch in batches:
        for part in byte_slices(batch, 1, batch_bytes):
            held.append(part)
            size += pc.sum(pc.binary_length(part.column(1))).as_py()
            if size >= batch_bytes:
                yield taken()
                held, size = [], 0
    if held:
        yield taken()


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 4096, batch_bytes: int = 4_000_000) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and whether there are more than ``limit``; no begin, end or added tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in by_bytes(batches, batch_bytes):
            if tokenizer_path.endswith(".model"):
                n = np.array(loaded(SentencePieceCounts, tokenizer_path).count(texts.to_pylist()), dtype=np.int64)
            else:
                n = np.diff(loaded(TokenizerPieces, tokenizer_path).encode(texts)[1])
            yield record_batch(_ARROW, [ids, pc.binary_length(texts), n, pa.array(n > limit)])

    return id_and_text(docs).mapInArrow(lean("counts", count), SCHEMA)
