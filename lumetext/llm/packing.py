"""Best-fit packing of token sequences into bins of fixed capacity, by best-two-fit.

Pieces differ only in their length, so the plan is made once over the histogram of lengths (at most ``capacity``
numbers, however large the corpus): ``plan`` fills a bin greedily with the longest piece that fits, then replaces
the bin's smallest piece by the two unpacked ones that fill its gap more tightly, and repeats that bin as often as
the histogram allows. Each piece then finds its place from its rank among the pieces of its length, which comes from
counts by (partition, length): no task sees more than a partition and no global sort takes place.

Null and empty texts are one token (the end id). A longer document than ``capacity`` is cut into pieces of
``capacity`` tokens, its first piece being shorter if need be. Repeated rows and rows without
doc_id are packed as often as they occur. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, id_and_text, lean, record_batch
from .pieces import TokenizerPieces, loaded
from .token_counts import by_bytes

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, place long"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("place", pa.int64())])
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_PLACED_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def plan(counts: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths of the bin) for the histogram ``counts[length]``; the capacity is the last length."""
    left = counts.astype(np.int64).copy()
    capacity = len(left) - 1
    bins: list[tuple[int, tuple[int, ...]]] = []

    def longest(room: int, used: dict[int, int], low: int = 1) -> int:
        for n in np.flatnonzero(left[low : room + 1])[::-1] + low:
            if left[n] > used.get(int(n), 0):
                return int(n)
        return 0

    while left.any():
        room, items, used = capacity, [], {}
        while room and (n := longest(room, used)):
            fit = min(room // n, int(left[n]) - used.get(n, 0))
            items += [n] * fit
            used[n] = used.get(n, 0) + fit
            room -= n * fit
        if room and items:
            smallest = items[-1]
            used[smallest] -= 1
            gap, best = room + smallest, (smallest, 0, 0)
            free = left[: gap + 1].copy()
            for n, k in used.items():
                if n <= gap:
                    free[n] -= k
            at = np.flatnonzero(free[1:] > 0) + 1
            if len(at):
                # for each a the largest b that still fits
                b = at[np.maximum(np.searchsorted(at, gap - at, side="right") - 1, 0)]
                fits = (at + b <= gap) & ((at != b) | (free[at] > 1))
                lower = (at == b) & (free[at] < 2) & (at + b <= gap)
                if lower.any():
                    k = np.maximum(np.searchsorted(at, at[lower]) - 1, 0)
                    b[lower] = at[k]
                    fits[lower] = at[k] != at[lower]
                total = np.where(fits, at + b, 0)
                j = int(np.argmax(total))
                if total[j] > smallest:
                    best = (int(total[j]), int(at[j]), int(b[j]))
            if best[1]:
                items = items[:-1] + sorted(best[1:], reverse=True)
        lengths, need = np.unique(items, return_counts=True)
        times = int((left[lengths] // need).min())
        left[lengths] -= times * need
        bins.append((times, tuple(items)))
    return bins


def slots(bins: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, bin, times per bin, first place within the bin, first sequence) by rank."""
    out: dict[int, list] = {}
    seen: dict[int, int] = {}
    sequence = 0
    for times, items in bins:
        offset, at = 0, 0
        while at < len(items):
            n, k = items[at], 1
            while at + k < len(items) and items[at + k] == n:
                k += 1
            out.setdefault(n, []).append((seen.get(n, 0), k, offset, sequence))
            seen[n] = seen.get(n, 0) + times * k
            offset += n * k
            at += k
        sequence += times
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def encode_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int | None, batch_bytes: int = 4_000_000) -> DataFrame:
    """A row for each piece, with its partition and its rank among the pieces of its length there. To be materialised."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for ids, texts in by_bytes(batches, batch_bytes):
            got, before = loaded(TokenizerPieces, tokenizer_path).encode(texts, end_id)
            n = np.diff(before)
            times = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), times)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)
            head = n[doc] - (times[doc] - 1) * capacity
            start = np.where(piece, head + (piece - 1) * capacity, 0)
            length = np.where(piece, capacity, head)
            raw = memoryview(got.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * (before[doc] + start)).tolist(), (4 * (before[doc] + start + length)).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            place = np.empty(len(doc), dtype=np.int64)
            place[order] = np.arange(len(doc)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            yield record_batch(_PIECES_ARROW, [ids.take(pa.array(doc)), piece.astype(np.int32), start, length.astype(np.int32), crc, np.full(len(doc), part, dtype=np.int32), place])

    return id_and_text(docs).mapInArrow(lean("packing", encode), _PIECES)


def place_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """The sequence and the offset of each of the (materialised) pieces."""
    spark = pieces.sparkSession
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # ranks run over partitions: what the earlier partitions have of a length
    before = by_part.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    layout = spark.sparkContext.broadcast(slots(plan(counts)))  # its size depends on ``capacity`` only

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                n = int(length[rows[0]])
                table = layout.value[n]
                k = table[np.searchsorted(table[:, 0], rank[rows], side="right") - 1]
                within = rank[rows] - k[:, 0]
                sequence[rows] = k[:, 3] + within // k[:, 1]
                offset[rows] = k[:, 2] + within % k[:, 1] * n
            yield record_batch(_PLACED_ARROW, [batch.column("doc_id"), batch.column("piece"), batch.column("start"), length.astype(np.int64), batch.column("ids_crc32"), sequence, offset])

    ranked = pieces.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(lean("packing", place), _PLACED)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int | None = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    return place_pieces(cut(encode_pieces(docs, tokenizer_path, capacity, end_id)), capacity)
