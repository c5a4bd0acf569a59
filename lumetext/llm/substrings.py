"""Substring dedup: Rabin-Karp hashes of every window of ``window`` words, counted over the whole corpus.

1. Each task hashes the windows of its texts in chunks (a rolling hash of 64 bits over hashed words, and 24 bits of
   another one with its own base that has to agree, too). Windows that repeat within a chunk are known there; of each distinct hash one goes on, so a very common
   passage costs one entry a chunk. The entries of a range of hashes travel as one packed row (sorted, as deltas).
2. Hashes are counted by range. What occurs in two chunks goes back, as places in its chunks. There are so many ranges
   that one stands for about ``range_bytes`` of text, however large the input, and chunks grow with them up to a bound.
3. Each chunk merges its repeated windows into maximal removal intervals for each document.
4. Documents meet their intervals, and the words outside them are kept.

Two different windows pass for equal only if all 88 bits agree, which among 10 ** 13 windows is to be expected for 0.2
pairs. Null and empty texts have no words and keep
the empty string. Texts shorter than a window lose nothing. Repeated rows repeat each other's windows. A table of
one row can still repeat within itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, lean, partitions, record_batch
from .words import hashes, mix, spans, text_buffer, windows

BASE = np.uint64(0xD1342543DE82EF95)
CHECK_BASE = np.uint64(0xAF251AF3B0F025B5)
_CHECK_BITS = np.uint64(24)
_PACKED = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("table", pa.bool_()), ("payload", pa.binary())])
_PACKED_SQL = "key long, chunk long, table boolean, payload binary"
_SPANS = pa.schema([("row_key", pa.int64()), ("id_key", pa.int64()), ("spans", pa.binary())])


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers, byte plane by byte plane, without the planes that are 0 throughout."""
    n = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return bytes([n]) + len(values).to_bytes(8, "little") + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:n]).tobytes()


def _unplaned(raw: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    n, size = raw[at], int.from_bytes(raw[at + 1 : at + 9], "little")
    at += 9
    out = np.zeros((size, 8), dtype=np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8, n * size, at).reshape(n, size).T
    return out.reshape(-1).view("<u8") if size else np.zeros(0, np.uint64), at + n * size


def ordered(found: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order in which equal pairs of hashes stand together, whether each but the first equals the one before)."""
    order = np.argsort(found)
    same = found[order][1:] == found[order][:-1]
    if (same & (check[order][1:] != check[order][:-1])).any():
        order = np.lexsort((check, found))
        same = found[order][1:] == found[order][:-1]
    return order, same & (check[order][1:] == check[order][:-1])


def pack_chunk(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, window: int, bits: int) -> tuple[list[tuple[int, bytes]], bytes]:
    """((range of hashes, packed entries) ..., the chunk's table) of some texts."""
    starts, ends, counts = spans(data, offsets)
    words = hashes(data, starts, ends)
    found, first = windows(words, counts, window, BASE)
    check = windows(words ^ words >> np.uint64(29), counts, window, CHECK_BASE)[0] >> np.uint64(64) - _CHECK_BITS
    order, same = ordered(found, check)
    found, first, check = found[order], first[order], check[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = ~same
    twice = np.zeros(len(found), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    table = _planes(keys.reshape(-1).view(np.uint64)) + _planes(np.diff(counts).astype(np.uint64)) + _planes(np.sort(first[twice]).astype(np.uint64))
    found, first, check = found[new], first[new], check[new]
    key = (found >> np.uint64(64 - bits)).astype(np.int64)
    out = []
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        if a < b:
            h = found[a:b] & np.uint64((1 << (64 - bits)) - 1)
            out.append((int(key[a]), _planes(np.diff(h, prepend=np.uint64(0))) + _planes(check[a:b]) + _planes(first[a:b].astype(np.uint64))))
    return out, table


def layout(text_bytes: int, n: int, range_bytes: int = 64_000_000) -> tuple[int, int]:
    """(bits of the number of ranges, bytes of a chunk) for so much text over n partitions."""
    ranges = max(256, 8 * n, -(-text_bytes // range_bytes))
    bits = min(40, (ranges - 1).bit_length())
    return bits, min(64_000_000, max(4_000_000, 400 << bits))


def repeated_spans(docs: DataFrame, window: int, chunk_bytes: int | None = None) -> DataFrame:
    """row_key, id_key, spans (pairs of int64: first word, end) of each row of ``docs`` (with these keys) that repeats a window."""
    n = partitions(docs.sparkSession)
    bits, usual = layout(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, n)
    chunk_bytes = chunk_bytes or usual

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            texts = pa.concat_arrays([b.column(2).cast(pa.large_string()) for b in held])
            keys = np.stack([np.concatenate([np.asarray(b.column(c)) for b in held]) for c in (0, 1)], axis=1)
            packed, table = pack_chunk(*text_buffer(texts), np.ascontiguousarray(keys), window, bits)
            chunk = (part << 24) + number
            rows = [(k, chunk, False, x) for k, x in packed] + [(int(mix(np.array([chunk], dtype=np.uint64))[0] >> np.uint64(64 - bits)), chunk, True, table)]
            return record_batch(_PACKED, list(zip(*rows, strict=True)))

        for batch in batches:
            at = 0
            sizes = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < batch.num_rows:
                done = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, done + chunk_bytes - size, side="right")))
                held.append(batch.slice(at, to - at))
                size += int(sizes[to - 1] - done)
                at = to
                if size >= chunk_bytes or at < batch.num_rows:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, entries = None, []

        def shared() -> pa.RecordBatch:
            places = []
            if len(entries) > 1:
                parts, checks = [], []
                for _, x in entries:
                    h, at = _unplaned(x)
                    check, at = _unplaned(x, at)
                    parts.append((np.cumsum(h, dtype=np.uint64), at))
                    checks.append(check.astype(np.uint32))
                h = np.concatenate([x for x, _ in parts])
                order, same = ordered(h, np.concatenate(checks))
                twice = np.zeros(len(h), dtype=bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                at = 0
                for (chunk, raw), (d, end) in zip(entries, parts, strict=True):
                    mine = twice[at : at + len(d)]
                    at += len(d)
                    if mine.any():
                        places.append((0, chunk, False, _planes(np.sort(_unplaned(raw, end)[0][mine]))))
            return record_batch(_PACKED, list(zip(*places, strict=True)) if places else [[]] * 4)

        for batch in batches:
            for key, chunk, table, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if table:
                    yield record_batch(_PACKED, [[0], [chunk], [True], [payload]])
                    continue
                if key != now:
                    yield shared()
                    now, entries = key, []
                entries.append((chunk, payload))
        yield shared()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, places = None, None, []

        def rows() -> pa.RecordBatch:
            out = []
            if table is not None:
                keys, at = _unplaned(table)
                counts, at = _unplaned(table, at)
                local, _ = _unplaned(table, at)
                ends = np.cumsum(counts.astype(np.int64))
                first = np.concatenate([local, *places]).astype(np.int64)
                if len(first):
                    step = np.zeros(int(ends[-1]) + 1, dtype=np.int64)
                    np.add.at(step, first, 1)
                    np.add.at(step, first + window, -1)
                    cover = np.cumsum(step[:-1]) > 0
                    edge = np.diff(cover.astype(np.int8), prepend=0, append=0)
                    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    # an interval that runs on into the next text is cut there
                    inner = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(cover))]
                    inner = np.unique(inner[cover[inner] & cover[inner - 1]])
                    a, b = np.sort(np.concatenate([a, inner])), np.sort(np.concatenate([b, inner]))
                    doc = np.searchsorted(ends, a, side="right")
                    begin = ends - counts.astype(np.int64)
                    pairs = np.stack([a - begin[doc], b - begin[doc]], axis=1).astype("<i8")
                    cuts = np.flatnonzero(np.diff(doc)) + 1
                    ids = keys.view(np.int64).reshape(-1, 2)
                    out = [(int(ids[doc[at], 0]), int(ids[doc[at], 1]), some.tobytes()) for at, some in zip(np.concatenate([[0], cuts]), np.split(pairs, cuts), strict=True)]
            return record_batch(_SPANS, list(zip(*out, strict=True)) if out else [[]] * 3)

        for batch in batches:
            for _, chunk, is_table, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != now:
                    yield rows()
                    now, table, places = chunk, None, []
                if is_table:
                    table = payload
                else:
                    places.append(_unplaned(payload)[0])
        yield rows()

    packed = docs.select("row_key", "id_key", "text").mapInArrow(lean("substrings", hashed), _PACKED_SQL)
    back = packed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lean("substrings", counted), _PACKED_SQL)
    found = back.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(lean("substrings", merged), "row_key long, id_key long, spans binary")
    return found.dropDuplicates(["row_key", "id_key"])  # equal rows have equal spans


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, with kept (its text without repeats), n_words, n_removed, kept_sha256."""
    row = F.struct(*[F.lit(None).cast(docs.schema[c].dataType).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(F.xxhash64(doc_id, text).alias("row_key"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("id_key"), row.alias("row"), text.alias("text"))
    packed_schema = T.StructType([*keyed.schema.fields[:3], T.StructField("z", T.BinaryType())])
    kept_schema = T.StructType([keyed.schema.fields[2], T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = zstandard.ZstdCompressor(level=1)
        for b in (part for batch in batches for part in byte_slices(batch, 3, 4_000_000)):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([write.compress(x.as_buffer()) for x in b.column(3).cast(pa.large_binary())], pa.binary())], ["row_key", "id_key", "row", "z"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = zstandard.ZstdDecompressor()
        for b in (part for batch in batches for part in byte_slices(batch, 1, 1_000_000)):
            out = []
            for z, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = read.decompress(z).split()
                n = len(words)
                if raw is not None:
                    at, left = 0, []
                    for a, e in np.frombuffer(raw, "<i8").reshape(-1, 2).tolist():
                        left += words[at:a]
                        at = e
                    words = left + words[at:]
                text = b" ".join(words)
                out.append((text, n, n - len(words), hashlib.sha256(text).hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["row", "kept", "n_words", "n_removed", "kept_sha256"])

    texts = keyed.mapInArrow(lean("substrings", shrunk), packed_schema)
    return texts.join(repeated_spans(keyed, window), ["row_key", "id_key"], "left").select("row", "z", "spans").mapInArrow(lean("substrings", kept), kept_schema)


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """The rows of ``docs``, all columns, with the kept words as text, and n_chars to match if there is such a column."""
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return remove_repeats(docs, window).select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
