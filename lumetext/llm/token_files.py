"""Token-id files: a shared zstandard dictionary, a frame for each document, an offset index.

Documents are dealt over ranges of (doc_id, hash of the text), one for each shuffle partition, so that no id is too common
for that. A range is written in ascending order to files of about ``shard_bytes``, however many documents that takes:

    magic 8 bytes | sha256 of the dictionary 32 | documents u64 | tokens u64 | bytes an id u64
    doc_id i64 x n | tokens u64 x n | offset of the frame u64 x (n + 1) | frames

Each frame is one document's ids (little-endian, unsigned, 2 or 4 bytes each), compressed on its own with the shared
dictionary, so ``Shard`` reads a short document by one seek and one frame. The dictionary is trained on the serialized ids
of a bounded sample of documents (``sample_docs``, the ones of least hash) and lies beside the shards. Of a document
of more than ``sample_bytes`` bytes of ids the sample has ``SLICES`` slices, from its start to its end, of so many
bytes in all. The files hold every document whole.

Null and empty texts have just the end id. Repeated rows are written as often as they occur; rows with a null doc_id
come first. An empty table gives no shard. Files are written under a name of the attempt's own and then renamed, so a
task that is run again or twice leaves one whole file. The manifest stays in Spark; the driver gets a number for each range.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path, id_and_text, lean, partitions, record_batch
from .pieces import TokenizerPieces, loaded
from .token_counts import by_bytes

MAGIC = b"LTOKENS1"
_HEAD = struct.Struct("<8s32sQQQ")
SLICES = 8
_NO_ID = -(2**63)
_MANIFEST = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64())])
_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def file_system(uri: str):
    """(file system, path) of a folder's address; anything that Spark's executors share."""
    from pyarrow import fs

    scheme, found, rest = uri.partition("://")
    if found and scheme in ("s3a", "s3n"):  # Spark's names for it
        uri = "s3://" + rest
    return fs.FileSystem.from_uri(uri if found or uri.startswith("file:") else "file://" + uri)


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """b"" if there is too little to learn from."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def sampled(ids: bytes, most: int, width: int) -> bytes:
    """``ids``, or slices from across it of ``most`` bytes in all."""
    if len(ids) <= most:
        return ids
    n, each = len(ids) // width, max(1, most // SLICES // width)
    starts = np.linspace(0, max(0, n - each), min(SLICES, max(1, most // width))).astype(np.int64) * width
    return b"".join(ids[a : a + each * width] for a in starts.tolist())


def _shared(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def shard_bytes_of(doc_ids: list[int], n_tokens: list[int], frames: list[bytes], dictionary: bytes, width: int) -> bytes:
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames], dtype=np.uint64)]).astype("<u8")
    head = _HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest(), len(frames), sum(n_tokens), width)
    return b"".join([head, np.array(doc_ids, dtype="<i8").tobytes(), np.array(n_tokens, dtype="<u8").tobytes(), offsets.tobytes(), *frames])


class Shard:
    """Random access to the documents of a shard: only its index is read whole, then one stretch for each document."""

    def __init__(self, source, dictionary: bytes):
        """source: an open file that can seek, or the shard's bytes."""
        self._source = io.BytesIO(source) if isinstance(source, bytes) else source
        magic, digest, self.n, self.tokens, self.width = _HEAD.unpack(self._source.read(_HEAD.size))
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token file of this dictionary")
        index = self._source.read(24 * self.n + 8)
        self.doc_ids = np.frombuffer(index, "<i8", self.n)
        self.n_tokens = np.frombuffer(index, "<u8", self.n, 8 * self.n).astype(np.int64)
        self.offsets = np.frombuffer(index, "<u8", self.n + 1, 16 * self.n).astype(np.int64)
        self._first = _HEAD.size + len(index)
        self._read = zstandard.ZstdDecompressor(**_shared(dictionary))

    def _ids(self, frame) -> np.ndarray:
        return np.frombuffer(self._read.decompress(frame), f"<u{self.width}").astype("<u4")

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        self._source.seek(self._first + int(self.offsets[k]))
        return self._ids(self._source.read(int(self.offsets[k + 1] - self.offsets[k])))

    def all_ids(self, step: int = 4_000_000) -> Iterator[np.ndarray]:
        """The ids of each document in order, read in stretches of about ``step`` bytes."""
        a = 0
        while a < self.n:
            b = max(a + 1, int(np.searchsorted(self.offsets, self.offsets[a] + step, side="right")) - 1)
            self._source.seek(self._first + int(self.offsets[a]))
            part = memoryview(self._source.read(int(self.offsets[b] - self.offsets[a])))
            for k in range(a, b):
                yield self._ids(part[self.offsets[k] - self.offsets[a] : self.offsets[k + 1] - self.offsets[a]])
            a = b


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, sample_docs: int = 400, sample_bytes: int = 16_384, dictionary_size: int = 65_536, shard_bytes: int = 32_000_000, level: int = 3) -> DataFrame:
    """Writes the shards and returns the manifest (shard, file, n_docs, n_tokens, start: tokens of all earlier files)."""
    spark = docs.sparkSession
    docs = id_and_text(docs)
    picked = [r[0] for r in docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()]
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 65_536 else 4

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
        """(doc_ids, serialized ids) of some documents at a time."""
        for doc_ids, texts in by_bytes(batches, 4_000_000):
            got, before = loaded(TokenizerPieces, tokenizer_path).encode(texts, end_id)
            raw, at = got.astype(f"<u{width}").tobytes(), (before * width).tolist()
            yield doc_ids, [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids in encoded(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sampled(x, sample_bytes, width) for x in ids], pa.binary())], ["sample"])

    sample = docs.where(F.col("doc_id").isin(picked)).mapInArrow(lean("files", serialized), "sample binary").limit(sample_docs) if picked else None
    dictionary = train_dictionary([bytes(r[0]) for r in sample.collect()], dictionary_size) if sample is not None else b""
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/dictionary") as f:
        f.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=level, **_shared(dictionary)).compress
        system, path = file_system(folder)
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        held: tuple[list, list, list] = ([], [], [])
        size = 0

        def flush() -> pa.RecordBatch:
            file = f"part-{shard:06d}-{number:06d}.tokens"
            with system.open_output_stream(own := f"{path}/{file}.{uuid.uuid4().hex}.tmp") as f:
                f.write(shard_bytes_of(*held, dictionary, width))
            try:
                system.move(own, f"{path}/{file}")
            except OSError:  # where a file isn't replaced: another attempt of this task has written the same
                if not system.get_file_info(f"{path}/{file}").is_file:
                    raise
                system.delete_file(own)
            return record_batch(_MANIFEST, [[shard], [file], [len(held[0])], [sum(held[1])], [before]])

        for doc_ids, ids in encoded(batches):
            for doc_id, x in zip(doc_ids.to_pylist(), ids, strict=True):
                frame = compress(x)
                for column, value in zip(held, (_NO_ID if doc_id is None else doc_id, len(x) // width, frame), strict=True):
                    column.append(value)
                size += len(frame) + 24
                if size >= shard_bytes:
                    yield flush()
                    number, before, size = number + 1, before + sum(held[1]), 0
                    held = ([], [], [])
        if held[0]:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    manifest = cut(dealt.mapInArrow(lean("files", write), "shard int, file string, n_docs long, n_tokens long, before long"))
    starts, total = [], 0  # a number for each range
    for r in manifest.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():
        starts.append((r["shard"], total))
        total += r["n"]
    ranges = F.broadcast(spark.createDataFrame(starts, "shard int, first long"))
    return manifest.join(ranges, "shard").select("shard", "file", "n_docs", "n_tokens", (F.col("first") + F.col("before")).alias("start"))


def read_token_files(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; each task reads the files of its rows of the manifest."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        with system.open_input_stream(f"{path}/dictionary") as f:
            dictionary = f.read()
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(f"{path}/{file}") as source:
                    shard = Shard(source, dictionary)
                    crc = [zlib.crc32(x.tobytes()) for x in shard.all_ids()]
                before = start + np.cumsum(shard.n_tokens) - shard.n_tokens
                yield record_batch(_ROWS, [[None if i == _NO_ID else i for i in shard.doc_ids.tolist()], before, shard.n_tokens, crc])

    return manifest.select("file", "start").mapInArrow(lean("files", parse), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, **options) -> DataFrame:
    """Writes ``docs`` into the shared folder and returns what the files hold."""
    folder = fresh_path(docs.sparkSession, "tokens")
    return read_token_files(folder, write_token_files(docs, folder, tokenizer_path, end_id, **options))
