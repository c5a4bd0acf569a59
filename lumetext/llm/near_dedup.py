"""Near-duplicate classes by Order MinHash, with candidates verified by banded alignment.

Words are runs of bytes other than ASCII blanks, controls and punctuation, in lower case; k-mers are ``k`` consecutive
words, labelled by their occurrence number within the text. For each of ``samples`` orders of the labelled k-mers the
two least are taken, in the order in which the text has them, so a sample agrees for texts that share both k-mers
*and* their order. Texts of scattered edits share few k-mers, so there are further samples of fewer words for the search
only (``SEARCH``). Texts whose samples agree somewhere are candidates. A candidate is linked if its word alignment
has at most (1 - ``similarity``) x (words of the longer text) edits, by a diagonal search for few edits and a banded
table beyond. Classes are the connected components of the links; a class's id is the least doc_id in it.

Equal word sequences are one text from the start, told apart by 128 bits of hash; each has a number of its own, whatever
the doc_ids of its rows. Within a bucket each text is first aligned with the bucket's leader (the text of least
number), so a bucket of n near copies gives n - 1 pairs and copies are never expanded into all pairs. Where that leaves a member unconnected, the members of the leader's buckets are compared
with each other as far as they are not connected: those that aren't alike to the leader among themselves, and with those
that are unless they stand too far from the leader for that (edit distance is a metric). These comparisons go by length
by counts of hashed words, parities of hashed word pairs and the distances from the leader, which rule out only texts
that can't be alike; what is left and shares a bucket is aligned. So no
two texts that share a bucket and are alike are left in different classes; the README has the share of alike texts that
share a bucket. Pairs of a leader with many members are dealt over several keys, and members that are compared with each
other over classes of length and, beyond ``block`` of them, over parts that meet two by two.

Texts of fewer than ``k`` words have one k-mer, the whole. Texts without words are alike only if they are equal. Null
text counts as empty. Rows without doc_id belong to the class of their text but give no class its id; a class of none
but these has the id null. Repeated rows each get a row. Rows of one doc_id with different texts are taken by their texts. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, cut, id_and_text, lean, partitions, record_batch
from .words import ALPHANUMERIC_GAPS, hashes, mix, spans, text_buffer, windows

BASE = np.uint64(0xA0761D6478BD642F)
FEW = 8
#: An edit distance that isn't known.
UNKNOWN = 1 << 60
#: Leaders whose distances tell members apart.
PIVOTS = 16
#: Words in a k-mer, fewest and most words of the texts, samples: what else texts are searched by. Ranges overlap by
#: more than the lengths of texts that are alike can differ, for a ``similarity`` of 0.72 or more.
SEARCH = ((1, 1, 24, 24), (2, 16, 100, 40), (3, 72, 1 << 62, 40))
_STEP = 1 << 20
_BLOCK_WORDS = 3e7  # of long texts, blocks are of so many words
_SKETCH = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("buckets", pa.list_(pa.int64()))])
_SKETCH_SQL = "doc_id long, row_key long, h1 long, h2 long, buckets array<long>"
_MAX = np.uint64(2**64 - 1)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words before each text and in all)."""
    data, offsets = text_buffer(pc.utf8_lower(texts))
    starts, ends, counts = spans(data, offsets, ALPHANUMERIC_GAPS)
    return hashes(data, starts, ends), counts


def labelled(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(occurrence-labelled k-mers in text order, number of them before each text and in all)."""
    grams, first = windows(words, counts, k, BASE)
    short = np.flatnonzero((np.diff(counts) > 0) & (np.diff(counts) < k))
    if len(short):
        whole = np.array([int.from_bytes(hashlib.blake2b(words[counts[i] : counts[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in short], dtype=np.uint64)
        at = np.searchsorted(first, counts[short])
        grams, first = np.insert(grams, at, whole), np.insert(first, at, counts[short])
    bounds = np.searchsorted(first, counts)
    text = np.repeat(np.arange(len(counts) - 1), np.diff(bounds))
    order = np.lexsort((grams, text))
    same = np.zeros(len(grams), dtype=bool)
    same[1:] = (grams[order][1:] == grams[order][:-1]) & (text[order][1:] == text[order][:-1])
    run = np.arange(len(grams))
    occurrence = np.empty(len(grams), dtype=np.uint64)
    occurrence[order] = run - np.maximum.accumulate(np.where(same, 0, run))
    return mix(grams + occurrence * np.uint64(0x9E3779B97F4A7C15)), bounds


def order_min_hash(grams: np.ndarray, bounds: np.ndarray, samples: int) -> np.ndarray:
    """Samples x texts; texts without k-mers are left out."""
    starts, sizes = bounds[:-1][np.diff(bounds) > 0], np.diff(bounds)[np.diff(bounds) > 0]
    out = np.zeros((samples, len(starts)), dtype=np.uint64)
    if not len(starts):
        return out
    seeds = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    for j, seed in enumerate(seeds):
        value = grams * seed
        value ^= value >> np.uint64(32)
        least = np.minimum.reduceat(value, starts)
        one = np.flatnonzero(value == np.repeat(least, sizes))
        one = one[np.searchsorted(one, starts)]
        value[one] = _MAX
        second = np.minimum.reduceat(value, starts)
        two = np.flatnonzero(value == np.repeat(second, sizes))
        two = two[np.searchsorted(two, starts)]
        first, last = np.minimum(one, two), np.maximum(one, two)
        out[j] = mix(mix(grams[first]) * np.uint64(3) + grams[last] + seed)
    return out


def few_edits(a: list, b: list, most: int) -> int | None:
    """The edit distance if it is at most ``most``, by the furthest point of each diagonal after 0, 1, ... edits."""
    n, m = len(a), len(b)
    far = {0: 0}
    for edits in range(most + 1):
        for k in far:
            x = far[k]
            while x < n and x + k < m and a[x] == b[x + k]:
                x += 1
            far[k] = x
        if far.get(m - n, -1) >= n:
            return edits
        new: dict[int, int] = {}
        for k, x in far.items():
            for d, y in ((k, x + 1), (k - 1, x + 1), (k + 1, x)):
                if y <= n and -n <= d <= m and y + d <= m and new.get(d, -1) < y:
                    new[d] = y
        far = new
    return None


def banded(a: list, b: list, most: int) -> int | None:
    """The same by the table's cells within ``most`` of its diagonal, a column of them in the bits of two numbers.

    Bit t of column j stands for row j - most + t: ``up`` and ``down`` say where a cell is one more or one less than
    the one above. Rows before the first lie above the table and rise away from it; what is outside the band counts as one more.
    """
    n, m = len(a), len(b)
    full = (1 << 2 * most + 1) - 1
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    down = (1 << most + 1) - 1
    up = full ^ down
    corner, most_there = 0, most + abs(n - m)
    for j in range(1, m + 1):
        up, down = up >> 1 | 1 << 2 * most, down >> 1
        same = at.get(b[j - 1], 0)
        same = (same >> j - most - 1 if j > most else same << most + 1 - j) & full
        level = (((same & up) + up) ^ up | same | down) & full
        right, left = down | full & ~(level | up), level & up
        corner += not level >> most & 1
        if corner > most_there:
            return None
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | full & ~(level | right), right & level
    if abs(n - m) > most:
        return None
    low, high = sorted((m, n))
    between = ((1 << high - low) - 1) << (low - m + most + 1)
    step = (up & between).bit_count() - (down & between).bit_count()
    edits = corner + (step if n > m else -step)
    return edits if edits <= most else None


def threshold(words: int, similarity: float) -> int:
    """Edits that alike texts may be apart, the longer having so many words."""
    return int((1 - similarity) * words + 1e-9)


def distance(a: np.ndarray, b: np.ndarray, similarity: float, further: bool = False) -> tuple[int, int]:
    """Bounds of the edit distance of two word sequences, equal ones if the two are alike.

    ``further``: also if any text can be alike to both; such a one has at most (words of the shorter) / similarity words.
    """
    short, long = sorted((len(a), len(b)))
    most = threshold(long, similarity)
    if further:
        between = short / similarity
        most = max(most, int((1 - similarity) * (between + max(long, between)) + 1e-6))
    x, i = np.unique(a, return_counts=True)
    y, k = np.unique(b, return_counts=True)
    _, p, q = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = long - int(np.minimum(i[p], k[q]).sum())
    if least > most:
        return least, UNKNOWN
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    edits = few_edits(a, b, min(most, FEW))
    if edits is None and most > FEW:
        edits = banded(a, b, most)
    return (most + 1, UNKNOWN) if edits is None else (edits, edits)


def bucket_lists(words: np.ndarray, counts: np.ndarray, k: int, samples: int) -> pa.ListArray:
    """The buckets of each text: by k-mers of ``k`` words, and by those of ``SEARCH`` for texts of its lengths."""
    n = np.diff(counts)
    owners, found = [], []
    for size, fewest, most, times in ((k, 1, 1 << 62, samples), *SEARCH):
        own = np.flatnonzero((n >= fewest) & (n <= most))
        inside = np.repeat((n >= fewest) & (n <= most), n)
        grams, bounds = labelled(words[inside], np.concatenate([[0], np.cumsum(n[own])]), size)
        got = order_min_hash(mix(grams + np.uint64(size)), bounds, times).T
        owners.append(np.repeat(own, times))
        found.append(np.ascontiguousarray(got).reshape(-1).view(np.int64))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    ends = np.searchsorted(owner[order], np.arange(len(n) + 1))
    return pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(np.concatenate(found)[order]))


def sketches(docs: DataFrame, k: int, samples: int) -> DataFrame:
    """doc_id, row_key (hash of doc_id and text), h1, h2 (hash of the word sequence) and the buckets of every row."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1, 2 * _STEP):
                words, counts = word_hashes(part.column(1))
                digests = np.zeros((part.num_rows, 2), dtype=np.int64)
                texts = part.column(1)
                for i in range(part.num_rows):
                    own = words[counts[i] : counts[i + 1]].tobytes() or b"\0" + texts[i].as_py().encode()
                    digests[i] = np.frombuffer(hashlib.blake2b(own, digest_size=16).digest(), "<i8")
                lists = bucket_lists(words, counts, k, samples)
                yield record_batch(_SKETCH, [part.column(0), part.column(2), digests[:, 0], digests[:, 1], lists])

    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key")).mapInArrow(lean("near", sketched), _SKETCH_SQL)


def components(edges: DataFrame) -> DataFrame:
    """(id, label): for each end of ``edges`` (a, b) one of the ids of its connected component, the same for all of them.

    Each end goes to the least of itself and its neighbours, which are ordered by their ids and by another hash in turns;
    edges follow their ends, and those within one id go. Stars around their least id go in the first round, and of
    chains, however their ids run, a constant share in each round of hashes.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    steps = []
    while not steps or not edges.isEmpty():
        ends = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, turn=len(steps): F.struct((F.xxhash64(c, F.lit(turn)) if turn % 2 else F.col(c)).alias("h"), F.col(c).alias("id"))
        to = ends.groupBy("a").agg(F.min(rank("b")).alias("near")).select(F.col("a").alias("id"), F.least("near", rank("a"))["id"].alias("label"))
        steps.append(to := cut(to))
        moved = edges.join(to.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(to.select(F.col("id").alias("b"), F.col("label").alias("y")), "b")
        edges = cut(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    labels = steps.pop()
    while steps:
        labels = cut(steps.pop().join(labels.select(F.col("id").alias("label"), F.col("label").alias("further")), "label", "left").select("id", F.coalesce("further", "label").alias("label")))
    return labels


def representatives(rows: DataFrame) -> DataFrame:
    """rep (a number), h1, h2, doc_id, row_key and buckets of each distinct word sequence of ``rows`` (see ``sketches``)."""
    texts = rows.groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("least"), F.first("buckets").alias("buckets"))
    return cut(texts.select(F.monotonically_increasing_id().alias("rep"), "h1", "h2", "least.doc_id", "least.row_key", "buckets"))


def texts_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep and z, the compressed text, of each of ``reps`` (rep, doc_id, row_key)."""

    def shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = zstandard.ZstdCompressor(level=1)
        for b in (part for batch in batches for part in byte_slices(batch, 2, 4 * _STEP)):
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([write.compress(x.as_buffer()) for x in b.column(2).cast(pa.large_binary())], pa.binary())], ["row_key", "id", "z"])

    own = F.coalesce("doc_id", F.lit(0).cast("long")).alias("id")
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), own, "text").mapInArrow(lean("near", shrunk), "row_key long, id long, z binary")
    return cut(texts.join(reps.select("rep", "row_key", own), ["row_key", "id"]).groupBy("rep").agg(F.max("z").alias("z")))


def verified_pairs(texts: DataFrame, pairs: DataFrame, similarity: float, spread: int, further: bool) -> DataFrame:
    """leader, member, low, high (see ``distance``) and alike of each of the pairs (leader, member)."""
    sizes = cut(pairs.groupBy("leader").agg(F.ceil(F.count("*") / spread).cast("int").alias("shares")))
    members = pairs.join(sizes, "leader").select("leader", F.pmod(F.xxhash64("member"), F.col("shares")).cast("int").alias("share"), "member").join(texts.withColumnRenamed("rep", "member"), "member")
    heads = sizes.join(texts.select(F.col("rep").alias("leader"), F.col("z").alias("head")), "leader").select("leader", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "head")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = zstandard.ZstdDecompressor()
        for batch in batches:
            leader, member, head, z = (c.to_pylist() for c in batch.columns)
            sizes = np.array([zstandard.frame_content_size(x) for x in z], dtype=np.int64)
            order = np.argsort(leader, kind="stable")
            # as many as hold about four steps of text, and one at least
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes[order]) // (4 * _STEP))) + 1
            bounds, alike = np.zeros((2, batch.num_rows), dtype=np.int64), np.zeros(batch.num_rows, dtype=bool)
            for own in np.split(order, cuts) if len(order) else []:
                firsts = dict(zip((leader[i] for i in own), (head[i] for i in own), strict=True))
                texts = [read.decompress(x).decode() for x in (*firsts.values(), *(z[i] for i in own))]
                words, counts = word_hashes(pa.array(texts, pa.large_string()))
                place = {i: k for k, i in enumerate(firsts)}
                for k, i in enumerate(own, len(firsts)):
                    x = place[leader[i]]
                    a, b = words[counts[x] : counts[x + 1]], words[counts[k] : counts[k + 1]]
                    bounds[:, i] = distance(a, b, similarity, further)
                    alike[i] = bounds[1, i] <= threshold(max(len(a), len(b)), similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bounds[0]), pa.array(bounds[1]), pa.array(alike)], ["leader", "member", "low", "high", "alike"])

    return cut(members.join(heads, ["leader", "share"]).select("leader", "member", "head", "z").mapInArrow(lean("near", verified), "leader long, member long, low long, high long, alike boolean"))


def signature(words: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """For each text, how many of its words fall to each of 2 ** m bins (255 at most; a bin for two words), and whether an odd number of its word pairs does to each of 2 ** m bits (two a word)."""
    bins, bits = [], []
    pairs, first = windows(words, counts, 2, BASE)
    bounds = np.searchsorted(first, counts)
    for i, n in enumerate(np.diff(counts).tolist()):
        size = max(64, 1 << (2 * n - 1).bit_length())
        own, couples = words[counts[i] : counts[i + 1]], pairs[bounds[i] : bounds[i + 1]]
        bins.append(np.minimum(np.bincount((own & np.uint64(size // 4 - 1)).astype(np.int64), minlength=size // 4), 255).astype(np.uint8).tobytes())
        bits.append(np.packbits(np.bincount((couples & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes())
    return bins, bits


def signatures(texts: DataFrame) -> DataFrame:
    """rep, words (their number), bins and bits (see ``signature``) of texts."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in byte_slices(batch, 1, _STEP):
                words, counts = word_hashes(pa.array([read.decompress(x) for x in part.column(1).to_pylist()], pa.large_binary()).cast(pa.large_string()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(counts)), *(pa.array(x, pa.binary()) for x in signature(words, counts))], ["rep", "words", "bins", "bits"])

    return texts.select("rep", "z").mapInArrow(lean("near", signed), "rep long, words long, bins binary, bits binary")


def folded(rows: list[bytes], how: np.ufunc, kind: type) -> np.ndarray:
    """Signatures as rows of one width, the least of theirs: a place of fewer stands for several of more."""
    size = min(map(len, rows))
    return np.stack([how.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0, dtype=kind) for x in rows])


class Members:
    """Some members of connected leaders: arrays, and signatures of one width, in the order of their words."""

    def __init__(self, batch: pa.RecordBatch):
        batch = batch.sort_by("words")
        self.rep, self.part, self.home, self.component, self.words = (np.asarray(batch.column(c)) for c in ("rep", "part", "home", "component", "words"))
        # bounds of the distances from the leaders that most of the members have
        leaders = batch.column("leader")
        found, times = np.unique(np.asarray(leaders.flatten()), return_counts=True)
        pivots = np.sort(found[np.argsort(-times, kind="stable")[:PIVOTS]])
        row, of = np.repeat(np.arange(len(self.rep)), pc.list_value_length(leaders)), np.searchsorted(pivots, np.asarray(leaders.flatten()))
        of[of == len(pivots)] = 0
        some = np.flatnonzero(pivots[of] == np.asarray(leaders.flatten())) if len(pivots) else np.zeros(0, np.int64)
        self.low, self.high = np.zeros((len(self.rep), len(pivots)), dtype=np.int64), np.full((len(self.rep), len(pivots)), UNKNOWN)
        for name, into in (("low", self.low), ("high", self.high)):
            into[row[some], of[some]] = np.asarray(batch.column(name).flatten())[some]
        self.bins = folded(batch.column("bins").to_pylist(), np.add, np.int16)
        self.bits = folded(batch.column("bits").to_pylist(), np.bitwise_xor, np.uint8).view(np.uint64)
        self.buckets = [frozenset(x) for x in batch.column("buckets").to_pylist()]

    def pairs(self, similarity: float) -> list[tuple[int, int]]:
        """Those of different components that share a bucket and may be alike; between the two parts only, if there are two.

        An edit changes the counts of two words and of four word pairs at most (two go, two come) and the length by one, so
        e edits leave (differences of the bins + difference of the lengths) / 2 <= e; and their distances from
        any leader differ by e at most. Two members that are both not at home meet elsewhere.
        """
        out = []
        two = len(np.unique(self.part)) > 1
        most = np.array([threshold(n, similarity) for n in self.words.tolist()])
        for j in range(1, len(self.rep)):
            start = int(np.searchsorted(self.words[:j], self.words[j] - most[j]))
            i = start + np.flatnonzero((self.component[start:j] != self.component[j]) & (self.home[start:j] | self.home[j]) & ((self.part[start:j] != self.part[j]) | (not two)))
            i = i[((self.low[i] - self.high[j] <= most[j]) & (self.low[j] - self.high[i] <= most[j])).all(axis=1)]
            if len(i):
                i = i[np.abs(self.bins[i] - self.bins[j]).sum(axis=1) + self.words[j] - self.words[i] <= 2 * most[j]]
            if len(i):
                i = i[np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(axis=1, dtype=np.int64) <= 4 * most[j]]
            out += [(int(self.rep[x]), int(self.rep[j])) for x in i.tolist() if not self.buckets[j].isdisjoint(self.buckets[x])]
        return out


def rest(texts: DataFrame, members: DataFrame, states: DataFrame, labels: DataFrame, similarity: float, block: int) -> DataFrame:
    """(leader, member): the pairs that share a bucket, aren't connected yet, weren't compared, and may be alike.

    They meet with all members of the leaders that are connected with theirs, so that each pair is looked at once.

    members: leader, rep, buckets (those of the leader that rep shares); states: from ``verified_pairs``; labels: from
    ``components``. Members are dealt
    over classes of length, each of which the next shorter one visits, and parts of about ``block`` (fewer if texts are
    long); each two parts of a class meet under a key.
    """
    n = partitions(texts.sparkSession)
    of = lambda name: labels.select(F.col("id").alias(name), F.col("label").alias(f"{name}_label"))
    both = states.select("leader", F.col("member").alias("rep"), "low", "high", "alike").union(states.select(F.col("member").alias("leader"), F.col("leader").alias("rep"), "low", "high", "alike"))
    placed = members.join(both, ["leader", "rep"]).join(of("leader"), "leader", "left").join(of("rep"), "rep", "left")
    placed = cut(placed.select("leader", "rep", "buckets", "low", "high", "alike", F.coalesce("leader_label", "leader").alias("group"), F.coalesce("rep_label", "rep").alias("component")).withColumn("apart", F.col("group") != F.col("component")))
    # members alike to a leader are of use only where one that isn't connected with it stands within reach of it
    open_ = cut(placed.groupBy("group").agg(F.max("apart").alias("some"), F.max(F.col("apart") & (F.col("high") < UNKNOWN)).alias("near")).where("some"))
    own = placed.join(open_, "group").where("near or not alike").groupBy("group", "rep").agg(F.first("component").alias("component"), F.flatten(F.collect_list("buckets")).alias("buckets"), F.collect_list(F.struct("leader", "low", "high")).alias("to"))
    own = cut(own.select("group", "rep", "component", "buckets", *[F.col(f"to.{c}").alias(c) for c in ("leader", "low", "high")]))
    signed = cut(signatures(texts.join(own.select("rep").distinct(), "rep", "left_semi")))
    grade = F.floor(F.log(F.greatest("words", F.lit(1))) / np.log(1 / similarity) * 0.999999).cast("int") if similarity < 1 else F.col("words").cast("int")
    graded = cut(own.join(signed.select("rep", grade.alias("grade")), "rep").select("group", "rep", "buckets", "leader", "low", "high", "component", F.col("grade").alias("own"), F.explode(F.array(F.col("grade"), F.col("grade") + 1)).alias("grade")))
    sizes = graded.groupBy("group", "grade").agg(F.count("*").alias("n"), F.max(F.col("own") == F.col("grade")).alias("some")).where("n > 1 and some")
    words = F.pow(F.lit(1 / similarity), F.col("grade") + 1)  # at most, in texts of the grade
    sizes = sizes.select("group", "grade", F.ceil(F.col("n") / F.greatest(F.lit(min(block, 64)), F.least(F.lit(block), _BLOCK_WORDS / words))).cast("int").alias("parts"))
    dealt = graded.join(sizes, ["group", "grade"]).withColumn("part", F.pmod(F.xxhash64("rep", "group"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(F.xxhash64("group", "grade", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "rep", "part", (F.col("own") == F.col("grade")).alias("home"), "leader", "low", "high", "component", "buckets")
    dealt = dealt.join(signed, "rep").select("key", "rep", "part", "home", "component", "leader", "low", "high", "words", "bins", "bits", "buckets").repartition(n, "key").sortWithinPartitions("key", "part")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs_of(batch: pa.RecordBatch) -> pa.RecordBatch:
            key = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            got = {(min(x), max(x)) for s, e in zip(cuts, cuts[1:], strict=False) if e - s > 1 for x in Members(batch.slice(s, e - s)).pairs(similarity)}
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in range(2)], ["leader", "member"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield pairs_of(pa.concat_batches([*held, batch.slice(0, last)]))
                held = []
            elif held and held[0].column(0)[0].as_py() != key[0]:
                yield pairs_of(pa.concat_batches(held))
                held = []
            held.append(batch.slice(last))
        if held:
            yield pairs_of(pa.concat_batches(held))

    more = dealt.mapInArrow(lean("near", met), "leader long, member long").distinct()
    seen = states.select(F.least("leader", "member").alias("leader"), F.greatest("leader", "member").alias("member"))
    return cut(more.join(seen, ["leader", "member"], "left_anti"))


def connected(docs: DataFrame, reps: DataFrame, similarity: float, spread: int = 32, block: int = 2048) -> DataFrame:
    """(id, label) of the representatives that are connected with others (see ``components``): all that share a bucket and are alike have one label."""
    rows = reps.select("rep", F.explode("buckets").alias("bucket"))
    leaders = cut(rows.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n"))
    members = cut(rows.join(leaders, "bucket").where("rep <> leader").groupBy("leader", "rep").agg(F.collect_list("bucket").alias("buckets")))
    pairs = members.groupBy(F.least("rep", "leader").alias("x"), F.greatest("rep", "leader").alias("y")).agg(F.min(F.struct("leader", F.col("rep").alias("member"))).alias("p"))
    pairs = cut(pairs.select("p.leader", "p.member"))
    some = pairs.select(F.col("leader").alias("rep")).union(pairs.select(F.col("member").alias("rep"))).distinct()
    texts = texts_of(docs, reps.select("rep", "doc_id", "row_key").join(some, "rep", "left_semi"))
    states = verified_pairs(texts, pairs, similarity, spread, True)
    labels = components(states.where("alike").select(F.col("leader").alias("a"), F.col("member").alias("b")))
    more = rest(texts, members, states, labels, similarity, block)
    if more.isEmpty():
        return labels
    found = verified_pairs(texts, more, similarity, spread, False).where("alike")
    of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    found = found.join(of("leader"), "leader", "left").join(of("member"), "member", "left")
    joined = components(found.select(F.coalesce("leader_label", "leader").alias("a"), F.coalesce("member_label", "member").alias("b")))
    old = labels.join(joined.select(F.col("id").alias("label"), F.col("label").alias("further")), "label", "left").select("id", F.coalesce("further", "label").alias("label"))
    return cut(old.union(joined.join(labels.select("id"), "id", "left_anti")))


def _classed(docs: DataFrame, k: int, samples: int, similarity: float) -> DataFrame:
    """doc_id, row_key, label (a number of the class) and class_id of every row of ``docs``."""
    rows = cut(sketches(docs, k, samples))
    reps = representatives(rows)
    labels = connected(docs, reps, similarity)
    named = reps.select("rep", "h1", "h2", "doc_id").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", "doc_id", F.coalesce("label", "rep").alias("label"))
    ids = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = named.drop("doc_id").join(ids, "label")
    return rows.select("doc_id", "row_key", "h1", "h2").join(named, ["h1", "h2"]).select("doc_id", "row_key", "label", "class_id")


def classes(docs: DataFrame, k: int = 5, samples: int = 24, similarity: float = 0.8) -> DataFrame:
    """doc_id and class_id of every row of ``docs``."""
    return _classed(id_and_text(docs), k, samples, similarity).select("doc_id", "class_id")


def keep_one(docs: DataFrame, k: int = 5, samples: int = 24, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one of each class does: the one of least doc_id."""
    classed = cut(_classed(id_and_text(docs), k, samples, similarity).select("doc_id", "row_key", "label"))
    first = cut(classed.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("least")).select(F.col("least.row_key").alias("row_key")))
    repeated = classed.groupBy("row_key").count().where("count > 1").join(first, "row_key", "left_semi")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = f"row_key_{uuid.uuid4().hex}"  # no column of the documents
    kept = docs.join(first.select(F.col("row_key").alias(own)), key == F.col(own), "left_semi")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
