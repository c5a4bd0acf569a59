"""Benchmark decontamination by latent semantic retrieval.

1. Fit. Every text is cut into passages of ``span`` words, weighted by term frequency over the benchmark's words. One
   pass over all of them sums, per task and then in Spark, the number of passages with each word and the product of
   the passages' Gram matrix with a random matrix; both are of the size of the benchmark's vocabulary. From these
   follow the inverse document frequencies and, by the Nystrom form of a randomised singular value decomposition,
   the leading right singular vectors of the TF-IDF passages.
2. Search. Windows of the texts (16, 32 or 64 words, by the length of the benchmark item, at steps of 8 or 16 words)
   are projected to the latent space, scaled to equal variance; windows whose cosine with an item is at least
   ``cosine`` are candidates; windows with far less TF-IDF weight than the lightest item are passed over there. Items
   of over 48 words are searched by pieces. What the cosine passes over is found by
   the words themselves: a stretch that holds ``common`` of an item's n words also holds all but (1 - ``common``) x n
   of any of them, so of its rarest words a known number stands close together (``anchored``). That loses nothing
   that the check lets through, whatever the words beside it; so of the windows that the cosine finds only those are
   checked around which these words stand.
3. Check. The longest common subsequence of the item and the text around the window (1.5 times the item's length)
   must cover ``common`` of the item, and that with its answer (the last sentence, or the last quarter if it has just
   one) ``answer`` of the answer, which lets paraphrases through that change some words.

Words are runs of bytes other than ASCII blanks, controls and punctuation, in lower case. The benchmark is taken in
blocks of ``block_bytes`` (see ``spaces``), each with its own vocabulary. Null and empty texts and items match nothing.
The cosine given is that of the best window, or of the stretch itself where only the words led to it.
Repeated rows each get their rows. Empty tables give no rows. No text is shortened and no candidate is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, lean
from .near_dedup import word_hashes

RANK = 64
BLOCK = 8
SCALES = ((10, 2, 1), (24, 4, 1), (48, 8, 2))  # items of up to so many words: blocks in a window, blocks in a step
_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("common", pa.float64()), ("answer", pa.float64())])
_LEAKS_SQL = "doc_id long, item_id long, cosine double, common double, answer double"
_SLOTS = 20
_SLICE = 2_000_000
_LIKE = 10_000_000  # cosines at a time
_NEAR = 1024  # rows at a time that stay in the processor's cache
_ANCHORS = 1_000_000  # rare words at a time
CLOSE = 0.25  # of an item's words, how many rare ones must stand close together


def answer_start(text: str, n_words: int) -> int:
    """Index of the first word of the last sentence; of the last quarter, if that is the whole."""
    parts = re.split(r"(?<=[.!?])\s+", text.strip())
    tail = len(word_hashes(pa.array([parts[-1]]))[0]) if len(parts) > 1 else 0
    return n_words - tail if 3 <= tail < n_words else n_words - max(1, n_words // 4)


class Items:
    """Benchmark items as vocabulary numbers, and a table that finds the numbers of many hashed words at once."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.items: list[tuple[int, np.ndarray, int]] = []
        found = []
        for item_id, text in rows:
            words = word_hashes(pa.array([text or ""]))[0]
            if len(words):
                found.append((item_id, words, answer_start(text, len(words))))
        self.vocabulary = np.unique(np.concatenate([w for _, w, _ in found])) if found else np.zeros(0, np.uint64)
        self.items = [(i, np.searchsorted(self.vocabulary, w), a) for i, w, a in found]
        slots = (self.vocabulary >> np.uint64(64 - _SLOTS)).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange((1 << _SLOTS) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max()) if len(slots) else 0

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The vocabulary number of each word, or -1."""
        out = np.full(len(words), -1, dtype=np.int32)
        slot = (words >> np.uint64(64 - _SLOTS)).astype(np.int64)
        low, n = self.first[slot], self.first[slot + 1] - self.first[slot]
        for d in range(self.deepest):
            at = np.flatnonzero(n > d)
            k = low[at] + d
            hit = self.vocabulary[k] == words[at]
            out[at[hit]] = k[hit]
        return out


def random_matrix(n: int, rank: int = RANK) -> np.ndarray:
    return np.random.default_rng(17).normal(size=(n, rank))


def blocks_of(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blocks before each text and in all, first word and end of each block) of the texts cut into blocks of words."""
    each = -(-np.diff(counts) // size)
    first = np.concatenate([[0], np.cumsum(each)])
    start = np.repeat(counts[:-1] - first[:-1] * size, each) + np.arange(int(first[-1])) * size
    return first, start, np.minimum(start + size, np.repeat(counts[1:], each))


def block_sums(number: np.ndarray, start: np.ndarray, end: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each block of words the sum of their rows; the last of ``rows`` is for words without a number."""
    out = np.zeros((len(start), rows.shape[1]), dtype=np.float32)
    for a in range(0, len(start), _NEAR):
        own, s, e = out[a : a + _NEAR], start[a : a + _NEAR], end[a : a + _NEAR]
        for k in range(BLOCK):
            own += rows.take(np.where(s + k < e, number[np.minimum(s + k, len(number) - 1)], -1), axis=0)
    return out


def doubled(sums: np.ndarray, size: int, last: np.ndarray) -> np.ndarray:
    """Sums of twice as many blocks from those of ``size`` blocks from each block on, as far as its text, which ends before ``last``, goes."""
    out = sums.copy()
    out[:-size] += sums[size:]
    short = np.flatnonzero(np.arange(len(sums)) + size >= last)
    out[short] = sums[short]
    return out


def gathered(items: Items, texts: pa.Array, span: int, omega: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Of some texts: passages, passages with each word, and z (rank x words): see ``statistics``."""
    n = len(items.vocabulary)
    words, counts = word_hashes(texts)
    number = items.numbers(words)
    first, start, end = blocks_of(counts, span)
    at = np.flatnonzero(number >= 0)
    if not len(at):
        return int(first[-1]), np.zeros(n), np.zeros((RANK, n))
    passage = np.searchsorted(start, at, side="right") - 1
    cell, times = np.unique(passage * n + number[at], return_counts=True)
    passage, word = cell // n, cell % n
    norm = np.sqrt(np.bincount(passage, weights=times.astype(float) ** 2, minlength=int(first[-1])))
    inner, a, b = blocks_of(counts, BLOCK)
    sums = block_sums(number, a, b, omega)
    low = np.searchsorted(a, start)
    high = np.append(low[1:], len(a))
    y = sums[low]
    for k in range(1, -(-span // BLOCK)):
        more = np.flatnonzero(low + k < high)
        y[more] += sums[low[more] + k]
    y = np.ascontiguousarray((y / np.maximum(norm, 1)[:, None]).T)
    value = times / norm[passage]
    return int(first[-1]), np.bincount(word, minlength=n).astype(float), np.stack([np.bincount(word, weights=y[j][passage] * value, minlength=n) for j in range(RANK)])


def statistics(docs: DataFrame, items: Items, span: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Passages in all; passages with each word; (T'T) times the random matrix, for the unit term vectors T of the passages."""
    n = len(items.vocabulary)
    columns = [f"z{j}" for j in range(RANK)]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega = np.vstack([random_matrix(n), np.zeros(RANK)]).astype(np.float32)
        passages, frequency, z = 0, np.zeros(n), np.zeros((RANK, n))
        for batch in (s for b in batches for s in byte_slices(b, 0, _SLICE)):
            more = gathered(items, batch.column(0), span, omega)
            passages, frequency, z = passages + more[0], frequency + more[1], z + more[2]
        some = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([float(passages)])] + [pa.array([0.0])] * RANK, ["word", "f", *columns])
        for a in range(0, len(some), 4096):
            k = some[a : a + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(frequency[k])] + [pa.array(z[j, k]) for j in range(RANK)], ["word", "f", *columns])

    sums = docs.select("text").mapInArrow(lean("decontaminate", summed), "word int, f double, " + ", ".join(f"{c} double" for c in columns)).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("f", *columns)])
    frequency, z, passages = np.zeros(n), np.zeros((n, RANK)), 0
    for r in sums.collect():  # a row for each word of the benchmark
        if r["word"] < 0:
            passages = int(r["f"])
        else:
            frequency[r["word"]] = r["f"]
            z[r["word"]] = r[2:]
    return passages, frequency, z


class Space:
    """The latent space, and the items in it."""

    def __init__(self, items: Items, passages: int, frequency: np.ndarray, z: np.ndarray):
        n = len(items.vocabulary)
        self.items = items
        self.idf = np.log((1 + passages) / (1 + frequency)) + 0.1
        omega = random_matrix(n) / self.idf[:, None]
        g = self.idf[:, None] * z
        value, vector = np.linalg.eigh((omega.T @ g + g.T @ omega) / 2)
        keep = value > max(value.max(initial=0), 1e-12) * 1e-9
        q, sigma, _ = np.linalg.svd(g @ vector[:, keep] / np.sqrt(value[keep]), full_matrices=False)
        good = sigma > sigma.max(initial=0) * 1e-4
        self.project = (self.idf[:, None] * q[:, good] / sigma[good]).astype(np.float32) if good.any() else np.diag(self.idf).astype(np.float32)[:, :RANK]
        # a row for each word, the last one for others; its last column is the weight
        self.rows = np.vstack([np.column_stack([self.project, self.idf]), np.zeros(self.project.shape[1] + 1)]).astype(np.float32, order="C")
        # the item pieces of each scale, unit length; their items; the least weight
        self.scales = []
        self.units: list[np.ndarray] = []
        pieces: list[list] = [[] for _ in SCALES]
        for k, (_, words, _) in enumerate(items.items):
            longest = SCALES[-1][0]
            cuts = -(-len(words) // longest)
            for part in np.array_split(words, cuts):
                scale = next(s for s, (most, _, _) in enumerate(SCALES) if len(part) <= most)
                pieces[scale].append((k, self.project[part].sum(axis=0), self.idf[part].sum()))
        for (_, blocks, step), own in zip(SCALES, pieces, strict=True):
            if own:
                v = np.array([p[1] for p in own])
                self.scales.append((blocks, step, np.array([p[0] for p in own]), v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), 0.5 * min(p[2] for p in own)))
        for k in range(len(items.items)):
            v = np.array([p[1] for own in pieces for p in own if p[0] == k])
            self.units.append(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))
        self.lengths = np.array([len(w) for _, w, _ in items.items], dtype=np.int64)
        self.answers = np.array([start for *_, start in items.items], dtype=np.int64)
        # bit i of masks[item, word]: the item's i-th word is this one; no bits for words that the benchmark hasn't
        self.masks = np.zeros((len(items.items), n + 1), dtype=np.uint64)
        self.long: dict[int, dict[int, int]] = {}
        self.rare: dict[float, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, (_, words, _) in enumerate(items.items):
            if len(words) <= 64:
                np.bitwise_or.at(self.masks[k], words, np.uint64(1) << np.arange(len(words), dtype=np.uint64))
            else:
                mask = self.long[k] = {}
                for bit, w in enumerate(words.tolist()):
                    mask[w] = mask.get(w, 0) | 1 << bit

    def candidates(self, number: np.ndarray, counts: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, ...]]:
        """Arrays (text, item, first word and end of the window, cosine) of the windows of some texts that look like an item."""
        first, begin, end = blocks_of(counts, BLOCK)
        if not len(begin):
            return
        sums, size = block_sums(number, begin, end, self.rows), 1
        each = np.diff(first)
        owner = np.repeat(np.arange(len(each)), each)
        last = first[1:][owner]
        for blocks, step, of, unit, least in self.scales:
            while size < blocks:
                sums, size = doubled(sums, size, last), 2 * size
            start = np.flatnonzero(((np.arange(int(first[-1])) - first[:-1][owner]) % step == 0) & (sums[:, -1] >= least))
            unit = np.ascontiguousarray(unit.T, dtype=np.float32)
            many, few = max(256, _LIKE // len(of)), max(256, _NEAR * 256 // len(of))
            for a in range(0, len(start), many):
                found = []
                for b in range(a, min(a + many, len(start)), few):
                    v = sums[start[b : min(b + few, a + many)], :-1]
                    norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), np.float32(1e-12))
                    like = v @ unit
                    at = np.flatnonzero(like >= np.float32(cosine) * norm[:, None])
                    w, p = np.divmod(at, len(of))
                    found.append((start[b + w], p, like.ravel()[at] / norm[w]))
                s, p, like = (np.concatenate(c) for c in zip(*found, strict=True))
                t = owner[s]
                from_word = counts[t] + (s - first[t]) * BLOCK
                yield t, of[p], from_word, np.minimum(from_word + blocks * BLOCK, counts[t + 1]), like.astype(np.float64)

    def anchors(self, common: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first entry of each vocabulary number and of the end, items of the entries, least entries that a stretch must hold of each item).

        Of an item's n words a stretch must hold m = ``common`` x n. So of its n - m + t rarest it holds at least t.
        """
        if common in self.rare:
            return self.rare[common]
        least, word, item = np.zeros(len(self.lengths), dtype=np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (_, words, _) in enumerate(self.items.items):
            n = len(words)
            need = min(n, max(1, int(np.ceil(common * n - 1e-9))))
            least[k] = min(need, max(1, round(CLOSE * n)))
            rare = words[np.argsort(-self.idf[words], kind="stable")[: n - need + least[k]]]
            word.append(rare)
            item.append(np.full(len(rare), k))
        word, item = np.concatenate(word), np.concatenate(item)
        order = np.argsort(word, kind="stable")
        self.rare[common] = np.searchsorted(word[order], np.arange(len(self.items.vocabulary) + 1)), item[order], least
        return self.rare[common]

    def groups(self, number: np.ndarray, counts: np.ndarray, anchors: tuple[np.ndarray, ...]) -> Iterator[tuple[int, int]]:
        """The texts in groups (first, end) with about ``_ANCHORS`` rare words, a text at least."""
        times = np.append(np.diff(anchors[0]), 0)[number]
        before = np.concatenate([[0], np.cumsum(times)])[counts]
        a = 0
        while a < len(counts) - 1:
            b = max(a + 1, int(np.searchsorted(before, before[a] + _ANCHORS, side="right")) - 1)
            yield a, b
            a = b

    def anchored(self, number: np.ndarray, counts: np.ndarray, anchors: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """Arrays (text, item, first and end of the words), by item and first word: where enough rare words of an item stand within one and a half times its length."""
        first, of, least = anchors
        known = np.flatnonzero(number >= 0)
        each = first[number[known] + 1] - first[number[known]]
        total = int(each.sum())
        at = np.repeat(known, each)
        item = of[np.repeat(first[number[known]] - (np.cumsum(each) - each), each) + np.arange(total)]
        order = np.argsort(item.astype(np.min_scalar_type(len(least))), kind="stable")  # texts and words of an item stay in order
        at, item = at[order], item[order]
        last = np.arange(total) + least[item] - 1
        inside = np.flatnonzero(last < total)
        end = last[inside]
        good = (item[end] == item[inside]) & (at[end] - at[inside] < (self.lengths + self.lengths // 2)[item[inside]])
        inside, end = inside[good], end[good]
        text = np.searchsorted(counts, at[inside], side="right") - 1
        same = at[end] < counts[text + 1]
        inside, end, text = inside[same], end[same], text[same]
        return text, item[inside], at[inside], at[end] + 1

    def present(self, item: np.ndarray, number: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Share of the items' words that stretches of words hold at all: no subsequence in common can be longer."""
        out = np.ones(len(item))
        for a in range(0, len(item), 16_384):
            k, s, e = item[a : a + 16_384], start[a : a + 16_384], end[a : a + 16_384]
            v = np.zeros(len(k), dtype=np.uint64)
            for step in range(int((e - s).max(initial=0))):
                at = s + step
                v |= self.masks[k, np.where(at < e, number[np.minimum(at, len(number) - 1)], -1)]
            out[a : a + 16_384] = np.bitwise_count(v) / self.lengths[k]
        return np.where(self.lengths[item] > 64, 1.0, out)

    def common(self, item: np.ndarray, number: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the items, and of their answers, in the longest common subsequences with stretches of words (bits: one a word of the item)."""
        got = np.zeros(len(item), dtype=np.uint64)
        for a in range(0, len(item), 16_384):
            k, s, e = item[a : a + 16_384], start[a : a + 16_384], end[a : a + 16_384]
            v = np.full(len(k), ~np.uint64(0))
            for step in range(int((e - s).max(initial=0))):
                at = s + step
                m = self.masks[k, np.where(at < e, number[np.minimum(at, len(number) - 1)], -1)]
                u = v & m
                v = (v + u) | (v - u)
            got[a : a + 16_384] = ~v
        n, answer = self.lengths[item], self.answers[item]
        got &= ~np.uint64(0) >> (64 - np.minimum(n, 64)).astype(np.uint64)
        whole, last = np.bitwise_count(got) / n, np.bitwise_count(got >> np.minimum(answer, 63).astype(np.uint64)) / (n - answer)
        for i in np.flatnonzero(n > 64):
            mask, full = self.long[int(item[i])], (1 << int(n[i])) - 1
            w = full
            for x in number[start[i] : end[i]].tolist():
                if m := mask.get(x):
                    u = w & m
                    w = ((w + u) | (w - u)) & full
            whole[i], last[i] = (full & ~w).bit_count() / n[i], ((full & ~w) >> int(answer[i])).bit_count() / (n[i] - answer[i])
        return whole, last


def leaks_of(space: Space, texts: pa.Array, cosine: float, common: float, answer: float) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(text, item): the best (common, answer, cosine) that passes."""
    words, counts = word_hashes(texts)
    number = space.items.numbers(words)
    out: dict[tuple[int, int], tuple[float, float, float]] = {}
    for a, b in space.groups(number, counts, space.anchors(common)):
        for (text, item), got in leaks_among(space, number[counts[a] : counts[b]], counts[a : b + 1] - counts[a], cosine, common, answer).items():
            out[a + text, item] = got
    return out


def leaks_among(space: Space, number: np.ndarray, counts: np.ndarray, cosine: float, common: float, answer: float) -> dict[tuple[int, int], tuple[float, float, float]]:
    """``leaks_of`` for the vocabulary numbers of some texts' words, and the words before each text and in all."""
    out: dict[tuple[int, int], tuple[float, float, float]] = {}

    def grid(text: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, like: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, first word, end, cosine) of stretches of one and a half times the item, at steps low to high of a quarter of the item, each once."""
        n = space.lengths[item]
        step = np.maximum(1, n // 4)
        times = np.maximum(high - low, 0) + 1
        row = np.repeat(np.arange(len(text)), times)
        j = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        order = np.lexsort((-like[row], j, item[row], text[row]))
        row, j = row[order], j[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (j[1:] != j[:-1]) | (item[row[1:]] != item[row[:-1]]) | (text[row[1:]] != text[row[:-1]])
        row, j = row[new], j[new]
        start = counts[text[row]] + j * step[row]
        return text[row], item[row], start, np.minimum(start + n[row] + n[row] // 2, counts[text[row] + 1]), like[row]

    def checked(text: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray, like: np.ndarray) -> None:
        whole, last = space.common(item, number, start, end)
        for i in np.flatnonzero((whole >= common) & (last >= answer)):
            key, near = (int(text[i]), int(item[i])), float(like[i])
            if np.isnan(near):
                v = space.rows[number[start[i] : end[i]], :-1].sum(axis=0)
                near = float((space.units[key[1]] @ v).max() / max(np.linalg.norm(v), 1e-12))
            got = (float(whole[i]), float(last[i]), near)
            if key not in out or got > out[key]:
                out[key] = got

    rare = space.anchored(number, counts, space.anchors(common))
    width = len(number) + 1
    place = rare[1] * width + rare[2]

    def anchor_in(item: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether enough rare words of the items stand close together in stretches of words; what passes the check has them."""
        if not len(place):
            return np.zeros(len(item), dtype=bool)
        at = np.minimum(np.searchsorted(place, item * width + start), len(place) - 1)  # the first from the start on ends first
        return (rare[1][at] == item) & (rare[2][at] >= start) & (rare[3][at] <= end)

    for text, item, a, b, like in space.candidates(number, counts, cosine):
        n = space.lengths[item]
        step = np.maximum(1, n // 4)
        low = np.maximum(a - n // 2 - counts[text], 0) // step
        high = np.maximum(np.maximum(np.minimum(b + n // 2, counts[text + 1]) - counts[text] - n, 0) // step, low)
        some = np.flatnonzero(anchor_in(item, counts[text] + low * step, np.minimum(counts[text] + high * step + n + n // 2, counts[text + 1])))
        text, item, a, b, like, low, high = (x[some] for x in (text, item, a, b, like, low, high))
        around = space.lengths[item] // 2
        held = space.present(item, number, np.maximum(a - around, counts[text]), np.minimum(b + around, counts[text + 1])) >= common
        checked(*grid(text[held], item[held], low[held], high[held], like[held]))
    for c in range(0, len(place), 100_000):
        text, item, a, b = (x[c : c + 100_000] for x in rare)
        n = space.lengths[item]
        step = np.maximum(1, n // 4)
        # the stretches with all of the words
        low = np.maximum(-(-(b - counts[text] - n - n // 2) // step), 0)
        high = (a - counts[text]) // step
        some = low <= high
        text, item, start, end, like = grid(text[some], item[some], low[some], high[some], np.full(int(some.sum()), np.nan))
        held = space.present(item, number, start, end) >= common
        checked(text[held], item[held], start[held], end[held], like[held])
    return out


def spaces(docs: DataFrame, benchmark: DataFrame, span: int = 64, block_bytes: int = 64_000_000) -> Iterator[Space]:
    """The benchmark in blocks whose table of items by words takes about ``block_bytes``, an item at least; each broadcast is bounded by that."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).orderBy(F.col("item_id"))
    block: list = []
    vocabulary: set = set()

    def made() -> list[Space]:
        items = Items(block)
        return [Space(items, *statistics(docs, items, span))] if items.items else []

    for r in rows.toLocalIterator():
        words = set(word_hashes(pa.array([r[1]]))[0].tolist())
        if block and 8 * (len(block) + 1) * len(vocabulary | words) > block_bytes:
            yield from made()
            block, vocabulary = [], set()
        block.append((r[0], r[1]))
        vocabulary |= words
    if block:
        yield from made()


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.35, common: float = 0.6, answer: float = 0.5) -> DataFrame:
    """doc_id, item_id, cosine, common, answer of every benchmark item that a document holds."""
    parts = []
    for space in spaces(_prepared(docs), benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(space)

        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in (s for b in batches for s in byte_slices(b, 1, _SLICE)):
                got = leaks_of(shared.value, b.column(1), cosine, common, answer)
                ids = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([[ids[t] for t, _ in got], [shared.value.items.items[k][0] for _, k in got], [v[2] for v in got.values()], [v[0] for v in got.values()], [v[1] for v in got.values()]], _LEAKS, strict=True)], schema=_LEAKS)

        parts.append(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(lean("decontaminate", found), _LEAKS_SQL))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], _LEAKS_SQL)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.35, common: float = 0.6, answer: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item."""
    out = docs
    for space in spaces(_prepared(docs), benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(space)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.schema.get_field_index("text")
                for s in byte_slices(b, at, _SLICE):
                    bad = {t for t, _ in leaks_of(shared.value, s.column(at).cast(pa.string()).fill_null(""), cosine, common, answer)}
                    yield s.filter(pa.array([t not in bad for t in range(s.num_rows)], pa.bool_()))

        out = out.mapInArrow(lean("decontaminate", clean), out.schema)
    return out
