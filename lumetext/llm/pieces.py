"""Encoding with public tokenizer files, piece by piece.

A text is cut where the tokenizer can never join the two sides, so the ids of the text are those of its pieces
one after another. ``TokenizerPieces`` works on the bytes of many texts at once, in numpy: texts fall into zones at
single spaces between two plain characters, and the plain zones into units, which are the pattern's own pieces (runs of
letters, digits or other characters, with the space before them if the tokenizer keeps spaces). Units of at most 15
bytes are found in a table by their very bytes, so no two of them can be mistaken for each other. New units go to the library
together, and so do zones that hold anything else: longer units, apostrophes, special strings, and characters beyond
ASCII and the Latin letters of U+00C0 to U+017F. What a worker remembers is bounded by number (``limit`` units) and by
bytes (``_KNOWN_BYTES`` of zones or pieces); when full it is emptied. Empty texts have no ids.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from .common import KEPT
from .words import mix, text_buffer

_SAFE_PIECE_SPACE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")
_BATCH = 20_000
_SPAN = 1 << 20
_UNIT = 15
_KNOWN_BYTES = 16_000_000
_SPACE, _LETTER, _DIGIT, _OTHER, _BLANK, _ODD = range(6)
_CLASS = np.full(256, _ODD, dtype=np.uint8)
for _b in range(0x21, 0x7F):
    _CLASS[_b] = _LETTER if chr(_b).isalpha() else _DIGIT if chr(_b).isdigit() else _OTHER
_CLASS[[0x20]], _CLASS[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]], _CLASS[0x27] = _SPACE, _BLANK, _ODD
_PLAIN = np.array([c in (_LETTER, _DIGIT, _OTHER) for c in range(6)])
_KIND = np.array([0, 1, 2, 3, 0, 5], dtype=np.uint8)  # spaces and other blanks are of a kind
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches flat[start : start + size], one after another."""
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


class _Table:
    """Ids by the 16 bytes that stand for a unit, by open addressing."""

    def __init__(self, limit: int, kind: type):
        self.limit, self.kind = limit, kind
        self.bits = max(4, (2 * limit - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.size, self.used = 0, 0
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        # the last entry stands for none: no unit has length 0
        self.low, self.high = np.zeros(1025, dtype=np.uint64), np.zeros(1025, dtype=np.uint64)
        self.start, self.length = np.zeros(1025, dtype=np.int32), np.zeros(1025, dtype=np.int32)
        self.ids = np.zeros(4096, dtype=self.kind)

    def find(self, low: np.ndarray, high: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        """The entry of each unit, or -1."""
        slot = (hashed >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.slots[slot]
        wrong = np.flatnonzero((out >= 0) & ((self.low[out] != low) | (self.high[out] != high)))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            entry = self.slots[slot[wrong]]
            out[wrong] = entry
            wrong = wrong[(entry >= 0) & ((self.low[entry] != low[wrong]) | (self.high[entry] != high[wrong]))]
        return out

    def _room(self, name: str, size: int) -> None:
        have = getattr(self, name)
        if size >= len(have):
            more = np.zeros(max(2 * len(have), size + 1), dtype=have.dtype)
            more[: len(have)] = have
            setattr(self, name, more)

    def add(self, low: np.ndarray, high: np.ndarray, hashed: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New units, each different from all others."""
        a, b = self.size, self.size + len(low)
        for name in ("low", "high", "start", "length"):
            self._room(name, b + 1)
        self._room("ids", self.used + len(ids))
        self.low[a:b], self.high[a:b], self.length[a:b] = low, high, sizes
        self.start[a:b] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.size, self.used = b, self.used + len(ids)
        slot, entry = (hashed >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(a, b, dtype=np.int32)
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]
            left = self.slots[slot] != entry
            slot, entry = (slot[left] + 1) & ((1 << self.bits) - 1), entry[left]


class TokenizerPieces:
    """Ids of whole texts by a ``tokenizers`` file: byte-level BPE that keeps spaces, or BPE with word ends that drops blanks."""

    def __init__(self, path: str, limit: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.keeps_space = self._ids([" a"]) != self._ids(["a"])
        self.gap = "\n" if self.keeps_space else "0"
        self.gap_id = self._ids([self.gap])[0][0]
        self.starts = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for k, i in vocabulary.items():
            self.starts[i] = k.startswith("Ġ")
        self.table = _Table(limit, np.uint16 if len(self.starts) <= 1 << 16 else np.uint32)
        self.zones: dict[bytes, np.ndarray] = {}
        self.zone_bytes = 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, number of ids of each), one text at a time."""
        got = [np.array(x, dtype=np.uint32) for a in range(0, len(texts), _BATCH) for x in self._ids([t.decode() for t in texts[a : a + _BATCH]])]
        return np.concatenate([np.zeros(0, np.uint32), *got]), np.array([len(x) for x in got], dtype=np.int64)

    def _together(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """The same for units of a kind: with a space before each, or with a gap between each two."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a in range(0, len(starts), _BATCH):
            s, n = starts[a : a + _BATCH], sizes[a : a + _BATCH]
            if spaced:
                text = gathered(data, s, n)
            else:
                text = np.full(int(n.sum()) + len(n), ord(self.gap), dtype=np.uint8)
                own = np.ones(len(text), dtype=bool)
                own[np.cumsum(n + 1) - n - 1] = False
                text[own] = gathered(data, s, n)
            got = np.array(self._ids([text.tobytes().decode()])[0], dtype=np.uint32)
            first = np.flatnonzero(self.starts[got] if spaced else got == self.gap_id)
            if len(first) == len(s) and (not len(first) or first[0] == 0):
                many = np.diff(first, append=len(got))
                if not spaced:
                    got, many = np.delete(got, first), many - 1
            else:
                got, many = self._each([data[x : x + k].tobytes() for x, k in zip(s.tolist(), n.tolist(), strict=True)])
            ids.append(got)
            counts.append(many)
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, hashed: np.ndarray) -> None:
        first, last = data[starts], _CLASS[data[starts + sizes - 1]]
        blank = (last == _SPACE) | (last == _BLANK)
        spaced = (first == 0x20) & ~blank
        alone = blank if self.keeps_space else (sizes == 1) & (first == ord("0"))
        for some, how in ((spaced, True), (~spaced & ~alone, False), (alone, None)):
            k = np.flatnonzero(some)
            if len(k):
                ids, counts = self._each([data[a : a + n].tobytes() for a, n in zip(starts[k].tolist(), sizes[k].tolist(), strict=True)]) if how is None else self._together(data, starts[k], sizes[k], how)
                self.table.add(low[k], high[k], hashed[k], ids, counts)

    def _units(self, d: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first bytes of the units, their sizes, first bytes of the odd zones, their sizes) of some texts, which start at ``edges``."""
        kind = _CLASS[d]
        high = np.flatnonzero(d >= 0x80)
        if len(high):
            lead = high[(d[high] >= 0xC3) & (d[high] <= 0xC5)]
            a, b = d[lead], d[lead + 1]
            lead = lead[~((a == 0xC3) & ((b == 0x97) | (b == 0xB7)) | (a == 0xC4) & (b == 0xB0))]  # the two signs among the letters; a letter of two in lower case
            kind[lead] = kind[lead + 1] = _LETTER
        kind[:-1][(d[:-1] == ord("<")) & (d[1:] == ord("|"))] = _ODD
        first = np.zeros(len(d), dtype=bool)
        first[edges] = True
        plain = _PLAIN[kind]
        cut = d == 0x20
        cut[1:] &= plain[:-1]
        cut[:-1] &= plain[1:] & ~first[1:]
        cut[[0, -1]] = False
        cut |= first
        zones = np.flatnonzero(cut)
        flags = first.copy()
        same = _KIND[kind]
        flags[1:] |= same[1:] != same[:-1]
        if self.keeps_space:
            after = 1 + np.flatnonzero(flags[1:] & ~first[1:] & (same[:-1] == 0) & (same[1:] != 0))
            flags[after[d[after - 1] == 0x20]] = False
            flags[after - 1] = True
        else:
            flags |= kind == _DIGIT
        starts = np.flatnonzero(flags)
        sizes = np.diff(starts, append=len(d))
        if not self.keeps_space:
            solid = same[starts] != 0
            starts, sizes = starts[solid], sizes[solid]
        odd = np.concatenate([np.flatnonzero(kind == _ODD), starts[sizes > _UNIT]])
        if not len(odd):
            return starts, sizes, odd, odd
        bad = np.zeros(len(zones), dtype=bool)
        bad[np.searchsorted(zones, odd, side="right") - 1] = True
        ends = np.append(zones[1:], len(d))
        keep = ~bad[np.searchsorted(zones, starts, side="right") - 1]
        return starts[keep], sizes[keep], zones[bad], (ends - zones)[bad]

    def _span(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte of each piece, its number of ids, the ids)."""
        starts, sizes, odd, odd_sizes = self._units(data, edges)
        padded = np.zeros((len(data) + 39) // 8 * 8, dtype=np.uint8)
        padded[: len(data)] = data
        q, at, shift = padded.view("<u8"), starts >> 3, ((starts & 7) << 3).astype(np.uint64)
        middle = q[at + 1]
        back = np.uint64(63) - shift
        low = (q[at] >> shift | middle << np.uint64(1) << back) & _MASK[np.minimum(sizes, 8)]
        high = (middle >> shift | q[at + 2] << np.uint64(1) << back) & _MASK[np.maximum(sizes - 8, 0)] | sizes.astype(np.uint64) << np.uint64(56)
        hashed = mix(low ^ high * _MULTIPLIER)
        if self.table.size > self.table.limit:
            self.table.clear()
        entry = self.table.find(low, high, hashed)
        while len(missing := np.flatnonzero(entry < 0)):
            k = missing[np.unique(hashed[missing], return_index=True)[1]]
            self._learn(data, starts[k], sizes[k], low[k], high[k], hashed[k])
            entry[missing] = self.table.find(low[missing], high[missing], hashed[missing])
        counts = self.table.length[entry].astype(np.int64)
        ids = gathered(self.table.ids, self.table.start[entry].astype(np.int64), counts).astype(np.uint32)
        if not len(odd):
            return starts, counts, ids
        own = [data[a : a + n].tobytes() for a, n in zip(odd.tolist(), odd_sizes.tolist(), strict=True)]
        new = list(dict.fromkeys(x for x in own if x not in self.zones))
        if self.zone_bytes > _KNOWN_BYTES:
            self.zones, self.zone_bytes, new = {}, 0, list(dict.fromkeys(own))
        got, many = self._each(new)
        fresh = dict(zip(new, np.split(got, np.cumsum(many)[:-1]) if new else [], strict=True))
        for x, v in fresh.items():
            if len(x) <= 256:
                self.zones[x] = v
                self.zone_bytes += len(x) + 4 * len(v) + 200
        pieces = [fresh[x] if x in fresh else self.zones[x] for x in own]
        # both kinds in the order of the text
        place = np.searchsorted(starts, odd)
        before = np.concatenate([[0], np.cumsum(counts)])[place]
        more = np.array([len(p) for p in pieces], dtype=np.int64)
        ids = np.insert(ids, np.repeat(before, more), np.concatenate([np.zeros(0, np.uint32), *pieces]))
        return np.insert(starts, place, odd), np.insert(counts, place, more), ids

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids before each text and in all); each text gets ``end_id``, if there is one."""
        data, offsets = text_buffer(texts)
        starts, counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        a = 0
        while a < len(data):
            b = self._end(data, offsets, a)
            inner = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)]
            s, n, i = self._span(data[a:b], np.unique(np.append(inner, a)) - a)
            starts.append(s + a)
            counts.append(n)
            ids.append(i)
            a = b
        starts, ids = np.concatenate(starts), np.concatenate(ids)
        before = np.concatenate([[0], np.cumsum(np.concatenate(counts))])[np.searchsorted(starts, offsets)]
        if end_id is not None:
            ids = np.insert(ids, before[1:], np.uint32(end_id))
            before = before + np.arange(len(before))
        return ids, before

    @staticmethod
    def _end(data: np.ndarray, offsets: np.ndarray, a: int) -> int:
        """Where the span from ``a`` on ends: at a text's end, or in a long text before a space between two ASCII letters or digits."""
        k = int(np.searchsorted(offsets, a + _SPAN, side="right")) - 1
        if offsets[k] > a:
            return int(offsets[k])
        end = int(offsets[k + 1])
        for low in range(a + _SPAN, end, _SPAN):
            part = data[low - 1 : min(low + _SPAN, end) + 1]
            sure = np.isin(_CLASS[part], (_LETTER, _DIGIT))
            cuts = np.flatnonzero(sure[:-2] & (part[1:-1] == 0x20) & sure[2:])
            if len(cuts):
                return low + int(cuts[0])
        return end


class SentencePieceCounts:
    """Number of ids of whole texts by a ``sentencepiece`` model.

    A single space between two characters that are neither space nor U+2581 is a boundary as long as no entry of the
    vocabulary holds U+2581 after another character; the model is checked for that, and if it does, texts go whole.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.limit = limit
        self.known: dict[str, int] = {}
        self.splits = not any(re.search("[^▁]▁", self.library.id_to_piece(i)) for i in range(self.library.get_piece_size()))
        self.splits &= [len(x) for x in self.library.encode(["a", " a"])] == [1, 2]  # a space before each text, none dropped

    def cut(self, text: str) -> list[str]:
        if not text or not self.splits:
            return [text]
        if "  " in text or "▁" in text or text[0] == " " or text[-1] == " ":
            return _SAFE_PIECE_SPACE.split(text)
        return text.split(" ")

    def count(self, texts: list[str]) -> list[int]:
        out, again, missing = [0] * len(texts), [], set()
        get = self.known.get
        for i, text in enumerate(texts):
            words = self.cut(text)
            got = list(map(get, words))
            if None in got:
                missing.update(w for w, g in zip(words, got, strict=True) if g is None)
                again.append((i, words))
            else:
                out[i] = sum(got)
        if missing:
            if len(self.known) + len(missing) > self.limit:
                self.known.clear()
                for _, words in again:
                    missing.update(words)
            new = list(missing)
            long = {}
            for a in range(0, len(new), _BATCH):
                some = new[a : a + _BATCH]
                for w, n in zip(some, map(len, self.library.encode(some, num_threads=1)), strict=True):
                    (self.known if len(w) <= 64 else long)[w] = n  # so what is kept has a bound in bytes
            for i, words in again:
                out[i] = sum([self.known[w] if w in self.known else long[w] for w in words])
        return out


_loaded: dict = {}
KEPT.append(_loaded)


def loaded(kind, path: str):
    """One encoder for each file and worker."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]
