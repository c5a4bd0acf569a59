"""Language identification: the family first, then one-versus-one linear support vector machines within it.

Features are the three-byte runs of the lower-cased text (UTF-8; ASCII other than letters counts as a space, runs
around a space's middle are left out), hashed to ``2 ** BITS`` places, as shares of the text's runs. Each machine is
linear in the shares, so a whole text is scored by summing the weights of its runs; texts are never shortened.

Machines are trained on the driver from a bounded sample: at most about ``per_language`` rows of each language (the
ones of least hash). Families are separated by one-versus-one machines, too; languages that ``FAMILIES`` doesn't name
are families of their own. A text that is null or has no letter is ``und`` with score 0; so is every text if
there is nothing to learn from. Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean
from .words import text_buffer

BITS = 13
UND = "und"
# Families of some languages, by their codes.
FAMILIES = {
    "romance": "ca es fr gl it la oc pt ro",
    "germanic": "af da de en fy is nb nl nn no sv",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk tr uz",
    "indic": "bn gu hi mr ne pa ur",
    "sinitic": "yue zh",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 0x20 for b in range(256)], dtype=np.uint8)
_SPAN = 1 << 19


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the run at each byte but the last two, whether it counts)."""
    d = _FOLD[data].astype(np.uint32)
    code = d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS), d[1:-1] != 0x20


def shares(column: pa.Array) -> Iterator[np.ndarray]:
    """The feature vector of each text."""
    data, offsets = text_buffer(pc.utf8_lower(column))
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        out = np.zeros(1 << BITS)
        if b - a > 2:
            place, counts = _runs(data[a:b])
            out = np.bincount(place[counts], minlength=1 << BITS).astype(np.float64)
            out /= max(out.sum(), 1)
        yield out


class Hierarchy:
    """Machines (a, b, weights, bias): positive for a. The first level's names are families."""

    def __init__(self, machines: list[tuple[str, str, np.ndarray, float]], languages: list[str]):
        self.names = [(a, b) for a, b, _, _ in machines]
        self.weights = np.stack([w for _, _, w, _ in machines], axis=1) if machines else np.zeros((1 << BITS, 0))
        self.bias = np.array([c for *_, c in machines])
        self.languages = languages

    def margins(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_buffer(pc.utf8_lower(column))
        out = np.zeros((len(offsets) - 1, len(self.bias)))
        n = np.zeros(len(out))
        text = 0
        at = 0
        while at < len(data):
            # spans overlap by two bytes; a run belongs to the text of its first byte if it ends there, too
            to = min(at + _SPAN, len(data))
            part = data[at : to + 2]
            if len(part) < 3:
                break
            place, counts = _runs(part)
            edges = np.clip(offsets - at, 0, len(place))
            last = np.clip(offsets[1:] - 2 - at, 0, len(place))
            text = int(np.searchsorted(offsets, at, side="right")) - 1
            end = int(np.searchsorted(offsets, to, side="left"))
            a, b = edges[text:end], np.maximum(last[text:end], edges[text:end])
            run = np.concatenate([[0], np.cumsum(counts)])
            n[text:end] += run[b] - run[a]
            for j in range(len(self.bias)):
                run = np.concatenate([[0.0], np.cumsum(np.where(counts, self.weights[:, j][place], 0.0))])
                out[text:end, j] += run[b] - run[a]
            at = to
        return out / np.maximum(n, 1)[:, None] + self.bias

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        margins = self.margins(column)
        letters = pc.match_substring_regex(column, r"\p{L}").to_numpy(zero_copy_only=False)
        sure = 1 / (1 + np.exp(-2 * np.clip(margins, -30, 30)))

        def vote(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """For each text the index of the winner by votes (then by margins), and its mean certainty."""
            if len(names) == 1:
                return np.zeros(len(margins), dtype=int), np.ones(len(margins))
            votes, certain = np.zeros((len(margins), len(names))), np.zeros((len(margins), len(names)))
            for i, k in combinations(range(len(names)), 2):
                j = self.names.index((names[i], names[k]))
                votes[:, i] += margins[:, j] > 0
                votes[:, k] += margins[:, j] <= 0
                certain[:, i] += sure[:, j]
                certain[:, k] += 1 - sure[:, j]
            certain /= len(names) - 1
            best = np.argmax(votes + certain / 2, axis=1)
            return best, certain[np.arange(len(best)), best]

        families = sorted({family(x) for x in self.languages})
        first, score = vote(families) if families else (np.zeros(len(margins), dtype=int), np.zeros(len(margins)))
        out = np.full(len(margins), UND, dtype=object)
        for i, f in enumerate(families):
            members = sorted(x for x in self.languages if family(x) == f)
            best, certain = vote(members)
            mine = first == i
            out[mine] = np.array(members, dtype=object)[best[mine]]
            score[mine] *= certain[mine]
        out[~letters] = UND
        score[~letters | (out == UND)] = 0.0
        return out.tolist(), score


def family(language: str) -> str:
    return "family:" + _FAMILY.get(language.split("-")[0].lower(), language)


def train_machine(x: np.ndarray, y: np.ndarray, steps: int = 1500, batch: int = 64, strength: float = 1e-4, seed: int = 5) -> tuple[np.ndarray, float]:
    """A linear support vector machine (hinge loss, L2) by averaged stochastic subgradients; both classes weigh alike."""
    rng = np.random.default_rng(seed)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    scale = 1 / max(np.sqrt((x**2).sum(axis=1)).mean(), 1e-12)
    w, c, mean, mean_c = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    for t in range(1, steps + 1):
        rows = rng.choice(len(y), size=batch, p=weight / weight.sum())
        some = x[rows] * scale
        wrong = y[rows] * (some @ w + c) < 1
        rate = 1 / (strength * (t + 1 / strength))
        w *= 1 - rate * strength
        w += rate * (y[rows] * wrong) @ some / batch * 4
        c += 0.1 * rate * (y[rows] * wrong).mean()
        if t > steps // 2:
            mean += w
            mean_c += c
    half = steps - steps // 2
    return mean / half * scale, mean_c / half


def train(x: np.ndarray, languages: list[str]) -> Hierarchy:
    names = sorted(set(languages))
    own = np.array(languages)
    families = np.array([family(i) for i in languages])
    machines = []
    groups = [(sorted({family(i) for i in names}), families)] + [([i for i in names if family(i) == f], own) for f in sorted({family(i) for i in names})]
    for members, of in groups:
        for a, b in combinations(members, 2):
            rows = (of == a) | (of == b)
            machines.append((a, b, *train_machine(x[rows], np.where(of[rows] == a, 1.0, -1.0))))
    return Hierarchy(machines, names)


def fit(rows: DataFrame, per_language: int = 300) -> Hierarchy:
    """rows: doc_id, text, lang of those to learn from. Takes at most ``per_language`` of each language."""
    rows = rows.where("text is not null and lang is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    hashed = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    counts = {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Hierarchy([], [])
    # about twice as many by a threshold on the hash, then the least of these
    cases = F.lit(False)
    for lang, n in counts.items():
        cases = cases | ((F.col("lang") == lang) & (F.pmod(F.col("h"), F.lit(1 << 30)) < int(min(1.0, 2 * per_language / n) * (1 << 30))))
    some = hashed.where(cases).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= per_language)
    ids = [r["doc_id"] for r in some.select("doc_id").collect()]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = list(shares(b.column(0)))
            at = [np.flatnonzero(v) for v in whole]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(at, pa.list_(pa.int16())), pa.array([v[i] for v, i in zip(whole, at, strict=True)], pa.list_(pa.float32()))], ["lang", "at", "share"])

    got = rows.where(F.col("doc_id").isin(ids)).orderBy(F.xxhash64("doc_id"), "doc_id", "lang").select("text", "lang").limit(per_language * len(counts)).mapInArrow(lean("language", vectors), "lang string, at array<short>, share array<float>").collect()
    x = np.zeros((len(got), 1 << BITS), dtype=np.float32)
    for i, r in enumerate(got):
        x[i, np.asarray(r["at"], dtype=np.int64)] = r["share"]
    return train(x, [r["lang"] for r in got])


def predict(docs: DataFrame, model: Hierarchy) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs``."""

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score = model.predict(pc.fill_null(b.column(1), ""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean("language", predicted), "doc_id long, lang_pred string, score double")


def held_out(fold: int, folds: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == fold


def identify(docs: DataFrame, per_language: int = 300) -> DataFrame:
    """Learns from the rows that aren't held out and predicts all: doc_id, held_out, lang_pred, score."""
    rest = F.coalesce(held_out(1, 3), F.lit(False))
    return predict(docs, fit(docs.where(~rest), per_language)).select("doc_id", rest.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, per_language: int = 300) -> DataFrame:
    """The rows of ``docs``, all columns, that are not ``und``; learns from all that name their language."""
    model = fit(docs, per_language)

    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, _ = model.predict(pc.fill_null(b.column(b.schema.get_field_index("text")).cast(pa.string()), ""))
            yield b.filter(pa.array([x != UND for x in names], pa.bool_()))

    # with nothing to learn from, no language can be told and nothing is rejected for that
    return docs.mapInArrow(lean("language", identified), docs.schema) if model.languages else docs
