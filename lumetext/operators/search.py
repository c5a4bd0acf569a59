"""The questions that the engine answers: by words, by prefix, by raw sequence, and over a word list."""

from __future__ import annotations

from dataclasses import dataclass, field
from time import perf_counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, sequence, text
from . import ranking, statistics
from .dictionary import Dictionary
from .index import Index


def word_hits(index: Index, stems: list[str]) -> DataFrame:
    """doc, coverage, frequency, score of every document with any of the stems: most stems first, then by BM25, then by doc."""
    found = ranking.matched(index, stems, stems=True).groupBy("doc")
    return found.agg(F.count("*").alias("coverage"), F.sum("tf").alias("frequency"), F.coalesce(F.sum(ranking.bm25_weight()), F.lit(0.0)).alias("score")).orderBy(F.desc("coverage"), F.desc("score"), "doc")


def docs_with_all(index: Index, stems: list[str]) -> DataFrame:
    return index.matching(stems).groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") == len(set(stems))).select("doc").orderBy("doc")


def docs_with_form(index: Index, term: str) -> DataFrame:
    return index.lookup(text.spelling_of(term), stems=False).select("doc").orderBy("doc")


def corrections(index: Index, dictionary: Dictionary, term: str, k: int = 5) -> DataFrame:
    """form, distance, weight of the words near a term that lead to a document, the term itself left out."""
    near = dictionary.approximate(term, limit=None).where(F.col("form") != text.spelling_of(term))
    leads = near.withColumn("term", index.preprocessor.stem(F.col("form"))).join(index.post_stem.select("term").distinct(), "term", "left_semi")
    key = text.without_accents(F.col("form"))
    return leads.select("form", "distance", "weight").orderBy("distance", F.desc("weight"), key, "form").limit(k)


def prefix_terms(index: Index, prefix: str, limit: int | None = 50) -> DataFrame:
    """term, doc of the words below a prefix in every document that spells them so; words without documents have a null."""
    words = Dictionary(index.vocabulary).listed(prefix, limit).select(F.col("form").alias("term"))
    return words.join(index.post_exact.select("term", "doc"), "term", "left")


def prefix_terms_per_doc(index: Index, prefix: str, limit: int | None = 50) -> DataFrame:
    return prefix_terms(index, prefix, limit).where("doc is not null").groupBy("doc").agg(F.countDistinct("term").alias("terms"))


def sequence_hits(index: Index, pattern: str, ignore_case: bool = True, contexts: int = 3) -> DataFrame:
    """doc, occurrences, positions, contexts of the documents that hold a raw sequence: most hits first, then by doc.

    Positions are those of the lower-cased text, contexts are cut from the original one.
    """
    target, pattern = (F.lower("content"), pattern.lower()) if ignore_case else (F.col("content"), pattern)
    rows = index.docs.where(F.contains(target, F.lit(pattern))) if pattern else index.docs.where("false")
    rows = rows.select("doc", "content", sequence.occurrences(target, pattern).alias("positions"))
    cut = F.transform(F.slice("positions", 1, contexts), lambda p: text.snippet(F.col("content"), p, F.lit(len(pattern))))
    return rows.where("size(positions) > 0").select("doc", F.size("positions").cast("long").alias("occurrences"), "positions", cut.alias("contexts")).orderBy(F.desc("occurrences"), "doc")


def sequence_totals(index: Index, pattern: str, ignore_case: bool = True, method: str = "kmp") -> DataFrame:
    """One row: occurrences and comparisons over all documents, the latter of a scan by ``kmp`` or ``naive``; both find the same."""
    target, pattern = (F.lower("content"), pattern.lower()) if ignore_case else (F.col("content"), pattern)
    compared = {"kmp": sequence.kmp_comparisons, "naive": sequence.naive_comparisons}[method](target, pattern)
    return index.docs.agg(F.coalesce(F.sum(sequence.occurrence_count(target, pattern)), F.lit(0)).alias("occurrences"), F.coalesce(F.sum(compared), F.lit(0)).alias("comparisons"))


@dataclass
class Engine:
    """An index, its dictionary, a word list, and the log of the questions asked."""

    index: Index
    lexicon: Dictionary | None = None
    log: list[tuple[int, str, str, int, float]] = field(default_factory=list)
    _dictionary: Dictionary | None = None

    @property
    def dictionary(self) -> Dictionary:
        if self._dictionary is None:
            self._dictionary = Dictionary(self.index.vocabulary)
        return self._dictionary

    def _logged(self, kind: str, question: str, results: int, began: float) -> None:
        self.log.append((len(self.log) + 1, kind, question, results, perf_counter() - began))

    def query_log(self) -> DataFrame:
        return self.index.docs.sparkSession.createDataFrame(self.log, "seq long, type string, text string, results long, seconds double")

    def state(self) -> dict:
        """What is there before any question: figures of the word list and of the index."""
        own, built = self.index.preprocessor, self.index.build_seconds
        words = statistics.lexicon_figures(self.lexicon).first().asDict() if self.lexicon else None
        return {"lexicon": words, "index": statistics.overview(self.index).first().asDict() | {"stemming": own.stemming, "seconds": built}}

    def report(self) -> dict:
        """All figures: corpus, structures, phases of building, preprocessing, questions (by type and each), hash table of the stems."""
        figures = statistics.overview(self.index).first().asDict()
        log = self.query_log()
        by_type = {r["type"]: {"questions": r["questions"], "seconds": r["seconds"], "mean": r["mean"]} for r in statistics.log_summary(log).orderBy("type").collect()}
        memory = {k: figures.pop(k) for k in ("nodes", "compressed_nodes", "saving")}
        keys = self.index.vocabulary_stems.select(F.col("stem").alias("key")).distinct()
        table = hashing.table_statistics(keys, hashing.capacity_for(figures["stems"])).first().asDict()
        return {
            "corpus": figures, "memory": memory, "building": self.index.seconds | {"total": self.index.build_seconds}, "preprocessing": self.index.preprocessor.described(),
            "questions": {"total": len(self.log), "by_type": by_type, "each": [{"type": t, "text": q, "results": n, "seconds": s} for _, t, q, n, s in self.log]}, "hash": table,
        }

    def insert(self, word: str) -> bool:
        """A word that prefixes find, without documents."""
        self._dictionary, new = self.dictionary.inserted(word)
        return new

    def word(self, query: str, ranked: bool = True) -> dict:
        began, p = perf_counter(), self.index.preprocessor
        terms, ignored = p.query_terms(query)
        by_stem: dict[str, str] = {}
        for t in terms:
            by_stem.setdefault(p.stem_of(t), t)
        stems = list(by_stem)
        hits = word_hits(self.index, stems).collect() if stems else []
        if not ranked:
            hits = sorted(hits, key=lambda r: (-r["coverage"], r["doc"]))
        df = {r["term"]: r["df"] for r in self.index.document_frequency().where(F.col("term").isin(stems)).collect()} if stems else {}
        details = [{"term": t, "stem": s, "documents": df.get(s, 0), "exact_form": [r["doc"] for r in docs_with_form(self.index, t).collect()]} for s, t in by_stem.items()]
        near = {d["term"]: [tuple(r) for r in corrections(self.index, self.dictionary, d["term"]).collect()] for d in details if not d["documents"]}
        fixed = " ".join(near[t][0][0] if near.get(t) else t for t in p.query_tokens(query)) if any(near.values()) else None
        self._logged("word", query, len(hits), began)
        return {
            "query": query, "term": details[0]["term"] if details else query, "stem": details[0]["stem"] if details else None, "terms": details, "ignored": ignored,
            "documents": [(r["doc"], r["score"] if ranked else 0.0) for r in hits], "frequencies": {r["doc"]: r["frequency"] for r in hits}, "coverage": {r["doc"]: r["coverage"] for r in hits},
            "all": sorted(r["doc"] for r in hits if r["coverage"] == len(stems)), "near": near, "correction": fixed,
        }

    def prefix(self, prefix: str, limit: int | None = 50) -> dict:
        began = perf_counter()
        terms = [r["form"] for r in self.dictionary.listed(prefix, limit).collect()]
        total = self.dictionary.count(prefix).first()["words"]
        best = [(r["form"], r["weight"]) for r in self.dictionary.suggested(prefix).collect()]
        posts = self.index.post_exact.where(F.col("term").isin(terms)).select("term", "doc").collect() if terms else []
        ranked = [tuple(r) for r in ranking.bm25(self.index, terms, stems=False).collect()] if terms else []
        self._logged("prefix", prefix, len(terms), began)
        return {"prefix": prefix, "terms": terms, "suggestions": best, "total": total, "truncated": total > len(terms), "by_term": {t: sorted(r["doc"] for r in posts if r["term"] == t) for t in terms}, "documents": sorted({r["doc"] for r in posts}), "ranking": ranked}

    def sequence(self, pattern: str, ignore_case: bool = True, contexts: int = 3) -> dict:
        began = perf_counter()
        hits = [r.asDict() for r in sequence_hits(self.index, pattern, ignore_case, contexts).collect()]
        totals = sequence_totals(self.index, pattern, ignore_case).first()
        self._logged("sequence", pattern, len(hits), began)
        return {"sequence": pattern, "results": hits, "occurrences": totals["occurrences"], "comparisons": totals["comparisons"]}

    def complete(self, prefix: str, limit: int | None = 60) -> dict:
        words = [r["form"] for r in self.lexicon.listed(prefix, limit).collect()]
        total = self.lexicon.count(prefix).first()["words"]
        return {"prefix": prefix, "words": words, "total": total, "truncated": total > len(words)}

    def lookup(self, word: str, k: int = 5) -> dict:
        """Whether the word list has a word; its other spellings, how many words go on from it, and near ones if it isn't there."""
        forms = [r["form"] for r in self.lexicon.forms_of(word).collect()]
        there = text.spelling_of(word) in forms
        below = self.lexicon.count(word).first()["words"] if text.fold(word) else 0
        near = [] if there else [tuple(r) for r in self.lexicon.approximate(word, limit=k).collect()]
        return {"word": word, "found": there, "forms": forms, "continuations": max(0, below - len(forms)), "near": [x for x in near if x[1] > 0]}

    def insert_in_lexicon(self, word: str) -> bool:
        self.lexicon, new = self.lexicon.inserted(word)
        return new

    def complete_last_word(self, typed: str, k: int = 7) -> list[str]:
        """Ways to go on from the last word of what was typed, with the head in front."""
        head, _, last = typed.rpartition(" ")
        head = head + " " if head else ""
        if not last:
            return []
        return [head + r["form"] for r in self.dictionary.suggested(last, k).collect() if r["form"] != text.spelling_of(last)]


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """The rows of a page (from 0) of an ordered listing."""
    return rows.offset(number * size).limit(size)


def parsed_limit(value: str | None, default: int = 60, most: int = 500) -> int | None:
    """A limit from a request: nonsense gives the default, 0 none, anything else is brought into range."""
    try:
        n = int(value) if value is not None else default
    except ValueError:
        return default
    return None if n == 0 else max(1, min(n, most))
