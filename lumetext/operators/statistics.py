"""Figures about a corpus, its index and the questions asked of it."""

from __future__ import annotations

from collections.abc import Callable
from statistics import median
from time import perf_counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .dictionary import Dictionary
from .index import Index


class Stopwatch:
    """Seconds between entering and leaving, around an action."""

    def __enter__(self) -> Stopwatch:
        self._began, self.seconds = perf_counter(), 0.0
        return self

    def __exit__(self, *_) -> None:
        self.seconds = perf_counter() - self._began

    @property
    def ms(self) -> float:
        return self.seconds * 1e3


def median_ms(action: Callable[[], object], runs: int = 5) -> float:
    """The median of the milliseconds that several runs of an action take."""
    times = []
    for _ in range(runs):
        with Stopwatch() as watch:
            action()
        times.append(watch.ms)
    return median(times)


def corpus_figures(index: Index) -> DataFrame:
    """One row: documents, raw_tokens, kept_tokens, reduction (share of tokens left out)."""
    raw = F.size(text.tokens(F.col("content"))).cast("long")
    kept = F.size(index.preprocessor.process(F.col("content"))).cast("long")
    rows = index.docs.select(raw.alias("raw"), kept.alias("kept")).agg(F.count("*").alias("documents"), F.coalesce(F.sum("raw"), F.lit(0)).alias("raw_tokens"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept_tokens"))
    return rows.withColumn("reduction", F.coalesce(F.try_divide((F.col("raw_tokens") - F.col("kept_tokens")).cast("double"), F.col("raw_tokens").cast("double")), F.lit(0.0)))


def structure_figures(index: Index) -> DataFrame:
    """One row: terms, stems, postings, nodes and compressed_nodes of the dictionary, saving by compression."""
    words = Dictionary(index.vocabulary)
    one = index.vocabulary.agg(F.count("*").alias("terms"))
    stems = index.post_stem.agg(F.countDistinct("term").alias("stems"), F.count("*").alias("postings"))
    nodes = words.node_count()
    short = words.compressed_count().withColumnRenamed("nodes", "compressed_nodes")
    return one.crossJoin(F.broadcast(stems)).crossJoin(F.broadcast(nodes)).crossJoin(F.broadcast(short)).withColumn("saving", 1 - F.col("compressed_nodes") / F.col("nodes"))  # one row each


def character_figures(words: DataFrame) -> DataFrame:
    """One row: characters of all distinct keys (what a plain tree would spell out without sharing), their number, and the longest."""
    keys = words.select("key").distinct()
    return keys.agg(F.coalesce(F.sum(F.length("key")), F.lit(0)).cast("long").alias("characters"), F.count("*").alias("keys"), F.max(F.length("key")).cast("long").alias("longest"))


def overview(index: Index) -> DataFrame:
    """One row: the figures of the corpus and of the structures over it."""
    return corpus_figures(index).crossJoin(F.broadcast(structure_figures(index)))  # one row each


def lexicon_figures(words: Dictionary) -> DataFrame:
    """One row: words, nodes, height of a word list."""
    return words.words.agg(F.count("*").alias("words")).crossJoin(F.broadcast(words.node_count())).crossJoin(F.broadcast(words.height()))  # one row each


def stem_reuse(index: Index) -> DataFrame:
    """One row: calls, hits, rate: how often a stemmer with a memory would have met a word before."""
    calls, words = F.coalesce(F.sum("weight"), F.lit(0)), F.count("*")
    return index.vocabulary.agg(calls.alias("calls"), (calls - words).alias("hits"), F.coalesce(F.try_divide((calls - words).cast("double"), calls.cast("double")), F.lit(0.0)).alias("rate"))


def index_growth(index: Index, bounds: list) -> DataFrame:
    """bound, documents, tokens, postings, terms of the documents up to each bound, from one pass over the postings and one over the lengths."""

    def upto(rows: DataFrame, key: str, *figures) -> DataFrame:
        place = F.explode(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: F.col(key) <= b))
        return rows.withColumn("bound", place).groupBy("bound").agg(*figures)

    lengths = upto(index.doc_lengths, "doc", F.count("*").alias("documents"), F.sum("dl").alias("tokens"))
    posts = upto(index.post_exact, "doc", F.count("*").alias("postings"))
    terms = upto(index.post_exact.groupBy("term").agg(F.min("doc").alias("first")), "first", F.count("*").alias("terms"))
    return lengths.join(posts, "bound", "left").join(terms, "bound", "left").fillna(0, ["postings", "terms"]).orderBy("bound")


def prefix_growth(words: DataFrame, prefixes: list[str], bounds: list[str], limit: int = 10) -> DataFrame:
    """bound, compared, found, shown: over the words up to each bound, what a scan for the prefixes compares, and what they find in all and up to a limit each."""
    place = F.explode(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: F.col("form") <= b))
    hits = [F.coalesce(F.sum(F.startswith("key", F.lit(text.fold(p))).cast("long")), F.lit(0)) for p in prefixes]
    counts = words.withColumn("bound", place).groupBy("bound").agg((F.count("*") * len(prefixes)).alias("compared"), F.array(*hits).alias("hits"))
    total = lambda f: F.aggregate(F.transform("hits", f), F.lit(0).cast("long"), lambda a, n: a + n)
    return counts.select("bound", "compared", total(lambda n: n).alias("found"), total(lambda n: F.least(n, F.lit(limit).cast("long"))).alias("shown")).orderBy("bound")


def document_summary(files: DataFrame, index: Index) -> DataFrame:
    """doc, bytes, tokens of every file; 0 tokens for those that came after the index."""
    return files.join(index.doc_lengths, "doc", "left").select("doc", "bytes", F.coalesce("dl", F.lit(0)).alias("tokens")).orderBy("doc")


def log_summary(log: DataFrame) -> DataFrame:
    """type, questions, seconds, mean for a log with type and seconds."""
    return log.groupBy("type").agg(F.count("*").alias("questions"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("mean"))


def last_question(log: DataFrame) -> DataFrame:
    return log.orderBy(F.desc("seq")).limit(1)


def mean_ratio(log: DataFrame, slow: str, fast: str) -> DataFrame:
    """One row: how many times longer questions of one type take than those of another, on average."""
    mean = lambda t: F.avg(F.when(F.col("type") == t, F.col("seconds")))
    return log.agg(F.try_divide(mean(slow), mean(fast)).alias("ratio"))


def stemming_effect(index: Index) -> DataFrame:
    """One row: forms, stems, forms_per_stem."""
    return index.vocabulary_stems.agg(F.count("*").alias("forms"), F.countDistinct("stem").alias("stems")).withColumn("forms_per_stem", F.try_divide(F.col("forms").cast("double"), F.col("stems").cast("double")))


def coverage_gain(index: Index, terms: list[str]) -> DataFrame:
    """term, exact, stemmed, gain: documents found by the form alone and by its stem."""
    asked = index.docs.sparkSession.createDataFrame([(t, index.preprocessor.stem_of(t)) for t in terms], "term string, stem string")
    exact = index.document_frequency(stems=False).where(F.col("term").isin(terms)).withColumnRenamed("df", "exact")
    stemmed = index.document_frequency().where(F.col("term").isin([index.preprocessor.stem_of(t) for t in terms])).select(F.col("term").alias("stem"), F.col("df").alias("stemmed"))
    both = asked.join(exact, "term", "left").join(stemmed, "stem", "left").fillna(0, ["exact", "stemmed"])
    return both.select("term", "exact", "stemmed", (F.col("stemmed") - F.col("exact")).alias("gain"))
