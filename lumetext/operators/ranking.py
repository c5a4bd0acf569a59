"""BM25 and TF-IDF over posting tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .index import Index

K1, B = 1.5, 0.75


def idf(n_docs: Column, df: Column) -> Column:
    """Positive for any term that occurs, 0 for others."""
    return F.when(df > 0, F.log((n_docs - df + 0.5) / (df + 0.5) + 1)).otherwise(0.0)


def bm25_score(tf: Column, dl: Column, avgdl: Column, weight: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _query(index: Index, terms: list[str]) -> DataFrame:
    """term, times: a term given twice counts twice."""
    rows = [(t, terms.count(t)) for t in dict.fromkeys(terms)]
    return index.docs.sparkSession.createDataFrame(rows, "term string, times long")


def matched(index: Index, terms: list[str], stems: bool) -> DataFrame:
    """The postings of the terms, with times, df, dl and the totals."""
    posts = index.matching(list(dict.fromkeys(terms)), stems)
    # a row for each term of the query, counted by partial sums: a term of every document is no hot key
    frequency = posts.groupBy("term").agg(F.count("*").alias("df"))
    asked = F.broadcast(_query(index, terms).join(frequency, "term"))
    return posts.join(asked, "term").join(index.doc_lengths, "doc").crossJoin(F.broadcast(index.totals))  # one row


def bm25_weight() -> Column:
    """The score of a row of ``matched``."""
    score = F.col("times") * bm25_score(F.col("tf"), F.col("dl"), F.col("avgdl"), idf(F.col("n_docs"), F.col("df")))
    return F.when(F.col("avgdl") > 0, score)


def bm25(index: Index, terms: list[str], stems: bool = True) -> DataFrame:
    """doc, score, best first, ties by doc; empty if no document has a token."""
    found = matched(index, terms, stems).where("avgdl > 0")
    return found.groupBy("doc").agg(F.sum(bm25_weight()).alias("score")).orderBy(F.desc("score"), "doc")


def tfidf(index: Index, terms: list[str], stems: bool = True) -> DataFrame:
    """doc, score; a document whose terms are in every document stays, with 0."""
    found = matched(index, terms, stems)
    score = F.col("times") * (1 + F.log10("tf")) * F.log10(F.col("n_docs") / F.col("df"))
    return found.groupBy("doc").agg(F.sum(score).alias("score")).orderBy(F.desc("score"), "doc")


def compared(index: Index, terms: list[str], k: int = 5, stems: bool = True) -> DataFrame:
    """rank, and the document and its length that either ranking has there."""

    def top(ranked: DataFrame, name: str) -> DataFrame:
        first = ranked.limit(k)
        return first.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc")).alias("rank"), "doc").join(index.doc_lengths, "doc").select("rank", F.col("doc").alias(f"{name}_doc"), F.col("dl").alias(f"{name}_length"))

    return top(bm25(index, terms, stems), "bm25").join(top(tfidf(index, terms, stems), "tfidf"), "rank", "full_outer").orderBy("rank")


def compared_lengths(index: Index, terms: list[str], k: int = 5, stems: bool = True) -> DataFrame:
    """term, df, bm25_length, tfidf_length, in_all for questions of one term each: the mean length of the first k documents by either ranking, and whether the term is in every document (then TF-IDF tells none apart)."""
    found = matched(index, list(dict.fromkeys(terms)), stems).where("avgdl > 0")
    weights = {"bm25": bm25_weight(), "tfidf": F.col("times") * (1 + F.log10("tf")) * F.log10(F.col("n_docs") / F.col("df"))}

    def top(name: str) -> DataFrame:
        # Spark keeps k rows of a term on each side of the shuffle, so a term of all documents is no hot key
        order = Window.partitionBy("term").orderBy(F.desc("score"), "doc")
        best = found.select("term", "df", "n_docs", "doc", "dl", weights[name].alias("score")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
        return best.groupBy("term").agg(F.max("df").alias("df"), F.max("n_docs").alias("n_docs"), F.avg("dl").alias(f"{name}_length"))

    both = top("bm25").join(top("tfidf").select("term", "tfidf_length"), "term")
    return both.select("term", "df", "bm25_length", "tfidf_length", (F.col("df") == F.col("n_docs")).alias("in_all"))
