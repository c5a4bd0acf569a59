"""Text folders, word lists and article texts in; JSON out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import text

#: Words of a missing or empty word list.
EXAMPLE_WORDS = ("computador", "computação", "computacional", "compilador", "complexidade", "programação", "processador", "processamento")


def _windows_1252() -> tuple[str, str]:
    """(Latin-1 characters 0x80 to 0x9F, the Windows-1252 ones in their place; U+FFFD for those it leaves open)."""
    raw = [bytes([b]) for b in range(0x80, 0xA0)]
    return "".join(b.decode("latin-1") for b in raw), "".join(b.decode("cp1252", errors="replace") for b in raw)


def decoded(content: Column) -> Column:
    """UTF-8 without a byte order mark, else Windows-1252; line ends become line feeds."""
    utf8 = F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")
    old = F.translate(F.decode(content, "ISO-8859-1"), *_windows_1252())
    return F.regexp_replace(F.when(F.is_valid_utf8(content), utf8).otherwise(old), "\r\n?", "\n")


def text_folder(spark: SparkSession, folder: str) -> DataFrame:
    """doc, bytes, content of the text files of a folder (any case of the ending, no subfolders); none if it is missing."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][xX][tT]").load(folder)
    except AnalysisException:
        return spark.createDataFrame([], "doc string, bytes long, content string")
    name = F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B"))
    return files.select(name.alias("doc"), F.col("length").alias("bytes"), decoded(F.col("content")).alias("content"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """word: the lines of a file, stripped, without blank ones and comments."""
    lines = text.stripped(F.col("value"))
    return spark.read.text(path).select(lines.alias("word")).where((F.col("word") != "") & ~F.startswith("word", F.lit("#")))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``word_list``; the example words if the file is missing or has none."""
    try:
        words = word_list(spark, path)
        if not words.isEmpty():
            return words
    except AnalysisException:
        pass
    return spark.createDataFrame([(w,) for w in EXAMPLE_WORDS], "word string")


def stopwords(spark: SparkSession, path: str) -> list[str]:
    """The distinct accent-free words of a list, sorted; none if the file is missing. A list of words of a language is small."""
    try:
        return sorted(r[0] for r in word_list(spark, path).select(text.normalised(F.col("word")).alias("word")).distinct().collect())
    except AnalysisException:
        return []


def cleaned_articles(articles: DataFrame, closing: list[str], least_words: int = 200) -> DataFrame:
    """doc, content of article texts: cleaned, and those with enough words."""
    return articles.select(text.safe_name(F.col("doc")).alias("doc"), text.cleaned_article(F.col("content"), closing).alias("content")).where(text.has_words(F.col("content"), least_words))


def lexicon_from(vocabulary: DataFrame, accepted: DataFrame, extra: list[str] = list(EXAMPLE_WORDS)) -> DataFrame:  # noqa: B006
    """word: Latin words of three or more letters that another table accepts, and some more, by (key, word)."""
    spark = vocabulary.sparkSession
    latin = vocabulary.where((F.length("word") >= 3) & F.col("word").rlike(r"^\p{IsLatin}+$")).join(accepted.select("word"), "word", "left_semi")
    words = latin.select("word").unionByName(spark.createDataFrame([(w,) for w in extra], "word string")).distinct()
    return words.orderBy(text.normalised(F.col("word")), "word")


def packed(docs: DataFrame, titles: DataFrame) -> DataFrame:
    """name, title, bytes, text of each document; the title from a table, else from the name."""
    return docs.join(titles.select("doc", "title"), "doc", "left").select(F.col("doc").alias("name"), F.coalesce("title", text.title_of(F.col("doc"))).alias("title"), "bytes", F.col("content").alias("text"))


def write_json(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)


def document(docs: DataFrame, name: str) -> DataFrame:
    return docs.where(F.col("doc") == name)
