"""The search index as tables: tokens, vocabulary, exact and stem postings, document lengths, collection totals.

``doc`` is any orderable key. Tables are DataFrames over the documents; ``saved`` writes them sorted by term, so that
a lookup by term reads few row groups, and ``load`` reads them back.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stemming, text


#: Forms of the asked stems that are looked for by a filter; more are joined.
FEW_FORMS = 5000


@dataclass(frozen=True)
class Preprocessor:
    """What becomes a term: stopwords (accent-free), the least length, and whether terms are stemmed."""

    stopwords: tuple[str, ...] = ()
    stemming: bool = True
    min_length: int = text.MIN_TOKEN

    def process(self, column):
        return text.without_stopwords(text.tokens(column), list(self.stopwords), self.min_length)

    def stem(self, column):
        return stemming.stem(column) if self.stemming else F.lower(column)

    def stem_of(self, word: str) -> str:
        return stemming.stem_of(word) if self.stemming else word.lower()

    def query_tokens(self, query: str) -> list[str]:
        """All tokens of a query, stopwords included."""
        out, word = [], ""
        for c in [*query.lower(), " "]:
            if c.isalpha() or (c.isalnum() and not c.isdecimal() and not c.isdigit()) or _is_number_letter(c):
                word += c
            elif word:
                out.append(word)
                word = ""
        return out

    def query_terms(self, query: str) -> tuple[list[str], list[str]]:
        """(terms to search for, tokens that are left out), each in the order typed."""
        terms, ignored = [], []
        for t in self.query_tokens(query):
            (terms if len(t) >= self.min_length and text.fold(t) not in self.stopwords else ignored).append(t)
        return terms, ignored

    def described(self) -> dict:
        return {"stopwords": len(self.stopwords), "stemming": "RSLP" if self.stemming else "none", "min_length": self.min_length}


def _is_number_letter(c: str) -> bool:
    import unicodedata

    return unicodedata.category(c) in ("Nl", "No")


@dataclass
class Index:
    docs: DataFrame  # doc, content
    preprocessor: Preprocessor = field(default_factory=Preprocessor)
    stored: bool = False
    seconds: dict[str, float] = field(default_factory=dict)  # of the phases of building, for a saved index

    @classmethod
    def of(cls, table: DataFrame, doc: str = "doc", content: str = "content", preprocessor: Preprocessor | None = None) -> Index:
        return cls(table.select(F.col(doc).alias("doc"), F.coalesce(F.col(content), F.lit("")).alias("content")), preprocessor or Preprocessor())

    @property
    def raw_tokens(self) -> DataFrame:
        return self.docs.select("doc", F.explode(text.tokens(F.col("content"))).alias("term"))

    @property
    def tokens(self) -> DataFrame:
        """doc, term: every occurrence of a term that is indexed."""
        return self.raw_tokens.where(text.is_searchable(F.col("term"), list(self.preprocessor.stopwords), self.preprocessor.min_length))

    @cached_property
    def post_exact(self) -> DataFrame:
        """term, doc, tf."""
        return self.tokens.groupBy("term", "doc").agg(F.count("*").alias("tf"))

    @cached_property
    def vocabulary(self) -> DataFrame:
        """form, key (accent-free), weight (occurrences in the corpus)."""
        return self.post_exact.groupBy(F.col("term").alias("form")).agg(F.sum("tf").alias("weight")).select("form", text.without_accents(F.col("form")).alias("key"), "weight")

    @cached_property
    def vocabulary_stems(self) -> DataFrame:
        """term, stem: each distinct term is stemmed once."""
        return self.vocabulary.select(F.col("form").alias("term"), self.preprocessor.stem(F.col("form")).alias("stem"))

    @cached_property
    def post_stem(self) -> DataFrame:
        """term (the stem), doc, tf."""
        return self.post_exact.join(self.vocabulary_stems, "term").groupBy(F.col("stem").alias("term"), "doc").agg(F.sum("tf").alias("tf"))

    @cached_property
    def doc_lengths(self) -> DataFrame:
        """doc, dl: indexed tokens of every document, 0 included."""
        words = self.preprocessor.process(F.col("content"))
        return self.docs.select("doc", F.size(words).cast("long").alias("dl"))

    @cached_property
    def totals(self) -> DataFrame:
        """One row: n_docs, total_tokens, avgdl."""
        return self.doc_lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total_tokens")).withColumn("avgdl", F.coalesce(F.try_divide(F.col("total_tokens").cast("double"), F.col("n_docs").cast("double")), F.lit(0.0)))

    def postings(self, stems: bool = True) -> DataFrame:
        return self.post_stem if stems else self.post_exact

    def matching(self, terms: list[str], stems: bool = True) -> DataFrame:
        """term, doc, tf of some terms. From stored tables by term; else only the tokens of these terms are counted."""
        if not stems or self.stored:
            return self.postings(stems).where(F.col("term").isin(terms))
        # suffixes only are stripped, so a form begins as its stem does; the others needn't be stemmed
        initial = F.substring(text.without_accents(F.col("term")), 1, 1).isin([text.fold(t)[:1] for t in terms])
        forms = self.tokens.select("term").distinct().where(initial).select("term", self.preprocessor.stem(F.col("term")).alias("stem")).where(F.col("stem").isin(terms))
        few = forms.limit(FEW_FORMS + 1).collect()
        tokens = self.tokens
        if len(few) <= FEW_FORMS:  # so many words can be part of the filter, and nothing but their occurrences is moved
            tokens = tokens.where(F.col("term").isin([r["term"] for r in few]))
            forms = F.broadcast(self.docs.sparkSession.createDataFrame(few, "term string, stem string"))
        return tokens.join(forms, "term").groupBy(F.col("stem").alias("term"), "doc").agg(F.count("*").alias("tf"))

    def lookup(self, term: str, stems: bool = True) -> DataFrame:
        """doc, tf of one term."""
        return self.matching([term], stems).select("doc", "tf")

    def document_frequency(self, stems: bool = True) -> DataFrame:
        return self.postings(stems).groupBy("term").agg(F.count("*").alias("df"))

    def size(self, stems: bool = True) -> DataFrame:
        """One row: terms, postings."""
        return self.postings(stems).agg(F.countDistinct("term").alias("terms"), F.count("*").alias("postings"))

    def most_frequent(self, k: int = 12, stems: bool = True) -> DataFrame:
        """term, occurrences, df of the k terms with most occurrences; ties by term."""
        return self.postings(stems).groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("df")).orderBy(F.desc("occurrences"), "term").limit(k)

    def as_maps(self, stems: bool = True) -> DataFrame:
        """term, postings as a map from doc to tf."""
        return self.postings(stems).groupBy("term").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("doc", "tf")))).alias("postings"))

    def saved(self, folder: str, contents: bool = True) -> Index:
        """Writes the tables, the postings sorted by term, and returns the index over them, with the seconds of each phase.

        Without ``contents`` the texts aren't kept, and raw sequences find nothing.
        """
        spark, phases = self.docs.sparkSession, {}

        def write(phase: str, name: str, table: DataFrame, key: str | None = None) -> DataFrame:
            began = perf_counter()
            ordered = table if key is None else table.repartitionByRange(key).sortWithinPartitions(key)
            ordered.write.mode("overwrite").parquet(f"{folder}/{name}")
            phases[phase] = phases.get(phase, 0.0) + perf_counter() - began
            return spark.read.parquet(f"{folder}/{name}")

        write("reading", "docs", self.docs if contents else self.docs.select("doc", F.lit("").alias("content")))
        self.__dict__["post_exact"] = write("preprocessing", "post_exact", self.post_exact, "term")
        for name, phase in (("vocabulary", "dictionary"), ("vocabulary_stems", "dictionary"), ("post_stem", "index"), ("doc_lengths", "index")):
            self.__dict__.pop(name, None)
            table = getattr(self, name)
            self.__dict__[name] = write(phase, name, table, table.columns[0])
        out = self.load(spark, folder, self.preprocessor)
        out.seconds.update(phases)
        return out

    @property
    def build_seconds(self) -> float:
        return sum(self.seconds.values())

    @classmethod
    def load(cls, spark: SparkSession, folder: str, preprocessor: Preprocessor | None = None) -> Index:
        out = cls(spark.read.parquet(f"{folder}/docs"), preprocessor or Preprocessor(), stored=True)
        for name in ("post_exact", "vocabulary", "vocabulary_stems", "post_stem", "doc_lengths"):
            out.__dict__[name] = spark.read.parquet(f"{folder}/{name}")
        return out
