"""An ordered dictionary with prefix access, without a tree: words are rows, nodes are the distinct prefixes of their keys.

A word is (form, key, weight): its spelling with accents, its accent-free key, and its weight. Listings are by
(key, form), suggestions by (weight descending, key, form), approximate matches by (distance, weight descending, key, form).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import distance, text


def words_of(rows: DataFrame) -> DataFrame:
    """form, key, weight of (word, weight): the greatest weight of each spelling; blank words are left out."""
    weight = F.col("weight") if "weight" in rows.columns else F.lit(1)
    once = rows.select("word", weight.cast("long").alias("weight")).groupBy("word").agg(F.max("weight").alias("weight"))
    # composing characters needs an Arrow function; each distinct word goes through it once
    forms = once.select(text.spelling_exact(F.col("word")).alias("form"), "weight").where("form <> ''").groupBy("form").agg(F.max("weight").alias("weight"))
    return forms.select("form", text.normalised_exact(F.col("form")).alias("key"), "weight")


def _prefixes(key: Column, root: bool = False) -> Column:
    some = F.transform(F.sequence(F.lit(1), F.length(key)), lambda n: F.substring(key, F.lit(1), n))
    return F.concat(F.array(F.lit("")), some) if root else some


@dataclass
class Dictionary:
    words: DataFrame  # form, key, weight

    @classmethod
    def of(cls, rows: DataFrame) -> Dictionary:
        return cls(words_of(rows))

    def inserted(self, word: str, weight: int = 1) -> tuple[Dictionary, bool]:
        """The dictionary with one more word, and whether it is new; a known one keeps the greater weight."""
        form = text.spelling_of(word)
        if not form or not text.fold(word):
            return self, False
        row = self.words.sparkSession.createDataFrame([(form, text.fold(word), weight)], "form string, key string, weight long")
        new = self.words.where(F.col("form") == form).isEmpty()
        return Dictionary(self.words.unionByName(row).groupBy("form", "key").agg(F.max("weight").alias("weight"))), new

    def find(self, word: str) -> DataFrame:
        return self.words.where(F.col("form") == text.spelling_of(word))

    def forms_of(self, word: str) -> DataFrame:
        """All spellings of the accent-free word."""
        return self.words.where(F.col("key") == text.fold(word)).orderBy("form")

    def below(self, prefix: str) -> DataFrame:
        return self.words.where(F.startswith("key", F.lit(text.fold(prefix))))

    def listed(self, prefix: str, limit: int | None = None, offset: int = 0) -> DataFrame:
        out = self.below(prefix).orderBy("key", "form")
        out = out.offset(offset) if offset else out
        return out if limit is None else out.limit(limit)

    def count(self, prefix: str) -> DataFrame:
        return self.below(prefix).agg(F.count("*").alias("words"))

    def suggested(self, prefix: str, k: int = 10) -> DataFrame:
        return self.below(prefix).orderBy(F.desc("weight"), "key", "form").limit(k)

    def suggested_for_all(self, prefixes: DataFrame, k: int = 10) -> DataFrame:
        """prefix, rank, form, weight for a table of prefixes (accent-free): an equi-join on the prefixes of keys."""
        lengths = [r[0] for r in prefixes.select(F.length("prefix")).distinct().collect()]  # a few lengths
        cut = self.words.select("*", F.explode(F.array(*[F.lit(n) for n in lengths] or [F.lit(-1)])).alias("n")).where("n >= 0 and n <= length(key)").withColumn("prefix", F.substring("key", F.lit(1), F.col("n")))
        order = Window.partitionBy("prefix").orderBy(F.desc("weight"), "key", "form")
        return cut.join(prefixes.select("prefix").distinct(), "prefix").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("prefix", "rank", "form", "weight")

    def approximate(self, word: str, most: int | None = None, limit: int | None = 5) -> DataFrame:
        """form, distance, weight of the words within ``most`` edits of the key: by default 1 up to four characters, else 2."""
        key = text.fold(word)
        if not key:
            return self.words.where("false").select("form", F.lit(0).alias("distance"), "weight")
        most = (1 if len(key) <= 4 else 2) if most is None else most
        near = self.words.where(distance.within(F.col("key"), F.lit(key), most)).withColumn("distance", distance.edit_distance(F.col("key"), F.lit(key)))
        out = near.where(F.col("distance") <= most).orderBy("distance", F.desc("weight"), "key", "form").select("form", "distance", "weight")
        return out if limit is None else out.limit(limit)

    # What a character tree would hold, and visit.

    def nodes(self) -> DataFrame:
        """path, is_end, words_below, best_weight of every node of the tree, the root included."""
        paths = self.words.select("key", "weight", F.explode(_prefixes(F.col("key"), root=True)).alias("path"))
        return paths.groupBy("path").agg(F.max(F.col("path") == F.col("key")).alias("is_end"), F.count("*").alias("words_below"), F.max("weight").alias("best_weight"))

    def node_count(self) -> DataFrame:
        return self.words.select(F.explode(_prefixes(F.col("key"))).alias("path")).agg((F.countDistinct("path") + 1).alias("nodes"))

    def compressed_nodes(self) -> DataFrame:
        """path of the nodes that path compression keeps: ends of words and branchings, besides the root."""
        paths = self.words.select("key", F.explode(_prefixes(F.col("key"))).alias("path"))
        follow = paths.select("path", F.nullif(F.substring("key", F.length("path") + 1, F.lit(1)), F.lit("")).alias("next"), (F.col("path") == F.col("key")).alias("is_end"))
        return follow.groupBy("path").agg(F.countDistinct("next").alias("branches"), F.max("is_end").alias("is_end")).where("is_end or branches >= 2").select("path")

    def compressed_count(self) -> DataFrame:
        return self.compressed_nodes().agg((F.count("*") + 1).alias("nodes"))

    def height(self) -> DataFrame:
        return self.words.agg(F.coalesce(F.max(F.length("key")), F.lit(0)).alias("height"))

    def descent_comparisons(self, prefix: str) -> DataFrame:
        """Characters compared on the way down, the failing one included."""
        key = text.fold(prefix)
        held = [F.max(F.startswith("key", F.lit(key[:n])).cast("int")) for n in range(1, len(key) + 1)]
        longest = sum((F.coalesce(h, F.lit(0)) for h in held), F.lit(0))
        return self.words.agg(F.least(F.lit(len(key)), longest + 1).cast("long").alias("comparisons"))

    def listing_visits(self, prefix: str, limit: int | None = None) -> DataFrame:
        """Nodes that an ordered walk opens below a prefix until it has ``limit`` words."""
        p = text.fold(prefix)
        paths = self.below(prefix).select(F.explode(_prefixes(F.col("key"), root=True)).alias("path")).where(F.startswith("path", F.lit(p))).distinct()
        if limit is None:
            return paths.agg(F.count("*").alias("visits"))
        last = self.listed(prefix, limit).agg(F.count("*").alias("n"), F.max("key").alias("last"))
        return paths.crossJoin(F.broadcast(last)).where((F.col("n") < limit) | (F.col("path") <= F.col("last"))).agg(F.count("*").alias("visits"))  # one row

    def best_first_visits(self, prefix: str, k: int) -> DataFrame:
        """Nodes that a best-first search opens below a prefix until it has k words."""
        p = text.fold(prefix)
        nodes = self.nodes().where(F.startswith("path", F.lit(p)))
        last = self.suggested(prefix, k).agg(F.count("*").alias("n"), F.max(F.struct((-F.col("weight")).alias("w"), F.col("key").alias("key"))).alias("last"))
        reached = F.struct((-F.col("best_weight")).alias("w"), F.col("path").alias("key")) <= F.col("last")
        return nodes.crossJoin(F.broadcast(last)).where((F.col("n") < k) | reached).agg(F.count("*").alias("visits"))  # one row

    def approximate_visits(self, word: str, most: int) -> DataFrame:
        """Nodes that a search with shared rows of the distance table opens: the root's children, and those whose parent's row has a value within reach."""
        key = text.fold(word)
        rows = self.words.select("key", distance.row_minima(F.col("key"), F.lit(key)).alias("low"))
        opened = rows.select("key", F.explode(F.filter(F.sequence(F.lit(1), F.length("key")), lambda n: (n == 1) | (F.array_max(F.transform(F.slice("low", 1, n - 1), lambda v: v)) <= most))).alias("n"))
        return opened.select(F.substring("key", F.lit(1), F.col("n")).alias("path")).agg(F.countDistinct("path").alias("visits"))
