"""Document fingerprints: bottom-k sketches of the hashes of word shingles, in built-in functions only.

A sketch is the ascending array of the ``k`` least distinct hashes of the shingles of five words; a text of one to
four words has one shingle, the whole; a text without words has none. Sketches of parts merge into the sketch of the
whole (``merged``), and two sketches estimate resemblance, containment and the number of distinct shingles. They are
exact for texts of at most ``k`` distinct shingles.

``fingerprint_edits`` also needs the next document in descending doc_id order. Documents go to blocks of about
``block`` neighbouring ids, evenly within each of ``SEGMENTS`` quantiles of the ids, so that ids far from all others
don't widen the blocks of these. One exchange of the texts brings neighbours together; only the first document of a
block is sent on, to the end of the block before. Null text: empty. Rows of one doc_id follow in order of their
text; rows without doc_id come last. A table of one document is its own next one. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_and_text, partitions

K = 256
WORDS = 5
SEGMENTS = 256


def _bind(value: Column, f) -> Column:
    """f(value) with the value computed once: within a lambda, a plain column expression is computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    def hashed(w: Column) -> Column:
        each = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, words)]))
        return F.slice(F.sort_array(F.array_distinct(F.slice(each, 1, F.greatest(F.size(w) - (words - 1), F.lit(1))))), 1, k)

    return _bind(F.filter(F.split(text, r"\s+"), lambda x: x != ""), hashed)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Shared part of both shingle sets; two empty sets are alike."""
    return _bind(merged(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below ``k``, else from the place of the k-th least of hashes spread evenly."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b has too."""
    union, both = distinct_shingles(merged(a, b, k), k), resemblance(a, b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both * union / distinct_shingles(a, k)))


def printed(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.hex(h)), ".")


def _following(blocks: DataFrame, fan: int = 65_536) -> DataFrame:
    """(block, following): the next lower block, after the lowest the highest; by groups of blocks and then over the groups."""
    groups = blocks.withColumn("g", F.expr(f"block div {fan}"))
    inner = groups.select("block", "g", F.lead("block").over(Window.partitionBy("g").orderBy(F.desc("block"))).alias("inner"))
    tops = groups.groupBy("g").agg(F.max("block").alias("top"))
    order = Window.orderBy(F.desc("g"))
    ring = tops.select("g", F.coalesce(F.lead("top").over(order), F.first("top").over(order)).alias("outer"))
    return inner.join(ring, "g").select("block", F.coalesce("inner", "outer").alias("following"))


def blocks(docs: DataFrame, block: int) -> Column:
    """The block of a doc_id: a number that never falls as the ids rise; rows without doc_id have the least."""
    low, high, n, cuts = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id"), F.percentile_approx("doc_id", [k / SEGMENTS for k in range(1, SEGMENTS)], 100 * SEGMENTS)).first()
    none = F.lit(-(2**62))
    if not n:
        return none
    first = sorted({low, *(c + 1 for c in cuts if c < high)})
    ends = [*first[1:], high + 1]
    widths = [max(1, (e - a) * block * len(first) // n) for a, e in zip(first, ends, strict=True)]
    segment = F.size(F.filter(F.array(*map(F.lit, first)), lambda a: a <= F.col("doc_id")))
    of = lambda numbers: F.get(F.array(*[F.lit(x).cast("long") for x in numbers]), segment - 1)
    return F.when(F.col("doc_id").isNull(), none).otherwise(segment.cast("long") * (1 << 40) + F.floor((F.col("doc_id") - of(first)) / of(widths)))


def fingerprint_edits(docs: DataFrame, k: int = K, block: int = 64) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    docs = id_and_text(docs)
    number = blocks(docs, block)
    dealt = docs.withColumn("block", number).repartition(max(partitions(spark), 8), "block")
    order = Window.partitionBy("block").orderBy(F.desc_nulls_last("doc_id"), F.desc("text"))
    heads = dealt.groupBy("block").agg(F.max(F.struct("doc_id", "text")).alias("head")).select(F.col("block").alias("following"), F.col("head.text").alias("head_text"))
    after = _following(docs.select(number.alias("block")).distinct()).join(heads, "following").select("block", "head_text").withColumn("head_sketch", sketch(F.col("head_text"), k))
    own = dealt.withColumn("sketch", sketch(F.col("text"), k))
    both = own.withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)}).join(after, "block")
    n_chars, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n_chars - third), F.substring(F.coalesce("next_text", "head_text"), F.lit(1), third))
    rows = both.select("doc_id", n_chars.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", F.coalesce("next_sketch", "head_sketch").alias("next_sketch"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), k))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
