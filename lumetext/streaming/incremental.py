"""Documents that arrive over time: postings per new document, appended as they come.

Postings of a document depend on that document alone, so the stream needs no state; frequencies and totals are
aggregated from the stored postings when a question is asked. A batch that is run again replaces its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index, Preprocessor


def append_postings(stream: DataFrame, folder: str, preprocessor: Preprocessor | None = None, available_now: bool = True) -> StreamingQuery:
    """stream: doc, content. Writes post_exact and doc_lengths of each batch below ``folder``."""

    def batch(docs: DataFrame, number: int) -> None:
        index = Index(docs, preprocessor or Preprocessor())
        index.post_exact.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/post_exact/batch={number}")
        index.doc_lengths.write.mode("overwrite").parquet(f"{folder}/doc_lengths/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/progress")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stored_index(spark: SparkSession, docs: DataFrame, folder: str, preprocessor: Preprocessor | None = None) -> Index:
    """The index over all batches so far; of a document that came again, the last one counts."""
    out = Index(docs, preprocessor or Preprocessor())
    lengths = spark.read.parquet(f"{folder}/doc_lengths")
    last = lengths.groupBy("doc").agg(F.max_by("dl", "batch").alias("dl"), F.max("batch").alias("batch"))
    out.__dict__["doc_lengths"] = last.select("doc", "dl")
    out.__dict__["post_exact"] = spark.read.parquet(f"{folder}/post_exact").join(last.select("doc", "batch"), ["doc", "batch"]).select("term", "doc", "tf")
    return out
