import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline

from .test_operators import brute_repeats, check_packing, edited, prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rng = random.Random(21)
    passage = prose(rng, 60, 3000)
    items = [(i, prose(rng, 30, 3000)) for i in range(10)]
    base = [prose(rng, 150, 3000) for _ in range(40)]
    rows = [(i, t + (" " + passage if i % 10 == 1 else "") + (" " + items[i][1] if i < 3 else "")) for i, t in enumerate(base)]
    rows += [(100 + i, edited(rng, rows[i][1], 0.03)) for i in range(10)] + [(200, "1234 !!"), (201, None), (202, rows[5][1]), (202, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "row": F.lit(3)})
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        if name != "packing":
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert docs.columns == columns
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(kept[0]) == {*range(40), *range(100, 110), 202}
    assert set(kept[1]) == set(range(40))
    expected = {d: n - gone for d, n, gone, _ in brute_repeats(list(kept[1].items()), 35)}
    assert {d: len(t.split()) for d, t in kept[2].items()} == expected and sum(expected.values()) < 40 * 150 + 4 * 60 + 3 * 30
    assert set(kept[3]) == set(range(3, 40))
    check_packing(docs.collect(), sorted(kept[3].items()))


def test_run(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    assert {r["doc_id"] for r in rows} == set(range(3, 40))


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 11)} == {x.split("_")[0] + "_" for x in names if x.startswith("op")}
    assert "pipeline" not in __spark_entry__.oracle_sql()
