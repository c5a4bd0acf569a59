import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumetext.functions.text import fold
from lumetext.operators import highlight, ranking, search, statistics
from lumetext.operators.dictionary import Dictionary
from lumetext.operators.index import Index, Preprocessor
from lumetext.sources import files
from lumetext.streaming import incremental

from .test_text import osa

LEXICON = list(files.EXAMPLE_WORDS)


def dictionary(spark, words):
    rows = [w if isinstance(w, tuple) else (w, 1) for w in words]
    return Dictionary.of(spark.createDataFrame(rows, "word string, weight long"))


def forms(rows):
    return [r["form"] for r in rows.collect()]


def test_prefixes(spark):
    d = dictionary(spark, LEXICON)
    assert forms(d.listed("comp")) == ["compilador", "complexidade", "computação", "computacional", "computador"]
    assert [d.find(w).count() for w in ("computador", "computação", "computadores", "comp", "computacao", "COMPUTAÇÃO")] == [1, 1, 0, 0, 0, 1]
    assert (d.listed("xyz").count(), d.listed("").count(), d.listed("comp", 2).count(), d.listed("comp", 0).count()) == (0, 8, 2, 0)
    assert [d.count(p).first()[0] for p in ("comp", "prog", "zzz")] == [5, 1, 0]
    assert d.height().first()[0] == len("processamento")
    assert forms(d.suggested("comp", 5)) == forms(d.listed("comp"))
    assert [d.inserted(w)[1] for w in ("computador", "", "  ", "novo")] == [False, False, False, True]
    accents = dictionary(spark, ["análise", "analise", "anel", "país"])
    assert forms(accents.listed("ana")) == ["analise", "análise"]
    assert forms(accents.forms_of("pais")) == ["país"]
    assert [tuple(r) for r in accents.approximate("pais").collect()][0] == ("país", 0, 1)


def test_weights_and_approximate(spark):
    d = dictionary(spark, [("computador", 10), ("computação", 90), ("compilador", 3)])
    assert [(r["form"], r["weight"]) for r in d.suggested("comp", 3).collect()] == [("computação", 90), ("computador", 10), ("compilador", 3)]
    r = dictionary(spark, [("rede", 5), ("redes", 50), ("rei", 90)])
    assert [tuple(x) for x in r.approximate("redr", 2).collect()] == [("rede", 1, 5), ("rei", 2, 90), ("redes", 2, 50)]
    assert forms(dictionary(spark, ["rede", "roda"]).approximate("rede")) == ["rede"]
    assert dictionary(spark, LEXICON).approximate("  ").count() == 0
    best = dictionary(spark, LEXICON).approximate("compliador").first()
    assert (best["form"], best["distance"]) == ("compilador", 1)


@pytest.mark.parametrize("seed", [11, 23])
def test_random_dictionaries(spark, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choices("abcçã", k=rng.randint(1, 6))): rng.randint(1, 9) for _ in range(60)}
    d = dictionary(spark, list(words.items()))
    for p in ("", "a", "b", "ca", "zz"):
        below = sorted((fold(w), w) for w in words if fold(w).startswith(p))
        assert forms(d.listed(p)) == [w for _, w in below]
        order = sorted(below, key=lambda x: (-words[x[1]], x))
        assert forms(d.suggested(p, 5)) == [w for _, w in order[:5]]
        # a walk in order, and a best-first one, opened node by node
        nodes = {k[:n] for k, _ in below for n in range(len(p), len(k) + 1)}
        last = below[4][0] if len(below) >= 5 else None
        assert d.listing_visits(p, 5).first()[0] == sum(last is None or x <= last for x in nodes)
        best = {x: max(words[w] for k, w in below if k.startswith(x)) for x in nodes}
        end = (-words[order[4][1]], order[4][0]) if len(order) >= 5 else None
        assert d.best_first_visits(p, 5).first()[0] == sum(end is None or (-best[x], x) <= end for x in nodes)
    keys = {fold(w) for w in words}
    paths = {k[:n] for k in keys for n in range(1, len(k) + 1)}
    assert d.node_count().first()[0] == len(paths) + 1
    kept = [p for p in paths if p in keys or len({k[len(p)] for k in keys if k.startswith(p) and len(k) > len(p)}) > 1]
    assert d.compressed_count().first()[0] == len(kept) + 1
    for q in ("abc", "bca"):
        near = sorted((osa(fold(w), q), -words[w], fold(w), w) for w in words)
        assert [r["form"] for r in d.approximate(q, 2, None).collect()] == [x[3] for x in near if x[0] <= 2]
    batch = d.suggested_for_all(spark.createDataFrame([("a",), ("ca",)], "prefix string"), 3)
    assert [r["form"] for r in batch.where("prefix = 'a'").orderBy("rank").collect()] == forms(d.suggested("a", 3))


def index(spark, docs, **options):
    return Index(spark.createDataFrame(docs, "doc string, content string"), Preprocessor(**options))


def test_small_index(spark):
    i = index(spark, [("d1.txt", "algoritmo busca algoritmo"), ("d2.txt", "busca dados"), ("d3.txt", "algoritmos grafos")])
    assert i.size().first()["postings"] == 6
    stem = i.preprocessor.stem_of("algoritmo")
    assert {r["doc"]: r["tf"] for r in i.lookup(stem).collect()} == {"d1.txt": 2, "d3.txt": 1}
    assert [r["doc"] for r in i.lookup("algoritmo", stems=False).collect()] == ["d1.txt"]
    assert [r["doc"] for r in ranking.bm25(i, [stem]).collect()] == ["d1.txt", "d3.txt"]
    assert ranking.bm25(i, ["nada"]).count() == 0
    twice = {r["doc"]: r["score"] for r in ranking.bm25(i, [stem, stem]).collect()}
    assert all(abs(twice[r["doc"]] - 2 * r["score"]) < 1e-9 for r in ranking.bm25(i, [stem]).collect())
    assert i.as_maps().where(F.col("term") == stem).first()["postings"] == {"d1.txt": 2, "d3.txt": 1}
    empty = index(spark, [("a", ""), ("b", None)])
    assert tuple(empty.totals.first()) == (2, 0, 0.0)
    assert ranking.bm25(empty, ["x"]).count() == 0


DOCS = [
    ("algoritmos.txt", "Os algoritmos de busca percorrem estruturas de dados. A execução de um algoritmo de ordenação é rápida."),
    ("redes.txt", "Uma rede liga computadores. As redes usam protocolos, e dados passam por elas."),
    ("banco_dados.txt", "O banco de dados guarda dados. A busca usa a chave primária da tabela."),
]
STOPWORDS = ("os", "de", "a", "um", "e", "uma", "as", "por", "elas", "o", "da")


@pytest.fixture(scope="module")
def engine(spark):
    i = index(spark, DOCS, stopwords=STOPWORDS)
    return search.Engine(i, dictionary(spark, LEXICON))


def test_word_questions(engine):
    assert "redes.txt" in dict(engine.word("rede")["documents"])
    none = engine.word("de")
    assert (none["documents"], none["stem"], none["term"], none["ignored"]) == ([], None, "de", ["de"])
    two = engine.word("busca dados")
    assert two["all"] == ["algoritmos.txt", "banco_dados.txt"]
    assert two["documents"][-1][0] == "redes.txt" and two["coverage"]["redes.txt"] == 1 and two["coverage"]["banco_dados.txt"] == 2
    assert len(engine.word("algoritmo algoritmos")["terms"]) == 1
    wrong = engine.word("busca de algortimo")
    assert wrong["correction"] == "busca de algoritmo" and wrong["documents"] and wrong["all"] == []
    assert engine.word("algortimo")["near"]["algortimo"][0][:2] == ("algoritmo", 1)
    assert engine.word("execucao")["near"]["execucao"][0][:2] == ("execução", 0)
    lost = engine.word("xyzkw")
    assert lost["near"] == {"xyzkw": []} and lost["correction"] is None
    assert engine.word("algoritmo")["terms"][0]["exact_form"] == ["algoritmos.txt"]


def test_prefix_and_sequence_questions(engine):
    p = engine.prefix("algor")
    assert p["terms"] == ["algoritmo", "algoritmos"] and not p["truncated"] and p["by_term"]["algoritmos"] == ["algoritmos.txt"]
    assert engine.prefix("algor", 1)["truncated"]
    assert {d for d, _ in p["ranking"]} == set(p["documents"])
    s = engine.sequence("chave primária")
    assert [r["doc"] for r in s["results"]] == ["banco_dados.txt"] and s["comparisons"] >= sum(len(c) for _, c in DOCS) - 20
    assert engine.sequence("")["results"] == [] and engine.sequence("")["comparisons"] == 0
    assert engine.insert("novidade") and engine.prefix("novid")["by_term"] == {"novidade": []}
    assert [r["type"] for r in statistics.log_summary(engine.query_log()).orderBy("type").collect()][:1] == ["prefix"]


def test_lexicon_questions(engine):
    assert engine.complete("comp", 2)["truncated"] and len(engine.complete("comp")["words"]) == 5
    there = engine.lookup("computacao")
    assert not there["found"] and there["forms"] == ["computação"] and there["continuations"] == 0
    assert engine.lookup("compiladro")["near"][0][:2] == ("compilador", 1)
    assert engine.lookup("comp")["continuations"] == 5
    assert engine.insert_in_lexicon("comp") and not engine.insert_in_lexicon("comp")
    assert engine.complete_last_word("busca de algor", 1) == ["busca de algoritmo"]
    assert [search.parsed_limit(x) for x in ("0", "x", None, "900", "-3")] == [None, 60, 60, 500, 1]


def test_highlight(spark):
    rows = spark.createDataFrame([("Os algoritmos, o Algoritmo.",)], "t string")
    marked = rows.select(highlight.segments(F.col("t"), prefix="algor").alias("m"))
    assert [s["text"] for s in marked.first()["m"] if s["hit"]] == ["algoritmos", "Algoritmo"]
    assert [tuple(r) for r in marked.select(highlight.ranges(F.col("m")).alias("r")).first()["r"]] == [(3, 13), (17, 26)]
    found = rows.select(highlight.sequence_segments(F.col("t"), "algo").alias("m")).first()["m"]
    assert [s["text"] for s in found if s["hit"]] == ["algo", "Algo"] and "".join(s["text"] for s in found) == "Os algoritmos, o Algoritmo."


def excerpt_of(content, hits, size=230):
    """By hand: the text shown for the ranges that light up."""
    if not hits:
        return None
    a = max(0, hits[0][0] - 80)
    if a:
        a = content.find(" ", a) + 1 or a
    b = min(len(content), a + size)
    if b < len(content) and content.rfind(" ", 0, b + 1) > hits[0][1]:
        b = content.rfind(" ", 0, b + 1)
    return ("… " if a else "") + re.sub(r"\s", " ", content[a:b]) + (" …" if b < len(content) else "")


def test_excerpts(spark):
    filler = "palavra outra\n coisa  "
    texts = ["", "nada", "rede", filler * 9 + "rede " + filler * 20, "x" * 300 + "rede" + "y" * 300, "x" * 300 + " rede" + "y" * 300, filler * 30 + "redes", "rede" + "z" * 400]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for mark, pattern in ((lambda c: highlight.segments(c, prefix="rede"), r"(?<![^\W\d_])rede[^\W\d_]*"), (lambda c: highlight.sequence_segments(c, "rede"), "rede")):
        shown = [r[0] for r in rows.select(highlight.excerpt(F.col("t"), mark)).collect()]
        assert [s and "".join(x["text"] for x in s) for s in shown] == [excerpt_of(t, [m.span() for m in re.finditer(pattern, t)]) for t in texts]
        assert all(any(x["hit"] for x in s) for s in shown if s)


def test_composed_spellings(spark):
    d = dictionary(spark, [("a\u0301rvore", 1), ("árvore", 4), ("ÁRVORE ", 2)])
    assert [tuple(r) for r in d.words.collect()] == [("árvore", "arvore", 4)]


def test_reports(engine, spark, tmp_path):
    state, report = engine.state(), engine.report()
    assert state["index"]["documents"] == report["corpus"]["documents"] == len(DOCS) and state["lexicon"]["words"] == engine.lexicon.words.count()
    assert report["questions"]["total"] == len(engine.log) and report["hash"]["keys"] == report["corpus"]["stems"]
    saved = index(spark, DOCS, stopwords=STOPWORDS).saved(str(tmp_path / "bare"), contents=False)
    assert set(saved.seconds) == {"reading", "preprocessing", "dictionary", "index"} and saved.build_seconds == sum(saved.seconds.values()) > 0
    assert search.sequence_hits(saved, "rede").count() == 0 and saved.lookup("dad").count() == 3
    assert statistics.median_ms(lambda: None, 3) >= 0


def test_encodings(spark, tmp_path):
    for name, raw in {"a.txt": "computação\r\nx\ry".encode("cp1252"), "B.TXT": "﻿computação".encode(), "c.Txt": b"x", "d.md": b"no"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["doc"]: r["content"] for r in files.text_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "computação\nx\ny", "B.TXT": "computação", "c.Txt": "x"}
    assert files.text_folder(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "words").write_text("# c\n\n casa \ncasa\nÁrvore\n")
    assert [r[0] for r in files.lexicon(spark, str(tmp_path / "words")).collect()] == ["casa", "casa", "Árvore"]
    assert files.stopwords(spark, str(tmp_path / "words")) == ["arvore", "casa"]
    assert files.stopwords(spark, str(tmp_path / "none")) == [] and files.lexicon(spark, str(tmp_path / "none")).count() == 8


def test_saved_index(spark, tmp_path):
    i = index(spark, DOCS, stopwords=STOPWORDS)
    before = sorted(map(tuple, i.post_stem.collect()))
    again = index(spark, DOCS, stopwords=STOPWORDS).saved(str(tmp_path / "index"))
    assert sorted(map(tuple, again.post_stem.collect())) == before
    assert [tuple(r) for r in ranking.bm25(again, ["dad"]).collect()] == [tuple(r) for r in ranking.bm25(i, ["dad"]).collect()]


def test_stream(spark, tmp_path):
    incoming, out = tmp_path / "in", str(tmp_path / "out")
    docs = spark.createDataFrame(DOCS, "doc string, content string")
    for n in range(3):
        docs.where(F.col("doc") == DOCS[n][0]).write.mode("append").parquet(str(incoming))
        stream = spark.readStream.schema("doc string, content string").parquet(str(incoming))
        incremental.append_postings(stream, out, Preprocessor(STOPWORDS)).awaitTermination()
    whole, kept = index(spark, DOCS, stopwords=STOPWORDS), incremental.stored_index(spark, docs, out, Preprocessor(STOPWORDS))
    assert sorted(map(tuple, kept.post_exact.collect())) == sorted(map(tuple, whole.post_exact.collect()))
    assert sorted(map(tuple, kept.doc_lengths.collect())) == sorted(map(tuple, whole.doc_lengths.collect()))


def test_the_rest_does_not_need_the_corpus_package():
    root = Path(files.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "lumetext.llm" not in p.read_text() and "from ..llm" not in p.read_text()
