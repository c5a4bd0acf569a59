import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumetext.functions import distance, hashing, sequence, stemming, text
from lumetext.operators.index import Preprocessor


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_normalised(spark):
    given_, expected = ["Computação", "ÁÉÍÓÚ", "  Ônibus  ", "algoritmo", "", None], ["computacao", "aeiou", "onibus", "algoritmo", "", None]
    assert column(spark, given_, text.normalised) == expected
    assert column(spark, given_, text.normalised_exact) == expected


def test_normalised_agrees_with_unicode(spark):
    chars = [chr(c) for c in range(0x20, 0x2000) if unicodedata.category(chr(c)) != "Cn"]
    expected = [text.fold("x" + c + "x") for c in chars]
    got = column(spark, ["x" + c + "x" for c in chars], text.normalised)
    plain = [i for i, c in enumerate(chars) if len("".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))) <= 1]
    assert [got[i] for i in plain] == [expected[i] for i in plain]


def test_tokens_and_stopwords(spark):
    assert column(spark, ["versão 3 do x86", "banco-de-dados", "", "   ...   ", "a² Ⅷ"], text.tokens) == [["versão", "do", "x"], ["banco", "de", "dados"], [], [], ["a²", "ⅷ"]]
    kept = column(spark, ["Os Algoritmos de Busca são muito importantes."], lambda c: text.without_stopwords(text.tokens(c), ["os", "de", "sao", "muito"]))
    assert kept == [["algoritmos", "busca", "importantes"]]


def test_query_terms():
    p = Preprocessor(("de",))
    assert p.query_terms("estruturas de x dados²!") == (["estruturas", "dados²"], ["de", "x"])
    assert p.query_tokens("x86 Ⅷ") == ["x", "ⅷ"]


def test_numbers(spark):
    rows = [(98718.0, 0, "98.718"), (1234567.0, 0, "1.234.567"), (24.0, 0, "24"), (46.6, 1, "46,6"), (0.6137, 3, "0,614"), (1234.5, 1, "1.234,5")]
    for value, decimals, expected in rows:
        assert column(spark, [value], lambda c, d=decimals: text.number_text(c, d), "double") == [expected]
    assert column(spark, [28.8e-6, 0.3308, 55.2e-3, 1.5], text.duration_text, "double") == ["28,8 µs", "330,8 ms", "55,2 ms", "1,50 s"]


def test_snippet(spark):
    body = "a" * 60 + " alvo\n\n " + "b" * 60
    assert column(spark, [body], lambda c: text.snippet(c, F.lit(61), F.lit(4))) == ["..." + "a" * 44 + " alvo " + "b" * 42 + "..."]
    assert column(spark, ["um alvo"], lambda c: text.snippet(c, F.lit(3), F.lit(4))) == ["um alvo"]


def test_articles_and_titles(spark):
    assert column(spark, ["x\n== Corpo ==\ny\n\n\n\nz\nReferências\nw"], lambda c: text.cleaned_article(c, ["Referências"])) == ["x\nCorpo\ny\n\nz"]
    assert column(spark, ["banco_dados.txt"], text.title_of) == ["Banco dados"]


PAIRS = [("algoritmo", "algoritmos"), ("dado", "dados"), ("rede", "redes"), ("documento", "documentos"), ("chave", "chaves"), ("buscar", "buscando"), ("buscou", "buscas")]


def test_stems(spark):
    for a, b in PAIRS:
        assert stemming.stem_of(a) == stemming.stem_of(b)
    assert [stemming.stem_of(w) for w in ("informação", "de", "é", "execucao", "execução")] == ["informac", "de", "e", "execuca", "execuc"]
    assert stemming.stem_of("coração") != "corac"
    words = [w for p in PAIRS for w in p] + ["informação", "de", "é", "Execução", "árvores", "mesa", "rainhas", "lentamente", "casarão", "organizado", "falaríamos", "alemães", "autoridade", ""]
    expected = [stemming.stem_of(w) for w in words]
    assert column(spark, words, stemming.stem) == expected
    assert column(spark, words, stemming.stem_expression) == expected


def test_explained(spark):
    steps = column(spark, ["algoritmos"], stemming.explained)[0]
    assert [(s["step"], s["before"], s["after"]) for s in steps] == [("plural", "algoritmos", "algoritmo"), ("vowel", "algoritmo", "algoritm")]


def osa(a, b):
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edit_distance(spark):
    import random

    random.seed(5)
    pairs = [("ca", "abc"), ("kitten", "sitting"), ("", "abc"), ("abcdef", "badcfe"), ("", "")] + [("".join(random.choices("abc", k=random.randint(0, 7))), "".join(random.choices("abc", k=random.randint(0, 7)))) for _ in range(200)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", distance.edit_distance(F.col("a"), F.col("b")).alias("d"), distance.within(F.col("a"), F.col("b"), F.lit(2)).alias("near")).collect()
    for r in rows:
        assert r["d"] == osa(r["a"], r["b"])
        assert r["near"] or r["d"] > 2
    assert osa("ca", "abc") == 3


def kmp(text_, pattern):
    fail, i, j, n, found = sequence.failure_table(pattern), 0, 0, 0, []
    if not pattern or len(pattern) > len(text_):
        return [], 0
    while i < len(text_):
        n += 1
        if text_[i] == pattern[j]:
            i, j = i + 1, j + 1
            if j == len(pattern):
                found.append(i - j)
                j = fail[j - 1]
        elif j:
            j = fail[j - 1]
        else:
            i += 1
    return found, n


@pytest.mark.parametrize(("pattern", "table"), [("ababc", [0, 0, 1, 2, 0]), ("aabaabaaa", [0, 1, 0, 1, 2, 3, 4, 5, 2]), ("abcd", [0] * 4), ("aaaa", [0, 1, 2, 3])])
def test_failure_table(pattern, table):
    assert sequence.failure_table(pattern) == table


def test_sequences(spark):
    import random

    random.seed(1)
    texts = ["xxabcxxabc", "aaaa", "abcdef", "abc", "ab", "", "a.b\\Ec", "x\nab\nab"] + ["".join(random.choices("abc", k=random.randint(0, 30))) for _ in range(60)]
    for pattern in ("abc", "aa", "xyz", "", "abcdef", "a", "aba", ".b\\Ec", "b\na"):
        at = column(spark, texts, lambda c, p=pattern: sequence.occurrences(c, p))
        expected = [[i for i in range(len(t) - len(pattern) + 1) if pattern and t[i:].startswith(pattern)] for t in texts]
        assert at == expected, pattern
        assert column(spark, texts, lambda c, p=pattern: sequence.occurrence_count(c, p)) == list(map(len, expected))
        assert column(spark, texts, lambda c, p=pattern: sequence.occurrences(c, p, first_only=True)) == [e[:1] for e in expected]
        assert column(spark, texts, lambda c, p=pattern: sequence.kmp_comparisons(c, p)) == [kmp(t, pattern)[1] for t in texts]
        naive = [sum(next((k + 1 for k in range(len(pattern)) if t[i + k] != pattern[k]), len(pattern)) for i in range(len(t) - len(pattern) + 1)) if pattern else 0 for t in texts]
        assert column(spark, texts, lambda c, p=pattern: sequence.naive_comparisons(c, p)) == naive


def test_trace(spark):
    rows = sequence.kmp_trace()(F.lit("aab"), F.lit("ab"), F.lit(100)).collect()
    assert [tuple(r) for r in rows] == [(0, 0, True, 0, "compare"), (1, 1, False, 0, "compare"), (1, 0, False, 1, "slide"), (1, 0, True, 1, "compare"), (2, 1, True, 1, "compare"), (2, 1, True, 1, "found")]
    assert len(sequence.kmp_trace()(F.lit("a" * 50), F.lit("b"), F.lit(7)).collect()) == 8
    texts = ["aab", "", None, "abab", "b"]
    assert column(spark, texts, lambda c: F.size(F.filter(sequence.kmp_trace_of(c, "ab"), lambda x: x["event"] == "compare"))) == [kmp(t or "", "ab")[1] for t in texts]


def test_names_and_prefixes(spark):
    assert column(spark, ["Ação", "ﬁle ²", None], text.safe_name) == ["Acao", "file 2", None]
    assert column(spark, ["rede", "rei", "", "x"], lambda c: text.common_prefix(c, F.lit("redes"))) == [4, 2, 0, 0]


def test_hash_map(spark):
    table = spark.createDataFrame([("a", 1)], "key string, value int")
    table, new = hashing.put(table, "b", 2)
    again, known = hashing.put(table, "a", 3)
    assert new and not known and {(r["key"], r["value"]) for r in again.collect()} == {("a", 3), ("b", 2)}
    assert hashing.found(again, "a").first()[0] == 3 and hashing.found(again, "c").count() == 0
    sweep = {r["capacity"]: r for r in hashing.capacity_sweep(again, [1, 64]).collect()}
    assert (sweep[1]["collisions"], sweep[1]["longest"], sweep[64]["collisions"]) == (1, 2, 0)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab", min_size=1, max_size=8))
def test_failure_table_is_the_longest_border(pattern):
    borders = [max(k for k in range(i) if pattern[:k] == pattern[i - k : i]) for i in range(1, len(pattern) + 1)]
    assert sequence.failure_table(pattern) == borders


def test_hash_table(spark):
    def h(k):
        v = 0
        for c in k:
            v = (v * 31 + ord(c)) % 2**32
        return v

    words = ["computação", "", "a", "chave7", "日本"]
    assert column(spark, words, hashing.polynomial_hash) == [h(w) for w in words]
    assert [hashing.capacity_for(n, 8) for n in (0, 6, 7, 200, 500)] == [8, 8, 16, 512, 1024]
    keys = spark.createDataFrame([(f"chave{i}",) for i in range(200)], "key string")
    s = hashing.table_statistics(keys, 64).first()
    counts = {}
    for i in range(200):
        counts[h(f"chave{i}") % 64] = counts.get(h(f"chave{i}") % 64, 0) + 1
    assert (s["keys"], s["occupied"], s["collisions"], s["longest"]) == (200, len(counts), 200 - len(counts), max(counts.values()))
    assert sum(r["chain"] * r["buckets"] for r in hashing.chain_histogram(keys, 64).collect()) == 200
    assert sum(r["buckets"] for r in hashing.chain_histogram(keys, 64).collect()) == 64
    assert hashing.table_statistics(keys.limit(0), 8).first()["mean_chain"] == 0.0
