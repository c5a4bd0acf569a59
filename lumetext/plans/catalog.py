"""Every query of the engine by name, over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import distance, hashing, sequence, stemming, text
from ..operators import highlight, ranking, search, statistics
from ..operators.dictionary import Dictionary
from ..operators.index import Index, Preprocessor

STOPWORDS = ("the", "of", "and", "to", "in", "de", "la", "le", "les", "des", "el", "que", "der", "die", "und", "es")
TERMS = ["ention", "with", "eau", "ing"]
STEM_TERMS = ["ention", "estion", "eau"]
PREFIX, SEQUENCE, MISSPELT = "ent", "anan", "enton"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _index(spark: SparkSession, sf_dir: str, stemmed: bool = True) -> Index:
    return Index.of(_docs(spark, sf_dir), "doc_id", "text", Preprocessor(STOPWORDS, stemmed))


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_RAW = r"raw AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+')) AS term FROM documents)"
_TOK = f"{_RAW}, tok AS (SELECT doc_id, term FROM raw WHERE length(term) >= 2 AND strip_accents(term) NOT IN ({_list(STOPWORDS)}))"
_POST = f"{_TOK}, post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL)"
_VOCAB = f"{_POST}, vocab AS (SELECT term AS form, strip_accents(term) AS key, CAST(sum(tf) AS BIGINT) AS weight FROM post GROUP BY term)"
_LEN = "dl AS (SELECT d.doc_id, count(t.term) AS dl FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY d.doc_id), tot AS (SELECT count(*) AS n_docs, CAST(sum(dl) AS BIGINT) AS total_tokens, sum(dl) / count(*) AS avgdl FROM dl)"
_STEMS = f"{_VOCAB}, {stemming.stem_sql('vocab', 'form')}, spost AS (SELECT stem AS term, doc_id, CAST(sum(tf) AS BIGINT) AS tf FROM post JOIN stems ON post.term = stems.word GROUP BY ALL)"


def _bm25_sql(post: str, terms: list[str]) -> str:
    return f"sc AS (SELECT p.doc_id, sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM {post} WHERE term IN ({_list(terms)})) p JOIN dl USING (doc_id), tot GROUP BY p.doc_id)"


# Text


@_query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{Nl}\\p{No}]+')) AS BIGINT) AS n FROM documents")
def tokens_per_doc(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n"))


@_query(f"WITH {_TOK} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM raw) AS raw_tokens, (SELECT count(*) FROM tok) AS kept_tokens, round(1 - (SELECT count(*) FROM tok) / (SELECT count(*) FROM raw), 9) AS reduction")
def raw_vs_kept_tokens(spark, sf_dir):
    return statistics.corpus_figures(_index(spark, sf_dir)).withColumn("reduction", F.round("reduction", 9))


@_query("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}_\\s]|_', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM documents")
def without_punctuation(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.trim(F.regexp_replace(text.without_punctuation(F.col("text")), r"(?U)\s+", " ")).alias("plain"))


@_query(f"WITH {_RAW} SELECT DISTINCT term AS form, strip_accents(term) AS key FROM raw")
def normalized_forms(spark, sf_dir):
    return _index(spark, sf_dir).raw_tokens.select(F.col("term").alias("form")).distinct().select("form", text.normalised(F.col("form")).alias("key"))


@_query(f"WITH {_VOCAB} SELECT key, count(*) AS forms, min(form) AS first_form, max(form) AS last_form FROM vocab GROUP BY key HAVING count(*) > 1")
def same_key_forms(spark, sf_dir):
    return _index(spark, sf_dir).vocabulary.groupBy("key").agg(F.count("*").alias("forms"), F.min("form").alias("first_form"), F.max("form").alias("last_form")).where("forms > 1")


@_query("SELECT o_orderkey, translate(format('{:,.2f}', CAST(o_totalprice AS DOUBLE)), ',.', '.,') AS price, translate(format('{:,.0f}', CAST(o_orderkey AS DOUBLE)), ',.', '.,') AS number FROM orders")
def number_texts(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", text.number_text(F.col("o_totalprice").cast("double"), 2).alias("price"), text.number_text(F.col("o_orderkey").cast("double")).alias("number"))


@_query("SELECT doc_id, translate(format('{:,.1f}', octet_length(encode(text)) / 1024), ',.', '.,') || ' KB' AS size FROM documents WHERE text IS NOT NULL")
def kilobytes(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", text.kilobytes_text(F.octet_length("text")).alias("size"))


@_query("SELECT DISTINCT l_discount AS share, translate(format('{:,.1f}', CAST(l_discount AS DOUBLE) * 100), ',.', '.,') || '%' AS written FROM lineitem")
def percentages(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_discount").alias("share")).distinct()
    return lines.select("share", text.percent_text(F.col("share").cast("double")).alias("written"))


@_query("SELECT k, CASE WHEN seconds >= 1 THEN translate(format('{:,.2f}', seconds), ',.', '.,') || ' s' WHEN seconds >= 0.001 THEN translate(format('{:,.1f}', seconds * 1000), ',.', '.,') || ' ms' ELSE translate(format('{:,.1f}', seconds * 1000000), ',.', '.,') || ' µs' END AS written FROM (SELECT n_nationkey AS k, CAST(7 AS DOUBLE) * pow(CAST(10 AS DOUBLE), n_nationkey - 7) AS seconds FROM nation WHERE n_nationkey < 10)")
def durations(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey < 10").select(F.col("n_nationkey").alias("k"))
    return keys.withColumn("seconds", F.lit(7.0) * F.pow(F.lit(10.0), F.col("k") - 7)).select("k", text.duration_text(F.col("seconds")).alias("written"))


_NAME = "replace(lower(n_name), ' ', '_') || '_corpus.v2.txt'"


@_query(f"SELECT n_nationkey AS k, upper(substr(t, 1, 1)) || lower(substr(t, 2)) AS title FROM (SELECT n_nationkey, replace(regexp_replace({_NAME}, '\\.[^.]*$', ''), '_', ' ') AS t FROM nation)")
def file_titles(spark, sf_dir):
    name = F.concat(F.translate(F.lower("n_name"), " ", "_"), F.lit("_corpus.v2.txt"))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"), text.title_of(name).alias("title"))


@_query("SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) >= 50 AS long_enough FROM documents WHERE text IS NOT NULL")
def long_enough_articles(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", text.has_words(F.col("text"), 50).alias("long_enough"))


QUESTION = "The Ention of LÉS eau, a with 42 É"


@_query(f"SELECT CAST(row_number() OVER () AS INT) AS place, term, length(term) >= 2 AND strip_accents(term) NOT IN ({_list(STOPWORDS)}) AS searched FROM (SELECT unnest(regexp_extract_all(lower('{QUESTION}'), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+')) AS term)")
def question_terms(spark, sf_dir):
    own = Preprocessor(STOPWORDS)
    terms, _ = own.query_terms(QUESTION)
    return spark.createDataFrame([(i, t, t in terms) for i, t in enumerate(own.query_tokens(QUESTION), 1)], "place int, term string, searched boolean")


@_query(f"WITH {_VOCAB} SELECT form, weight FROM vocab WHERE key = 'eau'")
def forms_of_word(spark, sf_dir):
    return Dictionary(_index(spark, sf_dir).vocabulary).forms_of("ÉAU").select("form", "weight")


@_query(f"WITH {_VOCAB} SELECT form, key, weight FROM vocab WHERE form = 'eau'")
def word_in_dictionary(spark, sf_dir):
    return Dictionary(_index(spark, sf_dir).vocabulary).find(" EAU ")


@_query(f"WITH {_VOCAB} SELECT greatest(weight, 1) AS weight, form FROM (SELECT form, weight FROM vocab UNION ALL SELECT 'palavranova', 5)")
def dictionary_with_insertions(spark, sf_dir):
    own = Dictionary(_index(spark, sf_dir).vocabulary)
    known, _ = own.inserted("eau", 1)  # keeps its greater weight
    return known.inserted("PalavraNova", 5)[0].words.select("weight", "form")


@_query(f"WITH {_VOCAB}, k AS (SELECT DISTINCT key FROM vocab) SELECT CAST(sum(length(key)) AS BIGINT) AS characters, count(*) AS keys, max(length(key)) AS longest FROM k")
def dictionary_characters(spark, sf_dir):
    return statistics.character_figures(_index(spark, sf_dir).vocabulary)


# Index


@_query(f"WITH {_VOCAB} SELECT form, key, weight FROM vocab")
def vocab_frequency(spark, sf_dir):
    return _index(spark, sf_dir).vocabulary


@_query(f"WITH {_POST} SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS df FROM post GROUP BY term ORDER BY occurrences DESC, term LIMIT 12")
def top_terms(spark, sf_dir):
    return _index(spark, sf_dir).most_frequent(12, stems=False)


@_query(f"WITH {_POST} SELECT term, doc_id, tf FROM post")
def postings_exact(spark, sf_dir):
    return _index(spark, sf_dir).post_exact.withColumnRenamed("doc", "doc_id")


@_query(f"WITH {_POST} SELECT term, count(*) AS df FROM post GROUP BY term")
def doc_freq(spark, sf_dir):
    return _index(spark, sf_dir).document_frequency(stems=False)


@_query(f"WITH {_TOK}, {_LEN} SELECT doc_id, dl FROM dl")
def doc_length(spark, sf_dir):
    return _index(spark, sf_dir).doc_lengths.withColumnRenamed("doc", "doc_id")


@_query(f"WITH {_POST}, {_LEN} SELECT n_docs, total_tokens, round(avgdl, 6) AS avgdl, (SELECT count(DISTINCT term) FROM post) AS terms, (SELECT count(*) FROM post) AS postings FROM tot")
def index_stats(spark, sf_dir):
    i = _index(spark, sf_dir)
    return i.totals.withColumn("avgdl", F.round("avgdl", 6)).crossJoin(F.broadcast(i.size(stems=False)))  # one row


@_query(f"WITH {_STEMS} SELECT word, stem FROM stems")
def rslp_stem(spark, sf_dir):
    return _index(spark, sf_dir).vocabulary_stems.select(F.col("term").alias("word"), "stem")


@_query(f"WITH {_STEMS} SELECT term, doc_id, tf FROM spost")
def stem_postings(spark, sf_dir):
    return _index(spark, sf_dir).post_stem.withColumnRenamed("doc", "doc_id")


@_query(f"WITH {_STEMS} SELECT count(*) AS forms, count(DISTINCT stem) AS stems, round(count(*) / count(DISTINCT stem), 9) AS forms_per_stem FROM stems")
def stem_effect(spark, sf_dir):
    return statistics.stemming_effect(_index(spark, sf_dir)).withColumn("forms_per_stem", F.round("forms_per_stem", 9))


@_query(f"WITH {_STEMS}, asked AS (SELECT word AS term, stem FROM stems WHERE word IN ({_list(TERMS)})) SELECT a.term, (SELECT count(*) FROM post p WHERE p.term = a.term) AS exact, (SELECT count(*) FROM spost p WHERE p.term = a.stem) AS stemmed, (SELECT count(*) FROM spost p WHERE p.term = a.stem) - (SELECT count(*) FROM post p WHERE p.term = a.term) AS gain FROM asked a")
def stem_coverage_gain(spark, sf_dir):
    i = _index(spark, sf_dir)
    return statistics.coverage_gain(i, TERMS).join(i.vocabulary.select(F.col("form").alias("term")), "term", "left_semi")


@_query("SELECT d.doc_id, octet_length(encode(text)) AS bytes, (SELECT count(*) FROM (SELECT unnest(regexp_extract_all(lower(d.text), '[\\p{L}\\p{Nl}\\p{No}]+')) AS t) WHERE length(t) >= 2 AND strip_accents(t) NOT IN (" + _list(STOPWORDS) + ")) AS tokens FROM documents d")
def doc_summary(spark, sf_dir):
    files = _docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.octet_length("text").cast("long").alias("bytes"))
    return statistics.document_summary(files, _index(spark, sf_dir)).withColumnRenamed("doc", "doc_id")


# Ranking


def _scores(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@_query(f"WITH {_POST}, {_LEN}, {_bm25_sql('post', TERMS[:1])} SELECT doc_id, round(score, 6) AS score FROM sc")
def bm25_single(spark, sf_dir):
    return _scores(ranking.bm25(_index(spark, sf_dir), TERMS[:1], stems=False))


@_query(f"WITH {_POST}, {_LEN}, {_bm25_sql('post', TERMS)} SELECT doc_id, round(score, 6) AS score FROM sc")
def bm25_multi(spark, sf_dir):
    return _scores(ranking.bm25(_index(spark, sf_dir), TERMS, stems=False))


@_query(f"WITH {_POST}, {_LEN} SELECT p.doc_id, round(sum((1 + log10(tf)) * log10(n_docs / df)), 6) AS score FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM post WHERE term IN ({_list(TERMS)})) p, tot GROUP BY p.doc_id")
def tfidf_multi(spark, sf_dir):
    return _scores(ranking.tfidf(_index(spark, sf_dir), TERMS, stems=False))


@_query(f"WITH {_POST}, {_LEN}, {_bm25_sql('post', TERMS)}, ti AS (SELECT p.doc_id, sum((1 + log10(tf)) * log10(n_docs / df)) AS score FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM post WHERE term IN ({_list(TERMS)})) p, tot GROUP BY p.doc_id), a AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id FROM sc), b AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id FROM ti) SELECT a.rank, a.doc_id AS bm25_doc, da.dl AS bm25_length, b.doc_id AS tfidf_doc, db.dl AS tfidf_length FROM a JOIN b USING (rank) JOIN dl da ON da.doc_id = a.doc_id JOIN dl db ON db.doc_id = b.doc_id WHERE a.rank <= 5")
def rank_compare(spark, sf_dir):
    return ranking.compared(_index(spark, sf_dir), TERMS, 5, stems=False)


# Questions by words


def _stems(terms=STEM_TERMS) -> list[str]:
    return list(dict.fromkeys(stemming.stem_of(t) for t in terms))


@_query(f"WITH {_STEMS} SELECT doc_id, count(*) AS coverage, CAST(sum(tf) AS BIGINT) AS frequency FROM spost WHERE term IN ({_list(_stems())}) GROUP BY doc_id")
def word_any_coverage(spark, sf_dir):
    return search.word_hits(_index(spark, sf_dir), _stems()).select(F.col("doc").alias("doc_id"), "coverage", "frequency")


@_query(f"WITH {_STEMS} SELECT doc_id FROM spost WHERE term IN ({_list(_stems()[:2])}) GROUP BY doc_id HAVING count(*) = {len(_stems()[:2])}")
def word_all_terms(spark, sf_dir):
    return search.docs_with_all(_index(spark, sf_dir), _stems()[:2]).withColumnRenamed("doc", "doc_id")


@_query(f"WITH {_STEMS}, {_LEN}, {_bm25_sql('spost', _stems())}, c AS (SELECT doc_id, count(*) AS coverage FROM spost WHERE term IN ({_list(_stems())}) GROUP BY doc_id) SELECT doc_id, coverage, round(score, 6) AS score FROM c JOIN sc USING (doc_id)")
def word_ranked(spark, sf_dir):
    return search.word_hits(_index(spark, sf_dir), _stems()).select(F.col("doc").alias("doc_id"), "coverage", F.round("score", 6).alias("score"))


@_query(f"WITH {_STEMS} SELECT s.doc_id, count(e.doc_id) > 0 AS exact FROM spost s LEFT JOIN post e ON e.doc_id = s.doc_id AND e.term = 'eau' WHERE s.term = '{stemming.stem_of('eau')}' GROUP BY s.doc_id")
def exact_vs_variant_docs(spark, sf_dir):
    i = _index(spark, sf_dir)
    exact = search.docs_with_form(i, "eau").withColumn("hit", F.lit(True))
    return i.lookup(stemming.stem_of("eau")).join(exact, "doc", "left").select(F.col("doc").alias("doc_id"), F.coalesce("hit", F.lit(False)).alias("exact"))


@_query(f"WITH {_VOCAB} SELECT form, 1 AS distance, weight FROM vocab WHERE damerau_levenshtein(key, '{MISSPELT}') = 1")
def fuzzy_terms(spark, sf_dir):
    return Dictionary(_index(spark, sf_dir).vocabulary).approximate(MISSPELT, most=1, limit=None).where("distance = 1")


def _osa_sql(word: str, most: int | None = None) -> str:
    """``osa``: for the first i letters of each key the row of the table of distances from the beginnings of a word, and the greatest of the least values so far."""
    m, w = len(word), _list(word)
    base = f"list_transform(range(0, {m} + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(line[j] + CASE WHEN substr(key, i + 1, 1) = ([{w}])[j] THEN 0 ELSE 1 END, line[j + 1] + 1, CASE WHEN i >= 1 AND j >= 2 AND substr(key, i + 1, 1) = ([{w}])[j - 1] AND substr(key, i, 1) = ([{w}])[j] THEN before[j - 1] + 1 ELSE 1000 END) END)"
    keys = "SELECT DISTINCT key FROM vocab" + (f" WHERE abs(length(key) - {m}) <= {most}" if most is not None else "")
    return (
        f"osa AS (SELECT key, 0 AS i, range(0, {m} + 1) AS line, range(0, {m} + 1) AS before, CAST(0 AS BIGINT) AS worst FROM ({keys}) UNION ALL "
        f"SELECT key, i + 1, next, line, greatest(worst, list_min(next)) FROM (SELECT *, list_transform(range(0, {m} + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda k: base[k + 1] + j - k))) AS next FROM (SELECT *, {base} AS base FROM osa WHERE i < length(key)))), "
        f"near AS (SELECT form, v.key, weight, CAST(line[{m} + 1] AS INT) AS distance FROM osa JOIN vocab v ON v.key = osa.key WHERE i = length(osa.key))"
    )


@_query(f"WITH RECURSIVE {_VOCAB}, {_osa_sql(MISSPELT, 2)} SELECT form, distance, weight FROM near WHERE distance <= 2")
def fuzzy_terms_two_edits(spark, sf_dir):
    return Dictionary(_index(spark, sf_dir).vocabulary).approximate(MISSPELT, limit=None)


@_query(f"WITH RECURSIVE {_VOCAB}, {_osa_sql(MISSPELT, 2)} SELECT form, distance, weight FROM near WHERE distance <= 2 AND form <> '{MISSPELT}' ORDER BY distance, weight DESC, key, form LIMIT 5")
def did_you_mean(spark, sf_dir):
    i = _index(spark, sf_dir)
    words, _ = Dictionary(i.vocabulary).inserted("entonw", 10**9)  # leads to no document, so it is no correction
    return search.corrections(i, words, MISSPELT)


@_query(f"WITH RECURSIVE {_VOCAB}, {_osa_sql('thhex', 2)} SELECT 'ention of ' || coalesce((SELECT form FROM near WHERE distance <= 2 ORDER BY distance, weight DESC, key, form LIMIT 1), 'thhex') AS corrected")
def corrected_query(spark, sf_dir):
    answer = search.Engine(_index(spark, sf_dir)).word("ention of thhex")
    return spark.createDataFrame([(answer["correction"] or answer["query"],)], "corrected string")


@_query(f"WITH RECURSIVE {_VOCAB}, {_osa_sql(MISSPELT)} SELECT count(DISTINCT substr(key, 1, i + 1)) AS visits FROM osa WHERE i < length(key) AND worst <= 1")
def approximate_visits(spark, sf_dir):
    return Dictionary(_index(spark, sf_dir).vocabulary).approximate_visits(MISSPELT, 1)


_OSA = [("algortimo", "algoritmo"), ("hahs", "hash"), ("", "abc"), ("kitten", "sitting"), ("dados", "dados")]


@_query("SELECT * FROM (VALUES ('algortimo', 'algoritmo', 1), ('hahs', 'hash', 1), ('', 'abc', 3), ('kitten', 'sitting', 3), ('dados', 'dados', 0)) t(a, b, distance)")
def edit_distances(spark, sf_dir):
    return spark.createDataFrame(_OSA, "a string, b string").select("a", "b", distance.edit_distance(F.col("a"), F.col("b")).alias("distance"))


@_query(f"WITH {_VOCAB} SELECT DISTINCT key, list_max(list_filter(range(0, least(length(key), 8) + 1), lambda n: substr(key, 1, CAST(n AS INT)) = substr('entonces', 1, CAST(n AS INT)))) AS shared FROM vocab")
def common_prefixes(spark, sf_dir):
    keys = _index(spark, sf_dir).vocabulary.select("key").distinct()
    return keys.select("key", text.common_prefix(F.col("key"), F.lit("entonces")).cast("long").alias("shared"))


# Prefixes


@_query(f"WITH {_VOCAB} SELECT form, key, weight FROM vocab WHERE starts_with(key, '{PREFIX}')")
def prefix_terms(spark, sf_dir):
    return Dictionary(_index(spark, sf_dir).vocabulary).listed(PREFIX)


@_query(f"WITH {_VOCAB} SELECT count(*) AS words FROM vocab WHERE starts_with(key, '{PREFIX}')")
def prefix_count(spark, sf_dir):
    return Dictionary(_index(spark, sf_dir).vocabulary).count(PREFIX)


@_query(f"WITH {_VOCAB} SELECT form, key, weight FROM vocab WHERE starts_with(key, '{PREFIX}') ORDER BY key, form LIMIT 20")
def prefix_limit(spark, sf_dir):
    return Dictionary(_index(spark, sf_dir).vocabulary).listed(PREFIX, 20)


@_query(f"WITH {_VOCAB} SELECT form, key, weight FROM vocab WHERE starts_with(key, '{PREFIX}') ORDER BY key, form LIMIT 10 OFFSET 10")
def prefix_page(spark, sf_dir):
    return search.page(Dictionary(_index(spark, sf_dir).vocabulary).listed(PREFIX), 1, 10)


@_query(f"WITH {_VOCAB} SELECT form, key, weight FROM vocab WHERE starts_with(key, '{PREFIX}') ORDER BY weight DESC, key, form LIMIT 10")
def prefix_topk(spark, sf_dir):
    return Dictionary(_index(spark, sf_dir).vocabulary).suggested(PREFIX, 10)


@_query(f"WITH {_VOCAB}, p AS (SELECT DISTINCT substr(key, 1, 2) AS prefix FROM vocab WHERE length(key) >= 2), r AS (SELECT prefix, CAST(row_number() OVER (PARTITION BY prefix ORDER BY weight DESC, key, form) AS INT) AS rank, form, weight FROM p JOIN vocab ON starts_with(key, prefix)) SELECT * FROM r WHERE rank <= 3")
def prefix_topk_batch(spark, sf_dir):
    words = _index(spark, sf_dir).vocabulary
    return Dictionary(words).suggested_for_all(words.where("length(key) >= 2").select(F.substring("key", 1, 2).alias("prefix")).distinct(), 3)


@_query(f"WITH {_VOCAB}, w AS (SELECT form FROM vocab WHERE starts_with(key, '{PREFIX}') ORDER BY key, form LIMIT 50) SELECT w.form AS term, p.doc_id FROM w JOIN post p ON p.term = w.form")
def prefix_docs(spark, sf_dir):
    return search.prefix_terms(_index(spark, sf_dir), PREFIX).withColumnRenamed("doc", "doc_id")


@_query(f"WITH {_VOCAB}, w AS (SELECT form FROM vocab WHERE starts_with(key, '{PREFIX}') ORDER BY key, form LIMIT 50) SELECT p.doc_id, count(DISTINCT w.form) AS terms FROM w JOIN post p ON p.term = w.form GROUP BY p.doc_id")
def prefix_terms_per_doc(spark, sf_dir):
    return search.prefix_terms_per_doc(_index(spark, sf_dir), PREFIX).withColumnRenamed("doc", "doc_id")


@_query(f"WITH {_VOCAB}, {_LEN}, w AS (SELECT form FROM vocab WHERE starts_with(key, '{PREFIX}') ORDER BY key, form LIMIT 50), sc AS (SELECT p.doc_id, sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM post WHERE term IN (SELECT form FROM w)) p JOIN dl USING (doc_id), tot GROUP BY p.doc_id) SELECT doc_id, round(score, 6) AS score FROM sc")
def prefix_bm25(spark, sf_dir):
    i = _index(spark, sf_dir)
    terms = [r["form"] for r in Dictionary(i.vocabulary).listed(PREFIX, 50).collect()]
    return _scores(ranking.bm25(i, terms, stems=False))


_PATHS = f"{_VOCAB}, paths AS (SELECT key, weight, substr(key, 1, CAST(n AS INT)) AS path FROM (SELECT key, weight, unnest(range(0, length(key) + 1)) AS n FROM vocab))"


@_query(f"WITH {_PATHS} SELECT count(DISTINCT path) AS nodes FROM paths")
def trie_nodes(spark, sf_dir):
    return Dictionary(_index(spark, sf_dir).vocabulary).node_count()


@_query(f"WITH {_PATHS} SELECT path, bool_or(path = key) AS is_end, count(*) AS words_below, max(weight) AS best_weight FROM paths GROUP BY path")
def trie_node_aggregates(spark, sf_dir):
    return Dictionary(_index(spark, sf_dir).vocabulary).nodes()


@_query(f"WITH {_VOCAB} SELECT max(length(key)) AS height FROM vocab")
def trie_height(spark, sf_dir):
    return Dictionary(_index(spark, sf_dir).vocabulary).height().select(F.col("height").cast("long").alias("height"))


@_query(f"WITH {_PATHS} SELECT count(*) + 1 AS nodes FROM (SELECT path FROM paths WHERE path <> '' GROUP BY path HAVING bool_or(path = key) OR count(DISTINCT nullif(substr(key, length(path) + 1, 1), '')) >= 2)")
def patricia_nodes(spark, sf_dir):
    return Dictionary(_index(spark, sf_dir).vocabulary).compressed_count()


@_query(f"WITH {_PATHS}, k AS (SELECT key FROM vocab WHERE starts_with(key, '{PREFIX}') ORDER BY key, form LIMIT 10) SELECT count(DISTINCT path) AS visits FROM paths WHERE starts_with(path, '{PREFIX}') AND path <= (SELECT max(key) FROM k)")
def prefix_visits(spark, sf_dir):
    return Dictionary(_index(spark, sf_dir).vocabulary).listing_visits(PREFIX, 10)


@_query(f"WITH {_PATHS}, n AS (SELECT path, max(weight) AS best FROM paths WHERE starts_with(path, '{PREFIX}') GROUP BY path), k AS (SELECT weight, key FROM vocab WHERE starts_with(key, '{PREFIX}') ORDER BY weight DESC, key, form LIMIT 10), last AS (SELECT weight, key FROM k ORDER BY weight, key DESC LIMIT 1) SELECT count(*) AS visits FROM n, last WHERE best > last.weight OR (best = last.weight AND path <= last.key)")
def bestfirst_visits(spark, sf_dir):
    return Dictionary(_index(spark, sf_dir).vocabulary).best_first_visits(PREFIX, 10)


@_query(f"WITH {_PATHS} SELECT least(9, (SELECT coalesce(max(length(path)), 0) FROM paths WHERE starts_with('entonxces', path)) + 1) AS comparisons")
def descent_comparisons(spark, sf_dir):
    return Dictionary(_index(spark, sf_dir).vocabulary).descent_comparisons("EntonXces")


# The word list


_LEX = "lex AS (SELECT lower(p_name) AS form, strip_accents(lower(p_name)) AS key, CAST(max(p_size) AS BIGINT) AS weight FROM part GROUP BY ALL)"


def _lexicon(spark, sf_dir) -> Dictionary:
    return Dictionary.of(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.upper("p_name").alias("word"), F.col("p_size").alias("weight")))


def _lexicon_engine(spark, sf_dir) -> search.Engine:
    return search.Engine(_index(spark, sf_dir), _lexicon(spark, sf_dir))


@_query(f"WITH {_LEX} SELECT form, key, weight FROM lex")
def lexicon_words(spark, sf_dir):
    return _lexicon(spark, sf_dir).words


@_query(f"WITH {_LEX}, w AS (SELECT form, row_number() OVER (ORDER BY key, form) AS r FROM lex WHERE starts_with(key, 's')), n AS (SELECT count(*) AS total FROM w) SELECT form, total, total > 4 AS truncated FROM w, n WHERE r <= 4")
def lexicon_completions(spark, sf_dir):
    answer = _lexicon_engine(spark, sf_dir).complete("S", 4)
    return spark.createDataFrame([(w, answer["total"], answer["truncated"]) for w in answer["words"]], "form string, total long, truncated boolean")


@_query(f"WITH RECURSIVE {_LEX}, vocab AS (SELECT * FROM lex), {_osa_sql('red widgte', 2)}, top AS (SELECT * FROM near WHERE distance <= 2 ORDER BY distance, weight DESC, key, form LIMIT 5) SELECT 'red widgte' AS word, false AS found, CAST(0 AS BIGINT) AS continuations, form AS near, distance FROM top WHERE distance > 0 UNION ALL SELECT 'red', false, (SELECT count(*) FROM lex WHERE starts_with(key, 'red')), NULL, NULL UNION ALL SELECT 'Red Widget', true, CAST(0 AS BIGINT), NULL, NULL")
def lexicon_lookups(spark, sf_dir):
    engine, rows = _lexicon_engine(spark, sf_dir), []
    for word in ("red widgte", "red", "Red Widget"):
        answer = engine.lookup(word)
        rows += [(word, answer["found"], answer["continuations"], near, d) for near, d, *_ in answer["near"] or [(None, None)]]
    return spark.createDataFrame(rows, "word string, found boolean, continuations long, near string, distance int")


@_query(f"WITH {_LEX} SELECT form, weight FROM lex UNION ALL SELECT 'zz new', 1")
def lexicon_with_insertion(spark, sf_dir):
    engine = _lexicon_engine(spark, sf_dir)
    new, again = engine.insert_in_lexicon(" ZZ New"), engine.insert_in_lexicon("zz new")
    return engine.lexicon.words.where(F.lit(new and not again)).select("form", "weight")


@_query(f"WITH {_VOCAB} SELECT 'the big ' || form AS line FROM (SELECT * FROM vocab WHERE starts_with(key, '{PREFIX}') ORDER BY weight DESC, key, form LIMIT 7) WHERE form <> '{PREFIX}'")
def last_word_completions(spark, sf_dir):
    lines = search.Engine(_index(spark, sf_dir)).complete_last_word(f"the big {PREFIX}")
    return spark.createDataFrame([(x,) for x in lines], "line string")


# Raw sequences

_AT = f"hit AS (SELECT doc_id, text, unnest(list_filter(range(1, greatest(length(text) - {len(SEQUENCE)} + 2, 1)), lambda p: substr(lower(text), CAST(p AS INT), {len(SEQUENCE)}) = '{SEQUENCE}')) - 1 AS pos FROM documents)"


@_query(f"WITH {_AT} SELECT doc_id, count(*) AS occurrences FROM hit GROUP BY doc_id")
def seq_count(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", sequence.occurrence_count(F.lower("text"), SEQUENCE).alias("occurrences"))
    return rows.where("occurrences > 0")


@_query(f"WITH {_AT} SELECT doc_id, CAST(pos AS INT) AS pos FROM hit")
def seq_offsets(spark, sf_dir):
    hits = search.sequence_hits(_index(spark, sf_dir), SEQUENCE)
    return hits.select(F.col("doc").alias("doc_id"), F.explode("positions").alias("pos"))


@_query(f"WITH {_AT}, f AS (SELECT doc_id, text, min(pos) AS pos FROM hit GROUP BY ALL), g AS (SELECT *, greatest(pos - 45, 0) AS a, least(length(text), pos + {len(SEQUENCE)} + 45) AS b FROM f) SELECT doc_id, CASE WHEN a > 0 THEN '...' ELSE '' END || trim(regexp_replace(substr(text, CAST(a + 1 AS INT), CAST(b - a AS INT)), '\\s+', ' ', 'g')) || CASE WHEN b < length(text) THEN '...' ELSE '' END AS snippet FROM g")
def seq_snippets(spark, sf_dir):
    hits = search.sequence_hits(_index(spark, sf_dir), SEQUENCE, contexts=1)
    return hits.select(F.col("doc").alias("doc_id"), F.col("contexts")[0].alias("snippet"))


@_query("SELECT p.page_id, (length(lower(html)) - length(replace(lower(html), '<p>', ''))) // 3 AS occurrences FROM pages p")
def seq_count_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", sequence.occurrence_count(F.lower("html"), "<p>").alias("occurrences"))


_STARTS = " + ".join(["greatest(length(text) - 3, 0)"] + [f"len(list_filter(range(1, greatest(length(text) - 2, 1)), lambda p: substr(lower(text), CAST(p AS INT), {k}) = '{SEQUENCE[:k]}'))" for k in (1, 2, 3)])


@_query(f"SELECT doc_id, CAST({_STARTS} AS BIGINT) AS comparisons FROM documents")
def naive_comparisons(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", sequence.naive_comparisons(F.lower("text"), SEQUENCE).alias("comparisons"))


# the scan for 'anan' by hand: for each state (letters matched) and letter the comparisons that it takes and the next state, as 8 x comparisons + state
_KMP = "CASE s % 8 WHEN 0 THEN s - s % 8 + CASE WHEN c = 'a' THEN 9 ELSE 8 END WHEN 1 THEN s - s % 8 + CASE c WHEN 'n' THEN 10 WHEN 'a' THEN 17 ELSE 16 END WHEN 2 THEN s - s % 8 + CASE WHEN c = 'a' THEN 11 ELSE 16 END ELSE s - s % 8 + CASE c WHEN 'n' THEN 10 WHEN 'a' THEN 25 ELSE 24 END END"


@_query(f"SELECT doc_id, CASE WHEN length(text) < {len(SEQUENCE)} THEN 0 ELSE list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(lower(text), ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda s, c: {_KMP.replace(chr(39) + 'a' + chr(39), '97').replace(chr(39) + 'n' + chr(39), '110')}) // 8 END AS comparisons FROM documents")
def kmp_comparisons(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", sequence.kmp_comparisons(F.lower("text"), SEQUENCE).alias("comparisons"))


@_query("SELECT doc_id, len(list_filter(regexp_extract_all(text, '\\p{L}+'), lambda w: length(w) >= 2 AND starts_with(strip_accents(lower(w)), 'ent'))) AS hits FROM documents")
def highlight_prefix(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", highlight.hit_count(highlight.segments(F.col("text"), prefix=PREFIX)).cast("long").alias("hits"))


_TRACE = "s AS (SELECT p_partkey AS k, p_name AS t, 0 AS i, 0 AS j FROM part WHERE length(p_name) >= 2 UNION ALL SELECT k, t, CASE WHEN same OR j = 0 THEN i + 1 ELSE i END, CASE WHEN same THEN 1 ELSE 0 END FROM (SELECT *, substr(t, i + 1, 1) = 'l' AS same FROM s WHERE i < length(t)))"


@_query(f"WITH RECURSIVE {_TRACE}, c AS (SELECT *, substr(t, i + 1, 1) = 'l' AS same FROM s WHERE i < length(t)) SELECT k, i, j, same AS matched, i - j AS shift, 'compare' AS event FROM c UNION ALL SELECT k, i, j, true, i - j, 'found' FROM c WHERE same AND j = 1 UNION ALL SELECT k, i, 0, false, i, 'slide' FROM c WHERE NOT same AND j = 1 UNION ALL SELECT k, i + 1, 0, false, i + 1, 'advance' FROM c WHERE NOT same AND j = 0")
def kmp_trace_steps(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select(F.col("p_partkey").alias("k"), F.inline(sequence.kmp_trace_of(F.col("p_name"), "ll")))


_AHEAD = [f"starts_with(c || n1 || n2 || n3, '{SEQUENCE[:k]}')" for k in (1, 2, 3, 4)]


@_query(f"WITH l AS (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS p FROM (SELECT doc_id, string_split(lower(text), '') AS cs FROM documents)), w AS (SELECT c, lead(c, 1) OVER d AS n1, lead(c, 2) OVER d AS n2, lead(c, 3) OVER d AS n3 FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY p)) SELECT count(*) FILTER ({_AHEAD[3]}) AS occurrences, count(*) + count(*) FILTER ({_AHEAD[0]}) + count(*) FILTER ({_AHEAD[1]}) + count(*) FILTER ({_AHEAD[2]}) AS comparisons FROM w WHERE n3 IS NOT NULL")
def sequence_totals_naive(spark, sf_dir):
    return search.sequence_totals(_index(spark, sf_dir), SEQUENCE, method="naive")


_MARK = "list_transform({0}, lambda w: length(w) >= 2 AND regexp_matches(w, '^\\p{{L}}') AND starts_with(strip_accents(lower(w)), 'ent'))"
_CUT = (
    "x AS (SELECT doc_id, text, regexp_extract_all(text, '\\p{L}+|\\P{L}+') AS ps FROM documents), y AS (SELECT *, list_position(" + _MARK.format("ps") + ", true) AS p FROM x), "
    "z AS (SELECT doc_id, text, CAST(coalesce(list_sum(list_transform(ps[1:p - 1], lambda q: length(q))), 0) AS BIGINT) AS a0, length(ps[p]) AS n FROM y WHERE p > 0), "
    "z1 AS (SELECT *, a0 + n AS b0, greatest(a0 - 80, 0) AS e FROM z), z2 AS (SELECT *, CASE WHEN e > 0 AND strpos(substr(text, e + 1), ' ') > 0 THEN e + strpos(substr(text, e + 1), ' ') ELSE e END AS a FROM z1), "
    "z3 AS (SELECT *, least(length(text), a + 230) AS f FROM z2), z4 AS (SELECT *, CASE WHEN strpos(reverse(substr(text, 1, f + 1)), ' ') > 0 THEN f + 1 - strpos(reverse(substr(text, 1, f + 1)), ' ') ELSE -1 END AS l FROM z3), "
    "z5 AS (SELECT *, CASE WHEN f < length(text) AND l > b0 THEN l ELSE f END AS b FROM z4), z6 AS (SELECT *, regexp_extract_all(substr(text, a + 1, b - a), '\\p{L}+|\\P{L}+') AS qs FROM z5)"
)


@_query(f"WITH {_CUT} SELECT doc_id, CASE WHEN a > 0 THEN '… ' ELSE '' END || regexp_replace(list_aggregate(list_transform(list_zip(qs, {_MARK.format('qs')}), lambda q: CASE WHEN q[2] THEN '[' || q[1] || ']' ELSE q[1] END), 'string_agg', ''), '\\s', ' ', 'g') || CASE WHEN b < length(text) THEN ' …' ELSE '' END AS excerpt FROM z6")
def excerpts(spark, sf_dir):
    cut = highlight.excerpt(F.col("text"), lambda t: highlight.segments(t, prefix=PREFIX))
    shown = F.array_join(F.transform(cut, lambda s: F.when(s["hit"], F.concat(F.lit("["), s["text"], F.lit("]"))).otherwise(s["text"])), "")
    return _docs(spark, sf_dir).select("doc_id", shown.alias("excerpt")).where("excerpt is not null")


@_query("WITH x AS (SELECT doc_id, regexp_extract_all(text, '\\p{L}+|\\P{L}+') AS ps FROM documents), q AS (SELECT doc_id, unnest(ps) AS w, generate_subscripts(ps, 1) AS i FROM x), r AS (SELECT *, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM q) SELECT doc_id, CAST(stop - length(w) AS INT) AS start, CAST(stop AS INT) AS stop FROM r WHERE length(w) >= 2 AND regexp_matches(w, '^\\p{L}') AND starts_with(strip_accents(lower(w)), 'ent')")
def highlight_ranges(spark, sf_dir):
    found = _docs(spark, sf_dir).select("doc_id", F.explode(highlight.ranges(highlight.segments(F.col("text"), prefix=PREFIX))).alias("r"))
    return found.select("doc_id", F.col("r.start").alias("start"), F.col("r.end").alias("stop"))


# Hash table

_HASH = f"{_VOCAB}, h AS (SELECT form, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(form, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) AS hash FROM vocab), cap AS (SELECT CAST(1024 * pow(2, greatest(0, ceil(log2(count(*) / 0.75 / 1024)))) AS BIGINT) AS capacity FROM vocab)"


def _keys(spark, sf_dir) -> tuple[DataFrame, int]:
    keys = _index(spark, sf_dir).vocabulary.select(F.col("form").alias("key"))
    return keys, hashing.capacity_for(keys.count())


@_query(f"WITH {_HASH} SELECT hash % capacity AS bucket, count(*) AS chain FROM h, cap GROUP BY ALL")
def hash_buckets(spark, sf_dir):
    return hashing.buckets(*_keys(spark, sf_dir))


@_query(f"WITH {_HASH}, b AS (SELECT hash % capacity AS bucket, count(*) AS chain FROM h, cap GROUP BY ALL) SELECT CAST(sum(chain) AS BIGINT) AS keys, (SELECT capacity FROM cap) AS capacity, round(sum(chain) / (SELECT capacity FROM cap), 6) AS load, count(*) AS occupied, CAST(sum(chain) - count(*) AS BIGINT) AS collisions, max(chain) AS longest, round(sum(chain) / count(*), 3) AS mean_chain FROM b")
def hash_stats(spark, sf_dir):
    return hashing.table_statistics(*_keys(spark, sf_dir))


@_query(f"WITH {_HASH}, b AS (SELECT hash % capacity AS bucket, count(*) AS chain FROM h, cap GROUP BY ALL), c AS (SELECT chain, count(*) AS buckets FROM b GROUP BY chain UNION ALL SELECT 0, (SELECT capacity FROM cap) - count(*) FROM b) SELECT chain, buckets FROM c")
def chain_histogram(spark, sf_dir):
    return hashing.chain_histogram(*_keys(spark, sf_dir))


CAPACITIES = [512, 1024, 2048, 4096, 8192, 16384, 32768]


@_query(f"WITH {_HASH}, b AS (SELECT capacity, hash % capacity AS bucket, count(*) AS chain FROM h, (SELECT CAST(unnest({CAPACITIES}) AS BIGINT) AS capacity) GROUP BY ALL) SELECT capacity, CAST(sum(chain) AS BIGINT) AS keys, round(sum(chain) / capacity, 6) AS load, count(*) AS occupied, CAST(sum(chain) - count(*) AS BIGINT) AS collisions, max(chain) AS longest, round(sum(chain) / count(*), 6) AS mean_chain, round(sum(chain) / capacity / (1 - exp(-sum(chain) / capacity)), 6) AS expected FROM b GROUP BY capacity")
def hash_capacity_sweep(spark, sf_dir):
    out = hashing.capacity_sweep(_index(spark, sf_dir).vocabulary.select(F.col("form").alias("key")), CAPACITIES)
    return out.select("capacity", "keys", F.round("load", 6).alias("load"), "occupied", "collisions", "longest", F.round("mean_chain", 6).alias("mean_chain"), F.round("expected", 6).alias("expected"))


# Statistics


_OVER = f"{_STEMS}, paths AS (SELECT key, weight, substr(key, 1, CAST(n AS INT)) AS path FROM (SELECT key, weight, unnest(range(0, length(key) + 1)) AS n FROM vocab)), c AS (SELECT (SELECT count(DISTINCT path) FROM paths) AS nodes, (SELECT count(*) + 1 FROM (SELECT path FROM paths WHERE path <> '' GROUP BY path HAVING bool_or(path = key) OR count(DISTINCT nullif(substr(key, length(path) + 1, 1), '')) >= 2)) AS compressed_nodes)"


@_query(f"WITH {_OVER} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM raw) AS raw_tokens, (SELECT count(*) FROM tok) AS kept_tokens, round(1 - (SELECT count(*) FROM tok) / (SELECT count(*) FROM raw), 9) AS reduction, (SELECT count(*) FROM vocab) AS terms, (SELECT count(DISTINCT term) FROM spost) AS stems, (SELECT count(*) FROM spost) AS postings, nodes, compressed_nodes, round(1 - compressed_nodes / nodes, 9) AS saving FROM c")
def engine_overview(spark, sf_dir):
    return statistics.overview(_index(spark, sf_dir)).withColumn("reduction", F.round("reduction", 9)).withColumn("saving", F.round("saving", 9))


@_query(f"WITH {_LEX} SELECT count(*) AS words, (SELECT count(DISTINCT substr(key, 1, CAST(n AS INT))) FROM (SELECT key, unnest(range(0, length(key) + 1)) AS n FROM lex)) AS nodes, max(length(key)) AS height FROM lex")
def lexicon_state(spark, sf_dir):
    return statistics.lexicon_figures(_lexicon(spark, sf_dir)).select("words", "nodes", F.col("height").cast("long").alias("height"))


@_query(f"WITH {_TOK} SELECT count(*) AS calls, count(*) - count(DISTINCT term) AS hits, round(1 - count(DISTINCT term) / count(*), 9) AS rate FROM tok")
def stem_reuse(spark, sf_dir):
    return statistics.stem_reuse(_index(spark, sf_dir)).withColumn("rate", F.round("rate", 9))


@_query(f"WITH {_POST}, {_LEN}, top AS (SELECT max(doc_id) AS m FROM documents), b AS (SELECT m * unnest([1, 2, 3, 4]) // 4 AS bound FROM top) SELECT bound, (SELECT count(*) FROM dl WHERE doc_id <= bound) AS documents, (SELECT CAST(sum(dl) AS BIGINT) FROM dl WHERE doc_id <= bound) AS tokens, (SELECT count(*) FROM post WHERE doc_id <= bound) AS postings, (SELECT count(DISTINCT term) FROM post WHERE doc_id <= bound) AS terms FROM b")
def index_growth(spark, sf_dir):
    last = _docs(spark, sf_dir).agg(F.max("doc_id")).first()[0]
    return statistics.index_growth(_index(spark, sf_dir), [last * n // 4 for n in (1, 2, 3, 4)])


_BOUNDS, _PREFIXES = ["d", "m", "s", "zz"], ["ent", "co", "pre", "a"]


@_query(f"WITH {_VOCAB}, b AS (SELECT unnest([{_list(_BOUNDS)}]) AS bound), h AS (SELECT bound, (SELECT count(*) FROM vocab WHERE form <= bound) AS n, p, (SELECT count(*) FROM vocab WHERE form <= bound AND starts_with(key, p)) AS found FROM b, (SELECT unnest([{_list(_PREFIXES)}]) AS p)) SELECT bound, max(n) * {len(_PREFIXES)} AS compared, CAST(sum(found) AS BIGINT) AS found, CAST(sum(least(found, 10)) AS BIGINT) AS shown FROM h GROUP BY bound")
def prefix_growth(spark, sf_dir):
    return statistics.prefix_growth(_index(spark, sf_dir).vocabulary, _PREFIXES, _BOUNDS)


_RANKED = "SELECT term, df, n_docs, dl, row_number() OVER (PARTITION BY term ORDER BY {0} DESC, doc_id) AS r FROM w"


@_query(f"WITH {_POST}, {_LEN}, w AS (SELECT p.*, dl, n_docs, ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS bm, (1 + log10(tf)) * log10(n_docs / df) AS ti FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM post WHERE term IN ({_list(TERMS)})) p JOIN dl USING (doc_id), tot), a AS ({_RANKED.format('bm')}), b AS ({_RANKED.format('ti')}) SELECT term, max(a.df) AS df, round(avg(a.dl), 6) AS bm25_length, (SELECT round(avg(dl), 6) FROM b WHERE b.term = a.term AND r <= 5) AS tfidf_length, bool_or(a.df = n_docs) AS in_all FROM a WHERE r <= 5 GROUP BY term")
def rank_lengths(spark, sf_dir):
    out = ranking.compared_lengths(_index(spark, sf_dir), TERMS, 5, stems=False)
    return out.select("term", "df", F.round("bm25_length", 6).alias("bm25_length"), F.round("tfidf_length", 6).alias("tfidf_length"), "in_all")




@_query("SELECT event_type AS type, count(*) AS questions, round(sum(value), 4) AS seconds, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def query_log_summary(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("type"), F.col("value").alias("seconds"))
    return statistics.log_summary(log).select("type", "questions", F.round("seconds", 4).alias("seconds"), F.round("mean", 6).alias("mean"))


@_query("SELECT round(avg(value) FILTER (event_type = (SELECT max(event_type) FROM events)) / avg(value) FILTER (event_type = (SELECT min(event_type) FROM events)), 6) AS ratio FROM events")
def query_log_ratio(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("type"), F.col("value").alias("seconds"))
    a, b = log.agg(F.max("type"), F.min("type")).first()
    return statistics.mean_ratio(log, a, b).select(F.round("ratio", 6).alias("ratio"))


@_query(f"WITH {_PATHS} SELECT (SELECT count(*) FROM vocab) AS terms, (SELECT count(DISTINCT path) FROM paths) AS nodes, (SELECT count(*) + 1 FROM (SELECT path FROM paths WHERE path <> '' GROUP BY path HAVING bool_or(path = key) OR count(DISTINCT nullif(substr(key, length(path) + 1, 1), '')) >= 2)) AS compressed_nodes")
def structure_stats(spark, sf_dir):
    return statistics.structure_figures(_index(spark, sf_dir, stemmed=False)).select("terms", "nodes", "compressed_nodes")


@_query("WITH n AS (SELECT conv_id, turn, CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{Nl}\\p{No}]+')) AS BIGINT) AS n FROM conversations) SELECT conv_id, count(*) AS turns, CAST(sum(n) AS BIGINT) AS tokens FROM n GROUP BY conv_id")
def conversation_tokens(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.size(text.tokens(F.col("text"))).cast("long")).alias("tokens"))
