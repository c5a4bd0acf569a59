"""Text preprocessing as column expressions: case, accents, tokens, stopwords, snippets, number formats.

Everything here is built in to Spark except the ``*_exact`` variants, which are Arrow functions for the few
characters (Hangul, some ligatures) whose decomposition a character-by-character map can't express.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{Nl}\p{No}]+"
MIN_TOKEN = 2


def bind(value: Column, f) -> Column:
    """f(value), with ``value`` computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


@cache
def accent_map() -> tuple[str, str]:
    """(characters, what ``translate`` makes of them; those without a counterpart are deleted)."""
    changed, deleted = [], []
    for c in map(chr, range(sys.maxunicode + 1)):
        if 0xD800 <= ord(c) <= 0xDFFF:
            continue
        if unicodedata.combining(c):
            deleted.append(c)
            continue
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if not plain:
            deleted.append(c)
        elif len(plain) == 1 and plain != c:
            changed.append((c, plain))
    return "".join(a for a, _ in changed) + "".join(deleted), "".join(b for _, b in changed)


def fold(text: str) -> str:
    """``normalised`` on the driver: stripped, lower case, decomposed, without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text.strip().lower()) if not unicodedata.combining(c))


def spelling_of(text: str) -> str:
    """``spelling`` on the driver: stripped, lower case, composed."""
    return unicodedata.normalize("NFC", text.strip().lower())


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lower_case(text: Column) -> Column:
    return F.lower(text)


def without_accents(text: Column) -> Column:
    return F.translate(text, *accent_map())


def normalised(text: Column) -> Column:
    """The key by which the dictionary is navigated: stripped, lower case, without accents."""
    return without_accents(F.lower(stripped(text)))


def spelling(text: Column) -> Column:
    """The identity of a word, accents kept, for text that is composed already."""
    return F.lower(stripped(text))


@F.pandas_udf(T.StringType())
def normalised_exact(text: pd.Series) -> pd.Series:
    return text.map(fold, na_action="ignore")


@F.pandas_udf(T.StringType())
def spelling_exact(text: pd.Series) -> pd.Series:
    return text.map(spelling_of, na_action="ignore")


def without_punctuation(text: Column) -> Column:
    """Everything but letters, numbers, underscores and blanks becomes a space, and so do underscores."""
    return F.regexp_replace(text, r"(?U)[^\p{L}\p{N}_\s]|_", " ")


def tokens(text: Column) -> Column:
    """Runs of letters of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def is_searchable(token: Column, stopwords: list[str], min_length: int = MIN_TOKEN) -> Column:
    """Long enough, and its accent-free form no stopword. Accents are taken off only where there can be any: beyond ASCII, and up to the longest stopword's length."""
    long = F.length(token) >= min_length
    if not stopwords:
        return long
    accented = (F.octet_length(token) != F.length(token)) & (F.length(token) <= max(map(len, stopwords)))
    return long & ~token.isin(stopwords) & ~(accented & without_accents(token).isin(stopwords))


def without_stopwords(words: Column, stopwords: list[str], min_length: int = MIN_TOKEN) -> Column:
    """An array of tokens, without short ones and without those whose accent-free form is a stopword."""
    return F.filter(words, lambda w: is_searchable(w, stopwords, min_length))


def snippet(text: Column, position: Column, length: Column, margin: int = 45) -> Column:
    """The text around an occurrence (0-based position), blanks collapsed, dots where it was cut."""
    start = F.greatest(position - margin, F.lit(0))
    end = F.least(F.length(text), position + length + margin)
    body = F.trim(F.regexp_replace(F.substring(text, start + 1, end - start), r"(?U)\s+", " "))
    return F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(end < F.length(text), "...").otherwise(""))


def number_text(value: Column, decimals: int = 0) -> Column:
    """Digits grouped by stops, with a decimal comma."""
    return F.translate(F.format_number(value, decimals), ",.", ".,")


def duration_text(seconds: Column) -> Column:
    return (
        F.when(seconds >= 1, F.concat(number_text(seconds, 2), F.lit(" s")))
        .when(seconds >= 1e-3, F.concat(number_text(seconds * 1e3, 1), F.lit(" ms")))
        .otherwise(F.concat(number_text(seconds * 1e6, 1), F.lit(" µs")))
    )


def percent_text(share: Column, decimals: int = 1) -> Column:
    return F.concat(number_text(share * 100, decimals), F.lit("%"))


def kilobytes_text(size: Column) -> Column:
    return F.concat(number_text(size / 1024, 1), F.lit(" KB"))


def distance_text(distance: Column) -> Column:
    return F.when(distance == 0, "outra acentuação").when(distance == 1, "1 edição").otherwise(F.concat(distance.cast("string"), F.lit(" edições")))


def title_of(name: Column) -> Column:
    """A title made of a file name: no ending, spaces for underscores, first letter in upper case."""
    stem = F.translate(F.regexp_replace(name, r"\.[^.]*$", ""), "_", " ")
    return F.concat(F.upper(F.substring(stem, 1, 1)), F.lower(F.substring(stem, F.lit(2), F.length(stem))))


@F.pandas_udf(T.StringType())
def safe_name(name: pd.Series) -> pd.Series:
    """A file name in compatibility decomposition, without combining marks."""
    return name.map(lambda n: "".join(c for c in unicodedata.normalize("NFKD", n) if not unicodedata.combining(c)), na_action="ignore")


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters two words have in common at their beginnings."""
    places = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.array_max(F.filter(places, lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)))


def cleaned_article(text: Column, closing: list[str]) -> Column:
    """Headings without their marks; nothing after the first line that is one of ``closing``; no runs of blank lines."""
    out = F.regexp_replace(text, r"(?m)^=+\s*(.*?)\s*=+$", "$1")
    for title in closing:
        out = F.get(F.split(out, rf"(?m)^\Q{title}\E\s*$", 2), F.lit(0))
    return stripped(F.regexp_replace(out, "\n{3,}", "\n\n"))


def has_words(text: Column, at_least: int) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")) >= at_least
