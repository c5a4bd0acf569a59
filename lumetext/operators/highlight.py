"""What lights up in a text: ranges, segments, and the excerpt around the first one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import sequence, stemming, text
from ..functions.text import bind


def lights_up(word: Column, stems: list[str] | None = None, prefix: str | None = None, equal: str | None = None) -> Column:
    """Does a word of at least two characters match: by its stem, by the prefix of its key, or by its key?"""
    if stems is not None:
        same = stemming.stem_expression(word).isin(stems)
    elif prefix is not None:
        same = F.startswith(text.normalised(word), F.lit(text.fold(prefix)))
    else:
        same = text.normalised(word) == text.fold(equal or "")
    return (F.length(word) >= 2) & same


def _pieces(content: Column) -> Column:
    """The text as alternating runs of letters and of anything else."""
    return F.regexp_extract_all(content, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))


def segments(content: Column, **criterion) -> Column:
    """The whole text as array<struct<text, hit>>."""
    return F.transform(_pieces(content), lambda p: F.struct(p.alias("text"), (F.regexp_like(p, F.lit(r"^\p{L}")) & lights_up(p, **criterion)).alias("hit")))


def sequence_segments(content: Column, pattern: str) -> Column:
    """The same for a raw sequence, whatever its case: occurrences that don't overlap; none if lower case changes the length."""
    low = F.lower(content)
    pieces = F.regexp_extract_all(content, F.lit(f"((?iu){sequence.quoted(pattern)}|(?s:.)(?:(?!(?iu){sequence.quoted(pattern)})(?s:.))*)"), F.lit(1))
    plain = F.array(F.struct(content.alias("text"), F.lit(False).alias("hit")))
    if not pattern:
        return plain
    return F.when(F.length(low) != F.length(content), plain).otherwise(F.transform(pieces, lambda p: F.struct(p.alias("text"), (F.lower(p) == pattern.lower()).alias("hit"))))


def hit_count(marked: Column) -> Column:
    return F.size(F.filter(marked, lambda s: s["hit"]))


def ranges(marked: Column) -> Column:
    """array<struct<start, end>> of the hits of a segmented text."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(state: Column, s: Column) -> Column:
        end = state["at"] + F.length(s["text"])
        one = F.array(F.struct(state["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(s["hit"], F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    return F.aggregate(marked, start, step)["found"]


def excerpt(content: Column, mark: Callable[[Column], Column], size: int = 230, before: int = 80) -> Column:
    """About ``size`` characters from a little before the first hit on, as segments; null if nothing lights up.

    ``mark`` makes segments of a text. Cut where a blank is, if there is one; every blank character becomes a space, and
    segments of dots tell where something was left out.
    """
    space = F.lit(" ")

    def cut(first: Column) -> Column:
        early = F.greatest(first["start"] - before, F.lit(0))
        blank = F.call_function("locate", space, content, early + 1)  # the place after the blank, counted from 0
        return bind(F.when((early > 0) & (blank > 0), blank).otherwise(early), lambda start: upto(first, start))

    def upto(first: Column, start: Column) -> Column:
        far = F.least(F.length(content), start + size)
        back = F.call_function("locate", space, F.reverse(F.substring(content, F.lit(1), far + 1)))
        last = F.when(back > 0, far + 1 - back).otherwise(-1)
        end = F.when((far < F.length(content)) & (last > first["end"]), last).otherwise(far)
        return bind(end, lambda end: shown(start, end))

    def shown(start: Column, end: Column) -> Column:
        dots = lambda t, where: F.when(where, F.array(F.struct(F.lit(t).alias("text"), F.lit(False).alias("hit")))).otherwise(F.array().cast("array<struct<text:string,hit:boolean>>"))
        body = F.transform(mark(F.substring(content, start + 1, end - start)), lambda s: F.struct(F.regexp_replace(s["text"], r"(?U)\s", " ").alias("text"), s["hit"].alias("hit")))
        return F.concat(dots("… ", start > 0), body, dots(" …", end < F.length(content)))

    first = F.get(ranges(mark(content)), F.lit(0))
    return F.when(first.isNotNull(), bind(first, cut))
