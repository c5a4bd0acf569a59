"""Raw character sequences: overlapping occurrences, and what classic scans would compare to find them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import UserDefinedTableFunction

from .text import bind


def quoted(pattern: str) -> str:
    return r"\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + r"\E"


def occurrence_count(text: Column, pattern: str) -> Column:
    """Overlapping occurrences; 0 for an empty pattern."""
    return F.regexp_count(text, F.lit(f"(?={quoted(pattern)})")).cast("long") if pattern else F.lit(0).cast("long")


def occurrences(text: Column, pattern: str, first_only: bool = False) -> Column:
    """0-based positions of all overlapping occurrences, ascending."""
    empty = F.array().cast("array<int>")
    if not pattern:
        return empty
    m = len(pattern)
    if first_only:
        at = F.locate(pattern, text, 1)
        return F.when(at > 0, F.array(at - 1)).otherwise(empty)

    def by_gaps(t: Column) -> Column:
        # each piece but the last ends where an occurrence begins
        gaps = F.transform(F.split(t, f"(?={quoted(pattern)})"), lambda p: F.length(p))
        ends = F.aggregate(gaps, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.filter(ends, lambda p: F.substring(t, p + 1, F.lit(m)) == pattern)

    return F.when(F.contains(text, F.lit(pattern)), F.array_distinct(bind(text, by_gaps))).otherwise(empty)


def failure_table(pattern: str) -> list[int]:
    """For each prefix the length of its longest proper border."""
    out: list[int] = []
    for i, c in enumerate(pattern):
        k = out[-1] if out else 0
        while k and pattern[k] != c:
            k = out[k - 1]
        out.append(k + 1 if i and pattern[k] == c else 0)
    return out


def kmp_comparisons(text: Column, pattern: str) -> Column:
    """Character comparisons of a Knuth-Morris-Pratt scan; 0 if the pattern is empty or longer than the text.

    An Arrow function: the scan depends on every character before, and stretches without the first character of the
    pattern are passed over at once, at a comparison each.
    """
    m, fail = len(pattern), failure_table(pattern)

    def scan(t: str) -> int:
        n, i, j, count = len(t), 0, 0, 0
        if not m or m > n:
            return 0
        while i < n:
            if not j:
                k = t.find(pattern[0], i)
                if k < 0:
                    return count + n - i
                count += k - i
                i = k
            count += 1
            if t[i] == pattern[j]:
                i += 1
                j += 1
                if j == m:
                    j = fail[m - 1]
            else:
                j = fail[j - 1]
        return count

    @F.pandas_udf(T.LongType())
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else scan(t) for t in texts], dtype="Int64")

    return counted(text)


def naive_comparisons(text: Column, pattern: str) -> Column:
    """Character comparisons of a scan that starts anew at each position: a k-th one wherever k - 1 characters agree."""
    m = len(pattern)
    if not m:
        return F.lit(0).cast("long")
    starts = F.length(text) - m + 1
    more = [F.regexp_count(text, F.lit(f"(?s)(?={quoted(pattern[:k])}.{{{m - k}}})")).cast("long") for k in range(1, m)]
    return F.when(starts <= 0, F.lit(0).cast("long")).otherwise(sum(more, starts.cast("long")))


def kmp_steps(text: str, pattern: str, limit: int = 4000) -> Iterator[tuple[int, int, bool, int, str]]:
    """(i, j, matched, shift, event) of a scan on the driver or in a worker: ``compare``, then ``found``, ``slide`` or ``advance`` if it led to one.

    Ends at the text's end or with the comparison that reaches ``limit`` steps; none if the pattern is empty or longer.
    """
    fail, i, j, steps = failure_table(pattern), 0, 0, 0
    while 0 < len(pattern) <= len(text) and i < len(text) and steps < limit:
        same = text[i] == pattern[j]
        yield i, j, same, i - j, "compare"
        steps += 1
        if same and j < len(pattern) - 1:
            i, j = i + 1, j + 1
            continue
        steps += 1
        if same:
            yield i, j, True, i - j, "found"
            i, j = i + 1, fail[j]
        elif j:
            j = fail[j - 1]
            yield i, j, False, i - j, "slide"
        else:
            i += 1
            yield i, j, False, i, "advance"


_STEP = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("matched", T.BooleanType()), T.StructField("shift", T.IntegerType()), T.StructField("event", T.StringType())])


class _Trace:
    def eval(self, text: str, pattern: str, limit: int) -> Iterator[tuple]:
        if text and pattern:
            yield from kmp_steps(text, pattern, limit)


def kmp_trace_of(text: Column, pattern: str, limit: int = 4000) -> Column:
    """``kmp_steps`` of each text as array<struct<i, j, matched, shift, event>>; an Arrow function, for the short texts that are shown."""

    @F.pandas_udf(T.ArrayType(_STEP))
    def traced(texts: pd.Series) -> pd.Series:
        names = _STEP.names
        return texts.map(lambda t: [dict(zip(names, x, strict=True)) for x in kmp_steps(t or "", pattern, limit)])

    return traced(text)


def kmp_trace() -> UserDefinedTableFunction:
    """A table function (text, pattern, limit): the steps of a scan; i, j, matched, shift, event."""
    return F.udtf(_Trace, returnType=_STEP)
