"""Edit distance with transpositions of neighbours (optimal string alignment), as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind


def _fold(a: Column, b: Column) -> Column:
    """struct(row, before, low): the last two rows of the table, and the least value of every row so far."""

    def over(x: Column, y: Column) -> Column:
        n = F.size(y)
        first = F.sequence(F.lit(0), n)

        def step(state: Column, i: Column) -> Column:
            row, before = state["row"], state["before"]
            c = F.get(x, i - 1)

            def cell(j: Column) -> Column:
                """Without insertions: a substitution, a deletion, or an exchange of neighbours."""
                d = F.get(y, j - 1)
                swap = (i > 1) & (j > 1) & (c == F.get(y, j - 2)) & (F.get(x, i - 2) == d)
                best = F.least(F.get(row, j - 1) + F.when(c == d, 0).otherwise(1), F.get(row, j) + 1)
                return F.when(swap, F.least(best, F.get(before, j - 2) + 1)).otherwise(best)

            base = F.transform(first, lambda j: F.when(j == 0, i).otherwise(cell(j)))
            # insertions: the least of (value - place) so far, plus the place
            run = bind(base, lambda s: F.aggregate(first, F.array().cast("array<int>"), lambda acc, j: F.concat(acc, F.array(F.when(j == 0, F.get(s, j)).otherwise(F.least(F.get(s, j), F.element_at(acc, -1) + 1))))))
            return bind(run, lambda s: F.struct(s.alias("row"), row.alias("before"), F.concat(state["low"], F.array(F.array_min(s))).alias("low")))

        start = F.struct(first.alias("row"), first.alias("before"), F.array().cast("array<int>").alias("low"))
        steps = F.when(F.size(x) > 0, F.sequence(F.lit(1), F.size(x))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, step)

    letters = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    return bind(letters(a), lambda x: bind(letters(b), lambda y: over(x, y)))


def edit_distance(a: Column, b: Column) -> Column:
    return F.element_at(_fold(a, b)["row"], -1)


def row_minima(a: Column, b: Column) -> Column:
    """For each prefix of ``a`` the least distance between it and any prefix of ``b``."""
    return _fold(a, b)["low"]


def within(a: Column, b: Column, most: Column | int) -> Column:
    """Can the distance be at most ``most``? By lengths and the built-in distance, which is at most twice this one and stops there if ``most`` is a number."""
    if isinstance(most, int):
        return (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b, 2 * most) >= 0)
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b) <= 2 * most)
