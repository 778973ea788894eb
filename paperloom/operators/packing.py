"""The greedy packer that all chunkers share.

An item starts a new group if it would push a non-empty group's sum over the target; a single larger item is a
group of its own. ``starts`` is the Column form without overlap (a fold, no shuffle, no Python), ``spans`` the
general one for table functions.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import text as T


def starts(widths: Column, target: int) -> Column:
    """Positions, from 0, at which groups of an array of widths start; empty for an empty array."""
    whole = lambda x: F.lit(x).cast("long")
    first = F.struct(F.array().cast("array<bigint>").alias("starts"), whole(0).alias("sum"), whole(0).alias("at"))

    def step(s: Column, w: Column) -> Column:
        cut = (s["at"] == 0) | ((s["sum"] + w > target) & (s["sum"] > 0))
        return F.struct(
            F.when(cut, F.array_append(s["starts"], s["at"])).otherwise(s["starts"]).alias("starts"),
            F.when(cut, w.cast("long")).otherwise(s["sum"] + w).alias("sum"),
            (s["at"] + 1).alias("at"),
        )

    return F.aggregate(widths, first, step, lambda s: s["starts"])


def groups(items: Column, widths: Column, target: int) -> Column:
    """An array with a struct ``(index, first, items)`` for each group of ``items``, packed by ``widths``."""

    def cut(s: Column) -> Column:
        ends = F.array_append(s, F.size(items).cast("long"))
        return T.let(ends, lambda e: F.transform(s, lambda a, k: F.struct(k.cast("long").alias("index"), a.alias("first"), F.slice(items, (a + 1).cast("int"), (F.get(e, k + 1) - a).cast("int")).alias("items"))))

    return T.let(starts(widths, target), cut)


def spans(widths: list[int], target: int, overlap: int = 0) -> Iterator[tuple[int, int]]:
    """Groups ``[first, end)``; the next group starts ``overlap`` items back, but always moves on by one.

    With an overlap one item can end several groups. Ends as soon as the last item is in a group.
    """
    sums = [0, *accumulate(widths)]
    first = 0
    while first < len(widths):
        fits = bisect_right(sums, sums[first] + target) - 1
        one = bisect_right(sums, sums[first])  # just past the first item with a width
        end = min(max(fits, one), len(widths))
        yield first, end
        if end == len(widths):
            return
        first = max(first + 1, end - min(overlap, end - first - 1))
