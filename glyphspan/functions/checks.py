"""Columns that check what they are given: spans that must not overlap, maps that must not share a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def disjoint(spans: Column, touching: bool = False) -> Column:
    """Whether no two spans, an array of (start, stop), overlap; ``touching`` ones may end where another starts."""
    ordered = F.array_sort(spans)
    after = lambda s, i: F.get(ordered, i + 1)
    apart = lambda s, i: s["stop"] <= after(s, i)["start"] if touching else s["stop"] < after(s, i)["start"]
    return F.forall(F.transform(ordered, lambda s, i: F.coalesce(apart(s, i), F.lit(True))), lambda ok: ok)


def merged_maps(a: Column, b: Column) -> Column:
    """Both maps in one; a key of both is an error."""
    twice = F.array_intersect(F.map_keys(a), F.map_keys(b))
    fault = F.raise_error(F.concat(F.lit("key in both maps: "), F.array_join(twice.cast("array<string>"), ", ")))
    return F.when(F.size(twice) == 0, F.map_concat(a, b)).otherwise(fault)
