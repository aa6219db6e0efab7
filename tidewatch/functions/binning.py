"""Equal-width bin index with numpy ``histogram`` semantics, as a Column.

Edges are ``first + i * (last - first) / n`` with the last edge exactly
``last``; bins are half open except the last, which is closed. The index is
computed from the scaled value and then corrected against the edges, as
numpy does, so values on an edge land in the same bin in both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge(i: Column, first: Column, last: Column, n: Column) -> Column:
    return F.when(i >= n, last).otherwise(i.cast("double") * ((last - first) / n) + first)


def equal_width_bin(v: Column, first: Column, last: Column, n: Column) -> Column:
    i0 = ((v - first) / (last - first) * n).cast("long")
    i1 = F.when(i0 >= n, n - 1).otherwise(i0)
    i2 = F.when(v < edge(i1, first, last, n), i1 - 1).otherwise(i1)
    return F.when((v >= edge(i2 + 1, first, last, n)) & (i2 != n - 1), i2 + 1).otherwise(i2)


def open_range(lo: Column, hi: Column) -> tuple[Column, Column]:
    """numpy widens a zero-width range by 0.5 on each side."""
    same = lo == hi
    return F.when(same, lo - 0.5).otherwise(lo), F.when(same, hi + 0.5).otherwise(hi)


def count_at_most(edges: Column, v: Column, max_edges: int) -> Column:
    """Number of elements of a sorted array ``edges`` (at most ``max_edges`` long) that
    are <= v, unrolled at plan time so it stays in generated code."""
    total = F.lit(0)
    for i in range(max_edges):
        total = total + F.when((F.size(edges) > i) & (F.try_element_at(edges, F.lit(i + 1)) <= v), 1).otherwise(0)
    return total
