"""Combining fragments as relations, and what each of them writes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concat(fragments: Sequence[DataFrame], dim: str, lengths: Sequence[int]) -> DataFrame:
    """Fragments one after the other: each one's <dim>_pos is moved by the lengths before it."""
    at, moved = 0, []
    for frame, length in zip(fragments, lengths, strict=True):
        moved.append(frame.withColumn(f"{dim}_pos", F.col(f"{dim}_pos") + F.lit(at).cast("long")))
        at += length
    return reduce(DataFrame.unionByName, moved)


def merge(variables: Sequence[DataFrame], dims: Sequence[str]) -> DataFrame:
    """Fragments with different variables side by side, by position. A variable in two of them is an error."""
    seen: set[str] = set()
    for frame in variables:
        own = set(frame.columns) - {f"{d}_pos" for d in dims}
        if both := own & seen:
            raise ValueError(f"the same variables {sorted(both)} are in more than one fragment")
        seen |= own
    return reduce(lambda a, b: a.join(b, [f"{d}_pos" for d in dims], "full"), variables)


def merge_long(variables: Sequence[tuple[str, DataFrame]], dims: Sequence[str]) -> DataFrame:
    """(variable, <dim>_pos ..., value): variables as rows, which never mix in a group by variable and chunk."""
    frames = [f.select(F.lit(name).alias("variable"), *(f"{d}_pos" for d in dims), F.col(name).cast("double").alias("value")) for name, f in variables]
    return reduce(DataFrame.unionByName, frames)


def writes_coord(merge_positions: Sequence[Column], all_positions: Sequence[Column], has_concat_dim: Column) -> Column:
    """Whether a fragment writes a coordinate: it is first in every merge dimension, and the coordinate has a concat dimension or the fragment is the very first."""
    zero = lambda columns: reduce(lambda a, b: a & b, [c == 0 for c in columns], F.lit(True))
    return zero(merge_positions) & (has_concat_dim | zero(all_positions))


def aligned(start: Column, stop: Column, chunk: int, size: Column | int) -> Column:
    """Whether a region begins on a chunk and ends on one or with the array."""
    size = F.lit(size) if isinstance(size, int) else size
    return (F.pmod(start, F.lit(chunk)) == 0) & ((F.pmod(stop, F.lit(chunk)) == 0) | (stop == size))


def agreed(cells: DataFrame, dims: Sequence[str], variable: str) -> DataFrame:
    """(<dim>_pos ..., variable): the labels that several fragments give for the same positions; different ones are an error.

    NaN agrees with NaN; a null says nothing. The labels are reduced where they lie before they move.
    """
    keys = [f"{d}_pos" for d in dims]
    both = cells.groupBy(*keys).agg(F.min(variable).alias("lo"), F.max(variable).alias("hi"))
    told = F.lit(f"fragments differ in the labels of {variable}")
    return both.select(*keys, F.when(F.col("lo").eqNullSafe(F.col("hi")), F.col("lo")).otherwise(F.raise_error(told)).alias(variable))
