"""From ordinals in the file sequence to offsets in the global array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def offsets(lens: DataFrame, append_offset: int = 0) -> DataFrame:
    """(position, len, start, dimsize) from ``lens(position, len)``, a row for each file of one dimension.

    start is the length of all earlier files plus ``append_offset``, dimsize that of all. The
    window runs over files, never over cells. A position that comes twice is an error.
    """
    before = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    twice = F.count("*").over(Window.partitionBy("position")) > 1
    return lens.select(
        F.when(twice, F.raise_error(F.lit("a position has more than one length"))).otherwise(F.col("position")).alias("position"),
        F.col("len").cast("long").alias("len"),
        (F.coalesce(F.sum("len").over(before), F.lit(0)) + append_offset).cast("long").alias("start"),
        (F.sum("len").over(Window.partitionBy()) + append_offset).cast("long").alias("dimsize"),
    )


def index_items(fragments: DataFrame, lens: DataFrame, concat_dims: Sequence[str], append_offsets: dict[str, int] | None = None) -> DataFrame:
    """``fragments`` with <dim>_start and <dim>_size for each concat dimension; merge positions stay.

    ``fragments`` has a column <dim>_pos for each dimension, ``lens`` is (dim, position, len).
    The offset tables have a row for each file; the planner broadcasts them if they are small.
    """
    for dim in concat_dims:
        if f"{dim}_start" in fragments.columns:
            raise ValueError(f"{dim} is already indexed")
        table = offsets(lens.where(F.col("dim") == dim).select("position", "len"), (append_offsets or {}).get(dim, 0))
        table = table.select(F.col("position").alias(f"{dim}_pos"), F.col("start").alias(f"{dim}_start"), F.col("dimsize").alias(f"{dim}_size"))
        fragments = fragments.join(table, f"{dim}_pos", "left")
    return fragments


def lens_of(cells: DataFrame, fragment: str) -> DataFrame:
    """(position, len): the number of cells of each fragment, counted before they move."""
    return cells.groupBy(F.col(fragment).alias("position")).agg(F.count("*").alias("len"))


def globally_placed(cells: DataFrame, fragment: str, order: str, append_offset: int = 0) -> DataFrame:
    """``cells`` with their global position: the fragment's start plus the place in it by ``order``.

    Places are counted within fragments, so no window crosses them.
    """
    table = offsets(lens_of(cells, fragment), append_offset).select(F.col("position").alias(fragment), "start")
    place = F.row_number().over(Window.partitionBy(fragment).orderBy(order)) - 1
    return cells.withColumn("place", place).join(table, fragment).withColumn("position", F.col("start") + F.col("place")).drop("place", "start")
