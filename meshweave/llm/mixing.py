"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Each source has a target and a schedule of how its weight changes over a nominal time t
from 0 to 1. The schedule's integral says when a source's words are due. The sum of all
sources' integrals, the cumulative demand at that time, says where in the training that
is: a document's position is the share of all training words that come before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Base weights by a source's rank, repeating, and how each one's schedule tilts: over the
#: nominal time t from 0 to 1 a source weighs w * (1 + tilt * (2 t - 1)), on average w.
WEIGHTS, TILTS = (5, 2, 1), (-0.5, 0.25, 0.75)
#: A source's words are added up in so many slices of hash order.
SLICE_DIGITS = 3


def words(text: Column) -> Column:
    """Number of runs of other than ASCII white space; null as ''."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size, rank, target) from ``totals(source, source_size)``, a row for each source.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all
    sizes; none gets over ``most`` times its size. Resharing the excess until none is above
    is the same as one level l with targets min(most * size, l * weight): with the sources
    by size / weight, it is the first at which the rest of the demand fits the next source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.array(*(F.lit(float(w)) for w in weights))[F.pmod(F.col("rank"), F.lit(len(weights)))]
    by_room = Window.orderBy(F.col("room") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    return (
        totals.withColumn("rank", rank).withColumn("weight", weight)
        .withColumn("room", F.col("source_size") * F.lit(float(most)))
        .withColumn("before", F.coalesce(F.sum("room").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(everything) - F.col("before")) / F.col("open"))
        .withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("room"), F.struct((F.col("room") / F.col("weight")).alias("r"), "rank", "level")))
        .withColumn("level", F.min("fits").over(everything)["level"])
        .select("source", "source_size", "rank", F.least("room", F.col("level") * F.col("weight")).alias("target"))
    )


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, tilts: Sequence[float] = TILTS, most: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """What the mix takes of each row of ``docs(doc_id, text, source, *keep)``, and when.

    Returns doc_id, size, source_size, target, taken, and for the curriculum whole (how often
    all of the document is taken), part (words of it that are taken once more), position (the
    share of all training words that come before its first pass, to 9 digits) and the terms
    that ``schedule`` needs, sorted by position with what isn't taken last. A source's words
    are passed over in the order of md5(doc_id), as often as they fit its target, and once
    more up to the rest of it, where the stream ends within a document; so the words taken
    are the target's, rounded, and no document exceeds ``most`` times its size.

    Null texts have size 0; a null source is a source; null ids come first in the order of
    their source, and rows that share an id in the order of size. Rows equal in all of these
    take turns, whichever comes first. An empty table gives none. Other columns are not read.
    """
    kept = [F.col(f"`{c}`").alias(f"kept{k}") for k, c in enumerate(keep)]
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("order"), *kept)
    sized = written(sized.withColumn("slice", F.substring("order", 1, SLICE_DIGITS)).withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "sizes")
    slices = sized.groupBy("s", "slice").agg(F.sum("size").alias("here"), F.first("source").alias("source"))
    slices = written(slices, "slices")
    targets = source_targets(slices.groupBy("source").agg(F.sum("here").alias("source_size")), weights, most)
    tilt = F.array(*(F.lit(float(a)) for a in tilts))[F.pmod(F.col("rank"), F.lit(len(tilts)))]
    everything = Window.partitionBy()  # a row for each source
    targets = targets.withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source").withColumn("tilt", tilt)
    targets = targets.withColumn("drift", F.sum(F.col("target") * F.col("tilt")).over(everything) / F.sum("target").over(everything))
    earlier = Window.partitionBy("s").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("start", F.coalesce(F.sum("here").over(earlier), F.lit(0))).join(targets, "s").drop("here", "source")
    inside = Window.partitionBy("s", "slice").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return (
        sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(slices, ["s", "slice"])
        .withColumn("start", F.col("start") + F.col("inside")).withColumn("whole", whole)
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("rest") + 0.5) - F.col("start"))).cast("long"))
        .withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
        .withColumn("position", F.when(F.col("taken") > 0, position(F.col("start"))))
        .select("doc_id", "size", "source_size", "target", "taken", "whole", "part", "position", "start", "tilt", "drift", *(F.col(f"kept{k}").alias(c) for k, c in enumerate(keep)))
        .orderBy(F.col("position").asc_nulls_last(), "doc_id")
    )


def when_due(demand: Column, target: Column, tilt: Column) -> Column:
    """The time at which a source's integrated schedule has asked for ``demand`` words of its ``target``.

    The integral of 1 + a (2 t - 1) is t + a (t t - t); set equal to the share of the demand,
    the root within [0, 1] is the form below, which also holds for a = 0.
    """
    share = F.least(demand / target, F.lit(1.0))
    return 2 * share / (1 - tilt + F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share) + F.when((share == 0) & (tilt == 1), 1.0).otherwise(0.0))


def position(demand: Column) -> Column:
    """The share of all training words before the time at which ``demand`` words of a source are due.

    By the nominal time t all sources together have asked for t + drift (t t - t) of their
    targets, drift being the mean of their tilts by target.
    """
    t = when_due(demand, F.col("target"), F.col("tilt"))
    return F.round(t + F.col("drift") * (t * t - t), 9)


def schedule(planned: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, pass, words, position, *keep): a row for each time that ``plan`` takes words of a document, range-sorted by position.

    Rows of which nothing is taken have none; null ids and repeated rows stay; ties of
    position go by doc_id and pass; an empty plan gives none; other columns are not read.
    """
    passes = F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)
    each = planned.where("taken > 0 and (whole > 0 or part > 0)").withColumn("pass", F.explode(F.sequence(F.lit(0), (passes - 1).cast("int"))))
    return (
        each.withColumn("position", position(F.col("pass") * F.col("source_size") + F.col("start")))
        .select("doc_id", "pass", F.when(F.col("pass") < F.col("whole"), F.col("size")).otherwise(F.col("part")).alias("words"), "position", *keep)
        .orderBy("position", "doc_id", "pass")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, text, source, ...)`` as often as the mix takes them, range-sorted by position, with all their columns.

    A document that the mix leaves before its middle isn't taken that time. Rows are told
    apart by 128 bits of hash over all columns; of rows equal in all columns each is taken as
    often as the most taken of them. Nulls, ties and empty tables are as for :func:`plan`;
    other columns may have any names.
    """
    names = tuple(f"mixed {k}" + " " * sum(c.startswith("mixed ") for c in docs.columns) for k in range(3))
    keyed = docs.select("*", *(F.xxhash64(F.lit(k), *(F.col(f"`{c}`") for c in docs.columns)).alias(names[k]) for k in range(2)))
    planned = written(plan(keyed, keep=names[:2]).withColumn("part", F.when(2 * F.col("part") >= F.col("size"), F.col("part")).otherwise(0)), "plan")
    turns = schedule(planned, names[:2]).groupBy(*names[:2], "pass").agg(F.min("position").alias(names[2])).drop("pass")
    return keyed.join(turns, list(names[:2])).orderBy(names[2], "doc_id").select(*(F.col(f"`{c}`") for c in docs.columns))
