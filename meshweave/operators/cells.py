"""Operations on the cells of fragments; each is a projection or a filter that Catalyst pushes down."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mask_where(cells: DataFrame, variable: str, keep: Column, fill: Column | None = None) -> DataFrame:
    """The variable where ``keep`` holds, else ``fill`` (null by default)."""
    return cells.withColumn(variable, F.when(keep, F.col(variable)).otherwise(F.lit(None) if fill is None else fill))


def rename(cells: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return cells.withColumnsRenamed(dict(names))


def isel(cells: DataFrame, **parts: slice) -> DataFrame:
    """Cells within contiguous parts of dimensions; their positions begin at 0 again."""
    for dim, part in parts.items():
        if part.step not in (None, 1):
            raise ValueError("only contiguous parts are taken")
        at, start = F.col(f"{dim}_pos"), part.start or 0
        cells = cells.where((at >= start) if part.stop is None else (at >= start) & (at < part.stop)).withColumn(f"{dim}_pos", at - start)
    return cells


def map_limited(rows: DataFrame, fn: Callable, schema: str, max_concurrency: int | None = None) -> DataFrame:
    """``mapInArrow`` with at most ``max_concurrency`` tasks at once."""
    return (rows.repartition(max_concurrency) if max_concurrency else rows).mapInArrow(fn, schema)


def set_attrs(schema: dict, **attrs: str) -> dict:
    """A schema with its attributes replaced."""
    return schema | {"attrs": dict(attrs)}


def promote_to_coord(schema: dict, *names: str) -> dict:
    """A schema in which data variables have become coordinates."""
    return schema | {"coords": schema["coords"] | {n: schema["data_vars"][n] for n in names}, "data_vars": {k: v for k, v in schema["data_vars"].items() if k not in names}}


# The conventions' units of time in microseconds, and the calendars that are the civil one.
TIME_UNITS = {"microseconds": 1, "milliseconds": 1_000, "seconds": 1_000_000, "minutes": 60_000_000, "hours": 3_600_000_000, "days": 86_400_000_000}
CIVIL = ("standard", "gregorian", "proleptic_gregorian")


def decoded(cells: DataFrame, variable: str, attrs: Mapping[str, Any]) -> DataFrame:
    """``variable`` as its attributes mean it: fill values are null, packed numbers are scaled, times are timestamps.

    Times are "<unit> since <date>" in the civil calendar, as timestamps without a zone; other
    units are left as numbers, other calendars are an error. Only built-in functions are used.
    """
    kind, raw = cells.schema[variable].dataType, F.col(variable)
    value = raw
    for name in ("_FillValue", "missing_value"):
        for fill in np.atleast_1d(attrs.get(name, [])).tolist():
            value = F.when(raw != F.lit(fill).cast(kind), value)
    if "scale_factor" in attrs or "add_offset" in attrs:
        value = value.cast("double") * float(attrs.get("scale_factor", 1)) + float(attrs.get("add_offset", 0))
    unit, since, start = str(attrs.get("units", "")).partition(" since ")
    step = TIME_UNITS.get(unit.strip().lower().rstrip("s") + "s") if since else None
    if step:
        if attrs.get("calendar", "standard") not in CIVIL:
            raise ValueError(f"times of the calendar {attrs['calendar']} can't be told as timestamps")
        seconds = F.round(value * F.lit(step)).cast("decimal(38,0)") / F.lit(1_000_000).cast("decimal(7,0)")
        value = F.to_timestamp_ntz(F.lit(start.strip().removesuffix("Z").removesuffix(" UTC"))) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return cells.withColumn(variable, value)
