"""Schemas of fragments and their reduction to the schema of the whole.

A schema is held as rows, so the reduction is grouping and counting: DIMS(dim, len),
CHUNKS(dim, at, len), ATTRS(key, value) and VARS(kind, name, dims, shape, dtype, attrs,
encoding), each with a position column for every axis of the file matrix. One step
reduces one axis; attributes stay if every fragment has them with equal values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dtypes import promote
from ..plans.patterns import CombineOp, Dimension

VARS = "kind string, name string, dims array<string>, shape array<long>, dtype string, attrs map<string,string>, encoding map<string,string>"


@dataclass(frozen=True)
class SchemaRows:
    """The schemas of fragments as rows, by the position columns of ``axes`` that aren't reduced yet."""

    axes: tuple[Dimension, ...]
    fragments: DataFrame
    dims: DataFrame
    chunks: DataFrame
    attrs: DataFrame
    vars: DataFrame

    def cached(self) -> SchemaRows:
        """The same rows, kept: a step reads them several times, and they are metadata."""
        return SchemaRows(self.axes, *(getattr(self, f).cache() for f in ("fragments", "dims", "chunks", "attrs", "vars")))

    def release(self) -> None:
        """Forget what :meth:`cached` keeps."""
        for f in ("fragments", "dims", "chunks", "attrs", "vars"):
            getattr(self, f).unpersist()


def _must(ok: Column, what: Column | str, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(what if isinstance(what, Column) else F.lit(what)))


def _kept(rows: DataFrame, groups: Sequence[str], whole: Sequence[str], column: str, out: str) -> DataFrame:
    """Map entries of ``column`` that all rows of a group hold with one value."""
    n = rows.groupBy(*groups).agg(F.count("*").alias("n"))
    each = rows.select(*groups, F.explode(column).alias("k", "v")).groupBy(*groups, "k").agg(F.count("*").alias("m"), F.min("v").alias("v"), F.max("v").alias("w"))
    same = each.join(n, list(groups)) if groups else each.crossJoin(n)
    same = same.where("m = n and v <=> w").groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(out))
    return same


def reduce_axis(rows: SchemaRows, axis: Dimension) -> SchemaRows:
    """Merge the schemas along one axis.

    Along a concat axis its dimension's lengths add up and are noted by position; all other
    dimensions must be there in every fragment with one length. A variable must have the
    same dimensions wherever it is; a data variable may be in one fragment only of a merge
    axis, and must be in all of a concat axis if it has the dimension. Types are promoted.
    """
    if axis not in rows.axes:
        raise ValueError(f"{axis} is no axis of these schemas")
    rows = rows.cached()
    concat = axis.operation is CombineOp.CONCAT
    left = tuple(a for a in rows.axes if a != axis)
    keys = [f"{a.name}_pos" for a in left]
    pos, name = f"{axis.name}_pos", axis.name
    counts = rows.fragments.groupBy(*keys).agg(F.count("*").alias("n"))

    def with_n(df: DataFrame) -> DataFrame:
        return df.join(counts, keys) if keys else df.crossJoin(counts)  # without keys counts is one row

    own = F.lit(concat) & (F.col("dim") == name)
    dims = with_n(rows.dims.groupBy(*keys, "dim").agg(F.count("*").alias("m"), F.min("len").alias("lo"), F.max("len").alias("hi"), F.sum("len").alias("s")))
    told = F.format_string("dimension %s differs in length between fragments", "dim")
    dims = dims.select(*keys, "dim", F.when(own, F.col("s")).otherwise(_must((F.col("m") == F.col("n")) & (F.col("lo") == F.col("hi")), told, F.col("lo"))).alias("len"))

    old = with_n(rows.chunks.groupBy(*keys, "dim", "at").agg(F.count("*").alias("m"), F.min("len").alias("lo"), F.max("len").alias("hi")))
    told = F.format_string("chunks of %s differ between fragments", "dim")
    bad = F.lit(concat) & (F.col("dim") == name)
    old = old.select(*keys, "dim", "at", F.when(bad, F.raise_error(F.lit(f"{name} is already chunked"))).otherwise(_must((F.col("m") == F.col("n")) & (F.col("lo") == F.col("hi")), told, F.col("lo"))).alias("len"))
    chunks = old
    if concat:
        new = rows.dims.where(F.col("dim") == name).groupBy(*keys, "dim", F.col(pos).alias("at")).agg(F.count("*").alias("m"), F.first("len").alias("len"))
        chunks = old.unionByName(new.select(*keys, "dim", "at", _must(F.col("m") == 1, f"a position of {name} comes twice", F.col("len")).alias("len")))

    attrs = with_n(rows.attrs.groupBy(*keys, "key").agg(F.count("*").alias("m"), F.min("value").alias("value"), F.max("value").alias("w")))
    attrs = attrs.where("m = n and value <=> w").select(*keys, "key", "value")

    one = [*keys, "kind", "name"]
    found = rows.vars.groupBy(*one).agg(
        F.count("*").alias("m"), F.count_distinct("dims").alias("kinds"), F.first("dims").alias("dims"), F.collect_set("dtype").alias("dtypes"),
    )
    found = with_n(found)
    has = F.array_contains("dims", name) if concat else F.lit(False)
    sound = (
        F.when(F.col("kinds") > 1, F.raise_error(F.format_string("variable %s has different dimensions", "name")))
        .when(F.lit(not concat) & (F.col("kind") == "data_var") & (F.col("m") > 1), F.raise_error(F.format_string("the same variable %s is in more than one fragment of a merge axis", "name")))
        .when(has & (F.col("m") < F.col("n")), F.raise_error(F.format_string("variable %s is missing from some fragments", "name")))
        .otherwise(F.col("dims"))
    )
    found = found.select(*one, sound.alias("dims"), promote(F.col("dtypes")).alias("dtype"))
    sizes = rows.vars.select(*one, "dims", F.posexplode("shape").alias("i", "size")).withColumn("dim", F.col("dims")[F.col("i")])
    sizes = sizes.groupBy(*one, "i", "dim").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.sum("size").alias("s"))
    told = F.format_string("variable %s has different shapes", "name")
    sizes = sizes.select(*one, "i", F.when(F.lit(concat) & (F.col("dim") == name), F.col("s")).otherwise(_must(F.col("lo") == F.col("hi"), told, F.col("lo"))).alias("size"))
    shapes = sizes.groupBy(*one).agg(F.sort_array(F.collect_list(F.struct("i", "size"))).alias("z")).select(*one, F.transform("z", lambda z: z["size"]).alias("shape"))
    empty = F.create_map().cast("map<string,string>")
    out = found.join(shapes, one, "left")
    for column in ("attrs", "encoding"):
        out = out.join(_kept(rows.vars, one, keys, column, column), one, "left")
    out = out.select(*one, "dims", F.coalesce("shape", F.array().cast("array<long>")).alias("shape"), "dtype", *(F.coalesce(c, empty).alias(c) for c in ("attrs", "encoding")))
    return SchemaRows(left, rows.fragments.select(*keys).distinct() if keys else rows.fragments.limit(1).select(F.lit(1).alias("one")), dims, chunks, attrs, out)


def determine_schema(rows: SchemaRows, axes: Sequence[Dimension]) -> dict:
    """One schema for all fragments: axes are reduced from the last to the first, then the rows collected.

    What is collected has a row for each variable, dimension and file position.
    """
    if rows.fragments.isEmpty():
        raise ValueError("there are no fragments to take a schema from")
    held: list[SchemaRows] = []
    try:
        for axis in reversed(axes):
            held.append(rows.cached())
            rows = reduce_axis(held[-1], axis)
        if rows.axes:
            raise ValueError(f"axes {rows.axes} aren't reduced")
        return collected(rows)
    finally:
        for step in held:
            step.release()


def collected(rows: SchemaRows) -> dict:
    """A reduced schema as a dictionary: attrs, dims, chunks, coords, data_vars."""
    out: dict = {"attrs": {r["key"]: r["value"] for r in rows.attrs.collect()}, "dims": {r["dim"]: r["len"] for r in rows.dims.collect()}, "chunks": {}, "coords": {}, "data_vars": {}}
    for r in rows.chunks.collect():
        out["chunks"].setdefault(r["dim"], {})[r["at"]] = r["len"]
    for r in rows.vars.collect():
        out["coords" if r["kind"] == "coord" else "data_vars"][r["name"]] = {k: r[k] for k in ("dims", "shape", "dtype", "attrs", "encoding")}
    return out


def position_range(positions: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """(*groups, lo, hi, n) of a column in one pass."""
    c = F.col(column)
    return positions.groupBy(*groups).agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n"))


def folded(rows: DataFrame, groups: Sequence[str], column: str, initial: Column, step, finish=None) -> DataFrame:
    """(*groups, value): a fold of a group's values in ascending order, for reductions that built-in ones lack.

    A group's values are held in one row, so it is for small groups such as schema entries.
    """
    values = F.sort_array(F.collect_list(column))
    args = (F.col("values"), initial, step) + ((finish,) if finish else ())
    return rows.groupBy(*groups).agg(values.alias("values")).select(*groups, F.aggregate(*args).alias("value"))


def target_chunks(schema: dict, specified: dict[str, int] | None = None, include_all_dims: bool = True) -> dict[str, int]:
    """The chunk length of each dimension: as specified, else the length at position 0 of a concat dimension, else the whole dimension."""
    out = {dim: schema["chunks"][dim][0] if dim in schema["chunks"] else size for dim, size in schema["dims"].items()} | (specified or {})
    if unknown := out.keys() - schema["dims"].keys():
        if not include_all_dims:
            raise KeyError(f"no dimension {sorted(unknown)}")
    return {dim: c for dim, c in out.items() if include_all_dims or c != schema["dims"][dim]}


def with_prefixed_attrs(schema: dict, attrs: dict[str, str] | None, prefix: str) -> dict:
    """The schema with a user's attributes under a prefix."""
    return schema | {"attrs": schema["attrs"] | {f"{prefix}{k}": v for k, v in (attrs or {}).items()}}
