"""Virtual stores: chunks as byte ranges of other files, combined and written as tables.

A reference is a row: variable, chunk (its index in each dimension), url, offset, length,
or the bytes themselves in ``inline``. Combining files is a union with moved chunk indexes.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REFERENCE = "variable string, chunk array<long>, url string, offset long, length long, inline binary"


def bucket(position: Column, lo: Column, hi: Column, n: Column, per_bucket: int = 5) -> Column:
    """The bucket of a position among ceil(n / per_bucket) equal ones; the greatest position opens one more. One position has bucket 0."""
    width = (hi - lo) / F.ceil(n / F.lit(per_bucket))
    return F.when(hi == lo, F.lit(0)).otherwise(F.floor((position - lo) / width)).cast("long")


def bucketed(references: DataFrame, position: str, per_bucket: int = 5) -> DataFrame:
    """References with their bucket; the range is one row that every reference meets."""
    span = references.agg(F.min(position).alias("lo"), F.max(position).alias("hi"), F.count(position).alias("n"))
    return references.crossJoin(F.broadcast(span)).withColumn("bucket", bucket(F.col(position), F.col("lo"), F.col("hi"), F.col("n"), per_bucket)).drop("lo", "hi", "n")


def _identical(references: DataFrame, positions: Sequence[str]) -> DataFrame:
    """One row for each chunk of variables that are the same in every file: the first file's; held bytes or lengths that differ are an error."""
    told = F.raise_error(F.format_string("files differ in %s", F.col("variable")))
    held = F.struct(*(F.col(c) for c in ("url", "offset", "length", "inline")))
    same = references.groupBy("variable", "chunk").agg(
        *(F.min(c).alias(f"{c}_lo") for c in ("length", "inline")), *(F.max(c).alias(f"{c}_hi") for c in ("length", "inline")),
        *(F.min(p).alias(p) for p in positions), F.min_by(held, F.struct(*(F.col(p) for p in positions))).alias("held"),
    )
    sound = F.col("length_lo").eqNullSafe(F.col("length_hi")) & F.col("inline_lo").eqNullSafe(F.col("inline_hi"))
    return same.select("variable", "chunk", *positions, F.when(sound, F.col("held")).otherwise(told).alias("held")).select("variable", "chunk", *positions, "held.*")


def _along(rows: DataFrame, position: str, dim: str, dims_of: dict[str, Sequence[str]]) -> DataFrame:
    """Chunk indexes moved along one dimension by the chunks that earlier positions hold; variables without it from the first position."""
    along = {v: list(d).index(dim) for v, d in dims_of.items() if dim in d}
    axis = F.create_map(*(F.lit(x) for v, i in along.items() for x in (v, i))) if along else F.create_map().cast("map<string,int>")
    rows = rows.withColumn("axis", axis[F.col("variable")])
    held = rows.where("axis is not null").groupBy("variable", position).agg((F.max(F.expr("chunk[axis]")) + 1).alias("m"))
    before = Window.partitionBy("variable").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("variable", position, F.coalesce(F.sum("m").over(before), F.lit(0)).alias("moved"))
    moved = rows.where("axis is not null").join(held, ["variable", position])
    moved = moved.withColumn("chunk", F.expr("transform(chunk, (c, i) -> if(i = axis, c + moved, c))")).drop("moved")
    first = rows.where("axis is null").groupBy("variable").agg(F.min(position).alias(position))
    return moved.unionByName(rows.where("axis is null").join(first, ["variable", position])).drop("axis")


def combine(references: DataFrame, position: str | Sequence[str], concat_dim: str | Sequence[str], dims_of: dict[str, Sequence[str]], identical: Sequence[str] = ()) -> DataFrame:
    """References of all files as those of one store, along one dimension or several.

    ``references`` has the file's ``position`` along each ``concat_dim``. Chunk indexes of
    variables with that dimension move by the number of chunks that earlier files hold;
    others are taken from the first file. Those in ``identical`` must have equal held bytes,
    or equal lengths of their ranges, in every file.
    """
    positions, dims = ([x] if isinstance(x, str) else list(x) for x in (position, concat_dim))
    whole = F.col("variable").isin(list(identical))
    rows = references.where(~whole)
    for p, d in zip(positions, dims, strict=True):
        rows = _along(rows, p, d, dims_of)
    if not identical:
        return rows
    return rows.unionByName(_identical(references.where(whole).select("variable", "chunk", "url", "offset", "length", "inline", *positions), positions), allowMissingColumns=True)


def keys(references: DataFrame) -> DataFrame:
    """References with their store key, as ``variable/c/0/1``."""
    return references.withColumn("key", F.concat_ws("/", F.col("variable"), F.lit("c"), F.array_join(F.col("chunk").cast("array<string>"), "/")))


def write_parquet(references: DataFrame, path: str, metadata: dict[str, dict], per_file: int = 10_000) -> None:
    """The references as a table sorted by key, ``per_file`` in a file at most, and the metadata documents as rows without a url."""
    spark = references.sparkSession
    documents = [(f"{k}/zarr.json" if k else "zarr.json", json.dumps(v)) for k, v in metadata.items()]
    docs = spark.createDataFrame(documents, "key string, text string").select("key", F.lit(None).cast("string").alias("url"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("length"), F.encode("text", "utf-8").alias("inline"))
    rows = keys(references).select("key", "url", "offset", "length", "inline").unionByName(docs)
    rows.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").option("maxRecordsPerFile", per_file).parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_json(references: DataFrame, path: str, metadata: dict[str, dict]) -> None:
    """One JSON document of all references, for the readers that want it; the driver streams the rows, so keep it to stores that such readers can open."""
    from ..sources.storage import Target

    refs: dict = {f"{k}/zarr.json" if k else "zarr.json": json.dumps(v) for k, v in metadata.items()}
    for r in keys(references).orderBy("key").toLocalIterator():
        refs[r["key"]] = "base64:" + base64.b64encode(bytes(r["inline"])).decode() if r["inline"] is not None else [r["url"], r["offset"], r["length"]]
    target, _, name = path.rpartition("/")
    Target(target).write(name, json.dumps({"version": 1, "refs": refs}).encode())


def write_combined(references: DataFrame, position: str | Sequence[str], concat_dim: str | Sequence[str], dims_of: dict[str, Sequence[str]], path: str, metadata: dict[str, dict], identical: Sequence[str] = ()) -> DataFrame:
    """Combine the references of all files and write them to ``path``, as its ending says; what was written."""
    if references.isEmpty():
        raise ValueError("there are no references to combine")
    combined = combine(references, position, concat_dim, dims_of, identical)
    if path.endswith(".parquet"):
        write_parquet(combined, path, metadata)
    elif path.endswith(".json"):
        write_json(combined, path, metadata)
    else:
        raise NotImplementedError(f"references are written as .parquet or .json, not as {path.rpartition('/')[2]}")
    return combined
