"""The engine's operators as queries over the driver's tables, each with SQL that gives the same rows.

``events`` is a one-dimensional array along ``event_id`` whose files are days, ``orders``
two variables along ``o_orderkey``, ``embeddings`` a matrix of vectors and components.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import grid
from .functions.names import cache_name_of, with_scheme
from .operators import align, cells, combine, rechunk, references, schema
from .operators.schema import SchemaRows
from .plans.patterns import CombineOp, Dimension, matrix, merkle_chain
from .plans.store import StoreToZarr
from .sources import netcdf3, openers, zarr3
from .sources.storage import Target

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TIME, VARIABLE = Dimension("time", CombineOp.CONCAT), Dimension("variable", CombineOp.MERGE)
#: Chunk of the event axis; vectors and components of a chunk of the embedding matrix.
CHUNK, VECTORS, COMPONENTS = 1000, 100, 16
#: Events of a file where events are written as files; chunks don't end with files.
FILE = 700


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _store_root(spark: SparkSession) -> str:
    """A new folder for a query's own store: in the shared folder if the cluster names one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared}/stores/{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="meshweave-store-")


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, position, len): the event files, one for each day, numbered in order."""
    days = _table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("len"))
    return days.select("day", (F.row_number().over(Window.orderBy("day")) - 1).cast("long").alias("position"), "len")


def _event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, position, value): events at their global positions, found from the days' lengths."""
    events = _table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), "value")
    return align.globally_placed(events, "day", "event_id")


def _matrix_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vec_pos"), F.posexplode("embedding").alias("comp_pos", "x"))
    return vectors.withColumn("comp_pos", F.col("comp_pos").cast("long"))


DAYS = """days AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS position, n AS len
    FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1))"""
SPANS = f"""{DAYS}, spans AS (SELECT position, len, CAST(coalesce(sum(len) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
    CAST(sum(len) OVER () AS BIGINT) AS dimsize FROM days)"""


# File patterns


def _region_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("pos"), F.col("r_name").alias("key"))
    months = spark.range(3).select(F.col("id").alias("pos"), (F.col("id") + 1).alias("key"))
    files = matrix([("region", regions), ("month", months)])
    return files.select("region_pos", "month_pos", F.format_string("store://%s/2024-%02d.nc", "region_key", "month_key").alias("url"))


_PRODUCT = "SELECT CAST(r_regionkey AS BIGINT) AS region_pos, m AS month_pos, 'store://' || r_name || '/2024-0' || (m + 1) || '.nc' AS url FROM region, (SELECT unnest([0, 1, 2])::BIGINT AS m)"


@query(_PRODUCT)
def pattern_product(spark, sf_dir):
    return _region_months(spark, sf_dir)


@query(_PRODUCT + " WHERE m < 2")
def pattern_prune(spark, sf_dir):
    return _region_months(spark, sf_dir).where("month_pos < 2")


@query(f"WITH {SPANS} SELECT position, len, start, dimsize FROM spans")
def pattern_offsets(spark, sf_dir):
    return align.offsets(_days(spark, sf_dir))


@query(f"WITH {SPANS} SELECT position, len, start + 500 AS start, dimsize + 500 AS dimsize FROM spans")
def pattern_offsets_append(spark, sf_dir):
    return align.offsets(_days(spark, sf_dir), 500)


@query(f"WITH {SPANS} SELECT position AS time_pos, start AS time_start, dimsize AS time_size, v AS variable_pos FROM spans, (SELECT unnest([0, 1])::BIGINT AS v)")
def index_items(spark, sf_dir):
    lens = _days(spark, sf_dir).select(F.lit("time").alias("dim"), "position", "len")
    fragments = lens.select(F.col("position").alias("time_pos"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("variable_pos"))
    return align.index_items(fragments, lens, ["time"])


_CHAIN = """WITH RECURSIVE u AS (SELECT row_number() OVER (ORDER BY r_regionkey) AS n, r_name AS url FROM region),
    c(n, hash) AS (SELECT CAST(0 AS BIGINT), sha256('root') UNION ALL
        SELECT c.n + 1, sha256(unhex(c.hash) || unhex(sha256(u.url))) FROM c JOIN u ON u.n = c.n + 1)"""


def _region_chain(spark, sf_dir):
    import hashlib

    files = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("row"), F.col("r_name").alias("url"))
    return merkle_chain(files, hashlib.sha256(b"root").digest())


@query(_CHAIN + " SELECT CAST(n AS INTEGER) AS n, hash FROM c")
def pattern_merkle(spark, sf_dir):
    return _region_chain(spark, sf_dir)


@query(_CHAIN + ", old AS (SELECT hash FROM c WHERE n = 3) SELECT CAST(c.n AS INTEGER) AS resume_at FROM c JOIN old ON c.hash = old.hash")
def pattern_resume(spark, sf_dir):
    chain = _region_chain(spark, sf_dir)
    old = chain.where("n = 3").select("hash")
    return chain.join(old, "hash").select(F.col("n").alias("resume_at"))


# Inputs


@query(r"""SELECT page_id, md5(url) || '-' || right(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(url)), '[^\w\s.\-]+', '_', 'g'), '[\s\-]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g'), 222) AS cache_name FROM pages""")
def cache_names(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", cache_name_of(F.col("url")).alias("cache_name"))


@query("""SELECT page_id, CASE WHEN contains(u, '://') THEN u ELSE 's3://' || u END AS url FROM (
    SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^[a-z]+://', '') ELSE url END AS u FROM pages)""")
def url_scheme_prefix(spark, sf_dir):
    bare = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^[a-z]+://", "")).otherwise(F.col("url"))
    return _table(spark, sf_dir, "pages").select("page_id", with_scheme(bare, "s3").alias("url"))


@query("SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes FROM pages")
def concurrency_map(spark, sf_dir):
    import pyarrow as pa
    import pyarrow.compute as pc

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64())], ["page_id", "n_bytes"])

    return cells.map_limited(_table(spark, sf_dir, "pages").select("page_id", "html"), measure, "page_id long, n_bytes long", 2)


# Cells


@query("SELECT event_id, CASE WHEN value < 50 THEN value END AS value FROM events")
def mask_where(spark, sf_dir):
    return cells.mask_where(_table(spark, sf_dir, "events").select("event_id", "value"), "value", F.col("value") < 50)


@query("SELECT o_orderkey AS x_pos, o_totalprice AS price FROM orders")
def rename_drop(spark, sf_dir):
    return cells.rename(_table(spark, sf_dir, "orders"), {"o_orderkey": "x_pos", "o_totalprice": "price"}).select("x_pos", "price")


@query("SELECT o_orderkey - 100 AS x_pos, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def isel_slice(spark, sf_dir):
    return cells.isel(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("x_pos"), "o_totalprice"), x=slice(100, 200))


@query("SELECT event_type, count(*) AS n_fragments, CAST(sum(len) AS BIGINT) AS n_items FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS len FROM events GROUP BY 1, 2) GROUP BY 1")
def nest_dim(spark, sf_dir):
    """All dimensions but the day group the fragments."""
    inner = _table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("len"))
    return inner.groupBy("event_type").agg(F.count("*").alias("n_fragments"), F.sum("len").alias("n_items"))


# Schemas


def _day_schemas(spark: SparkSession, sf_dir: str) -> SchemaRows:
    """Two merge fragments (value, count) for each day: the schema rows of a file matrix."""
    days = _days(spark, sf_dir).cache()  # a row for each day, read again by every part of the schema
    files = days.crossJoin(spark.range(2).select(F.col("id").alias("variable_pos"))).withColumnRenamed("position", "time_pos")
    keys = ["time_pos", "variable_pos"]
    sizes = F.array(F.struct(F.lit("time").alias("dim"), F.col("len")), F.struct(F.lit("lat").alias("dim"), F.lit(18).cast("long").alias("len")))
    attrs = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("conventions", F.lit('"CF 1.6"')), ("day", F.to_json(F.struct("day"))), ("variable", F.col("variable_pos").cast("string")))))
    text = lambda **kw: F.create_map(*(x for k, v in kw.items() for x in (F.lit(k), v)))
    entry = lambda kind, name, dims, shape, dtype, a: F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.array(*map(F.lit, dims)).alias("dims"), F.array(*shape).alias("shape"), dtype.alias("dtype"), a.alias("attrs"), F.create_map().cast("map<string,string>").alias("encoding"))
    lat = F.lit(18).cast("long")
    name = F.when(F.col("variable_pos") == 0, F.lit("value")).otherwise(F.lit("count"))
    small = F.when(F.col("variable_pos") == 1, F.lit("int64")).when(F.col("time_pos") % 2 == 0, F.lit("float32")).otherwise(F.lit("int32"))
    found = F.array(
        entry("coord", F.lit("time"), ["time"], [F.col("len")], F.lit("int64"), text(units=F.lit('"days"'), day=F.to_json(F.struct("day")))),
        entry("coord", F.lit("lat"), ["lat"], [lat], F.lit("float64"), text(units=F.lit('"degrees_north"'))),
        entry("data_var", name, ["time", "lat"], [F.col("len"), lat], small, text(long_name=name, day=F.to_json(F.struct("day")))),
    )
    chunks = spark.createDataFrame([], "time_pos long, variable_pos long, dim string, at long, len long")
    return SchemaRows((TIME, VARIABLE), files.select(*keys), files.select(*keys, F.inline(sizes)), chunks, files.select(*keys, F.inline(attrs)), files.select(*keys, F.inline(found)))


def _whole(spark, sf_dir) -> SchemaRows:
    return schema.reduce_axis(schema.reduce_axis(_day_schemas(spark, sf_dir), VARIABLE), TIME)


@query("SELECT 'time' AS dim, count(*) AS len FROM events UNION ALL SELECT 'lat', 18")
def schema_dims(spark, sf_dir):
    return _whole(spark, sf_dir).dims.select("dim", "len")


@query(f"WITH {DAYS} SELECT 'time' AS dim, position AS at, len FROM days")
def schema_chunks(spark, sf_dir):
    return _whole(spark, sf_dir).chunks.select("dim", "at", "len")


@query("""SELECT 'conventions' AS key, '"CF 1.6"' AS value""")
def schema_attrs(spark, sf_dir):
    return _whole(spark, sf_dir).attrs.select("key", "value")


@query("""SELECT * FROM (VALUES ('int8', 'int16', 'int16'), ('float32', 'int16', 'float32'), ('float32', 'int32', 'float64'), ('int64', 'uint64', 'float64'), ('bool', 'uint8', 'uint8'), ('float16', 'int8', 'float16'), ('float64', 'complex64', 'complex128')) t(a, b, dtype)""")
def schema_dtype(spark, sf_dir):
    from .functions.dtypes import promote

    pairs = [("int8", "int16"), ("float32", "int16"), ("float32", "int32"), ("int64", "uint64"), ("bool", "uint8"), ("float16", "int8"), ("float64", "complex64")]
    return spark.createDataFrame(pairs, "a string, b string").select("a", "b", promote(F.array("a", "b")).alias("dtype"))


@query("""SELECT kind, name, dims, array_to_string([CASE WHEN s = 0 THEN n ELSE s END for s in sizes], ',') AS shape, dtype, units FROM (VALUES
    ('coord', 'time', 'time', [0], 'int64', '"days"'), ('coord', 'lat', 'lat', [18], 'float64', '"degrees_north"'),
    ('data_var', 'value', 'time,lat', [0, 18], 'float64', NULL), ('data_var', 'count', 'time,lat', [0, 18], 'int64', NULL)) t(kind, name, dims, sizes, dtype, units),
    (SELECT count(*) AS n FROM events)""")
def schema_vars(spark, sf_dir):
    return _whole(spark, sf_dir).vars.select("kind", "name", F.array_join("dims", ",").alias("dims"), F.array_join(F.col("shape").cast("array<string>"), ",").alias("shape"), "dtype", F.col("attrs")["units"].alias("units"))


@query("SELECT 'time first' AS how, count(*) AS time_len, 4 AS n_vars FROM events UNION ALL SELECT 'variable first', count(*), 4 FROM events")
def determine_schema_nested(spark, sf_dir):
    """Either order of the axes gives the same schema."""
    rows = []
    for how, axes in (("time first", (VARIABLE, TIME)), ("variable first", (TIME, VARIABLE))):
        found = schema.determine_schema(_day_schemas(spark, sf_dir), axes)
        rows.append((how, found["dims"]["time"], len(found["coords"]) + len(found["data_vars"])))
    return spark.createDataFrame(rows, "how string, time_len long, n_vars int")


@query("SELECT event_type, min(event_id) AS lo, max(event_id) AS hi, count(event_id) AS n FROM events GROUP BY 1 UNION ALL SELECT NULL, min(event_id), max(event_id), count(event_id) FROM events")
def minmaxcount(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    both = schema.position_range(events, "event_id").select(F.lit(None).cast("string").alias("event_type"), "lo", "hi", "n")
    return schema.position_range(events, "event_id", ["event_type"]).unionByName(both)


@query("SELECT n_regionkey, CAST(sum(n_nationkey * n_nationkey) AS BIGINT) AS value FROM nation GROUP BY 1")
def custom_reduce(spark, sf_dir):
    return schema.folded(_table(spark, sf_dir, "nation"), ["n_regionkey"], "n_nationkey", F.lit(0).cast("long"), lambda a, x: a + x * x)


# Chunk grids


def _irregular(spark: SparkSession, sizes: tuple[int, ...]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(sizes)), "chunk long, size long")


_BOUNDS = "(VALUES (0, 0, 2), (1, 2, 6), (2, 6, 9)) b(chunk, lo, hi)"


@query(f"SELECT 'irregular' AS kind, CAST(chunk AS BIGINT) AS chunk, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM {_BOUNDS} UNION ALL SELECT 'uniform', i, i * 1000, least((i + 1) * 1000, n) FROM (SELECT count(*) AS n FROM events), range(100000) r(i) WHERE i * 1000 < n")
def chunk_slice(spark, sf_dir):
    n = _table(spark, sf_dir, "events").count()
    irregular = grid.bounds_table(_irregular(spark, (2, 4, 3))).select(F.lit("irregular").alias("kind"), "chunk", "lo", "hi")
    return irregular.unionByName(grid.chunk_spans(spark, CHUNK, n).select(F.lit("uniform").alias("kind"), "chunk", "lo", "hi"))


def _day_chunks(spark, sf_dir) -> DataFrame:
    """(chunk, size): an axis of all events in chunks of whole days."""
    return _days(spark, sf_dir).select(F.col("position").alias("chunk"), F.col("len").alias("size"))


@query(f"WITH {SPANS} SELECT event_id AS position, event_id // 1000 AS uniform, position AS chunk FROM events JOIN spans ON start <= event_id AND event_id < start + len".replace("position AS chunk", "spans.position AS chunk"))
def chunk_of_index(spark, sf_dir):
    positions = _table(spark, sf_dir, "events").select(F.col("event_id").alias("position"), grid.chunk_of("event_id", CHUNK).alias("uniform"))
    return grid.chunks_of_positions(positions, grid.bounds_table(_day_chunks(spark, sf_dir)))


@query(f"WITH {SPANS} SELECT position, unnest(range(start // 1000, (start + len - 1) // 1000 + 1)) AS chunk FROM spans")
def chunks_of_slice(spark, sf_dir):
    return align.offsets(_days(spark, sf_dir)).select("position", F.explode(grid.chunks_met("start", "len", CHUNK)).alias("chunk"))


@query(f"""WITH {SPANS}, u AS (SELECT i AS other_chunk, i * 1000 AS lo, least((i + 1) * 1000, n) AS hi FROM (SELECT count(*) AS n FROM events), range(1000000) r(i) WHERE i * 1000 < n)
    SELECT CAST(position AS BIGINT) AS chunk, other_chunk FROM spans, u WHERE start < hi AND lo < start + len AND (lo < start OR hi > start + len)""")
def chunk_conflicts(spark, sf_dir):
    days = grid.bounds_table(_day_chunks(spark, sf_dir))
    return grid.chunk_conflicts(days, grid.chunk_spans(spark, CHUNK, _table(spark, sf_dir, "events").count()))


@query(f"WITH {DAYS} SELECT CAST(position * 4 + part AS BIGINT) AS chunk, CAST(len // 4 + CASE WHEN part = 3 THEN len % 4 ELSE 0 END AS BIGINT) AS size FROM days, (SELECT unnest(range(4)) AS part)")
def chunk_subset(spark, sf_dir):
    return grid.subset_sizes(_day_chunks(spark, sf_dir), 4)


@query(f"WITH {DAYS} SELECT CAST(position // 4 AS BIGINT) AS chunk, CAST(sum(len) AS BIGINT) AS size FROM days GROUP BY 1")
def chunk_consolidate(spark, sf_dir):
    return grid.consolidated_sizes(_day_chunks(spark, sf_dir), 4)


@query(f"WITH {DAYS} SELECT CAST(position AS BIGINT) AS position, part, CAST(len // 7 + CASE WHEN part = 6 THEN len % 7 ELSE 0 END AS BIGINT) AS size FROM days, (SELECT unnest(range(7)) AS part)")
def calc_subsets(spark, sf_dir):
    return grid.subset_sizes(_day_chunks(spark, sf_dir), 7).select(F.expr("chunk div 7").alias("position"), F.expr("chunk % 7").alias("part"), "size")


@query("SELECT i AS chunk, i * 999 AS lo, least((i + 1) * 999, n) AS hi FROM (SELECT count(*) AS n FROM orders), range(1000000) r(i) WHERE i * 999 < n")
def uniform_grid(spark, sf_dir):
    return grid.chunk_spans(spark, 999, _table(spark, sf_dir, "orders").count())


@query(f"""WITH {DAYS}, f AS (SELECT CAST(len AS BIGINT) AS first_len, (SELECT count(*) FROM events) AS n FROM days WHERE position = 0)
    SELECT 'default' AS how, 'time' AS dim, first_len AS chunk FROM f UNION ALL SELECT 'default', 'lat', 18 UNION ALL SELECT 'given', 'time', 1000 UNION ALL SELECT 'given', 'lat', 18
    UNION ALL SELECT 'short', 'time', 1000 FROM f WHERE n <> 1000""")
def target_chunks(spark, sf_dir):
    found = schema.collected(_whole(spark, sf_dir))
    sets = {"default": schema.target_chunks(found), "given": schema.target_chunks(found, {"time": CHUNK}), "short": schema.target_chunks(found, {"time": CHUNK}, include_all_dims=False)}
    return spark.createDataFrame([(how, dim, size) for how, chunks in sets.items() for dim, size in chunks.items()], "how string, dim string, chunk long")


# Rechunking


def _day_fragments(spark, sf_dir) -> DataFrame:
    return align.offsets(_days(spark, sf_dir)).select("position", F.col("start").alias("time_start"), F.col("len").alias("time_len"), F.col("dimsize").alias("time_size"))


@query(f"WITH {SPANS}, s AS (SELECT *, unnest(range(start // 1000, (start + len - 1) // 1000 + 1)) AS c FROM spans) SELECT position, c AS time_chunk, greatest(start, c * 1000) AS time_lo, least(start + len, (c + 1) * 1000) AS time_hi FROM s")
def split_fragments(spark, sf_dir):
    return rechunk.split_fragments(_day_fragments(spark, sf_dir), {"time": CHUNK}).select("position", "time_chunk", "time_lo", "time_hi")


@query("""SELECT v * 250 AS vec_start, c AS comp_start, vc AS vec_chunk, cc AS comp_chunk, greatest(v * 250, vc * 100) AS vec_lo, least(least((v + 1) * 250, n), (vc + 1) * 100) AS vec_hi, greatest(c, cc * 16) AS comp_lo, least(c + 24, (cc + 1) * 16, 64) AS comp_hi
    FROM (SELECT count(*) AS n FROM embeddings), range(1000) a(v), (SELECT unnest([0::BIGINT, 24, 48]) AS c), range(10000) b(vc), range(4) d(cc)
    WHERE v * 250 < n AND vc * 100 < least((v + 1) * 250, n) AND (vc + 1) * 100 > v * 250 AND cc * 16 < least(c + 24, 64) AND (cc + 1) * 16 > c""")
def split_multidim(spark, sf_dir):
    n = _table(spark, sf_dir, "embeddings").count()
    blocks = grid.chunk_spans(spark, 250, n).crossJoin(grid.chunk_spans(spark, 24, 64).select(F.col("lo").alias("comp_start"), (F.col("hi") - F.col("lo")).alias("comp_len")))
    blocks = blocks.select(F.col("lo").alias("vec_start"), (F.col("hi") - F.col("lo")).alias("vec_len"), "comp_start", "comp_len")
    return rechunk.split_fragments(blocks, {"vec": VECTORS, "comp": COMPONENTS}).select("vec_start", "comp_start", "vec_chunk", "comp_chunk", "vec_lo", "vec_hi", "comp_lo", "comp_hi")


_CHUNKED = "count(*) AS n, min(event_id) AS lo, max(event_id) AS hi, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS scaled"


@query(f"SELECT event_id // 1000 AS chunk, {_CHUNKED} FROM events GROUP BY 1")
def rechunk_1d(spark, sf_dir):
    """Days to chunks of the event axis: offsets from the days' lengths, then partial sums by chunk, shuffled once."""
    placed = _event_cells(spark, sf_dir).select(grid.chunk_of("position", CHUNK).alias("chunk"), "event_id", F.round(F.col("value") * 100).cast("long").alias("scaled"))
    return placed.groupBy("chunk").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.sum("scaled").alias("scaled"))


@query("SELECT vec_id // 100 AS vec_chunk, (i - 1) // 16 AS comp_chunk, count(*) AS n, CAST(sum(CAST(round(CAST(embedding[i] AS DOUBLE) * 10000) AS BIGINT)) AS BIGINT) AS scaled FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2")
def rechunk_2d(spark, sf_dir):
    chunked = rechunk.with_chunks(_matrix_cells(spark, sf_dir), {"vec": VECTORS, "comp": COMPONENTS})
    return chunked.groupBy("vec_chunk", "comp_chunk").agg(F.count("*").alias("n"), F.sum(F.round(F.col("x").cast("double") * 10000).cast("long")).alias("scaled"))


@query("SELECT event_id // 1000 AS time_chunk, count(*) AS n_cells, CAST(count(*) * 8 + (1000 - count(*)) * 8 AS BIGINT) AS n_bytes FROM events GROUP BY 1")
def rechunk_blocks(spark, sf_dir):
    """Chunks as blocks of bytes, one for each, assembled where their cells meet."""
    events = _event_cells(spark, sf_dir).select(F.col("position").alias("time_pos"), "value")
    blocks = rechunk.assemble(events, "value", "float64", {"time": 0}, {"time": CHUNK})
    return blocks.select("time_chunk", "n_cells", F.octet_length("data").cast("long").alias("n_bytes"))


@query(f"WITH {SPANS} SELECT position % 3 AS grp, count(*) = count(DISTINCT start) AS \"full\", count(*) = 1 AS contiguous FROM spans GROUP BY 1 UNION ALL SELECT -1, true, true")
def combine_validate(spark, sf_dir):
    """Days dealt into three groups don't follow each other; all days together do."""
    parts = _day_fragments(spark, sf_dir)
    groups = parts.withColumn("grp", F.col("position") % 3).unionByName(parts.withColumn("grp", F.lit(-1).cast("long")))
    return rechunk.validate(groups, ["time"], ["grp"])


def _order_variables(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    at = F.col("o_orderkey").alias("x_pos")
    return [(name, orders.select(at, name)) for name in ("o_totalprice", "o_custkey")]


@query("SELECT variable, x // 1000 AS x_chunk, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS scaled FROM (SELECT 'o_totalprice' AS variable, o_orderkey AS x, o_totalprice AS value FROM orders UNION ALL SELECT 'o_custkey', o_orderkey, CAST(o_custkey AS DOUBLE) FROM orders) GROUP BY 1, 2")
def rechunk_merge_dim(spark, sf_dir):
    long = rechunk.with_chunks(combine.merge_long(_order_variables(spark, sf_dir), ["x"]), {"x": CHUNK})
    return long.groupBy("variable", "x_chunk").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("scaled"))


# Combining


@query("SELECT o_orderkey AS x_pos, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS o_custkey FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 5 <> 0")
def merge_vars(spark, sf_dir):
    (_, price), (_, customer) = _order_variables(spark, sf_dir)
    return combine.merge([price.where("x_pos % 3 <> 0"), customer.where("x_pos % 5 <> 0")], ["x"])


@query("SELECT event_id AS time_pos, value FROM events")
def concat_union(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select(F.col("event_id").alias("time_pos"), "value")
    n = events.count()
    half = n // 2
    return combine.concat([cells.isel(events, time=slice(0, half)), cells.isel(events, time=slice(half, None))], "time", [half, n - half])


@query(f"WITH {DAYS} SELECT position AS time_pos, v AS variable_pos, c AS coord FROM days, (SELECT unnest([0, 1])::BIGINT AS v), (SELECT unnest(['time', 'lat']) AS c) WHERE v = 0 AND (c = 'time' OR position = 0)")
def first_in_merge(spark, sf_dir):
    days = _days(spark, sf_dir).select(F.col("position").alias("time_pos"))
    every = days.crossJoin(spark.range(2).select(F.col("id").alias("variable_pos"))).withColumn("coord", F.explode(F.array(F.lit("time"), F.lit("lat"))))
    return every.where(combine.writes_coord([F.col("variable_pos")], [F.col("time_pos"), F.col("variable_pos")], F.col("coord") == "time"))


@query(f"WITH {SPANS} SELECT position, start, start + len AS stop, start % 1000 = 0 AND ((start + len) % 1000 = 0 OR start + len = dimsize) AS aligned FROM spans")
def region_alignment(spark, sf_dir):
    spans = align.offsets(_days(spark, sf_dir)).withColumn("stop", F.col("start") + F.col("len"))
    return spans.select("position", "start", "stop", combine.aligned(F.col("start"), F.col("stop"), CHUNK, F.col("dimsize")).alias("aligned"))


# Stores


def _event_schema(n: int) -> dict:
    entry = lambda dtype, **attrs: {"dims": ["time"], "shape": [n], "dtype": dtype, "attrs": {k: json.dumps(v) for k, v in attrs.items()}, "encoding": {}}
    return {"attrs": {"title": '"events"'}, "dims": {"time": n}, "chunks": {}, "coords": {"time": entry("int64", units="events")}, "data_vars": {"value": entry("float64", units="1")}}


def _event_variables(events: DataFrame) -> dict[str, DataFrame]:
    return {"time": events.select("time_pos", F.col("time_pos").alias("time")), "value": events.select("time_pos", "value")}


def _events(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("time_pos"), "value")


@query("SELECT event_id AS time_pos, value FROM events")
def zarr_roundtrip(spark, sf_dir):
    events = _events(spark, sf_dir)
    store = StoreToZarr("events.zarr", [TIME], _store_root(spark), {"time": CHUNK}, encoding={"value": {"codec": "zstd"}, "time": {"codec": "gzip"}})
    return zarr3.read(spark, store.write(_event_schema(events.count()), _event_variables(events)).root, "value")


@query("SELECT event_id AS time_pos, value FROM events WHERE event_id >= 150 AND event_id < 900")
def zarr_pushdown(spark, sf_dir):
    """A part of a store read through the data source: the comparisons choose the chunks that are opened."""
    from .sources import datasource

    datasource.register(spark)
    events, root = _events(spark, sf_dir), f"{_store_root(spark)}/events.zarr"
    n = events.count()
    blocks = rechunk.assemble(events, "value", "float64", {"time": n}, {"time": 100})
    options = {"path": root, "variable": "value", "dims": "time", "shape": str(n), "chunks": "100", "dtype": "float64", "codec": "zstd"}
    blocks.select("time_chunk", "data").write.format("meshweave").options(**options).mode("append").save()
    return spark.read.format("meshweave").options(path=root, variable="value").load().where("time_pos >= 150 and time_pos < 900")


@query("SELECT event_id AS time_pos, value FROM events")
def zarr_append(spark, sf_dir):
    """The first half, then the second one behind it."""
    events, root = _events(spark, sf_dir), _store_root(spark)
    n = events.count()
    half = n // 2 // CHUNK * CHUNK or n // 2
    chunk = {"time": min(CHUNK, half)}
    first, second = cells.isel(events, time=slice(0, half)), cells.isel(events, time=slice(half, None))
    StoreToZarr("events.zarr", [TIME], root, chunk).write(_event_schema(half), _event_variables(first))
    target = StoreToZarr("events.zarr", [TIME], root, chunk, append_dim="time").write(_event_schema(n - half), _event_variables(second))
    return zarr3.read(spark, target.root, "value")


@query("SELECT i AS time_chunk FROM range(2) r(i)")
def zarr_dynamic_chunks(spark, sf_dir):
    events = _events(spark, sf_dir)
    store = StoreToZarr("events.zarr", [TIME], _store_root(spark), dynamic_chunking_fn=lambda s, parts: {"time": -(-s["dims"]["time"] // parts)}, dynamic_chunking_fn_kwargs={"parts": 2})
    target = store.write(_event_schema(events.count()), _event_variables(events))
    return zarr3.chunk_table(spark, zarr3.array_documents(target)["value"]).select(F.col("i0").alias("time_chunk"))


@query("SELECT 'time' AS coord, 1 AS n_chunks, true AS consolidated, (SELECT CAST(sum(event_id) AS BIGINT) FROM events) AS total")
def consolidate_coords(spark, sf_dir):
    events = _events(spark, sf_dir)
    target = StoreToZarr("events.zarr", [TIME], _store_root(spark), {"time": CHUNK}).write(_event_schema(events.count()), _event_variables(events))
    zarr3.consolidate_metadata(target)
    names = zarr3.consolidate_coordinates(target)
    documents = zarr3.read_document(target)["consolidated_metadata"]["metadata"]
    total = zarr3.read(spark, target.root, "time").agg(F.sum("time").alias("total"))
    n = len([p for p, _ in target.files("time/c")])
    return total.select(F.lit(names[0]).alias("coord"), F.lit(n).alias("n_chunks"), F.lit(documents["time"]["chunk_grid"]["configuration"]["chunk_shape"] == documents["time"]["shape"]).alias("consolidated"), "total")


# From files to a store


def _event_files(spark, sf_dir, root: str) -> DataFrame:
    """(time_pos, variable_pos, url): events written as NetCDF files of FILE events, one for the values and one for the users."""

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("event_id")
        k, time = table.column("file")[0].as_py(), table.column("event_id").to_numpy()
        held = {"value": table.column("value").to_numpy(), "user": table.column("user_id").to_numpy()}
        for name, array in held.items():
            variables = {"time": (("time",), time, {"units": "events"}), "station": (("station",), np.array([7, 9], "i4"), {}), name: (("time",), array, {"long_name": name})}
            Target(root).write(f"{name}-{k}.nc", netcdf3.write({"time": len(time), "station": 2}, variables, {"title": "events"}, "time"))
        return pa.table({"time_pos": pa.array([k] * 2, pa.int64()), "variable_pos": pa.array([0, 1], pa.int64()), "url": [f"{root}/{name}-{k}.nc" for name in held]})

    events = _table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / FILE).alias("file"), "event_id", "value", "user_id")
    files = events.groupBy("file").applyInArrow(write, "time_pos long, variable_pos long, url string")
    files.write.parquet(f"{root}/files")  # so that no later use writes the inputs again
    return spark.read.parquet(f"{root}/files")


@query("SELECT event_id AS time_pos, event_id AS time, value, CAST(user_id AS INTEGER) AS user FROM events")
def store_from_files(spark, sf_dir):
    """NetCDF files of two variables to one store: headers, schema, offsets, parts of chunks, blocks; the store's cells."""
    root = _store_root(spark)
    files = _event_files(spark, sf_dir, f"{root}/inputs")
    target = StoreToZarr("events.zarr", [TIME, VARIABLE], root, {"time": CHUNK}, encoding={"value": {"codec": "zstd"}}).build(files)
    parts = [zarr3.read(spark, target.root, name) for name in ("time", "value", "user")]
    return combine.merge(parts, ["time"]).withColumn("time", F.col("time").cast("long"))


@query("SELECT 'user' AS name, ['time'] AS dims, (SELECT count(*) FROM events) AS n UNION ALL SELECT 'value', ['time'], (SELECT count(*) FROM events)")
def schema_from_files(spark, sf_dir):
    """The schema of files from their headers, one axis reduced after the other."""
    files = _event_files(spark, sf_dir, f"{_store_root(spark)}/inputs")
    rows = openers.scan_schemas(files, (TIME, VARIABLE))
    whole = schema.reduce_axis(schema.reduce_axis(rows, VARIABLE), TIME)
    return whole.vars.where("kind = 'data_var'").select("name", "dims", F.col("shape")[0].alias("n"))


@query("""SELECT event_id AS time_pos, CASE WHEN user_id % 50 = 7 THEN NULL ELSE CAST(user_id % 50 AS DOUBLE) / 2 + 10 END AS packed,
    strftime(TIMESTAMP '2001-03-04 06:00:00' + to_minutes(event_id), '%Y-%m-%d %H:%M:%S') AS at FROM events""")
def cf_decode(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select(F.col("event_id").alias("time_pos"), F.pmod("user_id", F.lit(50)).cast("short").alias("packed"), F.col("event_id").alias("at"))
    packed = cells.decoded(events, "packed", {"scale_factor": 0.5, "add_offset": 10, "_FillValue": 7})
    return cells.decoded(packed, "at", {"units": "minutes since 2001-03-04 06:00:00"}).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


# References


@query(f"""WITH {DAYS}, s AS (SELECT min(position) AS lo, max(position) AS hi, count(*) AS n FROM days)
    SELECT position, CAST(floor((position - lo) / ((hi - lo) / ceil(n / 5.0))) AS BIGINT) AS bucket FROM days, s""")
def refs_bucket(spark, sf_dir):
    return references.bucketed(_days(spark, sf_dir).select("position"), "position").select("position", "bucket")


def _day_references(spark, sf_dir) -> DataFrame:
    """Every day's file has two chunks of ``value`` and one of ``lat``."""
    days = _days(spark, sf_dir).select("position", F.concat(F.lit("store://"), F.col("day").cast("string")).alias("url"), "len")
    each = lambda name, chunk, offset, length: F.struct(F.lit(name).alias("variable"), F.array(*(F.lit(c).cast("long") for c in chunk)).alias("chunk"), offset.alias("offset"), length.alias("length"))
    half = F.col("len") * 4
    rows = F.array(each("value", (0, 0), F.lit(0).cast("long"), half), each("value", (1, 0), half, half), each("lat", (0,), half * 2, F.lit(144).cast("long")))
    return days.select("position", "url", F.inline(rows)).withColumn("inline", F.lit(None).cast("binary"))


_REFS = f"""WITH {DAYS}, r AS (SELECT 'value/c/' || (position * 2 + h) || '/0' AS key, 'store://' || day AS url, CAST(h * len * 4 AS BIGINT) AS "offset", CAST(len * 4 AS BIGINT) AS length FROM days, (SELECT unnest([0, 1]) AS h)
    UNION ALL SELECT 'lat/c/0', 'store://' || day, CAST(len * 8 AS BIGINT), 144 FROM days WHERE position = 0)"""


@query(_REFS + ' SELECT key, url, "offset", length FROM r')
def refs_combine(spark, sf_dir):
    combined = references.combine(_day_references(spark, sf_dir), "position", "time", {"value": ["time", "lat"], "lat": ["lat"]}, ["lat"])
    return references.keys(combined).select("key", "url", "offset", "length")


@query(_REFS + """ SELECT key, url, "offset", length FROM r UNION ALL SELECT 'zarr.json', NULL, NULL, NULL""")
def refs_write(spark, sf_dir):
    combined = references.combine(_day_references(spark, sf_dir), "position", "time", {"value": ["time", "lat"], "lat": ["lat"]}, ["lat"])
    path = f"{_store_root(spark)}/reference.parquet"
    references.write_parquet(combined, path, {"": zarr3.group_document()})
    return references.read_parquet(spark, path).select("key", "url", "offset", "length")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event days rechunked to a store's grid."""
    return rechunk_1d(spark, sf_dir)
