import json
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.operators import align, cells, combine, rechunk, references, schema
from meshweave.plans.patterns import CombineOp, Dimension, pattern_from_file_sequence
from meshweave.plans.store import StoreToZarr, injected, rechunk_store
from meshweave.sources import netcdf3, openers, zarr3
from meshweave.sources.storage import FlatCache, RequiredAtRuntime, Target
from meshweave.streaming.append import append_stream

TIME, VARIABLE = Dimension("time", CombineOp.CONCAT), Dimension("variable", CombineOp.MERGE)


def values(nt=10):
    rng = np.random.default_rng(2)
    return rng.random((nt, 4, 6)), rng.integers(0, 10, (nt, 4, 6)).astype("i4")


def files(path, nt=10, per_file=1, record_dim="time", split=False):
    """NetCDF classic files of ``per_file`` days; with ``split`` one for each variable."""
    foo, bar = values(nt)
    out = []
    for k, name in enumerate(("foo", "bar") if split else ("both",)):
        for i in range(0, nt, per_file):
            part = slice(i, i + per_file)
            own = {"foo": (("time", "lat", "lon"), foo[part], {"long_name": "Fantastic"}), "bar": (("time", "lat", "lon"), bar[part], {"long_name": "Beautiful"})}
            n = len(foo[part])
            variables = {"time": (("time",), np.arange(i, i + n, dtype="i4"), {"units": "days"}), "lat": (("lat",), np.linspace(-9, 9, 4), {}), **({name: own[name]} if split else own)}
            url = f"{path}/{name}{i:03d}.nc"
            with open(url, "wb") as f:
                f.write(netcdf3.write({"time": n, "lat": 4, "lon": 6}, variables, {"conventions": "CF 1.6", "day": i}, record_dim))
            out.append((i // per_file, k, url))
    return out


def filled(rows, variable, dims, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        out[tuple(r[f"{d}_pos"] for d in dims)] = r[variable]
    return out


@pytest.mark.parametrize("record_dim", ["time", None])
def test_netcdf3(tmp_path, record_dim):
    for _, _, url in files(tmp_path, 4, 2, record_dim):
        raw = open(url, "rb").read()
        h = netcdf3.read_header(raw)
        i = int(url[-6:-3])
        foo, bar = values(4)
        assert np.array_equal(netcdf3.read_variable(raw, h, "foo"), foo[i : i + 2]) and np.array_equal(netcdf3.read_variable(raw, h, "bar"), bar[i : i + 2])
        assert h.attrs == {"conventions": "CF 1.6", "day": i} and h.variables["foo"].attrs["long_name"] == "Fantastic"
        parts = [np.frombuffer(raw, ">f8", n // 8, at) for _, at, n in netcdf3.byte_ranges(h, "foo")]
        assert np.array_equal(np.concatenate(parts), foo[i : i + 2].ravel())
    with pytest.raises(ValueError):
        netcdf3.read_header(b"nothing of the kind")


def test_engines():
    assert openers.engine_for("netcdf3")["engine"] == "netcdf3"
    with pytest.raises(ValueError):
        openers.engine_for("zarr", {"engine": "hdf5"})
    with pytest.warns(UserWarning):
        openers.engine_for("zarr", {"engine": "zarr"})
    with pytest.warns(UserWarning):
        assert "engine" not in openers.engine_for("unknown")
    assert openers.sniff(b"CDF\x01...") == "netcdf3" and openers.sniff(b"GRIB") == "grib"
    with pytest.raises(ValueError):
        openers.sniff(b"....")


def test_offsets(spark):
    lens = spark.createDataFrame(list(enumerate([2, 2, 3, 2, 2])), "position long, len long")
    for extra in (0, 5, 500):
        rows = align.offsets(lens, extra).orderBy("position").collect()
        assert [r.start for r in rows] == [x + extra for x in (0, 2, 4, 7, 9)] and {r.dimsize for r in rows} == {11 + extra}
    with pytest.raises(Exception, match="more than one length"):
        align.offsets(lens.union(lens)).collect()
    with pytest.raises(ValueError):
        align.index_items(lens.withColumn("time_start", F.lit(0)), lens, ["time"])


@pytest.mark.parametrize("nt,per_file,chunks", [(10, 1, {"time": 3}), (10, 2, {"time": 10, "lat": 3}), (10, 1, {"time": 7, "lon": 5}), (10, 5, {"time": 1})])
def test_end_to_end(spark, tmp_path, nt, per_file, chunks):
    found = files(tmp_path, nt, per_file)
    pattern = pattern_from_file_sequence([u for *_, u in found], "time", file_type="netcdf3")
    table = pattern.files(spark).drop("row")
    whole = schema.determine_schema(openers.scan_schemas(table, (TIME,)), [TIME])
    assert whole["dims"] == {"time": nt, "lat": 4, "lon": 6} and whole["chunks"]["time"] == {i: per_file for i in range(nt // per_file)}
    assert whole["attrs"] == {"conventions": '"CF 1.6"'} and set(whole["coords"]) == {"time", "lat"}
    lens = spark.createDataFrame([("time", k, v) for k, v in whole["chunks"]["time"].items()], "dim string, position long, len long")
    frames = {}
    for name, v in {**whole["coords"], **whole["data_vars"]}.items():
        cells_ = openers.open_cells(table.withColumnRenamed("time_pos", "file_pos"), name, tuple(v["dims"]), v["dtype"])
        if "time" in v["dims"]:
            placed = align.offsets(lens.select("position", "len")).select(F.col("position").alias("file_pos"), "start")
            cells_ = cells_.join(placed, "file_pos").withColumn("time_pos", F.col("time_pos") + F.col("start")).drop("file_pos", "start")
        else:
            cells_ = cells_.where("file_pos = 0").drop("file_pos")
        frames[name] = cells_
    target = StoreToZarr("out.zarr", [TIME], str(tmp_path), chunks, attrs={"who": "me"}, encoding={"foo": {"codec": "zstd"}}).write(whole, frames)
    foo, bar = values(nt)
    assert np.array_equal(zarr3.read_array(target, "foo"), foo) and np.array_equal(zarr3.read_array(target, "bar"), bar)
    assert np.array_equal(zarr3.read_array(target, "time"), np.arange(nt))
    assert zarr3.read_document(target)["attributes"]["meshweave:who"] == "me"
    sizes = [chunks.get(d, {"time": per_file, "lat": 4, "lon": 6}[d]) for d in ("time", "lat", "lon")]
    keys = {p for p, _ in target.files() if p.startswith("foo/c/")}
    assert len(keys) == np.prod([-(-n // c) for n, c in zip((nt, 4, 6), sizes)]) and "foo/c/0/0/0" in keys
    part = zarr3.read(spark, target.root, "foo", {"time": slice(2, 5)}).collect()
    assert len(part) == 3 * 24 and np.array_equal(filled(part, "foo", ("time", "lat", "lon"), (nt, 4, 6))[2:5], foo[2:5])
    again = rechunk_store(spark, target.root, StoreToZarr("again.zarr", (), str(tmp_path)), {"time": nt, "lat": 1, "lon": 2})
    assert np.array_equal(zarr3.read_array(again, "foo"), foo)


def test_append_and_consolidation(spark, tmp_path):
    def write(n, offset, **kw):
        rows = spark.range(n).select(F.col("id").alias("time_pos"), (F.col("id") + offset).cast("double").alias("v"), (F.col("id") + offset).alias("time"))
        entry = {"dims": ["time"], "shape": [n], "attrs": {}, "encoding": {}}
        whole = {"attrs": {}, "dims": {"time": n}, "chunks": {}, "coords": {"time": entry | {"dtype": "int64"}}, "data_vars": {"v": entry | {"dtype": "float64"}}}
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return StoreToZarr("a.zarr", [TIME], str(tmp_path), {"time": 5}, **kw).write(whole, {"time": rows.select("time_pos", "time"), "v": rows.select("time_pos", "v")})

    write(10, 0)
    target = write(7, 10, append_dim="time")
    assert np.array_equal(zarr3.read_array(target, "v"), np.arange(17.0))
    with pytest.raises(ValueError, match="within a chunk"):
        write(3, 17, append_dim="time")
    zarr3.consolidate_metadata(target)
    assert zarr3.consolidate_coordinates(target) == ["time"]
    assert [p for p, _ in target.files("time/c")] == ["time/c/0"] and np.array_equal(zarr3.read_array(target, "time"), np.arange(17))
    assert len([p for p, _ in target.files("v/c")]) == 4
    write(10, 0)
    assert np.array_equal(zarr3.read_array(target, "v"), np.arange(10.0))


def test_store_options(tmp_path):
    with pytest.raises(TypeError, match="unsupported operand"):
        StoreToZarr("a.zarr").target
    with pytest.raises(ValueError):
        StoreToZarr("a", target_chunks={"x": 1}, dynamic_chunking_fn=lambda s: {})
    with pytest.raises(ValueError):
        StoreToZarr("a", [VARIABLE], append_dim="time")
    with pytest.raises(ValueError):
        StoreToZarr("a", [VARIABLE], append_dim="variable")
    assert injected({"TARGET_STORAGE": "s3://x", "other": "y"}, "StoreToZarr") == {"target_root": "s3://x"}
    assert isinstance(StoreToZarr("a").target_root, RequiredAtRuntime)


def schema_rows(spark, frags, axes=(TIME,)):
    """``frags``: (positions, dims, attrs, vars as (kind, name, dims, shape, dtype, attrs))."""
    keys = ", ".join(f"{a.name}_pos long" for a in axes)
    make = lambda rows, cols: spark.createDataFrame(rows, f"{keys}, {cols}" if cols else keys)
    return schema.SchemaRows(
        tuple(axes), make([p for p, *_ in frags], ""), make([(*p, d, n) for p, dims, *_ in frags for d, n in dims.items()], "dim string, len long"),
        make([], "dim string, at long, len long"), make([(*p, k, v) for p, _, a, _ in frags for k, v in a.items()], "key string, value string"),
        make([(*p, *v, {}) for p, *_, vs in frags for v in vs], schema.VARS),
    )


def var(name="v", dims=("time",), shape=(3,), dtype="float64", kind="data_var", **attrs):
    return (kind, name, list(dims), list(shape), dtype, attrs)


def test_schema_reduction(spark):
    frags = [((i,), {"time": n, "x": 2}, {"a": "1", "b": str(i)}, [var(dims=("time", "x"), shape=(n, 2), dtype=t, u="m", d=str(i))]) for i, (n, t) in enumerate([(3, "int16"), (3, "float32"), (4, "int16")])]
    out = schema.determine_schema(schema_rows(spark, frags), [TIME])
    assert out["dims"] == {"time": 10, "x": 2} and out["chunks"] == {"time": {0: 3, 1: 3, 2: 4}} and out["attrs"] == {"a": "1"}
    assert out["data_vars"]["v"] == {"dims": ["time", "x"], "shape": [10, 2], "dtype": "float32", "attrs": {"u": "m"}, "encoding": {}}
    assert schema.target_chunks(out) == {"time": 3, "x": 2} and schema.target_chunks(out, {"time": 10}, False) == {}
    with pytest.raises(KeyError):
        schema.target_chunks(out, {"y": 1}, False)


@pytest.mark.parametrize("axes,frags,message", [
    ((TIME,), [((0,), {"time": 3, "x": 2}, {}, [var()]), ((1,), {"time": 3, "x": 3}, {}, [var()])], "dimension x differs"),
    ((TIME,), [((0,), {"time": 3, "x": 2}, {}, [var()]), ((1,), {"time": 3}, {}, [var()])], "dimension x differs"),
    ((TIME,), [((0,), {"time": 3}, {}, [var()]), ((1,), {"time": 3}, {}, [])], "missing from some"),
    ((TIME,), [((0,), {"time": 3}, {}, [var()]), ((0,), {"time": 3}, {}, [var()])], "comes twice"),
    ((TIME,), [((0,), {"time": 3, "x": 1}, {}, [var(dims=("time", "x"), shape=(3, 1))]), ((1,), {"time": 3, "x": 1}, {}, [var(dims=("x", "time"), shape=(1, 3))])], "different dimensions"),
    ((VARIABLE,), [((0,), {"time": 3}, {}, [var()]), ((1,), {"time": 3}, {}, [var()])], "same variable v"),
])
def test_schema_errors(spark, axes, frags, message):
    with pytest.raises(Exception, match=message):
        schema.determine_schema(schema_rows(spark, frags, axes), axes)


def test_schema_empty(spark):
    with pytest.raises(ValueError, match="no fragments"):
        schema.determine_schema(schema_rows(spark, []), [TIME])


@pytest.mark.parametrize("chunk", [1, 3, 5, 10, 11])
@pytest.mark.parametrize("offset", [0, 5])
def test_split(spark, chunk, offset):
    part = spark.createDataFrame([(offset, 10, 20)], "time_start long, time_len long, time_size long")
    rows = rechunk.split_fragments(part, {"time": chunk}).orderBy("time_chunk").collect()
    covered = [p for r in rows for p in range(r.time_lo, r.time_hi)]
    assert covered == list(range(offset, offset + 10)) and all(r.time_lo // chunk == (r.time_hi - 1) // chunk == r.time_chunk for r in rows)
    with pytest.raises(Exception, match="properly indexed"):
        rechunk.split_fragments(part.withColumn("time_size", F.lit(0)), {"time": chunk}).collect()


def test_validate(spark):
    parts = [("ok", t, 3, x, 2) for t in (0, 3) for x in (0, 2)] + [("gap", 0, 3, 0, 2), ("gap", 4, 3, 0, 2)] + [("hole", t, 3, x, 2) for t, x in ((0, 0), (3, 2))]
    rows = rechunk.validate(spark.createDataFrame(parts, "g string, time_start long, time_len long, x_start long, x_len long"), ["time", "x"], ["g"]).collect()
    assert {r.g: (r.full, r.contiguous) for r in rows} == {"ok": (True, True), "gap": (True, False), "hole": (False, True)}


def test_assemble_errors(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 2.0)], "x_pos long, v double")
    with pytest.raises(Exception, match="more than once"):
        rechunk.assemble(rows, "v", "float64", {"x": 2}, {"x": 2}).collect()
    with pytest.raises(ValueError, match="more than one task"):
        rechunk.assemble(rows, "v", "float64", {"x": 1 << 40}, {"x": 1 << 40})
    blocks = rechunk.assemble(spark.createDataFrame([(0, 1.0), (3, None)], "x_pos long, v double"), "v", "float32", {"x": 4}, {"x": 3}, -1)
    assert {r.x_pos: r.v for r in rechunk.blocks_to_cells(blocks, "v", "float32", {"x": 4}, {"x": 3}).collect()} == {0: 1.0, 1: -1.0, 2: -1.0, 3: -1.0}


def test_rechunk_keeps_chunks_together(spark):
    out = rechunk.rechunk(spark.range(100).select(F.col("id").alias("x_pos")), {"x": 10}, partitions=3)
    assert out.withColumn("p", F.spark_partition_id()).groupBy("x_chunk").agg(F.count_distinct("p").alias("n")).where("n > 1").isEmpty()


def test_cells(spark):
    rows = spark.range(10).select(F.col("id").alias("x_pos"), F.col("id").cast("double").alias("v"))
    assert [r.v for r in cells.mask_where(rows, "v", F.col("v") < 2, F.lit(float("nan"))).orderBy("x_pos").collect()][:2] == [0.0, 1.0]
    assert [tuple(r) for r in cells.isel(rows, x=slice(8, None)).collect()] == [(0, 8.0), (1, 9.0)]
    with pytest.raises(ValueError):
        cells.isel(rows, x=slice(0, 4, 2))
    with pytest.raises(ValueError, match="same variables"):
        combine.merge([rows, rows], ["x"])
    whole = {"attrs": {"a": 1}, "coords": {}, "data_vars": {"v": 1}}
    assert cells.promote_to_coord(whole, "v")["coords"] == {"v": 1} and cells.set_attrs(whole, b="2")["attrs"] == {"b": "2"}


def test_bucket(spark):
    """Equal stretches of the range, one for every five positions or a part of them."""
    for lo, hi, n in ((0, 33, 34), (7, 60, 11), (0, 9, 10)):
        stretches = -(-n // 5)
        rows = spark.range(lo, hi + 1).select("id", references.bucket(F.col("id"), F.lit(lo), F.lit(hi), F.lit(n)).alias("b")).collect()
        assert all(r.b == int((r.id - lo) / ((hi - lo) / stretches)) for r in rows) and {r.b for r in rows} == set(range(stretches + 1))
    assert references.bucketed(spark.createDataFrame([(3,)], "p long"), "p").first()["bucket"] == 0


def test_references(spark, tmp_path):
    found = files(tmp_path, 6, 2)
    table = spark.createDataFrame([(i, u) for i, _, u in found], "time_pos long, url string")
    refs = openers.open_references(table, inline_threshold=20)
    dims = {"foo": ["time", "lat", "lon"], "bar": ["time", "lat", "lon"], "time": ["time"], "lat": ["lat"]}
    combined = references.combine(refs, "time_pos", "time", dims)
    rows = {r.key: r for r in references.keys(combined).collect()}
    assert set(rows) == {f"{v}/c/{i}/0/0" for v in ("foo", "bar") for i in range(6)} | {f"time/c/{i}" for i in range(6)} | {"lat/c/0"}
    foo, _ = values(6)
    for i in range(6):
        r = rows[f"foo/c/{i}/0/0"]
        raw = open(r.url, "rb").read()[r.offset : r.offset + r.length]
        assert np.array_equal(np.frombuffer(raw, ">f8"), foo[i].ravel())
    assert np.frombuffer(rows["time/c/4"].inline, ">i4")[0] == 4 and rows["time/c/4"].url is None
    references.write_parquet(combined, f"{tmp_path}/r.parquet", {"": zarr3.group_document()})
    assert references.read_parquet(spark, f"{tmp_path}/r.parquet").count() == 20
    references.write_json(combined, f"{tmp_path}/store/reference.json", {"": zarr3.group_document()})
    held = json.load(open(f"{tmp_path}/store/reference.json"))
    assert held["refs"]["foo/c/1/0/0"][1] == rows["foo/c/1/0/0"].offset and held["refs"]["time/c/0"].startswith("base64:")
    references.write_combined(refs, "time_pos", "time", dims, f"{tmp_path}/w/reference.json", {})
    assert len(json.load(open(f"{tmp_path}/w/reference.json"))["refs"]) == 19
    with pytest.raises(NotImplementedError):
        references.write_combined(refs, "time_pos", "time", dims, f"{tmp_path}/w/reference.csv", {})
    with pytest.raises(ValueError, match="no references"):
        references.write_combined(refs.limit(0), "time_pos", "time", dims, f"{tmp_path}/w/reference.json", {})
    with pytest.raises(ValueError):
        openers.open_references(table, "opendap")
    with pytest.raises(NotImplementedError):
        openers.open_references(table, "zarr")


def test_cache(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source = tmp_path / "in" / "a.bin"
    source.write_bytes(b"12345")
    cache = FlatCache(str(tmp_path / "cache"))
    assert cache.fill(str(source)) and not cache.fill(str(source)) and openers.read_url(str(source), cache) == b"12345"
    source.write_bytes(b"123456")
    assert cache.fill(str(source)) and cache.size(str(source)) == 6
    rows = spark.createDataFrame([(str(source),)], "url string")
    assert not openers.fill_cache(rows, cache.root, max_concurrency=1).first()["copied"]
    with pytest.raises(ValueError):
        openers.open_cells(rows, "v", ("x",), "float64", "zarr", copy_to_local=True)
    with pytest.raises(NotImplementedError):
        openers.open_cells(rows, "v", ("x",), "float64", "grib")


def test_target(tmp_path):
    t = Target(str(tmp_path)) / "a"
    t.write("x/y", b"abc")
    assert t.exists("x/y") and not t.exists("z") and t.size("x/y") == 3 and t.read("x/y", 1, 1) == b"b" and t.protocol == "file"
    assert list(t.files()) == [("x/y", 3)]
    with pytest.raises(IsADirectoryError):
        t.rm("x")
    t.rm("x", recursive=True)
    assert not t.exists("x/y")


def test_stream_appends(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    seen = []
    query = append_stream(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), lambda batch, n: seen.append((n, batch.count())), f"{tmp_path}/check")
    query.awaitTermination(60)
    assert seen == [(0, 5)]


def test_data_source(spark, tmp_path):
    from meshweave.sources import datasource

    datasource.register(spark)
    found = files(tmp_path, 4, 2)
    both = spark.read.format("meshweave").options(type="netcdf3", path="\n".join(u for *_, u in found), variable="foo").load()
    foo, _ = values(4)
    assert both.count() == foo.size and np.isclose(both.agg(F.sum("foo")).first()[0], foo.sum())
    reader = datasource.ArrayReader({"type": "netcdf3", "path": found[0][2], "variable": "foo"})
    assert reader.schema() == "`time_pos` long, `lat_pos` long, `lon_pos` long, `foo` double"
    blocks = spark.createDataFrame([(i, np.arange(3.0 * i, 3.0 * i + 3).tobytes()) for i in range(4)], "x_chunk long, data binary")
    options = {"path": f"{tmp_path}/s.zarr", "variable": "v", "dims": "x", "shape": "11", "chunks": "3", "dtype": "float64"}
    blocks.write.format("meshweave").options(**options).mode("append").save()
    part = spark.read.format("meshweave").options(path=f"{tmp_path}/s.zarr", variable="v").load().where("x_pos > 3 and x_pos <= 7")
    assert sorted(r.v for r in part.collect()) == [4.0, 5.0, 6.0, 7.0] and part.rdd.getNumPartitions() == 2
    assert spark.read.format("meshweave").options(path=f"{tmp_path}/s.zarr", variable="v").load().where("x_pos = 10").first()["v"] == 10.0


def bake(spark, settings, prune):
    bake.seen = settings, prune


def test_recipes(tmp_path):
    from meshweave.plans.recipes import load_registry, main

    (tmp_path / "r.json").write_text(json.dumps({"one": "tests.test_arrays:bake"}))
    assert main([str(tmp_path / "r.json"), "one", "--prune", "--conf", "TARGET_STORAGE=/x"]) == ["one"]
    from tests.test_arrays import bake as ran

    assert ran.seen == ({"TARGET_STORAGE": "/x"}, 2)
    with pytest.raises(SystemExit):
        main([str(tmp_path / "r.json"), "two"])
    (tmp_path / "r.json").write_text(json.dumps({"one": "nothing"}))
    with pytest.raises(ValueError):
        load_registry(str(tmp_path / "r.json"))
