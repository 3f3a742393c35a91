"""Inputs by byte ranges, over http, and from files to a store in one call."""

import base64
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshweave.operators import cells, combine, rechunk, references
from meshweave.plans import store
from meshweave.plans.patterns import CombineOp, Dimension
from meshweave.plans.store import StoreToZarr
from meshweave.sources import netcdf3, openers, zarr3
from meshweave.sources.storage import FlatCache, Target, opened

DAY, KIND = Dimension("day", CombineOp.CONCAT), Dimension("kind", CombineOp.MERGE)


def write(path, name, first, values, station=(3, 5, 8), dtype="f8", record=True, static=None):
    """A file with ``values`` (day, station) of one variable, and its coordinates."""
    n = len(values)
    variables = {"day": (("day",), np.arange(first, first + n, dtype="i4"), {}), "station": (("station",), np.asarray(station, "i4"), {}), name: (("day", "station"), values.astype(dtype), {})}
    if static is not None:
        variables["height"] = (("station",), np.asarray(static, "f4"), {})
    with open(path, "wb") as f:
        f.write(netcdf3.write({"day": n, "station": 3}, variables, {"made": "here"}, "day" if record else None))
    return str(path)


@pytest.fixture
def matrix(spark, tmp_path):
    rng = np.random.default_rng(5)
    rain, wind = rng.random((11, 3)), rng.integers(0, 99, (11, 3)).astype("f8")
    rows, at = [], 0
    for k, n in enumerate((4, 1, 6)):
        rows.append((k, 0, write(tmp_path / f"r{k}.nc", "rain", at, rain[at : at + n], static=(1, 2, k + 3))))
        rows.append((k, 1, write(tmp_path / f"w{k}.nc", "wind", at, wind[at : at + n], dtype="f4" if k else "i2", record=False)))
        at += n
    return spark.createDataFrame(rows, "day_pos long, kind_pos long, url string"), rain, wind


@pytest.mark.parametrize("chunks", [{"day": 3}, {"day": 11, "station": 2}, {"day": 1}, {"day": 50}])
def test_build(spark, tmp_path, matrix, chunks):
    files, rain, wind = matrix
    target = StoreToZarr("out.zarr", [DAY, KIND], str(tmp_path), chunks).build(files)
    assert np.array_equal(zarr3.read_array(target, "rain"), rain) and np.array_equal(zarr3.read_array(target, "wind"), wind)
    assert zarr3.read_array(target, "wind").dtype == "f4"
    assert np.array_equal(zarr3.read_array(target, "day"), np.arange(11)) and zarr3.read_array(target, "station").tolist() == [3, 5, 8]
    assert zarr3.read_array(target, "height").tolist() == [1, 2, 3]  # of the first file
    assert zarr3.read_document(target)["attributes"] == {"made": "here"}


def test_build_appends(spark, tmp_path):
    new = np.arange(15.0).reshape(5, 3)
    first = spark.createDataFrame([(0, write(tmp_path / "a.nc", "v", 0, new[:3]))], "day_pos long, url string")
    second = spark.createDataFrame([(0, write(tmp_path / "b.nc", "v", 3, new[3:4])), (1, write(tmp_path / "c.nc", "v", 4, new[4:]))], "day_pos long, url string")
    StoreToZarr("out.zarr", [DAY], str(tmp_path), {"day": 3}).build(first)
    with pytest.warns(UserWarning):
        store = StoreToZarr("out.zarr", [DAY], str(tmp_path), {"day": 3}, append_dim="day")
    target = store.build(second)
    assert np.array_equal(zarr3.read_array(target, "v"), new) and np.array_equal(zarr3.read_array(target, "day"), np.arange(5))


def test_blocks_are_written_where_they_are_made(spark, tmp_path, matrix, monkeypatch):
    """No block of labels or data goes on to a second Python worker, which would take as many at once as a partition holds."""
    files, rain, _ = matrix
    made = []
    for name in ("paste", "assemble"):
        real = getattr(rechunk, name)
        monkeypatch.setattr(store, name, lambda *a, real=real, **k: made.append(real(*a, **k)) or made[-1])
    target = StoreToZarr("out.zarr", [DAY, KIND], str(tmp_path), {"day": 2, "station": 2}, encoding={"rain": {"codec": "zstd"}}).build(files)
    assert len(made) == 5 and not any("data" in f.columns for f in made)
    assert np.array_equal(zarr3.read_array(target, "rain"), rain)


def test_kept_blocks(spark, tmp_path):
    """Blocks that are kept are the ones that come back else, in order and bytes."""
    document = zarr3.array_document([5, 3], [2, 2], "int32", ["x", "y"], fill=-1)
    cells_ = spark.createDataFrame([(i, j, 3 * i + j) for i in range(5) for j in range(3) if (i, j) != (4, 2)], "x_pos long, y_pos long, v int")
    how = ("v", "int32", {"x": 5, "y": 3}, {"x": 2, "y": 2}, -1)
    target = Target(str(tmp_path / "kept.zarr"))
    counts = {(r.x_chunk, r.y_chunk): r.n_cells for r in rechunk.assemble(cells_, *how, keep=zarr3.chunk_writer(target, "v", document)).collect()}
    back = {(r.x_chunk, r.y_chunk): r for r in rechunk.assemble(cells_, *how).collect()}
    assert counts == {k: r.n_cells for k, r in back.items()} == {(0, 0): 4, (0, 1): 2, (1, 0): 4, (1, 1): 2, (2, 0): 2}
    assert all(target.read(zarr3.chunk_key("v", k)) == r.data for k, r in back.items())
    assert zarr3.read_chunk(target, "v", (1, 1), document).tolist() == [[8], [11]] and not target.exists("v/c/2/1")


def test_headers_by_batches(spark, tmp_path, monkeypatch):
    """However many files a task has, so many headers are held at once; no other Python workers are started for the schemas."""
    monkeypatch.setattr(openers, "HEADERS", 2)
    urls = [write(tmp_path / f"{k}.nc", "v", k, np.full((1, 3), k)) for k in range(5)]
    files, seen = spark.createDataFrame(list(enumerate(urls)), "day_pos long, url string"), []
    real = type(files).mapInArrow
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, fn, *a: seen.append(fn) or real(self, fn, *a))
    rows = openers.scan_schemas(files, (DAY,))
    batch = pa.RecordBatch.from_pydict({"day_pos": pa.array(range(5), pa.int64()), "url": urls})
    assert [b.num_rows for b in seen[0](iter([batch]))] == [2, 2, 1]
    assert sorted(r.day_pos for r in rows.fragments.collect()) == [0, 1, 2, 3, 4] and rows.chunks.isEmpty()
    assert "ExistingRDD" not in rows.chunks._jdf.queryExecution().toString()


def test_labels_must_agree(spark, tmp_path):
    values = np.ones((1, 3))
    files = spark.createDataFrame([(0, write(tmp_path / "a.nc", "v", 0, values)), (1, write(tmp_path / "b.nc", "v", 1, values, station=(3, 5, 9)))], "day_pos long, url string")
    with pytest.raises(Exception, match="differ in the labels of station"):
        StoreToZarr("out.zarr", [DAY], str(tmp_path)).build(files)
    same = spark.createDataFrame([(0, float("nan")), (0, float("nan")), (1, 2.0), (1, None)], "x_pos long, x double")
    assert sorted(map(str, combine.agreed(same, ["x"], "x").collect())) == ["Row(x_pos=0, x=nan)", "Row(x_pos=1, x=2.0)"]


def test_parts(spark, tmp_path, monkeypatch):
    """Parts of small slabs are the array, and move as bytes; overlaps and blocks that no task could hold are refused."""
    values = np.arange(21.0).reshape(7, 3)
    url = write(tmp_path / "a.nc", "v", 0, values)
    files = spark.createDataFrame([(2, url)], "day_start long, url string")
    parts = openers.open_parts(files, "v", "float64", {"day": 4, "station": 2})
    rows = {(r.day_chunk, r.station_chunk): (r.day_lo, r.day_len, r.station_lo, r.station_len, len(r.data)) for r in parts.collect()}
    assert rows[0, 0] == (2, 2, 0, 2, 32) and rows[2, 1] == (0, 1, 0, 1, 8) and len(rows) == 6
    blocks = {(r.day_chunk, r.station_chunk): r for r in rechunk.paste(parts, "float64", {"day": 4, "station": 2}, -1).collect()}
    assert np.frombuffer(blocks[0, 1].data).reshape(4, 2).tolist() == [[-1, -1], [-1, -1], [2, -1], [5, -1]] and blocks[0, 1].n_cells == 2
    with pytest.raises(Exception, match="more than once"):
        rechunk.paste(parts.union(parts), "float64", {"day": 4, "station": 2}).collect()
    with pytest.raises(ValueError, match="more than one task"):
        rechunk.paste(parts, "float64", {"day": 1 << 20, "station": 1 << 20})
    monkeypatch.setattr(openers, "SLAB_BYTES", 50)
    slabs = list(openers._slabs(url, "v", openers.FileType.netcdf3, None, {}, None))
    assert [s for s, _ in slabs] == [[0, 0], [2, 0], [4, 0], [6, 0]] and np.array_equal(np.concatenate([a for _, a in slabs]), values)


class Counted:
    def __init__(self, raw):
        self.raw, self.read = raw, 0

    def size(self):
        return len(self.raw)

    def read_at(self, length, offset):
        self.read += len(self.raw[offset : offset + length])
        return self.raw[offset : offset + length]


@pytest.mark.parametrize("record", [True, False])
@pytest.mark.parametrize("wide", [True, False])
def test_ranges(tmp_path, monkeypatch, record, wide):
    """Headers and cells are read by their ranges, whether records are read in a stretch or one by one."""
    monkeypatch.setattr(netcdf3, "HEAD_BYTES", 16)
    monkeypatch.setattr(netcdf3, "STRETCH", 100 if wide else 1)
    values = np.arange(30000.0).reshape(10000, 3)
    raw = open(write(tmp_path / "a.nc", "v", 0, values, record=record), "rb").read()
    file = Counted(raw)
    header = netcdf3.open_header(file)
    assert header.variables.keys() == {"day", "station", "v"} and file.read < 5000
    for lo, hi in ((0, 1), (4, 5), (2, 17), (29990, 30000), (7, 7)):
        assert np.array_equal(netcdf3.read_flat(file, header, "v", lo, hi), values.ravel()[lo:hi])
    assert file.read < 10000
    with pytest.raises((ValueError, TypeError)):
        netcdf3.read_flat(Counted(raw[:-4]), header, "v", 29990, 30000)
    with pytest.raises(EOFError):
        netcdf3.open_header(Counted(raw[:40]))


@pytest.fixture
def server(tmp_path):
    """A folder over http, for one user; /plain/ ignores ranges, and a query must hold the key."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            path, _, query = self.path.partition("?")
            seen.append((self.path, self.headers.get("Range")))
            if self.headers.get("Authorization") != "Basic " + base64.b64encode(b"me:word").decode() or query != "key=s":
                return self.send_error(401)
            raw = (tmp_path / path.rpartition("/")[2]).read_bytes()
            if path.startswith("/plain/"):
                self.send_response(200)
            else:
                lo, hi = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
                if lo >= len(raw):
                    return self.send_error(416)
                self.send_response(206)
                self.send_header("Content-Range", f"bytes {lo}-{min(hi, len(raw) - 1)}/{len(raw)}")
                raw = raw[lo : hi + 1]
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen
    http.shutdown()


def test_http(spark, tmp_path, server):
    root, seen = server
    values = np.arange(6.0).reshape(2, 3)
    write(tmp_path / "a.nc", "v", 0, values)
    (tmp_path / "none").write_bytes(b"")
    access = {"secrets": {"key": "s"}, "auth": ("me", "word")}
    raw = (tmp_path / "a.nc").read_bytes()
    for kind in ("ranges", "plain"):
        with opened(f"{root}/{kind}/a.nc", **access) as f:
            assert f.size() == len(raw) and f.read_at(4, 0) == b"CDF\x02" and f.read_at(99, len(raw) - 3) == raw[-3:] and f.read_at(1, len(raw)) == b""
            assert f.read(5) + f.read() == raw
        files = spark.createDataFrame([(0, f"{root}/{kind}/a.nc")], "day_pos long, url string")
        target = StoreToZarr(f"{kind}.zarr", [DAY], str(tmp_path)).build(files, **access)
        assert np.array_equal(zarr3.read_array(target, "v"), values)
        cached = StoreToZarr(f"{kind}2.zarr", [DAY], str(tmp_path)).build(files, cache=str(tmp_path / "cache"), **access)
        assert np.array_equal(zarr3.read_array(cached, "v"), values)
        assert FlatCache(str(tmp_path / "cache")).size(f"{root}/{kind}/a.nc") == len(raw)
    assert openers.read_url(f"{root}/ranges/none", **access) == b""
    assert ("/ranges/a.nc?key=s", "bytes=0-0") in seen
    with pytest.raises(OSError) as caught:
        opened(f"{root}/ranges/a.nc", {"key": "s"}, ("me", "wrong"))
    assert "wrong" not in str(caught.value) and "key=s" not in str(caught.value)


def test_decoded(spark):
    rows = spark.createDataFrame([(0, 5, 1.5), (1, -1, 36.0), (2, None, None)], "x_pos long, a int, t double")
    out = cells.decoded(rows, "a", {"scale_factor": 0.25, "missing_value": [-1, -2]})
    out = cells.decoded(out, "t", {"units": "hours since 1999-12-31", "calendar": "standard"}).withColumn("t", F.col("t").cast("string")).orderBy("x_pos").collect()
    assert [r.a for r in out] == [1.25, None, None] and [r.t for r in out] == ["1999-12-31 01:30:00", "2000-01-01 12:00:00", None]
    assert cells.decoded(rows, "t", {"units": "m"}).collect() == rows.collect()
    with pytest.raises(ValueError, match="360_day"):
        cells.decoded(rows, "t", {"units": "days since 2000-01-01", "calendar": "360_day"})


def test_references_along_two_dimensions(spark):
    """Four files of a grid, each with 2 x 1 chunks of v: the chunk of the whole is that of all files before it in each dimension."""
    grid = [(a, b, i) for a in range(2) for b in range(2) for i in range(2)]
    rows = [(a, b, "v", [i, 0], f"f{a}{b}", i * 8, 8, None) for a, b, i in grid]
    rows += [(a, b, "lat", [0], None, None, None, bytearray(b"x")) for a, b, i in grid if not i] + [(a, b, "x", [0], f"f{a}{b}", 16, 4, None) for a, b, i in grid if not i]
    schema_ = "p long, q long, variable string, chunk array<long>, url string, offset long, length long, inline binary"
    dims = {"v": ["day", "x"], "x": ["x"], "lat": ["lat"]}
    found = references.keys(references.combine(spark.createDataFrame(rows, schema_), ["p", "q"], ["day", "x"], dims, ["lat"]))
    got = {r.key: (r.url, r.offset) for r in found.collect()}
    assert got == {f"v/c/{2 * a + i}/{b}": (f"f{a}{b}", i * 8) for a, b, i in grid} | {"lat/c/0": (None, None), "x/c/0": ("f00", 16), "x/c/1": ("f01", 16)}
    rows[8] = (*rows[8][:-1], bytearray(b"y"))
    with pytest.raises(Exception, match="files differ in lat"):
        references.combine(spark.createDataFrame(rows, schema_), ["p", "q"], ["day", "x"], dims, ["lat"]).collect()
