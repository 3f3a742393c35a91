"""Opening inputs: by file type, through a cache, as cells or as byte ranges."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator, Mapping
from itertools import product
from math import prod
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dtypes import spark_type
from ..operators.rechunk import cut, part_names
from ..operators.references import REFERENCE
from ..operators.schema import VARS, SchemaRows
from ..plans.patterns import Dimension, FileType
from . import netcdf3, zarr3
from .storage import FlatCache, Target, opened

#: Bytes of an input's array read at once, but a row of its first dimension at least; cells made of them at once.
SLAB_BYTES, BATCH_CELLS = 1 << 26, 1 << 20
#: Headers held at once.
HEADERS = 256

# The engine that reads each type, and the first bytes that tell a type.
ENGINES = {"grib": "grib", "kerchunk": "references", "netcdf3": "netcdf3", "netcdf4": "hdf5", "opendap": "opendap", "zarr": "zarr"}
MAGIC = {b"CDF\x01": "netcdf3", b"CDF\x02": "netcdf3", b"CDF\x05": "netcdf3", b"\x89HDF": "netcdf4", b"GRIB": "grib"}


def engine_for(file_type: FileType | str, options: Mapping[str, Any] | None = None) -> dict:
    """The options with the engine of the type; an engine that fits is superfluous, another one an error."""
    kind, out = FileType(file_type), dict(options or {})
    if kind is FileType.unknown:
        if "engine" not in out:
            warnings.warn("neither a file type nor an engine is given: each file's first bytes decide", stacklevel=2)
        return out
    engine = ENGINES[kind.value]
    if "engine" in out:
        if out["engine"] != engine:
            raise ValueError(f"{kind.value} files are read by {engine}, not by {out['engine']}")
        warnings.warn(f"the engine {engine} follows from the file type {kind.value}", stacklevel=2)
    return out | {"engine": engine}


def sniff(head: bytes) -> str:
    """The type that a file's first bytes tell."""
    if head[:4] not in MAGIC:
        raise ValueError("this file's type can't be told from its first bytes")
    return MAGIC[head[:4]]


def opened_url(url: str, cache: str | FlatCache | None = None, secrets: Mapping[str, str] | None = None, auth: tuple[str, str] | None = None):
    """A file to read by ranges: the cache's copy if there is one, which is filled if needed."""
    if cache is None:
        return opened(url, secrets, auth)
    cache = FlatCache(cache) if isinstance(cache, str) else cache
    cache.fill(url, secrets, auth)
    return cache.open(url)


def read_url(url: str, cache: str | FlatCache | None = None, secrets: Mapping[str, str] | None = None, auth: tuple[str, str] | None = None) -> bytes:
    """A file's bytes, from the cache if there is one."""
    with opened_url(url, cache, secrets, auth) as f:
        return f.read()


def fill_cache(files: DataFrame, cache: str, secrets: Mapping[str, str] | None = None, max_concurrency: int | None = None, auth: tuple[str, str] | None = None) -> DataFrame:
    """(url, copied): fill a cache with ``files(url)``, by at most ``max_concurrency`` tasks at once. Secrets stay in the closure, out of rows and plans."""
    target, hidden = FlatCache(cache), dict(secrets or {})

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([target.fill(u, hidden, auth) for u in urls], pa.bool_())], ["url", "copied"])

    rows = files.select("url")
    return (rows.repartition(max_concurrency) if max_concurrency else rows).mapInArrow(copy, "url string, copied boolean")


def _checked(file_type: FileType | str, copy_to_local: bool = False, load: bool = False) -> FileType:
    kind = FileType(file_type)
    if copy_to_local and kind in (FileType.zarr, FileType.opendap):
        raise ValueError(f"{kind.value} inputs aren't single files that could be copied")
    if copy_to_local and not load:
        warnings.warn("a local copy is only kept while its file is read", stacklevel=3)
    return kind


def _readable(kind: FileType) -> None:
    if kind not in (FileType.netcdf3, FileType.zarr, FileType.unknown):
        raise NotImplementedError(f"no reader for {kind.value} files is installed")


def _slabs(url: str, variable: str, kind: FileType, cache: str | None, secrets: Mapping[str, str], auth: tuple[str, str] | None) -> Iterator[tuple[list[int], np.ndarray]]:
    """(start of each dimension, values): an input's array in parts, which are a store's chunks or rows of a file's first dimension."""
    if kind is FileType.zarr:
        target = Target(url)
        document = zarr3.array_documents(target)[variable]
        size = document["chunk_grid"]["configuration"]["chunk_shape"]
        for index in product(*(range(-(-n // c)) for n, c in zip(document["shape"], size))):
            yield [i * c for i, c in zip(index, size)], zarr3.read_chunk(target, variable, index, document)
        return
    with opened_url(url, cache, secrets, auth) as f:
        if kind is FileType.unknown and sniff(f.read_at(4, 0)) != "netcdf3":
            raise NotImplementedError(f"no reader for {sniff(f.read_at(4, 0))} files is installed")
        header = netcdf3.open_header(f)
        v = header.variables[variable]
        if not v.dims:
            yield [], netcdf3.read_flat(f, header, variable, 0, 1).reshape(())
            return
        row = prod(v.shape[1:])
        step = max(1, SLAB_BYTES // max(1, row * np.dtype(v.dtype).itemsize))
        for lo in range(0, v.shape[0], step):
            hi = min(lo + step, v.shape[0])
            yield [lo] + [0] * (len(v.dims) - 1), netcdf3.read_flat(f, header, variable, lo * row, hi * row).reshape(hi - lo, *v.shape[1:])


def open_cells(files: DataFrame, variable: str, dims: tuple[str, ...], dtype: str, file_type: FileType | str = "netcdf3", cache: str | None = None, secrets: Mapping[str, str] | None = None, copy_to_local: bool = False, load: bool = False, auth: tuple[str, str] | None = None) -> DataFrame:
    """(*files but url, <dim>_pos ..., variable): the cells of one variable of every file, positions within the file.

    NetCDF classic files and Zarr stores; other types need a reader that isn't part of this
    package, and are an error. Inputs are read in parts of bounded size. ``load`` caches the
    result.
    """
    kind = _checked(file_type, copy_to_local, load)
    _readable(kind)
    others = [c for c in files.columns if c != "url"]
    hidden = dict(secrets or {})

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, url in enumerate(batch.column("url").to_pylist()):
                for start, values in _slabs(url, variable, kind, cache, hidden, auth):
                    flat = values.astype(values.dtype.newbyteorder("=") if values.dtype.kind == "S" else dtype).ravel()
                    for lo in range(0, flat.size, BATCH_CELLS):
                        part = flat[lo : lo + BATCH_CELLS]
                        places = np.unravel_index(np.arange(lo, lo + part.size), values.shape) if dims else ()
                        held = [pa.repeat(batch.column(c)[i], part.size) for c in others]
                        yield pa.RecordBatch.from_arrays([*held, *(pa.array(p + s, pa.int64()) for p, s in zip(places, start)), pa.array(part)], [*others, *(f"{d}_pos" for d in dims), variable])

    types = dict(files.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in others) + "".join(f"`{d}_pos` long, " for d in dims) + f"`{variable}` {spark_type(dtype)}"
    out = files.mapInArrow(cells, schema)
    return out.cache() if load else out


def open_parts(files: DataFrame, variable: str, dtype: str, chunks: Mapping[str, int], file_type: FileType | str = "netcdf3", cache: str | None = None, secrets: Mapping[str, str] | None = None, auth: tuple[str, str] | None = None) -> DataFrame:
    """(<dim>_chunk, <dim>_lo, <dim>_len ..., data): the parts of target chunks that every file's array holds, as bytes in C order.

    ``files`` has url and, of every concatenated dimension, <dim>_start: where the file begins
    in the whole array. lo counts within the chunk. A part's place is said once and its cells
    move as bytes of ``dtype``, so a shuffle of parts is about as large as the array.
    """
    kind = FileType(file_type)
    _readable(kind)
    dims, code, hidden = list(chunks), np.dtype(dtype), dict(secrets or {})
    sizes = [chunks[d] for d in dims]
    names = part_names(dims)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = {d: batch.column(f"{d}_start").to_pylist() for d in dims if f"{d}_start" in batch.schema.names}
            for i, url in enumerate(batch.column("url").to_pylist()):
                for start, values in _slabs(url, variable, kind, cache, hidden, auth):
                    at = [s + (begin[d][i] if d in begin else 0) for d, s in zip(dims, start)]
                    yield from cut(values.astype(code), at, sizes, names)

    return files.mapInArrow(split, "".join(f"`{n}` long, " for n in names) + "data binary")


def scan_schemas(files: DataFrame, axes: tuple[Dimension, ...], file_type: FileType | str = "netcdf3", cache: str | None = None, secrets: Mapping[str, str] | None = None, auth: tuple[str, str] | None = None) -> SchemaRows:
    """The schemas of all files, from their headers alone: a variable named like a dimension is a coordinate.

    The headers, a row for each file, are persisted, as each part of the schemas reads them.
    """
    kind, hidden = FileType(file_type), dict(secrets or {})
    keys = [f"{a.name}_pos" for a in axes]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, HEADERS) for b in batches for lo in range(0, b.num_rows, HEADERS)):
            rows = []
            for url in batch.column("url").to_pylist():
                if kind is FileType.zarr:
                    target = Target(url)
                    attrs, documents = zarr3.read_document(target)["attributes"], zarr3.array_documents(target)
                    found = {k: (d["dimension_names"], d["shape"], d["data_type"], d["attributes"]) for k, d in documents.items()}
                else:
                    with opened_url(url, cache, hidden, auth) as f:
                        h = netcdf3.open_header(f)
                    attrs, found = h.attrs, {v.name: (list(v.dims), list(v.shape), np.dtype(v.dtype).newbyteorder("=").name, v.attrs) for v in h.variables.values()}
                sizes = {d: n for own, shape, *_ in found.values() for d, n in zip(own, shape)}
                text = lambda values: [(k, json.dumps(v)) for k, v in values.items()]
                rows.append({
                    "sizes": [{"dim": d, "len": n} for d, n in sizes.items()], "attrs": [{"key": k, "value": v} for k, v in text(attrs)],
                    "vars": [{"kind": "coord" if name in sizes else "data_var", "name": name, "dims": own, "shape": shape, "dtype": t, "attrs": text(a), "encoding": []} for name, (own, shape, t, a) in found.items()],
                })
            types = [pa.list_(pa.struct([("dim", pa.string()), ("len", pa.int64())])), pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])), var_type]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array([r[c] for r in rows], t) for c, t in zip(("sizes", "attrs", "vars"), types))], [*keys, "sizes", "attrs", "vars"])

    text_map = pa.map_(pa.string(), pa.string())
    var_type = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("dims", pa.list_(pa.string())), ("shape", pa.list_(pa.int64())), ("dtype", pa.string()), ("attrs", text_map), ("encoding", text_map)]))
    schema = "".join(f"`{k}` long, " for k in keys) + f"sizes array<struct<dim:string,len:long>>, attrs array<struct<key:string,value:string>>, vars array<struct<{', '.join(x.replace(' ', ':', 1) for x in VARS.split(', '))}>>"
    found = files.select(*keys, "url").mapInArrow(scan, schema).persist()
    none = lambda n, t: F.lit(None).cast(t).alias(n)
    chunks = found.sparkSession.range(0).select(*(none(k, "long") for k in keys), none("dim", "string"), none("at", "long"), none("len", "long"))
    return SchemaRows(axes, found.select(*keys), found.select(*keys, F.inline("sizes")), chunks, found.select(*keys, F.inline("attrs")), found.select(*keys, F.inline("vars")))


def open_references(files: DataFrame, file_type: FileType | str = "netcdf3", inline_threshold: int = 300, remote_protocol: str | None = None, secrets: Mapping[str, str] | None = None, auth: tuple[str, str] | None = None) -> DataFrame:
    """(*files but url, variable, chunk, url, offset, length, inline): byte ranges of every variable of every file.

    Ranges of up to ``inline_threshold`` bytes are held themselves. Zarr stores are
    references already; types without a scanner here are an error.
    """
    kind = FileType(file_type)
    if kind is FileType.zarr:
        raise NotImplementedError("a Zarr store needs no references")
    if kind is not FileType.netcdf3:
        raise ValueError(f"no byte ranges of {kind.value} files can be told")
    others, hidden = [c for c in files.columns if c != "url"], dict(secrets or {})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in [*others, *names]}
            for i, url in enumerate(batch.column("url").to_pylist()):
                shown = url if "://" in url or not remote_protocol else f"{remote_protocol}://{url}"
                with opened(url, hidden, auth) as f:
                    header = netcdf3.open_header(f)
                    for name in header.variables:
                        for index, offset, length in netcdf3.byte_ranges(header, name):
                            held = f.read_at(length, offset) if length <= inline_threshold else None
                            for c in others:
                                out[c].append(batch.column(c)[i].as_py())
                            for c, v in zip(names, (name, list(index), None if held is not None else shown, None if held is not None else offset, None if held is not None else length, held)):
                                out[c].append(v)
            types_ = [batch.schema.field(c).type for c in others] + [pa.string(), pa.list_(pa.int64()), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types_)], list(out))

    names = [x.split()[0] for x in REFERENCE.split(", ")]
    types = dict(files.dtypes)
    return files.mapInArrow(scan, "".join(f"`{c}` {types[c]}, " for c in others) + REFERENCE)
