"""Zarr v3 stores, after the published specification: regular chunk grids, bytes with gzip or zstd.

Metadata are documents that the driver writes; chunks are files that tasks write, named by
their index, so a repeated task writes the same file again.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from math import ceil
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dtypes import spark_type
from ..operators.rechunk import cut, part_names
from .storage import Target


def array_document(shape: Sequence[int], chunks: Sequence[int], dtype: str, dims: Sequence[str], attrs: Mapping[str, Any] | None = None, codec: str | None = None, fill: float | int = 0) -> dict:
    kind = np.dtype(dtype)
    codecs: list[dict] = [{"name": "bytes", "configuration": {"endian": "little"}} if kind.itemsize > 1 else {"name": "bytes"}]
    if codec == "gzip":
        codecs.append({"name": "gzip", "configuration": {"level": 5}})
    elif codec == "zstd":
        codecs.append({"name": "zstd", "configuration": {"level": 3, "checksum": False}})
    elif codec not in (None, "raw"):
        raise ValueError(f"no codec {codec}")
    return {
        "zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": kind.name, "fill_value": bool(fill) if kind.kind == "b" else fill,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [max(1, c) for c in chunks]}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "codecs": codecs, "dimension_names": list(dims), "attributes": dict(attrs or {}),
    }


def group_document(attrs: Mapping[str, Any] | None = None) -> dict:
    return {"zarr_format": 3, "node_type": "group", "attributes": dict(attrs or {})}


def write_document(target: Target, path: str, document: dict) -> None:
    target.write(f"{path}/zarr.json" if path else "zarr.json", json.dumps(document, indent=1).encode())


def read_document(target: Target, path: str = "") -> dict:
    return json.loads(target.read(f"{path}/zarr.json" if path else "zarr.json"))


def array_documents(target: Target, consolidated: bool = True) -> dict[str, dict]:
    """Documents of a store's arrays by name, from the group's consolidated ones if it has them and they are wanted."""
    held = read_document(target).get("consolidated_metadata")
    if held and consolidated:
        return {k: v for k, v in held["metadata"].items() if v["node_type"] == "array"}
    names = sorted({p.removesuffix("/zarr.json") for p, _ in target.files() if p.endswith("/zarr.json")})
    found = {name: read_document(target, name) for name in names}
    return {k: v for k, v in found.items() if v["node_type"] == "array"}


def chunk_key(name: str, index: Sequence[int]) -> str:
    return "/".join([name, "c", *map(str, index)])


def encode(block: np.ndarray, document: dict) -> bytes:
    raw = block.astype(np.dtype(document["data_type"]).newbyteorder("<"), copy=False).tobytes()
    for codec in document["codecs"][1:]:
        raw = gzip.compress(raw, codec["configuration"]["level"], mtime=0) if codec["name"] == "gzip" else bytes(pa.Codec("zstd", codec["configuration"]["level"]).compress(raw))
    return raw


def decode(raw: bytes, document: dict) -> np.ndarray:
    shape, kind = document["chunk_grid"]["configuration"]["chunk_shape"], np.dtype(document["data_type"]).newbyteorder("<")
    for codec in reversed(document["codecs"][1:]):
        if codec["name"] == "gzip":
            raw = gzip.decompress(raw)
        elif codec["name"] == "zstd":
            import zstandard

            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        else:
            raise ValueError(f"no codec {codec['name']}")
    return np.frombuffer(raw, kind).reshape(shape)


def read_chunk(target: Target, name: str, index: Sequence[int], document: dict) -> np.ndarray:
    """A chunk, cut to the array; the fill value where there is no file."""
    shape, size = document["shape"], document["chunk_grid"]["configuration"]["chunk_shape"]
    key = chunk_key(name, index)
    block = decode(target.read(key), document) if target.exists(key) else np.full(size, document["fill_value"], np.dtype(document["data_type"]))
    return block[tuple(slice(0, min(c, n - i * c)) for i, c, n in zip(index, size, shape))]


def read_array(target: Target, name: str) -> np.ndarray:
    """A whole array in this process: for coordinates and tests."""
    document = array_documents(target)[name]
    size = document["chunk_grid"]["configuration"]["chunk_shape"]
    out = np.empty(document["shape"], np.dtype(document["data_type"]))
    for index in np.ndindex(*(ceil(n / c) for n, c in zip(document["shape"], size))):
        out[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, size))] = read_chunk(target, name, index, document)
    return out


def chunk_table(spark: SparkSession, document: dict) -> DataFrame:
    """(i0, i1 ...): the indexes of all chunks of an array."""
    size = document["chunk_grid"]["configuration"]["chunk_shape"]
    counts = [ceil(n / c) for n, c in zip(document["shape"], size)]
    total = int(np.prod(counts, dtype=object)) if counts else 1
    columns, step = [], total
    for k, n in enumerate(counts):
        step = step // n if n else 1
        columns.append(F.expr(f"(id div {max(step, 1)}) % {max(n, 1)}").alias(f"i{k}"))
    return spark.range(total).select(*columns)


def read(spark: SparkSession, root: str, variable: str, parts: Mapping[str, slice] | None = None) -> DataFrame:
    """(<dim>_pos ..., variable): the cells of one array, chunk by chunk.

    Only chunks that meet ``parts`` are opened. No other array of the store is read.
    """
    target = Target(root)
    document = array_documents(target)[variable]
    dims = [d or f"dim{i}" for i, d in enumerate(document["dimension_names"])]
    size = document["chunk_grid"]["configuration"]["chunk_shape"]
    table = chunk_table(spark, document)
    bounds = {d: (parts[d].start or 0, n if parts[d].stop is None else parts[d].stop) for d, n in zip(dims, document["shape"]) if parts and d in parts}
    for k, (d, c) in enumerate(zip(dims, size)):
        if d in bounds:
            table = table.where(f"i{k} * {c} < {bounds[d][1]} and (i{k} + 1) * {c} > {bounds[d][0]}")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for index in zip(*(c.to_pylist() for c in batch.columns)) if dims else [()]:
                block = read_chunk(target, variable, index, document)
                places = [p + i * c for p, i, c in zip(np.indices(block.shape).reshape(len(dims), -1), index, size)]
                keep = np.ones(block.size, bool)
                for d, p in zip(dims, places):
                    if d in bounds:
                        keep &= (p >= bounds[d][0]) & (p < bounds[d][1])
                values = block.ravel()
                values = values.astype(values.dtype.newbyteorder("="))
                yield pa.RecordBatch.from_arrays([*(pa.array(p[keep], pa.int64()) for p in places), pa.array(values[keep])], [*(f"{d}_pos" for d in dims), variable])

    schema = "".join(f"`{d}_pos` long, " for d in dims) + f"`{variable}` {spark_type(document['data_type'])}"
    return table.mapInArrow(cells, schema)


def read_parts(spark: SparkSession, root: str, variable: str, chunks: Mapping[str, int], moved: Mapping[str, int] | None = None) -> DataFrame:
    """The parts of other chunks that each chunk of an array holds (see ``paste``), ``moved`` by so much in a dimension; a chunk is read at a time."""
    target, dims, sizes = Target(root), list(chunks), list(chunks.values())
    document = array_documents(target)[variable]
    own, names, by = document["chunk_grid"]["configuration"]["chunk_shape"], part_names(dims), [(moved or {}).get(d, 0) for d in dims]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for index in zip(*(c.to_pylist() for c in batch.columns)) if dims else [()]:
                yield from cut(read_chunk(target, variable, index, document), [i * c + m for i, c, m in zip(index, own, by)], sizes, names)

    return chunk_table(spark, document).mapInArrow(parts, "".join(f"`{n}` long, " for n in names) + "data binary")


def chunk_writer(target: Target, name: str, document: dict) -> Callable[[Sequence[int], np.ndarray], None]:
    """Writes a block as its chunk's file: what ``paste`` and ``assemble`` do with a block where it is made.

    Blocks that come back from one Python worker to be written by another would come in batches
    of as many as a partition holds, and a task would need both workers.
    """
    return lambda index, block: target.write(chunk_key(name, index), encode(block, document))


def consolidate_metadata(target: Target) -> dict:
    """Put all arrays' documents into the group's."""
    group = read_document(target)
    group.pop("consolidated_metadata", None)
    group["consolidated_metadata"] = {"kind": "inline", "must_understand": False, "metadata": array_documents(target, consolidated=False)}
    write_document(target, "", group)
    return group


def consolidate_coordinates(target: Target) -> list[str]:
    """Write every dimension's own coordinate as one chunk, with its attributes and codecs; which ones there were."""
    documents = array_documents(target)
    names = sorted({d for doc in documents.values() for d in doc["dimension_names"] if d in documents})
    for name in names:
        values, document = read_array(target, name), documents[name]
        old = [p for p, _ in target.files(f"{name}/c")]
        document = document | {"chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [max(1, n) for n in document["shape"]]}}}
        target.write(chunk_key(name, [0] * values.ndim), encode(values, document))
        write_document(target, name, document)
        for path in old:
            if path != chunk_key(name, [0] * values.ndim):
                target.rm(path)
    if "consolidated_metadata" in read_document(target):
        consolidate_metadata(target)
    return names
