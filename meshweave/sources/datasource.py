"""Arrays as data sources: ``spark.read.format("meshweave")`` and ``df.write.format("meshweave")``.

Options: ``path`` (a Zarr store, or files of a pattern joined by newlines), ``variable``,
``type`` (zarr or netcdf3), and for writing ``dtype``, ``shape``, ``chunks`` and ``dims``,
the lists joined by commas. Comparisons of positions with literals reach the reader and
leave out whole chunks or records; they need ``spark.sql.python.filterPushdown.enabled``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.dtypes import spark_type
from . import netcdf3, zarr3
from .openers import opened_url
from .storage import Target


@dataclass
class Chunk(InputPartition):
    """A chunk of a store, or a file: its place and what of it is wanted."""

    source: str
    index: tuple[int, ...]
    offset: int = 0


@dataclass
class Written(WriterCommitMessage):
    blocks: int


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.kind, self.variable, self.paths = options.get("type", "zarr"), options["variable"], options["path"].split("\n")
        self.bounds: dict[str, list[int]] = {}
        if self.kind == "zarr":
            document = zarr3.array_documents(Target(self.paths[0]))[self.variable]
            self.document, self.dims, self.shape, self.dtype = document, document["dimension_names"], document["shape"], document["data_type"]
        else:
            with opened_url(self.paths[0]) as f:
                v = netcdf3.open_header(f).variables[self.variable]
            self.document, self.dims, self.dtype = None, list(v.dims), np.dtype(v.dtype).name

    def schema(self) -> str:
        return "".join(f"`{d}_pos` long, " for d in self.dims) + f"`{self.variable}` {spark_type(self.dtype)}"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take comparisons of positions; all are handed back, so Spark tests the rows too."""
        for f in filters:
            name = f.attribute[0].removesuffix("_pos") if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 else None
            if name in self.dims and f.attribute[0] == f"{name}_pos" and isinstance(f.value, int):
                span = self.bounds.setdefault(name, [0, 1 << 62])
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    span[0] = max(span[0], f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    span[1] = min(span[1], f.value + (not isinstance(f, LessThan)))
            yield f

    def partitions(self) -> list[InputPartition]:
        if self.kind != "zarr":
            return [Chunk(p, ()) for p in self.paths]
        size = self.document["chunk_grid"]["configuration"]["chunk_shape"]
        spans = []
        for d, n, c in zip(self.dims, self.shape, size):
            lo, hi = self.bounds.get(d, (0, n))
            spans.append(range(max(lo, 0) // c, ceil(max(min(hi, n), 0) / c)))
        found: list[tuple[int, ...]] = [()]
        for span in spans:
            found = [(*i, j) for i in found for j in span]
        return [Chunk(self.paths[0], i) for i in found] or [Chunk(self.paths[0], (-1,))]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        if partition.index == (-1,):
            return
        if self.kind == "zarr":
            size = self.document["chunk_grid"]["configuration"]["chunk_shape"]
            block = zarr3.read_chunk(Target(partition.source), self.variable, partition.index, self.document)
            start = [i * c for i, c in zip(partition.index, size)]
        else:
            block, start = self._rows(partition.source)
        places = [p + s for p, s in zip(np.indices(block.shape).reshape(len(self.dims), -1), start)]
        keep = np.ones(block.size, bool)
        for d, p in zip(self.dims, places):
            lo, hi = self.bounds.get(d, (0, 1 << 62))
            keep &= (p >= lo) & (p < hi)
        values = block.astype(block.dtype.newbyteorder("=")).ravel()
        yield pa.RecordBatch.from_arrays([*(pa.array(p[keep], pa.int64()) for p in places), pa.array(values[keep])], [*(f"{d}_pos" for d in self.dims), self.variable])


    def _rows(self, url: str) -> tuple[np.ndarray, list[int]]:
        """Of a NetCDF file, the wanted rows of the first dimension, by their byte ranges, and where they start."""
        with opened_url(url) as f:
            header = netcdf3.open_header(f)
            shape = header.variables[self.variable].shape
            if not shape:
                return netcdf3.read_flat(f, header, self.variable, 0, 1).reshape(()), []
            lo, hi = self.bounds.get(self.dims[0], (0, shape[0]))
            lo = min(max(lo, 0), shape[0])
            hi, row = min(max(hi, lo), shape[0]), prod(shape[1:])
            return netcdf3.read_flat(f, header, self.variable, lo * row, hi * row).reshape(hi - lo, *shape[1:]), [lo] + [0] * (len(shape) - 1)


class BlockWriter(DataSourceArrowWriter):
    """Writes blocks (<dim>_chunk ..., data) as chunk files; the array's document follows when all are there."""

    def __init__(self, options: dict[str, str]):
        self.target, self.variable, self.dims = Target(options["path"]), options["variable"], options["dims"].split(",")
        numbers = lambda key: [int(x) for x in options[key].split(",")]
        self.document = zarr3.array_document(numbers("shape"), numbers("chunks"), options["dtype"], self.dims, None, options.get("codec"))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        n, size = 0, self.document["chunk_grid"]["configuration"]["chunk_shape"]
        for batch in batches:
            for i in range(batch.num_rows):
                block = np.frombuffer(batch.column("data")[i].as_py(), np.dtype(self.document["data_type"])).reshape(size)
                self.target.write(zarr3.chunk_key(self.variable, [batch.column(f"{d}_chunk")[i].as_py() for d in self.dims]), zarr3.encode(block, self.document))
                n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        if not self.target.exists("zarr.json"):
            zarr3.write_document(self.target, "", zarr3.group_document())
        zarr3.write_document(self.target, self.variable, self.document)

    def abort(self, messages: list[Written | None]) -> None:
        """Chunk files without a document are no array; a repeat writes them again."""


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "meshweave"

    def _options(self) -> dict[str, str]:
        return {k: self.options[k] for k in ("path", "variable", "type", "dims", "shape", "chunks", "dtype", "codec") if k in self.options}

    def schema(self) -> str:
        return ArrayReader(self._options()).schema()

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self._options())

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(self._options())


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArraySource)
