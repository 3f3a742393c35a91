"""Storing cells as a Zarr store: schema, chunks and offsets first, then one job for each variable's blocks."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.align import index_items
from ..operators.combine import agreed
from ..operators.rechunk import assemble, paste
from ..operators.schema import determine_schema, target_chunks, with_prefixed_attrs
from ..sources import zarr3
from ..sources.openers import open_cells, open_parts, scan_schemas
from ..sources.storage import RequiredAtRuntime, Target
from .patterns import CombineOp, Dimension

#: Which argument of which transform a deployment fills in, and with what.
INJECTED = {
    "StoreToZarr": {"target_root": "TARGET_STORAGE"},
    "WriteReference": {"target_root": "TARGET_STORAGE"},
    "WriteCombinedReference": {"target_root": "TARGET_STORAGE"},
    "OpenURL": {"cache": "INPUT_CACHE_STORAGE"},
}


def injected(conf: Mapping[str, str], transform: str) -> dict[str, str]:
    """Arguments of a transform that the deployment's settings give."""
    return {arg: conf[key] for arg, key in INJECTED.get(transform, {}).items() if key in conf}


def json_value(text: str) -> Any:
    """An attribute's value from its JSON text, or the text itself."""
    try:
        return json.loads(text)
    except ValueError:
        return text


@dataclass
class StoreToZarr:
    """Write cells with a known schema to ``target_root / store_name``.

    Chunks are given, or made by ``dynamic_chunking_fn(schema, **kwargs)``, or the schema's
    own. With ``append_dim`` the cells go behind those of an existing store; that isn't
    idempotent, so the enlarged shape is written last, and a run that fails before leaves
    the store as readers know it.
    """

    store_name: str
    combine_dims: Sequence[Dimension] = ()
    target_root: str | Target | RequiredAtRuntime = field(default_factory=RequiredAtRuntime)
    target_chunks: dict[str, int] | None = None
    dynamic_chunking_fn: Callable[..., dict[str, int]] | None = None
    dynamic_chunking_fn_kwargs: dict = field(default_factory=dict)
    attrs: dict[str, str] = field(default_factory=dict)
    encoding: dict[str, dict] = field(default_factory=dict)
    append_dim: str | None = None
    attr_prefix: str = "meshweave:"

    def __post_init__(self) -> None:
        if self.target_chunks and self.dynamic_chunking_fn:
            raise ValueError("chunks are either given or made by a function")
        if self.append_dim:
            fits = [d for d in self.combine_dims if d.name == self.append_dim]
            if not fits:
                raise ValueError(f"{self.append_dim} is none of the combined dimensions")
            if fits[0].operation is not CombineOp.CONCAT:
                raise ValueError(f"{self.append_dim} doesn't concatenate")
            warnings.warn("appending twice appends twice", stacklevel=3)

    @property
    def target(self) -> Target:
        root = Target(self.target_root) if isinstance(self.target_root, str) else self.target_root
        return root / self.store_name

    def append_offset(self) -> int:
        """The length of the append dimension in the existing store; 0 without one."""
        if not self.append_dim:
            return 0
        for document in zarr3.array_documents(self.target).values():
            if self.append_dim in document["dimension_names"]:
                return document["shape"][document["dimension_names"].index(self.append_dim)]
        raise ValueError(f"{self.append_dim} isn't in the store")

    def chunks(self, schema: dict) -> dict[str, int]:
        given = self.dynamic_chunking_fn(schema, **self.dynamic_chunking_fn_kwargs) if self.dynamic_chunking_fn else self.target_chunks
        return target_chunks(schema, given)

    def build(self, files: DataFrame, file_type: str = "netcdf3", cache: str | None = None, secrets: Mapping[str, str] | None = None, auth: tuple[str, str] | None = None) -> Target:
        """From a table of files to the store: headers, one schema, offsets, parts of chunks, blocks; the store's folder.

        ``files`` has url and <dim>_pos of every combined dimension. Data without one of the
        concat dimensions is taken from the files that are first in it. All files with a
        coordinate must agree in its labels; those of an existing store aren't compared.
        """
        axes, given = list(self.combine_dims), {"file_type": file_type, "cache": cache, "secrets": secrets, "auth": auth}
        keys = [f"{a.name}_pos" for a in axes]
        along = [a.name for a in axes if a.operation is CombineOp.CONCAT]
        files = files.select(*keys, "url")
        rows = scan_schemas(files, tuple(axes), **given)
        schema = determine_schema(rows, axes)
        lens = [rows.dims.where(F.col("dim") == d).select("dim", F.col(f"{d}_pos").alias("position"), "len").distinct() for d in along]
        moved = {self.append_dim: self.append_offset()} if self.append_dim else None
        placed = index_items(files, reduce(DataFrame.unionByName, lens), along, moved) if lens else files

        def parts(name: str, v: dict) -> Callable[[dict[str, int]], DataFrame]:
            own = placed.join(rows.vars.where(F.col("name") == name).select(*keys), keys, "left_semi")
            for d in along:
                if d not in v["dims"]:
                    own = own.where(F.col(f"{d}_pos") == 0)
            return lambda sizes: open_parts(own.select("url", *(f"{d}_start" for d in along if d in v["dims"])), name, v["dtype"], sizes, **given)

        def labels(name: str, v: dict) -> DataFrame:
            own = placed.join(rows.vars.where(F.col("name") == name).select(*keys), keys, "left_semi")
            start = F.col("begin") - (moved or {}).get(name, 0) if name in along else F.lit(0)
            own = own.select("url", (F.col(f"{name}_start") if name in along else F.lit(0)).cast("long").alias("begin"))
            cells = open_cells(own, name, tuple(v["dims"]), v["dtype"], **given).withColumn(f"{name}_pos", F.col(f"{name}_pos") + start)
            return agreed(cells, v["dims"], name)

        return self.write(schema, {k: labels(k, v) for k, v in schema["coords"].items()} | {k: parts(k, v) for k, v in schema["data_vars"].items()})

    def write(self, schema: dict, variables: Mapping[str, DataFrame | Callable[[dict[str, int]], DataFrame]]) -> Target:
        """``variables``: (<dim>_pos ..., name) frames of global positions, from 0 for what is appended too; the store's folder.

        Instead of a frame of cells, a function of the chunks' lengths may give the parts of
        chunks (see ``paste``), placed in the whole store.
        """
        schema = with_prefixed_attrs(schema, self.attrs, self.attr_prefix)
        chunks, target, moved = self.chunks(schema), self.target, self.append_offset()
        every = {**schema["coords"], **schema["data_vars"]}
        if self.append_dim:
            every = {k: v for k, v in every.items() if self.append_dim in v["dims"]}
        documents = {}
        for name, v in every.items():
            own = self.encoding.get(name, {})
            shape = [n + moved * (d == self.append_dim) for d, n in zip(v["dims"], v["shape"])]
            sizes = own.get("chunks") or [chunks[d] for d in v["dims"]]
            if moved:
                old = zarr3.read_document(target, name)
                sizes = old["chunk_grid"]["configuration"]["chunk_shape"]
                if moved % sizes[list(v["dims"]).index(self.append_dim)]:
                    raise ValueError(f"{name} ends within a chunk at {moved}, so nothing can be written behind it without rewriting that chunk")
                documents[name] = old | {"shape": shape}
            else:
                attrs = {k: json_value(x) for k, x in v["attrs"].items()}
                documents[name] = zarr3.array_document(shape, sizes, v["dtype"], v["dims"], attrs, own.get("codec"), own.get("fill_value", 0))
        if not moved:  # the same store again after a repeat
            if target.exists():
                target.rm(recursive=True)
            zarr3.write_document(target, "", zarr3.group_document({k: json_value(x) for k, x in schema["attrs"].items()}))
            for name, document in documents.items():
                zarr3.write_document(target, name, document)
        for name, document in documents.items():
            dims, cells = list(every[name]["dims"]), variables[name]
            sizes = dict(zip(dims, document["chunk_grid"]["configuration"]["chunk_shape"]))
            written = {"fill": document["fill_value"], "keep": zarr3.chunk_writer(target, name, document)}
            if callable(cells):
                blocks = paste(cells(sizes), document["data_type"], sizes, **written)
            else:
                if moved:
                    cells = cells.withColumn(f"{self.append_dim}_pos", F.col(f"{self.append_dim}_pos") + moved)
                blocks = assemble(cells, name, document["data_type"], dict(zip(dims, document["shape"])), sizes, **written)
            blocks.agg(F.count("*")).collect()
        if moved:
            for name, document in documents.items():
                zarr3.write_document(target, name, document)
        return target


def rechunk_store(spark, source: str, store: StoreToZarr, chunks: Mapping[str, int]) -> Target:
    """Write an existing store anew with other chunks: its chunks are cut into parts of the new ones, which move as bytes."""
    documents = zarr3.array_documents(Target(source))
    dims = {d: n for doc in documents.values() for d, n in zip(doc["dimension_names"], doc["shape"])}
    entry = lambda doc: {"dims": doc["dimension_names"], "shape": doc["shape"], "dtype": doc["data_type"], "attrs": {k: json.dumps(v) for k, v in doc["attributes"].items()}, "encoding": {}}
    schema = {
        "attrs": {k: json.dumps(v) for k, v in zarr3.read_document(Target(source))["attributes"].items()}, "dims": dims, "chunks": {},
        "coords": {k: entry(v) for k, v in documents.items() if k in dims}, "data_vars": {k: entry(v) for k, v in documents.items() if k not in dims},
    }
    store.target_chunks = dict(chunks)
    moved = {store.append_dim: store.append_offset()}
    part_of = lambda name: lambda sizes: zarr3.read_parts(spark, source, name, sizes, moved)
    return store.write(schema, {name: part_of(name) for name in documents})
