"""Rechunking: from fragments or cells to target chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import chunk_of, chunks_met

#: Bytes of a block that one task may assemble.
BLOCK_BYTES = 1 << 30


def split_fragments(fragments: DataFrame, chunks: Mapping[str, int]) -> DataFrame:
    """A row for each target chunk that a fragment meets: <dim>_chunk, <dim>_lo and <dim>_hi, the part of the chunk that it fills.

    ``fragments`` has <dim>_start and <dim>_len; <dim>_size, if there, must not be 0. Merge
    positions are ordinary columns: group by them too, and variables never mix.
    """
    for dim, chunk in chunks.items():
        start, length = f"{dim}_start", f"{dim}_len"
        if f"{dim}_size" in fragments.columns:
            indexed = F.when(F.col(f"{dim}_size") > 0, F.col(start)).otherwise(F.raise_error(F.lit(f"{dim} isn't properly indexed")))
            fragments = fragments.withColumn(start, indexed)
        fragments = fragments.withColumn(f"{dim}_chunk", F.explode(chunks_met(start, length, chunk)))
        fragments = fragments.withColumn(f"{dim}_lo", F.expr(f"greatest(`{start}`, `{dim}_chunk` * {chunk})"))
        fragments = fragments.withColumn(f"{dim}_hi", F.expr(f"least(`{start}` + `{length}`, (`{dim}_chunk` + 1) * {chunk})"))
    return fragments


def with_chunks(cells: DataFrame, chunks: Mapping[str, int], suffix: str = "_pos") -> DataFrame:
    """Cells with the chunk of each dimension, a narrow operation."""
    return cells.withColumns({f"{dim}_chunk": chunk_of(f"{dim}{suffix}", size) for dim, size in chunks.items()})


def rechunk(cells: DataFrame, chunks: Mapping[str, int], by: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Cells dealt by target chunk and sorted within it: one shuffle, after which a chunk lies in one partition."""
    keys = [*by, *(f"{dim}_chunk" for dim in chunks)]
    cells = with_chunks(cells, chunks)
    dealt = cells.repartition(partitions, *keys) if partitions else cells.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *(f"{dim}_pos" for dim in chunks))


def validate(parts: DataFrame, dims: Sequence[str], group: Sequence[str]) -> DataFrame:
    """(*group, full, contiguous): whether the parts of each group fill a hypercube, and follow each other without gaps.

    ``parts`` has <dim>_start and <dim>_len. Full: as many parts as the product of their
    distinct starts. Contiguous: in every dimension each start is followed by the next
    where its part ends, and parts with one start have one length.
    """
    whole = parts.groupBy(*group).agg(F.count("*").alias("n"), *(F.count_distinct(f"{d}_start").alias(f"n_{d}") for d in dims))
    out = whole.select(*group, (F.col("n") == F.expr(" * ".join(f"n_{d}" for d in dims))).alias("full"))
    for d in dims:
        starts = parts.groupBy(*group, f"{d}_start").agg(F.min(f"{d}_len").alias("lo"), F.max(f"{d}_len").alias("hi"))
        following = F.lead(f"{d}_start").over(Window.partitionBy(*group).orderBy(f"{d}_start"))
        fits = (F.col("lo") == F.col("hi")) & F.coalesce(following == F.col(f"{d}_start") + F.col("lo"), F.lit(True))
        ok = starts.withColumn("ok", fits).groupBy(*group).agg(F.min("ok").alias(f"ok_{d}"))
        out = out.join(ok, list(group)) if group else out.crossJoin(ok)
    return out.select(*group, "full", F.expr(" and ".join(f"ok_{d}" for d in dims)).alias("contiguous"))


def _refuse_large(sizes: Sequence[int], code: np.dtype) -> None:
    if (size := int(np.prod(sizes, dtype=object)) * code.itemsize) > BLOCK_BYTES:
        raise ValueError(f"a chunk of {size} bytes is more than one task may hold ({BLOCK_BYTES})")


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def part_names(dims: Sequence[str]) -> list[str]:
    """The columns of a part's place: its chunk, where it begins in it, how long it is, for each dimension."""
    return [f"{d}_{c}" for d in dims for c in ("chunk", "lo", "len")]


def cut(values: np.ndarray, at: Sequence[int], sizes: Sequence[int], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """An array that begins at ``at`` as the parts of chunks of ``sizes``, one at a time: ``names`` and data."""
    for index in product(*(range(a // c, -(-(a + n) // c)) for a, n, c in zip(at, values.shape, sizes))):
        span = [(max(a, k * c), min(a + n, (k + 1) * c)) for a, n, c, k in zip(at, values.shape, sizes, index)]
        part = values[tuple(slice(lo - a, hi - a) for (lo, hi), a in zip(span, at))]
        place = [x for k, c, (lo, hi) in zip(index, sizes, span) for x in (k, lo - k * c, hi - lo)]
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in place), pa.array([part.tobytes()], pa.binary())], [*names, "data"])


def _made(rows: DataFrame, keys: Sequence[str], block: Callable[[pa.Table], tuple[int, np.ndarray]], keep: Callable[[Sequence[int], np.ndarray], None] | None) -> DataFrame:
    """(*keys, n_cells, data): ``block(rows)`` of each group. ``keep`` takes its keys and cells where it is made; then there is no data."""
    types = dict(rows.dtypes)
    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + "n_cells long" + ("" if keep else ", data binary")
    out_schema = _arrow_schema(schema)

    def one(table: pa.Table) -> pa.Table:
        at = [table.column(k)[0].as_py() for k in keys]
        n, data = block(table)
        if keep:
            keep(at, data)
        return pa.table([*([x] for x in at), [n], *([] if keep else [[data.tobytes()]])], names=out_schema.names).cast(out_schema)

    return rows.groupBy(*keys).applyInArrow(one, schema)


def paste(parts: DataFrame, dtype: str, chunks: Mapping[str, int], fill: float = 0, keep: Callable[[Sequence[int], np.ndarray], None] | None = None) -> DataFrame:
    """(<dim>_chunk ..., n_cells, data): parts of chunks (<dim>_chunk, <dim>_lo, <dim>_len ..., data) as whole blocks.

    What no part holds is ``fill``. A chunk over BLOCK_BYTES is refused, and parts that
    overlap are an error, so a chunk's parts are never more than one block's bytes. With
    ``keep(index, block)`` each block is handed over where it is made, and no data come back:
    a task then holds one block, however many it makes.
    """
    dims, code = list(chunks), np.dtype(dtype)
    sizes = [chunks[d] for d in dims]
    _refuse_large(sizes, code)

    def block(table: pa.Table) -> tuple[int, np.ndarray]:
        data, known = np.full(sizes, fill, code), np.zeros(sizes, bool)
        for batch in table.to_batches():
            places = [batch.column(f"{d}_{c}").to_pylist() for d in dims for c in ("lo", "len")]
            for i, raw in enumerate(batch.column("data")):
                lo, n = [p[i] for p in places[::2]], [p[i] for p in places[1::2]]
                box = tuple(slice(a, a + b) for a, b in zip(lo, n))
                if known[box].any():
                    raise ValueError("a cell comes more than once")
                data[box] = np.frombuffer(raw.as_buffer(), code).reshape(n)
                known[box] = True
        return int(known.sum()), data

    return _made(parts, [f"{d}_chunk" for d in dims], block, keep)


def assemble(cells: DataFrame, variable: str, dtype: str, shape: Mapping[str, int], chunks: Mapping[str, int], fill: float = 0, by: Sequence[str] = (), keep: Callable[[Sequence[int], np.ndarray], None] | None = None) -> DataFrame:
    """(*by, <dim>_chunk ..., n_cells, data): the cells of each target chunk as one block of whole chunk size in C order.

    Cells that aren't there hold ``fill``; what a chunk reaches past the array does too. A
    chunk over BLOCK_BYTES is refused before anything moves, as it wouldn't fit a task. A
    cell that comes twice, or null in a position, is an error; a null value is ``fill``.
    ``keep`` is as in :func:`paste`.
    """
    dims, code = list(chunks), np.dtype(dtype)
    sizes = [chunks[d] for d in dims]
    _refuse_large(sizes, code)
    keys = [*by, *(f"{d}_chunk" for d in dims)]

    def block(table: pa.Table) -> tuple[int, np.ndarray]:
        at = [table.column(f"{d}_pos").to_numpy() - table.column(f"{d}_chunk")[0].as_py() * n for d, n in zip(dims, sizes)]
        flat = np.ravel_multi_index(at, sizes) if dims else np.zeros(table.num_rows, np.int64)
        if len(np.unique(flat)) != len(flat):
            raise ValueError("a cell comes more than once")
        data = np.full(int(np.prod(sizes)), fill, code)
        values = table.column(variable).combine_chunks()
        known = values.is_valid().to_numpy(zero_copy_only=False)
        data[flat[known]] = values.drop_null().to_numpy(zero_copy_only=False).astype(code)
        return table.num_rows, data.reshape(sizes)

    return _made(with_chunks(cells.select(*by, *(f"{d}_pos" for d in dims), variable), chunks), keys, block, keep)


def blocks_to_cells(blocks: DataFrame, variable: str, dtype: str, shape: Mapping[str, int], chunks: Mapping[str, int]) -> DataFrame:
    """(<dim>_pos ..., variable): the cells of blocks made by :func:`assemble`, within ``shape``."""
    from ..functions.dtypes import spark_type

    dims, code = list(chunks), np.dtype(dtype)

    def cells(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                at = {d: batch.column(f"{d}_chunk")[i].as_py() for d in dims}
                block = np.frombuffer(batch.column("data")[i].as_py(), code).reshape([chunks[d] for d in dims])
                inside = block[tuple(slice(0, min(chunks[d], shape[d] - at[d] * chunks[d])) for d in dims)]
                places = np.indices(inside.shape).reshape(len(dims), -1)
                columns = [pa.array(p + at[d] * chunks[d], pa.int64()) for d, p in zip(dims, places)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.ascontiguousarray(inside).ravel())], [*(f"{d}_pos" for d in dims), variable])

    return blocks.mapInArrow(cells, "".join(f"`{d}_pos` long, " for d in dims) + f"`{variable}` {spark_type(dtype)}")
