"""SimHash near-duplicates, found in the space of per-segment bit counts.

A fingerprint's segments of two bits are replaced by their bit counts. The Manhattan
distance of two such rows of counts is a lower bound of the Hamming distance of the
fingerprints. If that is at most d, one half of the segments has a Manhattan distance of
at most d // 2, so some grid cell of counts lies within (d // 2 + 1) // 2 steps of both:
each fingerprint is sent to the cells around its own, those that meet in a cell are
compared exactly, and chains of links become components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, written

LOW_BITS = np.uint64(0x5555555555555555)
#: Members of a cell up to which all pairs are compared side by side, in one with others or alone, and up to which it isn't dealt further.
SMALL_CELL, SIDE, WALKED = 24, 256, 4096


def shingles(text: str | None, width: int = 4) -> list[bytes]:
    """Runs of ``width`` words, A-Z lower-cased and joined by one blank; of fewer words the whole sequence; of none nothing."""
    words = (text or "").encode().lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return [b" ".join(run) for run in zip(*(words[i:] for i in range(width)))]


def fingerprint(text: str | None, width: int = 4) -> int:
    """64 bits as a signed integer; each is 1 if over half of the shingles' hashes (repeats count) have it set."""
    grams = shingles(text, width)
    if not grams:
        return 0
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(42))), ">u8").astype(np.uint64)
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):  # bounded for the longest texts
        bits = np.unpackbits(hashes[start : start + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(grams), bitorder="little").view(np.int64)[0])


def cells(prints: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index of its fingerprint) for every cell within reach of each fingerprint's counts, in both halves.

    A cell's number holds its half and two bits for each count.
    """
    x = prints.view(np.uint64)
    counts = x - ((x >> np.uint64(1)) & LOW_BITS)
    keys, owners = [], []
    for half in range(2):
        code = (counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        own = np.arange(len(code))
        all_codes, all_owners = [code], [own]
        for _ in range((limit // 2 + 1) // 2):
            steps, owned = [], []
            for field in range(16):
                shift = np.uint64(2 * field)
                value = (code >> shift) & np.uint64(3)
                for ok, step in ((value < 2, np.uint64(1) << shift), (value > 0, -(np.int64(1) << np.int64(2 * field)))):
                    steps.append(code[ok] + np.uint64(step) if step > 0 else code[ok] - np.uint64(-step))
                    owned.append(own[ok])
            code, own = np.concatenate(steps), np.concatenate(owned)
            all_codes.append(code)
            all_owners.append(own)
        code, own = np.concatenate(all_codes), np.concatenate(all_owners)
        if limit // 2 + 1 >= 4:  # steps forth and back meet again
            both = np.unique(np.stack([code, own.astype(np.uint64)], 1), axis=0)
            code, own = both[:, 0], both[:, 1].astype(np.int64)
        keys.append((code | np.uint64(half << 32)).view(np.int64))
        owners.append(own)
    return np.concatenate(keys), np.concatenate(owners)


def _walk(rest: np.ndarray, limit: int, out: list[np.ndarray], starts: int) -> np.ndarray:
    """Chains of links from ``starts`` members, appended to ``out`` as (member, its links); what no chain has reached."""
    while len(rest) and starts:
        todo, rest, starts = [rest[0]], rest[1:], starts - 1
        while todo and len(rest):
            one = todo.pop()
            near = np.bitwise_count(rest ^ one) <= limit
            if near.any():
                found, rest = rest[near], rest[~near]
                todo += list(found)
                out.append(np.stack([np.full(len(found), one), found], 1))
    return rest


def _beside(some: np.ndarray, limit: int, out: list[np.ndarray]) -> None:
    """Links that connect what is connected in one group: all of them where they are few, else those of a walk."""
    if len(some) <= SIDE:
        a, b = np.nonzero(np.triu(np.bitwise_count(some[:, None] ^ some[None]) <= limit, 1))
        if len(a) <= 4 * len(some):
            out.append(np.stack([some[a], some[b]], 1))
            return
    _walk(some, limit, out, len(some))


def _grouped(keys: np.ndarray, x: np.ndarray, limit: int, bits: np.ndarray, out: list[np.ndarray]) -> None:
    """Links that connect what is connected within each group of equal ``keys``, which are sorted; members agree in all but ``bits``.

    A group over WALKED is dealt by each of limit + 1 shares of the bits: what is linked
    agrees in one of them. Before it is dealt again, the chains of a few members are taken
    out, which is most of what makes such a group large.
    """
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    for gap in range(1, SMALL_CELL):
        rows = starts[(sizes > gap) & (sizes <= SMALL_CELL)]
        if not len(rows):
            continue
        many = sizes[(sizes > gap) & (sizes <= SMALL_CELL)] - gap
        first = np.repeat(rows, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        near = first[np.bitwise_count(x[first] ^ x[first + gap]) <= limit]
        out.append(np.stack([x[near], x[near + gap]], 1))
    for start, size in zip(starts[sizes > SMALL_CELL], sizes[sizes > SMALL_CELL]):
        some = np.unique(x[start : start + size])
        if len(some) > WALKED and len(bits) < 64:
            some = _walk(some, limit, out, 4)
        if len(some) <= WALKED or len(bits) <= limit + 1:
            _beside(some, limit, out)
            continue
        for share in np.array_split(bits, limit + 1):
            key = some & np.bitwise_or.reduce(np.uint64(1) << share)
            order = np.argsort(key, kind="stable")
            _grouped(key[order], some[order], limit, np.setdiff1d(bits, share), out)


def links(keys: np.ndarray, prints: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within each cell; ``keys`` are sorted.

    In a small cell every linked pair is given. A larger one is compared side by side or
    walked through from one member after the other: what lies within the limit is linked
    and set aside, so copies cost a comparison with their group. A very large one is dealt
    further first.
    """
    out: list[np.ndarray] = []
    _grouped(keys, prints.view(np.uint64), limit, np.arange(64, dtype=np.uint64), out)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.concatenate(out).view(np.int64)
    both.sort(1)
    both = np.unique(both, axis=0)
    return both[:, 0], both[:, 1]


def _prints(df: DataFrame, width: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), width) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.int64())], [*keep, "print"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*(F.col(f"`{c}`") for c in keep), "text").mapInArrow(run, f"{schema}, print long")


def print_links(prints: DataFrame, limit: int) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``prints(print)``, enough to connect all that chains of links connect."""

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(x), 4096):
                keys, owners = cells(x[start : start + 4096], limit)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(x[start : start + 4096][owners])], ["cell", "print"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, x = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy(zero_copy_only=False)]
            x = np.r_[x, batch.column(1).to_numpy(zero_copy_only=False)]
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))  # the last cell may go on in the next batch
            a, b = links(keys[:last], x[:last], limit)
            keys, x = keys[last:], x[last:]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        a, b = links(keys, x, limit)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    met = prints.mapInArrow(around, "cell long, print long").repartition("cell").sortWithinPartitions("cell")
    return met.mapInArrow(meet, "a long, b long")


def _rooted(distinct: DataFrame, limit: int) -> DataFrame:
    """``distinct(print, ...)`` with the root of each fingerprint's component."""
    roots = components(print_links(distinct.select("print"), limit)).withColumnRenamed("node", "print")
    return written(distinct.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")), "rooted")


def near_duplicates(docs: DataFrame, limit: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs(doc_id long, text)``.

    Fingerprints that differ in at most ``limit`` bits are linked; component_id is the
    smallest doc_id that links reach. A null, empty or blank text has the fingerprint zero,
    linked like any other. Rows with a null id are linked too, but never name a component:
    where all ids of one are null, so is component_id. Repeated rows give repeated results;
    an empty table gives none; other columns are not read.
    """
    prints = written(_prints(docs, width), "prints")
    distinct = written(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    rooted = _rooted(distinct, limit)
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = written(rooted.select("print", "root").join(least, "root").select("print", "component_id"), "named")
    dropped(distinct, rooted, least)
    return prints.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, limit: int = 4, width: int = 4) -> DataFrame:
    """One row of ``docs(doc_id, text, ...)`` for each group of near-duplicates, with all its columns: that of the smallest doc_id.

    Rows without an id come last in their group. Rows are told apart by 128 bits of hash
    over all columns, so rows that share an id and aren't alike are groups of their own;
    of a group's rows with its smallest id, the one of the least hash stays.
    """
    keys = [f"row hash {k}" + " " * sum(c.startswith("row hash ") for c in docs.columns) for k in (1, 2)]
    keyed = docs.select("*", *(F.xxhash64(F.lit(k), *(F.col(f"`{c}`") for c in docs.columns)).alias(name) for k, name in enumerate(keys)))
    prints = written(_prints(keyed, width, ("doc_id", *keys)), "prints")
    distinct = written(prints.groupBy("print").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *(F.col(f"`{k}`") for k in keys))).alias("least")), "distinct")
    rooted = _rooted(distinct, limit)
    first = written(rooted.groupBy("root").agg(F.min("least").alias("least")).select(*(F.col(f"least.`{k}`") for k in keys)), "first")
    repeated = written(prints.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    dropped(distinct, rooted, prints)
    kept = keyed.join(first, keys, "left_semi")
    if not repeated.isEmpty():  # only rows that are equal in all columns move once more
        kept = kept.join(repeated, keys, "left_anti").union(kept.join(repeated, keys, "left_semi").dropDuplicates(keys))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
