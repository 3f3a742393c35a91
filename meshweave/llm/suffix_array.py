"""Suffix-array deduplication: bytes of repeated strings, found by backward extension on a Burrows-Wheeler transform.

A string of ``min_len`` bytes holds ``min_len - GRAM + 1`` grams; the least by hash is its
anchor, so equal strings have equal anchors at equal places. An anchor and the bytes of
all strings that it stands for are its context. Grams that several documents have bring
their contexts, as bytes, to one place, where the different ones of each gram get a
positional Burrows-Wheeler transform: at every column the contexts in the order of what
follows, led to the next column on the left by their preceding bytes. Common prefixes are
derived along with it, each column's from the one on its right, up to ``min_len``; where the value is
reached, an interval of contexts has the string in common, and its smallest document tells
which of the others lose it. Hashes only bring contexts together; bytes decide.

A gram with many rows is split: its equal contexts collapse where they lie, and different
ones are dealt by ever longer bytes around the gram, one deal for each range of places
that a string may have, until the groups are small.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

GRAM = 16
#: Bytes of text hashed at once, contexts compared at once, and the rows from which a group is split.
TEXT_BLOCK, CONTEXT_BLOCK, HOT_ROWS = 1 << 18, 1 << 14, 1 << 18
#: Anchors sorted at once before they are dealt by gram, to so many buckets for each partition.
ANCHOR_BLOCK, BUCKETS = 1 << 18, 16
#: Documents meet their rows, and grams their contexts, in so many parts one after the other, to halve what lies on disks.
SLICES = 2
#: Turns of a periodic run that one row stands for.
TURNS = 1 << 18

_random = np.random.default_rng(16)
_BYTES = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = [np.uint64(int(x) | 1) for x in _random.integers(0, 1 << 63, 6)]
#: An anchor as it is dealt: of one whose gram is known to be in several documents, at is inverted.
_PLACE = np.dtype([("gram", "<i8"), ("doc", "<i8"), ("row", "<i8"), ("at", "<i4"), ("shape", "<i4")])
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[5]
    return x ^ (x >> np.uint64(29))


def anchors(data: np.ndarray, ends: np.ndarray, min_len: int) -> dict[str, np.ndarray]:
    """The anchors in texts that are joined in ``data`` and end at ``ends``.

    Returns for each its gram's hash, its shape (64 times the first string's distance before
    it, plus the last one's), its text, its place in the text, and how many equal contexts
    follow each other there: in a periodic run the next one is as far away as the context
    has strings.
    """
    span = min_len - GRAM + 1
    none = {k: np.zeros(0, np.int64) for k in ("gram", "shape", "text", "at", "runs")}
    if len(data) < min_len:
        return none
    h = _BYTES[data]
    for k, step in enumerate((1, 2, 4, 8)):
        h = h[:-step] * _ODD[k] + h[step:]
    h = _mixed(h)
    low = (h & _HIGH) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    starts = np.r_[0, ends[:-1]]
    lengths = ends - starts
    text = np.repeat(np.arange(len(ends)), lengths)
    ok = np.flatnonzero(np.arange(len(low)) + min_len <= ends[text[: len(low)]])
    if not len(ok):
        return none
    place = (low[ok] & _LOW).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    first, last, at = ok[cut], ok[np.r_[cut[1:], len(ok)] - 1], place[cut]
    shape, gram, owner = (at - first) << 6 | (at - last), h[at], text[first]
    step = last - first + 1
    same = np.flatnonzero((shape[1:] == shape[:-1]) & (gram[1:] == gram[:-1]) & (owner[1:] == owner[:-1]) & (np.diff(at) == step[1:])) + 1
    for some in np.array_split(same, len(same) // 65536 + 1):  # the bytes tell whether it is a run
        size = step[some] + min_len - 1
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        here = np.repeat(first[some], size) + inner
        differs = np.bincount(np.repeat(np.arange(len(some)), size), data[here] != data[here - np.repeat(step[some], size)], len(some))
        owner[some] += np.where(differs == 0, len(ends), 0)  # marks a follower
    lead = np.flatnonzero(owner < len(ends))
    return {"gram": gram[lead].view(np.int64), "shape": shape[lead], "text": owner[lead], "at": at[lead] - starts[owner[lead]], "runs": np.diff(np.r_[lead, len(at)])}


def common_minima(bytes_: np.ndarray, groups: np.ndarray, least: np.ndarray, min_len: int) -> np.ndarray:
    """For each context (a row, a byte + 1 in each column or 0 outside) and each column where a string
    may start: the smallest ``least`` of the contexts in the same group that have the same string there.

    ``groups`` are ascending. Columns of the transform are positions; ``source`` leads from the
    order at column q to that at q + 1, from which the prefixes at q follow.
    """
    n, columns = bytes_.shape
    width = columns - min_len + 1
    out = np.repeat(least[:, None], width, 1)
    if n < 2:
        return out
    # Sorted as one number: group, byte (9 bits), place in the order so far (32 bits).
    block = np.cumsum(np.r_[False, groups[1:] != groups[:-1]]) << 41 | np.arange(n)
    now = np.arange(n)
    prefix = np.zeros(n + 1, np.int8)  # of each context and the one before it, min_len: not less; the last is never read
    columnwise = np.ascontiguousarray(bytes_.T)
    for q in range(columns - 1, -1, -1):
        key = np.sort(block | columnwise[q][now].astype(np.int64) << 32)
        source = key & 0xFFFFFFFF
        key >>= 32
        now = now[source]
        same = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] & 511 != 0)) + 1
        # What the two have in common from here on is this byte and the least that lies between them in the order behind it.
        low = prefix[source[same]]
        apart = np.flatnonzero(source[same] - source[same - 1] > 1)
        if len(apart):
            between = np.stack([source[same[apart] - 1], source[same[apart]]], 1).ravel() + 1
            low[apart] = np.minimum.reduceat(prefix, between)[::2]
        prefix = np.zeros(n + 1, np.int8)
        prefix[same] = np.minimum(low + 1, min_len)
        if q < width:
            heads = np.flatnonzero(prefix[:n] < min_len)
            out[now, q] = np.repeat(np.minimum.reduceat(least[now], heads), np.diff(np.r_[heads, n]))
    return out


def _heads(ascending: np.ndarray) -> np.ndarray:
    """Where each value begins."""
    return np.flatnonzero(np.r_[True, ascending[1:] != ascending[:-1]])


def _of_several(places: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Whether the anchors from each of ``heads`` on, up to the next, are of several documents."""
    return np.minimum.reduceat(places["doc"], heads) < np.maximum.reduceat(places["doc"], heads)


def _places(texts: DataFrame, min_len: int, buckets: int) -> DataFrame:
    """(bucket, places) for every anchor of ``texts(doc_id, row, text)``; places: _PLACE records of the bucket's grams, as bytes.

    shape: of :func:`anchors`, plus 4096 times the turns of a run. Of a gram that several
    documents in the block at hand have, the first row is a witness that tells the other
    blocks; the others are settled and go to any bucket. ``buckets`` is a power of two.
    """

    def found_in(raws: list[bytes], ids: list[int], rows: list[int]) -> np.ndarray:
        found = anchors(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([len(r) for r in raws]), min_len)
        gram, at, runs, shape, which = found["gram"], found["at"], found["runs"], found["shape"], found["text"]
        if (runs > TURNS).any():  # the next part of a long run begins where this one ends
            parts = -(-runs // TURNS)
            part = np.repeat(np.arange(len(runs)), parts)
            nth = np.arange(len(part)) - np.repeat(np.cumsum(parts) - parts, parts)
            gram, shape, which = gram[part], shape[part], which[part]
            at = at[part] + nth * TURNS * ((shape >> 6) - (shape & 63) + 1)
            runs = np.minimum(runs[part] - nth * TURNS, TURNS)
        out = np.empty(len(gram), _PLACE)
        out["gram"], out["doc"], out["row"], out["at"], out["shape"] = gram, np.array(ids, np.int64)[which], np.array(rows, np.int64)[which], at, runs << 12 | shape
        return out

    def cut(places: np.ndarray, starts: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
        bounds = np.r_[starts, len(places)].astype(np.int32) * _PLACE.itemsize
        blobs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(places.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), blobs], ["bucket", "places"])

    def dealt(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        whole = np.concatenate(found)
        for at in range(0, len(whole), 4 * ANCHOR_BLOCK):  # a long text has more
            yield from sorted_(whole[at : at + 4 * ANCHOR_BLOCK])

    def sorted_(places: np.ndarray) -> Iterator[pa.RecordBatch]:
        mixed = _mixed(places["gram"].astype(np.uint64))  # one to one; grams themselves are the least of their neighbours
        order = np.argsort(mixed)
        places, mixed = places[order], mixed[order]
        heads = _heads(mixed)
        several = _of_several(places, heads)
        settled = np.repeat(several, np.diff(np.r_[heads, len(places)]))
        places["at"][settled] = ~places["at"][settled]
        settled[heads] = False
        open_, settled = np.flatnonzero(~settled), np.flatnonzero(settled)
        bucket = mixed[open_] >> np.uint64(65 - buckets.bit_length())
        starts = _heads(bucket)
        yield cut(places[open_], starts, bucket[starts])
        if len(settled):
            starts = np.arange(0, len(settled), 256)
            yield cut(places[settled], starts, mixed[settled[starts]] & np.uint64(buckets - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raws, ids, rows, size, found = [], [], [], 0, []
        for batch in batches:
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = text.as_buffer()
                raws.append(raw.to_pybytes())
                ids.append(doc)
                rows.append(row)
                size += raw.size
                if size >= TEXT_BLOCK:
                    found.append(found_in(raws, ids, rows))
                    raws, ids, rows, size = [], [], [], 0
                    if sum(map(len, found)) >= ANCHOR_BLOCK:
                        yield from dealt(found)
                        found = []
        yield from dealt([*found, found_in(raws, ids, rows)])

    return texts.select("doc_id", "row", "text").mapInArrow(run, "bucket long, places binary")


def _shared(places: DataFrame) -> DataFrame:
    """The anchors whose gram is in several documents, told from whole buckets of grams.

    Settled anchors are dealt without regard to their gram, so a gram brings a row or so for
    each block that has it often.
    """
    names = ["gram", "doc", "row", "at", "shape"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups((b for b in batches if b.num_rows), 1):
            blobs = batch.column(1)
            bounds = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
            found = np.frombuffer(blobs.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(_PLACE)
            found = found[np.argsort(found["gram"], kind="stable")]
            heads = _heads(found["gram"])
            several = _of_several(found, heads) | np.logical_or.reduceat(found["at"] < 0, heads)
            kept = found[np.repeat(several, np.diff(np.r_[heads, len(found)]))]
            at = np.where(kept["at"] < 0, ~kept["at"], kept["at"])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (kept["gram"], kept["doc"], kept["row"], at, kept["shape"])], names)

    return places.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "gram long, doc long, row long, at int, shape int")


def _contexts(texts: DataFrame, shared: DataFrame, min_len: int) -> DataFrame:
    """``shared`` with the context of every row: texts and rows meet by document, each text before its rows."""
    names = ["gram", "doc", "row", "at", "shape", "context", "slice"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = np.zeros(0, np.uint8)
        for batch in batches:
            text, at, shape = batch.column(5), batch.column(3), batch.column(4)
            is_text = at.is_null().to_numpy(zero_copy_only=False)
            ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            data = np.concatenate([carried, raw])
            base = np.where(is_text, ends[:-1] - ends[0] + len(carried), 0)
            base = np.maximum.accumulate(base)  # of the text above; 0 is the one that was carried over
            rows = np.flatnonzero(~is_text)
            if len(rows):
                place, form = at.take(pa.array(rows)).to_numpy().astype(np.int64), shape.take(pa.array(rows)).to_numpy()
                before, after = form >> 6 & 63, form & 63
                size = (before - after + min_len).astype(np.int64)
                bounds = np.r_[0, np.cumsum(size)]
                inner = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size)
                found = data[np.repeat(base[rows] + place - before, size) + inner]
                context = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(found)])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows)) for i in range(5)), context, batch.column(6).take(pa.array(rows))], names)
            if is_text.any():
                last = int(np.flatnonzero(is_text)[-1])
                carried = raw[ends[last] - ends[0] : ends[last + 1] - ends[0]].copy()

    null = F.lit(None)
    wanted = texts.select(null.cast("long").alias("gram"), F.col("doc_id").alias("doc"), "row", null.cast("int").alias("at"), null.cast("int").alias("shape"), "text", null.cast("int").alias("slice"))
    both = wanted.union(shared.select("gram", "doc", "row", "at", "shape", null.cast("string"), "slice"))
    met = both.repartition("doc", "row").sortWithinPartitions("doc", "row", F.col("at").asc_nulls_first())
    return met.mapInArrow(run, "gram long, doc long, row long, at int, shape int, context binary, slice int")


def _common(context: pa.Array, group: np.ndarray, before: np.ndarray, after: np.ndarray, least: np.ndarray, a: int, b: int, min_len: int) -> tuple[np.ndarray, ...]:
    """(which, first, last, least): runs of the strings that begin between b and a bytes before the anchor, and lie in their
    context, that have one smallest document among the contexts of their group."""
    left = min_len - GRAM
    bounds = np.frombuffer(context.buffers()[1], np.int32)[context.offset : context.offset + len(context) + 1].astype(np.int64)
    flat, size = np.frombuffer(context.buffers()[2], np.uint8), np.diff(bounds)
    table = np.zeros((len(context), 2 * left + GRAM), np.uint16)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    table[np.repeat(np.arange(len(size)), size), np.repeat(left - before, size) + inner] = flat[bounds[0] : bounds[-1]].astype(np.uint16) + 1
    low = common_minima(table[:, left - b : left - a + min_len], group, least, min_len)
    distance = b - np.arange(b - a + 1)
    own = (distance <= before[:, None]) & (distance >= after[:, None])
    start = own & np.pad(~own[:, :-1] | (low[:, 1:] != low[:, :-1]), ((0, 0), (1, 0)), constant_values=True)
    end = own & np.pad(~own[:, 1:] | (low[:, 1:] != low[:, :-1]), ((0, 0), (0, 1)), constant_values=True)
    (which, first), (_, last) = np.nonzero(start), np.nonzero(end)
    return which, b - first, b - last, low[which, first]


def _whole_groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches joined and cut between values of their first column, from ``size`` rows on."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < size:
            continue
        table = pa.Table.from_batches(held)
        key = table.column(0).to_numpy()
        at = int(np.searchsorted(key, key[-1]))
        if at:
            yield table.slice(0, at).combine_chunks().to_batches()[0]
        held = table.slice(at).combine_chunks().to_batches()
        rows -= at
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _lost(contexts: DataFrame, min_len: int) -> DataFrame:
    """(doc, row, start, end) of lost bytes, from all rows of ``contexts`` of grams with a bounded number of them."""

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        gram, doc, row, at, shape = (batch.column(i).to_numpy() for i in range(5))
        before, after, turns = shape >> 6 & 63, shape & 63, (shape >> 12).astype(np.int64)
        codes = batch.column(5).dictionary_encode().indices.to_numpy().astype(np.int64)
        group = np.cumsum(np.r_[False, gram[1:] != gram[:-1]])
        key = (group * len(codes) + codes) * 64 + before
        order = np.lexsort((doc, key))
        new = np.r_[True, key[order][1:] != key[order][:-1]]
        one = order[new]  # of each different context the row of its smallest document
        # A context alone in its group has all its strings in common with its equals only; the others meet in the transform.
        size = np.bincount(group[one])[group[one]]
        single, several = np.flatnonzero(size == 1), np.flatnonzero(size > 1)
        which, first, last, low = single, before[one[single]], after[one[single]], doc[one[single]]
        if len(several):
            met = one[several]
            more = _common(batch.column(5).take(pa.array(met)), group[met], before[met], after[met], doc[met], 0, min_len - GRAM, min_len)
            which, first, last, low = (np.r_[x, y] for x, y in zip((which, first, last, low), (several[more[0]], *more[1:])))
            order_of = np.argsort(which, kind="stable")
            which, first, last, low = which[order_of], first[order_of], last[order_of], low[order_of]
        # All rows of a context meet its runs.
        many, place = np.bincount(which, minlength=len(one)), np.empty(len(key), np.int64)
        place[order] = np.cumsum(new) - 1
        start_of = np.cumsum(many) - many
        rows = np.repeat(np.arange(len(key)), many[place])
        run = np.repeat(start_of[place], many[place]) + np.arange(len(rows)) - np.repeat(np.cumsum(many[place]) - many[place], many[place])
        hit = low[run] < doc[rows]
        rows, run = rows[hit], run[hit]
        # A periodic run that is lost whole is lost in one piece, else turn by turn.
        whole = (first[run] == before[rows]) & (last[run] == after[rows])
        each = np.where(whole, 1, turns[rows])
        turn = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        more = np.repeat(np.where(whole, turns[rows] - 1, 0), each)
        rows, run = np.repeat(rows, each), np.repeat(run, each)
        step = (before - after + 1)[rows].astype(np.int64)
        start, end = at[rows] - first[run] + turn * step, at[rows] - last[run] + min_len + (turn + more) * step
        return pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(row[rows]), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["doc", "row", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups((b for b in batches if b.num_rows), CONTEXT_BLOCK):
            yield judge(batch)

    return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "doc long, row long, start int, end int")


CONTEXT = ["gram", "before", "context"]


def _hot_minima(contexts: DataFrame, min_len: int) -> DataFrame:
    """(gram, before, context, first, last, least): as :func:`_common`, for any number of ``contexts(gram, before, after, context, least, most)``.

    A group of contexts may share strings that begin a to b bytes before the anchor; equal
    ones agree in the a bytes before the gram and in the bytes behind it up to b bytes short
    of their end. So a group over HOT_ROWS is dealt twice, for each half of its range,
    by those bytes, and again, until it is small or the range is one place. There the group
    is an interval of the transform that has reached ``min_len``: its minimum is taken.
    """
    left = min_len - GRAM
    part = F.expr(f"substring(context, before - a + 1, a - b + {left + GRAM})")
    after = F.expr(f"before + {min_len} - octet_length(context)")
    names = [*CONTEXT, "first", "last", "least"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups((b for b in batches if b.num_rows), CONTEXT_BLOCK):
            deal, a, b, gram, before, after, least = (batch.column(i).to_numpy() for i in range(7))
            for x, y in set(zip(a.tolist(), b.tolist())):
                rows = np.flatnonzero((a == x) & (b == y))
                which, first, last, low = _common(batch.column(7).take(pa.array(rows)), np.cumsum(np.r_[0, deal[rows][1:] != deal[rows][:-1]]), before[rows], after[rows], least[rows], x, y, min_len)
                hit = low < batch.column(8).to_numpy()[rows[which]]
                which, first, last, low = rows[which[hit]], first[hit], last[hit], low[hit]
                yield pa.RecordBatch.from_arrays([pa.array(gram[which]), pa.array(before[which]), batch.column(7).take(pa.array(which)), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(low)], names)

    out, a_or_b = [], F.expr("cast(floor((a + b) / 2) as int)")
    dealt = written(contexts.withColumn("a", F.lit(0)).withColumn("b", F.lit(left)).withColumn("deal", F.xxhash64("gram", "a", "b", part)), "dealt")
    while True:
        big = written(dealt.groupBy("deal").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).withColumn("big", F.lit(True)).drop("n"), "big")
        marked = dealt.join(big, "deal", "left")
        small = marked.where("big is null").select("deal", "a", "b", "gram", "before", after.cast("int").alias("after"), "least", "context", "most")
        out.append(written(small.repartition("deal").sortWithinPartitions("deal").mapInArrow(run, "gram long, before int, context binary, first int, last int, least long"), "minima"))
        if big.isEmpty():
            dropped(dealt, big)
            return functools.reduce(DataFrame.union, out)
        rest = marked.where("big").drop("deal", "big")
        alone = rest.where("a = b").withColumn("string", F.expr(f"substring(context, before - a + 1, {min_len})"))
        lowest = alone.groupBy("a", "string").agg(F.min("least").alias("low"))
        out.append(written(alone.join(lowest, ["a", "string"]).where("low < most").select(*CONTEXT, F.col("a").alias("first"), F.col("a").alias("last"), F.col("low").alias("least")), "minima"))
        halves = F.explode(F.array(F.struct("a", a_or_b.alias("b")), F.struct((a_or_b + 1).alias("a"), "b")))
        ranges = rest.where("a < b").withColumn("half", halves).withColumn("a", F.col("half.a")).withColumn("b", F.col("half.b")).drop("half")
        ranges = ranges.where(F.greatest(F.col("a"), after) <= F.least("b", "before"))
        finer = written(ranges.withColumn("deal", F.xxhash64("gram", "a", "b", part)), "dealt")
        dropped(dealt, big)
        dealt = finer


def _hot_lost(contexts: DataFrame, min_len: int) -> DataFrame:
    """(doc, row, start, end) as :func:`_lost`, for grams with any number of rows: equal contexts collapse before they move."""
    rows = contexts.withColumn("before", F.expr("shape >> 6 & 63"))
    distinct = rows.groupBy(*CONTEXT).agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    minima = _hot_minima(distinct, min_len)
    met = rows.join(minima, CONTEXT).where("least < doc").withColumn("after", F.expr("shape & 63")).withColumn("turns", F.expr("shape >> 12"))
    whole = F.expr("first = before and last = after")  # then a periodic run is lost in one piece
    met = met.withColumn("turn", F.explode(F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("turns") - 1))))
    more = F.when(whole, F.col("turns") - 1).otherwise(F.lit(0))
    step: Column = F.expr("before - after + 1")
    return met.select("doc", "row", (F.col("at") - F.col("first") + F.col("turn") * step).alias("start"), (F.col("at") - F.col("last") + min_len + (F.col("turn") + more) * step).alias("end"))


def _copies(whole: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, row, start, end) of lost bytes for the rows of ``whole`` whose text a smaller document has too: all of them.

    ``texts`` has each different text once, with its smallest and largest document.
    """
    digest = F.sha2("text", 256).alias("digest")
    several = texts.where("doc_id < most").select("row", digest, F.col("doc_id").alias("least"))
    rows = whole.select(F.col("doc_id").alias("doc"), "row", digest, F.octet_length("text").alias("end"))
    return rows.join(several, ["row", "digest"]).where("doc > least").select("doc", "row", F.lit(0).alias("start"), "end")


def repeats(texts: DataFrame, min_len: int = 50) -> DataFrame:
    """(doc_id, row, lost) for the texts that lose bytes; lost: array of (start, end), which may overlap.

    ``texts(doc_id long, row long, text string)`` has a hash of its text in row, by which rows
    that share an id are told apart. Null ids and null texts have no part in it; equal rows
    count once; an empty table gives none.
    """
    whole = texts.where(f"doc_id is not null and octet_length(text) >= {min_len}")
    texts = written(whole.groupBy("row", "text").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("most")), "texts", "zstd")
    copies = written(_copies(whole, texts), "lost")
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = written(_shared(_places(texts, min_len, 1 << (BUCKETS * partitions - 1).bit_length())), "shared")
    hot = written(shared.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).withColumn("slice", F.lit(-1)).drop("n"), "hot")
    any_hot = not hot.isEmpty()
    sliced = shared.join(hot, "gram", "left").withColumn("slice", F.coalesce("slice", F.pmod(F.xxhash64("gram"), F.lit(SLICES)).cast("int")))
    half = lambda df, doc, k: df.where(F.pmod(F.xxhash64(doc), F.lit(SLICES)) == k)
    halves = [written(_contexts(half(texts, "doc_id", k), half(sliced, "doc", k), min_len), "contexts", "zstd") for k in range(SLICES)]
    contexts = functools.reduce(DataFrame.union, halves)
    dropped(shared, hot, texts)
    parts = [copies]
    parts += [written(_hot_lost(contexts.where("slice = -1"), min_len), "lost")] if any_hot else []
    parts += [written(_lost(contexts.where(f"slice = {k}"), min_len), "lost") for k in range(SLICES)]
    dropped(*halves)
    lost = functools.reduce(DataFrame.union, parts)
    return lost.groupBy(F.col("doc").alias("doc_id"), "row").agg(F.collect_list(F.struct("start", "end")).alias("lost"))


def kept_bytes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int]:
    """What stays of ``raw``, and the number of maximal removed runs."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    heads = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]]) if len(starts) else np.zeros(0, np.int64)
    begin, stop = starts[heads].tolist(), ends[np.r_[heads[1:] - 1, len(ends) - 1]].tolist() if len(starts) else []
    parts, at = [], 0
    for a, b in zip(begin, stop):
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return b"".join(parts), len(begin)


def _kept(docs: DataFrame, min_len: int, carried: list[str], text: bool) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, last, c0, c1, ...): last is the kept text or its digest, c0 ... the carried columns."""
    if not GRAM <= min_len <= GRAM + 63:
        raise ValueError(f"min_len must lie between {GRAM} and {GRAM + 63}")
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carried)]
    texts = docs.select("doc_id", F.xxhash64("text").alias("row"), "text", *own)
    lost = repeats(texts.select("doc_id", "row", "text"), min_len)
    types = "".join(f", c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carried))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_kept, spans, last = [], [], [], []
            for value, found in zip(batch.column(1), batch.column(2)):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                kept, n = kept_bytes(raw, *(found.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))) if found.is_valid else (raw, 0)
                n_bytes.append(len(raw))
                n_kept.append(len(kept))
                spans.append(n)
                last.append((kept.decode("utf-8", "ignore") if value.is_valid else None) if text else hashlib.sha256(kept).hexdigest())
            removed = [a - b for a, b in zip(n_bytes, n_kept)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, removed, spans)), pa.array(last, pa.string()), *batch.columns[3:]], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "last", *(f"c{k}" for k in range(len(carried)))]
    joined = texts.join(lost, ["doc_id", "row"], "left").select("doc_id", "text", "lost", *names[5:])
    return joined.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, last string{types}")


def deduplicate(docs: DataFrame, min_len: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs(doc_id long, text)``.

    Each byte covered by a string of ``min_len`` bytes that also starts in a document with a
    smaller doc_id is removed; strings are those of the whole input, never across documents.
    A null text is ''; a row with a null id loses nothing and takes from no other; rows that
    share an id don't take from each other, whatever their texts; repeated rows give repeated
    results; ties don't arise, as only smaller ids take; an empty table gives none; texts may
    have any length up to 2 GB; other columns are not read.
    """
    return _kept(docs, min_len, [], False).withColumnRenamed("last", "kept_sha256")


def without_repeats(docs: DataFrame, min_len: int = 50) -> DataFrame:
    """``docs(doc_id, text, ...)`` with the kept text of each row, and its length where there is a column n_chars.

    Rows, nulls and ties are as for :func:`deduplicate`, but a null text stays null and its
    n_chars what it was. A text that loses all its bytes is ''; a character that has lost a
    part goes. All other columns stay, whatever their names.
    """
    carried = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = _kept(docs, min_len, carried, True)
    columns = {c: F.col(f"c{k}") for k, c in enumerate(carried)} | {"doc_id": F.col("doc_id"), "text": F.col("last")}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col("last").isNull(), columns["n_chars"]).otherwise(F.length("last").cast(kind))
    return out.select(*(columns[c].alias(c) for c in docs.columns))
