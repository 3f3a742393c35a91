"""WARC fixity: Merkle trees over records and ordered offset ranges, compared from the root down.

An archive is a set of WARC files, kept as a table of their bytes in pieces that end with
a record. Each replica's bytes are read on their own: a record's leaf holds the hash of
its bytes and their offsets, a node above the hash of up to ``FANOUT`` children and the
range of offsets that they cover. Two replicas are compared by their roots, and only the
children of differing nodes are ever looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

#: Characters of a URL that a header can hold as they are.
SAFE = "".join(map(chr, range(33, 127))).replace("%", "")
FANOUT = 64
#: Records of a file, which is filled in the order of the rows, and bytes of a piece.
FILE_RECORDS, PIECE_BYTES = 4096, 1 << 20


def record(url: str | None, body: bytes, page: int | None = None) -> bytes:
    """One WARC record; its id follows from its content, so the same record has the same bytes everywhere."""
    digest = hashlib.sha256(body).hexdigest()
    name = hashlib.sha256(f"{url or ''}\n{digest}".encode()).hexdigest()
    head = (
        f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {quote(url or '', safe=SAFE)}\r\n"
        f"WARC-Record-ID: <urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:32]}>\r\n"
        f"WARC-Payload-Digest: sha256:{digest}\r\nContent-Type: text/html\r\n"
        + (f"Page-ID: {page}\r\n" if page is not None else "") + f"Content-Length: {len(body)}\r\n\r\n"
    )
    return head.encode() + body + b"\r\n\r\n"


def read_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, body) of each record of an uncompressed WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at offset {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        stop = end + 4 + size + 4
        if stop > len(data) or data[stop - 4 : stop] != b"\r\n\r\n":
            raise ValueError(f"the record at offset {at} is cut short")
        yield at, stop - at, headers, data[end + 4 : end + 4 + size]
        at = stop


def scan(pieces: DataFrame) -> DataFrame:
    """(file, offset, length, hash, id, url) of every record in ``pieces(file string, offset long, data binary)``.

    Hashes are of the bytes that are stored. What can't be read as a record, up to the end of
    its piece, counts as one, without id and url. Null or empty pieces have none, repeated
    ones repeat their records, and an empty table gives none; other columns are not read.
    """
    names = ["file", "offset", "length", "hash", "id", "url"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows, end = [], 0
                try:
                    for at, length, head, _ in read_records(data or b""):
                        end = at + length
                        page = head.get("page-id", "")
                        rows.append((file, start + at, length, hashlib.sha256(data[at:end]).digest(), int(page) if page.lstrip("-").isdigit() else None, unquote(head.get("warc-target-uri", ""))))
                except (ValueError, KeyError):
                    rows.append((file, start + end, len(data) - end, hashlib.sha256(data[end:]).digest(), None, None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    return pieces.select("file", "offset", "data").mapInArrow(run, "file string, offset long, length long, hash binary, id long, url string")


def leaves(records: DataFrame) -> DataFrame:
    """(file, node, first, last, hash, id, url) from ``records(file string, offset long, length long, hash binary, id, url)``.

    node: a record's place in its file by (offset, length, hash, id), nulls first; rows equal
    in these take turns. A null file is a file; an empty table gives none.
    """
    order = Window.partitionBy("file").orderBy("offset", "length", "hash", "id")
    return records.select(F.coalesce("file", F.lit("")).alias("file"), (F.row_number().over(order) - 1).cast("long").alias("node"), F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("last"), "hash", "id", "url")


def tree(leaf: DataFrame) -> list[DataFrame]:
    """The levels of the trees of all files, leaves first, up to one root for each file.

    A node's hash is of its children's ranges and hashes in order; a null among them counts
    as one. An empty table has one empty level.
    """
    levels = [written(leaf, "leaves")]
    while not levels[-1].where("node > 0").isEmpty():
        child = F.struct("node", "first", "last", "hash")
        up = levels[-1].select("file", F.expr(f"node div {FANOUT}").alias("node"), child.alias("child")).groupBy("file", "node").agg(F.sort_array(F.collect_list("child")).alias("children"))
        text = F.concat_ws(",", F.transform("children", lambda c: F.concat_ws(":", *(F.coalesce(x.cast("string"), F.lit("-")) for x in (c["first"], c["last"], F.hex(c["hash"]))))))
        levels.append(written(up.select("file", "node", F.element_at("children", 1)["first"].alias("first"), F.element_at("children", -1)["last"].alias("last"), F.unhex(F.sha2(text, 256)).alias("hash")), "level"))
    return levels


def audit(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Records that differ between two replicas, from their leaves; tables without a difference, or without rows, give none.

    Returns file, first, last (the expected range, or the found one of a record too many),
    id, url, expected_hash, found_hash; null where a replica lacks the record. Records are
    those at the same place in their file, so one that is lost makes the ones behind it
    differ up to the end of that file. Equal files cost the comparison of their roots.
    """
    left, right = tree(expected), tree(found)
    top = max(len(left), len(right))
    for levels in (left, right):  # the lower of two trees stands on its root
        levels += [levels[-1]] * (top - len(levels))
    wanted = None
    both = None
    for level in range(top - 1, -1, -1):
        own = [t.select("file", "node", *(F.col(c).alias(f"{side}_{c}") for c in t.columns if c not in ("file", "node"))) for side, t in (("e", left[level]), ("f", right[level]))]
        if wanted is not None:
            same = level + 1 < top and (left[level] is left[level + 1] or right[level] is right[level + 1])
            parent = F.lit(0) if same else F.expr(f"node div {FANOUT}")
            down = wanted.withColumnRenamed("node", "parent")
            own = [o.withColumn("parent", parent.cast("long")).join(down, ["file", "parent"], "left_semi").drop("parent") for o in own]
        both = own[0].join(own[1], ["file", "node"], "full")
        differs = ~(F.col("e_hash").eqNullSafe(F.col("f_hash")) & F.col("e_first").eqNullSafe(F.col("f_first")) & F.col("e_last").eqNullSafe(F.col("f_last")))
        both = both.where(differs)
        if level:
            wanted = written(both.select("file", "node"), "differing")
    return both.select(
        "file",
        F.coalesce("e_first", "f_first").alias("first"),
        F.coalesce("e_last", "f_last").alias("last"),
        F.coalesce("e_id", "f_id").alias("id"),
        F.coalesce("e_url", "f_url").alias("url"),
        F.lower(F.hex("e_hash")).alias("expected_hash"),
        F.lower(F.hex("f_hash")).alias("found_hash"),
    )


def archive(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """WARC files of ``pages(id, url, html)`` as pieces (file, offset, data), written to the shared folder.

    Every page becomes a record (null url and html: empty; a null id: none), placed in files
    in the order of the rows of a partition, after which the files are named.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, offset, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        for batch in batches:
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and (size >= PIECE_BYTES or seen % FILE_RECORDS == 0):
                    yield piece(part, seen - 1, offset, held)
                    offset, held, size = offset + size, [], 0
                if seen % FILE_RECORDS == 0:
                    offset = 0
                held.append(record(url, (html or "").encode(), page))
                size += len(held[-1])
                seen += 1
        if held:
            yield piece(part, seen - 1, offset, held)

    def piece(part: int, last: int, offset: int, held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{last // FILE_RECORDS:06d}.warc"]), pa.array([offset]), pa.array([b"".join(held)], pa.binary())], ["file", "offset", "data"])

    made = pages.select(F.col(id_col).cast("long"), "url", "html").mapInArrow(run, "file string, offset long, data binary")
    return written(made, "replica", "zstd")


def damaged(pieces: DataFrame) -> DataFrame:
    """A second replica of an :func:`archive`, with planted bit rot, written to the shared folder.

    Of every page whose id is divisible by 101 the last byte of content is flipped; of every
    one with the remainder 50 that byte is lost and a zero byte stands behind the record's
    content. Empty pages stay as they are.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(2).to_pylist():
                rotten = bytearray(data)
                for at, length, head, body in read_records(data):
                    page, last = head.get("page-id"), at + length - 5
                    if page is None or not body or int(page) % 101 not in (0, 50):
                        continue
                    if int(page) % 101 == 0:
                        rotten[last] ^= 1
                    else:
                        rotten[last] = 0
                out.append(bytes(rotten))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["file", "offset", "data"])

    return written(pieces.mapInArrow(run, "file string, offset long, data binary"), "replica", "zstd")


def audit_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, n_bytes, expected_sha256, found_sha256): the records of ``pages`` that planted bit rot has changed.

    Both replicas are written as WARC bytes and read again, each on its own. Null ids are
    never damaged; repeated rows give repeated results; an empty table, or one without
    damage, gives none; other columns are not read.
    """
    first = archive(pages)
    second = damaged(first)
    out = written(audit(leaves(scan(first)), leaves(scan(second))), "audit")
    dropped(first, second)
    return out.select(F.col("id").alias("page_id"), F.when(F.col("url") != "", F.col("url")).alias("url"), (F.col("last") - F.col("first")).alias("n_bytes"), F.col("expected_hash").alias("expected_sha256"), F.col("found_hash").alias("found_sha256"))
