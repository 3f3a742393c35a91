"""NetCDF classic files (CDF-1, -2 and -5), after the published format: header, data, byte ranges."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from math import prod
from typing import Any

import numpy as np

# The format's type codes.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6, "u1": 7, "u2": 8, "u4": 9, "i8": 10, "u8": 11}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12

#: Bytes first read for a header, which is read again fourfold while it goes on.
HEAD_BYTES = 1 << 16
#: Records are read in one stretch if it is at most this many times what is wanted of it.
STRETCH = 4


@dataclass
class Variable:
    name: str
    dims: tuple[str, ...]
    dtype: str
    shape: tuple[int, ...]
    attrs: dict[str, Any]
    begin: int
    size: int
    record: bool


@dataclass
class Header:
    dims: dict[str, int]
    attrs: dict[str, Any]
    variables: dict[str, Variable]
    record_dim: str | None = None
    records: int = 0
    record_size: int = 0
    used: int = field(default=0, repr=False)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.version = data, 4, data[3]

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise EOFError("the header goes on")
        self.at += n
        return out

    def int4(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def count(self) -> int:
        return struct.unpack(">q", self.take(8))[0] if self.version == 5 else self.int4()

    def offset(self) -> int:
        return self.int4() if self.version == 1 else struct.unpack(">q", self.take(8))[0]

    def padded(self, n: int) -> bytes:
        return self.take(n + (-n) % 4)[:n]

    def name(self) -> str:
        return self.padded(self.count()).decode()

    def entries(self, tag: int) -> int:
        found, n = self.int4(), self.count()
        if found not in (0, tag) or (not found and n):
            raise ValueError("this isn't a NetCDF classic header")
        return n

    def attributes(self) -> dict[str, Any]:
        out = {}
        for _ in range(self.entries(ATTRIBUTE)):
            name, code, n = self.name(), self.int4(), self.count()
            kind = np.dtype(TYPES[code])
            raw = self.padded(n * kind.itemsize)
            if code == 2:
                out[name] = raw.decode("utf-8", "replace")
            else:
                values = np.frombuffer(raw, kind).tolist()
                out[name] = values[0] if len(values) == 1 else values
        return out


def read_header(data: bytes) -> Header:
    """The header at the start of ``data``; EOFError if it is longer."""
    if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
        raise ValueError("this isn't a NetCDF classic file")
    r = _Reader(data)
    records = r.count()
    dims: dict[str, int] = {}
    record_dim = None
    for _ in range(r.entries(DIMENSION)):
        name, size = r.name(), r.count()
        dims[name] = size
        if not size:
            record_dim = name
            dims[name] = max(records, 0)
    names = list(dims)
    attrs = r.attributes()
    variables = {}
    for _ in range(r.entries(VARIABLE)):
        name = r.name()
        own = tuple(names[r.count()] for _ in range(r.count()))
        own_attrs, code, size, begin = r.attributes(), r.int4(), r.count(), r.offset()
        is_record = bool(own) and own[0] == record_dim
        variables[name] = Variable(name, own, TYPES[code], tuple(dims[d] for d in own), own_attrs, begin, size, is_record)
    record_vars = [v for v in variables.values() if v.record]
    for v in variables.values():  # the stored size may have overflowed
        row = prod(v.shape[1:]) if v.record else prod(v.shape)
        v.size = row * np.dtype(v.dtype).itemsize
    step = sum(v.size + (-v.size) % 4 for v in record_vars)
    if len(record_vars) == 1:
        step = record_vars[0].size
    return Header(dims, attrs, variables, record_dim, max(records, 0), step, r.at)


def open_header(file) -> Header:
    """The header of an open file, by ranges from its start, whatever else the file holds."""
    n, size = HEAD_BYTES, file.size()
    while True:
        try:
            return read_header(file.read_at(min(n, size), 0))
        except EOFError:
            if n >= size:
                raise
            n *= 4


def read_flat(file, header: Header, name: str, lo: int, hi: int) -> np.ndarray:
    """Cells ``lo`` to ``hi`` of a variable in C order, from the byte ranges that hold them; a file that ends before is an error."""
    v = header.variables[name]
    kind = np.dtype(v.dtype)
    if not v.record:
        return np.frombuffer(file.read_at((hi - lo) * kind.itemsize, v.begin + lo * kind.itemsize), kind, hi - lo)
    row = prod(v.shape[1:])
    if hi <= lo or not row:
        return np.zeros(0, kind)
    first, last, step = lo // row, -(-hi // row), header.record_size
    if step <= STRETCH * v.size:
        raw = file.read_at((last - first - 1) * step + v.size, v.begin + first * step)
        flat = np.ndarray((last - first, row), kind, raw, strides=(step, kind.itemsize)).ravel()
    else:
        flat = np.concatenate([np.frombuffer(file.read_at(v.size, v.begin + i * step), kind, row) for i in range(first, last)])
    return flat[lo - first * row : hi - first * row]


def read_variable(data: bytes, header: Header, name: str) -> np.ndarray:
    v = header.variables[name]
    kind = np.dtype(v.dtype)
    if not v.record:
        return np.frombuffer(data, kind, prod(v.shape), v.begin).reshape(v.shape)
    rows = [np.frombuffer(data, kind, prod(v.shape[1:]), v.begin + i * header.record_size) for i in range(header.records)]
    return np.stack(rows).reshape(v.shape) if rows else np.zeros(v.shape, kind)


def byte_ranges(header: Header, name: str) -> list[tuple[tuple[int, ...], int, int]]:
    """(chunk index, offset, length): the whole variable, or one range for each record."""
    v = header.variables[name]
    if not v.record:
        return [((0,) * len(v.dims), v.begin, v.size)]
    rest = (0,) * (len(v.dims) - 1)
    return [((i, *rest), v.begin + i * header.record_size, v.size) for i in range(header.records)]


def write(dims: dict[str, int], variables: dict[str, tuple[tuple[str, ...], np.ndarray, dict[str, Any]]], attrs: dict[str, Any] | None = None, record_dim: str | None = None) -> bytes:
    """A CDF-2 file with these variables: (dims, values, attributes) by name."""

    def named(text: str) -> bytes:
        raw = text.encode()
        return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)

    def attributes(values: dict[str, Any]) -> bytes:
        if not values:
            return struct.pack(">ii", 0, 0)
        out = struct.pack(">ii", ATTRIBUTE, len(values))
        for name, value in values.items():
            if isinstance(value, str):
                raw, code, n = value.encode(), 2, len(value.encode())
            else:
                a = np.atleast_1d(np.asarray(value))
                a = a.astype("i4") if a.dtype == np.int64 else a
                code, n, raw = CODES[a.dtype.str[1:]], a.size, a.astype(a.dtype.newbyteorder(">")).tobytes()
            out += named(name) + struct.pack(">ii", code, n) + raw + b"\0" * (-len(raw) % 4)
        return out

    arrays = {}
    for name, (own, values, own_attrs) in variables.items():
        a = np.asarray(values)
        a = a.astype("i4") if a.dtype in (np.dtype("i8"), np.dtype("bool")) else a
        arrays[name] = (own, a, own_attrs, bool(own) and own[0] == record_dim)
    order = list(dims)
    head = struct.pack(">i", dims[record_dim] if record_dim else 0)
    head += struct.pack(">ii", DIMENSION, len(dims)) if dims else struct.pack(">ii", 0, 0)
    for name, size in dims.items():
        head += named(name) + struct.pack(">i", 0 if name == record_dim else size)
    head += attributes(attrs or {})
    head += struct.pack(">ii", VARIABLE, len(arrays)) if arrays else struct.pack(">ii", 0, 0)
    pad = lambda n: n + (-n) % 4
    size_of = lambda a, record: (a[0:1].size if record else a.size) * a.dtype.itemsize
    heads = []
    for name, (own, a, own_attrs, record) in arrays.items():
        heads.append(named(name) + struct.pack(">i", len(own)) + b"".join(struct.pack(">i", order.index(d)) for d in own) + attributes(own_attrs) + struct.pack(">ii", CODES[a.dtype.str[1:]], pad(size_of(a, record))))
    begin = 4 + len(head) + sum(len(h) + 8 for h in heads)
    body, records = b"", []
    for h, (name, (own, a, _, record)) in zip(heads, arrays.items()):
        if not record:
            head += h + struct.pack(">q", begin + len(body))
            raw = a.astype(a.dtype.newbyteorder(">")).tobytes()
            body += raw + b"\0" * (-len(raw) % 4)
        else:
            records.append(name)
            head += h + b"\xff" * 8  # set below
    only = len(records) == 1
    at = begin + len(body)
    for name in records:
        head = head.replace(b"\xff" * 8, struct.pack(">q", at), 1)
        at += size_of(arrays[name][1], True) if only else pad(size_of(arrays[name][1], True))
    for i in range(dims[record_dim] if record_dim else 0):
        for name in records:
            raw = np.asarray(arrays[name][1][i]).astype(arrays[name][1].dtype.newbyteorder(">")).tobytes()
            body += raw + (b"" if only else b"\0" * (-len(raw) % 4))
    return b"CDF\x02" + head + body
