"""Places for stores and caches: any file system that Arrow or a plain path reaches; inputs also over http(s)."""

from __future__ import annotations

import uuid
from base64 import b64encode
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace
from urllib.error import HTTPError
from urllib.parse import urlsplit
from urllib.request import Request, urlopen

import pyarrow as pa
from pyarrow import fs as arrow_fs

from ..functions.names import NAME_BYTES, cache_name, with_secrets

#: Bytes copied at once.
COPY_BYTES = 10_000_000
#: Seconds until a silent http server is an error, which the task's repeat meets again.
HTTP_TIMEOUT = 60


class WebFile:
    """An http(s) resource by byte ranges; one whose server ignores ranges is held whole.

    ``auth`` is (user, password) of basic authentication. It isn't sent on to where a server
    redirects, and it is in no error's text.
    """

    def __init__(self, url: str, auth: tuple[str, str] | None = None):
        self.url, self.auth, self.at = url, auth, 0
        self.whole: bytes | None = None
        self.length = 0
        self._get(0, 1)

    def _get(self, offset: int, length: int) -> bytes:
        request = Request(self.url, headers={"Range": f"bytes={offset}-{offset + length - 1}"})
        if self.auth:
            request.add_unredirected_header("Authorization", "Basic " + b64encode(":".join(self.auth).encode()).decode())
        try:
            with urlopen(request, timeout=HTTP_TIMEOUT) as answer:
                told = answer.headers.get("Content-Range", "").rpartition("/")[2]
                if answer.status == 206 and told.isdigit():
                    self.length = int(told)
                    return answer.read()
                if answer.status == 206:
                    raise ValueError("the server gives a range without the whole size")
                self.whole = answer.read()
        except HTTPError as error:
            if error.code != 416 or offset:
                raise
            self.whole = b""  # an empty resource has no first byte
        self.length = len(self.whole)
        return self.whole[offset : offset + length]

    def __enter__(self) -> WebFile:
        return self

    def __exit__(self, *_) -> None:
        self.whole = None

    def size(self) -> int:
        return self.length

    def read_at(self, length: int, offset: int) -> bytes:
        length = min(length, self.length - offset)
        if length <= 0:
            return b""
        return self.whole[offset : offset + length] if self.whole is not None else self._get(offset, length)

    def read(self, length: int | None = None) -> bytes:
        out = self.read_at(self.length if length is None else length, self.at)
        self.at += len(out)
        return out


def opened(url: str, secrets: Mapping[str, str] | None = None, auth: tuple[str, str] | None = None):
    """A file to read by ranges (``read_at``, ``read``, ``size``): http(s), any other scheme that Arrow knows, or a path."""
    source = with_secrets(url, secrets)
    if urlsplit(source).scheme in ("http", "https"):
        return WebFile(source, auth)
    fs, path = arrow_fs.FileSystem.from_uri(source) if "://" in source else (arrow_fs.LocalFileSystem(), source)
    return fs.open_input_file(path)


class RequiredAtRuntime:
    """Stands for a target root that the deployment has to fill in."""

    def __truediv__(self, name: str):
        raise TypeError("unsupported operand: target_root must be given before a store can be written")


@dataclass(frozen=True)
class Target:
    """A folder under a root url or path. Files are written whole under another name and then renamed, so a repeated task does no harm."""

    root: str

    @classmethod
    def from_url(cls, url: str) -> Target:
        return cls(url)

    def __truediv__(self, name: str) -> Target:
        return replace(self, root=f"{self.root.rstrip('/')}/{name}")

    @property
    def protocol(self) -> str:
        return urlsplit(self.root).scheme or "file"

    def _open(self) -> tuple[arrow_fs.FileSystem, str]:
        if "://" in self.root:
            return arrow_fs.FileSystem.from_uri(self.root)
        return arrow_fs.LocalFileSystem(), self.root

    def _at(self, path: str) -> tuple[arrow_fs.FileSystem, str]:
        fs, root = self._open()
        return fs, f"{root.rstrip('/')}/{self.name_of(path)}" if path else root

    def name_of(self, path: str) -> str:
        return path

    def exists(self, path: str = "") -> bool:
        fs, at = self._at(path)
        return fs.get_file_info(at).type != arrow_fs.FileType.NotFound

    def size(self, path: str) -> int:
        fs, at = self._at(path)
        info = fs.get_file_info(at)
        if info.type != arrow_fs.FileType.File:
            raise FileNotFoundError(path)
        return info.size

    def rm(self, path: str = "", recursive: bool = False) -> None:
        fs, at = self._at(path)
        if fs.get_file_info(at).type == arrow_fs.FileType.Directory:
            if not recursive:
                raise IsADirectoryError(path)
            fs.delete_dir(at)
        else:
            fs.delete_file(at)

    def makedir(self, path: str = "") -> None:
        fs, at = self._at(path)
        fs.create_dir(at, recursive=True)

    def open(self, path: str) -> pa.NativeFile:
        fs, at = self._at(path)
        return fs.open_input_file(at)

    def read(self, path: str, offset: int = 0, length: int | None = None) -> bytes:
        with self.open(path) as f:
            return f.read_at(f.size() - offset if length is None else length, offset)

    def write(self, path: str, data: bytes) -> None:
        fs, at = self._at(path)
        parent = at.rpartition("/")[0]
        fs.create_dir(parent, recursive=True)
        draft = f"{at}.{uuid.uuid4().hex}.part"
        with fs.open_output_stream(draft) as f:
            f.write(data)
        fs.move(draft, at)

    def files(self, path: str = "") -> Iterator[tuple[str, int]]:
        """(path under this folder, size) of every file."""
        fs, at = self._at(path)
        base = self._open()[1].rstrip("/") + "/"
        for info in fs.get_file_info(arrow_fs.FileSelector(at, recursive=True, allow_not_found=True)):
            if info.type == arrow_fs.FileType.File:
                yield info.path.removeprefix(base), info.size


@dataclass(frozen=True)
class FlatCache(Target):
    """A cache in one folder: every path becomes one file name."""

    name_bytes: int | None = field(default=NAME_BYTES)

    def name_of(self, path: str) -> str:
        return cache_name(path, self.name_bytes if self.protocol == "file" else None)

    def fill(self, url: str, secrets: Mapping[str, str] | None = None, auth: tuple[str, str] | None = None) -> bool:
        """Copy ``url`` into the cache unless an entry of its size is there; whether it was copied.

        Only the size is compared, so a source that changes and keeps its size isn't seen.
        """
        with opened(url, secrets, auth) as f:
            if self.exists(url) and self.size(url) == f.size():
                return False
            own, at = self._at(url)
            own.create_dir(at.rpartition("/")[0], recursive=True)
            draft = f"{at[: -len('.part')] if len(at) > NAME_BYTES else at}.part"
            with own.open_output_stream(draft) as out:
                while block := f.read(COPY_BYTES):
                    out.write(block)
            own.move(draft, at)
        return True
