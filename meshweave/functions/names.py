"""Names of inputs: cache entries, schemes, secrets in query strings."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Mapping
from urllib.parse import parse_qs, urlencode, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest file name of common local file systems.
NAME_BYTES = 255


def slug(text: str) -> str:
    """``text`` in ASCII letters, digits, dots, underscores and single hyphens."""
    ascii_ = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[\s-]+", "-", re.sub(r"[^\w\s.-]+", "_", ascii_)).strip("-_")


def cache_name(path: str, limit: int | None = NAME_BYTES) -> str:
    """Name of a path's copy in a flat cache: its md5, and its slug, cut at the front so that the extension stays."""
    digest, tail = hashlib.md5(path.encode()).hexdigest(), slug(path)
    room = None if limit is None else limit - len(digest) - 1
    return f"{digest}-{tail if room is None or len(tail) <= room else tail[-room:]}"


def cache_name_of(path: Column, limit: int = NAME_BYTES) -> Column:
    """:func:`cache_name` of a column, with built-in functions; accents are decomposed as the driver's function does it."""
    plain = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), path, F.lit(True))
    tail = F.lower(F.regexp_replace(plain, r"[^\x00-\x7F]", ""))
    tail = F.regexp_replace(F.regexp_replace(tail, r"[^\w\s.\-]+", "_"), r"[\s\-]+", "-")
    tail = F.regexp_replace(tail, r"^[-_]+|[-_]+$", "")
    return F.concat(F.md5(F.encode(path, "utf-8")), F.lit("-"), F.right(tail, F.lit(limit - 33)))


def with_scheme(url: Column, scheme: str) -> Column:
    """The url, under ``scheme`` if it has none."""
    return F.when(url.contains("://"), url).otherwise(F.concat(F.lit(scheme + "://"), url))


def with_secrets(url: str, secrets: Mapping[str, str] | None) -> str:
    """The url with ``secrets`` in its query; they replace parameters of the same name. Only ever called where a file is opened."""
    if not secrets:
        return url
    parts = urlsplit(url)
    query = parse_qs(parts.query) | {k: [v] for k, v in secrets.items()}
    return urlunsplit(parts._replace(query=urlencode(query, doseq=True)))
