"""Token counts of whole texts: lengths only, batches balanced by bytes, long texts cut at safe boundaries."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text that one call of the library gets, and the length from which a text is cut.
BATCH_BYTES, LONG_BYTES = 1 << 20, 1 << 16

#: Where byte-level pre-tokens end whatever stands around: before a single blank or newline
#: between other characters, as the run before it ends there and a run after it begins with
#: it or behind it; and between an ASCII letter and a digit, which never share a run.
SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def cut_rule(path: str) -> re.Pattern | None:
    """The places at which a text may be cut for the tokenizer file at ``path``; None if it must stay whole.

    :data:`SAFE` holds for byte-level pre-tokens by the usual pattern, without a normaliser
    or an added blank, if no added token has such a place or takes white space around it.
    """
    with open(path, encoding="utf-8") as file:
        settings = json.load(file)
    before = settings.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not settings.get("normalizer") and not settings.get("post_processor")
    if not plain or (settings.get("model") or {}).get("type") != "BPE":
        return None
    for token in settings.get("added_tokens") or ():
        if token.get("lstrip") or token.get("rstrip") or token.get("single_word") or re.search(r"\s", token["content"]) or SAFE.search(token["content"]):
            return None
    return SAFE


def safe_pieces(text: str, rule: re.Pattern | None, size: int = LONG_BYTES) -> list[str]:
    """``text`` in pieces of about ``size`` characters whose token counts add up to its own.

    Cuts are only made where ``rule`` allows it; a stretch without such a place stays whole.
    """
    out, start = [], 0
    while rule is not None and len(text) - start > size:
        cut = rule.search(text, start + size)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found, cut_rule(path)


def balanced(pieces: Iterable[tuple[int, str, int]], size: int) -> Iterator[list[tuple[int, str, int]]]:
    """Batches of (owner, piece, bytes) in order, each closed as soon as it holds ``size`` bytes."""
    batch, held = [], 0
    for piece in pieces:
        batch.append(piece)
        held += piece[2]
        if held >= size:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def lengths(texts: list[str | None], path: str) -> tuple[list[int], list[int]]:
    """UTF-8 bytes and tokens of each text (None: 0, 0), without added special tokens."""
    tokenizer, rule = _tokenizer(path)
    n_bytes, n_tokens = [0] * len(texts), [0] * len(texts)

    def pieces() -> Iterator[tuple[int, str, int]]:
        for owner, text in enumerate(texts):
            if text:
                for piece in safe_pieces(text, rule):
                    yield owner, piece, len(piece) if piece.isascii() else len(piece.encode())

    for batch in balanced(pieces(), BATCH_BYTES):
        found = tokenizer.encode_batch_fast([piece for _, piece, _ in batch], add_special_tokens=False)
        for (owner, _, size), encoding in zip(batch, found):
            n_bytes[owner] += size
            n_tokens[owner] += len(encoding)
    return n_bytes, n_tokens


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``df``, in one pass without a shuffle.

    Null and empty texts have 0 bytes and 0 tokens; null ids stay null; repeated rows give
    repeated results; an empty table gives none; other columns are not read, whatever their
    names. ``path`` is any file of the ``tokenizers`` library: texts are cut only where the
    file's own settings make it safe (:func:`cut_rule`), and otherwise stay whole at any
    length, as the library needs them. Special strings inside texts are handled as the
    library does by default.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, tokens = lengths(batch.column(1).to_pylist(), path)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return df.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
