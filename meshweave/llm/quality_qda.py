"""Document quality by a regularised quadratic discriminant.

Each text becomes a row of transformed statistics. The labelled rows give, by built-in
aggregation, every class's count, sums and sums of products; shrinkage keeps the class
covariances regular; a text's score is the logistic of the difference between the
classes' log-densities, each a Mahalanobis distance by a Cholesky factor made once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ("length", "letters", "capitals", "symbols", "marks", "digits", "blanks", "word_length", "repeated_next", "repeated_lines")
# The characters that a class of marks holds.
_CLASS = np.zeros(256, np.int64)
for _name, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*+=@^~<>{}[]\\_`|", b"!?", b"0123456789", b" \t\n\r\x0b\x0c"), 1):
    _CLASS[list(_chars)] = _name
_CLASS[128:] = 7  # bytes of other letters
_TABLE = bytes(_CLASS.astype(np.uint8))


def _log_odds(part: float, whole: float) -> float:
    """Of a share, with a twentieth of the whole and half a case more on either side, so a single mark in a short text doesn't dominate."""
    return math.log((part + 0.05 * whole + 0.5) / (whole - part + 0.05 * whole + 0.5)) if whole >= part else 0.0


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; an empty or null text has those of no characters."""
    raw = (text or "").encode()
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw.translate(_TABLE), np.uint8), minlength=8).tolist()
    words = raw.lower().split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same_next = sum(map(bytes.__eq__, words, words[1:]))
    letters = counts[1] + counts[2] + counts[7]
    return [
        math.log1p(n),
        _log_odds(letters, n),
        _log_odds(counts[2], counts[1] + counts[2]),
        _log_odds(counts[3], n),
        _log_odds(counts[4], n),
        _log_odds(counts[5], n),
        _log_odds(counts[6], n),
        math.log1p((n - counts[6]) / (len(words) or 1)),
        _log_odds(same_next, len(words)),
        _log_odds(len(lines) - len(set(lines)), len(lines)),
    ]


def with_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f: array of statistics) for every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], [id_col, "f"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, f array<double>")


@dataclass(frozen=True)
class Discriminant:
    """A mean, an inverse Cholesky factor, and a constant for each class."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        density = [c - 0.5 * (((rows - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -50, 50)))


def fit(labelled: DataFrame, shrinkage: float = 0.5, ridge: float = 1e-3) -> Discriminant:
    """From ``labelled(f array<double>, label int)``, all of its rows, in one aggregation.

    Class covariances are drawn to the pooled one by ``shrinkage``, and to its diagonal's
    mean by ``ridge``; a class without rows takes the pooled covariance and an equal prior,
    so the scores of an unlabelled corpus are all 0.5.
    """
    d = len(FEATURES)
    x = [F.col("f")[i] for i in range(d)]
    moments: list[Column] = [F.avg(c).alias(f"m{i}") for i, c in enumerate(x)]  # centred as they go, so large counts lose no digits
    moments += [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    found = {r["label"]: r for r in labelled.where("label in (0, 1)").groupBy("label").agg(F.count("*").alias("n"), *moments).collect()}
    n, means, scatter = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for k, r in found.items():
        n[k] = r["n"]
        means[k] = [r[f"m{i}"] for i in range(d)]
        for i in range(d):
            for j in range(i, d):
                scatter[k, i, j] = scatter[k, j, i] = r["n"] * r[f"c{i}_{j}"]
    if not n.all():
        means[:] = means[int(n.argmax())]
        n[:] = max(n.sum(), 1) / 2
        scatter[:] = scatter.sum(0) / 2
    pooled = scatter.sum(0) / n.sum()
    level = max(np.trace(pooled) / d, 1e-6)
    factors, constants = [], []
    for k in range(2):
        c = (1 - shrinkage) * scatter[k] / n[k] + shrinkage * pooled + ridge * level * np.eye(d)
        factor = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(factor))
        constants.append(math.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(factors), np.array(constants))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document's label is kept from the fit: crc32 of its id as text, mod 5, is 0 (null ids: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """The discriminant of ``rows(doc_id, f)`` whose ``labels(doc_id, quality)`` are not held out.

    A document with differing labels counts as the greatest; null labels and ids count as none.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    return fit(rows.where(~held_out()).join(known, "doc_id").select("f", "label"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` that score at least ``threshold``, with all their columns.

    The statistics are taken twice, once for the fit and once beside the text, which so
    needs no shuffle. Nulls, repeated rows and empty tables are as for :func:`classify`.
    """
    model = learned(with_statistics(docs), labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = model.scores(np.array([statistics(t.as_py()) for t in batch.column(at)]))
                yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text)``.

    ``labels(doc_id, quality)`` are learnt from where they are not held out; a document
    with differing labels counts as the greatest, null labels as none. Null and empty texts
    are scored like any other; rows with null ids are scored and never learnt from. Repeated
    rows give repeated results; an empty table gives none. Other columns are not read.
    """
    from .common import written

    rows = written(with_statistics(docs), "statistics")
    model = learned(rows, labels)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(2)
            scores = model.scores(np.asarray(f.flatten()).reshape(len(f), -1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", held_out().alias("held_out"), "f").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
