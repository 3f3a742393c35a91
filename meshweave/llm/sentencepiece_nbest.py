"""SentencePiece encoding and decoding: the n best segmentations of whole texts.

A text's piece lattice falls apart wherever no piece of the vocabulary can hold two
characters that meet; what lies between such places is a segment. In a segment's lattice
the forward Viterbi scores are exact heuristics for an A-star search from its end back to
its start, which gives its segmentations from the best one down. The text's best are
combined from its segments': only the n - 1 segments with the smallest loss from their
best to their second one can differ among the n best.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Segments that a worker remembers, and the longest of them in characters.
KNOWN, KNOWN_CHARS = 600_000, 48
#: A character without a piece costs so much more than the worst piece (the library's value).
UNKNOWN_PENALTY = 10.0

Path = tuple[float, tuple[int, ...]]


class Lattice:
    """A model's pieces and what follows from them."""

    def __init__(self, pieces: Sequence[tuple[str, int, float]], byte_ids: dict[int, int], unknown: int, prefix: bool = True):
        """``pieces``: (text with U+2581 for a blank, id, score); ``byte_ids``: id of each byte's piece, or none."""
        self.scores = {text: (i, score) for text, i, score in pieces}
        self.byte_ids, self.unknown, self.prefix = byte_ids, unknown, prefix
        self.longest = max((len(t) for t in self.scores), default=1)
        self.unknown_score = min((s for _, s in self.scores.values()), default=0.0) - UNKNOWN_PENALTY
        chars = sorted({c for t in self.scores if len(t) > 1 for c in t})
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.kinds = len(chars) + 1
        self.parted = np.ones(self.kinds * self.kinds, bool)
        at = {c: i for i, c in enumerate(chars, 1)}
        for t in self.scores:
            for a, b in zip(t, t[1:]):
                self.parted[at[a] * self.kinds + at[b]] = False
        # A piece, or with None only the start of one.
        self.starts: dict[str, tuple[int, float] | None] = {t[:k]: None for t in self.scores for k in range(1, len(t))} | self.scores
        self.bytes = {i: t.replace(SPACE, " ").encode() for t, (i, _) in self.scores.items()} | {i: bytes([b]) for b, i in byte_ids.items()}
        texts = [self.bytes.get(i, b"") for i in range(max(self.bytes, default=-1) + 1)]
        self.byte_pool = np.frombuffer(b"".join(texts), np.uint8)
        self.byte_sizes = np.array([len(t) for t in texts], np.int64)
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.known: dict[str, int] = {}
        self.close: dict[tuple[str, int], list[Path]] = {}
        self._forget()

    @classmethod
    def load(cls, path: str) -> Lattice:
        """The lattice of a SentencePiece file. Texts are normalised by the library as the file says."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in every if model.is_byte(i)}
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        probe = model.normalize("a")
        if probe not in ("a", SPACE + "a", "A", SPACE + "A"):
            raise ValueError("a model that marks the ends of words isn't supported")
        out = cls([(model.id_to_piece(i), i, model.get_score(i)) for i in plain], byte_ids, model.unk_id(), probe[0] == SPACE)
        out.normalised = model.normalize
        return out

    def _forget(self) -> None:
        """Of each known segment: score, loss to the second best, and where its ids lie in the pool."""
        self.known.clear()
        self.score, self.loss = np.zeros(1024), np.zeros(1024)
        self.first, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.pooled = np.zeros(8192, np.int32), 0

    def normalised(self, text: str) -> str:
        """Blanks as pieces have them; a loaded model replaces this by the library's own normaliser."""
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def segments(self, text: str) -> list[str]:
        """The parts of a normalised text between which no piece can lie."""
        kinds = self.kind.take(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
        cuts = (np.flatnonzero(self.parted.take(kinds[:-1] * self.kinds + kinds[1:])) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])] if text else []

    def arcs(self, text: str) -> tuple[list[list[tuple[int, tuple[int, ...], float]]], list[float]]:
        """For each end: (start, ids, score) of the pieces that end there; and the best score from the start to each place."""
        n, starts, out = len(text), self.starts, [[] for _ in range(len(text) + 1)]
        forward = [0.0] + [-np.inf] * n
        for i in range(n):
            here, single = forward[i], False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                found = starts.get(text[i:j], False)
                if found:
                    out[j].append((i, (found[0],), found[1]))
                    if here + found[1] > forward[j]:
                        forward[j] = here + found[1]
                    single = single or j == i + 1
                elif found is False:
                    break
            if not single:
                ids = tuple(self.byte_ids[b] for b in text[i].encode("utf-8", "surrogatepass")) if self.byte_ids else (self.unknown,)
                out[i + 1].append((i, ids, self.unknown_score))
                forward[i + 1] = max(forward[i + 1], here + self.unknown_score)
        return out, forward

    def best_known(self, segment: str, n: int) -> list[Path]:
        """:meth:`best`, remembered for the segments that have close seconds again and again."""
        found = self.close.get((segment, n))
        if found is None:
            found = self.best(segment, n)
            if len(segment) <= KNOWN_CHARS:
                if len(self.close) >= KNOWN // 20:
                    self.close.clear()
                self.close[segment, n] = found
        return found

    def first_two(self, text: str) -> tuple[float, float, tuple[int, ...]]:
        """The best segmentation's score, its lead over the second one (infinite if it is alone), and its ids.

        The second one holds a piece that the best one doesn't: the lead is the least that
        any such piece costs between the best ways to its start and on from its end.
        """
        arcs, forward = self.arcs(text)
        n = len(text)
        backward = [-np.inf] * n + [0.0]
        lead, best, ids, at = np.inf, forward[n], (), n
        for end in range(n, 0, -1):
            on = backward[end]
            chosen = at == end
            for start, own, score in arcs[end]:
                if on + score > backward[start]:
                    backward[start] = on + score
                if chosen and forward[start] + score == forward[end]:
                    chosen, at, ids = False, start, own + ids
                elif best - forward[start] - score - on < lead:
                    lead = best - forward[start] - score - on
        return best, lead, ids

    def best(self, text: str, n: int) -> list[Path]:
        """The ``n`` best segmentations (fewer if there aren't as many), each a score and ids.

        Equal scores come in the order in which the search completes them, the one
        furthest back first; it depends on nothing but the text and the model.
        """
        arcs, forward = self.arcs(text)
        out: list[Path] = []
        made = 0
        # (estimate of the whole, place, age, score from the end back to the place, ids and what follows them)
        agenda: list = [(-forward[len(text)], len(text), 0, 0.0, None)]
        while agenda and len(out) < n:
            _, place, _, score, tail = heapq.heappop(agenda)
            if not place:
                ids: list[int] = []
                while tail is not None:
                    ids += tail[0]
                    tail = tail[1]
                out.append((score, tuple(ids)))
                continue
            for start, ids, gain in arcs[place]:
                made += 1
                total = score + gain
                heapq.heappush(agenda, (-(total + forward[start]), start, made, total, (ids, tail)))
        return out

    def _learn(self, segment: str) -> None:
        score, lead, ids = self.first_two(segment)
        at = len(self.known)
        if at == len(self.score):
            for name in ("score", "loss", "first", "size"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        while self.pooled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.pooled : self.pooled + len(ids)] = ids
        self.score[at], self.loss[at], self.first[at], self.size[at] = score, lead, self.pooled, len(ids)
        self.pooled += len(ids)
        self.known[segment] = at

    def encode(self, text: str, n: int) -> tuple[np.ndarray, list[float], list[list[tuple[int, int, tuple[int, ...]]]]]:
        """Ids of the best segmentation, the scores of the ``n`` best, and each one's differences from the best: (from, to, ids)."""
        parts = self.segments(self.normalised(text))
        if not parts:
            return np.zeros(0, np.int32), [0.0], [[]]
        known = self.known
        if len(known) + len(parts) > KNOWN and known:
            self._forget()
        try:
            which = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
        except KeyError:
            for p in parts:
                if p not in known:
                    self._learn(p)
            which = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
        sizes, losses = self.size[which], self.loss[which]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.first[which] - ends + sizes, sizes) + np.arange(ends[-1])]
        close = np.flatnonzero(losses < np.inf)
        if len(close) > n - 1 > 0:
            limit = np.partition(losses[close], n - 2)[n - 2]
            close = np.r_[close[losses[close] < limit], close[losses[close] == limit]][: n - 1]
            close.sort()
        combined: list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]] = [(float(self.score[which].sum()), [])]
        for at in close.tolist() if n > 1 else ():
            options = list(self.best_known(parts[at], n))
            begin, end = int(ends[at] - sizes[at]), int(ends[at])
            own = tuple(ids[begin:end].tolist())
            options.sort(key=lambda o: (-o[0], o[1] != own))  # of equal ones the chosen one stays
            combined = sorted(
                ((score - options[0][0] + s, changes + ([(begin, end, other)] if k else [])) for score, changes in combined for k, (s, other) in enumerate(options)),
                key=lambda c: -c[0],
            )[:n]
        if self.pooled > 16 * KNOWN:  # by long segments
            self._forget()
        return ids, [c[0] for c in combined], [c[1] for c in combined]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of a segmentation; bytes that make no character become U+FFFD."""
        if not isinstance(ids, np.ndarray):
            ids = np.array([i for i in ids if i is not None], np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.byte_sizes)):
            ids = ids[(ids >= 0) & (ids < len(self.byte_sizes))]
        sizes = self.byte_sizes[ids]
        ends = np.cumsum(sizes)
        raw = self.byte_pool[np.repeat(self.byte_starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        text = raw.tobytes().decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text

    def same_bytes(self, ids: np.ndarray, changes: list[tuple[int, int, tuple[int, ...]]]) -> bool:
        """Whether every change of :meth:`encode` has the bytes of what it replaces."""
        raw = lambda some: b"".join(self.byte_pool[self.byte_starts[i] : self.byte_starts[i] + self.byte_sizes[i]].tobytes() for i in some)
        return all(raw(ids[begin:end].tolist()) == raw(other) for begin, end, other in changes)


def changed(ids: np.ndarray, changes: list[tuple[int, int, tuple[int, ...]]]) -> np.ndarray:
    """``ids`` with (from, to, ids) in place of what they have there."""
    out, at = [], 0
    for begin, end, other in changes:
        out += [ids[at:begin], np.array(other, np.int32)]
        at = end
    return np.concatenate([*out, ids[at:]]) if out else ids


@functools.lru_cache(maxsize=2)
def _lattice(path: str) -> Lattice:
    return Lattice.load(path)


#: What :func:`encode_nbest` gives, with its types.
RESULTS = {"ids": "array<int>", "n_pieces": "long", "scores": "array<double>", "nbest": "array<array<int>>", "nbest_sha256": "array<string>", "decoded_equal": "boolean"}


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([len(x) for x in arrays], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.r_[np.int32(0), ends].astype(np.int32)), pa.array(np.concatenate(arrays).astype(np.int32, copy=False) if arrays else np.zeros(0, np.int32)))


def encode_nbest(df: DataFrame, path: str, n: int = 4, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", results: tuple[str, ...] = tuple(RESULTS)) -> DataFrame:
    """(*keep, *results) for every row of ``df``, in one pass without a shuffle.

    ids: the best segmentation by the sum of the pieces' scores in the file. Of a unigram
    model these are log-probabilities, and ids are what the library encodes. Of a BPE model,
    whose library encoding merges pairs and knows no n best, they are the ranks of merges,
    so ids are the segmentation with the least sum of ranks and not that encoding.

    Texts are normalised as the file says. scores, nbest and nbest_sha256: of the ``n`` best, from the
    best down (equal ones in an order that the text and the model fix), nbest being their ids and the digests those of the ids as little-endian
    32-bit integers. decoded_equal: whether the ids of all ``n`` decode to the text; a
    U+2581 of the text itself is lost, which the model can't tell from a blank, and what the
    normaliser changes. A null or empty text has one segmentation without pieces, with score
    0. Nulls in ``keep`` and repeated rows stay; an empty table gives none; texts may have
    any length; other columns are not read.
    """
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} {RESULTS[c]}" for c in results)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                best, scores, every, digests, equal = [], [], [], [], []
                for value in part.column(len(keep)):
                    text = value.as_py() or ""
                    ids, totals, differences = lattice.encode(text, n)
                    found = [changed(ids, d) for d in differences]
                    best.append(ids)
                    scores.append(totals)
                    if "nbest" in results:
                        every += found
                    if "nbest_sha256" in results:
                        digests.append([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in found])
                    equal.append(lattice.decode(ids) == text and all(lattice.same_bytes(ids, d) or lattice.decode(x) == text for x, d in zip(found, differences)))
                made = {
                    "ids": lambda: _lists(best),
                    "n_pieces": lambda: pa.array([len(x) for x in best], pa.int64()),
                    "scores": lambda: pa.array(scores, pa.list_(pa.float64())),
                    "nbest": lambda: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, scores)]).astype(np.int32)), _lists(every)),
                    "nbest_sha256": lambda: pa.array(digests, pa.list_(pa.string())),
                    "decoded_equal": lambda: pa.array(equal, pa.bool_()),
                }
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(made[c]() for c in results)], [*keep, *results])

    return df.select(*keep, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """(*keep, text): ids back to texts, in one pass without a shuffle.

    A null list gives a null text and an empty one ''. Null ids, ids out of range and those
    of control pieces stand for no bytes. Bytes that make no character become U+FFFD. Nulls
    in ``keep`` and repeated rows stay; an empty table gives none; other columns are not read.
    """
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(path)
        for batch in batches:
            texts = [None if v is None else lattice.decode(v) for v in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, "text"])

    return df.select(*keep, ids_col).mapInArrow(run, f"{schema}, text string")
