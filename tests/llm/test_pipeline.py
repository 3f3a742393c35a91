"""Each stage of the pipeline against a plain version, on what the stage before it kept."""

import re

import numpy as np
import pytest

import corpus_pipeline
from meshweave.llm import quality_qda
from meshweave.llm.common import written
from meshweave.llm.sentencepiece_nbest import Lattice
from tests.llm.test_operators import plain_kept
from tests.llm.test_small_functions import MODEL, joined, plain_print

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark):
    """Rows before the first stage and after every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        out.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    return out


def test_quality(spark, kept):
    model = quality_qda.learned(quality_qda.with_statistics(spark.read.parquet(f"{SF}/documents.parquet")), spark.read.parquet(f"{SF}/labels.parquet"))
    good = [r for r in kept[0] if model.scores(np.array([quality_qda.statistics(r.text)]))[0] >= 0.3]
    assert sorted(map(tuple, kept[1])) == sorted(map(tuple, good)) and 0.7 < len(good) / len(kept[0]) < 1
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in good}
    assert np.mean([(i in ids) == bool(q) for i, q in labels.items()]) > 0.95


def test_near_duplicates(kept):
    rows = sorted(kept[1], key=lambda r: r.doc_id)
    prints = [plain_print(r.text) for r in rows]
    roots = joined(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 4])
    assert sorted(map(tuple, kept[2])) == sorted(tuple(r) for i, (r, root) in enumerate(zip(rows, roots)) if i == root)


def test_repeated_strings(kept):
    rows = [(r.doc_id, r.text) for r in kept[2]]
    expected = {d: k.decode("utf-8", "ignore") for (d, _), k in zip(rows, plain_kept(rows))}
    assert {r.doc_id: r.text for r in kept[3]} == expected and len(kept[3]) == len(rows) and all(r.n_chars == len(r.text) for r in kept[3])


def test_source_mix(kept):
    """Each source's words come near its target, which is worked out by taking what is above and sharing it again."""
    texts = {r.doc_id: tuple(r) for r in kept[3]}
    assert all(tuple(r) == texts[r.doc_id] for r in kept[4])
    times, words, longest = {}, [{}, {}], {}
    for r in kept[4]:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    for rows, found in zip((kept[3], kept[4]), words):
        for r in rows:
            n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
            found[r.source] = found.get(r.source, 0) + n
            longest[r.source] = max(longest.get(r.source, 0), n)
    order = sorted(words[0], key=lambda s: (s is None, s))
    weight, target, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, float(sum(words[0].values()))
    while True:
        rest = [s for s in order if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        full = [s for s in rest if share[s] > 3 * words[0][s]]
        if not full:
            break
        for s in full:
            target[s] = 3.0 * words[0][s]
            left -= target[s]
    target |= share
    assert max(times.values()) <= 3
    assert all(abs(words[1].get(s, 0) - target[s]) <= longest[s] for s in order)


def test_pieces(kept):
    lattice = Lattice.load(MODEL)
    assert sorted((r.doc_id, lattice.decode(r.ids)) for r in kept[5]) == sorted((r.doc_id, r.text) for r in kept[4])
    assert all(len(set(r.nbest_sha256)) == len(r.nbest_sha256) <= 4 for r in kept[5])


def test_run(spark, kept):
    assert sorted(map(repr, corpus_pipeline.run(spark, SF).collect())) == sorted(map(repr, kept[5]))


def test_stages_of_empty_and_odd_tables(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (1, None, None, None, None), (2, "word", "en", None, 4)], "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda r: repr(tuple(r)[:5])
    rows = sorted(map(key, odd.collect()))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
        found = stage(spark, odd, SF).collect()
        if name == "SimHash near-dedup":  # the first of the three empty texts, and the word
            assert sorted(map(key, found)) == sorted({r for r in rows if r.startswith(("(1,", "(2,"))})
        elif name == "suffix-array dedup":
            assert sorted(map(key, found)) == rows
        elif name == "source mix":  # only the word can be taken
            assert {key(r) for r in found} == {r for r in rows if r.startswith("(2,")}
        elif name == "SentencePiece":
            assert [len(r.ids) > 0 for r in sorted(found, key=lambda r: (r.doc_id is None, r.doc_id))] == [False, False, True, False]
