"""The training-data operators over small tables with nulls, repeats, ties, long texts and clashing columns."""

import hashlib
import math
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.llm import canon_digest, common, html_density, merkle_warc, mixing, nn_descent, quality_qda, sentencepiece_nbest, simhash, suffix_array, token_count
from tests.llm.test_small_functions import BPE, MODEL, joined, plain_print

LONG = "lorem ipsum dolor " * 20_000
TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog and runs away from it all day long."), (1, None), (2, ""), (3, "The quick brown fox jumps over the lazy dog and runs away from it all day long."),
    (4, "A"), (4, "A"), (None, "text without an id"), (5, LONG), (6, "ÀÉ ﬁ ß x  y"), (7, "àé fi ss x y"), (9, "  \n "), (8, "The quick brown fox jumps over the lazy dog and walks away from it all day long."), (12, LONG + "end"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{k % 4}" if k % 5 else None, 0, "x", 1.0) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, target double")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def key(row):
    return repr(tuple(row))


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 400, (260, 2))] + [(500 + i, 501 + i) for i in range(60)] + [(700, 700 + i) for i in range(30)]
    edges = spark.createDataFrame([*pairs, (None, 1), (3, 3), pairs[0]], "a long, b long")
    found = {r.node: r.root for r in common.components(edges).collect()}
    roots = joined(800, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert found == {i: roots[i] for i in linked}
    assert common.components(edges.limit(0)).count() == 0


def test_token_counts(docs, empty):
    exact = {t: len(token_count._tokenizer(BPE)[0].encode(t or "", add_special_tokens=False)) for _, t in TEXTS}
    rows = token_count.count_tokens(docs, BPE).collect()
    assert sorted(map(key, rows)) == sorted(key((i, len((t or "").encode()), exact[t], exact[t] > 1024)) for i, t in TEXTS)
    assert token_count.count_tokens(empty, BPE).count() == 0


def test_nbest(docs, empty):
    out = sentencepiece_nbest.encode_nbest(docs, MODEL, 3)
    rows = out.collect()
    assert len(rows) == len(TEXTS) and all(r.decoded_equal and r.n_pieces == len(r.ids) and len(r.scores) == len(r.nbest_sha256) for r in rows)
    assert all(r.nbest_sha256[0] == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest() for r in rows)
    back = sentencepiece_nbest.decode(out, MODEL).collect()
    assert sorted(map(key, back)) == sorted(key((i, t or "")) for i, t in TEXTS)
    assert sentencepiece_nbest.encode_nbest(empty, MODEL).count() == 0


def test_nbest_segmentations_are_kept_and_decode(docs):
    out = sentencepiece_nbest.encode_nbest(docs, MODEL, 3)
    rows = out.collect()
    assert all(r.nbest[0] == r.ids and [hashlib.sha256(np.array(x, "<i4").tobytes()).hexdigest() for x in r.nbest] == r.nbest_sha256 for r in rows)
    assert any(len(r.nbest) == 3 for r in rows)
    each = out.select("doc_id", F.explode("nbest").alias("ids"))
    texts = {}
    for i, t in TEXTS:
        texts.setdefault(i, set()).add(t or "")
    assert all(r.text in texts[r.doc_id] for r in sentencepiece_nbest.decode(each, MODEL).collect())


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (0, 0), (5, 0), (None, 1), (7, None), (12, 1), (8, 1)], "doc_id long, quality int")
    rows = quality_qda.classify(docs, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert {r.score for r in quality_qda.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_qda.classify(empty, labels).count() == 0 and quality_qda.keep_good(empty, labels).count() == 0
    kept = quality_qda.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)


def test_quality_held_out(spark):
    base = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    rows = quality_qda.classify(spark.read.parquet(f"{base}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95


def plain_statistics(text):
    text = text or ""
    raw, odds = text.encode(), lambda part, whole: math.log((part + 0.05 * whole + 0.5) / (whole - part + 0.05 * whole + 0.5))
    n, count = len(raw), lambda pattern: len(re.findall(pattern, raw))
    words, lines = raw.lower().split(), [x for x in raw.split(b"\n") if x.strip()]
    small, capitals, other, space = count(b"[a-z]"), count(b"[A-Z]"), count(b"[\x80-\xff]"), count(rb"[ \t\n\r\x0b\x0c]")
    return [
        math.log(1 + n), odds(small + capitals + other, n), odds(capitals, small + capitals), odds(count(rb"[#$%&*+=@^~<>{}\[\]\\_`|]"), n), odds(count(b"[!?]"), n), odds(count(b"[0-9]"), n), odds(space, n),
        math.log(1 + (n - space) / max(1, len(words))), odds(sum(a == b for a, b in zip(words, words[1:])), len(words)), odds(len(lines) - len(set(lines)), len(lines)),
    ]


def test_quality_against_plain_densities(spark):
    """Class means, shrunk covariances and log-densities, all from their definitions."""
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    x = {r.doc_id: np.array(plain_statistics(r.text)) for r in docs.collect()}
    label = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    groups = [np.array([x[i] for i in x if label.get(i) == k]) for k in (0, 1)]
    scatter = [sum(np.outer(r - g.mean(0), r - g.mean(0)) for r in g) for g in groups]
    n = sum(map(len, groups))
    pooled = (scatter[0] + scatter[1]) / n
    ridge = 1e-3 * np.trace(pooled) / len(pooled) * np.eye(len(pooled))
    covariances = [0.5 * s / len(g) + 0.5 * pooled + ridge for s, g in zip(scatter, groups)]

    def density(r, k):
        away = r - groups[k].mean(0)
        return math.log(len(groups[k]) / n) - 0.5 * np.linalg.slogdet(covariances[k])[1] - 0.5 * away @ np.linalg.solve(covariances[k], away)

    for r in quality_qda.classify(docs, labels).collect():
        lead = np.clip(density(x[r.doc_id], 1) - density(x[r.doc_id], 0), -50, 50)
        assert r.score == pytest.approx(1 / (1 + math.exp(-lead)), abs=1e-6)


def canonical(text):
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return re.sub(r"[\s\x85]+", " ", text).strip(" ")


def test_fingerprints(docs, empty):
    rows = canon_digest.fingerprints(docs).collect()
    assert len(rows) == len(TEXTS) and canon_digest.fingerprints(empty).count() == 0
    ids = sorted({i for i, _ in TEXTS}, key=lambda i: (i is not None, i))
    first = {i: min((t or "" for j, t in TEXTS if j == i)) for i in ids}
    expected = []
    for i, t in TEXTS:
        t, after = t or "", first[ids[(ids.index(i) + 1) % len(ids)]]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canonical(t) == canonical(edited)), float(canonical(t) == canonical(after))))
    assert sorted(map(key, [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows])) == sorted(map(key, expected))
    by_length = {}
    for r in rows:
        by_length.setdefault((r.doc_id, r.n_chars), r.fingerprint)
    prints = [by_length[i, len(t or "")] for i, t in TEXTS]
    for (_, a), p in zip(TEXTS, prints):
        for (_, b), q in zip(TEXTS, prints):
            assert (p == q) == (canonical(a) == canonical(b))
    assert all(re.fullmatch("[0-9a-f]{32}", p) for p in prints)
    assert all((r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1.0) for r in rows)


def test_clashing_digests_are_told_apart(docs, monkeypatch):
    monkeypatch.setattr(canon_digest, "digest", lambda c: F.concat(F.lit("d"), F.length(c) % 2))
    rows = canon_digest.fingerprints(docs.where("doc_id in (0, 2, 3, 4, 8, 9)")).collect()
    assert len({r.fingerprint for r in rows}) == 4 and {r.fingerprint for r in rows if r.doc_id in (0, 3)}.__len__() == 1


def test_single_document(docs):
    one = canon_digest.fingerprints(docs.where("doc_id = 0")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_the_least_id_is_no_null(spark):
    rows = [(-(1 << 63), "first text"), (None, "no id"), (0, "second text")]
    found = {r.doc_id: r for r in canon_digest.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    edited = lambda t, after: hashlib.sha256((t[: len(t) - len(t) // 4] + after[: len(t) // 4]).encode()).hexdigest()
    assert set(found) == {None, 0, -(1 << 63)}
    assert found[None].edited_sha256 == edited("no id", "first text") and found[-(1 << 63)].edited_sha256 == edited("first text", "second text") and found[0].edited_sha256 == edited("second text", "no id")


def test_near_duplicates(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    prints = [plain_print(t) for _, t in TEXTS]
    roots = joined(len(TEXTS), [(a, b) for a in range(len(TEXTS)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 4])
    least = {r: min((i for (i, _), q in zip(TEXTS, roots) if q == r and i is not None), default=None) for r in roots}
    assert sorted(map(key, rows)) == sorted(key((i, f"{p:016x}", least[r])) for (i, _), p, r in zip(TEXTS, prints, roots))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first(docs)
    own = {-1 if i is None else i for (i, _), r in zip(TEXTS, roots) if i is None or least[r] == i}
    assert kept.columns == docs.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(own)


def test_first_of_rows_with_clashing_or_missing_ids(spark):
    a, b, c = ("".join(f"{w}{k} " for k in range(40)) for w in ("red", "green", "blue"))
    rows = [(1, a), (1, b), (2, b), (0, a), (None, c), (None, c), (None, a), (1, b)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(key, kept)) == sorted(map(key, [(0, a), (1, b), (None, c)]))


def test_mixing(docs, empty):
    rows = mixing.plan(docs).collect()
    sizes = {}
    for k, (i, t) in enumerate(TEXTS):
        s = f"s{k % 4}" if k % 5 else None
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, capped = {}, float(sum(sizes.values())), set()
    while True:
        open_ = [s for s in order if s not in capped]
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            capped.add(s)
            target[s] = 3.0 * sizes[s]
            left -= target[s]
    target |= share
    by_size = {v: s for s, v in sizes.items()}
    taken = {}
    for r in rows:
        s = by_size[r.source_size]
        assert math.isclose(r.target, target[s], abs_tol=1e-6) and 0 <= r.taken <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in order)
    assert len(rows) == len(TEXTS) and mixing.plan(empty).count() == 0 and mixing.mixed(empty).count() == 0
    again = mixing.plan(docs).collect()
    assert sorted(map(key, rows)) == sorted(map(key, again))
    turns = mixing.schedule(mixing.plan(docs)).collect()
    assert [r.position for r in turns] == sorted(r.position for r in turns) and all(0 <= r.position <= 1 for r in turns)
    assert sum(r.words for r in turns) == sum(r.taken for r in rows)
    assert mixing.mixed(docs).columns == docs.columns


def test_shares_follow_the_schedule(spark):
    """In ten windows of the training, each source has the words that its schedule asks for there."""
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(n), f"s{i % 4}") for i, n in enumerate(rng.integers(1, 40, 6000))]
    planned = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=("source",))
    target, tilt = {r.source: r.target for r in planned.select("source", "target").distinct().collect()}, dict(zip(("s0", "s1", "s2", "s3"), (-0.5, 0.25, 0.75, -0.5)))
    whole = sum(target.values())
    due = lambda s, t: target[s] * (t + tilt[s] * (t * t - t))
    grid = np.linspace(0, 1, 100_001)
    ends = [grid[np.searchsorted(sum(due(s, grid) for s in target), whole * k / 10)] if 0 < k < 10 else k / 10 for k in range(11)]
    words = {}
    for r in mixing.schedule(planned, ("source",)).collect():
        at = min(int(r.position * 10), 9), r.source
        words[at] = words.get(at, 0) + r.words
    assert sum(words.values()) == pytest.approx(whole, abs=2)
    for k in range(10):
        assert sum(words[k, s] for s in target) == pytest.approx(whole / 10, abs=200)
        for s in target:
            assert words[k, s] == pytest.approx(due(s, ends[k + 1]) - due(s, ends[k]), abs=100)
    assert words[0, "s0"] > 1.5 * words[9, "s0"]
    flat = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), tilts=(0.0,))
    assert {r.doc_id: r.position for r in flat.collect()} != {r.doc_id: r.position for r in planned.collect()}


def test_mix_of_clashing_columns_and_ids(spark):
    rows = [(1, "a b c", "x", 0.5, 7), (1, "d e", "x", 0.5, 8), (None, None, None, 0.1, 1), (2, "f " * 9, "y", 0.2, 2), (2, "f " * 9, "y", 0.2, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, position double, `mixed 0` int")
    out = mixing.mixed(docs).collect()
    assert mixing.mixed(docs).columns == docs.columns and {tuple(r) for r in out} <= set(rows) and all(sum(tuple(r) == x for r in out) <= 6 for x in rows)


@pytest.mark.parametrize("tilt", [-1.0, -0.5, 0.0, 0.75, 1.0])
def test_schedule_is_inverted(spark, tilt):
    rows = spark.range(11).select((F.col("id") / 10).alias("x")).select("x", mixing.when_due(F.col("x") * 7, F.lit(7.0), F.lit(tilt)).alias("t")).collect()
    assert all(math.isclose(r.t + tilt * (r.t**2 - r.t), r.x, abs_tol=1e-9) and 0 <= r.t <= 1 for r in rows)


def plain_lost(rows, n=50):
    """For each row its bytes and which of them are lost."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1 if d is not None else 0):
            first[b[i : i + n]] = min(first.get(b[i : i + n], d), d)
    for d, t in rows:
        b = (t or "").encode()
        lost = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1 if d is not None else 0):
            if first[b[i : i + n]] < d:
                lost[i : i + n] = True
        yield b, lost


def plain_kept(rows, n=50):
    return [bytes(np.frombuffer(b, np.uint8)[~lost]) for b, lost in plain_lost(rows, n)]


def plain_dedup(rows, n=50):
    return [(d, len(b), int(lost.sum()), int((np.diff(np.r_[0, lost.astype(int)]) == 1).sum()), hashlib.sha256(k).hexdigest()) for (d, _), (b, lost), k in zip(rows, plain_lost(rows, n), plain_kept(rows, n))]


def odd_repeats():
    """Rows with repeated ids, runs, rows without an id or a text, and many near the same strings."""
    rng = np.random.default_rng(0)
    base, run = "".join(rng.choice(list("ab"), 400)), "Is onhe. " * 60
    rows = [(int(i // 2) if i % 7 else None, base[a : a + b] + base[c : c + 60] + (run[:e] if i % 4 == 0 else "") + "é" * (i % 40) if i % 11 else None) for i in range(120) for a, b, c, e in [rng.integers(0, 300, 4)]]
    rows += [(5, "q" * 200), (6, "q" * 120), (7, "z" * 90_000), (9, "z" * 40_000 + "y"), (9, "z" * 40_000 + "y"), (9, "other " * 20)]
    rows += [(300, "263" * 30), (305, "263" * 30), (305, "480" * 30)]  # texts whose 16-bit digests were once equal
    line = "a line that very many documents have, of more than fifty bytes, word by word"
    rows += [(400 + k % 250, f"{rng.integers(1 << 40)} {line}{rng.integers(1 << 40)} {line[:40]}") for k in range(300)]
    return rows


@pytest.mark.parametrize("hot,block", [(1 << 18, 5), (8, 1 << 14), (1, 1)])
def test_repeats(spark, monkeypatch, hot, block):
    monkeypatch.setattr(suffix_array, "HOT_ROWS", hot)
    monkeypatch.setattr(suffix_array, "CONTEXT_BLOCK", block)
    monkeypatch.setattr(suffix_array, "TURNS", 1000)
    rows = odd_repeats()
    found = suffix_array.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(key, found)) == sorted(map(key, plain_dedup(rows)))


def test_copies_bring_no_anchors(spark, monkeypatch):
    """Equal texts collapse before anchors are taken; what a copy loses doesn't depend on a hash of 64 bits."""
    rows, made = [], {}
    write = suffix_array.written

    def written(df, name, *args):
        out = write(df, name, *args)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(suffix_array, "written", written)
    for k in range(3):  # three different texts of 40 copies each
        text = "".join(chr(97 + (7 * i * i + k * i) % 26) + str(i * (k + 3)) for i in range(100))
        rows += [(100 * i + k, text) for i in range(40)]
    found = suffix_array.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, found)) == sorted(plain_dedup(rows))
    assert made["texts"] == 3 and made["shared"] == 0
    same_hash = [(1, 7, "a" * 30 + "b" * 30), (2, 7, "c" * 30 + "d" * 30), (3, 7, "a" * 30 + "b" * 30)]
    lost = suffix_array.repeats(spark.createDataFrame(same_hash, "doc_id long, row long, text string")).collect()
    assert [(r.doc_id, r.row, [tuple(x) for x in r.lost]) for r in lost] == [(3, 7, [(0, 60)])]


def test_places_move_as_blocks(spark, monkeypatch):
    """Anchors are dealt as bytes, a row for each bucket of grams, and the shared ones are those of several documents."""
    monkeypatch.setattr(suffix_array, "TEXT_BLOCK", 1 << 12)
    monkeypatch.setattr(suffix_array, "ANCHOR_BLOCK", 1 << 10)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = docs.where("octet_length(text) >= 50").groupBy(F.xxhash64("text").alias("row"), "text").agg(F.min("doc_id").alias("doc_id"))
    places = suffix_array._places(texts, 50, 16).coalesce(2).cache()
    found = np.concatenate([np.frombuffer(r.places, suffix_array._PLACE) for r in places.collect()])
    assert places.count() < len(found) / 5
    sizes = [r.n for r in places.groupBy("bucket").agg(F.sum(F.octet_length("places")).alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) < 1.5 * np.mean(sizes)
    several = {}
    for p in found:
        several.setdefault(int(p["gram"]), set()).add(int(p["doc"]))
    expected = sorted((int(p["gram"]), int(p["doc"]), max(int(p["at"]), ~int(p["at"]))) for p in found if len(several[int(p["gram"])]) > 1)
    assert expected and sorted(map(tuple, suffix_array._shared(places).select("gram", "doc", "at").collect())) == expected
    places.unpersist()


def test_texts_without_repeats(spark, docs, empty):
    assert suffix_array.deduplicate(empty).count() == 0 and suffix_array.without_repeats(empty).count() == 0
    rows = odd_repeats() + [(1000, "ü" * 30 + "tail"), (1001, "xü" * 20 + "ü" * 30 + "x")]
    found = suffix_array.without_repeats(spark.createDataFrame([(*r, 1, 2, "3") for r in rows], "doc_id long, text string, lost int, n_bytes int, c0 string")).collect()
    expected = [(d, None if t is None else k.decode("utf-8", "ignore"), 1, 2, "3") for (d, t), k in zip(rows, plain_kept(rows))]
    assert sorted(map(key, found)) == sorted(map(key, expected))
    kept = suffix_array.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)
    assert all(r.n_chars == (0 if r.text is None else len(r.text)) for r in kept.collect())
    by_id = {r.doc_id: r.text for r in kept.collect()}
    assert by_id[0] == TEXTS[0][1] and by_id[3] == "" and by_id[12] != TEXTS[-1][1] and by_id[1] is None


def test_repeats_over_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert sorted(map(key, suffix_array.deduplicate(docs).collect())) == sorted(map(key, plain_dedup([tuple(r) for r in docs.collect()])))


def test_pages(spark):
    rows = [(0, "u", "<p>a</p>"), (0, "u", "<p>a</p>"), (None, None, None), (1, "v", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = html_density.extract_text(pages).collect()
    assert sorted(map(key, found)) == sorted(map(key, [(0, "u", "a", 1), (0, "u", "a", 1), (None, None, "", 0), (1, "v", "", 0)]))
    assert html_density.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page", [
    "<div class='layout has-sidebar'>{}</div>", "<div id='content' class='with-comments widget'>{}</div>", "<form>{}</form>", "<div class='notice share'><article>{}</article></div>",
    "<div><div class='post-header'></div>{}</div>",
])
def test_text_inside_doubtful_names_stays(page):
    body = "".join(f"<p>Sentence {k} of an article that is long enough to be the text of its page.</p>" for k in range(8))
    menu = "<div class='sidebar'><a href='/a'>First</a> <a href='/b'>Second</a> a few words</div>"
    text = html_density.main_text(menu + page.format(body))
    assert text.count("Sentence") == 8 and "few words" not in text


def test_headline_and_text_beside_an_article_stay():
    body = "".join(f"<p>Sentence {k} of an article that is long enough to be the text of its page.</p>" for k in range(8))
    assert "Headline" in html_density.main_text(f"<article><div class='post-header'><h1>Headline of it</h1></div>{body}</article>")
    assert html_density.main_text(f"<article>{body}</article><section>{body}</section>").count("Sentence") == 16


def flat_audit(first, second):
    """The records at the same place of their files that differ, without any tree."""
    out, sides = [], []
    for records in (first, second):
        files = {}
        for r in records:
            files.setdefault(r.file, []).append(r)
        sides.append({f: sorted(rows, key=lambda r: r.offset) for f, rows in files.items()})
    for f in set(sides[0]) | set(sides[1]):
        a, b = (s.get(f, []) for s in sides)
        for k in range(max(len(a), len(b))):
            x, y = a[k] if k < len(a) else None, b[k] if k < len(b) else None
            if x is None or y is None or (x.offset, x.length, x.hash) != (y.offset, y.length, y.hash):
                out.append((f, (x or y).offset, x and bytes(x.hash).hex(), y and bytes(y.hash).hex()))
    return out


def test_fixity(spark, monkeypatch):
    monkeypatch.setattr(merkle_warc, "FILE_RECORDS", 100)
    monkeypatch.setattr(merkle_warc, "PIECE_BYTES", 3000)
    monkeypatch.setattr(merkle_warc, "FANOUT", 4)
    rows = [(i, f"http://a/{i} é%\r\n" if i % 3 else None, f"<p>{i}\r\n\r\n</p>" * (i % 5) if i % 7 else None) for i in range(400)] + [(None, "u", "h"), (101, "u", "h"), (-101, "u", "h")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, hash string")
    found = merkle_warc.audit_pages(pages).collect()
    assert sorted(map(str, ((r.page_id, r.url) for r in found))) == sorted(map(str, ((i, u) for i, u, h in rows if i is not None and h and i % 101 in (0, 50))))
    assert all(r.expected_sha256 != r.found_sha256 for r in found)
    first = merkle_warc.archive(pages)
    assert merkle_warc.audit(merkle_warc.leaves(merkle_warc.scan(first)), merkle_warc.leaves(merkle_warc.scan(first))).count() == 0
    assert merkle_warc.audit_pages(pages.limit(0)).count() == 0


def test_audits_against_a_flat_comparison(spark, monkeypatch):
    """Rot in content and in headers, a lost record, a cut file and a file too many."""
    monkeypatch.setattr(merkle_warc, "FANOUT", 3)
    rng = np.random.default_rng(8)
    files = {f"f{k}": [merkle_warc.record(f"http://a/{k}/{i}", bytes(rng.integers(97, 123, int(rng.integers(0, 90))).astype(np.uint8)), 100 * k + i) for i in range(n)] for k, n in enumerate((40, 1, 27, 3, 9))}
    second = {f: list(r) for f, r in files.items()}
    second["f0"][17] = second["f0"][17].replace(b"http", b"hxtp")
    second["f2"].pop(20)
    second["f3"][1] = second["f3"][1].replace(b"WARC/1.1", b"WARX/1.1")
    second["f4"][-1] = second["f4"][-1][:-7]
    second["f9"] = [merkle_warc.record("u", b"body")]
    table = lambda side: spark.createDataFrame([(f, 0, bytearray(b"".join(r))) for f, r in side.items()], "file string, offset long, data binary")
    a, b = (merkle_warc.scan(table(side)) for side in (files, second))
    found = merkle_warc.audit(merkle_warc.leaves(a), merkle_warc.leaves(b)).collect()
    assert sorted(map(str, ((r.file, r["first"], r.expected_hash, r.found_hash) for r in found))) == sorted(map(str, flat_audit(a.collect(), b.collect())))
    assert {r.file for r in found} == {"f0", "f2", "f3", "f4", "f9"} and sum(r.file == "f0" for r in found) == 1


def test_fixity_of_lost_and_added_records(spark):
    make = lambda rows: merkle_warc.leaves(spark.createDataFrame([(f, o, 10, bytes([h]), o, "u") for f, o, h in rows], "file string, offset long, length long, hash binary, id long, url string"))
    whole = [(f, 10 * i, i % 200) for f in ("a", "b", "c") for i in range(40 if f == "a" else 3)]
    lost = [r for r in whole if r != ("a", 370, 37)]
    found = merkle_warc.audit(make(whole), make(lost)).collect()
    assert {(r.file, r["first"]) for r in found} == {("a", 370), ("a", 380), ("a", 390)}
    more = merkle_warc.audit(make(whole), make([*whole, ("d", 0, 1)])).collect()
    assert [(r.file, r.expected_hash is None) for r in more] == [("d", True)]


def plain_links(rows, limit=0.98):
    n = len(rows)
    ok = [r[0] is not None and r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(c is not None and math.isfinite(c) for c in r[1]) and any(r[1]) for r in rows]
    x = [np.array(r[1], np.float32).astype(float) if k else None for r, k in zip(rows, ok)]
    pairs = [(a, b) for a in range(n) for b in range(a) if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= limit]
    roots, links = joined(n, pairs), [0] * n
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    least = {}
    for r, root in zip(rows, roots):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    return [(r[0], k, r[0] if not k and r[0] is None else least.get(root, r[0]), r[0] is None or r[0] == least.get(root, r[0])) for r, k, root in zip(rows, links, roots)]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 16))
    rows = [(i, base[i].astype(np.float32).tolist(), i % 3) for i in range(300)]
    rows += [(1000 + i, (base[i % 40] + 0.03 * rng.normal(size=16)).astype(np.float32).tolist(), (i % 40) % 3) for i in range(200)]
    center = rng.normal(size=16)
    rows += [(2000 + i, (center + 0.08 * rng.normal(size=16)).astype(np.float32).tolist(), 1) for i in range(150)]
    rows += [(3000, rows[0][1], 0), (3001, rows[0][1], 1), (3002, rows[0][1], None), (3003, None, 0), (3004, [0.0] * 16, 0), (3005, [math.nan] * 16, 0), (3006, [None] * 16, 0), (3007, [], 0), (None, rows[0][1], 0), (3008, [1.0, 2.0], 0), (3009, [2.0, 4.0], 0), (5, rows[5][1], 2), (3010, [math.inf] * 16, 0)]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    out = nn_descent.link_vectors(vectors).collect()
    assert sorted(key(tuple(r)[:4]) for r in out) == sorted(map(key, plain_links(rows)))
    assert all(r.audited_recall >= nn_descent.GOAL for r in out)
    assert nn_descent.link_vectors(vectors.limit(0)).count() == 0


def near(center, share, rng):
    """A unit vector whose cosine with ``center`` is ``share``."""
    x = rng.normal(size=len(center))
    x -= x @ center * center
    return share * center + math.sqrt(1 - share**2) * x / np.sqrt(x @ x)


def tight_pair(rng, d=64, each=20):
    """Two groups of ``each`` vectors: cosine about 0.999 within, about 0.985 across."""
    a = rng.normal(size=d)
    a /= np.sqrt(a @ a)
    b = near(a, 0.986, rng)
    return [near(c, math.sqrt(0.9995), rng) for c in (a, b) for _ in range(each)]


def exactly_linked(spark, rows):
    vectors = spark.createDataFrame([(i, v.astype(np.float32).tolist(), p) for i, v, p in rows], "vec_id long, embedding array<float>, label int")
    found = nn_descent.link_vectors(vectors).collect()
    assert sorted(key(tuple(r)[:4]) for r in found) == sorted(map(key, plain_links([tuple(r) for r in vectors.collect()])))
    return {r.vec_id: r for r in found}


def late_ids(spark, n, count):
    """The ``count`` of the ids 0 to n - 1 whose hashes are greatest, which a sample by least hash leaves out, and the others."""
    ids = [r.id for r in spark.range(n).orderBy(F.xxhash64("id").desc()).collect()]
    return ids[:count], ids[count:]


def test_vectors_of_tight_groups_side_by_side(spark):
    rng = np.random.default_rng(2)
    late, others = late_ids(spark, 500, 40)
    found = exactly_linked(spark, [(i, v, 0) for i, v in zip(late, tight_pair(rng))] + [(i, rng.normal(size=64), 0) for i in others])
    assert all(found[i].n_links == 39 and found[i].component_id == min(late) for i in late)


def test_vectors_after_a_thin_graph(spark, monkeypatch):
    for name, value in (("MISS", 0.9), ("CELL", 1), ("CELL_MOST", 2), ("ROUNDS", 1)):
        monkeypatch.setattr(nn_descent, name, value)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    exactly_linked(spark, [(i, base[i % 60] + 0.02 * rng.normal(size=16), 0) for i in range(300)])


def test_vectors_of_small_groups_beside_a_hot_one(spark, monkeypatch):
    for name, value in (("MISS", 0.9), ("CELL", 1), ("ROUNDS", 1)):
        monkeypatch.setattr(nn_descent, name, value)
    rng = np.random.default_rng(4)
    late, others = late_ids(spark, 700, 60)
    hot, pairs = rng.normal(size=32), rng.normal(size=(30, 32))
    rows = [(i, pairs[k // 2] + 0.02 * rng.normal(size=32), 0) for k, i in enumerate(late)]
    rows += [(i, hot + 0.02 * rng.normal(size=32) if k % 2 else rng.normal(size=32), 0) for k, i in enumerate(others)]
    found = exactly_linked(spark, rows)
    assert all(found[i].n_links == 1 for i in late)


def test_crowded_vectors_and_the_exact_search(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "LIST_MOST", 16)
    rng = np.random.default_rng(6)
    rows = [(i, v, 0) for i, v in enumerate(tight_pair(rng, each=60))] + [(1000 + i, rng.normal(size=64), 0) for i in range(200)]
    assert max(r.n_links for r in exactly_linked(spark, rows).values()) == 119
    monkeypatch.setattr(nn_descent, "GOAL", 2.0)  # no audit passes
    exactly_linked(spark, rows)


def test_a_long_chain_needs_no_blocks(spark, monkeypatch):
    """20,000 vectors on a circle, each linked with a few before and behind it."""
    monkeypatch.setattr(nn_descent, "_compared", None)
    n, turns = 20_000, np.arange(20_000) * (math.acos(0.98) / 3.5)
    steps = np.stack([np.cos(turns), np.sin(turns)], 1)
    # A helix: as it turns it drifts through other dimensions, so that only near turns are near.
    drift = turns / 15
    x = np.concatenate([steps] + [np.stack([np.cos(drift * f), np.sin(drift * f)], 1) for f in (0.37, 0.61, 1.0, 1.7)], 1)
    x = (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    y = x.astype(float)
    y /= np.sqrt((y * y).sum(1))[:, None]
    links = np.concatenate([(y[k : k + 2000] @ y.T >= 0.98).sum(1) - 1 for k in range(0, n, 2000)])
    if links.max() >= nn_descent.LIST_MOST:
        pytest.skip("the chain is too dense")
    found = {r.vec_id: r for r in nn_descent.link_vectors(vectors).collect()}
    assert np.mean([found[i].n_links == links[i] for i in range(n)]) > 0.97 and found[0].audited_recall >= nn_descent.GOAL
