"""Driver-side parts of the training-data operators against plain versions."""

import hashlib
import itertools
import math
import re
import tracemalloc

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from meshweave.llm import html_density, merkle_warc, quality_qda, simhash, suffix_array, token_count
from meshweave.llm.sentencepiece_nbest import SPACE, Lattice, changed

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# Token counts


def library_counts(texts, path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return [len((t or "").encode()) for t in texts], [len(library.encode(t or "", add_special_tokens=False)) for t in texts]


FILES = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json")]


@pytest.mark.parametrize("path", FILES)
def test_lengths_are_the_librarys(path):
    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.one_of(st.none(), st.text("ab1 é.'\n\t \x1c\xa0\u0301", max_size=60), st.text(max_size=30)), max_size=5), st.integers(1, 12))
    def check(texts, size):
        token_count.safe_pieces.__defaults__ = (size,)
        assert token_count.lengths(texts, path) == library_counts(texts, path)

    try:
        check()
    finally:
        token_count.safe_pieces.__defaults__ = (token_count.LONG_BYTES,)


@pytest.mark.parametrize("path", FILES)
def test_lengths_of_special_strings_and_long_texts(path, monkeypatch):
    monkeypatch.setattr(token_count, "BATCH_BYTES", 300)
    texts = ["<|endoftext|> a <|endoftext|>x\ny", "a b\nc d e f", "x" * 300 + " y " + "z" * 100 + "\n" + "w" * 70, "it's 1st 2nd's don't " * 9000, "1a" * 40_000, "é" * 70_000, "", None]
    assert token_count.lengths(texts, path) == library_counts(texts, path)


def test_cut_rules():
    assert [token_count.cut_rule(f) is not None for f in FILES] == [True, False]


@given(st.text("ab1 \n", max_size=200), st.integers(1, 30))
def test_pieces_join(text, size):
    pieces = token_count.safe_pieces(text, token_count.SAFE, size)
    assert "".join(pieces) == text and all(len(p) >= size for p in pieces[:-1])
    assert token_count.safe_pieces(text, None, size) == [text]


@given(st.lists(st.integers(0, 50)), st.integers(1, 60))
def test_batches_are_balanced(sizes, most):
    batches = list(token_count.balanced([(i, "", n) for i, n in enumerate(sizes)], most))
    assert [x[0] for b in batches for x in b] == list(range(len(sizes)))
    assert all(sum(x[2] for x in b[:-1]) < most for b in batches) and all(sum(x[2] for x in b) >= most for b in batches[:-1])


# SentencePiece


def every_path(lattice, text):
    """All segmentations of a normalised text with their scores."""
    if not text:
        return [(0.0, ())]
    out = []
    for j in range(1, len(text) + 1):
        found = lattice.scores.get(text[:j])
        if found is None and j == 1:
            found = ((*(lattice.byte_ids[b] for b in text[0].encode()),), lattice.unknown_score)
        elif found is None:
            continue
        ids = found[0] if isinstance(found[0], tuple) else (found[0],)
        out += [(found[1] + s, ids + rest) for s, rest in every_path(lattice, text[j:])]
    return out


def toy():
    pieces = ["a", "b", "ab", "ba", "aba", "c", SPACE, SPACE + "a", SPACE + "ab", "bc"]
    return Lattice([(p, 300 + i, -float((7 * i) % 11)) for i, p in enumerate(pieces)], {b: b for b in range(256)}, 0)


@settings(max_examples=80, deadline=None)
@given(st.text("abc xé", max_size=8), st.integers(1, 5))
def test_nbest_against_all_paths(text, n):
    lattice = toy()
    ids, scores, changes = lattice.encode(text, n)
    paths = sorted(every_path(lattice, lattice.normalised(text)), key=lambda p: -p[0])
    assert scores == pytest.approx([p[0] for p in paths[:n]])
    mine = [tuple(changed(ids, c).tolist()) for c in changes]
    score_of = dict((p[1], p[0]) for p in paths)
    assert len(set(mine)) == len(mine) and [score_of[m] for m in mine] == pytest.approx(scores)
    assert all(lattice.decode(m) == text for m in mine)


def test_nbest_against_library():
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    proto = pb.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    lattice = Lattice.load(MODEL)
    for text in ("Hello world and more", "the reading thereof, in Ordnung?", "est une elle des mots"):
        ids, _, changes = lattice.encode(text, 4)
        assert sorted(tuple(changed(ids, c).tolist()) for c in changes) == sorted(map(tuple, library.nbest_encode(text, nbest_size=4, out_type=int)))


def small_model(path, prefix, tidy, kind=1):
    """A unigram model made by hand: nothing is trained."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    for name, score, kind_ in [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]:
        proto.pieces.add(piece=name, score=score, type=kind_)
    for k, piece in enumerate([SPACE, "a", "b", "c", "ab", "ba", "abc", "ca", SPACE + "a", SPACE + "ab", "b" + SPACE, "bca", "aa"]):
        proto.pieces.add(piece=piece, score=-1.5 - 0.37 * k - (k * k % 7) * 0.113, type=1)
    proto.trainer_spec.model_type = kind
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.add_dummy_prefix = prefix
    proto.normalizer_spec.remove_extra_whitespaces = tidy
    path.write_bytes(proto.SerializeToString())
    return str(path)


@pytest.mark.parametrize("prefix,tidy", [(True, False), (False, False), (True, True), (False, True)])
def test_unigram_models_against_the_library(tmp_path, prefix, tidy):
    import sentencepiece

    path = small_model(tmp_path / "small.model", prefix, tidy)
    library, lattice = sentencepiece.SentencePieceProcessor(model_file=path), Lattice.load(path)

    @settings(max_examples=150, deadline=None)
    @given(st.text("abc ", min_size=1, max_size=12).filter(str.strip), st.integers(1, 6))
    def check(text, n):
        ids, scores, changes = lattice.encode(text, n)
        mine, own = [tuple(changed(ids, c).tolist()) for c in changes], library.nbest_encode(text, nbest_size=n, out_type=int)
        score = lambda x: sum(library.get_score(i) for i in x)
        assert [score(x) for x in mine] == pytest.approx([score(x) for x in own], abs=1e-4) and scores == pytest.approx([score(x) for x in own], abs=1e-4)
        assert len(set(mine)) == len(mine) and score(ids) == pytest.approx(score(library.encode(text)), abs=1e-4)
        assert lattice.decode(ids) == library.decode(list(map(int, ids)))

    check()


def test_the_files_normaliser_is_the_plain_one():
    lattice = Lattice.load(MODEL)
    for text in ("", " ", "a  b", " ﬁ Å\t\n", "▁x", "\u00a0 \u3000"):
        assert lattice.normalised(text) == ((SPACE if text else "") + text.replace(" ", SPACE))


def test_decode_of_odd_ids():
    lattice = Lattice.load(MODEL)
    a = int(lattice.encode("word", 1)[0][0])
    assert lattice.decode([None, a, -5, 10**9, 1]) == lattice.decode([a]) and lattice.decode([]) == ""


def test_decode_bytes_and_memory(monkeypatch):
    import meshweave.llm.sentencepiece_nbest as module

    lattice = Lattice.load(MODEL)
    monkeypatch.setattr(module, "KNOWN", 20)
    for text in ("", " ", "  two  blanks ", "\n\t中😀", "a" * 500, "word " * 40, "ünïcödé​"):
        ids, scores, _ = lattice.encode(text, 3)
        assert lattice.decode(ids) == text and scores == sorted(scores, reverse=True)
    assert lattice.decode([lattice.byte_ids[0xFF]]) == "�"


# Quality


def test_statistics_are_finite():
    for text in (None, "", " ", "\n\n", "a", "|" * 1000, "ÀÉ" * 10, "the " * 5000):
        row = quality_qda.statistics(text)
        assert len(row) == len(quality_qda.FEATURES) and np.isfinite(row).all()
    assert quality_qda.statistics(None) == quality_qda.statistics("")


# SimHash


def plain_print(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


@settings(deadline=None)
@given(st.one_of(st.none(), st.text("aBÉ \t\n\x0b\x1c ", max_size=60)))
def test_print(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_print(text)


def joined(n, pairs):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("limit", [0, 1, 3, 4, 6])
def test_cells_and_links(limit):
    rng = np.random.default_rng(limit)
    x = rng.integers(0, 1 << 64, 150, dtype=np.uint64)
    for _ in range(2):
        y = x.copy()
        for _ in range(max(limit, 1)):
            y ^= np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64)
        x = np.concatenate([x, y])
    near = np.full(80, x[0])
    for _ in range(2):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
    x = np.unique(np.concatenate([x, near])).view(np.int64)
    keys, owners = simhash.cells(x, limit)
    order = np.argsort(keys, kind="stable")
    a, b = simhash.links(keys[order], x[owners][order], limit)
    at = {v: i for i, v in enumerate(x.tolist())}
    distance = np.bitwise_count(x.view(np.uint64)[:, None] ^ x.view(np.uint64)[None])
    assert joined(len(x), [(at[p], at[q]) for p, q in zip(a.tolist(), b.tolist())]) == joined(len(x), np.argwhere(distance <= limit).tolist())
    assert all(distance[at[p], at[q]] <= limit for p, q in zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("limit", [1, 4])
def test_links_of_a_hot_cell(monkeypatch, limit):
    """One cell with clusters, chains and strangers, walked, dealt once and dealt again."""
    rng = np.random.default_rng(limit)
    flips = lambda n, most: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, most)).astype(np.uint64), 1)
    x = [rng.integers(0, 1 << 64, 600, dtype=np.uint64), rng.integers(0, 1 << 64, 1, dtype=np.uint64) ^ flips(700, 3), np.uint64(77) ^ np.bitwise_xor.accumulate(flips(200, 2))]
    x = np.unique(np.concatenate([*x, rng.integers(0, 1 << 20, 500, dtype=np.uint64)])).view(np.int64)
    distance = np.bitwise_count(x.view(np.uint64)[:, None] ^ x.view(np.uint64)[None])
    expected = joined(len(x), np.argwhere(distance <= limit).tolist())
    at = {v: i for i, v in enumerate(x.tolist())}
    for walked in (4096, 100, 3):
        monkeypatch.setattr(simhash, "WALKED", walked)
        a, b = simhash.links(np.zeros(len(x), np.int64), x, limit)
        pairs = [(at[p], at[q]) for p, q in zip(a.tolist(), b.tolist())]
        assert joined(len(x), pairs) == expected and all(distance[p, q] <= limit for p, q in pairs)


# Repeated strings


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=20, max_size=60), min_size=1, max_size=4))
def test_anchors_agree(texts):
    """Equal strings have equal anchors, contexts that hold them, and places."""
    raws = [t.encode() for t in texts]
    found = suffix_array.anchors(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([len(r) for r in raws]), 20)
    owner = {}
    for gram, shape, text, at, runs in zip(*(found[k].tolist() for k in ("gram", "shape", "text", "at", "runs"))):
        before, after = shape >> 6, shape & 63
        for k in range(runs):
            for start in range(at - before, at - after + 1):
                owner[text, start + k * (before - after + 1)] = gram, at - start
    assert set(owner) == {(i, s) for i, r in enumerate(raws) for s in range(len(r) - 19)}
    seen = {}
    for (i, s), value in owner.items():
        assert seen.setdefault(raws[i][s : s + 20], value) == value


def plain_minima(rows, groups, least, n):
    width = rows.shape[1] - n + 1
    out = np.repeat(least[:, None], width, 1)
    for p in range(width):
        best = {}
        for g, r, x in zip(groups, rows, least):
            if (r[p : p + n] != 0).all():
                key = g, r[p : p + n].tobytes()
                best[key] = min(best.get(key, x), x)
        for i, (g, r) in enumerate(zip(groups, rows)):
            if (r[p : p + n] != 0).all():
                out[i, p] = best[g, r[p : p + n].tobytes()]
    return out


def test_common_minima():
    rng = np.random.default_rng(3)
    for letters, n in itertools.product((1, 2, 3), (4, 7)):
        rows = rng.integers(1, 1 + letters, (60, n + 5)).astype(np.uint16)
        rows[rng.random(60) < 0.3, 0] = 0
        rows[rng.random(60) < 0.3, -1] = 0
        groups, least = np.sort(rng.integers(0, 6, 60)), rng.integers(0, 1000, 60)
        got, expected = suffix_array.common_minima(rows, groups, least, n), plain_minima(rows, groups, least, n)
        for p in range(6):
            whole = (rows[:, p : p + n] != 0).all(1)
            assert np.array_equal(got[whole, p], expected[whole, p])


def test_common_minima_hold_one_column():
    """The transform keeps one column's order, not those of all columns."""
    rng = np.random.default_rng(5)
    rows, groups, least = rng.integers(1, 5, (20_000, 84)).astype(np.uint16), np.sort(rng.integers(0, 5000, 20_000)), np.arange(20_000)
    tracemalloc.start()
    suffix_array.common_minima(rows, groups, least, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * rows.nbytes


def test_kept_bytes():
    assert suffix_array.kept_bytes(b"abcdefgh", np.array([5, 1, 2]), np.array([6, 3, 5])) == (b"agh", 1)
    assert suffix_array.kept_bytes(b"abcdefgh", np.array([6, 1]), np.array([7, 3])) == (b"adefh", 2)
    assert suffix_array.kept_bytes(b"ab", np.zeros(0, int), np.zeros(0, int)) == (b"ab", 0)


# Pages


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<", "<"), ("a < b & c &amp; d", "a < b & c & d"), ("<p>one<p>two  three\n</p>", "one\ntwo three"),
    ("<article><h1>T</h1><p>x<br>y</p></article><footer>z</footer>", "T\nx y"),
    ("<nav><ul><li><a href=/>a</a></ul></nav><div class='ad'>buy now this long advert</div><article><p>text</p></article>", "text"),
    ("<header>site</header><main><header><h1>H</h1></header><p>body</p></main><aside>side</aside>", "body"),
    ("<article><header><h1>H</h1></header><p>body</p><div class='comment-list'><p>reader</p></div><form>f</form></article>", "H\nbody"),
    ("<script>var t='</p><p>no</p>';</script><style>p{}</style><p>yes</p><!-- <p>no</p> -->", "yes"),
    ("<div id=cookie-notice>We use cookies</div><div><h2>T</h2><p>Some longer text here.</p><p>And more.</p></div><div class=sidebar><p>x</p></div>", "T\nSome longer text here.\nAnd more."),
    ("<div style='display: none'>x</div><p class=intro>y</p><p hidden>z</p>", "y"), ("<p>a<b>bold</b>c</p>", "aboldc"), ("<ul><li>one<li>two</ul>", "one\ntwo"), ("<p>&lt;b&gt; &eacute; &#8212;", "<b> é —"),
])
def test_main_text(page, text):
    assert html_density.main_text(page) == text


@settings(deadline=None)
@given(st.text("<>/pdiv a='\"!-&;", max_size=80))
def test_pages_never_fail(page):
    html_density.main_text(page)


def test_long_page():
    paragraphs = [f"paragraph {i} " * 20 for i in range(3000)]
    page = "<body><nav>menu</nav><article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>"
    assert html_density.main_text(page) == "\n".join(p.strip() for p in paragraphs)


# WARC


def test_records_round_trip():
    bodies = [b"", b"x" * 1000, "é\r\n\r\n".encode()]
    data = b"".join(merkle_warc.record(f"http://a/{i}", b) for i, b in enumerate(bodies))
    found = list(merkle_warc.read_records(data))
    assert [b for *_, b in found] == bodies and [h["warc-target-uri"] for _, _, h, _ in found] == [f"http://a/{i}" for i in range(3)]
    assert sum(n for _, n, *_ in found) == len(data)
    assert found[1][2]["warc-payload-digest"] == "sha256:" + hashlib.sha256(bodies[1]).hexdigest()
    with pytest.raises(ValueError):
        list(merkle_warc.read_records(data[:-3]))


def plain_density(tree, body=None):
    """(density, total, characters, tags, link characters, link tags) of nested (tag, [texts and trees]), each node's in a list of the whole in page order."""
    tag, parts = tree
    every, chars, tags, link_chars, link_tags, inner = [], 0, 0, 0, 0, []
    for x in parts:
        if isinstance(x, str):
            chars += len(x.replace(" ", ""))
        else:
            below = plain_density(x, body)
            every += below
            inner.append(below[0])
            chars, tags, link_chars, link_tags = chars + below[0][2], tags + below[0][3] + 1, link_chars + below[0][4], link_tags + below[0][5] + (x[0] == "a")
    if tag == "a":
        link_chars = chars
    ratio = body if body is not None else 0
    density = 0.0
    if chars:
        t = max(tags, 1)
        argument = chars / max(link_chars, 1) * t / max(link_tags, 1)
        base = math.log(math.e + chars / max(1, chars - link_chars) * link_chars + ratio * chars)
        density = chars / t * max(0.0, math.log(argument)) / max(1.0, base) if argument > 0 else 0.0
    return [(density, sum(x[0] for x in inner), chars, tags, link_chars, link_tags), *every]


def test_densities_against_plain_ones():
    import random

    rng = random.Random(4)

    def tree(depth):
        if depth == 0:
            return rng.choice(["div", "section", "b", "a"]), ["word " * rng.randint(1, 30)]
        return rng.choice(["div", "section"]), [tree(rng.randint(0, depth - 1)) if rng.random() < 0.7 else "text " * rng.randint(1, 9) for _ in range(rng.randint(1, 5))]

    text = lambda x: x if isinstance(x, str) else f"<{x[0]}>{''.join(map(text, x[1]))}</{x[0]}>"
    for _ in range(60):
        whole = "body", [tree(3) for _ in range(rng.randint(1, 4))]
        _, _, chars, _, link_chars, _ = plain_density(whole)[0]
        expected = plain_density(whole, link_chars / chars)
        nodes = html_density.measure(html_density.parse(text(whole)))
        assert [n.density for n in nodes] == pytest.approx([e[0] for e in expected])
        assert [n.total for n in nodes if n.total > 1e-3] == pytest.approx([e[1] for e in expected if e[1] > 1e-3])


BODY = "".join(f"<p>Paragraph {k} says something of a length that paragraphs of an article have.</p>" for k in range(6))
PLAIN = "\n".join(f"Paragraph {k} says something of a length that paragraphs of an article have." for k in range(6))


@pytest.mark.parametrize("page,text", [
    (f"<form action=x>{BODY}<input></form>", PLAIN),
    (f"<article><div class='entry-header'><h1>Title</h1></div>{BODY}</article>", "Title\n" + PLAIN),
    (f"<article>{BODY}</article>" + "<article class=teaser>" + "<p><a href=/x>A link to another article of the site</a></p>" * 4 + "</article>", PLAIN),
    (f"<article>{BODY}<div class='discussion'>" + "<p>I don't agree with this.</p>" * 3 + "</div></article>", PLAIN),
    (f"<div><ul>{'<li><a href=/>menu</a>' * 8}</ul></div><div>{BODY}</div><div><a href=/>imprint</a></div>", PLAIN),
    (f"<div><h2>Headline</h2><div>{BODY}</div><div>{'<a href=/>tag</a> ' * 6}</div></div>", "Headline\n" + PLAIN),
    (f"<section><section>{BODY}</section><section>{BODY}</section><section><p>Short end.</p></section></section>", PLAIN + "\n" + PLAIN + "\nShort end."),
])
def test_density_chooses(page, text):
    assert html_density.main_text(page) == text


@pytest.mark.parametrize("tag", ["section", "div", "main"])
def test_the_element_of_the_article_hardly_matters(tag):
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    assert sum(html_density.main_text(p) != html_density.main_text(p.replace("<article", f"<{tag}").replace("</article", f"</{tag}")) for p in pages) <= len(pages) // 100


def test_very_long_blocks():
    text = "one very long block " * 200_000
    assert html_density.main_text(f"<nav>menu</nav><div>{text}</div>") == text.strip()
