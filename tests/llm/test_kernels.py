"""Kernels without Spark, against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import bpe, html, jaccard, mixing, rules, wavelet
from lattica.llm.common import same_spans, slices, span_hashes, text_buffer, word_spans

WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab A#|é漢\n\t\x0b\x85 ", max_size=60), st.text(max_size=20)), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words(texts):
    buf, offsets = text_buffer(pa.array(texts, pa.string()))
    starts, ends, rows = word_spans(buf, offsets)
    data = buf.tobytes()
    assert [(r, data[a:b].decode()) for a, b, r in zip(starts, ends, rows, strict=True)] == [(k, w) for k, t in enumerate(texts) for w in WORD.findall(t or "")]
    hashes = span_hashes(buf, starts, ends)
    words = [w for t in texts for w in WORD.findall(t or "")]
    assert all((x == y) == (v == w) for x, v in zip(hashes, words, strict=True) for y, w in zip(hashes, words, strict=True))


def measured(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, cover = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            cover.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "\n", " ", "é#", "|"]), max_size=60).map(" ".join)), min_size=1, max_size=6))
def test_rule_measures(texts):
    found = rules.measure_batch(pa.array(texts, pa.string()))
    assert list(zip(*(found[k].tolist() for k in rules.MEASURES[:5]), strict=True)) == [measured(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc", " ", "  ", "\n", "é", "'s", "'", "1", "23", "!", "漢", "word ", "the ", "x" * 9, "\x1c", " "]), max_size=300).map("".join))
def test_chunks_encode_as_the_whole(text):
    enc = bpe.encoder(bpe.ranks_path())
    ids = enc.encode_ordinary(text)
    assert bpe.encode(text, enc, 40, 20) == ids and bpe.decode(ids, enc) == text.encode()


def test_one_long_run_has_no_stitch():
    enc = bpe.encoder(bpe.ranks_path())
    assert bpe.chunks_of("x" * 100, 40, 20) == ["x" * 60, "x" * 60] and bpe.chunks_of("x" * 60, 40, 20) == ["x" * 60] and bpe.chunks_of("", 40, 20) == [""]
    assert bpe.stitch([0, 20], [0], "x" * 22, 20) is None
    for text in ("x" * 500, "word " * 20 + "\u088f" + " more" * 60):
        assert bpe.encode(text, enc, 40, 20) == enc.encode_ordinary(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=[*map(chr, range(1, 0x250)), *"Σς漢🙂—“́Å"], max_size=14), min_size=1, max_size=10))
def test_pieces_encode_as_the_whole(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(wavelet.tokenizer_path())
    ids, counts = wavelet.word_encoder(wavelet.tokenizer_path()).encode(*text_buffer(pa.array(texts)))
    ends = np.cumsum(counts)
    assert [ids[b - n : b].tolist() for n, b in zip(counts, ends, strict=True)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def thue_morse(n):
    """A word and its complement, which any polynomial modulo a power of two takes for one another once they are long."""
    word = "".join("ab"[k.bit_count() & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [16, 64, 1024, 2048, 65536])
def test_hashes_tell_mirrored_words_apart(n):
    x, y = thue_morse(n)
    buf, offsets = text_buffer(pa.array([f"{x} {y} {x}"]))
    starts, ends, rows = word_spans(buf, offsets)
    hashes = span_hashes(buf, starts, ends)
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]
    assert same_spans(buf, starts[:1], starts[2:], ends[:1] - starts[:1]) and not same_spans(buf, starts[:1], starts[1:2], ends[:1] - starts[:1])
    assert rules.measure_batch(pa.array([f"{x}\n{y}\n{x}"]))["n_dup_lines"].tolist() == [1]
    sets = jaccard.shingle_sets(pa.array([f"{x} {y} {x} {y} q", f"{y} {x} {y} {x} q"]))
    assert len(np.intersect1d(*sets)) == 0 and [len(s) for s in sets] == [2, 2]
    # Windows of words: the same pattern, one level up.
    words = [" ".join({"a": "one", "b": "two"}[c] for c in w[:8]) for w in (x, y)]
    a, b = jaccard.shingle_sets(pa.array(words), 8)
    assert len(np.intersect1d(a, b)) == 0


@pytest.mark.parametrize("n", [1024, 2048, 65536])
def test_mirrored_words_keep_their_own_ids(n):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(wavelet.tokenizer_path())
    texts = list(thue_morse(n))
    enc = wavelet.WordEncoder(wavelet.tokenizer_path())
    for text in texts:
        assert enc.encode(*text_buffer(pa.array([text])))[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pieces_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(wavelet, "span_hashes", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    test_pieces_encode_as_the_whole.hypothesis.inner_test(["some words", "a b some", "", "b!"])


@pytest.mark.parametrize("text", ["hello <|endoftext|> world", "a<|endoftext|>B <|startoftext|><|startoftext|>it's", "<|ENDOFTEXT|> <|endoftext|><|ENDOFTEXT|> <|endof text|>", "<|endoftext|>", "x <|endoftext|", "é漢<|startoftext|>É 12<|endoftext|>34"])
def test_special_tokens_count_as_in_the_library(text):
    from tokenizers import Tokenizer

    ids, counts = wavelet.word_encoder(wavelet.tokenizer_path()).encode(*text_buffer(pa.array([text, text + " x", "oftext|> y"])))
    whole = Tokenizer.from_file(wavelet.tokenizer_path())
    assert ids.tolist() == [i for t in (text, text + " x", "oftext|> y") for i in whole.encode(t, add_special_tokens=False).ids]


@pytest.mark.parametrize(("n", "top", "planes"), [(0, 5, 3), (1, 1, 1), (70_000, 300, 9), (600_000, 60_000, 16), (1000, 100_000, 17)])
def test_wavelet_files(n, top, planes):
    kind = "<u2" if planes <= 16 else "<u4"
    ids = np.random.default_rng(n).integers(0, top if planes > 1 else 2, n).astype(kind)
    file = wavelet.WaveletFile(wavelet.write_file(ids, [7, None], [n, 0], 11, planes))
    assert (file.ids() == ids).all() and file.before == 11 and file.doc_ids[0] == 7 and file.null_ids.tolist() == [False, True] and file.counts.tolist() == [n, 0]
    rng = random.Random(1)
    for _ in range(20 if n else 0):
        at, token = rng.randrange(n), int(ids[rng.randrange(n)])
        assert file.access(at) == ids[at]
        assert file.count(token, at) == (ids[:at] == token).sum()
        where = np.flatnonzero(ids == token)
        k = rng.randrange(len(where))
        assert file.select(token, k) == where[k]
    assert file.count(1 << planes) == 0
    with pytest.raises(IndexError):
        file.access(n)


def test_cube_keeps_tokens_and_documents():
    rng = random.Random(3)
    sizes = [rng.randrange(1, 400) for _ in range(500)]
    out = mixing.fly(sizes, [0.3] * 500, random.Random(1))
    assert sum(0 < x < 1 for x in out) <= 2
    assert abs(sum(out) - 150) < 1e-6 and abs(sum(s * x for s, x in zip(sizes, out, strict=True)) - 0.3 * sum(sizes)) < 1e-3
    landed = mixing.land(sizes, out)
    assert set(landed) <= {0.0, 1.0} and out == mixing.fly(sizes, [0.3] * 500, random.Random(1))
    assert mixing.fly([], [], rng) == [] and mixing.land([], []) == [] and mixing.fly([5], [0.5], rng) == [0.5]
    assert set(mixing.fly([4] * 40, [0.5] * 40, random.Random(2))) == {0.0, 1.0}


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_shared_lines_are_longest(a, b):
    found = sorted(html.shared_lines(a, b))
    rest = iter(b)
    assert len(found) == lcs(a, b) and all(any(a[k] == y for y in rest) for k in found)


def text_of(page):
    """What stays of a page without a pair."""
    lines = html.lines_of(page)
    alone = any(z == html.ARTICLE for z, _ in lines)
    return " ".join(t for z, t in lines if z == html.ARTICLE or z == html.BODY and not alone)


def test_pages():
    page = (
        '<html><head><title>t</title></head><body class="has-sidebar"><header>Head</header><nav>n</nav><div class="cookie-notice">We use</div><main><article><header><h1>T&eacute;</h1></header><p>a <b>b</b>c<br>d<aside>x</aside>'
        '<p>e&nbsp;f<form>q<input></form><ul><li>l1<li>l2</ul><div class="share">s</div><span class="ad">A</span>tail<script>var t="</p>";</script><section id="comments"><article>c1</article></section></article></main><div id="sidebar">S</div><footer>f</footer>'
    )
    assert text_of(page) == "Té a bc d e f l1 l2 tail"
    assert text_of("") == "" and text_of("plain &amp; simple\n text") == "plain & simple text"
    assert text_of("<div class='wrap sidebar-left'><article>in</article></div><p>out</p>") == "in"
    assert text_of("<p hidden>x</p><p style='display: none'>y</p><p>z</p>") == "z"
    assert text_of("<p>a <!-- c <p>no</p> --> b</p><") == "a b <"
    assert text_of("<article><p class='ad'>" + "<i>" * 60 + "buy<div>Body text</div></article>") == "Body text"
    assert text_of("<p>" + "<b>" * 60 + "bold<div>block</div>") == "bold block"
    assert text_of("<article><p>x <math><mi>y</mi></math> z</p><figure class='banner'>f</figure><table class='responses'><tr><td>r</td></tr></table></article>") == "x y z f r"


def test_pages_in_linear_time():
    import time

    began = time.time()
    for page in ('<a href="' * 20_000, "<b>" * 30_000 + "</i>" * 30_000 + "<p>" * 10_000, "<" * 100_000, "<!--" * 20_000):
        html.lines_of(page)
    assert time.time() - began < 10


def shingles(text, size=4):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "A", "b", "c", "É"]), max_size=12).map(" ".join)), min_size=1, max_size=6))
def test_shingles(texts):
    found, brute = jaccard.shingle_sets(pa.array(texts, pa.string())), [shingles(t) for t in texts]
    assert [len(x) for x in found] == [len(x) for x in brute]
    for x, s in zip(found, brute, strict=True):
        for y, t in zip(found, brute, strict=True):
            assert len(np.intersect1d(x, y)) == len(s & t)


def test_filters_lose_no_link():
    rng = np.random.default_rng(4)
    classes = np.zeros(1 << 16, np.uint8)
    for _ in range(400):
        n = int(rng.integers(6, 120))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.1 * rng.random()], rng.integers(0, 2**63, int(rng.integers(0, 6))).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if 100 * common < 85 * (len(x) + len(y) - common):
            continue
        heads = []
        for order in (0, 1, 2):
            ranks = [np.sort(jaccard.ranked(s, classes, order))[: jaccard.prefix_size(len(s))] for s in (x, y)]
            assert len(np.intersect1d(*ranks))
            heads.append(ranks)
        for ranks in heads[1:]:
            a, b = ((r >> np.uint64(32)).astype("<u4") for r in ranks)
            assert jaccard.order_allows(a, b, len(x), len(y), 85)
        differ = sum(int(v).bit_count() for v in (jaccard.parity(x) ^ jaccard.parity(y)).view(np.uint64))
        assert differ <= len(x) + len(y) - 2 * common


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "", "b" * 50, "c"])], names=["text"])
    parts = list(slices(batch, "text", 12))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist() and len(parts) > 1
    assert list(slices(batch.slice(0, 0), "text")) == []


def test_names_drop_nothing_else():
    for kept in ('<section id="discussion">', '<section id="related-work">', '<section id="related">', '<h2 id="discussion">', '<div class="with-sidebar">', '<div class="share-price">'):
        close = re.match(r"<(\w+)", kept)[1]
        assert text_of(f"<article>a {kept}b</{close}> c</article>") == "a b c"
    assert text_of('<article class="post has-comments">a</article>') == "a"
    assert text_of('<div class="no-comments"><article>a</article></div>') == "a"
    assert text_of('<main class="related-posts">a</main>') == "a"
    assert text_of('<div class="content has-sidebar">a</div>') == "a"
    assert text_of('<div class="page layoutWithSidebar">a</div><div class="left-sidebar">b</div><div id="comments">c<article>d</article></div>') == "a"
    assert text_of('<article>a<div class="ad">x</div><section class="comments">y</section></article>') == "a"
