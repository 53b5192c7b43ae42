"""The numpy parts against plain Python."""

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from evidentia.llm import cutting, html_text, near_dedup, nearest_tiles, packing, secrets, shingles, suffixes, toxicity
from evidentia.llm.line_templates import lines
from tests.llm.data import prose


def _blocks(texts):
    return [(at, *shingles.words(d, o), d, o) for at, d, o in shingles.blocks(pa.array(texts))]


def test_word_hashes_are_those_of_words():
    texts = [prose(i, 50) for i in range(20)] + ["", " ", "a", "a\tb\x0bc\r\nd  e", "é ü x"]
    (_, value, first, _, _, _), = _blocks(texts)
    want = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    seen = {}
    assert len(value) == len(want)
    assert all(seen.setdefault(w, h) == h for w, h in zip(want, value.tolist())) and len(set(seen.values())) == len(seen)
    assert np.diff(first).tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]


def test_a_text_longer_than_a_block_is_whole():
    text = "word " * 600_000
    (_, value, _, _, _, _), = _blocks([text])
    assert len(value) == 600_000 and len(set(value.tolist())) == 1


def test_bags_count_occurrences():
    def bag(t):
        (_, d, o), = shingles.blocks(pa.array([t]))
        w, f, _ = shingles.words(d, o)
        return shingles.counted(*shingles.shingles(w, f))

    assert len(set(bag("a b c d e a b c d e a b c d e").tolist())) == 11
    assert bag("a b c").tolist() == bag(" a  b\nc ").tolist() != bag("a b d").tolist()
    assert len(bag("")) == 1


def test_signatures_agree_as_often_as_texts_are_alike():
    rng = random.Random(0)
    base = prose(9, 400).split()
    texts = []
    for share in (0.0, 0.01, 0.05, 0.2):
        texts.append(" ".join(w if rng.random() > share else f"new{rng.random()}" for w in base))
    (_, d, o), = shingles.blocks(pa.array(texts))
    w, f, _ = shingles.words(d, o)
    s, f = shingles.shingles(w, f)
    e = shingles.counted(s, f)
    sig = near_dedup.signatures(e, f, 2000)
    for i in range(1, 4):
        a, b = (np.sort(e[f[k] : f[k + 1]]) for k in (0, i))
        assert (sig[0] == sig[i]).mean() == pytest.approx(near_dedup.similarity(a, b), abs=0.04)
    one = near_dedup.signatures(e[f[2] : f[3]], np.array([0, f[3] - f[2]]), 2000)
    assert (one[0] == sig[2]).all()  # alone or among others


def test_suffix_arrays_find_owners():
    rng = np.random.default_rng(1)
    for _ in range(60):
        length, letters = int(rng.integers(3, 12)), int(rng.integers(1, 4))
        pieces = [bytes(rng.integers(0, letters, int(rng.integers(length, length + 20))).astype(np.uint8)) for _ in range(int(rng.integers(1, 25)))]
        owner = rng.integers(0, 10, len(pieces))
        least = {}
        for p, o in zip(pieces, owner):
            for i in range(len(p) - length + 1):
                least[p[i : i + length]] = min(least.get(p[i : i + length], 99), o)
        want = [least[p[i : i + length]] for p in pieces for i in range(len(p) - length + 1)]
        for part in (10, 60, 1 << 20):
            assert suffixes.least_owner(pieces, owner, length, part).tolist() == want


def test_suffixes_are_sorted_as_numbers(monkeypatch):
    """Places used to be sorted by key in every round, which took most of the time of a shard."""
    rng = np.random.default_rng(3)
    sorted_places = []
    argsort = np.argsort
    monkeypatch.setattr(suffixes.np, "argsort", lambda key, *a, **b: sorted_places.append(len(key)) or argsort(key, *a, **b))
    for letters, size in itertools.product((1, 2, 60, 256), (1, 2, 5, 9, 3_000)):
        data = np.tile(rng.integers(0, letters, size, dtype=np.uint8), 3)
        order, rank = suffixes.suffix_array(data)
        text = data.tobytes()
        assert order.tolist() == sorted(range(len(data)), key=lambda i: text[i:]) and (rank[order] == np.arange(len(data))).all()
    assert not sorted_places
    key = rng.integers(0, 1 << 60, 500, dtype=np.uint64) >> np.uint64(54)
    within, found = suffixes._in_order(key << np.uint64(57), 63)  # too wide to carry a place
    assert sorted_places and (found >> np.uint64(57) == np.sort(key)).all() and sorted(within.tolist()) == list(range(500))


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    for letters in (1, 2, 5):
        data = rng.integers(0, letters, 300).astype(np.uint8)
        order, rank = suffixes.suffix_array(data)
        raw = data.tobytes()
        assert order.tolist() == sorted(range(300), key=lambda i: raw[i:]) and (rank[order] == np.arange(300)).all()


def test_column_generation_meets_demand_with_few_patterns():
    rng = np.random.default_rng(3)
    for n in (1, 7, 300, 40_000):
        sizes = np.clip(rng.lognormal(3.3, 1, n).astype(int) + 1, 1, 256)
        counts = {int(s): int(c) for s, c in zip(*np.unique(sizes, return_counts=True))}
        found = cutting.patterns(counts, 256)
        made = collections.Counter()
        for items, times in found:
            assert sum(s * k for s, k in items.items()) <= 256
            for s, k in items.items():
                made[s] += k * times
        assert all(made[s] >= c for s, c in counts.items())
        bound = -(-int(sizes.sum()) // 256)
        large = sum(sizes > 128)
        assert sum(t for _, t in found) <= max(bound, large) * 1.02 + 3
    assert cutting.patterns({}, 10) == []
    with pytest.raises(ValueError):
        cutting.patterns({11: 1}, 10)


def test_word_ids_are_the_tokenizers_own():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    whole, words = Tokenizer.from_file(path), packing.WordIds(path)
    texts = [
        "", " ", "Hello, World's they'll 'tis 12345 a1b2", "Straße ÉÈÇ İstanbul ΣΑΣ ǅ ﬁ", "tabs\tand\x0bbreaks\r\n x y\x1cz",
        "é combining ́start", "<|endoftext|> in<|startoftext|>side <|", "日本語 テスト 한국어", "x" * 300, "a\x00b ‍ zero",
        prose(1, 200), "!!??** -- __ ''s 'S",
    ]
    for t in texts:
        assert np.frombuffer(words.text(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_pages():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header>
    <nav><ul><li><a href=/a>a</a><li><a href=/b>b</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <div id=content><h1>Head&amp;line</h1><p>First   long paragraph of the article with many words in it,<br>
    broken once.<p>Second one &lt;b&gt; with <a href=x>a link</a> and more words that say things.
    <div class="comments"><p>A reader says that this is a long comment with many many words in it.</p></div>
    <form><input value=x><button>Send</button></form></div>
    <aside>Side</aside><footer>&copy; me</footer><script>var t="</p>";</script></body></html>"""
    assert html_text.main_text(page) == (
        "Head&line First long paragraph of the article with many words in it, broken once. "
        "Second one <b> with a link and more words that say things."
    )
    for odd in (None, "", "<", "<p", "plain text", "<div>" * 5000 + "deep", "</p></div>", "<!-- only -->", "<article></article>"):
        assert isinstance(html_text.main_text(odd), str)
    assert html_text.main_text("plain &eacute; text") == "plain é text"
    assert html_text.main_text("<article>" + "<p>w</p>" * 20_000 + "</article>").count("w") == 20_000


def test_names_drop_no_part_of_an_article():
    words = "Plain words of the article that say quite a lot of things about it."
    article = f"<article><h2 id=legal>Head</h2><section id='related-work'><p>{words}</p></section><p class='navy'>{words}</p><div class='notice-period'>{words}</div></article>"
    whole = f"Head {words} {words} {words}"
    for around in ("layout has-sidebar", "no-sidebar", "sidebar", "modal", "page"):
        assert html_text.main_text(f"<body><div class='{around}'>{article}</div><div class='sidebar-left'>{words}</div></body>") == whole
    assert html_text.main_text(f"<body><div class='overlay'><p>{words}</p><p>{words}</p></div><ul class=nav><li>Home</ul></body>") == f"{words} {words}"
    replies = f"<div id=comments class='comment-list'><article><p>{words}</p></article>" + f"<p>{words}</p>" * 9 + "</div>"
    assert html_text.main_text(f"<body>{article}{replies}</body>") == whole
    for name in ("ad", "ads", "cookie-notice", "main-nav", "related", "site-footer", "share-buttons", "ad-1"):
        assert html_text.main_text(f"<body><article><p>{words}</p><div class='x {name}'>Other.</div></article></body>") == words


def test_tiles_keep_every_near_pair():
    rng = np.random.default_rng(5)
    q, c = rng.normal(size=(7, 12)), np.round(rng.normal(size=(300, 12)), 1)
    c[50:80] = c[50]
    ids, query_ids = np.arange(300), np.arange(1000, 1007)
    at_q, at_c, far = nearest_tiles.tile(q, query_ids, c, ids, 5)
    exact = np.sqrt(((q[:, None] - c[None]) ** 2).sum(axis=2))
    for i in range(7):
        want = np.lexsort((ids, exact[i]))[:5]
        mine = at_c[at_q == i]
        assert set(want) <= set(mine) and len(mine) < 150
        assert far[at_q == i] == pytest.approx(exact[i][mine])


def test_thresholds_follow_the_classes():
    even = {b: 100 for b in range(secrets.BINS)}
    low = {0: 5000, **{b: 100 for b in range(1, secrets.BINS)}}
    got = secrets.thresholds({"even": even, "low": low, "none": {0: 10}})
    assert got["even"] == 0.0 and got["low"] == pytest.approx(0.05) and "none" not in got


def test_compression_tells_a_typical_word():
    rows = [(prose(i, 60) + (" dreadful" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(240)]
    model = toxicity.fit(rows)
    savings = toxicity.Savings(model.ordinary, model.toxic)
    assert savings[b"dreadful"] >= 4 > savings[b"thering"]
    assert toxicity.fit([]).weights.tolist() == [0.0] * 20


def test_lines_and_shapes():
    text = "one two three four five\n\nshort\nitem 17 of the list 9 here\nitem 18 of the list 3 here\none two three four five"
    (_, d, o), = shingles.blocks(pa.array([text]))
    found = lines(d, o)
    assert found["number"].tolist() == [0, 3, 4, 5] and found["size"].tolist() == [5, 7, 7, 5]
    shape = found["shape"].tolist()
    assert shape[0] == shape[3] and shape[1] == shape[2] != shape[0]
