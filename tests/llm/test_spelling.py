"""Spelling variants against brute force over every pair."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from evidentia.llm import spelling
from tests.llm.data import documents, empty

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute(docs, least=7, least_count=2, times=10):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UP, LOW))
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= least_count}
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= times * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def result(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


def variants(seed):
    """Texts of words with their one-letter variants, many of them anagrams, some far beyond any count limit."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("aeinrstÀéü") for _ in range(rng.randint(6, 11))) for _ in range(25)]
    base += ["e" * 20 + "n" * 17, "Zeppelin", "ünïcödéx"]
    rows = []
    for key in range(60):
        words = []
        for w in rng.choices(base, weights=[300 // (i + 1) + 1 for i in range(len(base))], k=400):
            at, kind = rng.randrange(3), rng.random()
            letter = rng.choice("aeZ")
            if kind < 0.05:
                w = w[:at] + w[at + 1 :]
            elif kind < 0.1:
                w = w[:at] + letter + w[at:]
            elif kind < 0.15:
                w = w[:at] + letter + w[at + 1 :]
            words.append(rng.choice([w, w.upper(), w + "-" + w]))
        rows.append((None if key % 13 == 0 else key, " ".join(words)))
    return rows


@pytest.mark.parametrize("part", [spelling.PART, 3])
def test_equals_brute_force(spark, part):
    rows = variants(part)
    got = result(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), part=part))
    want = brute(rows)
    assert got == want
    assert sum(1 for r in want if r[1]) > 20 and any(r[1] != r[2] for r in want if r[1])


def test_edge_rows(spark):
    docs = documents(spark)
    assert result(spelling.variants(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    assert result(spelling.variants(empty(spark))) == []


def test_very_long_words(spark):
    long = "".join(random.Random(3).choice("abcdefg") for _ in range(6_000))
    rows = [(1, f"{long} " * 20), (2, f"{long[:3_000]}x{long[3_000:]} " * 2), (3, f"{long[:-1]}z " * 2)]
    assert result(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
