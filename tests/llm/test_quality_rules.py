"""Quality rules: counts against brute force, the list against plain Python, held-out accuracy."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from evidentia.llm import quality_rules
from evidentia.llm.queries import op12_quality_rules
from tests.llm.data import documents, empty, prose
from tests.llm.queries_data import SF, has_tables

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        sum(line in lines[:i] for i, line in enumerate(lines)), len(again),
    )


def failed(counts):
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def junk(seed, n):
    return " ".join(w + "###" for w in prose(seed, n).split())


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, n_words string")


def test_counts_of_awkward_texts():
    rng = random.Random(1)
    texts = ["", " \n\t", "a", "a b a b a b", "x\n\nx\n x\nx ", "é ü ñ\x85b #|<>", " a b\x1cc", "same line\n" * 30]
    texts += ["".join(rng.choice("ab \n#é|") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    for text in texts:
        assert quality_rules.statistics_of(text.encode())[:5] == brute(text), text


def test_edge_rows(spark):
    docs = documents(spark)
    judged, rules = quality_rules.judge(docs, labels(spark, [(1, 1, 0, "x"), (None, 0, 0, "x")]))
    assert rules.rules == ()
    got = sorted((tuple(r) for r in judged.select("doc_id", *BASE, "base_failed", "kept").collect()), key=str)
    want = [(r.doc_id, *brute(r.text)) for r in docs.collect()]
    assert got == sorted(((*w, failed(w[1:]), not failed(w[1:])) for w in want), key=str)


def test_empty_tables(spark):
    judged, rules = quality_rules.judge(empty(spark), labels(spark, []))
    assert judged.collect() == [] and rules.rules == ()


def test_learns_planted_junk_and_emits_the_same_verdicts(spark):
    rows = [(i, junk(i, 90) if i % 4 == 0 else prose(i, 90)) for i in range(400)]
    rows += [(i, prose(i, 90).upper() if i % 3 == 0 else prose(i, 90)) for i in range(400, 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bad = {i for i, _ in rows if (i < 400 and i % 4 == 0) or (i >= 400 and i % 3 == 0)}
    marks = [(i, int(i not in bad), 0, "") for i, _ in rows if i % 2] + [(i, int(i not in bad), 0, "") for i in range(0, 400, 4)]
    marks += [(7, 0, 0, ""), (9, None, 0, ""), (None, 0, 0, ""), (11, 5, 0, "")]
    judged, rules = quality_rules.judge(docs, labels(spark, marks))
    rejected = {r.doc_id for r in judged.where("NOT kept").collect()}
    assert rejected == bad and 1 <= len(rules.rules) <= 3
    # The conditional expression says what the rules say.
    table = judged.select("kept", *[c.alias(n) for n, c in quality_rules.features().items()]).toPandas()
    assert (rules.bad(table[list(quality_rules.features())].to_numpy()) == ~table["kept"].to_numpy()).all()


def test_list_is_ordered_and_pruned():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality_rules.features())))
    bad = ((x[:, 0] > 0.7) & (x[:, 1] <= 0.4)) | (x[:, 2] > 0.95)
    found = quality_rules.learned(x, bad)
    assert len(found.rules) >= 2 and (found.bad(x) == bad).mean() > 0.97
    noise = rng.random(3000) < 0.3
    assert quality_rules.learned(x, noise).rules == ()
    assert quality_rules.learned(x[:0], bad[:0]).rules == () and quality_rules.learned(x, np.ones(3000, bool)).rules == ()


@pytest.mark.skipif(not has_tables(), reason="no test tables here")
def test_held_out_accuracy(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged, rules = quality_rules.judge(docs, marks.where("doc_id % 5 <> 0"))
    held = judged.where("NOT base_failed").join(marks.where("doc_id % 5 = 0"), "doc_id").select("kept", "quality").toPandas()
    good, wrong = held[held.quality == 1], held[held.quality == 0]
    assert good.kept.mean() > 0.995 and (~wrong.kept).mean() > 0.9, rules.text()


@pytest.mark.skipif(not has_tables(), reason="no test tables here")
def test_query_equals_brute_force(spark):
    rows = op12_quality_rules(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        counts = brute(texts[r.doc_id])
        assert tuple(r[1:6]) == counts and r.base_failed == failed(counts) and not (r.base_failed and r.kept)
