"""Quality rules as a learned decision list.

One pass over the texts takes their statistics. Sequential covering learns from labelled
statistics: a rule grows as a conjunction of thresholds on two thirds of the rows, the condition of
largest information gain first, until it covers no good text; it is pruned on the last third by
dropping its last conditions as long as that serves; the rows it covers are removed, and the next
rule is grown, until a pruned rule is not precise enough. The list becomes one conditional
expression over the statistics, its rules in the order they were learned, so judging all documents
is a projection that Spark compiles.

Only a bounded sample of labelled statistics (``TRAIN_ROWS``) reaches the driver; texts never do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import stored, text_of

TRAIN_ROWS = 20_000  # labelled rows a list is learned from: those of the smallest hashes
LEAST_PRECISION = 0.9  # of a rule, on the rows it is pruned on and on those it grew on
LEAST_COVERED = 5  # bad texts a rule must cover to be kept
MOST_CONDITIONS = 4
HASHES = 1 << 32
LEAST_WORDS = 50  # base rule: fewer words fail
REPEATED_PERCENT = 50  # base rule: more words in repeated windows fail

SYMBOLS = "#*$%&|<>"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_distinct",
)


def _bytes_of(letters: str) -> np.ndarray:
    return np.array([ord(c) for c in letters])


_SPACES, _SYMBOLS = _bytes_of(" \t\n\x0b\x0c\r"), _bytes_of(SYMBOLS)
_UPPER, _LOWER, _DIGITS = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
_MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in SYMBOLS])


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur at least twice, the first time included."""
    first: dict[tuple[bytes, bytes, bytes], int] = {}
    marked = bytearray(len(words))
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        j = first.setdefault(window, i)
        if j != i:
            marked[i : i + 3] = marked[j : j + 3] = b"\1\1\1"
    return sum(marked)


def statistics_of(text: bytes) -> tuple[int, ...]:
    """``COUNTS`` of one UTF-8 text."""
    words = text.split()  # bytes split at space and \t to \r, nothing else
    held = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    points = len(text) - int(held[128:192].sum())
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words), points - int(held[_SPACES].sum()), int(held[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), int(held[_UPPER].sum()), int(held[_LOWER].sum()), int(held[_DIGITS].sum()), int(held[_MARKS].sum()), len(set(words)),
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        rows = np.array([statistics_of(t.as_py()) for t in texts], dtype=np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), *[pa.array(rows[:, i]) for i in range(len(COUNTS))]], names=["key", *COUNTS]
        )


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts) of every whole text; a null text counts as empty."""
    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return plain.mapInArrow(_counted, f"key {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


def features() -> dict[str, Column]:
    """Measures that rules set thresholds on, by name; all are numbers for every text."""
    share = lambda a, b: (F.col(a) if isinstance(a, str) else a) / F.greatest(F.col(b) if isinstance(b, str) else b, F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "marks_per_word": share("n_marks", "n_words"),
        "digits_per_letter": share("n_digits", "word_chars"),
        "upper_share": share("n_upper", F.col("n_upper") + F.col("n_lower")),
        "repeated_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
        "duplicate_lines": share("n_dup_lines", "n_lines"),
        "words_per_line": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool  # the value lies above the threshold, else at or below it
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.threshold if self.above else x[:, self.feature] <= self.threshold

    def text(self) -> str:
        return f"{list(features())[self.feature]} {'>' if self.above else '<='} {self.threshold!r}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a text that one of them covers is bad, any other good."""

    rules: tuple[tuple[Condition, ...], ...]

    def bad(self, x: np.ndarray) -> np.ndarray:
        return np.any([covered(rule, x) for rule in self.rules], axis=0) if self.rules else np.zeros(len(x), dtype=bool)

    def column(self) -> Column:
        """Whether a text is good, over the columns of ``statistics``."""
        measured = list(features().values())
        out = None
        for rule in self.rules:
            all_of = F.lit(True)
            for c in rule:
                all_of = all_of & (measured[c.feature] > c.threshold if c.above else measured[c.feature] <= c.threshold)
            out = F.when(all_of, False) if out is None else out.when(all_of, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def text(self) -> list[str]:
        return [" AND ".join(c.text() for c in rule) for rule in self.rules]


def covered(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    held = np.ones(len(x), dtype=bool)
    for c in rule:
        held &= c.holds(x)
    return held


def _best(x: np.ndarray, bad: np.ndarray) -> tuple[float, Condition] | None:
    """The condition of largest gain ``p (log p/(p+n) - log P/(P+N))`` over all thresholds between values."""
    total, wrong = len(bad), int(bad.sum())
    before = np.log(wrong / total)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        value, hit = x[order, f], np.cumsum(bad[order])
        cut = np.flatnonzero(value[1:] > value[:-1])
        if not len(cut):
            continue
        p_low, n_low = hit[cut], cut + 1
        for above, p, n in ((False, p_low, n_low), (True, wrong - p_low, total - n_low)):
            gain = p * (np.log(np.maximum(p, 1e-300) / n) - before)
            at = int(gain.argmax())
            if gain[at] > 1e-9 and (best is None or gain[at] > best[0]):
                low, high = float(value[cut[at]]), float(value[cut[at] + 1])
                middle = (low + high) / 2
                best = float(gain[at]), Condition(f, above, middle if low <= middle < high else low)
    return best


def _grown(x: np.ndarray, bad: np.ndarray) -> tuple[Condition, ...]:
    rule: list[Condition] = []
    while len(rule) < MOST_CONDITIONS and bad.any() and not bad.all():
        found = _best(x, bad)
        if found is None:
            break
        rule.append(found[1])
        held = found[1].holds(x)
        x, bad = x[held], bad[held]
    return tuple(rule)


def _precision(rule: tuple[Condition, ...], x: np.ndarray, bad: np.ndarray) -> float:
    held = covered(rule, x)
    return float(bad[held].mean()) if held.any() else 0.0


def _pruned(rule: tuple[Condition, ...], x: np.ndarray, bad: np.ndarray) -> tuple[Condition, ...]:
    """The beginning of ``rule`` that does best on other rows, the shortest of equals."""

    def worth(some: tuple[Condition, ...]) -> float:
        held = covered(some, x)
        p = int(bad[held].sum())
        return (2 * p - int(held.sum())) / (int(held.sum()) + 1)  # one row more than covered: few rows prove little

    return max((rule[:i] for i in range(1, len(rule) + 1)), key=lambda some: (worth(some), -len(some)))


def learned(x: np.ndarray, bad: np.ndarray, least_precision: float = LEAST_PRECISION) -> DecisionList:
    """The decision list of labelled features; rows of one class alone give an empty list."""
    third = np.arange(len(x)) % 3 == 2  # callers hand rows over in hash order
    left = np.ones(len(x), dtype=bool)
    rules: list[tuple[Condition, ...]] = []
    while True:
        grow, prune = left & ~third, left & third
        if not bad[grow].any() or bad[grow].all():
            break
        rule = _grown(x[grow], bad[grow])
        if not rule:
            break
        if bad[prune].any():
            rule = _pruned(rule, x[prune], bad[prune])
        held = covered(rule, x)
        precise = _precision(rule, x[left], bad[left]) >= least_precision
        if prune.any() and covered(rule, x[prune]).any():
            precise &= _precision(rule, x[prune], bad[prune]) >= least_precision
        if not precise or int((held & left & bad).sum()) < LEAST_COVERED:
            break
        rules.append(rule)
        left &= ~held
    return DecisionList(tuple(rules))


def fit(counted: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> DecisionList:
    """Learn from at most ``rows`` labelled rows of ``statistics``, those of the smallest hash of key and counts.

    Rows that the base rule fails are not learned from, nor are labels other than 0 and 1 or a key
    with both.
    """
    known = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).where("__key IS NOT NULL AND __label IN (0, 1)")
    known = known.groupBy("__key").agg(F.min("__label").alias("__label"), F.max("__label").alias("__high")).where("__label = __high")
    joined = counted.where(~base_failed()).join(known, F.col("key") == F.col("__key"))
    drawn = joined.select(
        F.pmod(F.xxhash64("key", *COUNTS), F.lit(HASHES)).alias("h"), "__label", *[c.alias(f"f_{n}") for n, c in features().items()]
    )
    # A cut by hash keeps about as many rows as are wanted before any are ordered.
    share = min(1.0, (rows + 8 * math.sqrt(rows) + 16) / max(drawn.count(), 1))
    drawn = drawn.where(F.col("h") < int(share * HASHES)).orderBy(*drawn.columns).limit(rows).toPandas()
    return learned(drawn[[c for c in drawn.columns if c.startswith("f_")]].to_numpy(dtype=float), drawn["__label"].to_numpy() == 0)


def judge(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS
) -> tuple[DataFrame, DecisionList]:
    """Every row of ``docs`` as (key, counts, base_failed, kept), and the list that judged it.

    A null or empty text has no word and fails the base rule; very long texts are used whole;
    repeated rows and null keys each come back; null keys take no label. Without labels, or with
    labels of one class, the list is empty and the base rule decides alone. An empty table gives
    an empty result. Other columns are not read.
    """
    counted = stored(statistics(docs, key, text), "quality-statistics")
    rules = fit(counted, labels, key, label, rows)
    judged = counted.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.column())
    return judged.withColumnRenamed("key", key), rules
