"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text: one trained on ordinary text, and one
that carries the same content followed by what is typical of toxic text, the words and beginnings of
words whose presence tells toxic from ordinary documents best (by likelihood ratio). A text is cut into windows of
words, and each window is compressed with either dictionary. The difference of the two lengths is
what the toxic dictionary saves: nothing for ordinary words, some bytes for toxic ones. Windows
are framed by padding that both dictionaries know, since the compressor does not search the last
bytes of its input and stores what it cannot shrink.

How many windows of a document save at least so many bytes, as counts and shares, goes into a
logistic model whose weights are fitted on the labelled rows; its output is the score.

Only a bounded sample of labelled rows reaches the driver. Scoring is one pass over the texts in
Arrow batches. Each task remembers window lengths it has computed, up to a fixed number.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import give_back, single_threaded, text_of, unused

TRAIN_ROWS = 8_000  # labelled rows the dictionaries and weights are fitted on
ORDINARY_BYTES = 32_768
TOXIC_PARTS = 800
LEAST_DOCUMENTS = 3
SAMPLE_BYTES = 32  # of the pieces the ordinary dictionary is trained on
SAMPLES = 60_000
LEVEL = 3
SAVED = (1, 2, 3, 4, 5, 6, 7, 8, 9)
RIDGE = 1e-2
FOLDS = 5
KEPT_WINDOWS = 250_000
LONGEST_KEPT = 64
MARKS = ".,*%&$#!|?;:\"'()"
BEGINNINGS = (4, 5, 6, 7, 8)
PADDING = np.random.default_rng(5).integers(128, 256, 48, dtype=np.uint8).tobytes()
LEAD, TRAIL = PADDING + b" ", b" " + PADDING[:24]


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    width: int


class Savings(dict):
    """Bytes the toxic dictionary saves on a window, remembered."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        super().__init__()
        self.plain, self.other = _compressor(ordinary), _compressor(toxic)

    def __missing__(self, window: bytes) -> int:
        framed = LEAD + window + TRAIL
        saved = len(self.plain(framed)) - len(self.other(framed))
        if len(window) <= LONGEST_KEPT and len(self) < KEPT_WINDOWS:
            self[window] = saved
        return saved

    def of(self, text: str, width: int) -> np.ndarray:
        words = text.encode().split()
        if width > 1:
            words = [b" ".join(words[i : i + width]) for i in range(0, len(words), width)]
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def _compressor(content: bytes):
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    made = zstandard.ZstdCompressor(
        level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    return made.compress


def _features(saved: np.ndarray) -> list[float]:
    n = len(saved)
    counts = [(saved >= s).sum() for s in SAVED]
    return [math.log1p(n), *[math.log1p(c) for c in counts], *[math.log((0.05 + c) / (n + 1)) for c in counts]]


def _ratio(toxic: int, ordinary: int, n_toxic: int, n_ordinary: int) -> float:
    """Likelihood-ratio statistic of presence; negative if the word is rather ordinary."""
    share = (toxic + ordinary) / (n_toxic + n_ordinary)

    def term(seen: int, n: int) -> float:
        out = 0.0
        if seen:
            out += seen * math.log(seen / (n * share))
        if n > seen and share < 1:
            out += (n - seen) * math.log((n - seen) / (n * (1 - share)))
        return out

    value = 2 * (term(toxic, n_toxic) + term(ordinary, n_ordinary))
    return value if toxic * n_ordinary > ordinary * n_toxic else -value


def _parts(text: str) -> set[bytes]:
    """The words of a text and how they begin, each behind the space that precedes it."""
    out = set()
    for word in {w.strip(MARKS) for w in text.split()}:
        out.update(f" {word[:n]}".encode() for n in BEGINNINGS if n < len(word))
        out.add(f" {word} ".encode())
    return out


def _typical(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Parts typical of toxic texts, the most telling first; none that chance among all parts explains."""
    seen = [Counter(), Counter()]
    for text in toxic:
        seen[0].update(_parts(text))
    known = {w for w, n in seen[0].items() if n >= LEAST_DOCUMENTS and len(w) >= 5}
    for text in ordinary:
        seen[1].update(_parts(text) & known)
    cut = 2 * math.log(len(known) + 1) + 6
    scored = [(_ratio(seen[0][w], seen[1][w], len(toxic), len(ordinary)), w) for w in known]
    chosen: list[bytes] = []
    for g, part in sorted(scored, key=lambda x: (-x[0], x[1])):
        if g <= cut:
            break
        # Of the beginnings in one family only the most telling one; whole words all.
        if part.endswith(b" ") or not any(part.startswith(c.rstrip()) or c.startswith(part) for c in chosen):
            chosen.append(part)
    return chosen[:TOXIC_PARTS]


def fit(rows: list[tuple[str, int]], width: int = 1) -> Model:
    """Dictionaries and weights from (text, label) rows; equal texts count once per label."""
    rows = sorted(set(rows))
    toxic, ordinary = [t for t, y in rows if y], [t for t, y in rows if not y]
    pieces = [p for t in ordinary for raw in [t.encode()] for p in (raw[i : i + SAMPLE_BYTES] for i in range(0, len(raw), SAMPLE_BYTES))]
    order = np.random.default_rng(0).permutation(len(pieces))[:SAMPLES]
    pieces = [pieces[i] for i in order]
    try:
        content = zstandard.train_dictionary(ORDINARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        content = b"".join(pieces)[:ORDINARY_BYTES]
    tail = b"".join(reversed(_typical(toxic, ordinary))) if toxic and ordinary else b""
    plain, other = content + PADDING, content + b" " + tail + b" " + PADDING
    savings = Savings(plain, other)
    x = np.array([_features(savings.of(t, width)) for t, _ in rows] or np.zeros((0, 1 + 2 * len(SAVED))))
    y = np.array([float(v) for _, v in rows])
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    design = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    weights = np.zeros(design.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        pull = design.T @ (y - p) - RIDGE * weights
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + RIDGE * np.eye(len(weights)), pull)
        weights += step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return Model(plain, other, mean, scale, weights, width)


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = TRAIN_ROWS) -> list[tuple[str, int]]:
    """At most ``most`` labelled (text, label) rows outside the held-out fold, by a hash of the key."""
    used = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    drawn = used.distinct().orderBy(F.md5(F.col("k").cast("string")), "k", "y").limit(most)
    rows = docs.select(F.col(key).alias("k"), text_of(text).alias("t")).join(F.broadcast(drawn), "k")  # at most ``most`` rows
    return [(r["t"], r["y"]) for r in rows.select("t", "y").collect()]


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score of 0 to 1 in a last column ``name``.

    Null and empty texts have no windows and get the score that this implies. Texts of any length
    are scored whole. Repeated rows and null keys score like any other. An empty table gives an
    empty result. Columns of the same name are replaced.
    """
    carried = [c for c in docs.columns if c != name]
    schema = docs.select(*carried).schema.add(name, "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        savings = Savings(model.ordinary, model.toxic)
        for batch in batches:
            rows = np.array([_features(savings.of(t.as_py() or "", model.width)) for t in batch.column(at)])
            z = np.column_stack([np.ones(len(rows)), (rows.reshape(len(rows), -1) - model.mean) / model.scale]) @ model.weights if len(rows) else np.zeros(0)
            found = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(found, pa.float64())], [*carried, name])
        savings.clear()
        give_back()

    # A text that is carried along anyway is not sent to the workers twice.
    if text in carried and docs.schema[text].dataType.simpleString() == "string":
        at = carried.index(text)
        return docs.select(*carried).mapInArrow(scored, schema)
    at = len(carried)
    return docs.select(*carried, text_of(text).alias(unused(carried, "__text"))).mapInArrow(scored, schema)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from a score of one half), fitted on ``labels``.

    Without labelled rows of both kinds the score is the share of toxic ones, or one half with none.
    """
    model = fit(training_rows(docs, labels, key, text, label))
    return score(docs, model, text).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
