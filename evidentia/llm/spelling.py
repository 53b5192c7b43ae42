"""Spelling variants by a trie of letter-group counts.

Every word becomes the vector of how often each group of letters occurs in it. Words that differ
by one inserted, deleted or replaced code point have vectors that differ by a surplus of at
most one in one group and a deficit of at most one in another. The vectors of all words form a
trie, one level a group; a search walks down it and may spend one surplus and one deficit on
its way. The words of the leaves it reaches are verified letter by letter.

The top of the trie, the word length and the first LEVELS groups, is dealt over tasks: a word lies
under its own path and is sent as a search to the few paths its budget reaches, always from the
shorter word to the longer and else from the smaller path to the larger, so two words meet under one path
only. Paths of one length share bins of about PART words; a path with more is split by a hash of
the word, and searches go to each part. Below its paths a bin walks the rest of the trie for
all its searches at once, level by level.

Only counts and the best near word leave a task, once per word and path; links are never listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import stored, text_of

LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of one group, frequent ones alone; every other letter is in one more, last group.
GROUPS = ("e", "n", "t", "a", "r", "i", "o", "s", "h", "l", "dc", "um", "gbv", "wfpkz")
LEVELS = 3  # groups of a path
BITS = 4  # of a count; longer counts are taken as the largest, which only widens a search
MOST = (1 << BITS) - 1
PART = 20_000  # words in one bin, on average
DROP_EVERY = 31
LEAST_LETTERS = 7
LEAST_COUNT = 2
FORM_TIMES = 10
SEARCHES = 8_192  # walked down the trie at once
PAIR_BYTES = 1 << 24  # verified at once

_group = np.full(256, len(GROUPS), dtype=np.uint8)
for _i, _letters in enumerate(GROUPS):
    for _letter in _letters:
        _group[ord(_letter)] = _i


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS) -> DataFrame:
    """(word): every run of letters in every text, A-Z in lower case, of at least ``least`` letters.

    Of each ``DROP_EVERY``-th run, by the checksum of key and run, one letter is deleted; a null
    key counts as empty there, a null text as without words.
    """
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"),
        F.explode(F.regexp_extract_all(text_of(text), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("run"),
    )
    runs = runs.select("k", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "k", "run").cast("binary")))
    cut = F.expr("concat(substring(run, 1, cast(h % length(run) AS int)), substring(run, cast(h % length(run) AS int) + 2))")
    words = runs.select(F.when(F.col("h") % DROP_EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least)


def vectors(words: list[bytes]) -> np.ndarray:
    """Counts of letters by group, a row per word (Latin-1 bytes)."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    letters = _group[np.frombuffer(b"".join(words), dtype=np.uint8)]
    width = len(GROUPS) + 1
    at = np.repeat(np.arange(len(words)), sizes) * width + letters
    counts = np.bincount(at, minlength=len(words) * width).reshape(len(words), width)
    return np.minimum(counts, MOST).astype(np.int64)


def _latin(column: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in column.to_pylist()]


def _path(size: np.ndarray, head: np.ndarray) -> np.ndarray:
    path = size.astype(np.int64)
    for g in range(head.shape[1]):
        path = (path << BITS) | head[:, g]
    return path


def _sent(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows a batch of words sends to paths: (path, home, more, less, same, word, n).

    ``home`` marks the word under its own path; ``more`` and ``less`` are the surplus and deficit left
    for the rest of the search; ``same`` marks a search under the word's own path.
    """
    words = _latin(batch.column("word"))
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    head = vectors(words)[:, :LEVELS]
    rows, paths, flags = [], [], []

    def send(which: np.ndarray, length: np.ndarray, to: np.ndarray, home: int, more: int, less: int, same: int) -> None:
        rows.append(np.flatnonzero(which))
        paths.append(_path(length, to)[which])
        flags.append(np.tile(np.array([[home, more, less, same]], dtype=np.int8), (len(rows[-1]), 1)))

    every = np.ones(len(words), dtype=bool)
    send(every, size, head, 1, 1, 1, 1)
    send(every, size + 1, head, 0, 1, 0, 0)
    for g in range(LEVELS):
        up = head.copy()
        up[:, g] += 1
        room = head[:, g] < MOST  # at the largest count another letter changes nothing
        send(room, size, up, 0, 0, 1, 0)
        send(room, size + 1, up, 0, 0, 0, 0)
        for h in range(g + 1, LEVELS):
            other = up.copy()
            other[:, h] -= 1
            send(room & (head[:, h] > 0), size, other, 0, 0, 0, 0)
    rows_, flags_ = np.concatenate(rows), np.concatenate(flags)
    at = pa.array(rows_)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(paths)), *[pa.array(flags_[:, i]) for i in range(4)], batch.column("word").take(at), batch.column("n").take(at)],
        names=["path", "home", "more", "less", "same", "word", "n"],
    )


class Trie:
    """The levels below some paths: ``children[l][node, count]`` is a node of the next level or -1."""

    def __init__(self, paths: np.ndarray, tails: np.ndarray):
        self.order = np.lexsort((*tails.T[::-1], paths))
        tails = tails[self.order]
        self.children = []
        self.paths, node = np.unique(paths[self.order], return_inverse=True)
        for level in range(tails.shape[1]):
            step = node * (MOST + 1) + tails[:, level]
            first = np.flatnonzero(np.diff(step, prepend=-1))
            table = np.full((node[-1] + 1) * (MOST + 1), -1, dtype=np.int32)
            table[step[first]] = np.arange(len(first))
            self.children.append(table)
            node = np.repeat(np.arange(len(first)), np.diff(first, append=len(step)))
        self.start = np.flatnonzero(np.diff(node, prepend=-1))
        self.stop = np.append(self.start[1:], len(node))

    def leaves(self, paths: np.ndarray, tails: np.ndarray, more: np.ndarray, less: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(search, leaf) for every leaf a search reaches within its surplus and deficit."""
        root = np.minimum(np.searchsorted(self.paths, paths), len(self.paths) - 1)
        search = np.flatnonzero(self.paths[root] == paths)
        node, more, less = root[search], more[search], less[search]
        for level, table in enumerate(self.children):
            count = tails[search, level]
            at = node * (MOST + 1) + count
            up = np.flatnonzero((more > 0) & (count < MOST))
            down = np.flatnonzero((less > 0) & (count > 0))
            to = np.concatenate([table[at], table[at[up] + 1], table[at[down] - 1]])
            found = np.flatnonzero(to >= 0)
            who = np.concatenate([np.arange(len(at)), up, down])[found]
            spent = np.concatenate([np.zeros(len(at), np.int8), np.ones(len(up), np.int8), np.full(len(down), 2, np.int8)])[found]
            search, node = search[who], to[found].astype(np.int64)
            more, less = more[who] - (spent == 1), less[who] - (spent == 2)
        return search, node


def _letters(words: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)


def _one_apart(short: np.ndarray, long: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Whether rows of padded letters differ by one replaced letter, or by one inserted where ``longer``."""
    differs = short != long
    near = differs.sum(axis=1) == 1
    if longer.any():
        a, b = short[longer], long[longer]
        first = differs[longer].argmax(axis=1)
        # Behind the inserted letter all others are moved by one.
        moved = a[:, :-1] != b[:, 1:]
        last = np.where(moved.any(axis=1), moved.shape[1] - 1 - moved[:, ::-1].argmax(axis=1), -1)
        near[longer] = last < first
    return near


def _near(rows: pa.Table) -> pa.Table:
    """Of all words in one bin: how many near words each meets there, and the best of them."""
    none = pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "near": pa.array([], pa.int64()),
                     "form_n": pa.array([], pa.int64()), "form": pa.array([], pa.string())})
    home = rows.column("home").to_numpy().astype(bool)
    if not home.any():
        return none
    text = np.array(rows.column("word").to_pylist(), dtype=object)
    words = [w.encode("latin-1") for w in text]
    n = rows.column("n").to_numpy()
    same = rows.column("same").to_numpy().astype(bool)
    tails = vectors(words)[:, LEVELS:]
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    width = int(size[home].max())
    letters = _letters(words, width)
    here = np.flatnonzero(home)
    paths = rows.column("path").to_numpy()
    trie = Trie(paths[here], tails[here])
    entries = here[trie.order]
    # Places in the order of words, and in the order of preference: largest count, then smallest word.
    place = np.empty(len(words), dtype=np.int64)
    by_word = np.array(sorted(range(len(words)), key=words.__getitem__))
    place[by_word] = np.arange(len(words))
    by_count = np.lexsort((place, -n))
    rank = np.empty(len(words), dtype=np.int64)
    rank[by_count] = np.arange(len(words))

    near = np.zeros(len(words), dtype=np.int64)
    best = np.full(len(words), len(words), dtype=np.int64)
    more, less = rows.column("more").to_numpy(), rows.column("less").to_numpy()
    slice_rows = max(1, PAIR_BYTES // width)
    for at in range(0, len(words), SEARCHES):
        part = slice(at, at + SEARCHES)
        search, leaf = trie.leaves(paths[part], tails[part], more[part], less[part])
        search += at
        held = trie.stop[leaf] - trie.start[leaf]
        ends = np.cumsum(held)
        total = int(ends[-1]) if len(ends) else 0
        for low in range(0, total, slice_rows):
            pair = np.arange(low, min(low + slice_rows, total))
            hit = np.searchsorted(ends, pair, side="right")
            q = search[hit]
            e = entries[trie.start[leaf[hit]] + pair - (ends[hit] - held[hit])]
            wanted = ~same[q] | (place[q] < place[e])  # words of one path meet once
            q, e = q[wanted], e[wanted]
            ok = _one_apart(letters[q], letters[e], size[q] < size[e])
            q, e = q[ok], e[ok]
            near += np.bincount(q, minlength=len(words)) + np.bincount(e, minlength=len(words))
            np.minimum.at(best, q, rank[e])
            np.minimum.at(best, e, rank[q])
    met = np.flatnonzero(near)
    if not len(met):
        return none
    form = by_count[best[met]]
    return pa.table({
        "word": pa.array(text[met], pa.string()), "n": pa.array(n[met]), "near": pa.array(near[met]),
        "form_n": pa.array(n[form]), "form": pa.array(text[form], pa.string()),
    })


def near_words(words: DataFrame, part: int = PART) -> DataFrame:
    """(word, n, n_near, best, best_n) for distinct ``words`` (word, n): near words and the one of largest n."""
    schema = "path long, home byte, more byte, less byte, same byte, word string, n long"
    sent = stored(words.select("word", "n").mapInArrow(lambda batches: map(_sent, batches), schema), "spelling-sent")
    held = sent.where("home = 1").groupBy("path").agg(F.count(F.lit(1)).alias("held"))
    crowded = held.where(F.col("held") > part).select("path", F.ceil(F.col("held") / part).cast("int").alias("parts"))
    size = F.shiftright("path", BITS * LEVELS)
    bins = held.groupBy(size.alias("size")).agg(F.ceil(F.sum("held") / part).cast("bigint").alias("bins"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = sent.join(crowded, "path", "left").withColumn("own", F.pmod(F.xxhash64("word"), parts.cast("bigint")).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    # A word is at home in its own part and searches in all of them.
    dealt = dealt.withColumn("home", F.when(F.col("own") == F.col("part"), F.col("home")).otherwise(F.lit(0)).cast("byte"))
    dealt = dealt.withColumn("size", size).join(bins, "size")  # lengths that no word has drop out
    # In one bin all lengths are equal, so the head's counts and the part tell its paths apart.
    branch = F.col("path").bitwiseAND((1 << BITS * LEVELS) - 1) + F.shiftleft(F.col("part").cast("bigint"), BITS * LEVELS)
    dealt = dealt.withColumn("path", branch).withColumn("bin", F.pmod(F.xxhash64("path"), F.col("bins")))
    met = dealt.select("size", "bin", "path", "home", "more", "less", "same", "word", "n").groupBy("size", "bin").applyInArrow(
        _near, "word string, n long, near long, form_n long, form string"
    )
    zero = words.select("word", "n", F.lit(0).cast("bigint").alias("near"), F.lit(None).cast("bigint").alias("form_n"), F.lit(None).cast("string").alias("form"))
    first = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form"))))
    out = zero.unionAll(met).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), first.alias("b"))
    return out.select("word", "n", "n_near", F.col("b.form").alias("best"), (-F.col("b.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the last word that following forms leads to.

    Counts grow tenfold with every step, so chains are short; each round doubles the step.
    """
    step = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = step.join(ahead, "root", "left")
        after = stored(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        step = after.select("word", "root")


def variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT, times: int = FORM_TIMES, part: int = PART,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of at least ``least`` letters and ``least_count`` occurrences.

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its
    near word of largest count (ties: smallest in code-point order) if that is at least ``times``
    its own count, else null; its root is the last word that following forms leads to, itself if
    it has none. Null and empty texts hold no word; very long texts and words are used whole;
    repeated rows count each time; a null key counts as empty in the checksum that picks letters to delete. An
    empty table gives an empty result. Other columns are not read.
    """
    words = occurrences(docs, key, text, least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = stored(words.where(F.col("n") >= least_count), "spelling-words")
    met = near_words(words, part)
    has = F.col("best_n") >= times * F.col("n")
    named = stored(
        met.select("word", "n", "n_near", F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "spelling-forms"
    )
    root = roots(named.where("form IS NOT NULL"))
    return named.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
