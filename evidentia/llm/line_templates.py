"""Line dedup by a log-template tree.

A line's path in the tree has a fixed depth: the number of its tokens, then its leading tokens,
with tokens that hold a digit read as a variable. Lines of one leaf generalise position by
position: a token that enough documents of the leaf have in that place is part of the
template, any other is a variable field. Enough is judged at ``least`` documents and at every
doubling of it, up to the size of the leaf: in a large leaf each value of a variable field has many
documents, but far fewer than the constant tokens beside it, so some level tells them apart whatever
the size of the table. A line has one template per level that changes it. What results does not
depend on the order of lines, so leaves need not be worked through by one task: counts per (leaf,
position, token) and per template are aggregations that combine before they shuffle, however often
a line occurs.

A template recurs for a line if as many documents have it as the lowest level that gives it asks
for, and enough of its tokens are constant. The first document keeps its lines; in the others
they are dropped.

Lines too short for a template and lines too long to recur by chance count verbatim: a long one
recurs in two documents, a short one in more the fewer tokens it has.

One pass over the texts reads leaves and verbatim lines. Leaves that enough documents reach set bits of a
sieve of fixed size, and a second pass sends the tokens of the lines that pass it; a line that
passes by chance recurs nowhere and changes nothing. Texts are not shuffled for this. The last pass takes the lines out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import give_back, stored, text_of, unused
from evidentia.llm.shingles import U, blocks, mixed, powers, words

DEPTH = 3  # leading tokens of a path
LEAST_DOCUMENTS = 3
LEAST_TOKENS = 5
LONG_TOKENS = 50  # a line of as many tokens recurs verbatim in two documents
SHORT_DOCUMENTS = 2  # documents a short line needs beyond the least for each token it lacks
SIEVE_BITS = 1 << 27  # lines of leaves that fall on no set bit send no tokens; others may, to no effect
CONSTANT = 0.6  # share of a template's tokens that must be constant
VARIABLE = U(0x5851F42D4C957F2D)


def lines(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH, least_tokens: int = LEAST_TOKENS) -> dict[str, np.ndarray]:
    """Long enough lines of a block of texts: text, number in it, leaf, shape, and where their tokens lie.

    ``shape`` is the hash of all tokens, variables as one; equal lines have equal shapes. ``exact``
    is the hash of all tokens as they are.
    """
    word, first, start = words(data, offsets)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    breaks = np.flatnonzero(data == 10)
    number = np.searchsorted(breaks, start) - np.searchsorted(breaks, offsets[:-1])[text]
    digit = ((data >= 48) & (data <= 57)).astype(np.int64)
    token = np.where(np.add.reduceat(digit, start) > 0, VARIABLE, word) if len(word) else word
    fresh = np.ones(len(token), dtype=bool)
    fresh[1:] = (text[1:] != text[:-1]) | (number[1:] != number[:-1])
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(token)))
    place = np.arange(len(token)) - np.repeat(begin, size)
    weight = powers(int(size.max(initial=0)) + 1)[place]
    whole, exact = (np.add.reduceat(x * weight, begin) if len(x) else x for x in (token, word))
    long = size >= least_tokens
    begin, size = begin[long], size[long]
    leaf = size.astype(np.uint64)
    for j in range(depth):
        leaf = mixed(leaf + token[begin + np.minimum(j, size - 1)])
    return {
        "text": text[begin], "number": number[begin], "leaf": leaf.view(np.int64), "shape": mixed(whole[long]).view(np.int64),
        "exact": mixed(exact[long]).view(np.int64), "begin": begin, "size": size, "token": token.view(np.int64),
    }


def _paired(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One hash for a text's number in its block and a value."""
    with np.errstate(over="ignore"):
        return mixed(value.view(U) ^ mixed(text.astype(U) + U(1)))


def _once(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places of the first of equal (text, value) pairs."""
    return np.sort(np.unique(_paired(text, value), return_index=True)[1])


def _read(
    batches: Iterator[pa.RecordBatch], least: int, depth: int, least_tokens: int, long_tokens: int, kinds: tuple[str, ...]
) -> Iterator[pa.RecordBatch]:
    """doc, text -> (doc, need, value): leaves (need 0) and the lines that count as they are, once per document."""
    for batch in batches:
        for at, data, offsets in blocks(batch.column(1)):
            found = lines(data, offsets, depth, 1)
            size, text = found["size"], found["text"]
            parts = []
            if "template" in kinds:
                long = np.flatnonzero(size >= max(least_tokens, depth))
                long = long[_once(text[long], found["leaf"][long])]
                parts.append((text[long], np.zeros(len(long), np.int64), found["leaf"][long]))
            short, long = (size < least_tokens) & ("short" in kinds), (size >= long_tokens) & ("long" in kinds)
            need = np.where(long, 2, least + SHORT_DOCUMENTS * (least_tokens - size))
            exact = np.flatnonzero(short | long)
            exact = exact[_once(text[exact], found["exact"][exact])]
            parts.append((text[exact], need[exact], found["exact"][exact]))
            which, needs, values = (np.concatenate(c) for c in zip(*parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which + at)), pa.array(needs, pa.int64()), pa.array(values, pa.int64())], ["doc", "need", "value"]
            )
    give_back()


def _sieve(common: DataFrame) -> np.ndarray:
    """A fixed number of bits, set where a common leaf falls: at most 2 MB of words reach the driver
    as 32 MB of rows, whatever the number of leaves."""
    bit = F.col("value").bitwiseAND(SIEVE_BITS - 1)
    words = common.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(63).cast("int"))).alias("bits"))
    held = words.toArrow()
    out = np.zeros(SIEVE_BITS >> 6, dtype=np.int64)
    out[held.column("word").to_numpy()] = held.column("bits").to_numpy()
    return out


def _picked(batches: Iterator[pa.RecordBatch], sieve: np.ndarray, depth: int, least_tokens: int) -> Iterator[pa.RecordBatch]:
    """doc, text -> (doc, leaf, shape, tokens) of the lines that pass the sieve, once per document and shape."""
    for batch in batches:
        for at, data, offsets in blocks(batch.column(1)):
            found = lines(data, offsets, depth, max(least_tokens, depth))
            bit = found["leaf"] & (SIEVE_BITS - 1)
            keep = np.flatnonzero((sieve[bit >> 6] >> (bit & 63)) & 1)
            keep = keep[_once(found["text"][keep], found["shape"][keep])]
            size = found["size"][keep]
            ends = np.concatenate([[0], np.cumsum(size)])
            at_token = np.arange(ends[-1]) - np.repeat(ends[:-1], size) + np.repeat(found["begin"][keep], size)
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found["token"][at_token], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(found["text"][keep] + at)), pa.array(found["leaf"][keep], pa.int64()),
                    pa.array(found["shape"][keep], pa.int64()), tokens,
                ],
                ["doc", "leaf", "shape", "tokens"],
            )
    give_back()


def _without(texts: pa.Array, hashes: pa.Array, least_tokens: int) -> list[tuple[str, int]]:
    """Each text without its lines of its list of shapes or exact hashes, and their number."""
    out = []
    for at, data, offsets in blocks(texts):
        found = lines(data, offsets, 0, 1)
        some = hashes.slice(at, len(offsets) - 1)
        wanted = _paired(np.repeat(np.arange(len(some)), some.value_lengths().to_numpy()), some.flatten().to_numpy())
        gone = np.isin(_paired(found["text"], found["shape"]), wanted) & (found["size"] >= least_tokens)
        gone = np.flatnonzero(gone | np.isin(_paired(found["text"], found["exact"]), wanted))
        bounds = np.searchsorted(found["text"][gone], np.arange(len(some) + 1))
        for d in range(len(some)):
            drop = set(found["number"][gone[bounds[d] : bounds[d + 1]]].tolist())
            kept = texts[at + d].as_py()
            out.append(("\n".join(x for i, x in enumerate(kept.split("\n")) if i not in drop) if drop else kept, len(drop)))
    return out


def templates(picked: DataFrame, least: int, constant: float) -> DataFrame:
    """(shape, template, need) of lines whose template is constant enough, from (doc, leaf, shape, tokens).

    ``need`` is the number of documents at which the template recurs for the shape. Templates that
    cannot reach it are left out.
    """
    shapes = stored(picked.groupBy("leaf", "shape").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "line-shapes")
    each = shapes.select("leaf", "shape", "n", F.posexplode("tokens").alias("at", "token"))
    fixed = each.where(F.col("token") != F.lit(int(VARIABLE.view(np.int64)))).groupBy("leaf", "at", "token").agg(F.sum("n").alias("seen"))
    # The highest doubling of ``least`` that a token reaches: as many as the quotient has binary digits, less one.
    level = F.length(F.bin(F.floor(F.col("seen") / least))) - 1
    fixed = fixed.where(F.col("seen") >= least).select("leaf", "at", "token", level.alias("level"))
    marked = each.join(fixed, ["leaf", "at", "token"], "left").select(
        "leaf", "shape", "n", F.struct("at", "token", F.coalesce("level", F.lit(-1)).alias("level")).alias("t")
    )
    built = marked.groupBy("leaf", "shape").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("t")).alias("t"))
    changes = F.array_distinct(F.concat(F.array(F.lit(0)), F.transform("t.level", lambda v: v + 1)))
    built = built.select("leaf", "shape", "n", "t", F.explode(changes).alias("from"))
    body = F.transform("t", lambda x: F.when(x["level"] >= F.col("from"), x["token"].cast("string")).otherwise(F.lit("*")))
    constants = F.size(F.filter("t", lambda x: x["level"] >= F.col("from")))
    built = built.where(constants >= F.size("t") * F.lit(constant)).select(
        "shape", "n", F.xxhash64("leaf", F.concat_ws(" ", body)).alias("template"), (F.lit(least) * F.pow(2, "from")).cast("long").alias("need")
    )
    built = stored(built, "line-levels")
    most = built.groupBy("template").agg(F.sum("n").alias("most"))
    return built.join(most, "template").where("most >= need").select("shape", "template", "need")


def drop_recurring(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_DOCUMENTS, depth: int = DEPTH,
    least_tokens: int = LEAST_TOKENS, constant: float = CONSTANT, long_tokens: int = LONG_TOKENS,
    kinds: tuple[str, ...] = ("template", "short", "long"),
) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and ``n_lines`` and ``n_dropped`` added.

    A template recurs if at least ``least`` documents have it, or more where only a higher level
    gives it. Lines of ``long_tokens`` tokens recur verbatim in two documents. Lines of fewer than
    ``least_tokens`` recur by chance: they count verbatim, in ``SHORT_DOCUMENTS`` more documents for
    every token they lack. ``kinds`` names the rules that hold. The document with the smallest key (nulls last) keeps its lines. Null texts count as empty and stay null; an empty
    text has one empty line. Very long texts are read whole. Rows that repeat both key and text
    are one document and fare alike. An empty table gives an empty result. Other columns come
    back unchanged, whatever their names; columns named as the added ones are replaced.
    """
    carried = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    doc, lost = unused(carried, "__doc"), unused(carried, "__gone")
    marked = docs.select(
        *carried,
        F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.col(key).cast("string"), F.lit("null")), text_of(text)))).alias(doc),
    )
    plain = marked.select(F.col(doc).alias("doc"), text_of(text).alias("text"))
    read = stored(
        plain.mapInArrow(lambda b: _read(b, least, depth, least_tokens, long_tokens, kinds), "doc binary, need long, value long"), "line-read"
    )
    parts = []
    if "template" in kinds:
        common = read.where("need = 0").groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        sieve = docs.sparkSession.sparkContext.broadcast(_sieve(common))
        picked = plain.mapInArrow(
            lambda b: _picked(b, sieve.value, depth, least_tokens), "doc binary, leaf long, shape long, tokens array<long>"
        )
        picked = stored(picked, "line-picked")
        parts.append(picked.select("doc", "shape").distinct().join(templates(picked, least, constant), "shape").select("doc", "shape", "template", "need"))
    if {"short", "long"} & set(kinds):
        exact = read.where("need > 0").select("doc", F.col("value").alias("exact"), "need").distinct()
        again = exact.groupBy("exact").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("least")).where("n >= least").select("exact")
        parts.append(exact.join(again, "exact").select("doc", F.col("exact").alias("shape"), F.col("exact").alias("template"), "need"))
    ours = reduce(DataFrame.unionAll, parts)
    keys = marked.select(F.col(doc).alias("doc"), F.col(key).isNull().alias("none"), F.col(key).alias("key")).distinct()
    ours = stored(ours.join(keys, "doc"), "line-templates")
    recurring = ours.select("template", "doc", "none", "key").distinct().groupBy("template").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("none", "key", "doc")).alias("first")
    )
    recurring = recurring.where("n >= 2").select("template", "n", F.col("first.doc").alias("first"))
    gone = ours.join(recurring, "template").where("n >= need AND doc <> first").groupBy(F.col("doc").alias(doc)).agg(
        F.collect_set("shape").alias(lost)
    )
    out = marked.join(gone, doc, "left").drop(doc)
    schema = marked.drop(doc).schema.add("n_lines", "long").add("n_dropped", "long")
    at_text = carried.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, dropped = [], [], []
            values, shapes = batch.column(at_text), batch.column(len(carried))
            touched = np.flatnonzero(shapes.is_valid().to_numpy(zero_copy_only=False))
            without = dict(zip(touched.tolist(), _without(values.take(pa.array(touched)), shapes.take(pa.array(touched)), least_tokens)))
            for i, value in enumerate(values.to_pylist()):
                total.append(1 if value is None else value.count("\n") + 1)
                value, n = without.get(i, (value, 0))
                kept.append(value)
                dropped.append(n)
            columns = list(batch.columns[: len(carried)])
            columns[at_text] = pa.array(kept, batch.column(at_text).type)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], [*carried, "n_lines", "n_dropped"]
            )
        give_back()

    return out.mapInArrow(cut, schema)
