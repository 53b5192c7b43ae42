"""Packing documents into fixed-length sequences by cutting-stock column generation.

Documents become token ids once. Whole stretches of ``capacity`` ids are sequences of their
own. What remains of a document falls into one of ``capacity / unit`` length classes; only the
class histogram reaches the driver, where column generation finds the patterns of classes
that fill sequences (``cutting.py``). Documents are ranked within their class by distributed
running counts, and the rank says which slot of which pattern a document takes.

Lengths within a class differ by less than ``unit`` ids, so a filled pattern has a little
room left. Short remainders, and a hash share of the others, therefore stay out of the
program: laid end to end they form one stream that is cut freely, first into the room left in
the sequences and then into sequences of its own, so almost nothing is padded.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import single_threaded, stored, text_of
from evidentia.llm.cutting import patterns
from evidentia.operators.ordering import scan

CAPACITY = 4096
UNIT = 16
SHORT = 128  # remainders below this are cut freely
STREAM_SHARE = 1 / 16  # of the longer ones, by a hash of the identifier
TOKENIZER = "word_bpe_49k.json"
END = 2

#: Pre-tokens of this tokenizer; a fixed value from its description.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KEPT_WORDS = 400_000  # entries of a worker's word memory; frequent words come early, later ones are worked out again
LONGEST_KEPT = 64


class WordIds(dict):
    """Ids of single words as little-endian bytes, remembered.

    This tokenizer splits at white space before anything else, so a text's ids are those of its
    words in a row. Printable Latin words are split into pre-tokens here and each pre-token goes
    through the tokenizer's model; every other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.find = regex.compile(PIECES).findall
        self.bytes_as_letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if word.isprintable() and "<|" not in word and (word.isascii() or max(word) < "ɐ"):
            ids = b"".join(map(self._piece, self.find(word.lower())))
        else:
            ids = _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= LONGEST_KEPT and len(self) < KEPT_WORDS:
            self[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            letters = piece if piece.isascii() else self.bytes_as_letters(piece)[0][0]
            ids = _packed([t.id for t in self.model.tokenize(letters)])
            if len(piece) <= LONGEST_KEPT and len(self.pieces) < KEPT_WORDS:
                self.pieces[piece] = ids
        return ids

    def text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def _worker_words(path: str) -> WordIds:
    """The word memory of this Python worker, kept from one task to the next.

    Code travels with its task, so a module's own variables start anew in each; what is to last
    as long as the process hangs on a module that belongs to the process.
    """
    state = sys.modules.setdefault("evidentia_worker", types.ModuleType("evidentia_worker"))
    held = getattr(state, "words", None)
    if held is None or held.path != path:
        held = state.words = WordIds(path)
    return held


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def _tokenised(batches: Iterator[pa.RecordBatch], path: str, capacity: int, short: int, share: float) -> Iterator[pa.RecordBatch]:
    """key, row, text -> key, row, tokens, crcs of the full stretches and of the rest, ids of the rest if it is streamed."""
    single_threaded()
    words = _worker_words(path)
    end, width = _packed([END]), 4 * capacity
    for batch in batches:
        tokens, crcs, streams = [], [], []
        for key, text in zip(batch.column(0), batch.column(2)):
            ids = words.text(text.as_py()) + end
            count = len(ids) // 4
            cuts = range(0, len(ids), width)
            tokens.append(count)
            crcs.append([zlib.crc32(ids[a : a + width]) for a in cuts])
            rest = count % capacity
            drawn = zlib.crc32(f"pack:{key.as_py()}".encode()) < share * 2**32
            streams.append(ids[cuts[-1] :] if rest and (rest < short or drawn) else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array(tokens, pa.int64()),
                pa.array(crcs, pa.list_(pa.int64())), pa.array(streams, pa.binary()),
            ],
            ["key", "row", "tokens", "crcs", "stream"],
        )


def _slots(found: list[tuple[dict[int, int], int]]) -> tuple[dict[int, tuple[np.ndarray, ...]], int]:
    """Per class the first slot, first sequence and slots a sequence of every pattern that has it."""
    table: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for items, times in found:
        for size, each in items.items():
            table.setdefault(size, []).append((used.get(size, 0), first, each))
            used[size] = used.get(size, 0) + each * times
        first += times
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for s, rows in table.items()}, first


def _overlap(a: Column, a_len: Column, b: Column, b_len: Column) -> tuple[Column, Column]:
    start = F.greatest(a, b)
    return start, F.least(a + a_len, b + b_len) - start


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
    capacity: int = CAPACITY, unit: int = UNIT, short: int = SHORT, share: float = STREAM_SHARE,
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts have the one closing id. A text may be of any length; each of its ids
    lies in exactly one piece. Rows that repeat an identifier are packed each on its own. An
    empty table gives no pieces. Other columns are not read.
    """
    import public_tokenizers

    path = public_tokenizers.path(tokenizer) if "/" not in tokenizer else tokenizer
    rows = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), text_of(text).alias("text"))
    key_type = docs.schema[key].dataType.simpleString()
    rows = rows.mapInArrow(
        lambda b: _tokenised(b, path, capacity, short, share),
        f"key {key_type}, row long, tokens long, crcs array<long>, stream binary",
    )
    rows = stored(rows, "pack-tokens")
    rows = rows.withColumns({"rest": F.col("tokens") % capacity, "full": F.expr(f"tokens div {capacity}")})
    sized = rows.drop("stream")

    placed = rows.where((F.col("rest") > 0) & F.col("stream").isNull()).select(
        "key", "row", "tokens", "rest", F.element_at("crcs", -1).alias("crc"),
        F.expr(f"(rest + {unit - 1}) div {unit}").cast("int").alias("class"),
    )
    histogram = {r["class"]: r["count"] for r in placed.groupBy("class").count().collect()}  # one row per class
    slots, sequences = _slots(patterns(histogram, capacity // unit))
    ranked = scan(placed, [("rest", "desc"), ("row", "asc")], by=["class"], sums={"rank": F.lit(1).cast("bigint")})

    @F.pandas_udf("long")
    def sequence_of(kind: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(kind), dtype=np.int64)
        kinds, at = kind.to_numpy(), rank.to_numpy() - 1
        for k in np.unique(kinds):
            base, first, each = slots[int(k)]
            mine = kinds == k
            p = np.searchsorted(base, at[mine], side="right") - 1
            out[mine] = first[p] + (at[mine] - base[p]) // each[p]
        return pd.Series(out)

    inside = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank")
    whole = ranked.withColumn("sequence_id", sequence_of("class", "rank")).withColumn(
        "offset", F.sum("rest").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rest")
    )
    whole = stored(
        whole.select(
            "key", (F.col("tokens") - F.col("rest")).alias("start"), F.col("rest").alias("length"),
            F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), "sequence_id", "offset",
        ),
        "pack-patterns",
    )

    # Room left in the sequences, and the stream that fills it: both laid end to end.
    room = whole.groupBy("sequence_id").agg(F.sum("length").alias("filled")).where(F.col("filled") < capacity)
    room = scan(room.withColumn("room", capacity - F.col("filled")), [("sequence_id", "asc")], sums={"to": F.col("room")})
    room = room.withColumn("from", F.col("to") - F.col("room")).drop("to")
    streamed = rows.where(F.col("stream").isNotNull())
    stream = scan(
        streamed.select("key", "row", "tokens", "rest"), [("row", "asc")], sums={"to": F.col("rest")}
    ).withColumn("at", F.col("to") - F.col("rest")).drop("to")
    total = room.agg(F.coalesce(F.sum("room"), F.lit(0)).alias("n")).first()["n"]

    block = lambda c, size: F.sequence(F.expr(f"`{c}` div {capacity}"), F.expr(f"(`{c}` + `{size}` - 1) div {capacity}"))
    rooms = room.withColumn("block", F.explode(block("from", "room")))
    lengths = stream.withColumn("block", F.explode(block("at", "rest")))
    start, length = _overlap(F.col("at"), F.col("rest"), F.col("from"), F.col("room"))
    into_rooms = lengths.join(rooms, "block").withColumns({"begin": start, "length": length})
    into_rooms = into_rooms.where((F.col("length") > 0) & (F.expr(f"begin div {capacity}") == F.col("block"))).select(
        "row", (F.col("begin") - F.col("at")).alias("cut"), "length", "sequence_id",
        (F.col("filled") + F.col("begin") - F.col("from")).alias("offset"),
    )
    beyond = stream.where(F.col("at") + F.col("rest") > total).withColumn(
        "first", F.greatest(F.col("at"), F.lit(total)) - F.lit(total)
    )
    beyond = beyond.withColumn("last", F.col("at") + F.col("rest") - 1 - F.lit(total)).withColumn(
        "block", F.explode(F.expr(f"sequence(first div {capacity}, last div {capacity})"))
    )
    begin = F.greatest(F.col("first"), F.col("block") * capacity)
    beyond = beyond.withColumns({"begin": begin, "end": F.least(F.col("last") + 1, (F.col("block") + 1) * capacity)})
    beyond = beyond.select(
        "row", (F.col("begin") + F.lit(total) - F.col("at")).alias("cut"), (F.col("end") - F.col("begin")).alias("length"),
        (F.col("block") + F.lit(sequences)).alias("sequence_id"), (F.col("begin") % capacity).alias("offset"),
    )
    pieces = into_rooms.unionByName(beyond)
    bytes_of = F.expr("substring(stream, cast(cut * 4 + 1 as int), cast(length * 4 as int))")
    cut = streamed.select("key", "row", "tokens", "rest", "stream").join(pieces, "row").select(
        "key", (F.col("tokens") - F.col("rest") + F.col("cut")).alias("start"), "length",
        F.crc32(bytes_of).alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), "sequence_id", "offset",
    )

    # Full stretches follow, numbered by a running count.
    tail = stream.agg(F.coalesce(F.sum("rest"), F.lit(0)).alias("n")).first()["n"]
    after = sequences + -(-max(0, tail - total) // capacity)
    full = scan(sized.where("full > 0"), [("row", "asc")], sums={"to": F.col("full")})
    full = full.select("*", F.explode(F.expr("sequence(0, full - 1)")).alias("i")).select(
        "key", (F.col("i") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("length"),
        F.expr("crcs[cast(i as int)]").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"),
        (F.lit(after) + F.col("to") - F.col("full") + F.col("i")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
    )
    return whole.unionByName(cut).unionByName(full).withColumnRenamed("key", key)
