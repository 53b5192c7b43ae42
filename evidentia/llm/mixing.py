"""Mixing sources to target weights.

Every document gets a hash-random place within its source. Running totals of word counts over
that order say where the source's budget ends; a source whose budget exceeds what it has is
repeated whole as often as it fits, and the rest is cut from the front of the order. Budgets
share all words by weight; no source is read more than ``most`` times, and what it cannot take
goes to the others by weight. All of it is DataFrame operations.

A running total never needs a source in one task: rows are laid out in ranges of
(source, hash), each range adds up its own words, and only one total per range is exchanged.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import WORD, stored, text_of
from evidentia.operators.ordering import null_safe_join, scan

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3


def words(text: str) -> Column:
    """Number of words in a whole text; 0 for null."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint")


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with ``target``.

    Sources in code point order (null last) take the weights in turn. With every source's
    ceiling ``most * size``, the sources that reach it are those with the smallest
    ceiling-to-weight ratio; the rest share what is left by weight.
    """
    scale = math.lcm(*weights)
    named = totals.withColumn("__none", F.col("source").isNull().cast("int"))
    placed = scan(named, [("__none", "asc"), ("source", "asc")], sums={"__at": F.lit(1).cast("bigint")})
    weight = F.array(*[F.lit(int(w)).cast("bigint") for w in weights])[((F.col("__at") - 1) % len(weights)).cast("int")]
    placed = placed.withColumns({"__weight": weight, "__cap": F.col("source_size") * most})
    placed = placed.withColumn("__ratio", F.expr(f"__cap * {scale} div __weight"))
    level = scan(
        placed, [("__ratio", "asc"), ("__at", "asc")],
        sums={"__cap_to": F.col("__cap"), "__weight_to": F.col("__weight"), "__rank": F.lit(1).cast("bigint")},
        totals={"__size_all": F.col("source_size"), "__weight_all": F.col("__weight")},
    )
    level = stored(
        level.withColumns(
            {
                "__left": F.col("__size_all") - F.col("__cap_to") + F.col("__cap"),
                "__share": F.col("__weight_all") - F.col("__weight_to") + F.col("__weight"),
            }
        ),
        "mix-levels",
    )
    fits = level.where(F.col("__left") * F.col("__weight") <= F.col("__cap") * F.col("__share"))
    cut = fits.agg(F.min_by(F.struct("__rank", "__left", "__share"), "__rank").alias("c")).first()["c"]
    if cut is None:  # no sources
        return totals.withColumn("target", F.lit(0.0)).limit(0)
    shared = (F.lit(cut["__left"]).cast("bigint") * F.col("__weight")).cast("double") / F.lit(float(cut["__share"]))
    target = F.when(F.col("__rank") < cut["__rank"], F.col("__cap").cast("double")).otherwise(shared)
    return level.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix", whole: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: key, size, source, source_size, target, taken, epochs, at_cut.

    ``taken`` counts the words the mix takes, repeats included: ``epochs`` whole passes, then
    the front of the random order up to the word where the budget ends. With ``whole`` the one
    document at the cut is taken whole or not at all, whichever ends nearer to the budget.

    Null texts have size 0 and are never taken. A null source is a source of its own, in the
    last place. Rows that repeat an identifier stand next to each other in the order, smaller
    size first; equal rows are interchangeable. Very long texts are counted whole and may be
    cut. An empty table gives an empty result. ``carry`` names further columns to keep.
    """
    random = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))
    rows = docs.select(
        F.monotonically_increasing_id().alias("__row"), F.col(key), F.col(source).alias("source"), words(text).alias("size"),
        random.alias("__random"), *carry,
    )
    whole_rows = stored(rows, "mix-sizes")
    rows = whole_rows.drop(*carry)  # what is carried waits in the table until the places are known
    totals = rows.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    aims = targets(totals, weights, most)
    placed = scan(
        rows, [("__random", "asc"), (key, "asc"), ("size", "asc")], by=["source"], sums={"__to": F.col("size")}
    )
    placed = null_safe_join(placed, aims, ["source"])
    budget = F.floor(F.col("target") + 0.5).cast("bigint")
    full = F.when(F.col("source_size") > 0, F.expr("__budget div source_size")).otherwise(F.lit(0).cast("bigint"))
    rest = F.col("__budget") - F.col("epochs") * F.col("source_size")
    before = F.col("__to") - F.col("size")
    if whole:
        part = F.when((before * 2 + F.col("size") <= rest * 2) & (rest > 0), F.col("size")).otherwise(F.lit(0))
    else:
        part = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), rest - before))
    placed = placed.withColumn("__budget", budget).withColumn("epochs", full)
    placed = placed.withColumn("at_cut", part.cast("bigint"))
    taken = F.col("epochs") * F.col("size") + F.col("at_cut")
    if carry:
        placed = placed.join(whole_rows.select("__row", *carry), "__row")
    return placed.withColumn("taken", taken.cast("bigint")).select(
        key, "size", "source", "source_size", "target", "taken", "epochs", "at_cut", *carry
    )
