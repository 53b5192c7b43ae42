"""Symbol clean-up against an authority table of approved, previous and alias names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.scalars import as_col, stripped, tokens, well_formed

APPROVED, PREVIOUS, ALIAS, UNKNOWN = "approved", "previous_symbol", "alias_symbol", "not_found"


def symbol_index(
    authority: DataFrame, symbol: str = "symbol", status: str = "status",
    previous: str = "prev_symbol", alias: str = "alias_symbol", row_id: str = "row_id",
) -> DataFrame:
    """One row per known name: ``name, status, target``.

    Only approved records count. A name is approved before previous before alias; of
    several records claiming a previous name the first in source order wins. Because
    the index has one row per name, classifying and renaming take a single join.
    """
    kept = authority.filter(F.col(status) == "Approved")
    approved = kept.select(
        F.col(symbol).alias("name"), F.lit(0).alias("level"),
        F.col(symbol).alias("target"), F.col(row_id).alias("at"), F.lit(0).alias("pos"),
    )
    listed = []
    for level, column in ((1, previous), (2, alias)):
        listed.append(
            kept.select(F.posexplode(tokens(column)).alias("pos", "name"), F.col(symbol).alias("to"), F.col(row_id).alias("at"))
            .select(
                "name", F.lit(level).alias("level"),
                (F.col("to") if level == 1 else F.col("name")).alias("target"), "at", "pos",
            )
        )
    every = reduce(DataFrame.unionByName, [approved, *listed])
    best = every.groupBy("name").agg(
        F.min_by(F.struct("level", "target"), F.struct("level", "at", "pos")).alias("__b")
    )
    label = F.element_at(F.array(F.lit(APPROVED), F.lit(PREVIOUS), F.lit(ALIAS)), F.col("__b.level") + 1)
    return best.select("name", label.alias("status"), F.col("__b.target").alias("target"))


def classify(df: DataFrame, index: DataFrame, key: str, name: str = "status") -> DataFrame:
    """Attach approved / previous_symbol / alias_symbol / not_found."""
    dim = index.select(F.col("name").alias("__n"), F.col("status").alias("__s"))
    joined = df.join(dim, F.col(key) == F.col("__n"), "left")
    return joined.withColumn(name, F.coalesce("__s", F.lit(UNKNOWN))).drop("__n", "__s")


def status_summary(classified: DataFrame, status: str = "status") -> DataFrame:
    """Rows per status and the overall share that is approved (one decimal)."""
    counts = classified.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(
        F.round(100.0 * F.sum(F.when(F.col(status) == APPROVED, F.col("n")).otherwise(0)) / F.sum("n"), 1)
    )
    return counts.withColumn("approved_pct", total.scalar())


def _renames(df: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Symbols of df that are previous names: (old, new, taken, clash, rows).

    ``taken``: the target is a row of df already, so the old row goes. ``clash``: rows end on one
    symbol, because two names or two rows share it. All of it is judged on one count per symbol, so
    the data is read once for the counts and once for the rows.
    """
    counts = df.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n")).filter("__k is not null")
    moved = index.filter((F.col("status") == PREVIOUS) & (F.col("name") != F.col("target"))).select(
        F.col("name").alias("__old"), F.col("target").alias("__new"))
    named = counts.join(moved, F.col("__k") == F.col("__old"), "left")
    # Every symbol with its own rows, whether these stay, and the names that are renamed to it.
    old = F.col("__old").isNotNull()
    sides = F.array(
        F.struct(F.col("__k").alias("s"), F.col("__n").alias("here"), F.when(old, 0).otherwise(F.col("__n")).alias("stay"), F.lit(None).cast("string").alias("old"), F.lit(0).cast("bigint").alias("n")),
        F.struct(F.col("__new").alias("s"), F.lit(0).cast("bigint").alias("here"), F.lit(0).cast("bigint").alias("stay"), F.col("__old").cast("string").alias("old"), F.col("__n").alias("n")),
    )
    each = named.select(F.inline(F.when(old, sides).otherwise(F.slice(sides, 1, 1))))
    ends = each.groupBy(F.col("s").alias("__new")).agg(
        F.sum("here").alias("__here"), F.sum("stay").alias("__stay"), F.sum("n").alias("__come"),
        F.collect_list(F.when(F.col("old").isNotNull(), F.struct("old", "n"))).alias("__olds"),  # previous names of one symbol in the index
    )
    # A row whose target is present goes, so it cannot clash.
    clash = F.col("__stay") + F.when(F.col("__here") > 0, 0).otherwise(F.col("__come")) > 1
    touched = ends.withColumn("__clash", clash).filter(F.col("__clash") | (F.size("__olds") > 0))
    found = touched.select(F.explode_outer("__olds").alias("o"), "__new", (F.col("__here") > 0).alias("__taken"), "__clash")
    return found.select(F.coalesce("o.old", "__new").alias("__old"), "__new", "__taken", "__clash", F.col("o.n").alias("__n"))


def canonical(df: DataFrame, index: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """Rename previous symbols and keep every row (into ``name``, default in place)."""
    dim = index.filter(F.col("status") == PREVIOUS).select(F.col("name").alias("__old"), F.col("target").alias("__new"))
    joined = df.join(dim, F.col(key) == F.col("__old"), "left")
    return joined.withColumn(name or key, F.coalesce("__new", F.col(key))).drop("__old", "__new").select(
        *df.columns, *([name] if name and name not in df.columns else [])
    )


def harmonize(
    df: DataFrame, index: DataFrame, key: str
) -> tuple[DataFrame, DataFrame]:
    """Rename previous symbols; drop a deprecated row whose target is already present.

    Returns the table and the changes: one row per previous symbol of df with its target, whether it
    was dropped, and its rows. The table's plan itself raises, naming the symbol, if rows ended on one.
    """
    renames = _renames(df, index, key)
    joined = df.join(renames, F.col(key) == F.col("__old"), "left")
    failed = F.raise_error(F.concat(F.lit("harmonize produced duplicate symbols: "), F.col("__new"))).cast("boolean")
    sound = F.when(F.coalesce(F.col("__clash"), F.lit(False)), failed).otherwise(F.lit(True))
    out = joined.filter(sound & F.coalesce(~F.col("__taken"), F.lit(True)))
    out = out.withColumn(key, F.coalesce("__new", F.col(key))).select(*df.columns)
    changes = renames.filter("__n is not null").select(
        F.col("__old").alias("name"), F.col("__new").alias("target"), F.col("__taken").alias("dropped"), F.col("__n").alias("n_rows"))
    return out, changes


def rename_counts(changes: DataFrame) -> DataFrame:
    """(renamed, dropped) of the changes ``harmonize`` reports."""
    return changes.agg(
        F.coalesce(F.sum(F.when(~F.col("dropped"), F.col("n_rows"))), F.lit(0)).alias("renamed"), F.count_if("dropped").alias("dropped"))


def format_profile(df: DataFrame, key: str) -> DataFrame:
    """Formatting report of a symbol column as one row.

    Text is reduced to distinct spellings with counts first; the rest works on those.
    """
    spelled = df.select(as_col(key).cast("string").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))

    def rows(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")

    # Characters become distinct rows before they are listed, so the list stays short.
    char = F.explode(F.array_distinct(F.regexp_extract_all(F.col("s"), F.lit(r"([^\p{L}\p{N}])"), F.lit(1))))
    specials = spelled.select(char.alias("ch")).distinct().agg(F.array_join(F.array_sort(F.collect_set("ch")), ""))
    return spelled.agg(
        F.sum("n").cast("bigint").alias("n"),
        F.count("s").alias("unique_n"),
        rows(F.col("s") != stripped("s")).alias("whitespace"),
        rows(F.contains(F.col("s"), F.lit(" "))).alias("space"),
        rows((stripped("s") == "") | (F.col("s") == "NA")).alias("empty_or_na"),
        (F.sum("n") - F.count(F.lit(1))).cast("bigint").alias("duplicates"),
        F.count_if(~well_formed("s")).alias("nonstandard_n"),
    ).withColumn("special_chars", specials.scalar())


def nonstandard_symbols(df: DataFrame, key: str) -> DataFrame:
    """Distinct spellings that do not look like a symbol."""
    return df.select(key).filter(~well_formed(key)).distinct()


def family_of(
    df: DataFrame, groups: DataFrame, key: str, group_key: str = "symbol",
    group_ids: str = "gene_group_id", row_id: str | None = None, name: str = "family",
) -> DataFrame:
    """Family id: the first listed group, else the three-letter prefix of the symbol.

    A symbol listed more than once takes its last listed group when ``row_id`` is given.
    """
    first = F.get(tokens(group_ids), F.lit(0))
    known = groups.select(F.col(group_key).alias("__g"), first.alias("__first"),
                          (F.col(row_id) if row_id else F.lit(0)).alias("__at")).filter("__first is not null")
    known = known.groupBy("__g").agg(F.max_by("__first", F.struct("__at", "__first")).alias("__first"))
    joined = df.join(known, F.col(key) == F.col("__g"), "left")
    family = F.coalesce(
        F.concat(F.lit("HGNC:"), F.col("__first")),
        F.concat(F.lit("PFX:"), F.upper(F.substring(key, 1, 3))),
    )
    return joined.withColumn(name, family).drop("__g", "__first")
