"""Sinks. Parquet is the working format; delimited text and JSON are exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATING = (T.DoubleType, T.FloatType)
_NESTED = (T.ArrayType, T.StructType, T.MapType)


def fixed_floats(df: DataFrame, places: int = 6) -> DataFrame:
    """Floating columns as text with a fixed number of decimals; missing stays missing."""
    return df.withColumns(
        {
            f.name: F.when(F.col(f"`{f.name}`").isNotNull(), F.format_string(f"%.{places}f", F.col(f"`{f.name}`")))
            for f in df.schema.fields if isinstance(f.dataType, _FLOATING)
        }
    )


def nested_as_json(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nested columns as JSON text, the rest unchanged."""
    nested = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, _NESTED)]
    return df.withColumns({c: F.to_json(F.col(c), {"ignoreNullFields": "false"}) for c in nested})


def write_delimited(df: DataFrame, path: str, sep: str = "\t", na: str = "NA", places: int | None = None,
                    mode: str = "errorifexists") -> None:
    """Text export; every task writes its own part file."""
    out = fixed_floats(df, places) if places is not None else df
    (
        out.write.mode(mode).option("sep", sep).option("header", True).option("nullValue", na)
        .option("emptyValue", "").option("quote", '"').option("escape", '"').csv(path)
    )


def write_by_condition(df: DataFrame, path: str, condition: str = "condition", mode: str = "errorifexists") -> None:
    """One write that serves both the stacked table and each condition's part."""
    df.write.mode(mode).partitionBy(condition).parquet(path)


def write_metrics(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)
