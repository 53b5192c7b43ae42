"""Scans. Schemas are declared; nothing is inferred, and missing is always NULL."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.scalars import stripped

_NEVER = "\u0000"  # a null marker no text file holds


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_delimited(
    spark: SparkSession, path: str, columns: Sequence[str], sep: str = "\t", header: bool = True,
    na: str | None = None, schema: T.StructType | None = None, keep: Sequence[str] | None = None,
) -> DataFrame:
    """CSV/TSV scan by declared column names (header-less files take them as given).

    All columns are text unless a schema is passed. ``na=None`` keeps a literal ``NA``;
    otherwise that spelling reads as missing. A file whose header lacks a column fails.
    """
    reader = (
        spark.read.schema(schema or text_schema(columns))
        .option("sep", sep).option("header", header).option("quote", '"').option("escape", '"')
        .option("nullValue", _NEVER if na is None else na).option("enforceSchema", False)
        .option("emptyValue", "")
    )
    df = reader.csv(path)
    if na is None:  # blank cells of an all-text scan are empty text, not missing
        text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        df = df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in text})
    return df.select(*[F.col(f"`{c}`") for c in keep]) if keep else df


def read_symbols(spark: SparkSession, path: str, name: str = "gene") -> DataFrame:
    """One symbol per line: stripped, blanks dropped, distinct."""
    lines = spark.read.text(path).select(stripped("value").alias(name))
    return lines.filter(F.col(name) != "").distinct()


def read_symbol_column(
    spark: SparkSession, path: str, columns: Sequence[str], column: str, sep: str = ",", name: str = "gene"
) -> DataFrame:
    """Distinct stripped symbols of one column; a byte-order mark is removed."""
    df = (
        spark.read.schema(text_schema(columns)).option("sep", sep).option("header", True)
        .option("enforceSchema", True).csv(path)
    )
    return symbol_set(df, column, name)


def symbol_set(df: DataFrame, column: str, name: str = "gene") -> DataFrame:
    cleaned = stripped(F.regexp_replace(F.col(f"`{column}`"), "^﻿", ""))
    return df.select(cleaned.alias(name)).filter(F.col(name) != "").distinct()


def read_shards(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Parquet shards that must share one schema.

    Only footers are read for the check; the scan itself is one distributed read.
    """
    ordered = sorted(paths)
    if not ordered:
        raise ValueError("no shards given")
    with ThreadPoolExecutor(16) as pool:
        schemas = list(pool.map(lambda p: spark.read.parquet(p).schema, ordered))
    first = schemas[0]
    shape = lambda s: [(f.name, f.dataType.simpleString()) for f in s.fields]
    for p, found in zip(ordered, schemas):
        if shape(found) != shape(first):
            raise ValueError(f"schema mismatch in {p}: {shape(found)} != {shape(first)}")
    return spark.read.schema(first).parquet(*ordered)


_MOA = "array<struct<mechanismOfAction:string,actionType:string>>"
TARGET_PAGE = (
    "target struct<approvedSymbol:string, drugAndClinicalCandidates:struct<rows:array<struct<"
    "maxClinicalStage:string,"
    f"drug:struct<name:string,mechanismsOfAction:struct<rows:{_MOA}>>,"
    "diseases:array<struct<diseaseFromSource:string,disease:struct<id:string,name:string>>>>>>>"
)
SCORE_PAGE = "target struct<id:string,approvedSymbol:string>, datasourceScores array<struct<id:string,score:double>>"
PROGRAM_PAGE = (
    "approvedSymbol string, drugAndClinicalCandidates struct<count:bigint,rows:array<struct<"
    "maxClinicalStage:string,drug:struct<id:string,name:string,drugType:string,maximumClinicalStage:string>,"
    "diseases:array<struct<disease:struct<id:string,name:string,"
    "therapeuticAreas:array<struct<id:string,name:string>>>>>>>>"
)


def read_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed API pages as nested rows (one JSON document per line)."""
    return spark.read.schema(schema).json(path)


def read_matrix(spark: SparkSession, rows_path: str, columns_path: str) -> tuple[DataFrame, DataFrame]:
    """A landed matrix: rows with their value arrays, and the column dimension."""
    return spark.read.parquet(rows_path), spark.read.parquet(columns_path)


def matrix_cells(rows: DataFrame, columns: DataFrame, keep: Sequence[str], values: str = "values") -> DataFrame:
    """Long (row, column, value) cells with the column dimension attached."""
    long = rows.select(*keep, F.posexplode(values).alias("col_id", "value"))
    return long.join(columns, "col_id")
