"""The corpus pipeline: five stages, each working on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet in the shared folder and reads it back as the next stage's documents.

Stages read the columns of documents and no others, so more of them clash with nothing. Null keys and
repeated rows pass like any other row until near dedup, which keeps one of the rows that repeat
key and text. Null and empty texts are never toxic by themselves, have no lines to drop, are one near
duplicate of each other, and take no part in the mix, as they have no words. Texts are used whole at any length.
Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import line_templates, mixing, near_dedup, packing, toxicity
from evidentia.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    scored = toxicity.classify(docs.select(COLUMNS), table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(COLUMNS)


def recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template recurs; lengths follow the text.

    Long lines of two documents wait for ``near_duplicates``, which needs both copies whole.
    """
    kept = line_templates.drop_recurring(docs.select(COLUMNS), kinds=("template", "short"))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest identifier.

    Of long lines that two of these still share, the first document keeps its own.
    """
    kept = stored(near_dedup.representatives(docs.select(COLUMNS)), "pipeline-representatives")
    kept = line_templates.drop_recurring(kept, kinds=("long",))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents up to each source's target, once per pass over the source."""
    docs = docs.select(COLUMNS)
    mixed = mixing.mix(docs, whole=True, carry=["text", "lang", "n_chars"])
    times = F.col("epochs") + F.when(F.col("at_cut") > 0, 1).otherwise(0)
    repeated = mixed.withColumn("__times", times.cast("int")).where("__times > 0 AND size > 0")
    return repeated.withColumn("__pass", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids."""
    return packing.pack(docs.select(COLUMNS))


STAGES = [
    ("toxicity", toxic_documents),
    ("line_dedup", recurring_lines),
    ("near_dedup", near_duplicates),
    ("mixing", source_mix),
    ("packing", packed),
]

#: Fitted dictionaries, dart signatures and column generation are not expressible in SQL; the
#: stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
