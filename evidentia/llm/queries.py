"""The corpus queries, each beside the SQL that checks it where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import exact_dedup, html_text, line_templates, mixing, near_dedup, nearest_tiles, packing, quality_rules, secrets, spelling, substring_dedup, toxicity, whitening
from evidentia.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its check where SQL can state it."""

    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


@query(
    r"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
    g AS (SELECT doc_id, body, min(doc_id) OVER (PARTITION BY body) AS keep_id,
                 count(*) OVER (PARTITION BY body) AS group_size FROM t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
    """
)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming exact dedup of all documents."""
    return exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


MIX_SQL = r"""
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                      md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS k FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, 3 * source_size AS cap, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
    r AS (SELECT *, cap * 6 // weight AS ratio, row_number() OVER (ORDER BY cap * 6 // weight, source NULLS LAST) AS pos FROM w),
    l AS (SELECT *, CAST(sum(source_size) OVER () - sum(cap) OVER (ORDER BY pos) + cap AS BIGINT) AS rest,
                 CAST(sum(weight) OVER () - sum(weight) OVER (ORDER BY pos) + weight AS BIGINT) AS share FROM r),
    c AS (SELECT pos AS first, rest, share FROM l WHERE rest * weight <= cap * share ORDER BY pos LIMIT 1),
    g AS (SELECT source, source_size, CASE WHEN l.pos < c.first THEN CAST(cap AS DOUBLE)
                 ELSE CAST(c.rest * weight AS DOUBLE) / CAST(c.share AS DOUBLE) END AS target FROM l, c),
    b AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM g),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
    p AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS rest,
                 CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS before
          FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, size, source_size, target,
           CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM p
"""


@query(MIX_SQL)
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by weights 1, 2, 3 takes of every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op2_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 ids."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query()
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query()
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: counts and spans of the base patterns and of random-looking strings."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        of("random").alias("n_random"), F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


@query(
    """
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1),
                 lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM p)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """
)
def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every hundredth vector."""
    return nearest_tiles.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates."""
    return near_dedup.classes(table(spark, sf_dir, "documents"))


@query()
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 50-byte strings of earlier ones."""
    cut = substring_dedup.cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by compression distance."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return toxicity.classify(docs, labels).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


@query()
def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template recurs across documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring(docs).select("doc_id", "n_lines", "n_dropped", "text")


@query()
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight whitened components of every usable embedding."""
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query()
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether base rules and the learned decision list keep it."""
    judged, _ = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query()
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of all documents with its commoner form, one letter away."""
    return spelling.variants(table(spark, sf_dir, "documents"))


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five stages of the corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)
