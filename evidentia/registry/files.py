"""File scans and sinks: every query writes given tables to the shared folder and scans them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import scalars as S
from evidentia.registry.base import query, shaped, table
from evidentia.session import scratch_folder
from evidentia.sources import readers, writers


@query("SELECT DISTINCT trim(p_brand) AS gene FROM part WHERE trim(p_brand) <> ''")
def line_list_scan(spark, sf):
    """One padded name a line, with repeats and blank lines."""
    path = scratch_folder(spark, "lines")
    names = table(spark, sf, "part").select(F.concat(F.lit("  "), "p_brand", F.lit(" ")).alias("value"))
    blank = table(spark, sf, "region").select(F.lit("   ").alias("value"))
    names.unionByName(blank).write.text(path)
    return readers.read_symbols(spark, path)


@query("""
SELECT c_custkey::VARCHAR AS id, c_name AS name, printf('%.2f', c_acctbal) AS balance FROM customer
""")
def headerless_scan(spark, sf):
    path = scratch_folder(spark, "headerless")
    cust = table(spark, sf, "customer").select("c_custkey", "c_name", F.format_string("%.2f", "c_acctbal"))
    cust.write.option("sep", "\t").option("header", False).csv(path)
    return readers.read_delimited(spark, path, ["id", "name", "balance"], header=False)


@query("SELECT o_orderstatus AS status, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def shard_scan(spark, sf):
    """Shards of one schema, written one by one and scanned as one table."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    paths = [f"{scratch_folder(spark, 'shard')}" for _ in range(3)]
    for i, path in enumerate(paths):
        orders.filter(F.pmod(F.xxhash64("o_orderkey"), F.lit(3)) == i).write.parquet(path)
    both = readers.read_shards(spark, paths)
    return both.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("""
SELECT 'S' || l_partkey AS gene, 'E' || l_partkey AS ensembl_id, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL
""")
def page_scan(spark, sf):
    """Nested score pages landed as JSON lines and read by their declared schema."""
    path = scratch_folder(spark, "pages")
    top = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.max("l_extendedprice").alias("top"))
    score = lambda name, v: F.struct(F.lit(name).alias("id"), v.alias("score"))
    top.select(
        F.struct(F.concat(F.lit("E"), "l_partkey").alias("id"), F.concat(F.lit("S"), "l_partkey").alias("approvedSymbol")).alias("target"),
        F.array(score("other", F.lit(1.0)), score("kept", F.col("top"))).alias("datasourceScores"),
    ).write.json(path)
    pages = readers.read_pages(spark, path, readers.SCORE_PAGE)
    kept = pages.select("target.*", F.explode("datasourceScores").alias("s")).filter(F.col("s.id") == "kept")
    return kept.select(F.col("approvedSymbol").alias("gene"), F.col("id").alias("ensembl_id"), F.col("s.score").alias("score"))


@query("SELECT o_orderkey, o_totalprice, o_orderstatus AS condition FROM orders")
def condition_parts(spark, sf):
    """One write gives the stacked table and a part per condition; the parts add up to the table."""
    path = scratch_folder(spark, "conditions")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("condition"))
    writers.write_by_condition(orders, path)
    return spark.read.parquet(path)


@query("""
SELECT o_orderpriority AS name, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1
""")
def metrics_document(spark, sf):
    path = scratch_folder(spark, "metrics")
    per = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean")
    )
    writers.write_metrics(per, path)
    return spark.read.schema("name string, n bigint, mean double").json(path)


@query("""
SELECT p_partkey, CAST(CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS BIGINT) AS flag FROM part
""")
def text_flags(spark, sf):
    kind = F.col("p_size") % 4
    spelled = F.when(kind == 0, "TRUE").when(kind == 1, "true").when(kind == 2, "False")
    return shaped(table(spark, sf, "part").select("p_partkey", S.text_flag(spelled).alias("flag")))
