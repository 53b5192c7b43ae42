"""Scans, filters, duplicates, joins, sets, grouping and symbol queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import scalars as S
from evidentia.operators import dedup, grouping, joins, ordering, sets, symbols
from evidentia.plans import drug_table, entity_table
from evidentia.registry.base import query, shaped, table
from evidentia.sources import readers, writers

# ------------------------------------------------------------------ duplicates


@query("""
SELECT p_partkey, p_name, p_brand, CAST(p_size AS BIGINT) AS p_size FROM part
QUALIFY count(*) OVER (PARTITION BY p_name, p_brand) = 1
""")
def drop_all_duplicates(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return shaped(dedup.drop_all_copies(part, ["p_name", "p_brand"]))


@query("""
SELECT p_name, p_brand, CAST(count(*) AS BIGINT) AS n_rows FROM part GROUP BY ALL HAVING count(*) > 1
""")
def duplicated_keys(spark, sf):
    return dedup.duplicated_keys(table(spark, sf, "part"), ["p_name", "p_brand"])


@query("""
SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1
""")
def keep_first(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")
    return dedup.keep_first(orders, ["o_custkey"], "o_orderkey")


@query("""
SELECT user_id,
  arg_min(CASE WHEN event_type = 'purchase' THEN value END, event_id)
    FILTER (WHERE event_type = 'purchase') AS first_purchase,
  arg_min(CASE WHEN value > 100 THEN event_type END, event_id) FILTER (WHERE value > 100) AS first_large
FROM events GROUP BY 1
""")
def first_known_per_key(spark, sf):
    ev = table(spark, sf, "events").select(
        "user_id", "event_id",
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("first_purchase"),
        F.when(F.col("value") > 100, F.col("event_type")).alias("first_large"),
    )
    return dedup.first_known(ev, ["user_id"], ["first_purchase", "first_large"], "event_id")


@query("SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def exact_row_dedup(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").dropDuplicates()


# --------------------------------------------------------------------- filters


@query("""
SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS BIGINT) AS kept,
  CAST(count(DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END) AS BIGINT) AS customers_kept
FROM orders GROUP BY 1
""")
def filter_counters(spark, sf):
    urgent = F.col("o_orderpriority") == "1-URGENT"
    per = table(spark, sf, "orders").groupBy("o_orderstatus", "o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(urgent).alias("k")
    )
    return per.groupBy("o_orderstatus").agg(
        F.sum("n").alias("total"), F.sum("k").alias("kept"), F.count_if(F.col("k") > 0).alias("customers_kept")
    )


@query("""
SELECT p_partkey, p_name, p_brand, p_type FROM part
WHERE starts_with(p_brand, 'Brand#1') AND coalesce(p_type NOT IN ('PROMO', 'ECONOMY'), true)
  AND trim(p_name) <> '' AND p_name <> 'NA'
""")
def entity_row_filters(spark, sf):
    return table(spark, sf, "part").filter(
        S.has_prefix("p_brand", "Brand#1") & S.not_in("p_type", ["PROMO", "ECONOMY"]) & S.is_named("p_name")
    ).select("p_partkey", "p_name", "p_brand", "p_type")


@query("""
WITH m AS (SELECT l_partkey AS part, max(l_quantity * l_discount) AS top FROM lineitem GROUP BY 1)
SELECT t AS threshold, CAST(count(*) AS BIGINT) AS members FROM m, (VALUES (1.0::DOUBLE), (4.0::DOUBLE), (4.5::DOUBLE)) v(t)
WHERE top >= t GROUP BY 1
""")
def threshold_sets(spark, sf):
    top = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.max(F.col("l_quantity") * F.col("l_discount")).alias("top")
    )
    cuts = (1.0, 4.0, 4.5)
    counts = top.agg(*[F.count_if(F.col("top") >= c).alias(f"n{i}") for i, c in enumerate(cuts)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("threshold"), F.col(f"n{i}").alias("members")) for i, c in enumerate(cuts)
    ])))


@query("""
SELECT c_custkey, c_nationkey::BIGINT AS nation,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS measured,
  CASE WHEN c_acctbal >= 9000 THEN CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END
       ELSE least(greatest(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END, 100.0), 9000.0) END AS x
FROM customer WHERE NOT (c_acctbal < 0)
""")
def complete_rows(spark, sf):
    x = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    df = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("bigint").alias("nation"), x.alias("measured"),
        F.when(F.col("c_acctbal") >= 9000, x).otherwise(S.clip(x, 100.0, 9000.0)).alias("x"),
    )
    return df.dropna(subset=["measured", "x"], how="any").filter(S.is_finite("x"))


# ----------------------------------------------------------------------- joins

_SPEND = "SELECT o_custkey, sum(o_totalprice) AS spend FROM orders GROUP BY 1"


def _sources(spark, sf):
    orders = table(spark, sf, "orders")
    spend = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spend"))
    use = table(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.max("value").alias("top_value"), F.count(F.lit(1)).alias("n_events")
    )
    return [joins.Source(spend, ["spend"], 0.0, "orders"), joins.Source(use, None, None, "events")]


@query(f"""
SELECT c_custkey, c_name, round(coalesce(spend, 0), 2) AS spend, top_value, n_events
FROM customer LEFT JOIN ({_SPEND}) s ON c_custkey = o_custkey
LEFT JOIN (SELECT user_id, max(value) AS top_value, CAST(count(*) AS BIGINT) AS n_events FROM events GROUP BY 1) e
  ON c_custkey = user_id
""")
def left_join_sources(spark, sf):
    base = table(spark, sf, "customer").select("c_custkey", "c_name")
    out, _ = joins.attach_sources(base, _sources(spark, sf), "c_custkey")
    return out.withColumn("spend", F.round("spend", 2))


@query(f"""
SELECT 'orders' AS source, CAST(count(o_custkey) AS BIGINT) AS matched FROM customer LEFT JOIN ({_SPEND}) s ON c_custkey = o_custkey
UNION ALL
SELECT 'events', CAST(count(*) AS BIGINT) FROM customer WHERE c_custkey IN (SELECT user_id FROM events)
""")
def source_match_counts(spark, sf):
    base = table(spark, sf, "customer").select("c_custkey")
    return joins.attach_sources(base, _sources(spark, sf), "c_custkey")[1]


@query("""
SELECT s_suppkey, s_name, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey
FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def checked_join(spark, sf):
    base = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey"))
    out = joins.attach_checked(base, table(spark, sf, "nation"), "n_nationkey", ["n_name", "n_regionkey"])
    return shaped(out.drop("n_nationkey"))


_PANEL = "SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3)"


def _panel(spark, sf):
    return table(spark, sf, "nation").filter(F.col("n_regionkey").isin(1, 3)).select("n_nationkey")


@query(f"SELECT s_suppkey, CAST(s_nationkey IN ({_PANEL}) AS BIGINT) AS in_panel FROM supplier")
def membership_flag(spark, sf):
    out = joins.flag_members(
        table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", _panel(spark, sf), "n_nationkey", "in_panel"
    )
    return shaped(out.drop("s_nationkey"))


@query(f"SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN ({_PANEL})")
def panel_semi(spark, sf):
    return joins.only_members(table(spark, sf, "supplier"), "s_nationkey", _panel(spark, sf), "n_nationkey").select("s_suppkey", "s_name")


@query(f"SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey NOT IN ({_PANEL})")
def panel_anti(spark, sf):
    return joins.without_members(table(spark, sf, "supplier"), "s_nationkey", _panel(spark, sf), "n_nationkey").select("s_suppkey", "s_name")


@query("""
WITH m AS (SELECT p_name, arg_max(p_brand, p_partkey) AS last_brand, arg_min(p_brand, p_partkey) AS first_brand
           FROM part WHERE p_size > 25 GROUP BY 1)
SELECT p_partkey, p_name, coalesce(last_brand, p_name) AS last_brand, first_brand FROM part LEFT JOIN m USING (p_name)
""")
def lookup_with_default(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    big = part.filter("p_size > 25")
    last = joins.keyed_values(big, "p_name", "p_brand", "p_partkey", "last")
    first = joins.keyed_values(big, "p_name", "p_brand", "p_partkey", "first")
    out = joins.look_up(part, "p_name", last, "p_name", "p_brand", "last_brand", F.col("p_name"))
    out = joins.look_up(out, "p_name", first, "p_name", "p_brand", "first_brand")
    return out.select("p_partkey", "p_name", "last_brand", "first_brand")


@query(f"""
SELECT c_custkey, c_name, rank, spend FROM (
  SELECT c_custkey, c_name, round(coalesce(spend, 0), 2) AS spend,
    row_number() OVER (ORDER BY round(coalesce(spend, 0), 2) DESC, c_custkey) AS rank
  FROM customer LEFT JOIN ({_SPEND}) s ON c_custkey = o_custkey)
""")
def zero_filled_universe(spark, sf):
    spend = _sources(spark, sf)[0].df
    full = joins.attach_zero_filled(table(spark, sf, "customer").select("c_custkey", "c_name"), spend, "c_custkey", "spend")
    full = full.withColumn("spend", F.round("spend", 2))
    return joins.place_after(ordering.row_rank(full, [("spend", "desc"), ("c_custkey", "asc")]), "rank", "c_name")


# ------------------------------------------------------------------------ sets

_YEARS = """
WITH a AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE year(o_orderdate) = 1997),
     b AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE year(o_orderdate) = 1998),
     n AS (SELECT (SELECT count(*) FROM a) AS l, (SELECT count(*) FROM b) AS r,
                  (SELECT count(*) FROM a WHERE c IN (SELECT c FROM b)) AS k)
"""


def _year_sets(spark, sf):
    orders = table(spark, sf, "orders")
    return sets.membership({
        "y97": orders.filter(F.year("o_orderdate") == 1997).select("o_custkey"),
        "y98": orders.filter(F.year("o_orderdate") == 1998).select("o_custkey"),
    })


@query(_YEARS + """
SELECT unnest(['left', 'right', 'both', 'only_left', 'only_right', 'union', 'pct_left_in_right', 'pct_right_in_left', 'jaccard_pct']) AS metric,
       unnest([l::DOUBLE, r::DOUBLE, k::DOUBLE, (l - k)::DOUBLE, (r - k)::DOUBLE, (l + r - k)::DOUBLE,
               round(100.0::DOUBLE * k / l, 1), round(100.0::DOUBLE * k / r, 1), round(100.0::DOUBLE * k / (l + r - k), 1)]) AS value
FROM n
""")
def overlap_report(spark, sf):
    return sets.overlap_report(_year_sets(spark, sf), "y97", "y98")


@query(_YEARS + """
SELECT c AS entity, CAST(c IN (SELECT c FROM a) AS BIGINT) AS y97, CAST(c IN (SELECT c FROM b) AS BIGINT) AS y98
FROM (SELECT c FROM a UNION SELECT c FROM b)
""")
def set_membership(spark, sf):
    return shaped(_year_sets(spark, sf))


@query(f"""
SELECT CAST(count(DISTINCT l_partkey) AS BIGINT) AS n_items,
  CAST(count(DISTINCT l_partkey) FILTER (WHERE s_nationkey IN ({_PANEL})) AS BIGINT) AS n_items_hit,
  round(100.0::DOUBLE * count(DISTINCT l_partkey) FILTER (WHERE s_nationkey IN ({_PANEL})) / count(DISTINCT l_partkey), 1) AS pct_hit
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
""")
def fact_overlap(spark, sf):
    sup = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    flagged = joins.flag_members(sup, "s_nationkey", _panel(spark, sf), "n_nationkey", "hit")
    facts = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").join(flagged, F.col("l_suppkey") == F.col("s_suppkey"))
    return sets.fact_overlap(facts, "l_partkey", "hit")


@query("""
SELECT o_orderstatus AS condition, o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL
""")
def stacked_conditions(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.groupBy(F.col("o_orderstatus").alias("condition"), "o_custkey").agg(F.count(F.lit(1)).alias("n"))


# -------------------------------------------------------------------- grouping


@query("""
SELECT c_nationkey::BIGINT AS c_nationkey, string_agg(DISTINCT c_mktsegment, '; ' ORDER BY c_mktsegment) AS segments,
  string_agg(DISTINCT c_name, '; ' ORDER BY c_name) AS names,
  CAST(count(DISTINCT c_name) AS BIGINT) AS n_names, CAST(count(DISTINCT c_mktsegment) AS BIGINT) AS n_segments,
  any_value(n_name) AS nation
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
""")
def collapse_lists(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    cust = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    cust = cust.withColumnsRenamed({"c_mktsegment": "segments", "c_name": "names"})
    return shaped(grouping.collapse(
        cust, ["c_nationkey"], lists=["segments", "names"], counts={"n_names": "names", "n_segments": "segments"},
        constants=["nation"],
    ))


@query("""
WITH v AS (SELECT DISTINCT c_nationkey, c_mktsegment || ':' || c_name AS v FROM customer),
p AS (SELECT c_nationkey, v, CAST((sum(length(v) + 2) OVER (PARTITION BY c_nationkey ORDER BY v) - length(v) - 2) // 400 AS BIGINT) AS part FROM v)
SELECT c_nationkey, part, string_agg(v, '; ' ORDER BY v) AS values FROM p GROUP BY ALL
""")
def list_parts(spark, sf):
    """Long lists as numbered parts of bounded length."""
    cust = table(spark, sf, "customer").select("c_nationkey", F.concat_ws(":", "c_mktsegment", "c_name").alias("v"))
    return grouping.list_parts(cust, ["c_nationkey"], "v", 400)


@query("""
SELECT l_partkey, l_suppkey, max(l_quantity) AS top FROM lineitem
WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY ALL
""")
def group_maximum(spark, sf):
    li = table(spark, sf, "lineitem").dropna(subset=["l_partkey", "l_suppkey"])
    return li.groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("top"))


@query("""
SELECT CAST(count(*) AS BIGINT) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, round(max(n) / sum(n)::DOUBLE, 6) AS largest_share
FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1)
""")
def group_share(spark, sf):
    return shaped(grouping.group_share(table(spark, sf, "part"), "p_type"))


@query("""
SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE o_totalprice > 250000) AS BIGINT) AS large,
  CAST(count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS BIGINT) AS low,
  CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers
FROM orders GROUP BY 1
""")
def conditional_tallies(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 250000).alias("large"),
        F.count_if(F.col("o_orderpriority") == "5-LOW").alias("low"), F.count_distinct("o_custkey").alias("customers"),
    )


_TYPES = ["click", "view", "error"]


@query("SELECT user_id, " + ", ".join(
    f"round(avg(value) FILTER (WHERE event_type = '{e}'), 6) AS {e}_mean, "
    f"nullif(CAST(count(*) FILTER (WHERE event_type = '{e}') AS BIGINT), 0) AS {e}_n" for e in _TYPES
) + " FROM events GROUP BY 1")
def pivot_metrics(spark, sf):
    long = table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")
    )
    return shaped(grouping.pivot_once(long, "user_id", "event_type", _TYPES, ["mean", "n"]))


@query("SELECT user_id, " + ", ".join(
    f"arg_min(value, event_id) FILTER (WHERE event_type = '{e}') AS {e}_value" for e in _TYPES
) + " FROM events GROUP BY 1")
def pivot_first_value(spark, sf):
    return grouping.pivot_first(table(spark, sf, "events"), "user_id", "event_type", _TYPES, ["value"], "event_id")


@query("""
WITH b AS (SELECT CAST(min(n_chars) AS DOUBLE) AS lo, (max(n_chars) - min(n_chars)) / 45.0::DOUBLE AS w FROM documents),
h AS (SELECT lang, CAST(greatest(1, least(45, ceil((n_chars - lo) / w))) AS BIGINT) AS bin, lo, w FROM documents, b WHERE n_chars IS NOT NULL)
SELECT lang, bin, round(any_value(lo + (bin - 0.5) * w), 4) AS mid, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY 1, 2
""")
def histogram_by_group(spark, sf):
    return shaped(grouping.equal_width_bins(table(spark, sf, "documents"), "n_chars", 45, ["lang"]), 4)


@query("""
WITH b AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 80.0::DOUBLE AS w FROM orders),
h AS (SELECT CAST(greatest(1, least(80, ceil((o_totalprice - lo) / w))) AS BIGINT) AS bin, lo, w FROM orders, b)
SELECT bin, round(any_value(lo + (bin - 0.5) * w), 4) AS mid, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY 1
""")
def histogram_over_range(spark, sf):
    return shaped(grouping.equal_width_bins(table(spark, sf, "orders"), "o_totalprice", 80), 4)


@query("""
SELECT o_orderpriority, CAST(count(o_totalprice) AS BIGINT) AS n, round(avg(o_totalprice), 4) AS mean,
  round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50,
  round(quantile_cont(o_totalprice, 0.75), 4) AS q75
FROM orders GROUP BY 1
""")
def group_distribution(spark, sf):
    return shaped(grouping.distribution(
        table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"], {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    ), 4)


@query("""
WITH t AS (SELECT p_name, count(*) AS c FROM part GROUP BY 1 ORDER BY c DESC, p_name LIMIT 8)
SELECT coalesce(t.p_name, 'other') AS hub, CAST(count(*) AS BIGINT) AS n, CAST(sum(p_size) AS BIGINT) AS total_size
FROM part LEFT JOIN t USING (p_name) GROUP BY 1
""")
def frequent_or_other(spark, sf):
    out = grouping.frequent_or_other(table(spark, sf, "part"), "p_name", 8, "hub")
    return out.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("total_size"))


_REVENUE = """
WITH r AS (SELECT n_name AS nation, 'y' || year(o_orderdate) AS yr, round(sum(o_totalprice), 2) AS revenue
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE year(o_orderdate) IN (1996, 1997, 1998) GROUP BY 1, 2)
"""


def _revenue(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    cust = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"))
    year = F.year("o_orderdate")
    orders = table(spark, sf, "orders").select("o_custkey", year.alias("y"), "o_totalprice").filter(F.col("y").isin(1996, 1997, 1998))
    return orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        "nation", F.concat(F.lit("y"), F.col("y")).alias("yr")
    ).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query(_REVENUE + """,
g AS (SELECT nation, greatest(
    abs(max(revenue) FILTER (WHERE yr = 'y1996') - max(revenue) FILTER (WHERE yr = 'y1997')),
    abs(max(revenue) FILTER (WHERE yr = 'y1996') - max(revenue) FILTER (WHERE yr = 'y1998'))) AS gap
  FROM r GROUP BY 1 ORDER BY gap DESC NULLS LAST, nation LIMIT 15)
SELECT nation, yr, revenue, round(gap, 2) AS gap FROM r JOIN g USING (nation)
""")
def gap_ranking(spark, sf):
    out = grouping.gap_ranking(_revenue(spark, sf), "nation", "yr", "revenue", "y1996", ["y1997", "y1998"], 15)
    return out.withColumn("gap", F.round("gap", 2)).select("nation", "yr", "revenue", "gap")


# --------------------------------------------------------------------- symbols

_AUTHORITY = """
auth AS (SELECT c_custkey AS row_id, 'S' || c_custkey AS symbol,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Withdrawn' ELSE 'Approved' END AS status,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'S' || (c_custkey + 1) || '|OLD' || c_custkey
                    WHEN 'HOUSEHOLD' THEN '|S' || (c_custkey + 3) ELSE '' END AS prev,
  CASE c_mktsegment WHEN 'FURNITURE' THEN 'S' || (c_custkey + 2) || '| ' ELSE '' END AS ali FROM customer),
prevs AS (SELECT p AS name, arg_min(symbol, row_id) AS target
  FROM (SELECT row_id, symbol, unnest(string_split(prev, '|')) AS p FROM auth WHERE status = 'Approved')
  WHERE trim(p) <> '' GROUP BY 1),
alis AS (SELECT DISTINCT p AS name FROM (SELECT unnest(string_split(ali, '|')) AS p FROM auth WHERE status = 'Approved') WHERE trim(p) <> ''),
genes AS (SELECT 'S' || o_custkey AS gene, CAST(count(*) AS BIGINT) AS n_large FROM orders GROUP BY 1),
cls AS (SELECT gene, n_large, CASE
    WHEN gene IN (SELECT symbol FROM auth WHERE status = 'Approved') THEN 'approved'
    WHEN gene IN (SELECT name FROM prevs) THEN 'previous_symbol'
    WHEN gene IN (SELECT name FROM alis) THEN 'alias_symbol' ELSE 'not_found' END AS status FROM genes)
"""


def _authority(spark, sf):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    return table(spark, sf, "customer").select(
        k.alias("row_id"), text("S", k).alias("symbol"),
        F.when(seg == "MACHINERY", "Withdrawn").otherwise("Approved").alias("status"),
        F.when(seg == "BUILDING", text("S", k + 1, "|OLD", k)).when(seg == "HOUSEHOLD", text("|S", k + 3)).otherwise("").alias("prev_symbol"),
        F.when(seg == "FURNITURE", text("S", k + 2, "| ")).otherwise("").alias("alias_symbol"),
    )


def _genes(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.groupBy(F.concat(F.lit("S"), "o_custkey").alias("gene")).agg(F.count(F.lit(1)).alias("n_large"))


@query("WITH " + _AUTHORITY + "SELECT gene, status FROM cls")
def classify_symbols(spark, sf):
    index = symbols.symbol_index(_authority(spark, sf))
    return symbols.classify(_genes(spark, sf), index, "gene").select("gene", "status")


@query("WITH " + _AUTHORITY + """
SELECT status, CAST(count(*) AS BIGINT) AS n,
  round(100.0::DOUBLE * (SELECT count(*) FROM cls WHERE status = 'approved') / (SELECT count(*) FROM cls), 1) AS approved_pct
FROM cls GROUP BY 1
""")
def symbol_status_summary(spark, sf):
    index = symbols.symbol_index(_authority(spark, sf))
    return symbols.status_summary(symbols.classify(_genes(spark, sf), index, "gene"))


@query("WITH " + _AUTHORITY + """
SELECT CASE WHEN status = 'previous_symbol' THEN target ELSE gene END AS gene, n_large
FROM cls LEFT JOIN prevs ON gene = name
WHERE NOT (status = 'previous_symbol' AND target IN (SELECT gene FROM genes))
""")
def harmonize_symbols(spark, sf):
    index = symbols.symbol_index(_authority(spark, sf))
    return symbols.harmonize(_genes(spark, sf), index, "gene")[0]


@query("WITH " + _AUTHORITY + """,
moved AS (SELECT gene, target, target IN (SELECT gene FROM genes) AS taken FROM cls JOIN prevs ON gene = name WHERE status = 'previous_symbol')
SELECT gene AS name, target, CAST(taken AS BIGINT) AS dropped, CAST(1 AS BIGINT) AS n_rows FROM moved
""")
def harmonize_report(spark, sf):
    """Every previous symbol met, one row each: its target and whether its row was dropped for it."""
    index = symbols.symbol_index(_authority(spark, sf))
    return shaped(symbols.harmonize(_genes(spark, sf), index, "gene")[1])


@query("WITH " + _AUTHORITY + """
SELECT gene, CASE WHEN status = 'previous_symbol' THEN target ELSE gene END AS gene_current, n_large
FROM cls LEFT JOIN prevs ON gene = name
""")
def canonical_symbols(spark, sf):
    index = symbols.symbol_index(_authority(spark, sf))
    return symbols.canonical(_genes(spark, sf), index, "gene", "gene_current").select("gene", "gene_current", "n_large")


def _profile_sql(column: str, source: str) -> str:
    return f"""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT s) AS BIGINT) AS unique_n,
  CAST(count(*) FILTER (WHERE s <> trim(s)) AS BIGINT) AS whitespace,
  CAST(count(*) FILTER (WHERE contains(s, ' ')) AS BIGINT) AS space,
  CAST(count(*) FILTER (WHERE trim(s) = '' OR s = 'NA') AS BIGINT) AS empty_or_na,
  CAST(count(*) - count(DISTINCT s) AS BIGINT) AS duplicates,
  CAST(count(DISTINCT CASE WHEN NOT regexp_matches(s, '^[A-Z0-9][A-Za-z0-9._-]*$') THEN s END) AS BIGINT) AS nonstandard_n,
  coalesce((SELECT string_agg(DISTINCT ch, '' ORDER BY ch) FROM (
     SELECT unnest(regexp_extract_all(s, '[^\\p{{L}}\\p{{N}}]')) AS ch FROM {source} t({column}, s))), '') AS special_chars
FROM {source} t({column}, s)
"""


@query(_profile_sql("k", "(SELECT p_partkey, CASE WHEN p_size = 7 THEN ' ' || p_name WHEN p_size = 9 THEN 'NA' ELSE p_brand || '-' || p_type END FROM part)"))
def format_profile(spark, sf):
    size = F.col("p_size")
    spelled = F.when(size == 7, F.concat(F.lit(" "), "p_name")).when(size == 9, "NA").otherwise(F.concat_ws("-", "p_brand", "p_type"))
    return symbols.format_profile(table(spark, sf, "part").select(spelled.alias("s")), "s")


@query("SELECT DISTINCT p_name FROM part WHERE NOT regexp_matches(p_name, '^[A-Z0-9][A-Za-z0-9._-]*$')")
def nonstandard_symbols(spark, sf):
    return symbols.nonstandard_symbols(table(spark, sf, "part"), "p_name")


# ------------------------------------------------------------- nested documents

_MOA_TYPE = "CASE WHEN l_tax < 0.02 THEN '' ELSE p_type END"


def _pages(spark, sf):
    """One landed page per order line: target, one candidate, up to two indications."""
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    li = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    stage = F.when(F.col("l_returnflag") == "A", "APPROVAL").when(F.col("l_returnflag") == "N", "PHASE_3").otherwise("PHASE_2")
    moa = F.array(
        F.struct(F.col("p_type").alias("mechanismOfAction"), F.when(F.col("l_tax") < 0.02, "").otherwise(F.col("p_type")).alias("actionType")),
        F.struct(F.concat(F.lit("on "), "l_linestatus").alias("mechanismOfAction"), F.col("l_linestatus").alias("actionType")),
        F.struct(F.col("p_type").alias("mechanismOfAction"), F.lit(None).cast("string").alias("actionType")),
    )
    num = F.col("l_linenumber").cast("string")
    ill = lambda name, id_: F.struct(
        F.concat(F.lit("source "), num).alias("diseaseFromSource"), F.struct(id_.alias("id"), name.alias("name")).alias("disease"))
    listed = F.array(
        ill(F.concat(F.lit("illness "), num), F.concat(F.lit("D"), num)),
        ill(F.lit("").cast("string"), F.lit(None).cast("string")),
    )
    none = F.array().cast(listed_type())
    return li.select(F.struct(
        F.col("p_brand").alias("approvedSymbol"),
        F.struct(F.array(F.struct(
            stage.alias("maxClinicalStage"),
            F.struct(F.col("p_name").alias("name"), F.struct(moa.alias("rows")).alias("mechanismsOfAction")).alias("drug"),
            F.when(F.col("l_discount") == 0, none).otherwise(listed).alias("diseases"),
        )).alias("rows")).alias("drugAndClinicalCandidates"),
    ).alias("target"))


def listed_type() -> str:
    return "array<struct<diseaseFromSource:string,disease:struct<id:string,name:string>>>"


def _descendants(spark, sf):
    ids = table(spark, sf, "lineitem").filter(F.col("l_linenumber") <= 3)
    return ids.select(F.concat(F.lit("D"), "l_linenumber").alias("id")).distinct()


_FLAT = f"""
WITH base AS (SELECT p_brand AS target, p_name AS drug_name,
    p_type || '; on ' || l_linestatus AS action,
    CASE WHEN l_tax < 0.02 THEN l_linestatus ELSE p_type || '; ' || l_linestatus END AS action_type,
    CASE l_returnflag WHEN 'A' THEN 'APPROVAL' WHEN 'N' THEN 'PHASE_3' ELSE 'PHASE_2' END AS max_clinical_stage,
    CASE WHEN l_discount = 0 THEN [{{'n': '', 'i': ''}}]
      ELSE [{{'n': 'illness ' || l_linenumber, 'i': 'D' || l_linenumber}}, {{'n': 'source ' || l_linenumber, 'i': ''}}] END AS ds
  FROM lineitem JOIN part ON l_partkey = p_partkey),
ex AS (SELECT target, drug_name, action, action_type, max_clinical_stage, unnest(ds) AS d FROM base),
flat AS (SELECT DISTINCT target, drug_name, action, action_type, d.n AS specific_disease, d.i AS specific_disease_id,
    'immune system disorder' AS broad_category, max_clinical_stage,
    CAST(d.i IN ('D1', 'D2', 'D3', 'MONDO_0005046') AS BIGINT) AS immune_indication FROM ex)
"""


@query(_FLAT + "SELECT * FROM flat")
def flatten_nested(spark, sf):
    return shaped(drug_table.flatten_targets(_pages(spark, sf), _descendants(spark, sf)))


@query(_FLAT + """
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE immune_indication = 1) AS BIGINT) AS kept_immune,
  CAST(count(*) FILTER (WHERE max_clinical_stage = 'APPROVAL') AS BIGINT) AS kept_approved,
  CAST(count(DISTINCT drug_name) FILTER (WHERE immune_indication = 1) AS BIGINT) AS drugs_immune FROM flat
""")
def program_filter_counts(spark, sf):
    return drug_table.filter_counts(drug_table.flatten_targets(_pages(spark, sf), _descendants(spark, sf)))


@query(_FLAT + """
SELECT target, action_type, string_agg(DISTINCT action, '; ' ORDER BY action) AS action,
  string_agg(DISTINCT drug_name, '; ' ORDER BY drug_name) AS drug_name,
  string_agg(DISTINCT specific_disease, '; ' ORDER BY specific_disease) AS specific_disease,
  CAST(count(DISTINCT drug_name) AS BIGINT) AS num_drugs, CAST(count(DISTINCT specific_disease) AS BIGINT) AS num_diseases,
  any_value(broad_category) AS broad_category, any_value(max_clinical_stage) AS max_clinical_stage, any_value(immune_indication) AS immune_indication
FROM flat WHERE immune_indication = 1 AND max_clinical_stage = 'APPROVAL' GROUP BY 1, 2
""")
def grouped_programs(spark, sf):
    flat = drug_table.flatten_targets(_pages(spark, sf), _descendants(spark, sf))
    return shaped(drug_table.grouped_programs(drug_table.approved_only(drug_table.immune_only(flat))))


@query(_FLAT + "SELECT DISTINCT target, drug_name, max_clinical_stage FROM flat WHERE max_clinical_stage = 'APPROVAL'")
def approved_pairs(spark, sf):
    return drug_table.approved_pairs(drug_table.flatten_targets(_pages(spark, sf), _descendants(spark, sf)))


@query(_FLAT + """,
names AS (SELECT target, string_agg(DISTINCT drug_name, '; ' ORDER BY drug_name) AS d FROM flat WHERE max_clinical_stage = 'APPROVAL' GROUP BY 1)
SELECT s_suppkey, 'Brand#' || (s_nationkey + 3) AS nearest, coalesce(d, '') AS anchor_drugs
FROM supplier LEFT JOIN names ON target = 'Brand#' || (s_nationkey + 3)
""")
def anchor_drugs(spark, sf):
    flat = drug_table.flatten_targets(_pages(spark, sf), _descendants(spark, sf))
    cand = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), F.col("s_nationkey") + 3).alias("nearest"))
    return drug_table.with_anchor_drugs(cand, drug_table.approved_pairs(flat), "nearest", "anchor_drugs")


_RETAIL = "SELECT l_partkey, max(l_extendedprice) AS top FROM lineitem GROUP BY 1"


def _score_pages(spark, sf):
    top = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.max("l_extendedprice").alias("top"))
    score = lambda name, v: F.struct(F.lit(name).alias("id"), v.alias("score"))
    return top.select(
        F.struct(F.concat(F.lit("E"), "l_partkey").alias("id"), F.concat(F.lit("S"), "l_partkey").alias("approvedSymbol")).alias("target"),
        F.when(F.col("l_partkey") > 50, F.array(score("other", F.lit(9.0)), score("gwas_credible_sets", F.col("top"))))
        .otherwise(F.array(score("other", F.lit(9.0)))).alias("datasourceScores"),
    )


_RANKED = "WITH " + _AUTHORITY + f""",
raw AS (SELECT 'S' || l_partkey AS gene, 'E' || l_partkey AS ensembl_id, CASE WHEN l_partkey > 50 THEN top END AS score FROM ({_RETAIL})),
kind AS (SELECT raw.*, target, gene NOT IN (SELECT symbol FROM auth WHERE status = 'Approved') AND target IS NOT NULL AS moved
  FROM raw LEFT JOIN prevs ON gene = name),
kept AS (SELECT CASE WHEN moved THEN target ELSE gene END AS gene, ensembl_id, score FROM kind
  WHERE NOT (moved AND target IN (SELECT gene FROM raw)))
"""


@query(_RANKED + """
SELECT row_number() OVER (ORDER BY score DESC NULLS LAST, gene) AS rank, gene, ensembl_id, score AS gwas_score FROM kept
""")
def association_scores(spark, sf):
    index = symbols.symbol_index(_authority(spark, sf))
    return entity_table.association_scores(_score_pages(spark, sf), index)


@query(_RANKED + """,
u AS (SELECT DISTINCT 'S' || p_partkey AS gene FROM part),
uk AS (SELECT u.gene, target, u.gene NOT IN (SELECT symbol FROM auth WHERE status = 'Approved') AND target IS NOT NULL AS moved
  FROM u LEFT JOIN prevs ON u.gene = name),
un AS (SELECT CASE WHEN moved THEN target ELSE gene END AS gene FROM uk WHERE NOT (moved AND target IN (SELECT gene FROM u)))
SELECT un.gene, coalesce(score, 0) AS gwas_score FROM un LEFT JOIN kept USING (gene)
""")
def zero_filled_scores(spark, sf):
    index = symbols.symbol_index(_authority(spark, sf))
    scores = entity_table.association_scores(_score_pages(spark, sf), index)
    universe = table(spark, sf, "part").select(F.concat(F.lit("S"), "p_partkey").alias("gene"))
    return entity_table.zero_filled_scores(universe, scores, index)


# ------------------------------------------------------------ the entity table


def _constraint(spark, sf):
    """Order lines as a raw entity table with unusable ids, excluded groups and blank names."""
    part = table(spark, sf, "part")
    return part.select(
        F.when(F.col("p_size") == 11, "NA").when(F.col("p_size") == 12, "  ")
        .when(F.col("p_size") == 13, F.concat(F.lit("D"), F.col("p_retailprice").cast("bigint")))
        .otherwise(F.concat(F.lit("S"), "p_partkey")).alias("gene"),
        F.when(F.col("p_type") == "PROMO", "ENST1").otherwise(F.concat(F.lit("ENSG"), "p_partkey")).alias("gene_id"),
        F.when(F.col("p_brand") == "Brand#5", "chrX").when(F.col("p_brand") == "Brand#6", None).otherwise("chr1").alias("chromosome"),
        F.when(F.col("p_size") < 5, "NA").otherwise(F.col("p_size").cast("string")).alias("lof_oe_ci_upper"),
        F.col("p_size").cast("string").alias("mis_z_score"),
    )


_BUILD = "WITH " + _AUTHORITY + f""",
raw AS (SELECT CASE p_size WHEN 11 THEN 'NA' WHEN 12 THEN '  ' WHEN 13 THEN 'D' || CAST(floor(p_retailprice) AS BIGINT) ELSE 'S' || p_partkey END AS gene,
    CASE WHEN p_type = 'PROMO' THEN 'ENST1' ELSE 'ENSG' || p_partkey END AS gene_id,
    CASE p_brand WHEN 'Brand#5' THEN 'chrX' WHEN 'Brand#6' THEN NULL ELSE 'chr1' END AS chromosome,
    CASE WHEN p_size < 5 THEN 'NA' ELSE p_size::VARCHAR END AS lof_oe_ci_upper, p_size::VARCHAR AS mis_z_score FROM part),
f AS (SELECT * FROM raw WHERE starts_with(gene_id, 'ENSG') AND coalesce(chromosome NOT IN ('chrX', 'chrY', 'X', 'Y'), true)
    AND trim(gene) <> '' AND gene <> 'NA'),
uq AS (SELECT * FROM f QUALIFY count(*) OVER (PARTITION BY gene) = 1),
k AS (SELECT uq.*, target, gene NOT IN (SELECT symbol FROM auth WHERE status = 'Approved') AND target IS NOT NULL AS moved
    FROM uq LEFT JOIN prevs ON gene = name),
h AS (SELECT * REPLACE (CASE WHEN moved THEN target ELSE gene END AS gene) FROM k WHERE NOT (moved AND target IN (SELECT gene FROM uq))),
src AS (SELECT 'S' || l_partkey AS gene, max(l_quantity) AS score FROM lineitem GROUP BY 1),
sk AS (SELECT src.*, target, gene NOT IN (SELECT symbol FROM auth WHERE status = 'Approved') AND target IS NOT NULL AS moved
    FROM src LEFT JOIN prevs ON gene = name),
s AS (SELECT CASE WHEN moved THEN target ELSE gene END AS gene, score FROM sk WHERE NOT (moved AND target IN (SELECT gene FROM src))),
panel AS (SELECT DISTINCT 'S' || c_custkey AS gene FROM customer WHERE c_nationkey IN ({_PANEL}))
"""


def _build(spark, sf):
    index = symbols.symbol_index(_authority(spark, sf))
    li = table(spark, sf, "lineitem")
    score = li.groupBy(F.concat(F.lit("S"), "l_partkey").alias("gene")).agg(F.max("l_quantity").alias("score"))
    cust = joins.only_members(table(spark, sf, "customer"), "c_nationkey", _panel(spark, sf), "n_nationkey")
    panel = cust.select(F.concat(F.lit("S"), "c_custkey").alias("gene"))
    src = [joins.Source(score.withColumnRenamed("score", "gwas_score"), ["gwas_score"], 0.0, "filled"),
           joins.Source(score.withColumnRenamed("score", "assay"), None, None, "measured")]
    return entity_table.build(_constraint(spark, sf), index, panel, src)


@query(_BUILD + """
SELECT h.gene, h.gene_id, lof_oe_ci_upper, mis_z_score, CAST(h.gene IN (SELECT gene FROM panel) AS BIGINT) AS iei,
  coalesce(score, 0) AS gwas_score, score AS assay FROM h LEFT JOIN s USING (gene)
""")
def entity_table_build(spark, sf):
    return shaped(_build(spark, sf)[0])


@query(_BUILD + """
SELECT unnest(['filled', 'measured']) AS source, unnest([n, n]) AS matched
FROM (SELECT CAST(count(score) AS BIGINT) AS n FROM h LEFT JOIN s USING (gene))
""")
def entity_table_matches(spark, sf):
    return _build(spark, sf)[1]


@query(_BUILD + """
SELECT CAST((SELECT count(*) FROM raw) AS BIGINT) AS input,
  CAST((SELECT count(*) FROM raw WHERE starts_with(gene_id, 'ENSG')) AS BIGINT) AS keep_ensg,
  CAST((SELECT count(*) FROM raw WHERE coalesce(chromosome NOT IN ('chrX', 'chrY', 'X', 'Y'), true)) AS BIGINT) AS keep_autosomal,
  CAST((SELECT count(*) FROM raw WHERE trim(gene) <> '' AND gene <> 'NA') AS BIGINT) AS keep_named,
  CAST((SELECT count(*) FROM f) AS BIGINT) AS kept,
  CAST((SELECT count(*) FROM (SELECT gene FROM f GROUP BY 1 HAVING count(*) > 1)) AS BIGINT) AS duplicated_symbols,
  CAST((SELECT count(*) FROM f) - (SELECT count(*) FROM uq) AS BIGINT) AS duplicated_rows,
  CAST((SELECT count(*) FROM k WHERE moved AND target NOT IN (SELECT gene FROM uq)) AS BIGINT) AS renamed,
  CAST((SELECT count(*) FROM k WHERE moved AND target IN (SELECT gene FROM uq)) AS BIGINT) AS dropped,
  CAST((SELECT count(*) FROM h) AS BIGINT) AS final
""")
def entity_table_audit(spark, sf):
    return shaped(_build(spark, sf)[2])


# ------------------------------------------------------------- scalars and text


@query("""
SELECT p_partkey, CAST(regexp_matches(p_brand, '^[A-Z0-9][A-Za-z0-9._-]*$') AS BIGINT) AS well_formed,
  'PFX:' || upper(substr(p_name, 1, 3)) AS prefix_family,
  string_split(p_name, ' ')[1] AS first_token, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS n_tokens,
  TRY_CAST(replace(p_brand, 'Brand#', CASE WHEN p_size > 40 THEN 'x' ELSE '' END) AS DOUBLE) AS coerced,
  round(sign(p_size - 25) * -log10(greatest(p_size / 60.0::DOUBLE, 1e-300::DOUBLE)), 6) AS signed_log,
  CASE WHEN p_size / 500.0::DOUBLE < 0.001 THEN '***' WHEN p_size / 500.0::DOUBLE < 0.01 THEN '**'
       WHEN p_size / 500.0::DOUBLE < 0.05 THEN '*' ELSE 'ns' END AS stars,
  least(greatest(p_retailprice, 950.0::DOUBLE), 1900.0::DOUBLE) AS clipped,
  greatest(abs(p_size - 30), abs(10 - p_size))::DOUBLE AS max_abs,
  CAST(sign(p_size - 20) = sign(p_retailprice - 1000) AS BIGINT) AS same_sign,
  printf('%d / %d = %.1f%%', p_size, 51, 100.0 * p_size / 51) AS rate
FROM part
""")
def scalar_expressions(spark, sf):
    size, price = F.col("p_size"), F.col("p_retailprice")
    raw = F.regexp_replace("p_brand", "Brand#", F.when(size > 40, F.lit("x")).otherwise(F.lit("")))
    return shaped(table(spark, sf, "part").select(
        "p_partkey", S.well_formed("p_brand").alias("well_formed"),
        F.concat(F.lit("PFX:"), F.upper(F.substring("p_name", 1, 3))).alias("prefix_family"),
        F.get(S.tokens("p_name", " "), F.lit(0)).alias("first_token"), F.size(S.tokens("p_name", " ")).alias("n_tokens"),
        S.number(raw).alias("coerced"), S.signed_log10(size - 25, size / 60.0).alias("signed_log"),
        S.stars(size / 500.0).alias("stars"), S.clip(price, 950.0, 1900.0).alias("clipped"),
        S.max_abs(size - 30, 10 - size).cast("double").alias("max_abs"),
        S.same_sign(size - 20, price - 1000).alias("same_sign"), S.rate_text(size, F.lit(51)).alias("rate"),
    ))


@query("""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Approved' WHEN '2-HIGH' THEN 'Phase III'
    WHEN '3-MEDIUM' THEN 'Phase I/II' ELSE '' END AS label,
  CASE o_orderpriority WHEN '1-URGENT' THEN 4.0::DOUBLE WHEN '2-HIGH' THEN 3.0::DOUBLE WHEN '3-MEDIUM' THEN 1.5::DOUBLE
    WHEN '4-NOT SPECIFIED' THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS number,
  ['low', 'mid', 'high'][CAST(o_orderkey % 4 AS INT) + 1] AS decoded
FROM orders
""")
def ordinal_and_category_maps(spark, sf):
    stage = (F.when(F.col("o_orderpriority") == "1-URGENT", "APPROVAL").when(F.col("o_orderpriority") == "2-HIGH", "PHASE_3")
             .when(F.col("o_orderpriority") == "3-MEDIUM", "PHASE_1_2").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "PHASE_0"))
    code = F.when(F.col("o_orderkey") % 4 == 3, -1).otherwise(F.col("o_orderkey") % 4).cast("int")
    return table(spark, sf, "orders").select(
        "o_orderkey", S.stage_label(stage).alias("label"), S.stage_number(stage).alias("number"),
        S.decoded(code, F.array(F.lit("low"), F.lit("mid"), F.lit("high"))).alias("decoded"),
    )


@query("""
SELECT event_id, '{"kind":"' || event_type || '","k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS doc FROM events
""")
def json_export(spark, sf):
    k = F.from_json("props", "k int")["k"]
    nested = table(spark, sf, "events").select("event_id", F.struct(F.col("event_type").alias("kind"), k.alias("k")).alias("doc"))
    return writers.nested_as_json(nested)


@query("""
SELECT c_name, c_mktsegment, printf('%.6f', c_acctbal) AS balance, CASE WHEN c_acctbal < 0 THEN 'NA' ELSE c_mktsegment END AS code,
  CASE WHEN c_acctbal < 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS guarded FROM customer
""")
def delimited_round_trip(spark, sf):
    """Write a TSV with NA cells, then read it both ways: as text, and with NA as missing."""
    from evidentia.session import scratch_folder

    cust = table(spark, sf, "customer").select(
        "c_name", "c_mktsegment", F.col("c_acctbal").alias("balance"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("code"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("guarded"),
    )
    path = scratch_folder(spark, "export")
    cols = ["c_name", "c_mktsegment", "balance", "code", "guarded"]
    writers.write_delimited(cust, path, places=6)
    text = readers.read_delimited(spark, path, cols, keep=["c_name", "c_mktsegment", "balance", "code"])
    typed = readers.read_delimited(spark, path, cols, na="NA", keep=["c_name", "guarded"])
    typed = typed.select("c_name", F.coalesce(S.number("guarded"), F.lit(0.0)).alias("guarded"))
    return text.join(typed, "c_name")


@query("SELECT c_nationkey::BIGINT AS c_nationkey, c_custkey, c_acctbal, c_mktsegment FROM customer")
def required_columns(spark, sf):
    out = joins.require_columns(table(spark, sf, "customer"), ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    return shaped(joins.place_after(out, "c_custkey", "c_nationkey"))


@query("SELECT DISTINCT trim(p_brand) AS gene FROM part WHERE trim(p_brand) <> ''")
def symbol_set_scan(spark, sf):
    padded = table(spark, sf, "part").select(F.concat(F.lit(" "), "p_brand", F.lit("\t")).alias("Gene"))
    return readers.symbol_set(padded, "Gene")


@query("""
SELECT vec_id, CAST(i - 1 AS BIGINT) AS col_id, 'c' || (i - 1) AS gene_name, embedding[i]::DOUBLE AS value
FROM embeddings, range(1, 65) r(i)
""")
def matrix_cells(spark, sf):
    emb = table(spark, sf, "embeddings")
    dims = emb.select(F.posexplode("embedding").alias("col_id", "v")).select("col_id").distinct()
    dims = dims.withColumn("gene_name", F.concat(F.lit("c"), "col_id"))
    cells = readers.matrix_cells(emb, dims, ["vec_id"], "embedding")
    return cells.withColumns({"col_id": F.col("col_id").cast("bigint"), "value": F.col("value").cast("double")})


@query("""
WITH flat AS (SELECT c_nationkey, c_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_name, c_nationkey::BIGINT AS c_nationkey FROM flat WHERE c_name IN ('Customer#000000007', 'Customer#000000042', 'Customer#000000113')
""")
def candidate_lookup(spark, sf):
    from evidentia.operators.validation import named_rows

    names = ["Customer#000000007", "Customer#000000042", "Customer#000000113"]
    return shaped(named_rows(table(spark, sf, "customer"), "c_name", names).select("c_name", "c_nationkey"))
