"""Enrichment, rank statistics, regression scans, combination scores, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import contingency, nearest, ordering, regression, symbols, validation
from evidentia.plans import burden, enrichment, neighbours, polarization
from evidentia.registry.base import query, shaped, table
from evidentia.registry.relational import _AUTHORITY, _authority

# ------------------------------------------------------------------ enrichment

_UNIVERSES = ["all parts", "quantity >= 48", "quantity >= 49.5", "small", "small and quantity >= 48"]

_MEMBERS = """
WITH mx AS (SELECT l_partkey AS e, max(l_quantity) AS top, max(l_discount) AS disc FROM lineitem GROUP BY 1),
m AS (SELECT p_partkey, p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#11') AS p,
    p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.1 AND l_quantity >= 40) AS t,
    coalesce(top, -1) AS top, p_size <= 25 AS s FROM part LEFT JOIN mx ON e = p_partkey),
u AS (SELECT 'all parts' AS universe, p, t FROM m
  UNION ALL SELECT 'quantity >= 48', p, t FROM m WHERE top >= 48
  UNION ALL SELECT 'quantity >= 49.5', p, t FROM m WHERE top >= 49.5
  UNION ALL SELECT 'small', p, t FROM m WHERE s
  UNION ALL SELECT 'small and quantity >= 48', p, t FROM m WHERE s AND top >= 48),
c AS (SELECT universe, CAST(count(*) FILTER (WHERE p AND t) AS BIGINT) AS a, CAST(count(*) FILTER (WHERE p AND NOT t) AS BIGINT) AS b,
    CAST(count(*) FILTER (WHERE t AND NOT p) AS BIGINT) AS c, CAST(count(*) FILTER (WHERE NOT p AND NOT t) AS BIGINT) AS d FROM u GROUP BY 1),
k AS (SELECT universe, sum(exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1)
    - lgamma(i + 1) - lgamma(a + b - i + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1))) AS p
  FROM c, LATERAL (SELECT unnest(range(a, least(a + b, a + c) + 1)) AS i) GROUP BY 1),
r AS (SELECT c.*, a + b + c + d AS N, a / (a + b)::DOUBLE AS p1, c / (c + d)::DOUBLE AS p0, (a * d)::DOUBLE / (b * c) AS o,
    1.96::DOUBLE * sqrt(1.0::DOUBLE / a + 1.0::DOUBLE / b + 1.0::DOUBLE / c + 1.0::DOUBLE / d) AS se, k.p FROM c JOIN k USING (universe))
"""


def _members(spark, sf):
    brands = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#11"]
    # One pass over the order lines gives membership and top quantity of every part.
    bought = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.max("l_quantity").alias("top"),
        F.max(F.expr("cast(l_discount >= 0.1D and l_quantity >= 40 as int)")).alias("target"),
    )
    part = table(spark, sf, "part").select(
        "p_partkey", F.col("p_brand").isin(*brands).cast("int").alias("panel"), (F.col("p_size") <= 25).cast("int").alias("small"))
    return part.join(bought, "p_partkey", "left").withColumn("target", F.coalesce("target", F.lit(0)))


def _enrichment(spark, sf):
    top = F.coalesce("top", F.lit(-1.0))
    small = F.col("small") == 1
    conditions = [F.lit(True), top >= 48, top >= 49.5, small, small & (top >= 48)]
    return contingency.enrichment(_members(spark, sf), "panel", "target", dict(zip(_UNIVERSES, conditions)))


@query(_MEMBERS + """
SELECT universe, a, b, c, d, N, round(p1, 6) AS p_tgt_iei, round(p0, 6) AS p_tgt_non, round(p1 / p0, 6) AS "RR",
  round(o, 6) AS "OR", round(exp(ln(o) - se), 6) AS "OR_lo", round(exp(ln(o) + se), 6) AS "OR_hi", round(p, 6) AS p FROM r
""")
def enrichment_by_universe(spark, sf):
    return shaped(_enrichment(spark, sf))


@query(_MEMBERS + """
SELECT universe AS comparison_group, printf('%d / %d = %.1f%%', a, a + b, 100.0 * p1) AS panel_rate,
  printf('%d / %d = %.1f%%', c, c + d, 100.0 * p0) AS other_rate,
  printf('%.1f× (OR %.1f, %.1f–%.1f)', p1 / p0, o, exp(ln(o) - se), exp(ln(o) + se)) AS fold_text,
  format('{:.0e}', p) AS p_text FROM r
""")
def enrichment_readable(spark, sf):
    return contingency.readable(_enrichment(spark, sf))


@query(_MEMBERS + """
SELECT CAST(list_position(['small', 'all parts', 'quantity >= 48'], universe) AS BIGINT) AS position, universe,
  round(100.0 * p1, 6) AS panel_pct, round(100.0 * p0, 6) AS other_pct, round(p1 / p0, 6) AS fold,
  CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars
FROM r WHERE universe IN ('small', 'all parts', 'quantity >= 48')
""")
def enrichment_comparison(spark, sf):
    return shaped(contingency.comparison(_enrichment(spark, sf), ["small", "all parts", "quantity >= 48"]))


@query("""
WITH g AS (SELECT c_mktsegment AS segment, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS a,
    count(*) FILTER (WHERE o_orderpriority <> '1-URGENT') AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
c AS (SELECT segment, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(sum(a) OVER () - a AS BIGINT) AS c, CAST(sum(b) OVER () - b AS BIGINT) AS d FROM g),
k AS (SELECT segment, i, a, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1)
    - lgamma(i + 1) - lgamma(a + b - i + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1) AS lp
  FROM c, LATERAL (SELECT unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS i))
SELECT segment, c.a, c.b, c.c, c.d, round((SELECT least(1.0::DOUBLE, sum(exp(lp))) FROM k
    WHERE k.segment = c.segment AND lp <= (SELECT lp FROM k z WHERE z.segment = c.segment AND z.i = c.a) + 1e-7), 6) AS p
FROM c
""")
def fisher_two_sided(spark, sf):
    urgent = F.col("o_orderpriority") == "1-URGENT"
    cust = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderpriority")
    cells = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).groupBy("segment").agg(
        F.count_if(urgent).alias("a"), F.count_if(~urgent).alias("b")
    )
    total = cells.agg(F.struct(F.sum("a").alias("a"), F.sum("b").alias("b"))).scalar()
    cells = cells.withColumn("t", total)
    cells = cells.select("segment", "a", "b", (F.col("t.a") - F.col("a")).alias("c"), (F.col("t.b") - F.col("b")).alias("d"))
    return shaped(contingency.exact_p(cells, "two-sided"))


_RAW_LISTS = """
WITH ex AS (SELECT 'P' || l_partkey AS gene_name, max(CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_quantity / 10.0::DOUBLE END) AS top
  FROM lineitem WHERE l_partkey % 11 <> 0 GROUP BY 1),
pa AS (SELECT DISTINCT 'P' || p_partkey AS g FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#11')),
ta AS (SELECT DISTINCT 'P' || l_partkey AS g FROM lineitem WHERE l_discount >= 0.1 AND l_quantity >= 40),
dr AS (SELECT DISTINCT 'P' || p_partkey AS g FROM part WHERE p_size <= 25),
al AS (SELECT g FROM pa UNION SELECT g FROM ta UNION SELECT g FROM dr UNION SELECT gene_name FROM ex),
m AS (SELECT al.g, al.g IN (SELECT g FROM pa) AS p, al.g IN (SELECT g FROM ta) AS t, al.g IN (SELECT g FROM dr) AS s, coalesce(top, -1) AS top FROM al LEFT JOIN ex ON gene_name = al.g),
""" + "u AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS universe, p, t FROM m WHERE {cond}" for name, cond in zip(enrichment.UNIVERSES, ("true", "top >= 1", "top >= 5", "s", "s AND top >= 1"))
) + """),
c AS (SELECT universe, CAST(count(*) FILTER (WHERE p AND t) AS BIGINT) AS a, CAST(count(*) FILTER (WHERE p AND NOT t) AS BIGINT) AS b,
    CAST(count(*) FILTER (WHERE t AND NOT p) AS BIGINT) AS c, CAST(count(*) FILTER (WHERE NOT p AND NOT t) AS BIGINT) AS d FROM u GROUP BY 1)
"""


@query(_RAW_LISTS + """
SELECT universe, a, b, c, d, a + b + c + d AS N, round((a * d)::DOUBLE / nullif(b * c, 0), 6) AS "OR" FROM c
""")
def enrichment_from_raw_lists(spark, sf):
    """The whole plan: panel, targets, druggable list and expression in, counts of every universe out."""
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    name = lambda c: F.concat(F.lit("P"), c).alias("entity")
    brands = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#11"]
    expression = li.where("l_partkey % 11 <> 0").select(
        name("l_partkey").alias("gene"), name("l_partkey").alias("gene_name"), F.when(F.col("l_orderkey") % 9 != 0, F.col("l_quantity") / 10.0).alias("ntpm"))
    result, _, _ = enrichment.build(
        part.where(F.col("p_brand").isin(*brands)).select(name("p_partkey")), li.filter("l_discount >= 0.1D and l_quantity >= 40").select(name("l_partkey")),
        part.where("p_size <= 25").select(name("p_partkey")), expression)
    return shaped(result.select("universe", "a", "b", "c", "d", "N", "OR"))


# --------------------------------------------------------------- rank statistics

_PSEUDO_P = "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 97 = 5 THEN NULL ELSE ((o_orderkey * 7919) % 1009)::DOUBLE / 1009.0::DOUBLE END AS p FROM orders"


def _pseudo_p(spark, sf):
    p = ((F.col("o_orderkey") * 7919) % 1009).cast("double") / F.lit(1009.0)
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 97 != 5, p).alias("p")
    )


@query(f"""
WITH x AS ({_PSEUDO_P}),
k AS (SELECT *, greatest(p, 1e-300::DOUBLE) AS pc, row_number() OVER w AS i, count(*) OVER (PARTITION BY o_orderpriority) AS m
  FROM x WHERE p IS NOT NULL WINDOW w AS (PARTITION BY o_orderpriority ORDER BY p, o_orderkey)),
q AS (SELECT o_orderkey, o_orderpriority, p, least(1.0::DOUBLE, min(pc * m / i) OVER (PARTITION BY o_orderpriority ORDER BY i DESC)) AS fdr FROM k)
SELECT x.o_orderkey, x.o_orderpriority, round(x.p, 6) AS p, round(min(q.fdr), 6) AS fdr
FROM x LEFT JOIN q ON q.o_orderpriority = x.o_orderpriority AND q.o_orderkey = x.o_orderkey GROUP BY ALL
""")
def bh_fdr(spark, sf):
    return shaped(ordering.benjamini_hochberg(_pseudo_p(spark, sf), "p", ["o_orderpriority"]))


@query(f"""
WITH x AS ({_PSEUDO_P}),
r AS (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY p DESC NULLS LAST) AS lo, count(*) OVER (PARTITION BY o_orderpriority, p) AS t FROM x)
SELECT o_orderkey, o_orderpriority, round(p, 6) AS p, CASE WHEN p IS NOT NULL THEN CAST(floor(lo + (t - 1) / 2.0::DOUBLE) AS BIGINT) END AS rank FROM r
""")
def average_rank(spark, sf):
    return shaped(ordering.average_rank(_pseudo_p(spark, sf), "p", ["o_orderpriority"], "rank"))


@query(f"""
WITH x AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * -log10(greatest(p, 1e-300::DOUBLE)) AS obs FROM ({_PSEUDO_P}) WHERE p > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY obs, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM x)
SELECT o_orderkey, o_orderpriority, round(obs, 6) AS obs, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n,
  round(sign((k - 0.5::DOUBLE) / n - 0.5) * -log10(1 - 2 * abs((k - 0.5::DOUBLE) / n - 0.5) + 1e-300::DOUBLE), 6) + 0.0 AS expected FROM k
""")
def qq_points(spark, sf):
    sign = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    x = _pseudo_p(spark, sf).filter("p > 0").select(
        "o_orderkey", "o_orderpriority", (sign * -F.log10(F.greatest("p", F.lit(1e-300)))).alias("obs")
    )
    return shaped(ordering.qq_points(x, "obs", "o_orderkey", ["o_orderpriority"]))


@query("""
WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT rank, o_orderkey, o_totalprice FROM r
""")
def contiguous_rank(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ordering.row_rank(orders, [("o_totalprice", "desc"), ("o_orderkey", "asc")])


@query("""
WITH ref AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 50 AND l_discount >= 0.09),
s AS (SELECT l_partkey, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1),
hi AS (SELECT l_partkey FROM s ORDER BY v DESC, l_partkey LIMIT 50), lo AS (SELECT l_partkey FROM s ORDER BY v, l_partkey LIMIT 50)
SELECT 'positive' AS direction, CAST(count(*) AS BIGINT) AS overlap FROM hi WHERE l_partkey IN (SELECT l_partkey FROM ref)
UNION ALL SELECT 'negative', CAST(count(*) AS BIGINT) FROM lo WHERE l_partkey IN (SELECT l_partkey FROM ref)
""")
def topk_overlap(spark, sf):
    li = table(spark, sf, "lineitem")
    scores = li.groupBy("l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("signed_log10p"))
    scores = scores.select(F.col("l_partkey").alias("ensg"), F.col("l_partkey").alias("gene"), "signed_log10p", F.lit("all").alias("condition"))
    named = li.filter("l_quantity = 50 and l_discount >= 0.09D").select(F.col("l_partkey").alias("gene")).distinct()
    ref = named.select("gene", F.explode(F.array(F.lit("positive"), F.lit("negative"))).alias("direction"))
    return burden.list_overlap(scores, "all", ref)


@query("""
SELECT c_custkey, c_name, md5('1234:' || c_custkey) AS draw FROM customer WHERE c_acctbal > 500 ORDER BY draw, c_custkey LIMIT 50
""")
def seeded_sample(spark, sf):
    pool = table(spark, sf, "customer").filter("c_acctbal > 500").select("c_custkey", "c_name")
    drawn = ordering.seeded_sample(pool, "c_custkey", 50, 1234)
    return drawn.withColumn("draw", ordering.seeded_key(1234, "c_custkey"))


_SIMPSON_NORMAL = """
(SELECT sum(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5::DOUBLE * (z * i / 2000) * (z * i / 2000))) * z / 6000 / sqrt(2 * pi())
 FROM range(0, 2001) g(i))
"""


@query(f"""
WITH x AS (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS rk FROM x),
t AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS c FROM x GROUP BY n_chars)),
s AS (SELECT count(*) FILTER (WHERE quality = 1)::DOUBLE AS n1, count(*) FILTER (WHERE quality = 0)::DOUBLE AS n0, sum(rk) FILTER (WHERE quality = 1) AS rt FROM r),
v AS (SELECT n1, n0, rt - n1 * (n1 + 1) / 2 AS u, n1 * n0 / 2 AS mu, sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS sd FROM s, t),
w AS (SELECT *, (u - mu - 0.5) / sd AS z FROM v)
SELECT CAST(n1 AS BIGINT) AS n_members, CAST(n0 AS BIGINT) AS n_rest, round(u, 6) AS u, round(z, 6) AS z, round(0.5 - {_SIMPSON_NORMAL}, 6) AS p FROM w
""")
def rank_sum_test(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return shaped(regression.rank_sum(docs.join(table(spark, sf, "labels"), "doc_id"), "n_chars", "quality"))


# ------------------------------------------------------------------- regression

_COEF = """
CASE WHEN 1 - xw * xw > 1e-8 THEN (xy - xw * yw) / (1 - xw * xw) END AS coef,
CASE WHEN 1 - xw * xw > 1e-8 THEN sqrt(greatest(1 - (xy * xy + yw * yw - 2 * xy * yw * xw) / (1 - xw * xw), 0) / ((n - 3) * (1 - xw * xw))) END AS se
"""


def _scan_sql(x: str, y: str, w: str) -> str:
    return f"""
WITH m AS (SELECT p_brand, count(*) AS n, corr({x}, {y}) AS xy, corr({x}, {w}) AS xw, corr({y}, {w}) AS yw
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey <> l_partkey GROUP BY 1 HAVING count(*) >= 100),
f AS (SELECT p_brand, CAST(n AS BIGINT) AS n_reg, n, {_COEF} FROM m)
"""


def _brand_cells(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    li = table(spark, sf, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey"))


@query(_scan_sql("l_quantity", "l_extendedprice", "l_discount") + """
SELECT p_brand, n_reg, round(coef, 6) AS coef_beta, round(se, 6) AS se_beta, round(coef / se, 3) AS t_stat FROM f
""")
def column_regression_scan(spark, sf):
    out = regression.scan_columns(
        _brand_cells(spark, sf), ["p_brand"], "l_quantity", "l_extendedprice", "l_discount", "l_suppkey", "l_partkey")
    return shaped(out.withColumn("t_stat", F.round("t_stat", 3)))


_T_TWO_SIDED = """
greatest(0, 1 - 2 * (SELECT sum(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
   * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2) - 0.5::DOUBLE * ln(dof * pi()) - (dof + 1) / 2 * ln(1 + (t * i / 2000) * (t * i / 2000) / dof))) * t / 6000
 FROM range(0, 2001) g(i)))
"""


@query(_scan_sql("l_discount", "l_quantity", "l_tax") + f""",
d AS (SELECT *, abs(coef / se) AS t, (n - 3)::DOUBLE AS dof FROM f),
p AS (SELECT *, {_T_TWO_SIDED} AS p FROM d),
k AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m, sign(coef) * -log10(p) AS slp FROM p)
SELECT p_brand, n_reg, round(coef, 6) AS coef_beta, round(se, 6) AS se_beta, round(p, 6) AS p_beta, round(slp, 5) AS signed_log10p,
  round(least(1.0::DOUBLE, min(p * m / i) OVER (ORDER BY i DESC)), 6) AS fdr, row_number() OVER (ORDER BY slp DESC) AS rank FROM k
""")
def regression_pvalues_fdr(spark, sf):
    fits = regression.scan_columns(
        _brand_cells(spark, sf), ["p_brand"], "l_discount", "l_quantity", "l_tax", "l_suppkey", "l_partkey")
    out = regression.with_p_values(fits).drop("t_stat")
    return shaped(out.withColumn("signed_log10p", F.round("signed_log10p", 5)))


def _matrix_rows(spark, sf):
    """Embeddings as matrix rows, covariates from two other tables, up to two own columns masked."""
    y = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.log1p("n_chars").alias("y"))
    w = table(spark, sf, "customer").select(F.col("c_custkey").alias("vec_id"), F.col("c_acctbal").alias("w"))
    emb = table(spark, sf, "embeddings")
    full = emb.join(y, "vec_id", "left").join(w, "vec_id", "left")
    return full.select(
        F.when(F.col("label") < 5, "low").otherwise("high").alias("condition"), F.col("embedding").alias("values"),
        F.when(F.col("label") != 3, F.array((F.col("vec_id") % 64).cast("int"), (F.col("vec_id") % 5).cast("int"))).alias("own_cols"), "y", "w",
    )


_MATRIX = f"""
WITH v AS (SELECT vec_id, CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS condition, label, i - 1 AS col_id, embedding[i]::DOUBLE AS x,
    ln(1 + n_chars) AS y, c_acctbal AS w FROM embeddings LEFT JOIN documents ON doc_id = vec_id LEFT JOIN customer ON c_custkey = vec_id, range(1, 65) r(i)),
m AS (SELECT condition, col_id, count(*) AS n, corr(x, y) AS xy, corr(x, w) AS xw, corr(y, w) AS yw FROM v
    WHERE x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND NOT (label <> 3 AND (vec_id % 64 = col_id OR vec_id % 5 = col_id)) GROUP BY 1, 2 HAVING count(*) >= 100),
f AS (SELECT condition, CAST(col_id AS BIGINT) AS col_id, CAST(n AS BIGINT) AS n_reg, n, {_COEF} FROM m)
"""


@query(_MATRIX + "SELECT condition, col_id, n_reg, round(coef, 6) AS coef_beta, round(se, 6) AS se_beta, round(coef / se, 5) AS t_stat FROM f")
def matrix_regression_scan(spark, sf):
    out = regression.scan_matrix(_matrix_rows(spark, sf))
    return shaped(out.withColumn("t_stat", F.round("t_stat", 5)))


@query(_MATRIX + f""",
d AS (SELECT *, abs(coef / se) AS t, (n - 3)::DOUBLE AS dof FROM f),
p AS (SELECT *, {_T_TWO_SIDED} AS p FROM d),
r AS (SELECT condition, p, row_number() OVER (PARTITION BY condition ORDER BY p) AS k, count(p) OVER (PARTITION BY condition) AS m FROM p)
SELECT condition, CAST(count(*) AS BIGINT) AS n_scored, CAST(coalesce(max(k) FILTER (WHERE p * m / k < 0.05), 0) AS BIGINT) AS n_fdr,
  CAST(count(*) FILTER (WHERE p < 0.05) AS BIGINT) AS n_p05 FROM r GROUP BY 1
""")
def burden_score_counts(spark, sf):
    cols = table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("col_id", "v")).select("col_id").distinct()
    cols = cols.select("col_id", F.concat(F.lit("E"), "col_id").alias("gene_ids"), F.concat(F.lit("g"), "col_id").alias("gene_name"))
    return burden.score_counts(burden.score(_matrix_rows(spark, sf), cols))


@query("""
WITH f AS (SELECT p_name AS ensg, CASE WHEN p_size = 1 THEN 'Infinity'::DOUBLE WHEN p_size = 2 THEN '-Infinity'::DOUBLE ELSE p_retailprice END AS v
  FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1),
b AS (SELECT min(v) AS lo, max(v) AS hi FROM f WHERE abs(v) < 'Infinity'::DOUBLE)
SELECT ensg, least(greatest(v, lo), hi) AS post_mean FROM f, b
""")
def clipped_covariates(spark, sf):
    price = F.when(F.col("p_size") == 1, float("inf")).when(F.col("p_size") == 2, float("-inf")).otherwise(F.col("p_retailprice"))
    raw = table(spark, sf, "part").select(F.col("p_name").alias("ensg"), price.alias("post_mean"), F.col("p_partkey").alias("row_id"))
    return burden.clipped_first(raw, "ensg", "post_mean", "row_id")


# The whole burden plan: vectors are rows of perturbed entities; symbols, ids and covariates come from
# customers, suppliers and documents with repeats, infinities and unknown names among them.

_BURDEN = "WITH " + _AUTHORITY + f""",
gm AS (SELECT c_custkey AS row_id, 'S' || (c_custkey % 500) AS symbol, 'E' || (c_custkey % 120) AS ensg FROM customer WHERE c_custkey % 500 < 450),
g1 AS (SELECT symbol, arg_max(ensg, row_id) AS ensg FROM gm GROUP BY 1),
gy AS (SELECT 'E' || (doc_id % 120) AS ensg, doc_id AS row_id, CASE WHEN doc_id % 40 = 3 THEN 'Infinity'::DOUBLE WHEN doc_id % 40 = 5 THEN '-Infinity'::DOUBLE ELSE ln(1 + n_chars) END AS v FROM documents),
g2 AS (SELECT ensg, arg_min(v, row_id) AS v FROM gy GROUP BY 1), gb AS (SELECT min(v) AS lo, max(v) AS hi FROM g2 WHERE abs(v) < 'Infinity'::DOUBLE),
gw AS (SELECT 'E' || (s_suppkey % 130) AS ensg, arg_min(s_acctbal, s_suppkey) AS w FROM supplier GROUP BY 1),
co AS (SELECT j AS col_id, 'E' || (j % 50) AS ensg, 'S' || j AS gene FROM range(0, 64) t(j)),
rw AS (SELECT vec_id, CASE label % 3 WHEN 0 THEN 'Rest' WHEN 1 THEN 'Stim8hr' ELSE 'Stim48hr' END AS condition, coalesce(g1.ensg, 'S' || (vec_id % 500)) AS entity, embedding
  FROM embeddings LEFT JOIN g1 ON symbol = 'S' || (vec_id % 500)),
ce AS (SELECT condition, col_id, embedding[col_id + 1]::DOUBLE AS x, least(greatest(g2.v, lo), hi) AS y, gw.w FROM rw JOIN g2 ON g2.ensg = entity JOIN gw ON gw.ensg = entity, gb, co
  WHERE co.ensg <> entity),
m AS (SELECT condition, col_id, count(*) AS n, corr(x, y) AS xy, corr(x, w) AS xw, corr(y, w) AS yw FROM ce GROUP BY 1, 2 HAVING count(*) >= 30),
f AS (SELECT condition, col_id, CAST(n AS BIGINT) AS n_reg, n, {_COEF} FROM m),
d AS (SELECT *, abs(coef / se) AS t, (n - 3)::DOUBLE AS dof FROM f),
p AS (SELECT *, {_T_TWO_SIDED} AS p FROM d),
wd AS (SELECT gene, """ + ", ".join(
    f"max({e}) FILTER (WHERE condition = '{c}') AS {pre}_{n}"
    for c, pre in burden.CONDITIONS.items() for n, e in (("coef_beta", "coef"), ("se_beta", "se"), ("signed_log10p", "sign(coef) * -log10(greatest(p, 1e-300))"))
) + """ FROM p JOIN co USING (col_id) GROUP BY 1),
mv AS (SELECT wd.*, target, gene NOT IN (SELECT symbol FROM auth WHERE status = 'Approved') AND target IS NOT NULL AS moved FROM wd LEFT JOIN prevs ON gene = name)
"""


def _burden_table(spark, sf):
    cust, docs, supp = (table(spark, sf, t) for t in ("customer", "documents", "supplier"))
    rows = table(spark, sf, "embeddings").select(
        F.when(F.col("label") % 3 == 0, "Rest").when(F.col("label") % 3 == 1, "Stim8hr").otherwise("Stim48hr").alias("culture_condition"),
        F.concat(F.lit("S"), F.col("vec_id") % 500).alias("target_contrast_gene_name"), F.col("embedding").alias("values"),
    )
    columns = spark.range(64).select(F.col("id").cast("int").alias("col_id"), F.concat(F.lit("E"), F.col("id") % 50).alias("gene_ids"), F.concat(F.lit("S"), "id").alias("gene_name"))
    at = F.col("doc_id") % 40
    mean = F.when(at == 3, float("inf")).when(at == 5, float("-inf")).otherwise(F.log1p("n_chars"))
    gamma = docs.select(F.col("doc_id").alias("row_id"), F.concat(F.lit("E"), F.col("doc_id") % 120).alias("ensg"), mean.alias("post_mean"))
    shet = supp.select(F.col("s_suppkey").alias("row_id"), F.concat(F.lit("E"), F.col("s_suppkey") % 130).alias("ensg"), F.col("s_acctbal").alias("shet"))
    genes = cust.where("c_custkey % 500 < 450").select(
        F.col("c_custkey").alias("row_id"), F.concat(F.lit("S"), F.col("c_custkey") % 500).alias("symbol"), F.concat(F.lit("E"), F.col("c_custkey") % 120).alias("ensg"))
    index = symbols.symbol_index(_authority(spark, sf))
    return burden.table(rows, columns, gamma, shet, genes, index, 30)


@query(_BURDEN + """
SELECT CASE WHEN moved THEN target ELSE gene END AS gene, """ + ", ".join(
    f"round({pre}_{n}, {d}) + 0.0 AS {pre}_{n}" for pre in burden.CONDITIONS.values() for n, d in (("coef_beta", 6), ("se_beta", 6), ("signed_log10p", 4))
) + """ FROM mv WHERE NOT (moved AND target IN (SELECT gene FROM wd))
""")
def burden_wide(spark, sf):
    """From raw inputs to one row per gene: mapping, covariates, all own columns masked, scan, reshape, current symbols."""
    out = _burden_table(spark, sf)[1]
    return shaped(out.withColumns({f"{p}_signed_log10p": F.round(F.col(f"{p}_signed_log10p") * 1e4, 0) / 1e4 + F.lit(0.0) for p in burden.CONDITIONS.values()}))


@query(_BURDEN + """
SELECT condition, 'S' || col_id AS gene, n_reg, round(coef, 6) + 0.0 AS coef_beta, round(se, 6) AS se_beta, round(-log10(greatest(p, 1e-300)), 4) + 0.0 AS log10p FROM p
""")
def burden_scores(spark, sf):
    """The long scores behind the wide table; p is compared on the log scale."""
    out = _burden_table(spark, sf)[0]
    logged = F.round(-F.log10(F.greatest("p_beta", F.lit(1e-300))) * 1e4, 0) / 1e4 + F.lit(0.0)
    return shaped(out.select("condition", "gene", "n_reg", "coef_beta", "se_beta", logged.alias("log10p")))


# ----------------------------------------------------------------- polarization

_Z = """
WITH s AS (SELECT user_id, event_type, avg(value) - 50 AS m, stddev_samp(value) / sqrt(count(*)) AS e FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1, 2),
w AS (SELECT user_id, max(m) FILTER (WHERE event_type = 'error') AS c0, max(m) FILTER (WHERE event_type = 'click') AS c8, max(m) FILTER (WHERE event_type = 'view') AS c48,
    max(m / nullif(e, 0)) FILTER (WHERE event_type = 'error') AS z0, max(m / nullif(e, 0)) FILTER (WHERE event_type = 'click') AS z8,
    max(m / nullif(e, 0)) FILTER (WHERE event_type = 'view') AS z48 FROM s GROUP BY 1),
k AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') > 14 AS known,
    CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') > 14 THEN 'Th2 regulator' ELSE 'Th1 regulator' END AS kind FROM events GROUP BY 1),
p AS (SELECT w.*, known, kind, (z8 + z48) / sqrt(2::DOUBLE) AS score FROM w JOIN k USING (user_id) WHERE c8 IS NOT NULL AND c48 IS NOT NULL)
"""


def _coefficients(spark, sf):
    ev = table(spark, sf, "events")
    per = ev.groupBy("user_id", "event_type").agg(
        (F.avg("value") - 50).alias("coef_mean"), (F.stddev_samp("value") / F.sqrt(F.count(F.lit(1)))).alias("coef_sem")
    )
    notes = ev.groupBy("user_id").agg(
        (F.count_if(F.col("event_type") == "signup") > 14).alias("known_regulators"),
        F.when(F.count_if(F.col("event_type") == "purchase") > 14, "Th2 regulator").otherwise("Th1 regulator").alias("regulator_type"),
    )
    cell = F.when(F.col("event_type") == "click", "Stim8hr").when(F.col("event_type") == "view", "Stim48hr").when(F.col("event_type") == "error", "Rest")
    return per.join(notes, "user_id").select(
        F.col("user_id").alias("regulator"), cell.alias("celltype"),
        F.when(cell.isNotNull(), "ota").otherwise("none").alias("signature"), "coef_mean", "coef_sem",
        "known_regulators", "regulator_type", F.col("user_id").alias("row_id"),
    )


def _polarization(spark, sf):
    return polarization.score(polarization.condition_z(_coefficients(spark, sf)))


@query(_Z + """
SELECT user_id AS gene, row_number() OVER (ORDER BY abs(score) DESC NULLS LAST, user_id) AS rank, round(score, 6) AS polarization_score, round(abs(score), 6) AS abs_score,
  CASE WHEN score > 0 THEN 'toward_signature_pos' ELSE 'toward_signature_neg' END AS direction,
  CAST(coalesce(sign(z8) = sign(z48), false) AS BIGINT) AS signs_agree, round(z8, 6) AS z_stim8hr, round(z48, 6) AS z_stim48hr, round(z0, 6) AS z_rest,
  round(abs(z0), 6) AS z_rest_abs, round(c8, 6) AS coef_stim8hr, round(c48, 6) AS coef_stim48hr, CAST(known AS BIGINT) AS known_regulator, kind AS regulator_type FROM p
""")
def stouffer_score(spark, sf):
    return shaped(_polarization(spark, sf))


@query(_Z + """,
r AS (SELECT known, rank() OVER (ORDER BY abs(score)) + (count(*) OVER (PARTITION BY abs(score)) - 1) / 2.0::DOUBLE AS rk FROM p WHERE score IS NOT NULL),
g AS (SELECT count(*) FILTER (WHERE known)::DOUBLE AS n1, count(*) FILTER (WHERE NOT known)::DOUBLE AS n0, sum(rk) FILTER (WHERE known) AS rt FROM r)
SELECT CAST(n1 AS BIGINT) AS n_members, CAST(n0 AS BIGINT) AS n_rest, round(rt - n1 * (n1 + 1) / 2, 6) AS u,
  round((rt - n1 * (n1 + 1) / 2 - n1 * n0 / 2 - 0.5) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1)), 6) AS z FROM g
""")
def score_calibration(spark, sf):
    return shaped(polarization.calibration(_polarization(spark, sf)).drop("p"))


@query(_Z + """
SELECT CASE WHEN known THEN kind WHEN coalesce(sign(z8) = sign(z48), false) THEN 'signs agree' ELSE 'signs disagree' END AS class, CAST(count(*) AS BIGINT) AS n
FROM p GROUP BY 1
""")
def display_classes(spark, sf):
    return polarization.display_class(_polarization(spark, sf)).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------- nearest anchors

_SIG = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x, i: CASE WHEN i - 1 = vec_id % 64 THEN 0 ELSE x::DOUBLE * 20 END)::DOUBLE[] AS x FROM embeddings),
pr AS (SELECT q.vec_id, a.vec_id AS anchor, list_cosine_similarity(q.x, a.x) AS c FROM v q JOIN v a ON a.label = 0 AND a.vec_id <> q.vec_id),
b AS (SELECT vec_id, max(c) AS best, arg_max(anchor, c) AS nearest FROM pr GROUP BY 1)
"""


def _signatures(spark, sf):
    scaled = table(spark, sf, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda v: v.cast("double") * 20).alias("values"),
        (F.col("vec_id") % 64).cast("int").alias("own_col"), F.col("vec_id").alias("row_id"),
    )
    return nearest.signatures(scaled, "vec_id", "values", "row_id", "own_col").withColumn(
        "anchor", (F.col("label") == 0).cast("int"))


def _nearest(spark, sf, block_bytes=nearest.BLOCK_BYTES):
    return nearest.nearest_anchor(_signatures(spark, sf), "vec_id", "anchor", "row_id", block_bytes)


@query(_SIG + """
SELECT v.vec_id, round(best, 6) AS best, nearest, CAST(label = 0 AS BIGINT) AS anchor, CAST(len(list_filter(x, lambda e: abs(e) > 3)) AS BIGINT) AS breadth
FROM v JOIN b USING (vec_id)
""")
def nearest_anchor(spark, sf):
    return shaped(_nearest(spark, sf).select("vec_id", "best", "nearest", "anchor", "breadth"))


@query(_SIG + """
SELECT v.vec_id, round(best, 6) AS best, nearest FROM v JOIN b USING (vec_id)
""")
def nearest_anchor_in_blocks(spark, sf):
    """The same search with many small blocks."""
    return shaped(_nearest(spark, sf, block_bytes=8 * 64 * 20).select("vec_id", "best", "nearest"))


@query(_SIG + """,
hubs AS (SELECT nearest, count(*) AS n FROM b GROUP BY 1 ORDER BY n DESC, nearest LIMIT 8)
SELECT CAST(b.nearest AS VARCHAR) AS hub, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(x[1], 0.5), 6) AS median_x, round(quantile_cont(x[2], 0.5), 6) AS median_y
FROM b JOIN hubs USING (nearest) JOIN v USING (vec_id) GROUP BY 1
""")
def nearest_anchor_hubs(spark, sf):
    found = _nearest(spark, sf).select(
        F.lpad(F.col("nearest").cast("string"), 12, "0").alias("nearest"), F.get("values", F.lit(0)).alias("x"), F.get("values", F.lit(1)).alias("y"))
    hubs = nearest.hub_summary(found, "nearest", ["x", "y"], 8)
    return shaped(hubs.withColumn("hub", F.col("hub").cast("bigint").cast("string")))


@query("WITH " + _AUTHORITY + """,
raw AS (SELECT vec_id, 'S' || (vec_id % 400) AS gene, embedding FROM embeddings
  WHERE label % 2 = 0 AND coalesce(nullif(vec_id % 7, 3) <> 0, false) AND vec_id % 200 >= 50),
firsts AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY gene ORDER BY vec_id) = 1),
v AS (SELECT vec_id, gene, list_transform(embedding, lambda x, i: CASE WHEN 'S' || (i - 1) = gene THEN 0 ELSE x::DOUBLE * 20 END)::DOUBLE[] AS x,
    CASE WHEN gene NOT IN (SELECT symbol FROM auth WHERE status = 'Approved') AND target IS NOT NULL THEN target ELSE gene END AS cur
  FROM firsts LEFT JOIN prevs ON gene = name),
f AS (SELECT *, cur IN (SELECT 'S' || (k * 10) FROM range(40) t(k)) AS is_fda FROM v),
pr AS (SELECT q.gene, a.gene AS anchor, list_cosine_similarity(q.x, a.x) AS c FROM f q JOIN f a ON a.is_fda AND a.gene <> q.gene),
b AS (SELECT gene, max(c) AS best, arg_max(anchor, c) AS nearest FROM pr GROUP BY 1)
SELECT f.gene, round(best, 6) AS knn_max_score, nearest AS nearest_fda_target,
  CASE WHEN nearest NOT IN (SELECT symbol FROM auth WHERE status = 'Approved') AND target IS NOT NULL THEN target ELSE nearest END AS nearest_fda_target_current,
  CAST(is_fda AS BIGINT) AS is_fda_target, CAST(len(list_filter(x, lambda e: abs(e) > 3)) AS BIGINT) AS n_downstream_z3, 'even' AS culture_condition
FROM f LEFT JOIN b USING (gene) LEFT JOIN prevs ON nearest = name
""")
def nearest_candidates(spark, sf):
    """The whole plan: quality filter, first row, own column, anchors by current symbol, nearest anchor."""
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.concat(F.lit("S"), F.col("vec_id") % 400).alias("target_contrast_gene_name"),
        F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("culture_condition"),
        (F.nullif(F.col("vec_id") % 7, F.lit(3)) != 0).alias("ontarget_significant"), (F.col("vec_id") % 200).alias("n_cells_target"),
        F.transform("embedding", lambda v: v.cast("double") * 20).alias("values"),
    )
    columns = spark.range(64).select(F.col("id").cast("int").alias("col_id"), F.concat(F.lit("S"), "id").alias("gene_name"))
    anchors = spark.range(40).select(F.concat(F.lit("S"), F.col("id") * 10).alias("gene"))
    index = symbols.symbol_index(_authority(spark, sf))
    return shaped(neighbours.candidates(rows, columns, anchors, index, "even"))


_VECTOR_PLAN = "WITH " + _AUTHORITY + """,
raw AS (SELECT vec_id, 'S' || vec_id AS gene, embedding FROM embeddings
  WHERE label % 2 = 0 AND coalesce(embedding[1] > embedding[2], false) AND floor(abs(embedding[3]::DOUBLE) * 2000) >= 50),
firsts AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY gene ORDER BY vec_id) = 1),
v AS (SELECT vec_id, gene, list_transform(embedding, lambda x, i: CASE WHEN 'S' || (i - 1) = gene THEN 0 ELSE x::DOUBLE * 20 END)::DOUBLE[] AS x,
    CASE WHEN gene NOT IN (SELECT symbol FROM auth WHERE status = 'Approved') AND target IS NOT NULL THEN target ELSE gene END AS cur
  FROM firsts LEFT JOIN prevs ON gene = name),
f AS (SELECT *, cur IN (SELECT 'S' || vec_id FROM embeddings WHERE label = 0) AS is_fda FROM v),
pr AS (SELECT q.gene, a.gene AS anchor, list_cosine_similarity(q.x, a.x) AS c FROM f q JOIN f a ON a.is_fda AND a.gene <> q.gene),
b AS (SELECT gene, max(c) AS best, arg_max(anchor, c) AS nearest FROM pr GROUP BY 1)
"""


def _vector_plan(spark, sf):
    vectors = table(spark, sf, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i))
    rows = vectors.select(
        F.col("vec_id").alias("row_id"), F.concat(F.lit("S"), "vec_id").alias("target_contrast_gene_name"),
        F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("culture_condition"),
        (at(0) > at(1)).alias("ontarget_significant"), F.floor(F.abs(at(2).cast("double")) * 2000).alias("n_cells_target"),
        F.transform("embedding", lambda v: v.cast("double") * 20).alias("values"),
    )
    columns = spark.range(64).select(F.col("id").cast("int").alias("col_id"), F.concat(F.lit("S"), "id").alias("gene_name"))
    anchors = vectors.where("label = 0").select(F.concat(F.lit("S"), "vec_id").alias("gene"))
    index = symbols.symbol_index(_authority(spark, sf))
    return rows, columns, anchors, index


@query(_VECTOR_PLAN + """
SELECT f.gene, round(best, 6) AS knn_max_score, nearest AS nearest_fda_target,
  CASE WHEN nearest NOT IN (SELECT symbol FROM auth WHERE status = 'Approved') AND target IS NOT NULL THEN target ELSE nearest END AS nearest_fda_target_current,
  CAST(is_fda AS BIGINT) AS is_fda_target, CAST(len(list_filter(x, lambda e: abs(e) > 3)) AS BIGINT) AS n_downstream_z3, 'even' AS culture_condition
FROM f LEFT JOIN b USING (gene) LEFT JOIN prevs ON nearest = name
""")
def nearest_candidates_per_vector(spark, sf):
    """The whole plan where every vector is an entity: anchors and quality come from the data and grow with the table."""
    return shaped(neighbours.candidates(*_vector_plan(spark, sf), "even"))


@query()
def signature_pca(spark, sf):
    pcs, fitted = nearest.principal_components(_signatures(spark, sf), "vec_id", 8)
    shares = (fitted.variances / fitted.total_variance).tolist()
    lines = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(s).alias("share")) for i, s in enumerate(shares)])
    spread = pcs.agg(*[F.var_samp(f"pc{i + 1}").alias(f"v{i + 1}") for i in range(len(shares))])
    return spread.select(F.inline(lines), F.array(*[F.col(f"v{i + 1}") for i in range(len(shares))]).alias("vs")).select(
        "component", "share", F.get("vs", F.col("component") - 1).alias("variance"))


_UNIT = _SIG + """,
u AS (SELECT vec_id, list_transform(x, lambda e: e / (sqrt(list_sum(list_transform(x, lambda y: y * y))) + 1e-12)) AS e FROM v),
c AS (SELECT vec_id, unnest(e) AS e, unnest(range(1, 65)) AS j FROM u),
m AS (SELECT j, avg(e) AS m, var_samp(e) AS s FROM c GROUP BY 1)
"""


@query(_UNIT + """
SELECT CAST(component AS BIGINT) AS component, 0.0::DOUBLE AS residual, 0.0::DOUBLE AS variance_gap, 0.0::DOUBLE AS overlap,
  (SELECT round(sum(s), 6) FROM m) AS total_variance FROM range(1, 9) t(component)
""")
def signature_components(spark, sf):
    """What makes directions principal, measured on the rows: each is mapped to itself times its variance
    by the covariance, and scores along different ones are uncorrelated."""
    sig = _signatures(spark, sf)
    pcs, fitted = nearest.principal_components(sig, "vec_id", 8)
    k = len(fitted.variances)
    mean, directions = F.array(*[F.lit(float(x)) for x in fitted.mean]), fitted.directions
    scored = sig.select("vec_id", F.zip_with("unit", mean, lambda x, m: x - m).alias("d")).join(pcs, "vec_id")
    # The covariance times a direction, column by column, against the direction times its variance.
    names = [f"pc{i + 1}" for i in range(k)]
    long = scored.select(F.posexplode("d").alias("j", "d"), *names)
    mapped = long.groupBy("j").agg(*[F.covar_samp("d", c).alias(c) for c in names])
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in directions])
    gaps = mapped.select(*[(F.col(c) - F.get(F.get(rows, F.col("j")), F.lit(i)) * float(fitted.variances[i])).alias(c) for i, c in enumerate(names)])
    residual = gaps.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"r{i}") for i, c in enumerate(names)])
    spread = scored.agg(
        *[(F.var_samp(c) - float(fitted.variances[i])).alias(f"v{i}") for i, c in enumerate(names)],
        *[F.greatest(*[F.abs(F.corr(c, d)) for d in names if d != c]).alias(f"o{i}") for i, c in enumerate(names)],
    )
    lines = F.array(*[
        F.struct(F.lit(i + 1).alias("component"), F.col(f"r{i}").alias("residual"), F.abs(f"v{i}").alias("variance_gap"), F.col(f"o{i}").alias("overlap"))
        for i in range(k)
    ])
    both = residual.join(F.broadcast(spread)).select(F.inline(lines), F.lit(float(fitted.total_variance)).alias("total_variance"))  # one row each
    return shaped(both)


@query(_VECTOR_PLAN + """,
un AS (SELECT gene, list_transform(x, lambda e: e / (sqrt(list_sum(list_transform(x, lambda y: y * y))) + 1e-12)) AS e FROM v),
cu AS (SELECT gene, unnest(e) AS e, unnest(range(1, 65)) AS j FROM un),
mu AS (SELECT j, avg(e) AS m FROM cu GROUP BY 1),
en AS (SELECT gene, sum((e - m) * (e - m)) AS energy FROM cu JOIN mu USING (j) GROUP BY 1)
SELECT gene, CAST(is_fda AS BIGINT) AS is_fda_target, nearest AS nearest_fda_target, round(energy, 6) AS energy FROM en JOIN f USING (gene) LEFT JOIN b USING (gene)
""")
def signature_embedding(spark, sf):
    """All components of the signatures of one condition with their labels: over all of them a row keeps its distance from the mean."""
    rows, columns, anchors, index = _vector_plan(spark, sf)
    found = neighbours.candidates(rows, columns, anchors, index, "even")
    pcs, fitted = neighbours.signature_components(rows, columns, found, "even", 64)
    energy = sum(F.col(f"pc{i + 1}") * F.col(f"pc{i + 1}") for i in range(fitted.directions.shape[1]))
    return shaped(pcs.select("gene", "is_fda_target", "nearest_fda_target", energy.alias("energy")))


# -------------------------------------------------------------------- validation

_STAGE = "CASE o_orderpriority WHEN '1-URGENT' THEN 4.0::DOUBLE WHEN '2-HIGH' THEN 3.0::DOUBLE WHEN '3-MEDIUM' THEN 1.5::DOUBLE WHEN '4-NOT SPECIFIED' THEN 0.0::DOUBLE END"
_LABEL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Approved' WHEN '2-HIGH' THEN 'Phase III' WHEN '3-MEDIUM' THEN 'Phase I/II' ELSE '' END"
_BEST = f"""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS wanted, {_STAGE} AS num, {_LABEL} AS label, 'drug ' || o_orderkey AS drug FROM orders),
b AS (SELECT o_custkey, num, label, drug FROM o WHERE num IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY num DESC, o_orderkey) = 1),
i AS (SELECT o_custkey, num, label, drug FROM o WHERE num IS NOT NULL AND wanted QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY num DESC, o_orderkey) = 1),
best AS (SELECT c.o_custkey, coalesce(b.label, '') AS max_clinical_stage, coalesce(b.num, -1) AS max_stage_number, coalesce(b.drug, '') AS example_drug,
  coalesce(i.label, '') AS immune_max_stage, coalesce(i.num, -1) AS immune_stage_number, coalesce(i.drug, '') AS immune_example_drug,
  CASE WHEN i.drug IS NULL THEN '' ELSE 'immune' END AS immune_indication
FROM (SELECT DISTINCT o_custkey FROM o) c LEFT JOIN b USING (o_custkey) LEFT JOIN i USING (o_custkey))
"""


def _best(spark, sf):
    pr = F.col("o_orderpriority")
    stage = F.when(pr == "1-URGENT", "APPROVAL").when(pr == "2-HIGH", "PHASE_3").when(pr == "3-MEDIUM", "PHASE_1_2").when(pr == "4-NOT SPECIFIED", "PHASE_0")
    programs = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", stage.alias("stage"), F.concat(F.lit("drug "), "o_orderkey").alias("drug"),
        F.lit("immune").alias("disease"), (F.col("o_orderstatus") == "F").alias("wanted"))
    return validation.best_programs(programs, "o_custkey", "stage", "drug", "disease", F.col("wanted"), "o_orderkey")


@query(_BEST + "SELECT * FROM best")
def best_stage(spark, sf):
    return shaped(_best(spark, sf))


_ARMS = """
r AS (SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS rank FROM customer WHERE c_nationkey >= 5),
t AS (SELECT c_custkey, rank, 'top' AS arm FROM r ORDER BY rank LIMIT 25),
k AS (SELECT c_custkey, rank, 'control' AS arm FROM r WHERE rank > 50 ORDER BY md5('1234:' || c_custkey), c_custkey LIMIT 50),
arms AS (SELECT * FROM t UNION ALL SELECT * FROM k)
"""


def _arms(spark, sf):
    pool = table(spark, sf, "customer").select("c_custkey", "c_acctbal", (F.col("c_nationkey") < 5).cast("int").alias("label"))
    ranked = ordering.row_rank(pool.filter("label = 0"), [("c_acctbal", "desc"), ("c_custkey", "asc")]).drop("c_acctbal")
    return validation.top_and_controls(ranked, "label", "rank", "c_custkey", 25, 50, 50, 1234)


@query("WITH " + _ARMS + "SELECT * FROM arms")
def seeded_controls(spark, sf):
    return shaped(_arms(spark, sf).select("c_custkey", "rank", "arm"))


@query(_BEST + ", " + _ARMS + """,
h AS (SELECT arm, CAST(coalesce(max_stage_number, -1) >= 4 AS INT) AS any_hit, CAST(coalesce(immune_stage_number, -1) >= 4 AS INT) AS immune_hit
  FROM arms LEFT JOIN best ON o_custkey = c_custkey),
c AS (SELECT count(*) FILTER (WHERE arm = 'top') AS tn, count(*) FILTER (WHERE arm = 'control') AS cn, sum(any_hit) FILTER (WHERE arm = 'top') AS ta,
  sum(any_hit) FILTER (WHERE arm = 'control') AS ca, sum(immune_hit) FILTER (WHERE arm = 'top') AS ti, sum(immune_hit) FILTER (WHERE arm = 'control') AS ci FROM h),
cells AS (SELECT 'any_hit' AS outcome, tn, cn, ta::BIGINT AS a, ca::BIGINT AS c FROM c UNION ALL SELECT 'immune_hit', tn, cn, ti::BIGINT, ci::BIGINT FROM c),
z AS (SELECT outcome, i, lgamma(tn + 1) + lgamma(cn + 1) + lgamma(a + c + 1) + lgamma(tn + cn - a - c + 1) - lgamma(tn + cn + 1)
    - lgamma(i + 1) - lgamma(tn - i + 1) - lgamma(a + c - i + 1) - lgamma(cn - a - c + i + 1) AS lp
  FROM cells, LATERAL (SELECT unnest(range(greatest(0, a + c - cn), least(tn, a + c) + 1)) AS i))
SELECT outcome, CAST(tn AS BIGINT) AS top_n, a AS top_hits, CAST(cn AS BIGINT) AS ctrl_n, c AS ctrl_hits,
  round(100.0::DOUBLE * a / tn, 6) AS top_pct, round(100.0::DOUBLE * c / cn, 6) AS ctrl_pct,
  round((SELECT least(1.0::DOUBLE, sum(exp(lp))) FROM z WHERE z.outcome = cells.outcome AND lp <= (SELECT lp FROM z y WHERE y.outcome = cells.outcome AND y.i = cells.a) + 1e-7), 6) AS p
FROM cells
""")
def arm_tallies(spark, sf):
    best = _best(spark, sf).select(F.col("o_custkey").alias("c_custkey"), "max_stage_number", "immune_stage_number")
    hit = lambda c: F.coalesce((F.col(c) >= 4).cast("int"), F.lit(0))
    tagged = _arms(spark, sf).join(best, "c_custkey", "left").withColumns(
        {"any_hit": hit("max_stage_number"), "immune_hit": hit("immune_stage_number")})
    return shaped(validation.arm_tallies(tagged, "arm", ["any_hit", "immune_hit"]))
