"""Per-column regression scan over a large matrix, and two-group rank tests.

For every (condition, column) the model is ``z(y) ~ a*z(x) + b*w + c`` over the rows
with finite x, y and w whose entity is not the column itself. With one predictor of
interest and one covariate the fit has a closed form in the three correlations, so
the whole scan is one aggregation of second moments.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.scalars import is_finite, ratio, signed_log10
from evidentia.functions.tails import rank_sum_p, student_t_two_sided
from evidentia.operators.ordering import average_rank, benjamini_hochberg, scan, value_counts

MIN_ROWS = 100
COLLINEAR = 1e-8
_CELLS = 2_000_000


def _solve(moments: DataFrame, by: Sequence[str], min_rows: int) -> DataFrame:
    """Coefficient, standard error and t from n and the three correlations.

    A constant x or y, or an x collinear with w, gives missing results.
    """
    xy, xw, yw = F.col("r_xy"), F.col("r_xw"), F.col("r_yw")
    left = F.lit(1.0) - xw * xw
    solvable = left > COLLINEAR
    coef = F.when(solvable, (xy - xw * yw) / left)
    explained = (xy * xy + yw * yw - 2.0 * xy * yw * xw) / left
    se = F.when(
        solvable, F.sqrt(F.greatest(1.0 - explained, F.lit(0.0)) / ((F.col("n_reg") - 3) * left))
    )
    return (
        moments.filter(F.col("n_reg") >= min_rows)
        .withColumns({"coef_beta": coef, "se_beta": se})
        .select(*by, "n_reg", "coef_beta", "se_beta")
        .withColumn("t_stat", ratio("coef_beta", "se_beta"))
    )


def scan_columns(
    cells: DataFrame, by: Sequence[str], x: str, y: str, w: str,
    entity: str | None = None, column_entity: str | None = None, min_rows: int = MIN_ROWS,
) -> DataFrame:
    """The scan on long cells (one row per matrix entry)."""
    usable = is_finite(x) & is_finite(y) & is_finite(w)
    if entity is not None:
        usable = usable & ~F.col(entity).eqNullSafe(F.col(column_entity))
    moments = cells.filter(usable).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_reg"),
        *[F.stddev_pop(c).alias(f"s_{n}") for n, c in (("x", x), ("y", y), ("w", w))],
        *[F.covar_pop(a, b).alias(f"c_{n}") for n, a, b in (("xy", x, y), ("xw", x, w), ("yw", y, w))],
    )
    # corr() fails on a constant column; the quotient is missing there.
    moments = moments.withColumns(
        {f"r_{p}{q}": ratio(F.col(f"c_{p}{q}"), F.col(f"s_{p}") * F.col(f"s_{q}")) for p, q in ("xy", "xw", "yw")}
    )
    return _solve(moments, by, min_rows)


_NAMES = ("n", "x", "y", "w", "xx", "yy", "ww", "xy", "xw", "yw")
_PARTIAL = "condition string, col_id int, " + ", ".join(f"{n} double" for n in _NAMES)


def _cell_sums(part: pd.DataFrame, shift: tuple[np.ndarray, float, float]) -> np.ndarray:
    """Sums of every column over a few rows of what cells, y and w differ from a fixed shift, and of the products."""
    x = np.stack(part["values"].to_numpy()).astype(float)
    own = part["own_cols"].to_numpy()
    at = np.repeat(np.arange(len(part)), [len(o) for o in own])
    if len(at):
        x[at, np.concatenate([o for o in own if len(o)]).astype(int)] = np.nan
    ok = np.isfinite(x)
    dx = np.where(ok, x - shift[0], 0.0)
    y = part["y"].to_numpy(dtype=float) - shift[1]
    w = part["w"].to_numpy(dtype=float) - shift[2]
    here = ok.astype(float)
    return np.stack([
        here.sum(0), dx.sum(0), y @ here, w @ here, (dx * dx).sum(0), (y * y) @ here, (w * w) @ here, y @ dx, w @ dx, (y * w) @ here
    ])


def _shifts(rows: DataFrame) -> dict[str, tuple[np.ndarray, float, float]]:
    """Per condition one row: its values, y and w.

    Sums about a fixed value near the data can be added in any order and keep the digits that sums of
    plain squares lose.
    """
    hashed = rows.withColumn("h", F.xxhash64("y", "w"))
    least = hashed.groupBy("condition").agg(F.min("h").alias("h"))  # reads y and w only
    found = hashed.join(least, ["condition", "h"], "left_semi").groupBy("condition")
    order = F.xxhash64("values")
    picked = found.agg(F.min_by("values", order).alias("v"), F.min_by("y", order).alias("y"), F.min_by("w", order).alias("w"))
    out = {}
    for r in picked.collect():
        v = np.array([np.nan if c is None else c for c in r["v"]], dtype=float)
        out[r["condition"]] = (np.where(np.isfinite(v), v, 0.0), r["y"], r["w"])
    return out


def scan_matrix(rows: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """The scan on matrix rows ``condition, values array, own_cols, y, w``.

    Every task sends one set of sums per column instead of one row per cell; sums are about a shift that is
    fixed per condition and column, so Spark adds them before and after the shuffle like
    any others. ``own_cols`` lists the columns of the row's own entity, all of which are left out.
    """
    own = F.coalesce("own_cols", F.array().cast("array<int>"))
    usable = rows.filter(is_finite("y") & is_finite("w")).select(
        F.col("condition").cast("string").alias("condition"), "values", own.alias("own_cols"),
        F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"),
    )
    shared = rows.sparkSession.sparkContext.broadcast(_shifts(usable))

    def sums(batches):
        held: dict = {}
        for pdf in batches:
            for cond, part in pdf.groupby("condition", sort=False):
                step = max(16, _CELLS // max(1, len(part["values"].iloc[0])))  # bounds the working memory
                for s in range(0, len(part), step):
                    new = _cell_sums(part.iloc[s:s + step], shared.value[cond])
                    held[cond] = held[cond] + new if cond in held else new
        for cond, m in held.items():
            keep = np.flatnonzero(m[0] > 0)
            yield pd.DataFrame({"condition": cond, "col_id": keep.astype("int32")} | {n: m[i, keep] for i, n in enumerate(_NAMES)})

    by = ["condition", "col_id"]
    total = usable.mapInPandas(sums, _PARTIAL).groupBy(*by).agg(*[F.sum(n).alias(n) for n in _NAMES])
    centred = {
        f"c_{p}{q}": F.greatest(F.col(p + q) - F.col(p) * F.col(q) / F.col("n"), F.lit(0.0 if p == q else float("-inf")))
        for p, q in ("xx", "yy", "ww", "xy", "xw", "yw")
    }
    co = total.select(*by, F.col("n").cast("bigint").alias("n_reg"), *[e.alias(n) for n, e in centred.items()])
    # What rounding leaves of a constant column is no variance.
    flat = {f"c_{p}{p}": F.when(F.col(f"c_{p}{p}") > 0, F.col(f"c_{p}{p}")).otherwise(0.0) for p in "xyw"}
    corr = {
        f"r_{p}{q}": ratio(F.col(f"c_{p}{q}"), F.sqrt(F.col(f"c_{p}{p}") * F.col(f"c_{q}{q}")))
        for p, q in ("xy", "xw", "yw")
    }
    return _solve(co.withColumns(flat).withColumns(corr), by, min_rows)


def with_p_values(fits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Two-sided t p-value, signed -log10 p, FDR and rank within each ``by`` group."""
    tested = fits.withColumn("p_beta", student_t_two_sided(F.col("t_stat"), (F.col("n_reg") - 3).cast("double")))
    tested = tested.withColumn("signed_log10p", signed_log10("coef_beta", "p_beta"))
    adjusted = benjamini_hochberg(tested, "p_beta", by, "fdr")
    return average_rank(adjusted, "signed_log10p", by, "rank")


def rank_sum(df: DataFrame, value: str, member: str) -> DataFrame:
    """Mann-Whitney U of members (1) over the rest (0), one-sided greater.

    Ranks come from the distinct values and their counts. Without ties and with a small
    group the exact law is used, else the normal one with tie and continuity correction.
    """
    known = df.filter(F.col(value).isNotNull() & F.col(member).isNotNull())
    counts = value_counts(
        known, value,
        n1=F.count_if(F.col(member) == 1), n0=F.count_if(F.col(member) == 0), t=F.count(F.lit(1)),
    )
    placed = scan(counts, [(value, "asc")], sums={"to": F.col("t")})
    mean_rank = F.col("to") - (F.col("t") - 1) / 2.0
    t = F.col("t").cast("double")
    sums = placed.agg(
        F.sum("n1").cast("bigint").alias("n_members"), F.sum("n0").cast("bigint").alias("n_rest"),
        F.sum(F.col("n1") * mean_rank).alias("rank_total"), F.sum(t * t * t - t).alias("ties"),
    )
    n1, n0 = F.col("n_members").cast("double"), F.col("n_rest").cast("double")
    n = n1 + n0
    u = F.col("rank_total") - n1 * (n1 + 1) / 2.0
    sd = F.sqrt(n1 * n0 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return (
        sums.withColumn("u", u)
        .withColumn("z", ratio(F.col("u") - n1 * n0 / 2.0 - 0.5, sd))
        .withColumn("p", rank_sum_p("u", "z", "n_members", "n_rest", "ties"))
        .select("n_members", "n_rest", "u", "z", "p")
    )
