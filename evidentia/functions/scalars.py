"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted shape of a symbol, the smallest p used on a log scale,
# and the clinical-stage scale (label, number).
SYMBOL_SHAPE = r"^[A-Z0-9][A-Za-z0-9._-]*$"
P_FLOOR = 1e-300
STAGES = {
    "APPROVAL": ("Approved", 4.0),
    "PHASE_4": ("Phase IV", 4.0),
    "PHASE_3": ("Phase III", 3.0),
    "PHASE_2_3": ("Phase II/III", 2.5),
    "PHASE_2": ("Phase II", 2.0),
    "PHASE_1_2": ("Phase I/II", 1.5),
    "PHASE_1": ("Phase I", 1.0),
    "EARLY_PHASE_1": ("Early Phase I", 0.5),
    "PHASE_0": ("", 0.0),
    "PRECLINICAL": ("", 0.0),
}


def as_col(c: Column | str | float) -> Column:
    """A column from a name, a number or a column."""
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(c)


def stripped(c: Column | str) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.regexp_replace(as_col(c), r"^\s+|\s+$", "")


def is_named(c: Column | str) -> Column:
    """True for text that is neither blank nor the literal NA (NULL counts as blank)."""
    return F.coalesce((stripped(c) != "") & (as_col(c) != "NA"), F.lit(False))


def not_in(c: Column | str, values: Sequence) -> Column:
    """Exclusion that keeps missing values, unlike SQL ``NOT IN``."""
    return ~F.coalesce(as_col(c).isin(*values), F.lit(False))


def has_prefix(c: Column | str, prefix: str) -> Column:
    return F.coalesce(as_col(c).startswith(prefix), F.lit(False))


def is_finite(c: Column | str) -> Column:
    """True for a real number: not NULL, NaN or infinite."""
    x = as_col(c).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def number(c: Column | str) -> Column:
    """Numeric reading of text; anything unreadable or NaN becomes missing."""
    return F.nanvl(as_col(c).try_cast("double"), F.lit(None).cast("double"))


def flag(cond: Column) -> Column:
    """0/1 integer for a condition; unknown counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def well_formed(c: Column | str) -> Column:
    return as_col(c).rlike(SYMBOL_SHAPE)


def tokens(c: Column | str, sep: str = "|") -> Column:
    """Non-blank tokens of a delimited text."""
    return F.filter(F.split(as_col(c), "[" + sep + "]"), lambda t: F.trim(t) != "")


def joined_distinct(arr: Column, sep: str = "; ") -> Column:
    """Distinct non-empty elements in first-seen order, joined; empty text for none."""
    kept = F.array_except(arr, F.array(F.lit(""), F.lit(None).cast("string")))
    return F.coalesce(F.array_join(kept, sep), F.lit(""))


def clip(c: Column | str, lo: Column | float, hi: Column | float) -> Column:
    """Clamp into bounds; missing stays missing."""
    x = as_col(c)
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def neg_log10(p: Column | str) -> Column:
    return -F.log10(F.greatest(as_col(p), F.lit(P_FLOOR)))


def signed_log10(effect: Column | str, p: Column | str) -> Column:
    return F.when(as_col(p).isNotNull(), F.signum(as_col(effect)) * neg_log10(p))


def same_sign(a: Column | str, b: Column | str) -> Column:
    """Sign agreement; false when either side is missing."""
    return F.coalesce(F.signum(as_col(a)) == F.signum(as_col(b)), F.lit(False))


def max_abs(*cols: Column | str) -> Column:
    """Largest magnitude of a row, skipping missing entries."""
    return F.greatest(*[F.abs(as_col(c)) for c in cols])


def any_at_least(threshold: float, *cols: Column | str) -> Column:
    """1.0 if any magnitude reaches the threshold, else 0.0 (also when all are missing)."""
    return F.coalesce(max_abs(*cols) >= F.lit(float(threshold)), F.lit(False)).cast("double")


def ratio(a: Column | str, b: Column | str) -> Column:
    """Quotient that is missing when the divisor is zero or missing."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def percent(n: Column | str, d: Column | str, places: int = 1) -> Column:
    return F.round(ratio(F.lit(100.0) * as_col(n), d), places)


def lookup(c: Column | str, table: Mapping, default) -> Column:
    """Constant-table lookup with a default."""
    out = F.lit(default)
    if not table:
        return out
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[as_col(c)], out)


def stage_label(c: Column | str) -> Column:
    return lookup(c, {k: v[0] for k, v in STAGES.items()}, "")


def stage_number(c: Column | str) -> Column:
    return lookup(c, {k: v[1] for k, v in STAGES.items()}, -1.0)


def stars(p: Column | str) -> Column:
    """Significance marks for a p-value."""
    p = as_col(p)
    return (
        F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
    )


def rate_text(n: Column | str, d: Column | str) -> Column:
    """``72 / 505 = 14.3%``"""
    n, d = as_col(n), as_col(d)
    return F.format_string("%d / %d = %.1f%%", n, d, F.lit(100.0) * ratio(n, d))


def fold_text(fold: Column, odds: Column, lo: Column, hi: Column) -> Column:
    """``4.3× (OR 4.9, 3.8–6.3)`` — each number rounded once from full precision."""
    return F.format_string("%.1f× (OR %.1f, %.1f–%.1f)", fold, odds, lo, hi)


def exponent_text(p: Column | str) -> Column:
    """``4e-24``"""
    return F.regexp_replace(F.format_string("%.0e", as_col(p)), r"\.e", "e")


def text_flag(c: Column | str) -> Column:
    """Reading of True/TRUE/true text as a boolean."""
    return F.upper(as_col(c).cast("string")) == "TRUE"


def decoded(codes: Column | str, categories: Column | str) -> Column:
    """Category text for a 0-based code; a negative code is missing."""
    codes = as_col(codes)
    return F.when(codes >= 0, F.get(as_col(categories), codes))
