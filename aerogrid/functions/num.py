"""Small numeric column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """0/1 flag in which a comparison with a missing value counts as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def clip(c: Column | str, lo, hi) -> Column:
    """Clip to bounds (either may be None) and keep missing values missing."""
    c = col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(hi))
    return F.when(c.isNotNull(), out)


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """num/den, and `default` where the denominator is zero."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(float(default)))


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Round for reporting."""
    return F.round(col(c), digits)


def no_nan(c: Column | str) -> Column:
    """NaN becomes null: missing values have one form inside the library."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def right_closed(c: Column | str, edges: list[float], labels: list) -> Column:
    """Bins (e0,e1], (e1,e2] ...; the lowest edge itself and everything outside is null."""
    c = col(c)
    out = None
    for hi, label in zip(edges[1:], labels):
        cond = (c <= F.lit(float(hi))) if hi != float("inf") else c.isNotNull()
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.when(c > F.lit(float(edges[0])), out)


def numeric_columns(df, exclude: set[str] = frozenset()) -> list[str]:
    """Names of the numeric columns, by schema."""
    kinds = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [n for n, t in df.dtypes if (t in kinds or t.startswith("decimal")) and n not in exclude]


def categorical_columns(df, exclude: set[str] = frozenset()) -> list[str]:
    return [n for n, t in df.dtypes if t == "string" and n not in exclude]
