"""Number columns: rounding policy, null sentinels, guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def rnd(c, digits: int = 0) -> Column:
    """Round half away from zero on the scaled value, one policy for every published number."""
    scale = float(10 ** digits)
    return F.round(col(c) * F.lit(scale), 0) / F.lit(scale)


def ratio(a, b) -> Column:
    """a / b, NULL for a zero or missing denominator (also under ANSI mode)."""
    return col(a) / F.nullif(col(b).cast("double"), F.lit(0.0))


def pct(part, whole, digits: int = 1) -> Column:
    return rnd(ratio(F.lit(100.0) * col(part), whole), digits)


def finite(c) -> Column:
    """NULL for NaN and both infinities."""
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def denan(c) -> Column:
    x = col(c)
    return F.when(~F.isnan(x), x)


def clean_nulls(df: DataFrame, keep_infinite: bool = True) -> DataFrame:
    """Turn NaN (and, for a sink, infinities) into NULL in every floating column, nested ones too."""
    fix = denan if keep_infinite else finite

    def walk(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return fix(c)
        if isinstance(t, T.ArrayType):
            if _has_float(t.elementType):
                return F.transform(c, lambda x: walk(x, t.elementType))
            return c
        if isinstance(t, T.StructType) and _has_float(t):
            return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
        return c

    return df.select(*[
        walk(F.col(f"`{f.name}`"), f.dataType).alias(f.name) if _has_float(f.dataType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def _has_float(t: T.DataType) -> bool:
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return True
    if isinstance(t, T.ArrayType):
        return _has_float(t.elementType)
    if isinstance(t, T.StructType):
        return any(_has_float(f.dataType) for f in t.fields)
    return False


def cagr_percent(first, last, span_days, points, min_points=6, min_days=180, max_abs=2.0) -> Column:
    """Annualised growth in percent; NULL until the history is long enough or when implausible."""
    growth = F.pow(ratio(last, first), F.lit(365.25) / F.nullif(col(span_days).cast("double"), F.lit(0.0))) - 1
    ok = (col(points) >= min_points) & (col(span_days) >= min_days) & (col(first) > 0) & (col(last) > 0)
    return F.when(ok & (F.abs(growth) <= max_abs), rnd(growth * 100, 1))
