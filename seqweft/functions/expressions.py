"""Column expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skew(col: str | Column) -> Column:
    """Bias-corrected skewness (needs three values); 0 for a constant series."""
    n = F.count(col).cast("double")
    scale = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n >= 3, F.coalesce(_unless_constant(F.skewness(col), col) * scale, F.lit(0.0)))


def sample_kurtosis(col: str | Column) -> Column:
    """Bias-corrected excess kurtosis (needs four values); 0 for a constant series."""
    n = F.count(col).cast("double")
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    corrected = scale * ((n + 1) * _unless_constant(F.kurtosis(col), col) + 6)
    return F.when(n >= 4, F.coalesce(corrected, F.lit(0.0)))


def _unless_constant(stat: Column, col: str | Column) -> Column:
    return F.when(F.max(col) > F.min(col), stat)


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation over rows where both are finite; null for a constant side, where `corr` raises an error."""
    a, b = (finite(F.col(c) if isinstance(c, str) else c) for c in (x, y))
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def finite(value: Column) -> Column:
    """The value as a double; null if it is null, NaN or infinite."""
    number = value.cast("double")
    return F.when(F.abs(number) <= 1.7976931348623157e308, number)


def hash_order(*cols: str | Column) -> Column:
    """A repeatable pseudo-random whole number in [0, 2^32), equal in any engine that has md5."""
    text = F.concat_ws("|", *cols)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
