"""Small column helpers on top of the built-in functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; null stays null (``greatest``/``least`` alone would skip it)."""
    bounded = c
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    return F.when(c.isNotNull(), bounded)


def normalise_ticker(c: Column) -> Column:
    return F.upper(F.trim(c))


def percent(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", c * 100)


def count_present(columns: list[str]) -> Column:
    """Row-wise number of non-null values."""
    return F.expr(" + ".join(f"int({name} is not null)" for name in columns) or "0")


def title_case(c: Column) -> Column:
    return F.initcap(F.lower(c))


def split_list(c: Column) -> Column:
    """``"spy, qqq"`` -> ``["SPY", "QQQ"]``."""
    return F.transform(F.split(c, ","), normalise_ticker)
