"""Probability vectors as ``array<double>`` columns; everything stays in generated code."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from barometry.constants import REGIME_NAMES


def blend(a: Column, b: Column, wa: float, wb: float) -> Column:
    """Weighted mean of two vectors, the weights brought to sum 1."""
    total = wa + wb
    return F.zip_with(a, b, lambda x, y: x * F.lit(wa / total) + y * F.lit(wb / total))


def argmax(p: Column) -> Column:
    """0-based position of the first largest element."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def rounded(p: Column, digits: int = 4) -> Column:
    return F.transform(p, lambda x: F.round(x, digits))


def normalised(p: Column) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(p, lambda x: x / total)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    return normalised(F.transform(logits, lambda x: F.exp(x - top)))


def permuted(p: Column, source_of: list[int]) -> Column:
    """Vector whose element ``i`` is ``p[source_of[i]]``."""
    return F.array(*[F.element_at(p, s + 1) for s in source_of])


def regime_name(regime: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in REGIME_NAMES]), regime + 1)
