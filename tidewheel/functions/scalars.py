"""Scalar and array expressions that the plans share."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def softmax(x: Column, *by: str) -> Column:
    """e^x over its sum in the group, from the group's maximum."""
    w = Window.partitionBy(*by)
    e = F.exp(x - F.max(x).over(w))
    return e / F.sum(e).over(w)


def pad_right(items: Column, n: int, value: Column) -> Column:
    """An array of exactly ``n``: cut or filled with ``value``."""
    return F.slice(F.concat(items, F.array_repeat(value, n)), 1, n)


def half_life(age: Column, days: float) -> Column:
    """2 ** (-age / days); 1 where days is 0."""
    return F.pow(F.lit(2.0), -age / days) if days else F.lit(1.0)
