"""Columns at the engine's boundary: text to double, one missing marker, guarded arithmetic, fills."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spreads and denominators up to this count as zero.
TINY = 1e-12
_NUMBER = r"^\s*[+-]?(([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|inf|infinity|nan)\s*$"


def nullify(x: Column) -> Column:
    """NaN and infinities become null; aggregates then skip them."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def to_double(x: Column, kind: T.DataType | None = None) -> Column:
    """Any column as finite double or null; text must look like a number as a whole ('1.5d' doesn't)."""
    if kind is not None and isinstance(kind, T.NumericType):
        return nullify(x.cast("double"))
    if kind is not None and isinstance(kind, T.BooleanType):
        return x.cast("double")
    text = x.cast("string")
    return nullify(F.when(F.lower(text).rlike(_NUMBER), F.trim(text).try_cast("double")))


def divide(a: Column, b: Column) -> Column:
    """a / b; null where b is zero."""
    return F.try_divide(a, b)


def guarded_divide(a: Column, b: Column, least: float = TINY) -> Column:
    """a / b; null where |b| is at most `least`."""
    return F.when(F.abs(b) > least, a / b)


def fill(x: Column, value: float | None) -> Column:
    """x, or the fitted value where missing; a column with no value at all fills with 0."""
    return F.coalesce(x, F.lit(0.0 if value is None else float(value)))


def finite_or_zero(x: Column) -> Column:
    """Hygiene fill: whatever isn't a finite number is 0."""
    return F.coalesce(nullify(x), F.lit(0.0))


def missing_flag(x: Column) -> Column:
    return x.isNull().cast("double")
