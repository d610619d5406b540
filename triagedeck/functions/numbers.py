"""Numeric column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prediction codes and their names.
FAILED = -2
CODE_NAMES = {-2: "failed", -1: "mixed", 0: "not severe", 1: "severe"}
LOG_FLOOR = -100.0


def missing_to_failed(c: Column) -> Column:
    """NaN or null prediction -> the failed code, others as integers."""
    value = c.cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(FAILED)).otherwise(value.cast("int"))


def code_name(c: Column, names: Mapping[int, str] = CODE_NAMES) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.element_at(F.create_map(*pairs), c.cast("int"))


def rounded_label(p: Column) -> Column:
    """Nearest integer, halves to even."""
    return F.bround(p, 0).cast("int")


def threshold_label(p: Column, t: Column | float, strict: bool = False) -> Column:
    t = t if isinstance(t, Column) else F.lit(float(t))
    return ((p > t) if strict else (p >= t)).cast("int")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def cross_entropy(y: Column, p: Column) -> Column:
    """Binary cross-entropy of one row; logarithms never fall below the floor."""

    def floored(q: Column) -> Column:
        return F.when(q <= 0, F.lit(LOG_FLOOR)).otherwise(
            F.greatest(F.log(q), F.lit(LOG_FLOOR))
        )

    return -(y * floored(p) + (F.lit(1.0) - y) * floored(F.lit(1.0) - p))


def rescale(x: Column, lo: Column, hi: Column, out_lo: Column, out_hi: Column) -> Column:
    """Linear map of [lo, hi] onto [out_lo, out_hi]; a constant input goes to out_lo."""
    share = F.when(hi == lo, F.lit(0.0)).otherwise((x - lo) / (hi - lo))
    return out_lo + share * (out_hi - out_lo)


def minkowski(a: Column, b: Column, p: int) -> Column:
    """Minkowski distance of two numeric arrays."""
    powers = F.zip_with(a, b, lambda x, y: F.pow(F.abs(x.cast("double") - y.cast("double")), F.lit(float(p))))
    total = F.aggregate(powers, F.lit(0.0), lambda s, v: s + v)
    return F.pow(total, F.lit(1.0 / p))
