"""Vector and bit-string helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalised(v: Column, floor: float = 1e-8) -> Column:
    return F.transform(v, lambda x: x.cast("double") / (l2_norm(v) + floor))


def l2_distance(a: Column, b: Column) -> Column:
    return l2_norm(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")))


def argmax(v: Column) -> Column:
    """First place of the largest value, from 0."""
    return F.array_position(v, F.array_max(v)) - 1


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def packed_bits(flags: Column) -> Column:
    """Up to 64 booleans as a BIGINT, first flag in the highest bit."""
    return F.aggregate(flags, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))
