"""Unsigned 64-bit arithmetic on decimal(20,0): comparisons are those of integers, and sums
wrap modulo 2^64 as machine words do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = T.DecimalType(20, 0)
TWO_64 = 1 << 64


def wrapped_sum(c: Column) -> Column:
    """SUM modulo 2^64, null over no rows. The exact sum is a decimal(30,0) at most."""
    return (F.sum(c) % F.lit(str(TWO_64)).cast("decimal(38,0)")).cast(U64)


def wrapped_product(a: Column, b: Column) -> Column:
    """a * b modulo 2^64 of two values below 2^64, by halves of a, so that no step leaves decimal(38,0)."""
    wide = lambda c: c.cast("decimal(38,0)")
    half, whole = (wide(F.lit(str(1 << n))) for n in (32, 64))
    a, b = wide(a), b.cast(U64)
    high, low = ((a - a % half) / half).cast("decimal(10,0)"), (a % half).cast("decimal(10,0)")
    upper = (wide(high * b) % half).cast("decimal(10,0)") * half.cast("decimal(10,0)")
    return ((wide(upper) + wide(low * b)) % whole).cast(U64)
