"""Vector arithmetic on array columns, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(_d(v), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(_d(a), _d(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(_d(v), lambda x: x * x)))


def scale(v: Column, by: Column) -> Column:
    return F.transform(_d(v), lambda x: x * by)


def let(value: Column, f) -> Column:
    """f of a value that is computed once; inside a lambda an outer expression would be computed for every coordinate."""
    return F.element_at(F.transform(F.array(value), f), 1)


def l2_normalize(v: Column) -> Column:
    """The unit vector; a zero vector stays zero."""
    return let(_d(v), lambda u: let(norm(u), lambda n: F.when(n > 0, F.transform(u, lambda x: x / n)).otherwise(u)))


def prefix_normalize(v: Column, d: int) -> Column:
    """The first d coordinates at unit length."""
    return l2_normalize(F.slice(v, 1, d))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(_d(a), _d(b), lambda x, y: x + y)


def saxpy(a: Column, x: Column, y: Column) -> Column:
    """a * x + y."""
    return F.zip_with(_d(x), _d(y), lambda p, q: a * p + q)


def affine(v: Column, mean: Column, inverse: Column) -> Column:
    """(v - mean) * inverse, coordinate by coordinate."""
    return F.zip_with(F.zip_with(_d(v), _d(mean), lambda x, m: x - m), _d(inverse), lambda x, s: x * s)


def nested(v: Column, decay: float) -> Column:
    """Coordinate r times 1 / sqrt(1 + r / decay)."""
    return F.transform(_d(v), lambda x, i: x / F.sqrt(1 + i / F.lit(decay)))


def value_range(v: Column) -> Column:
    return F.struct(F.array_min(v).alias("least"), F.array_max(v).alias("greatest"))


def at_least(v: Column, threshold: Column) -> Column:
    """The places (from 0) of values at or above the threshold."""
    return F.filter(F.transform(v, lambda x, i: F.when(x >= threshold, i)), lambda i: i.isNotNull())


def to_bf16(v: Column) -> Column:
    """The upper halves of the floats' bits, cut off, as shorts."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<smallint>")
    def pack(s):
        import numpy as np

        return s.map(lambda x: None if x is None else (np.asarray(x, "<f4").view("<u4") >> 16).astype("<u2").view("<i2"))

    return pack(v)


def from_bf16(v: Column) -> Column:
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def unpack(s):
        import numpy as np

        return s.map(lambda x: None if x is None else (np.asarray(x, "<i2").view("<u2").astype("<u4") << 16).view("<f4"))

    return unpack(v)
