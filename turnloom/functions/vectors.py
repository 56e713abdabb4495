"""Column functions on numeric arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; null where lengths differ or an entry is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(a: Column) -> Column:
    """The array at unit length; null for a zero array."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def hashed(terms: Column, dims: int = 256) -> Column:
    """Terms as a signed count vector: a term adds 1 or -1 (the ninth digit of its MD5 is even or odd) at the place its first eight digits name."""
    part = lambda t, at, n: F.conv(F.substring(F.md5(t), at, n), 16, 10).cast("bigint")
    each = F.transform(terms, lambda t: F.struct(F.pmod(part(t, 1, 8), F.lit(dims)).alias("place"), F.when(F.pmod(part(t, 9, 1), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.filter(each, lambda x: x["place"] == i), F.lit(0.0), lambda s, x: s + x["sign"]))
