"""Vector expressions over array columns. Everything is computed in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def raw_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def checked(a: Column, b: Column, value: Column) -> Column:
    """Empty vectors and vectors of unequal length are errors."""
    bad = (F.size(a) == 0) | (F.size(a) != F.size(b))
    return F.when(bad, F.raise_error(F.lit("vectors must be non-empty and of equal length")).cast("double")).otherwise(value)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def cosine(a: Column, b: Column) -> Column:
    """In -1..1; 0 where a norm is 0."""
    na, nb = raw_dot(a, a), raw_dot(b, b)
    return checked(a, b, F.when((na <= 0) | (nb <= 0), F.lit(0.0)).otherwise(clamp(raw_dot(a, b) / (F.sqrt(na) * F.sqrt(nb)), -1.0, 1.0)))


def unit_dot(a: Column, b: Column) -> Column:
    """Cosine of vectors that are already of unit length."""
    return checked(a, b, clamp(raw_dot(a, b), -1.0, 1.0))


def normalized(v: Column, tiny: float = 1e-12) -> Column:
    """Unit length; empty and tiny vectors stay as they are."""
    norm = F.sqrt(raw_dot(v, v))
    return F.when((F.size(v) == 0) | (norm <= tiny), doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / norm))


def normalized_or_zero(v: Column, tiny: float = 1.401298464324817e-45) -> Column:
    """Unit length; vectors without length become zeros."""
    norm = F.sqrt(raw_dot(v, v))
    return F.when(norm <= tiny, F.transform(doubles(v), lambda x: F.lit(0.0))).otherwise(F.transform(doubles(v), lambda x: x / norm))


def valid(v: Column, dim: int) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & (raw_dot(v, v) > 1e-12), F.lit(False))


def variance(x: Column) -> Column:
    """Population variance of an array's values, inside the row."""
    mean = F.aggregate(x, F.lit(0.0), lambda s, y: s + y) / F.size(x)
    return F.get(F.transform(F.array(mean), lambda m: F.aggregate(x, F.lit(0.0), lambda s, y: s + (y - m) * (y - m)) / F.size(x)), F.lit(0))


def centroid(df: DataFrame, keys: list[str], vector: str, dim: int, weight: Column | None = None, floor: float = 0.01) -> DataFrame:
    """keys, centroid (unit length): the mean per component, weighted if asked. One sum a component, so a row stays a row and only sums are shuffled."""
    w = F.lit(1.0) if weight is None else F.greatest(F.lit(floor), F.coalesce(weight, F.lit(1.0)))
    v = doubles(F.col(vector))
    rows = df.where(v.isNotNull()).select(*keys, w.alias("w"), F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.lit(f"vectors must have {dim} components")).cast("array<double>")).alias("v"))
    sums = rows.groupBy(*keys).agg(F.sum("w").alias("w"), *(F.sum(F.col("w") * F.get("v", F.lit(k))).alias(f"s{k}") for k in range(dim)))
    means = sums.select(*keys, F.transform(F.array(*(f"s{k}" for k in range(dim))), lambda s: s / F.col("w")).alias("m"))
    return means.select(*keys, normalized(F.col("m")).alias("centroid"))
