"""Filling and cleaning of values; ``keys`` name the groups (volumes) that are treated apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import quantiles

TINY = 1e-6


def _beside(df: DataFrame, keys: list[str], *stats) -> DataFrame:
    """``df`` with its groups' statistics; a single row is broadcast, groups are joined by their keys."""
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(*stats)))  # one row
    named = df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(*stats)
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = df.join(named, on)
    return joined.drop(*(f"_{k}" for k in keys))


def _beside_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """``df`` with its groups' quantiles, found without a list of a group's values."""
    found = quantiles(df, keys, wanted)
    if not keys:
        return df.crossJoin(F.broadcast(found))  # one row
    named = found.withColumnsRenamed({k: f"_{k}" for k in keys})
    return df.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*(f"_{k}" for k in keys))


def median_fill(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Values of nearly zero become the median of the others."""
    some = F.when(F.abs(value) > TINY, F.col(value))
    return _beside_quantiles(df, keys, {"_m": (some, 0.5)}).withColumn(value, F.when(F.abs(value) <= TINY, F.coalesce("_m", value)).otherwise(F.col(value))).drop("_m")


def is_finite(value: str):
    return F.col(value).isNotNull() & ~F.isnan(value) & ~F.abs(F.col(value)).eqNullSafe(F.lit(float("inf")))


def sanitize_nonfinite(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """NaN and null become the median of the finite values, infinities their greatest and least; a group without any fails."""
    good = F.when(is_finite(value), F.col(value).cast("double"))
    told = _beside_quantiles(df, keys, {"_m": (good, 0.5), "_lo": (good, 0.0), "_hi": (good, 1.0)})
    clean = F.when(is_finite(value), F.col(value)).when(F.col(value).isNull() | F.isnan(value), F.col("_m")).when(F.col(value) > 0, F.col("_hi")).otherwise(F.col("_lo"))
    return told.withColumn(value, F.when(F.col("_m").isNull(), F.raise_error(F.lit("volume contains no finite voxels")).cast("double")).otherwise(clean)).drop("_m", "_lo", "_hi")


def pad_value(df: DataFrame, keys: list[str], value: str = "v", inside: str = "inside") -> DataFrame:
    """The value that pads a volume: the median of its finite masked voxels, else of all finite ones. A missing mask is all true."""
    good = F.when(is_finite(value), F.col(value).cast("double"))
    masked = F.when(F.coalesce(F.col(inside), F.lit(True)), good)
    found = quantiles(df, keys, {"masked": (masked, 0.5), "whole": (good, 0.5)})
    return found.select(*keys, F.coalesce("masked", "whole").alias("pad"), F.isnull("masked").alias("unmasked"))


def fill_edges(df: DataFrame, keys: list[str], value: str = "v", valid: str = "valid") -> DataFrame:
    """Invalid voxels take the median of the invalid ones."""
    return _beside_quantiles(df, keys, {"_m": (F.when(~F.col(valid), F.col(value)), 0.5)}).withColumn(value, F.when(F.col(valid), F.col(value)).otherwise(F.col("_m"))).drop("_m")
