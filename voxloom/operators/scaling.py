"""Intensity statistics and normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from .cleaning import _beside, _beside_quantiles

BINS = 65536
#: The share of voxels cut off at either end is one in this many.
CUT = 5000


def minmax_scale(df: DataFrame, keys: list[str], value: str = "v", low: float | None = None, high: float | None = None) -> DataFrame:
    """``scaled``: 0..1 within each group, or within fixed bounds."""
    if low is not None and high is not None:
        return df.withColumn("scaled", N.minmax(F.col(value), F.lit(low), F.lit(high)))
    return _beside(df, keys, F.min(value).alias("_lo"), F.max(value).alias("_hi")).withColumn("scaled", N.minmax(F.col(value), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def histogram(df: DataFrame, keys: list[str], value: str, bins: int, low: float, high: float) -> DataFrame:
    """(keys, bin, n): equal bins over [low, high], the last one closed; values outside aren't counted."""
    at = F.least(F.floor((F.col(value) - F.lit(low)) * (bins / (high - low))), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(value).between(low, high)).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _running(keys: list[str], forward: bool) -> Window:
    return Window.partitionBy(*keys).orderBy(F.col("bin") if forward else F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)


def cumulative_bounds(df: DataFrame, keys: list[str], value: str = "v", bins: int = BINS, high: float = 65535.0, cut: int = CUT) -> DataFrame:
    """The bins at which more than ``1 / cut`` of a group's values lie below and above; the whole range if there is none.

    Only a histogram of at most ``bins`` rows a group is ordered.
    """
    h = histogram(df, keys, value, bins, 0.0, high)
    total = df.groupBy(*keys).agg((F.count(value) / cut).cast("long").alias("most"))
    told = h.join(total, keys).withColumn("up", F.sum("n").over(_running(keys, True))).withColumn("down", F.sum("n").over(_running(keys, False)))
    return told.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("up") > F.col("most"), F.col("bin"))), F.lit(0)).alias("lo"), F.coalesce(F.max(F.when(F.col("down") > F.col("most"), F.col("bin"))), F.lit(bins - 1)).alias("hi"))


def count_bounds(df: DataFrame, keys: list[str], value: str = "v", bins: int = 256, low: float = 0.0, high: float = 255.0, cut: int = CUT) -> DataFrame:
    """Left edges of the first and last bin that alone hold more than ``1 / cut`` of a group's values."""
    h = histogram(df, keys, value, bins, low, high)
    total = df.groupBy(*keys).agg((F.count(value) / cut).cast("long").alias("most"))
    width = (high - low) / bins
    kept = h.join(total, keys).filter("n > most")
    return kept.groupBy(*keys).agg((F.min("bin") * F.lit(width) + low).alias("lo"), (F.max("bin") * F.lit(width) + low).alias("hi"))


def pooled_bounds(df: DataFrame, value: str = "v", bins: int = BINS, cut: int = CUT) -> DataFrame:
    """Cumulative bounds over all volumes together, zeros left out, as values on an even grid from 0 to the greatest."""
    some = df.filter(F.col(value) != 0)
    top = some.agg(F.max(value).alias("top"), F.count(value).alias("all"))
    at = F.least(F.floor(F.col(value) * bins / F.col("top")), F.lit(bins - 1)).cast("int")
    h = some.crossJoin(F.broadcast(top)).groupBy(at.alias("bin"), "top", "all").agg(F.count(F.lit(1)).alias("n"))
    most = (F.col("all") / cut).cast("long")
    up, down = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col("bin"), F.col("bin").desc()))
    told = h.withColumn("most", most).withColumn("up", F.sum("n").over(up)).withColumn("down", F.sum("n").over(down))
    step = F.max("top") / (bins - 1)
    return told.agg((F.coalesce(F.min(F.when(F.col("up") > F.col("most"), F.col("bin"))), F.lit(0)) * step).alias("lo"), (F.coalesce(F.max(F.when(F.col("down") > F.col("most"), F.col("bin"))), F.lit(bins - 1)) * step).alias("hi"))


def mean_std(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Mean and population standard deviation from sums."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.sqrt(F.greatest(F.avg(F.col(value) * F.col(value)) - F.avg(value) * F.avg(value), F.lit(0.0))).alias("std"))


def percentile_band(df: DataFrame, keys: list[str], value: str = "v", low: float = 0.9975, high: float = 0.999) -> DataFrame:
    """Rows strictly between two percentiles of their group."""
    return _beside_quantiles(df, keys, {"_lo": (F.col(value), low), "_hi": (F.col(value), high)}).filter((F.col(value) > F.col("_lo")) & (F.col(value) < F.col("_hi"))).drop("_lo", "_hi")


def contrast_clip(df: DataFrame, keys: list[str], value: str = "v", bins: int = 256, high: float = 255.0, cut: int = CUT) -> DataFrame:
    """``clipped``: 0..1 between the first and last well-filled bin of the group, cut off outside."""
    b = count_bounds(df, keys, value, bins, 0.0, high, cut).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    told = df.join(b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    scaled = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(2.0**-23))
    return told.withColumn("clipped", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).drop(*(f"_{k}" for k in keys), "_lo", "_hi")


def softmax(df: DataFrame, keys: list[str], value: str, temperature: float = 1.0) -> DataFrame:
    """``p``: exp(value / temperature) over its group's sum, the greatest taken off first."""
    top = _beside(df, keys, F.max(value).alias("_top"))
    e = top.withColumn("_e", F.exp((F.col(value) - F.col("_top")) / temperature)).drop("_top")
    return _beside(e, keys, F.sum("_e").alias("_all")).withColumn("p", F.col("_e") / F.col("_all")).drop("_e", "_all")


def centred(df: DataFrame, centre: DataFrame, on: list[str], value: str) -> DataFrame:
    """``value`` less its centre; centre: one row for each ``on`` (a score's column, say), with ``centre``. Values without one stay."""
    told = centre.select(*(F.col(k).alias(f"_{k}") for k in on), F.col("centre").alias("_centre"))
    joined = df.join(told, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in on], "left")
    return joined.withColumn(value, F.col(value) - F.coalesce("_centre", F.lit(0.0))).drop("_centre", *(f"_{k}" for k in on))


def log_softmax(df: DataFrame, keys: list[str], value: str, temperature: float = 1.0) -> DataFrame:
    """``log_p``: value / temperature less the logarithm of its group's summed exponentials, the greatest taken off first."""
    top = _beside(df, keys, F.max(value).alias("_top"))
    shifted = top.withColumn("_s", (F.col(value) - F.col("_top")) / temperature).drop("_top")
    return _beside(shifted, keys, F.log(F.sum(F.exp("_s"))).alias("_all")).withColumn("log_p", F.col("_s") - F.col("_all")).drop("_s", "_all")


def low_outliers(df: DataFrame, keys: list[str], value: str, k: float) -> DataFrame:
    """Rows more than ``k`` sample deviations below their group's mean."""
    return _beside(df, keys, F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s")).filter(F.col(value) < F.col("_m") - k * F.col("_s")).drop("_m", "_s")
