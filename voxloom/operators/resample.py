"""Resampling in blocks and with a blur before, export as bytes, thresholds and soft cuts of volumes. Voxels: tp, z, y, x, v; dense."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from .grid import convolve, trilinear

_AT = ["tp", "z", "y", "x"]


def target_shape(shape: tuple[int, int, int], size: tuple[int, int, int] | None = None, scale: float | tuple[float, float, float] | None = None) -> tuple[int, int, int]:
    """The shape asked for by a size or by a scale; exactly one of them is given and all of it is positive."""
    if (size is None) == (scale is None):
        raise ValueError("give either size or scale")
    if size is None:
        each = scale if isinstance(scale, tuple) else (scale,) * 3
        if len(each) != 3 or min(each) <= 0:
            raise ValueError("a scale is a positive number or three of them")
        size = tuple(math.floor(n * s) for n, s in zip(shape, each))
    if len(size) != 3 or min(size) <= 0:
        raise ValueError(f"not a shape of three positive extents: {size}")
    return size


def gaussian_taps(size: int, sigma: float) -> list[float]:
    """A normalised kernel of an odd number of taps."""
    if size <= 0 or size % 2 == 0 or sigma <= 0:
        raise ValueError("a kernel has an odd number of taps and a positive width")
    raw = [math.exp(-((k - size // 2) ** 2) / (2 * sigma**2)) for k in range(size)]
    return [v / sum(raw) for v in raw]


def antialiased(df: DataFrame, shape: tuple[int, int, int], target: tuple[int, int, int], size: int = 5, sigma: float = 1.0) -> DataFrame:
    """The volume on another grid; it is blurred on all axes first (zeros outside) if any axis gets shorter."""
    if any(t < n for n, t in zip(shape, target)):
        for a, n in zip("zyx", shape):
            df = convolve(df, gaussian_taps(size, sigma), a, n)
    return trilinear(df, shape, target)


def _corner_in_block(i: Column, size_out: int, size_in: int, block: int) -> Column:
    """As ``numeric.source_corner``, but cells outside the block don't count; where blocks overlap in the output the later one holds."""
    begin = lambda c: F.floor(c * F.lit(block * size_out) / F.lit(size_in))
    last = F.lit(-(-size_in // block) - 1)
    guess = F.least(F.floor((i + 1) * F.lit(size_in) / F.lit(size_out * block)) + 1, last)
    c = F.when(begin(guess) <= i, guess).when(begin(guess - 1) <= i, guess - 1).otherwise(guess - 2)
    first = c * block
    cells = F.least(first + block, F.lit(size_in)) - first
    end = F.least(F.ceil((first + cells) * F.lit(size_out) / F.lit(size_in)), F.lit(size_out))
    at = F.greatest((i - begin(c) + 0.5) * cells / (end - begin(c)) - 0.5, F.lit(0.0))
    low = F.floor(at)
    return F.struct((first + F.least(low, cells - 1)).cast("int").alias("lo"), (first + F.least(low + 1, cells - 1)).cast("int").alias("hi"), (at - low).alias("w"))


def blockwise(df: DataFrame, shape: tuple[int, int, int], target: tuple[int, int, int], block: tuple[int, int, int]) -> DataFrame:
    """The volume on another grid, each block of it interpolated by itself, so that seams show at the blocks' edges."""
    return trilinear(df, shape, target, lambda axis, i, t, n: _corner_in_block(i, t, n, block[axis]))


def exported(channels: DataFrame, shape: tuple[int, int, int], target: tuple[int, int, int]) -> DataFrame:
    """(tp, c, z, y, x, u8): every channel on another grid, scaled to bytes by its own least and greatest value. channels: tp, c, z, y, x, v."""
    each = channels.select(F.struct("tp", "c").alias("tp"), "z", "y", "x", "v")
    large = trilinear(each, shape, target)
    ends = large.groupBy("tp").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    unit = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-6)
    return large.join(ends, "tp").select("tp.tp", "tp.c", "z", "y", "x", N.quantize_u8(unit).alias("u8"))


def otsu(df: DataFrame, keys: list[str], value: str = "v", bins: int = 256) -> DataFrame:
    """(keys, threshold): the centre of the bin that parts a group's values with the greatest variance between both sides.

    The first such bin if several do; the value itself if a group has only
    one.  Only a histogram of at most ``bins`` rows a group is ordered.
    """
    ends = df.groupBy(*keys).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / F.when(width != 0, width) * bins), F.lit(bins - 1))).cast("int")
    counts = df.join(ends, keys).groupBy(*keys, "_lo", "_hi", at.alias("_b")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_c", F.col("_lo") + (F.col("_b") + 0.5) * width / bins)
    whole = Window.partitionBy(*keys)
    below = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("_n") * F.col("_c")
    told = counts.select(*keys, "_lo", "_b", "_c", F.sum("_n").over(below).alias("_w1"), F.sum(mass).over(below).alias("_s1"), F.sum("_n").over(whole).alias("_w"), F.sum(mass).over(whole).alias("_s"))
    w2 = F.when(F.col("_w") > F.col("_w1"), F.col("_w") - F.col("_w1"))
    between = F.col("_w1") * w2 * F.pow(F.col("_s1") / F.col("_w1") - (F.col("_s") - F.col("_s1")) / w2, F.lit(2.0))
    best = F.max(F.when(w2.isNotNull(), F.struct(between.alias("v"), (-F.col("_b")).alias("b"), F.col("_c").alias("c"))))
    return told.groupBy(*keys).agg(F.coalesce(best["c"], F.min("_lo")).alias("threshold"))


def soft_cuts(df: DataFrame, radius: int = 5, spatial_sigma: float = 4.0, intensity_sigma: float = 10.0) -> DataFrame:
    """(tp, loss): the number of classes less the sum of each class's share of its ties that stay inside it. df: also probs, an array of the classes' probabilities.

    A tie between two voxels weighs less with their distance (up to
    ``radius`` on each axis) and with how far the second one's value is from
    the class's mean.  The spatial weight is a product over the axes, so three
    passes along lines put it together.
    """
    each = df.select(*_AT, F.col("v").cast("double").alias("v"), F.size("probs").alias("classes"), F.posexplode("probs").alias("k", "p"))
    mean = each.groupBy("tp", "k").agg((F.avg(F.col("v") * F.col("p")) / (F.avg("p") + 1e-5)).alias("m"))
    near = F.exp(-F.pow(F.col("v") - F.col("m"), F.lit(4.0)) / intensity_sigma**2)
    told = each.join(mean, ["tp", "k"]).select(*_AT, "k", "classes", F.col("p").cast("double").alias("p"), near.alias("w"))
    taps = F.array(*(F.struct(F.lit(k).alias("o"), F.lit(math.exp(-0.5 * (k / spatial_sigma) ** 2)).alias("g")) for k in range(-radius, radius + 1)))
    sums = told.select(*_AT, "k", (F.col("p") * F.col("w")).alias("inside"), F.col("w").alias("all"))
    for a in "zyx":
        spread = sums.withColumn("t", F.explode(taps)).withColumn(a, F.col(a) + F.col("t.o"))
        sums = spread.groupBy(*_AT, "k").agg(F.sum(F.col("inside") * F.col("t.g")).alias("inside"), F.sum(F.col("all") * F.col("t.g")).alias("all"))
    share = told.join(sums, [*_AT, "k"]).groupBy("tp", "k", "classes").agg((F.sum(F.col("p") * F.col("inside")) / (F.sum(F.col("p") * F.col("all")) + 1e-6)).alias("s"))
    return share.groupBy("tp").agg((F.max("classes") - F.sum(F.abs("s"))).alias("loss"))
