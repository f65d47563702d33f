"""More of what is done to volumes and tokens: channels, masks, neighbourhoods, attention, spectra. Voxels: keys, z, y, x, v."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attention channels at the end of a feature vector.
ATTENTION_CHANNELS = 6


def channel_sum(features: Column) -> Column:
    """The sum over a vector's channels, those of attention left out if there are others."""
    n = F.size(features)
    kept = F.when(n > ATTENTION_CHANNELS, F.slice(features, F.lit(1), n - ATTENTION_CHANNELS)).otherwise(features)
    return F.aggregate(kept, F.lit(0.0), lambda s, x: s + x.cast("double"))


def with_attention(features: Column, attention: Column) -> Column:
    return F.concat(features, attention)


def repeated_channel(value: Column, times: int) -> Column:
    return F.array_repeat(value, times)


def backgrounds(voxels: DataFrame, keys: list[str], threshold: float = 10.0) -> DataFrame:
    """(keys, total, is_background): whether an image's sum is below the threshold."""
    return voxels.groupBy(*keys).agg(F.sum(F.col("v").cast("double")).alias("total")).withColumn("is_background", F.col("total") < threshold)


def slice_indices(mask: DataFrame, keys: list[str], height: int, width: int, chunk: int = 4) -> DataFrame:
    """(keys, z, chunk, is_fg, indices): flat places of foreground and background in each slice; a slice bounds the array."""
    flat = F.col("y") * width + F.col("x")
    return mask.groupBy(*keys, "z", F.floor(F.col("z") / chunk).cast("int").alias("chunk"), (F.col("label") != 0).alias("is_fg")).agg(F.array_sort(F.collect_list(flat)).alias("indices"))


def flat_mask(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    """The voxels at which a mask of (y, x) holds, in every slice."""
    return voxels.join(mask.select("y", "x").distinct(), ["y", "x"], "left_semi")


def kept_slices(voxels: DataFrame, slices: DataFrame, keys: list[str]) -> DataFrame:
    """The voxels of the given slices (keys, z), numbered anew from 0."""
    listed = slices.select(*keys, "z").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("z")).alias("_z"))
    return voxels.join(listed, keys).withColumn("_at", F.array_position("_z", F.col("z")).cast("int") - 1).filter("_at >= 0").select(*keys, F.col("_at").alias("z"), "y", "x", "v")


def feature_crop(pad: Column, scale: float) -> list[Column]:
    """What to cut before and after in feature space for a padding of the volume."""
    cells = F.floor(pad / F.lit(float(scale))).cast("int")
    before = F.floor(cells / 2).cast("int")
    return [before, cells - before]


def greatest_divisor(a: Column, b: Column) -> Column:
    """The greatest common divisor by Euclid's rule; 93 steps do for 64 bits."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(93)),
        F.struct(F.abs(a.cast("long")).alias("a"), F.abs(b.cast("long")).alias("b")),
        lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))),
    )
    return step["a"]


def least_multiple(a: Column, b: Column) -> Column:
    d = greatest_divisor(a, b)
    return F.when(d == 0, F.lit(0).cast("long")).otherwise(F.abs(a.cast("long")) * (F.abs(b.cast("long")) / F.when(d != 0, d)).cast("long"))


def due(step: Column, interval: int, last: Column) -> Column:
    """Whether something is done at a step: every ``interval`` steps and at the last."""
    return (step % interval == 0) | (step == last)


def batch_rows(budget: int, channels: Column, least: int = 4096) -> Column:
    """Rows of float vectors that fit into a budget, but some at least."""
    return F.greatest(F.lit(least), F.floor(F.lit(budget) / (4 * F.greatest(channels.cast("long"), F.lit(1))))).cast("long")


def batch_channels(budget: int, channels: Column, voxels: Column, copies: int = 1) -> Column:
    """Channels of float volumes that fit into a budget, one at least and all at most."""
    return F.greatest(F.lit(1), F.least(channels, F.floor(F.lit(budget) / F.greatest(4 * copies * voxels.cast("long"), F.lit(1))))).cast("long")


def normalised(voxels: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """Clip to [low, high], scale to [0, 1], then by each volume's own least and greatest."""
    unit = voxels.withColumn("v", (F.greatest(F.lit(float(low)), F.least(F.col("v"), F.lit(float(high)))) - low) / (high - low + 1e-6))
    ends = unit.groupBy(*keys).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    return unit.join(ends, keys).withColumn("v", (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-6)).drop("_lo", "_hi")


def neighbourhoods(voxels: DataFrame, keys: list[str], reach: int = 1) -> DataFrame:
    """(keys, z, y, x, n, total): voxels around each one within ``reach`` on every axis, itself included; partial sums travel, not neighbourhoods."""
    steps = F.array(*(F.lit(k) for k in range(-reach, reach + 1)))
    out = voxels
    for axis in "zyx":  # a box is three lines, one after the other
        out = out.withColumn("_d", F.explode(steps)).withColumn(axis, F.col(axis) + F.col("_d"))
        value, n = (F.col("v").cast("double"), F.lit(1)) if axis == "z" else (F.col("total"), F.col("n"))
        out = out.groupBy(*keys, "z", "y", "x").agg(F.sum(n).cast("long").alias("n"), F.sum(value).alias("total"))
    return out.join(voxels.select(*keys, "z", "y", "x"), [*keys, "z", "y", "x"], "left_semi")


def attention(scores: DataFrame, keys: list[str], block: str) -> DataFrame:
    """(keys, o): values weighted by the softmax of scores, put together from blocks. scores: keys, block, s, v.

    A block is reduced to its greatest score, the sum of exponentials below it
    and the weighted sum; these three merge in any order.
    """
    top = scores.groupBy(*keys, block).agg(F.max("s").alias("m"))
    part = scores.join(top, [*keys, block]).groupBy(*keys, block, "m").agg(F.sum(F.exp(F.col("s") - F.col("m"))).alias("l"), F.sum(F.exp(F.col("s") - F.col("m")) * F.col("v")).alias("o"))
    best = part.groupBy(*keys).agg(F.max("m").alias("_m"))
    scaled = part.join(best, keys).withColumn("_f", F.exp(F.col("m") - F.col("_m")))
    return scaled.groupBy(*keys).agg((F.sum(F.col("o") * F.col("_f")) / F.sum(F.col("l") * F.col("_f"))).alias("o"))


def any_true(rows: DataFrame, keys: list[str], flag: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.bool_or(F.col(flag)).alias("any"))


def random_masks(samples: DataFrame, key: str, patches: int, low: float, high: float, seed: str = "mask") -> DataFrame:
    """(key, ratio, patch, weight): masked patches of each sample, chosen by a hash, with weights that sum to one.

    A sampling operator.  The ratios of masked patches run evenly from ``low``
    to ``high`` by a hash of the key.
    """
    u = lambda *c: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *c)), 1, 12), 16, 10).cast("double") / float(16**12)
    told = samples.select(key, (F.lit(low) + (high - low) * u(F.col(key).cast("string"))).alias("ratio"))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(patches - 1)), lambda p: F.struct(u(F.col(key).cast("string"), p.cast("string")).alias("u"), p.alias("p"))))
    n = F.floor(F.col("ratio") * patches).cast("int")
    taken = F.slice(order, F.lit(1), n)
    return told.filter(n > 0).select(key, "ratio", F.explode(taken).alias("t"), (1.0 / n).alias("weight")).select(key, "ratio", F.col("t.p").alias("patch"), "weight")


def spectrum_gap(pairs: DataFrame, keys: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """(keys, gap): mean absolute difference of the Fourier magnitudes of two volumes. pairs: keys, z, y, x, a, b; a volume is one group, as its transform needs all of it."""

    def gap(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        both = np.zeros((2, *shape))
        both[:, rows.z, rows.y, rows.x] = rows.a, rows.b
        a, b = np.abs(np.fft.rfftn(both, axes=(1, 2, 3), norm="ortho"))
        return pd.DataFrame([[*key, float(np.abs(a - b).mean())]], columns=[*keys, "gap"])

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    return pairs.groupBy(*keys).applyInPandas(gap, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "gap double"]))


def chained(frames: Iterator[DataFrame], *steps) -> Iterator[DataFrame]:
    """Every table through the steps (DataFrame to DataFrame), in order: plan by plan, nothing is computed."""
    for frame in frames:
        for step in steps:
            frame = frame.transform(step)
        yield frame
