"""Densities of foreground and background values and the votes that follow from them. Samples: c, cls, v."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_range(samples: DataFrame) -> DataFrame:
    """Least and greatest value of each channel over both classes; an empty range is one wide."""
    r = samples.groupBy("c").agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))
    return r.select("c", "lo", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")).alias("hi"))


def smoothed_histogram(samples: DataFrame, points: int = 256, sigma: float = 1.0) -> DataFrame:
    """(c, cls, i, x, f): counts on a grid over the joint range, smoothed by a Gaussian (zeros outside) and divided by n and cell width."""
    sigma = max(sigma, 0.5)
    half = max(1, round(3 * sigma))
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    taps = F.array(*(F.struct(F.lit(k).alias("o"), F.lit(w / sum(raw)).alias("w")) for k, w in zip(range(-half, half + 1), raw)))
    told = samples.join(value_range(samples), "c")
    at = F.least(F.greatest(((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-20) * (points - 1)).cast("int"), F.lit(0)), F.lit(points - 1))
    counts = told.groupBy("c", "cls", "lo", "hi", at.alias("i")).agg(F.count(F.lit(1)).alias("n"))
    total = samples.groupBy("c", "cls").agg(F.count(F.lit(1)).alias("all"))
    spread = counts.select("c", "cls", "lo", "hi", "n", "i", F.explode(taps).alias("t")).select("c", "cls", "lo", "hi", (F.col("i") + F.col("t.o")).alias("i"), (F.col("n") * F.col("t.w")).alias("m")).filter(F.col("i").between(0, points - 1))
    dense = spread.groupBy("c", "cls", "lo", "hi", "i").agg(F.sum("m").alias("m")).join(total, ["c", "cls"])
    width = (F.col("hi") - F.col("lo")) / points
    return dense.select("c", "cls", "i", (F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1)).alias("x"), (F.col("m") / (F.col("all") * width)).alias("f"))


def kde(samples: DataFrame, points: int = 64) -> DataFrame:
    """(c, cls, i, x, f): Gaussian kernel density on a grid over the joint range with Silverman's bandwidth.

    The spread is the lesser of standard deviation and scaled quartile range;
    a sample of equal values has 1.  Infinities and NaN count nowhere.  Equal
    values are counted first, so the work is points times distinct values.
    """
    v = F.col("v").cast("double")
    samples = samples.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    b = samples.groupBy("c", "cls").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("v").alias("sd"), (F.percentile("v", 0.75) - F.percentile("v", 0.25)).alias("iqr"))
    spread = F.when(F.col("sd") > 0, F.least("sd", F.col("iqr") / 1.349)).when(F.col("iqr") > 0, F.col("iqr") / 1.349).otherwise(1.0)
    width = F.when(F.col("n") < 2, 0.2).otherwise(1.06 * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    b = b.select("c", "cls", "n", F.greatest(width, F.lit(1e-6)).alias("h"))
    distinct = samples.groupBy("c", "cls", F.col("v").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    grid = distinct.join(b, ["c", "cls"]).join(value_range(samples), "c").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1))
    u = (F.col("x") - F.col("v")) / F.col("h")
    return grid.groupBy("c", "cls", "i", "x").agg((F.sum(F.col("k") * F.exp(-0.5 * u * u)) / F.max(F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("f"))


def lookup(density: DataFrame, values: DataFrame) -> DataFrame:
    """The density at each value (c, v) by linear interpolation between grid points; zero outside the grid.

    Grid points become intervals by a window; the interval follows from the
    value by arithmetic, so the join is an equi-join.
    """
    own = Window.partitionBy("c", "cls")
    grid = density.withColumn("x0", F.min("x").over(own)).withColumn("i0", F.min("i").over(own)).withColumn("x9", F.max("x").over(own)).withColumn("nx", F.lead("x").over(own.orderBy("i"))).withColumn("nf", F.lead("f").over(own.orderBy("i")))
    spans = grid.filter("nx IS NOT NULL").select("c", "cls", "i", "x", "f", "nx", "nf")
    ends = grid.groupBy("c", "cls").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("i").alias("i0"), F.max("i").alias("i9"))
    asked = values.join(ends, "c").withColumn("i", F.least(F.greatest(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (F.col("i9") - F.col("i0"))) + F.col("i0"), F.col("i0")), F.col("i9") - 1).cast("int"))
    told = asked.join(spans, ["c", "cls", "i"], "left")
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    value = F.col("f") + (F.col("nf") - F.col("f")) * (F.col("v") - F.col("x")) / (F.col("nx") - F.col("x"))
    return told.select(*values.columns, "cls", F.when(inside, F.coalesce(value, F.lit(0.0))).otherwise(0.0).alias("p"))


def votes(looked_up: DataFrame, keys: list[str], background: float = 0.4, foreground: float = 0.95) -> DataFrame:
    """Whether a voxel is foreground: more channels say so (probability above ``foreground``) than say background (above ``background``)."""
    both = looked_up.groupBy(*keys, "c").agg(F.sum(F.when(F.col("cls") == "bg", F.col("p")).otherwise(0.0)).alias("b"), F.sum(F.when(F.col("cls") == "fg", F.col("p")).otherwise(0.0)).alias("f"))
    total = F.col("b") + F.col("f")
    p = both.select(*keys, F.when(total > 0, F.col("b") / F.when(total > 0, total)).otherwise(0.5).alias("b"), F.when(total > 0, F.col("f") / F.when(total > 0, total)).otherwise(0.5).alias("f"))
    return p.groupBy(*keys).agg(F.count_if(F.col("b") > background).alias("bg"), F.count_if(F.col("f") > foreground).alias("fg")).withColumn("is_fg", F.col("fg") > F.col("bg"))


def stratified_sample(rows: DataFrame, strata: list[str], most: int, slices: str, key: str, seed: str = "1337") -> DataFrame:
    """At most ``most`` rows of each stratum, spread evenly over its slices, chosen by a hash of ``key``.

    A sampling operator: ``most`` is its purpose.
    """
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    n = rows.groupBy(*strata).agg(F.countDistinct(slices).alias("_slices"))
    ranked = rows.join(n, strata).withColumn("_o", order)
    within = F.row_number().over(Window.partitionBy(*strata, slices).orderBy("_o", key))
    kept = ranked.withColumn("_r", within).filter(F.col("_r") <= F.ceil(F.lit(most) / F.col("_slices")))
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy("_o", key))).filter(F.col("_r") <= most).drop("_slices", "_o", "_r")
