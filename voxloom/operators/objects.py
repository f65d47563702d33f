"""Measurements of labelled objects. Voxels: tp, z, y, x and a value; masks: tp, z, y, x, label (0 is background)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VOXEL = ["tp", "z", "y", "x"]


def geometry(mask: DataFrame) -> DataFrame:
    """Per object: voxels, centroid, bounding box (upper ends exclusive). Background goes before any shuffle."""
    bounds = [e for a in "zyx" for e in (F.min(a).cast("int").alias(f"{a}0"), (F.max(a) + 1).cast("int").alias(f"{a}1"))]
    return mask.filter("label <> 0").groupBy("tp", "label").agg(F.count(F.lit(1)).alias("volume"), *(F.avg(a).alias(f"c{a}") for a in "zyx"), *bounds)


def labelled(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    """Voxels with the label at the same place."""
    return voxels.join(mask.select(*VOXEL, "label"), VOXEL)


def mean_intensity(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    objects = labelled(voxels, mask.filter("label <> 0"))
    return objects.groupBy("tp", "label").agg(F.count(F.lit(1)).alias("volume"), F.sum("v").alias("total"), F.avg("v").cast("float").alias("amplitude"))


def weighted_centroid(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    objects = labelled(voxels, mask.filter("label <> 0"))
    return objects.groupBy("tp", "label").agg(*((F.sum(F.col(a) * F.col("v")) / (F.sum("v") + F.lit(1e-6))).alias(f"w{a}") for a in "zyx"))


def feature_mean(features: DataFrame, keys: list[str], vector: str = "feat") -> DataFrame:
    """The mean vector of each group: one row per channel is summed on the map side."""
    flat = features.select(*keys, F.posexplode(vector).alias("c", "f"))
    return flat.groupBy(*keys, "c").agg(F.avg(F.col("f").cast("double")).alias("mean"))


def particle_medians(voxels: DataFrame, mask: DataFrame, most: int = 4000) -> DataFrame:
    """Upper median, sum and mean of each object's first ``most`` voxels in raster order."""
    first = Window.partitionBy("tp", "label").orderBy("z", "y", "x")
    objects = labelled(voxels, mask.filter("label <> 0")).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most)
    return objects.groupBy("tp", "label").agg(F.sort_array(F.collect_list("v")).alias("_v"), F.sum("v").alias("total"), F.avg("v").alias("mean")).select(
        "tp", "label", F.get("_v", F.floor(F.size("_v") / 2).cast("int")).alias("median"), "total", "mean"
    )


def shell(radius: int, inner: int) -> list[tuple[int, int, int]]:
    """Offsets farther than ``inner`` and at most ``radius`` away."""
    span = range(-radius, radius + 1)
    return [(a, b, c) for a in span for b in span for c in span if inner * inner < a * a + b * b + c * c <= radius * radius]


def local_background(voxels: DataFrame, mask: DataFrame, radius: int = 4, inner: int = 2) -> DataFrame:
    """Objects with the mean of the background around them taken off.

    Every voxel of an object looks at the offsets of a shell; background voxels
    seen from several voxels count as often.  The offsets are an array column,
    so the only join is the equi-join of shifted places with background voxels.
    """
    every = labelled(voxels, mask)
    offsets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in shell(radius, inner)))
    seen = every.filter("label <> 0").select("tp", "label", "z", "y", "x", F.explode(offsets).alias("o"))
    seen = seen.select("tp", "label", (F.col("z") + F.col("o.a")).alias("z"), (F.col("y") + F.col("o.b")).alias("y"), (F.col("x") + F.col("o.c")).alias("x"))
    seen = seen.groupBy("tp", "label", "z", "y", "x").agg(F.count(F.lit(1)).alias("times"))
    around = seen.join(every.filter("label = 0").select(*VOXEL, "v"), VOXEL).groupBy("tp", "label").agg((F.sum(F.col("v") * F.col("times")) / F.sum("times")).alias("background"))
    return (
        mean_intensity(voxels, mask)
        .join(around, ["tp", "label"], "left")
        .select("tp", "label", "volume", F.coalesce("background", F.lit(0.0)).alias("background"), (F.col("total") / F.col("volume") - F.coalesce("background", F.lit(0.0))).alias("corrected_mean"), (F.col("total") - F.coalesce("background", F.lit(0.0)) * F.col("volume")).alias("corrected_total"))
    )


#: Places of the raster order that a block of slices and voxels shares.
BLOCK = 4096


def raster_places(voxels: DataFrame) -> DataFrame:
    """``voxels`` with ``n``: the place (from 0) in raster order among those of their time point.

    Counts of lines are added up within slices and those of slices within time
    points, so no window is longer than one side of a volume.
    """
    lines = voxels.groupBy("tp", "z", "y").agg(F.count(F.lit(1)).alias("_line"))
    slices = lines.groupBy("tp", "z").agg(F.sum("_line").alias("_slice"))
    upto = lambda size, keys, order: F.sum(size).over(Window.partitionBy(*keys).orderBy(order)) - F.col(size)
    slices = slices.select("tp", "z", upto("_slice", ["tp"], "z").alias("_above"))
    lines = lines.select("tp", "z", "y", upto("_line", ["tp", "z"], "y").alias("_before")).join(slices, ["tp", "z"])
    in_line = F.row_number().over(Window.partitionBy("tp", "z", "y").orderBy("x")) - 1
    return voxels.withColumn("_in", in_line).join(lines, ["tp", "z", "y"]).withColumn("n", F.col("_above") + F.col("_before") + F.col("_in")).drop("_above", "_before", "_in")


def _slices(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where each object's slice begins; null for one that no longer fits, after which smaller ones still may."""
    for t in tables:
        for tp, total, sizes in zip(t["tp"], t["total"], t["sizes"]):
            start, rows = 0, []
            for s in sizes:
                fits = start + s["volume"] <= total
                rows.append((tp, s["label"], s["volume"], total, start if fits else None))
                start += s["volume"] * fits
            yield pd.DataFrame(rows, columns=["tp", "label", "volume", "total", "begin"]).astype({"begin": "Int64"})


def matched_background(voxels: DataFrame, mask: DataFrame, seed: str = "background") -> DataFrame:
    """Per object (tp, label) as many background voxels as it has itself: ``drawn``, whether they were ``redrawn``, and their mean ``background``.

    Objects take disjoint slices of the background in raster order, one after
    the other by label.  One that finds fewer voxels left draws from the whole
    background with replacement, by a hash of time point, label and count; it
    takes nothing away from later ones.  Without background nothing is drawn
    and the mean is null.  Slices meet voxels by blocks of ``BLOCK`` places;
    only the sizes of a volume's objects are gathered, never its voxels.
    """
    background = raster_places(labelled(voxels, mask.filter("label = 0"))).select("tp", "n", "v")
    totals = background.groupBy("tp").agg(F.count(F.lit(1)).alias("total"))
    sizes = mask.filter("label <> 0").groupBy("tp", "label").agg(F.count(F.lit(1)).alias("volume"))
    listed = sizes.groupBy("tp").agg(F.array_sort(F.collect_list(F.struct(F.col("label").cast("long").alias("label"), "volume"))).alias("sizes"))
    told = listed.join(totals, "tp", "left").select("tp", F.coalesce("total", F.lit(0)).alias("total"), "sizes")
    kind = mask.schema["tp"].dataType.simpleString()
    slices = told.mapInPandas(_slices, f"tp {kind}, label long, volume long, total long, begin long")
    block = lambda n: F.floor(n / BLOCK)
    fitting = slices.filter("begin is not null").withColumn("b", F.explode(F.sequence(block(F.col("begin")), block(F.col("begin") + F.col("volume") - 1))))
    taken = fitting.join(background.withColumn("b", block(F.col("n"))), ["tp", "b"]).filter("n >= begin and n < begin + volume").select("tp", "label", "v")
    again = slices.filter("begin is null and total > 0").withColumn("j", F.explode(F.expr("sequence(0, volume - 1)")))
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("tp").cast("string"), F.col("label").cast("string"), F.col("j").cast("string"))), 1, 12), 16, 10).cast("long") % F.col("total")
    drawn = again.withColumn("n", place).join(background, ["tp", "n"]).select("tp", "label", "v")
    means = taken.unionByName(drawn).groupBy("tp", "label").agg(F.count("v").alias("drawn"), F.avg("v").alias("background"))
    return slices.join(means, ["tp", "label"], "left").select("tp", "label", F.coalesce("drawn", F.lit(0)).alias("drawn"), (F.col("begin").isNull() & (F.col("total") > 0)).alias("redrawn"), "background")
