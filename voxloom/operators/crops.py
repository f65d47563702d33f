"""Boxes around centres, what they cut out, and regions grown from seeds. Voxels: tp, z, y, x, v."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from .components import connected_components
from .resample import otsu

_AROUND = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]


def _share(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) by a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts))), 1, 12), 16, 10).cast("double") / float(16**12)


def boxes_around(centres: DataFrame, shape: tuple[int, int, int], low: float, high: float, seed: str = "box") -> DataFrame:
    """(tp, box, z0, z1, y0, y1, x0, x1): a half-open box around each centre (tp, box, z, y, x), cut at the volume's ends.

    A sampling operator: each side is a share of the volume's side between
    ``low`` and ``high`` by a hash of volume, box and axis.
    """
    out = ["tp", "box"]
    for axis, size in zip("zyx", shape):
        half = (F.lit(low) + (high - low) * _share(seed, F.col("tp"), F.col("box"), F.lit(axis))) * (size / 2)
        out.append(F.greatest(F.col(axis) - half, F.lit(0.0)).cast("int").alias(f"{axis}0"))
        out.append(F.least(F.col(axis) + half, F.lit(float(size))).cast("int").alias(f"{axis}1"))
    return centres.select(*out)


def cropped(voxels: DataFrame, boxes: DataFrame) -> DataFrame:
    """(tp, box, z, y, x, v): what each box holds, places counted from its corner; boxes may overlap.

    A volume's boxes travel as one array, so the join is by volume and a voxel
    is copied only into the boxes that hold it.
    """
    listed = boxes.groupBy("tp").agg(F.collect_list(F.struct("box", "z0", "z1", "y0", "y1", "x0", "x1")).alias("_boxes"))
    inside = lambda b: (F.col("z") >= b["z0"]) & (F.col("z") < b["z1"]) & (F.col("y") >= b["y0"]) & (F.col("y") < b["y1"]) & (F.col("x") >= b["x0"]) & (F.col("x") < b["x1"])
    held = voxels.join(listed, "tp").withColumn("_b", F.explode(F.filter("_boxes", inside)))
    return held.select("tp", F.col("_b.box").alias("box"), *((F.col(a) - F.col(f"_b.{a}0")).alias(a) for a in "zyx"), "v")


def _neighbours(voxels: DataFrame, *more: str) -> DataFrame:
    """A row for each of the 26 places around a voxel, with the voxel's other columns."""
    shifts = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in _AROUND))
    return voxels.withColumn("_o", F.explode(shifts)).select("tp", *((F.col(k) + F.col(f"_o.{o}")).alias(k) for k, o in zip("zyx", "abc")), *more)


def maxima(voxels: DataFrame) -> DataFrame:
    """The voxels above none of whose 26 neighbours is a greater one; all of a plateau count."""
    above = _neighbours(voxels, "v").groupBy("tp", "z", "y", "x").agg(F.max("v").alias("_top"))
    return voxels.join(above, ["tp", "z", "y", "x"], "left").filter(F.col("_top").isNull() | (F.col("v") >= F.col("_top"))).drop("_top")


def grown(mask: DataFrame, seeds: DataFrame) -> DataFrame:
    """(tp, z, y, x, label): labels of the seeds grown through the mask by one voxel a round, the least label where several meet.

    Only the rim of a round looks for neighbours.  Rounds are as many as the
    longest way from a seed, each one cut; what no seed reaches has no label.
    """
    at = ["tp", "z", "y", "x"]
    free = cut(mask.select(*at).join(seeds.select(*at), at, "left_anti"))
    rim = cut(seeds.select(*at, "label").join(mask.select(*at), at, "left_semi"))
    done = [rim]
    while rim.limit(1).count():
        near = _neighbours(rim, "label").groupBy(*at).agg(F.min("label").alias("label"))
        rim = cut(free.join(near, at))
        free = cut(free.join(rim.select(*at), at, "left_anti"))
        done.append(rim)
        if len(done) > 32:  # keeps the plan short
            done = [cut(reduce(DataFrame.unionByName, done))]
    return reduce(DataFrame.unionByName, done)


def voronoi_otsu(spots: DataFrame, outline: DataFrame, height: int, width: int) -> DataFrame:
    """Regions of the outline above its Otsu threshold, one for each maximum of the spots inside.

    ``spots`` and ``outline`` are the volume blurred by two widths.  Touching
    voxels of one plateau are one seed; seeds are numbered in raster order.
    """
    at = ["tp", "z", "y", "x"]
    mask = cut(outline.join(otsu(outline, ["tp"]).select("tp", "threshold"), "tp").filter("v > threshold").select(*at))
    tops = maxima(spots).select(*at).join(mask, at, "left_semi")
    return grown(mask, connected_components(tops, height, width))


def _line_best(tables: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """For each line of seeds (place, squared distance so far, label): every place's nearest one, the least label of equals."""
    places = np.arange(size)
    for t in tables:
        near, labels = [], []
        for line in t["line"]:
            at, far, label = (np.array([s[k] for s in line]) for k in ("at", "far", "label"))
            known = far[:, None] + (at[:, None] - places[None, :]) ** 2
            least = known.min(axis=0)
            near.append(least.tolist())
            labels.append(np.where(known == least, label[:, None], label.max()).min(axis=0).tolist())
        yield t.drop(columns="line").assign(far=near, label=labels)


def nearest_seed(cells: DataFrame, seeds: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """``cells`` (tp, z, y, x) with the ``label`` of the nearest seed of their time point and the squared distance ``far`` to it; the least label of equally near ones.

    seeds: tp, z, y, x, label; seeds outside the shape are left out.  One pass
    an axis: along x every place of a line with seeds learns its nearest seed
    on that line, along y and z lines of such answers are met in the same way,
    which is exact as squared distances add up over axes.  Three passes
    whatever the distances; a task holds lines, never a plane or volume.  Time
    points without seeds give no rows.
    """
    inside = [F.col(a).between(0, n - 1) for a, n in zip("zyx", shape)]
    left = seeds.filter(inside[0] & inside[1] & inside[2]).select("tp", "z", "y", "x", F.lit(0).cast("long").alias("far"), F.col("label").cast("long").alias("label"))
    kind = seeds.schema["tp"].dataType.simpleString()
    for axis, size in (("x", shape[2]), ("y", shape[1]), ("z", shape[0])):
        others = [a for a in "zyx" if a != axis]
        lines = left.groupBy("tp", *others).agg(F.collect_list(F.struct(F.col(axis).alias("at"), "far", "label")).alias("line"))  # a side of the volume at most
        best = lines.mapInPandas(lambda tables, n=size: _line_best(tables, n), f"tp {kind}, {others[0]} int, {others[1]} int, far array<long>, label array<long>")
        left = best.select("tp", *others, F.posexplode(F.arrays_zip("far", "label")).alias(axis, "_s")).select("tp", "z", "y", "x", "_s.far", "_s.label")
    return cells.select("tp", "z", "y", "x").join(left, ["tp", "z", "y", "x"])
