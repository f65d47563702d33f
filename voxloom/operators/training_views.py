"""Views of volumes for training: boxes of random sides or around clusters, interpolated to one size, turned, stretched and with noise.

Voxels: tp, z, y, x, v.  Boxes: tp, box, half-open sides z0, z1, ... and the
size rz, ry, rx that they are brought to.  Random numbers are hashes of a
seed, the volume, the box and what they are for, so they depend neither on
partitions nor on order.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from .crops import boxes_around
from .grid import median_filter_2d, pad_or_crop
from .scaling import percentile_band

Shape = tuple[int, int, int]
#: Parts into which a volume's candidates are dealt before the least hashes of all are taken.
PARTS = 64


def drawn(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) by a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts))), 1, 12), 16, 10).cast("double") / float(16**12)


def resized_boxes(views: DataFrame, shape: Shape, size: Shape, scale: tuple[float, float] = (0.08, 1.0), ratio: tuple[float, float] = (0.75, 4 / 3), attempts: int = 10, seed: str = "crop") -> DataFrame:
    """Boxes for ``views`` (tp, box): a random part of the volume with sides near the ratios of ``size``.

    The part is even between the bounds of ``scale``, the two ratios of sides
    even in their logarithm.  The first of ``attempts`` whose sides fit is
    taken, at an even place; if none fits, the middle box of the size's ratios.
    """
    if not 0 < scale[0] <= scale[1] or not 0 < ratio[0] <= ratio[1]:
        raise ValueError("bounds must be positive and rising")
    u = lambda *c: drawn(seed, F.col("tp"), F.col("box"), *c)
    room = math.prod(shape) * (scale[0] + (scale[1] - scale[0]) * u(F.lit("part")))
    low, wide = math.log(ratio[0]), math.log(ratio[1]) - math.log(ratio[0])

    def attempt(k: Column) -> Column:
        high, broad = (size[i] / size[0] * F.exp(low + wide * u(k, F.lit(name))) for i, name in ((1, "y"), (2, "x")))
        deep = F.round(F.pow(room / (high * broad), F.lit(1 / 3)))
        return F.struct(deep.cast("int").alias("z"), F.round(deep * high).cast("int").alias("y"), F.round(deep * broad).cast("int").alias("x"), k.alias("k"))

    fits = lambda s: (s["z"] > 0) & (s["y"] > 0) & (s["x"] > 0) & (s["z"] <= shape[0]) & (s["y"] <= shape[1]) & (s["x"] <= shape[2])
    factor = min(n / s for n, s in zip(shape, size))
    middle = [min(n, int(s * factor)) for n, s in zip(shape, size)]
    told = views.select("tp", "box", F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), attempt), fits), F.lit(0)).alias("s"))
    out = []
    for i, a in enumerate("zyx"):
        side = F.coalesce(F.col(f"s.{a}"), F.lit(middle[i]))
        begin = F.when(F.col("s").isNotNull(), F.floor(u(F.lit("at"), F.lit(a)) * (shape[i] - side + 1))).otherwise((shape[i] - middle[i]) // 2).cast("int")
        out += [begin.alias(f"{a}0"), (begin + side).alias(f"{a}1"), F.lit(size[i]).alias(f"r{a}")]
    return told.select("tp", "box", *out)


def resized(voxels: DataFrame, boxes: DataFrame, side: int = 16) -> DataFrame:
    """(tp, box, z, y, x, v, rz, ry, rx): every box interpolated to its size, dense; missing voxels are zero.

    Trilinear with half-pixel centres and the box's edges repeated.  A box is
    named to the blocks of the grid that it meets, voxels find it by one
    equi-join on blocks, and each gives its share to the places that it is a
    corner of; shares are summed before they travel.
    """
    met, held = boxes, voxels.select("tp", "z", "y", "x", F.col("v").cast("double").alias("v"))
    for a in "zyx":
        met = met.withColumn(f"b{a}", F.explode(F.sequence(F.floor(F.col(f"{a}0") / side), F.floor((F.col(f"{a}1") - 1) / side))))
        held = held.withColumn(f"b{a}", F.floor(F.col(a) / side))
    held = held.join(met, ["tp", "bz", "by", "bx"])
    weight = F.col("v")
    for a in "zyx":
        held = held.filter((F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}1")))
        n, at, size = F.col(f"{a}1") - F.col(f"{a}0"), F.col(a) - F.col(f"{a}0"), F.col(f"r{a}")
        step = n / size
        first = F.when(at == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil((at - 0.5) / step - 0.5))).cast("int")
        last = F.when(at == n - 1, size - 1).otherwise(F.least(size - 1, F.floor((at + 1.5) / step - 0.5))).cast("int")
        held = held.withColumn(f"o{a}", F.explode(F.when(first <= last, F.sequence(first, F.greatest(first, last)))))
        from_ = F.greatest(F.lit(0.0), F.least(n - 1, (F.col(f"o{a}") + 0.5) * step - 0.5))
        weight = weight * F.greatest(F.lit(0.0), 1 - F.abs(from_ - at))
    size = ["rz", "ry", "rx"]
    shares = held.select("tp", "box", *(F.col(f"o{a}").alias(a) for a in "zyx"), *size, weight.alias("v")).filter("v <> 0")
    grid = boxes.select("tp", "box", *size)
    for a in "zyx":
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), F.col(f"r{a}") - 1)))
    rows = shares.unionByName(grid.withColumn("v", F.lit(0.0)))
    return rows.groupBy("tp", "box", "z", "y", "x", *size).agg(F.sum("v").alias("v"))


def turned(views: DataFrame, chance: float = 0.5, seed: str = "turn") -> DataFrame:
    """Each view flipped along each axis with a chance, then with the same chance turned in (z, y) by one to three quarters; sizes turn too."""
    u = lambda what: drawn(seed, F.col("tp"), F.col("box"), F.lit(what))
    out = views
    for a in "zyx":
        out = out.withColumn(a, F.when(u(a) < chance, F.col(f"r{a}") - 1 - F.col(a)).otherwise(F.col(a)))
    k = F.when(u("turn") < chance, 1 + F.floor(u("quarters") * 3)).otherwise(0)
    z, y, rz, ry = (F.col(c) for c in ("z", "y", "rz", "ry"))
    new_z = F.when(F.col("_k") == 1, ry - 1 - y).when(F.col("_k") == 2, rz - 1 - z).when(F.col("_k") == 3, y).otherwise(z)
    new_y = F.when(F.col("_k") == 1, z).when(F.col("_k") == 2, ry - 1 - y).when(F.col("_k") == 3, rz - 1 - z).otherwise(y)
    odd = F.col("_k") % 2 == 1
    kept = [c for c in views.columns if c not in ("z", "y", "rz", "ry")]
    return out.withColumn("_k", k).select(*kept, new_z.alias("z"), new_y.alias("y"), F.when(odd, ry).otherwise(rz).alias("rz"), F.when(odd, rz).otherwise(ry).alias("ry"))


def stretched(views: DataFrame, chance: float = 0.8, gamma: tuple[float, float] = (0.25, 2.0), seed: str = "gamma") -> DataFrame:
    """A part of the views with values to a random power of their place between the view's ends; its mean and (population) deviation stay."""
    key = ["tp", "box"]
    u = lambda what: drawn(seed, F.col("tp"), F.col("box"), F.lit(what))
    power = F.when(u("chance") < chance, gamma[0] + (gamma[1] - gamma[0]) * u("power"))
    ends = views.groupBy(*key).agg(F.min("v").alias("_lo"), (F.max("v") - F.min("v")).alias("_range"), F.avg("v").alias("_mean"), F.stddev_pop("v").alias("_std"))
    bent = views.join(ends, key).withColumn("_g", power).withColumn("_b", F.pow((F.col("v") - F.col("_lo")) / (F.col("_range") + 1e-7), F.col("_g")) * F.col("_range") + F.col("_lo"))
    after = bent.groupBy(*key).agg(F.avg("_b").alias("_m"), F.stddev_pop("_b").alias("_s"))
    value = F.when(F.col("_g").isNull(), F.col("v")).otherwise((F.col("_b") - F.col("_m")) / (F.col("_s") + 1e-8) * F.col("_std") + F.col("_mean"))
    return bent.join(after, key).withColumn("v", value).select(*views.columns)


def noisy(views: DataFrame, deviation: float = 0.1, seed: str = "noise") -> DataFrame:
    """Normal noise on every voxel, from two hashes of its place."""
    u = lambda what: drawn(seed, *(F.col(c) for c in ("tp", "box", "z", "y", "x")), F.lit(what))
    return views.withColumn("v", F.col("v") + deviation * F.sqrt(-2 * F.log(1 - u("far"))) * F.cos(2 * math.pi * u("angle")))


def least_hashes(places: DataFrame, most: int, seed: str = "sample") -> DataFrame:
    """At most ``most`` places (tp, z, y, x) a volume, those of the least hashes: a sampling operator.

    The least of each of ``PARTS`` parts come first, so no task sorts a volume.
    """
    told = places.select("tp", "z", "y", "x", drawn(seed, *(F.col(c) for c in ("tp", "z", "y", "x"))).alias("_u")).withColumn("_p", F.pmod(F.xxhash64("z", "y", "x"), F.lit(PARTS)))
    order = ["_u", "z", "y", "x"]
    for part in (["tp", "_p"], ["tp"]):
        told = told.withColumn("_n", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col("_n") <= most)
    return told.select("tp", "z", "y", "x")


def _clusters(points: np.ndarray, k: int, rnd: np.random.Generator, rounds: int = 300) -> np.ndarray:
    """Centres of k clusters of points scaled to 0..1 on each axis, in the points' own units; spread starts, then means until nothing moves."""
    low, span = points.min(axis=0), np.ptp(points, axis=0)
    span = np.where(span == 0, 1, span)
    p = (points - low) / span
    centres = [p[rnd.integers(len(p))]]
    while len(centres) < k:
        far = np.min([((p - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(p[rnd.choice(len(p), p=far / far.sum())] if far.sum() else p[rnd.integers(len(p))])
    at, before = np.array(centres), None
    for _ in range(rounds):
        near = np.argmin(((p[:, None] - at[None]) ** 2).sum(axis=2), axis=1)
        if before is not None and (near == before).all():
            break
        before = near
        at = np.array([p[near == c].mean(axis=0) if (near == c).any() else at[c] for c in range(k)])
    return at * span + low


def cluster_centres(places: DataFrame, k: int, most: int = 5000, seed: str = "clusters") -> DataFrame:
    """(tp, box, z, y, x): centres of k clusters of every volume's places (tp, z, y, x), numbered in their order.

    Fitted on at most ``most`` places a volume (see :func:`least_hashes`),
    which is all that a group holds.  A volume with fewer than k places draws
    k of them with replacement; one without any has no row.
    """
    kind = places.schema["tp"].dataType.simpleString()

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rnd = np.random.Generator(np.random.Philox(key=np.frombuffer(hashlib.md5(f"{seed}:{key[0]}".encode()).digest(), np.uint64)))
        points = rows[["z", "y", "x"]].sort_values(["z", "y", "x"]).to_numpy(float)
        centres = points[rnd.integers(0, len(points), k)] if len(points) < k else _clusters(points, k, rnd)
        centres = centres[np.lexsort(centres.T[::-1])]
        return pd.DataFrame({"tp": key[0], "box": range(k), **dict(zip("zyx", centres.T))})

    return least_hashes(places, most, seed).groupBy("tp").applyInPandas(fit, f"tp {kind}, box int, z double, y double, x double")


def boxes_of_size(centres: DataFrame, shape: Shape, size: Shape) -> DataFrame:
    """Boxes of one size around rounded centres (tp, box, z, y, x), moved to lie inside the volume; cut where the volume is smaller."""
    out = ["tp", "box"]
    for a, n, s in zip("zyx", shape, size):
        begin = F.greatest(F.lit(0), F.least(F.lit(n - s), F.rint(a).cast("int") - s // 2))
        out += [begin.alias(f"{a}0"), F.least(begin + s, F.lit(n)).alias(f"{a}1"), F.lit(s).alias(f"r{a}")]
    return centres.select(*out)


def clustered_boxes(voxels: DataFrame, shape: Shape, size: Shape, k: int, low: float = 0.9975, high: float = 0.999, most: int = 5000, seed: str = "clusters") -> DataFrame:
    """k boxes of one size a volume, around clusters of the voxels between two percentiles."""
    return boxes_of_size(cluster_centres(percentile_band(voxels, ["tp"], "v", low, high), k, most, seed), shape, size)


def auto_boxes(voxels: DataFrame, shape: Shape, k: int = 4, low: float = 0.9975, high: float = 0.999, least: float = 0.3, widest: float = 0.6, most: int = 5000, seed: str = "auto") -> DataFrame:
    """k boxes a volume whose sides are random shares of it, around clusters of the voxels between two percentiles that a 3 x 3 median in their slice keeps.

    Volumes with fewer than k such voxels have no box.
    """
    band = percentile_band(voxels, ["tp"], "v", low, high).select("tp", "z", "y", "x", F.lit(1.0).alias("v"))
    dense = pad_or_crop(band, shape, shape).select("tp", "z", "y", "x", (F.col("v") > 0).alias("inside"))
    kept = median_filter_2d(dense).filter("inside").select("tp", "z", "y", "x")
    enough = kept.groupBy("tp").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k)
    return boxes_around(cluster_centres(kept.join(enough.select("tp"), "tp"), k, most, seed), shape, least, widest, seed)


def pretraining_views(voxels: DataFrame, shape: Shape, large: Shape, small: Shape, n_large: int = 2, n_small: int = 8, low: float = 0.9975, high: float = 0.999, seed: str = "views") -> DataFrame:
    """(tp, box, z, y, x, v, rz, ry, rx): the large views of every volume (boxes from 0) and its small ones (after them).

    Boxes lie around clusters of bright voxels; then flips and quarter turns,
    powers, noise, and values scaled to 0..1 in each view.  Boxes and views
    are each met several times, so they are written once.
    """
    wide = clustered_boxes(voxels, shape, large, n_large, low, high, seed=seed + ":large")
    near = clustered_boxes(voxels, shape, small, n_small, low, high, seed=seed + ":small").withColumn("box", F.col("box") + n_large)
    flat = cut(resized(voxels, cut(wide.unionByName(near))))
    told = cut(noisy(stretched(turned(flat, seed=seed + ":turn"), seed=seed + ":gamma"), seed=seed + ":noise"))
    ends = told.groupBy("tp", "box").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    return told.join(ends, ["tp", "box"]).withColumn("v", (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-6)).select(*told.columns)
