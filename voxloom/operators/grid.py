"""Operators on regular grids in long format (tp, z, y, x, v)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from .scaling import minmax_scale


def z_projection(df: DataFrame, how: str = "max") -> DataFrame:
    return df.groupBy("tp", "y", "x").agg({"max": F.max, "mean": F.avg}[how]("v").alias("v"))


def nonzero_stacks(df: DataFrame) -> DataFrame:
    """The z slices of each volume that hold a voxel above zero."""
    return df.groupBy("tp", "z").agg(F.max("v").alias("top")).filter("top > 1e-6").select("tp", "z")


def chunks(df: DataFrame, size: tuple[int, int, int], drop_empty: bool = False) -> DataFrame:
    """Voxels and extent of every chunk of a fixed grid; -1 takes a whole axis."""
    at = [(F.lit(0) if s == -1 else F.floor(F.col(a) / s)).cast("int").alias(f"k{a}") for a, s in zip("zyx", size)]
    out = df.groupBy("tp", *at).agg(F.count(F.lit(1)).alias("voxels"), F.max("v").alias("top"), *(F.min(a).alias(f"{a}0") for a in "zyx"), *((F.max(a) + 1).alias(f"{a}1") for a in "zyx"))
    return out.filter("top > 1e-6") if drop_empty else out


def patch_starts(size: int, patch: int, overlap: float) -> list[int]:
    """Where overlapping patches begin on an axis; the last one ends at its end."""
    step = max(1, patch - int(patch * overlap))
    return sorted({min(k, max(size - patch, 0)) for k in range(0, max(size - patch, 0) + step, step)})


def _starts(axis: str, size: int, patch: int, overlap: float):
    starts = F.array(*(F.lit(s) for s in patch_starts(size, patch, overlap)))
    return F.filter(starts, lambda s: (s <= F.col(axis)) & (F.col(axis) < s + patch))


def patches(df: DataFrame, shape: tuple[int, int, int], patch: tuple[int, int, int], overlap: float) -> DataFrame:
    """Voxels once for each overlapping patch that holds them; the patches follow from the coordinates, so nothing is joined."""
    out = df
    for a, n, p in zip("zyx", shape, patch):
        out = out.withColumn(f"p{a}", F.explode(_starts(a, n, p, overlap)))
    return out


def _weight(axis: str, patch: int):
    """Triangular weight from 0.1 at a patch's edge to 1 in its middle."""
    middle = (patch - 1) / 2
    return F.lit(1.0) if middle == 0 else 1 - 0.9 * F.abs(F.col(axis) - F.col(f"p{axis}") - middle) / middle


def blend(df: DataFrame, patch: tuple[int, int, int], value: str = "v") -> DataFrame:
    """Overlapping patches put together: the weighted mean of what each says of a voxel."""
    w = _weight("z", patch[0]) * _weight("y", patch[1]) * _weight("x", patch[2])
    return df.withColumn("_w", w).groupBy("tp", "z", "y", "x").agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias(value))


def patchwise_minmax(df: DataFrame, shape: tuple[int, int, int], patch: tuple[int, int, int], overlap: float) -> DataFrame:
    """Each patch scaled to 0..1 by itself, then blended."""
    scaled = minmax_scale(patches(df, shape, patch, overlap), ["tp", "pz", "py", "px"])
    return blend(scaled.select("tp", "z", "y", "x", "pz", "py", "px", F.col("scaled").alias("v")), patch)


def reconstruct(pieces: DataFrame) -> DataFrame:
    """Pieces (seq, z, y, x, v) written onto one volume; where they overlap the last one stays."""
    return pieces.groupBy("tp", "z", "y", "x").agg(F.max_by("v", "seq").alias("v"))


def pad_or_crop(df: DataFrame, shape: tuple[int, int, int], target: tuple[int, int, int], fill: float = 0.0) -> DataFrame:
    """The middle of a volume, padded evenly with ``fill`` where it is too small; dense over the target grid."""
    moved = df
    for a, n, t in zip("zyx", shape, target):
        moved = moved.withColumn(a, (F.col(a) + ((t - n) // 2 if t >= n else -((n - t) // 2))).cast("int"))
    grid = df.select("tp").distinct()
    for a, t in zip("zyx", target):
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(t - 1))))
    return grid.join(moved.select("tp", "z", "y", "x", "v"), ["tp", "z", "y", "x"], "left").select("tp", "z", "y", "x", F.coalesce("v", F.lit(fill)).alias("v"))


def strided(df: DataFrame, step: tuple[int, int, int]) -> DataFrame:
    keep = [F.col(a) % s == 0 for a, s in zip("zyx", step)]
    return df.filter(keep[0] & keep[1] & keep[2]).select("tp", *((F.col(a) / s).cast("int").alias(a) for a, s in zip("zyx", step)), "v")


def trilinear(df: DataFrame, shape: tuple[int, int, int], target: tuple[int, int, int], corner=lambda axis, i, t, n: N.source_corner(i, t, n)) -> DataFrame:
    """The volume sampled on another grid: half-pixel centres, edges repeated, missing voxels zero.

    Each target voxel names its eight corners with weights; one equi-join
    fetches them and one sum puts them together.  ``corner`` gives the two
    cells of an axis and the upper one's weight.
    """
    grid = df.select("tp").distinct()
    for k, (a, n, t) in enumerate(zip("zyx", shape, target)):
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(t - 1)))).withColumn(f"s{a}", corner(k, F.col(a), t, n))
    ends = lambda a: F.array(F.struct(F.col(f"s{a}.lo").alias("i"), (1 - F.col(f"s{a}.w")).alias("w")), F.struct(F.col(f"s{a}.hi").alias("i"), F.col(f"s{a}.w").alias("w")))
    corners = grid
    for a in "zyx":
        corners = corners.withColumn(f"c{a}", F.explode(ends(a)))
    corners = corners.select("tp", "z", "y", "x", *(F.col(f"c{a}.i").alias(f"i{a}") for a in "zyx"), (F.col("cz.w") * F.col("cy.w") * F.col("cx.w")).alias("w")).filter("w > 0")
    source = df.select("tp", *(F.col(a).alias(f"i{a}") for a in "zyx"), "v")
    return corners.join(source, ["tp", "iz", "iy", "ix"], "left").groupBy("tp", "z", "y", "x").agg(F.sum(F.coalesce("v", F.lit(0.0)) * F.col("w")).alias("v"))


def gaussian_kernel(sigma: float) -> list[float]:
    """A normalised one-dimensional kernel of at least three taps."""
    half = max(1, round(3 * sigma))
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    return [v / sum(raw) for v in raw]


def convolve(df: DataFrame, kernel: list[float], axis: str, size: int) -> DataFrame:
    """Convolution along one axis with zeros outside; a dense separable filter is three of these."""
    half = len(kernel) // 2
    taps = F.array(*(F.struct(F.lit(k - half).alias("o"), F.lit(w).alias("w")) for k, w in enumerate(kernel)))
    keys = ["tp", "z", "y", "x"]
    spread = df.select(*keys, "v", F.explode(taps).alias("t")).withColumn(axis, (F.col(axis) + F.col("t.o")).cast("int"))
    return spread.filter(F.col(axis).between(0, size - 1)).groupBy(*keys).agg(F.sum(F.col("v") * F.col("t.w")).alias("v"))


def median_filter_2d(mask: DataFrame) -> DataFrame:
    """A 3 x 3 median of a boolean mask within each z slice of a dense grid; edges are reflected."""
    taps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    box = mask.groupBy("tp", "z").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    wide = mask.join(box, ["tp", "z"]).select("tp", "z", "y", "x", "y0", "y1", "x0", "x1", F.explode(taps).alias("o"))
    inside = lambda v, lo, hi: F.least(F.greatest(v, F.col(lo)), F.col(hi))
    asked = wide.select("tp", "z", F.col("y").alias("ty"), F.col("x").alias("tx"), inside(F.col("y") + F.col("o.a"), "y0", "y1").alias("y"), inside(F.col("x") + F.col("o.b"), "x0", "x1").alias("x"))
    told = asked.join(mask.select("tp", "z", "y", "x", "inside"), ["tp", "z", "y", "x"], "left")
    return told.groupBy("tp", "z", F.col("ty").alias("y"), F.col("tx").alias("x")).agg((F.sum(F.coalesce(F.col("inside"), F.lit(False)).cast("int")) >= 5).alias("inside"))


def affine(df: DataFrame, inverse: list[list[float]], target: tuple[int, int, int]) -> DataFrame:
    """The volume warped onto a grid: ``inverse`` (3 x 4) leads from target to source coordinates (z, y, x); zero outside, trilinear."""
    grid = df.select("tp").distinct()
    for a, t in zip("zyx", target):
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(t - 1))))
    for a, row in zip("zyx", inverse):
        at = F.lit(row[0]) * F.col("z") + F.lit(row[1]) * F.col("y") + F.lit(row[2]) * F.col("x") + F.lit(row[3])
        grid = grid.withColumn(f"s{a}", at).withColumn(f"c{a}", F.explode(F.array(*(F.struct((F.floor(at) + k).cast("int").alias("i"), (1 - F.abs(at - F.floor(at) - k)).alias("w")) for k in (0, 1)))))
    corners = grid.select("tp", "z", "y", "x", *(F.col(f"c{a}.i").alias(f"i{a}") for a in "zyx"), (F.col("cz.w") * F.col("cy.w") * F.col("cx.w")).alias("w"))
    source = df.select("tp", *(F.col(a).alias(f"i{a}") for a in "zyx"), "v")
    return corners.join(source, ["tp", "iz", "iy", "ix"], "left").groupBy("tp", "z", "y", "x").agg(F.sum(F.coalesce("v", F.lit(0.0)) * F.col("w")).alias("v"))


def page_grid(df: DataFrame, order: list[str], cells: int = 36) -> DataFrame:
    """``page`` and ``cell`` of each row, ``cells`` to a page in the given order within its time point."""
    n = F.row_number().over(Window.partitionBy("tp").orderBy(*order)) - 1
    return df.withColumn("page", (n / cells).cast("int")).withColumn("cell", (n % cells).cast("int"))


def flip(df: DataFrame, axis: str, size: int) -> DataFrame:
    return df.withColumn(axis, (F.lit(size - 1) - F.col(axis)).cast("int"))


def rot90(df: DataFrame, width: int) -> DataFrame:
    """A quarter turn in the (y, x) plane."""
    return df.withColumn("_y", (F.lit(width - 1) - F.col("x")).cast("int")).withColumn("x", F.col("y")).withColumn("y", F.col("_y")).drop("_y")


def ball(radius: int) -> list[tuple[int, int, int]]:
    span = range(-radius, radius + 1)
    return [(a, b, c) for a in span for b in span for c in span if a * a + b * b + c * c <= radius * radius]


def _over(df: DataFrame, radius: int, how) -> DataFrame:
    """The extreme of the voxels that exist within a ball around each voxel of ``df``."""
    taps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in ball(radius)))
    seen = df.select("tp", "v", F.explode(taps).alias("o"), "z", "y", "x").select("tp", "v", *((F.col(k) + F.col(f"o.{o}")).alias(k) for k, o in zip("zyx", "abc")))
    return seen.groupBy("tp", "z", "y", "x").agg(how("v").alias("v")).join(df.select("tp", "z", "y", "x"), ["tp", "z", "y", "x"], "left_semi")


def opening(df: DataFrame, radius: int) -> DataFrame:
    """Grey opening by a ball: the least, then the greatest value around each voxel."""
    return _over(_over(df, radius, F.min), radius, F.max)


def patchify(df: DataFrame, p: int) -> DataFrame:
    """(tp, pz, py, px, values): voxels of each cubic patch in raster order."""
    parts = df.select("tp", *(F.floor(F.col(a) / p).cast("int").alias(f"p{a}") for a in "zyx"), F.struct("z", "y", "x", "v").alias("s"))
    return parts.groupBy("tp", "pz", "py", "px").agg(F.array_sort(F.collect_list("s")).alias("s")).select("tp", "pz", "py", "px", F.col("s.v").alias("values"))


def unpatchify(patches: DataFrame, p: int) -> DataFrame:
    """(tp, z, y, x, v): the voxels of cubic patches (tp, pz, py, px, values in raster order); a patch of another length fails."""
    whole = F.when(F.size("values") == p**3, F.col("values")).otherwise(F.raise_error(F.lit(f"a patch hasn't {p**3} values")).cast(patches.schema["values"].dataType))
    flat = patches.select("tp", "pz", "py", "px", F.posexplode(whole).alias("_i", "v"))
    at = {"z": F.floor(F.col("_i") / (p * p)), "y": F.floor(F.col("_i") / p) % p, "x": F.col("_i") % p}
    return flat.select("tp", *((F.col(f"p{a}") * p + k).cast("int").alias(a) for a, k in at.items()), "v")


def foreground(mask: DataFrame) -> DataFrame:
    """The mask with ``is_fg``: any label but the least of its time point."""
    least = mask.groupBy(F.col("tp").alias("_tp")).agg(F.min("label").alias("_least"))
    return mask.join(least, F.col("tp") == F.col("_tp")).withColumn("is_fg", F.col("label") != F.col("_least")).drop("_tp", "_least")


def common_shape(shapes: DataFrame, patch: int) -> DataFrame:
    """The least extent of each axis, cut to whole patches. shapes: z, y, x."""
    return shapes.agg(*((F.floor(F.min(a) / patch) * patch).cast("int").alias(a) for a in "zyx"))
