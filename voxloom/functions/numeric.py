"""Numbers, coordinates and vectors as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def distance(dy: Column, dx: Column, dz: Column, z_weight: float) -> Column:
    """Distance between centroids whose squared z part is weighted, as float."""
    return F.sqrt(dy * dy + dx * dx + F.lit(z_weight) * dz * dz).cast("float")


def minmax(v: Column, low: Column, high: Column) -> Column:
    return (v - low) / (high - low + F.lit(EPSILON))


def remap(v: Column, low: float, high: float) -> Column:
    return v * (high - low) + low


def unnormalise(v: Column, mean: Column, std: Column) -> Column:
    return v * std + mean


def quantize_u8(scaled: Column) -> Column:
    """0..1 as 0..255, cut off towards zero."""
    return F.floor(F.least(F.greatest(scaled * 255, F.lit(0.0)), F.lit(255.0))).cast("int")


def ceil_to_multiple(v: Column, base: int) -> Column:
    return (F.ceil(v / base) * base).cast("long")


def padded_size(size: Column, chunk: int, patch: int) -> Column:
    """(chunk rounded up to patches, size rounded up to chunks, padding)."""
    whole = -(-chunk // patch) * patch
    target = ceil_to_multiple(size, whole)
    return F.struct(F.lit(whole).cast("long").alias("chunk"), target.alias("target"), F.greatest(target - size, F.lit(0)).cast("long").alias("padding"))


def flat_index(z: Column, y: Column, x: Column, height: int, width: int) -> Column:
    return (z.cast("long") * height + y) * width + x


def unflatten(index: Column, height: int, width: int) -> Column:
    return F.struct((index / (height * width)).cast("long").alias("z"), ((index / width).cast("long") % height).alias("y"), (index % width).alias("x"))


def nearest_low(i: Column, high: int, low: int) -> Column:
    """The low-resolution cell of a high-resolution index."""
    return F.least(F.floor(i * (low / high)), F.lit(low - 1)).cast("int")


def source_corner(i: Column, size_out: int, size_in: int) -> Column:
    """(lower index, upper index, upper weight) on a grid of ``size_in`` of cell i of ``size_out``: half-pixel centres, edges repeated."""
    at = (i + F.lit(0.5)) * (size_in / size_out) - F.lit(0.5)
    at = F.greatest(at, F.lit(0.0))
    low = F.floor(at)
    return F.struct(F.least(low, F.lit(size_in - 1)).cast("int").alias("lo"), F.least(low + 1, F.lit(size_in - 1)).cast("int").alias("hi"), (at - low).alias("w"))


def utilisation(total0: Column, idle0: Column, total1: Column, idle1: Column) -> Column:
    """Per cent busy between two samples of counters, 0 to 100."""
    gone = total1 - total0
    return F.when(gone <= 0, 0.0).otherwise(F.least(F.greatest((gone - (idle1 - idle0)) / F.when(gone > 0, gone) * 100.0, F.lit(0.0)), F.lit(100.0)))


def cosine_schedule(step: Column, base: float, final: float, total: int, warmup: int = 0, start: float = 0.0, freeze: int = 0) -> Column:
    """Frozen at zero, then a linear warm-up, then half a cosine from ``base`` to ``final``."""
    ramp = F.lit(start) + (F.lit(base) - F.lit(start)) * (step - freeze) / max(1, warmup - 1)
    left = max(1, total - warmup - freeze)
    wave = F.lit(final) + F.lit(0.5 * (base - final)) * (1 + F.cos(F.lit(math.pi) * (step - freeze - warmup) / left))
    return F.when(step < freeze, 0.0).when(step < freeze + warmup, ramp).when(step < total, wave).otherwise(final)


def layer_decay(rate: float, layers: int, layer: Column) -> Column:
    return F.pow(F.lit(rate), F.lit(layers + 1) - layer)


def sincos(position: Column, k: Column, dims: int) -> Column:
    """Entry k of a one-dimensional sine-cosine embedding: sines first, then cosines."""
    half = dims // 2
    angle = position / F.pow(F.lit(10000.0), (k % half) / F.lit(float(half)))
    return F.when(k < half, F.sin(angle)).otherwise(F.cos(angle))


def charbonnier(p: Column, t: Column, eps: float = 1e-3, alpha: float = 0.5) -> Column:
    return F.pow((p - t) * (p - t) + F.lit(eps * eps), F.lit(alpha))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums; null for one row or no variance."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    return F.when((n > 1) & (vx > 1e-12) & (vy > 1e-12), (sxy - sx * sy / n) / F.sqrt(F.when(vx > 0, vx) * F.when(vy > 0, vy)))


def vote_thresholds(features: int) -> list[int]:
    """Default thresholds that ``features`` votes can pass."""
    usual = [t for t in (400, 320, 300, 280, 260) if t <= features]
    return usual or [max(1, round(0.8 * features))]


def rgb_channel(wavelength: Column, shortest: int) -> Column:
    """0 red, 1 green or 2 blue for a wavelength in nm; below ``shortest`` it is red."""
    return F.when((wavelength >= shortest) & (wavelength < 440), 2).when(wavelength.between(440, 509), 1).otherwise(0)
