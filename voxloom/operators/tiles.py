"""Stencils on tiles: every tile of a volume gets the border that its neighbours hold once, and works on arrays. Voxels: tp, z, y, x, v."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import ball, gaussian_kernel

Shape = tuple[int, int, int]


class Step(NamedTuple):
    """What is done to an array, and from how far away a voxel's result draws."""

    reach: int
    apply: Callable[[np.ndarray], np.ndarray]


def _shifted(block: np.ndarray, offsets: Sequence[Shape], reach: int, mode: str = "edge"):
    """The block as seen from each of the offsets; beyond its ends the last value counts, or zero with mode ``constant``."""
    wide = np.pad(block, reach, mode=mode)
    for a, b, c in offsets:
        yield wide[tuple(slice(reach + o, reach + o + n) for o, n in zip((a, b, c), block.shape))]


def weighted(kernel: np.ndarray) -> Step:
    """Convolution with a kernel of odd sides; the volume's edges are repeated."""
    reach = max(kernel.shape) // 2
    middle = [s // 2 for s in kernel.shape]
    places = [tuple(int(m - i) for i, m in zip(at, middle)) for at in np.ndindex(kernel.shape)]

    def apply(block: np.ndarray) -> np.ndarray:
        out = np.zeros_like(block)
        for w, seen in zip(kernel.ravel(), _shifted(block, places, reach)):
            out += w * seen
        return out

    return Step(reach, apply)


def blurred(sigma: float) -> Step:
    """A Gaussian, axis by axis; none if sigma is 0."""
    if sigma == 0:
        return Step(0, lambda block: block)
    taps = np.array(gaussian_kernel(sigma))
    lines = [weighted(taps.reshape([-1 if a == axis else 1 for a in range(3)])) for axis in range(3)]

    def apply(block: np.ndarray) -> np.ndarray:
        for line in lines:
            block = line.apply(block)
        return block

    return Step(len(taps) // 2, apply)


def opened(radius: int) -> Step:
    """Grey opening by a ball: least, then greatest values."""
    places = ball(radius)

    def extreme(block: np.ndarray, how) -> np.ndarray:
        out = block.copy()
        for seen in _shifted(block, places, radius):
            how(out, seen, out=out)
        return out

    return Step(2 * radius, lambda block: extreme(extreme(block, np.minimum), np.maximum))


def without(background: Step) -> Step:
    """The array less a background made of it."""
    return Step(background.reach, lambda block: block - background.apply(block))


def peaks() -> Step:
    """1 where none of the 26 neighbours is greater, else 0; all of a plateau count."""
    places = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]

    def apply(block: np.ndarray) -> np.ndarray:
        top = block.copy()
        for seen in _shifted(block, places, 1):
            np.maximum(top, seen, out=top)
        return (block >= top).astype(float)

    return Step(1, apply)


def laplacian_of_gaussian(size: Shape = (7, 7, 7), sigma: float = 1.0) -> np.ndarray:
    """The second derivative of a Gaussian on a grid, shifted to a mean of zero."""
    away = np.meshgrid(*(np.arange(s) - (s - 1) / 2 for s in size), indexing="ij")
    square = sum(a**2 for a in away)
    raw = (square - 3 * sigma**2) / sigma**5 * np.exp(-square / (2 * sigma**2))
    return raw - raw.mean()


def _dealt(voxels: DataFrame, shape: Shape, side: int, halo: int) -> DataFrame:
    """Every voxel in each tile whose core or border holds it, and an empty row for every tile of a time point."""
    out = voxels.filter(" and ".join(f"{a} between 0 and {n - 1}" for a, n in zip("zyx", shape))).select("tp", "z", "y", "x", F.col("v").cast("double").alias("v"))
    marks = voxels.select("tp").distinct()
    for a, n in zip("zyx", shape):
        last = (n - 1) // side
        first, end = F.greatest(F.floor((F.col(a) - halo) / side), F.lit(0)), F.least(F.floor((F.col(a) + halo) / side), F.lit(last))
        out = out.withColumn(f"t{a}", F.explode(F.sequence(first.cast("int"), end.cast("int"))))
        marks = marks.withColumn(f"t{a}", F.explode(F.sequence(F.lit(0), F.lit(last))))
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("z", "int"), ("y", "int"), ("x", "int"), ("v", "double"))]
    kinds = [F.col(a).cast("int").alias(a) for a in "zyx"]
    return out.select("tp", "tz", "ty", "tx", *kinds, "v").unionByName(marks.select("tp", "tz", "ty", "tx", *empty))


def _tile(key: tuple, rows: pd.DataFrame, shape: Shape, side: int, halo: int) -> tuple[np.ndarray, list[int], tuple[slice, ...]]:
    """The tile with its border as an array, its core's corner, and where the core lies in the array."""
    at = [int(t) * side for t in key[1:4]]
    low = [max(0, a - halo) for a in at]
    block = np.zeros([min(n, a + side + halo) - b for n, a, b in zip(shape, at, low)])
    held = rows[rows["z"].notna()]
    places = tuple(held[a].to_numpy().astype(int) - b for a, b in zip("zyx", low))
    block[places] = held["v"].fillna(0).to_numpy()
    core = tuple(slice(a - b, min(n, a + side) - b) for n, a, b in zip(shape, at, low))
    return block, at, core


def stencils(voxels: DataFrame, shape: Shape, outputs: dict[str, Sequence[Step]], first: Sequence[Step] = (), side: int = 32) -> DataFrame:
    """(tp, z, y, x, and a double for each of ``outputs``): steps in a row, dense over the shape.

    ``first`` is done once for all outputs.  Voxels that are missing or null
    are 0, those outside the shape are left out, of repeated ones any counts.
    A tile takes in as much border as all its steps together reach, in one
    exchange, so what a step gets wrong at a tile's rim never reaches its core;
    copies grow with the tiles' surface, and a task holds
    (side + 2 * reach)^3 numbers, whatever the volume.
    """
    halo = sum(s.reach for s in first) + max(sum(s.reach for s in steps) for steps in outputs.values())
    kind = voxels.schema["tp"].dataType.simpleString()

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block, at, core = _tile(key, rows, shape, side, halo)
        for step in first:
            block = step.apply(block)
        found = {}
        for name, steps in outputs.items():
            out = block
            for step in steps:
                out = step.apply(out)
            found[name] = out[core].ravel()
        extent = [c.stop - c.start for c in core]
        places = np.indices(extent).reshape(3, -1) + np.array(at)[:, None]
        return pd.DataFrame({"tp": key[0], "z": places[0], "y": places[1], "x": places[2], **found})

    told = _dealt(voxels, shape, side, halo).groupBy("tp", "tz", "ty", "tx")
    return told.applyInPandas(work, f"tp {kind}, z int, y int, x int, " + ", ".join(f"{name} double" for name in outputs))


def neighbour_values(voxels: DataFrame, shape: Shape, reach: int = 1, side: int = 32) -> DataFrame:
    """(tp, z, y, x, values): the values around each given voxel in raster order of their offsets, zero where there is none.

    Every voxel is sent once to its tile and to those whose border it is in.
    """
    offsets = [(a, b, c) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) for c in range(-reach, reach + 1)]
    kind = voxels.schema["tp"].dataType.simpleString()

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block, at, _ = _tile(key, rows, shape, side, reach)
        low = np.array([max(0, a - reach) for a in at])
        places = rows.loc[rows["z"].notna(), ["z", "y", "x"]].drop_duplicates().to_numpy().astype(int)
        places = places[((places >= at) & (places < np.array(at) + side)).all(axis=1)]
        here = tuple((places - low).T)
        values = np.stack([seen[here] for seen in _shifted(block, offsets, reach, "constant")], axis=1)
        return pd.DataFrame({"tp": key[0], "z": places[:, 0], "y": places[:, 1], "x": places[:, 2], "values": list(values)})

    told = _dealt(voxels, shape, side, reach).filter("z is not null").groupBy("tp", "tz", "ty", "tx")
    return told.applyInPandas(work, f"tp {kind}, z int, y int, x int, values array<double>")
