"""Masks of patches for training samples: how many of a batch are masked, how much, and which blocks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Grid = tuple[int, int, int]

#: Places that are tried for one block before a mask is left as it is.
TRIES = 10


def scheduled(samples: DataFrame, key: str, batch: str, low: float, high: float, share: float, seed: str = "mask") -> DataFrame:
    """``samples`` with ``ratio``: the part of the patches that is to be masked.

    Of a batch of n samples, in the order of a hash, the first int(n * share)
    have one ratio from each of as many equal steps between ``low`` and
    ``high``; the others 0.  A batch is as large as a training step's.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), 1, 12), 16, 10).cast("double") / float(16**12)
    order = Window.partitionBy(batch)
    told = samples.withColumn("_u", u).withColumn("_n", F.floor(F.count(F.lit(1)).over(order) * share)).withColumn("_k", F.row_number().over(order.orderBy("_u", key)) - 1)
    inner = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("step"), F.col(key).cast("string"))), 1, 12), 16, 10).cast("double") / float(16**12)
    ratio = F.when(F.col("_k") < F.col("_n"), F.lit(low) + (high - low) * (F.col("_k") + inner) / F.col("_n")).otherwise(0.0)
    return told.withColumn("ratio", ratio).drop("_u", "_n", "_k")


def numbers(seed: str, key) -> np.random.Generator:
    """Random numbers of one sample: counted from a key, so neither partitions nor order matter."""
    digest = hashlib.md5(f"{seed}:{key}".encode()).digest()
    return np.random.Generator(np.random.Philox(key=np.frombuffer(digest, np.uint64)))


def block_mask(goal: int, grid: Grid, rnd: np.random.Generator, least: int, aspect: tuple[float, float]) -> np.ndarray:
    """A mask of blocks that cover at most ``goal`` patches.

    Blocks are placed one after the other.  Each has a volume between ``least``
    and what is left of the goal, two ratios of sides that are even in their
    logarithm, and a random place; it is taken if it is smaller than the grid
    in every axis and covers some, but no more than is left, of the open
    patches.  After ``TRIES`` misses in a row the mask stays as it is.
    """
    mask = np.zeros(grid, bool)
    left, logs = goal, np.log(aspect)
    while left > 0:
        for _ in range(TRIES):
            volume = rnd.uniform(least, left) if left > least else rnd.uniform(left, least)
            deep, high = np.exp(rnd.uniform(*logs, 2))
            sides = [round((volume * deep * high) ** (1 / 3)), round((volume * high / deep) ** (1 / 3)), round((volume / (deep * high)) ** (1 / 3))]
            if any(s >= g for s, g in zip(sides, grid)):
                continue
            box = tuple(slice(at, at + s) for s, at in ((s, int(rnd.integers(0, g - s, endpoint=True))) for s, g in zip(sides, grid)))
            fresh = math.prod(sides) - int(mask[box].sum())
            if 0 < fresh <= left:
                mask[box] = True
                left -= fresh
                break
        else:
            break
    return mask


def block_masks(samples: DataFrame, key: str, grid: Grid, least: int = 4, narrowest: float = 0.3, widest: float | None = None, seed: str = "mask") -> DataFrame:
    """(key, ratio, goal, patches, weight): the masked patches of every sample, as numbers in raster order.

    samples: ``key``, ``ratio``.  A mask covers at most ``goal`` = int(ratio *
    cells) patches; ``weight`` is one over their number (at least 1).  A null
    ratio is 0.  Each row is worked out on its own from its key and the seed.
    """
    aspect = (narrowest, widest or 1 / narrowest)
    cells = math.prod(grid)

    def masked(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in tables:
            goals = [int(cells * r) if r == r and r is not None else 0 for r in t["ratio"]]
            found = [np.flatnonzero(block_mask(g, grid, numbers(seed, k), least, aspect)).tolist() for k, g in zip(t[key], goals)]
            yield t.assign(goal=goals, patches=found, weight=[1.0 / max(1, len(f)) for f in found])

    kind = samples.schema[key].dataType.simpleString()
    return samples.select(key, F.col("ratio").cast("double").alias("ratio")).mapInPandas(masked, f"{key} {kind}, ratio double, goal int, patches array<int>, weight double")
