"""Block masks against a sequential version on sets, and ratios of a batch."""

import math

import numpy as np
import pytest

from voxloom.operators import masks


def sequential(goal, grid, rnd, least, narrowest):
    """The same draws, patch by patch."""
    done, lo, hi = set(), math.log(narrowest), math.log(1 / narrowest)
    misses = 0
    while len(done) < goal and misses < 10:
        left = goal - len(done)
        volume = rnd.uniform(min(least, left), max(least, left))
        a, b = math.exp(rnd.uniform(lo, hi)), math.exp(rnd.uniform(lo, hi))
        d, h, w = (round(x ** (1 / 3)) for x in (volume * a * b, volume * b / a, volume / (a * b)))
        misses += 1
        if not (d < grid[0] and h < grid[1] and w < grid[2]):
            continue
        z, y, x = (int(rnd.integers(0, g - s + 1)) for g, s in zip(grid, (d, h, w)))
        box = {((z + i) * grid[1] + y + j) * grid[2] + x + k for i in range(d) for j in range(h) for k in range(w)}
        if 0 < len(box - done) <= left:
            done |= box
            misses = 0
    return sorted(done)


@pytest.mark.parametrize("grid", [(6, 7, 8), (2, 3, 20), (1, 5, 5)])
def test_blocks(spark, grid):
    cells = math.prod(grid)
    rows = [(k, [None, 0.0, 0.01, 0.1, 0.35, 0.5, 1.0][k % 7]) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, ratio double")
    one = {r.id: r for r in masks.block_masks(df, "id", grid, seed="s").collect()}
    two = {r.id: r for r in masks.block_masks(df.repartition(7), "id", grid, seed="s").collect()}
    assert one == two
    for k, ratio in rows:
        goal = int(cells * (ratio or 0))
        want = sequential(goal, grid, masks.numbers("s", k), 4, 0.3)
        assert (one[k].goal, one[k].patches) == (goal, want) and len(want) <= goal
        assert one[k].weight == 1 / max(1, len(want))
    if min(grid) > 5:
        assert np.mean([len(one[k].patches) / one[k].goal for k, r in rows if one[k].goal > 20]) > 0.5


def test_ratios_of_a_batch(spark):
    df = spark.range(100).selectExpr("id", "cast(id div 30 as int) as batch", "'x' as ratio_of")
    got = masks.scheduled(df, "id", "batch", 0.1, 0.5, 0.5).collect()
    assert len(got) == 100
    for batch, n in ((0, 30), (1, 30), (2, 30), (3, 10)):
        some = sorted(r.ratio for r in got if r.batch == batch and r.ratio > 0)
        assert len(some) == n // 2
        for k, ratio in enumerate(some):  # one in each step
            assert 0.1 + 0.4 * k / len(some) <= ratio <= 0.1 + 0.4 * (k + 1) / len(some)
