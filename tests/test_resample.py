"""Resampling, thresholds, soft cuts and views against numpy and by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import resample, sampling

VOXEL = "tp string, z int, y int, x int, v double"


def volume(spark, array, tp="a"):
    return spark.createDataFrame([(tp, z, y, x, float(array[z, y, x])) for z, y, x in np.ndindex(array.shape)], VOXEL)


def array_of(df, shape, value="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["z"], r["y"], r["x"]] = r[value]
    return out


def line(a, axis, size):
    """Linear interpolation along one axis, half-pixel centres, edges repeated."""
    n = a.shape[axis]
    at = np.maximum((np.arange(size) + 0.5) * n / size - 0.5, 0)
    lo = np.minimum(np.floor(at).astype(int), n - 1)
    w = (at - lo).reshape([-1 if k == axis else 1 for k in range(3)])
    return np.take(a, lo, axis) * (1 - w) + np.take(a, np.minimum(lo + 1, n - 1), axis) * w


def interpolated(a, size):
    for k in range(3):
        a = line(a, k, size[k])
    return a


@pytest.fixture
def noise():
    return np.random.default_rng(3).normal(size=(5, 7, 6))


@pytest.mark.parametrize("target", [(3, 7, 6), (8, 9, 6)])
def test_blur_only_where_an_axis_gets_shorter(spark, noise, target):
    want = noise
    if min(np.subtract(target, noise.shape)) < 0:
        taps = np.exp(-(np.arange(-1, 2) ** 2) / (2 * 0.8**2))
        for k in range(3):
            want = np.apply_along_axis(lambda v: np.convolve(v, taps / taps.sum(), "same"), k, want)
    got = array_of(resample.antialiased(volume(spark, noise), noise.shape, target, 3, 0.8), target)
    assert np.allclose(got, interpolated(want, target))


@pytest.mark.parametrize("target", [(9, 7, 11), (5, 17, 6), (4, 5, 3), (2, 2, 2)])
def test_blocks_are_interpolated_alone(spark, noise, target):
    block, shape = (2, 3, 4), noise.shape
    want = np.zeros(target)
    ends = [[(a, min(a + b, n), math.floor(a * t / n), min(t, math.ceil(min(a + b, n) * t / n))) for a in range(0, n, b)] for n, b, t in zip(shape, block, target)]
    for a, b, p, q in ends[0]:
        for c, d, r, s in ends[1]:
            for e, f, t, u in ends[2]:
                want[p:q, r:s, t:u] = interpolated(noise[a:b, c:d, e:f], (q - p, s - r, u - t))
    assert np.allclose(array_of(resample.blockwise(volume(spark, noise), shape, target, block), target), want)


def test_channels_are_bytes_of_their_own_range(spark, noise):
    both = volume(spark, noise).withColumn("c", F.lit(0)).unionByName(volume(spark, 10 * noise + 3).withColumn("c", F.lit(1)))
    got = resample.exported(both, noise.shape, (5, 10, 6))
    for c, a in enumerate((noise, 10 * noise + 3)):
        large = interpolated(a, (5, 10, 6))
        want = np.clip((large - large.min()) / (large.max() - large.min() + 1e-6) * 255, 0, 255).astype(int)
        assert np.abs(array_of(got.filter(f"c = {c}"), (5, 10, 6), "u8") - want).max() <= 1
    assert resample.exported(both.limit(0), noise.shape, (2, 2, 2)).count() == 0


def test_shapes_and_kernels():
    assert resample.target_shape((9, 51, 11), scale=(0.5, 1, 2)) == (4, 51, 22) and resample.target_shape((1, 1, 1), size=(2, 3, 4)) == (2, 3, 4)
    for bad in ({}, {"size": (1, 1, 1), "scale": 1.0}, {"scale": 0.01}, {"scale": -1.0}, {"size": (0, 1, 1)}):
        with pytest.raises(ValueError):
            resample.target_shape((9, 9, 9), **bad)
    for size, sigma in ((4, 1.0), (3, 0.0), (0, 1.0)):
        with pytest.raises(ValueError):
            resample.gaussian_taps(size, sigma)
    assert math.isclose(sum(resample.gaussian_taps(7, 1.3)), 1)


def test_otsu(spark):
    v = np.r_[np.random.default_rng(5).normal(10, 1, 300), np.random.default_rng(6).normal(30, 2, 200)]
    counts, edges = np.histogram(v, 256)
    c = (edges[1:] + edges[:-1]) / 2
    w1, w2 = np.cumsum(counts), np.cumsum(counts[::-1])[::-1]
    m1, m2 = np.cumsum(counts * c) / w1, (np.cumsum((counts * c)[::-1]) / w2[::-1])[::-1]
    want = c[np.argmax(w1[:-1] * w2[1:] * (m1[:-1] - m2[1:]) ** 2)]
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("one", 4.0)] * 3, "tp string, v double")
    got = {r["tp"]: r["threshold"] for r in resample.otsu(df, ["tp"]).collect()}
    assert math.isclose(got["a"], want, rel_tol=1e-9) and got["one"] == 4.0


def test_soft_cuts(spark, noise):
    p = 1 / (1 + np.exp(-noise))
    df = volume(spark, noise).withColumn("probs", F.array(1 / (1 + F.exp(-F.col("v"))), 1 - 1 / (1 + F.exp(-F.col("v")))))
    total = 0.0
    for q in (p, 1 - p):
        m = (noise * q).mean() / (q.mean() + 1e-5)
        w = np.exp(-((noise - m) ** 4) / 1.5**2)
        num = den = 0.0
        for at in np.ndindex(noise.shape):
            for to in np.ndindex(noise.shape):
                d = np.subtract(at, to)
                if np.abs(d).max() <= 2:
                    g = math.exp(-0.5 * (d @ d) / 9.0)
                    num += q[at] * q[to] * w[to] * g
                    den += q[at] * w[to] * g
        total += num / (den + 1e-6)
    assert math.isclose(resample.soft_cuts(df, 2, 3.0, 1.5).first()["loss"], 2 - total, rel_tol=1e-9)


def test_views_batches_cells_and_ranks(spark):
    one = spark.createDataFrame([(1, ["a", "b", "c"], ["x", "y"]), (2, [], ["z"])], "id int, s array<string>, t array<string>")
    assert sorted((r["student"], r["teacher"]) for r in sampling.view_pairs(one, "s", "t").collect()) == [(a, b) for a in "abc" for b in "xy"]
    assert sorted((r["student"], r["teacher"]) for r in sampling.view_pairs(one, "s", "t", skip_same=True).collect()) == [("a", "y"), ("b", "x"), ("c", "x"), ("c", "y")]
    rows = spark.createDataFrame([(k, f"n{k}") for k in range(5)], "p long, name string")
    batches = sampling.batched(rows, "p", 2)
    assert batches.count() == 3 and sorted((r["batch"], r["at"], r["name"]) for r in sampling.unbatched(batches).collect()) == [(k // 2, k % 2, f"n{k}") for k in range(5)]
    cells = sampling.token_grid(spark.createDataFrame([(1, list(range(6)))], "id int, t array<int>"), "t", (1, 2, 3)).collect()
    assert sorted((r["z"], r["y"], r["x"], r["token"]) for r in cells) == [(0, k // 3, k % 3, k) for k in range(6)]
    with pytest.raises(Exception, match="fill a grid"):
        sampling.token_grid(spark.createDataFrame([(1, [1])], "id int, t array<int>"), "t", (1, 2, 3)).collect()
    for n, ranks in ((5, 3), (1, 4), (4, 2)):
        dealt = sampling.ranked(rows.filter(F.col("p") < n), "p", ranks).collect()
        each = -(-n // ranks)
        assert sorted((r["rank"], r["turn"], r["p"]) for r in dealt) == sorted((s % ranks, s // ranks, s % n) for s in range(each * ranks))
    assert sampling.ranked(rows.limit(0), "p", 3).count() == 0
