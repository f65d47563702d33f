"""Stencils on tiles against whole arrays, and the segmentation chain against a sequential one."""

import itertools

import numpy as np

from voxloom.operators import segmentation, tiles


def frame(spark, volumes, kind="double"):
    rows = [(str(t), *map(int, at), float(v[at])) for t, v in enumerate(volumes) for at in zip(*np.nonzero(v))]
    return spark.createDataFrame(rows, f"tp string, z int, y int, x int, v {kind}")


def array(df, column, shape, tp="0"):
    out = np.full(shape, np.nan)
    for r in df.filter(f"tp = '{tp}'").collect():
        assert np.isnan(out[r.z, r.y, r.x])  # every voxel once
        out[r.z, r.y, r.x] = r[column]
    return out


def clamped(volume, offsets):
    for o in offsets:
        yield volume[np.ix_(*(np.clip(np.arange(n) + k, 0, n - 1) for n, k in zip(volume.shape, o)))]


def ball_offsets(radius):
    span = range(-radius, radius + 1)
    return [o for o in itertools.product(span, repeat=3) if sum(k * k for k in o) <= radius * radius]


def convolved(volume, kernel):
    out = np.zeros(volume.shape)
    half = [s // 2 for s in kernel.shape]
    for at in np.ndindex(kernel.shape):
        out += kernel[at] * next(clamped(volume, [tuple(h - i for h, i in zip(half, at))]))
    return out


def gauss(volume, sigma):
    half = max(1, round(3 * sigma))
    taps = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    for axis in range(3):
        volume = convolved(volume, (taps / taps.sum()).reshape([-1 if a == axis else 1 for a in range(3)]))
    return volume


def background(volume, radius):
    low = np.min(list(clamped(volume, ball_offsets(radius))), axis=0)
    return np.max(list(clamped(low, ball_offsets(radius))), axis=0)


def test_chain_of_steps_is_that_of_the_whole_volume(spark):
    rnd = np.random.default_rng(1)
    shape = (7, 19, 12)
    volumes = [rnd.random(shape) * (rnd.random(shape) < share) for share in (0.9, 0.2)]
    lopsided = rnd.random((3, 5, 1))
    first = [tiles.without(tiles.opened(2)), tiles.weighted(lopsided)]
    got = tiles.stencils(frame(spark, volumes), shape, {"a": [tiles.blurred(1.0)], "b": [tiles.peaks()]}, first, side=5).cache()
    for t, v in enumerate(volumes):
        want = convolved(v - background(v, 2), lopsided)
        assert np.allclose(array(got, "a", shape, str(t)), gauss(want, 1.0))
        near = list(itertools.product((-1, 0, 1), repeat=3))
        assert (array(got, "b", shape, str(t)) == (want >= np.max(list(clamped(want, near)), axis=0))).all()


def test_neighbour_values(spark):
    rnd = np.random.default_rng(2)
    shape = (4, 9, 6)
    v = rnd.random(shape) * (rnd.random(shape) < 0.5)
    wide = np.pad(v, 1)
    got = tiles.neighbour_values(frame(spark, [v]), shape, side=3).collect()
    assert len(got) == (v > 0).sum()
    for r in got:
        assert np.allclose(r["values"], wide[r.z : r.z + 3, r.y : r.y + 3, r.x : r.x + 3].ravel())


def test_edges_of_the_input(spark):
    odd = spark.createDataFrame([("a", 0, 0, 0, None), ("a", 1, 1, 1, 2.0), ("a", 9, 0, 0, 5.0), ("a", -1, 0, 0, 5.0)], "tp string, z int, y int, x int, v double")
    got = tiles.stencils(odd, (2, 2, 2), {"v": [tiles.blurred(0)]}, side=1)
    assert sorted((r.z, r.y, r.x, r.v) for r in got.collect() if r.v) == [(1, 1, 1, 2.0)] and got.count() == 8
    none = odd.filter("false")
    assert tiles.stencils(none, (2, 2, 2), {"v": [tiles.peaks()]}).count() == 0 and tiles.neighbour_values(none, (2, 2, 2)).count() == 0
    assert segmentation.segmented(none.selectExpr("tp", "z", "y", "x", "array(v) features"), (2, 2, 2), (2, 2, 2)).count() == 0


def pieces_of(mask):
    """26-connected pieces, numbered in raster order."""
    label, n = np.zeros(mask.shape, int), 0
    for at in zip(*np.nonzero(mask)):
        if label[at]:
            continue
        n += 1
        label[at], open_ = n, [at]
        while open_:
            here = open_.pop()
            for o in itertools.product((-1, 0, 1), repeat=3):
                there = tuple(a + b for a, b in zip(here, o))
                if all(0 <= a < s for a, s in zip(there, mask.shape)) and mask[there] and not label[there]:
                    label[there] = n
                    open_.append(there)
    return label


def otsu_threshold(values):
    counts, edges = np.histogram(values, 256)
    mid = (edges[:-1] + edges[1:]) / 2
    w1, w2 = np.cumsum(counts), counts.sum() - np.cumsum(counts)
    s = np.cumsum(counts * mid)
    with np.errstate(all="ignore"):
        between = np.where((w1 > 0) & (w2 > 0), w1 * w2 * (s / w1 - (s[-1] - s) / w2) ** 2, -1)
    return mid[np.argmax(between)]


def test_segmentation_is_that_of_a_sequential_version(spark):
    rnd = np.random.default_rng(3)
    shape = (8, 20, 20)
    away = lambda c: sum((g - k) ** 2 for g, k in zip(np.indices(shape), c))
    v = rnd.random(shape) * 0.5 + 3.0
    for c in [(3, 4, 4), (4, 4, 10), (3, 14, 15), (5, 12, 3)]:
        v += 40 * np.exp(-away(c) / 5.0)
    rows = [("0", *map(int, at), [float(v[at]), float(v[at]) / 2]) for at in np.ndindex(shape)]
    tokens = spark.createDataFrame(rows, "tp string, z int, y int, x int, features array<double>")
    got = np.nan_to_num(array(segmentation.segmented(tokens, shape, shape, radius=3, side=9), "label", shape))

    u = v * 1.5
    field = gauss(convolved(u - background(u, 3), -tiles.laplacian_of_gaussian()), 1.0)
    last = gauss(field, 2.0)
    near = list(itertools.product((-1, 0, 1), repeat=3))
    mask = last > otsu_threshold(last)
    seeds = pieces_of(mask & (last >= np.max(list(clamped(last, near)), axis=0)))
    pieces = pieces_of(mask)
    places = np.argwhere(seeds)
    want = np.zeros(shape)
    for at in np.argwhere(mask):
        if (seeds[pieces == pieces[tuple(at)]] > 0).any():
            far = ((places - at) ** 2).sum(axis=1)
            want[tuple(at)] = seeds[tuple(places[far == far.min()].T)].min()
    assert want.max() >= 4 and (got == want).all()
