"""Views for training against numpy: boxes, interpolation, turns, powers, noise and clusters."""

import hashlib
import itertools
import math

import numpy as np
import pytest

from voxloom.operators import training_views as V

SHAPE = (10, 14, 12)


def u(seed, *parts):
    return int(hashlib.md5(":".join([seed, *map(str, parts)]).encode()).hexdigest()[:12], 16) / 16**12


def frame(spark, volumes):
    rows = [(str(t), *map(int, at), float(v[at])) for t, v in enumerate(volumes) for at in zip(*np.nonzero(v))]
    return spark.createDataFrame(rows, "tp string, z int, y int, x int, v double")


def arrays(df):
    out = {}
    for r in df.collect():
        a = out.setdefault((r.tp, r.box), np.full((r.rz, r.ry, r.rx), np.nan))
        assert np.isnan(a[r.z, r.y, r.x])
        a[r.z, r.y, r.x] = r.v
    assert not any(np.isnan(a).any() for a in out.values())
    return out


def box_by_hand(tp, box, shape, size, scale, ratio):
    room = math.prod(shape) * (scale[0] + (scale[1] - scale[0]) * u("crop", tp, box, "part"))
    log = lambda k, a: math.log(ratio[0]) + (math.log(ratio[1]) - math.log(ratio[0])) * u("crop", tp, box, k, a)
    for k in range(10):
        high, broad = size[1] / size[0] * math.exp(log(k, "y")), size[2] / size[0] * math.exp(log(k, "x"))
        deep = round((room / (high * broad)) ** (1 / 3))
        sides = (deep, round(deep * high), round(deep * broad))
        if all(0 < s <= n for s, n in zip(sides, shape)):
            return [(b := int(u("crop", tp, box, "at", a) * (n - s + 1)), b + s) for a, s, n in zip("zyx", sides, shape)]
    f = min(n / s for n, s in zip(shape, size))
    return [(b := (n - m) // 2, b + m) for n, m in zip(shape, [min(n, int(s * f)) for n, s in zip(shape, size)])]


@pytest.mark.parametrize("scale", [(0.05, 0.6), (0.99, 1.0)])
def test_ten_boxes_and_what_they_hold(spark, scale):
    rnd = np.random.default_rng(5)
    v = rnd.random(SHAPE) * (rnd.random(SHAPE) < 0.7)
    ids = [("0", b) for b in range(10)]
    large = V.resized_boxes(spark.createDataFrame(ids[:2], "tp string, box int"), SHAPE, (8, 8, 8), scale)
    small = V.resized_boxes(spark.createDataFrame(ids[2:], "tp string, box int"), SHAPE, (3, 5, 4), scale)
    boxes = large.unionByName(small)
    told = {r.box: [(r[f"{a}0"], r[f"{a}1"]) for a in "zyx"] for r in boxes.collect()}
    got = arrays(V.resized(frame(spark, [v]), boxes, side=4))
    for b in range(10):
        size = (8, 8, 8) if b < 2 else (3, 5, 4)
        assert told[b] == box_by_hand("0", b, SHAPE, size, scale, (0.75, 4 / 3))
        want = v[tuple(slice(*s) for s in told[b])]
        for axis, s in enumerate(size):
            n = want.shape[axis]
            at = np.clip((np.arange(s) + 0.5) * n / s - 0.5, 0, None)
            low = np.floor(at).astype(int)
            w = (at - low).reshape([-1 if a == axis else 1 for a in range(3)])
            want = np.take(want, np.minimum(low, n - 1), axis) * (1 - w) + np.take(want, np.minimum(low + 1, n - 1), axis) * w
        assert np.allclose(got["0", b], want)


def test_turns_powers_and_noise(spark):
    rnd = np.random.default_rng(6)
    flat = {(str(t), b): rnd.random((3, 4, 5)) for t, b in itertools.product(range(2), range(10))}
    rows = [(*k, *map(int, at), float(a[at]), *a.shape) for k, a in flat.items() for at in np.ndindex(a.shape)]
    df = spark.createDataFrame(rows, "tp string, box int, z int, y int, x int, v double, rz int, ry int, rx int")
    turned, stretched, noisy = arrays(V.turned(df)), arrays(V.stretched(df)), arrays(V.noisy(df, 0.5))
    kinds = set()
    for k, a in flat.items():
        for axis, name in enumerate("zyx"):
            a = np.flip(a, axis) if u("turn", *k, name) < 0.5 else a
        quarters = 1 + int(u("turn", *k, "quarters") * 3) if u("turn", *k, "turn") < 0.5 else 0
        kinds.add(quarters)
        assert np.array_equal(turned[k], np.rot90(a, quarters, (0, 1)))
        a = flat[k]
        if u("gamma", *k, "chance") < 0.8:
            g = 0.25 + 1.75 * u("gamma", *k, "power")
            bent = ((a - a.min()) / (np.ptp(a) + 1e-7)) ** g * np.ptp(a) + a.min()
            want = (bent - bent.mean()) / (bent.std() + 1e-8) * a.std() + a.mean()
        else:
            want = a
        assert np.allclose(stretched[k], want)
        far = [[u("noise", *k, *at, what) for what in ("far", "angle")] for at in np.ndindex(a.shape)]
        assert np.allclose(noisy[k].ravel(), a.ravel() + [0.5 * math.sqrt(-2 * math.log(1 - f)) * math.cos(2 * math.pi * g) for f, g in far])
    assert kinds == {0, 1, 2, 3}


def blobs(spark, centres, tp="0"):
    return spark.createDataFrame([(tp, z + a, y + b, x + c) for z, y, x in centres for a, b, c in itertools.product((-1, 0, 1), repeat=3)], "tp string, z int, y int, x int")


def test_clusters(spark):
    centres = [(3, 3, 3), (4, 20, 5), (15, 6, 22)]
    places = blobs(spark, centres).unionByName(blobs(spark, [(1, 1, 1)], "one"))
    got = V.cluster_centres(places, 3).orderBy("box").collect()
    assert np.allclose([(r.z, r.y, r.x) for r in got if r.tp == "0"], centres) and sum(r.tp == "one" for r in got) == 3
    assert V.cluster_centres(places.repartition(5), 3).orderBy("box", "tp").collect() == sorted(got, key=lambda r: (r.box, r.tp))
    few = V.cluster_centres(places.filter("tp = 'one' and z = 0 and y = 0"), 5).collect()
    assert len(few) == 5 and {(r.z, r.y) for r in few} == {(0.0, 0.0)}
    boxes = V.boxes_of_size(V.cluster_centres(places.filter("tp = '0'"), 3), (18, 22, 24), (6, 8, 8)).orderBy("box").collect()
    assert [(r.z0, r.z1, r.y0, r.y1, r.x0, r.x1) for r in boxes] == [(0, 6, 0, 8, 0, 8), (1, 7, 14, 22, 1, 9), (12, 18, 2, 10, 16, 24)]
    assert V.cluster_centres(places.filter("false"), 3).count() == 0


def test_least_hashes_are_the_least(spark):
    places = blobs(spark, [(3, 3, 3), (4, 20, 5), (15, 6, 22)])
    want = sorted((u("sample", r.tp, r.z, r.y, r.x), r.z, r.y, r.x) for r in places.collect())[:20]
    assert sorted(tuple(r[1:]) for r in V.least_hashes(places, 20).collect()) == sorted(w[1:] for w in want)


def test_views_and_boxes_of_whole_volumes(spark):
    rnd = np.random.default_rng(7)
    shape = (12, 16, 16)
    v = rnd.random(shape)
    v[2:6, 2:6, 2:6] += 10
    v[7:11, 9:14, 9:14] += 10
    got = arrays(V.pretraining_views(frame(spark, [v, v * 2]), shape, (6, 6, 6), (3, 3, 3), low=0.94, high=0.999))
    assert len(got) == 20 and all(got[t, b].shape == ((6,) * 3 if b < 2 else (3,) * 3) for t, b in got)
    assert all(a.min() == 0 and 0.99 < a.max() < 1 for a in got.values())

    low, high = np.percentile(v, [94, 99.9])
    mask = (v > low) & (v < high)
    wide = np.pad(mask, ((0, 0), (1, 1), (1, 1)), mode="edge").astype(int)
    kept = sum(wide[:, a : a + 16, b : b + 16] for a in range(3) for b in range(3)) >= 5
    halves = [np.argwhere(kept & (np.indices(shape).sum(axis=0) < 21)), np.argwhere(kept & (np.indices(shape).sum(axis=0) >= 21))]
    boxes = V.auto_boxes(frame(spark, [v]), shape, k=2, low=0.94, high=0.999).orderBy("box").collect()
    for r, points in zip(boxes, halves):
        for a, n, c in zip("zyx", shape, points.mean(axis=0)):
            half = (0.3 + 0.3 * u("auto", "0", r.box, a)) * n / 2
            assert (r[f"{a}0"], r[f"{a}1"]) == (int(max(c - half, 0)), int(min(c + half, n)))
    assert len(boxes) == 2 and V.auto_boxes(frame(spark, [v]), shape, k=5000, low=0.94, high=0.999).count() == 0
