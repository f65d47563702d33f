"""Spread centroids and reseeded clusters."""

import numpy as np

from voxloom.operators import vectors


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cost(points, centroids):
    return float((np.maximum(0, 1 - unit(points) @ unit(centroids).T).min(axis=1) ** 2).sum())


def one_by_one(points, clusters, rnd):
    """The choice of one centroid after the other, with chances by squared distance."""
    p = unit(points)
    chosen = [p[rnd.integers(len(p))]]
    while len(chosen) < clusters:
        d = np.maximum(0, 1 - p @ np.array(chosen).T).min(axis=1) ** 2
        chosen.append(p[rnd.choice(len(p), p=d / d.sum())])
    return np.array(chosen)


def frame(spark, points):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(points)], "id long, vec array<double>")


def test_as_good_as_one_by_one(spark):
    rnd = np.random.default_rng(4)
    centres = rnd.standard_normal((12, 6)) * 3
    points = np.concatenate([centres[k % 12] + rnd.standard_normal((1, 6)) * 0.3 for k in range(400)])
    df = frame(spark, points)
    want = np.mean([cost(points, one_by_one(points, 12, rnd)) for _ in range(30)])
    got = [np.array([r.vec for r in vectors.spread_centroids(df, 12, rounds=3, seed=s).orderBy("k").collect()]) for s in "ab"]
    assert all(len(g) == 12 for g in got) and np.mean([cost(points, g) for g in got]) < 1.2 * want
    again = np.array([r.vec for r in vectors.spread_centroids(df.repartition(7), 12, rounds=3, seed="a").orderBy("k").collect()])
    assert np.allclose(again, got[0])


def test_few_points_and_copies(spark):
    points = np.repeat(np.eye(3), 50, axis=0)
    got = vectors.spread_centroids(frame(spark, points), 8, rounds=2).collect()
    assert sorted(np.argmax(r.vec) for r in got) == [0, 1, 2]
    assert vectors.spread_centroids(frame(spark, points).limit(0), 8, rounds=1).collect() == []


def test_an_empty_cluster_takes_the_farthest_point(spark):
    """Two centroids without points: they get the two points farthest from theirs, then settle."""
    rnd = np.random.default_rng(5)
    points = np.concatenate([np.array([[1, 0.0, 0]]) + 0.01 * rnd.standard_normal((30, 3)), [[0, 1.0, 0], [0, 0.9, 0.1]], [[0, 0, 1.0]]])
    start = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [-1.0, 0.0, 0.0]), (2, [-1.0, -0.1, 0.0])], "k int, vec array<double>")
    near, _ = vectors.kmeans(frame(spark, points), start, rounds=6, reseed=True)
    label = {r.id: r.k for r in near.collect()}
    assert len({label[0], label[30], label[32]}) == 3 and label[30] == label[31] and len({label[k] for k in range(30)}) == 1
    kept, centroids = vectors.kmeans(frame(spark, points), start, rounds=2)
    assert {r.k for r in kept.collect()} == {0} and centroids.count() == 3
