"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from voxloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, v string, block int, `list` int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", 2, 3) for i, v in rows], SCHEMA)


def brute(rows, every, k):
    """The k best of every query: (query, rank, id, score)."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q in good:
        if i % every == 0:
            best = sorted((-float(q @ v) + 0.0, j) for j, v in good if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def found(spark, rows, every, k):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(frame(spark, rows), every=every, k=k).collect())


def recall(got, want):
    pairs = {(q, v) for q, _, v, _ in want}
    return len(pairs & {(q, v) for q, _, v, _ in got}) / len(pairs)


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_recall_and_scores(spark, monkeypatch, spread):
    monkeypatch.setattr(neighbours, "BLOCK", 128)
    monkeypatch.setattr(neighbours, "CHUNK", 32)
    rnd = np.random.default_rng(1)
    centres = rnd.standard_normal((12, 8))
    # lengths differ: the largest inner product is not the least distance
    rows = [(k, (centres[k % 12] + spread * rnd.standard_normal(8)) * rnd.uniform(0.3, 3)) for k in range(1500)]
    got, want = found(spark, rows, 20, 20), brute(rows, 20, 20)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert recall(got, want) > 0.9
    vec = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, r, i, s in got:
        assert q != i and abs(s - vec[q] @ vec[i]) < 1e-12
    for (q, _, i, s), (p, _, j, t) in zip(got, got[1:]):
        assert q != p or (-s, i) < (-t, j)


def test_many_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rnd = np.random.default_rng(2)
    same = rnd.standard_normal(8)
    rows = [(k, same if k % 3 else rnd.standard_normal(8)) for k in range(600)]
    got = found(spark, rows, 20, 20)
    copies = [k for k in range(600) if k % 3]
    for q in (20, 40, 580):
        mine = [i for p, _, i, _ in got if p == q]
        better = [i for i in mine if i not in copies]
        assert mine[len(better) :] == [i for i in copies if i != q][: 20 - len(better)] and mine[: len(better)] == better


def test_rows_that_take_no_part(spark):
    rows = [(0, np.ones(8)), (1, None), (2, []), (3, np.zeros(8)), (4, [1, None, 1, 1, 1, 1, 1, 1]), (5, [1, np.nan, 1, 1, 1, 1, 1, 1]), (6, [np.inf] * 8), (7, [1.0, 2.0]), (None, np.ones(8)), (20, None), (8, 2 * np.ones(8)), (9, -np.ones(8))]
    assert found(spark, rows, 20, 20) == [(0, 1, 8, 16.0), (0, 2, 9, -8.0)]
    assert found(spark, [(0, np.ones(8))], 20, 20) == []
    assert found(spark, [], 20, 20) == []


def test_repeated_rows_count_once(spark):
    rows = [(0, np.ones(8)), (0, np.ones(8)), (1, np.ones(8)), (1, np.ones(8)), (2, np.arange(8))]
    assert found(spark, rows, 20, 20) == [(0, 1, 2, 28.0), (0, 2, 1, 8.0)]


def test_an_early_end_loses_little():
    """Pairs that the tests on some of the columns abandon are too far, but for very few."""
    rnd = np.random.default_rng(3)
    data = rnd.standard_normal((4000, 64))
    index = neighbours.Index(data[:1000], len(data), float(np.linalg.norm(data, axis=1).max()), 20)
    q = rnd.standard_normal((50, 64))
    cut = lambda m: [np.ascontiguousarray(m[:, a : a + 16], np.float32) for a in range(0, m.shape[1], 16)]
    a, x = index.placed(q, query=True), index.placed(data)
    far = ((a[:, None, :] - x[None]) ** 2).sum(axis=2)
    bound = np.sort(far, axis=1)[:, 19]
    kept = set(zip(*map(list, neighbours.Scan(index, 20).survivors(cut(a), cut(x), bound.astype(np.float32)))))
    near = set(zip(*map(list, np.nonzero(far <= bound[:, None]))))
    assert len(near & kept) >= 0.98 * len(near) and len(kept) < 0.05 * far.size
