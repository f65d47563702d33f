"""Searches of growing reach and pairs as arrays against their plain forms, on random objects with copies and ties."""

import math
import random

import numpy as np
import pytest

from voxloom.operators import matching, tracks

REACH = (3.0, 2.0, 2.5)


def objects(spark, seed):
    rnd = random.Random(seed)
    rows = [(t, label, rnd.randint(0, 24) / 2, rnd.choice([0.0, 0.5, 9.0]), float(rnd.randint(1, 3))) for t in range(3) for label in rnd.sample(range(100), 45)]
    rows += [(1, 200, None, 0.0, 1.0), (1, 201, float("nan"), 0.0, 1.0)]
    return rows, spark.createDataFrame(rows, "t int, label long, cy double, cx double, cz double")


@pytest.mark.parametrize("start", [0.4, None])
def test_nearest_links(spark, start):
    _, o = objects(spark, 1)
    want = tracks.mutual_nearest(matching.candidates(o, *REACH))
    got = sorted(map(tuple, tracks.nearest_links(o, *REACH, start).select("t", "ref", "cand").collect()))
    assert got == sorted(map(tuple, want.select("t", "ref", "cand").collect())) and len(got) > 10


def test_candidates_are_all_pairs_within_reach(spark):
    rows, o = objects(spark, 2)
    known = [r for r in rows if r[2] is not None and not math.isnan(r[2])]
    want = sorted((a[0], a[1], b[1]) for a in known for b in known if b[0] == a[0] + 1 and all(abs(a[k] - b[k]) <= r for k, r in ((2, 3.0), (3, 3.0), (4, 2.0))))
    assert sorted(tuple(r)[:3] for r in matching.candidates(o, *REACH).collect()) == want


def copies(spark):
    """Objects of which many lie at one place, two at equal distances, one without a label."""
    rows = [(t, 100 * k + label, y, x, 1.0) for t in range(3) for k in range(7) for label, y, x in ((1, 0.0, 0.0), (2, 2.0, 0.0), (3, -2.0, 0.0), (4, 1.0, 2.5), (5, 30.0, 0.0))]
    rows += [(1, None, 0.0, -0.0, 1.0), (1, 999, None, 0.0, 1.0), (1, 998, float("nan"), 0.0, 1.0)]
    return rows, spark.createDataFrame(rows, "t int, label long, cy double, cx double, cz double")


def by_hand(rows, radius=3.0):
    """Pairs and their distances; null labels come last among equal distances."""
    known = [r for r in rows if r[2] is not None and not math.isnan(r[2])]
    met = [(a[0], a[1], b[1], math.hypot(a[2] - b[2], a[3] - b[3])) for a in known for b in known if b[0] == a[0] + 1 and all(abs(a[k] - b[k]) <= radius for k in (2, 3))]
    return sorted(met, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[3], r[2] is None, r[2] or 0))


@pytest.mark.parametrize("block", [2, 4096])
@pytest.mark.parametrize("cells", [("cy",), matching.AXES])
def test_copies_meet_once_a_place(spark, monkeypatch, block, cells):
    monkeypatch.setattr(matching, "BLOCK", block)
    rows, o = copies(spark)
    key = lambda r: tuple((v is None, v or 0) for v in r[:3])
    near = matching.near_places(o, *REACH, cells=cells)
    got = [(r.t, r.ref, r.cand) for r in matching.pairs_of(near).collect()]
    assert sorted(got, key=key) == sorted((r[:3] for r in by_hand(rows)), key=key) and len(got) > 1000
    met = near.collect()
    assert max(len(x) for r in met for x in (r.refs, r.cands)) <= block and (block == 2 or len(met) < 50)


@pytest.mark.parametrize("cells", [("cy",), matching.AXES])
def test_candidates_in_order(spark, cells):
    rows, o = copies(spark)
    want, last = [], None
    for t, ref, cand, _ in by_hand(rows):
        place = place + 1 if (t, ref) == last else 1  # noqa: F821
        last = (t, ref)
        want.append((t, ref, cand, place))
    key = lambda r: (r[0], r[1] is None, r[1] or 0, r[3])
    got = matching.candidates_in_order(o, *REACH, cells=cells)
    assert sorted(map(tuple, got.collect()), key=key) == want


def test_a_range_of_one_axis_is_shared_by_several_cells(spark):
    """Where only one axis is cut, a crowded range of twice the radius is the work of four cells, and every pair still meets once."""
    rows = [(t, k, k / 4, 0.0, 1.0) for t in range(2) for k in range(-40, 240)]
    o = spark.createDataFrame(rows, "t int, label long, cy double, cx double, cz double")
    keys, ref, cand = matching._meeting(o, 15.0, 2.0, None, ("cy",))
    assert max(r["count"] for r in ref.groupBy(*keys).count().collect()) <= 31
    assert max(r["count"] for r in cand.groupBy(*keys).count().collect()) <= 152
    got = [(r.ref, r.cand) for r in matching.candidates(o, 15.0, 2.0, cells=("cy",)).filter("t = 0").collect()]
    assert sorted(got) == [(a, b) for a in range(-40, 240) for b in range(-40, 240) if abs(a - b) <= 60]


@pytest.mark.parametrize("name", ["ranked_candidates_by_distance", "spatial_candidates"])
def test_no_pair_is_shuffled_or_sorted(spark, name):
    """Above the join, where rows are pairs, nothing is exchanged, sorted or held in a window."""
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Join")]
    assert not any(x in above for x in ("Exchange", "Sort ", "Window")) and above.count("Generate") >= 2


def test_a_list_of_candidates_is_put_in_order_once(spark):
    """What all rows of a place or an object share is made before its rows: the order not anew in a filter of the join, the name not in every row."""
    import __spark_entry__ as entry

    df = entry.queries()["ranked_candidates_by_distance"](spark, "/root/testdata/sf0.001")
    plan = [line.strip(" :+-") for line in df._jdf.queryExecution().executedPlan().toString().splitlines()]
    assert not any("sort_array" in line for line in plan if "Join" in line)
    assert sum("sort_array" in line for line in plan) == 1
    last = next(i for i, line in enumerate(plan) if "Generate posexplode" in line)
    assert last > 0 and not any("concat" in line for line in plan[:last]) and "concat" in plan[last + 1]


@pytest.mark.parametrize("start", [0.7, None])
def test_greedy_of_objects(spark, start):
    _, o = objects(spark, 3)
    free, want = set(), []
    for r in sorted(matching.candidates(o, *REACH).collect(), key=lambda r: (r.dist, r.ref, r.cand)):
        if not {(r.t, "ref", r.ref), (r.t, "cand", r.cand)} & free:
            free |= {(r.t, "ref", r.ref), (r.t, "cand", r.cand)}
            want.append((r.t, r.ref, r.cand))
    assert sorted(map(tuple, matching.greedy_objects(o, *REACH, start).collect())) == sorted(want)


def sequential(rows, w=2.5):
    """The sequential rule on objects, and how many pairs it has to choose from."""
    by_t = {}
    for r in rows:
        by_t.setdefault(r[0], []).append(r)
    dist = lambda a, b: np.float32(math.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 + w * (a[4] - b[4]) * (a[4] - b[4])))
    met = [(t, dist(a, b), a[1], b[1]) for t in by_t for a in by_t[t] for b in by_t.get(t + 1, []) if all(abs(a[k] - b[k]) <= x for k, x in ((2, REACH[0]), (3, REACH[0]), (4, REACH[1])))]
    used, out = set(), []
    for t, _, a, b in sorted(met):
        if not {(t, "a", a), (t, "b", b)} & used:
            used |= {(t, "a", a), (t, "b", b)}
            out.append((t, a, b))
    return sorted(out), len(met)


@pytest.mark.parametrize("start", [0.7, None])
@pytest.mark.parametrize("seed", [4, 6])
def test_greedy_of_places_equally_near(spark, start, seed):
    """Several objects at each place of a grid, so that nearly all places are equally near to several; labels are strewn."""
    rnd = random.Random(seed)
    rows, side = [], (6, 2) if seed == 6 else (12, 3)
    for t in range(4):
        spots = [(rnd.randint(0, side[0]) / 2, rnd.randint(0, side[1]) / 2, float(rnd.randint(1, 2))) for _ in range(40)]
        labels = rnd.sample(range(1000), 150)
        rows += [(t, label, *rnd.choice(spots)) for label in labels]
    o = spark.createDataFrame(rows, "t int, label long, cy double, cx double, cz double")
    want, met = sequential(rows)
    assert sorted(map(tuple, matching.greedy_objects(o, *REACH, start).collect())) == want and met > 5000


def test_greedy_rounds_do_not_grow_with_the_objects_of_a_place(spark, monkeypatch):
    """Two places equally near to one, forty objects each, labels in turn: settled at once, and the last ones with them."""
    rows = [(t, 10 * k + p, y, 0.0, 1.0) for k in range(40) for t, p, y in ((0, 1, 0.0), (1, 1, 1.0), (1, 2, -1.0), (0, 3, 2.5), (1, 3, 40.0))]
    o = spark.createDataFrame(rows, "t int, label long, cy double, cx double, cz double")
    sc = spark.sparkContext
    sc.setJobGroup("greedy", "greedy")
    matched = matching.greedy_objects(o, *REACH, 2.0)
    sc.setJobGroup("others", "others")
    got = sorted(map(tuple, matched.collect()))
    assert got == sequential(rows)[0] and len(got) == 60
    assert 0 < len(sc.statusTracker().getJobIdsForGroup("greedy")) < 150
    # the optimizer's size of the result isn't a product over all rounds
    assert len(str(matched._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 60


def test_greedy_of_objects_without_a_label(spark):
    rows = [(0, None, 0.0, 0.0, 1.0), (0, 5, 0.0, 0.0, 1.0), (1, 2**60 + 1, 1.0, 0.0, 1.0), (1, 2**60, -1.0, 0.0, 1.0), (1, None, -1.0, 0.0, 1.0)]
    o = spark.createDataFrame(rows, "t int, label long, cy double, cx double, cz double")
    got = {tuple(r) for r in matching.greedy_objects(o, *REACH).collect()}
    assert got == {(0, None, None), (0, 5, 2**60)}


def test_samples_that_only_one_object_has(spark):
    """The samples that meet count, whatever else each object has; a null counts but adds nothing, one sample has no correlation."""
    rows = [(0, 1, 0, k, float(k)) for k in range(5)] + [(0, 1, 1, 0, 2.0)] + [(1, 7, 0, k, v) for k, v in ((3, 1.0), (1, 4.0), (4, None), (9, 8.0))] + [(1, 7, 1, 0, 5.0), (1, 7, 2, 0, 5.0)]
    s = spark.createDataFrame(rows, "t int, label int, c int, k int, f double")
    pairs = spark.createDataFrame([(0, 1, 7), (0, 1, 8)], "t int, ref int, cand int")
    got = {r.c: (r.corr, r.mse) for r in matching.pair_features(pairs, s).collect()}
    assert set(got) == {0, 1} and got[1] == (None, 9.0) and got[0][1] == pytest.approx((9.0 + 4.0) / 2)
    plan = matching.pair_features(pairs, s)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 2  # one row a pair travels


def test_blocks_of_vectors():
    """Copies of a row are the blocks of the other side: few, and no faster than the rows."""
    from voxloom.operators import vectors

    assert vectors.blocks(600_000, 600_000, 64) == (19, 19)
    assert vectors.blocks(10, 500, 64) == (1, 1) and vectors.blocks(200, 10_256, 64) == (1, 11)
    assert all(n / p * w * 8 <= 2**24 for n in (10**6, 10**7) for w in (64, 384, 2048) for p in vectors.blocks(n, n, w))
