"""Hand-checked cases of the volumetric operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import numeric as N
from voxloom.functions import strings as S
from voxloom.operators import catalogue, cleaning, components, density, grid, matching, objects, ops, tracks, vectors
from voxloom.sources import tables
from voxloom.streaming import progress

VOXEL = "tp string, z int, y int, x int, v double"


def volume(spark, array, tp="a"):
    a = np.asarray(array, float)
    return spark.createDataFrame([(tp, z, y, x, float(a[z, y, x])) for z, y, x in np.ndindex(a.shape)], VOXEL)


def array_of(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["z"], r["y"], r["x"]] = r["v"]
    return out


def test_natural_order_and_listing(spark):
    names = ["b.tif", "A.tiff", ".hidden.tiff", "ignore.txt", "img10.tif", "img2.tif"]
    files = spark.createDataFrame([("d", n, False, 1, 0) for n in names] + [("d", "subdir", True, 0, 0)], "dir string, name string, is_dir boolean, length long, mtime_ms long")
    assert [r["name"] for r in catalogue.tiff_files(files).orderBy("key").collect()] == ["A.tiff", "b.tif", "img2.tif", "img10.tif"]


def test_names(spark):
    one = spark.createDataFrame([("Ex05_CamA_ch0_CamB_stack0145_488nm_560nm.x.tif",), ("plain",), (None,)], "name string")
    got = one.select(S.frame_number(F.col("name")), S.name_part(F.col("name"), "camera"), S.name_part(F.col("name"), "wavelength"), S.stem(F.col("name"))).collect()
    assert tuple(got[0]) == (145, "CamB", "560nm.x", "Ex05_CamA_ch0_CamB_stack0145_488nm_560nm.x")
    assert tuple(got[1]) == (None, None, None, "plain") and tuple(got[2]) == (None,) * 4


def test_validation(spark):
    df = spark.createDataFrame([("ok-1",), (".",), ("a/b",), (" ",), (".x",)], "n string")
    assert [tuple(r) for r in df.select(S.dataset_name_ok(F.col("n")), S.directory_name_problem(F.col("n"))).collect()] == [(True, None), (False, "reserved"), (False, "separator"), (False, "blank"), (False, "hidden")]
    t = spark.createDataFrame([("300, ,280",), ("",), (None,)], "t string").select(S.thresholds(F.col("t"))).collect()
    assert [r[0] for r in t] == [[300, 280], None, None]
    assert [r[0] for r in spark.createDataFrame([("process-features_run",), ("",)], "j string").select(S.job_title(F.col("j"))).collect()] == ["Process Features Run", "Job"]
    assert N.vote_thresholds(390) == [320, 300, 280, 260] and N.vote_thresholds(10) == [8]


def test_nonfinite(spark):
    a = [[[1, np.nan], [2, np.inf]], [[3, -np.inf], [4, 5]]]
    assert array_of(cleaning.sanitize_nonfinite(volume(spark, a), ["tp"]), (2, 2, 2)).tolist() == [[[1, 3], [2, 5]], [[3, 1], [4, 5]]]
    with pytest.raises(Exception, match="contains no finite voxels"):
        cleaning.sanitize_nonfinite(volume(spark, np.full((2, 2, 2), np.nan)), ["tp"]).collect()


def test_pad_value_of_an_empty_mask(spark):
    v = volume(spark, np.arange(48).reshape(2, 4, 6)).withColumn("inside", F.lit(False))
    assert cleaning.pad_value(v, ["tp"]).first()["pad"] == 23.5
    assert cleaning.pad_value(v.drop("inside").withColumn("inside", F.lit(None).cast("boolean")).filter("v < 3"), []).first()["pad"] == 1.0


def trilinear_numpy(a, shape):
    out = np.zeros(shape)
    for p in np.ndindex(shape):
        lo, hi, w = [], [], []
        for i, n, m in zip(p, a.shape, shape):
            s = max((i + 0.5) * n / m - 0.5, 0)
            lo.append(min(int(s), n - 1)), hi.append(min(int(s) + 1, n - 1)), w.append(s - int(s))
        for c in np.ndindex(2, 2, 2):
            out[p] += a[tuple(h if k else l for k, l, h in zip(c, lo, hi))] * math.prod(x if k else 1 - x for k, x in zip(c, w))
    return out


def test_trilinear(spark):
    a = np.arange(24.0).reshape(2, 3, 4)
    assert np.allclose(array_of(grid.trilinear(volume(spark, a), (2, 3, 4), (4, 6, 8)), (4, 6, 8)), trilinear_numpy(a, (4, 6, 8)), atol=1e-5)
    assert np.allclose(array_of(grid.affine(volume(spark, a), [[1, 0, 0, 0], [0, 1, 0, 1], [0, 0, 1, 0.5]], (2, 2, 3)), (2, 2, 3)), a[:, 1:, :3] + 0.5)


def test_grid_shapes(spark):
    a = np.arange(120.0).reshape(4, 5, 6)
    assert np.array_equal(array_of(grid.pad_or_crop(volume(spark, a), (4, 5, 6), (2, 3, 4)), (2, 3, 4)), a[1:3, 1:4, 1:5])
    padded = array_of(grid.pad_or_crop(volume(spark, a), (4, 5, 6), (6, 5, 6), -1.0), (6, 5, 6))
    assert np.array_equal(padded[1:5], a) and (padded[[0, 5]] == -1).all()
    assert np.array_equal(array_of(grid.strided(volume(spark, a), (2, 2, 2)), (2, 3, 3)), a[::2, ::2, ::2])
    assert grid.patch_starts(10, 4, 0.5) == [0, 2, 4, 6] and grid.patch_starts(11, 4, 0.5) == [0, 2, 4, 6, 7] and grid.patch_starts(3, 4, 0.5) == [0]
    whole = grid.blend(grid.patches(volume(spark, a), (4, 5, 6), (2, 3, 4), 0.5), (2, 3, 4))
    assert np.allclose(array_of(whole, (4, 5, 6)), a)


def test_components(spark):
    on = spark.createDataFrame([("a", 0, 0, 0), ("a", 2, 2, 2), ("b", 0, 0, 0), ("b", 1, 1, 1), ("b", 2, 2, 0)], "tp string, z int, y int, x int")
    got = sorted((r["tp"], r["z"], r["label"]) for r in components.connected_components(on, 3, 3).collect())
    assert got == [("a", 0, 1), ("a", 2, 2), ("b", 0, 1), ("b", 1, 1), ("b", 2, 1)]


def two_frames(spark):
    cells = [(z, y, x) for z in (1, 2) for y in (1, 2) for x in (0, 1)]
    mask = spark.createDataFrame([(t, 1, z, y, x + s) for t, s in ((1, 1), (2, 2)) for z, y, x in cells], "t int, label int, z int, y int, x int")
    raw = mask.select("t", "label", "z", "y", "x", F.when(F.col("t") == 1, 120.0).otherwise(140.0).alias("v"))
    return mask, raw


@pytest.mark.parametrize("depth, z", [(4, 2.5), (None, 1.5)])
def test_tracking_of_two_frames(spark, depth, z):
    mask, raw = two_frames(spark)
    g = objects.geometry(mask.withColumnRenamed("t", "tp")).withColumnRenamed("tp", "t")
    o = g.join(raw.groupBy("t", "label").agg(F.avg("v").alias("A")), ["t", "label"])
    pairs = matching.candidates(o, 20, 10, 2.5)
    dice = matching.overlap_dice(pairs, mask, g)
    assert [(r["overlap"], r["dice"]) for r in dice.collect()] == [(8, 1.0)]
    features = pairs.select("t", "ref", "cand", F.lit(0).alias("c"), F.lit(None).cast("double").alias("corr"), F.lit(0.0).alias("mse"))
    links = matching.assign(pairs.join(dice, ["t", "ref", "cand"]), features, 3.0, [320, 300, 280, 260])
    assert [r["method"] for r in links.collect()] == ["distance_prefilter"]
    rows = sorted(tuple(r) for r in tracks.export(tracks.chain(o, links), o, depth).collect())
    assert rows == [(1, 1, 1, 1.5, 1.5, z, 120.0, 2), (1, 1, 2, 2.5, 1.5, z, 140.0, 2)]


def greedy_rows(rows):
    used_r, used_c, out = set(), set(), []
    for t, r, c, d in sorted(rows, key=lambda p: (p[3], p[1], p[2])):
        if (t, r) not in used_r and (t, c) not in used_c:
            used_r.add((t, r)), used_c.add((t, c)), out.append((t, r, c))
    return sorted(out)


def test_greedy_is_the_sequential_rule(spark):
    rng = np.random.default_rng(5)
    rows = [(t, int(r), int(c), float(np.float32(rng.integers(0, 6)))) for t in range(3) for r in range(8) for c in range(8) if rng.random() < 0.6]
    pairs = spark.createDataFrame(rows, "t int, ref int, cand int, dist float")
    assert sorted(tuple(r)[:3] for r in matching.greedy(pairs).collect()) == greedy_rows(rows)
    assert matching.greedy(pairs.limit(0)).count() == 0


def test_cascade(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 1.0, 0.9), (1, 1, 2, 2.0, 0.9), (1, 2, 2, 1.0, 0.9), (1, 2, 1, 1.5, 0.9)], "t int, ref int, cand int, dist float, dice double")
    features = [(1, r, c, k, 0.9, float(e)) for k in range(5) for r, c, e in ((1, 1, 0.1), (1, 2, 0.2), (2, 2, 0.3 if k else 0.1), (2, 1, 0.2))]
    f = spark.createDataFrame(features, "t int, ref int, cand int, c int, corr double, mse double")
    # both want 1 at first; only after the distance rule takes over is one left
    assert matching.cascade(pairs, f, [3]).count() == 0
    got = sorted((r["ref"], r["cand"], r["method"]) for r in matching.assign(pairs, f, 0.5, [3]).collect())
    assert got == [(1, 1, "global_closest"), (2, 2, "global_closest")]
    alone = matching.cascade(pairs.filter("ref = 1"), f, [5, 4]).collect()
    assert [(r["cand"], r["method"], r["wins"]) for r in alone] == [(1, "vote_threshold_4", 5)]  # 5 isn't more than 5


def test_zero_variance_has_no_correlation(spark):
    s = spark.createDataFrame([(t, 1, 0, k, float(k * t)) for t in (0, 1) for k in range(4)], "t int, label int, c int, k int, f double")
    r = matching.pair_features(spark.createDataFrame([(0, 1, 1)], "t int, ref int, cand int"), s).first()
    assert r["corr"] is None and r["mse"] == 3.5


def test_track_chains(spark):
    o = spark.createDataFrame([(t, l) for t in range(1, 10) for l in (1, 2)], "t int, label int")
    links = spark.createDataFrame([(t, 1, 2) if t % 2 else (t, 2, 1) for t in range(1, 9) if t != 5], "t int, ref int, cand int")
    got = {(r["t"], r["label"]): (r["track_id"], r["start"], r["i"], r["track_length"]) for r in tracks.chain(o, links).collect()}
    assert got[1, 1] == (1, 1, 1, 5) and got[5, 1] == (1, 1, 5, 5) and got[1, 2] == (2, 1, 1, 1) and got[6, 2][1:] == (6, 1, 4)


def test_nan_amplitudes_drop_the_track(spark):
    t = spark.createDataFrame([(1, 1, 1, 1, 1, 1), (2, 1, 2, 2, 1, 1)], "t int, label int, track_id int, start int, i int, track_length int")
    o = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, float("nan")), (2, 1, 0.0, 0.0, 0.0, 1.0)], "t int, label int, cx double, cy double, cz double, A double")
    assert [r["track_id"] for r in tracks.export(t, o).collect()] == [2]


def test_density_of_one_class(spark):
    s = spark.createDataFrame([(0, "fg", float(v)) for v in (1, 2, 3, 3)], "c int, cls string, v double")
    assert {r["cls"] for r in density.kde(s, 8).collect()} == {"fg"}
    ranges = density.value_range(spark.createDataFrame([(0, "a", 0.0), (0, "b", 14.0), (1, "a", 10.0), (1, "a", -4.0), (2, "a", 5.0)], "c int, cls string, v double"))
    assert sorted(tuple(r) for r in ranges.collect()) == [(0, 0.0, 14.0), (1, -4.0, 10.0), (2, 5.0, 6.0)]


def test_vectors(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 4))
    a /= np.linalg.norm(a, axis=1)[:, None]
    p = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(a)], "id long, vec array<double>")
    s = a @ a.T
    np.fill_diagonal(s, -9)
    got = {r["id"]: r["neighbour"] for r in vectors.nearest_neighbour(p, p, block=8).collect()}
    assert got == {k: int(v) for k, v in enumerate(s.argmax(1))}
    cov = np.cov(a.T)
    assert all(abs(r["cov"] - cov[r["i"], r["j"]]) < 1e-9 for r in vectors.covariance(p).collect())
    one = np.array([r["value"] for r in vectors.pca(p, 1).orderBy("id").collect()])
    assert abs(one.var(ddof=1) - np.linalg.eigvalsh(cov)[-1]) < 1e-9
    balanced = vectors.sinkhorn(p.select(F.col("id").alias("b"), F.posexplode("vec").alias("k", "s")), 3)
    assert all(abs(r["t"] - 1) < 1e-6 for r in balanced.groupBy("b").agg(F.sum("p").alias("t")).collect())


def test_cpu(spark):
    lines = ["cpu 1 2 3 4 5", "cpu0 10 1 2 3 4 5 6 7", "cpu1 20 2 3 4 5 6 7 8", "intr 123", "cpuX bad values here", "cpu2 1 x 3 4 5"]
    got = sorted(tuple(r) for r in ops.parse_cpu(spark.createDataFrame([(x,) for x in lines], "value string")).collect())
    assert got == [("cpu0", 38, 7), ("cpu1", 55, 9)]
    s = spark.createDataFrame([("a", 1, 10, 1), ("a", 2, 10, 1), ("b", 1, 10, 1), ("b", 2, 20, 1), ("c", 1, 10, 1), ("c", 2, 20, 11)], "cpu string, n int, total long, idle long")
    assert sorted((r["cpu"], r["pct"]) for r in ops.utilisation(s, "cpu", "n").collect()) == [("a", 0.0), ("b", 100.0), ("c", 0.0)]
    pct = ops.utilisation(spark.createDataFrame([("cpu0", 1, 100, 20), ("cpu0", 2, 200, 40), ("cpu1", 1, 100, 90), ("cpu1", 2, 200, 195)], "cpu string, n int, total long, idle long"), "cpu", "n")
    assert tuple(ops.cpu_summary(pct).first()) == (2, 1, 40.0)


def test_jobs(spark):
    j = spark.createDataFrame([("old", "me", 100, "done"), ("new", "me", 300, "running"), ("x", "you", 500, "done")], "job_id string, owner string, created_at_ms long, status string")
    assert [r["job_id"] for r in ops.jobs_of(j, "me").collect()] == ["new", "old"]
    assert [r["job_id"] for r in ops.cleared(ops.jobs_of(j, "me"), True).collect()] == ["new"]


def test_progress(spark):
    totals = spark.createDataFrame([("j", "/tmp/out/lr_feats/stack0001.npy"), ("j", "/tmp/out/lr_feats/stack0002.npy")], "job_id string, item string")
    lines = ["Saving to /tmp/out/lr_feats/stack0001.npy", "Saved features to /tmp/out/lr_feats/stack0001.npy\r", "Saved features to /tmp/out/lr_feats/stack0001.npy", "\x1b[32mSaved features to /elsewhere/stack0002.npy\x1b[0m", "Saved features to /tmp/out/lr_feats/stack0002.npy"]
    df = spark.createDataFrame([("j", k, x) for k, x in enumerate(lines)], "job_id string, seq int, line string")
    assert [tuple(r) for r in progress.progress(df.filter("seq < 4"), totals).collect()] == [("j", 1, 2)]  # a known name in another folder is no known file
    assert [tuple(r) for r in progress.progress(df, totals).collect()] == [("j", 2, 2)]
    stopped = spark.createDataFrame([("j", 4)], "job_id string, stopped_seq int")
    assert [tuple(r) for r in progress.progress(df, totals, stopped).collect()] == [("j", 1, 2)]
    assert progress.progress(df.filter("seq = 0"), totals).count() == 0


def test_sources(spark, tmp_path):
    np.save(tmp_path / "stack0001.npy", np.arange(8.0).reshape(2, 2, 2))
    assert np.array_equal(array_of(tables.npy_volumes(spark, str(tmp_path)), (2, 2, 2)), np.arange(8.0).reshape(2, 2, 2))
    assert [r["name"] for r in tables.listing(spark, str(tmp_path), "*.npy").collect()] == ["stack0001.npy"]
    (tmp_path / "norm.txt").write_text("Global hist min: 3\nGlobal hist max: 9.5 \n")
    assert tables.norm_bounds(spark, str(tmp_path / "norm.txt")) == (3.0, 9.5)
    out = str(tmp_path / "ledger")
    names = spark.createDataFrame([("a",), ("b",), ("b",)], "value string")
    tables.append_ledger(names, names.limit(0), out)
    tables.append_ledger(spark.createDataFrame([("b",), ("c",)], "value string"), tables.lines(spark, out), out)
    assert sorted(r["value"] for r in tables.lines(spark, out).collect()) == ["a", "b", "c"]


def test_pairing(spark):
    f = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert sorted((r["stem"], r["status"]) for r in catalogue.paired(f("a.npy", "b.npy"), f("b.tif", "c.tif")).collect()) == [("a", "missing_right"), ("b", "ok"), ("c", "missing_left")]
    with pytest.raises(FileNotFoundError, match="missing_left: s2"):
        catalogue.timepoints(f("s1.npy", "s9.npy"), f("s10.tif", "s2.tif", "s1.tif"))
    with pytest.raises(Exception, match="duplicate name"):
        catalogue.by_stem(f("a.npy", "a.tif")).collect()


def test_greedy_match_covers_all_frames(spark):
    from voxloom.plans import queries

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries._pairs(spark, sf).select("t", "ref", "cand", "dist").collect()]
    got = sorted(tuple(r) for r in queries.greedy_match(spark, sf).select("t", "ref", "cand").collect())
    assert got == greedy_rows(rows)
    assert len({t for t, *_ in got}) > 3


def test_connected_components_of_all_time_points(spark):
    from voxloom.plans import queries
    from voxloom.plans.views import view

    sf = "/root/testdata/sf0.001"
    want, left = {}, {}
    for r in view(spark, sf, "voxel").filter("v > 40000").collect():
        left.setdefault(r["tp"], set()).add((r["z"], r["y"], r["x"]))
    for tp, places in left.items():
        label = 0
        for first in sorted(places):
            if (tp, *first) in want:
                continue
            label, todo = label + 1, [first]
            while todo:
                z, y, x = todo.pop()
                if (z, y, x) in places and (tp, z, y, x) not in want:
                    want[tp, z, y, x] = label
                    todo += [(z + a, y + b, x + c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    got = {(r["tp"], r["z"], r["y"], r["x"]): r["label"] for r in queries.connected_components(spark, sf).collect()}
    assert got == want and len(left) > 1


def test_total_loss_of_all_steps(spark):
    from voxloom.plans import queries
    from voxloom.plans.views import view

    sf = "/root/testdata/sf0.01"
    want = {}
    for r in view(spark, sf, "metric").collect():
        want[r["iteration"]] = want.get(r["iteration"], 0.0) + {"click": 0.5, "view": 2.0}.get(r["name"], 0.0) * (r["value"] or 0.0)
    got = {r["step"]: r["loss"] for r in queries.total_loss(spark, sf).collect()}
    assert got.keys() == want.keys() and max(got) > 200
    assert all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)


def test_all_jobs_of_owners_are_listed(spark):
    from voxloom.plans import queries
    from voxloom.plans.views import view

    sf = "/root/testdata/sf0.001"
    jobs = view(spark, sf, "job")
    got = {}
    for r in queries.jobs_newest(spark, sf).orderBy("owner", "n").collect():
        got.setdefault(r["owner"], []).append((r["n"], r["job_id"]))
    assert sum(map(len, got.values())) == jobs.count()
    longest = max(got, key=lambda o: len(got[o]))
    assert len(got[longest]) > 3
    assert got[longest] == [(k, r["job_id"]) for k, r in enumerate(ops.jobs_of(jobs, longest).collect(), 1)]


def test_sinkhorn_of_all_dimensions(spark):
    from voxloom.plans import queries

    sf = "/root/testdata/sf0.001"
    points = {r["id"]: r["vec"] for r in queries._points(spark, sf).collect()}
    ids = sorted(points)
    q = np.exp(np.array([points[k] for k in ids], float) / 0.5)
    q /= q.sum()
    for _ in range(3):
        q = q / q.sum(axis=0) / q.shape[1]
        q = q / q.sum(axis=1, keepdims=True) / len(ids)
    got = {(r["b"], r["k"]): r["p"] for r in queries.sinkhorn3(spark, sf).collect()}
    assert len(got) == q.size and q.shape[1] == 64
    assert all(got[b, k] == pytest.approx(q[i, k] * len(ids), abs=2e-6) for i, b in enumerate(ids) for k in range(64))


def test_address_classes_are_those_of_the_standard_library(spark):
    from voxloom.functions import strings as S
    from voxloom.plans.oracles import _address_class

    rng = np.random.default_rng(2)
    some = ["", "localhost", "1.2.3", "01.2.3.4", "::", "1::", "::1:2:3:4:5:6:7:8", "fe80::1%eth0", "febf::1", "fec0::1", "2001:0:0:0:0:0:0:1", "2001:20::1", "2001:1::1", "64:ff9b:1::9", "12345::", "1:::2", "fd00::", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "100.64.0.1", "192.0.0.9"]
    some += [".".join(map(str, rng.integers(0, 256, 4))) for _ in range(60)] + [f"{a}.{b}.0.7" for a, b in ((0, 1), (169, 254), (172, 15), (172, 16), (172, 31), (172, 32), (192, 0), (198, 17), (198, 18), (198, 19), (198, 20), (203, 0), (239, 1), (240, 0), (255, 1))]
    some += [":".join(f"{x:x}" for x in rng.integers(0, 65536, 8)) for _ in range(20)]
    df = spark.createDataFrame([(x,) for x in some], "a string")
    assert {r[0]: r[1] for r in df.select("a", S.ip_class(F.col("a"))).collect()} == {x: _address_class(x) for x in some}


def test_parameters(spark):
    from voxloom.functions import strings as S

    one = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    assert [one(S.flag(F.lit(x), True)) for x in ("t", "Y", " on ", "f", "n", "0")] == [True] * 3 + [False] * 3
    assert one(S.flag(F.lit(None).cast("string"), True)) is True and one(S.bounded_int(F.lit(None).cast("string"), 7, 0, 9)) == 7
    assert one(S.bounded_int(F.lit(" 1_0 "), 7, 0, 10)) == 10
    for wrong in (S.flag(F.lit("maybe"), True), S.bounded_int(F.lit("11"), 7, 0, 10), S.bounded_int(F.lit("x"), 7, 0, 10), S.positive_thresholds(F.lit("3,0"))):
        with pytest.raises(Exception, match="Invalid|positive"):
            one(wrong)
    assert one(S.positive_thresholds(F.lit(" 4, ,2 "))) == [4, 2] and one(S.positive_thresholds(F.lit(" "))) is None
    assert one(S.placed(F.lit("<a>X</a>"), {"X": F.lit("1<2 & \"q\"")})) == "<a>1&lt;2 &amp; &quot;q&quot;</a>"
    assert one(S.client_id_ok(F.lit(" 12345678 "))) and not one(S.client_id_ok(F.lit("1234567")))
    assert one(S.preview(F.array(*map(F.lit, "abcd")))) == "a, b, c..." and one(S.output_path(F.lit("/o"), "raw", F.lit("t1"))) == "/o/raw/t1.tif"


def test_kde_of_equal_and_odd_values(spark):
    s = spark.createDataFrame([(0, "fg", 2.0)] * 5 + [(0, "fg", float("inf")), (0, "fg", float("nan"))] + [(0, "bg", 0.0), (0, "bg", 4.0)], "c int, cls string, v double")
    got = {r["x"]: r["f"] for r in density.kde(s, 5).filter("cls = 'fg'").collect()}
    h = 1.06 * 5**-0.2
    assert got.keys() == {0.0, 1.0, 2.0, 3.0, 4.0}
    assert all(f == pytest.approx(np.exp(-0.5 * ((x - 2) / h) ** 2) / (h * np.sqrt(2 * np.pi))) for x, f in got.items())


def test_koleo_makes_vectors_unit_length_and_knows_batches(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(12, 4)) * rng.uniform(0.1, 9, (12, 1))
    points = spark.createDataFrame([(k, k % 2, list(map(float, x))) for k, x in enumerate(v)], "id long, b long, vec array<double>")

    def want(x):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = u @ u.T
        np.fill_diagonal(s, -2)
        return float(-np.log(np.sqrt(np.maximum(2 - 2 * s.max(1), 0)) + 1e-8).mean())

    assert vectors.koleo(points).first()["koleo"] == pytest.approx(want(v))
    assert {r["b"]: r["koleo"] for r in vectors.koleo(points, "b").collect()} == {k: pytest.approx(want(v[k::2])) for k in (0, 1)}


def test_covariance_of_large_means_and_centroids_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(50, 5)) + 1e6
    points = spark.createDataFrame([(k, list(map(float, x))) for k, x in enumerate(v)], "id long, vec array<double>").repartition(7)
    want = np.cov(v.T)
    monkeypatch.setattr(vectors, "MERGE", 2)
    got = {(r["i"], r["j"]): r["cov"] for r in vectors.covariance(points).collect()}
    assert len(got) == 15 and all(got[i, j] == pytest.approx(want[i, j], rel=1e-7, abs=1e-7) for i, j in got)
    centroids = points.filter("id < 9").select(F.col("id").alias("k"), "vec")
    whole = sorted(map(tuple, vectors.assign(points, centroids).collect()))
    monkeypatch.setattr(vectors, "MOST_CENTROIDS", 2)
    assert [r[:2] for r in sorted(map(tuple, vectors.assign(points, centroids).collect()))] == [r[:2] for r in whole]


def test_votes_have_no_distance(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 1.0, 0.9)], "t int, ref int, cand int, dist float, dice double")
    f = spark.createDataFrame([(1, 1, 1, k, 0.9, 0.1) for k in range(5)], "t int, ref int, cand int, c int, corr double, mse double")
    assert [(r["method"], r["distance"], r["wins"]) for r in matching.cascade(pairs, f, [3]).collect()] == [("vote_threshold_3", None, 5)]


def test_spectrum_gap_against_a_plain_transform(spark):
    from voxloom.operators import voxels

    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 2, 3, 4))
    rows = [("u", z, y, x, float(a[z, y, x]), float(b[z, y, x])) for z, y, x in np.ndindex(a.shape)]
    place = np.array(list(np.ndindex(a.shape)))
    # half of the last axis, as the other half mirrors it
    waves = np.array([[np.exp(-2j * np.pi * (place / a.shape @ k)) for k in np.ndindex(2, 3, 3)]])[0]
    magnitude = lambda v: np.abs(waves @ v.ravel()) / np.sqrt(v.size)
    got = voxels.spectrum_gap(spark.createDataFrame(rows, "tp string, z int, y int, x int, a double, b double"), ["tp"], a.shape).first()
    assert got["gap"] == pytest.approx(np.abs(magnitude(a) - magnitude(b)).mean())


def test_errors_of_exchanged_tables(spark):
    from voxloom.operators import exchange

    t = lambda names: spark.createDataFrame([(n, k, k * 10) for k, n in enumerate(names)], "name string, position int, value int")
    assert [r["value"] for r in exchange.aligned(t("ab").drop("value"), t("ba")).orderBy("position").collect()] == [10, 0]
    assert [r["value"] for r in exchange.aligned(t("aa").drop("value"), t("aa")).orderBy("position").collect()] == [0, 10]
    for here, there in (("ab", "abc"), ("ab", "ac"), ("aa", "ab")):
        with pytest.raises(ValueError):
            exchange.aligned(t(here).drop("value"), t(there))
    with pytest.raises(ValueError, match="zz"):
        exchange.selected(t("ab"), spark.createDataFrame([("zz",)], "name string"))
