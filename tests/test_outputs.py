"""Hand-checked and brute-force cases of outputs, crops and grown regions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import crops, outputs

AT = "tp string, z int, y int, x int"


def test_managed_and_requested(spark):
    paths = ["raw", "raw/a.npy", "rawer", "norm_per_vol.txt", "hr_feats/x", "pca_3/x", "pca_33/x"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = df.select("p", outputs.managed(F.col("p")).alias("m"), outputs.requested(F.col("p"), F.lit(True), F.lit(3), F.lit(False)).alias("r")).collect()
    assert [r.p for r in got if r.m] == ["raw", "raw/a.npy", "norm_per_vol.txt"]
    assert [r.p for r in got if r.r] == ["pca_3/x"]


def test_metric_lines(spark, tmp_path):
    medians = spark.createDataFrame([("b", 1, 0.5), ("a", 1, 2.0), ("a", 2, None)], "name string, iteration long, median double")
    times = spark.createDataFrame([(1, 0.25, 0.1), (2, 0.5, 0.2)], "iteration long, iter_time double, data_time double")
    lines = outputs.metric_lines(medians, times)
    outputs.append_lines(lines, str(tmp_path / "m"))
    outputs.append_lines(lines.filter("iteration = 2"), str(tmp_path / "m"))
    got = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "m")).collect()), key=lambda r: r["iteration"])
    assert got == [{"iteration": 1, "iter_time": 0.25, "data_time": 0.1, "a": 2.0, "b": 0.5}] + [{"iteration": 2, "iter_time": 0.5, "data_time": 0.2}] * 2


def test_report(spark):
    rows = spark.createDataFrame([("a.txt", 3 << 30, 2), ("a.txt", 1 << 30, 3)], "list string, size long, tifs long")
    want = "## File: a.txt\n\n- Experiments: 2\n\n- Total data: 4.00 GB\n\n- Avg z-frames (TIFs) per experiment: 2.5\n\n- Avg size per experiment: 2.00 GB\n"
    assert [tuple(r) for r in outputs.report(rows).collect()] == [("a.txt", want)]


def test_densities_round_trip(spark, tmp_path):
    rows = [(c, cls, i, i / 4, 0.5 * i) for c in (0, 1) for cls in ("fg", "bg") for i in range(3)]
    outputs.write_densities(spark.createDataFrame(rows, "c int, cls string, i int, x double, f double"), str(tmp_path / "d"))
    got = outputs.read_densities(spark, str(tmp_path / "d"))
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["int", "string", "int", "float", "float"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows)


@pytest.mark.parametrize("total,want", [(0, []), (1, [(0, 1)]), (4, [(0, 4)]), (9, [(0, 4), (4, 8), (8, 9)])])
def test_row_blocks(spark, total, want):
    (row,) = spark.range(1).select(outputs.row_blocks(F.lit(total), 4).alias("b")).collect()
    assert [tuple(b) for b in row.b] == want
    with pytest.raises(ValueError):
        outputs.row_blocks(F.lit(1), 0)


def test_axes_and_named_steps(spark):
    df = spark.createDataFrame([("a", 1, 2, 3, 4.0)], AT + ", v double")
    assert tuple(outputs.permuted(df, "xzy").first()) == ("a", 3, 1, 2, 4.0)
    assert outputs.each_named(df, {"v": [lambda c: c + 1, lambda c: c * 2]}).first().v == 10.0
    for wrong in (lambda: outputs.permuted(df, "zzy"), lambda: outputs.each_named(df, {"w": []})):
        with pytest.raises(ValueError):
            wrong()


def test_npy_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 1, 1, 4.0), ("b", 1, 0, 0, 5.0)], AT + ", v double")
    paths = {r.tp: r.path for r in outputs.write_npy(df, (2, 2, 2), str(tmp_path / "out")).collect()}
    a = np.load(paths["a"])
    assert a.dtype == np.float32 and a.shape == (2, 2, 2) and a[0, 1, 1] == 4 and a.sum() == 4
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.npy", "b.npy"]


def test_boxes_hold_what_they_cut(spark):
    rng = np.random.default_rng(3)
    a = rng.random((6, 7, 8))
    v = spark.createDataFrame([("a", *map(int, i), float(a[i])) for i in np.ndindex(a.shape)], AT + ", v double")
    centres = spark.createDataFrame([("a", k, *map(float, rng.random(3) * a.shape)) for k in range(5)], "tp string, box int, z double, y double, x double")
    boxes = crops.boxes_around(centres, a.shape, 0.3, 0.7)
    got = crops.cropped(v, boxes).groupBy("box").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).collect()
    want = {b.box: a[b.z0 : b.z1, b.y0 : b.y1, b.x0 : b.x1] for b in boxes.collect()}
    assert {r.box: (r.n, round(r.s, 9)) for r in got} == {k: (c.size, round(float(c.sum()), 9)) for k, c in want.items() if c.size}
    assert boxes.collect() == boxes.collect()


def brute_grown(mask, seeds):
    label, rim = dict(seeds), dict(seeds)
    while rim:
        met = {}
        for (z, y, x), k in rim.items():
            for d in np.ndindex(3, 3, 3):
                p = (z + d[0] - 1, y + d[1] - 1, x + d[2] - 1)
                if p in mask and p not in label:
                    met[p] = min(met.get(p, k), k)
        label |= met
        rim = met
    return label


def test_regions_grow_as_by_brute_force(spark):
    rng = np.random.default_rng(5)
    mask = {tuple(map(int, i)) for i in np.argwhere(rng.random((4, 9, 9)) < 0.45)}
    seeds = {p: k + 1 for k, p in enumerate(sorted(mask)[::17])}
    m = spark.createDataFrame([("a", *p) for p in mask], AT)
    s = spark.createDataFrame([("a", *p, k) for p, k in seeds.items()] + [("a", 50, 50, 50, 99)], AT + ", label int")
    assert {(r.z, r.y, r.x): r.label for r in crops.grown(m, s).collect()} == brute_grown(mask, seeds)


def test_two_blobs_are_two_regions(spark):
    a = np.zeros((1, 5, 12))
    a[0, 2, 1:11] = [6, 8, 9, 8, 6, 6, 8, 9, 9, 6]
    v = spark.createDataFrame([("a", *map(int, i), float(a[i])) for i in np.ndindex(a.shape)], AT + ", v double")
    got = {(r.y, r.x): r.label for r in crops.voronoi_otsu(v, v, 5, 12).collect()}
    assert got == {(2, x): 1 if x <= 5 else 2 for x in range(1, 11)}


def test_empty_volumes(spark):
    none = spark.createDataFrame([], AT + ", v double")
    assert crops.maxima(none).count() == 0 and crops.grown(none, none.withColumn("label", F.lit(1))).count() == 0
