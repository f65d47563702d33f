"""Small operators on hand-made rows: centring, log-softmax, patches, times that are left."""

import math

import pytest
from pyspark.sql import functions as F

from voxloom.operators import grid, ops, scaling, voxels


def test_centred_log_softmax(spark):
    rows = [("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 5.0), ("b", 0, -3.0)]
    df = spark.createDataFrame(rows, "g string, k int, s double")
    centre = spark.createDataFrame([(0, 0.5), (1, -1.0)], "k int, centre double")
    got = {(r.g, r.k): r.log_p for r in scaling.log_softmax(scaling.centred(df, centre, ["k"], "s"), ["g"], "s", 0.5).collect()}
    left = {(g, k): (s - {0: 0.5, 1: -1.0}.get(k, 0.0)) / 0.5 for g, k, s in rows}
    for (g, k), x in left.items():
        assert got[g, k] == pytest.approx(x - math.log(sum(math.exp(y) for (h, _), y in left.items() if h == g)))
    large = spark.createDataFrame([("a", 0, 5000.0), ("a", 1, 4999.0)], "g string, k int, s double")
    assert sum(math.exp(r.log_p) for r in scaling.log_softmax(large, ["g"], "s").collect()) == pytest.approx(1.0)


def test_patches_and_back(spark):
    rows = [("t", z, y, x, float(100 * z + 10 * y + x)) for z in range(4) for y in range(2) for x in range(6)]
    df = spark.createDataFrame(rows, "tp string, z int, y int, x int, v double")
    back = grid.unpatchify(grid.patchify(df, 2), 2)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    with pytest.raises(Exception, match="hasn't 27 values"):
        grid.unpatchify(grid.patchify(df, 2), 3).collect()


def test_time_that_is_left(spark):
    df = spark.createDataFrame([("m", k, None if k == 1 else float(k)) for k in range(1, 8)], "name string, iteration long, seconds double")
    got = {r.iteration: r.left for r in ops.remaining_times(df, "name", 6, 2).collect()}
    assert got == {2: 2.0 * 4, 4: 3.0 * 2, 6: 0.0, 7: 0.0}


def test_sizes_beyond_32_bits(spark, tmp_path):
    from voxloom.plans import queries

    keys = [7, 900_000, 9_000_012, 3_000_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: (r.gcd, r.channels) for r in queries.QUERIES["sizes"](spark, str(tmp_path)).collect()}
    assert got == {k: (math.gcd(k, 360), max(1, min(k % 400 + 1, 536870912 // max(4 * k * 1000, 1)))) for k in keys}
    large = spark.createDataFrame([(2_000_000_000,)], "n int")
    assert large.select(voxels.batch_rows(2**40, F.col("n"), 1), voxels.batch_channels(2**40, F.lit(500), F.col("n")), voxels.least_multiple(F.col("n"), F.lit(3))).first()[:] == (137, 137, 6_000_000_000)
