"""Exact quantiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import selection

SHARES = {"m": 0.5, "hi": 0.999, "least": 0.0, "most": 1.0}


def table(spark):
    rnd = np.random.default_rng(0)
    rows = [("big", float(x)) for x in rnd.standard_normal(20001)] + [("ties", float(x)) for x in rnd.integers(0, 3, 500)] + [("ten", float(k)) for k in range(10)]
    rows += [("odd", float(k)) for k in range(7)] + [("two", 1.0), ("two", 4.0), ("one", 3.0), ("none", None), ("nan", float("nan")), ("nan", 1.0), (None, 2.0), (None, 5.0)]
    return rows, spark.createDataFrame(rows, "k string, v double").repartition(3)


@pytest.mark.parametrize("accuracy,most", [(10_000, 1_000_000), (100, 20)])
def test_quantiles(spark, monkeypatch, accuracy, most):
    """With fine sketches, and with coarse ones whose brackets are narrowed several times."""
    monkeypatch.setattr(selection, "ACCURACY", accuracy)
    monkeypatch.setattr(selection, "MOST", most)
    rows, df = table(spark)
    wanted = {n: (F.col("v"), q) for n, q in SHARES.items()} | {"above": (F.when(F.col("v") > 0, F.col("v")), 0.3)}
    got = {r["k"]: r for r in selection.quantiles(df, ["k"], wanted).collect()}
    assert set(got) == {k for k, _ in rows}
    for k in got:
        v = np.array([x for g, x in rows if g == k and x is not None and x == x])
        for name, q in (SHARES | {"above": 0.3}).items():
            some = v[v > 0] if name == "above" else v
            assert got[k][name] == (pytest.approx(np.quantile(some, q), abs=1e-12) if len(some) else None), (k, name)


def test_without_keys_and_empty(spark):
    rows, df = table(spark)
    want = float(np.median([x for _, x in rows if x is not None and x == x]))
    assert selection.quantiles(df, [], {"m": (F.col("v"), 0.5)}).first().m == pytest.approx(want)
    assert selection.quantiles(df.limit(0), [], {"m": (F.col("v"), 0.5)}).first().m is None
    assert selection.quantiles(df.limit(0), ["k"], {"m": (F.col("v"), 0.5)}).collect() == []


def test_no_group_in_one_list(spark):
    """No plan gathers the values of a group."""
    _, df = table(spark)
    plan = selection.quantiles(df, ["k"], {"m": (F.col("v"), 0.5)})._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and " percentile(" not in plan and "median(" not in plan
