import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import mixing, quality


def poisson(u, mean):
    k, term, cdf = 0, math.exp(-mean), math.exp(-mean)
    while u >= cdf:
        k += 1
        term *= mean / k
        cdf += term
    return k


def uniform(seed, *keys):
    return int(hashlib.md5(":".join([seed, *map(str, keys)]).encode()).hexdigest()[:13], 16) / 16**13


def test_mixing_against_brute_force(table):
    rows = [(k, "t", "big" if k % 4 else f"s{k % 3}") for k in range(400)] + [(1000, "t", None), (1000, "t", None), (None, "t", "big")]
    sizes = {}
    for _, _, s in rows:
        sizes[s] = sizes.get(s, 0) + 1
    weights = {s: math.sqrt(n) for s, n in sizes.items()}
    mean = {s: len(rows) * weights[s] / sum(weights.values()) / n for s, n in sizes.items()}
    want = sorted((str(i), k) for i, _, s in rows for k in range(poisson(uniform("mix", "null" if i is None else i), mean[s])))
    got = mixing.mix(table(rows))
    assert sorted((str(r["doc_id"]), r["copy"]) for r in got.collect()) == want
    assert set(table(rows).columns) <= set(got.columns)


def test_mixing_weights_large_means_and_salting(table, monkeypatch):
    rows = [(k, "t", "a" if k < 300 else "b") for k in range(330)]
    shares = mixing.mix(table(rows), weights={"a": 1.0, "b": 1.0}, rate=4.0).groupBy("source").count().collect()
    shares = {r["source"]: r["count"] for r in shares}
    assert abs(shares["a"] - 660) < 130 and abs(shares["b"] - 660) < 130
    whole = sorted((r["doc_id"], r["copy"]) for r in mixing.mix(table(rows)).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted((r["doc_id"], r["copy"]) for r in mixing.mix(table(rows)).collect()) == whole
    split = mixing.mix(table(rows), weights={"b": 1.0}, rate=20.0, max_mean=32.0)  # means over the limit are sums of draws
    assert abs(split.count() - 6600) < 500
    assert mixing.mix(table([])).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(table(rows), weights={"a": -1.0})


def test_mixing_a_source_of_one_document(table):
    """Its mean is half of all rows; the copies are the sum of its draws, the texts are carried whole."""
    rows = [(k, None if k == 3 else "t" * (k % 7), "a") for k in range(4000)] + [(9999, "x" * 100_000, "tiny")]
    got = mixing.mix(table(rows), weights={"a": 1.0, "tiny": 1.0})
    mean = len(rows) / 2
    draws = math.ceil(mean / 64)
    want = sum(poisson(uniform("mix", 9999, *([k] if k else [])), mean / draws) for k in range(draws))
    counts = {r["doc_id"]: (r["n"], r["text"], r["_mean"], r["a.b"]) for r in got.filter("source = 'tiny'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"), F.first("_mean").alias("_mean"), F.first("`a.b`").alias("a.b")).collect()}
    assert counts == {9999: (want, "x" * 100_000, 7, 7)}


def test_mixing_order_is_global(table):
    keys = [r["mix_key"] for r in mixing.mix(table([(k, "t", "a") for k in range(200)])).collect()]
    assert keys == sorted(keys)


def test_isotonic():
    got = quality.isotonic(np.array([1.0, 0.0, 0.5, 0.2, 0.9]), np.array([1.0, 1.0, 2.0, 2.0, 1.0]))
    assert np.all(np.diff(got) >= 0) and abs(got[0] - np.mean([1.0, 0.0, 0.5, 0.5, 0.2, 0.2])) < 1e-9 and got[-1] == 0.9


def test_quality_on_held_out_rows(spark, table, words):
    import random

    rnd = random.Random(1)
    rows, labels = [], []
    for k in range(600):
        good = rnd.random() < 0.7
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(5, 80))) if good else " ".join(rnd.choice(words) + "%%%" for _ in range(rnd.randint(5, 80)))
        rows.append((k, text))
        labels.append((k, int(good)))
    rows += [(700, None), (701, ""), (None, "x"), (5, rows[5][1]), (702, "long " * 20000)]
    labels += [(3, None), (None, 1), (6, labels[6][1])]
    got = quality.scores(table(rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    truth = dict(labels[:600])
    held = [r for r in got if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held) and len(held) > 80
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held if r["doc_id"] in truth]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_quality_system_against_numpy(spark, monkeypatch):
    """The ridge system of all rows at once, solved plainly, with parts added up two at a time."""
    monkeypatch.setattr(quality, "FAN_IN", 2)
    rng = np.random.default_rng(5)
    width = len(quality.STATISTICS)
    x, y = rng.normal(size=(200, width)) * rng.uniform(0.5, 5, width) + 3, rng.integers(0, 2, 200).astype(float)
    training = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y)], "stats array<double>, y double").repartition(9)
    model = quality.fit(training, features=16)
    assert model.mean == pytest.approx(x.mean(0)) and model.scale == pytest.approx(x.std(0))
    random = np.random.Generator(np.random.PCG64(9))
    directions, phases = random.normal(0, 1 / np.sqrt(width), (width, 16)), random.uniform(0, 2 * np.pi, 16)
    z = model.features(x)
    assert z[:, :16] == pytest.approx(np.sqrt(2 / 16) * np.cos((x - x.mean(0)) / x.std(0) @ directions + phases))
    ridge = quality.PENALTY * len(x) * np.eye(17)
    ridge[-1, -1] = 0
    assert model.weights == pytest.approx(np.linalg.solve(z.T @ z + ridge, z.T @ y), rel=1e-6, abs=1e-9)
    assert np.all(np.diff(model.score(x)[np.argsort(model.raw(x))]) >= -1e-12)


def test_quality_learns_nothing_from_held_out_labels(spark, table):
    rows = [(k, "a b c" if k % 2 else "x% y% z%") for k in range(100)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda l: {r["doc_id"]: round(r["score"], 9) for r in quality.scores(table(rows), l).collect()}
    assert score(labels) == score(flipped)


def test_quality_without_labels_or_rows(spark, table):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.scores(table([(1, "a"), (2, None)]), none).collect()} == {0.5}
    assert quality.scores(table([]), none).count() == 0
    docs = table([(1, "a"), (2, None)])
    assert quality.drop_rejected(docs, none).count() == 2 and quality.drop_rejected(docs, none).columns == docs.columns
