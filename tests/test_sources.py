"""Data sources: tar shards and the token store."""

import io
import os
import random
import tarfile

import numpy as np
import pytest

from voxloom.sources import shards, token_store

FAILED = "failed-once"


def test_expanded():
    assert shards.expanded("a-{008..010}.tar::b/{x,y}-{1..2}.tar") == ["a-008.tar", "a-009.tar", "a-010.tar", "b/x-1.tar", "b/x-2.tar", "b/y-1.tar", "b/y-2.tar"]
    assert shards.expanded("plain.tar") == ["plain.tar"] and shards.expanded("{3..1}") == ["3", "2", "1"] and shards.expanded("") == []


def test_samples_as_others_write_them(spark, tmp_path):
    """Folders, several dots, files that belong to no sample, samples that aren't neighbours, an empty archive."""
    with tarfile.open(tmp_path / "s-0.tar", "w") as t:
        for name, data in [("d/a.npy", b"1"), ("d/a.meta.json", b"2"), ("d/.hidden", b"3"), ("README", b"4"), ("b.npy", b""), ("d/a.npy", b"5")]:
            about = tarfile.TarInfo(name)
            about.size = len(data)
            t.addfile(about, io.BytesIO(data))
    tarfile.open(tmp_path / "s-1.tar", "w").close()
    got = shards.read_shards(spark, f"{tmp_path}/s-{{0..1}}.tar").orderBy("place")
    assert [(r.place, r.key, {k: bytes(v) for k, v in r.files.items()}) for r in got.collect()] == [(0, "d/a", {"npy": b"1", "meta.json": b"2"}), (1, "b", {"npy": b""}), (2, "d/a", {"npy": b"5"})]
    assert got.rdd.getNumPartitions() >= 1 and shards.read_shards(spark, f"{tmp_path}/s-{{0..1}}.tar").rdd.getNumPartitions() == 2


def samples(spark, n, first=0, parts=3):
    rnd = random.Random(8)
    rows = [(f"k{i:04d}", {"npy": bytearray(rnd.randbytes(rnd.randint(0, 3000))), "json": bytearray(b"{}")}) for i in range(first, first + n)]
    return rows, spark.createDataFrame(rows, "key string, files map<string, binary>").repartition(parts)


def plain(rows):
    return sorted((r["key"] if not isinstance(r, tuple) or hasattr(r, "key") else r[0], sorted((k, bytes(v)) for k, v in (r["files"] if hasattr(r, "key") else r[1]).items())) for r in rows)


def test_round_trip_and_numbers_go_on(spark, tmp_path):
    path = str(tmp_path / "out")
    one, df = samples(spark, 60)
    shards.write_shards(df, path, maxsize=20000)
    first = sorted(os.listdir(path))
    assert first == [f"dataset-{k:06d}.tar" for k in range(len(first))] and len(first) > 3
    two, df = samples(spark, 20, 60)
    shards.write_shards(df, f"file://{path}", maxsize=10**9)
    names = sorted(os.listdir(path))
    assert names[: len(first)] == first and len(names) == len(first) + 3
    got = shards.read_shards(spark, f"{path}/dataset-{{000000..{len(names) - 1:06d}}}.tar").collect()
    assert plain(got) == plain(one + two)
    drawn = shards.read_shards(spark, f"{path}/dataset-{{000000..{len(names) - 1:06d}}}.tar", draws=40, seed="s").select("shard").collect()
    again = shards.read_shards(spark, f"{path}/dataset-{{000000..{len(names) - 1:06d}}}.tar", draws=40, seed="s").select("shard").collect()
    assert sorted(drawn) == sorted(again) and len({r.shard for r in drawn}) > 3
    shards.write_shards(df, path, overwrite=True)
    assert len(os.listdir(path)) == 3


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    """A task dies after its neighbours wrote: no shard appears, old ones stay; the next run is whole."""
    from pyspark.sql import functions as F

    path = str(tmp_path / "out")
    rows, df = samples(spark, 30)
    shards.write_shards(df, path)
    before = sorted(os.listdir(path))
    broken = df.withColumn("key", F.when(F.col("key") == "k0017", F.raise_error(F.lit("lost"))).otherwise(F.col("key")))
    with pytest.raises(Exception, match="lost"):
        shards.write_shards(broken, path)
    assert sorted(os.listdir(path)) == before
    shards.write_shards(df, path)
    assert len(os.listdir(path)) == 6


def test_attempts_that_are_repeated_count_once(tmp_path):
    """What a lost attempt wrote isn't committed."""
    path = str(tmp_path)
    writer = shards._Writer({"path": path}, False)
    for attempt in (1, 2):
        os.makedirs(f"{path}/{writer.job}", exist_ok=True)
        with open(f"{path}/{writer.job}/000000-{attempt}-000000.tar", "wb") as f:
            f.write(b"%d" % attempt)
    writer.commit([shards._Written(0, [f"{path}/{writer.job}/000000-2-000000.tar"]), None])
    assert os.listdir(path) == ["dataset-000000.tar"] and open(f"{path}/dataset-000000.tar", "rb").read() == b"2"


def test_store_ranges(spark, tmp_path):
    path = str(tmp_path / "store")
    token_store.create(path, rows=100, width=3, dtype="float16", block=8)
    values = np.random.default_rng(1).standard_normal((100, 3)).astype(np.float16)
    frame = lambda rows: spark.createDataFrame([(r, [float(x) for x in values[r]]) for r in rows], "row long, vec array<float>")
    read = lambda *a: {r.row: r.vec for r in token_store.read_rows(spark, path, *a).collect()}
    token_store.write_rows(frame(range(10, 50)), path)
    assert sorted(os.listdir(path)) == [*(f"block-{k:08d}.bin" for k in range(1, 7)), "store.json"]
    got = read()
    assert len(got) == 100 and got[9] == [0, 0, 0] and got[99] == [0, 0, 0] and all(got[r] == values[r].tolist() for r in range(10, 50))
    values[20:60] += 1  # an overlapping range: rows of the same blocks outside it stay
    stay = values.copy()
    token_store.write_rows(frame(range(20, 60)), path)
    got = read(15, 60)
    assert sorted(got) == list(range(15, 60)) and all(got[r] == stay[r].tolist() for r in got)


def test_a_range_opens_only_its_blocks(spark, tmp_path):
    path = str(tmp_path / "store")
    token_store.create(path, rows=1000, width=2, block=10)
    token_store.write_rows(spark.range(1000).selectExpr("id as row", "array(id, -id) as vec"), path)
    for number in [*range(0, 12), *range(18, 100)]:  # whoever opens one of these fails
        with open(f"{path}/block-{number:08d}.bin", "wb") as f:
            f.write(b"?")
    some = token_store.read_rows(spark, path, 125, 176)
    assert some.rdd.getNumPartitions() == 6 and [r.row for r in some.orderBy("row").collect()] == list(range(125, 176))
    few = token_store.read_rows(spark, path).filter("row in (130, 171) and vec[0] > 140")
    assert [r.vec for r in few.collect()] == [[171.0, -171.0]] and few.rdd.getNumPartitions() == 2
    assert token_store.read_rows(spark, path).filter("row = 2000").count() == 0


def test_rows_outside_fail_and_change_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    token_store.create(path, rows=10, width=2, block=4)
    for bad in (["cast(10 as long) as row", "array(1f, 2f) as vec"], ["cast(3 as long) as row", "array(1f) as vec"]):
        with pytest.raises(Exception, match="isn't one of"):
            token_store.write_rows(spark.range(1).selectExpr(*bad), path)
    assert os.listdir(path) == ["store.json"]
    with pytest.raises(ValueError):
        token_store.create(path, 1, 0)
