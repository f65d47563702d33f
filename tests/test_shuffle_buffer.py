"""The shuffle buffer against a sequential one, over restarts."""

from voxloom.streaming import shuffle_buffer as B


def one_by_one(stream, items, size, seed="shuffle"):
    """A buffer over a list of items; None ends it."""
    waiting, came, out = [], 0, []
    for item in items:
        if item is None:
            while waiting:
                k = B.number(len(waiting), seed, stream, came, "left", len(waiting))
                waiting[k], waiting[-1] = waiting[-1], waiting[k]
                out.append(waiting.pop())
            continue
        came += 1
        if len(waiting) < size:
            waiting.append(item)
        else:
            k = B.number(size, seed, stream, came)
            out.append(waiting[k])
            waiting[k] = item
    return out


def test_same_order_after_restarts(spark, tmp_path):
    streams = {"a": [f"a{k}" for k in range(90)] + [None] + [f"b{k}" for k in range(40)], "few": ["x", "y", None], "open": ["p", "q", "p"]}
    rows = [(s, k, i) for s, items in streams.items() for k, i in enumerate(items)]
    rows += [(None, 1, "lost")]
    orders = []
    for cuts in ([200], [0, 30, 31, 95, 200]):
        path = str(tmp_path / f"of{len(cuts)}")
        for low, high in zip([-1, *cuts], cuts):
            spark.createDataFrame([r for r in rows if low < r[1] <= high] or rows[:0], B.ROWS).repartition(3).write.mode("append").parquet(f"{path}/rows")
            B.run(spark.readStream.schema(B.ROWS).parquet(f"{path}/rows"), f"{path}/out", f"{path}/checkpoint", 7, 25)
        got = {}
        for r in spark.read.schema(B.SHUFFLED).parquet(f"{path}/out").orderBy("stream", "place").collect():
            assert r.place == len(got.setdefault(r.stream, [])) and r.epoch == r.place // 25
            got[r.stream].append(r.item)
        orders.append(got)
    want = {s: out for s, items in streams.items() if (out := one_by_one(s, items, 7))}
    assert orders[0] == want and orders[1] == want
    assert sorted(want["a"][:90]) == sorted(streams["a"][:90]) and want["a"][:90] != streams["a"][:90] and "open" not in want
