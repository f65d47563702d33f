"""Progress of jobs as a stateful stream, over restarts."""

from voxloom.streaming import job_state

SAVED = "\x1b[32mSaved features to /out/{}.npy\x1b[0m\r\n"


def test_what_comes_after_a_stop_changes_nothing(spark, tmp_path):
    """Three starts on one checkpoint: repeats, unexpected paths, events out of order, stops, ends and late lines."""
    path = str(tmp_path)

    def take_in(*rows):
        spark.createDataFrame(rows, job_state.EVENTS).coalesce(1).write.mode("append").parquet(f"{path}/events")
        job_state.run(spark.readStream.schema(job_state.EVENTS).parquet(f"{path}/events"), f"{path}/states", f"{path}/checkpoint")
        return {r.job_id: tuple(r)[1:] for r in job_state.latest(spark, f"{path}/states").collect()}

    line = lambda job, seq, name: (job, seq, "line", SAVED.format(name))
    expect = [(j, k, "expect", f"/out/{n}.npy") for j in ("a", "b", "c") for k, n in enumerate("xyz")]
    got = take_in(*expect, line("a", 10, "x"), line("a", 11, "x"), line("a", 12, "w"), line("b", 12, "z"), ("b", 11, "stop", None), line("b", 10, "y"), (None, 1, "stop", None), ("d", None, "line", "x"), ("e", 5, "line", "nothing"), line("f", 1, "x"))
    assert got == {"a": (10, "running", 1, 3, "/out/x.npy"), "b": (11, "stopped", 1, 3, "/out/y.npy"), "c": (2, "running", 0, 3, None)}
    # b was stopped in the last start: late lines, an end and new items find it over; a goes on where it was
    got = take_in(line("b", 20, "x"), ("b", 21, "status", "finished"), ("b", 22, "expect", "/out/v.npy"), line("a", 13, "x"), line("a", 14, "y"), line("c", 14, "x"), ("c", 15, "status", "failed"), line("c", 16, "y"))
    assert got == {"a": (14, "running", 2, 3, "/out/y.npy"), "b": (11, "stopped", 1, 3, "/out/y.npy"), "c": (15, "failed", 1, 3, "/out/x.npy")}
    got = take_in(line("a", 15, "z"), ("a", 16, "status", "finished"), line("c", 30, "z"))
    assert got["a"] == (16, "finished", 3, 3, "/out/z.npy") and got["c"] == (15, "failed", 1, 3, "/out/x.npy")
    assert spark.read.parquet(f"{path}/states").count() == 6  # reports of changes only


def test_a_job_is_forgotten_in_the_end(spark, tmp_path):
    """Once its time is over nothing of a job is kept; lines without expected items still count for nothing."""
    path = str(tmp_path)
    for k, rows in enumerate(([("a", 0, "expect", "/out/x.npy"), ("a", 1, "stop", None)], [("a", 2, "line", SAVED.format("x"))])):
        spark.createDataFrame(rows, job_state.EVENTS).coalesce(1).write.mode("append").parquet(f"{path}/events")
        job_state.run(spark.readStream.schema(job_state.EVENTS).parquet(f"{path}/events"), f"{path}/states", f"{path}/checkpoint", remembered=1)
    assert [tuple(r) for r in job_state.latest(spark, f"{path}/states").collect()] == [("a", 1, "stopped", 0, 1, None)]


def test_a_stop_comes_before_the_line_of_its_number(spark, tmp_path):
    """Whatever order a shuffle brings: a line with the stop's own number isn't counted."""
    expect = [("a", 0, "expect", "/out/x.npy"), ("a", 0, "expect", "/out/y.npy")]
    ends = [("a", 2, "stop", None), ("a", 2, "line", SAVED.format("y"))]
    for k, rows in enumerate(([*expect, *ends], [*ends[::-1], *expect])):
        path = f"{tmp_path}/{k}"
        spark.createDataFrame([("a", 1, "line", SAVED.format("x")), *rows], job_state.EVENTS).coalesce(1).write.parquet(f"{path}/events")
        job_state.run(spark.readStream.schema(job_state.EVENTS).parquet(f"{path}/events"), f"{path}/states", f"{path}/checkpoint")
        assert [tuple(r) for r in job_state.latest(spark, f"{path}/states").collect()] == [("a", 2, "stopped", 1, 2, "/out/x.npy")]
