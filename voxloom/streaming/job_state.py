"""Progress of jobs as a stateful stream: what is expected, reported, stopped and finished.

Events are rows (job_id, seq, kind, text) of the kinds ``expect`` (text: a path
that the job will save), ``line`` (text: a line of its log), ``stop`` (asked to
stop) and ``status`` (text: finished, failed or the like).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import strings as S
from .append import to_table

EVENTS = "job_id string, seq long, kind string, text string"
REPORT = "job_id string, seq long, status string, processed int, total int, current string"
#: Milliseconds for which a job that is over is remembered, so that late lines find it.
REMEMBERED = 7 * 24 * 3600 * 1000
#: Events of one seq in the order in which they count: what ends a job comes before the line that it came with.
TURN = {"expect": 0, "stop": 1, "status": 2, "line": 3}


class JobStates(StatefulProcessor):
    """Per job: the expected items that are open and done, and what was told last; one value is read and written a micro-batch.

    A stop or status ends a job: its items are given up, what it said last
    stays for a while, and whatever comes later changes nothing.
    """

    def __init__(self, remembered: int):
        self.remembered = remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.running = handle.getValueState("running", "open array<string>, done array<string>, current string")
        self.over = handle.getValueState("over", "status string", ttlDurationMs=self.remembered)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        events = events.assign(turn=events["kind"].map(TURN).fillna(len(TURN))).sort_values(["seq", "turn", "item"], kind="stable")
        if self.over.exists():
            return
        open_items, done, current = self.running.get() if self.running.exists() else ((), (), None)
        expected, done = {*open_items, *done}, set(done)
        status, last = "running", None
        for seq, kind, item in zip(events["seq"].tolist(), events["kind"].tolist(), events["item"].tolist()):
            if kind in ("stop", "status"):
                status, last = ("stopped" if kind == "stop" else item), seq
                break
            if item is None:
                continue
            if kind == "expect" and item not in expected:
                expected.add(item)
                last = seq
            elif kind == "line" and item in expected and item not in done:
                done.add(item)
                current, last = item, seq
        if last is None:
            return
        if status == "running":
            self.running.update((sorted(expected - done), sorted(done), current))
        else:
            self.over.update((status,))
            self.running.clear()
        yield pd.DataFrame({"job_id": [key[0]], "seq": [last], "status": [status], "processed": [len(done)], "total": [len(expected)], "current": [current]})

    def close(self) -> None:
        pass


def states(events: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    """Changes of the jobs of an event stream: job_id, seq (of the last event that counted), status, processed, total, current.

    Lines are read by SQL functions before the shuffle; those that report
    nothing saved stay behind.  Events count in the order of ``seq`` within a
    micro-batch (of one seq: expected items, stop, status, lines) and as they
    come across them.  Items that aren't expected or
    were reported before change nothing.  Rows with a null job, kind or seq
    are left out.
    """
    item = F.when(F.col("kind") == "line", S.reported(S.plain_line(F.col("text")))).otherwise(F.col("text"))
    told = events.select("job_id", "seq", "kind", item.alias("item")).filter("job_id is not null and seq is not null and kind is not null and (item is not null or kind = 'stop')")
    return told.groupBy("job_id").transformWithStateInPandas(JobStates(remembered), REPORT, "append", "processingTime")


def run(events: DataFrame, table: str, checkpoint: str, remembered: int = REMEMBERED) -> None:
    """Take in what has come and add the changes to the Parquet table ``table``; call again to go on from ``checkpoint``."""
    to_table(states(events, remembered), table, checkpoint)


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The last state of every job in a table of :func:`run`; what ended a job counts as its last."""
    rows = spark.read.schema(REPORT).parquet(table)
    # a job that runs on reports ever more; its end is one row
    newest = F.struct(F.col("status") != "running", "processed", "total", "seq")
    return rows.groupBy("job_id").agg(*(F.max_by(c, newest).alias(c) for c in ("seq", "status", "processed", "total", "current")))
