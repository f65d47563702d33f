"""A shuffle buffer as a stateful stream: rows wait in a buffer of bounded size and leave it in random order.

Rows are (stream, seq, item): one buffer a stream, filled in the order of
``seq``.  A row without an item ends its stream: what still waits leaves, and
the buffer is empty again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .append import to_table

ROWS = "stream string, seq long, item string"
SHUFFLED = "stream string, place long, epoch long, item string"


def number(below: int, *parts) -> int:
    """A number from 0 to ``below`` - 1 by a hash."""
    return int.from_bytes(hashlib.md5(":".join(map(str, parts)).encode()).digest()[:8], "big") % below


class Buffer(StatefulProcessor):
    """Per stream: the waiting items by slot, how many wait and how many have come and left; a batch reads only the slots that it draws."""

    def __init__(self, size: int, epoch: int, seed: str):
        self.size, self.epoch, self.seed = size, epoch, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot int", "item string")
        self.counts = handle.getValueState("counts", "waiting int, came long, gone long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told = pd.concat(list(rows)).sort_values(["seq", "item"], kind="stable", na_position="last")
        waiting, came, gone = self.counts.get() if self.counts.exists() else (0, 0, 0)
        began, seen, touched, left = waiting, {}, set(), []

        def held(slot: int) -> str:
            return seen[slot] if slot in seen else self.slots.getValue((slot,))[0]

        for item in told["item"].tolist():
            if item is None or item != item:
                while waiting:
                    slot = number(waiting, self.seed, key[0], came, "left", waiting)
                    left.append(held(slot))
                    waiting -= 1
                    if slot < waiting:  # the last one takes the place
                        seen[slot] = held(waiting)
                        touched.add(slot)
                continue
            came += 1
            if waiting < self.size:
                slot, waiting = waiting, waiting + 1
            else:
                slot = number(self.size, self.seed, key[0], came)
                left.append(held(slot))
            seen[slot] = item
            touched.add(slot)
        for slot in touched:
            if slot < waiting:
                self.slots.updateValue((slot,), (seen[slot],))
        for slot in range(waiting, began):
            self.slots.removeKey((slot,))
        self.counts.update((waiting, came, gone + len(left)))
        if left:
            places = range(gone, gone + len(left))
            yield pd.DataFrame({"stream": key[0], "place": places, "epoch": [p // self.epoch for p in places], "item": left})

    def close(self) -> None:
        pass


def shuffled(rows: DataFrame, size: int, epoch: int, seed: str = "shuffle") -> DataFrame:
    """(stream, place, epoch, item): the rows of a stream as they leave a buffer of ``size`` items, in epochs of ``epoch`` rows a stream.

    A row that comes when the buffer is full takes the place of one that
    leaves.  Which one is a hash of the stream and of how many came before,
    so a run that is taken up again from its checkpoint, or reads the same
    rows in other batches, gives the same order as long as a stream's rows
    come in the order of ``seq`` from batch to batch.  Rows with a null stream
    or seq are left out; repeated rows are shuffled as often as they come, and
    of rows of one seq the end comes last.  State is one small value and at
    most ``size`` items a stream; a hot source is dealt to several streams.
    """
    if size < 1 or epoch < 1:
        raise ValueError("a buffer and an epoch hold at least one row")
    kept = rows.filter("stream is not null and seq is not null").select("stream", F.col("seq").cast("long").alias("seq"), F.col("item").cast("string").alias("item"))
    return kept.groupBy("stream").transformWithStateInPandas(Buffer(size, epoch, seed), SHUFFLED, "append", "none")


def run(rows: DataFrame, table: str, checkpoint: str, size: int, epoch: int, seed: str = "shuffle") -> None:
    """Shuffle what has come into the Parquet table ``table``; call again to go on from ``checkpoint``."""
    to_table(shuffled(rows, size, epoch, seed), table, checkpoint)
