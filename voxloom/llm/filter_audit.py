"""How filters interact: what each one removes, at each place of each order, and what it alone would.

Every document gets a mask of the filters that it fails, whatever the order.
Duplicates among them come from a sort: documents are ranged by fingerprint and
id, so that a group of copies of any size is cut where a partition ends, and
sorted by fingerprint, full text and id; a row is compared with the one before.
The groups that a boundary may cut are settled among their first rows, one a
partition.  Counts by (part, mask) are additive: every figure of every order is
a sum of some of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import input_bytes, shuffle_partitions, written

FILTERS = "ABCDE"
#: The bit of the filter of duplicates.
COPY = 1 << FILTERS.index("E")
#: Bytes of the table's files that one task sorts.
TASK_BYTES = 32 << 20

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SIGNS = b"#$%&*|"
#: Bytes of UTF-8 that begin no code point.
_LATER = bytes(range(0x80, 0xC0))

_ROWS = "doc_id long, part string, mask int, print long, body binary"
_REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_failures(text: bytes) -> int:
    """The mask of the filters A to D, which look at one text (UTF-8)."""
    words = text.split()  # of bytes: at runs of ASCII white space
    short = len(words) < 200
    repeats = 100 * len(set(words)) < 50 * len(words)
    capitals = 100 * (len(text) - len(text.translate(None, _UPPER))) > 3 * len(text.translate(None, _LATER))
    signs = len(text.translate(None, _SIGNS)) < len(text)
    return short | repeats << 1 | capitals << 2 | signs << 3


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted partition: masks of its rows.

    The first row of each text whose fingerprint is the partition's first or
    last keeps its text, as other partitions may hold copies.
    """
    first = last = body = least = None
    waiting: list[tuple] = []  # first rows of the texts of the present fingerprint, if that is not the partition's first
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("print", pa.int64()), ("body", pa.binary())])
    as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    for batch in batches:
        out = []
        ids, parts, prints = (batch.column(k).to_pylist() for k in range(3))
        for k, (doc_id, part, mark) in enumerate(zip(ids, parts, prints)):
            text = batch.column(3)[k].as_py()
            if first is None:
                first = mark
            if mark != last:
                out += [(*r[:3], None, None) for r in waiting]
                waiting = []
            if mark != last or text != body:
                body, least = text, doc_id
            last = mark
            mask = own_failures(text)
            if doc_id == least:  # the text's smallest id in this partition, or none
                row = (doc_id, part, mask, mark, text)
                if mark == first:
                    out.append(row)
                else:
                    waiting.append(row)
            else:
                # ids that are null come last and have no smaller one
                out.append((doc_id, part, mask | COPY * (doc_id is not None), None, None))
        if out:
            yield as_batch(out)
    if waiting:
        yield as_batch(waiting)


def failures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id``, ``part`` and ``mask`` of every row; bit k of the mask is filter k of ``FILTERS``.

    Null text is empty (it fails A, and E if a smaller id's is empty too), null
    parts are the empty string.  A row with a null id fails no E and makes no
    other row fail it; rows that repeat id and text don't make each other fail.
    Whole texts are read and compared, of any length.  Other columns, whatever
    their names, are not read; an empty table gives no rows.
    """
    n = max(shuffle_partitions(docs.sparkSession), input_bytes(docs) // TASK_BYTES)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("print"), F.coalesce(text_col, F.lit("")).cast("binary").alias("body"),
    )
    in_order = rows.repartitionByRange(n, F.col("print"), F.col("doc_id").asc_nulls_last()).sortWithinPartitions("print", "body", F.col("doc_id").asc_nulls_last())
    marked = written(in_order.mapInArrow(_compared, _ROWS), "failures")
    firsts = marked.filter("print is not null").withColumn("least", F.min("doc_id").over(Window.partitionBy("print", "body")))
    settled = firsts.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(F.col("least") < F.col("doc_id"), COPY).otherwise(0)).alias("mask"))
    return marked.filter("print is null").select("doc_id", "part", "mask").unionByName(settled)


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows by ``part`` and ``mask``: how many (n), how many with quality 1 (good) and how many toxic ones.

    A document counts as labelled if any of its rows in ``labels`` says so;
    those without a row or id, and null labels, count as neither.
    """
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counted = [F.count(F.lit(1)).alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic"))]
    return masks.join(marks, "doc_id", "left").groupBy("part", "mask").agg(*counted)


def _figures() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) and, for each figure, which masks (weighted) it sums."""
    masks = np.arange(1 << len(FILTERS))
    sizes = np.array([bin(m).count("1") for m in masks])
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps, sums = [], {k: [] for k in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    for order in orders:
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails, gone = masks & bit > 0, masks & before > 0
            steps.append((order, step))
            sums["kept"].append(masks & (before | bit) == 0)
            sums["removed"].append(fails & ~gone)
            sums["redundant"].append(fails & gone)
            sums["unique_fails"].append(masks == bit)
            # of all orders, the filter comes first among those that a document fails in one of as many as these are
            sums["shapley"].append(np.where(fails, len(orders) // np.maximum(sizes, 1), 0))
            before |= bit
    return steps, {k: np.array(v, np.int64) for k, v in sums.items()}


def report(counts: DataFrame) -> DataFrame:
    """Every figure of every part, order and step from :func:`counters`, zeros included."""

    def figures(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, sums = _figures()
        for table in tables:
            for part, cells in zip(table["part"], table["cells"]):
                n, good, toxic = np.zeros((3, 1 << len(FILTERS)), np.int64)
                for c in cells:
                    n[c["mask"]], good[c["mask"]], toxic[c["mask"]] = c["n"], c["good"], c["toxic"]
                out = pd.DataFrame(steps, columns=["filter_order", "step"])
                for k, chosen in sums.items():
                    out[k] = chosen @ n
                out["good_lost"], out["toxic_lost"], out["part"] = sums["removed"] @ good, sums["removed"] @ toxic, part
                yield out[[f.split()[0] for f in _REPORT.split(", ")]]

    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    return cells.mapInPandas(figures, _REPORT)


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The figures of all orders of the five filters over ``docs``.

    One row per part, order and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley (see :func:`failures` and
    :func:`counters` for nulls, repeats and empty tables: no rows).
    """
    return report(counters(failures(docs, **columns), labels))
