"""A store of token vectors by row number, in blocks, as a Spark data source.

A folder holds ``store.json`` (rows, width, kind of number, rows of a block) and
a file of raw numbers a block.  Reading a range of rows opens the blocks that
hold them and reads only their bytes; writing a range replaces the blocks that
it touches, other rows of them stay.  Rows never written are zeros.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .shards import file_system

ROWS = "row long, vec array<float>"


def _about(path: str) -> dict:
    system, inside = file_system(path)
    with system.open_input_stream(f"{inside}/store.json") as f:
        return json.loads(f.read())


def _block(inside: str, number: int) -> str:
    return f"{inside}/block-{number:08d}.bin"


@dataclass
class _Rows(InputPartition):
    block: int
    first: int
    last: int  # not included


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.about = path, _about(path)
        self.ranges = [(0, self.about["rows"])]

    def pushFilters(self, filters: list) -> Iterator:
        """Bounds of ``row`` become ranges; other filters stay with Spark."""
        lo, hi, chosen = 0, self.about["rows"], None
        for f in filters:
            bound = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("row",) or bound is None:
                yield f
            elif isinstance(f, GreaterThanOrEqual):
                lo = max(lo, bound)
            elif isinstance(f, GreaterThan):
                lo = max(lo, bound + 1)
            elif isinstance(f, LessThanOrEqual):
                hi = min(hi, bound + 1)
            elif isinstance(f, LessThan):
                hi = min(hi, bound)
            elif isinstance(f, EqualTo):
                lo, hi = max(lo, bound), min(hi, bound + 1)
            elif isinstance(f, In):
                wanted = {v for v in bound if v is not None}
                chosen = wanted if chosen is None else chosen & wanted
            else:
                yield f
        self.ranges = [(lo, hi)] if chosen is None else [(r, r + 1) for r in sorted(chosen) if lo <= r < hi]

    def partitions(self) -> list[InputPartition]:
        size = self.about["block"]
        parts = [_Rows(b, max(lo, b * size), min(hi, (b + 1) * size)) for lo, hi in self.ranges if lo < hi for b in range(lo // size, (hi - 1) // size + 1)]
        return parts or [_Rows(-1, 0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        n = partition.last - partition.first
        if n <= 0:
            return
        from pyarrow import fs

        system, inside = file_system(self.path)
        kind, width = np.dtype(self.about["dtype"]), self.about["width"]
        if system.get_file_info(_block(inside, partition.block)).type == fs.FileType.NotFound:
            values = np.zeros((n, width), np.float32)
        else:
            with system.open_input_file(_block(inside, partition.block)) as f:
                f.seek((partition.first - partition.block * self.about["block"]) * width * kind.itemsize)
                values = np.frombuffer(f.read(n * width * kind.itemsize), kind).reshape(n, width).astype(np.float32)
        vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first, partition.last)), vec], names=["row", "vec"])


@dataclass
class _Blocks(WriterCommitMessage):
    blocks: list[tuple[int, str]]


class _Writer(DataSourceArrowWriter):
    """Tasks hold whole blocks in order of rows and write new versions of them beside the old; the commit puts them in place."""

    def __init__(self, path: str):
        self.path, self.about, self.job = path, _about(path), f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyarrow import fs
        from pyspark import TaskContext

        system, inside = file_system(self.path)
        kind, width, size = np.dtype(self.about["dtype"]), self.about["width"], self.about["block"]
        folder = f"{inside}/{self.job}"
        system.create_dir(folder, recursive=True)
        done, number, values = [], None, None

        def close():
            if number is not None:
                path = f"{folder}/{number:08d}-{TaskContext.get().taskAttemptId()}.bin"
                with system.open_output_stream(path) as f:
                    f.write(values.tobytes())
                done.append((number, path))

        for batch in iterator:
            vectors = batch.column(batch.schema.get_field_index("vec"))
            for row, vec in zip(batch.column(batch.schema.get_field_index("row")).to_pylist(), vectors):
                if not 0 <= row < self.about["rows"] or len(vec) != width:
                    raise ValueError(f"row {row} of {len(vec)} numbers isn't one of {self.about['rows']} rows of {width}")
                if row // size != number:
                    close()
                    number = row // size
                    rows = min(size, self.about["rows"] - number * size)
                    if system.get_file_info(_block(inside, number)).type == fs.FileType.NotFound:
                        values = np.zeros((rows, width), kind)
                    else:
                        with system.open_input_stream(_block(inside, number)) as f:
                            values = np.frombuffer(f.read(), kind).reshape(rows, width).copy()
                values[row - number * size] = vec.values.to_numpy(zero_copy_only=False).astype(kind)
        close()
        return _Blocks(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, inside = file_system(self.path)
        for message in messages:
            for number, path in message.blocks if message else []:
                system.move(path, _block(inside, number))
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, inside = file_system(self.path)
        if system.get_file_info(f"{inside}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{inside}/{self.job}")


class TokenStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_store"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def create(path: str, rows: int, width: int, dtype: str = "float32", block: int = 16384) -> None:
    """A store of zeros; nothing but its description is written."""
    if rows < 0 or width < 1 or block < 1 or np.dtype(dtype).kind != "f":
        raise ValueError("a store needs a width, blocks of rows and a kind of floating-point number")
    system, inside = file_system(path)
    system.create_dir(inside, recursive=True)
    with system.open_output_stream(f"{inside}/store.json") as f:
        f.write(json.dumps({"rows": rows, "width": width, "dtype": str(np.dtype(dtype)), "block": block}).encode())


def read_rows(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """(row, vec) of the rows from ``start`` (included) to ``end`` (not included), as single-precision numbers.

    Bounds given here or in later filters of ``row`` reach the source: a task a
    block that holds such rows, reading only their bytes.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenStore)
    rows = spark.read.format("token_store").load(path)
    for bound in ([F.col("row") >= start] if start is not None else []) + ([F.col("row") < end] if end is not None else []):
        rows = rows.filter(bound)
    return rows


def write_rows(tokens: DataFrame, path: str) -> None:
    """Put vectors (row, vec) into their rows, cast to the store's kind of number.

    Each block is written by one task.  Of rows that repeat a number one stays;
    a row or width outside the store fails and changes nothing.  A second
    writer of the same blocks at the same time isn't allowed.
    """
    tokens.sparkSession.dataSource.register(TokenStore)
    size = _about(path)["block"]
    blocks = tokens.select(F.col("row").cast("long"), F.col("vec").cast("array<float>")).repartition(F.floor(F.col("row") / size)).sortWithinPartitions("row")
    blocks.write.format("token_store").mode("append").save(path)
