"""Tar shards: samples of some files each, in numbered archives, as a Spark data source.

    spark.dataSource.register(TarShards)
    spark.read.format("tar_shards").load("/data/a/dataset-{000000..000868}.tar::/data/b/dataset-{000000..000778}.tar")
    samples.write.format("tar_shards").option("maxsize", 10**9).mode("append").save("/data/c")

A sample is a row (key, files): the files ``key.extension`` of an archive that
follow each other.  Paths are those of ``pyarrow.fs``: local ones, ``file:``,
``hdfs:``, ``s3:`` and so on, seen by the driver and all executors.
"""

from __future__ import annotations

import io
import os
import re
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SAMPLE = "shard string, place int, key string, files map<string, binary>"
#: Bytes of content that a task gathers before it hands them on.
BATCH_BYTES = 16 << 20
NAME = "dataset-{:06d}.tar"
_NAME = re.compile(r"dataset-\d+\.tar$")


def expanded(pattern: str) -> list[str]:
    """The paths of ``::``-joined patterns with ``{first..last}`` ranges (both ends included) and ``{a,b}`` lists, in order.

    A range keeps the width of its first number when that is padded with zeros.
    """
    out = []
    for one in pattern.split("::"):
        fixed = re.split(r"\{([^{}]*)\}", one)
        choices = []
        for k, part in enumerate(fixed):
            numbers = re.match(r"(\d+)\.\.(\d+)$", part) if k % 2 else None
            if numbers:
                first, last = numbers.groups()
                step = 1 if int(first) <= int(last) else -1
                choices.append([str(n).zfill(len(first)) for n in range(int(first), int(last) + step, step)])
            else:
                choices.append(part.split(",") if k % 2 else [part])
        out += ["".join(c) for c in product(*choices)]
    return [p for p in out if p]


def file_system(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else os.path.abspath(path))


def split_name(name: str) -> tuple[str, str]:
    """Key and extension: the base name is cut at its first dot, folders belong to the key."""
    folder, _, base = name.rpartition("/")
    stem, _, extension = base.partition(".")
    return (f"{folder}/{stem}" if folder else stem), extension.lower()


def samples_of(stream) -> Iterator[tuple[str, dict[str, bytes]]]:
    """Samples of an archive that is read once from front to end; files without an extension or with a leading dot are none."""
    key, files = None, {}
    with tarfile.open(fileobj=stream, mode="r|") as archive:
        for member in archive:
            if not member.isfile() or os.path.basename(member.name).startswith("."):
                continue
            name, extension = split_name(member.name)
            if not extension:
                continue
            if name != key:
                if files:
                    yield key, files
                key, files = name, {}
            if extension in files:
                raise ValueError(f"{member.name} is twice in its sample")
            files[extension] = archive.extractfile(member).read()
    if files:
        yield key, files


@dataclass
class _Shard(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        paths = expanded(self.options["path"])
        draws = int(self.options.get("draws", 0))
        if draws and paths:  # with replacement, as by a generator that starts anew for each draw
            import random

            seed = self.options.get("seed", "0")
            paths = [paths[random.Random(f"{seed}:{k}").randrange(len(paths))] for k in range(draws)]
        return [_Shard(p) for p in paths]

    def read(self, partition: _Shard) -> Iterator[pa.RecordBatch]:
        system, inside = file_system(partition.path)
        schema = pa.schema([("shard", pa.string()), ("place", pa.int32()), ("key", pa.string()), ("files", pa.map_(pa.string(), pa.binary()))])
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        with system.open_input_stream(inside) as stream:
            for place, (key, files) in enumerate(samples_of(stream)):
                rows.append((partition.path, place, key, list(files.items())))
                size += sum(map(len, files.values()))
                if size >= BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


@dataclass
class _Written(WriterCommitMessage):
    task: int
    paths: list[str]


class _Writer(DataSourceArrowWriter):
    """Tasks write archives under a name of the job; the commit numbers them after those that are there."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.maxsize, self.overwrite = options["path"].rstrip("/"), int(float(options.get("maxsize", 1e9))), overwrite
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, inside = file_system(self.path)
        context = TaskContext.get()
        folder = f"{inside}/{self.job}"
        system.create_dir(folder, recursive=True)
        paths, size, archive, stream = [], 0, None, None
        for batch in iterator:
            keys, files = batch.column(batch.schema.get_field_index("key")), batch.column(batch.schema.get_field_index("files"))
            for key, content in zip(keys, files):
                if archive is not None and size >= self.maxsize:
                    archive.close()
                    stream.close()
                    archive = None
                if archive is None:
                    paths.append(f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}-{len(paths):06d}.tar")
                    stream = system.open_output_stream(paths[-1])
                    archive, size = tarfile.open(fileobj=stream, mode="w|"), 0
                for extension, data in sorted(content.as_py() or []):
                    about = tarfile.TarInfo(f"{key.as_py()}.{extension}")
                    about.size = len(data or b"")
                    archive.addfile(about, io.BytesIO(data or b""))
                    size += 512 + -(-about.size // 512) * 512
        if archive is not None:
            archive.close()
            stream.close()
        return _Written(context.partitionId(), paths)

    def _shards(self, system, inside: str) -> list[str]:
        from pyarrow import fs

        return [f.path for f in system.get_file_info(fs.FileSelector(inside, allow_not_found=True)) if _NAME.search(f.path)]

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, inside = file_system(self.path)
        there = self._shards(system, inside)
        if self.overwrite:
            for old in there:
                system.delete_file(old)
            there = []
        numbers = [int(re.search(r"(\d+)\.tar$", p)[1]) for p in there]
        number = max(len(there), max(numbers, default=-1) + 1)
        for message in sorted((m for m in messages if m), key=lambda m: m.task):
            for path in message.paths:
                system.move(path, f"{inside}/{NAME.format(number)}")
                number += 1
        self._clean(system, inside)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean(*file_system(self.path))

    def _clean(self, system, inside: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{inside}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{inside}/{self.job}")  # also what failed or repeated attempts left


class TarShards(DataSource):
    """Options: path; reading: draws (number of shards drawn with replacement, in place of each once) and seed; writing: maxsize (bytes after which a shard is full)."""

    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def schema(self) -> str:
        return SAMPLE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def read_shards(spark: SparkSession, pattern: str, draws: int = 0, seed: str = "0") -> DataFrame:
    """Samples of the shards of a pattern, a task a shard: shard, place (in the shard), key, files.

    With ``draws`` as many shards are drawn with replacement.  A missing or
    broken archive fails the job; an empty one has no samples.
    """
    spark.dataSource.register(TarShards)
    reader = spark.read.format("tar_shards").option("seed", seed)
    return (reader.option("draws", draws) if draws else reader).load(pattern)


def written_shards(path: str) -> str:
    """The shards of a folder, in order, as a pattern that :func:`read_shards` takes."""
    from pyarrow import fs

    system, inside = file_system(path)
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(inside, allow_not_found=True)) if _NAME.search(f.path))
    return "::".join(f"{path.rstrip('/')}/{n}" for n in names)


def write_shards(samples: DataFrame, path: str, maxsize: int = 10**9, overwrite: bool = False) -> None:
    """Add samples (key, files) to the shards of a folder, numbered after the last one there.

    Shards appear only when all tasks have succeeded; what failed or repeated
    attempts wrote goes.  A task's samples stay in order; a shard is full once
    it holds ``maxsize`` bytes.
    """
    samples.sparkSession.dataSource.register(TarShards)
    writer = samples.select(F.col("key").cast("string"), F.col("files").cast("map<string, binary>")).write.format("tar_shards").option("maxsize", maxsize)
    writer.mode("overwrite" if overwrite else "append").save(path)
