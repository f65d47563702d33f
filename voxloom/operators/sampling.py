"""Orders and batches of samples that don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tracks import numbered


def shuffled_batches(rows: DataFrame, key: str, size: int, seed: str = "0") -> DataFrame:
    """Rows in the order of a hash of ``key`` with their position and batch; numbered by range partitions, not in one task."""
    told = rows.withColumn("_order", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))))
    return numbered(told, ["_order", key], "position").withColumn("batch", F.floor((F.col("position") - 1) / size).cast("int")).drop("_order")


def by_view(rows: DataFrame, position: str, views: int) -> DataFrame:
    """A sample-major order split into (sample, view)."""
    return rows.withColumn("sample", F.floor(F.col(position) / views).cast("int")).withColumn("view", (F.col(position) % views).cast("int"))


def view_pairs(samples: DataFrame, students: str, teachers: str, skip_same: bool = False) -> DataFrame:
    """Each sample's student views beside its teacher views: ``i``, ``student``, ``j``, ``teacher``; with ``skip_same`` not those of one index.

    A sample's views are two arrays of fixed size, so its pairs stay in its row's task.
    """
    kept = [F.col(c) for c in samples.columns if c not in (students, teachers)]
    pairs = samples.select(*kept, teachers, F.posexplode(students).alias("i", "student")).select(*kept, "i", "student", F.posexplode(teachers).alias("j", "teacher"))
    return pairs.filter("i <> j") if skip_same else pairs


def batched(rows: DataFrame, position: str, size: int) -> DataFrame:
    """(batch, samples): runs of ``size`` rows as arrays of structs in the order of ``position`` (from 0)."""
    return rows.groupBy(F.floor(F.col(position) / size).cast("int").alias("batch")).agg(F.array_sort(F.collect_list(F.struct(position, *(c for c in rows.columns if c != position)))).alias("samples"))


def unbatched(batches: DataFrame) -> DataFrame:
    """The rows of batches again, with their place ``at`` in the batch."""
    return batches.select("batch", F.posexplode("samples").alias("at", "sample")).select("batch", "at", "sample.*")


def token_grid(samples: DataFrame, tokens: str, grid: tuple[int, int, int]) -> DataFrame:
    """A row for each token of an array, with its cell (z, y, x) in raster order; the array has as many as the grid."""
    _, height, width = grid
    n = grid[0] * height * width
    right = F.when(F.size(tokens) == n, F.col(tokens)).otherwise(F.raise_error(F.lit(f"tokens don't fill a grid of {n} cells")).cast(samples.schema[tokens].dataType))
    kept = [c for c in samples.columns if c != tokens]
    cell = samples.select(*kept, F.posexplode(right).alias("_t", "token"))
    return cell.select(*kept, F.floor(F.col("_t") / (height * width)).cast("int").alias("z"), (F.floor(F.col("_t") / width) % height).cast("int").alias("y"), (F.col("_t") % width).alias("x"), "token")


def ranked(rows: DataFrame, position: str, ranks: int) -> DataFrame:
    """Rows dealt to ranks in turn by their position (from 0), with ``rank`` and ``turn``; the first rows come again so that all ranks have as many."""
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    told = rows.crossJoin(F.broadcast(n))
    slots = F.sequence(F.col(position).cast("long"), F.ceil(F.col("_n") / ranks) * ranks - 1, F.col("_n"))
    return told.withColumn("_s", F.explode(slots)).withColumn("rank", (F.col("_s") % ranks).cast("int")).withColumn("turn", F.floor(F.col("_s") / ranks).cast("long")).drop("_s", "_n")
