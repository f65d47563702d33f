"""What a run leaves behind: managed files, metric lines, reports, densities, blocks of rows, arrays."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed names of what feature extraction manages below its output folder.
MANAGED = ("lr_feats", "raw", "tmp", "norm_per_vol.txt")


def _top(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def managed(path: Column) -> Column:
    """Whether a path relative to the output folder is deleted before a run that overwrites; all else stays."""
    return _top(path).isin(*MANAGED)


def requested(path: Column, pca: Column, components: Column, high_resolution: Column) -> Column:
    """Whether a relative path is among the outputs that a run was asked to make anew: one PCA folder, the high-resolution folder."""
    return (pca & (_top(path) == F.concat(F.lit("pca_"), components.cast("string")))) | (high_resolution & (_top(path) == "hr_feats"))


def metric_lines(medians: DataFrame, times: DataFrame) -> DataFrame:
    """(iteration, line): a JSON line for every iteration in ``times``, its times first, then its meters by name.

    medians: name, iteration, median; times: iteration, iter_time, data_time.
    A meter without a value is left out.
    """
    told = medians.filter("median IS NOT NULL").groupBy("iteration").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "median"))))).alias("meters"))
    head = F.to_json(F.struct("iteration", "iter_time", "data_time"))
    line = F.when(F.col("meters").isNull(), head).otherwise(F.concat(F.regexp_replace(head, r"\}$", ","), F.regexp_replace("meters", r"^\{", "")))
    return times.join(told, "iteration", "left").select("iteration", line.alias("line"))


def append_lines(lines: DataFrame, path: str) -> None:
    """Append metric lines to a table of JSON lines, in order of the iterations inside each file."""
    lines.repartitionByRange("iteration").sortWithinPartitions("iteration").select("line").write.mode("append").text(path)


def report(stats: DataFrame) -> DataFrame:
    """(list, text): the Markdown section of each list of experiments. stats: list, size, tifs, one row an experiment."""
    giga = float(1 << 30)
    r = stats.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("tifs").alias("tifs"))
    told = lambda c, places: F.format_string(f"%.{places}f", F.bround(c, places))
    lines = [
        F.concat(F.lit("## File: "), "list", F.lit("\n")),
        F.concat(F.lit("- Experiments: "), F.col("n").cast("string"), F.lit("\n")),
        F.concat(F.lit("- Total data: "), told(F.col("size") / giga, 2), F.lit(" GB\n")),
        F.concat(F.lit("- Avg z-frames (TIFs) per experiment: "), told(F.col("tifs") / F.col("n"), 1), F.lit("\n")),
        F.concat(F.lit("- Avg size per experiment: "), told(F.col("size") / F.col("n") / giga, 2), F.lit(" GB\n")),
    ]
    return r.select("list", F.concat_ws("\n", *lines).alias("text"))


def write_densities(density: DataFrame, path: str) -> None:
    """Densities (c, cls, i, x, f) as compressed Parquet by channel, single precision."""
    density.select("c", "cls", "i", F.col("x").cast("float").alias("x"), F.col("f").cast("float").alias("f")).write.mode("overwrite").partitionBy("c").parquet(path)


def read_densities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("c", "cls", "i", F.col("x").cast("float").alias("x"), F.col("f").cast("float").alias("f"))


def row_blocks(total: Column, block: int) -> Column:
    """The half-open blocks (first, past) of rows 0 up to ``total``; none for no rows."""
    if block <= 0:
        raise ValueError("a block has at least one row")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(total.cast("long") - 1, F.lit(0).cast("long")), F.lit(block).cast("long"))
    spans = F.transform(starts, lambda s: F.struct(s.alias("first"), F.least(s + block, total.cast("long")).alias("past")))
    return F.filter(spans, lambda s: s["first"] < s["past"])


def permuted(voxels: DataFrame, axes: str) -> DataFrame:
    """Voxels with their axes in another order: ``axes`` names, for z, y and x in turn, the axis that takes the place."""
    if sorted(axes) != ["x", "y", "z"]:
        raise ValueError("the axes are z, y and x, each once")
    return voxels.withColumns(dict(zip("zyx", (F.col(a) for a in axes))))


def each_named(df: DataFrame, steps: dict[str, list[Callable[[Column], Column]]]) -> DataFrame:
    """Each named column through its own steps; an unknown name is an error, other columns stay."""
    if missing := sorted(set(steps) - set(df.columns)):
        raise ValueError(f"no columns {missing}")
    out = {}
    for name, functions in steps.items():
        c = F.col(name)
        for f in functions:
            c = f(c)
        out[name] = c
    return df.withColumns(out)


def write_npy(voxels: DataFrame, shape: tuple[int, int, int], folder: str) -> DataFrame:
    """(tp, path): each volume as one ``.npy`` file in a folder that all executors see; absent voxels are 0.

    A volume is one group, as its file is.  A file gets its name when it is
    whole, so a task that is run again does no harm.
    """

    def save(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import os
        import uuid

        import numpy as np

        a = np.zeros(shape, np.float32)
        a[rows.z, rows.y, rows.x] = rows.v
        os.makedirs(folder, exist_ok=True)
        path, part = os.path.join(folder, f"{key[0]}.npy"), os.path.join(folder, f".{uuid.uuid4().hex}.part")
        with open(part, "wb") as f:
            np.save(f, a)
        os.replace(part, path)
        return pd.DataFrame([[key[0], path]], columns=["tp", "path"])

    return voxels.groupBy("tp").applyInPandas(save, "tp string, path string")
