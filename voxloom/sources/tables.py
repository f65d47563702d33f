"""Reading and writing: listings, logs, volumes, ledgers and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S

VOXEL = "tp string, z int, y int, x int, v double"


def listing(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(dir, name, is_dir, length, mtime_ms) of the files below a path; file contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select(F.regexp_replace("path", r"/[^/]*$", "").alias("dir"), S.base_name(F.col("path")).alias("name"), F.lit(False).alias("is_dir"), "length", F.unix_millis("modificationTime").alias("mtime_ms"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines of text files that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")


def npy_volumes(spark: SparkSession, path: str) -> DataFrame:
    """Voxels of three-dimensional ``.npy`` files, one row each: tp is the stem, axes are z, y, x."""

    def decode(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                a = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                if a.ndim != 3:
                    raise ValueError(f"{name.as_py()} isn't three-dimensional")
                for z in range(a.shape[0]):  # a slice at a time bounds the memory
                    y, x = np.indices(a.shape[1:]).reshape(2, -1).astype(np.int32)
                    n = len(y)
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * n), pa.array(np.full(n, z, np.int32)), pa.array(y), pa.array(x), pa.array(a[z].ravel().astype(np.float64))], names=["tp", "z", "y", "x", "v"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return files.select(S.stem(S.base_name(F.col("path"))).alias("tp"), "content").mapInArrow(decode, VOXEL)


def write_tracks(rows: DataFrame, path: str) -> None:
    """The track export as CSV with a header, ordered by track and time; files are range-partitioned parts in that order."""
    rows.select("track_id", "start", "t", "x", "y", "z", "A", "track_length").repartitionByRange("track_id").sortWithinPartitions("track_id", "t").write.mode("overwrite").option("header", True).csv(path)


def append_ledger(names: DataFrame, ledger: DataFrame, path: str) -> None:
    """Append the names that the ledger lacks."""
    names.select("value").distinct().join(ledger.select("value"), "value", "left_anti").write.mode("append").text(path)


def write_masks(mask: DataFrame, path: str) -> None:
    """Masks by time point; time points that are written again are replaced, others stay."""
    mask.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tp").parquet(path)


def norm_bounds(spark: SparkSession, path: str) -> tuple[float, float]:
    """Least and greatest intensity from a normalisation file; fails unless the second is larger."""
    row = spark.read.text(path, wholetext=True).select(*(F.regexp_extract("value", rf"(?m)^Global hist {k}:\s*(.+?)\s*$", 1).try_cast("double").alias(k) for k in ("min", "max"))).first()
    if row is None or row["min"] is None or row["max"] is None or row["max"] <= row["min"]:
        raise ValueError("no valid bounds")
    return row["min"], row["max"]
