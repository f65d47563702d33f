"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, which the driver and all executors see.

    Where that is unset and all runs in one process, below a temporary folder;
    a cluster without it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="voxloom-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the session's checkpoint folder, which all executors share.

    A temporary folder is taken only where ``spark.checkpoint.dir`` is unset
    and all runs in one process; a cluster without it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="voxloom-"))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a Parquet table in the checkpoint folder, read again.

    A checkpoint keeps the size that the optimizer expected of what made it;
    for a join that is the product of both sides, so in a loop of joins its
    digits multiply each round, until planning takes longer than the work.  A
    table has the size of its files.  :func:`discard` deletes it.
    """
    spark = df.sparkSession
    at = spark.sparkContext.getCheckpointDir()
    path = f"{at.rstrip('/')}/table-{uuid.uuid4().hex}" if at else shared_folder(spark, "table")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(table._written_at)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
