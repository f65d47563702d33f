"""What the operators share: written intermediate tables and sizes of jobs."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where that is unset and all runs in one process (tests), a temporary
    folder is taken; a cluster without it is an error, as executors don't see
    each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="voxloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Seconds between two calls of the driver's garbage collector, which lets Spark remove shuffle files of steps that are over.
CLEAN_SECONDS = 3.0
_cleaned = [0.0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    Cuts the lineage: what is read survives the loss of any executor, and what
    made it is computed once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    collect_garbage(spark)
    return table


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps that are over, unless that was done just before."""
    if time.monotonic() - _cleaned[0] > CLEAN_SECONDS:
        spark.sparkContext._jvm.System.gc()
        _cleaned[0] = time.monotonic()


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def make_folder(spark: SparkSession, path: str) -> None:
    place, system = _folder(spark, path)
    system.mkdirs(place)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Rename a folder; False if there is none."""
    place, system = _folder(spark, path)
    return system.exists(place) and system.rename(place, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to))


def delete(spark: SparkSession, path: str) -> None:
    place, system = _folder(spark, path)
    system.delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for table in tables:
        delete(table.sparkSession, table._written_at)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """Bytes that the optimizer expects of ``df`` (files' sizes for a table); 0 if it has no idea."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def fresh(taken: Iterable[str], *names: str) -> tuple[str, ...]:
    """Names for columns of an operator's own that no column in ``taken`` has, in any case of letters."""
    lower = {t.lower() for t in taken}
    lead = "_"
    while any(f"{lead}{n}" in lower for n in names):
        lead += "_"
    return tuple(f"{lead}{n}" for n in names)


def named(column: str) -> Column:
    """The column of exactly this name, dots and the like included."""
    return F.col("`" + column.replace("`", "``") + "`")


def map_in_arrow(df: DataFrame, function, schema: T.StructType) -> DataFrame:
    """``df.mapInArrow`` whatever the columns' names; the function sees and gives them by place."""
    inner = T.StructType([T.StructField(f"c{k}", f.dataType, True) for k, f in enumerate(schema.fields)])
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))

    def renamed(batches):
        for batch in function(batches):
            yield batch.rename_columns(inner.names)

    return plain.mapInArrow(renamed, inner).toDF(*schema.names)
