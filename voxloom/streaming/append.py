"""Running a stateful stream over what has come, into a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def to_table(rows: DataFrame, table: str, checkpoint: str) -> None:
    """Take in what has come and append to the Parquet table ``table``; call again to go on from ``checkpoint``."""
    spark = rows.sparkSession
    # a state with an end of time asks for batches without rows for ever, so an available-now stream would not end
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        sink = rows.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        sink.option("path", table).option("checkpointLocation", checkpoint).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
