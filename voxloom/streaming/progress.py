"""Progress of jobs from their log lines, as a stream or a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import strings as S


def progress(lines: DataFrame, totals: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """(job_id, processed, total): distinct expected items that a job's lines report as saved, at most the total.

    lines: job_id, line (may be a stream, then the result is updated) and, with
    ``jobs``, seq; totals: job_id, item (the expected items: paths if any line
    names paths).  Lines about other items change nothing, repeated ones count
    once, so replayed input is harmless.  jobs: job_id, stopped_seq (the line
    from which on a job no longer runs, or null): later lines don't count.
    Lines meet the expected items by (job, item).
    """
    said = lines.withColumn("item", S.reported(S.plain_line(F.col("line")))).filter("item IS NOT NULL")
    if jobs is not None:
        said = said.join(jobs.select("job_id", "stopped_seq"), "job_id", "left").filter("stopped_seq IS NULL OR seq < stopped_seq")
    expected = totals.select("job_id", "item").distinct().join(totals.groupBy("job_id").agg(F.count_distinct("item").cast("int").alias("total")), "job_id")
    told = said.select("job_id", "item").join(expected, ["job_id", "item"])
    return told.groupBy("job_id").agg(F.size(F.collect_set("item")).alias("processed"), F.first("total").alias("total"))


def two_phases(lines: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, prepared, matched, processed, total) of tracking jobs: n time points are prepared and n - 1 pairs matched.

    jobs: job_id, timepoints; lines: job_id, line.  Each time point and pair
    counts once; the sum is at most the total.
    """
    line = S.plain_line(F.col("line"))
    said = lines.select("job_id", S.completed(line).alias("prepared"), S.matched_pair(line).alias("matched")).filter("prepared IS NOT NULL OR matched IS NOT NULL")
    done = said.groupBy("job_id").agg(F.count_distinct("prepared").alias("prepared"), F.count_distinct("matched").alias("matched"))
    total = F.col("timepoints") + F.greatest(F.col("timepoints") - 1, F.lit(0))
    both = F.coalesce("prepared", F.lit(0)) + F.coalesce("matched", F.lit(0))
    return jobs.join(done, "job_id", "left").select("job_id", F.coalesce("prepared", F.lit(0)).alias("prepared"), F.coalesce("matched", F.lit(0)).alias("matched"), F.when(total > 0, F.least(total, both)).otherwise(both).cast("int").alias("processed"), total.cast("int").alias("total"))


def start(lines: DataFrame, totals: DataFrame, table: str, checkpoint: str | None = None):
    """Run :func:`progress` over a stream into the in-memory table ``table`` until the available input is used up."""
    writer = progress(lines, totals).writeStream.format("memory").queryName(table).outputMode("complete").trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
