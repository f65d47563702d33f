"""Jobs, logs, CPU samples and metric meters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N


def parse_cpu(lines: DataFrame, line: str = "value") -> DataFrame:
    """(cpu, total, idle) of ``cpuN`` lines of counters; other lines and lines that aren't whole numbers are passed over."""
    parts = F.split(F.trim(line), r"\s+")
    counts = F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.try_cast("long"))
    told = lines.filter(F.col(line).rlike(r"^cpu\d+\s")).select(parts[0].alias("cpu"), counts.alias("n"))
    return told.filter((F.size("n") >= 5) & F.forall("n", lambda x: x.isNotNull())).select("cpu", F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), (F.col("n")[3] + F.col("n")[4]).alias("idle"))


def utilisation(samples: DataFrame, key: str, order: str) -> DataFrame:
    """Per cent busy since the sample before. samples: key, order, total, idle."""
    w = Window.partitionBy(key).orderBy(order)
    told = samples.withColumn("_t", F.lag("total").over(w)).withColumn("_i", F.lag("idle").over(w)).filter("_t IS NOT NULL")
    return told.select(key, order, N.utilisation(F.col("_t"), F.col("_i"), F.col("total"), F.col("idle")).alias("pct"))


def cpu_summary(used: DataFrame, threshold: float = 10.0) -> DataFrame:
    p = F.round("pct", 1)
    return used.agg(F.count(F.lit(1)).alias("total"), F.count_if(p > threshold).alias("active"), F.round(F.avg(p), 1).alias("average"))


def meters(metric: DataFrame, width: int = 20) -> DataFrame:
    """At every step: lower median, mean and greatest of the last ``width`` values, the mean so far and the value. metric: name, iteration, value."""
    near = Window.partitionBy("name").orderBy("iteration").rowsBetween(-(width - 1), 0)
    so_far = Window.partitionBy("name").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    values = F.sort_array(F.collect_list("value").over(near))
    return metric.select("name", "iteration", F.get(values, F.floor((F.size(values) - 1) / 2).cast("int")).alias("median"), F.avg("value").over(near).alias("mean"), F.max("value").over(near).alias("top"), (F.sum("value").over(so_far) / F.count("value").over(so_far)).alias("global_mean"), F.col("value").alias("last"))


def merged_meters(parts: DataFrame) -> DataFrame:
    """Meters of several processes: sums of total and count only."""
    return parts.groupBy("name").agg(F.sum("count").alias("count"), F.sum("total").alias("total")).withColumn("global_mean", F.col("total") / F.greatest(F.col("count"), F.lit(1)))


def jobs_of(jobs: DataFrame, owner: str) -> DataFrame:
    return jobs.filter(F.col("owner") == owner).orderBy(F.col("created_at_ms").desc(), "job_id")


def listed(jobs: DataFrame) -> DataFrame:
    """Every job with its position ``n`` in its owner's list, newest first, as :func:`jobs_of` orders it."""
    return jobs.withColumn("n", F.row_number().over(Window.partitionBy("owner").orderBy(F.col("created_at_ms").desc(), "job_id")))


def cleared(jobs: DataFrame, keep_running: bool) -> DataFrame:
    return jobs.filter("status = 'running'") if keep_running else jobs.limit(0)


def final_status(jobs: DataFrame) -> DataFrame:
    """completed, failed, halted or running from exit code, stop request and counts; success needs all outputs."""
    status = F.when(F.col("exit_code").isNull(), "running").when(F.col("stop_requested"), "halted").when((F.col("exit_code") == 0) & (F.col("processed") >= F.col("total")), "completed").otherwise("failed")
    return jobs.withColumn("status", status)


def log_tail(lines: DataFrame, most: int = 200) -> DataFrame:
    """The last ``most`` lines of each job (1 to 500: a tail is what is asked for) with the number of all."""
    most = min(max(most, 1), 500)
    last = Window.partitionBy("job_id").orderBy(F.col("seq").desc())
    total = lines.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"))
    tail = lines.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= most)
    return tail.join(total, "job_id").select("job_id", "seq", "line", "total", (F.col("total") > most).alias("truncated"))


def iteration_times(events: DataFrame, key: str, order: str, every: int) -> DataFrame:
    """Seconds between the iterations of each key, at every ``every``-th one and the last. events: key, order (ms), iteration."""
    w = Window.partitionBy(key).orderBy("iteration")
    last = F.max("iteration").over(Window.partitionBy(key))
    told = events.withColumn("seconds", (F.col(order) - F.lag(order).over(w)) / 1000.0).withColumn("_last", last)
    return told.filter((F.col("iteration") % every == 0) | (F.col("iteration") == F.col("_last"))).select(key, "iteration", "seconds")


def remaining_times(times: DataFrame, key: str, total: int, every: int) -> DataFrame:
    """Seconds that each key's run still takes: the mean of its iterations so far for each of ``total`` that is left, at every ``every``-th one and the last. times: key, iteration, seconds (nulls count for nothing)."""
    so_far = Window.partitionBy(key).orderBy("iteration")
    last = F.max("iteration").over(Window.partitionBy(key))
    told = times.withColumn("_mean", F.avg("seconds").over(so_far)).withColumn("_last", last)
    return told.filter((F.col("iteration") % every == 0) | (F.col("iteration") == F.col("_last"))).select(key, "iteration", (F.col("_mean") * F.greatest(F.lit(total) - F.col("iteration"), F.lit(0))).alias("left"))


def total_loss(terms: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The weighted sum of each step's terms; missing ones count as zero. terms: step, name, value."""
    w = F.lit(0.0)
    for name, weight in sorted(weights.items()):
        w = F.when(F.col("name") == name, weight).otherwise(w)
    return terms.groupBy("step").agg(F.sum(F.coalesce("value", F.lit(0.0)) * w).alias("loss"))
