"""Mixing sources to target weights by Poisson replication (SQL functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import fresh, input_bytes, named, written

#: Hexadecimal digits of MD5 that make a uniform number; 13 digits are 52 bits, exact in a double.
_DIGITS = 13


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) fixed by ``seed`` and ``keys``."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(k.cast("string"), F.lit("null")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def poisson_table(mean: Column) -> Column:
    """The Poisson distribution function at 0, 1, ... up to where what is left of it is negligible, as an array."""
    tail = F.floor(mean + 12 * F.sqrt(mean) + 30).cast("int")
    return F.aggregate(
        F.sequence(F.lit(1), tail),
        F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("cdf")),
        lambda s, k: F.struct((s["term"] * mean / k).alias("term"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["term"] * mean / k)).alias("cdf")),
        lambda s: s["cdf"],
    )


def poisson_inverse(u: Column, table: Column) -> Column:
    """The Poisson quantile of ``u``: how many values of the distribution function are at most ``u``."""
    return F.size(F.filter(table, lambda c: c <= u)).cast("long")


def source_rates(docs: DataFrame, *, source_col: str = "source", weights: dict[str, float] | None = None, exponent: float = 0.5, rate: float = 1.0) -> DataFrame:
    """The mean number of copies of a document of each source.

    A source's share of the output is proportional to its entry in ``weights``
    (0 if it has none), or, without ``weights``, to its number of documents
    raised to ``exponent``.  ``rate`` is the output's expected number of
    documents as a multiple of the input's.  Null is a source of its own.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        target = F.pow(F.col("n").cast("double"), F.lit(float(exponent)))
    else:
        if any(w < 0 or not math.isfinite(w) for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        target = F.lit(0.0)
        for name, w in sorted(weights.items()):
            target = F.when(F.col("source") == name, float(w)).otherwise(target)
    sized = sizes.withColumn("w", target)
    total = sized.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    return sized.join(F.broadcast(total)).select(  # one row by construction
        "source", "n", F.when(F.col("all_w") > 0, F.lit(float(rate)) * F.col("all_n") * F.col("w") / F.col("all_w") / F.col("n")).otherwise(0.0).alias("mean_copies")
    )


#: Sources that are broadcast with their distribution functions (of at most about 200 numbers each); beyond it these are joined by a salted shuffle.
BROADCAST_SOURCES = 10_000
_SALTS = 64
#: Bytes of the optimizer's estimate of the output for each partition of the shuffle, which has the session's number of partitions at least.
PARTITION_BYTES = 128 << 20


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str, float] | None = None,
    exponent: float = 0.5,
    rate: float = 1.0,
    seed: str = "mix",
    max_mean: float = 64.0,
) -> DataFrame:
    """Copies of the documents so that the sources have their target weights, in random order.

    Each document's number of copies is the Poisson quantile of a number hashed
    from ``seed`` and its id, with the source's mean: the same input gives the
    same output whatever the partitions, and a lost executor's part is remade
    the same.  A mean over ``max_mean`` is split: each document of that source
    draws several independent Poisson numbers of equal mean and adds them,
    which is the same distribution, so no count is capped.  A source's
    distribution function is made once, with its rate.  Copies are ordered by
    another hashed number (``mix_key``): its range is cut into equal parts, one
    a partition, which is the global shuffle; as the number is uniform, no
    source and no document can fill a part.

    The rates are joined by a broadcast if there are at most
    ``BROADCAST_SOURCES`` sources (counted first), else by a shuffle salted by
    the id so that no source meets in one task.

    Adds ``copy`` (0, 1, ...) and ``mix_key`` to the columns of ``docs``.  A
    null source is a source of its own, a null id hashes as a word, rows that
    repeat an id draw the same number of copies.  Texts aren't looked at, so
    null, empty and very long ones are carried as they are.  Columns of
    ``docs`` named ``copy`` or ``mix_key`` are replaced, all others kept,
    whatever their names.  Empty in, empty out.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c.lower() not in ("copy", "mix_key")]
    its, mean, draws, table, salt, own_salt, copies, part = fresh(docs.columns, "source", "mean", "draws", "table", "salt", "own_salt", "copies", "part")
    rates = source_rates(docs, source_col=source_col, weights=weights, exponent=exponent, rate=rate).select(F.col("source").alias(its), F.col("mean_copies").alias(mean))
    rates = rates.withColumn(draws, F.greatest(F.lit(1), F.ceil(F.col(mean) / F.lit(float(max_mean)))).cast("long"))
    rates = written(rates.withColumn(table, poisson_table(F.col(mean) / F.col(draws))), "rates")
    rows = docs.select(*map(named, columns))
    source, doc = named(source_col), named(id_col)
    if rates.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(rates), source.eqNullSafe(F.col(its)))
    else:
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        joined = rows.withColumn(own_salt, F.pmod(F.xxhash64(doc), F.lit(_SALTS)).cast("int")).join(salted, source.eqNullSafe(F.col(its)) & (F.col(own_salt) == F.col(salt)))
    text = F.coalesce(doc.cast("string"), F.lit("null"))
    draw = F.transform(F.sequence(F.lit(0).cast("long"), F.col(draws) - 1), lambda k: uniform(seed, F.when(k == 0, text).otherwise(F.concat(text, F.lit(":"), k.cast("string")))))
    count = F.aggregate(draw, F.lit(0).cast("long"), lambda n, u: n + poisson_inverse(u, F.col(table)))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rate * input_bytes(docs) / PARTITION_BYTES))
    out = (
        joined.withColumn(copies, count)
        .filter(F.col(copies) > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)))
        .withColumn("mix_key", uniform(seed + "-order", doc, F.col("copy")))
        .withColumn(part, F.floor(F.col("mix_key") * partitions).cast("int"))
        .select(*map(named, columns), "copy", "mix_key", part)
    )
    return out.repartitionById(partitions, F.col(part)).drop(part).sortWithinPartitions("mix_key", doc, "copy")
