"""Exact quantiles of groups of any size, without a list of a group's values anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketches that bracket a quantile: a bracket holds about four of so many parts of a group.
ACCURACY = 10_000
#: Different values of a bracket that are ordered in one task; where there are more, brackets are narrowed again.
MOST = 1_000_000


def _narrowed(rows: DataFrame, brackets: DataFrame | None, by: list[str], shares: dict[str, float]) -> DataFrame:
    """For each group the bracket (lo, hi) of its quantile among ``rows``, as seen by a mergeable sketch.

    ``brackets``: those of the pass before (rows outside are not looked at).
    """
    if brackets is None:
        inside, n, before = rows, None, F.lit(0)
    else:
        b = brackets.select(*(F.col(k).alias(f"_{k}") for k in by), "lo", "hi", F.col("n").alias("_n"), "below")
        inside = rows.join(b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by]).filter("v >= lo and v <= hi")
        n, before = F.max("_n"), F.max("below")
    step = 2.0 / ACCURACY
    if brackets is None:
        marks = sorted({max(0.0, q - step) for q in shares.values()} | {min(1.0, q + step) for q in shares.values()})
        lo, hi = (F.coalesce(*(F.when(F.col("name") == k, F.col("marks")[marks.index(f(q))]) for k, q in shares.items())) for f in (lambda q: max(0.0, q - step), lambda q: min(1.0, q + step)))
        told = inside.groupBy(*by).agg(F.count("v").alias("n"), F.percentile_approx("v", marks, ACCURACY).alias("marks"))
        return told.select(*by, "n", lo.alias("lo"), hi.alias("hi"))
    # the share differs by group now, so all marks of a coarse ladder are taken and the two around the rank chosen
    ladder = [k / 1000 for k in range(1001)]
    told = inside.groupBy(*by).agg(n.alias("n"), before.alias("before"), F.count("v").alias("m"), F.percentile_approx("v", ladder, ACCURACY).alias("marks"))
    share = F.coalesce(*(F.when(F.col("name") == k, F.lit(q)) for k, q in shares.items()))
    at = (share * (F.col("n") - 1) - F.col("before")) / F.col("m") * 1000
    slack = 2 + 2 * len(ladder) // ACCURACY
    place = lambda x: F.greatest(F.lit(0), F.least(F.lit(1000), x)).cast("int")
    return told.select(*by, "n", F.get("marks", place(F.floor(at) - slack)).alias("lo"), F.get("marks", place(F.ceil(at) + slack)).alias("hi"))


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row a group with the asked quantiles, interpolated between the two values around the place ``q * (n - 1)``.

    wanted: name -> (value, share).  Nulls and NaN are left out; a group
    without other values has null.  Without keys there is one row, for an empty
    table too.

    A sketch a group gives a bracket that surely holds the quantile; a second
    pass counts what lies below it and merges the counts of the few different
    values inside, which are put in order.  Groups whose bracket still holds
    more than ``MOST`` values are narrowed again, so the passes grow with the
    logarithm of a group and each task keeps a sketch or a bracket.
    """
    pairs = F.array(*(F.struct(F.lit(name).alias("name"), value.cast("double").alias("v")) for name, (value, _) in wanted.items()))
    rows = df.select(*keys, F.explode(pairs).alias("one")).select(*keys, "one.name", "one.v").filter("v is not null and not isnan(v)")
    shares = {name: float(q) for name, (_, q) in wanted.items()}
    by = [*keys, "name"]
    joined = lambda b: rows.join(b.select(*(F.col(k).alias(f"_{k}") for k in by), "n", "lo", "hi"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by])
    brackets = _narrowed(rows, None, by, shares)
    widest = None
    while True:
        near = joined(brackets).filter("n is not null")
        sides = near.groupBy(*by).agg(
            F.max("n").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.when(F.col("v") < F.col("lo"), 1)).alias("below"),
            F.count(F.when((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")), 1)).alias("inside"),
            F.max(F.when(F.col("v") < F.col("lo"), F.col("v"))).alias("under"), F.min(F.when(F.col("v") > F.col("hi"), F.col("v"))).alias("over"),
        )
        biggest = sides.agg(F.max(F.when(F.col("lo") < F.col("hi"), F.col("inside")))).first()[0] or 0
        # where narrowing no longer helps, few values repeat and their counts are short
        if biggest <= MOST or biggest == widest:
            break
        widest, brackets = biggest, _narrowed(rows, sides, by, shares)
    counted = near.filter("v >= lo and v <= hi").groupBy(*by, "v").agg(F.count(F.lit(1)).alias("times"))
    upto = counted.withColumn("upto", F.sum("times").over(Window.partitionBy(*by).orderBy("v")))
    # a bracket's values, with the one before and after it, which a sketch of few values may miss by a place
    place = F.coalesce(*(F.when(F.col("name") == k, F.lit(q)) for k, q in shares.items())) * (F.col("n") - 1)
    asked = sides.withColumn("place", place)
    both = upto.join(asked.select(*(F.col(k).alias(f"_{k}") for k in by), "below", F.floor("place").alias("a"), F.ceil("place").alias("b")), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by])
    at = lambda rank: F.max(F.when((F.col("below") + F.col("upto") - F.col("times") <= F.col(rank)) & (F.col(rank) < F.col("below") + F.col("upto")), F.col("v")))
    found = both.groupBy(*(F.col(k).alias(f"_{k}") for k in by)).agg(at("a").alias("va"), at("b").alias("vb"))
    told = asked.join(found, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by], "left")
    missed = F.raise_error(F.lit("a bracket misses its quantile")).cast("double")
    pick = lambda v, rank: F.coalesce(F.col(v), F.when(rank == F.col("below") - 1, F.col("under")).when(rank == F.col("below") + F.col("inside"), F.col("over")).otherwise(missed))
    a, b = pick("va", F.floor("place")), pick("vb", F.ceil("place"))
    value = told.select(*by, (a + (b - a) * (F.col("place") - F.floor("place"))).alias("v"))
    columns = [F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in wanted]
    if not keys:
        return value.agg(*columns)
    # every group of the input has its row, those without values too
    out = df.select(*keys).distinct().join(value.withColumnsRenamed({k: f"_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    return out.groupBy(*keys).agg(*columns)
