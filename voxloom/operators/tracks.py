"""Chaining matches into tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from . import matching


def chain(objects: DataFrame, links: DataFrame) -> DataFrame:
    """The track of every object: (t, label, track_id, start, i, track_length).

    links: t, ref, cand, one-to-one between frames t and t + 1.  Every object
    points to its predecessor; pointers are doubled, so the rounds grow with
    the logarithm of the longest track.  Tracks are numbered by their first
    frame and label.
    """
    back = links.select((F.col("t") + 1).alias("t"), F.col("cand").alias("label"), F.col("ref").alias("before"))
    at = cut(objects.select("t", "label").join(back, ["t", "label"], "left").select("t", "label", F.when(F.col("before").isNotNull(), F.col("t") - 1).otherwise(F.col("t")).alias("ht"), F.coalesce("before", "label").alias("hl")))
    while True:
        far = at.select(F.col("t").alias("ht"), F.col("label").alias("hl"), F.col("ht").alias("ft"), F.col("hl").alias("fl"))
        step = cut(at.join(far, ["ht", "hl"]).select("t", "label", F.col("ft").alias("ht"), F.col("fl").alias("hl"), (F.col("ft") != F.col("ht")).alias("moved")))
        at = step.select("t", "label", "ht", "hl")
        if not step.filter("moved").limit(1).count():
            break
    heads = at.filter("t = ht").select("ht", "hl")
    ids = numbered(heads, ["ht", "hl"], "track_id")
    own = Window.partitionBy("track_id")
    return at.join(ids, ["ht", "hl"]).select("t", "label", "track_id", F.col("ht").alias("start"), F.row_number().over(own.orderBy("t")).alias("i"), F.count(F.lit(1)).over(own).alias("track_length"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 1 in the given order without one task seeing them all.

    Rows are range-partitioned, counted per partition (a table of one row per
    partition) and numbered within it from its offset.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_offset"))
    return ranged.join(F.broadcast(offsets), "_p").withColumn(name, (F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + F.col("_offset")).cast("int")).drop("_p", "_offset")


def mutual_nearest(pairs: DataFrame) -> DataFrame:
    """Pairs that are each other's nearest (ties by label)."""
    by_ref = pairs.groupBy("t", "ref").agg(F.min(F.struct("dist", "cand")).alias("b")).select("t", "ref", F.col("b.cand").alias("cand"))
    by_cand = pairs.groupBy("t", "cand").agg(F.min(F.struct("dist", "ref")).alias("b")).select("t", F.col("b.ref").alias("ref"), "cand")
    return by_ref.join(by_cand, ["t", "ref", "cand"])


def nearest_links(objects: DataFrame, radius: float, z_radius: float, z_weight: float = 1.0, start: float | None = None) -> DataFrame:
    """:func:`mutual_nearest` of the candidates of the objects, found without all the pairs.

    Of objects at one place only the one of the least label can be another's
    nearest, so the others stay out of the search.
    """
    places = cut(objects.filter("cy is not null and cx is not null and cz is not null").groupBy("t", "cy", "cx", "cz").agg(F.min("label").alias("label")))
    asked = places.withColumn("d", F.explode(F.array(F.lit(1), F.lit(-1))))
    found = cut(matching.nearest(asked, places, radius, z_radius, z_weight, start))
    by_ref = found.filter("d = 1").select("t", F.col("label").alias("ref"), F.col("near").alias("cand"))
    by_cand = found.filter("d = -1").select((F.col("t") - 1).alias("t"), F.col("near").alias("ref"), F.col("label").alias("cand"))
    return by_ref.join(by_cand, ["t", "ref", "cand"])


def export(tracks: DataFrame, objects: DataFrame, invert_z: float | None = None) -> DataFrame:
    """Track rows with positions and amplitude, in the export's column order; tracks with a NaN or null amplitude are left out.

    ``invert_z``: the volume's depth, to count z from the other end.
    """
    bad = F.max(F.when(F.col("A").isNull() | F.isnan("A"), 1).otherwise(0)).over(Window.partitionBy("track_id"))
    rows = tracks.join(objects.select("t", "label", "cx", "cy", "cz", "A"), ["t", "label"]).withColumn("_bad", bad).filter("_bad = 0")
    z = F.col("cz") if invert_z is None else F.lit(invert_z) - F.col("cz")
    return rows.select("track_id", "start", F.col("i").alias("t"), F.col("cx").alias("x"), F.col("cy").alias("y"), z.alias("z"), "A", "track_length")


def as_arrays(rows: DataFrame) -> DataFrame:
    """One row per track with its positions and amplitudes in order of time."""
    points = F.array_sort(F.collect_list(F.struct("t", "x", "y", "z", "A")))
    return rows.groupBy("track_id").agg(points.alias("p")).select("track_id", *(F.col(f"p.{k}").alias(k) for k in ("x", "y", "z", "A")))
