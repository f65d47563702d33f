"""Connected components of voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import numeric as N

#: Half of the eight lines around a line along x: those that come later in raster order.
_FORWARD = [(0, 1), (1, -1), (1, 0), (1, 1)]


def connected_components(voxels: DataFrame, height: int, width: int) -> DataFrame:
    """26-connected components of the given voxels (tp, z, y, x), numbered in raster order of their first voxel within each time point.

    Voxels in a row along x are one node, named by its first place.  Edges
    come from one equi-join of voxels on shifted places, each pair of runs
    once; labels fall to the least place by neighbours' labels and pointer
    jumping, each round cut.
    """
    place = N.flat_index(F.col("z"), F.col("y"), F.col("x"), height, width)
    line = Window.partitionBy("tp", "z", "y")
    told = voxels.select("tp", "z", "y", "x", (F.col("x") - F.dense_rank().over(line.orderBy("x"))).alias("_g"))
    nodes = cut(told.select("tp", "z", "y", "x", F.min(place).over(Window.partitionBy("tp", "z", "y", "_g")).alias("p")))
    shifts = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b in _FORWARD for c in (-1, 0, 1)))
    asked = nodes.select("tp", F.col("p").alias("u"), "z", "y", "x", F.explode(shifts).alias("o")).select("tp", "u", *((F.col(k) + F.col(f"o.{o}")).alias(k) for k, o in zip("zyx", "abc")))
    half = asked.join(nodes.withColumnRenamed("p", "w"), ["tp", "z", "y", "x"]).select("tp", "u", "w").distinct()
    edges = cut(half.union(half.select("tp", F.col("w").alias("u"), F.col("u").alias("w"))))
    labels = cut(nodes.select("tp", "p", F.col("p").alias("root")).distinct())
    while True:
        near = edges.join(labels.select("tp", F.col("p").alias("w"), "root"), ["tp", "w"]).groupBy("tp", F.col("u").alias("p")).agg(F.min("root").alias("offer"))
        lower = labels.join(near, ["tp", "p"], "left").select("tp", "p", "root", F.least("root", F.coalesce("offer", "root")).alias("low"))
        jump = labels.select("tp", F.col("p").alias("low"), F.col("root").alias("far"))
        step = cut(lower.join(jump, ["tp", "low"]).select("tp", "p", F.least("low", "far").alias("root"), (F.least("low", "far") != F.col("root")).alias("moved")))
        labels = step.select("tp", "p", "root")
        if not step.filter("moved").limit(1).count():
            break
    roots = labels.filter("p = root").select("tp", "root", F.row_number().over(Window.partitionBy("tp").orderBy("root")).alias("label"))
    return nodes.join(labels, ["tp", "p"]).join(roots, ["tp", "root"]).select("tp", "z", "y", "x", "label")
