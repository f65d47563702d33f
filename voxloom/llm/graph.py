"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``links``: label is the smallest node of its component.

    Every round gives a node the least label among its own and its neighbours'
    and then the label of that label (pointer jumping), so the rounds grow with
    the logarithm of a component's diameter.  Each round is written to the
    shared folder; nothing but the number of changed nodes reaches the driver.
    Links to null and loops are ignored.
    """
    pairs = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = written(pairs.union(pairs.select("y", "x")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("near")).select("node", F.least("node", "near").alias("label"), F.lit(True).alias("new")), "labels")
    while True:
        offered = edges.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("offer"))
        nearer = labels.select("node", "label").join(offered, "node").select("node", "label", F.least("label", "offer").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        step = nearer.join(jump, "low").select("node", F.least("low", "far").alias("label"), (F.least("low", "far") != F.col("label")).alias("new"))
        before, labels = labels, written(step, "labels")
        discard(before)
        if not labels.filter("new").limit(1).count():
            discard(edges)
            found = labels.select("node", "label")
            found._written_at = labels._written_at
            return found
