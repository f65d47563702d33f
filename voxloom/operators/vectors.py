"""Vectors: similarity, clustering, balancing, principal components. Points: id, vec."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import numeric as N

#: Centroids that are broadcast; the number of clusters is a parameter and doesn't grow with the data.
MOST_CENTROIDS = 10_000


def unit(vec):
    norm = F.sqrt(N.dot(vec, vec))
    return F.transform(vec, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def blocks(n_q: int, n_p: int, width: int) -> tuple[int, int]:
    """Blocks of queries and of points: up to 32,768 rows or 16 MB each, as rows are copied once for each block of the other side; at least 16 pairs of blocks where rows suffice."""
    most = max(512, min(32_768, 2**24 // (8 * max(1, width))))
    parts, p_parts = max(1, -(-n_q // most)), max(1, -(-n_p // most))
    return parts, max(p_parts, min(-(-16 // parts), -(-n_p // 1024)))


def nearest_neighbour(queries: DataFrame, points: DataFrame, block: int | None = None) -> DataFrame:
    """(id, neighbour, similarity): the other point of greatest dot product with each query of unit length; ties go to the least id.

    ``queries`` is the stated query set.  Points and queries are dealt into
    blocks, each pair of blocks is a dense product, taken 256 queries at a
    time, that keeps one row a query, and a grouped maximum puts the blocks
    together.  ``block`` sets the queries of a block (eight times as many
    points); by default see :func:`blocks`.
    """
    n_q = queries.count()
    about = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    parts, p_parts = blocks(n_q, about["n"], about["width"] or 1) if block is None else (max(1, -(-n_q // block)), max(1, -(-about["n"] // (8 * block))))
    q = queries.select(F.lit(True).alias("q"), "id", "vec", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(p_parts - 1))).alias("j"))
    p = points.select(F.lit(False).alias("q"), "id", "vec", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("i"), F.pmod(F.xxhash64("id"), F.lit(p_parts)).alias("j"))

    def best(pdf):
        a, b = pdf[pdf.q], pdf[~pdf.q].sort_values("id")
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "neighbour": [], "similarity": []}).astype({"id": "int64", "neighbour": "int64"})
        u, v = (np.stack(x.vec.to_numpy()).astype(np.float64) for x in (a, b))
        ids, found = b.id.to_numpy(), []
        for at in range(0, len(a), 256):
            own = a.id.to_numpy()[at : at + 256]
            s = u[at : at + 256] @ v.T
            s[own[:, None] == ids[None, :]] = -np.inf
            k = s.argmax(1)
            found.append(pd.DataFrame({"id": own, "neighbour": ids[k], "similarity": s[np.arange(len(own)), k]}))
        return pd.concat(found)

    found = q.unionByName(p).groupBy("i", "j").applyInPandas(best, "id long, neighbour long, similarity double").filter(~F.col("similarity").isin(float("-inf")))
    top = found.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("neighbour")).alias("n"))).alias("m"))
    return top.select("id", (-F.col("m.n")).alias("neighbour"), F.col("m.similarity").alias("similarity"))


def koleo(points: DataFrame, batch: str | None = None, eps: float = 1e-8) -> DataFrame:
    """Minus the mean log distance of vectors, made unit length first, to their nearest neighbour.

    With ``batch``, a column that numbers batches, neighbours are those of the
    batch, one row a batch; batches are as large as a training step's and meet
    as arrays.
    """
    told = points.withColumn("vec", unit(F.col("vec")))
    if batch is None:
        near = nearest_neighbour(told, told)
        gap = F.sqrt(F.greatest(2 - 2 * F.col("similarity"), F.lit(0.0)))
        return near.agg((-F.avg(F.log(gap + eps))).alias("koleo"))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(rows.vec.to_numpy()).astype(np.float64)
        s = v @ v.T
        np.fill_diagonal(s, -np.inf)
        gap = np.sqrt(np.maximum(2 - 2 * s.max(1), 0)) if len(v) > 1 else np.array([])
        return pd.DataFrame({batch: [key[0]], "koleo": [float(-np.log(gap + eps).mean()) if len(gap) else None]})

    kind = points.schema[batch].dataType.simpleString()
    return told.groupBy(batch).applyInPandas(one, f"{batch} {kind}, koleo double")


def assign(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, k, distance): the nearest centroid by cosine distance, ties to the least k.

    Up to ``MOST_CENTROIDS`` (counted here) meet each point as one array in its
    row, so nothing is multiplied out or shuffled; more are taken in blocks of
    that many, one after the other, and the best of a point's blocks wins.
    """
    blocks = -(-centroids.count() // MOST_CENTROIDS)
    best = None
    for block in range(max(1, blocks)):
        some = centroids if blocks <= 1 else centroids.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == block)
        listed = some.agg(F.array_sort(F.collect_list(F.struct("k", unit(F.col("vec")).alias("u")))).alias("_all"))
        own = F.transform(F.array(unit(F.col("vec"))), lambda v: F.array_min(F.transform("_all", lambda c: F.struct((1.0 - N.dot(v, c["u"])).alias("d"), c["k"].alias("k")))))[0]
        found = points.join(F.broadcast(listed)).select("id", own.alias("m"))
        best = found if best is None else best.union(found)
    if blocks > 1:
        best = best.groupBy("id").agg(F.min("m").alias("m"))
    return best.select("id", F.col("m.k").alias("k"), F.col("m.d").alias("distance"))


def means(points: DataFrame, assigned: DataFrame) -> DataFrame:
    """Unit-length means of the clusters, channel by channel on the map side."""
    flat = points.join(assigned.select("id", "k"), "id").select("k", F.posexplode("vec").alias("c", "f"))
    m = flat.groupBy("k", "c").agg(F.avg(F.col("f").cast("double")).alias("m")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("c", "m"))).alias("s"))
    return m.select("k", unit(F.col("s.m")).alias("vec"))


def spread_centroids(points: DataFrame, clusters: int, rounds: int = 5, oversampling: float = 2.0, seed: str = "0") -> DataFrame:
    """(k, vec): ``clusters`` points that lie apart, drawn with chances by squared distance in a few passes.

    Each pass draws ``oversampling * clusters`` points at once, by the least of
    exponential keys (-log(u) / distance squared, u from a hash of id and
    pass): a draw without replacement with those chances.  Distances to the
    nearest draw are kept between passes, so a pass meets only the new draws.
    The candidates, weighed by how many points are nearest to them, are drawn
    down to ``clusters`` one after the other; there are at most 1 + rounds *
    oversampling * clusters of them, so that is done in the driver.  Distances
    are cosine distances; the result depends on ids and seed only.  Fewer
    points than ``clusters`` give as many centroids as there are different
    points.
    """
    each = max(1, int(oversampling * clusters))
    if 1 + rounds * each > MOST_CENTROIDS:
        raise ValueError("too many candidates: take fewer clusters, rounds or less oversampling")
    u = lambda r: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}-{r}"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("double") + 1.0) / float(16**12)
    known = points.select("id", unit(F.col("vec")).alias("vec")).withColumn("distance", F.lit(None).cast("double")).withColumn("nearest", F.lit(None).cast("int"))
    drawn: list = []
    fresh = known.orderBy(u(0), "id").limit(1).select("vec").collect()
    for r in range(1, rounds + 2):
        if not fresh:
            break
        first = len(drawn)
        drawn += [row.vec for row in fresh]
        # the draws are a bounded list of this job's making, not of the data's size
        new = known.sparkSession.createDataFrame([(k, v) for k, v in enumerate(drawn[first:], first)], "k int, vec array<double>")
        listed = new.agg(F.array_sort(F.collect_list(F.struct("k", "vec"))).alias("_new"))
        best = F.array_min(F.transform("_new", lambda c: F.struct(F.greatest(F.lit(0.0), 1.0 - N.dot(F.col("vec"), c["vec"])).alias("d"), c["k"].alias("k"))))
        met = known.join(F.broadcast(listed)).withColumn("_best", best)  # one row
        closer = F.col("distance").isNull() | (F.col("_best.d") < F.col("distance"))
        known = cut(met.select("id", "vec", F.when(closer, F.col("_best.d")).otherwise(F.col("distance")).alias("distance"), F.when(closer, F.col("_best.k")).otherwise(F.col("nearest")).alias("nearest")))
        if r <= rounds:
            race = -F.log(u(r)) / (F.col("distance") * F.col("distance"))
            fresh = known.filter("distance > 1e-12").orderBy(race, "id").limit(each).select("vec").collect()
    weights = np.zeros(len(drawn))
    for row in known.groupBy("nearest").count().collect():  # a row a candidate
        weights[row["nearest"]] = row["count"]
    chosen = _drawn_down(np.array(drawn), weights, clusters, seed) if drawn else []
    return points.sparkSession.createDataFrame([(k, [float(x) for x in drawn[c]]) for k, c in enumerate(chosen)], "k int, vec array<double>")


def _drawn_down(candidates: np.ndarray, weights: np.ndarray, clusters: int, seed: str) -> list[int]:
    """Places of ``clusters`` candidates, each drawn by weight times squared distance to those before; of some tries the one that helps most."""
    import zlib

    rnd = np.random.default_rng(zlib.crc32(seed.encode()))
    gaps = np.maximum(0.0, 1.0 - candidates @ candidates.T) ** 2
    chosen = [int(rnd.choice(len(candidates), p=weights / weights.sum()))]
    cost = gaps[chosen[0]]
    tries = 2 + int(np.log(max(1, clusters)))
    while len(chosen) < clusters and (weights * cost).sum() > 1e-18:
        chance = weights * cost
        some = rnd.choice(len(candidates), size=tries, p=chance / chance.sum())
        best = min(some, key=lambda c: ((weights * np.minimum(cost, gaps[c])).sum(), c))
        chosen.append(int(best))
        cost = np.minimum(cost, gaps[best])
    return chosen


def kmeans(points: DataFrame, centroids: DataFrame, rounds: int = 10, tol: float = 1e-6, reseed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(assignment, centroids) after Lloyd rounds from given centroids.

    An empty cluster keeps its centroid or, with ``reseed``, takes the point
    farthest from its centroid: of e empty ones each another of the e farthest.
    """
    now = cut(centroids.select("k", unit(F.col("vec")).alias("vec")))
    for _ in range(rounds):
        near = assign(points, now)
        if reseed:
            near = cut(near)
        both = now.join(means(points, near).withColumnRenamed("vec", "new"), "k", "left").select("k", F.coalesce("new", "vec").alias("vec"), F.isnull("new").alias("empty"))
        nxt = cut(both)
        empty = [r.k for r in nxt.filter("empty").select("k").orderBy("k").collect()] if reseed else []  # no more than there are centroids
        if empty:
            far = points.join(near.filter("distance > 1e-12").orderBy(F.desc("distance"), "id").limit(len(empty)), "id").select("vec", "distance", "id")
            seats = far.orderBy(F.desc("distance"), "id").collect()
            taken = points.sparkSession.createDataFrame([(k, [float(x) for x in s.vec]) for k, s in zip(empty, seats)], "k int, new array<double>")
            nxt = cut(nxt.join(F.broadcast(taken), "k", "left").select("k", F.coalesce(unit(F.col("new")), "vec").alias("vec")))
        nxt = nxt.select("k", "vec")
        moved = nxt.join(now.withColumnRenamed("vec", "old"), "k").select(F.aggregate(F.zip_with("vec", "old", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d")).agg(F.sum("d")).first()[0]
        now = nxt
        if (moved or 0.0) <= tol:
            break
    return assign(points, now), now


def first_centroids(points: DataFrame, clusters: int) -> DataFrame:
    """The points of least hash, one for each cluster: the same whatever the partitions."""
    top = points.select("id", "vec", F.md5(F.col("id").cast("string")).alias("o")).orderBy("o", "id").limit(clusters)
    return top.select((F.row_number().over(Window.orderBy("o", "id")) - 1).alias("k"), "vec")


def sinkhorn(scores: DataFrame, rounds: int = 3, temperature: float = 1.0) -> DataFrame:
    """Balanced assignment of samples b to prototypes k from scores s: alternating row and column normalisation; p sums to 1 for each b."""
    total = scores.select(F.exp(F.col("s") / temperature).alias("q")).agg(F.sum("q").alias("all"))
    q = scores.select("b", "k", F.exp(F.col("s") / temperature).alias("q")).crossJoin(F.broadcast(total)).select("b", "k", (F.col("q") / F.col("all")).alias("q"))  # one row
    n = scores.agg(F.countDistinct("k").alias("nk"), F.countDistinct("b").alias("nb")).first()
    for _ in range(rounds):
        for key, size in (("k", n["nk"]), ("b", n["nb"])):
            sums = q.groupBy(key).agg(F.sum("q").alias("z"))
            q = cut(q.join(sums, key).select("b", "k", (F.col("q") / F.col("z") / size).alias("q")))
    return q.select("b", "k", (F.col("q") * n["nb"]).alias("p"))


#: Matrices that one task merges.
MERGE = 256


def covariance(points: DataFrame) -> DataFrame:
    """(i, j, cov) for i <= j, unbiased.

    Every task adds up its own rows' centred products and hands on one small
    matrix (width squared numbers); these are merged about their means, so
    large means cost no precision, by at most ``MERGE`` at a time.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, mean, m2 = 0, None, None
        for batch in batches:
            if len(batch):
                v = np.stack(batch.vec.to_numpy()).astype(np.float64)
                n, mean, m2 = merged_moments((n, mean, m2), (len(v), v.mean(0), (v - v.mean(0)).T @ (v - v.mean(0))))
        if n:
            yield pd.DataFrame({"n": [n], "mean": [mean.tolist()], "m2": [m2.ravel().tolist()]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        now = (0, None, None)
        for n, mean, m2 in zip(rows.n, rows["mean"], rows.m2):
            now = merged_moments(now, (n, np.array(mean), np.array(m2).reshape(len(mean), len(mean))))
        return pd.DataFrame({"n": [now[0]], "mean": [now[1].tolist()], "m2": [now[2].ravel().tolist()]})

    kind = "n long, mean array<double>, m2 array<double>"
    parts = points.select("vec").mapInPandas(partial, kind)
    groups = max(1, points.rdd.getNumPartitions() // MERGE)
    while groups > 1:
        parts = parts.groupBy((F.spark_partition_id() % groups).alias("g")).applyInPandas(merge, kind)
        groups //= MERGE
    whole = parts.groupBy(F.lit(0).alias("g")).applyInPandas(merge, kind)
    flat = whole.select("n", F.size("mean").alias("w"), F.posexplode("m2").alias("p", "s"))
    return flat.select(F.floor(F.col("p") / F.col("w")).cast("int").alias("i"), (F.col("p") % F.col("w")).alias("j"), (F.col("s") / (F.col("n") - 1)).alias("cov")).filter("i <= j")


def merged_moments(a: tuple, b: tuple) -> tuple:
    """Count, mean and centred products of two samples together."""
    if not a[0]:
        return b
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def pca(points: DataFrame, components: int) -> DataFrame:
    """(id, c, value): centred points on the leading eigenvectors, each signed so that its largest entry is positive.

    Only the covariance matrix (width squared numbers) reaches the driver.
    """
    rows = covariance(points).collect()
    width = max(r["j"] for r in rows) + 1
    m = np.zeros((width, width))
    for r in rows:
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["cov"]
    _, vectors = np.linalg.eigh(m)
    lead = vectors[:, ::-1][:, :components].T
    lead = lead * np.sign(lead[np.arange(len(lead)), np.abs(lead).argmax(1)])[:, None]
    centre = {r["c"]: r["m"] for r in points.select(F.posexplode("vec").alias("c", "f")).groupBy("c").agg(F.avg(F.col("f").cast("double")).alias("m")).collect()}
    mean = [centre[c] for c in range(width)]
    as_array = lambda v: F.array(*(F.lit(float(x)) for x in v))
    moved = points.select("id", F.zip_with("vec", as_array(mean), lambda a, b: a.cast("double") - b).alias("v"))
    return moved.select("id", F.posexplode(F.array(*(N.dot(F.col("v"), as_array(v)) for v in lead))).alias("c", "value"))


def ema(rows: DataFrame, keys: list[str], order: str, value: str, momentum: float) -> DataFrame:
    """Exponential moving average by key, started at the first value; one ordered list a key (metrics are short)."""
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("double").alias("v")))).alias("s"))
    return listed.select(*keys, F.aggregate(F.slice("s", 2, F.size("s")), F.col("s")[0]["v"], lambda c, x: c * momentum + x["v"] * (1 - momentum)).alias("ema"))
