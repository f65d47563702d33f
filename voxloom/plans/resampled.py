"""Registered queries of resampling, thresholds, soft cuts and views, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resample, sampling
from ..operators.tracks import numbered
from .more import _sql
from .queries import SHAPE, _r, query
from .views import table, view


@query
def antialiased_volume(spark, sf):
    """No SQL: compared with numpy in the tests."""
    return resample.antialiased(view(spark, sf, "voxel"), SHAPE, resample.target_shape(SHAPE, scale=0.5)).select("tp", "z", "y", "x", *_r("v"))


@query
def blockwise_volume(spark, sf):
    """No SQL: compared with numpy in the tests."""
    return resample.blockwise(view(spark, sf, "voxel"), SHAPE, (12, 70, 11), (4, 20, 5)).select("tp", "z", "y", "x", *_r("v"))


@query
def exported_channels(spark, sf):
    """No SQL: compared with numpy in the tests. Channels are the values and their square roots."""
    v = view(spark, sf, "voxel").select("tp", "z", "y", "x", F.posexplode(F.array(F.col("v").cast("double"), F.sqrt("v"))).alias("c", "v"))
    return resample.exported(v, SHAPE, (9, 60, 20))


@query
def otsu_threshold(spark, sf):
    return resample.otsu(view(spark, sf, "voxel"), ["tp"]).select("tp", *_r("threshold"))


_sql(
    "otsu_threshold",
    "WITH e AS (SELECT tp, min(v) AS lo, max(v) AS hi FROM voxel GROUP BY tp), h AS (SELECT tp, lo, hi, least(floor((v - lo) / (hi - lo) * 256), 255)::INT AS b, count(*) AS n FROM voxel JOIN e USING (tp) GROUP BY ALL), "
    "c AS (SELECT tp, b, n, lo + (b + 0.5) * (hi - lo) / 256 AS c FROM h), s AS (SELECT a.tp, a.b, a.c, sum(d.n) FILTER (d.b <= a.b) AS w1, sum(d.n * d.c) FILTER (d.b <= a.b) AS s1, sum(d.n) FILTER (d.b > a.b) AS w2, sum(d.n * d.c) FILTER (d.b > a.b) AS s2 "
    "FROM c a JOIN c d USING (tp) GROUP BY ALL), r AS (SELECT tp, c, row_number() OVER (PARTITION BY tp ORDER BY w1 * w2 * (s1 / w1 - s2 / w2) ** 2 DESC, b) AS o FROM s WHERE w2 > 0) SELECT tp, round(c + 1e-9, 4) AS threshold FROM r WHERE o = 1",
    "voxel",
)


@query
def soft_cut_loss(spark, sf):
    p = F.when(F.col("v") > 40000, 0.9).otherwise(0.2)
    v = view(spark, sf, "voxel").select("tp", "z", "y", "x", (F.col("v") / 1e5).alias("v"), F.array(p, 1 - p).alias("probs"))
    return resample.soft_cuts(v, 1, 2.0, 0.2).select("tp", *_r("loss"))


_sql(
    "soft_cut_loss",
    "WITH c AS (SELECT tp, z, y, x, v / 1e5 AS v, k, CASE WHEN (v > 40000) = (k = 0) THEN CASE WHEN k = 0 THEN 0.9 ELSE 0.8 END ELSE CASE WHEN k = 0 THEN 0.2 ELSE 0.1 END END::DOUBLE AS p FROM voxel, range(2) r(k)), "
    "m AS (SELECT tp, k, avg(v * p) / (avg(p) + 1e-5) AS m FROM c GROUP BY tp, k), w AS (SELECT c.*, exp(-((v - m) ** 4) / 0.04) AS w FROM c JOIN m USING (tp, k)), d AS (SELECT unnest(range(-1, 2)) AS d), "
    "o AS (SELECT a.d AS a, b.d AS b, c.d AS c, exp(-(a.d ** 2 + b.d ** 2 + c.d ** 2) / 8.0) AS g FROM d a, d b, d c), s AS (SELECT tp, k, z + a AS z, y + b AS y, x + c AS x, sum(p * w * g) AS i, sum(w * g) AS al FROM w, o GROUP BY ALL), "
    "r AS (SELECT tp, k, sum(w.p * i) / (sum(w.p * al) + 1e-6) AS s FROM w JOIN s USING (tp, k, z, y, x) GROUP BY tp, k) SELECT tp, round(2 - sum(abs(s)) + 1e-9, 4) AS loss FROM r GROUP BY tp",
    "voxel",
)


@query
def view_pair_products(spark, sf):
    """Products of four student views of each vector with two teacher views, equal indexes left out."""
    part = lambda k: F.transform(F.slice("embedding", 16 * k + 1, 16), lambda x: x.cast("double"))
    s = table(spark, sf, "embeddings").select("vec_id", F.array(*(part(k) for k in range(4))).alias("students"), F.array(part(2), part(3)).alias("teachers"))
    pairs = sampling.view_pairs(s, "students", "teachers", skip_same=True)
    dot = F.aggregate(F.zip_with("student", "teacher", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    return pairs.groupBy("vec_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum(dot).alias("total")).select("vec_id", "pairs", *_r("total"))


_sql(
    "view_pair_products",
    "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT vec_id, list_dot_product(e[16 * i + 1:16 * i + 16], e[16 * j + 33:16 * j + 48]) AS d FROM e, range(4) a(i), range(2) b(j) WHERE i <> j) SELECT vec_id, count(*) AS pairs, round(sum(d) + 1e-9, 4) AS total FROM p GROUP BY vec_id",
)


@query
def batches_and_back(spark, sf):
    rows = numbered(table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"], "position").withColumn("position", F.col("position") - 1)
    return sampling.unbatched(sampling.batched(rows, "position", 32)).select("batch", "at", "doc_id", "quality")


_sql("batches_and_back", "SELECT (n // 32)::INT AS batch, (n % 32)::INT AS \"at\", doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM labels)")


@query
def token_cells(spark, sf):
    g = sampling.token_grid(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", (2, 4, 8))
    return g.groupBy("vec_id", "z", "y").agg(F.sum(F.col("token").cast("double") * (F.col("x") + 1)).alias("total")).select("vec_id", "z", "y", *_r("total"))


_sql("token_cells", "SELECT vec_id, z::INT AS z, y::INT AS y, round(sum(embedding[32 * z + 8 * y + x + 1]::DOUBLE * (x + 1)) + 1e-9, 4) AS total FROM embeddings, range(2) a(z), range(4) b(y), range(8) c(x) GROUP BY ALL")


@query
def rows_of_ranks(spark, sf):
    rows = numbered(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], "position").withColumn("position", F.col("position") - 1)
    return sampling.ranked(rows, "position", 7).select("c_custkey", "rank", "turn")


_sql(
    "rows_of_ranks",
    "WITH n AS (SELECT count(*) AS n FROM customer), r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer) SELECT c_custkey, (s % 7)::INT AS rank, s // 7 AS turn FROM n, range(0, ((SELECT n FROM n) + 6) // 7 * 7) t(s) JOIN r ON r.p = s % n",
)
