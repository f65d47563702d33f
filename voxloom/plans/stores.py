"""Registered queries of shards, the token store, job states, masks and spread centroids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..checkpoints import shared_folder
from ..operators import crops, masks, vectors
from ..sources import shards, token_store
from ..streaming import job_state
from .more import _sql
from .queries import SHAPE, _r, query
from .views import table, view


@query
def shard_samples(spark, sf):
    """Pages as samples of two files, written to shards in two jobs and read back."""
    pages = table(spark, sf, "pages").withColumn("html", F.coalesce("html", F.lit("")))
    samples = pages.select("page_id", F.concat(F.lit("page/p"), F.col("page_id").cast("string")).alias("key"), F.map_from_arrays(F.array(F.lit("html"), F.lit("url.txt")), F.array(F.col("html").cast("binary"), F.coalesce("url", F.lit("")).cast("binary"))).alias("files"))
    path = shared_folder(spark, "shards")
    for half in (0, 1):
        shards.write_shards(samples.filter(F.col("page_id") % 2 == half), path, maxsize=10**9)
    got = shards.read_shards(spark, shards.written_shards(path))
    return got.select(F.substring_index("key", "/p", -1).cast("long").alias("page_id"), F.md5(F.col("files")["html"]).alias("digest"), F.octet_length(F.col("files")["html"]).cast("long").alias("bytes"), F.decode(F.col("files")["url.txt"], "UTF-8").alias("url"))


_sql("shard_samples", "SELECT page_id, md5(coalesce(html, '')) AS digest, strlen(coalesce(html, ''))::BIGINT AS bytes, coalesce(url, '') AS url FROM pages")


@query
def token_store_cells(spark, sf):
    """Vectors written to a store; the rows after five special ones are its cells."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").alias("vec"))
    about = e.agg(F.max("row").alias("last"), F.max(F.size("vec")).alias("width")).first()
    path = shared_folder(spark, "tokens")
    token_store.create(path, about["last"] + 1, about["width"], "float32", block=256)
    token_store.write_rows(e, path)
    cells = token_store.read_rows(spark, path, start=5)
    return cells.select((F.col("row") - 5).alias("cell"), F.aggregate("vec", F.lit(0.0), lambda s, x: s + x).alias("total"), F.col("vec")[0].cast("double").alias("first")).select("cell", *_r("total", "first"))


_sql("token_store_cells", "SELECT vec_id - 5 AS cell, round(list_sum(embedding::DOUBLE[]) + 1e-9, 4) AS total, round(embedding[1]::DOUBLE + 1e-9, 4) AS first FROM embeddings WHERE vec_id >= 5")


@query
def stream_job_states(spark, sf):
    """Jobs expect 45 paths; every third one is asked to stop at its 20th line; lines come in two starts of the stream."""
    log = view(spark, sf, "log").withColumn("n", F.row_number().over(Window.partitionBy("job_id").orderBy("seq")))
    lines = log.select("job_id", (F.col("seq") + 100).alias("seq"), F.lit("line").alias("kind"), F.col("line").alias("text"), "n")
    paths = table(spark, sf, "events").select(F.concat(F.lit("/out/hr_feats/"), "event_type", (F.col("event_id") % 9).cast("string"), F.lit(".npy")).alias("text")).distinct()
    expected = log.select("job_id").distinct().withColumn("text", F.explode(F.array(*(F.lit(r.text) for r in paths.collect()))))  # 45 at most
    stops = lines.filter((F.col("n") == 20) & (F.col("job_id").cast("long") % 3 == 0)).select("job_id", "seq", F.lit("stop").alias("kind"), F.lit(None).cast("string").alias("text"))
    path = shared_folder(spark, "jobs")
    early, late = lines.filter("n <= 30").drop("n"), lines.filter("n > 30").drop("n")
    first = expected.select("job_id", F.lit(0).cast("long").alias("seq"), F.lit("expect").alias("kind"), "text").unionByName(stops).unionByName(early)
    for part in (first, late):
        part.write.mode("append").parquet(f"{path}/events")
        job_state.run(spark.readStream.schema(job_state.EVENTS).parquet(f"{path}/events"), f"{path}/states", f"{path}/checkpoint")
    return job_state.latest(spark, f"{path}/states").select("job_id", "status", "processed", "total")


_sql(
    "stream_job_states",
    "WITH n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n FROM log), c AS (SELECT job_id, count(*) AS lines, count(DISTINCT CASE WHEN job_id::BIGINT % 3 <> 0 OR n < 20 THEN line END)::INT AS processed FROM n GROUP BY job_id), "
    "t AS (SELECT count(DISTINCT event_type || event_id % 9)::INT AS total FROM events) "
    "SELECT job_id, CASE WHEN job_id::BIGINT % 3 = 0 AND lines >= 20 THEN 'stopped' ELSE 'running' END AS status, processed, total FROM c, t",
    "log",
)


@query
def block_masks(spark, sf):
    """No SQL: blocks at random places; compared with a sequential version in the tests."""
    samples = table(spark, sf, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 28).alias("batch"))
    told = masks.scheduled(samples, "vec_id", "batch", 0.1, 0.5, 0.5)
    return masks.block_masks(told, "vec_id", (14, 14, 14)).select("vec_id", "goal", F.size("patches").alias("n"), F.array_join("patches", ",").alias("patches"), *_r("ratio", "weight", digits=6))


@query
def scheduled_ratios(spark, sf):
    samples = table(spark, sf, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 28).alias("batch"))
    return masks.scheduled(samples, "vec_id", "batch", 0.1, 0.5, 0.5).select("vec_id", "batch", *_r("ratio", digits=6))


_HASH = "('0x' || substr(md5('{0}' || vec_id), 1, 12))::BIGINT::DOUBLE / 281474976710656.0"
_sql(
    "scheduled_ratios",
    f"WITH s AS (SELECT vec_id, vec_id // 28 AS batch, {_HASH.format('mask:')} AS u, {_HASH.format('mask:step:')} AS v FROM embeddings), "
    "k AS (SELECT *, floor(count(*) OVER (PARTITION BY batch) * 0.5) AS n, row_number() OVER (PARTITION BY batch ORDER BY u, vec_id) - 1 AS k FROM s) "
    "SELECT vec_id, batch, round(CASE WHEN k < n THEN 0.1 + 0.4 * (k + v) / n ELSE 0 END, 6) AS ratio FROM k",
)


@query
def kmeans_spread(spark, sf):
    """No SQL: random draws; the tests compare the cost with a sequential choice."""
    points = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    near, _ = vectors.kmeans(points, vectors.spread_centroids(points, 10), rounds=5, reseed=True)
    return near.select("id", "k", *_r("distance"))


@query
def nearest_seeds(spark, sf):
    """Bright voxels by the nearest of the brightest ones, numbered by place."""
    v = view(spark, sf, "voxel")
    seeds = v.filter("v > 75000 and (z + y + x) % 5 = 0").select("tp", "z", "y", "x", (F.col("z") * 10000 + F.col("y") * 100 + F.col("x")).alias("label"))
    return crops.nearest_seed(v.filter("v > 40000"), seeds, SHAPE)


_sql(
    "nearest_seeds",
    "WITH s AS (SELECT *, z * 10000 + y * 100 + x AS label FROM voxel WHERE v > 75000 AND (z + y + x) % 5 = 0), "
    "p AS (SELECT c.tp, c.z, c.y, c.x, min({'far': (c.z - s.z) ** 2 + (c.y - s.y) ** 2 + (c.x - s.x) ** 2, 'label': s.label}) AS m FROM voxel c JOIN s USING (tp) WHERE c.v > 40000 GROUP BY ALL) "
    "SELECT tp, z, y, x, m.far::BIGINT AS far, m.label::BIGINT AS label FROM p",
    "voxel",
)
