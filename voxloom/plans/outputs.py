"""Registered queries of outputs, reports, crops and grown regions, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crops, outputs, scaling
from .more import _sql
from .queries import SHAPE, _r, query
from .views import table, view


@query
def overwritten_outputs(spark, sf):
    """Entries of output folders made of page numbers, with what either kind of run deletes."""
    tops = F.array(*(F.lit(t) for t in ("lr_feats", "raw", "tmp", "norm_per_vol.txt", "hr_feats", "pca_3", "pca_12", "raw2")))
    e = table(spark, sf, "pages").select("page_id", F.concat_ws("/", F.element_at(tops, (F.col("page_id") % 8 + 1).cast("int")), F.col("page_id").cast("string")).alias("path"))
    n = F.when(F.col("page_id") % 3 == 0, 12).otherwise(3)
    return e.select("page_id", outputs.managed(F.col("path")).alias("managed"), outputs.requested(F.col("path"), F.col("page_id") % 5 != 0, n, F.col("page_id") % 7 != 0).alias("requested"))


_sql(
    "overwritten_outputs",
    "SELECT page_id, page_id % 8 < 4 AS managed, (page_id % 5 <> 0 AND page_id % 8 = CASE WHEN page_id % 3 = 0 THEN 6 ELSE 5 END) OR (page_id % 7 <> 0 AND page_id % 8 = 4) AS requested FROM pages",
)


@query
def metric_json_lines(spark, sf):
    m = view(spark, sf, "metric").select("name", "iteration", F.floor("value").cast("long").alias("median"))
    times = m.select("iteration").distinct().select("iteration", (F.col("iteration") % 90).alias("iter_time"), (F.col("iteration") % 7).alias("data_time"))
    return outputs.metric_lines(m.filter("median % 4 <> 0"), times)


_sql(
    "metric_json_lines",
    "SELECT iteration, '{\"iteration\":' || iteration || ',\"iter_time\":' || iteration % 90 || ',\"data_time\":' || iteration % 7 || coalesce(string_agg(CASE WHEN floor(value)::BIGINT % 4 <> 0 THEN ',\"' || name || '\":' || floor(value)::BIGINT END, '' ORDER BY name), '') || '}' AS line FROM metric GROUP BY iteration",
    "metric",
)


@query
def list_reports(spark, sf):
    f = view(spark, sf, "file").groupBy(F.concat(F.lit("list"), F.col("page_id") % 2, F.lit(".txt")).alias("list"), "dir").agg(F.sum(F.col("length") * 100000).alias("size"), F.count_if(F.lower("name").rlike(r"\.tiff?$")).alias("tifs"))
    return outputs.report(f)


_sql(
    "list_reports",
    "SELECT list, '## File: ' || list || chr(10) || chr(10) || '- Experiments: ' || count(*) || chr(10) || chr(10) || '- Total data: ' || printf('%.2f', round_even(sum(size) / 1073741824.0::DOUBLE, 2)) || ' GB' || chr(10) || chr(10) || '- Avg z-frames (TIFs) per experiment: ' "
    "|| printf('%.1f', round_even(sum(tifs)::DOUBLE / count(*), 1)) || chr(10) || chr(10) || '- Avg size per experiment: ' || printf('%.2f', round_even(sum(size)::DOUBLE / count(*) / 1073741824.0::DOUBLE, 2)) || ' GB' || chr(10) AS text "
    "FROM (SELECT 'list' || page_id % 2 || '.txt' AS list, dir, sum(length * 100000)::BIGINT AS size, count(*) FILTER (regexp_matches(lower(name), '\\.tiff?$')) AS tifs FROM file GROUP BY ALL) GROUP BY list",
    "file",
)


@query
def store_blocks(spark, sf):
    b = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"))
    return b.select("o_custkey", F.explode(outputs.row_blocks(F.col("total"), 4)).alias("b")).select("o_custkey", "b.first", "b.past")


_sql("store_blocks", 'SELECT o_custkey, 4 * k AS "first", least(4 * k + 4, n) AS past FROM (SELECT o_custkey, n, unnest(range((n + 3) // 4)) AS k FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey))')


@query
def permuted_axes(spark, sf):
    """Slices along what was the x axis, with the values scaled and clipped by name."""
    v = outputs.each_named(view(spark, sf, "voxel"), {"v": [lambda c: c / 1000, lambda c: F.least(c, F.lit(50.0))]})
    return outputs.permuted(v, "xzy").groupBy("tp", "z").agg(F.sum(F.col("v") * (F.col("y") + 1)).alias("total"), F.max("x").alias("most")).select("tp", "z", "most", *_r("total"))


_sql("permuted_axes", "SELECT tp, x AS z, max(y) AS most, round(sum(least(v::DOUBLE / 1000, 50) * (z + 1)) + 1e-9, 4) AS total FROM voxel GROUP BY tp, x", "voxel")


@query
def centre_crops(spark, sf):
    """Two boxes a volume around the mean place of its dark and its bright voxels; sides are drawn by a hash."""
    v = view(spark, sf, "voxel")
    centres = v.groupBy("tp", (F.col("v") > 40000).cast("int").alias("box")).agg(*(F.avg(a).alias(a) for a in "zyx"))
    held = crops.cropped(v, crops.boxes_around(centres, SHAPE, 0.4, 0.8))
    return held.groupBy("tp", "box").agg(F.count(F.lit(1)).alias("n"), *(F.max(a).alias(f"m{a}") for a in "zyx"), F.sum("v").alias("total")).select("tp", "box", "n", "mz", "my", "mx", *_r("total", digits=2))


_sql(
    "centre_crops",
    "WITH c AS (SELECT tp, (v > 40000)::INT AS box, avg(z) AS z, avg(y) AS y, avg(x) AS x FROM voxel GROUP BY ALL), h AS (SELECT *, [(0.4 + (0.8 - 0.4)::DOUBLE * (('0x' || md5('box:' || tp || ':' || box || ':' || a)[1:12])::BIGINT::DOUBLE / 281474976710656)) / 2 FOR a IN ['z', 'y', 'x']] AS s FROM c), "
    "b AS (SELECT tp, box, trunc(greatest(z - s[1] * 9, 0))::INT AS z0, trunc(least(z + s[1] * 9, 9))::INT AS z1, trunc(greatest(y - s[2] * 51, 0))::INT AS y0, trunc(least(y + s[2] * 51, 51))::INT AS y1, trunc(greatest(x - s[3] * 11, 0))::INT AS x0, trunc(least(x + s[3] * 11, 11))::INT AS x1 FROM h) "
    "SELECT tp, box, count(*) AS n, max(z - z0) AS mz, max(y - y0) AS my, max(x - x0) AS mx, round(sum(v)::DOUBLE + 1e-9, 2) AS total FROM voxel JOIN b USING (tp) WHERE z >= z0 AND z < z1 AND y >= y0 AND y < y1 AND x >= x0 AND x < x1 GROUP BY tp, box",
    "voxel",
)


@query
def local_maxima(spark, sf):
    return crops.maxima(view(spark, sf, "voxel")).select("tp", "z", "y", "x", *_r("v", digits=2))


_sql(
    "local_maxima",
    "SELECT tp, z, y, x, round(v::DOUBLE + 1e-9, 2) AS v FROM voxel a WHERE NOT EXISTS (SELECT 1 FROM voxel b WHERE b.tp = a.tp AND b.z BETWEEN a.z - 1 AND a.z + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.v > a.v)",
    "voxel",
)


@query
def voronoi_regions(spark, sf):
    """No SQL (rounds of growth): compared with a brute-force version in the tests."""
    v = view(spark, sf, "voxel")
    return crops.voronoi_otsu(v, scaling.minmax_scale(v, ["tp"]).select("tp", "z", "y", "x", F.col("scaled").alias("v")), SHAPE[1], SHAPE[2])
