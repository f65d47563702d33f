"""More registered queries, each beside its DuckDB SQL: launch checks, exchanged tables, channels, masks, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import exchange, launch, matching, voxels
from ..streaming import progress
from .queries import _r, query
from .views import table, view, with_views

SQL: dict[str, str] = {}


def _sql(name: str, text: str, *views: str) -> None:
    SQL[name] = with_views(text, *views) if views else text


# -- launch ---------------------------------------------------------------------------------------------------------


@query
def path_problems(spark, sf):
    """Paths made of the files' folders, some relative, some leaving their root."""
    f = view(spark, sf, "file").select("page_id", F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("data/"), "name")).when(F.col("page_id") % 5 == 1, F.concat(F.col("dir"), F.lit("/../../../other/"), F.col("name"))).otherwise(F.concat(F.col("dir"), F.lit("/./"), F.col("name"))).alias("path"))
    return f.select("page_id", launch.normal_path(F.col("path")).alias("normal"), launch.path_problem(F.col("path"), F.array(F.lit("/data/Ex00"), F.lit("/data/Ex01"), F.lit("/data/Ex0"))).alias("problem"))


_sql(
    "path_problems",
    "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '/data/' || name WHEN page_id % 5 = 1 THEN '/other/' || name ELSE dir || '/' || name END AS normal, "
    "CASE WHEN page_id % 7 = 0 THEN 'not_absolute' WHEN page_id % 5 = 1 THEN 'outside' WHEN page_id % 5 = 0 THEN NULL ELSE 'outside' END AS problem FROM file",
    "file",
)


@query
def longest_root(spark, sf):
    roots = spark.createDataFrame([("/",), ("/data",), ("/data/Ex01",), ("/data/Ex02/DS",)], "root string")
    paths = view(spark, sf, "file").select("page_id", F.concat_ws("/", "dir", "name").alias("path"))
    return launch.root_of(paths, roots).select("page_id", "root")


_sql("longest_root", "SELECT page_id, CASE page_id % 5 WHEN 1 THEN '/data/Ex01' WHEN 2 THEN '/data/Ex02/DS' ELSE '/data' END AS root FROM file", "file")


@query
def visible_entries(spark, sf):
    e = view(spark, sf, "file").select(
        "page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("."), "name")).otherwise(F.col("name")).alias("name"), "is_dir", (F.col("page_id") % 4 == 1).alias("is_link"),
        F.when(F.col("page_id") % 8 == 1, F.lit("/data/in")).otherwise(F.lit("/data/../out")).alias("target"), F.lit(True).alias("target_is_dir"),
    )
    return launch.visible(e, "/data", dirs_only=True).select("page_id", "name", "is_dir")


_sql("visible_entries", "SELECT page_id, name, true AS is_dir FROM file WHERE page_id % 3 <> 0 AND (is_dir OR page_id % 8 = 1)", "file")


@query
def shape_problems(spark, sf):
    f = view(spark, sf, "file").select("dir", "name", "page_id", F.when(F.col("page_id") % 50 == 33, F.array(F.lit(4), F.lit(5))).when(F.col("page_id") % 40 == 11, F.array(F.lit(4), F.lit(5), F.lit(7))).otherwise(F.array(F.lit(4), F.lit(5), F.lit(6))).alias("shape"))
    return launch.shape_problems(f, ["dir"], "page_id").select("dir", "files", F.array_join("expected", "x").alias("expected"), "file", "reason")


_sql(
    "shape_problems",
    "WITH s AS (SELECT dir, name, page_id, CASE WHEN page_id % 50 = 33 THEN '4x5' WHEN page_id % 40 = 11 THEN '4x5x7' ELSE '4x5x6' END AS shape FROM file), f AS (SELECT dir, count(*) AS files, arg_min(shape, page_id) AS expected FROM s GROUP BY dir), "
    "b AS (SELECT dir, arg_min(name, page_id) AS file, arg_min(CASE WHEN shape = '4x5' THEN 'not_3d' ELSE 'shape_mismatch' END, page_id) AS reason FROM s JOIN f USING (dir) WHERE shape = '4x5' OR shape <> expected GROUP BY dir) "
    "SELECT dir, files, expected, file, reason FROM f LEFT JOIN b USING (dir)",
    "file",
)


def _requests(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    gpus = spark.createDataFrame([(0,), (1,)], "gpu int")
    common = o.select(
        "o_orderkey", F.when(k % 11 == 0, "missing").alias("folder_problem"), F.when(k % 13 == 0, "output_not_directory").alias("output_problem"), F.when(k % 7 != 0, (k % 3).cast("int")).alias("gpu"), (k % 6).cast("int").alias("subfolders"),
        (k % 2 == 0).alias("save_pca"), (k % 5 == 0).alias("save_high"), F.when(k % 17 == 0, ".png").otherwise(".npy").alias("high_format"), F.when(k % 19 == 0, ".gif").otherwise(".tif").alias("pca_format"),
        F.when(k % 5 == 0, "voronoi-otsu").when(k % 23 == 0, "other").otherwise("probability-map").alias("mode"), F.when(k % 9 == 4, "hist").otherwise("kde").alias("density_method"), (k % 4 < 2).alias("stage_1"), (k % 4 != 2).alias("stage_2"),
        F.when(k % 8 == 0, " ").when(k % 8 == 1, "t9").otherwise(" t1").alias("training_timepoint"), F.array(F.lit("t0"), F.lit("t1")).alias("timepoints"),
        F.lit("/m.tif").alias("seg_tif"), (k % 29 != 0).alias("seg_tif_exists"), F.when(k % 3 == 0, "/v.tif").alias("valid_mask"), (k % 27 != 0).alias("valid_mask_exists"), F.when(k % 4 == 3, "/d.npz").alias("densities"), (k % 31 != 0).alias("densities_exists"),
        F.when(k % 10 == 3, "400,x").when(k % 10 == 4, "0").when(k % 10 == 5, "").otherwise("400, 300").alias("thresholds"), F.when(k % 37 == 0, "shape_mismatch").alias("segmentation_problem"),
    )
    return common, gpus


_GPU = "WHEN k % 7 = 0 THEN 'missing_gpu_selection' WHEN k % 3 = 2 THEN 'invalid_gpu_selection' "
_IN = "CASE WHEN k % 11 = 0 THEN 'missing' "


@query
def features_launch(spark, sf):
    requests, gpus = _requests(spark, sf)
    return launch.features_launch(requests, gpus).select("o_orderkey", "reason", "progress_total")


_sql(
    "features_launch",
    f"WITH q AS (SELECT o_orderkey, o_orderkey AS k FROM orders), r AS (SELECT *, {_IN}WHEN k % 2 <> 0 AND k % 5 <> 0 THEN 'no_outputs_selected' {_GPU}WHEN k % 17 = 0 THEN 'invalid_high_resolution_format' WHEN k % 19 = 0 THEN 'invalid_pca_format' "
    "WHEN k % 13 = 0 THEN 'output_not_directory' END AS reason FROM q) SELECT o_orderkey, reason, CASE WHEN reason IS NULL THEN (k % 6)::INT END AS progress_total FROM r",
)


@query
def segmentation_launch(spark, sf):
    requests, gpus = _requests(spark, sf)
    return launch.segmentation_launch(requests, gpus).select("o_orderkey", "reason", "progress_total")


_sql(
    "segmentation_launch",
    f"WITH q AS (SELECT o_orderkey, o_orderkey AS k, o_orderkey % 5 <> 0 AS map FROM orders), r AS (SELECT *, {_IN}{_GPU}WHEN map AND k % 23 = 0 THEN 'invalid_segmentation_mode' WHEN k % 13 = 0 THEN 'output_not_directory' WHEN NOT map THEN NULL WHEN k % 9 = 4 THEN 'invalid_density_method' "
    "WHEN k % 4 = 2 THEN 'no_probability_map_stages_selected' WHEN k % 4 < 2 AND k % 8 = 0 THEN 'missing_training_timepoint' WHEN k % 4 < 2 AND k % 8 = 1 THEN 'invalid_training_timepoint' WHEN k % 4 < 2 AND k % 29 = 0 THEN 'missing_seg_tif' "
    "WHEN k % 4 < 2 AND k % 3 = 0 AND k % 27 = 0 THEN 'missing_valid_mask_tif' WHEN k % 4 = 3 AND k % 31 = 0 THEN 'missing_probmap_densities' END AS reason FROM q) "
    "SELECT o_orderkey, reason, CASE WHEN reason IS NOT NULL THEN NULL WHEN map THEN (CASE WHEN k % 4 < 2 THEN 2 ELSE 0 END + CASE WHEN k % 4 <> 2 THEN k % 6 ELSE 0 END)::INT ELSE (k % 6)::INT END AS progress_total FROM r",
)


@query
def tracking_launch(spark, sf):
    return launch.tracking_launch(_requests(spark, sf)[0]).select("o_orderkey", "reason", "pair_count", "progress_total")


_sql(
    "tracking_launch",
    f"WITH r AS (SELECT o_orderkey, o_orderkey AS k, {_IN}WHEN k % 37 = 0 THEN 'shape_mismatch' WHEN k % 13 = 0 THEN 'output_not_directory' WHEN k % 10 IN (3, 4) THEN 'invalid_vote_thresholds' END AS reason FROM orders) "
    "SELECT o_orderkey, reason, CASE WHEN reason IS NULL THEN greatest(k % 6 - 1, 0)::INT END AS pair_count, CASE WHEN reason IS NULL THEN (k % 6 + greatest(k % 6 - 1, 0))::INT END AS progress_total FROM r",
)


@query
def crop_problems(spark, sf):
    k = F.col("o_orderkey").cast("int")
    size = [F.lit(9), F.lit(51), F.lit(11)]
    bounds = [k % 10, k % 12, k % 53, k % 60, F.lit(0), k % 14]
    lo, hi = launch.crop_bounds(k % 4 - 1, k % 15 - 3, F.lit(9))
    return table(spark, sf, "orders").select("o_orderkey", launch.crop_problem(bounds, size).alias("problem"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


_sql(
    "crop_problems",
    "SELECT o_orderkey, CASE WHEN k % 10 >= k % 12 THEN 'empty_z' WHEN k % 53 >= k % 60 THEN 'empty_y' WHEN 0 >= k % 14 THEN 'empty_x' WHEN k % 10 >= 9 THEN 'start_z' WHEN k % 53 >= 51 THEN 'start_y' WHEN k % 12 > 9 THEN 'end_z' WHEN k % 60 > 51 THEN 'end_y' "
    "WHEN k % 14 > 11 THEN 'end_x' END AS problem, greatest(k % 4 - 1, 0)::INT AS lo, CASE WHEN k % 15 - 3 <= 0 THEN 9 ELSE least(k % 15 - 3, 9) END::INT AS hi FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)",
)


@query
def two_phase_progress(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("job_id"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("[tracking] Completed t"), F.col("event_id") % 6)).otherwise(F.concat(F.lit("\x1b[1m[tracking] Matched t"), F.col("event_id") % 5, F.lit(" -> t"), F.col("event_id") % 5 + 1, F.lit(" (1/5)\x1b[0m\r"))).alias("line"),
    )
    jobs = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("job_id"), F.lit(6).alias("timepoints"))
    return progress.two_phases(e, jobs)


_sql(
    "two_phase_progress",
    "WITH d AS (SELECT user_id::VARCHAR AS job_id, count(DISTINCT CASE WHEN event_id % 2 = 0 THEN event_id % 6 END) AS prepared, count(DISTINCT CASE WHEN event_id % 2 <> 0 THEN event_id % 5 END) AS matched FROM events GROUP BY 1) "
    "SELECT c_custkey::VARCHAR AS job_id, coalesce(prepared, 0) AS prepared, coalesce(matched, 0) AS matched, least(11, coalesce(prepared, 0) + coalesce(matched, 0))::INT AS processed, 11 AS total FROM customer LEFT JOIN d ON d.job_id = c_custkey::VARCHAR",
)


# -- names ----------------------------------------------------------------------------------------------------------


@query
def casefold_order(spark, sf):
    n = table(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("name"), F.lit(0).alias("one"))
    return launch.newest_first(n, "one", [S.casefold_key(F.col("name"))]).select("name", "place")


_sql("casefold_order", "SELECT name, row_number() OVER (ORDER BY lower(name), name)::INT AS place FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS name FROM nation)")


@query
def name_checks(spark, sf):
    f = view(spark, sf, "file").select("page_id", F.concat(F.when(F.col("page_id") % 3 == 0, "pca_").otherwise("PCA_"), F.col("page_id")).alias("folder"), F.when(F.col("page_id") % 4 == 0, " ").otherwise(F.concat(F.col("page_id") + 1, F.lit(", ,7"))).alias("text"), "name")
    page = S.placed(F.lit("<p>{name}</p>"), {"{name}": F.concat(F.lit("a<b & "), F.col("name"))})
    return f.select("page_id", S.pca_components(F.col("folder")).alias("components"), F.array_join(S.positive_thresholds(F.col("text")), "+").alias("thresholds"), page.alias("page"))


_sql(
    "name_checks",
    "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN page_id::INT END AS components, CASE WHEN page_id % 4 <> 0 THEN (page_id + 1) || '+7' END AS thresholds, '<p>a&lt;b &amp; ' || name || '</p>' AS page FROM file",
    "file",
)


@query
def parameters(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "Y").when(F.col("o_orderkey") % 3 == 1, " off").alias("a"), F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 100).cast("string")).alias("b"))
    return o.select("o_orderkey", S.flag(F.col("a"), True).alias("flag"), S.bounded_int(F.col("b"), 20, 0, 100).alias("number"))


_sql("parameters", "SELECT o_orderkey, o_orderkey % 3 <> 1 AS flag, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 100 ELSE 20 END AS number FROM orders")


# -- exchanged tables -----------------------------------------------------------------------------------------------


def _curves(spark, sf):
    return table(spark, sf, "labels").groupBy((F.col("doc_id") % 7).alias("c")).agg(F.array_sort(F.collect_list(F.col("doc_id").cast("double"))).alias("x"))


@query
def padded_curves(spark, sf):
    p = exchange.padded(_curves(spark, sf), "x", -1.0)
    return p.select("c", "length", F.size("x").alias("width"), F.aggregate("x", F.lit(0.0), lambda s, v: s + v).alias("total"))


_sql("padded_curves", "WITH l AS (SELECT doc_id % 7 AS c, count(*)::INT AS length, sum(doc_id)::DOUBLE AS s FROM labels GROUP BY 1), m AS (SELECT max(length) AS width FROM l) SELECT c, length, width, s - (width - length) AS total FROM l, m")


@query
def aligned_lists(spark, sf):
    n = table(spark, sf, "nation")
    saved = n.select(F.col("n_name").alias("name"), (24 - F.col("n_nationkey")).alias("position"), F.col("n_regionkey").alias("value"))
    return exchange.aligned(n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("position")), saved).select("name", "position", "value")


_sql("aligned_lists", "SELECT n_name AS name, n_nationkey AS position, n_regionkey AS value FROM nation")


@query
def chosen_of_manifest(spark, sf):
    m = table(spark, sf, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    chosen = exchange.selected(m, m.filter("n_nationkey % 4 = 1").select("name"))
    return exchange.present(chosen, table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey")), ["n_nationkey"])


_sql("chosen_of_manifest", "SELECT n_name AS name, n_nationkey FROM nation WHERE n_nationkey % 4 = 1 AND n_nationkey IN (SELECT c_nationkey FROM customer)")


@query
def merged_metadata(spark, sf):
    older = F.create_map(F.lit("a"), F.col("l_quantity").cast("string"), F.lit("b"), F.col("l_tax").cast("string"))
    newer = F.when(F.col("l_linenumber") == 1, F.create_map(F.lit("b"), F.lit("x"), F.lit("c"), F.lit("y"))).otherwise(F.create_map(F.lit("c"), F.lit("z")))
    m = table(spark, sf, "lineitem").select("l_linenumber", exchange.merged(older, newer).alias("m"))
    return m.groupBy("l_linenumber", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("names"), (F.col("m")["b"] == "x").alias("newer"), F.col("m")["c"].alias("c")).agg(F.count(F.lit(1)).alias("n"))


_sql("merged_metadata", "SELECT l_linenumber, 'a,b,c' AS names, l_linenumber = 1 AS newer, CASE WHEN l_linenumber = 1 THEN 'y' ELSE 'z' END AS c, count(*) AS n FROM lineitem GROUP BY 1")


@query
def values_with_curves(spark, sf):
    values = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 7).alias("c"))
    return exchange.with_curves(values, _curves(spark, sf)).select("doc_id", "c", F.size("x").alias("points"))


_sql("values_with_curves", "SELECT doc_id, d.doc_id % 7 AS c, points FROM documents d JOIN (SELECT doc_id % 7 AS c, count(*)::INT AS points FROM labels GROUP BY 1) l ON l.c = d.doc_id % 7")


@query
def sparse_rows(spark, sf):
    m = view(spark, sf, "mask").select(F.concat_ws("/", "tp", "z").alias("row"), (F.col("y") * 11 + F.col("x")).alias("k"), "label")
    rows = exchange.sparse(m, "row", "k", "label")
    back = exchange.dense(rows, "row", "k", "label").groupBy("row").agg(F.sum("label").alias("total"), F.max("k").alias("last"))
    return rows.join(back, "row", "left").select("row", "n", "total", "last")


_sql("sparse_rows", "SELECT tp || '/' || z AS row, count(*) FILTER (label <> 0)::INT AS n, sum(label) FILTER (label <> 0)::BIGINT AS total, max(y * 11 + x) FILTER (label <> 0)::INT AS last FROM mask GROUP BY 1", "mask")


@query
def job_json(spark, sf):
    return exchange.as_json(view(spark, sf, "job").select("job_id", "created_at_ms", "stop_requested", "exit_code"), "job_id")


_sql("job_json", "SELECT job_id, '{\"jobId\":\"' || job_id || '\",\"createdAtMs\":' || created_at_ms || ',\"stopRequested\":' || stop_requested || CASE WHEN exit_code IS NULL THEN '' ELSE ',\"exitCode\":' || exit_code END || '}' AS json FROM job", "job")


@query
def set_operations(spark, sf):
    c, s = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return count(exchange.in_both(c, s), "both").union(count(exchange.every_one([c, s, s]), "either"))


_sql("set_operations", "SELECT 'both' AS what, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")


# -- volumes and tokens ---------------------------------------------------------------------------------------------


@query
def channel_sums(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    both = voxels.with_attention(F.slice("v", 1, 8), voxels.repeated_channel(F.col("v")[8], 6))
    return e.select("vec_id", voxels.channel_sum(F.col("v")).alias("total"), voxels.channel_sum(both).alias("first"), voxels.channel_sum(F.slice("v", 1, 3)).alias("few")).select("vec_id", *_r("total", "first", "few"))


_sql("channel_sums", "SELECT vec_id, round(list_sum(embedding[1:58]::DOUBLE[]) + 1e-9, 4) AS total, round(list_sum(embedding[1:8]::DOUBLE[]) + 1e-9, 4) AS first, round(list_sum(embedding[1:3]::DOUBLE[]) + 1e-9, 4) AS few FROM embeddings")


@query
def background_images(spark, sf):
    return voxels.backgrounds(view(spark, sf, "voxel").withColumn("v", F.col("v") / 100000), ["tp", "z"]).select("tp", "z", *_r("total"), "is_background")


_sql("background_images", "SELECT tp, z, round(sum(v / 100000) + 1e-9, 4) AS total, sum(v / 100000) < 10 AS is_background FROM voxel GROUP BY tp, z", "voxel")


@query
def mask_indices(spark, sf):
    i = voxels.slice_indices(view(spark, sf, "mask"), ["tp"], 51, 11)
    return i.select("tp", "z", "chunk", "is_fg", F.size("indices").alias("n"), F.col("indices")[0].alias("first"))


_sql("mask_indices", "SELECT tp, z, (z // 4)::INT AS chunk, label <> 0 AS is_fg, count(*)::INT AS n, min(y * 11 + x)::INT AS first FROM mask GROUP BY ALL", "mask")


@query
def masked_slices(spark, sf):
    v = view(spark, sf, "voxel")
    flat = voxels.flat_mask(v, v.filter("z = 0 AND v > 50000"))
    return voxels.kept_slices(flat, v.filter("v > 90000"), ["tp"])


_sql(
    "masked_slices",
    "WITH f AS (SELECT * FROM voxel SEMI JOIN (SELECT y, x FROM voxel WHERE z = 0 AND v > 50000) USING (y, x)), s AS (SELECT tp, z, row_number() OVER (PARTITION BY tp ORDER BY z)::INT - 1 AS nz FROM (SELECT DISTINCT tp, z FROM voxel WHERE v > 90000)) "
    "SELECT tp, nz AS z, y, x, v FROM f JOIN s USING (tp, z)",
    "voxel",
)


@query
def sizes(spark, sf):
    k = F.col("o_orderkey").cast("long")
    before, after = voxels.feature_crop(k % 50, 8.0)
    return table(spark, sf, "orders").select(
        "o_orderkey", before.alias("before"), after.alias("after"), voxels.greatest_divisor(k, F.lit(360)).alias("gcd"), voxels.least_multiple(k % 100, F.lit(12)).alias("lcm"), voxels.due(k, 10, F.lit(7)).alias("due"),
        voxels.batch_rows(268435456, k % 500).alias("rows"), voxels.batch_channels(536870912, k % 400 + 1, k * 1000).alias("channels"),
    )


_sql(
    "sizes",
    "SELECT o_orderkey, ((k % 50) // 8 // 2)::INT AS before, ((k % 50) // 8 - (k % 50) // 8 // 2)::INT AS after, gcd(k, 360)::BIGINT AS gcd, CASE WHEN k % 100 = 0 THEN 0 ELSE lcm(k % 100, 12) END::BIGINT AS lcm, k % 10 = 0 OR k = 7 AS due, "
    "greatest(4096, 268435456 // (4 * greatest(k % 500, 1)))::BIGINT AS rows, greatest(1, least(k % 400 + 1, 536870912 // greatest(4 * k * 1000, 1)))::BIGINT AS channels FROM (SELECT o_orderkey, o_orderkey::BIGINT AS k FROM orders)",
)


@query
def normalised_volumes(spark, sf):
    return voxels.normalised(view(spark, sf, "voxel"), ["tp"], 2000.0, 60000.0).select("tp", "z", "y", "x", *_r("v"))


_sql("normalised_volumes", "WITH u AS (SELECT tp, z, y, x, (greatest(2000, least(v, 60000)) - 2000) / (58000 + 1e-6) AS v FROM voxel), e AS (SELECT tp, min(v) AS lo, max(v) AS hi FROM u GROUP BY tp) SELECT tp, z, y, x, round((v - lo) / (hi - lo + 1e-6) + 1e-9, 4) AS v FROM u JOIN e USING (tp)", "voxel")


@query
def neighbourhoods(spark, sf):
    return voxels.neighbourhoods(view(spark, sf, "voxel").filter("v > 40000"), ["tp"]).select("tp", "z", "y", "x", "n", *_r("total", digits=2))


_sql(
    "neighbourhoods",
    "WITH b AS (SELECT * FROM voxel WHERE v > 40000), d AS (SELECT unnest(range(-1, 2)) AS d), o AS (SELECT a.d AS a, b.d AS b, c.d AS c FROM d a, d b, d c) "
    "SELECT tp, z, y, x, count(*) AS n, round(sum(w) + 1e-9, 2) AS total FROM (SELECT tp, z + a AS z, y + b AS y, x + c AS x, v AS w FROM b, o) SEMI JOIN b USING (tp, z, y, x) GROUP BY tp, z, y, x",
    "voxel",
)


@query
def block_attention(spark, sf):
    s = view(spark, sf, "det").select("t", (F.col("label") % 4).alias("block"), (F.col("cx") / 2).alias("s"), F.col("cy").alias("v"))
    return voxels.attention(s, ["t"], "block").select("t", *_r("o"))


_sql("block_attention", "WITH m AS (SELECT t, max(cx / 2) AS m FROM det GROUP BY t) SELECT t, round(sum(exp(cx / 2 - m) * cy) / sum(exp(cx / 2 - m)) + 1e-9, 4) AS o FROM det JOIN m USING (t) GROUP BY t", "det")


@query
def any_flags(spark, sf):
    return voxels.any_true(table(spark, sf, "labels").withColumn("c", F.col("doc_id") % 50).withColumn("bad", F.col("toxic") == 1), ["c"], "bad")


_sql("any_flags", "SELECT doc_id % 50 AS c, bool_or(toxic = 1) AS \"any\" FROM labels GROUP BY 1")


@query
def random_masks(spark, sf):
    m = voxels.random_masks(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 32, 0.1, 0.5)
    return m.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.sum("patch").alias("patches"), F.round(F.sum("weight"), 6).alias("weight"))


_U = "('0x' || substr(md5('mask:' || vec_id{0}), 1, 12))::BIGINT::DOUBLE / 281474976710656.0"
_sql(
    "random_masks",
    f"WITH r AS (SELECT vec_id, floor((0.1 + 0.4 * {_U.format('')}) * 32) AS n FROM embeddings), p AS (SELECT vec_id, n, k, row_number() OVER (PARTITION BY vec_id ORDER BY {_U.format(chr(32) + '|| ' + chr(39) + ':' + chr(39) + ' || k')}, k) AS o FROM r, range(0, 32) q(k)) "
    "SELECT vec_id, count(*) AS n, sum(k)::BIGINT AS patches, 1.0 AS weight FROM p WHERE o <= n GROUP BY vec_id",
)


@query
def spectrum_gap(spark, sf):
    """No SQL: Fourier transforms; compared with numpy in the tests."""
    v = view(spark, sf, "voxel").select("tp", "z", "y", "x", (F.col("v") / 1e5).alias("a"), F.when(F.col("v") > 40000, F.col("v") / 1e5).otherwise(0.0).alias("b"))
    return voxels.spectrum_gap(v, ["tp"], (9, 51, 11)).select("tp", *_r("gap", digits=6))


@query
def ranked_candidates_by_distance(spark, sf):
    """Candidates of each object in the order of distance; equal ones in the order of labels."""
    c = matching.places_in_order(view(spark, sf, "det"), 5.0, 2.0, cells=("cy",))
    return matching.numbered(c, "object", lambda r: F.concat("t", F.lit(":"), r)).select("object", "cand", "place")


_sql(
    "ranked_candidates_by_distance",
    "SELECT a.t || ':' || a.label AS object, b.label AS cand, row_number() OVER (PARTITION BY a.t, a.label ORDER BY sqrt((a.cy - b.cy) ** 2 + (a.cx - b.cx) ** 2 + (a.cz - b.cz) ** 2)::FLOAT, b.label)::INT AS place "
    "FROM det a JOIN det b ON b.t = a.t + 1 AND abs(a.cy - b.cy) <= 5 AND abs(a.cx - b.cx) <= 5 AND abs(a.cz - b.cz) <= 2",
    "det",
)
