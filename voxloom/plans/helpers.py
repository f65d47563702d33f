"""Registered queries of index arithmetic, names, requests and listings, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import strings as S
from ..operators import catalogue, cleaning, grid, ops, scaling, tracks
from .more import _sql
from .queries import _r, query
from .views import table, view


@query
def index_arithmetic(spark, sf):
    """Parts as places in a volume of 9 x 51 x 11, sizes rounded up, and cells of a coarser axis."""
    p = table(spark, sf, "part").select("p_partkey", "p_size", N.unflatten(F.col("p_partkey"), 51, 11).alias("u"), N.padded_size(F.col("p_size").cast("long"), 10, 4).alias("c"))
    return p.select(
        "p_partkey", *(F.col(f"u.{a}").cast("long").alias(a) for a in "zyx"), N.flat_index(F.col("u.z"), F.col("u.y"), F.col("u.x"), 51, 11).alias("again"),
        N.ceil_to_multiple(F.col("p_partkey"), 8).alias("multiple"), N.nearest_low(F.col("p_size") - 1, 50, 20).alias("low"), "c.chunk", "c.target", "c.padding",
    )


_sql(
    "index_arithmetic",
    "WITH p AS (SELECT p_partkey, p_size, p_partkey // 561 AS z, p_partkey // 11 % 51 AS y, p_partkey % 11 AS x FROM part) SELECT p_partkey, z, y, x, (z * 51 + y) * 11 + x AS again, (p_partkey + 7) // 8 * 8 AS multiple, "
    "least((p_size - 1) * 20 // 50, 19)::INT AS low, 12::BIGINT AS chunk, (p_size + 11) // 12 * 12::BIGINT AS target, ((p_size + 11) // 12 * 12 - p_size)::BIGINT AS padding FROM p",
)


@query
def curve_terms(spark, sf):
    share = F.col("p_size") / 50.0
    p = table(spark, sf, "part").select("p_partkey", N.remap(share, -1.0, 3.0).alias("remapped"), N.unnormalise(share, F.lit(0.163), F.lit(0.0988)).alias("raw"), N.layer_decay(0.75, 12, F.col("p_size") % 13).alias("rate"), N.charbonnier(F.col("p_retailprice") / 1000, share).alias("loss"))
    return p.select("p_partkey", *_r("remapped", "raw", "rate", "loss", digits=5))


_sql("curve_terms", "SELECT p_partkey, round(p_size / 50.0::DOUBLE * 4 - 1 + 1e-9, 5) AS remapped, round(p_size / 50.0::DOUBLE * 0.0988 + 0.163 + 1e-9, 5) AS raw, round(pow(0.75::DOUBLE, 13 - p_size % 13) + 1e-9, 5) AS rate, round(sqrt(pow(p_retailprice / 1000 - p_size / 50.0::DOUBLE, 2) + 1e-6) + 1e-9, 5) AS loss FROM part")


@query
def wavelength_channels(spark, sf):
    w = table(spark, sf, "part").select("p_partkey", (F.lit(350) + F.col("p_size") * 5).alias("nm"))
    return w.select("p_partkey", "nm", N.rgb_channel(F.col("nm"), 400).alias("channel"))


_sql("wavelength_channels", "SELECT p_partkey, 350 + p_size * 5 AS nm, CASE WHEN 350 + p_size * 5 < 400 THEN 0 WHEN 350 + p_size * 5 < 440 THEN 2 WHEN 350 + p_size * 5 < 510 THEN 1 ELSE 0 END AS channel FROM part")

#: Names made of page urls and texts: some of them can't name a directory, dataset or client.
_NAMES = "SELECT page_id, CASE page_id % 9 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN repeat('.', CAST(page_id % 4 AS INT)) WHEN 3 THEN concat('.', CAST(page_id AS VARCHAR(20))) WHEN 4 THEN substr(url, 8) WHEN 5 THEN replace(substr(url, 8), '/', '_') WHEN 6 THEN concat('p', CAST(page_id AS VARCHAR(20)), '\\\\x') WHEN 7 THEN substr(url, 9, 12) END AS name FROM {pages}"


@query
def name_problems(spark, sf):
    n = spark.sql(_NAMES, pages=table(spark, sf, "pages"))
    return n.select("page_id", "name", S.directory_name_problem(F.col("name")).alias("problem"), S.dataset_name_ok(F.col("name")).alias("dataset_ok"), S.client_id_ok(F.col("name")).alias("client_ok"))


_sql(
    "name_problems",
    "WITH n AS (" + _NAMES.replace("{pages}", "pages").replace("\\\\", "\\") + ") SELECT page_id, name, CASE WHEN name IS NULL OR trim(name) = '' THEN 'blank' WHEN name IN ('.', '..') THEN 'reserved' WHEN position('/' IN name) + position('\\' IN name) > 0 THEN 'separator' WHEN left(name, 1) = '.' THEN 'hidden' END AS problem, "
    "regexp_full_match(name, '[A-Za-z0-9][-A-Za-z0-9._]*') AS dataset_ok, length(trim(name)) >= 8 AND length(trim(name)) <= 128 AS client_ok FROM n",
)


@query
def output_names(spark, sf):
    p = table(spark, sf, "part")
    item, root = S.numbered("feature_", F.col("p_partkey") % 1390, 1390), F.lower(F.regexp_replace("p_brand", "#", "/"))
    return p.select("p_partkey", item.alias("item"), S.output_path(root, "lr_feats", item).alias("features"), S.output_path(root, "hr_feats", item).alias("channels"), S.output_path(root, "norm").alias("norm"))


_sql("output_names", "WITH p AS (SELECT p_partkey, 'feature_' || lpad((p_partkey % 1390)::VARCHAR, 4, '0') AS item, lower(replace(p_brand, '#', '/')) AS root FROM part) SELECT p_partkey, item, root || '/lr_feats/' || item || '.npy' AS features, root || '/hr_feats/' || item AS channels, root || '/norm_per_vol.txt' AS norm FROM p")


@query
def list_previews(spark, sf):
    names = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_name")).alias("names"))
    return names.select("s_nationkey", S.preview(F.col("names")).alias("shown"))


_sql("list_previews", "WITH n AS (SELECT s_nationkey, list_sort(list(s_name)) AS names FROM supplier GROUP BY s_nationkey) SELECT s_nationkey, array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN '...' ELSE '' END AS shown FROM n")


@query
def repeated_stems(spark, sf):
    return catalogue.duplicate_stems(view(spark, sf, "file").select(F.regexp_replace("name", "[0-9]{3}", "").alias("name")))


_sql("repeated_stems", "WITH s AS (SELECT regexp_replace(regexp_replace(name, '[0-9]{3}', '', 'g'), '\\.[^.]*$', '') AS stem FROM file) SELECT stem, count(*) AS n FROM s GROUP BY stem HAVING count(*) > 1", "file")


@query
def files_to_upload(spark, sf):
    f = view(spark, sf, "file").select("name", "length")
    remote = f.filter(F.col("length") % 3 != 0).select("name", F.when(F.col("length") % 7 == 0, F.col("length") + 1).otherwise(F.col("length")).alias("length"))
    return catalogue.upload_plan(f, remote)


_sql("files_to_upload", "SELECT name, length FROM file f WHERE NOT EXISTS (SELECT 1 FROM file r WHERE r.name = f.name AND r.length % 3 <> 0 AND f.length = CASE WHEN r.length % 7 = 0 THEN r.length + 1 ELSE r.length END)", "file")


@query
def gpu_lines(spark, sf):
    """Parts written as lines of a GPU listing; lines of other forms are passed over."""
    p = table(spark, sf, "part")
    used = F.when(F.col("p_size") % 7 == 0, F.lit("[N/A]")).otherwise(F.col("p_size").cast("string"))
    lines = p.select(F.when(F.col("p_size") % 5 == 0, F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name")).otherwise(F.concat_ws(" , ", F.col("p_partkey").cast("string"), "p_name", used, F.lit("81920"))).alias("value"))
    return catalogue.gpu_rows(lines)


_sql("gpu_lines", "SELECT p_partkey::INT AS index, trim(p_name) AS name, p_size AS used, 81920 AS total FROM part WHERE p_size % 5 <> 0 AND p_size % 7 <> 0 AND position(',' IN p_name) = 0")


@query
def archive_members(spark, sf):
    """Page paths as archive members, some of them absolute or leaving the folder."""
    path = F.when(F.col("page_id") % 7 == 0, F.substring("url", 7, 100)).when(F.col("page_id") % 7 == 1, F.concat(F.lit("a/../"), F.substring("url", 9, 100))).when(F.col("page_id") % 7 == 2, F.concat(F.lit("C:\\"), F.col("page_id").cast("string"))).when(F.col("page_id") % 7 == 3, F.lit(" ")).otherwise(F.concat(F.lit("a..b/"), F.substring("url", 9, 100)))
    return catalogue.safe_members(table(spark, sf, "pages").select("page_id", path.alias("path")))


_sql(
    "archive_members",
    "WITH m AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN substr(url, 7, 100) WHEN 1 THEN 'a/../' || substr(url, 9, 100) WHEN 2 THEN 'C:\\' || page_id WHEN 3 THEN ' ' ELSE 'a..b/' || substr(url, 9, 100) END AS path FROM pages) "
    "SELECT * FROM m WHERE left(path, 1) NOT IN ('/', '\\') AND NOT regexp_matches(path, '^[A-Za-z]:') AND NOT list_contains(string_split(replace(path, '\\', '/'), '/'), '..') AND trim(path) <> ''",
)


@query
def folder_reasons(spark, sf):
    """Folders of the listing with what is wrong with them first."""
    f = view(spark, sf, "file").select("page_id", F.concat("dir", F.lit("/"), (F.col("page_id") % 13).cast("string")).alias("dir"), "name", "length")
    per = f.groupBy("dir").agg(
        (F.max("page_id") % 11 != 0).alias("exists"), (F.min("page_id") % 6 != 5).alias("is_dir"), (F.count(F.lit(1)) - 1).alias("files"), F.count_if(S.is_tiff(F.col("name")) & (F.col("length") % 2 == 0)).alias("tifs"),
        (F.count_distinct("length") < F.count(F.lit(1))).alias("duplicate_names"), F.count_distinct(F.col("length") % 3).alias("shapes"),
    )
    return catalogue.folder_problem(per).select("dir", "reason")


_sql(
    "folder_reasons",
    "WITH p AS (SELECT dir || '/' || page_id % 13 AS dir, max(page_id) AS most, min(page_id) AS least, count(*) AS n, count(*) FILTER (regexp_matches(lower(name), '\\.tiff?$') AND length % 2 = 0) AS tifs, count(DISTINCT length) AS lengths, count(DISTINCT length % 3) AS shapes FROM file GROUP BY 1) "
    "SELECT dir, CASE WHEN most % 11 = 0 THEN 'missing' WHEN least % 6 = 5 THEN 'not_directory' WHEN n = 1 THEN 'missing_required_files' WHEN tifs = 0 THEN 'no_tiff_files' WHEN lengths < n THEN 'duplicate_timepoint_names' WHEN shapes > 1 THEN 'shape_mismatch' END AS reason FROM p",
    "file",
)


@query
def norm_requests(spark, sf):
    """Orders as normalisation requests: mode by priority, bounds by price and key."""
    o = table(spark, sf, "orders")
    mode = F.when(F.col("o_orderpriority").startswith("1"), "manual").when(F.col("o_orderpriority").startswith("2"), "per_volume").when(F.col("o_orderpriority").startswith("3"), "global_auto").when(F.col("o_orderpriority").startswith("4"), "manual").otherwise(F.lower("o_orderpriority"))
    low, high = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")), F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") * 200.0)
    return catalogue.norm_problem(o.select("o_orderkey", mode.alias("mode"), low.alias("low"), high.alias("high"))).select("o_orderkey", "reason")


_sql(
    "norm_requests",
    "WITH r AS (SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'manual' WHEN '2' THEN 'per_volume' WHEN '3' THEN 'global_auto' WHEN '4' THEN 'manual' ELSE lower(o_orderpriority) END AS mode, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS low, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey * 200.0 END AS high FROM orders) "
    "SELECT o_orderkey, CASE WHEN mode NOT IN ('per_volume', 'global_auto', 'manual') THEN 'unknown_mode' WHEN mode <> 'manual' AND coalesce(low, high) IS NOT NULL THEN 'bounds_not_allowed' WHEN mode = 'manual' AND (low IS NULL OR high IS NULL) THEN 'bounds_missing' WHEN mode = 'manual' AND high <= low THEN 'bounds_order' END AS reason FROM r",
)


@query
def meters_of_processes(spark, sf):
    parts = view(spark, sf, "metric").groupBy("name", (F.col("iteration") % 4).alias("process")).agg(F.count(F.lit(1)).alias("count"), F.sum("value").alias("total"))
    return ops.merged_meters(parts).select("name", "count", *_r("total", digits=2), *_r("global_mean"))


_sql("meters_of_processes", "SELECT name, count(*)::BIGINT AS count, round(sum(value) + 1e-9, 2) AS total, round(avg(value) + 1e-9, 4) AS global_mean FROM metric GROUP BY name", "metric")


@query
def grid_pages(spark, sf):
    d = view(spark, sf, "det").select(F.col("t").alias("tp"), "label", "A")
    return grid.page_grid(d, ["label"]).select("tp", "label", "page", "cell")


_sql("grid_pages", "WITH n AS (SELECT t AS tp, label, row_number() OVER (PARTITION BY t ORDER BY label) - 1 AS n FROM det) SELECT tp, label, (n // 36)::INT AS page, (n % 36)::INT AS cell FROM n", "det")


@query
def track_arrays(spark, sf):
    """Detections of a label as a track: its arrays, joined as texts."""
    a = tracks.as_arrays(view(spark, sf, "det").select(F.col("label").alias("track_id"), "t", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), "A"))
    joined = [F.array_join(F.transform(k, lambda v: F.format_number(v, 3)), ";").alias(k) for k in ("x", "y", "z", "A")]
    return a.select("track_id", F.size("x").alias("n"), *joined)


_sql("track_arrays", "SELECT label AS track_id, count(*)::INT AS n, " + ", ".join(f"string_agg(format('{{:,.3f}}', {v}), ';' ORDER BY t) AS {k}" for k, v in (("x", "cx"), ("y", "cy"), ("z", "cz"), ("A", "A"))) + " FROM det GROUP BY label", "det")


@query
def first_positions(spark, sf):
    return catalogue.in_first_order(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id")


_sql("first_positions", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")


@query
def filled_edges(spark, sf):
    v = view(spark, sf, "voxel").withColumn("valid", F.col("x") > 1)
    return cleaning.fill_edges(v, ["tp"]).select("tp", "z", "y", "x", *_r("v", digits=2))


_sql("filled_edges", "WITH m AS (SELECT tp, median(v) AS m FROM voxel WHERE x <= 1 GROUP BY tp) SELECT tp, z, y, x, round(CASE WHEN x > 1 THEN v ELSE m END, 2) AS v FROM voxel JOIN m USING (tp)", "voxel")


@query
def folders_expanded(spark, sf):
    """Experiments of a folder each, or the folder itself where it has none."""
    f = view(spark, sf, "file").groupBy("dir").agg(F.collect_set(F.when(F.col("is_dir"), F.concat_ws("/", "dir", "name"))).alias("children"))
    return catalogue.expanded(f.select(F.col("dir").alias("path"), "children"))


_sql("folders_expanded", "SELECT DISTINCT dir || '/' || name AS path FROM file WHERE is_dir UNION ALL SELECT dir FROM file GROUP BY dir HAVING NOT bool_or(is_dir)", "file")


@query
def models_of_manifest(spark, sf):
    """Parts of a brand as the models of a JSON manifest."""
    p = table(spark, sf, "part").select("p_brand", F.struct(F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("name"), (F.col("p_size") * 1000).cast("long").alias("size")).alias("m"))
    texts = p.groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list("m").alias("models"))).alias("value"))
    return catalogue.from_manifest(texts.select("value"))


_sql("models_of_manifest", "SELECT p_brand || '-' || p_partkey AS name, p_size * 1000::BIGINT AS size FROM part")


@query
def centred_log_softmax(spark, sf):
    """Scores of prototypes (the numbers of a vector), less each one's mean, as logarithms of shares at temperature 0.1."""
    scores = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "s")).withColumn("s", F.col("s").cast("double"))
    centre = scores.groupBy("k").agg(F.avg("s").alias("centre"))
    return scaling.log_softmax(scaling.centred(scores, centre, ["k"], "s"), ["vec_id"], "s", 0.1).select("vec_id", "k", *_r("log_p", digits=5))


_sql(
    "centred_log_softmax",
    "WITH s AS (SELECT vec_id, unnest(range(0, len(embedding)))::INT AS k, unnest(embedding)::DOUBLE AS s FROM embeddings), c AS (SELECT vec_id, k, (s - avg(s) OVER (PARTITION BY k)) / 0.1 AS s FROM s), m AS (SELECT *, s - max(s) OVER (PARTITION BY vec_id) AS d FROM c) "
    "SELECT vec_id, k, round(d - ln(sum(exp(d)) OVER (PARTITION BY vec_id)) + 1e-9, 5) AS log_p FROM m",
)


@query
def unpatchified(spark, sf):
    """Vectors as patches of 4 x 4 x 4 in a row of patches for each frame."""
    f = view(spark, sf, "feat").select(F.col("t").alias("tp"), F.lit(0).alias("pz"), F.floor((F.col("label") - 1) / 10).alias("py"), ((F.col("label") - 1) % 10).alias("px"), F.col("feat").alias("values"))
    return grid.unpatchify(f, 4).select("tp", "z", "y", "x", F.col("v").cast("double").alias("v"))


_sql(
    "unpatchified",
    "WITH f AS (SELECT t AS tp, label - 1 AS n, unnest(range(0, 64)) AS i, unnest(feat)::DOUBLE AS v FROM feat) SELECT tp, (i // 16)::INT AS z, (n // 10 * 4 + i // 4 % 4)::INT AS y, (n % 10 * 4 + i % 4)::INT AS x, v FROM f",
    "feat",
)


@query
def remaining_times(spark, sf):
    m = view(spark, sf, "metric").select("name", "iteration", F.when(F.col("iteration") % 9 != 0, F.col("value") / 10).alias("seconds"))
    return ops.remaining_times(m, "name", 10000, 25).withColumnRenamed("left", "seconds_left").select("name", "iteration", *_r("seconds_left", digits=2))


_sql(
    "remaining_times",
    "WITH m AS (SELECT name, iteration, avg(CASE WHEN iteration % 9 <> 0 THEN value / 10 END) OVER (PARTITION BY name ORDER BY iteration) AS mean, max(iteration) OVER (PARTITION BY name) AS n FROM metric) "
    "SELECT name, iteration, round(mean * greatest(10000 - iteration, 0) + 1e-9, 2) AS seconds_left FROM m WHERE iteration % 25 = 0 OR iteration = n",
    "metric",
)
