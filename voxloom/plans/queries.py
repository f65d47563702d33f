"""The registered queries: operators on the views, results rounded where sums of floating-point numbers may differ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import numeric as N
from ..functions import strings as S
from ..operators import catalogue, cleaning, components, density, grid, matching, objects, ops, sampling, scaling, tracks, vectors
from ..streaming import progress
from .views import table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Addresses of the query that classifies them.
ADDRESSES = "127.0.0.1 ::1 10.2.3.4 192.168.0.9%eth0 8.8.8.8 ::ffff:172.20.1.1 fe80::1 2001:db8::1 what 0.0.0.0 198.18.0.1 240.0.0.1 192.0.2.1 localhost 2001:4860:4860::8888 256.1.1.1 ::".split()

#: The grid of the voxel view.
SHAPE = (9, 51, 11)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _r(*names: str, digits: int = 4):
    # the tiny shift rounds exact ties the same way whatever the order of a sum
    return [F.round(F.col(n).cast("double") + (1e-9 if digits < 6 else 0.0), digits).alias(n) for n in names]


# -- objects ------------------------------------------------------------------------------------------------------


@query
def object_geometry(spark, sf):
    g = objects.geometry(view(spark, sf, "mask"))
    return g.select("tp", "label", "volume", *_r("cz", "cy", "cx"), "z0", "z1", "y0", "y1", "x0", "x1")


@query
def object_intensity(spark, sf):
    return objects.mean_intensity(view(spark, sf, "voxel"), view(spark, sf, "mask")).select("tp", "label", "volume", *_r("total", digits=2), F.round(F.col("total") / F.col("volume") + 1e-9, 3).alias("amplitude"))


@query
def weighted_centroid(spark, sf):
    return objects.weighted_centroid(view(spark, sf, "voxel"), view(spark, sf, "mask")).select("tp", "label", *_r("wz", "wy", "wx"))


@query
def label_feature_mean(spark, sf):
    return objects.feature_mean(view(spark, sf, "feat"), ["t"]).select("t", "c", *_r("mean", digits=5))


@query
def particle_medians(spark, sf):
    return objects.particle_medians(view(spark, sf, "voxel"), view(spark, sf, "mask")).select("tp", "label", "median", *_r("total", "mean", digits=2))


@query
def local_background(spark, sf):
    # sums of millions need a larger shift than _r's, which is lost in their last places
    shifted = [F.round(F.col(n) + 1e-9 + F.abs(n) * 1e-12, 2).alias(n) for n in ("background", "corrected_mean", "corrected_total")]
    return objects.local_background(view(spark, sf, "voxel"), view(spark, sf, "mask")).select("tp", "label", "volume", *shifted)


@query
def matched_background(spark, sf):
    return objects.matched_background(view(spark, sf, "voxel"), view(spark, sf, "mask")).select("tp", "label", "drawn", "redrawn", *_r("background", digits=2))


# -- cleaning and scaling -----------------------------------------------------------------------------------------


def _gappy(spark, sf):
    """The voxel view with zeros, NaN and infinities at fixed places."""
    v = view(spark, sf, "voxel")
    k = F.col("y") * 11 + F.col("x")
    return v.withColumn("v", F.when(k % 13 == 0, 0.0).otherwise(F.col("v"))), v.withColumn("v", F.when(k % 17 == 0, float("nan")).when(k % 19 == 0, float("inf")).when(k % 23 == 0, float("-inf")).otherwise(F.col("v")))


@query
def median_fill(spark, sf):
    return cleaning.median_fill(_gappy(spark, sf)[0], ["tp"]).select("tp", "z", "y", "x", *_r("v"))


@query
def sanitize_nonfinite(spark, sf):
    return cleaning.sanitize_nonfinite(_gappy(spark, sf)[1], ["tp"]).select("tp", "z", "y", "x", *_r("v"))


@query
def pad_value(spark, sf):
    return cleaning.pad_value(_gappy(spark, sf)[1].withColumn("inside", F.when(F.col("z") < 4, F.col("tp") != "1995")), ["tp"]).select("tp", *_r("pad"), "unmasked")


@query
def minmax_scale(spark, sf):
    scaled = scaling.minmax_scale(view(spark, sf, "voxel"), ["tp"])
    return scaled.select("tp", "z", "y", "x", *_r("scaled", digits=6), N.remap(F.round("scaled", 6), -1.0, 1.0).alias("remapped")).withColumn("remapped", F.round(F.col("remapped") + 1e-9, 5))


@query
def quantize_u8(spark, sf):
    scaled = scaling.minmax_scale(view(spark, sf, "voxel"), [], low=0.0, high=60000.0)
    return scaled.groupBy(N.quantize_u8(F.col("scaled")).alias("q")).agg(F.count(F.lit(1)).alias("n"))


@query
def hist_bounds_cumulative(spark, sf):
    return scaling.cumulative_bounds(view(spark, sf, "voxel"), ["tp"], bins=4096, cut=50)


@query
def hist_bounds_count(spark, sf):
    return scaling.count_bounds(view(spark, sf, "voxel"), ["tp"], bins=256, high=65536.0, cut=240)


@query
def global_hist_bounds(spark, sf):
    return scaling.pooled_bounds(view(spark, sf, "voxel"), bins=4096, cut=50).select(*_r("lo", "hi"))


@query
def global_mean_std(spark, sf):
    return scaling.mean_std(view(spark, sf, "voxel"), ["tp"]).select("tp", "n", *_r("mean", digits=3), *_r("std", digits=2))


@query
def percentile_band(spark, sf):
    return scaling.percentile_band(view(spark, sf, "voxel"), ["tp"], low=0.9, high=0.99)


# -- grids --------------------------------------------------------------------------------------------------------


@query
def z_projection(spark, sf):
    v = view(spark, sf, "voxel")
    return grid.z_projection(v, "max").withColumnRenamed("v", "top").join(grid.z_projection(v, "mean"), ["tp", "y", "x"]).select("tp", "y", "x", "top", *_r("v", digits=3))


@query
def nonzero_stacks(spark, sf):
    return grid.nonzero_stacks(view(spark, sf, "voxel"))


@query
def grid_chunks(spark, sf):
    return grid.chunks(view(spark, sf, "voxel"), (-1, 16, 4), drop_empty=True)


@query
def overlap_patches(spark, sf):
    p = grid.patches(view(spark, sf, "voxel"), SHAPE, (4, 16, 6), 0.5)
    return p.groupBy("tp", "pz", "py", "px").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))


@query
def blend_patches(spark, sf):
    return grid.patchwise_minmax(view(spark, sf, "voxel"), SHAPE, (4, 16, 6), 0.5).select("tp", "z", "y", "x", *_r("v", digits=5))


@query
def reconstruct_volume(spark, sf):
    p = grid.patches(view(spark, sf, "voxel"), SHAPE, (4, 16, 6), 0.5)
    return grid.reconstruct(p.select("tp", "z", "y", "x", (F.col("v") + F.col("pz")).alias("v"), (F.col("pz") * 10000 + F.col("py") * 100 + F.col("px")).alias("seq"))).select("tp", "z", "y", "x", *_r("v", digits=2))


@query
def pad_or_crop(spark, sf):
    return grid.pad_or_crop(view(spark, sf, "voxel"), SHAPE, (11, 21, 11), -1.0)


@query
def strided_downsample(spark, sf):
    return grid.strided(view(spark, sf, "voxel"), (2, 4, 1))


@query
def trilinear_sample(spark, sf):
    return grid.trilinear(view(spark, sf, "voxel"), SHAPE, (4, 12, 22)).select("tp", "z", "y", "x", *_r("v", digits=3))


@query
def conv3d_gaussian(spark, sf):
    v, k = view(spark, sf, "voxel"), grid.gaussian_kernel(1.0)
    for axis, size in zip("zyx", SHAPE):
        v = grid.convolve(v, k, axis, size)
    return v.select("tp", "z", "y", "x", *_r("v", digits=3))


@query
def median_filter_2d(spark, sf):
    dense = grid.pad_or_crop(view(spark, sf, "voxel"), SHAPE, SHAPE, 0.0)
    return grid.median_filter_2d(dense.select("tp", "z", "y", "x", (F.col("v") > 20000).alias("inside")))


@query
def connected_components(spark, sf):
    """The components of every time point."""
    bright = view(spark, sf, "voxel").filter("v > 40000")
    return components.connected_components(bright.select("tp", "z", "y", "x"), SHAPE[1], SHAPE[2])


# -- matching and tracks ------------------------------------------------------------------------------------------


#: Radius in the plane, along z, and the weight of z, of the candidates of the detections.
REACH = (15.0, 2.0, 2.5)


def _pairs(spark, sf):
    """All candidates of the detections, unrounded."""
    return matching.candidates(view(spark, sf, "det"), *REACH, cells=("cy",))


@query
def spatial_candidates(spark, sf):
    near = matching.near_places(view(spark, sf, "det"), *REACH, cells=("cy",))
    return matching.pairs_of(near.select("t", "refs", "cands", *_r("dist", digits=3)))


def _frame_mask(spark, sf):
    return view(spark, sf, "mask").filter("label <> 0").select((F.col("tp").cast("int") - 1991).alias("t"), "label", "z", "y", "x")


@query
def mask_overlap_dice(spark, sf):
    m = _frame_mask(spark, sf)
    g = objects.geometry(m.withColumnRenamed("t", "tp")).withColumnRenamed("tp", "t")
    pairs = matching.candidates(g, 12.0, 3.0, 2.5)
    return matching.overlap_dice(pairs, m, g).select("t", "ref", "cand", "overlap", *_r("dice", digits=5))


def _feature_pairs(spark, sf):
    """Candidates of the vector view by centroids (the first three numbers), with the dice of their masks (where each of 4 x 4 x 4 numbers is positive), and their features: eight samples of eight channels."""
    f = view(spark, sf, "feat").select("t", "label", F.posexplode("feat").alias("p", "f"))
    samples = f.select("t", "label", F.floor(F.col("p") / 8).cast("int").alias("c"), (F.col("p") % 8).alias("k"), "f")
    centre = lambda k: F.col("feat")[k].cast("double") * 100
    o = view(spark, sf, "feat").select("t", "label", centre(0).alias("cy"), centre(1).alias("cx"), centre(2).alias("cz"))
    m = f.filter("f > 0").select("t", "label", F.floor(F.col("p") / 16).cast("int").alias("z"), (F.floor(F.col("p") / 4) % 4).cast("int").alias("y"), (F.col("p") % 4).alias("x"))
    g = objects.geometry(m.withColumnRenamed("t", "tp")).withColumnRenamed("tp", "t")
    near = cut(matching.candidates(o, 20.0, 10.0, 2.5))
    pairs = cut(near.join(matching.overlap_dice(near, m, g).select("t", "ref", "cand", "dice"), ["t", "ref", "cand"]))
    return pairs, matching.pair_features(pairs, samples)


@query
def pair_feature_mse_corr(spark, sf):
    return _feature_pairs(spark, sf)[1].select("t", "ref", "cand", "c", *_r("corr", "mse", digits=5))


@query
def feature_votes(spark, sf):
    pairs, features = _feature_pairs(spark, sf)
    return matching.ranked(matching.votes(pairs, features, 0.5, 0.0)).select("t", "ref", "cand", "wins", "rank")


@query
def greedy_match(spark, sf):
    return matching.greedy_objects(view(spark, sf, "det"), *REACH)


@query
def assign_pairs(spark, sf):
    pairs, features = _feature_pairs(spark, sf)
    return matching.assign(pairs, features, 8.0, [3, 2], 0.5, 0.0).select("t", "ref", "cand", "method", *_r("distance", digits=4), "wins")


@query
def tracks_export(spark, sf):
    """Flagship: mutual nearest links by a band join of growing reach, tracks by pointer doubling, export rows."""
    o = cut(view(spark, sf, "det"))
    links = tracks.nearest_links(o, *REACH)
    return tracks.export(tracks.chain(o, links), o)


@query
def track_lengths(spark, sf):
    o = cut(view(spark, sf, "det"))
    t = tracks.chain(o, tracks.nearest_links(o, *REACH))
    return t.select("track_id", "track_length").distinct().groupBy("track_length").agg(F.count(F.lit(1)).alias("n"))


# -- densities ----------------------------------------------------------------------------------------------------


@query
def density_hist(spark, sf):
    return density.smoothed_histogram(view(spark, sf, "sample"), 64, 1.5).select("c", "cls", "i", *_r("x"), *_r("f", digits=8))


@query
def density_kde(spark, sf):
    return density.kde(view(spark, sf, "sample"), 32).select("c", "cls", "i", *_r("x"), *_r("f", digits=8))


@query
def probmap_votes(spark, sf):
    s = view(spark, sf, "sample")
    d = density.smoothed_histogram(s, 64, 1.5)
    asked = s.select("id", "c", F.col("v"))
    return density.votes(density.lookup(d, asked), ["id"])


@query
def stratified_sample(spark, sf):
    return density.stratified_sample(view(spark, sf, "sample"), ["c", "cls"], 60, "z", "id").select("c", "cls", "z", "id")


# -- vectors ------------------------------------------------------------------------------------------------------


def _points(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query
def nearest_neighbour(spark, sf):
    p = _points(spark, sf)
    return vectors.nearest_neighbour(p.filter("id % 50 = 0"), p).select("id", "neighbour", *_r("similarity", digits=5))


@query
def koleo(spark, sf):
    return vectors.koleo(_points(spark, sf)).select(*_r("koleo"))


@query
def kmeans_step(spark, sf):
    p = _points(spark, sf)
    return vectors.assign(p, vectors.first_centroids(p, 8)).select("id", "k", *_r("distance", digits=5))


@query
def kmeans_fit(spark, sf):
    p = _points(spark, sf)
    return vectors.kmeans(p, vectors.first_centroids(p, 8), rounds=5)[0].select("id", "k", *_r("distance", digits=5))


@query
def sinkhorn3(spark, sf):
    """All 64 dimensions as scores of as many prototypes."""
    flat = _points(spark, sf).select(F.col("id").alias("b"), F.posexplode("vec").alias("k", "s"))
    return vectors.sinkhorn(flat.select("b", "k", F.col("s").cast("double").alias("s")), 3, 0.5).select("b", "k", *_r("p", digits=6))


@query
def covariance(spark, sf):
    return vectors.covariance(_points(spark, sf)).select("i", "j", *_r("cov", digits=7))


@query
def pca_project(spark, sf):
    return vectors.pca(_points(spark, sf), 3).select("id", "c", *_r("value", digits=4))


@query
def ema_center(spark, sf):
    return vectors.ema(view(spark, sf, "metric"), ["name"], "iteration", "value", 0.9).select("name", *_r("ema", digits=5))


@query
def lr_schedule(spark, sf):
    steps = spark.range(0, 120).select(F.col("id").alias("step"))
    return steps.select("step", F.round(N.cosine_schedule(F.col("step"), 1.0, 0.1, 100, 10, 0.0, 5), 8).alias("lr"))


@query
def sincos_pos_embed(spark, sf):
    cells = spark.range(0, 20).select(F.col("id").alias("pos"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    return cells.select("pos", "k", F.round(N.sincos(F.col("pos").cast("double"), F.col("k"), 16), 6).alias("e"))


# -- catalogue and operations -------------------------------------------------------------------------------------


@query
def natural_sort(spark, sf):
    files = catalogue.tiff_files(view(spark, sf, "file"))
    return tracks.numbered(files.select("key", "name"), ["key", "name"], "position").select("name", "position")


@query
def name_metadata(spark, sf):
    return catalogue.name_metadata(view(spark, sf, "file")).drop("key")


@query
def stem_pairing(spark, sf):
    f = view(spark, sf, "file").filter("NOT is_dir")
    return catalogue.paired(f.filter("page_id % 3 <> 0"), f.filter("page_id % 4 <> 0")).select("stem", "status")


@query
def experiment_stats(spark, sf):
    return catalogue.experiment_stats(view(spark, sf, "file"))


@query
def experiment_filter(spark, sf):
    stats = catalogue.experiment_stats(view(spark, sf, "file"))
    return catalogue.eligible(stats, stats.filter("dir LIKE '%Ex02%'"), "(?i)ex0[0-3]", 5).select("dir", "tifs")


@query
def list_page(spark, sf):
    return catalogue.list_page(view(spark, sf, "file").select("name", "is_dir", "mtime_ms"), "mtime_ms", False, 2, 20)


@query
def manifest_json(spark, sf):
    kinds = [("image", r"(?i)\.tiff?$"), ("note", r"\.txt$"), ("camera_a", "_CamA_")]
    return catalogue.manifest(view(spark, sf, "file"), kinds).select("kind", "n", "bytes", F.length("entries").alias("size"))


@query
def dedup_first(spark, sf):
    return catalogue.first_by(table(spark, sf, "documents").select("source", "doc_id", "lang"), ["source"], ["doc_id"])


@query
def chunk_key(spark, sf):
    f = view(spark, sf, "file")
    meta = catalogue.name_metadata(f)
    key = S.chunk_key(S.experiment_id(F.lit("/data")), F.col("frame"), F.when(F.col("frame") % 2 == 0, F.lit(-1)).otherwise(F.col("frame") % 5), F.col("wavelength"), F.lit(0))
    return meta.select("name", key.alias("key"))


@query
def ip_class(spark, sf):
    a = F.array(*(F.lit(x) for x in ADDRESSES))
    return table(spark, sf, "region").select("r_regionkey", F.posexplode(a).alias("i", "address")).select("r_regionkey", "i", S.ip_class(F.col("address")).alias("class"))


@query
def smoothed_meter(spark, sf):
    return ops.meters(view(spark, sf, "metric")).select("name", "iteration", "median", *_r("mean", "global_mean", digits=5), "top", "last")


@query
def jobs_newest(spark, sf):
    """All jobs of each owner with their places, the newest first."""
    return ops.listed(view(spark, sf, "job")).select("owner", "n", "job_id", S.job_title(F.regexp_replace("kind", " ", "_")).alias("title"))


@query
def job_final_status(spark, sf):
    return ops.final_status(view(spark, sf, "job")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def log_tail(spark, sf):
    return ops.log_tail(view(spark, sf, "log"), 5)


@query
def cpu_utilization(spark, sf):
    s = view(spark, sf, "metric").select("name", "iteration", (F.col("iteration") * 10).alias("total"), F.floor(F.col("iteration") * 3 + F.col("value") % 7).alias("idle"))
    return ops.utilisation(s, "name", "iteration").select("name", "iteration", *_r("pct"))


@query
def job_progress(spark, sf):
    lines = view(spark, sf, "log").select("job_id", "line")
    return progress.progress(lines, lines.select("job_id", S.reported(F.col("line")).alias("item")).filter("item NOT LIKE '%8.npy'"))


@query
def stream_progress(spark, sf):
    """The same from a stream of the events table, run until its input is used up."""
    from ..checkpoints import cut

    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*").parquet(sf)
    lines = stream.select(F.col("user_id").cast("string").alias("job_id"), F.concat(F.lit("Saved features to /out/hr_feats/"), "event_type", (F.col("event_id") % 9).cast("string"), F.lit(".npy")).alias("line"))
    told = events.select(F.col("user_id").cast("string").alias("job_id"), F.concat(F.lit("/out/hr_feats/"), "event_type", (F.col("event_id") % 9).cast("string"), F.lit(".npy")).alias("item")).filter("item NOT LIKE '%8.npy'")
    running = progress.start(lines, told, "voxloom_progress")
    running.awaitTermination()
    return cut(spark.table("voxloom_progress"))


# -- more of the same groups --------------------------------------------------------------------------------------


@query
def contrast_clip(spark, sf):
    return scaling.contrast_clip(view(spark, sf, "voxel"), ["tp"], high=131072.0, cut=300).select("tp", "z", "y", "x", *_r("clipped", digits=5))


@query
def softmax(spark, sf):
    return scaling.softmax(view(spark, sf, "det").select("t", "label", "cx"), ["t"], "cx", 2.0).select("t", "label", *_r("p", digits=8))


@query
def low_outliers(spark, sf):
    return scaling.low_outliers(view(spark, sf, "voxel"), ["tp"], "v", 1.5)


@query
def flip_rotate(spark, sf):
    return grid.rot90(grid.flip(view(spark, sf, "voxel"), "z", SHAPE[0]), SHAPE[2])


@query
def grey_opening(spark, sf):
    return grid.opening(view(spark, sf, "voxel"), 2)


@query
def patchify(spark, sf):
    p = grid.patchify(view(spark, sf, "voxel"), 3)
    return p.select("tp", "pz", "py", "px", F.size("values").alias("n"), F.col("values")[0].alias("first"), F.element_at("values", -1).alias("last"))


@query
def foreground_mask(spark, sf):
    return grid.foreground(view(spark, sf, "mask")).groupBy("tp", "is_fg").agg(F.count(F.lit(1)).alias("n"))


@query
def common_shape(spark, sf):
    v = view(spark, sf, "voxel").groupBy("tp").agg(*((F.max(a) + 1).alias(a) for a in "zyx"))
    return grid.common_shape(v, 4)


@query
def shuffled_batches(spark, sf):
    return sampling.shuffled_batches(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 32)


@query
def views_of_samples(spark, sf):
    return sampling.by_view(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 10)


@query
def file_slice(spark, sf):
    return catalogue.file_slice(view(spark, sf, "file"), 10, 40)


@query
def choose_datasets(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), "n_regionkey")
    return catalogue.chosen(n, n.filter("n_regionkey = 1"), "skip")


@query
def merged_settings(spark, sf):
    return catalogue.merged(view(spark, sf, "metric").select(F.col("iteration").alias("layer"), F.col("name").alias("key"), "value"))


@query
def models_of_listing(spark, sf):
    return catalogue.models_of(view(spark, sf, "file").select(F.concat_ws("/", "dir", "name").alias("key")).withColumn("key", F.regexp_replace("key", "/DS/", "/")))


@query
def iteration_times(spark, sf):
    m = view(spark, sf, "metric").select("name", "iteration", (F.col("iteration") * 250 + F.col("iteration") % 3 * 10).alias("ms"))
    return ops.iteration_times(m, "name", "ms", 50)


@query
def total_loss(spark, sf):
    """The loss of every step."""
    m = view(spark, sf, "metric").select(F.col("iteration").alias("step"), "name", "value")
    return ops.total_loss(m, {"click": 0.5, "view": 2.0}).select("step", *_r("loss"))


from . import helpers, more, outputs, resampled, segments, stores  # noqa: E402, F401  registers its queries too
