"""Checks of paths, folders and requests before a job starts: each gives the code of the first problem, or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings as S

# Names that requests use.
SAVE_FORMATS = (".npy", ".tif")
SEGMENTATION_MODES = ("voronoi-otsu", "probability-map")
DENSITY_METHODS = ("kde", "gpu-hist")


def first_problem(*rules: tuple[str, Column]) -> Column:
    """The code of the first rule whose condition holds."""
    found = F.lit(None).cast("string")
    for code, condition in reversed(rules):
        found = F.when(condition, code).otherwise(found)
    return found


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def normal_path(path: Column) -> Column:
    """An absolute path without empty, ``.`` and ``..`` parts."""
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, p: F.when(p.isin("", "."), done).when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))),
    )
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def inside(path: Column, root: Column) -> Column:
    """Whether a normal path is the root or lies below it."""
    return (path == root) | (root == "/") | path.startswith(F.concat(root, F.lit("/")))


def path_problem(path: Column, roots: Column) -> Column:
    """``invalid``, ``not_absolute`` or ``outside`` of all roots (an empty array allows everything)."""
    normal = normal_path(path)
    return first_problem(
        ("invalid", path.isNull() | path.contains("\x00")),
        ("not_absolute", ~path.startswith("/")),
        ("outside", (F.size(roots) > 0) & ~F.exists(roots, lambda r: inside(normal, normal_path(r)))),
    )


def root_of(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """``paths`` with the longest root that holds each (null if none): an equi-join of the ancestors of distinct paths."""
    parts = F.filter(F.split(normal_path(F.col(path)), "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    climbed = paths.select(path).distinct().select(path, F.explode(above).alias("_above"))
    held = climbed.join(roots.select(normal_path(F.col(root)).alias("_above"), F.col(root).alias("_root")).distinct(), "_above")
    best = held.groupBy(path).agg(F.max(F.struct(F.length("_above").alias("n"), F.col("_root"))).alias("m")).select(path, F.col("m._root").alias("root"))
    return paths.join(best, path, "left")


def visible(entries: DataFrame, root: str, include_hidden: bool = False, dirs_only: bool = False) -> DataFrame:
    """The entries of a listing that are shown. entries: name, is_dir, is_link, target (of a link), target_is_dir.

    A link to a directory is followed only if it stays inside the root.
    """
    followed = F.col("is_link") & F.col("target_is_dir") & ~F.col("is_dir")
    folder = F.col("is_dir") | followed
    shown = entries.filter(F.lit(include_hidden) | ~F.col("name").startswith(".")).filter(~F.lit(dirs_only) | folder)
    return shown.filter(~followed | inside(normal_path(F.col("target")), normal_path(F.lit(root)))).withColumn("is_dir", folder)


def shape_problems(files: DataFrame, keys: list[str], order: str, shape: str = "shape") -> DataFrame:
    """One row a folder: the shape of its first file and the first file that isn't 3D or has another shape, with the reason.

    files: keys, name, ``order``, ``shape`` (array).  The folder's first shape
    is found by a partial aggregate, so a folder of many files isn't gathered.
    """
    first = files.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("o"), F.col(shape).alias("s"))).alias("f"), F.count(F.lit(1)).alias("files")).select(*keys, F.col("f.s").alias("expected"), "files")
    bad = files.join(first, keys).filter((F.size(shape) != 3) | ~F.col(shape).eqNullSafe(F.col("expected")))
    worst = bad.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("o"), F.col("name"), F.when(F.size(shape) != 3, "not_3d").otherwise("shape_mismatch").alias("r"))).alias("w"))
    return first.join(worst, keys, "left").select(*keys, "files", "expected", F.col("w.name").alias("file"), F.col("w.r").alias("reason"))


def crop_problem(bounds: list[Column], shape: list[Column]) -> Column:
    """The first axis whose bounds are wrong: empty, beginning or ending beyond the volume. bounds: begin and end of z, y, x."""
    axes = list(zip("zyx", bounds[::2], bounds[1::2], shape))
    return first_problem(
        *((f"empty_{a}", lo >= hi) for a, lo, hi, _ in axes), *((f"start_{a}", lo >= n) for a, lo, _, n in axes), *((f"end_{a}", hi > n) for a, _, hi, n in axes)
    )


def crop_bounds(lo: Column, hi: Column, size: Column) -> list[Column]:
    """Begin and end of a crop; an end of 0 or less means the whole axis."""
    return [F.greatest(F.coalesce(lo, F.lit(0)), F.lit(0)), F.when(F.coalesce(hi, F.lit(0)) <= 0, size).otherwise(F.least(hi, size))]


def features_launch(requests: DataFrame, gpus: DataFrame) -> DataFrame:
    """``requests`` with ``reason`` (null if the job may start) and ``progress_total``.

    requests: folder_problem, output_problem (null if none), save_pca,
    save_high, gpu, high_format, pca_format, subfolders.
    """
    known = requests.join(F.broadcast(gpus.select(F.col("gpu"), F.lit(True).alias("_there")).distinct()), "gpu", "left")  # a machine's devices
    reason = first_problem(
        ("input", F.col("folder_problem").isNotNull()),
        ("no_outputs_selected", ~F.col("save_pca") & ~F.col("save_high")),
        ("missing_gpu_selection", F.col("gpu").isNull()),
        ("invalid_gpu_selection", F.col("_there").isNull()),
        ("invalid_high_resolution_format", ~F.col("high_format").isin(*SAVE_FORMATS)),
        ("invalid_pca_format", ~F.col("pca_format").isin(*SAVE_FORMATS)),
        ("output", F.col("output_problem").isNotNull()),
    )
    said = F.when(reason == "input", F.col("folder_problem")).when(reason == "output", F.col("output_problem")).otherwise(reason)
    return known.select(*requests.columns, said.alias("reason"), F.when(said.isNull(), F.col("subfolders")).alias("progress_total"))


def segmentation_launch(requests: DataFrame, gpus: DataFrame) -> DataFrame:
    """As :func:`features_launch`, for segmentation.

    requests also: mode, density_method, stage_1, stage_2, training_timepoint,
    timepoints (array), seg_tif, valid_mask, densities and whether each of
    these files exists (``..._exists``).  Stage 1 counts two steps, stage 2 one
    a subfolder.
    """
    known = requests.join(F.broadcast(gpus.select(F.col("gpu"), F.lit(True).alias("_there")).distinct()), "gpu", "left")  # a machine's devices
    mapped, first = F.col("mode") == "probability-map", F.col("stage_1")
    absent = lambda name: F.coalesce(~F.col(f"{name}_exists"), F.lit(True))
    reason = first_problem(
        ("input", F.col("folder_problem").isNotNull()),
        ("missing_gpu_selection", F.col("gpu").isNull()),
        ("invalid_gpu_selection", F.col("_there").isNull()),
        ("invalid_segmentation_mode", F.coalesce(~F.col("mode").isin(*SEGMENTATION_MODES), F.lit(True))),
        ("output", F.col("output_problem").isNotNull()),
        ("invalid_density_method", mapped & ~F.col("density_method").isin(*DENSITY_METHODS)),
        ("no_probability_map_stages_selected", mapped & ~first & ~F.col("stage_2")),
        ("missing_training_timepoint", mapped & first & blank(F.col("training_timepoint"))),
        ("invalid_training_timepoint", mapped & first & ~F.array_contains("timepoints", F.trim("training_timepoint"))),
        ("missing_seg_tif", mapped & first & (blank(F.col("seg_tif")) | absent("seg_tif"))),
        ("missing_valid_mask_tif", mapped & first & ~blank(F.col("valid_mask")) & absent("valid_mask")),
        ("missing_probmap_densities", mapped & ~first & (blank(F.col("densities")) | absent("densities"))),
    )
    said = F.when(reason == "input", F.col("folder_problem")).when(reason == "output", F.col("output_problem")).otherwise(reason)
    total = F.when(mapped, F.when(first, 2).otherwise(0) + F.when(F.col("stage_2"), F.col("subfolders")).otherwise(0)).otherwise(F.col("subfolders"))
    return known.select(*requests.columns, said.alias("reason"), F.when(said.isNull(), total).alias("progress_total"))


def tracking_launch(requests: DataFrame) -> DataFrame:
    """As :func:`features_launch`, for tracking: requests have folder_problem, segmentation_problem, output_problem, thresholds (text) and subfolders. Every subfolder and every pair of neighbours is a step."""
    entries = F.filter(F.split(F.coalesce("thresholds", F.lit("")), ","), lambda t: F.trim(t) != "")
    wrong = F.exists(entries, lambda t: F.coalesce(F.trim(t).try_cast("int") <= 0, F.lit(True)))
    reason = F.coalesce("folder_problem", "segmentation_problem", "output_problem", F.when(wrong, "invalid_vote_thresholds"))
    pairs = F.greatest(F.col("subfolders") - 1, F.lit(0))
    return requests.withColumns({"reason": reason, "pair_count": F.when(reason.isNull(), pairs), "progress_total": F.when(reason.isNull(), F.col("subfolders") + pairs)})


def newest_first(rows: DataFrame, key: str, order: list) -> DataFrame:
    """``rows`` with their place within the key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def download_launch(requests: DataFrame, manifest: DataFrame, present: DataFrame, key: str = "request", confirm: bool = True) -> DataFrame:
    """What each request for datasets leads to. requests: ``key``, datasets (array of names), existing_mode (skip, overwrite or null); manifest and present: name.

    Returns ``key``, reason (null if the job may start or must be confirmed),
    names (those the reason or the question is about, in the order asked for:
    the invalid one, at most three unknown ones, all that are there),
    needs_confirmation, selected and skipped (null if no job starts) and
    overwrite.  Names are trimmed and count once, at their first place; names
    of manifest and present may repeat.  A null or empty list is a missing
    selection, a null name an invalid one.  Names meet both tables by
    equi-joins, so neither is broadcast by force nor gathered.
    """
    name = F.trim(F.col("_raw"))
    each = requests.select(key, F.posexplode_outer("datasets").alias("_at", "_raw")).filter("_at is not null")
    told = each.select(key, "_at", "_raw", name.alias("name"), F.coalesce(S.dataset_name_ok(name), F.lit(False)).alias("_ok"))
    once = told.groupBy(key, "name", "_ok").agg(F.min("_at").alias("_at"), F.min_by("_raw", "_at").alias("_raw"))
    known = once.join(manifest.select("name").distinct().withColumn("_listed", F.lit(True)), "name", "left").join(present.select("name").distinct().withColumn("_there", F.lit(True)), "name", "left")
    row = F.struct("_at", F.when(F.col("_ok"), F.col("name")).otherwise(F.col("_raw")).alias("name"), "_ok", F.col("_listed").isNotNull().alias("listed"), F.col("_there").isNotNull().alias("there"))
    lists = known.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("_rows"))  # a request's own list
    all_of = requests.select(key, "existing_mode").join(lists, key, "left").withColumn("_rows", F.coalesce("_rows", F.array().cast(lists.schema["_rows"].dataType)))

    def names(which) -> Column:
        return F.transform(F.filter("_rows", which), lambda r: r["name"])

    wrong, unknown, there = names(lambda r: ~r["_ok"]), names(lambda r: ~r["listed"]), names(lambda r: r["there"])
    skip = F.coalesce(F.col("existing_mode") == "skip", F.lit(False))
    open_ = names(lambda r: ~(r["there"] & skip))
    asks = (F.size(there) > 0) & F.col("existing_mode").isNull() & F.lit(confirm)
    reason = first_problem(
        ("invalid_dataset_name", F.size(wrong) > 0),
        ("missing_selection", F.size("_rows") == 0),
        ("unknown_dataset", F.size(unknown) > 0),
        ("ask", asks),
        ("nothing_to_download", F.size(open_) == 0),
    )
    out = all_of.withColumn("_why", reason)
    starts = F.col("_why").isNull()
    about = F.when(F.col("_why") == "invalid_dataset_name", F.slice(wrong, 1, 1)).when(F.col("_why") == "unknown_dataset", F.slice(unknown, 1, 3)).when(F.col("_why") == "ask", there)
    return out.select(
        key,
        F.when(F.col("_why") != "ask", F.col("_why")).alias("reason"),
        about.alias("names"),
        F.coalesce(F.col("_why") == "ask", F.lit(False)).alias("needs_confirmation"),
        F.when(starts, open_).alias("selected"),
        F.when(starts, names(lambda r: r["there"] & skip)).alias("skipped"),
        (starts & (F.coalesce("existing_mode", F.lit("overwrite")) == "overwrite")).alias("overwrite"),
    )
