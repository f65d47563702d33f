"""Listings, pairings, ledgers and manifests. Files: dir, name, is_dir, length, mtime_ms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings as S


def tiff_files(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("is_dir") & S.is_tiff(F.col("name"))).withColumn("key", S.natural_key(F.col("name")))


def by_stem(files: DataFrame) -> DataFrame:
    """(stem, name); fails if two files share a stem."""
    named = files.select(S.stem(F.col("name")).alias("stem"), "name").groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))
    return named.select("stem", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("duplicate name "), F.col("stem")))).otherwise(F.col("name")).alias("name"))


def duplicate_stems(files: DataFrame) -> DataFrame:
    return files.groupBy(S.stem(F.col("name")).alias("stem")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Stems of both sides with a status: ok, missing_left or missing_right."""
    both = by_stem(left).withColumnRenamed("name", "left_name").join(by_stem(right).withColumnRenamed("name", "right_name"), "stem", "full_outer")
    return both.withColumn("status", F.when(F.col("left_name").isNull(), "missing_left").when(F.col("right_name").isNull(), "missing_right").otherwise("ok"))


def timepoints(left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs; fails on the first file without a partner, the left side's missing ones first."""
    rows = paired(left, right).filter("status <> 'ok'").orderBy(F.when(F.col("status") == "missing_left", 0).otherwise(1), S.natural_key(F.col("stem"))).limit(1).collect()
    if rows:
        raise FileNotFoundError(f"{rows[0]['status']}: {rows[0]['stem']}")
    return paired(left, right).select("stem", "left_name", "right_name")


def name_metadata(files: DataFrame) -> DataFrame:
    n = F.col("name")
    wave = S.name_part(n, "wavelength")
    return files.select("name", S.stem(n).alias("stem"), S.frame_number(n).alias("frame"), S.name_part(n, "camera").alias("camera"), S.name_part(n, "channel").alias("channel"), S.wavelength_nm(wave).alias("wavelength"), S.natural_key(n).alias("key"))


def experiment_stats(files: DataFrame) -> DataFrame:
    """Per directory: files, TIFF files, bytes, GiB."""
    return files.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.lower("name").rlike(r"\.tiff?$")).alias("tifs"), F.sum("length").alias("bytes")).withColumn("gib", F.round(F.col("bytes") / float(1 << 30), 6))


def eligible(experiments: DataFrame, known: DataFrame, pattern: str, least_tifs: int, limit: int | None = None) -> DataFrame:
    """Directories that match, aren't known and hold enough TIFF files; the first ``limit`` by name if asked for."""
    found = experiments.filter(F.col("dir").rlike(pattern) & (F.col("tifs") >= least_tifs)).join(known.select("dir"), "dir", "left_anti")
    return found.orderBy("dir").limit(limit) if limit is not None else found


def list_page(rows: DataFrame, sort: str, ascending: bool, page: int, size: int) -> DataFrame:
    """A page of a sorted listing with ``total`` and ``pages``; directories first, ties by name."""
    total = rows.count()
    pages = max(1, -(-total // size))
    if not 1 <= page <= pages:
        raise ValueError("no such page")
    first = F.col(sort).asc() if ascending else F.col(sort).desc()
    shown = rows.orderBy(F.col("is_dir").desc(), first, F.lower("name"), "name").offset((page - 1) * size).limit(size)
    return shown.withColumn("total", F.lit(total)).withColumn("pages", F.lit(pages))


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: a grouped minimum, so a hot key is one row per task."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("s")).select(*keys, *(F.col(f"s.{c}").alias(c) for c in (*order, *rest)))


def in_first_order(rows: DataFrame, name: str, position: str) -> DataFrame:
    """Each name once with its first position."""
    return rows.groupBy(name).agg(F.min(position).alias(position))


def manifest(files: DataFrame, kinds: list[tuple[str, str]]) -> DataFrame:
    """(kind, entries as JSON) of files by pattern rules; a file that matches two rules is listed twice."""
    rules = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(p).alias("pattern")) for k, p in kinds))
    hits = files.select("name", "length", F.explode(rules).alias("r")).filter(F.expr("name RLIKE r.pattern"))
    return hits.groupBy(F.col("r.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), F.to_json(F.array_sort(F.collect_list(F.struct("name", "length")))).alias("entries"))


def upload_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local files that the other side lacks or has with another size."""
    return local.join(remote.select("name", "length"), ["name", "length"], "left_anti")


def folder_problem(facts: DataFrame) -> DataFrame:
    """The first failing rule of each folder as a reason code; null if none. facts: exists, is_dir, files, tifs, duplicate_names, shapes."""
    reason = (
        F.when(~F.col("exists"), "missing").when(~F.col("is_dir"), "not_directory").when(F.col("files") == 0, "missing_required_files")
        .when(F.col("tifs") == 0, "no_tiff_files").when(F.col("duplicate_names"), "duplicate_timepoint_names").when(F.col("shapes") > 1, "shape_mismatch")
    )
    return facts.withColumn("reason", reason)


def safe_members(members: DataFrame, path: str = "path") -> DataFrame:
    """Archive members that stay inside: neither absolute nor with a step upwards."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    return members.filter(~F.col(path).rlike(r"^([/\\]|[A-Za-z]:)") & ~F.exists(parts, lambda p: p == "..") & (F.trim(path) != ""))


def models_of(keys: DataFrame, key: str = "key") -> DataFrame:
    """The distinct directories right above the objects of a listing."""
    parts = F.split(key, "/")
    return keys.select(F.try_element_at(parts, F.lit(-2)).alias("model")).filter("model IS NOT NULL AND model <> ''").distinct()


def from_manifest(texts: DataFrame, text: str = "value") -> DataFrame:
    """(name, size) of JSON manifests {"models": [{"name", "size"}]}; fails on a name that is listed twice."""
    rows = texts.select(F.explode(F.from_json(text, "models array<struct<name: string, size: bigint>>")["models"]).alias("m")).select("m.name", "m.size").filter("name IS NOT NULL")
    one = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    return one.select(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("listed twice: "), F.col("name")))).otherwise(F.col("name")).alias("name"), "size")


def gpu_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """(index, name, used, total) of comma-separated GPU lines; lines with other fields are passed over."""
    p = F.transform(F.split(line, ","), lambda x: F.trim(x))
    told = lines.select(p.alias("p")).filter(F.size("p") >= 4).select(F.col("p")[0].try_cast("int").alias("index"), F.col("p")[1].alias("name"), F.col("p")[2].try_cast("int").alias("used"), F.col("p")[3].try_cast("int").alias("total"))
    return told.filter("index IS NOT NULL AND used IS NOT NULL AND total IS NOT NULL")


def merged(settings: DataFrame) -> DataFrame:
    """(key, value) of settings from several layers; the highest layer that names a key wins. settings: layer, key, value."""
    return settings.groupBy("key").agg(F.max_by("value", "layer").alias("value"))


def file_slice(files: DataFrame, start: int, end: int) -> DataFrame:
    """Files start .. end - 1 in natural order."""
    from .tracks import numbered

    ordered = numbered(files.select("name", S.natural_key(F.col("name")).alias("_k")), ["_k", "name"], "n")
    return ordered.filter(F.col("n").between(start + 1, end)).select("name", (F.col("n") - 1).alias("n"))


def expanded(folders: DataFrame) -> DataFrame:
    """Each path's children, or the path itself without any. folders: path, children."""
    return folders.select(F.explode(F.when(F.size("children") > 0, F.col("children")).otherwise(F.array("path"))).alias("path"))


def chosen(wanted: DataFrame, existing: DataFrame, mode: str) -> DataFrame:
    """What to do with each wanted dataset: create, or for existing ones what ``mode`` says (skip, overwrite or ask)."""
    have = existing.select(F.col("name").alias("_have")).distinct()
    return wanted.select("name").distinct().join(have, F.col("name") == F.col("_have"), "left").select("name", F.when(F.col("_have").isNull(), "create").otherwise(mode).alias("action"))


def norm_problem(rows: DataFrame) -> DataFrame:
    """Why a normalisation request is invalid; null if it isn't. rows: mode, low, high."""
    both, none = F.col("low").isNotNull() & F.col("high").isNotNull(), F.col("low").isNull() & F.col("high").isNull()
    reason = (
        F.when(~F.col("mode").isin("per_volume", "global_auto", "manual") | F.col("mode").isNull(), "unknown_mode")
        .when((F.col("mode") != "manual") & ~none, "bounds_not_allowed").when((F.col("mode") == "manual") & ~both, "bounds_missing").when((F.col("mode") == "manual") & (F.col("high") <= F.col("low")), "bounds_order")
    )
    return rows.withColumn("reason", reason)
