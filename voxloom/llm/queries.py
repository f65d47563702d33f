"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, filter_audit, html_text, leaderboard, licenses, mixing, near_dedup, neighbours, quality, substring_dedup, token_counts, warc
from .oracles import ORACLES
from .runtime import new_path, written

#: The tokenizer of op7, a file of the installed vocabularies.
TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of the documents as files ``source/lang/doc_id.txt``."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    found = licenses.license_scan(docs.select("doc_id", path.alias("path"), "text"))
    return found.select("doc_id", "path", F.array_join("declared", ",").alias("declared"), "score", F.array_join("licenses", ",").alias("licenses"), "inherited_from")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of the whole documents so that each source's share follows the square root of its size."""
    return mixing.mix(_table(spark, sf_dir, "documents"), exponent=0.5, rate=1.0, seed="mix")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=1024)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path, min_revisit_bytes=0)
    records = written(warc.read_archives(spark, path).drop("payload"), "records")
    return warc.resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_leaderboard_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.change_feed(*(_table(spark, sf_dir, t) for t in ("sale_lines", "vendors", "items")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_near_dedup": op2_near_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_html_text": op4_html_text,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_token_counts": op7_token_counts,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_filter_audit": op12_filter_audit,
    "op13_leaderboard_feed": op13_leaderboard_feed,
}
