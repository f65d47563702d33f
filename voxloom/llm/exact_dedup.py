"""Exact deduplication by a 128-bit content hash (SQL functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import fresh, named

#: A run of ASCII white space.
_SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACES, " ")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", content_hash=F.md5) -> DataFrame:
    """For every row the row of equal text that stays.

    Rows are grouped by ``content_hash`` (128 bits) of the normalised text and,
    within it, by the text itself: the aggregation's hash table compares the
    bytes, so texts whose hashes collide form different groups.  Partial sums
    on the map side make one row per task of any number of copies, so a text
    that holds a third of all rows costs no more than a rare one.  The way back
    from a group to its rows is an equi-join on (hash, SHA-256) of narrow
    rows, which adaptive execution splits where a group is large; no text is
    moved there.  Two different texts of one group with equal MD5 *and* equal
    SHA-256 would stop the job rather than be merged.

    Returns one row per input row: ``id_col``, ``keep_id`` (smallest id of the
    group), ``group_size``, ``kept``, ``text_sha256``.  Null text counts as
    empty.  Null ids count in ``group_size`` but never stay if the group has
    another id; in a group of null ids alone ``keep_id`` is null and the rows
    are kept.  Rows that repeat an id with equal text are all kept or all
    dropped.  Other columns are ignored; an empty table gives an empty result.
    """
    text = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    keyed = text.select("id", "norm", content_hash(F.col("norm").cast("binary")).alias("h"))
    same = keyed.groupBy("h", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = (
        same.select("h", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "keep_id", "group_size")
        .groupBy("h", "sha")
        .agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        .select(
            F.col("h").alias("gh"),
            F.col("sha").alias("gsha"),
            "keep_id",
            F.when(F.col("texts") > 1, F.raise_error(F.lit("different texts have equal MD5 and SHA-256")).cast("long")).otherwise(F.col("group_size")).alias("group_size"),
        )
    )
    rows = keyed.select("id", "h", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
    return rows.join(groups, (F.col("h") == F.col("gh")) & (F.col("sha") == F.col("gsha"))).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text no row with a smaller id has.

    Rows that repeat an id with equal text are one document and stay together.
    """
    kept_id, kept_sha = fresh(docs.columns, "kept_id", "kept_sha")
    kept = exact_groups(docs, id_col=id_col, text_col=text_col).filter("kept").select(F.col(id_col).alias(kept_id), F.col("text_sha256").alias(kept_sha)).distinct()
    sha = F.sha2(normalised(named(text_col)).cast("binary"), 256)
    return docs.join(kept, named(id_col).eqNullSafe(F.col(kept_id)) & (sha == F.col(kept_sha)), "left_semi")
