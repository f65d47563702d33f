"""Tables that operators hand on: curves, named lists, manifests, sparse labels, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which (counted first) a table is broadcast.
BROADCAST_ROWS = 100_000


def small(table: DataFrame) -> DataFrame:
    """``table`` marked for a broadcast if it is counted to be small enough, else left to a shuffle."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def padded(curves: DataFrame, values: str, pad: float) -> DataFrame:
    """``curves`` with all arrays as long as the longest, filled with ``pad``, and their own lengths."""
    longest = curves.agg(F.greatest(F.max(F.size(values)), F.lit(0)).alias("_longest"))
    filled = curves.crossJoin(F.broadcast(longest))  # one row
    return filled.select(*(c for c in curves.columns if c != values), F.concat(values, F.array_repeat(F.lit(float(pad)), F.col("_longest") - F.size(values))).alias(values), F.size(values).alias("length"))


def aligned(current: DataFrame, saved: DataFrame, name: str = "name", position: str = "position") -> DataFrame:
    """The saved lists in the order of the current names.

    Both have ``name`` and ``position``; an error tells of different counts, of
    names that are missing, and of names that occur twice unless both sides
    have the same names in the same places.
    """
    count = lambda t: t.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(name).alias("d")).first()
    here, there = count(current), count(saved)
    if here["n"] != there["n"]:
        raise ValueError("the numbers of features differ")
    by = [name]
    if here["d"] < here["n"] or there["d"] < there["n"]:
        by = [name, position]
    found = current.select(name, position).join(saved if by == [name, position] else saved.drop(position), by)
    if found.count() < here["n"]:
        raise ValueError("features are missing or out of place")
    return found


def selected(manifest: DataFrame, wanted: DataFrame, name: str = "name") -> DataFrame:
    """The manifest's rows of the wanted names; unknown names are an error."""
    unknown = [r[0] for r in wanted.select(name).distinct().join(manifest.select(name), name, "left_anti").limit(5).collect()]
    if unknown:
        raise ValueError(f"unknown names: {unknown}")
    return manifest.join(wanted.select(name).distinct(), name, "left_semi")


def present(expected: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """The expected rows that exist."""
    return expected.join(there.select(*keys).distinct(), keys, "left_semi")


def merged(older: Column, newer: Column) -> Column:
    """Two maps in one; the newer one's values win."""
    return F.map_zip_with(older, newer, lambda k, a, b: F.coalesce(b, a))


def with_curves(values: DataFrame, curves: DataFrame, key: str = "c") -> DataFrame:
    """Every value with the curve of its channel."""
    return values.join(small(curves), key)


def sparse(labels: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(row, n, columns, values): rows of a matrix in compressed form, their entries that aren't 0 in order of columns."""
    entry = F.when(F.col(value) != 0, F.struct(F.col(column).alias("k"), F.col(value).alias("v")))
    kept = labels.groupBy(row).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return kept.select(row, F.size("e").alias("n"), F.col("e.k").alias("columns"), F.col("e.v").alias("values"))


def dense(rows: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """The entries of compressed rows."""
    return rows.select(row, F.explode(F.arrays_zip("columns", "values")).alias("e")).select(row, F.col("e.columns").alias(column), F.col("e.values").alias(value))


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def as_json(rows: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as JSON with its names in camel case; nulls are left out."""
    return rows.select(key, F.to_json(F.struct(*(F.col(c).alias(camel(c)) for c in rows.columns))).alias("json"))


def every_one(parts: list[DataFrame]) -> DataFrame:
    """The distinct rows of several lists."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)
