"""Views of the test tables that play the parts of volumes, masks, detections, features, files, logs and metrics.

Each is one SQL text that Spark and DuckDB both understand; ``{table}`` stands
for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    # a sparse volume for each year: price over tax, quantity and discount
    "voxel": (("lineitem",), "SELECT CAST(year(l_shipdate) AS VARCHAR(4)) AS tp, CAST(round(l_tax * 100) AS INT) AS z, CAST(l_quantity AS INT) AS y, CAST(round(l_discount * 100) AS INT) AS x, max(l_extendedprice) AS v FROM {lineitem} GROUP BY 1, 2, 3, 4"),
    # bright voxels in fixed boxes
    "mask": (("lineitem",), "SELECT tp, z, y, x, CASE WHEN v > 20000 THEN CAST(floor(y / 10.0) AS INT) * 10 + CAST(floor(x / 4.0) AS INT) + 1 ELSE 0 END AS label FROM (" "SELECT CAST(year(l_shipdate) AS VARCHAR(4)) AS tp, CAST(round(l_tax * 100) AS INT) AS z, CAST(l_quantity AS INT) AS y, CAST(round(l_discount * 100) AS INT) AS x, max(l_extendedprice) AS v FROM {lineitem} GROUP BY 1, 2, 3, 4) s"),
    # an object for each user and day
    "det": (("events",), "SELECT CAST(dayofyear(ts) AS INT) AS t, user_id + 1 AS label, round(avg(value), 4) AS cy, round(avg(hour(ts)), 4) AS cx, CAST(count(*) AS DOUBLE) AS cz, round(avg(value), 4) AS A FROM {events} GROUP BY 1, 2"),
    # vectors in frames of fifty
    "feat": (("embeddings",), "SELECT CAST(floor(vec_id / 50.0) AS INT) + 1 AS t, vec_id % 50 + 1 AS label, embedding AS feat FROM {embeddings}"),
    "sample": (("documents", "labels"), "SELECT 0 AS c, CASE WHEN l.quality = 1 THEN 'fg' ELSE 'bg' END AS cls, d.doc_id AS id, d.doc_id % 4 AS z, CAST(least(floor(d.n_chars / 64.0), 255) AS DOUBLE) AS v FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"),
    "file": (("pages",), "SELECT page_id, concat('/data/Ex0', CAST(page_id % 5 AS VARCHAR(20)), '/DS') AS dir, concat('Ex0', CAST(page_id % 5 AS VARCHAR(20)), '_Cam', CASE WHEN page_id % 2 = 0 THEN 'A' ELSE 'B' END, '_ch', CAST(page_id % 3 AS VARCHAR(20)), '_stack', CASE WHEN page_id % 7 = 0 THEN CAST(page_id AS VARCHAR(20)) ELSE lpad(CAST(page_id AS VARCHAR(20)), 6, '0') END, '_', CASE WHEN page_id % 4 = 0 THEN '488nm' ELSE '560nm' END, CASE WHEN page_id % 11 = 0 THEN '.TIFF' WHEN page_id % 13 = 0 THEN '.txt' ELSE '.tif' END) AS name, page_id % 17 = 0 AS is_dir, CAST(length(html) AS BIGINT) AS length, page_id * 37 % 1000 AS mtime_ms FROM {pages}"),
    "log": (("events",), "SELECT CAST(user_id AS VARCHAR(20)) AS job_id, event_id AS seq, concat('Saved features to /out/hr_feats/', event_type, CAST(event_id % 9 AS VARCHAR(20)), '.npy') AS line FROM {events}"),
    "metric": (("events",), "SELECT event_type AS name, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS iteration, round(value, 3) AS value FROM {events}"),
    "job": (("orders",), "SELECT CAST(o_orderkey AS VARCHAR(20)) AS job_id, CAST(o_custkey AS VARCHAR(20)) AS owner, o_orderkey * 10 AS created_at_ms, o_orderkey % 5 AS processed, CAST(4 AS BIGINT) AS total, CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS exit_code, o_orderkey % 7 = 0 AS stop_requested, lower(o_orderpriority) AS kind FROM {orders}"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL that begins with the named views."""
    texts = [f"{n} AS (" + VIEWS[n][1].format(**{t: t for t in VIEWS[n][0]}) + ")" for n in names]
    head = "WITH RECURSIVE " if sql.lstrip().upper().startswith("RECURSIVE ") else "WITH "
    body = sql.lstrip().removeprefix("RECURSIVE ").removeprefix("WITH ")
    joiner = ", " if sql.lstrip().removeprefix("RECURSIVE ").startswith("WITH ") else " "
    return head + ", ".join(texts) + joiner + body
