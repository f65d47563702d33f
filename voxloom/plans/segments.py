"""Registered queries of tiles, segmentation, sampled crops, views and shuffle buffers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checkpoints import shared_folder
from ..operators import launch, segmentation, tiles, training_views
from ..streaming import shuffle_buffer
from .more import _sql
from .queries import SHAPE, _r, query
from .views import table, view

_AT = ["tp", "z", "y", "x"]


@query
def neighbour_values(spark, sf):
    """The 27 values around every voxel, as one number that tells their places apart."""
    told = tiles.neighbour_values(view(spark, sf, "voxel"), SHAPE, side=16)
    place = F.aggregate(F.transform("values", lambda v, k: v * (k + 1)), F.lit(0.0), lambda s, x: s + x)
    return told.select(*_AT, F.size("values").alias("n"), F.round(F.col("values")[13], 2).alias("middle"), F.round(place + 1e-4, 2).alias("total"))


_sql(
    "neighbour_values",
    "WITH o AS (SELECT a, b, c, (a + 1) * 9 + (b + 1) * 3 + c + 2 AS k FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b), (SELECT unnest([-1, 0, 1]) AS c)) "
    "SELECT p.tp, p.z, p.y, p.x, 27 AS n, round(p.v, 2) AS middle, round(sum(q.v * k) + 1e-4, 2) AS total FROM voxel p, o JOIN voxel q ON q.tp = p.tp AND q.z = p.z + a AND q.y = p.y + b AND q.x = p.x + c GROUP BY ALL",
    "voxel",
)


@query
def spot_response(spark, sf):
    """Minus the Laplacian of a Gaussian of every volume, dense, edges repeated."""
    told = tiles.stencils(view(spark, sf, "voxel").withColumn("v", F.col("v") / 1000), SHAPE, {"v": [tiles.weighted(-tiles.laplacian_of_gaussian())]}, side=16)
    return told.select(*_AT, *_r("v"))


_sql(
    "spot_response",
    # a sum of products of three lines, so three passes of seven taps
    "WITH k AS (SELECT k, exp(-k * k / 2.0) AS e, k * k * exp(-k * k / 2.0) AS f FROM (SELECT unnest(range(-3, 4))::INT AS k)), "
    "m AS (SELECT (3 * sum(f) * sum(e) ** 2 - 3 * sum(e) ** 3) / 343 AS m FROM k), "
    "g AS (SELECT tp, z::INT AS z, y::INT AS y, x::INT AS x FROM (SELECT DISTINCT tp FROM voxel), range(9) r(z), range(51) s(y), range(11) t(x)), "
    "d AS (SELECT g.*, coalesce(v, 0) / 1000 AS v FROM g LEFT JOIN voxel USING (tp, z, y, x)), "
    "a AS (SELECT g.tp, g.z, g.y, g.x, sum(v * e) AS e, sum(v * f) AS f, sum(v) AS b FROM (SELECT g.*, k.*, least(greatest(g.x + k, 0), 10) AS i FROM g, k) g JOIN d ON d.tp = g.tp AND d.z = g.z AND d.y = g.y AND d.x = i GROUP BY ALL), "
    "b AS (SELECT g.tp, g.z, g.y, g.x, sum(a.e * g.e) AS e, sum(a.f * g.e + a.e * g.f) AS f, sum(b) AS b FROM (SELECT g.*, k.*, least(greatest(g.y + k, 0), 50) AS i FROM g, k) g JOIN a ON a.tp = g.tp AND a.z = g.z AND a.y = i AND a.x = g.x GROUP BY ALL), "
    "c AS (SELECT g.tp, g.z, g.y, g.x, sum(b.e * g.e) AS e, sum(b.f * g.e + b.e * g.f) AS f, sum(b) AS b FROM (SELECT g.*, k.*, least(greatest(g.z + k, 0), 8) AS i FROM g, k) g JOIN b ON b.tp = g.tp AND b.z = i AND b.y = g.y AND b.x = g.x GROUP BY ALL) "
    "SELECT tp, z, y, x, round(m * b - (f - 3 * e) + 1e-9, 4) AS v FROM c, m",
    "voxel",
)


@query
def segmented_regions(spark, sf):
    """No SQL: components and nearest seeds; compared with a sequential version in the tests. Channels are the values and their square roots."""
    tokens = view(spark, sf, "voxel").select(*_AT, F.array(F.col("v").cast("double"), F.sqrt("v")).alias("features"))
    return segmentation.segmented(tokens, SHAPE, (9, 51, 22), radius=2, side=24)


_VIEWS = {"large": ((6, 24, 8), range(2), (0.3, 1.0)), "small": ((3, 12, 4), range(2, 10), (0.05, 0.3))}


def _ten(spark, sf):
    """Two large and eight small boxes of every volume."""
    volumes = view(spark, sf, "voxel").select("tp").distinct()
    each = [training_views.resized_boxes(volumes.withColumn("box", F.explode(F.array(*map(F.lit, boxes)))), SHAPE, size, scale) for size, boxes, scale in _VIEWS.values()]
    return each[0].unionByName(each[1])


@query
def resized_views(spark, sf):
    return training_views.resized(view(spark, sf, "voxel"), _ten(spark, sf)).select("tp", "box", "z", "y", "x", *_r("v"))


@query
def resized_view_boxes(spark, sf):
    return _ten(spark, sf)


def _boxes_sql() -> str:
    u = lambda *what: "('0x' || substr(md5('crop:' || tp || ':' || box" + "".join(f" || ':' || {w}" for w in what) + "), 1, 12))::BIGINT::DOUBLE / 281474976710656.0"
    kinds = ", ".join(f"({b}, {s[0]}, {s[1]}, {s[2]}, {lo}::DOUBLE, {hi}::DOUBLE)" for s, boxes, (lo, hi) in _VIEWS.values() for b in boxes)
    begin = lambda a, n: f"CASE WHEN k IS NULL THEN (({n} - m{a}) // 2) ELSE floor({u(chr(39) + 'at' + chr(39), chr(39) + a + chr(39))} * ({n} - d{a} + 1)) END::INT"
    span = "(ln(4.0 / 3) - ln(0.75))"
    return (
        f"b AS (SELECT * FROM (SELECT DISTINCT tp FROM voxel), (VALUES {kinds}) AS t(box, rz, ry, rx, lo, hi)), "
        f"a AS (SELECT b.*, k, (9 * 51 * 11) * (lo + (hi - lo) * {u(chr(39) + 'part' + chr(39))}) AS room, ry::DOUBLE / rz * exp(ln(0.75) + {span} * {u('k', chr(39) + 'y' + chr(39))}) AS high, rx::DOUBLE / rz * exp(ln(0.75) + {span} * {u('k', chr(39) + 'x' + chr(39))}) AS broad FROM b, range(10) r(k)), "
        "s AS (SELECT *, round((room / (high * broad)) ** (1.0 / 3)) AS deep FROM a), "
        "f AS (SELECT tp, box, min({'k': k, 'z': deep, 'y': round(deep * high), 'x': round(deep * broad)}) AS s FROM s WHERE deep BETWEEN 1 AND 9 AND round(deep * high) BETWEEN 1 AND 51 AND round(deep * broad) BETWEEN 1 AND 11 GROUP BY ALL), "
        "m AS (SELECT b.*, s.k AS k, least(9.0 / rz, 51.0 / ry, 11.0 / rx) AS q, least(9, trunc(rz * q))::INT AS mz, least(51, trunc(ry * q))::INT AS my, least(11, trunc(rx * q))::INT AS mx, coalesce(s.z, mz)::INT AS dz, coalesce(s.y, my)::INT AS dy, coalesce(s.x, mx)::INT AS dx FROM b LEFT JOIN f USING (tp, box)), "
        f"w AS (SELECT *, {begin('z', 9)} AS z0, {begin('y', 51)} AS y0, {begin('x', 11)} AS x0 FROM m), "
        "boxes AS (SELECT tp, box, z0, z0 + dz AS z1, y0, y0 + dy AS y1, x0, x0 + dx AS x1, rz, ry, rx FROM w)"
    )


_sql("resized_view_boxes", f"WITH {_boxes_sql()} SELECT * FROM boxes", "voxel")
_ends = lambda a: f"LATERAL (SELECT greatest(0, ({a} + 0.5) * ({a}1 - {a}0)::DOUBLE / r{a} - 0.5) AS at_{a})"
_corner = lambda a: f"unnest([{{'i': {a}0 + least(floor(at_{a}), {a}1 - {a}0 - 1)::INT, 'w': 1 - (at_{a} - floor(at_{a}))}}, {{'i': {a}0 + least(floor(at_{a}) + 1, {a}1 - {a}0 - 1)::INT, 'w': at_{a} - floor(at_{a})}}]) AS c{a}"
_sql(
    "resized_views",
    f"WITH {_boxes_sql()}, g AS (SELECT boxes.*, z::INT AS z, y::INT AS y, x::INT AS x FROM boxes, range(24) r(z), range(24) s(y), range(24) t(x) WHERE z < rz AND y < ry AND x < rx), "
    f"p AS (SELECT * FROM g, {_ends('z')}, {_ends('y')}, {_ends('x')}), c1 AS (SELECT *, {_corner('z')} FROM p), c2 AS (SELECT *, {_corner('y')} FROM c1), c3 AS (SELECT *, {_corner('x')} FROM c2) "
    "SELECT c.tp, box, c.z, c.y, c.x, round(sum(coalesce(v.v, 0) * cz.w * cy.w * cx.w) + 1e-9, 4) AS v FROM c3 c LEFT JOIN voxel v ON v.tp = c.tp AND v.z = cz.i AND v.y = cy.i AND v.x = cx.i GROUP BY ALL",
    "voxel",
)


@query
def pretraining_views(spark, sf):
    """No SQL: clusters; each step is compared with numpy in the tests."""
    return training_views.pretraining_views(view(spark, sf, "voxel"), SHAPE, (6, 24, 8), (3, 12, 4), low=0.9, high=0.99).select("tp", "box", "z", "y", "x", *_r("v"), "rz", "ry", "rx")


@query
def automatic_boxes(spark, sf):
    """No SQL: clusters; compared with a sequential version in the tests."""
    return training_views.auto_boxes(view(spark, sf, "voxel"), SHAPE, k=3, low=0.5, high=0.99)


@query
def stream_shuffle(spark, sf):
    """No SQL: one row after the other; compared with a sequential buffer in the tests. Vectors come in two starts, the end with the second."""
    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 4).cast("string").alias("stream"), F.col("vec_id").alias("seq"), F.col("vec_id").cast("string").alias("item"))
    half = e.agg(F.floor(F.max("seq") / 2)).first()[0]
    ends = e.groupBy("stream").agg(F.max("seq").alias("seq")).withColumn("item", F.lit(None).cast("string"))
    path = shared_folder(spark, "shuffle")
    for part in (e.filter(F.col("seq") <= half), e.filter(F.col("seq") > half).unionByName(ends)):
        part.write.mode("append").parquet(f"{path}/rows")
        shuffle_buffer.run(spark.readStream.schema(shuffle_buffer.ROWS).parquet(f"{path}/rows"), f"{path}/out", f"{path}/checkpoint", 50, 100)
    return spark.read.schema(shuffle_buffer.SHUFFLED).parquet(f"{path}/out")


@query
def download_launch(spark, sf):
    """An order asks for its lines' parts; every seventh part isn't in the manifest, a third is there already, odd lines' names are wrong in some orders."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("n"), F.concat(F.when(F.col("l_orderkey") % 29 == 0, F.lit("../")).otherwise(F.lit(" p")), F.col("l_partkey").cast("string")).alias("raw"))
    asked = lines.groupBy("request").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "raw"))), lambda r: r["raw"]).alias("datasets"))
    mode = F.when(F.col("request") % 3 == 0, F.lit("skip")).when(F.col("request") % 3 == 1, F.lit("overwrite"))
    requests = table(spark, sf, "orders").select(F.col("o_orderkey").alias("request")).join(asked, "request", "left").withColumn("existing_mode", mode)
    parts = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"))
    told = launch.download_launch(requests, parts.filter("p_partkey % 7 <> 0"), parts.filter("p_partkey % 3 = 0"))
    return told.select("request", "reason", "needs_confirmation", "overwrite", *(F.array_join(c, ",").alias(c) for c in ("names", "selected", "skipped")))


_sql(
    "download_launch",
    "WITH l AS (SELECT l_orderkey AS request, l_linenumber AS n, CASE WHEN l_orderkey % 29 = 0 THEN '../' ELSE 'p' END || l_partkey AS name, l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0) AS listed, l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0) AS there FROM lineitem), "
    "u AS (SELECT request, name, listed, there, min(n) AS n FROM l GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY request, listed ORDER BY n, name) AS k FROM u), "
    "a AS (SELECT o_orderkey AS request, o_orderkey % 3 AS mode, count(name) AS c, count(*) FILTER (NOT listed) AS missing, count(*) FILTER (there) AS old, first(name ORDER BY n, name) AS wrong, string_agg(name, ',' ORDER BY n, name) FILTER (NOT listed AND k <= 3) AS unknown, string_agg(name, ',' ORDER BY n, name) FILTER (there) AS old_names, "
    "coalesce(string_agg(name, ',' ORDER BY n, name), '') AS all_names, string_agg(name, ',' ORDER BY n, name) FILTER (NOT there) AS new_names FROM orders LEFT JOIN o ON o.request = o_orderkey GROUP BY ALL), "
    "w AS (SELECT *, CASE WHEN c = 0 THEN 'missing_selection' WHEN request % 29 = 0 THEN 'invalid_dataset_name' WHEN missing > 0 THEN 'unknown_dataset' WHEN mode = 2 AND old > 0 THEN 'ask' WHEN mode = 0 AND old = c THEN 'nothing_to_download' END AS why FROM a) "
    "SELECT request, nullif(why, 'ask') AS reason, coalesce(why = 'ask', false) AS needs_confirmation, why IS NULL AND mode <> 0 AS overwrite, CASE why WHEN 'invalid_dataset_name' THEN wrong WHEN 'unknown_dataset' THEN unknown WHEN 'ask' THEN old_names END AS names, "
    "CASE WHEN why IS NULL THEN CASE WHEN mode = 0 THEN new_names ELSE all_names END END AS selected, CASE WHEN why IS NULL THEN CASE WHEN mode = 0 THEN coalesce(old_names, '') ELSE '' END END AS skipped FROM w",
)
