"""DuckDB SQL of the registered queries."""

from __future__ import annotations

import ipaddress

from .queries import ADDRESSES
from .views import with_views as _v

ORACLES: dict[str, str] = {}


def _shifted(sql: str) -> str:
    """``sql`` whose ``round(x, d)`` with d below 6 rounds x + 1e-9, as the queries do: exact ties then round alike."""
    out, at = [], 0
    while (begin := sql.find("round(", at)) >= 0:
        depth, comma, end = 1, -1, begin + 6
        while depth:
            c = sql[end]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = end
            end += 1
        inner, digits = sql[begin + 6 : comma], sql[comma + 1 : end - 1].strip()
        shift = int(digits) < 6 and "1e-9" not in inner
        out.append(sql[at:begin] + (f"round(({_shifted(inner)}) + 1e-9, {digits})" if shift else f"round({inner}, {digits})"))
        at = end
    return "".join(out) + sql[at:]


def _add(name: str, sql: str, *views: str) -> None:
    sql = _shifted(sql)
    ORACLES[name] = _v(sql, *views) if views else sql


_OBJECTS = "WITH o AS (SELECT m.*, v.v FROM mask m JOIN voxel v USING (tp, z, y, x)) "

_add(
    "object_geometry",
    "SELECT tp, label, count(*) AS volume, round(avg(z), 4) AS cz, round(avg(y), 4) AS cy, round(avg(x), 4) AS cx, min(z) AS z0, max(z) + 1 AS z1, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM mask WHERE label <> 0 GROUP BY tp, label",
    "mask",
)
_add("object_intensity", _OBJECTS + "SELECT tp, label, count(*) AS volume, round(sum(v), 2) AS total, round(sum(v) / count(*), 3) AS amplitude FROM o WHERE label <> 0 GROUP BY tp, label", "mask", "voxel")
_add("weighted_centroid", _OBJECTS + "SELECT tp, label, round(sum(z * v) / (sum(v) + 1e-6), 4) AS wz, round(sum(y * v) / (sum(v) + 1e-6), 4) AS wy, round(sum(x * v) / (sum(v) + 1e-6), 4) AS wx FROM o WHERE label <> 0 GROUP BY tp, label", "mask", "voxel")
_add("label_feature_mean", "SELECT t, c - 1 AS c, round(avg(f::DOUBLE), 5) AS mean FROM (SELECT t, unnest(feat) AS f, unnest(range(1, 65)) AS c FROM feat) GROUP BY t, c", "feat")
_add(
    "particle_medians",
    _OBJECTS + ", r AS (SELECT *, row_number() OVER (PARTITION BY tp, label ORDER BY z, y, x) AS n FROM o WHERE label <> 0) "
    "SELECT tp, label, list_sort(list(v))[count(*) // 2 + 1] AS median, round(sum(v), 2) AS total, round(avg(v), 2) AS mean FROM r WHERE n <= 4000 GROUP BY tp, label",
    "mask", "voxel",
)
_add(
    "local_background",
    _OBJECTS + ", axis AS (SELECT unnest(range(-4, 5)) AS d), shell AS (SELECT a.d AS a, b.d AS b, c.d AS c FROM axis a, axis b, axis c WHERE a.d * a.d + b.d * b.d + c.d * c.d BETWEEN 5 AND 16), "
    "seen AS (SELECT p.tp, p.label, q.v FROM (SELECT o.tp, o.label, o.z + s.a AS z, o.y + s.b AS y, o.x + s.c AS x FROM o, shell s WHERE o.label <> 0) p JOIN (SELECT * FROM o WHERE label = 0) q USING (tp, z, y, x)), "
    "bg AS (SELECT tp, label, avg(v) AS b FROM seen GROUP BY tp, label), m AS (SELECT tp, label, count(*) AS volume, sum(v) AS total FROM o WHERE label <> 0 GROUP BY tp, label), "
    "r AS (SELECT tp, label, volume, coalesce(b, 0) AS b, total / volume - coalesce(b, 0) AS c, total - coalesce(b, 0) * volume AS t FROM m LEFT JOIN bg USING (tp, label)) "
    "SELECT tp, label, volume, round(b + 1e-9 + abs(b) * 1e-12, 2) AS background, round(c + 1e-9 + abs(c) * 1e-12, 2) AS corrected_mean, round(t + 1e-9 + abs(t) * 1e-12, 2) AS corrected_total FROM r",
    "mask", "voxel",
)
_add(
    "matched_background",
    _OBJECTS + ", bg AS (SELECT tp, v, row_number() OVER (PARTITION BY tp ORDER BY z, y, x) - 1 AS n FROM o WHERE label = 0), t AS (SELECT tp, count(*) AS total FROM bg GROUP BY tp), "
    "s AS (SELECT tp, list({'label': label, 'volume': volume, 'begin': NULL::BIGINT, 'start': 0::BIGINT} ORDER BY label) AS sizes, coalesce(any_value(total), 0) AS total FROM (SELECT tp, label::BIGINT AS label, count(*) AS volume FROM mask WHERE label <> 0 GROUP BY tp, label) LEFT JOIN t USING (tp) GROUP BY tp), "
    "f AS (SELECT tp, total, list_reduce(list_transform(sizes, lambda e: [e]), lambda done, e: done || [{'label': e[1].label, 'volume': e[1].volume, 'begin': CASE WHEN done[-1].start + e[1].volume <= total THEN done[-1].start END, 'start': done[-1].start + CASE WHEN done[-1].start + e[1].volume <= total THEN e[1].volume ELSE 0 END}], "
    "[{'label': -1::BIGINT, 'volume': 0::BIGINT, 'begin': NULL::BIGINT, 'start': 0::BIGINT}]) AS done FROM s), "
    "w AS (SELECT tp, total, done.label AS label, done.volume AS volume, done.begin AS begin FROM (SELECT tp, total, unnest(done) AS done FROM f)), "
    "p AS (SELECT tp, label, total, begin, CASE WHEN begin IS NOT NULL THEN begin + j WHEN total > 0 THEN ('0x' || substr(md5('background:' || tp || ':' || label || ':' || j), 1, 12))::BIGINT % total END AS n FROM (SELECT *, unnest(range(0, volume)) AS j FROM w WHERE label >= 0)) "
    "SELECT p.tp, p.label, count(bg.v) AS drawn, bool_and(begin IS NULL AND total > 0) AS redrawn, round(avg(bg.v), 2) AS background FROM p LEFT JOIN bg ON bg.tp = p.tp AND bg.n = p.n GROUP BY p.tp, p.label",
    "mask", "voxel",
)
_add(
    "median_fill",
    "WITH g AS (SELECT tp, z, y, x, CASE WHEN (y * 11 + x) % 13 = 0 THEN 0.0 ELSE v END AS v FROM voxel), m AS (SELECT tp, median(v) FILTER (abs(v) > 1e-6) AS m FROM g GROUP BY tp) "
    "SELECT tp, z, y, x, round(CASE WHEN abs(v) <= 1e-6 THEN m ELSE v END, 4) AS v FROM g JOIN m USING (tp)",
    "voxel",
)
_GAPPY = "WITH g AS (SELECT tp, z, y, x, CASE WHEN (y * 11 + x) % 17 = 0 THEN 'NaN'::DOUBLE WHEN (y * 11 + x) % 19 = 0 THEN 'Infinity'::DOUBLE WHEN (y * 11 + x) % 23 = 0 THEN '-Infinity'::DOUBLE ELSE v END AS v FROM voxel), "
_add(
    "sanitize_nonfinite",
    _GAPPY + "m AS (SELECT tp, median(v) AS m, min(v) AS lo, max(v) AS hi FROM g WHERE isfinite(v) GROUP BY tp) "
    "SELECT tp, z, y, x, round(CASE WHEN isfinite(v) THEN v WHEN isnan(v) THEN m WHEN v > 0 THEN hi ELSE lo END, 4) AS v FROM g JOIN m USING (tp)",
    "voxel",
)
_add(
    "pad_value",
    _GAPPY + "i AS (SELECT *, coalesce(CASE WHEN z < 4 THEN tp <> '1995' END, true) AS inside FROM g WHERE isfinite(v)) "
    "SELECT tp, round(coalesce(median(v) FILTER (inside), median(v)), 4) AS pad, count(*) FILTER (inside) = 0 AS unmasked FROM i GROUP BY tp",
    "voxel",
)
_add(
    "minmax_scale",
    "WITH s AS (SELECT tp, z, y, x, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-6), 6) AS scaled FROM voxel WINDOW w AS (PARTITION BY tp)) SELECT *, round(scaled * 2.0 - 1.0, 5) AS remapped FROM s",
    "voxel",
)
_add("quantize_u8", "SELECT floor(least(greatest(v / (60000.0 + 1e-6) * 255, 0.0), 255.0))::INT AS q, count(*) AS n FROM voxel GROUP BY 1", "voxel")
_HIST = "WITH h AS (SELECT tp, least(floor(v * (4096 / 65535.0)), 4095)::INT AS bin, count(*) AS n FROM voxel WHERE v BETWEEN 0 AND 65535 GROUP BY 1, 2), t AS (SELECT tp, floor(count(*) / 50.0) AS most FROM voxel GROUP BY tp), "
_add(
    "hist_bounds_cumulative",
    _HIST + "c AS (SELECT *, sum(n) OVER (PARTITION BY tp ORDER BY bin) AS up, sum(n) OVER (PARTITION BY tp ORDER BY bin DESC) AS down FROM h JOIN t USING (tp)) "
    "SELECT tp, coalesce(min(bin) FILTER (up > most), 0) AS lo, coalesce(max(bin) FILTER (down > most), 4095) AS hi FROM c GROUP BY tp",
    "voxel",
)
_add(
    "hist_bounds_count",
    "WITH h AS (SELECT tp, least(floor(v * (256 / 65536.0)), 255)::INT AS bin, count(*) AS n FROM voxel WHERE v BETWEEN 0 AND 65536 GROUP BY 1, 2), t AS (SELECT tp, floor(count(*) / 240.0) AS most FROM voxel GROUP BY tp) "
    "SELECT tp, min(bin) * 256.0::DOUBLE AS lo, max(bin) * 256.0::DOUBLE AS hi FROM h JOIN t USING (tp) WHERE n > most GROUP BY tp",
    "voxel",
)
_add(
    "global_hist_bounds",
    "WITH g AS (SELECT max(v) AS top, floor(count(*) / 50.0) AS most FROM voxel WHERE v <> 0), h AS (SELECT least(floor(v * 4096 / top), 4095)::INT AS bin, count(*) AS n FROM voxel, g WHERE v <> 0 GROUP BY 1), "
    "c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS up, sum(n) OVER (ORDER BY bin DESC) AS down FROM h) "
    "SELECT round(min(bin) FILTER (up > most) * max(top) / 4095, 4) AS lo, round(max(bin) FILTER (down > most) * max(top) / 4095, 4) AS hi FROM c, g",
    "voxel",
)
_add("global_mean_std", "SELECT tp, count(*) AS n, round(avg(v), 3) AS mean, round(stddev_pop(v), 2) AS std FROM voxel GROUP BY tp", "voxel")
_add("percentile_band", "WITH q AS (SELECT tp, quantile_cont(v, 0.9) AS lo, quantile_cont(v, 0.99) AS hi FROM voxel GROUP BY tp) SELECT tp, z, y, x, v FROM voxel JOIN q USING (tp) WHERE v > lo AND v < hi", "voxel")
_add("z_projection", "SELECT tp, y, x, max(v) AS top, round(avg(v) + 1e-9, 3) AS v FROM voxel GROUP BY tp, y, x", "voxel")
_add("nonzero_stacks", "SELECT DISTINCT tp, z FROM voxel WHERE v > 1e-6", "voxel")
_add(
    "grid_chunks",
    "SELECT tp, 0 AS kz, y // 16 AS ky, x // 4 AS kx, count(*) AS voxels, max(v) AS top, min(z) AS z0, min(y) AS y0, min(x) AS x0, max(z) + 1 AS z1, max(y) + 1 AS y1, max(x) + 1 AS x1 FROM voxel GROUP BY tp, y // 16, x // 4 HAVING max(v) > 1e-6",
    "voxel",
)
_PATCH = (
    "WITH pz AS (SELECT unnest([0, 2, 4, 5]) AS pz), py AS (SELECT unnest([0, 8, 16, 24, 32, 35]) AS py), px AS (SELECT unnest([0, 3, 5]) AS px), "
    "p AS (SELECT v.*, pz, py, px FROM voxel v JOIN pz ON v.z >= pz AND v.z < pz + 4 JOIN py ON v.y >= py AND v.y < py + 16 JOIN px ON v.x >= px AND v.x < px + 6) "
)
_add("overlap_patches", _PATCH + "SELECT tp, pz, py, px, count(*) AS n, max(v) AS top FROM p GROUP BY tp, pz, py, px", "voxel")
_add(
    "blend_patches",
    _PATCH + ", s AS (SELECT *, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-6) AS s, (1 - 0.9 * abs(z - pz - 1.5) / 1.5) * (1 - 0.9 * abs(y - py - 7.5) / 7.5) * (1 - 0.9 * abs(x - px - 2.5) / 2.5) AS k FROM p WINDOW w AS (PARTITION BY tp, pz, py, px)) "
    "SELECT tp, z, y, x, round(sum(s * k) / sum(k), 5) AS v FROM s GROUP BY tp, z, y, x",
    "voxel",
)
_add("reconstruct_volume", _PATCH + "SELECT tp, z, y, x, round(max_by(v + pz, pz * 10000 + py * 100 + px), 2) AS v FROM p GROUP BY tp, z, y, x", "voxel")
_add(
    "pad_or_crop",
    "WITH g AS (SELECT tp, z, y, x FROM (SELECT DISTINCT tp FROM voxel), range(0, 11) a(z), range(0, 21) b(y), range(0, 11) c(x)) SELECT g.tp, g.z, g.y, g.x, coalesce(v.v, -1.0) AS v FROM g LEFT JOIN voxel v ON v.tp = g.tp AND v.z + 1 = g.z AND v.y - 15 = g.y AND v.x = g.x",
    "voxel",
)
_add("strided_downsample", "SELECT tp, z // 2 AS z, y // 4 AS y, x, v FROM voxel WHERE z % 2 = 0 AND y % 4 = 0", "voxel")


def _axis(name: str, out: int, size: int) -> str:
    at = f"greatest((i + 0.5) * ({size} / {out}.0) - 0.5, 0.0)"
    return f"{name} AS (SELECT i AS o, least(floor({at}), {size - 1})::INT AS i, 1 - ({at} - floor({at})) AS w FROM range(0, {out}) r(i) UNION ALL SELECT i, least(floor({at}) + 1, {size - 1})::INT, {at} - floor({at}) FROM range(0, {out}) r(i))"


_add(
    "trilinear_sample",
    f"WITH {_axis('az', 4, 9)}, {_axis('ay', 12, 51)}, {_axis('ax', 22, 11)}, tps AS (SELECT DISTINCT tp FROM voxel) "
    "SELECT tps.tp, az.o AS z, ay.o AS y, ax.o AS x, round(sum(coalesce(v.v, 0) * az.w * ay.w * ax.w) + 1e-9, 3) AS v FROM tps, az, ay, ax LEFT JOIN voxel v ON v.tp = tps.tp AND v.z = az.i AND v.y = ay.i AND v.x = ax.i GROUP BY tps.tp, az.o, ay.o, ax.o",
    "voxel",
)
_add(
    "conv3d_gaussian",
    "WITH raw AS (SELECT k, exp(-0.5 * k * k) AS w FROM range(-3, 4) r(k)), kern AS (SELECT k, w / sum(w) OVER () AS w FROM raw), "
    "a AS (SELECT tp, z + k AS z, y, x, sum(v * w) AS v FROM voxel, kern WHERE z + k BETWEEN 0 AND 8 GROUP BY ALL), b AS (SELECT tp, z, y + k AS y, x, sum(v * w) AS v FROM a, kern WHERE y + k BETWEEN 0 AND 50 GROUP BY ALL) "
    "SELECT tp, z, y, x + k AS x, round(sum(v * w), 3) AS v FROM b, kern WHERE x + k BETWEEN 0 AND 10 GROUP BY tp, z, y, x + k",
    "voxel",
)
_add(
    "median_filter_2d",
    "WITH g AS (SELECT tps.tp, z, y, x, coalesce(v.v, 0) > 20000 AS inside FROM (SELECT DISTINCT tp FROM voxel) tps CROSS JOIN range(0, 9) a(z) CROSS JOIN range(0, 51) b(y) CROSS JOIN range(0, 11) c(x) LEFT JOIN voxel v USING (tp, z, y, x)), "
    "n AS (SELECT unnest([-1, 0, 1]) AS d), t AS (SELECT g.tp, g.z, g.y, g.x, least(greatest(g.y + a.d, 0), 50) AS sy, least(greatest(g.x + b.d, 0), 10) AS sx FROM g, n a, n b) "
    "SELECT t.tp, t.z, t.y, t.x, sum(s.inside::INT) >= 5 AS inside FROM t JOIN g s ON s.tp = t.tp AND s.z = t.z AND s.y = t.sy AND s.x = t.sx GROUP BY t.tp, t.z, t.y, t.x",
    "voxel",
)
_CANDIDATES = (
    "WITH c AS (SELECT a.t, a.label AS ref, b.label AS cand, sqrt((a.cy - b.cy) * (a.cy - b.cy) + (a.cx - b.cx) * (a.cx - b.cx) + 2.5 * (a.cz - b.cz) * (a.cz - b.cz))::FLOAT AS dist "
    "FROM det a JOIN det b ON b.t = a.t + 1 AND abs(a.cy - b.cy) <= 15 AND abs(a.cx - b.cx) <= 15 AND abs(a.cz - b.cz) <= 2) "
)
_add("spatial_candidates", _CANDIDATES + "SELECT t, ref, cand, round(dist::DOUBLE, 3) AS dist FROM c", "det")
_add(
    "mask_overlap_dice",
    "WITH m AS (SELECT tp::INT - 1991 AS t, label, z, y, x FROM mask WHERE label <> 0), g AS (SELECT t, label, count(*) AS volume, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx, min(z) AS z0, min(y) AS y0, min(x) AS x0, "
    "least(max(z) - min(z), max(y) - min(y), max(x) - min(x)) AS thin FROM m GROUP BY t, label), "
    "p AS (SELECT a.t, a.label AS ref, b.label AS cand, a.volume + b.volume AS vols, least(a.thin, b.thin) AS thin, (round_even((a.cz - a.z0) - (b.cz - b.z0), 0) + a.z0 - b.z0)::INT AS oz, (round_even((a.cy - a.y0) - (b.cy - b.y0), 0) + a.y0 - b.y0)::INT AS oy, (round_even((a.cx - a.x0) - (b.cx - b.x0), 0) + a.x0 - b.x0)::INT AS ox "
    "FROM g a JOIN g b ON b.t = a.t + 1 AND abs(a.cy - b.cy) <= 12 AND abs(a.cx - b.cx) <= 12 AND abs(a.cz - b.cz) <= 3), "
    "n AS (SELECT p.t, p.ref, p.cand, count(*) AS overlap FROM p JOIN m c ON c.t = p.t + 1 AND c.label = p.cand JOIN m r ON r.t = p.t AND r.label = p.ref AND r.z = c.z + p.oz AND r.y = c.y + p.oy AND r.x = c.x + p.ox WHERE p.thin >= 1 GROUP BY p.t, p.ref, p.cand) "
    "SELECT t, ref, cand, coalesce(overlap, 0)::INT AS overlap, round((2.0 * coalesce(overlap, 0) / vols)::FLOAT::DOUBLE, 5) AS dice FROM p LEFT JOIN n USING (t, ref, cand)",
    "mask",
)
_FEATURES = (
    "WITH f AS (SELECT t, label, (p // 8)::INT AS c, p % 8 AS k, p, f::DOUBLE AS f FROM (SELECT t, label, unnest(feat) AS f, unnest(range(0, 64)) AS p FROM feat)), "
    "o AS (SELECT t, label, feat[1]::DOUBLE * 100 AS cy, feat[2]::DOUBLE * 100 AS cx, feat[3]::DOUBLE * 100 AS cz FROM feat), "
    "near AS (SELECT a.t, a.label AS ref, b.label AS cand, sqrt((a.cy - b.cy) * (a.cy - b.cy) + (a.cx - b.cx) * (a.cx - b.cx) + 2.5 * (a.cz - b.cz) * (a.cz - b.cz))::FLOAT AS dist FROM o a JOIN o b ON b.t = a.t + 1 AND abs(a.cy - b.cy) <= 20 AND abs(a.cx - b.cx) <= 20 AND abs(a.cz - b.cz) <= 10), "
    "m AS (SELECT t, label, p // 16 AS z, p // 4 % 4 AS y, p % 4 AS x FROM f WHERE f > 0), "
    "g AS (SELECT t, label, count(*) AS volume, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx, min(z) AS z0, min(y) AS y0, min(x) AS x0, least(max(z) - min(z), max(y) - min(y), max(x) - min(x)) AS thin FROM m GROUP BY t, label), "
    "p AS (SELECT near.*, a.volume + b.volume AS vols, least(a.thin, b.thin) AS thin, (round_even((a.cz - a.z0) - (b.cz - b.z0), 0) + a.z0 - b.z0)::INT AS oz, (round_even((a.cy - a.y0) - (b.cy - b.y0), 0) + a.y0 - b.y0)::INT AS oy, (round_even((a.cx - a.x0) - (b.cx - b.x0), 0) + a.x0 - b.x0)::INT AS ox "
    "FROM near JOIN g a ON a.t = near.t AND a.label = ref JOIN g b ON b.t = near.t + 1 AND b.label = cand), "
    "n AS (SELECT p.t, p.ref, p.cand, count(*) AS overlap FROM p JOIN m c ON c.t = p.t + 1 AND c.label = p.cand JOIN m r ON r.t = p.t AND r.label = p.ref AND r.z = c.z + p.oz AND r.y = c.y + p.oy AND r.x = c.x + p.ox WHERE p.thin >= 1 GROUP BY p.t, p.ref, p.cand), "
    "d AS (SELECT t, ref, cand, dist, (2.0 * coalesce(overlap, 0) / vols)::FLOAT AS dice FROM p LEFT JOIN n USING (t, ref, cand)), "
    "s AS (SELECT d.t, d.ref, d.cand, any_value(d.dist) AS dist, any_value(d.dice) AS dice, a.c, count(*) AS n, sum(a.f) AS sa, sum(b.f) AS sb, sum(a.f * a.f) AS saa, sum(b.f * b.f) AS sbb, sum(a.f * b.f) AS sab, avg((a.f - b.f) * (a.f - b.f)) AS mse "
    "FROM d JOIN f a ON a.t = d.t AND a.label = d.ref JOIN f b ON b.t = d.t + 1 AND b.label = d.cand AND a.c = b.c AND a.k = b.k GROUP BY d.t, d.ref, d.cand, a.c), "
    "q AS (SELECT t, ref, cand, c, dist, dice, CASE WHEN saa - sa * sa / n > 1e-12 AND sbb - sb * sb / n > 1e-12 THEN (sab - sa * sb / n) / sqrt((saa - sa * sa / n) * (sbb - sb * sb / n)) END AS corr, mse FROM s) "
)
_add("pair_feature_mse_corr", _FEATURES + "SELECT t, ref, cand, c, round(corr, 5) AS corr, round(mse, 5) AS mse FROM q", "feat")
_add(
    "feature_votes",
    _FEATURES + ", w AS (SELECT t, ref, c, arg_min(cand, (mse, dist, cand)) AS cand FROM q WHERE corr > 0 AND dice > 0.5 GROUP BY t, ref, c), "
    "k AS (SELECT t, ref, cand, count(*) AS wins FROM w GROUP BY t, ref, cand) "
    "SELECT t, ref, cand, wins, row_number() OVER (PARTITION BY t, ref ORDER BY wins DESC, dist, cand) AS rank FROM k JOIN d USING (t, ref, cand)",
    "feat",
)
_LINKS = _CANDIDATES + (
    ", r AS (SELECT t, ref, arg_min(cand, (dist, cand)) AS cand FROM c GROUP BY t, ref), k AS (SELECT t, cand, arg_min(ref, (dist, ref)) AS ref FROM c GROUP BY t, cand), links AS (SELECT r.t, r.ref, r.cand FROM r JOIN k ON k.t = r.t AND k.ref = r.ref AND k.cand = r.cand), "
    "heads AS (SELECT t, label FROM det ANTI JOIN (SELECT t + 1 AS t, cand AS label FROM links) x USING (t, label)), ids AS (SELECT t AS start, label AS hl, row_number() OVER (ORDER BY t, label)::INT AS track_id FROM heads), "
    "walk AS (SELECT track_id, start, start AS t, hl AS label FROM ids UNION ALL SELECT w.track_id, w.start, w.t + 1, l.cand FROM walk w JOIN links l ON l.t = w.t AND l.ref = w.label) "
)
_add(
    "tracks_export",
    "RECURSIVE " + _LINKS + "SELECT w.track_id, w.start, row_number() OVER (PARTITION BY w.track_id ORDER BY w.t)::INT AS t, d.cx AS x, d.cy AS y, d.cz AS z, d.A, count(*) OVER (PARTITION BY w.track_id) AS track_length FROM walk w JOIN det d USING (t, label)",
    "det",
)
_add("track_lengths", "RECURSIVE " + _LINKS + "SELECT track_length, count(*) AS n FROM (SELECT track_id, count(*) AS track_length FROM walk GROUP BY track_id) GROUP BY track_length", "det")
_RANGE = "WITH r AS (SELECT min(v) AS lo, CASE WHEN max(v) <= min(v) THEN min(v) + 1 ELSE max(v) END AS hi FROM sample), "
_DENSE = _RANGE + (
    "raw AS (SELECT k, exp(-0.5 * (k / 1.5) * (k / 1.5)) AS w FROM range(-4, 5) q(k)), kern AS (SELECT k, w / sum(w) OVER () AS w FROM raw), "
    "h AS (SELECT cls, least(greatest(trunc((v - lo) / (hi - lo + 1e-20) * 63), 0), 63)::INT AS i, count(*) AS n FROM sample, r GROUP BY 1, 2), t AS (SELECT cls, count(*) AS n_all FROM sample GROUP BY cls), "
    "dens AS (SELECT cls, h.i + k AS i, sum(n * w) AS m FROM h, kern WHERE h.i + k BETWEEN 0 AND 63 GROUP BY 1, 2), d AS (SELECT 0 AS c, cls, i, lo + i * (hi - lo) / 63 AS x, m / (n_all * ((hi - lo) / 64)) AS f FROM dens JOIN t USING (cls), r) "
)
_add("density_hist", _DENSE + "SELECT c, cls, i, round(x, 4) AS x, round(f, 8) AS f FROM d", "sample")
_add(
    "density_kde",
    _RANGE + "b AS (SELECT cls, count(*) AS n, greatest(CASE WHEN count(*) < 2 THEN 0.2 ELSE 1.06 * CASE WHEN stddev_pop(v) > 0 THEN least(stddev_pop(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349) ELSE 1.0 END * pow(count(*), -0.2) END, 1e-6) AS h FROM sample GROUP BY cls), "
    "g AS (SELECT i, lo + i * (hi - lo) / 31 AS x FROM r, range(0, 32) q(i)) "
    "SELECT 0 AS c, s.cls, g.i, round(g.x, 4) AS x, round(avg(exp(-0.5 * ((g.x - s.v) / b.h) * ((g.x - s.v) / b.h))) / any_value(b.h * sqrt(2 * pi())), 8) AS f FROM sample s JOIN b USING (cls), g GROUP BY s.cls, g.i, g.x",
    "sample",
)
_add(
    "stratified_sample",
    "WITH o AS (SELECT *, md5('1337:' || id) AS o, ceil(60.0 / (SELECT count(DISTINCT z) FROM sample s WHERE s.cls = sample.cls)) AS quota FROM sample), k AS (SELECT *, row_number() OVER (PARTITION BY cls, z ORDER BY o, id) AS r FROM o QUALIFY r <= quota) "
    "SELECT c, cls, z, id FROM k QUALIFY row_number() OVER (PARTITION BY c, cls ORDER BY o, id) <= 60",
    "sample",
)
_add(
    "nearest_neighbour",
    "WITH p AS (SELECT a.vec_id AS id, b.vec_id AS n, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT id, arg_max(n, (s, -n)) AS neighbour, round(max(s), 5) AS similarity FROM p GROUP BY id",
)
_add("koleo", "WITH p AS (SELECT a.vec_id AS id, max(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1) SELECT round(-avg(ln(sqrt(greatest(2 - 2 * s, 0)) + 1e-8)), 4) AS koleo FROM p")
_add(
    "kmeans_step",
    "WITH c AS (SELECT row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS k, embedding::DOUBLE[] AS v FROM embeddings ORDER BY k LIMIT 8), d AS (SELECT e.vec_id AS id, k, 1 - list_cosine_similarity(e.embedding::DOUBLE[], c.v) AS d FROM embeddings e, c) "
    "SELECT id, arg_min(k, (d, k))::INT AS k, round(min(d), 5) AS distance FROM d GROUP BY id",
)
_add(
    "sinkhorn3",
    "WITH s AS (SELECT vec_id AS b, k, exp(embedding[k + 1]::DOUBLE / 0.5) AS q FROM embeddings, range(0, 64) r(k)), n AS (SELECT count(DISTINCT b) AS nb FROM s), q0 AS (SELECT b, k, q / sum(q) OVER () AS q FROM s), "
    + ", ".join(f"k{i} AS (SELECT b, k, q / sum(q) OVER (PARTITION BY k) / 64 AS q FROM q{i - 1}), q{i} AS (SELECT b, k, q / sum(q) OVER (PARTITION BY b) / nb AS q FROM k{i}, n)" for i in (1, 2, 3))
    + " SELECT b, k::INT AS k, round(q * nb, 6) AS p FROM q3, n",
)
_add("covariance", "WITH f AS (SELECT vec_id, unnest(embedding)::DOUBLE AS f, unnest(range(0, 64)) AS i FROM embeddings) SELECT a.i::INT AS i, b.i::INT AS j, round(covar_samp(a.f, b.f), 7) AS cov FROM f a JOIN f b USING (vec_id) WHERE a.i <= b.i GROUP BY a.i, b.i")
_add("ema_center", "WITH m AS (SELECT name, value, iteration, max(iteration) OVER (PARTITION BY name) AS n FROM metric) SELECT name, round(sum(value * pow(0.9, n - iteration) * CASE WHEN iteration = 1 THEN 1 ELSE 0.1 END), 5) AS ema FROM m GROUP BY name", "metric")
_add("lr_schedule", "SELECT step, round(CASE WHEN step < 5 THEN 0.0 WHEN step < 15 THEN (step - 5) / 9.0 WHEN step < 100 THEN 0.1 + 0.45 * (1 + cos(pi() * (step - 15) / 85.0)) ELSE 0.1 END, 8) AS lr FROM range(0, 120) r(step)")
_add("sincos_pos_embed", "SELECT pos, k::INT AS k, round(CASE WHEN k < 8 THEN sin(pos / pow(10000, (k % 8) / 8.0)) ELSE cos(pos / pow(10000, (k % 8) / 8.0)) END, 6) AS e FROM range(0, 20) a(pos), range(0, 16) b(k)")
_KEY = "array_to_string(list_transform(regexp_extract_all(name, '(\\d+|\\D+)', 1), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN lpad(p, 20, '0') ELSE lower(p) END), '')"
_add("natural_sort", f"SELECT name, row_number() OVER (ORDER BY {_KEY}, name)::INT AS position FROM file WHERE NOT is_dir AND regexp_matches(lower(name), '\\.tiff?$')", "file")
_META = (
    "WITH n AS (SELECT name, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM file), k AS (SELECT name, stem, string_split(stem, '_') AS t FROM n), meta AS (SELECT name, stem, "
    "regexp_extract(stem, 'stack(\\d+)', 1)::BIGINT AS frame, list_filter(t, lambda x: contains(x, 'Cam'))[-1] AS camera, list_filter(t, lambda x: NOT contains(x, 'Cam') AND contains(lower(x), 'ch'))[-1] AS channel, "
    "regexp_extract(list_filter(t, lambda x: contains(lower(x), 'nm'))[-1], '^(\\d+)', 1)::INT AS wavelength FROM k) "
)
_add("name_metadata", _META + "SELECT * FROM meta", "file")
_add(
    "stem_pairing",
    "WITH f AS (SELECT page_id, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM file WHERE NOT is_dir) SELECT stem, CASE WHEN page_id % 3 = 0 THEN 'missing_left' WHEN page_id % 4 = 0 THEN 'missing_right' ELSE 'ok' END AS status FROM f WHERE page_id % 3 <> 0 OR page_id % 4 <> 0",
    "file",
)
_add("experiment_stats", "SELECT dir, count(*) AS files, count(*) FILTER (regexp_matches(lower(name), '\\.tiff?$')) AS tifs, sum(length)::BIGINT AS bytes, round(sum(length) / 1073741824.0, 6) AS gib FROM file GROUP BY dir", "file")
_add("experiment_filter", "SELECT dir, count(*) FILTER (regexp_matches(lower(name), '\\.tiff?$')) AS tifs FROM file WHERE regexp_matches(dir, '(?i)ex0[0-3]') AND dir NOT LIKE '%Ex02%' GROUP BY dir HAVING tifs >= 5", "file")
_add("list_page", "WITH n AS (SELECT count(*)::INT AS total FROM file) SELECT name, is_dir, mtime_ms, total, greatest(1, ceil(total / 20.0))::INT AS pages FROM file, n ORDER BY is_dir DESC, mtime_ms DESC, lower(name), name LIMIT 20 OFFSET 20", "file")
_add("dedup_first", "SELECT source, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source")
_add(
    "manifest_json",
    "WITH r AS (SELECT * FROM (VALUES ('image', '(?i)\\.tiff?$'), ('note', '\\.txt$'), ('camera_a', '_CamA_')) v(kind, pattern)), h AS (SELECT kind, name, length FROM file, r WHERE regexp_matches(name, pattern)) "
    "SELECT kind, count(*) AS n, sum(length)::BIGINT AS bytes, (1 + sum(strlen('{\"name\":\"' || name || '\",\"length\":' || length || '},')))::INT AS size FROM h GROUP BY kind",
    "file",
)
_add("chunk_key", _META + "SELECT name, concat_ws('_', md5('/data'), frame::VARCHAR, CASE WHEN frame % 2 <> 0 THEN (frame % 5)::VARCHAR END, wavelength::VARCHAR, '0') AS key FROM meta", "file")


def _address_class(address: str) -> str:
    """What the standard library says."""
    try:
        ip = ipaddress.ip_address(address.split("%")[0])
    except ValueError:
        return "Unknown"
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return "Local" if ip.is_loopback else "Local network" if ip.is_private or ip.is_link_local else "Remote"


_add("ip_class", "SELECT r_regionkey, i::INT AS i, [" + ", ".join(f"'{_address_class(x)}'" for x in ADDRESSES) + f"][i + 1] AS class FROM region, range(0, {len(ADDRESSES)}) r(i)")
_add(
    "smoothed_meter",
    "SELECT name, iteration, list_sort(list(value) OVER w)[(count(*) OVER w + 1) // 2] AS median, round((avg(value) OVER w) + 1e-9, 5) AS mean, round((avg(value) OVER a) + 1e-9, 5) AS global_mean, max(value) OVER w AS top, value AS last FROM metric "
    "WINDOW w AS (PARTITION BY name ORDER BY iteration ROWS 19 PRECEDING), a AS (PARTITION BY name ORDER BY iteration)",
    "metric",
)
_add("jobs_newest", "SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY created_at_ms DESC, job_id)::INT AS n, job_id, array_to_string(list_transform(list_filter(regexp_split_to_array(kind, '[-_ ]+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM job", "job")
_add("job_final_status", "SELECT CASE WHEN exit_code IS NULL THEN 'running' WHEN stop_requested THEN 'halted' WHEN exit_code = 0 AND processed >= total THEN 'completed' ELSE 'failed' END AS status, count(*) AS n FROM job GROUP BY 1", "job")
_add("log_tail", "SELECT job_id, seq, line, count(*) OVER (PARTITION BY job_id) AS total, count(*) OVER (PARTITION BY job_id) > 5 AS truncated FROM log QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) <= 5", "log")
_add(
    "cpu_utilization",
    "WITH s AS (SELECT name, iteration, floor(iteration * 3 + value % 7) AS idle FROM metric), d AS (SELECT name, iteration, idle - lag(idle) OVER (PARTITION BY name ORDER BY iteration) AS di FROM s) SELECT name, iteration, round(least(greatest((10 - di) / 10.0 * 100, 0), 100), 4) AS pct FROM d WHERE di IS NOT NULL",
    "metric",
)
_PROGRESS = "WITH i AS (SELECT user_id::VARCHAR AS job_id, event_type || (event_id % 9) AS item FROM events WHERE event_id % 9 <> 8) SELECT job_id, count(DISTINCT item)::INT AS processed, count(DISTINCT item)::INT AS total FROM i GROUP BY job_id"
_add("job_progress", _PROGRESS)
_add("stream_progress", _PROGRESS)
_add(
    "contrast_clip",
    "WITH h AS (SELECT tp, least(floor(v * (256 / 131072.0)), 255)::INT AS bin, count(*) AS n FROM voxel WHERE v BETWEEN 0 AND 131072 GROUP BY 1, 2), t AS (SELECT tp, floor(count(*) / 300.0) AS most FROM voxel GROUP BY tp), "
    "b AS (SELECT tp, min(bin) * 512.0 AS lo, max(bin) * 512.0 AS hi FROM h JOIN t USING (tp) WHERE n > most GROUP BY tp) "
    "SELECT tp, z, y, x, round(least(greatest((v - lo) / (hi - lo + pow(2.0, -23)), 0), 1) + 1e-9, 5) AS clipped FROM voxel JOIN b USING (tp)",
    "voxel",
)
_add("softmax", "SELECT t, label, round(exp(cx / 2.0 - max(cx / 2.0) OVER w) / sum(exp(cx / 2.0 - m)) OVER w, 8) AS p FROM (SELECT *, max(cx / 2.0) OVER (PARTITION BY t) AS m FROM det) WINDOW w AS (PARTITION BY t)", "det")
_add("low_outliers", "SELECT tp, z, y, x, v FROM voxel QUALIFY v < avg(v) OVER (PARTITION BY tp) - 1.5 * stddev_samp(v) OVER (PARTITION BY tp)", "voxel")
_add("flip_rotate", "SELECT tp, 8 - z AS z, 10 - x AS y, y AS x, v FROM voxel", "voxel")
_add(
    "grey_opening",
    "WITH d AS (SELECT unnest(range(-2, 3)) AS d), b AS (SELECT a.d AS a, b.d AS b, c.d AS c FROM d a, d b, d c WHERE a.d * a.d + b.d * b.d + c.d * c.d <= 4), "
    "e AS (SELECT tp, z, y, x, min(w) AS v FROM (SELECT tp, z + a AS z, y + b AS y, x + c AS x, v AS w FROM voxel, b) SEMI JOIN voxel USING (tp, z, y, x) GROUP BY tp, z, y, x) "
    "SELECT tp, z, y, x, max(w) AS v FROM (SELECT tp, z + a AS z, y + b AS y, x + c AS x, v AS w FROM e, b) SEMI JOIN voxel USING (tp, z, y, x) GROUP BY tp, z, y, x",
    "voxel",
)
_add("patchify", "SELECT tp, z // 3 AS pz, y // 3 AS py, x // 3 AS px, count(*)::INT AS n, arg_min(v, (z, y, x)) AS first, arg_max(v, (z, y, x)) AS last FROM voxel GROUP BY ALL", "voxel")
_add("foreground_mask", "WITH m AS (SELECT tp, label <> min(label) OVER (PARTITION BY tp) AS is_fg FROM mask) SELECT tp, is_fg, count(*) AS n FROM m GROUP BY tp, is_fg", "mask")
_add("common_shape", "WITH s AS (SELECT tp, max(z) + 1 AS z, max(y) + 1 AS y, max(x) + 1 AS x FROM voxel GROUP BY tp) SELECT min(z) // 4 * 4 AS z, min(y) // 4 * 4 AS y, min(x) // 4 * 4 AS x FROM s", "voxel")
_add("shuffled_batches", "WITH n AS (SELECT vec_id, row_number() OVER (ORDER BY md5('0:' || vec_id), vec_id)::INT AS position FROM embeddings) SELECT *, ((position - 1) // 32)::INT AS batch FROM n")
_add("views_of_samples", "SELECT vec_id, (vec_id // 10)::INT AS sample, (vec_id % 10)::INT AS view FROM embeddings")
_add("file_slice", f"WITH n AS (SELECT name, row_number() OVER (ORDER BY {_KEY}, name)::INT - 1 AS n FROM file) SELECT * FROM n WHERE n >= 10 AND n < 40", "file")
_add("choose_datasets", "SELECT n_name AS name, CASE WHEN n_regionkey = 1 THEN 'skip' ELSE 'create' END AS action FROM nation")
_add("merged_settings", "SELECT name AS key, arg_max(value, iteration) AS value FROM metric GROUP BY name", "metric")
_add("models_of_listing", "SELECT DISTINCT string_split(dir, '/')[3] AS model FROM file", "file")
_add(
    "iteration_times",
    "WITH m AS (SELECT name, iteration, iteration * 250 + iteration % 3 * 10 AS ms, max(iteration) OVER (PARTITION BY name) AS n FROM metric), d AS (SELECT name, iteration, n, (ms - lag(ms) OVER (PARTITION BY name ORDER BY iteration)) / 1000.0 AS seconds FROM m) SELECT name, iteration, seconds FROM d WHERE iteration % 50 = 0 OR iteration = n",
    "metric",
)
_add("total_loss", "SELECT iteration AS step, round(sum(value * CASE name WHEN 'click' THEN 0.5 WHEN 'view' THEN 2.0 ELSE 0 END) + 1e-9, 4) AS loss FROM metric GROUP BY iteration", "metric")

from . import helpers, outputs, resampled, segments, stores  # noqa: E402, F401  adds its SQL
from .more import SQL  # noqa: E402

ORACLES |= SQL
