"""DuckDB SQL for the operators that SQL can express."""

_SOURCE_MIXING = """
WITH sizes AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE * sum(n) OVER () * w / sum(w) OVER () / n AS mean FROM sizes),
draws AS (
  SELECT d.*, r.mean, ('0x' || substr(md5('mix:' || d.doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
),
steps AS (
  SELECT mean, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS term FROM (SELECT DISTINCT mean FROM rates) CROSS JOIN range(0, 60) t(k)
),
cdf AS (SELECT mean, sum(term) OVER (PARTITION BY mean ORDER BY k) AS c FROM steps),
copies AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM cdf WHERE cdf.mean = d.mean AND cdf.c <= d.u) AS n FROM draws d)
SELECT doc_id, text, lang, source, n_chars, copy, ('0x' || substr(md5('mix-order:' || doc_id || ':' || copy), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS mix_key
FROM (SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n)) AS copy FROM copies)
"""

_EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""

_DECONTAMINATION = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM bw WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM windows),
found AS (
  SELECT p.doc_id, p.k, p.size, x.item_id
  FROM (
    SELECT doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') AS win
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM dw CROSS JOIN sizes WHERE len(w) >= size)
  ) p JOIN windows x ON x.win = p.win AND x.size = p.size
),
hit AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM (SELECT doc_id, k, unnest(range(0, size)) AS j FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# DuckDB has SHA-1 in hexadecimal only; base32 is put together from the bits.
_WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
h AS (SELECT *, sha1(html) AS hex FROM p),
b AS (
  SELECT *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, ((i * 5) // 4)::INTEGER + 1, 1))::INTEGER * 16 + ('0x' || coalesce(nullif(substr(hex, ((i * 5) // 4)::INTEGER + 2, 1), ''), '0'))::INTEGER) >> (3 - (i * 5) % 4)::INTEGER) & 31)::INTEGER + 1, 1)) AS letters
  FROM h
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string(letters, '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""

_SUBSTRING_DEDUP = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, k, hash(w[k : k + 12]) AS h, md5(array_to_string(w[k : k + 12], ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM w WHERE len(w) >= 13)),
firsts AS (SELECT h, win, min(doc_id) AS least FROM wins GROUP BY h, win HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, k + j AS place
  FROM (SELECT x.doc_id, x.k, unnest(range(0, 13)) AS j FROM wins x JOIN firsts f ON x.h = f.h AND x.win = f.win AND f.least < x.doc_id)
),
places AS (SELECT doc_id, list(place) AS places, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM w) ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN places USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_FILTER_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 200)::INTEGER AS a, (100 * len(list_distinct(w)) < 50 * len(w))::INTEGER AS b,
    (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INTEGER AS c, regexp_matches(text, '[#$%&*|]')::INTEGER AS d, coalesce(least < doc_id, false)::INTEGER AS e
  FROM d LEFT JOIN l USING (doc_id)
),
cells AS (SELECT part, [a, b, c, d, e] AS fails, a + b + c + d + e AS size, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(range(1, 6)) AS k),
orders AS (
  SELECT [p.k, q.k, r.k, s.k, t.k] AS o FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5
),
steps AS (SELECT o, step FROM orders CROSS JOIN (SELECT unnest(range(1, 6)) AS step)),
seen AS (SELECT s.o, s.step, c.*, fails[o[step]] AS here, len(list_filter(o[1 : step - 1], lambda k: fails[k] = 1)) AS before FROM steps s CROSS JOIN cells c)
SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k::INTEGER, 1)), '') AS filter_order, step::INTEGER AS step,
  sum(CASE WHEN before = 0 AND here = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN before = 0 AND here = 1 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN before > 0 AND here = 1 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN size = 1 AND here = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN before = 0 AND here = 1 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN before = 0 AND here = 1 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN here = 1 THEN n * (120 // size) ELSE 0 END)::BIGINT AS shapley
FROM seen GROUP BY part, o, step
"""

# DuckDB has no CRC-32; the table of its 256 steps is made from the polynomial, and a text's bytes run through it.
_LEADERBOARD = r"""
WITH t AS (
  SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n) ORDER BY n) AS steps FROM (SELECT unnest(range(0, 256))::BIGINT AS n)
),
hashed AS (
  SELECT l.*, xor(list_reduce(list_transform(string_split(concat_ws(',', coalesce(sale_id::VARCHAR, ''), coalesce(item_id::VARCHAR, ''), coalesce(vendor_id::VARCHAR, ''), coalesce(line_no::VARCHAR, '')), ''), lambda c: ascii(c)::BIGINT),
    lambda c, b: xor(c // 256, steps[xor(c % 256, b) + 1]), 4294967295), 4294967295) AS h
  FROM sale_lines l CROSS JOIN t
),
shipped AS (SELECT *, coalesce(shipped_at::DATE - DATE '1970-01-01', 19723 + h % 150)::BIGINT AS s FROM hashed),
arrived AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM shipped),
cut AS (SELECT *, greatest(1, least(10, 1 + floor((a - 19723) * 10 / 180)))::INTEGER AS batch FROM arrived),
latest AS (SELECT batch, max(max(s)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cut GROUP BY batch),
counted AS (
  SELECT v.nation_id, c.item_id, c.a, c.batch,
    CASE WHEN flag = 'swapped' THEN -1.0 ELSE 1.0 END::DOUBLE * coalesce(floor(100::DOUBLE * amount + 0.5::DOUBLE), quantity * floor(100::DOUBLE * price + 0.5::DOUBLE), 0) AS cents
  FROM cut c JOIN latest USING (batch) JOIN vendors v ON v.vendor_id = c.vendor_id JOIN items i ON i.item_id = c.item_id
  WHERE v.nation_id IS NOT NULL AND NOT coalesce(s + 3 < before, false)
),
steps AS (SELECT nation_id, item_id, a, sum(sum(cents)) OVER (PARTITION BY nation_id, item_id ORDER BY a) AS cents, lead(a, 1, 1000000) OVER (PARTITION BY nation_id, item_id ORDER BY a) AS until FROM counted GROUP BY 1, 2, 3),
days AS (SELECT nation_id, a, min(batch) AS batch, row_number() OVER (PARTITION BY nation_id ORDER BY a) AS k FROM counted GROUP BY 1, 2),
held AS (SELECT d.nation_id, d.k, s.item_id, s.cents FROM days d JOIN steps s ON s.nation_id = d.nation_id AND s.a <= d.a AND d.a < s.until),
ranks AS (SELECT nation_id, k, item_id, row_number() OVER (PARTITION BY nation_id, k ORDER BY cents DESC, item_id)::INTEGER AS rank FROM held WHERE cents > 0 QUALIFY rank <= 10),
pairs AS (
  SELECT coalesce(n.nation_id, o.nation_id) AS nation_id, coalesce(n.k, o.k + 1) AS k, coalesce(n.item_id, o.item_id) AS item_id, o.rank AS old_rank, n.rank AS new_rank
  FROM ranks n FULL JOIN ranks o ON n.nation_id = o.nation_id AND n.item_id = o.item_id AND n.k = o.k + 1
)
SELECT p.nation_id, d.a AS arrival_day, p.item_id, d.batch, CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change, old_rank, new_rank, h.cents::BIGINT AS revenue
FROM pairs p JOIN days d ON d.nation_id = p.nation_id AND d.k = p.k JOIN held h ON h.nation_id = p.nation_id AND h.k = p.k AND h.item_id = p.item_id
WHERE old_rank IS DISTINCT FROM new_rank
"""

ORACLES: dict[str, str] = {
    "op3_source_mixing": _SOURCE_MIXING,
    "op5_exact_dedup": _EXACT_DEDUP,
    "op6_decontamination": _DECONTAMINATION,
    "op8_warc": _WARC,
    "op10_substring_dedup": _SUBSTRING_DEDUP,
    "op12_filter_audit": _FILTER_AUDIT,
    "op13_leaderboard_feed": _LEADERBOARD,
}
