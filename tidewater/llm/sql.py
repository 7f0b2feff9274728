"""The registered queries in SQL, for those that SQL can express."""

from __future__ import annotations

from tidewater.llm.sharding import P, round_keys


def _mixed(x: str, k: int) -> str:
    t = f"((({x}) % {P} * 48271 + {k}) % {P})"
    s = f"(({t} * {t} + 12345) % {P})"
    return f"(({s} * 69621 + {t}) % {P})"


def _feistel(source: str, seed: int = 0) -> str:
    """A query with columns doc_id, size, text_crc32, x (the image of the source's x), n, a, b."""
    q = f"SELECT doc_id, size, text_crc32, n, a, b, x // b AS l, x % b AS r FROM {source}"
    for k1, k2 in round_keys(seed):
        q = f"SELECT doc_id, size, text_crc32, n, a, b, (l + {_mixed('r', k1)}) % a AS l, r FROM ({q})"
        q = f"SELECT doc_id, size, text_crc32, n, a, b, l, (r + {_mixed('l', k2)}) % b AS r FROM ({q})"
    return f"SELECT doc_id, size, text_crc32, l * b + r AS x, n, a, b FROM ({q})"


OP8 = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    xor(4294967295, list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, v: xor(t[CAST(xor(c, v) & 255 AS INTEGER) + 1], c >> 8))) AS text_crc32
  FROM documents, crc_table),
total AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a, CAST(ceil(count(*) / ceil(sqrt(count(*)))) AS BIGINT) AS b FROM documents),
first AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS x, n, a, b FROM sized, total),
walk AS ({_feistel('first')} UNION ALL {_feistel('(SELECT * FROM walk WHERE x >= n)')})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % 40 AS INTEGER) AS shard, x // 40 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM walk WHERE x < n"""

OP9 = r"""
WITH rows AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('0:' || CAST(doc_id AS VARCHAR)) AS k FROM documents),
sources AS (
  SELECT source, source_size, rk, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS cap
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM rows GROUP BY source)),
levels AS (
  SELECT *, cap / w AS fill, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
    / CAST(sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM sources),
targets AS (SELECT source, source_size, rk, least(CAST(cap AS DOUBLE), (SELECT arg_min(level, (fill, rk)) FROM levels WHERE level <= fill) * w) AS target FROM levels),
queue AS (
  SELECT doc_id, size, source_size, rk, target, k, CAST(sum(size) OVER (PARTITION BY rk ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
entries AS (SELECT q.*, (p * source_size + upto) / target AS f FROM queue q, range(3) r(p) WHERE size > 0),
mixed AS (SELECT *, sum(size) OVER (ORDER BY f, rk, k ROWS UNBOUNDED PRECEDING) AS total FROM entries),
times AS (SELECT rk, k, count(*) AS times FROM mixed WHERE total <= (SELECT sum(size) FROM rows) GROUP BY rk, k)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(times, 0) AS BIGINT) AS taken FROM queue LEFT JOIN times USING (rk, k)"""

OP3 = r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
ruled AS (
  SELECT p.*, (SELECT arg_max((rule, verdict), length(rule)) FROM rules WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/')))) AS r
  FROM parts p),
outcomes AS (SELECT host, CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 0 END AS good FROM parts LEFT JOIN labels ON page_id = doc_id),
hosts AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS g, regexp_extract(regexp_replace(host, ':[0-9]*$', ''), '([^.]*\.)?[^.]*$') AS domain FROM outcomes GROUP BY host),
domains AS (SELECT domain, regexp_extract(domain, '[^.]*$') AS suffix, sum(n) AS n, sum(g) AS g FROM hosts GROUP BY domain),
suffixes AS (SELECT suffix, sum(n) AS n, sum(g) AS g FROM domains GROUP BY suffix),
every AS (SELECT sum(n) AS n, sum(g) AS g, (sum(g) + 1) / (sum(n) + 2) AS prior FROM suffixes),
s0 AS (SELECT c.*, p.n AS pn, p.g AS pg, p.prior AS up FROM suffixes c, every p),
s1 AS (SELECT suffix, n, g, (g + w * up) / (n + w) AS prior FROM s0, (WEIGHT s0)),
d0 AS (SELECT c.*, p.n AS pn, p.g AS pg, p.prior AS up FROM domains c JOIN s1 p USING (suffix)),
d1 AS (SELECT domain, n, g, (g + w * up) / (n + w) AS prior FROM d0, (WEIGHT d0)),
h0 AS (SELECT c.*, p.n AS pn, p.g AS pg, p.prior AS up FROM hosts c JOIN d1 p USING (domain)),
h1 AS (SELECT host, (g + w * up) / (n + w) AS m, n + w AS ab FROM h0, (WEIGHT h0))
SELECT page_id, host, path, r[1] AS rule, coalesce(r[2], CASE WHEN m + 1.645 * sqrt(m * (1 - m) / (ab + 1)) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  round(m, 9) AS good_rate, round(m + 1.645 * sqrt(m * (1 - m) / (ab + 1)), 9) AS good_upper
FROM ruled LEFT JOIN h1 USING (host)"""
_WEIGHT = """SELECT CASE WHEN coalesce(free, 0) = 0 THEN 2.0 WHEN dev <= expected THEN 1e6 ELSE least(1e6, greatest(2.0, noise * free / (dev - expected) - 1)) END AS w
  FROM (SELECT sum(n * (g / n - pg / pn) ** 2) AS dev, sum(pg / pn * (1 - pg / pn) * (1 - n / pn)) AS expected, sum(n - n * n / pn) AS free, sum(pg / pn * (1 - pg / pn) * n) / sum(n) AS noise
    FROM {} WHERE n > 0)"""
for _level in ("s0", "d0", "h0"):
    OP3 = OP3.replace(f"WEIGHT {_level}", _WEIGHT.format(_level))

OP5 = r"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM texts),
elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS i FROM elements x JOIN elements y USING (e) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  WHERE 100 * i >= 80 * (na + nb - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s) AS n_shingles, c AS component_id FROM sets s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON s.doc_id = a"""

#: Line feeds cut texts; the white space of a key's ends is space, tab, line feed, vertical tab, form feed, carriage return.
OP13 = """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT r, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM texts),
keyed AS (SELECT r, doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
ids AS (SELECT DISTINCT key, doc_id FROM keyed WHERE length(key) >= 40),
shared AS (SELECT key AS shared_key, max(doc_id) AS last FROM ids GROUP BY key HAVING count(*) >= 5),
marked AS (SELECT r, doc_id, line, i, last IS NOT NULL AND (doc_id IS NULL OR doc_id <> last) AS gone FROM keyed LEFT JOIN shared ON key = shared_key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id"""

ORACLES = {"op5_signature_tree_join": OP5, "op3_host_reputation": OP3, "op8_feistel_sharding": OP8, "op9_fair_queue_mixing": OP9, "op13_bloom_line_dedup": OP13}
