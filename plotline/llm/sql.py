"""DuckDB SQL for the operators that SQL can state, by plainer ways than the operators'."""

from __future__ import annotations

from plotline.llm.secrets import RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# every window of 13 words (or the whole of a shorter item) is sought in all documents
DECONTAMINATE_SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p + 1 : p + least(13, len(w))], ' ') AS win
  FROM i, unnest(range(greatest(1, len(w) - 12))) AS t(p) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p + 1 : p + n], ' ') AS win
  FROM d, lens, unnest(range(len(w) - n + 1)) AS t(p) WHERE len(w) >= n),
hit AS (SELECT doc_id, item_id, p, dw.n FROM dw JOIN iw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM hit, unnest(range(n)) AS t(k) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""

MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS place,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rk FROM s),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM r),
l AS (
  SELECT *, cap / weight AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT arg_min(level, struct_pack(ratio := ratio, rk := rk)) AS common FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, rk, least(cap, weight * common) AS target FROM l, c),
q AS (
  SELECT d.*, t.source_size, t.target, t.rk, sum(d.size) OVER (PARTITION BY t.rk ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) AS served
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, (lap * source_size + served) / target AS finish FROM q, unnest([0, 1]) AS u(lap) WHERE size > 0),
m AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, rk, place, doc_id ROWS UNBOUNDED PRECEDING) AS merged FROM p),
k AS (SELECT doc_id, sum(size) AS taken FROM m WHERE merged <= 1.5 * (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, CAST(q.source_size AS BIGINT) AS source_size, q.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN k USING (doc_id)
"""

URLS_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, regexp_extract(url, '^(.*?)://', 1, 's') AS scheme,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT page_id, html, scheme, host, path, rh || rp AS rule, v
  FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) = 1),
raw AS (
  SELECT host AS src, CASE WHEN starts_with(l, '//') THEN scheme || ':' || l ELSE l END AS url
  FROM (SELECT host, scheme, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]*)', 1)) AS l FROM m WHERE host <> '')),
l0 AS (
  SELECT src, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path, row_number() OVER () AS i
  FROM raw),
l1 AS (
  SELECT src, dst, v FROM l0 LEFT JOIN rules ON (dst = rh OR ends_with(dst, '.' || rh)) AND starts_with(path, rp)
  WHERE dst <> '' AND src <> dst QUALIFY row_number() OVER (PARTITION BY i ORDER BY length(rh || rp) DESC) = 1),
judged AS (
  SELECT host, avg(CASE WHEN v = 'allow' THEN 1.0 ELSE 0 END) > 0.5 AS good, avg(CASE WHEN v = 'block' THEN 1.0 ELSE 0 END) > 0.5 AS bad
  FROM m WHERE host <> '' GROUP BY host),
h AS (
  SELECT * FROM judged UNION ALL
  SELECT dst, avg(CASE WHEN v = 'allow' THEN 1.0 ELSE 0 END) > 0.5, avg(CASE WHEN v = 'block' THEN 1.0 ELSE 0 END) > 0.5
  FROM l1 WHERE dst NOT IN (SELECT host FROM judged) GROUP BY dst),
seeds AS (
  SELECT 'trust' AS kind, host, CASE WHEN good THEN 1.0::DOUBLE / nullif(count(*) FILTER (good) OVER (), 0) ELSE 0 END AS seed FROM h UNION ALL
  SELECT 'distrust', host, CASE WHEN bad THEN 1.0::DOUBLE / nullif(count(*) FILTER (bad) OVER (), 0) ELSE 0 END FROM h),
ways0 AS (SELECT 'trust' AS kind, src AS a, dst AS b, count(*) AS n FROM l1 GROUP BY ALL UNION ALL SELECT 'distrust', dst, src, count(*) FROM l1 GROUP BY ALL),
ways AS (SELECT kind, a, b, CAST(n / sum(n) OVER (PARTITION BY kind, a) AS DOUBLE) AS share FROM ways0),
st AS (
  SELECT kind, host, seed, seed AS score, 0 AS r FROM seeds UNION ALL
  SELECT kind, host, seed, 0.85::DOUBLE * flow + seed * (1 - 0.85::DOUBLE * sum(flow) OVER (PARTITION BY kind)), r + 1
  FROM (
    SELECT t.kind, t.host, t.seed, t.r, coalesce(f.flow, 0) AS flow
    FROM st t LEFT JOIN (SELECT ways.kind, b, sum(score * share) AS flow FROM st JOIN ways ON st.kind = ways.kind AND st.host = a GROUP BY ways.kind, b) f ON t.kind = f.kind AND t.host = f.b)
  WHERE r < 100),
s AS (
  SELECT host, round((sum(CASE kind WHEN 'distrust' THEN score ELSE -score END)) * (SELECT count(*) FROM h), 9) > 0.2 AS blocked
  FROM st WHERE r = 100 GROUP BY host)
SELECT page_id, m.host, path, rule, coalesce(v, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM m LEFT JOIN s ON m.host = s.host
"""


def _secrets_sql() -> str:
    kinds = []
    for i, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''").replace("(?i)(password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))")
        kinds.append(
            f"SELECT b.text, {i} AS ord, '{rule.kind}' AS kind, {rule.least} AS least, "
            f"regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS hits, "
            f"regexp_extract_all(text, '{pattern}', {rule.group}) AS vals FROM b"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT DISTINCT text FROM d),
k AS ({" UNION ALL ".join(kinds)}),
s AS (
  SELECT text, ord, kind, least, vals[j] AS val, length(hits[j]) AS n,
    coalesce(list_sum(list_transform(gaps[1:j], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:j-1], lambda g: length(g))), 0) AS st
  FROM k, unnest(range(1, len(hits) + 1)) AS t(j)),
f AS (SELECT text, ord, kind, CAST(st AS BIGINT) AS st, CAST(st + n AS BIGINT) AS til FROM s WHERE length(val) >= least),
g AS (
  SELECT text, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || st || ':' || til, ',' ORDER BY st, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || st || ':' || til, ',' ORDER BY st, ord) AS spans
  FROM f GROUP BY text)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (text)
"""


SECRETS_SQL = _secrets_sql()

#: The checksum's table follows from its polynomial; near words share what one place leaves.
SPELLING_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([k] || range(8), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t
  FROM range(256) AS r(k)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents),
counted AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM runs WHERE length(run) >= 6 GROUP BY 1, 2),
coded AS (
  SELECT run, n, hex(encode(id || ':' || run)) AS hx FROM counted),
summed AS (
  SELECT run, n, xor(4294967295, list_reduce([4294967295] || list_transform(range(length(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM coded, crc),
thinned AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM thinned WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (
  SELECT word, n, unnest(range(length(word))) AS i FROM words),
gaps AS (
  SELECT DISTINCT word, n, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM places),
shorter AS (
  SELECT DISTINCT word, n, head || tail AS less FROM gaps),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION ALL SELECT s.word, s.n, w.word, w.n FROM shorter s JOIN words w ON s.less = w.word
  UNION ALL SELECT w.word, w.n, s.word, s.n FROM shorter s JOIN words w ON s.less = w.word),
placed AS (
  SELECT word, n, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS place FROM pairs),
formed AS (
  SELECT w.word, w.n, coalesce(p.n_near, 0) AS n_near, CASE WHEN p.m >= 5 * w.n THEN p.other END AS form, CASE WHEN p.m >= 5 * w.n THEN p.m END AS form_n
  FROM words w LEFT JOIN placed p ON w.word = p.word AND p.place = 1),
chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON f.word = c.word JOIN formed e ON c.at = e.word AND e.form IS NULL
"""
