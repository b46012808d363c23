"""DuckDB SQL for the queries that SQL can express."""

OP5 = r"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP9 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST({_WORDS} AS BIGINT) AS size, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS key
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w
  FROM d GROUP BY source),
lev AS (
  SELECT *, 2 * source_size AS cap,
         (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(sum(2 * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per WINDOW r AS (ORDER BY CAST(2 * source_size AS DOUBLE) / w, source NULLS LAST)),
tgt AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), w * max(level) OVER ()) AS target FROM lev),
q AS (
  SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum,
         row_number() OVER () AS rid
  FROM d JOIN tgt t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT rid, size, source, key, doc_id, lap, CAST(cum + (lap - 1) * source_size AS DOUBLE) / target AS f
  FROM q, (VALUES (1), (2)) v(lap) WHERE size > 0 AND target > 0),
run AS (
  SELECT rid, size, sum(size) OVER (ORDER BY f, source IS NULL, source, key, doc_id, lap ROWS UNBOUNDED PRECEDING) AS c FROM e),
took AS (SELECT rid, CAST(sum(size) AS BIGINT) AS taken FROM run WHERE c <= (SELECT sum(target) FROM tgt) GROUP BY rid)
SELECT doc_id, source, size, source_size, target, coalesce(taken, 0) AS taken
FROM q LEFT JOIN took USING (rid)
"""

_FITS = lambda h, p: f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '/{p}')"

OP8 = rf"""
WITH RECURSIVE u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r AS (
  SELECT *, CASE WHEN {_FITS("example.com", "en/7")} THEN 'example.com/en/7' WHEN {_FITS("example.net", "de/8")} THEN 'example.net/de/8'
                 WHEN {_FITS("com", "en/")} THEN 'com/en/' WHEN {_FITS("net", "de/")} THEN 'net/de/' WHEN {_FITS("org", "es/")} THEN 'org/es/' END AS rule
  FROM u),
j AS (
  SELECT *, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled,
         regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', '#', 'g') AS shape
  FROM r),
sh AS (SELECT host, shape, string_split(shape, '/') AS seg, count(*) FILTER (ruled = 'block') AS b, count(ruled) AS n FROM j GROUP BY ALL),
tree AS (
  SELECT host, shape, seg, b, n, CAST(1 AS BIGINT) AS i, '' AS t, CASE WHEN hn >= 8 THEN hb ELSE 0 END AS eb, CASE WHEN hn >= 8 THEN hn ELSE 0 END AS en
  FROM (SELECT *, CAST(sum(b) OVER (PARTITION BY host) AS BIGINT) AS hb, CAST(sum(n) OVER (PARTITION BY host) AS BIGINT) AS hn FROM sh)
  UNION ALL
  SELECT host, shape, seg, b, n, i + 1, t2, CASE WHEN mn >= 8 THEN mb ELSE eb END, CASE WHEN mn >= 8 THEN mn ELSE en END
  FROM (
    SELECT *, CAST(sum(b) OVER (PARTITION BY host, t2) AS BIGINT) AS mb, CAST(sum(n) OVER (PARTITION BY host, t2) AS BIGINT) AS mn FROM (
      SELECT *, t || '/' || CASE WHEN s <> '' AND CASE WHEN cn > 0 THEN labelled >= 2 AND (cb * tn - cn * tb) * (cb * tn - cn * tb) <= 3.841459::DOUBLE * cn * tb * (tn - tb) ELSE fan > 32 OR labelled >= 2 END THEN '*' ELSE s END AS t2 FROM (
        SELECT *, count(DISTINCT s) OVER (PARTITION BY host, t) AS fan, count(DISTINCT CASE WHEN cn > 0 THEN s END) OVER (PARTITION BY host, t) AS labelled FROM (
          SELECT *, CAST(sum(b) OVER (PARTITION BY host, t, s) AS DOUBLE) AS cb, CAST(sum(n) OVER (PARTITION BY host, t, s) AS DOUBLE) AS cn,
                 CAST(sum(b) OVER (PARTITION BY host, t) AS DOUBLE) AS tb, CAST(sum(n) OVER (PARTITION BY host, t) AS DOUBLE) AS tn
          FROM (SELECT *, seg[i] AS s FROM tree WHERE i <= len(seg))))))),
leaves AS (SELECT host, shape, t AS template, CASE WHEN (eb + 1) * 100 >= (en + 2) * 90 THEN 'block' ELSE 'allow' END AS learnt FROM tree WHERE i = len(seg) + 1)
SELECT page_id, host, path, rule, coalesce(ruled, learnt) AS verdict, template FROM j JOIN leaves USING (host, shape)
"""

OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM c)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"


def _terms(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_TERM})"


OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_terms("text")} AS t FROM documents),
s AS (SELECT CAST(count(*) FILTER (len(t) > 0) AS BIGINT) AS nd, CAST(sum(len(t)) AS BIGINT) AS nt FROM d),
q AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT item_id, unnest({_terms("text")}) AS term FROM benchmark) GROUP BY ALL),
p AS (
  SELECT rid, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, nd),
i AS (SELECT rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt))) AS impact FROM p JOIN w USING (term), s),
r AS (
  SELECT item_id, rid, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING sum(times * impact) > 0),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, rid) AS INTEGER) AS rank FROM r)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""


def _lloyd_round(i: int) -> str:
    """SQL of one round: vectors to their nearest centroids, and the centroids that follow."""
    square = "CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    return f"""
a{i} AS MATERIALIZED (
  SELECT vec_id, rid, e, cluster, distance FROM (
    SELECT v.vec_id, v.rid, v.e, c.cluster, {square} AS distance, row_number() OVER (PARTITION BY v.rid ORDER BY {square}, c.cluster) AS nearest FROM v, c{i} c)
  WHERE nearest = 1)""" + (f""",
m{i} AS (
  SELECT cluster, dim, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(range(64)) AS dim, unnest(e) AS x FROM a{i}) GROUP BY ALL),
n{i} AS (SELECT cluster, list((s - ((s % n + n) % n)) // n ORDER BY dim) AS e FROM m{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.e, c.e) AS e FROM c{i} c LEFT JOIN n{i} n USING (cluster))""" if i < 3 else "")


OP12 = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT cluster, e FROM (SELECT e, CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS cluster FROM v) WHERE cluster < 16),{",".join(_lloyd_round(i) for i in range(4))}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a3 JOIN c3 c USING (cluster)
"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50),
g AS MATERIALIZED (SELECT rid, doc_id, p, sha256(array_to_string(w[p : p + 49], ' ')) AS g FROM s),
r AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT rid, p FROM g JOIN r USING (g) WHERE doc_id > least),
gone AS (SELECT rid, list_distinct(flatten(list(range(p, p + 50)))) AS gone FROM c GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF gone IS NULL OR NOT list_contains(gone, i)], ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (rid)
"""
