"""Queries of the heading hierarchy, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrid.functions import text as T
from leafgrid.operators import hierarchy as H
from leafgrid.plans.registry import Registry
from leafgrid.sources import views as V

REGISTRY = Registry()
_HD = V.with_views("hd")
_RANK = "CASE level WHEN 'H1' THEN 1 WHEN 'H2' THEN 2 WHEN 'H3' THEN 3 WHEN 'H4' THEN 4 ELSE 0 END"
_CN = "一二三四五六七八九十"
_SQUEEZED = r"regexp_replace(text, '\s+', '', 'g')"
_INFER = rf"""CASE WHEN regexp_matches(t, '^第[{_CN}百\d]+[章节]') OR regexp_matches(t, '^[{_CN}]+[、.．]') THEN 'H1'
  WHEN regexp_matches(t, '^\d+[、.．]') THEN CASE WHEN regexp_matches(t, '^\d+[.．]\d+[.．]\d+') THEN 'H4' WHEN regexp_matches(t, '^\d+[.．]\d+') THEN 'H3' ELSE 'H2' END
  WHEN regexp_matches(t, '^(（[{_CN}\d]+）|\([{_CN}\d]+\)|\d+[）)])') THEN 'H3' END"""
_TXT = f",\ntx AS (SELECT *, {_SQUEEZED} AS t, {_RANK} AS rank FROM hd)"
_DEC = r",\ndc AS (SELECT *, list_transform(CASE WHEN regexp_matches(t, '^\d+([.．]\d+)+') THEN regexp_split_to_array(regexp_extract(t, '^(\d+([.．]\d+)+)', 1), '[.．]') END, lambda x: CAST(x AS INTEGER)) AS dec FROM tx)".replace(
    "\\n", "\n", 1
)


def _h(spark, d):
    return V.headings(spark, d)




@REGISTRY.query("f9_infer_level", _HD + _TXT + f"\nSELECT doc, ord, {_INFER} AS inferred FROM tx")
def f9_infer_level(spark, d):
    return _h(spark, d).select("doc", "ord", T.infer_level(F.col("text")).alias("inferred"))


@REGISTRY.query("r1_heading_level", _HD + _TXT + f"\nSELECT doc, ord, CASE WHEN block_type = 'paragraph_title' THEN CASE WHEN level IN ('H1','H2','H3','H4') THEN level ELSE {_INFER} END END AS level FROM tx")
def r1_heading_level(spark, d):
    return _h(spark, d).select("doc", "ord", T.heading_level(F.col("level"), F.col("block_type"), F.col("text")).alias("level"))


@REGISTRY.query("r2_stored_level", _HD + "\nSELECT doc, ord, CASE WHEN block_type = 'paragraph_title' AND level IN ('H1','H2','H3','H4') THEN level END AS level FROM hd")
def r2_stored_level(spark, d):
    return _h(spark, d).select("doc", "ord", T.stored_level(F.col("level"), F.col("block_type")).alias("level"))


@REGISTRY.query("f10_decimal_number", _HD + _TXT + _DEC + "\nSELECT doc, ord, array_to_string(dec, '.') AS number, len(dec) AS parts FROM dc WHERE dec IS NOT NULL")
def f10_decimal_number(spark, d):
    h = _h(spark, d).withColumn("dec", T.decimal_number(F.col("text"))).where("dec is not null")
    return h.select("doc", "ord", F.array_join(F.transform("dec", lambda x: x.cast("string")), ".").alias("number"), F.size("dec").cast("long").alias("parts"))


@REGISTRY.query("f11_chapter_root", _HD + _TXT + rf"""
SELECT doc, ord, regexp_matches(t, '^(第[{_CN}百\d]+[章节]|[{_CN}]+[、.．])') AS root FROM tx""")
def f11_chapter_root(spark, d):
    return _h(spark, d).select("doc", "ord", T.is_chapter_root(F.col("text")).alias("root"))


@REGISTRY.query("f12_chinese_ordinal", """
WITH d AS (SELECT unnest(['零','一','二','三','四','五','六','七','八','九','十']) AS ch, unnest(range(11)) AS v),
n AS (SELECT ch AS s, v FROM d UNION SELECT '十' || ch, 10 + v FROM d WHERE v BETWEEN 1 AND 9 UNION SELECT ch || '十', v * 10 FROM d WHERE v BETWEEN 2 AND 9
      UNION SELECT a.ch || '十' || b.ch, a.v * 10 + b.v FROM d a, d b WHERE a.v BETWEEN 2 AND 9 AND b.v BETWEEN 1 AND 9 UNION SELECT '百', NULL UNION SELECT '一十', NULL)
SELECT s, CAST(v AS INTEGER) AS value FROM n""")
def f12_chinese_ordinal(spark, d):
    digits = list(T.CN_DIGITS)
    texts = {*digits, *("十" + x for x in digits[1:10]), *(x + "十" for x in digits[2:10]), *(a + "十" + b for a in digits[2:10] for b in digits[1:10]), "百", "一十"}
    return spark.createDataFrame([(t,) for t in sorted(texts)], "s string").select("s", T.chinese_ordinal(F.col("s")).alias("value"))


_ORDINAL = """
WITH c AS (SELECT ['零','一','二','三','四','五','六','七','八','九','十'] AS c),
r AS (SELECT l_orderkey, l_linenumber, l_orderkey % 5 AS m, CAST(l_partkey % 8 + 2 AS INTEGER) AS a, CAST(l_suppkey % 9 + 1 AS INTEGER) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE m WHEN 0 THEN c[a + 1] WHEN 1 THEN '十' || c[b + 1] WHEN 2 THEN c[a + 1] || '十' WHEN 3 THEN c[a + 1] || '十' || c[b + 1] ELSE c[b + 1] || '百' END AS s,
       CASE m WHEN 0 THEN a WHEN 1 THEN 10 + b WHEN 2 THEN 10 * a WHEN 3 THEN 10 * a + b END AS value FROM r, c"""


@REGISTRY.query("f12_row_ordinals", _ORDINAL)
def f12_row_ordinals(spark, d):
    """Chinese ordinals of all rows, one and two digits, and some that are none."""
    t, c = V.table(spark, d, "lineitem"), F.array(*map(F.lit, "零一二三四五六七八九十"))
    a, b = F.get(c, (F.col("l_partkey") % 8 + 2).cast("int")), F.get(c, (F.col("l_suppkey") % 9 + 1).cast("int"))
    m = F.col("l_orderkey") % 5
    text = F.when(m == 0, a).when(m == 1, F.concat(F.lit("十"), b)).when(m == 2, F.concat(a, F.lit("十"))).when(m == 3, F.concat(a, F.lit("十"), b)).otherwise(F.concat(b, F.lit("百")))
    return t.select("l_orderkey", "l_linenumber", text.alias("s")).withColumn("value", T.chinese_ordinal(F.col("s")))


_SCHEMA = rf""",
sc AS (
  SELECT *, CASE WHEN dec IS NOT NULL THEN 'decimal_' || len(dec) WHEN regexp_matches(t, '^[（(][{_CN}]+[）)]') THEN 'cn_paren' WHEN regexp_matches(t, '^[（(]\d+[）)]') THEN 'arabic_paren'
                 WHEN regexp_matches(t, '^[{_CN}]+[、.．]') THEN 'cn_comma' WHEN regexp_matches(t, '^\d+[、.．]') THEN 'arabic_dot' WHEN regexp_matches(t, '^第[{_CN}\d]+条') THEN 'legal_article' END AS kind
  FROM dc),
sf AS (
  SELECT *, CASE WHEN dec IS NOT NULL THEN 'decimal.' || array_to_string(dec[:-2], '.') ELSE kind END AS family,
         CAST(CASE WHEN dec IS NOT NULL THEN dec[-1] WHEN kind = 'cn_paren' THEN strpos('{_CN}', regexp_extract(t, '^[（(]([{_CN}]+)', 1)) WHEN kind = 'arabic_dot' THEN CAST(regexp_extract(t, '^(\d+)', 1) AS INTEGER) END AS INTEGER) AS ordinal
  FROM sc)"""


@REGISTRY.query("f13_number_schema", _HD + _TXT + _DEC + _SCHEMA + "\nSELECT doc, ord, kind, family, ordinal FROM sf WHERE kind IS NOT NULL")
def f13_number_schema(spark, d):
    return _h(spark, d).withColumn("s", T.number_schema(F.col("text"))).where("s is not null").select("doc", "ord", "s.kind", "s.family", "s.ordinal")


@REGISTRY.query("f14_level_rank", _HD + f"\nSELECT doc, ord, CAST({_RANK} AS INTEGER) AS rank, CASE WHEN level IS NOT NULL THEN level END AS back FROM hd")
def f14_level_rank(spark, d):
    h = _h(spark, d).withColumn("rank", T.level_rank(F.coalesce("level", F.lit(""))))
    return h.select("doc", "ord", "rank", T.rank_level(F.col("rank")).alias("back"))


_CLAMP = f""",
cl AS (
  SELECT *, CASE WHEN l IS NOT NULL THEN 'H' || CAST(k + least(0, min(l - k) OVER (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING)) AS VARCHAR) END AS repaired
  FROM (SELECT *, count(l) OVER (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN block_type = 'paragraph_title' THEN nullif({_RANK}, 0) END AS l FROM hd)))"""


@REGISTRY.query("w1_clamp_levels", f"""{_HD},
t AS (SELECT doc, list([ord, {_RANK}] ORDER BY ord) AS xs FROM hd WHERE block_type = 'paragraph_title' AND level IS NOT NULL GROUP BY doc),
r AS (SELECT doc, unnest(list_reduce([[[0, 0]]] || list_transform(xs, lambda x: [x]), lambda a, x: a || [[x[1][1], least(x[1][2], a[-1][2] + 1)]])[2:]) AS m FROM t)
SELECT hd.doc, hd.ord, CASE WHEN m IS NOT NULL THEN 'H' || CAST(m[2] AS VARCHAR) END AS repaired FROM hd LEFT JOIN r ON r.doc = hd.doc AND r.m[1] = hd.ord""")
def w1_clamp_levels(spark, d):
    """The oracle runs the sequential rule as a fold; ours is a running minimum."""
    return H.clamp_levels(_h(spark, d)).select("doc", "ord", "repaired")


def _path_sql(frame: str) -> str:
    w = f"OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND {frame})"
    last = lambda cond, v: f"last_value(CASE WHEN {cond} THEN {v} END IGNORE NULLS) {w}"
    clip = r"CASE WHEN len(trim(regexp_replace(text, '\s+', ' ', 'g'))) > 40 THEN left(trim(regexp_replace(text, '\s+', ' ', 'g')), 40) || '…' ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END"
    return ", ".join(f"CASE WHEN {last('r > 0', 'r')} >= {n} AND {last(f'r = {n}', 'ord')} > coalesce({last(f'r > 0 AND r < {n}', 'ord')}, -1) THEN {last(f'r = {n}', clip)} END AS path{n}" for n in range(1, 5))


@REGISTRY.query("w2_active_path", _HD + _CLAMP + f""",
rr AS (SELECT *, coalesce(CAST(substr(repaired, 2) AS INTEGER), 0) AS r FROM cl)
SELECT doc, ord, {_path_sql("CURRENT ROW")} FROM rr""")
def w2_active_path(spark, d):
    return H.active_path(H.clamp_levels(_h(spark, d))).select("doc", "ord", "path1", "path2", "path3", "path4")


@REGISTRY.query("w3_allowed_levels", _HD + f""",
v AS (SELECT doc, page_id, ord, {_RANK} AS l, row_number() OVER (PARTITION BY doc ORDER BY ord) AS k FROM hd WHERE block_type = 'paragraph_title' AND level IS NOT NULL),
rp AS (SELECT *, k + least(0, min(l - k) OVER (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING)) AS r FROM v),
pg AS (SELECT DISTINCT doc, page_id FROM hd)
SELECT doc, page_id, CAST(least(coalesce((SELECT arg_max(r, ord) FROM rp WHERE rp.doc = pg.doc AND rp.page_id < pg.page_id), 0) + 1, 4) AS INTEGER) AS allowed_rank FROM pg""")
def w3_allowed_levels(spark, d):
    return H.page_outlines(_h(spark, d)).select("doc", "page_id", "allowed_rank")


def outline_sql(following: bool) -> str:
    """The outline text of each page (view ol: doc, page_id, outline) from lists of the titles before and after it."""
    clip = r"CASE WHEN len(trim(regexp_replace(text, '\s+', ' ', 'g'))) > 40 THEN left(trim(regexp_replace(text, '\s+', ' ', 'g')), 40) || '…' ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END"
    o = H.OUTLINE
    none = f"'  {o['empty']}'"
    lines = lambda a: f"CASE WHEN len({a}) = 0 THEN {none} ELSE array_to_string({a}, chr(10)) END"
    names = lambda test: f"'  ' || CASE WHEN len(list_filter([1, 2, 3, 4], lambda n: {test})) = 0 THEN '{o['empty']}' ELSE array_to_string(list_transform(list_filter([1, 2, 3, 4], lambda n: {test}), lambda n: 'H' || CAST(n AS VARCHAR)), ', ') END"
    more = f", '', '{o['following_header']}', '{o['following']}', {lines('ahead')}" if following else ""
    return f""",
ot AS (SELECT doc, page_id, ord, level, {clip} AS txt, {_RANK} AS l, row_number() OVER (PARTITION BY doc ORDER BY ord) AS k FROM hd WHERE block_type = 'paragraph_title' AND level IS NOT NULL),
orp AS (SELECT *, CAST(k + least(0, min(l - k) OVER (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING)) AS INTEGER) AS r FROM ot),
opg AS (SELECT DISTINCT doc, page_id FROM hd),
opast AS (SELECT p.doc, p.page_id, coalesce(list({{r: t.r, x: t.txt}} ORDER BY t.ord) FILTER (t.ord IS NOT NULL), []) AS past FROM opg p LEFT JOIN orp t ON t.doc = p.doc AND t.page_id < p.page_id GROUP BY ALL),
onext AS (SELECT p.doc, p.page_id, coalesce(list('  page ' || CAST(t.page_id + 1 AS VARCHAR) || ': ' || t.level || ' ' || t.txt ORDER BY t.ord) FILTER (t.ord IS NOT NULL), [])[1:12] AS ahead FROM opg p LEFT JOIN orp t ON t.doc = p.doc AND t.page_id > p.page_id GROUP BY ALL),
opath AS (
  SELECT *, list_reduce([CAST([NULL, NULL, NULL, NULL] AS VARCHAR[])] || list_transform(past, lambda t: [CAST(t.r AS VARCHAR), t.x]::VARCHAR[]),
    lambda a, t: [CASE WHEN 1 < CAST(t[1] AS INTEGER) THEN a[1] WHEN 1 = CAST(t[1] AS INTEGER) THEN t[2] END, CASE WHEN 2 < CAST(t[1] AS INTEGER) THEN a[2] WHEN 2 = CAST(t[1] AS INTEGER) THEN t[2] END,
                  CASE WHEN 3 < CAST(t[1] AS INTEGER) THEN a[3] WHEN 3 = CAST(t[1] AS INTEGER) THEN t[2] END, CASE WHEN 4 = CAST(t[1] AS INTEGER) THEN t[2] END]::VARCHAR[]) AS path
  FROM opast JOIN onext USING (doc, page_id)),
odep AS (SELECT *, least(coalesce(list_max(list_filter([1, 2, 3, 4], lambda n: path[n] IS NOT NULL)), 0) + 1, 4) AS allow,
  list_transform(list_filter([1, 2, 3, 4], lambda n: path[n] IS NOT NULL), lambda n: repeat('  ', n) || 'H' || CAST(n AS VARCHAR) || ': ' || path[n]) AS pl,
  list_transform(past[-12:], lambda t: '  H' || CAST(t.r AS VARCHAR) || ' ' || t.x) AS rl FROM opath),
ol AS (SELECT doc, page_id, CAST(allow AS INTEGER) AS allowed_rank, array_to_string(['{o['header']}', '{o['path']}', {lines('pl')}, '{o['recent']}', {lines('rl')}, '{o['appeared']}', {names('len(list_filter(past, lambda t: t.r = n)) > 0')},
  '{o['allowed']}', {names('n <= allow')}, '{o['forbidden']}', {names('n > allow')}{more}], chr(10)) AS outline FROM odep)"""


@REGISTRY.query("w3_page_outlines", _HD + outline_sql(True) + "\nSELECT doc, page_id, outline, allowed_rank FROM ol")
def w3_page_outlines(spark, d):
    """Prompt texts with look-ahead; also held against a plain Python version in the tests."""
    return H.page_outlines(_h(spark, d), following=12)


_CHAIN = _HD + r""",
ht AS (SELECT doc, page_id, ord, block_type, level, x1, y1, replace(text, '章', '节') AS text FROM hd),
ft AS (SELECT doc, ord, coalesce(CAST(substr(level, 2) AS INTEGER), 0) AS rank, regexp_replace(text, '\s+', '', 'g') AS t FROM ht WHERE block_type = 'paragraph_title'),
fk AS (SELECT *, regexp_matches(t, '^第[一二三四五六七八九十]+节') AS root, regexp_matches(t, '^\d+、') AS item, regexp_matches(t, '^[（(][一二三四五六七八九十]+[）)]') OR regexp_matches(t, '^\d+\.(\d\d|\d([^.\d]|$))') AS paren FROM ft),
fl AS (SELECT doc, list({s: false, h2: false, h3: false, ord: ord, rank: rank, root: root, item: item, paren: paren, outs: CAST([] AS INTEGER[][])} ORDER BY ord) AS xs FROM fk GROUP BY doc),
fr AS (SELECT doc, unnest(list_reduce([{s: false, h2: false, h3: false, ord: 0, rank: 0, root: false, item: false, paren: false, outs: CAST([] AS INTEGER[][])}] || xs, lambda a, x: {
  s: a.s OR x.root, h2: NOT x.root AND (a.h2 OR (a.s AND x.rank = 1 AND x.item)), h3: NOT x.root AND (a.h3 OR (a.s AND x.rank = 2 AND x.paren AND a.h2)), ord: x.ord, rank: x.rank, root: x.root, item: x.item, paren: x.paren,
  outs: list_append(a.outs, [x.ord, x.rank + CASE WHEN a.s AND NOT x.root AND ((x.rank = 1 AND x.item) OR (x.rank = 2 AND x.paren AND a.h2) OR (x.rank = 3 AND x.item AND a.h3)) THEN 1 ELSE 0 END])}).outs) AS o FROM fl)"""


@REGISTRY.query("w5_financial_chain", _CHAIN + """
SELECT ht.doc, ht.ord, level, CASE WHEN o IS NOT NULL AND o[2] > 0 THEN 'H' || CAST(o[2] AS VARCHAR) ELSE level END AS fixed FROM ht LEFT JOIN fr ON fr.doc = ht.doc AND fr.o[1] = ht.ord""")
def w5_financial_chain(spark, d):
    h = _h(spark, d).withColumn("text", F.replace(F.col("text"), F.lit("章"), F.lit("节")))
    return H.financial_chain(h).select("doc", "ord", "level", "fixed")


def _reconcile_sql() -> str:
    """The document pass as a recursion over each document's titles: the state has the records of numbered titles, the active path and the last left edges."""
    w = H.WEIGHTS

    def score(r: int) -> str:
        above = f"CASE WHEN h{r - 1} AND p{r - 1} IS NOT NULL THEN CASE WHEN x1 >= p{r - 1} - 12 THEN {w['deeper_indent']} ELSE {w['indent_conflict']} END ELSE 0 END" if r > 1 else "0"
        step = f"CASE WHEN k > 0 THEN {w['legal_ascend']} ELSE 0 END" if r == 1 else (
            f"CASE WHEN deep = 0 THEN {w['missing_parent_deep_level'] if r >= 3 else 0} WHEN {r} = deep THEN {w['legal_same_level']} WHEN {r} < deep THEN {w['legal_ascend']} "
            f"WHEN {r} = deep + 1 THEN {w['legal_descend']} WHEN {r} = deep + 2 THEN {w['skip_one_level']} ELSE {w['skip_two_levels']} END")
        return f"""(CASE WHEN own = {r} THEN {w['model_match']} ELSE {w['model_change']} END
          + CASE WHEN chapter THEN {w['chapter_root'] if r == 1 else -w['chapter_root']} ELSE 0 END
          + CASE WHEN num IS NULL THEN 0 ELSE
              CASE WHEN par IS NOT NULL THEN CASE WHEN {r} = par.r + 1 THEN {w['direct_parent_match']} + CASE WHEN par.pg <> page_id THEN {w['cross_page_parent']} ELSE 0 END ELSE {w['direct_parent_conflict']} END
                   ELSE {w['missing_parent_deep_level'] if r >= 3 else 0} END
              + CASE WHEN sib IS NULL THEN 0 WHEN {r} = sib.r THEN {w['sibling_match']} + CASE WHEN sib.pg <> page_id THEN {w['cross_page_sibling']} ELSE 0 END ELSE {w['sibling_conflict']} END
              + CASE WHEN (par IS NOT NULL OR sib IS NOT NULL) AND least(greatest(parts, 2), 4) = {r} THEN {w['decimal_relative_depth']} ELSE 0 END END
          + {step}
          + CASE WHEN x1 IS NULL THEN 0 ELSE CASE WHEN l{r} IS NULL THEN 0 WHEN abs(x1 - l{r}) <= 36 THEN {w['same_level_indent']} ELSE {w['indent_conflict']} END + {above} END)"""

    slots = ", ".join(f"CASE WHEN pick = {r} THEN true WHEN pick > {r} THEN h{r} ELSE false END AS h{r}, CASE WHEN pick = {r} THEN x1 WHEN pick > {r} THEN p{r} END AS p{r}, CASE WHEN pick = {r} AND x1 IS NOT NULL THEN x1 ELSE l{r} END AS l{r}" for r in range(1, 5))
    start = ", ".join(f"false AS h{r}, NULL::INTEGER AS p{r}, NULL::INTEGER AS l{r}" for r in range(1, 5))
    kept = ", ".join(f"h{r}, p{r}, l{r}" for r in range(1, 5))
    return _HD.replace("WITH li", "WITH RECURSIVE li", 1) + _TXT + _DEC + f""",
tt AS (
  SELECT doc, ord, page_id, level, x1, rank AS own, regexp_matches(t, '^(第[{_CN}百\\d]+[章节]|[{_CN}]+[、.．])') AS chapter, array_to_string(dec, '.') AS num, array_to_string(dec[:-2], '.') AS up, len(dec) AS parts,
         row_number() OVER (PARTITION BY doc ORDER BY ord) AS n FROM dc WHERE block_type = 'paragraph_title'),
rc AS (
  SELECT doc, CAST(0 AS BIGINT) AS k, []::STRUCT(num VARCHAR, up VARCHAR, r INTEGER, pg INTEGER)[] AS sel, {start}, NULL::INTEGER AS ord, NULL::VARCHAR AS level, NULL::INTEGER AS pick, NULL::BIGINT AS score, NULL::BIGINT AS margin
  FROM (SELECT DISTINCT doc FROM tt)
  UNION ALL
  SELECT doc, n, CASE WHEN num IS NULL THEN sel ELSE list_append(sel, {{num: num, up: up, r: pick, pg: page_id}}) END, {slots}, ord, level, pick, got[pick], margin
  FROM (
    SELECT *, CAST(CASE WHEN own > 0 AND best <> own AND NOT (own IN (2, 3) AND best = own + 1 AND margin >= 6 AND (par IS NOT NULL OR coalesce(page_id - sib.pg <= 3, false))) THEN own ELSE best END AS INTEGER) AS pick
    FROM (
      SELECT *, o[1][3] AS best, o[2][1] - o[1][1] AS margin FROM (
        SELECT *, list_sort(list_transform(range(1, 5), lambda r: [-got[r], CASE WHEN r = own THEN 0 ELSE 1 END, r])) AS o FROM (
          SELECT *, [{", ".join(f"CAST({score(r)} AS BIGINT)" for r in range(1, 5))}] AS got FROM (
            SELECT rc.doc, rc.k, rc.sel, {", ".join("rc." + x for x in kept.split(", "))}, tt.ord, tt.page_id, tt.level, tt.x1, tt.own, tt.chapter, tt.num, tt.up, tt.parts, tt.n,
                   CASE WHEN rc.h4 THEN 4 WHEN rc.h3 THEN 3 WHEN rc.h2 THEN 2 WHEN rc.h1 THEN 1 ELSE 0 END AS deep,
                   list_filter(rc.sel, lambda z: z.num = tt.up)[-1] AS par, list_filter(rc.sel, lambda z: z.up = tt.up)[-1] AS sib
            FROM rc JOIN tt ON tt.doc = rc.doc AND tt.n = rc.k + 1))))))
SELECT doc, ord, level AS old_level, 'H' || CAST(pick AS VARCHAR) AS new_level, score, margin FROM rc WHERE ord IS NOT NULL"""


@REGISTRY.query("w6_reconcile_document", _reconcile_sql())
def w6_reconcile_document(spark, d):
    return H.reconcile_document(_h(spark, d))


_SCOPE = f""",
ti AS (SELECT *, {_RANK} AS rank FROM hd WHERE block_type = 'paragraph_title' AND level IS NOT NULL),
so AS (
  SELECT *, CASE WHEN o2 > coalesce(scope_h1, -1) THEN o2 END AS scope_h2 FROM (
    SELECT *, last_value(CASE WHEN rank = 1 THEN ord END IGNORE NULLS) OVER w AS scope_h1, last_value(CASE WHEN rank = 2 THEN ord END IGNORE NULLS) OVER w AS o2
    FROM ti WINDOW w AS (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


@REGISTRY.query("w7_scopes", _HD + _SCOPE + "\nSELECT doc, ord, scope_h1, scope_h2 FROM so")
def w7_scopes(spark, d):
    h = _h(spark, d).where((F.col("block_type") == "paragraph_title") & F.col("level").isNotNull())
    return H.scopes(h).select("doc", "ord", "scope_h1", "scope_h2")


_TITLES = _HD + _TXT + _DEC + _SCHEMA + _SCOPE + """,
nt AS (SELECT sf.*, so.scope_h1, so.scope_h2, row_number() OVER (PARTITION BY sf.doc ORDER BY sf.ord) AS n FROM sf JOIN so USING (doc, ord) WHERE kind IS NOT NULL)"""
_NEAR = """,
ne AS (
  SELECT a.doc, a.n, b.n AS o, a.rank, b.rank AS o_rank, a.ordinal, b.ordinal AS o_ordinal, a.x1, b.x1 AS o_x1
  FROM nt a JOIN nt b ON a.doc = b.doc AND a.kind = b.kind AND a.family = b.family AND a.n <> b.n AND abs(a.n - b.n) <= 8 AND abs(a.page_id - b.page_id) <= 5
   AND a.scope_h1 = b.scope_h1 AND (a.rank < 3 OR a.scope_h2 IS NOT DISTINCT FROM b.scope_h2) WHERE a.rank IN (2, 3))"""


@REGISTRY.query("j17_neighbourhood", _TITLES + _NEAR + "\nSELECT doc, n, o, rank, o_rank FROM ne")
def j17_neighbourhood(spark, d):
    return H.neighbourhood(H.numbered_titles(_h(spark, d))).select("doc", F.col("n").cast("long").alias("n"), F.col("o").cast("long").alias("o"), "rank", "o_rank")


_ROOTS = """,
ro AS (SELECT a.doc, a.n, max(b.n) AS parent_n FROM nt a JOIN nt b ON a.doc = b.doc AND b.rank = 1 AND b.n < a.n AND a.page_id - b.page_id <= 1 AND b.dec = a.dec[:-2] WHERE len(a.dec) >= 3 AND a.dec[-1] < 100 GROUP BY ALL)"""


@REGISTRY.query("j16_root_parents", _TITLES + _ROOTS + "\nSELECT doc, n, parent_n FROM ro")
def j16_root_parents(spark, d):
    return H.root_parents(H.numbered_titles(_h(spark, d)))


@REGISTRY.query("j15_preceding_parent", _TITLES + """
SELECT a.doc, a.ord, max(b.ord) AS parent_ord FROM nt a JOIN nt b ON a.doc = b.doc AND b.ord < a.ord AND b.dec = a.dec[:-2] WHERE a.dec IS NOT NULL GROUP BY ALL""")
def j15_preceding_parent(spark, d):
    """The nearest earlier heading whose number is this one's without its last part."""
    t = H.numbered_titles(_h(spark, d)).where("decimal is not null")
    a, b = t.withColumn("up", F.slice("decimal", F.lit(1), F.size("decimal") - 1)).alias("a"), t.alias("b")
    on = (F.col("a.doc") == F.col("b.doc")) & (F.col("a.up") == F.col("b.decimal")) & (F.col("b.ord") < F.col("a.ord"))
    return a.join(b, on).groupBy(F.col("a.doc").alias("doc"), F.col("a.ord").alias("ord")).agg(F.max("b.ord").alias("parent_ord"))


@REGISTRY.query("w8_r4_local_reconciliation", _TITLES + _NEAR + _ROOTS + """,
fa AS (
  SELECT doc, n, count(*) FILTER (o_rank = rank + 1) AS support, count(*) FILTER (o_rank = rank) AS conflicts, bool_or(o_rank = rank + 1 AND o_ordinal = ordinal - 1) AS prev,
         bool_or(o_rank = rank + 1 AND o_ordinal = ordinal + 1) AS nxt, count(*) FILTER (o_rank = rank + 1 AND abs(o_x1 - x1) <= 36) >= 2 AS indent FROM ne GROUP BY doc, n),
pa AS (SELECT DISTINCT a.doc, a.n FROM nt a JOIN nt b ON a.doc = b.doc AND b.dec = a.dec[:-2] AND b.rank = a.rank AND a.scope_h1 = b.scope_h1 AND (a.rank < 3 OR a.scope_h2 IS NOT DISTINCT FROM b.scope_h2) WHERE a.rank IN (2, 3)),
al AS (
  SELECT nt.doc, nt.ord, nt.level, nt.rank, coalesce(support, 0) AS support, coalesce(conflicts, 0) AS conflicts, coalesce(prev, false) AS prev, coalesce(nxt, false) AS nxt, coalesce(indent, false) AS indent,
         ro.n IS NOT NULL AS root, ro.n IS NOT NULL OR pa.n IS NOT NULL AS num
  FROM nt LEFT JOIN fa USING (doc, n) LEFT JOIN ro USING (doc, n) LEFT JOIN pa USING (doc, n) WHERE rank IN (2, 3)),
sc2 AS (
  SELECT *, support * 3 + 12 * root::INT + 5 * prev::INT + 5 * nxt::INT + 4 * (prev AND nxt)::INT + 5 * num::INT + 2 * indent::INT - 4 * (conflicts > support)::INT AS score,
         (support > 0)::INT + root::INT + prev::INT + nxt::INT + num::INT + indent::INT AS evidence FROM al)
SELECT doc, ord, level AS old_level, 'H' || CAST(rank + 1 AS VARCHAR) AS new_level, score FROM sc2
WHERE (support >= 2 OR (rank = 2 AND root)) AND (evidence >= 2 OR root) AND score >= 12""")
def w8_r4_local_reconciliation(spark, d):
    return H.reconcile_locally(_h(spark, d))


_CANDIDATES = _HD + _TXT + _DEC + rf""",
pt AS (SELECT * FROM dc WHERE block_type = 'paragraph_title'),
ca AS (
  SELECT a.doc, a.ord, a.level, a.text, row_number() OVER (PARTITION BY a.doc ORDER BY a.ord) AS k FROM pt a
  WHERE a.rank IN (2, 3) AND (regexp_matches(a.t, '^(?:\d+(?:[.．]\d+)+|[（(][{_CN}\d]+[)）]|\d+[、.)）])') OR (a.rank = 2 AND len(a.dec) >= 3))
    AND EXISTS (SELECT 1 FROM pt b WHERE b.doc = a.doc AND b.ord < a.ord AND b.rank = a.rank AND (b.dec = a.dec[:-2] OR (b.page_id = a.page_id AND a.x1 >= b.x1 + 24))))"""


@REGISTRY.query("w9_o8_review_candidates", _CANDIDATES + "\nSELECT doc, ord, level, text, CAST(k AS INTEGER) AS k FROM ca WHERE k <= 32")
def w9_o8_review_candidates(spark, d):
    return H.review_candidates(_h(spark, d))


@REGISTRY.query("r5_apply_reviews", _CANDIDATES + """
SELECT doc, ord, level AS old_level, CASE WHEN ord % 3 = 0 AND ord % 10 >= 5 THEN 'H' || CAST(CAST(substr(level, 2) AS INTEGER) + 1 AS VARCHAR) ELSE level END AS new_level, ord % 3 = 0 AND ord % 10 >= 5 AS applied FROM ca WHERE k <= 32""")
def r5_apply_reviews(spark, d):
    h = _h(spark, d)
    decisions = h.where("ord % 3 = 0").select("doc", "ord", F.lit("DEEPER").alias("decision"), F.when(F.col("ord") % 10 >= 5, 0.95).otherwise(0.5).alias("confidence"))
    return H.apply_reviews(H.review_candidates(h).select("doc", "ord", "level"), decisions)


@REGISTRY.query("w10_review_context", _HD + """,
pt AS (SELECT * FROM hd WHERE block_type = 'paragraph_title'),
ar AS (SELECT doc, ord, list({o: ord, l: ': page ' || CAST(page_id + 1 AS VARCHAR) || '; 当前=' || coalesce(level, 'None') || '; 文本=' || left(text, 120)}) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS a FROM pt)
SELECT doc, ord, array_to_string(list_transform(a, lambda x: CASE WHEN x.o = ord THEN '目标' ELSE '邻近' END || x.l), chr(10)) AS context FROM ar""")
def w10_review_context(spark, d):
    return H.review_context(_h(spark, d))


@REGISTRY.query("w11_prior_blocks", _HD + """
SELECT doc, page_id, CAST(coalesce(sum(n) OVER (PARTITION BY doc ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior FROM (SELECT doc, page_id, count(*) AS n FROM hd GROUP BY ALL)""")
def w11_prior_blocks(spark, d):
    return H.prior_blocks(_h(spark, d))


def _visibility(name: str, condition: str) -> None:
    sql = V.with_views() + f""",
pg AS (SELECT DISTINCT doc, CAST((l_orderkey % 40) AS INTEGER) AS page_id FROM li)
SELECT a.doc, a.page_id, b.page_id AS prior_page FROM pg a JOIN pg b ON a.doc = b.doc AND b.page_id < a.page_id WHERE {condition}"""
    REGISTRY.add(
        f"t3_visible_pages_{name}",
        lambda spark, d: H.visible_pages(V.items(spark, d).select("doc", (F.col("l_orderkey") % 40).cast("int").alias("page_id")).distinct(), name, 4),
        sql,
    )


_visibility("contiguous", "true")
_visibility("contiguous_anchor", "a.page_id % 4 = 0 OR b.page_id <= a.page_id // 4 * 4")
_visibility("staggered", "(a.page_id % 8) % 2 = 1 OR b.page_id // 8 < a.page_id // 8 OR (b.page_id % 8) % 2 = 0")
_visibility("contiguous_cascade", "true")


def _prompts(name: str, before: str, condition: str) -> None:
    sql = V.with_views() + f""",
pg AS (SELECT DISTINCT doc, CAST((l_orderkey % 40) AS INTEGER) AS page_id FROM li)
SELECT a.doc, a.page_id, count(*) FILTER (b.page_id < {before}) AS known, count(*) FILTER (b.page_id >= {before} AND {condition}) AS same_batch, max(b.page_id) FILTER (b.page_id > a.page_id AND {condition}) AS last_ahead
FROM pg a JOIN pg b ON a.doc = b.doc GROUP BY a.doc, a.page_id"""

    def run(spark, d):
        pages = V.items(spark, d).select("doc", (F.col("l_orderkey") % 40).cast("int").alias("page_id")).distinct()
        bounds = H.prompt_pages(pages, name, 4)
        both = bounds.join(pages.select("doc", F.col("page_id").alias("b")), "doc")
        also = F.coalesce((F.col("b") >= F.col("also")) & (F.col("b") <= F.col("until")) & ((F.col("b") - F.col("also")) % F.col("step") == 0), F.lit(False))
        return both.groupBy("doc", "page_id").agg(
            F.count_if(F.col("b") < F.col("before")).alias("known"), F.count_if(also).alias("same_batch"), F.max(F.when(also & (F.col("b") > F.col("page_id")), F.col("b"))).alias("last_ahead"))

    REGISTRY.add(f"t3_prompt_pages_{name}", run, sql)


_prompts("contiguous", "a.page_id // 4 * 4", "false")
_prompts("contiguous_anchor", "a.page_id // 4 * 4", "false")
_prompts("contiguous_cascade", "a.page_id // 4 * 4", "(a.page_id % 4 > 0 AND b.page_id = a.page_id // 4 * 4)")
_prompts("staggered", "a.page_id // 8 * 8", "((a.page_id % 8) % 2 = 1 AND b.page_id // 8 = a.page_id // 8 AND (b.page_id % 8) % 2 = 0)")
