"""Queries of the evaluator, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrid.functions import geometry as G
from leafgrid.operators import matching as M
from leafgrid.operators import metrics as E
from leafgrid.plans.registry import Registry
from leafgrid.sources import views as V

REGISTRY = Registry()


def _inter(a: str, b: str) -> str:
    return f"greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"


def _area(a: str) -> str:
    return f"greatest(0, {a}.x2 - {a}.x1) * greatest(0, {a}.y2 - {a}.y1)"


_PAIRS = f""",
pairs AS (
  SELECT *, inter / nullif(ga, 0) AS gt_coverage, coalesce(inter / nullif(ga + pa - inter, 0), 0) AS iou FROM (
    SELECT g.doc, g.page_id, g.idx AS gt_idx, p.idx AS pred_idx, g.label AS gl, p.label AS pl, g.level AS gv, p.level AS pv,
           {_inter("g", "p")} AS inter, {_area("g")} AS ga, {_area("p")} AS pa
    FROM gt g JOIN pred p ON g.doc = p.doc AND g.page_id = p.page_id)),
cand AS (SELECT * FROM pairs WHERE iou >= 0.5)"""


def _greedy(source: str, name: str) -> str:
    """Greedy fold over each page: a list of [gt, pred] grows from the candidates in order."""
    return f""",
{name}_pages AS (SELECT doc, page_id, list([gt_idx, pred_idx] ORDER BY iou DESC, gt_coverage DESC, gt_idx DESC, pred_idx DESC) AS c FROM {source} GROUP BY ALL),
{name}_kept AS (
  SELECT doc, page_id, unnest(list_reduce(list_transform(c, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: y[1] = x[1][1] OR y[2] = x[1][2])) > 0 THEN a ELSE a || x END)) AS m
  FROM {name}_pages),
{name} AS (SELECT k.doc, k.page_id, m[1] AS gt_idx, m[2] AS pred_idx, s.gt_coverage, s.iou FROM {name}_kept k JOIN {source} s ON s.doc = k.doc AND s.page_id = k.page_id AND s.gt_idx = m[1] AND s.pred_idx = m[2])"""


_VIEWS = V.with_views("gt", "pred")
_SOLID = """,
solid AS (SELECT * FROM cand WHERE gl NOT IN ('footer', 'header') AND pl NOT IN ('footer', 'header'))"""
_LABEL_PAIRS = """,
gk AS (SELECT *, row_number() OVER (PARTITION BY doc, page_id, label ORDER BY x1, y1, x2, y2, idx) AS k FROM gt WHERE label IN ('footer', 'header')),
pk AS (SELECT *, row_number() OVER (PARTITION BY doc, page_id, label ORDER BY x1, y1, x2, y2, idx) AS k FROM pred WHERE label IN ('footer', 'header')),
lp AS (SELECT g.doc, g.page_id, g.idx AS gt_idx, p.idx AS pred_idx FROM gk g JOIN pk p USING (doc, page_id, label, k))"""


def _views(spark, d):
    return V.gt_blocks(spark, d), V.pred_blocks(spark, d)


@REGISTRY.query("j2_candidate_pairs", _VIEWS + _PAIRS + "\nSELECT doc, page_id, gt_idx, pred_idx, gt_coverage, iou FROM cand")
def j2_candidate_pairs(spark, d):
    return M.candidate_pairs(*_views(spark, d))


@REGISTRY.query("j2_candidate_pairs_with_coverage", _VIEWS + _PAIRS + "\nSELECT doc, page_id, gt_idx, pred_idx, gt_coverage, iou FROM cand WHERE gt_coverage >= 0.8")
def j2_with_coverage(spark, d):
    return M.candidate_pairs(*_views(spark, d), 0.5, 0.8)


@REGISTRY.query("j4_greedy_match", _VIEWS + _PAIRS + _greedy("cand", "gm") + "\nSELECT doc, page_id, gt_idx, pred_idx, gt_coverage, iou FROM gm")
def j4_greedy_match(spark, d):
    return M.greedy_matches(*_views(spark, d))


@REGISTRY.query("j5_label_only_pairs", _VIEWS + _PAIRS + _LABEL_PAIRS + "\nSELECT doc, page_id, gt_idx, pred_idx, gt_coverage, iou FROM lp JOIN pairs USING (doc, page_id, gt_idx, pred_idx)")
def j5_label_only_pairs(spark, d):
    return M.label_pairs(*_views(spark, d))


@REGISTRY.query("j1_document_join", _VIEWS + """
SELECT doc, gt_blocks, pred_blocks, CASE WHEN gt_blocks IS NULL THEN 'extra' WHEN pred_blocks IS NULL THEN 'missing' ELSE 'both' END AS side
FROM (SELECT doc, count(*) AS gt_blocks FROM gt WHERE doc % 7 <> 0 GROUP BY doc) FULL JOIN (SELECT doc, count(*) AS pred_blocks FROM pred WHERE doc % 5 <> 0 GROUP BY doc) USING (doc)""")
def j1_document_join(spark, d):
    gt, pred = _views(spark, d)
    g = gt.where("doc % 7 <> 0").groupBy("doc").agg(F.count(F.lit(1)).alias("gt_blocks"))
    p = pred.where("doc % 5 <> 0").groupBy("doc").agg(F.count(F.lit(1)).alias("pred_blocks"))
    side = F.when(F.col("gt_blocks").isNull(), "extra").when(F.col("pred_blocks").isNull(), "missing").otherwise("both")
    return g.join(p, "doc", "full_outer").withColumn("side", side)


@REGISTRY.query("p20_page_exclusion", _VIEWS + "\nSELECT doc, page_id, count(*) AS n FROM gt g WHERE NOT EXISTS (SELECT 1 FROM li f WHERE f.doc = g.doc AND f.page_id = g.page_id AND f.l_partkey % 41 = 0) GROUP BY doc, page_id")
def p20_page_exclusion(spark, d):
    failed = V.items(spark, d).where("l_partkey % 41 = 0").select("doc", "page_id")
    return M.without_pages(V.gt_blocks(spark, d), failed).groupBy("doc", "page_id").agg(F.count(F.lit(1)).alias("n"))


# --- evaluation without region equivalence: matches, label pairs, exemptions ---------------------------------------

_OUT = _PAIRS + _SOLID + _greedy("solid", "gm") + _LABEL_PAIRS + """,
mt AS (SELECT doc, gt_idx, pred_idx FROM gm UNION ALL SELECT doc, gt_idx, pred_idx FROM lp),
go AS (
  SELECT g.doc, g.idx, g.label, g.level, p.label AS pl, p.level AS pv, p.idx IS NOT NULL AS matched,
         coalesce(p.label = g.label, false) AS strict, coalesce(p.label = g.label, false) OR g.label = 'footer' AS correct,
         coalesce(p.label = g.label AND p.level = g.level, false) OR g.label = 'footer' AS correct_level
  FROM gt g LEFT JOIN mt ON mt.doc = g.doc AND mt.gt_idx = g.idx LEFT JOIN pred p ON p.doc = g.doc AND p.idx = mt.pred_idx),
kd AS (SELECT DISTINCT doc FROM gt),
po AS (
  SELECT p.doc, p.idx, p.label, p.level, mt.gt_idx IS NOT NULL AS used, kd.doc IS NOT NULL AS known,
         kd.doc IS NOT NULL AND (coalesce(p.label = g.label, false) OR p.label = 'footer') AS correct,
         kd.doc IS NOT NULL AND (coalesce(p.label = g.label AND p.level = g.level, false) OR p.label = 'footer') AS correct_level
  FROM pred p LEFT JOIN kd USING (doc) LEFT JOIN mt ON mt.doc = p.doc AND mt.pred_idx = p.idx LEFT JOIN gt g ON g.doc = p.doc AND g.idx = mt.gt_idx)"""


def _rates(source: str, keys: str) -> str:
    return f"""
SELECT *, coalesce(2.0 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM (
  SELECT *, coalesce(correct / nullif(CAST(support AS DOUBLE), 0), 0) AS recall, coalesce(pred_correct / nullif(CAST(predicted AS DOUBLE), 0), 0) AS precision FROM (
    SELECT {keys}, count(*) FILTER (g = 1) AS support, count(*) FILTER (g = 1 AND ok) AS correct, count(*) FILTER (g = 0 AND ok) AS pred_correct, count(*) FILTER (g = 0) AS predicted
    FROM ({source}) GROUP BY ALL))"""


_BOTH = "SELECT {k}, 1 AS g, {c} AS ok FROM go {w} UNION ALL SELECT {k}, 0, {c} FROM po {w}"
_PER_LABEL = _VIEWS + _OUT + _rates(_BOTH.format(k="label", c="correct", w=""), "label")


def _plain(spark, d):
    return E.evaluate(*_views(spark, d), region_coverage=None)


@REGISTRY.query("a1_label_metrics", _PER_LABEL)
def a1_label_metrics(spark, d):
    return E.per_label(_plain(spark, d))


@REGISTRY.query("a1_level_metrics", _VIEWS + _OUT + _rates(_BOTH.format(k="level", c="correct_level", w=""), "level"))
def a1_level_metrics(spark, d):
    return E.per_level(_plain(spark, d))


@REGISTRY.query("a1_title_level_metrics", _VIEWS + _OUT + _rates(_BOTH.format(k="level", c="correct_level", w="WHERE label = 'paragraph_title'"), "level"))
def a1_title_level_metrics(spark, d):
    return E.title_levels(_plain(spark, d))


_CONFUSION = _VIEWS + _OUT + """,
cf AS (
  SELECT gt_label, pred_label, count(*) AS n FROM (
    SELECT label AS gt_label, CASE WHEN matched THEN pl ELSE '__missing__' END AS pred_label FROM go WHERE NOT correct
    UNION ALL SELECT '__extra__', label FROM po WHERE NOT used AND NOT correct) GROUP BY ALL)"""


@REGISTRY.query("a2_label_confusion", _CONFUSION + "\nSELECT * FROM cf")
def a2_label_confusion(spark, d):
    return E.label_confusion(_plain(spark, d))


@REGISTRY.query("o5_top_confusions", _CONFUSION + "\nSELECT * FROM cf ORDER BY n DESC, gt_label, pred_label LIMIT 20")
def o5_top_confusions(spark, d):
    return E.top_confusions(E.label_confusion(_plain(spark, d)))


def _level_sql(where: str) -> str:
    return _VIEWS + _OUT + f"""
SELECT gt_level, pred_level, count(*) AS n FROM (
  SELECT level AS gt_level, CASE WHEN NOT matched THEN '__missing__' WHEN pl = label THEN pv ELSE pl END AS pred_level FROM go WHERE NOT correct_level {where}
  UNION ALL SELECT '__extra__', level FROM po WHERE known AND NOT used AND NOT correct {where}) GROUP BY ALL"""


@REGISTRY.query("a2_level_confusion", _level_sql(""))
def a2_level_confusion(spark, d):
    return E.level_confusion(_plain(spark, d))


@REGISTRY.query("a2_title_level_confusion", _level_sql("AND label = 'paragraph_title'"))
def a2_title_level_confusion(spark, d):
    return E.level_confusion(_plain(spark, d), titles_only=True)


@REGISTRY.query("a3_document_rows", _VIEWS + _OUT + """
SELECT doc, coalesce(gt, 0) AS gt, coalesce(predicted, 0) AS predicted, coalesce(matched, 0) AS matched, coalesce(correct, 0) AS correct, coalesce(pred_correct, 0) AS pred_correct,
       coalesce(matched / nullif(CAST(gt AS DOUBLE), 0), 0) AS detection_recall, coalesce(strict / nullif(CAST(matched AS DOUBLE), 0), 0) AS classification_accuracy,
       coalesce(correct / nullif(CAST(gt AS DOUBLE), 0), 0) AS end_to_end_recall, coalesce(missing, 0) AS missing, coalesce(extra, 0) AS extra
FROM (SELECT doc, count(*) AS gt, count(*) FILTER (matched) AS matched, count(*) FILTER (strict) AS strict, count(*) FILTER (correct) AS correct, count(*) FILTER (NOT matched AND NOT correct) AS missing FROM go GROUP BY doc)
FULL JOIN (SELECT doc, count(*) AS predicted, count(*) FILTER (correct) AS pred_correct, count(*) FILTER (NOT used AND NOT correct) AS extra FROM po WHERE known GROUP BY doc) USING (doc)""")
def a3_document_rows(spark, d):
    return E.per_document(_plain(spark, d))


@REGISTRY.query("a4_totals", _VIEWS + _OUT + """
SELECT *, coalesce(2.0 * detection_precision * detection_recall / nullif(detection_precision + detection_recall, 0), 0) AS detection_f1,
       coalesce(2.0 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM (
  SELECT total_gt, total_matched, total_correct, missing, total_predicted, total_pred_correct, extra,
         total_matched / CAST(total_predicted AS DOUBLE) AS detection_precision, total_matched / CAST(total_gt AS DOUBLE) AS detection_recall,
         strict / CAST(total_matched AS DOUBLE) AS classification_accuracy, total_pred_correct / CAST(total_predicted AS DOUBLE) AS precision, total_correct / CAST(total_gt AS DOUBLE) AS recall
  FROM (SELECT count(*) AS total_gt, count(*) FILTER (matched) AS total_matched, count(*) FILTER (strict) AS strict, count(*) FILTER (correct) AS total_correct, count(*) FILTER (NOT matched AND NOT correct) AS missing FROM go),
       (SELECT count(*) AS total_predicted, count(*) FILTER (correct) AS total_pred_correct, count(*) FILTER (NOT used AND NOT correct) AS extra FROM po))""")
def a4_totals(spark, d):
    return E.totals(_plain(spark, d))


@REGISTRY.query("a5_category_metrics", _VIEWS + _OUT + _rates(
    "SELECT 'c' || CAST(doc % 3 AS VARCHAR) AS category, label, 1 AS g, correct AS ok FROM go UNION ALL SELECT 'c' || CAST(doc % 3 AS VARCHAR), label, 0, correct FROM po WHERE known", "category, label"))
def a5_category_metrics(spark, d):
    gt, pred = _views(spark, d)
    category = gt.select("doc").distinct().withColumn("category", F.concat(F.lit("c"), (F.col("doc") % 3).cast("string")))
    return E.per_category(E.evaluate(gt, pred, region_coverage=None), category)


@REGISTRY.query("a6_label_universe", _VIEWS + "\nSELECT label, level FROM gt UNION SELECT label, level FROM pred")
def a6_label_universe(spark, d):
    gt, pred = _views(spark, d)
    return gt.select("label", "level").union(pred.select("label", "level")).distinct()


@REGISTRY.query("o6_level_order", _VIEWS + """
SELECT level, CAST(row_number() OVER (ORDER BY CASE WHEN regexp_matches(level, '^H[0-9]+$') THEN 0 WHEN level = 'none' THEN 2 ELSE 1 END, coalesce(TRY_CAST(substr(level, 2) AS INTEGER), 0), level) AS INTEGER) AS position
FROM (SELECT DISTINCT level FROM gt UNION SELECT DISTINCT label FROM gt)""")
def o6_level_order(spark, d):
    gt = V.gt_blocks(spark, d)
    names = gt.select("level").union(gt.select("label")).distinct()
    from pyspark.sql import Window

    return names.select("level", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(E.level_rank(F.col("level")))).alias("position"))


# --- geometry over groups --------------------------------------------------------------------------------------------

_SPAN = "list_reduce([[0.0, -1e18]::DOUBLE[]] || list_sort(list_transform(list_filter({b}, lambda b: b[1] < {r} AND b[3] > {l}), lambda b: [b[2], b[4]]::DOUBLE[])), lambda a, s: [a[1] + CASE WHEN s[1] >= a[2] THEN s[2] - s[1] ELSE greatest(s[2] - a[2], 0) END, greatest(a[2], s[2])])[1]"


def union_sql(boxes: str) -> str:
    """Area of the union of a list of [x1, y1, x2, y2]."""
    xs = f"list_sort(list_distinct(list_transform({boxes}, lambda b: b[1]) || list_transform({boxes}, lambda b: b[3])))"
    slab = _SPAN.format(b=boxes, l="z[1]", r="z[2]")
    return f"coalesce(list_sum(list_transform(list_zip({xs}[:-2], {xs}[2:]), lambda z: (z[2] - z[1]) * {slab})), 0)"


_ARR = "[x1, y1, x2, y2]"


@REGISTRY.query("a7_union_area", _VIEWS + f"\nSELECT doc, page_id, label, {union_sql('bs')} AS union_area FROM (SELECT doc, page_id, label, list({_ARR}) AS bs FROM gt GROUP BY ALL)")
def a7_union_area(spark, d):
    boxes = V.gt_blocks(spark, d).groupBy("doc", "page_id", "label").agg(F.collect_list(G.Box.named().struct()).alias("bs"))
    return boxes.select("doc", "page_id", "label", G.union_area(F.col("bs")).alias("union_area"))


@REGISTRY.query("a7_group_coverage", _VIEWS + f""",
ps AS (SELECT doc, page_id, list({_ARR}) AS bs FROM pred GROUP BY ALL),
cs AS (SELECT g.*, list_filter(list_transform(bs, lambda b: [greatest(g.x1, b[1]), greatest(g.y1, b[2]), least(g.x2, b[3]), least(g.y2, b[4])]), lambda b: b[1] < b[3] AND b[2] < b[4]) AS common FROM gt g JOIN ps USING (doc, page_id))
SELECT doc, idx, {union_sql("common")} / ({_area("cs")}) AS covered FROM cs""")
def a7_group_coverage(spark, d):
    gt, pred = _views(spark, d)
    others = pred.groupBy("doc", "page_id").agg(F.collect_list(G.Box.named().struct()).alias("bs"))
    return gt.join(others, ["doc", "page_id"]).select("doc", "idx", G.group_coverage(G.Box.named(), F.col("bs")).alias("covered"))


@REGISTRY.query("a9_max_pair_overlap", _VIEWS + f"""
SELECT doc, page_id, coalesce(max(o), 0) AS overlap FROM (SELECT DISTINCT doc, page_id FROM gt) LEFT JOIN (
  SELECT a.doc, a.page_id, ({_inter("a", "b")}) / nullif(least({_area("a")}, {_area("b")}), 0) AS o FROM gt a JOIN gt b ON a.doc = b.doc AND a.page_id = b.page_id AND a.idx < b.idx) USING (doc, page_id) GROUP BY ALL""")
def a9_max_pair_overlap(spark, d):
    boxes = V.gt_blocks(spark, d).groupBy("doc", "page_id").agg(F.collect_list(G.Box.named().struct()).alias("bs"))
    return boxes.select("doc", "page_id", G.max_pair_overlap(F.col("bs")).alias("overlap"))


_BOX_METRICS = _VIEWS + _PAIRS + "\nSELECT doc, gt_idx, pred_idx, inter, ga AS gt_area, pa AS pred_area, gt_coverage, iou FROM pairs"


@REGISTRY.query("f15_f16_box_metrics", _BOX_METRICS)
@REGISTRY.query("f15_f16_box_metrics_all", _BOX_METRICS)
def f15_f16_box_metrics(spark, d):
    """The metrics of all pairs of blocks of a page (under both of its names)."""
    gt, pred = _views(spark, d)
    fields = ("idx", "x1", "y1", "x2", "y2")
    both = gt.select("doc", "page_id", *[F.col(c).alias("g_" + c) for c in fields]).join(pred.select("doc", "page_id", *[F.col(c).alias("p_" + c) for c in fields]), ["doc", "page_id"])
    a, b = G.Box.named("g_"), G.Box.named("p_")
    return both.select(
        "doc", F.col("g_idx").alias("gt_idx"), F.col("p_idx").alias("pred_idx"), G.intersection(a, b).alias("inter"), G.area(a).alias("gt_area"), G.area(b).alias("pred_area"),
        G.coverage(a, b).alias("gt_coverage"), G.iou(a, b).alias("iou"),
    )


# --- region equivalence and the whole evaluator ----------------------------------------------------------------------

def _region_sql(name: str, keys: str) -> str:
    on = f"doc, page_id, {keys}"
    same = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in on.split(","))
    edges = f"""(SELECT {", ".join("a." + k.strip() for k in on.split(","))}, a.idx * 2 AS u, b.idx * 2 + 1 AS v FROM gt a JOIN pred b ON {same}
    WHERE a.label NOT IN ('footer', 'header') AND b.label NOT IN ('footer', 'header') AND {_inter("a", "b")} > 0)"""
    box = lambda t: f"[{t}.x1, {t}.y1, {t}.x2, {t}.y2]"
    common = lambda b, others: f"list_filter(list_transform({others}, lambda o: [greatest({b}[1], o[1]), greatest({b}[2], o[2]), least({b}[3], o[3]), least({b}[4], o[4])]), lambda o: o[1] < o[3] AND o[2] < o[4])"
    chars = "coalesce(list_sum(list_transform(list_distinct(string_split(gt_text, '')), lambda ch: least(len(gt_text) - len(replace(gt_text, ch, '')), len(pred_text) - len(replace(pred_text, ch, ''))))), 0)"
    return f""",
{name}_e AS {edges},
{name}_s AS (SELECT {on}, u, v FROM {name}_e UNION ALL SELECT {on}, v, u FROM {name}_e),
{name}_r AS (
  SELECT {on}, u AS node, u AS root FROM {name}_s
  UNION SELECT {", ".join("r." + k.strip() for k in on.split(","))}, s.v, r.root FROM {name}_r r JOIN {name}_s s ON s.u = r.node AND {" AND ".join(f"s.{k.strip()} = r.{k.strip()}" for k in on.split(","))}),
{name}_c AS (SELECT {on}, node, min(root) AS root FROM {name}_r GROUP BY ALL),
{name}_g AS (
  SELECT c.doc, c.page_id, {", ".join("c." + k.strip() for k in keys.split(","))}, c.root,
         list(g.idx) FILTER (g.idx IS NOT NULL) AS gi, list(p.idx) FILTER (p.idx IS NOT NULL) AS pi, list({box("g")}) FILTER (g.idx IS NOT NULL) AS gb, list({box("p")}) FILTER (p.idx IS NOT NULL) AS pb,
         regexp_replace(lower(coalesce(string_agg(g.text, ''), '')), '[^a-z0-9]', '', 'g') AS gt_text, regexp_replace(lower(coalesce(string_agg(p.text, ''), '')), '[^a-z0-9]', '', 'g') AS pred_text
  FROM {name}_c c LEFT JOIN gt g ON c.node % 2 = 0 AND g.doc = c.doc AND g.idx = c.node // 2 LEFT JOIN pred p ON c.node % 2 = 1 AND p.doc = c.doc AND p.idx = c.node // 2 GROUP BY ALL),
{name}_t AS (SELECT *, {chars} AS common FROM {name}_g),
{name}_ov AS (
  SELECT *, (SELECT coalesce(max(o), 0) FROM (SELECT greatest(0, least(a[3], b[3]) - greatest(a[1], b[1])) * greatest(0, least(a[4], b[4]) - greatest(a[2], b[2])) / least((a[3] - a[1]) * (a[4] - a[2]), (b[3] - b[1]) * (b[4] - b[2])) AS o
             FROM (SELECT unnest(gb) AS a, generate_subscripts(gb, 1) AS i), (SELECT unnest(gb) AS b, generate_subscripts(gb, 1) AS j) WHERE i < j)) AS go_,
         (SELECT coalesce(max(o), 0) FROM (SELECT greatest(0, least(a[3], b[3]) - greatest(a[1], b[1])) * greatest(0, least(a[4], b[4]) - greatest(a[2], b[2])) / least((a[3] - a[1]) * (a[4] - a[2]), (b[3] - b[1]) * (b[4] - b[2])) AS o
             FROM (SELECT unnest(pb) AS a, generate_subscripts(pb, 1) AS i), (SELECT unnest(pb) AS b, generate_subscripts(pb, 1) AS j) WHERE i < j)) AS po_
  FROM {name}_t),
{name}_cov AS (
  SELECT *, list_min(list_transform(gb, lambda b: {union_sql(common("b", "pb"))} / ((b[3] - b[1]) * (b[4] - b[2])))) AS gc,
         list_min(list_transform(pb, lambda b: {union_sql(common("b", "gb"))} / ((b[3] - b[1]) * (b[4] - b[2])))) AS pc
  FROM {name}_ov),
{name} AS (
  SELECT * FROM {name}_cov
  WHERE CASE WHEN coalesce(common / nullif(CAST(len(gt_text) AS DOUBLE), 0), 0) >= 0.8 AND coalesce(common / nullif(CAST(len(pred_text) AS DOUBLE), 0), 0) >= 0.8 THEN true
             WHEN len(gi) = 1 AND len(pi) = 1 AND coalesce(common / nullif(CAST(len(gt_text) AS DOUBLE), 0), 0) >= 0.9 THEN true
             WHEN len(gi) = 1 AND len(pi) = 1 THEN false
             ELSE go_ <= 0.5 AND po_ <= 0.5 AND gc >= 0.8 AND pc >= 0.8 END)"""


_RECURSIVE = _VIEWS.replace("WITH li", "WITH RECURSIVE li", 1)
_CHARTS = _RECURSIVE.replace("\ngt AS (", "\ngt0 AS (") + """,
gt AS (SELECT * REPLACE (CASE WHEN label = 'image' THEN 'flowchart' ELSE label END AS label) FROM gt0)"""
_ACCEPTED_BOX = "[greatest(gb[1], x.b[1]), greatest(gb[2], x.b[2]), least(gb[3], x.b[3]), least(gb[4], x.b[4])]"
#: Flowcharts of the first pages, in order of position: a recursion carries the predictions taken so far.
_FLOWCHARTS = f""",
fc AS (
  SELECT g.doc, g.page_id, g.idx, any_value([g.x1, g.y1, g.x2, g.y2]) AS gb, any_value({_area("g")}) AS ga,
         list({{c: ({_inter("g", "p")}) / ({_area("g")}), i: ({_inter("g", "p")}) / ({_area("g")} + {_area("p")} - ({_inter("g", "p")})), idx: p.idx, b: [p.x1, p.y1, p.x2, p.y2]}} ORDER BY p.idx) AS cand
  FROM gt g JOIN pred p ON g.doc = p.doc AND g.page_id = p.page_id
  WHERE g.label = 'flowchart' AND g.page_id < 3 AND p.label IN ('flowchart', 'image', 'text') AND {_inter("g", "p")} > 0 GROUP BY ALL),
fk AS (SELECT *, row_number() OVER (PARTITION BY doc, page_id ORDER BY idx) AS k FROM fc),
fr AS (
  SELECT doc, page_id, CAST(0 AS BIGINT) AS k, []::INTEGER[] AS used, []::INTEGER[] AS ids, NULL::INTEGER AS gt_idx, NULL::INTEGER AS pred_idx, NULL::DOUBLE AS gt_coverage, NULL::DOUBLE AS iou
  FROM (SELECT DISTINCT doc, page_id FROM fk)
  UNION ALL
  SELECT doc, page_id, k, CASE WHEN ok THEN used || list_transform(free, lambda x: x.idx) ELSE used END, CASE WHEN ok THEN list_transform(free, lambda x: x.idx) ELSE [] END,
         CASE WHEN ok THEN idx END, CASE WHEN ok THEN best.idx END, CASE WHEN ok THEN greatest(best.c, {union_sql("common")} / ga) END, CASE WHEN ok THEN best.i END
  FROM (
    SELECT *, coalesce(best.c >= 0.10, false) AS ok, list_transform(free, lambda x: {_ACCEPTED_BOX}) AS common FROM (
      SELECT *, list_max(list_transform(free, lambda x: {{c: x.c, i: x.i, idx: x.idx}})) AS best FROM (
        SELECT fk.doc, fk.page_id, fk.k, fk.idx, fk.gb, fk.ga, fr.used, list_filter(fk.cand, lambda x: NOT list_contains(fr.used, x.idx)) AS free
        FROM fr JOIN fk ON fk.doc = fr.doc AND fk.page_id = fr.page_id AND fk.k = fr.k + 1)))),
fl AS (SELECT doc, page_id, gt_idx, pred_idx, gt_coverage, iou, ids FROM fr WHERE gt_idx IS NOT NULL)"""


@REGISTRY.query("j6_region_equivalence", _RECURSIVE + _region_sql("rg", "label") + "\nSELECT doc, 'g' AS side, unnest(gi) AS idx FROM rg UNION ALL SELECT doc, 'p', unnest(pi) FROM rg")
def j6_region_equivalence(spark, d):
    return M.equivalent_regions(*_views(spark, d))


_REGION_ROWS = """,
rgg AS (SELECT doc, unnest(gi) AS idx FROM rg), rgp AS (SELECT doc, unnest(pi) AS idx FROM rg), rvg AS (SELECT doc, unnest(gi) AS idx FROM rv), rvp AS (SELECT doc, unnest(pi) AS idx FROM rv)"""


def _outcomes_sql(matches: str, chart_gt: str = "false", chart_pred: str = "false", used: str = "mt.gt_idx IS NOT NULL") -> str:
    return _PAIRS + _SOLID + _greedy("solid", "gm") + _LABEL_PAIRS + _region_sql("rg", "label") + _region_sql("rv", "label, level") + _REGION_ROWS + f""",
m0 AS (SELECT doc, gt_idx, pred_idx FROM gm UNION ALL SELECT doc, gt_idx, pred_idx FROM lp),
{matches},
go AS (
  SELECT g.doc, g.idx, g.label, g.level, p.label AS pl, p.level AS pv, p.idx IS NOT NULL AS matched, coalesce(p.label = g.label, false) AS strict,
         coalesce(p.label = g.label, false) OR g.label = 'footer' OR {chart_gt} OR (g.doc, g.idx) IN (SELECT doc, idx FROM rgg) AS correct,
         coalesce(p.label = g.label AND p.level = g.level, false) OR g.label = 'footer' OR {chart_gt} OR (g.doc, g.idx) IN (SELECT doc, idx FROM rvg) AS correct_level
  FROM gt g LEFT JOIN mt ON mt.doc = g.doc AND mt.gt_idx = g.idx LEFT JOIN pred p ON p.doc = g.doc AND p.idx = mt.pred_idx),
kd AS (SELECT DISTINCT doc FROM gt),
po AS (
  SELECT p.doc, p.idx, p.label, p.level, kd.doc IS NOT NULL AS known, bool_or({used}) AS used,
         kd.doc IS NOT NULL AND bool_or(coalesce(p.label = g.label, false) OR p.label = 'footer' OR {chart_pred} OR (p.doc, p.idx) IN (SELECT doc, idx FROM rgp)) AS correct,
         kd.doc IS NOT NULL AND bool_or(coalesce(p.label = g.label AND p.level = g.level, false) OR p.label = 'footer' OR {chart_pred} OR (p.doc, p.idx) IN (SELECT doc, idx FROM rvp)) AS correct_level
  FROM pred p LEFT JOIN kd USING (doc) LEFT JOIN mt ON mt.doc = p.doc AND mt.pred_idx = p.idx LEFT JOIN gt g ON g.doc = p.doc AND g.idx = mt.gt_idx
  GROUP BY p.doc, p.idx, p.label, p.level, kd.doc)"""


_FULL = _RECURSIVE + _outcomes_sql("mt AS (SELECT * FROM m0)")
#: With the images of the first pages as flowcharts that may be answered by other labels.
_FULL_CHARTS = _CHARTS + _FLOWCHARTS + _outcomes_sql(
    """mt AS (SELECT * FROM m0 WHERE (doc, gt_idx) NOT IN (SELECT doc, gt_idx FROM fl) UNION ALL SELECT doc, gt_idx, pred_idx FROM fl),
fa AS (SELECT doc, unnest(ids) AS idx FROM fl)""",
    "(g.doc, g.idx) IN (SELECT doc, gt_idx FROM fl)", "(p.doc, p.idx) IN (SELECT doc, idx FROM fa)",
    "(p.doc, p.idx) IN (SELECT doc, pred_idx FROM m0) OR (p.doc, p.idx) IN (SELECT doc, idx FROM fa)")


@REGISTRY.query("flagship_label_metrics", _FULL + _rates(_BOTH.format(k="label", c="correct", w=""), "label"))
def flagship_label_metrics(spark, d):
    """Per-label precision, recall and F1 of the whole evaluator, region equivalence included."""
    return E.per_label(E.evaluate(*_views(spark, d)))


@REGISTRY.query("flagship_title_level_metrics", _FULL + _rates(_BOTH.format(k="level", c="correct_level", w="WHERE label = 'paragraph_title'"), "level"))
def flagship_title_level_metrics(spark, d):
    return E.title_levels(E.evaluate(*_views(spark, d)))


@REGISTRY.query("u1_u3_outcome_flags", _FULL + "\nSELECT doc, idx, label, level, matched, strict, correct, correct_level FROM go")
def u1_u3_outcome_flags(spark, d):
    return E.evaluate(*_views(spark, d)).gt.select("doc", "idx", "label", "level", "matched", "strict", "correct", "correct_level")


_RATE_FIELDS = "support: support, correct: correct, pred_correct: pred_correct, predicted: predicted, recall: recall, precision: precision, f1: f1"
_REPORT = _FULL + f""",
pl AS ({_rates(_BOTH.format(k="label", c="correct", w=""), "label")}),
tl AS ({_rates(_BOTH.format(k="level", c="correct_level", w="WHERE label = 'paragraph_title'"), "level")}),
gd AS (SELECT doc, count(*) AS gt, count(*) FILTER (matched) AS matched, count(*) FILTER (strict) AS strict, count(*) FILTER (correct) AS correct, count(*) FILTER (NOT matched AND NOT correct) AS missing FROM go GROUP BY doc),
pd AS (SELECT doc, count(*) AS predicted, count(*) FILTER (correct) AS pred_correct, count(*) FILTER (NOT used AND NOT correct) AS extra FROM po WHERE known GROUP BY doc),
jr AS (
  SELECT doc, coalesce(gt, 0) AS gt, coalesce(predicted, 0) AS predicted, coalesce(matched, 0) AS matched, coalesce(correct, 0) AS correct, coalesce(pred_correct, 0) AS pred_correct, coalesce(matched / nullif(CAST(gt AS DOUBLE), 0), 0) AS dr,
         coalesce(strict / nullif(CAST(matched AS DOUBLE), 0), 0) AS ca, coalesce(correct / nullif(CAST(gt AS DOUBLE), 0), 0) AS er, coalesce(missing, 0) AS missing, coalesce(extra, 0) AS extra
  FROM gd FULL JOIN pd USING (doc)),
t0 AS (
  SELECT *, total_matched / CAST(total_predicted AS DOUBLE) AS dp, total_matched / CAST(total_gt AS DOUBLE) AS dr, strict / CAST(total_matched AS DOUBLE) AS ca, total_pred_correct / CAST(total_predicted AS DOUBLE) AS pr, total_correct / CAST(total_gt AS DOUBLE) AS re
  FROM (SELECT count(*) AS total_gt, count(*) FILTER (matched) AS total_matched, count(*) FILTER (strict) AS strict, count(*) FILTER (correct) AS total_correct, count(*) FILTER (NOT matched AND NOT correct) AS missing FROM go),
       (SELECT count(*) AS total_predicted, count(*) FILTER (correct) AS total_pred_correct, count(*) FILTER (NOT used AND NOT correct) AS extra FROM po))
SELECT CAST(to_json({{
  totals: {{total_gt: total_gt, total_matched: total_matched, total_correct: total_correct, missing: missing, total_predicted: total_predicted, total_pred_correct: total_pred_correct, extra: extra, detection_precision: dp, detection_recall: dr,
    classification_accuracy: ca, precision: pr, recall: re, detection_f1: 2.0::DOUBLE * dp * dr / (dp + dr), f1: 2.0::DOUBLE * pr * re / (pr + re)}},
  per_label: (SELECT list({{label: label, {_RATE_FIELDS}}} ORDER BY label) FROM pl),
  paragraph_title_by_level: (SELECT list({{level: level, {_RATE_FIELDS}}} ORDER BY level) FROM tl),
  job_rows: (SELECT list({{doc: doc, gt: gt, predicted: predicted, matched: matched, correct: correct, pred_correct: pred_correct, detection_recall: dr, classification_accuracy: ca, end_to_end_recall: er, missing: missing, extra: extra}} ORDER BY doc) FROM jr)
}}) AS VARCHAR) AS report FROM t0"""


@REGISTRY.query("k15_report_json", _REPORT)
def k15_report_json(spark, d):
    return E.report_json(E.evaluate(*_views(spark, d)))


def _charts(spark, d):
    """Both sides with the images of the ground truth as flowcharts, and the pages where other labels may answer them."""
    gt, pred = _views(spark, d)
    gt = gt.withColumn("label", F.when(F.col("label") == "image", "flowchart").otherwise(F.col("label")))
    return gt, pred, gt.where("page_id < 3").select("doc", "page_id").distinct()


@REGISTRY.query("j7_flexible_flowcharts", _CHARTS + _FLOWCHARTS + "\nSELECT doc, page_id, gt_idx, pred_idx, gt_coverage, iou, list_sort(ids) AS accepted FROM fl")
def j7_flexible_flowcharts(spark, d):
    return M.flowchart_matches(*_charts(spark, d)).withColumn("accepted", F.array_sort("accepted"))


@REGISTRY.query("flagship_flowchart_confusion", _FULL_CHARTS + """
SELECT gt_label, pred_label, count(*) AS n FROM (
  SELECT label AS gt_label, CASE WHEN matched THEN pl ELSE '__missing__' END AS pred_label FROM go WHERE NOT correct
  UNION ALL SELECT '__extra__', label FROM po WHERE NOT used AND NOT correct) GROUP BY ALL""")
def flagship_flowchart_confusion(spark, d):
    """Confusions of the whole evaluator with reviewed flowchart pages."""
    gt, pred, pages = _charts(spark, d)
    return E.label_confusion(E.evaluate(gt, pred, flowchart_pages=pages))


@REGISTRY.query("j8_overlay", _CHARTS + _FLOWCHARTS + _PAIRS + _SOLID + _greedy("solid", "gm") + _LABEL_PAIRS + """,
m0 AS (SELECT doc, page_id, gt_idx, pred_idx, 'geometry' AS kind FROM gm UNION ALL SELECT doc, page_id, gt_idx, pred_idx, 'label' FROM lp)
SELECT * FROM m0 WHERE (doc, gt_idx) NOT IN (SELECT doc, gt_idx FROM fl) UNION ALL SELECT doc, page_id, gt_idx, pred_idx, 'flowchart' FROM fl""")
def j8_overlay(spark, d):
    return M.overlay(*_charts(spark, d))


@REGISTRY.query("k14_level_errors", _level_sql("AND label = 'paragraph_title'") + "\nORDER BY n DESC, gt_level, pred_level LIMIT 10")
def k14_level_errors(spark, d):
    """The ten most frequent level errors of paragraph titles."""
    return E.top_confusions(E.level_confusion(_plain(spark, d), titles_only=True), 10)


_PERCENT = "lpad(printf('%.1f%%', {x} * 100), {w}, ' ')"


@REGISTRY.query("k14_report_lines", _VIEWS + _OUT + """,
cf AS (
  SELECT gt_label, pred_label, count(*) AS n FROM (
    SELECT label AS gt_label, CASE WHEN matched THEN pl ELSE '__missing__' END AS pred_label FROM go WHERE NOT correct
    UNION ALL SELECT '__extra__', label FROM po WHERE NOT used AND NOT correct) GROUP BY ALL),
lf AS (
  SELECT gt_level, pred_level, count(*) AS n FROM (
    SELECT level AS gt_level, CASE WHEN NOT matched THEN '__missing__' WHEN pl = label THEN pv ELSE pl END AS pred_level FROM go WHERE NOT correct_level AND label = 'paragraph_title'
    UNION ALL SELECT '__extra__', level FROM po WHERE known AND NOT used AND NOT correct AND label = 'paragraph_title') GROUP BY ALL),
rt AS (""" + " UNION ALL ".join(
    f"SELECT {k} AS section, * FROM ({_rates(_BOTH.format(k=key, c=c, w=w), key).replace(key + ', count', key + ' AS name, count')})"
    for k, key, c, w in ((2, "label", "correct", ""), (3, "level", "correct_level", ""), (4, "level", "correct_level", "WHERE label = 'paragraph_title'"))) + """),
rl AS (
  SELECT section, row_number() OVER (PARTITION BY section ORDER BY CASE WHEN section = 2 THEN 0 WHEN regexp_matches(name, '^H[0-9]+$') THEN 0 WHEN name = 'none' THEN 2 ELSE 1 END,
           CASE WHEN section > 2 THEN coalesce(TRY_CAST(substr(name, 2) AS INTEGER), 0) ELSE 0 END, name) AS pos,
         '  ' || rpad(name, CAST(greatest(20, length(name)) AS INTEGER), ' ') || lpad(CAST(support AS VARCHAR), 9, ' ') || lpad(CAST(correct AS VARCHAR), 9, ' ') || """
    + _PERCENT.format(x="recall", w=9) + " || " + _PERCENT.format(x="precision", w=11) + """ || lpad(printf('%.3f', f1), 8, ' ') AS line FROM rt)
SELECT section, CAST(pos AS INTEGER) AS pos, line FROM rl
UNION ALL SELECT 6, CAST(row_number() OVER (ORDER BY n DESC, gt_label, pred_label) AS INTEGER), '  ' || rpad(gt_label, CAST(greatest(20, length(gt_label)) AS INTEGER), ' ') || ' -> ' || rpad(pred_label, CAST(greatest(20, length(pred_label)) AS INTEGER), ' ') || ' ' || CAST(n AS VARCHAR)
  FROM (SELECT * FROM cf ORDER BY n DESC, gt_label, pred_label LIMIT 20)
UNION ALL SELECT 7, CAST(row_number() OVER (ORDER BY n DESC, gt_level, pred_level) AS INTEGER), '  ' || rpad(gt_level, CAST(greatest(10, length(gt_level)) AS INTEGER), ' ') || ' -> ' || rpad(pred_level, CAST(greatest(16, length(pred_level)) AS INTEGER), ' ') || ' ' || CAST(n AS VARCHAR)
  FROM (SELECT * FROM lf ORDER BY n DESC, gt_level, pred_level LIMIT 10)""")
def k14_report_lines(spark, d):
    """The report's tables of labels, levels and errors as printed lines (documents and totals are tested in pytest)."""
    return E.report_lines(_plain(spark, d)).where("section not in (1, 5)")
