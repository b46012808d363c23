"""Queries of scalars, normalisers and projections, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrid.functions import geometry as G
from leafgrid.functions import jsonx as J
from leafgrid.functions import text as T
from leafgrid.operators import blocks as B
from leafgrid.operators.containment import contained
from leafgrid.plans.registry import Registry
from leafgrid.sources import views as V

REGISTRY = Registry()
_LI = V.with_views()


def raw_boxes(spark, d):
    """Boxes with swapped corners, halves, negative and out-of-page values, from line items."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    li = V.items(spark, d)
    x1, y1 = (p * 31 + n * 57) % 1300 - 100, (s * 41 + p * 7) % 1500 - 150
    x2, y2 = x1 + (p * 13) % 400 - 60, y1 + (p * 7) % 300 - 30
    half = lambda c, k: c + F.when(p % k == 0, 0.5).otherwise(0.0)
    return li.select("doc", "rid", "page_id", half(x1, 2).alias("x1"), half(y1, 3).alias("y1"), half(x2, 2).alias("x2"), half(y2, 3).alias("y2"),
                     (F.lit(800) + n * 100).cast("int").alias("width"), (F.lit(900) + (p % 5) * 150).cast("int").alias("height"), p.alias("p"), n.alias("n"))


_RAW = _LI + """,
rb AS (
  SELECT doc, rid, page_id, xa + CASE WHEN p % 2 = 0 THEN 0.5::DOUBLE ELSE 0 END AS x1, ya + CASE WHEN p % 3 = 0 THEN 0.5::DOUBLE ELSE 0 END AS y1,
         xa + (p * 13) % 400 - 60 + CASE WHEN p % 2 = 0 THEN 0.5::DOUBLE ELSE 0 END AS x2, ya + (p * 7) % 300 - 30 + CASE WHEN p % 3 = 0 THEN 0.5::DOUBLE ELSE 0 END AS y2,
         CAST(800 + n * 100 AS INTEGER) AS width, CAST(900 + (p % 5) * 150 AS INTEGER) AS height, p, n
  FROM (SELECT *, l_partkey AS p, l_linenumber AS n, (l_partkey * 31 + l_linenumber * 57) % 1300 - 100 AS xa, (l_suppkey * 41 + l_partkey * 7) % 1500 - 150 AS ya FROM li)),
ob AS (SELECT *, least(x1, x2) AS ax1, least(y1, y2) AS ay1, greatest(x1, x2) AS ax2, greatest(y1, y2) AS ay2 FROM rb)"""


def _flat(df, c="b", keys=("doc", "rid")):
    return df.where(F.col(c).isNotNull()).select(*keys, *[F.col(f"{c}.{n}").alias(n) for n in ("x1", "y1", "x2", "y2")])


def _clamp_sql(w: str, h: str, source: str = "ob", x=("ax1", "ay1", "ax2", "ay2")) -> str:
    put = lambda c, m: f"CAST(least(greatest(round_even({c}, 0), 0), {m}) AS INTEGER)"
    return f"SELECT * FROM (SELECT doc, rid, {put(x[0], w)} AS x1, {put(x[1], h)} AS y1, {put(x[2], w)} AS x2, {put(x[3], h)} AS y2 FROM {source}) WHERE x1 < x2 AND y1 < y2"


@REGISTRY.query("p3_clamped_bbox", _RAW + "\n" + _clamp_sql("width", "height"))
def p3(spark, d):
    return _flat(raw_boxes(spark, d).withColumn("b", G.clamped(G.Box.named(), F.col("width"), F.col("height"))))


@REGISTRY.query("p4_grid_bbox", _RAW + "\n" + _clamp_sql("1000", "1000"))
def p4(spark, d):
    return _flat(raw_boxes(spark, d).withColumn("b", G.clamped_1000(G.Box.named())))


@REGISTRY.query("p5_float_bbox", _RAW + "\nSELECT doc, rid, ax1 AS x1, ay1 AS y1, ax2 AS x2, ay2 AS y2 FROM ob WHERE ax1 < ax2 AND ay1 < ay2")
def p5(spark, d):
    return _flat(raw_boxes(spark, d).withColumn("b", G.checked(G.Box.named())))


_GRID = _RAW + ",\ngr AS (" + _clamp_sql("1000", "1000") + "),\ngw AS (SELECT gr.*, width, height, p FROM gr JOIN rb USING (doc, rid))"


@REGISTRY.query("p6_grid_to_pixels", _GRID + """,
px AS (SELECT doc, rid, width, height, CAST(least(greatest(round_even(x1 / 1000 * width, 0), 0), width) AS INTEGER) AS a, CAST(least(greatest(round_even(y1 / 1000 * height, 0), 0), height) AS INTEGER) AS b,
              CAST(least(greatest(round_even(x2 / 1000 * width, 0), 0), width) AS INTEGER) AS c, CAST(least(greatest(round_even(y2 / 1000 * height, 0), 0), height) AS INTEGER) AS e FROM gw)
SELECT doc, rid, CASE WHEN a < c AND b < e THEN a ELSE 0 END AS x1, CASE WHEN a < c AND b < e THEN b ELSE 0 END AS y1, CASE WHEN a < c AND b < e THEN c ELSE width END AS x2, CASE WHEN a < c AND b < e THEN e ELSE height END AS y2 FROM px""")
def p6(spark, d):
    df = raw_boxes(spark, d).withColumn("g", G.clamped_1000(G.Box.named())).where("g is not null")
    return _flat(df.withColumn("b", G.pixels_of_1000(G.Box.of(F.col("g")), F.col("width"), F.col("height"))))


@REGISTRY.query("p7_pixels_to_grid", _RAW + ",\npx AS (" + _clamp_sql("width", "height") + """)
SELECT doc, rid, CAST(least(greatest(round_even(px.x1 / width * 1000, 0), 0), 1000) AS INTEGER) AS x1, CAST(least(greatest(round_even(px.y1 / height * 1000, 0), 0), 1000) AS INTEGER) AS y1,
       CAST(least(greatest(round_even(px.x2 / width * 1000, 0), 0), 1000) AS INTEGER) AS x2, CAST(least(greatest(round_even(px.y2 / height * 1000, 0), 0), 1000) AS INTEGER) AS y2 FROM px JOIN rb USING (doc, rid)""")
def p7(spark, d):
    df = raw_boxes(spark, d).withColumn("g", G.clamped(G.Box.named(), F.col("width"), F.col("height"))).where("g is not null")
    return _flat(df.withColumn("b", G.grid_of_pixels(G.Box.of(F.col("g")), F.col("width"), F.col("height"))))


@REGISTRY.query("p8_rescaled_bbox", _RAW + """,
cc AS (SELECT *, 50 AS cx1, 20 AS cy1, 50 + width - 100 AS cx2, 20 + height - 40 AS cy2, 1000 + p % 7 * 100 AS pw, 1400 + p % 3 * 50 AS ph FROM ob),
cl AS (SELECT *, least(greatest(ax1, cx1), cx2) AS u1, least(greatest(ay1, cy1), cy2) AS v1, least(greatest(ax2, cx1), cx2) AS u2, least(greatest(ay2, cy1), cy2) AS v2 FROM cc),
sc AS (SELECT doc, rid, pw, ph, u1 < u2 AND v1 < v2 AS ok,
         CAST(least(greatest(round_even((u1 - cx1) * (pw / (cx2 - cx1)), 0), 0), pw) AS INTEGER) AS a, CAST(least(greatest(round_even((v1 - cy1) * (ph / (cy2 - cy1)), 0), 0), ph) AS INTEGER) AS b,
         CAST(least(greatest(round_even((u2 - cx1) * (pw / (cx2 - cx1)), 0), 0), pw) AS INTEGER) AS c, CAST(least(greatest(round_even((v2 - cy1) * (ph / (cy2 - cy1)), 0), 0), ph) AS INTEGER) AS e FROM cl)
SELECT doc, rid, CASE WHEN ok AND a < c AND b < e THEN a ELSE 0 END AS x1, CASE WHEN ok AND a < c AND b < e THEN b ELSE 0 END AS y1,
       CAST(CASE WHEN ok AND a < c AND b < e THEN c ELSE pw END AS INTEGER) AS x2, CAST(CASE WHEN ok AND a < c AND b < e THEN e ELSE ph END AS INTEGER) AS y2 FROM sc""")
def p8(spark, d):
    df = raw_boxes(spark, d)
    content = G.Box(F.lit(50), F.lit(20), F.lit(50) + F.col("width") - 100, F.lit(20) + F.col("height") - 40)
    page = ((F.lit(1000) + F.col("p") % 7 * 100), (F.lit(1400) + F.col("p") % 3 * 50))
    return _flat(df.withColumn("b", G.rescaled(G.Box.named().ordered(), content, *[c.cast("int") for c in page])))


_EXPORT = _RAW + """,
ex AS (SELECT *, CASE WHEN n = 1 THEN [ax1, ay1, ax2, ay2] END AS own, p % 2 = 0 AS on_model, CASE WHEN p % 5 = 0 THEN 0 ELSE 1200 END AS mw, 1700 AS mh FROM ob),
pp AS (SELECT *, least(greatest(round_even(ax1, 0), 0), width) AS u1, least(greatest(round_even(ay1, 0), 0), height) AS v1, least(greatest(round_even(ax2, 0), 0), width) AS u2, least(greatest(round_even(ay2, 0), 0), height) AS v2 FROM ex),
mm AS (SELECT *, CASE WHEN on_model AND mw > 0 THEN (100.0::DOUBLE + u1 / width * 1000.0) / mw * 1000 ELSE u1 / width * 1000 END AS e1, CASE WHEN on_model AND mw > 0 THEN (150.0::DOUBLE + v1 / height * 1400.0) / mh * 1000 ELSE v1 / height * 1000 END AS f1,
              CASE WHEN on_model AND mw > 0 THEN (100.0::DOUBLE + u2 / width * 1000.0) / mw * 1000 ELSE u2 / width * 1000 END AS e2, CASE WHEN on_model AND mw > 0 THEN (150.0::DOUBLE + v2 / height * 1400.0) / mh * 1000 ELSE v2 / height * 1000 END AS f2 FROM pp),
gg AS (SELECT *, [least(greatest(round_even(own[1], 0), 0), 1000), least(greatest(round_even(own[2], 0), 0), 1000), least(greatest(round_even(own[3], 0), 0), 1000), least(greatest(round_even(own[4], 0), 0), 1000)] AS g1,
              [least(greatest(round_even(e1, 0), 0), 1000), least(greatest(round_even(f1, 0), 0), 1000), least(greatest(round_even(e2, 0), 0), 1000), least(greatest(round_even(f2, 0), 0), 1000)] AS g2 FROM mm)
SELECT doc, rid, array_to_string(list_transform(CASE WHEN own IS NOT NULL AND g1[1] < g1[3] AND g1[2] < g1[4] THEN g1 WHEN u1 < u2 AND v1 < v2 AND g2[1] < g2[3] AND g2[2] < g2[4] THEN g2 ELSE [0, 0, 1, 1] END, lambda x: CAST(x AS INTEGER)), ',') AS bbox FROM gg"""


@REGISTRY.query("p9_export_bbox", _EXPORT)
def p9(spark, d):
    o = G.Box.named().ordered().array()
    b = F.struct(F.when(F.col("n") == 1, o).alias("bbox_1000"), o.alias("bbox"))
    df = raw_boxes(spark, d).withColumn("blk", b)
    box = B.export_box(F.col("blk"), F.col("width"), F.col("height"), F.when(F.col("p") % 5 == 0, 0).otherwise(1200), F.lit(1700), F.array(*map(F.lit, (100, 150, 1100, 1550))), F.col("p") % 2 == 0)
    return df.select("doc", "rid", F.array_join(F.transform(box, lambda v: v.cast("string")), ",").alias("bbox"))


@REGISTRY.query("p10_coordinate_mode", _RAW + """,
md AS (SELECT doc, page_id, max(width) AS width, max(height) AS height, bool_or((greatest(x1, x2) > 1050 AND greatest(x1, x2) <= mw * 1.05::DOUBLE) OR (greatest(y1, y2) > 1050 AND greatest(y1, y2) <= mh * 1.05::DOUBLE)) AS px
       FROM (SELECT *, max(width) OVER (PARTITION BY doc, page_id) AS mw, max(height) OVER (PARTITION BY doc, page_id) AS mh FROM rb) GROUP BY doc, page_id)
SELECT doc, page_id, CASE (doc + page_id) % 5 WHEN 0 THEN 'pixel' WHEN 1 THEN 'normalized_1000' ELSE CASE WHEN page_id = 4 OR px THEN 'pixel' ELSE 'normalized_1000' END END AS mode FROM md""")
def p10(spark, d):
    pages = raw_boxes(spark, d).groupBy("doc", "page_id").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.collect_list(G.Box.named().array()).alias("boxes"))
    declared = F.when((F.col("doc") + F.col("page_id")) % 5 == 0, " Absolute_Pixels ").when((F.col("doc") + F.col("page_id")) % 5 == 1, "0-1000").when(F.col("doc") % 2 == 0, "unknown")
    return pages.select("doc", "page_id", B.coordinate_mode(declared, F.col("boxes"), F.col("width"), F.col("height"), F.col("page_id") == 4).alias("mode"))


_KINDS = ("title", "list", "text", "figure", "chart", "bogus", "seal", "paragraph_title", "footnote", "other")
_KIND_SQL = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "][p % 10 + 1]"
_ALIAS_SQL = "CASE {k} WHEN 'list' THEN 'table_of_contents' WHEN 'title' THEN 'paragraph_title' WHEN 'figure_title' THEN 'caption' WHEN 'figure' THEN 'image' WHEN 'footnote' THEN 'vision_footnote' WHEN 'reference' THEN 'vision_footnote' WHEN 'other' THEN 'text' ELSE {k} END"


def _kind():
    return F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p") % 10 + 1).cast("int"))


@REGISTRY.query("p2_block_type", _RAW + f"\nSELECT doc, rid, {_ALIAS_SQL.format(k='kind')} AS block_type FROM (SELECT doc, rid, CASE WHEN n = 7 THEN 'text' ELSE {_KIND_SQL} END AS kind FROM rb)")
def p2(spark, d):
    raw = F.when(F.col("n") == 7, "").when(F.col("n") == 6, F.concat(F.lit("  "), _kind())).otherwise(_kind())
    return raw_boxes(spark, d).select("doc", "rid", T.block_type(raw).alias("block_type"))


@REGISTRY.query("p11_w12_normalized_blocks", _RAW + f""",
kd AS (SELECT *, {_ALIAS_SQL.format(k=_KIND_SQL)} AS kind, max(width) OVER (PARTITION BY doc, page_id) AS mw, max(height) OVER (PARTITION BY doc, page_id) AS mh FROM ob),
pxm AS (SELECT doc, page_id, bool_or((ax2 > 1050 AND ax2 <= mw * 1.05::DOUBLE) OR (ay2 > 1050 AND ay2 <= mh * 1.05::DOUBLE)) AS px FROM kd GROUP BY doc, page_id),
bx AS (SELECT kd.*, px, [least(greatest(round_even(ax1, 0), 0), CASE WHEN px THEN mw ELSE 1000 END), least(greatest(round_even(ay1, 0), 0), CASE WHEN px THEN mh ELSE 1000 END), least(greatest(round_even(ax2, 0), 0), CASE WHEN px THEN mw ELSE 1000 END), least(greatest(round_even(ay2, 0), 0), CASE WHEN px THEN mh ELSE 1000 END)] AS g
       FROM kd JOIN pxm USING (doc, page_id) WHERE kind <> 'bogus'),
ok AS (SELECT *, row_number() OVER (PARTITION BY doc, page_id ORDER BY rid) - 1 AS k FROM bx WHERE g[1] < g[3] AND g[2] < g[4])
SELECT doc, page_id, printf('p%03d_b%03d', page_id, k) AS id, kind AS block_type, CASE WHEN kind = 'chart' THEN 'about ' || CAST(p AS VARCHAR) ELSE '' END AS description,
       CASE WHEN kind = 'paragraph_title' THEN CASE WHEN p % 4 < 2 THEN 'H' || CAST(p % 4 + 1 AS VARCHAR) ELSE 'H2' END END AS level,
       CAST(CASE WHEN px THEN least(greatest(round_even(g[1] / mw * 1000, 0), 0), 1000) ELSE g[1] END AS INTEGER) AS gx1, CAST(CASE WHEN px THEN least(greatest(round_even(g[4] / mh * 1000, 0), 0), 1000) ELSE g[4] END AS INTEGER) AS gy2 FROM ok""")
def p11(spark, d):
    level = F.when(F.col("p") % 4 < 2, F.concat(F.lit("H"), (F.col("p") % 4 + 1).cast("string")))
    b = F.struct("rid", _kind().alias("block_type"), G.Box.named().array().alias("bbox"), F.concat(F.col("p").cast("string"), F.lit("、item")).alias("text"), level.alias("level"),
                 F.concat(F.lit("about "), F.col("p").cast("string")).alias("description"))
    pages = raw_boxes(spark, d).groupBy("doc", "page_id").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.array_sort(F.collect_list(b)).alias("blocks"))
    pages = pages.withColumns({"page_width": F.col("width"), "page_height": F.col("height"), "pixel_default": F.lit(False), "declared": F.lit("")})
    out = B.normalized_page_blocks(pages)
    return out.select("doc", "page_id", "id", "block_type", "description", "level", F.col("bbox_1000.x1").alias("gx1"), F.col("bbox_1000.y2").alias("gy2"))


_BLK = _RAW + f""",
bl AS (SELECT *, CASE WHEN n = 2 THEN NULL ELSE {_KIND_SQL} END AS label, CASE WHEN n = 2 THEN 'title' ELSE 'text' END AS bt, CASE WHEN n = 3 THEN NULL ELSE [ax1, ay1, ax2, ay2] END AS bbox, CASE WHEN p % 3 = 0 THEN 'H2' WHEN p % 3 = 1 THEN 'H9' END AS level, 'd' || CAST(p AS VARCHAR) AS description FROM ob),
lb AS (SELECT *, {_ALIAS_SQL.format(k="coalesce(label, bt)")} AS lab FROM bl)"""
_KNOWN = "(" + ", ".join(f"'{k}'" for k in T.BLOCK_TYPES) + ")"


def _blk(spark, d):
    o = G.Box.named().ordered().array()
    n, p = F.col("n"), F.col("p")
    b = F.struct(
        F.concat(F.lit("b"), F.col("rid").cast("string")).alias("id"), F.when(n == 3, F.lit(None)).otherwise(o).alias("bbox"), F.when(n == 1, o).alias("bbox_1000"), F.when(n == 2, "").otherwise(_kind()).alias("label"),
        F.when(n == 2, "title").otherwise("text").alias("block_type"), F.lit("t").alias("text"), F.concat(F.lit("d"), p.cast("string")).alias("description"), F.lit(None).cast("int").alias("page_id"),
        F.when(p % 5 == 0, "manual").alias("source"), F.lit(None).cast("boolean").alias("modified"), F.when(p % 3 == 0, "H2").when(p % 3 == 1, "H9").alias("level"), F.array(F.lit("text")).alias("modified_fields"),
    )
    return raw_boxes(spark, d).select("doc", "rid", "page_id", "p", "n", "width", "height", b.alias("b"))


_ints = lambda c: F.array_join(F.transform(c, lambda v: v.cast("int").cast("string")), ",")


@REGISTRY.query("p12_annotation_block", _BLK + f"""
SELECT doc, rid, lab2 AS label, CASE WHEN n = 3 THEN '0,0,1,1' ELSE array_to_string(list_transform(bbox, lambda v: CAST(trunc(v) AS INTEGER)), ',') END AS bbox, CASE WHEN lab2 = 'chart' THEN description ELSE '' END AS description,
       page_id, CASE WHEN p % 5 = 0 THEN 'manual' ELSE 'model' END AS source, p % 5 = 0 AS modified, CASE WHEN lab2 = 'paragraph_title' AND level = 'H2' THEN level END AS level
FROM (SELECT *, CASE WHEN lab IN {_KNOWN} THEN lab ELSE 'text' END AS lab2 FROM lb)""")
def p12(spark, d):
    df = _blk(spark, d).select("doc", "rid", B.annotation_block(F.col("b"), F.col("page_id")).alias("a"))
    return df.select("doc", "rid", "a.label", _ints(F.col("a.bbox")).alias("bbox"), "a.description", "a.page_id", "a.source", "a.modified", "a.level")


@REGISTRY.query("p13_export_block", _BLK + """
SELECT doc, rid, 'b' || CAST(rid AS VARCHAR) AS id, lab AS block_type, CASE WHEN n = 3 THEN '0,0,1,1' ELSE array_to_string(list_transform(bbox, lambda v: CAST(trunc(v) AS INTEGER)), ',') END AS bbox,
       CASE WHEN lab = 'chart' THEN description ELSE '' END AS description, CASE WHEN lab = 'paragraph_title' AND level = 'H2' THEN level END AS level FROM lb""")
def p13(spark, d):
    df = _blk(spark, d).select("doc", "rid", B.export_block(F.col("b")).alias("e"))
    return df.select("doc", "rid", "e.id", "e.block_type", _ints(F.col("e.bbox")).alias("bbox"), "e.description", "e.level")


@REGISTRY.query("p14_job_block", _BLK + f"""
SELECT doc, rid, k AS block_type, CASE WHEN k = 'chart' THEN description ELSE '' END AS description, CASE WHEN k = 'paragraph_title' AND level = 'H2' THEN level END AS level FROM (SELECT *, CASE WHEN lab IN {_KNOWN} THEN lab ELSE 'text' END AS k FROM lb)""")
def p14(spark, d):
    return _blk(spark, d).select("doc", "rid", B.job_block(F.col("b")).alias("e")).select("doc", "rid", "e.block_type", "e.description", "e.level")


@REGISTRY.query("p15_cli_block", _BLK + """
SELECT doc, rid, bt AS block_type, array_to_string(list_transform([ax1, ay1, ax2, ay2], lambda v: CAST(trunc(v) AS INTEGER)), ',') AS bbox FROM lb WHERE n <> 3""")
def p15(spark, d):
    df = _blk(spark, d).select("doc", "rid", B.cli_block(F.col("b"), F.col("rid")).alias("e")).where("e is not null")
    return df.select("doc", "rid", "e.block_type", _ints(F.col("e.bbox")).alias("bbox"))


@REGISTRY.query("p16_truth_bbox", _RAW + """
SELECT doc, rid, array_to_string([CAST(least(greatest(round_even(ax1 / width * 1000, 0), 0), 1000) AS INTEGER), CAST(least(greatest(round_even(ay1 / height * 1000, 0), 0), 1000) AS INTEGER),
       CAST(least(greatest(round_even(ax2 / width * 1000, 0), 0), 1000) AS INTEGER), CAST(least(greatest(round_even(ay2 / height * 1000, 0), 0), 1000) AS INTEGER)], ',') AS bbox FROM ob WHERE ax1 < ax2 AND ay1 < ay2""")
def p16(spark, d):
    df = raw_boxes(spark, d).withColumn("t", B.truth_box(G.Box.named().array(), F.col("width"), F.col("height"))).where("t is not null")
    return df.select("doc", "rid", _ints(F.col("t")).alias("bbox"))


@REGISTRY.query("j3_p21_seal_texts", V.with_views("gt") + """,
sb AS (SELECT *, CASE WHEN label = 'table' THEN 'seal' WHEN label IN ('text', 'image') THEN 'text' ELSE label END AS bt, CASE WHEN idx % 2 = 0 THEN ' 合同 专用章' WHEN idx % 3 = 0 THEN '公章' ELSE text END AS tx FROM gt)
SELECT doc, page_id, idx FROM sb b WHERE NOT (bt = 'text' AND regexp_full_match(replace(tx, ' ', ''), '(?:(?:合同|财务|发票|业务|行政|公司)?专用章|公章)') AND EXISTS (
  SELECT 1 FROM sb s WHERE s.bt = 'seal' AND s.doc = b.doc AND s.page_id = b.page_id AND greatest(0, least(b.x2, s.x2) - greatest(b.x1, s.x1)) * greatest(0, least(b.y2, s.y2) - greatest(b.y1, s.y1)) / ((b.x2 - b.x1) * (b.y2 - b.y1)) >= 0.5))""")
def j3(spark, d):
    gt = V.gt_blocks(spark, d)
    kind = F.when(F.col("label") == "table", "seal").when(F.col("label").isin("text", "image"), "text").otherwise(F.col("label"))
    text = F.when(F.col("idx") % 2 == 0, " 合同 专用章").when(F.col("idx") % 3 == 0, "公章").otherwise(F.col("text"))
    return B.without_seal_texts(gt.withColumns({"block_type": kind, "text": text})).select("doc", "page_id", "idx")


@REGISTRY.query("o1_a11_reading_order", _RAW + "\nSELECT doc, rid, CAST(row_number() OVER (PARTITION BY doc ORDER BY page_id, CAST(trunc(y1) AS INTEGER), CAST(trunc(x1) AS INTEGER), rid) AS INTEGER) AS ord FROM rb")
def o1(spark, d):
    return B.in_reading_order(raw_boxes(spark, d), tie="rid").select("doc", "rid", "ord")


@REGISTRY.query("o2_bbox_sort", _RAW + "\nSELECT doc, page_id, array_to_string(list(rid ORDER BY y1, x1, y2, x2, rid), ',') AS rids FROM rb GROUP BY doc, page_id")
def o2(spark, d):
    s = F.array_sort(F.collect_list(F.struct("y1", "x1", "y2", "x2", "rid")))
    return raw_boxes(spark, d).groupBy("doc", "page_id").agg(F.array_join(F.transform(s, lambda b: b["rid"].cast("string")), ",").alias("rids"))


@REGISTRY.query("p30_f33_segments", _RAW + """
SELECT doc, rid, round(least(greatest(ax1 / width * 100, 0), 100), 3) AS x, round(least(greatest(ay1 / height * 100, 0), 100), 3) AS y, round(least(greatest((ax2 - ax1) / width * 100, 0), 100), 3) AS w, round(least(greatest((ay2 - ay1) / height * 100, 0), 100), 3) AS h FROM ob""")
def p30(spark, d):
    return raw_boxes(spark, d).select("doc", "rid", B.segment(G.Box.named().ordered(), F.col("width"), F.col("height")).alias("s")).select("doc", "rid", "s.*")


@REGISTRY.query("p25_percent_boxes", _RAW + """,
pc AS (SELECT *, x1 / width * 100 AS a, y1 / height * 100 AS b, x2 / width * 100 AS c, y2 / height * 100 AS e FROM rb)
SELECT doc, rid, a AS px1, e AS py2, CAST(trunc(a * width / 100) AS INTEGER) AS x1, CAST(trunc(e * height / 100) AS INTEGER) AS y2 FROM pc""")
def p25(spark, d):
    df = raw_boxes(spark, d).withColumn("q", B.to_percent(G.Box.named(), F.col("width"), F.col("height")))
    df = df.withColumn("r", B.from_percent(G.Box.of(F.col("q")), F.col("width"), F.col("height")))
    return df.select("doc", "rid", F.col("q.x1").alias("px1"), F.col("q.y2").alias("py2"), F.col("r.x1").alias("x1"), F.col("r.y2").alias("y2"))


@REGISTRY.query("p35_moved_boxes", _RAW + """,
mv AS (SELECT *, least(greatest(ax1 + 40, 0), greatest(width - (ax2 - ax1), 0)) AS x, least(greatest(ay1 - 30, 0), greatest(height - (ay2 - ay1), 0)) AS y FROM ob)
SELECT doc, rid, x AS x1, y AS y1, x + (ax2 - ax1) AS x2, y + (ay2 - ay1) AS y2 FROM mv""")
def p35(spark, d):
    return _flat(raw_boxes(spark, d).withColumn("b", B.moved(G.Box.named().ordered(), F.lit(40), F.lit(-30), F.col("width"), F.col("height"))))


@REGISTRY.query("p36_edit_provenance", _BLK + "\nSELECT doc, rid, CASE WHEN p % 5 = 0 THEN 'manual' ELSE 'human_verified' END AS source, 'text,bbox' AS fields FROM lb")
def p36(spark, d):
    df = _blk(spark, d).select("doc", "rid", B.edited(F.col("b"), ["bbox", "text"]).alias("e"))
    return df.select("doc", "rid", "e.source", F.array_join("e.modified_fields", ",").alias("fields"))


@REGISTRY.query("p29_f18_smart_size", _RAW + """,
s0 AS (SELECT doc, rid, width, height, greatest(4096, p * 997 % 900000) AS most, greatest(32, CAST(round_even(width / 32, 0) AS INTEGER) * 32) AS w, greatest(32, CAST(round_even(height / 32, 0) AS INTEGER) * 32) AS h FROM rb),
s1 AS (SELECT *, CASE WHEN w * h > most THEN greatest(32, CAST(floor(width / sqrt(width * height / most) / 32) AS INTEGER) * 32) ELSE w END AS w1, CASE WHEN w * h > most THEN greatest(32, CAST(floor(height / sqrt(width * height / most) / 32) AS INTEGER) * 32) ELSE h END AS h1 FROM s0)
SELECT doc, rid, CASE WHEN w1 * h1 > most THEN greatest(32, CAST(floor(w1 / sqrt(w1 * h1 / most) / 32) AS INTEGER) * 32) ELSE w1 END AS width, CASE WHEN w1 * h1 > most THEN greatest(32, CAST(floor(h1 / sqrt(w1 * h1 / most) / 32) AS INTEGER) * 32) ELSE h1 END AS height FROM s1""")
def p29(spark, d):
    return raw_boxes(spark, d).select("doc", "rid", T.smart_size(F.col("width"), F.col("height"), F.col("p") * 997 % 900000).alias("s")).select("doc", "rid", "s.*")


@REGISTRY.query("p28_clamp_int", _RAW + "\nSELECT doc, rid, CASE WHEN n = 1 THEN 180 ELSE CAST(least(greatest(p % 400, 72), 300) AS INTEGER) END AS dpi FROM rb")
def p28(spark, d):
    raw = F.when(F.col("n") == 1, "abc").otherwise(F.concat(F.lit(" "), (F.col("p") % 400).cast("string")))
    return raw_boxes(spark, d).select("doc", "rid", T.clamp_int(raw, 180, 72, 300).alias("dpi"))


@REGISTRY.query("p19_resolved_input", _RAW + "\nSELECT doc, rid, CASE WHEN n = 1 THEN 'sys' ELSE '' END AS system, CASE WHEN n = 1 THEN '' WHEN n = 2 THEN 'second' ELSE '当前页面 page_id=' || CAST(page_id AS VARCHAR) || '，图像尺寸为 ' || CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR) || '。' END AS user FROM rb")
def p19(spark, d):
    put = lambda s, u: F.struct(s.alias("system"), u.alias("user"))
    a = put(F.when(F.col("n") == 1, "sys").otherwise(""), F.lit(None).cast("string"))
    b = F.when(F.col("n") == 2, put(F.lit(None).cast("string"), F.lit("second")))
    return raw_boxes(spark, d).select("doc", "rid", B.resolved_input([a, b], F.col("page_id"), F.col("width"), F.col("height")).alias("i")).select("doc", "rid", "i.*")


# --- texts -------------------------------------------------------------------------------------------------------------


def _docs(spark, d):
    return V.table(spark, d, "documents").select("doc_id", "text")


@REGISTRY.query("f2_normalized_span", r"""SELECT doc_id, regexp_replace(replace(replace(text, '責任', '责任'), '行為', '行为'), '\s+|---|#{1,6}', '', 'g') AS span FROM documents""")
def f2(spark, d):
    return _docs(spark, d).select("doc_id", T.normalized_span(F.col("text")).alias("span"))


@REGISTRY.query("f3_clip", r"""SELECT doc_id, CASE WHEN len(t) > 40 THEN left(t, 40) || '…' ELSE t END AS clipped FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def f3(spark, d):
    return _docs(spark, d).select("doc_id", T.clip(F.col("text")).alias("clipped"))


_ANSWERS = """
WITH a AS (
  SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN '<think>{"x": 1}</think > ' || chr(10) || text WHEN 1 THEN 'x</THINK>y</think>' || text ELSE text END AS raw,
         '{"blocks": [{"text": "' || CAST(conv_id AS VARCHAR) || ' } {", "k": ' || CAST(turn AS VARCHAR) || '}]}' AS obj FROM conversations),
m AS (SELECT *, CASE turn % 3 WHEN 0 THEN 'Old ```json {"a": 1} ``` then ```json' || chr(10) || obj || chr(10) || '``` end' WHEN 1 THEN '```' || chr(10) || obj || chr(10) || '```' ELSE 'Draft {"b": 2} so ' || obj || ' done' END AS msg FROM a)"""


def _answers(spark, d):
    c = V.table(spark, d, "conversations")
    t = F.col("turn")
    raw = F.when(t % 4 == 0, F.concat(F.lit('<think>{"x": 1}</think > \n'), "text")).when(t % 4 == 1, F.concat(F.lit("x</THINK>y</think>"), "text")).otherwise(F.col("text"))
    obj = F.concat(F.lit('{"blocks": [{"text": "'), F.col("conv_id").cast("string"), F.lit(' } {", "k": '), t.cast("string"), F.lit("}]}"))
    c = c.select("conv_id", "turn", "text", raw.alias("raw"), obj.alias("obj"))
    msg = F.when(t % 3 == 0, F.concat(F.lit('Old ```json {"a": 1} ``` then ```json\n'), "obj", F.lit("\n``` end"))).when(t % 3 == 1, F.concat(F.lit("```\n"), "obj", F.lit("\n```")))
    return c.withColumn("msg", msg.otherwise(F.concat(F.lit('Draft {"b": 2} so '), "obj", F.lit(" done"))))


@REGISTRY.query("f4_after_thinking", _ANSWERS + r"""
SELECT conv_id, turn, CASE WHEN turn % 4 < 2 THEN regexp_replace(text, '^\s+', '') ELSE text END AS answer FROM m""")
def f4(spark, d):
    return _answers(spark, d).select("conv_id", "turn", T.after_thinking(F.col("raw")).alias("answer"))


@REGISTRY.query("f5_fences", _ANSWERS + "\nSELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN obj END AS fenced, CASE WHEN turn % 3 = 1 THEN obj ELSE msg END AS plain FROM m")
def f5(spark, d):
    return _answers(spark, d).select("conv_id", "turn", J.last_json_fence(F.col("msg")).alias("fenced"), J.without_fence(F.col("msg")).alias("plain"))


@REGISTRY.query("f6_last_object", _ANSWERS + "\nSELECT conv_id, turn, obj AS found FROM m")
def f6(spark, d):
    return _answers(spark, d).select("conv_id", "turn", J.last_object(F.col("msg")).alias("found"))


@REGISTRY.query("f7_model_json", _ANSWERS + "\nSELECT conv_id, turn, obj AS payload FROM m")
def f7(spark, d):
    return _answers(spark, d).select("conv_id", "turn", J.model_object(F.col("msg")).alias("payload"))


@REGISTRY.query("f30_review_decision", """
SELECT event_id, CASE WHEN event_id % 4 < 2 THEN event_id % 2 = 0 END AS deeper, CASE WHEN event_id % 4 = 3 THEN 0.0 ELSE CASE WHEN event_id % 4 < 2 THEN least(greatest(round(value, 1), 0), 1) ELSE round(value, 1) END END AS confidence FROM events""")
def f30(spark, d):
    e = V.table(spark, d, "events")
    k, v = F.col("event_id") % 4, F.round("value", 1)
    word = F.when(k == 0, "deeper").when(k == 1, "KEEP").otherwise("maybe")
    text = F.when(k == 3, "no json here").otherwise(F.concat(F.lit('<think>x</think> ok {"decision": "'), word, F.lit('", "confidence": '), v.cast("string"), F.lit("}")))
    return e.select("event_id", J.review_decision(text).alias("r")).select("event_id", "r.*")


@REGISTRY.query("f20_render_prompt", r"""
SELECT event_id, 'User ' || CAST(user_id AS VARCHAR) || ' did ' || event_type || ' ($1) ' || '' || ' end' AS prompt FROM events""")
def f20(spark, d):
    e = V.table(spark, d, "events")
    values = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("what"), F.concat("event_type", F.lit(" ($1)")))
    return e.select("event_id", T.render(F.lit("User {{user}} did {{ what }} {{missing}} end"), values).alias("prompt"))


@REGISTRY.query("f22_next_version", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'v1.1' ELSE 'v' || CAST(event_id % 3 AS VARCHAR) || '.' || CAST(event_id % 12 + 1 AS VARCHAR) END AS version FROM events")
def f22(spark, d):
    i = F.col("event_id")
    raw = F.when(i % 3 == 0, "draft").otherwise(F.concat(F.lit("v"), (i % 3).cast("string"), F.lit("."), (i % 12).cast("string")))
    return V.table(spark, d, "events").select("event_id", T.next_version(raw).alias("version"))


@REGISTRY.query("f23_revision", "SELECT doc_id, left(sha256(text), 16) AS revision FROM documents")
def f23(spark, d):
    return _docs(spark, d).select("doc_id", T.revision(F.col("text")).alias("revision"))


@REGISTRY.query("f24_data_url", "SELECT page_id, 'data:image/png;base64,' || base64(encode(html)) AS url FROM pages")
def f24(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.regexp_replace(T.data_url(F.col("html").cast("binary")), r"[\r\n]", "").alias("url"))


@REGISTRY.query("f25_image_token", "SELECT conv_id, turn, '<image>' || chr(10) || text AS user FROM conversations")
def f25(spark, d):
    c = V.table(spark, d, "conversations")
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<image>\n"), "text")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", T.with_image_token(raw).alias("user"))


@REGISTRY.query("s8_document_key", r"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Report ' || CAST(page_id AS VARCHAR) WHEN page_id % 3 = 1 THEN 'job' || CAST(page_id AS VARCHAR) ELSE 'page_' || CAST(page_id AS VARCHAR) END AS key FROM pages""")
def s8(spark, d):
    i = F.col("page_id")
    name = F.when(i % 3 == 0, F.concat(F.lit(" /up/Report "), i.cast("string"), F.lit(".pdf ")))
    path = F.when(i % 3 == 1, F.concat(F.lit("/data/job"), i.cast("string"), F.lit("/result.json"))).otherwise(F.concat(F.lit("/data/x/page_"), i.cast("string"), F.lit(".json")))
    return V.table(spark, d, "pages").select("page_id", T.document_key([name, F.lit("")], path).alias("key"))


@REGISTRY.query("s10_failed_pages", "SELECT event_id % 50 AS doc, CAST(user_id % 40 AS INTEGER) AS page_id FROM events WHERE event_type = 'error' GROUP BY ALL")
def s10(spark, d):
    e = V.table(spark, d, "events")
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("第 "), (F.col("user_id") % 40 + 1).cast("string"), F.lit(" 页分析失败: timeout"))).otherwise("other")
    return e.select((F.col("event_id") % 50).alias("doc"), T.failed_page(text).alias("page_id")).where("page_id is not null").distinct()


@REGISTRY.query("p26_image_id", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'img_20240101123456_0a1b2c' ELSE 'photo.v' || CAST(event_id AS VARCHAR) END AS image_id FROM events")
def p26(spark, d):
    i = F.col("event_id")
    name = F.when(i % 2 == 0, F.concat(F.lit("img_20240101123456_0a1b2c_"), i.cast("string"), F.lit(".png"))).otherwise(F.concat(F.lit("photo.v"), i.cast("string"), F.lit(".png")))
    return V.table(spark, d, "events").select("event_id", T.image_id(name).alias("image_id"))


@REGISTRY.query("p27_safe_names", r"""
SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.\-一-鿿]+', '_', 'g'), '^[._ ]+|[._ ]+$', '', 'g'), ''), 'dataset') AS safe,
       regexp_replace(regexp_replace(lower(url), '[^a-z0-9_\-]+', '_', 'g'), '^_+|_+$', '', 'g') AS template FROM pages""")
def p27(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("safe"), T.template_id(F.col("url")).alias("template"))


@REGISTRY.query("k10_f32_relative_paths", "SELECT page_id, 'datasets/a/' || CAST(page_id AS VARCHAR) || '.png and x/datasets' AS text FROM pages")
def k10(spark, d):
    raw = F.concat(F.lit("/srv/app/backend/datasets/a/"), F.col("page_id").cast("string"), F.lit(".png and /srv/app/x/datasets"))
    return V.table(spark, d, "pages").select("page_id", T.relative_path(raw, {"/srv/app": "", "/srv/app/backend/datasets": "datasets", "/srv/app/backend": "backend"}).alias("text"))


_CONTAINED = "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"


def _passages(spark, d):
    return V.table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))


@REGISTRY.query("j14_containment", _CONTAINED)
def j14(spark, d):
    """Benchmark passages that documents contain verbatim."""
    return contained(_docs(spark, d), _passages(spark, d))


@REGISTRY.query("j14_containment_by_anchor", _CONTAINED)
def j14_anchor(spark, d):
    """The same by the way of lists too long to broadcast."""
    return contained(_docs(spark, d), _passages(spark, d), broadcast_bytes=0)


@REGISTRY.query("f1_fold_text")
def f1(spark, d):
    """NFKC folding; DuckDB has no NFKC, so the tests hold it against plain Python."""
    return _docs(spark, d).select("doc_id", T.fold_text(F.col("text")).alias("folded"))


@REGISTRY.query("f1_folded_blocks", V.with_views("gt", "hd") + """,
t AS (
  SELECT doc, idx AS k, 'block' AS kind, text || '，' || level || '（' || label || '）' AS text FROM gt UNION ALL SELECT doc, ord, 'heading', text || '：“A-1”' FROM hd)
SELECT doc, k, kind, regexp_replace(lower(text), '[^0-9a-z一-鿿]', '', 'g') AS folded FROM t""")
def f1_folded(spark, d):
    """Folding of ASCII and Han texts with their punctuation, where NFKC changes nothing that stays."""
    gt = V.gt_blocks(spark, d).select("doc", F.col("idx").cast("long").alias("k"), F.lit("block").alias("kind"), F.concat("text", F.lit("，"), "level", F.lit("（"), "label", F.lit("）")).alias("text"))
    hd = V.headings(spark, d).select("doc", F.col("ord").cast("long"), F.lit("heading"), F.concat("text", F.lit("：“A-1”")))
    return gt.union(hd).select("doc", "k", "kind", T.fold_text(F.col("text")).alias("folded"))


@REGISTRY.query("a8_shared_characters", r"""
WITH p AS (SELECT a.doc_id, regexp_replace(lower(a.text), '[^a-z0-9]', '', 'g') AS x, regexp_replace(lower(b.text), '[^a-z0-9]', '', 'g') AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.lang = 'en' AND b.lang = 'en')
SELECT doc_id, CAST(coalesce(list_sum(list_transform(list_filter(list_distinct(string_split(x, '')), lambda c: c <> ''), lambda c: least(len(x) - len(replace(x, c, '')), len(y) - len(replace(y, c, ''))))), 0) AS INTEGER) AS common FROM p""")
def a8(spark, d):
    from leafgrid.operators.matching import shared_characters

    docs = V.table(spark, d, "documents").where("lang = 'en'").select("doc_id", F.regexp_replace(F.lower("text"), "[^a-z0-9]", "").alias("x"))
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y"))
    return docs.join(nxt, "doc_id").select("doc_id", shared_characters(F.col("x"), F.col("y")).alias("common"))
