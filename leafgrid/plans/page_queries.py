"""Queries of page and job projections, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrid.operators import pages as P
from leafgrid.plans import tables
from leafgrid.plans.registry import Registry
from leafgrid.sources import views as V

REGISTRY = Registry()


def _pages(spark, d):
    i = F.col("page_id")
    url = F.when(i % 3 == 0, F.concat(F.lit("/jobs/m/j"), i.cast("string"), F.lit("/pages/p.png"))).when(i % 3 == 1, "pages/q.png")
    page = F.struct(i.cast("int").alias("page_id"), url.alias("image_url"), F.lit("/pages/r.png").alias("image_path"), (i % 900 + 100).cast("int").alias("width"), F.when(i % 2 == 0, F.lit(1400)).alias("height"),
                    F.lit(None).cast("int").alias("model_width"), F.lit(7).alias("model_height"))
    return V.table(spark, d, "pages").select("page_id", F.concat(F.lit("j"), i.cast("string")).alias("job"), page.alias("page"))


@REGISTRY.query("p17_layout_pages", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'pages/p.png' ELSE 'pages/r.png' END AS image_path, CASE WHEN page_id % 3 = 0 THEN '/jobs/m/j' || CAST(page_id AS VARCHAR) || '/pages/p.png' WHEN page_id % 3 = 1 THEN 'pages/q.png' ELSE '' END AS image_url,
       CAST(page_id % 900 + 100 AS INTEGER) AS width, CASE WHEN page_id % 2 = 0 THEN 1400 ELSE 0 END AS height, 7 AS model_height FROM pages""")
def p17(spark, d):
    out = _pages(spark, d).select("page_id", P.layout_page(F.col("page"), F.col("job")).alias("l"))
    return out.select("page_id", "l.image_path", "l.image_url", "l.width", "l.height", "l.model_height")


@REGISTRY.query("p18_qa_entries", "SELECT conv_id, turn, '' AS system, role AS user, regexp_replace(text, '^\\s+', '') AS assistant FROM conversations")
def p18(spark, d):
    c = V.table(spark, d, "conversations")
    e = P.qa_entry(F.col("turn"), F.lit("p.png"), F.lit(None).cast("string"), F.col("role"), F.concat(F.lit("<think>z</think>"), "text"))
    return c.select("conv_id", "turn", e.alias("e")).select("conv_id", "turn", "e.system", "e.user", "e.assistant")


@REGISTRY.query("r7_uses_model_page", "SELECT page_id, page_id % 4 IN (0, 1) AS on_model FROM pages")
def r7(spark, d):
    i = F.col("page_id") % 4
    image = F.when(i == 0, "model_pages/a.png").when(i == 1, "x/m.png").when(i == 2, "pages/a.png")
    return V.table(spark, d, "pages").select("page_id", P.uses_model_page(image, F.lit("x/m.png")).alias("on_model"))


@REGISTRY.query("f27_coordinate_instruction", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '请输出当前 ' || page_id || 'x900 模型图像上的绝对像素 bbox，x 坐标范围为 0-' || page_id || '，y 坐标范围为 0-900，不要输出 0-1000 相对坐标；最终 JSON 顶层必须包含 "coordinate_mode": "pixel"。'
       ELSE '请严格输出 0-1000 相对坐标 bbox，不要输出像素坐标；最终 JSON 顶层必须包含 "coordinate_mode": "normalized_1000"。' END AS text FROM pages""")
def f27(spark, d):
    return V.table(spark, d, "pages").select("page_id", P.coordinate_instruction(F.col("page_id"), F.lit(900), F.col("page_id") % 2 == 0).alias("text"))


@REGISTRY.query("r6_review_strips", V.with_views("gt") + """
SELECT doc, idx, CAST(greatest(y1 - 240, 0) AS INTEGER) AS top, CAST(least(1000, greatest(y2 + 240, greatest(y1 - 240, 0) + 320)) AS INTEGER) AS bottom FROM gt""")
def r6(spark, d):
    return V.gt_blocks(spark, d).select("doc", "idx", P.review_strip(F.col("y1"), F.col("y2"), F.lit(1000)).alias("s")).select("doc", "idx", "s.top", "s.bottom")


@REGISTRY.query("r3_left_edges", V.with_views("gt") + "\nSELECT doc, idx, CASE WHEN idx % 3 <> 0 THEN x1 END AS left_edge FROM gt")
def r3(spark, d):
    box = F.when(F.col("idx") % 3 != 0, F.array("x1", "y1", "x2", "y2")).otherwise(F.array("x1"))
    return V.gt_blocks(spark, d).select("doc", "idx", P.left_edge(box).alias("left_edge"))


@REGISTRY.query("r16_public_config", "SELECT c_custkey, c_name AS model, CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS has_api_key FROM customer")
def r16(spark, d):
    c = F.struct(F.lit("u").alias("base_url"), F.col("c_name").alias("model"), F.when(F.col("c_custkey") % 2 == 0, "secret").otherwise("").alias("api_key"))
    return V.table(spark, d, "customer").select("c_custkey", P.public_config(c).alias("p")).select("c_custkey", "p.model", "p.has_api_key")


@REGISTRY.query("r18_asset_paths", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'a' END AS path FROM pages")
def r18(spark, d):
    i = F.col("page_id") % 4
    files = F.when(i == 0, F.array(*map(F.lit, "cba"))).when(i == 1, F.array(*map(F.lit, "cb"))).when(i == 2, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>"))
    return V.table(spark, d, "pages").select("page_id", P.asset_path(F.lit("a"), F.lit("b"), F.lit("c"), files).alias("path"))


@REGISTRY.query("r28_cleaned_errors", "SELECT page_id, CASE WHEN page_id % 5 = 2 THEN 'other' ELSE '第 3 页失败|other' END AS errors FROM pages")
def r28(spark, d):
    errors = F.array(F.lit("第 3 页失败"), F.lit("other"))
    return V.table(spark, d, "pages").select("page_id", F.array_join(P.cleaned_errors(errors, (F.col("page_id") % 5).cast("int")), "|").alias("errors"))


@REGISTRY.query("r33_deletions", tables._JOBS + "\nSELECT job_id, CASE WHEN annotation_type = 'bounding_box' THEN 'box' ELSE 'layout' END AS route FROM jb")
def r33(spark, d):
    layout, box = P.deletions(tables.jobs(spark, d))
    return layout.select("job_id", F.lit("layout").alias("route")).union(box.select("job_id", F.lit("box").alias("route")))


@REGISTRY.query("r36_repaired_labels", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'image,text' ELSE 'image,text,seal' END AS labels FROM pages")
def r36(spark, d):
    labels = F.when(F.col("page_id") % 2 == 0, F.array(*map(F.lit, ("figure", "other", "image", "text")))).otherwise(F.array(*map(F.lit, ("image", "text", "seal", "figure"))))
    return V.table(spark, d, "pages").select("page_id", F.array_join(P.repaired_labels(labels), ",").alias("labels"))


@REGISTRY.query("r37_projects", tables._JOBS + "\nSELECT job_id, coalesce(nullif(filename, ''), job_id) AS name, CASE WHEN page_count > 0 THEN CAST(floor(completed_pages / page_count * 100 + 0.5) AS BIGINT) ELSE 0 END AS progress, page_count > 0 AS open FROM jb")
def r37(spark, d):
    return P.project_row(tables.jobs(spark, d))


@REGISTRY.query("k4_snapshots", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'draft.json' WHEN 'view' THEN 'annotation.json' ELSE 'annotation_v2_' || strftime(ts, '%Y%m%d_%H%M%S') || '.json' END AS target,
       CASE event_type WHEN 'click' THEN 'second_annotating' WHEN 'view' THEN 'first_annotated' ELSE 'second_annotated' END AS annotation_status FROM events""")
def k4(spark, d):
    mode = F.when(F.col("event_type") == "click", "draft").when(F.col("event_type") == "view", "overwrite").otherwise("submit")
    return P.snapshots(V.table(spark, d, "events"), mode, F.date_format("ts", "yyyyMMdd_HHmmss")).select("event_id", "target", "annotation_status")


@REGISTRY.query("s2_r23_lookup", tables._JOBS + "\nSELECT job_id, status FROM jb WHERE job_id = 'j7' LIMIT 1")
def s2(spark, d):
    return P.first_match(tables.jobs(spark, d), "job_id", "j7", "k").select("job_id", "status")


@REGISTRY.query("o10_best_tuple", V.with_views("gt") + "\nSELECT doc, page_id, arg_max(idx, (x2 - x1) * 1e9 + (y2 - y1) * 1e5 + idx) AS best FROM gt GROUP BY ALL")
def o10(spark, d):
    best = F.max(F.struct((F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), "idx"))
    return V.gt_blocks(spark, d).groupBy("doc", "page_id").agg(best["idx"].alias("best"))
