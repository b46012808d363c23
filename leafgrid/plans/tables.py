"""Queries of catalogs, exports, quality checks, table changes and streams, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrid.functions import jsonx as J
from leafgrid.functions import text as T
from leafgrid.operators import blocks as B
from leafgrid.operators import catalog as C
from leafgrid.operators import export as X
from leafgrid.operators import hierarchy as H
from leafgrid.operators import quality as Q
from leafgrid.plans.headings import outline_sql
from leafgrid.plans.registry import Registry
from leafgrid.sources import readers as R
from leafgrid.sources import views as V
from leafgrid.sources.shared import checkpointed
from leafgrid.sources.versions import VersionedTable
from leafgrid.streaming import incremental as S

REGISTRY = Registry()
NOW = 1_700_000_000


def jobs(spark, d):
    """Job summaries from orders."""
    o = V.table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(F.col("o_orderstatus") == "F", F.element_at(F.array(*map(F.lit, ("complete", "Done", "completed"))), (k % 3 + 1).cast("int"))).when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    pages = (c % 7 * F.when(k % 11 == 0, 1000).otherwise(1)).cast("int")
    return o.select(
        F.concat(F.lit("j"), k.cast("string")).alias("job_id"), F.when(k % 4 == 0, F.concat(F.lit("d"), k.cast("string"))).alias("dataset_id"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("File"), (c % 90).cast("string"), F.lit(".pdf"))).alias("filename"),
        status.alias("status"), pages.alias("page_count"), (pages * 2 / 3).cast("int").alias("completed_pages"), (k % 50).cast("int").alias("block_count"), (F.lit(NOW) - k * 977 % 4_000_000).cast("long").alias("updated_at"),
        F.when(k % 6 == 0, "second_annotated").when(k % 6 == 1, "none").alias("annotation_status"), F.when(k % 8 == 0, "bounding_box").alias("annotation_type"), F.concat(F.lit("m"), (c % 3).cast("string")).alias("model"), k.alias("k"), c.alias("c"),
    )


_JOBS = f"""
WITH jb AS (
  SELECT 'j' || CAST(k AS VARCHAR) AS job_id, CASE WHEN k % 4 = 0 THEN 'd' || CAST(k AS VARCHAR) END AS dataset_id, CASE WHEN k % 5 = 0 THEN '' ELSE 'File' || CAST(c % 90 AS VARCHAR) || '.pdf' END AS filename,
         CASE WHEN o_orderstatus = 'F' THEN ['complete', 'Done', 'completed'][k % 3 + 1] WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'running' END AS status,
         CAST(c % 7 * CASE WHEN k % 11 = 0 THEN 1000 ELSE 1 END AS INTEGER) AS page_count, CAST(trunc(CAST(c % 7 * CASE WHEN k % 11 = 0 THEN 1000 ELSE 1 END AS INTEGER) * 2 / 3) AS INTEGER) AS completed_pages,
         CAST(k % 50 AS INTEGER) AS block_count, {NOW} - k * 977 % 4000000 AS updated_at, CASE WHEN k % 6 = 0 THEN 'second_annotated' WHEN k % 6 = 1 THEN 'none' END AS annotation_status,
         CASE WHEN k % 8 = 0 THEN 'bounding_box' END AS annotation_type, 'm' || CAST(c % 3 AS VARCHAR) AS model, k, c
  FROM (SELECT *, o_orderkey AS k, o_custkey AS c FROM orders)),
cd AS (
  SELECT coalesce(dataset_id, job_id) AS id, coalesce(nullif(filename, ''), 'Dataset ' || coalesce(dataset_id, job_id)) AS name, CASE WHEN annotation_type = 'bounding_box' THEN 'Bounding Box' ELSE 'PDF Layout' END AS category,
         CASE WHEN page_count >= 1000 THEN printf('%.1fK', page_count / 1000.0::DOUBLE) ELSE CAST(page_count AS VARCHAR) END AS amount, CASE WHEN page_count = 1 THEN 'page' ELSE 'pages' END AS amount_label,
         CASE WHEN lower(status) IN ('complete', 'completed', 'done') THEN 'Completed' WHEN status = 'failed' THEN 'Error' ELSE 'Running' END AS st, {NOW} - updated_at AS ago, updated_at, page_count, completed_pages, block_count, model,
         coalesce(annotation_type, 'layout') AS annotation_type, CASE WHEN annotation_status IS NOT NULL AND annotation_status <> 'none' THEN annotation_status WHEN lower(status) IN ('complete', 'completed', 'done') THEN 'first_annotated' ELSE 'none' END AS annotation_status, k
  FROM jb)"""
_CARD = """
SELECT id, name, category, amount, amount_label, st AS status,
       CASE WHEN ago < 60 THEN 'Updated just now' WHEN ago < 3600 THEN 'Updated ' || CAST(ago // 60 AS VARCHAR) || ' minutes ago' WHEN ago < 86400 THEN 'Updated ' || CAST(ago // 3600 AS VARCHAR) || ' hours ago'
            WHEN ago < 2592000 THEN 'Updated ' || CAST(ago // 86400 AS VARCHAR) || ' days ago' ELSE CAST(year(make_timestamp(updated_at * 1000000)) AS VARCHAR) || '/' || CAST(month(make_timestamp(updated_at * 1000000)) AS VARCHAR) || '/' || CAST(day(make_timestamp(updated_at * 1000000)) AS VARCHAR) END AS updated,
       CASE WHEN st = 'Running' THEN CASE WHEN page_count > 0 THEN CAST(floor(completed_pages / page_count * 100 + 0.5) AS BIGINT) ELSE 0 END END AS progress,
       CASE WHEN st = 'Running' THEN CAST(completed_pages AS VARCHAR) || '/' || CAST(page_count AS VARCHAR) || ' pages processed' END AS progress_label, block_count, page_count, model, annotation_status, annotation_type FROM cd"""


def _cards(spark, d):
    return C.cards(jobs(spark, d), F.lit(NOW))


@REGISTRY.query("p31_dataset_cards", _JOBS + _CARD)
def p31(spark, d):
    return _cards(spark, d)


@REGISTRY.query("p32_filtered_cards", _JOBS + "\nSELECT id, name, st AS status FROM cd WHERE annotation_type = 'layout' AND st = 'Completed' AND contains(lower(name || ' ' || category || ' ' || amount_label || ' ' || model), 'file1')")
def p32(spark, d):
    return C.filter_cards(_cards(spark, d), "PDF Layout", "Completed", "File1").select("id", "name", "status")


@REGISTRY.query("p33_search_projects", _JOBS + "\nSELECT id, name FROM cd WHERE contains(lower(name), '.pdf') AND contains(lower(name), '7')")
def p33(spark, d):
    return _cards(spark, d).where(F.lower("name").contains(".pdf") & F.lower("name").contains("7")).select("id", "name")


@REGISTRY.query("r34_convertible", _JOBS + "\nSELECT id, st = 'Completed' AND annotation_status IN ('first_annotated', 'second_annotated') AS convertible FROM cd")
def r34(spark, d):
    return C.convertible(_cards(spark, d)).select("id", "convertible")


@REGISTRY.query("a16_dashboard_totals", _JOBS + "\nSELECT CAST(sum(page_count) AS BIGINT) AS total_pages, CAST(sum(block_count) AS BIGINT) AS total_blocks, count(*) FILTER (st = 'Completed') AS completed FROM cd")
def a16(spark, d):
    return C.dashboard(_cards(spark, d))


@REGISTRY.query("a18_batch_progress", _JOBS + "\nSELECT model, CAST(sum(page_count) AS BIGINT) AS pages, CAST(sum(completed_pages) AS BIGINT) AS done FROM jb GROUP BY model")
def a18(spark, d):
    return C.batch_progress(jobs(spark, d), ["model"])


@REGISTRY.query("o3_recent_jobs", _JOBS + "\nSELECT job_id, updated_at FROM jb ORDER BY updated_at DESC, job_id LIMIT 6")
def o3(spark, d):
    return jobs(spark, d).select("job_id", "updated_at").orderBy(F.col("updated_at").desc(), "job_id").limit(6)


@REGISTRY.query("a10_job_counts", V.with_views("gt") + ",\nbp AS (SELECT doc, page_id, count(*) AS n FROM gt GROUP BY ALL)\nSELECT doc AS job_id, count(*) AS page_count, count(*) FILTER ((doc + page_id) % 3 <> 2) AS completed_pages, CAST(sum(n) AS BIGINT) AS block_count, count(*) FILTER ((doc + page_id) % 3 = 1) AS error_count FROM bp GROUP BY doc")
def a10(spark, d):
    pages = V.gt_blocks(spark, d).groupBy("doc", "page_id").agg(F.collect_list("idx").alias("blocks"))
    k = (F.col("doc") + F.col("page_id")) % 3
    return C.job_counts(pages.select(F.col("doc").alias("job_id"), F.when(k == 0, "done").when(k == 1, "error").otherwise("pending").alias("status"), "blocks"))


@REGISTRY.query("j12_r14_summaries", _JOBS + """
SELECT jb.job_id, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'second_annotating' WHEN lower(status) IN ('complete', 'completed', 'done') THEN 'first_annotated' ELSE 'none' END AS annotation_status,
       CASE WHEN k % 2 = 0 THEN 'success' ELSE 'none' END AS convert_status, CASE WHEN k % 2 = 0 THEN greatest(updated_at, 1699990000) ELSE updated_at END AS updated_at FROM jb""")
def j12(spark, d):
    j = jobs(spark, d)
    states = j.where("k % 2 = 0").select("job_id", F.when(F.col("k") % 3 == 0, "second_annotating").otherwise("none").alias("annotation_status"), F.lit("success").alias("convert_status"), F.array(F.lit("swift")).alias("converted_formats"), F.lit(1699990000).alias("updated_at"))
    return C.summaries(j.drop("annotation_status"), states).select("job_id", "annotation_status", "convert_status", "updated_at")


@REGISTRY.query("j13_resolved_ids", _JOBS + """,
w AS (SELECT job_id AS wanted FROM jb WHERE k % 10 = 0 UNION SELECT dataset_id FROM jb WHERE k % 20 = 4 UNION SELECT filename FROM jb WHERE k % 100 = 1 UNION SELECT 'nowhere')
SELECT wanted, coalesce((SELECT min(job_id) FROM jb WHERE job_id = wanted), (SELECT min(job_id) FROM jb WHERE dataset_id = wanted), (SELECT min(job_id) FROM jb WHERE filename = wanted)) AS job_id FROM w""")
def j13(spark, d):
    j = jobs(spark, d)
    wanted = j.where("k % 10 = 0").select(F.col("job_id").alias("wanted")).union(j.where("k % 20 = 4").select("dataset_id")).union(j.where("k % 100 = 1").select("filename")).union(spark.createDataFrame([("nowhere",)], "w string")).distinct()
    return C.resolved_ids(wanted, j)


@REGISTRY.query("u4_all_datasets", _JOBS + "\nSELECT job_id AS id, updated_at, 'layout' AS annotation_type FROM jb UNION ALL SELECT 'b' || CAST(p_partkey AS VARCHAR), p_partkey + 5, 'bounding_box' FROM part")
def u4(spark, d):
    boxes = V.table(spark, d, "part").select(F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_partkey") + 5).alias("updated_at"))
    return C.all_datasets(jobs(spark, d).select(F.col("job_id").alias("id"), "updated_at"), boxes)


@REGISTRY.query("u7_converted_formats", _JOBS + "\nSELECT job_id, CASE WHEN k % 3 = 0 THEN 'success' ELSE 'none' END AS convert_status, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'llamafactory,swift' ELSE 'swift' END ELSE CASE WHEN k % 2 = 0 THEN 'llamafactory' ELSE 'swift' END END AS formats FROM jb")
def u7(spark, d):
    j = jobs(spark, d)
    states = j.select("job_id", "k", F.lit("none").alias("convert_status"), F.array(F.when(F.col("k") % 2 == 0, "llamafactory").otherwise("swift")).alias("converted_formats"))
    return C.converted(states, j.where("k % 3 = 0"), "swift", "success").select("job_id", "convert_status", F.array_join("converted_formats", ",").alias("formats"))


@REGISTRY.query("u6_distinct_models", _JOBS + "\nSELECT DISTINCT model FROM jb")
def u6(spark, d):
    return jobs(spark, d).select("model").distinct()


@REGISTRY.query("t5_interrupted_tasks", "SELECT event_id AS task_id, CASE WHEN event_type = 'click' THEN 'failed' ELSE event_type END AS status FROM events")
def t5(spark, d):
    tasks = V.table(spark, d, "events").select(F.col("event_id").alias("task_id"), F.when(F.col("event_type") == "click", "converting").otherwise(F.col("event_type")).alias("status"))
    return C.interrupted(tasks)


@REGISTRY.query("k3_upsert", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1""")
def k3(spark, d):
    e = V.table(spark, d, "events").select("user_id", "event_id", "event_type")
    half = e.agg(F.max("event_id").alias("m")).first()["m"] // 2
    order = F.col("event_id").desc()
    old, new = C.latest(e.where(F.col("event_id") <= half), ["user_id"], order), C.latest(e.where(F.col("event_id") > half), ["user_id"], order)
    return C.upsert(old, new, ["user_id"])


@REGISTRY.query("k11_delete", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def k11(spark, d):
    e = V.table(spark, d, "events")
    return C.without(e, e.where("event_type = 'error'").select("user_id").distinct(), ["user_id"]).select("event_id")


@REGISTRY.query("r11_insert_if_absent", "SELECT user_id, CASE WHEN bool_or(event_type = 'signup') THEN 'kept' ELSE 'new' END AS origin FROM events GROUP BY user_id")
def r11(spark, d):
    e = V.table(spark, d, "events")
    old = e.where("event_type = 'signup'").select("user_id").distinct().withColumn("origin", F.lit("kept"))
    return C.insert_if_absent(old, e.select("user_id").distinct().withColumn("origin", F.lit("new")), ["user_id"])


@REGISTRY.query("s7_latest_version", "SELECT user_id AS job, max('annotation_v2_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || lpad(CAST(event_id AS VARCHAR), 9, '0') || '.json') AS file FROM events GROUP BY user_id")
def s7(spark, d):
    name = F.concat(F.lit("/x/"), F.col("user_id").cast("string"), F.lit("/annotation_v2_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_"), F.lpad(F.col("event_id").cast("string"), 9, "0"), F.lit(".json"))
    files = V.table(spark, d, "events").select("user_id", name.alias("path"))
    return R.latest_versions(files).select(F.col("user_id").alias("job"), T.base_name(F.col("path")).alias("file"))


@REGISTRY.query("s9_repeated_keys", "SELECT c_nationkey AS key, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def s9(spark, d):
    return C.repeated_keys(V.table(spark, d, "customer").select(F.col("c_nationkey").alias("key")), ["key"])


@REGISTRY.query("s5_preferred_results", "SELECT page_id FROM pages WHERE page_id % 4 = 1")
def s5(spark, d):
    i = F.col("page_id")
    name = F.when(i % 4 == 1, "result.json").when(i % 4 == 2, "dataset_state.json").otherwise("other.json")
    files = V.table(spark, d, "pages").select("page_id", F.concat(F.lit("/r/"), i.cast("string"), F.lit("/"), name).alias("path"))
    return R.preferred_results(files).select("page_id")


@REGISTRY.query("s11_active_version", """
SELECT user_id AS job_id, CASE WHEN bool_or(event_type = 'error') THEN 'draft' WHEN bool_or(event_type = 'signup') THEN max(CASE WHEN event_type = 'signup' THEN 'annotation_v2_' || strftime(ts, '%Y%m%d_%H%M%S') END) ELSE 'first' END AS version FROM events GROUP BY user_id""")
def s11(spark, d):
    e = V.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "draft").when(F.col("event_type") == "signup", F.concat(F.lit("annotation_v2_"), F.date_format("ts", "yyyyMMdd_HHmmss"))).otherwise("first")
    return C.active_version(e.select(F.col("user_id").alias("job_id"), kind.alias("version")))


@REGISTRY.query("a15_box_datasets", """
SELECT n_nationkey AS id, n_name AS name, coalesce(i, 0) AS image_count, coalesce(a, 0) AS annotated_count, n_nationkey % 4 + 1 AS label_count FROM nation
LEFT JOIN (SELECT c_nationkey AS k, count(*) AS i FROM customer GROUP BY 1) c ON c.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*) FILTER (s_suppkey % 3 <> 0) AS a FROM supplier GROUP BY 1) s ON s.k = n_nationkey""")
def a15(spark, d):
    n = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.sequence(F.lit(0), F.col("n_nationkey") % 4).alias("labels"))
    images = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("dataset_id"))
    boxes = F.when(F.col("s_suppkey") % 3 != 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return C.box_summaries(n, images, V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("dataset_id"), boxes.alias("boxes")))


@REGISTRY.query("k13_box_labels", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'table,seal' ELSE 'table,text,seal' END AS labels FROM nation")
def k13(spark, d):
    """Label list of a box dataset after an addition and a removal."""
    n = V.table(spark, d, "nation").withColumn("labels", F.array(F.lit("table"), F.lit("text")))
    changed = F.array_append(F.when(F.col("n_nationkey") % 2 == 0, F.array_remove("labels", "text")).otherwise(F.col("labels")), "seal")
    return n.select(F.col("n_nationkey").alias("id"), F.array_join(changed, ",").alias("labels"))


@REGISTRY.query("p34_visible_segments", V.with_views("gt") + "\nSELECT doc, idx FROM gt WHERE page_id = 2 AND label IN ('table', 'text')")
def p34(spark, d):
    return V.gt_blocks(spark, d).where((F.col("page_id") == 2) & F.col("label").isin("table", "text")).select("doc", "idx")


@REGISTRY.query("r17_model_names", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'a/b  c' WHEN event_id % 4 = 1 THEN event_type WHEN event_id % 4 = 2 THEN 'n' ELSE '未知' END AS model, CASE WHEN event_id % 4 = 0 THEN 'a_b c' WHEN event_id % 4 = 1 THEN event_type WHEN event_id % 4 = 2 THEN 'n' ELSE '未知' END AS folder FROM events")
def r17(spark, d):
    i = F.col("event_id") % 4
    m = C.model_name(F.when(i == 0, " a/b  c "), F.when(i == 1, F.col("event_type")), F.when(i == 2, "n"))
    return V.table(spark, d, "events").select("event_id", m.alias("model"), C.model_folder(m).alias("folder"))


# --- prompts -----------------------------------------------------------------------------------------------------------


def prompts(spark, d):
    p = V.table(spark, d, "part")
    k = F.col("p_partkey")
    tasks = F.array(*map(F.lit, ("layout_analysis", "swift_conversion", "auto_annotation", "other task")))
    content = F.when(k % 13 == 0, "").when(k % 7 == 0, "Read {{1bad}}").when(k % 5 == 0, "Open {{ name").otherwise(F.concat(F.lit("Read {{page}} of "), F.col("p_name")))
    return C.normalized_prompts(p.select(
        F.concat(F.lit(" Part "), k.cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("description"), F.when(k % 2 == 0, "model_inference").otherwise("x").alias("type"),
        F.element_at(tasks, (k % 4 + 1).cast("int")).alias("task_type"), F.when(k % 3 == 0, "").otherwise("m1").alias("model_name"), F.when(k % 6 == 0, "disabled").alias("status"), (k % 9 == 0).alias("is_default"),
        content.alias("content"), F.lit("v1.0").alias("version"), F.when(k % 17 == 0, "2024").alias("deleted_at"), F.lpad((k * 37 % 1000).cast("string"), 4, "0").alias("updated_at"), F.lit("0").alias("created_at"), k.alias("ord"),
        F.array(F.struct(F.lit("v1.0").alias("version"), content.alias("content"))).alias("versions"),
    ))


_PROMPTS = """
WITH pr AS (
  SELECT 'part_' || CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand AS description, CASE WHEN p_partkey % 2 = 0 THEN 'model_inference' ELSE 'custom' END AS type,
         ['layout_analysis', 'swift_conversion', 'auto_annotation', 'custom'][p_partkey % 4 + 1] AS task_type, CASE WHEN p_partkey % 3 = 0 THEN 'all' ELSE 'm1' END AS model_name, CASE WHEN p_partkey % 6 = 0 THEN 'disabled' ELSE 'enabled' END AS status,
         p_partkey % 9 = 0 AS is_default, CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN 'Read {{1bad}}' WHEN p_partkey % 5 = 0 THEN 'Open {{ name' ELSE 'Read {{page}} of ' || p_name END AS content,
         CASE WHEN p_partkey % 17 = 0 THEN '2024' END AS deleted_at, lpad(CAST(p_partkey * 37 % 1000 AS VARCHAR), 4, '0') AS updated_at, p_partkey AS k FROM part)"""


@REGISTRY.query("p23_normalized_prompts", _PROMPTS + "\nSELECT id, name, type, task_type, model_name, status, is_default, content FROM pr")
def p23(spark, d):
    return prompts(spark, d).select("id", "name", "type", "task_type", "model_name", "status", "is_default", "content")


@REGISTRY.query("p23_f21_prompt_problems", _PROMPTS + """
SELECT id, 'empty_content' AS problem FROM pr WHERE content = '' UNION ALL SELECT id, 'bad_variable' FROM pr WHERE contains(content, '1bad') UNION ALL SELECT id, 'stray_braces' FROM pr WHERE contains(content, 'Open')
UNION ALL SELECT id, 'disabled_default' FROM pr WHERE is_default AND status <> 'enabled'""")
def p23b(spark, d):
    return C.prompt_problems(prompts(spark, d))


@REGISTRY.query("p22_o4_list_prompts", _PROMPTS + "\nSELECT id, updated_at FROM pr WHERE deleted_at IS NULL AND type = 'model_inference' AND status = 'enabled' AND contains(lower(name || ' ' || description || ' ' || content), 'read') ORDER BY updated_at DESC, id")
def p22(spark, d):
    return C.list_prompts(prompts(spark, d), "READ ", "model_inference", status="enabled").select("id", "updated_at")


@REGISTRY.query("u8_enforced_defaults", _PROMPTS + "\nSELECT id, is_default AND status = 'enabled' AND row_number() OVER (PARTITION BY task_type, is_default AND status = 'enabled' ORDER BY k) = 1 AS is_default FROM pr")
def u8(spark, d):
    return C.enforced_defaults(prompts(spark, d)).select("id", "is_default")


@REGISTRY.query("r21_default_for_task", _PROMPTS + "\nSELECT task_type, id FROM (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY is_default DESC, updated_at DESC, id) AS n FROM pr WHERE deleted_at IS NULL AND status = 'enabled') WHERE n = 1")
def r21(spark, d):
    return C.default_for_task(prompts(spark, d)).select("task_type", "id")


@REGISTRY.query("r19_updated_prompts", _PROMPTS + """
SELECT id, CASE WHEN deleted_at IS NULL AND k % 3 = 0 AND content <> 'New' THEN 'v1.1' ELSE 'v1.0' END AS version, CASE WHEN deleted_at IS NULL AND k % 3 = 0 THEN 'New' ELSE content END AS content, CAST(CASE WHEN deleted_at IS NULL AND k % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS versions FROM pr""")
def r19(spark, d):
    p = prompts(spark, d)
    none = F.lit(None).cast("string")
    edits = p.where("ord % 3 = 0").select("id", F.lit("New").alias("content"), none.alias("name"), none.alias("status"))
    return C.updated_prompts(p, edits).select("id", "version", "content", F.size("versions").alias("versions"))


@REGISTRY.query("r20_rollback_delete_copy", _PROMPTS + """
SELECT id, CASE WHEN deleted_at IS NULL AND k % 3 = 0 THEN 'v1.2' ELSE 'v1.0' END AS version, content, CASE WHEN k % 5 = 0 AND deleted_at IS NULL THEN '2025' ELSE deleted_at END AS deleted_at, CASE WHEN k % 5 = 0 AND deleted_at IS NULL THEN 'disabled' ELSE status END AS status FROM pr
UNION ALL SELECT trim(regexp_replace(lower(name), '[^a-z0-9_\\-]+', '_', 'g'), '_') || '_copy_c', 'v1.0', content, NULL, status FROM pr WHERE deleted_at IS NULL AND k % 11 = 0""")
def r20(spark, d):
    p = prompts(spark, d)
    none = F.lit(None).cast("string")
    edited = C.updated_prompts(p, p.where("ord % 3 = 0").select("id", F.lit("New").alias("content"), none.alias("name"), none.alias("status")))
    back = C.rolled_back(edited, p.where("ord % 3 = 0").select("id", F.lit("v1.0").alias("version")))
    gone = C.soft_deleted(back, p.where("ord % 5 = 0").select("id"), F.lit("2025"))
    copies = C.copied(p.where("ord % 11 = 0"), F.lit("c"))
    return gone.unionByName(copies).select("id", "version", "content", "deleted_at", "status")


# --- exports -----------------------------------------------------------------------------------------------------------


def qa(spark, d):
    c = V.table(spark, d, "conversations")
    t = F.col("turn")
    answer = F.when(t % 3 == 0, F.concat(F.lit('<think>no</think>{"image_path":"old","blocks":[{"id":"b","page_id":'), t.cast("string"), F.lit("}]}"))).when(t % 5 == 4, "").otherwise(F.col("text"))
    return c.select(F.col("conv_id").alias("doc"), t.cast("int").alias("page_id"), F.when(t % 7 == 6, "").otherwise("pages/p.png").alias("image"), F.when(F.col("conv_id") % 2 == 0, "").otherwise("sys").alias("system"),
                    F.when(t % 2 == 0, F.concat(F.lit("<image>\n"), F.col("role"))).otherwise(F.col("role")).alias("user"), answer.alias("assistant"))


_QA = r"""
WITH q AS (
  SELECT conv_id AS doc, CAST(turn AS INTEGER) AS page_id, CASE WHEN conv_id % 2 = 0 THEN '你是一个专业的文档版面分析模型。' ELSE 'sys' END AS system, '<image>' || chr(10) || role AS user,
         printf('images/%s/page_%03d.png', CAST(conv_id AS VARCHAR), turn) AS ref, turn, text FROM conversations WHERE turn % 7 <> 6 AND (turn % 3 = 0 OR turn % 5 <> 4)),
s AS (SELECT *, CASE WHEN turn % 3 = 0 THEN '{"image_path":"' || ref || '","blocks":[{"id":"b","page_id":' || CAST(turn AS VARCHAR) || '}]}' ELSE text END AS answer FROM q)"""


@REGISTRY.query("k5_swift_samples", _QA + "\nSELECT doc, page_id, 'system=' || system || '|user=' || user || '|assistant=' || answer AS messages, ref AS image FROM s")
def k5(spark, d):
    out = X.samples(qa(spark, d), "swift")
    return out.select("doc", "page_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|").alias("messages"), F.col("images")[0].alias("image"))


@REGISTRY.query("k5_llamafactory_samples", _QA + "\nSELECT doc, page_id, user AS instruction, '' AS input, answer AS output, system, 'val' AS split FROM s")
def k5b(spark, d):
    return X.with_split(X.samples(qa(spark, d), "llamafactory"), "val").drop("images")


@REGISTRY.query("a17_export_stats", V.with_views("gt") + """
SELECT category, file, count(*) AS pages, count(*) FILTER (blocks > 0) AS samples, CAST(sum(blocks) AS BIGINT) AS blocks, CAST(CASE WHEN grouping(file) = 0 THEN 0 WHEN grouping(category) = 0 THEN 1 ELSE 3 END AS INTEGER) AS level
FROM (SELECT 'c' || CAST(doc % 3 AS VARCHAR) AS category, doc AS file, page_id, count(*) FILTER (label <> 'text') AS blocks FROM gt GROUP BY ALL) GROUP BY ROLLUP (category, file)""")
def a17(spark, d):
    pages = V.gt_blocks(spark, d).groupBy(F.concat(F.lit("c"), (F.col("doc") % 3).cast("string")).alias("category"), F.col("doc").alias("file"), "page_id").agg(F.count_if(F.col("label") != "text").alias("blocks"))
    return X.export_stats(pages)


@REGISTRY.query("r25_usable_pages", V.with_views("gt") + "\nSELECT skipped, count(*) AS pages FROM (SELECT doc, page_id, CASE WHEN (doc + page_id) % 4 = 0 THEN 'not_done' WHEN count(*) < 30 THEN 'few_blocks' END AS skipped FROM gt GROUP BY doc, page_id) GROUP BY skipped")
def r25(spark, d):
    pages = V.gt_blocks(spark, d).groupBy("doc", "page_id").agg(F.count(F.lit(1)).alias("blocks")).withColumn("status", F.when((F.col("doc") + F.col("page_id")) % 4 == 0, "error").otherwise("done"))
    return X.usable_pages(pages, 30).groupBy("skipped").agg(F.count(F.lit(1)).alias("pages"))


@REGISTRY.query("r13_chosen_image", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'm.png' WHEN 1 THEN 'd.png' WHEN 2 THEN 'p.png' END AS image FROM pages")
def r13(spark, d):
    i = F.col("page_id") % 4
    have = F.when(i == 0, F.array(*map(F.lit, ("p.png", "d.png", "m.png")))).when(i == 1, F.array(F.lit("p.png"), F.lit("d.png"))).when(i == 2, F.array(F.lit("p.png"))).otherwise(F.array().cast("array<string>"))
    return V.table(spark, d, "pages").select("page_id", X.chosen_image(F.lit("m.png"), F.lit("p.png"), F.lit("d.png"), have).alias("image"))


def _pages(spark, d):
    h = V.headings(spark, d)
    b = F.struct(F.lit("b").alias("id"), F.col("text"), F.array("x1", "y1", F.col("x1") + 9, F.col("y1") + 9).alias("bbox"), F.col("page_id"), F.col("block_type").alias("label"), F.col("block_type"), F.lit("").alias("description"), F.col("level"))
    from leafgrid.operators.blocks import export_block

    answers = X.page_answers(h.select("doc", "page_id", "ord", export_block(b).alias("b")))
    return h, answers.withColumns({"width": F.lit(100), "height": F.lit(200), "image": F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".png"))})


_BLOCK = """'{"id":"b","text":"' || text || '","bbox":[' || CAST(x1 AS VARCHAR) || ',' || CAST(y1 AS VARCHAR) || ',' || CAST(x1 + 9 AS VARCHAR) || ',' || CAST(y1 + 9 AS VARCHAR) || '],"page_id":' || CAST(page_id AS VARCHAR)
   || ',"block_type":"' || block_type || '","description":"","level":' || CASE WHEN block_type = 'paragraph_title' AND level IS NOT NULL THEN '"' || level || '"' ELSE 'null' END || '}'"""
_HD = V.with_views("hd")
_PAGES = outline_sql(False) + f""",
pb AS (SELECT doc, page_id, string_agg({_BLOCK}, ',' ORDER BY ord) AS blocks, count(*) AS n FROM hd GROUP BY ALL),
pu AS (SELECT pb.*, outline, '当前页面 page_id=' || CAST(page_id AS VARCHAR) || '，图像尺寸为 100x200。' || chr(10) || chr(10) || outline AS page_user, 'pages/' || CAST(page_id AS VARCHAR) || '.png' AS image FROM pb JOIN ol USING (doc, page_id))"""


@REGISTRY.query("j10_r9_refreshed_answers", _HD + _PAGES + """
SELECT doc, page_id, image, '' AS system, page_user AS user, '{"image_path":"' || image || '","blocks":[' || blocks || ']}' AS assistant FROM pu""")
def j10(spark, d):
    """Q&A answers and prompts after corrections; checked in the tests."""
    h, pages = _pages(spark, d)
    old = pages.select("doc", "page_id", "image", F.lit("").alias("system"), F.lit("old").alias("user"), F.lit("old").alias("assistant"))
    return X.refreshed_answers(old, pages, H.page_outlines(h))


@REGISTRY.query("w4_training_lines", _HD + _PAGES + r"""
SELECT doc, page_id, '{"image":"' || image || '","input":{"system":"","user":"' || replace(page_user, chr(10), '\n') || '"},"output":{"blocks":[' || blocks || ']}}' AS line FROM pu""")
def w4(spark, d):
    h, pages = _pages(spark, d)
    return X.training_lines(pages, H.page_outlines(h)).select("doc", "page_id", J.compact(F.struct("image", "input", "output")).alias("line"))


@REGISTRY.query("j9_page_lookup", V.with_views("gt") + "\nSELECT DISTINCT g.doc, g.page_id, p.last FROM gt g LEFT JOIN (SELECT doc, page_id, arg_max(l_suppkey, rid) AS last FROM li WHERE l_orderkey % 3 = 0 GROUP BY ALL) p USING (doc, page_id)")
def j9(spark, d):
    """Left join on the last of several rows of a page."""
    last = V.items(spark, d).where("l_orderkey % 3 = 0").groupBy("doc", "page_id").agg(F.max_by("l_suppkey", "rid").alias("last"))
    return V.gt_blocks(spark, d).select("doc", "page_id").distinct().join(last, ["doc", "page_id"], "left")


@REGISTRY.query("j11_r10_replaced_blocks", V.with_views("gt", "pred") + """
SELECT doc, page_id, CASE WHEN p.n IS NOT NULL THEN p.n ELSE g.n END AS blocks, p.n IS NOT NULL AS replaced FROM (SELECT doc, page_id, count(*) AS n FROM gt GROUP BY ALL) g LEFT JOIN (SELECT doc, page_id, count(*) AS n FROM pred WHERE doc % 2 = 0 GROUP BY ALL) p USING (doc, page_id)""")
def j11(spark, d):
    """Blocks of pages that a correction holds replace the job's own."""
    per = lambda b, n: b.groupBy("doc", "page_id").agg(F.count(F.lit(1)).alias(n))
    both = per(V.gt_blocks(spark, d), "own").join(per(V.pred_blocks(spark, d).where("doc % 2 = 0"), "new"), ["doc", "page_id"], "left")
    return both.select("doc", "page_id", F.coalesce("new", "own").alias("blocks"), F.col("new").isNotNull().alias("replaced"))


@REGISTRY.query("j11_r10_job_blocks", V.with_views("gt", "pred") + f""",
n AS (SELECT doc, page_id, list({{i: idx, k: CASE WHEN label IN {T.BLOCK_TYPES} THEN label ELSE 'text' END}} ORDER BY idx) AS b FROM pred WHERE doc % 2 = 0 GROUP BY ALL),
o AS (SELECT doc, page_id, count(*) AS own FROM gt GROUP BY ALL)
SELECT doc, string_agg(CAST(page_id AS VARCHAR) || ':' || CAST(coalesce(len(b), own) AS VARCHAR), ',' ORDER BY page_id) AS pages,
       coalesce(array_to_string(list_transform(flatten(list(b ORDER BY page_id) FILTER (b IS NOT NULL)), lambda x: CAST(x.i AS VARCHAR) || x.k), ','), '') AS result
FROM o LEFT JOIN n USING (doc, page_id) GROUP BY doc""")
def j11_blocks(spark, d):
    """Jobs whose pages take the blocks of a correction, and the list of all replaced blocks."""
    from leafgrid.sources.readers import BLOCK

    def pages(rows):
        box = F.array("x1", "y1", "x2", "y2")
        block = F.struct(F.col("idx").cast("string").alias("id"), "text", box.alias("bbox"), F.lit(None).cast("array<double>").alias("bbox_1000"), F.lit(None).cast("array<double>").alias("model_bbox"), "page_id", F.lit(None).cast("string").alias("block_type"), "label",
                         F.lit(None).cast("string").alias("type"), F.lit("").alias("description"), F.lit("").alias("chart_description"), "level", F.lit("").alias("source"), F.lit(False).alias("modified"), F.lit(None).cast("array<string>").alias("modified_fields")).cast(BLOCK)
        return rows.groupBy("doc", "page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", block.alias("b")))), lambda x: x["b"]).alias("blocks"))

    own = pages(V.gt_blocks(spark, d)).withColumn("blocks", F.transform("blocks", B.job_block))
    replaced, listed = C.with_replaced_blocks(own, pages(V.pred_blocks(spark, d).where("doc % 2 = 0")).withColumn("pos", F.lit(0)))
    per = replaced.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", F.size("blocks").alias("n")))), lambda x: F.concat_ws(":", x["page_id"], x["n"])), ",").alias("pages"))
    return per.join(listed, "doc").select("doc", "pages", F.array_join(F.transform("blocks", lambda b: F.concat(b["id"], b["block_type"])), ",").alias("result"))


@REGISTRY.query("k11_deleted_datasets", _JOBS + """,
w AS (
  SELECT k AS pos, job_id AS wanted FROM jb WHERE k % 10 = 0 UNION ALL SELECT k + 1000000000, dataset_id FROM jb WHERE k % 20 = 4 UNION ALL SELECT k + 2000000000, job_id FROM jb WHERE k % 30 = 0
  UNION ALL SELECT k + 3000000000, 'none' || CAST(k AS VARCHAR) FROM jb WHERE k % 50 = 1),
g AS (SELECT * , row_number() OVER (PARTITION BY job ORDER BY pos) AS turn FROM (SELECT pos, wanted, coalesce(a.job_id, b.job_id) AS job FROM w LEFT JOIN jb a ON a.job_id = wanted LEFT JOIN jb b ON b.dataset_id = wanted))
SELECT 'report' AS part, wanted AS id, CASE WHEN job IS NULL OR turn > 1 THEN 'FileNotFoundError: dataset not found: ' || wanted END AS error FROM g
UNION ALL SELECT 'kept', job_id, NULL FROM jb WHERE job_id NOT IN (SELECT job FROM g WHERE job IS NOT NULL)""")
def k11_deleted(spark, d):
    """Datasets deleted by job and dataset ids; ids that are unknown or come twice have an error each and stop nothing."""
    j = jobs(spark, d)
    k = F.col("k")
    ids = j.where(k % 10 == 0).select(k.alias("pos"), F.col("job_id").alias("wanted")).union(j.where(k % 20 == 4).select(k + 1000000000, "dataset_id")).union(j.where(k % 30 == 0).select(k + 2000000000, "job_id"))
    ids = ids.union(j.where(k % 50 == 1).select(k + 3000000000, F.concat(F.lit("none"), k.cast("string"))))
    kept, report = C.deleted(j, ids)
    none = F.lit(None).cast("string")
    return report.select(F.lit("report").alias("part"), F.col("wanted").alias("id"), "error").union(kept.select(F.lit("kept"), "job_id", none))


@REGISTRY.query("f26_compact_json", V.with_views("gt") + """
SELECT doc, idx, '{"label":"' || label || '","level":' || CASE WHEN level = 'none' THEN 'null' ELSE '"' || level || '"' END || ',"page_id":' || CAST(page_id AS VARCHAR) || '}' AS json FROM gt""")
def f26(spark, d):
    return V.gt_blocks(spark, d).select("doc", "idx", J.compact(F.struct("label", F.nullif("level", F.lit("none")).alias("level"), "page_id")).alias("json"))


# --- gold units --------------------------------------------------------------------------------------------------------

_VOCABULARY = {"kind": ("审批", "责任", "许可", "处罚"), "role": ("审批主体", "责任主体", "权利主体"), "action_type": ("做",)}


def units(spark, d):
    t = V.table(spark, d, "documents")
    i = F.col("doc_id")
    word = F.regexp_extract("text", r"^(\S*)", 1)
    kinds = F.array(*map(F.lit, ("审批", "责任", "许可", "处罚", "其他")))
    action = lambda name, kind: F.struct(name.alias("name"), F.lit(kind).alias("type"))
    actions = F.when(i % 6 == 0, F.array().cast("array<struct<name:string,type:string>>")).otherwise(F.array(action(word, "做"), action(F.when(i % 9 == 0, word).when(i % 10 == 1, "zzqx").otherwise(F.lit(None).cast("string")), "想")))
    raw = F.struct(
        F.when(i % 7 == 0, "other").otherwise(F.col("source")).alias("name"), F.when(i % 5 == 0, "x").otherwise(F.col("text")).alias("clause"),
        F.array(F.struct(F.element_at(kinds, (i % 5 + 1).cast("int")).alias("kind"), F.when(i % 4 != 0, F.array(F.struct(word.alias("name"), F.array().cast("array<string>").alias("aliases"), F.when(i % 3 == 0, "审批主体").otherwise("责任主体").alias("role")))).alias("subjects"), actions.alias("actions"))).alias("rules"),
    )
    answer = F.from_json(F.to_json(raw), Q.ANSWER)
    return t.select(i.alias("unit_id"), F.col("lang").alias("document_id"), F.col("source").alias("document_name"), F.concat(F.lit("第"), i.cast("string"), F.lit("条")).alias("unit_number"), F.col("text").alias("input_text"), F.col("text").alias("source_text"),
                    F.concat(F.lit("/s/"), (i % 11).cast("string")).alias("source_markdown"), F.lit("h").alias("source_sha256"), F.when(i % 4 == 0, "human_reviewed").when(i % 4 == 1, "").alias("review_status"), answer.alias("answer"))


_UNITS = r"""
WITH un AS (SELECT *, doc_id AS i, regexp_replace(regexp_extract(text, '^(\S*)', 1), '\s+|---|#{1,6}', '', 'g') AS w, ['审批', '责任', '许可', '处罚', '其他'][doc_id % 5 + 1] AS kind, CASE WHEN doc_id % 3 = 0 THEN '审批主体' ELSE '责任主体' END AS role FROM documents),
iss AS (
  SELECT i AS unit_id, 'document_name' AS code, 'answer.name' AS path FROM un WHERE i % 7 = 0
  UNION ALL SELECT i, 'clause_text', 'answer.clause' FROM un WHERE i % 5 = 0
  UNION ALL SELECT i, 'missing_action', 'rules.0.actions' FROM un WHERE i % 6 = 0
  UNION ALL SELECT i, 'missing_consequence', 'rules.0.consequences' FROM un WHERE kind = '处罚'
  UNION ALL SELECT i, 'subject_role', 'rules.0.subjects' FROM un WHERE (kind = '审批' AND (i % 4 = 0 OR role <> '审批主体')) OR (kind = '责任' AND (i % 4 = 0 OR role <> '责任主体')) OR (kind = '许可' AND i % 4 <> 0)
  UNION ALL SELECT i, 'duplicate_entity', 'rules.0.actions' FROM un WHERE i % 6 <> 0 AND i % 9 = 0 AND regexp_extract(text, '^(\S*)', 1) <> ''
  UNION ALL SELECT i, 'evidence_span', 'rules.0.actions.1.name' FROM un WHERE i % 6 <> 0 AND i % 9 <> 0 AND i % 10 = 1
  UNION ALL SELECT i, 'controlled_value', 'rules.0.kind' FROM un WHERE kind = '其他'
  UNION ALL SELECT i, 'controlled_value', 'rules.0.actions.1.type' FROM un WHERE i % 6 <> 0)"""


def _issues(spark, d):
    return Q.issues(units(spark, d), vocabularies=_VOCABULARY)


@REGISTRY.query("q210_issues", _UNITS + "\nSELECT unit_id, 'error' AS severity, code, path FROM iss")
def q210(spark, d):
    return _issues(spark, d)


@REGISTRY.query("q210_source_issues", """
WITH s AS (SELECT i, i <> 3 AS have, CASE WHEN i = 4 THEN 'other' ELSE 'h' END AS h FROM range(11) r(i) WHERE i <> 3)
SELECT doc_id AS unit_id, 'source_path' AS code FROM documents WHERE doc_id % 11 = 3 UNION ALL SELECT doc_id, 'source_hash' FROM documents WHERE doc_id % 11 = 4
UNION ALL SELECT doc_id, 'source_text_grounding' FROM documents WHERE doc_id % 11 <> 3 AND doc_id >= 11 AND NOT contains((SELECT regexp_replace(text, '\\s+|---|#{1,6}', '', 'g') FROM documents z WHERE z.doc_id = documents.doc_id % 11), regexp_replace(text, '\\s+|---|#{1,6}', '', 'g'))""")
def q210s(spark, d):
    u = units(spark, d)
    s = u.where("unit_id < 11 and unit_id <> 3").select("source_markdown", F.when(F.col("unit_id") == 4, "other").otherwise("h").alias("sha256"), F.concat(F.col("input_text"), F.lit("\n---\n12\n"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.concat(F.lit("src"), k.cast("string"))))).alias("text"))
    return Q.issues(u, s).where(F.col("code").startswith("source")).select("unit_id", "code")


@REGISTRY.query("a13_severity_counts", _UNITS + "\nSELECT 'error' AS severity, count(*) AS n FROM iss")
def a13(spark, d):
    return Q.severity_counts(_issues(spark, d))


@REGISTRY.query("a12_gold_summary", _UNITS + """
SELECT lang AS document_id, min(source) AS document_name, count(*) AS unit_count, count(*) FILTER (i % 4 = 0) AS reviewed_count, count(*) AS rule_count, count(*) FILTER (i IN (SELECT unit_id FROM iss)) AS invalid_count FROM un GROUP BY lang""")
def a12(spark, d):
    return Q.summary(units(spark, d), _issues(spark, d))


@REGISTRY.query("a14_duplicate_families", _UNITS + "\nSELECT unit_id, path FROM iss WHERE code = 'duplicate_entity'")
def a14(spark, d):
    return _issues(spark, d).where("code = 'duplicate_entity'").select("unit_id", "path")


@REGISTRY.query("p24_list_units", r"""
SELECT doc_id AS unit_id, lang AS document_id, CASE WHEN doc_id % 4 = 0 THEN 'human_reviewed' ELSE 'requires_independent_human_review' END AS status, left(text, 140) AS preview, CAST(1 AS INTEGER) AS rule_count FROM documents
WHERE lang = 'en' AND doc_id % 4 <> 0 AND contains(lower(CAST(doc_id AS VARCHAR) || ' 第' || CAST(doc_id AS VARCHAR) || '条 ' || source || ' ' || text), 'license')""")
def p24(spark, d):
    return Q.list_units(units(spark, d), "en", "requires_independent_human_review", " LICENSE")


@REGISTRY.query("k12_guarded_review", _UNITS + """
SELECT i AS unit_id, CASE WHEN i % 2 = 0 AND i NOT IN (SELECT unit_id FROM iss) THEN 'human_reviewed' ELSE CASE WHEN i % 4 = 0 THEN 'human_reviewed' WHEN i % 4 = 1 THEN '' END END AS review_status, i % 2 = 0 AND i IN (SELECT unit_id FROM iss) AS refused FROM un""")
def k12(spark, d):
    u = units(spark, d)
    edits = u.where("unit_id % 2 = 0").select("unit_id", F.lit("human_reviewed").alias("review_status"), F.lit("me").alias("reviewer"))
    return Q.reviewed(u, edits, "r1", "r1", _issues(spark, d)).select("unit_id", "review_status", "refused")


@REGISTRY.query("u5_f28_shape_issues", "SELECT event_id, 'schema_extra' AS code, 'props.k' AS path FROM events UNION ALL SELECT event_id, 'schema_missing', 'props.name' FROM events")
def u5(spark, d):
    return V.table(spark, d, "events").select("event_id", F.explode(Q.shape_issues(F.col("props"), ("name",), "props")).alias("i")).select("event_id", "i.code", "i.path")


@REGISTRY.query("f29_json_leaves", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS leaf FROM events")
def f29(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("m"))
    return e.select("event_id", F.explode("m").alias("key", "leaf")).select("event_id", "leaf")


@REGISTRY.query("labels_confusion", "SELECT quality AS gt_label, toxic AS pred_label, count(*) AS n FROM labels GROUP BY ALL")
def labels_confusion(spark, d):
    return V.table(spark, d, "labels").groupBy(F.col("quality").alias("gt_label"), F.col("toxic").alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))


# --- streams -----------------------------------------------------------------------------------------------------------


#: Files of a micro-batch: that many tasks read it.
_FILES = 4


def _stream(spark, frame, folder, part, parts):
    """The rows of a frame as a stream of files: those of part 0 first, then those of part 1, ..."""
    cut = frame.withColumn("part", part.cast("int"))
    for k in range(parts):
        cut.where(F.col("part") == k).drop("part").repartition(_FILES).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", _FILES).option("latestFirst", False).parquet(f"{folder}/in")


@REGISTRY.query("t1_stream_upsert", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def t1(spark, d):
    """Commits of a stream as upserts of the touched buckets; the last version equals the batch result."""
    folder = S.shared_folder(spark)
    stream = _stream(spark, V.table(spark, d, "events").select("user_id", "event_id", "event_type"), folder, F.col("event_id") % 3, 3)
    table = VersionedTable(spark, f"{folder}/table", "user_id long, event_id long, event_type string", ["user_id"])
    S.run_to_end(stream, folder, S.upserts(table, ["event_id"], "events"))
    return VersionedTable(spark, f"{folder}/table", table.schema, ["user_id"]).read()


@REGISTRY.query("t2_stream_heading_state", V.with_views("hd") + """,
cl AS (
  SELECT *, CASE WHEN l IS NOT NULL THEN 'H' || CAST(k + least(0, min(l - k) OVER (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING)) AS VARCHAR) END AS repaired
  FROM (SELECT *, count(l) OVER (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN block_type = 'paragraph_title' AND level IS NOT NULL THEN CAST(substr(level, 2) AS INTEGER) END AS l FROM hd)))
SELECT doc, ord, repaired FROM cl""")
def t2(spark, d):
    """The heading clamp over pages that finish in any order: a page waits in the state until those before it have come."""
    folder = S.shared_folder(spark)
    pages = checkpointed(S.page_rows(V.headings(spark, d)))  # the four parts are written from it
    stream = _stream(spark, pages, folder, F.pmod(F.xxhash64("doc", "page_id"), F.lit(4)), 4)
    out = S.clamp_pages(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc", "ord", "repaired")


@REGISTRY.query("t4_failed_pages_rerun", """
SELECT conv_id, turn, CASE WHEN done THEN 'done' ELSE 'dead' END AS status, CAST(CASE WHEN turn % 3 <> 1 THEN 1 WHEN done THEN 1 + conv_id % 4 ELSE 3 END AS BIGINT) AS attempts,
       CASE WHEN done THEN t ELSE 'timeout' END AS said
FROM (SELECT conv_id, turn, min(text) AS t, turn % 3 <> 1 OR (conv_id % 4 BETWEEN 1 AND 2) AS done FROM conversations GROUP BY ALL)""")
def t4(spark, d):
    """A stream of page results with failures, then reruns: some pages work at the second attempt, some at the third, some never."""
    folder = S.shared_folder(spark)
    pages = V.table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("payload"))
    error = lambda bad: F.when(bad, "timeout")
    stamp = lambda k: F.timestamp_seconds(F.lit(k))
    first = pages.withColumns({"error": error(F.col("turn") % 3 == 1), "at": stamp(0)})
    queue = S.PageQueue(spark, f"{folder}/queue", "conv_id long, turn long")
    S.run_to_end(_stream(spark, first, folder, F.pmod("conv_id", F.lit(2)), 2), folder, queue.sink("pages"))

    def attempt(k):
        works = (F.col("conv_id") % 4 <= k) & (F.col("conv_id") % 4 >= 1)
        return lambda keys: keys.join(pages, ["conv_id", "turn"]).withColumns({"error": error(~works), "at": stamp(k)})

    again = S.PageQueue(spark, f"{folder}/queue", "conv_id long, turn long")  # another object finds what the first one left
    for k in (1, 2, 3):
        again.rerun(attempt(k), most=3)
    done = again.done.read().select("conv_id", "turn", F.lit("done").alias("status"), "attempts", F.col("payload").alias("said"))
    return done.unionByName(again.waiting().select("conv_id", "turn", F.lit("dead").alias("status"), "attempts", F.col("error").alias("said")))
