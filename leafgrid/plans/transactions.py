"""Queries of tables in versions: reviews, annotations, page commits and tasks, each run to its last version, with DuckDB SQL for the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrid.operators import annotations as A
from leafgrid.operators import reviews as W
from leafgrid.plans.registry import Registry
from leafgrid.plans.tables import _UNITS, _VOCABULARY, units
from leafgrid.sources import views as V
from leafgrid.sources.shared import fresh_folder

REGISTRY = Registry()


def _edits(u, seq: int, answer, status, revision):
    given = {"seq": F.lit(seq), "answer": answer, "adjudication_notes": F.lit(None).cast("array<string>"), "review_status": (status if not isinstance(status, str) else F.lit(status)).cast("string"), "reviewer": F.lit(f"editor {seq}"), "review_note": F.lit(""), "expected_revision": revision}
    return u.select("unit_id", *[v.alias(k) for k, v in given.items()])


@REGISTRY.query("k12_gold_update", _UNITS + """,
f AS (
  SELECT i, CASE WHEN i % 4 = 0 THEN 'human_reviewed' WHEN i % 4 = 1 THEN '' END AS was, i % 6 AS m,
         i % 6 = 0 OR i % 6 = 4 OR (i % 6 = 2 AND i % 10 = 0) AS saved FROM un)
SELECT i AS unit_id, CASE WHEN m = 0 OR (m = 2 AND i % 10 = 0) THEN 'human_reviewed' WHEN m = 4 THEN 'in_progress' ELSE was END AS review_status,
       CASE WHEN m = 2 AND i % 10 = 0 THEN 'editor 2' WHEN saved THEN 'editor 1' END AS reviewed_by, CAST(CASE WHEN saved THEN 1 ELSE 0 END AS INTEGER) AS edits,
       CASE WHEN m = 0 AND i % 10 = 0 THEN '1 saved,2 stale' WHEN m = 0 THEN '1 saved' WHEN m = 2 AND i % 10 = 0 THEN '1 invalid,2 saved' WHEN m = 2 THEN '1 invalid'
            WHEN m = 4 AND i % 10 = 0 THEN '1 saved,2 stale' WHEN m = 4 THEN '1 saved' WHEN i % 7 = 0 THEN '1 missing_answer' END AS first_batch,
       CASE WHEN i % 5 = 0 THEN '3 stale' END AS second_batch, CASE WHEN i % 15 = 0 THEN '4 invalid_status' END AS third_batch
FROM f UNION ALL SELECT -1, NULL, NULL, NULL, '1 missing_unit', NULL, NULL""")
def k12_gold_update(spark, d):
    """Three batches of edits: answers that are valid, invalid, missing or late; the second batch still has the first one's revision."""
    i = F.col("unit_id")
    more = {"adjudication_notes": F.lit(None).cast("array<string>"), "reviewed_by": F.lit(None).cast("string"), "reviewed_at": F.lit(None).cast("string"), "review_history": F.lit(None).cast(W.HISTORY)}
    u = units(spark, d).withColumns(more)
    store = W.GoldStore(spark, fresh_folder(spark, "gold"), vocabularies=_VOCABULARY)
    store.create(u)
    first = store.revision
    answer = lambda name: F.struct(name.alias("name"), F.col("input_text").alias("clause"), F.array().cast(f"{W.ANSWER[W.ANSWER.index('array<') : -1]}").alias("rules")).cast(W.ANSWER)
    good, bad, none = answer(F.col("document_name")), answer(F.concat(F.col("document_name"), F.lit("?"))), F.lit(None).cast(W.ANSWER)
    one = _edits(u.where(i % 2 == 0), 1, F.when(i % 6 == 0, good).otherwise(bad), F.when(i % 6 == 4, "in_progress").otherwise(W.Q.REVIEWED), F.when(i % 6 != 4, first))
    two = _edits(u.where(i % 10 == 0), 2, good, W.Q.REVIEWED, F.lit(first))
    lost = _edits(u.where((i % 2 == 1) & (i % 7 == 0)), 1, none, F.lit(None), F.lit(""))
    nowhere = _edits(u.where(i == u.agg(F.min(i)).first()[0]).withColumn("unit_id", F.lit(-1).cast("long")), 1, good, W.Q.REVIEWED, F.lit(""))
    _, a = store.save(one.unionByName(two).unionByName(lost).unionByName(nowhere), "2024-01-01T00:00:00+0000")
    _, b = store.save(_edits(u.where(i % 5 == 0), 3, good, W.Q.REVIEWED, F.lit(first)), "2024-01-02T00:00:00+0000")
    _, c = store.save(_edits(u.where(i % 15 == 0), 4, good, "done", F.lit("")), "2024-01-03T00:00:00+0000")
    said = lambda t, name: t.groupBy("unit_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "seq", "outcome"))), ",").alias(name))
    out = store.units().select("unit_id", "review_status", "reviewed_by", F.coalesce(F.size("review_history"), F.lit(0)).alias("edits"))
    out = out.withColumn("edits", F.greatest("edits", F.lit(0)))
    for t, name in ((a, "first_batch"), (b, "second_batch"), (c, "third_batch")):
        out = out.join(said(t, name), "unit_id", "full_outer")
    return out


# --- annotations in versions -------------------------------------------------------------------------------------------

_SAVES = """
WITH s AS (
  SELECT 'u' || CAST(user_id AS VARCHAR) AS job, event_id AS e, ts, props AS pages, event_id % 2 AS half,
         CASE event_type WHEN 'click' THEN 'draft' WHEN 'view' THEN 'overwrite' ELSE 'submit' END AS mode FROM events),
v AS (
  SELECT *, CASE mode WHEN 'draft' THEN 'draft' WHEN 'overwrite' THEN 'first_annotation' ELSE 'annotation_v2_' || strftime(ts, '%Y%m%d_%H%M%S') END AS version FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY job, version ORDER BY half DESC, ts DESC, pages DESC) AS n FROM v {where}),
a AS (SELECT job, version, pages, row_number() OVER (PARTITION BY job ORDER BY CASE WHEN version = 'draft' THEN 0 WHEN version LIKE 'annotation_v2_%' THEN 1 ELSE 2 END, version DESC) AS r FROM k WHERE n = 1),
st AS (
  SELECT job, arg_max(CASE mode WHEN 'draft' THEN 'second_annotating' WHEN 'overwrite' THEN 'first_annotated' ELSE 'second_annotated' END, (half, ts)) AS annotation_status
  FROM v {where} GROUP BY job)
SELECT a.job AS job_id, a.version AS active_version, a.pages, st.annotation_status FROM a JOIN st USING (job) WHERE r = 1"""


def _annotations(spark, d, as_of=None):
    mode = F.when(F.col("event_type") == "click", "draft").when(F.col("event_type") == "view", "overwrite").otherwise("submit")
    saves = V.table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("job_id"), mode.alias("mode"), F.col("props").alias("pages"), F.col("ts").alias("saved_at"), "event_id")
    store = A.AnnotationStore(spark, fresh_folder(spark, "annotations"))
    for half in (0, 1):
        store.save(saves.where(F.col("event_id") % 2 == half).drop("event_id"))
    return store.active(as_of).select("job_id", "active_version", "pages", "annotation_status")


@REGISTRY.query("k4_s11_saved_annotations", _SAVES.format(where=""))
def k4_s11(spark, d):
    """Two batches of drafts, overwrites and second annotations; per job the annotation that readers see, and the job's stage."""
    return _annotations(spark, d)


@REGISTRY.query("k4_annotations_as_of", _SAVES.format(where="WHERE half = 0"))
def k4_as_of(spark, d):
    """The same store as it was after the first batch."""
    return _annotations(spark, d, as_of=0)


_STATUS = "CASE event_type WHEN 'signup' THEN 'converting' WHEN 'view' THEN NULL WHEN 'click' THEN 'converting' WHEN 'purchase' THEN 'success' ELSE 'failed' END"


@REGISTRY.query("r15_t5_task_states", f"""
WITH RECURSIVE e AS (
  SELECT CAST(event_id // 5 AS VARCHAR) AS task_id, event_id AS seq, ts, {_STATUS} AS status, CAST(event_id % 3 AS VARCHAR) AS f, CAST(event_id AS VARCHAR) AS x FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts, seq) AS k FROM e),
w AS (
  SELECT task_id, CAST(0 AS BIGINT) AS k, '' AS status, NULL::VARCHAR AS f0, NULL::VARCHAR AS f1, NULL::VARCHAR AS f2, NULL::TIMESTAMP AS seen, 0 AS refused FROM (SELECT DISTINCT task_id FROM o)
  UNION ALL
  SELECT task_id, k, CASE WHEN ok THEN coalesce(new, status) ELSE status END, CASE WHEN ok AND f = '0' THEN x ELSE f0 END, CASE WHEN ok AND f = '1' THEN x ELSE f1 END, CASE WHEN ok AND f = '2' THEN x ELSE f2 END,
         CASE WHEN ok THEN ts ELSE seen END, refused + CASE WHEN ok THEN 0 ELSE 1 END
  FROM (
    SELECT w.task_id, o.k, w.status, o.status AS new, w.f0, w.f1, w.f2, w.seen, w.refused, o.ts, o.f, o.x,
           o.status IS NULL OR (w.status = '' AND o.status IN ('converting', 'failed')) OR w.status = 'converting' AS ok
    FROM w JOIN o ON o.task_id = w.task_id AND o.k = w.k + 1)),
z AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY k DESC) AS last FROM w),
c AS (SELECT *, status = 'converting' AND seen < (SELECT max(ts) FROM events) - INTERVAL 5 DAY AS cut FROM z WHERE last = 1)
SELECT task_id, CASE WHEN cut THEN 'failed' ELSE status END AS status, coalesce(f0, '-') || '/' || coalesce(f1, '-') || '/' || coalesce(f2, '-') AS fields, CASE WHEN cut THEN 'timeout' END AS error, refused FROM c""")
def r15_t5(spark, d):
    """Events of tasks in two batches, out of order and partly repeated, folded into states with a timeout."""
    e = V.table(spark, d, "events")
    kind = F.col("event_type")
    status = F.when(kind.isin("signup", "click"), "converting").when(kind == "purchase", "success").when(kind != "view", "failed")
    i = F.col("event_id")
    rows = e.select(F.floor(i / 5).cast("string").alias("task_id"), i.alias("seq"), F.col("ts").alias("at"), status.alias("status"), F.create_map((i % 3).cast("string"), i.cast("string")).alias("fields"))
    log = A.TaskLog(spark, fresh_folder(spark, "tasks"))
    log.append(rows.where("seq % 7 < 4"))
    log.append(rows.where("seq % 7 >= 3"))
    states = log.states(now=F.lit(e.agg(F.max("ts")).first()[0]), patience="5 days")
    part = lambda k: F.coalesce(F.element_at("fields", k), F.lit("-"))
    return states.select("task_id", "status", F.concat_ws("/", part("0"), part("1"), part("2")).alias("fields"), F.element_at("fields", "error").alias("error"), "refused")
