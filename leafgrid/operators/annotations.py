"""Saved annotations and convert tasks as tables in versions.

``AnnotationStore`` keeps for every job the first annotation, a draft and numbered second annotations, with the job's state; one commit saves a batch of
jobs, so a reader never sees an annotation without its state. ``TaskLog`` keeps the events of convert tasks and folds them into states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafgrid.functions import text as T
from leafgrid.functions.geometry import let
from leafgrid.operators.catalog import active_version
from leafgrid.sources.versions import VersionedTable

# --- annotations -------------------------------------------------------------------------------------------------------

#: Stage of a job after a save, by the mode of the save.
STAGES = {"draft": "second_annotating", "overwrite": "first_annotated", "submit": "second_annotated"}
FIRST, DRAFT, SECOND, STATE = "first_annotation", "draft", "annotation_v2_", "state"
SAVED = "job_id string, version string, pages string, annotation_status string, saved_at timestamp, second_annotated_at timestamp"


class AnnotationStore:
    """Rows (job_id, version): annotations with their pages, and a row ``state`` with the stage and times of the job."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16) -> None:
        self.table = VersionedTable(spark, folder, SAVED, ["job_id"], buckets)

    def save(self, saves: DataFrame) -> int:
        """Commit saves (job_id, mode, pages, saved_at): a draft replaces the draft, overwrite the first annotation, and any other mode adds a second annotation named by its
        time. Of saves that write one version the last one counts; the state follows the last save of a job. Drafts stay when a version is submitted, as readers prefer them."""
        mode = F.when(F.col("mode").isin("draft", "overwrite"), F.col("mode")).otherwise("submit")
        named = F.when(mode == "draft", DRAFT).when(mode == "overwrite", FIRST).otherwise(F.concat(F.lit(SECOND), F.date_format("saved_at", "yyyyMMdd_HHmmss")))
        rows = saves.select("job_id", named.alias("version"), "pages", F.lit(None).cast("string").alias("annotation_status"), "saved_at", F.lit(None).cast("timestamp").alias("second_annotated_at"))
        stage = F.max_by(_named(STAGES, mode), "saved_at")
        states = saves.groupBy("job_id").agg(
            stage.alias("annotation_status"), F.max("saved_at").alias("saved_at"), F.max(F.when(mode == "submit", F.col("saved_at"))).alias("second_annotated_at")
        ).select("job_id", F.lit(STATE).alias("version"), F.lit(None).cast("string").alias("pages"), "annotation_status", "saved_at", "second_annotated_at")
        return self.table.merge(rows.unionByName(states), self._with)

    def _with(self, old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.select(*self.table.schema.names, F.lit(0).alias("_new")).unionByName(new.select(*self.table.schema.names, F.lit(1).alias("_new")))
        newest = Window.partitionBy("job_id", "version").orderBy(F.col("_new").desc(), F.col("saved_at").desc(), F.col("pages").desc())
        kept = F.coalesce("second_annotated_at", F.max("second_annotated_at").over(Window.partitionBy("job_id", "version")))
        both = both.withColumns({"second_annotated_at": F.when(F.col("version") == STATE, kept), "_k": F.row_number().over(newest)})
        return both.where("_k = 1").select(self.table.schema.names)

    def active(self, as_of: int | None = None) -> DataFrame:
        """Per job the annotation that readers see: the draft, else the latest second annotation, else the first; with the job's state. ``as_of`` takes an earlier version."""
        rows = self.table.read(as_of)
        best = active_version(rows.where(F.col("version") != STATE)).select("job_id", F.col("version").alias("active_version"), "pages")
        states = rows.where(F.col("version") == STATE).select("job_id", "annotation_status", "second_annotated_at")
        return best.join(states, "job_id", "left")


def _named(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


# --- convert tasks -----------------------------------------------------------------------------------------------------

#: The states of a convert task and what may follow each; a finished task starts anew only as a task of its own.
FOLLOWS = {"": ("converting", "failed"), "converting": ("converting", "success", "partial_success", "failed"), "success": (), "partial_success": (), "failed": ()}
#: What a task that was cut off says.
CUT_OFF, RESTARTED = "转换任务已中断", "后端服务重启，后台转换线程已停止，请重新发起转换。"
EVENT = "task_id string, seq long, at timestamp, status string, fields map<string,string>"


def task_states(events: DataFrame, now: Column | None = None, patience: str | None = None, restarted: Column | None = None) -> DataFrame:
    """(task_id, status, fields, at, refused) of events (task_id, seq, at, status, fields), in the order of (at, seq).

    An event updates the fields it names and leaves the others; a status that may not follow the one before is refused with its fields (null: no change of
    status, fields only). Repeated events (of one task and seq) count once. A task that is still converting is failed if its last event is
    older than ``patience`` at ``now`` (``timeout``), or before ``restarted``, the time of a restart. The fold of a task is as long as its events.
    """
    order = lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)
    per = events.dropDuplicates(["task_id", "seq"]).groupBy("task_id").agg(F.collect_list(F.struct("at", "seq", "status", "fields")).alias("_e"))
    none = F.create_map().cast("map<string,string>")
    start = F.struct(F.lit("").alias("status"), none.alias("fields"), F.lit(None).cast("timestamp").alias("at"), F.lit(0).alias("refused"))
    allowed = F.create_map(*[x for s, after in FOLLOWS.items() for x in (F.lit(s), F.array(*map(F.lit, after)).cast("array<string>"))])

    def step(acc: Column, e: Column) -> Column:
        fine = e["status"].isNull() | F.array_contains(F.element_at(allowed, acc["status"]), e["status"])
        given = F.coalesce(e["fields"], none)
        kept = F.map_filter(acc["fields"], lambda k, v: ~F.map_contains_key(given, k))
        return let(fine, lambda ok: F.struct(
            F.when(ok, F.coalesce(e["status"], acc["status"])).otherwise(acc["status"]).alias("status"), F.when(ok, F.map_concat(kept, given)).otherwise(acc["fields"]).alias("fields"),
            F.when(ok, e["at"]).otherwise(acc["at"]).alias("at"), (acc["refused"] + F.when(ok, 0).otherwise(1)).alias("refused"),
        ))

    out = per.select("task_id", F.aggregate(F.array_sort("_e", order), start, step).alias("s")).select("task_id", "s.*")
    late = F.lit(False)
    if now is not None and patience is not None:
        late = F.col("at") < now - F.expr(f"interval {patience}")
    gone = F.col("at") < restarted if restarted is not None else F.lit(False)
    cut = (F.col("status") == "converting") & (late | gone)
    said = F.create_map(F.lit("message"), F.lit(CUT_OFF), F.lit("error"), F.when(gone, RESTARTED).otherwise("timeout"))
    others = F.map_filter("fields", lambda k, v: ~k.isin("message", "error"))
    return out.withColumn("_cut", cut).select("task_id", F.when(F.col("_cut"), "failed").otherwise(F.col("status")).alias("status"), F.when(F.col("_cut"), F.map_concat(others, said)).otherwise(F.col("fields")).alias("fields"), "at", "refused")


class TaskLog:
    """Events of convert tasks, appended in any order and any number of times."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16) -> None:
        # Buckets by task: the events of a task lie together.
        self.table = VersionedTable(spark, folder, EVENT, ["task_id"], buckets)

    def append(self, events: DataFrame, stream: tuple[str, int] | None = None) -> int:
        first = lambda old, new: old.unionByName(new.select(self.table.schema.names)).dropDuplicates(["task_id", "seq"])
        return self.table.merge(events.select(self.table.schema.names), first, stream)

    def states(self, as_of: int | None = None, **limits) -> DataFrame:
        return task_states(self.table.read(as_of), **limits)

    def task(self, task_id: str, **limits) -> DataFrame:
        """The state of one task; reads its bucket only."""
        return task_states(self.table.lookup(task_id), **limits)


def converted_formats(states: DataFrame, tasks: DataFrame) -> DataFrame:
    """Dataset states (job_id, convert_status, converted_formats) after tasks (their states with fields dataset_ids, separated by commas, and target_format): a job's status is that of
    its last task, and each task that worked adds its format to the sorted set."""
    each = tasks.select(F.explode(F.split(F.col("fields.dataset_ids"), ",")).alias("job_id"), "status", F.col("fields.target_format").alias("f"), "at", "task_id").where("job_id <> ''")
    worked = F.col("status").isin("success", "partial_success")
    per = each.groupBy("job_id").agg(F.max_by("status", F.struct("at", "task_id")).alias("_status"), F.collect_set(F.when(worked, F.col("f"))).alias("_formats"))
    both = states.join(per, "job_id", "left")
    none = F.array().cast("array<string>")
    formats = F.array_sort(F.array_union(F.coalesce("converted_formats", none), F.coalesce("_formats", none)))
    return both.select("job_id", F.coalesce("_status", T.filled(F.col("convert_status")), F.lit("none")).alias("convert_status"), formats.alias("converted_formats"))
