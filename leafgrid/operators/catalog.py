"""Dataset, prompt and box catalogs: state folding, summaries, filters, versions, updates.

Tables are changed by making a new one: an upsert is a full outer join, a delete an anti-join, so each works in batch
and inside ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.functions import text as T

#: Enumerations of prompt records.
PROMPT_TYPES = ("data_annotation", "second_review", "data_cleaning", "data_conversion", "model_inference", "system_role", "custom")
TASK_TYPES = ("layout_analysis", "table_recognition", "image_captioning", "data_quality_check", "llamafactory_conversion", "swift_conversion", "second_manual_review", "auto_annotation", "custom")
FINISHED = ("done", "error")


# --- tables ------------------------------------------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` with those of ``new`` put in by key; of several new rows of one key any one counts, so reduce them first."""
    keep = old.join(new.select(*keys).distinct(), keys, "left_anti")
    return keep.unionByName(new, allowMissingColumns=True)


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key that comes first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: a uniqueness constraint fails where this has rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def active_version(versions: DataFrame, key: str = "job_id", kind: str = "version") -> DataFrame:
    """Per job the draft, else the latest second annotation, else the first one."""
    rank = F.when(F.col(kind) == "draft", 0).when(F.col(kind).startswith("annotation_v2_"), 1).otherwise(2)
    return latest(versions, [key], rank, F.col(kind).desc())


# --- dataset states ----------------------------------------------------------------------------------------------------


def complete(status: Column) -> Column:
    return F.lower(F.coalesce(status, F.lit(""))).isin("complete", "completed", "done")


def folded_status(status: Column) -> Column:
    """Completed, Error or Running."""
    return F.when(complete(status), "Completed").when(F.lower(status).isin("error", "failed"), "Error").otherwise("Running")


def folded_annotation(annotation: Column, status: Column) -> Column:
    """The stored stage; an unset one of a completed job is the first annotation."""
    stored = F.nullif(F.nullif(F.coalesce(annotation, F.lit("none")), F.lit("none")), F.lit(""))
    return F.coalesce(stored, F.when(complete(status), "first_annotated").otherwise("none"))


def model_name(config_model: Column, model: Column, name: Column) -> Column:
    # the plain fields are tried before trimming, the configured one after
    plain = F.coalesce(T.filled(model), name)
    return F.coalesce(T.filled(T.stripped(config_model)), T.filled(T.stripped(plain)), F.lit("未知"))


def model_folder(c: Column) -> Column:
    text = F.coalesce(T.filled(T.stripped(c)), F.lit("未知"))
    flat = F.regexp_replace(F.regexp_replace(text, r"[\\/:\x00]+", "_"), r"(?U)\s+", " ")
    return F.coalesce(T.filled(F.regexp_replace(flat, r"^[ .]+|[ .]+$", "")), F.lit("未知"))


def age_text(updated: Column, now: Column) -> Column:
    """How long ago, as the dataset cards say it; dates beyond thirty days."""
    ago = F.greatest(now - updated, F.lit(0))
    said = lambda unit, name: F.format_string(f"Updated %d {name} ago", F.floor(ago / unit).cast("long"))
    date = F.date_format(F.timestamp_seconds(updated), "yyyy/M/d")
    return (
        F.when(F.coalesce(updated, F.lit(0)) == 0, "Updated recently").when(ago < 60, "Updated just now").when(ago < 3600, said(60, "minutes"))
        .when(ago < 86400, said(3600, "hours")).when(ago < 2592000, said(86400, "days")).otherwise(date)
    )


def progress(done: Column, pages: Column) -> Column:
    """Whole percent, half up; 0 without pages."""
    return F.when(F.coalesce(pages, F.lit(0)) > 0, F.floor(F.coalesce(done, F.lit(0)) / pages * 100 + 0.5)).otherwise(0).cast("long")


def cards(jobs: DataFrame, now: Column) -> DataFrame:
    """Dataset cards of job summaries (job_id, dataset_id, filename, status, page_count, completed_pages, block_count, updated_at, annotation_status, annotation_type, model)."""
    status = folded_status(F.col("status"))
    pages, done = F.coalesce("page_count", F.lit(0)), F.coalesce("completed_pages", F.lit(0))
    running = status == "Running"
    ident = F.coalesce(T.filled(F.col("dataset_id")), F.col("job_id"))
    kind = F.coalesce(T.filled(F.col("annotation_type")), F.lit("layout"))
    return jobs.select(
        ident.alias("id"), F.coalesce(T.filled(F.col("filename")), F.concat(F.lit("Dataset "), ident)).alias("name"), F.when(kind == "bounding_box", "Bounding Box").otherwise("PDF Layout").alias("category"),
        T.short_count(pages).alias("amount"), F.when(pages == 1, "page").otherwise("pages").alias("amount_label"), status.alias("status"), age_text(F.col("updated_at"), now).alias("updated"),
        F.when(running, progress(done, pages)).alias("progress"), F.when(running, F.format_string("%s/%s pages processed", done.cast("string"), pages.cast("string"))).alias("progress_label"),
        F.coalesce("block_count", F.lit(0)).alias("block_count"), pages.alias("page_count"), F.coalesce(T.filled(F.col("model")), F.lit("Unknown model")).alias("model"),
        folded_annotation(F.col("annotation_status"), F.col("status")).alias("annotation_status"), kind.alias("annotation_type"),
    )


def filter_cards(c: DataFrame, category: str = "All", status: str = "All", search: str = "") -> DataFrame:
    by = {"PDF Layout": F.col("annotation_type") == "layout", "Bounding Box": F.col("annotation_type") == "bounding_box", "second": F.col("annotation_status") == "second_annotated"}
    if category != "All":
        c = c.where(by.get(category, F.col("status") == category))
    if status != "All":
        c = c.where(F.col("status") == status)
    text = F.lower(F.concat_ws(" ", "name", "category", "amount_label", "model"))
    return c.where(text.contains(search.lower())) if search else c


def convertible(c: DataFrame) -> DataFrame:
    return c.withColumn("convertible", (F.col("status") == "Completed") & F.col("annotation_status").isin("first_annotated", "second_annotated"))


def job_counts(pages: DataFrame) -> DataFrame:
    """Per job: pages, finished pages, blocks, errors; from rows (job_id, status, blocks array)."""
    return pages.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("page_count"), F.count_if(F.col("status").isin(*FINISHED)).alias("completed_pages"), F.sum(F.size("blocks")).alias("block_count"), F.count_if(F.col("status") == "error").alias("error_count"),
    )


def dashboard(c: DataFrame) -> DataFrame:
    return c.agg(F.sum("page_count").alias("total_pages"), F.sum("block_count").alias("total_blocks"), F.count_if(F.col("status") == "Completed").alias("completed"))


def summaries(jobs: DataFrame, states: DataFrame) -> DataFrame:
    """Jobs with their dataset state (job_id, annotation_status, convert_status, converted_formats, updated_at), newest first to sort by."""
    s = states.select("job_id", F.col("annotation_status").alias("_a"), F.col("convert_status").alias("_c"), F.col("converted_formats").alias("_f"), F.col("updated_at").alias("_u"))
    both = jobs.join(s, "job_id", "left")
    return both.select(
        *[F.col(c) for c in jobs.columns if c != "updated_at"], folded_annotation(F.col("_a"), F.col("status")).alias("annotation_status"), F.coalesce("_c", F.lit("none")).alias("convert_status"),
        F.coalesce("_f", F.array().cast("array<string>")).alias("converted_formats"), F.greatest(F.coalesce("updated_at", F.lit(0)), F.coalesce("_u", F.lit(0))).alias("updated_at"),
    )


def resolved_ids(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """(wanted, job_id): by job id, else by dataset id, else by file name. Three equi-joins with priority."""
    jobs = jobs.select("job_id", "dataset_id", "filename")
    parts = [jobs.select(F.col(c).alias("wanted"), "job_id", F.lit(k).alias("k")) for k, c in enumerate(("job_id", "dataset_id", "filename"))]
    every = parts[0].union(parts[1]).union(parts[2]).where("wanted is not null")
    return wanted.join(every, "wanted", "left").groupBy("wanted").agg(F.min(F.struct("k", "job_id"))["job_id"].alias("job_id"))


def converted(states: DataFrame, ids: DataFrame, target: str, status: str) -> DataFrame:
    """States after a conversion of the listed jobs: status set, format added to the sorted set."""
    hit = F.col("_hit").isNotNull()
    both = states.join(ids.select("job_id", F.lit(1).alias("_hit")).distinct(), "job_id", "left")
    formats = F.array_sort(F.array_union(F.coalesce("converted_formats", F.array().cast("array<string>")), F.array(F.lit(target))))
    return both.withColumns({"convert_status": F.when(hit, status).otherwise(F.col("convert_status")), "converted_formats": F.when(hit, formats).otherwise(F.col("converted_formats"))}).drop("_hit")


def interrupted(tasks: DataFrame) -> DataFrame:
    """Convert tasks as read after a restart: those still converting have failed."""
    return tasks.withColumn("status", F.when(F.col("status") == "converting", "failed").otherwise(F.col("status")))


def all_datasets(layout: DataFrame, boxes: DataFrame) -> DataFrame:
    """Layout and box datasets in one table with a discriminator and a common time column."""
    return layout.withColumn("annotation_type", F.lit("layout")).unionByName(boxes.withColumn("annotation_type", F.lit("bounding_box")), allowMissingColumns=True)


def box_summaries(datasets: DataFrame, images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Box datasets (id, name, labels array) with counts of images, annotated images and labels."""
    i = images.groupBy(F.col("dataset_id").alias("id")).agg(F.count(F.lit(1)).alias("image_count"))
    a = annotations.groupBy(F.col("dataset_id").alias("id")).agg(F.count_if(F.size("boxes") > 0).alias("annotated_count"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return datasets.join(i, "id", "left").join(a, "id", "left").select("id", "name", zero("image_count"), zero("annotated_count"), F.size("labels").cast("long").alias("label_count"))


# --- prompts -----------------------------------------------------------------------------------------------------------


def normalized_prompts(raw: DataFrame) -> DataFrame:
    """Prompt records with defaults; unknown enumeration values become custom or enabled."""
    one_of = lambda c, values, other: F.when(T.clean(F.col(c)).isin(*values), T.clean(F.col(c))).otherwise(other)
    ident = T.template_id(F.col("id"))
    return raw.withColumns({
        "id": ident, "name": F.coalesce(T.filled(T.stripped(F.col("name"))), ident), "type": one_of("type", PROMPT_TYPES, "custom"), "task_type": one_of("task_type", TASK_TYPES, "custom"),
        "status": one_of("status", ("enabled", "disabled"), "enabled"), "model_name": T.clean(F.col("model_name"), "all"), "version": T.clean(F.col("version"), "v1.0"),
        "is_default": F.coalesce(F.col("is_default"), F.lit(False)), "content": T.clean(F.col("content")),
    })


def prompt_problems(prompts: DataFrame) -> DataFrame:
    """(id, problem): missing content, malformed variables, a disabled default."""
    names = F.regexp_extract_all("content", F.lit(r"(?s)\{\{(.*?)\}\}"), F.lit(1))
    rest = F.regexp_replace("content", r"(?s)\{\{.*?\}\}", "")
    tests = {
        "empty_content": F.col("content") == "", "bad_variable": F.exists(names, lambda n: ~T.stripped(n).rlike(T.VARIABLE)), "stray_braces": rest.contains("{{") | rest.contains("}}"),
        "disabled_default": F.col("is_default") & (F.col("status") != "enabled"),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]), lambda x: x.isNotNull())
    return prompts.select("id", F.explode(found).alias("problem"))


def list_prompts(prompts: DataFrame, search: str = "", type_: str = "all", task_type: str = "all", model_name_: str = "all", status: str = "all", is_default: bool | None = None,
                 include_deleted: bool = False, sort_by: str = "updated_at", descending: bool = True) -> DataFrame:
    out = prompts if include_deleted else prompts.where("deleted_at is null")
    for column, value in (("type", type_), ("task_type", task_type), ("model_name", model_name_), ("status", status)):
        if value and value != "all":
            out = out.where(F.col(column) == value)
    if is_default is not None:
        out = out.where(F.col("is_default") == is_default)
    if search.strip():
        out = out.where(F.lower(F.concat_ws(" ", "name", "description", "content")).contains(search.strip().lower()))
    key = F.col(sort_by if sort_by in ("created_at", "updated_at", "name") else "updated_at")
    return out.orderBy(key.desc() if descending else key.asc(), "id")


def enforced_defaults(prompts: DataFrame, chosen: str | None = None) -> DataFrame:
    """At most one enabled default per task: the chosen prompt, else the first in order (ord)."""
    enabled = F.col("is_default") & (F.col("status") == "enabled")
    picked = F.col("id") == chosen if chosen is not None else F.lit(False)
    candidate = F.coalesce(enabled | (picked & (F.col("status") == "enabled")), F.lit(False))
    order = Window.partitionBy("task_type", candidate).orderBy(F.when(picked, 0).otherwise(1), "ord")
    return prompts.withColumn("is_default", candidate & (F.row_number().over(order) == 1))


def default_for_task(prompts: DataFrame) -> DataFrame:
    """Per task type the enabled default, else the first enabled prompt, newest first."""
    live = prompts.where("deleted_at is null and status = 'enabled'")
    return latest(live, ["task_type"], F.col("is_default").desc(), F.col("updated_at").desc(), F.col("id"))


def updated_prompts(prompts: DataFrame, edits: DataFrame) -> DataFrame:
    """Prompts with edits (id, content, name, status; null keeps a value): no change without a difference, a new version only for new content."""
    e = edits.select("id", *[F.col(c).alias("e_" + c) for c in ("content", "name", "status")])
    both = prompts.join(e, "id", "left").withColumns({"e_" + c: F.coalesce("e_" + c, c) for c in ("content", "name", "status")})
    live = F.col("deleted_at").isNull()
    content = live & ~F.col("e_content").eqNullSafe(F.col("content"))
    versions = F.when(content, F.array_append("versions", F.struct(T.next_version(F.col("version")).alias("version"), F.col("e_content").alias("content")))).otherwise(F.col("versions"))
    version = F.when(content, T.next_version(F.col("version"))).otherwise(F.col("version"))
    fresh = {c: F.when(live, F.col("e_" + c)).otherwise(F.col(c)) for c in ("content", "name", "status")}
    return both.withColumns({"versions": versions, "version": version}).withColumns(fresh).drop("e_content", "e_name", "e_status")


def rolled_back(prompts: DataFrame, targets: DataFrame) -> DataFrame:
    """Prompts set back to the content of an older version (id, version): an edit like any other."""
    wanted = targets.select("id", F.col("version").alias("_v"))
    old = prompts.join(wanted, "id").select("id", F.get(F.filter("versions", lambda v: v["version"] == F.col("_v")), F.lit(0))["content"].alias("content"))
    none = F.lit(None).cast("string")
    return updated_prompts(prompts, old.where("content is not null").select("id", "content", none.alias("name"), none.alias("status")))


def soft_deleted(prompts: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    both = prompts.join(ids.select("id", F.lit(True).alias("_d")).distinct(), "id", "left")
    gone = F.coalesce(F.col("_d"), F.lit(False)) & F.col("deleted_at").isNull()
    return both.withColumns({
        "deleted_at": F.when(gone, at).otherwise(F.col("deleted_at")), "status": F.when(gone, "disabled").otherwise(F.col("status")), "is_default": F.col("is_default") & ~gone,
    }).drop("_d")


def copied(prompts: DataFrame, suffix: Column) -> DataFrame:
    """Copies under new ids and names, no defaults, first version, no history."""
    fresh = F.array(F.struct(F.lit("v1.0").alias("version"), F.col("content").alias("content")))
    return prompts.where("deleted_at is null").withColumns({
        "id": F.concat(T.template_id(F.col("name")), F.lit("_copy_"), suffix), "name": F.concat("name", F.lit("_副本")), "is_default": F.lit(False), "version": F.lit("v1.0"), "versions": fresh,
    })


def batch_progress(jobs: DataFrame, by: list[str]) -> DataFrame:
    """Pages and finished pages of each batch of jobs."""
    return jobs.groupBy(*by).agg(F.sum("page_count").alias("pages"), F.sum("completed_pages").alias("done"))


def migrated_prompts(prompts: DataFrame, builtin: DataFrame, legacy: DataFrame, default_id: str, revision: str) -> DataFrame:
    """Prompts after the store's migrations: missing built-in records, then missing legacy templates, then the default's new revision.

    Built-in and legacy rows have id, name, prompt. A legacy template without id or prompt is left out. The default record takes the built-in text and
    the next version unless its notes carry the revision or it is deleted.
    """
    columns = ["id", "name", "description", "content", "version", "is_default", "deleted_at", "notes"]

    def records(rows: DataFrame, description: str) -> DataFrame:
        named = rows.where(F.coalesce(F.trim("id"), F.lit("")) != "")
        return named.select(
            "id", F.coalesce(T.filled(F.col("name")), F.col("id")).alias("name"), F.lit(description).alias("description"), F.col("prompt").alias("content"), F.lit("v1.0").alias("version"),
            (F.col("id") == default_id).alias("is_default"), F.lit(None).cast("string").alias("deleted_at"), F.lit("").alias("notes"),
        )

    out = insert_if_absent(prompts.select(*columns), records(builtin, "从内置模板初始化。"), ["id"])
    out = insert_if_absent(out, records(legacy.where(F.coalesce(F.trim("prompt"), F.lit("")) != ""), "从旧提示词模板迁移而来。"), ["id"])
    text = builtin.where(F.col("id") == default_id).select("id", F.col("prompt").alias("_new"))
    out = out.join(F.broadcast(text), "id", "left")
    stale = F.col("_new").isNotNull() & F.col("deleted_at").isNull() & ~F.coalesce(F.col("notes"), F.lit("")).contains(revision)
    return out.withColumns({
        "content": F.when(stale, F.col("_new")).otherwise(F.col("content")), "version": F.when(stale, T.next_version(F.col("version"))).otherwise(F.col("version")),
        "notes": F.when(stale, F.lit(f"revision={revision}")).otherwise(F.col("notes")),
    }).select(*columns)


def changed_labels(datasets: DataFrame, edits: DataFrame) -> DataFrame:
    """Box datasets (id, labels) after edits (id, n, action, label, new) in order n: add, remove or rename a label; unknown datasets are ignored."""
    listed = edits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "action", "label", "new"))).alias("_e"))

    def step(labels: Column, e: Column) -> Column:
        rest = F.filter(labels, lambda x: x != e["label"])
        renamed = F.array_distinct(F.transform(labels, lambda x: F.when(x == e["label"], e["new"]).otherwise(x)))
        return F.when(e["action"] == "add", F.array_append(rest, e["label"])).when(e["action"] == "remove", rest).when(e["action"] == "rename", renamed).otherwise(labels)

    both = datasets.join(listed, "id", "left")
    return both.withColumn("labels", F.when(F.col("_e").isNull(), F.col("labels")).otherwise(F.aggregate("_e", F.col("labels"), step))).drop("_e")


def saved_boxes(stored: DataFrame, saves: DataFrame) -> DataFrame:
    """Box annotations (dataset_id, image_id, kind, boxes) after saves (dataset_id, image_id, n, mode, boxes).

    A draft replaces the image's draft; a submit replaces the annotation, clears the draft and keeps the annotation it replaces as a version; a delete
    removes annotation and draft. The last save of an image counts for each kind, in order n.
    """
    image = ["dataset_id", "image_id"]
    drafts = latest(saves.where("mode = 'draft'"), image, F.col("n").desc()).select(*image, F.col("n").alias("dn"), F.col("boxes").alias("db"))
    submits = saves.where("mode = 'submit'")
    last = latest(submits, image, F.col("n").desc()).select(*image, F.col("n").alias("sn"), F.col("boxes").alias("sb"))
    gone = saves.where("mode = 'delete'").groupBy(*image).agg(F.max("n").alias("gn"))
    old = stored.groupBy(*image).agg(F.first(F.when(F.col("kind") == "annotation", F.col("boxes")), True).alias("ob"), F.first(F.when(F.col("kind") == "draft", F.col("boxes")), True).alias("od"))
    both = old.join(drafts, image, "full").join(last, image, "full").join(gone, image, "left")
    never = F.lit(-1)
    n = lambda c: F.coalesce(F.col(c), never)
    annotation = F.when((n("sn") > n("gn")), F.col("sb")).when(F.col("gn").isNull(), F.col("ob"))
    draft = F.when((n("dn") > n("gn")) & (n("dn") > n("sn")), F.col("db")).when(F.col("gn").isNull() & F.col("sn").isNull() & F.col("dn").isNull(), F.col("od"))
    now = both.select(*image, F.explode(F.array(F.struct(F.lit("annotation").alias("kind"), annotation.alias("boxes")), F.struct(F.lit("draft").alias("kind"), draft.alias("boxes")))).alias("e")).select(*image, "e.*")
    replaced = old.where("ob is not null").join(submits.select(*image).distinct(), image, "left_semi").select(*image, F.lit("version").alias("kind"), F.col("ob").alias("boxes"))
    order = Window.partitionBy(*image).orderBy("n")
    earlier = submits.withColumn("_last", F.lead("n").over(order).isNull()).where("not _last").select(*image, F.lit("version").alias("kind"), "boxes")
    kept = stored.where("kind = 'version'").select(*image, "kind", "boxes")
    return now.where("boxes is not null").unionByName(replaced).unionByName(earlier).unionByName(kept)


def deleted(jobs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The jobs that stay, and a report (pos, wanted, job_id, error) of the ids (pos, wanted) to delete.

    An id is a job id, a dataset id or a file name. An id that no job answers to, or whose job an earlier id has deleted already, has an error and
    stops nothing; blank ids are skipped.
    """
    asked = ids.where(F.trim(F.coalesce("wanted", F.lit(""))) != "")
    found = asked.join(resolved_ids(asked.select("wanted").distinct(), jobs), "wanted", "left")
    turn = F.row_number().over(Window.partitionBy("job_id").orderBy("pos"))
    gone = F.col("job_id").isNull() | (turn > 1)
    report = found.select("pos", "wanted", "job_id", F.when(gone, F.concat(F.lit("FileNotFoundError: dataset not found: "), "wanted")).alias("error"))
    return jobs.join(report.where("error is null").select("job_id"), "job_id", "left_anti"), report


def with_replaced_blocks(pages: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Job pages (doc, page_id, blocks) with the blocks that corrections (doc, page_id, blocks: annotation blocks) hold for them, and (doc, blocks): each job's list
    of the blocks that were replaced, in the order of pages. Pages without a correction keep their blocks and are no part of the list; corrections of pages that the job lacks
    are ignored; of two corrections of a page the later one (column ``pos``) counts."""
    from leafgrid.operators.blocks import job_block

    newest = latest(corrections, ["doc", "page_id"], F.col("pos").desc())
    new = newest.select("doc", "page_id", F.transform("blocks", job_block).alias("_new"))
    both = pages.join(new, ["doc", "page_id"], "left")
    replaced = both.select("doc", "page_id", F.coalesce("_new", "blocks").alias("blocks"), F.col("_new").isNotNull().alias("replaced"))
    listed = replaced.groupBy("doc").agg(F.array_sort(F.collect_list(F.when(F.col("replaced"), F.struct("page_id", "blocks")))).alias("p"))
    none = F.slice(F.array(F.lit(None)), 1, 0)
    return replaced, listed.select("doc", F.coalesce(F.flatten(F.transform("p", lambda x: x["blocks"])), none).alias("blocks"))
