"""Page, question-and-answer and job projections that the exports and editors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid.functions import text as T


def relative_image(url: Column, path: Column, job: Column) -> Column:
    """Path of a page image below its job's folder: from a /jobs/ URL, else the stored path without leading slashes."""
    below = F.regexp_replace(url, F.concat(F.lit("^/jobs/(?:.*/)?"), job, F.lit("/")), "")
    return F.when(F.coalesce(url, F.lit("")).startswith("/jobs/"), below).otherwise(F.regexp_replace(T.clean(path), "^/+", ""))


def layout_page(page: Column, job: Column) -> Column:
    """A page struct (page_id, image_url, image_path, width, height, model_width, model_height) as stored with the layout."""
    return F.struct(
        F.coalesce(page["page_id"], F.lit(0)).alias("page_id"), relative_image(page["image_url"], page["image_path"], job).alias("image_path"), F.coalesce(page["image_url"], F.lit("")).alias("image_url"),
        F.coalesce(page["width"], F.lit(0)).alias("width"), F.coalesce(page["height"], F.lit(0)).alias("height"), page["model_width"].alias("model_width"), page["model_height"].alias("model_height"),
    )


def qa_entry(page_id: Column, image: Column, system: Column, user: Column, answer: Column) -> Column:
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(page_id.alias("page_id"), image.alias("image"), empty(system).alias("system"), empty(user).alias("user"), T.after_thinking(answer).alias("assistant"))


def uses_model_page(image: Column, model_image: Column) -> Column:
    """Whether an answer's image is the model's own page."""
    image = F.coalesce(image, F.lit(""))
    return (image != "") & ((image == F.coalesce(model_image, F.lit(""))) | image.startswith("model_pages/"))


def coordinate_instruction(width: Column, height: Column, pixel: Column) -> Column:
    """The sentence that asks the model for pixel or for grid coordinates."""
    w, h = width.cast("string"), height.cast("string")
    by_pixel = F.format_string('请输出当前 %sx%s 模型图像上的绝对像素 bbox，x 坐标范围为 0-%s，y 坐标范围为 0-%s，不要输出 0-1000 相对坐标；最终 JSON 顶层必须包含 "coordinate_mode": "pixel"。', w, h, w, h)
    return F.when(pixel, by_pixel).otherwise('请严格输出 0-1000 相对坐标 bbox，不要输出像素坐标；最终 JSON 顶层必须包含 "coordinate_mode": "normalized_1000"。')


def review_strip(y1: Column, y2: Column, height: Column, margin: int = 240, least: int = 320) -> Column:
    """struct(top, bottom) of the strip around a title that a visual review sees."""
    top = F.greatest(y1.cast("int") - margin, F.lit(0))
    return F.struct(top.alias("top"), F.least(height, F.greatest(y2.cast("int") + margin, top + least)).alias("bottom"))


def left_edge(bbox: Column) -> Column:
    """x1 of a box of four as double, else null."""
    return F.when(F.size(bbox) == 4, F.get(bbox, F.lit(0)).try_cast("double"))


def public_config(config: Column) -> Column:
    """A model configuration without its key: the key becomes a flag."""
    return F.struct(config["base_url"].alias("base_url"), config["model"].alias("model"), F.when(F.coalesce(config["api_key"], F.lit("")) != "", "true").otherwise("false").alias("has_api_key"))


def asset_path(current: Column, legacy: Column, by_job: Column, files: Column) -> Column:
    """The first of three candidate paths that is among the files; the current one if none is."""
    have = lambda c: F.when(F.array_contains(files, c), c)
    return F.coalesce(have(current), have(legacy), have(by_job), current)


def cleaned_errors(errors: Column, page_id: Column) -> Column:
    """Error texts of a job without those of one page (zero-based)."""
    return F.filter(errors, lambda e: ~F.coalesce(T.failed_page(e) == page_id, F.lit(False)))


def deletions(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dataset ids to delete, by kind: layout ones and box ones."""
    box = F.coalesce(F.col("annotation_type"), F.lit("layout")) == "bounding_box"
    return ids.where(~box), ids.where(box)


def repaired_labels(labels: Column) -> Column:
    """A list of label types with aliases resolved and repeats dropped, in order."""
    return F.array_distinct(F.transform(labels, lambda x: T.block_type(x)))


def project_row(jobs: DataFrame) -> DataFrame:
    """Jobs as the overview's projects: name, folded progress and whether they can be opened."""
    pages = F.coalesce("page_count", F.lit(0))
    share = F.when(pages > 0, F.floor(F.coalesce("completed_pages", F.lit(0)) / pages * 100 + 0.5)).otherwise(0).cast("long")
    return jobs.select("job_id", F.coalesce(T.filled(F.col("filename")), F.col("job_id")).alias("name"), share.alias("progress"), (pages > 0).alias("open"))


def snapshots(rows: DataFrame, mode: Column, stamp: Column) -> DataFrame:
    """Target file of a saved annotation: draft.json, the first annotation, or a version of its own; with the stage that follows."""
    target = F.when(mode == "draft", "draft.json").when(mode == "overwrite", "annotation.json").otherwise(F.concat(F.lit("annotation_v2_"), stamp, F.lit(".json")))
    stage = F.when(mode == "draft", "second_annotating").when(mode == "overwrite", "first_annotated").otherwise("second_annotated")
    return rows.withColumns({"target": target, "annotation_status": stage})


def first_match(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first row whose key has the value."""
    return rows.where(F.col(key) == value).orderBy(order).limit(1)
