"""Training data: questions and answers, prompts with outlines, fine-tuning samples, split files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid.functions import jsonx as J
from leafgrid.functions import text as T
from leafgrid.functions.geometry import let

#: Default prompts of training samples.
SYSTEM = "你是一个专业的文档版面分析模型。"
USER = "<image>\n请识别图片中的所有主要版面块，并按照阅读顺序输出严格合法的 JSON。"
SPLITS = ("train", "val", "test", "all")


def page_answers(blocks: DataFrame) -> DataFrame:
    """(doc, page_id, blocks): exported block structs (column b, order ord) of each page in order."""
    return blocks.groupBy("doc", "page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "b"))).alias("x")).select("doc", "page_id", F.transform("x", lambda v: v["b"]).alias("blocks"))


def refreshed_answers(qa: DataFrame, pages: DataFrame, outlines: DataFrame) -> DataFrame:
    """Q&A rows (doc, page_id, image, system, user, assistant) with the answers and prompts of corrected pages.

    ``pages`` has doc, page_id, width, height, blocks; rows without a page stay as they are.
    """
    known = pages.join(outlines.select("doc", "page_id", "outline"), ["doc", "page_id"], "left")
    both = qa.join(known.select("doc", "page_id", "width", "height", "blocks", "outline", F.lit(True).alias("_p")), ["doc", "page_id"], "left")
    user = F.concat_ws("\n\n", T.page_text(F.col("page_id"), F.col("width"), F.col("height")), "outline")
    answer = J.compact(F.struct(F.col("image").alias("image_path"), F.col("blocks")))
    return both.withColumns({"user": F.when(F.col("_p"), user).otherwise(F.col("user")), "assistant": F.when(F.col("_p"), answer).otherwise(F.col("assistant"))}).drop("width", "height", "blocks", "outline", "_p")


def training_lines(pages: DataFrame, outlines: DataFrame) -> DataFrame:
    """(doc, page_id, image, input, output): one line a page, with the outline of the pages before it."""
    both = pages.join(outlines.select("doc", "page_id", "outline"), ["doc", "page_id"], "left")
    user = F.concat_ws("\n\n", T.page_text(F.col("page_id"), F.col("width"), F.col("height")), "outline")
    return both.select("doc", "page_id", "image", F.struct(F.lit("").alias("system"), user.alias("user")).alias("input"), F.struct("blocks").alias("output"))


def image_ref(dataset: Column, page_id: Column, suffix: Column) -> Column:
    return F.format_string("images/%s/page_%03d%s", T.safe_name(dataset), page_id, F.coalesce(T.filled(suffix), F.lit(".png")))


def samples(qa: DataFrame, style: str, images: DataFrame | None = None) -> DataFrame:
    """Fine-tuning samples of Q&A rows (doc, page_id, image, system, user, assistant); rows without image or answer are left out.

    ``style`` is swift (messages, images) or llamafactory (instruction, input, output, system, images). ``images`` lists
    the image files (doc, image) that exist.
    """
    rows = qa.where((F.trim("image") != "") & (T.after_thinking(F.col("assistant")) != ""))
    if images is not None:
        rows = rows.join(images.select("doc", "image").distinct(), ["doc", "image"], "left_semi")
    ref = image_ref(F.col("doc").cast("string"), F.col("page_id"), F.regexp_extract("image", r"(\.[^./]+)$", 1))
    answer = T.after_thinking(F.col("assistant"))
    named = lambda v: F.try_variant_get(v, "$.image_path", "string").eqNullSafe(ref)  # noqa: E731 - an answer that names the image already stays as it is
    blocks = lambda v: F.when(~named(v), F.try_variant_get(v, "$.blocks", "string"))
    put = lambda a, b: F.when(b.startswith("["), F.concat(F.lit('{"image_path":"'), ref, F.lit('","blocks":'), b, F.lit("}"))).otherwise(a)
    rewritten = let(answer, lambda a: let(F.try_parse_json(J.model_object(a)), lambda v: let(blocks(v), lambda b: put(a, b))))
    rows = rows.select("doc", "page_id", F.coalesce(T.filled(F.col("system")), F.lit(SYSTEM)).alias("system"), T.with_image_token(F.coalesce(T.filled(F.col("user")), F.lit(USER))).alias("user"), rewritten.alias("answer"), ref.alias("ref"))
    if style == "swift":
        message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
        return rows.select("doc", "page_id", F.array(message("system", "system"), message("user", "user"), message("assistant", "answer")).alias("messages"), F.array("ref").alias("images"))
    if style == "llamafactory":
        return rows.select("doc", "page_id", F.col("user").alias("instruction"), F.lit("").alias("input"), F.col("answer").alias("output"), "system", F.array("ref").alias("images"))
    raise ValueError("style is 'swift' or 'llamafactory'")


def with_split(rows: DataFrame, split: str) -> DataFrame:
    """The split column; all rows go to one file, ``all`` to train."""
    if split not in SPLITS:
        raise ValueError(f"split is one of {SPLITS}")
    return rows.withColumn("split", F.lit("train" if split == "all" else split))


def write_split(rows: DataFrame, folder: str, split: str) -> None:
    """JSON lines under folder/split=<name>."""
    with_split(rows, split).write.mode("overwrite").partitionBy("split").option("ignoreNullFields", "false").json(folder)


def dataset_info(style: str, files: list[str]) -> dict:
    columns = {"messages": "messages", "images": "images"} if style == "swift" else {"prompt": "instruction", "query": "input", "response": "output", "system": "system", "images": "images"}
    return {"format": style, "files": files, "columns": columns}


def export_stats(pages: DataFrame) -> DataFrame:
    """Per file, per category and in all: pages, exported pages, blocks; from (category, file, blocks count)."""
    return pages.rollup("category", "file").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("blocks") > 0).alias("samples"), F.sum("blocks").alias("blocks"), F.grouping_id().cast("int").alias("level"))


def chosen_image(model_url: Column, page_url: Column, default: Column, files: Column) -> Column:
    """First of model image, default model file, page image among the files of a dataset (array)."""
    have = lambda c: F.when(F.array_contains(files, c), c)
    return F.coalesce(have(model_url), have(default), have(page_url))


def usable_pages(pages: DataFrame, min_blocks: int = 1) -> DataFrame:
    """Adds why a page is left out: not done, or fewer blocks than asked for; null for pages that are used."""
    return pages.withColumn("skipped", F.when(F.col("status") != "done", "not_done").when(F.col("blocks") < min_blocks, "few_blocks"))


def convert_files(tasks: DataFrame, style: str, split: str) -> DataFrame:
    """(dataset_id, path, content): the small files beside an exported dataset, from (dataset_id, sources, merge, created_at, logs, skipped).

    dataset_info.json names the split's file and columns, convert_config.json the task, convert_log.txt its log; swift sets have a usage note.
    """
    file = ("train" if split == "all" else split) + ".jsonl"
    info = json.dumps(dataset_info(style, [file]), ensure_ascii=False, separators=(",", ":"))
    config = J.compact(F.struct(
        F.col("sources").alias("source_datasets"), F.lit(style).alias("target_format"), "merge", F.lit(split).alias("split_type"), "created_at", F.lit("").alias("operator"), F.col("dataset_id").alias("output_path")))
    usage = F.concat(F.lit("  cd "), F.col("dataset_id"), F.lit(f"\n  swift sft --model <model> --dataset {file} --train_type lora\n"))
    log = F.concat(F.array_join("logs", "\n"), F.lit("\nskipped_samples="), F.col("skipped").cast("string"), F.lit("\n"))
    made = [("dataset_info.json", F.lit(info)), ("convert_config.json", config), ("convert_log.txt", F.concat(log, F.lit("\n"), usage) if style == "swift" else log)]
    if style == "swift":
        made.append(("README_ms_swift.txt", usage))
    files = F.array(*[F.struct(F.lit(path).alias("path"), content.alias("content")) for path, content in made])
    return tasks.select("dataset_id", F.explode(files).alias("f")).select("dataset_id", "f.*")


def write_pretty(rows: DataFrame, path: str) -> None:
    """One indented JSON object per row, rows apart by lines of their own."""
    rows.select(F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def category_manifests(files: DataFrame) -> DataFrame:
    """(category, dataset, samples, pages, blocks, files) from per-file rows (category, file, pages, samples, blocks); categories without samples fail."""
    listed = F.array_sort(F.collect_list(F.struct("file", "pages", "samples", "blocks")))
    out = files.groupBy("category").agg(F.sum("samples").alias("samples"), F.sum("pages").alias("pages"), F.sum("blocks").alias("blocks"), listed.alias("files"))
    checked = F.when(F.col("samples") > 0, F.col("samples")).otherwise(F.raise_error(F.concat(F.lit("no usable samples in category "), F.col("category"))).cast("long"))
    return out.select("category", F.concat("category", F.lit(".jsonl")).alias("dataset"), checked.alias("samples"), "pages", "blocks", "files")


def export_categories(samples: DataFrame, files: DataFrame, folder: str) -> None:
    """Writes samples (category, ..) as JSON lines below folder/data/category=<name>, manifests below folder/manifests and the index to folder/index."""
    samples.repartition("category").write.mode("overwrite").partitionBy("category").option("ignoreNullFields", "false").json(f"{folder}/data")
    manifests = category_manifests(files)
    manifests.write.mode("overwrite").json(f"{folder}/manifests")
    index = manifests.agg(F.array_sort(F.collect_list("category")).alias("categories"), F.sum("samples").alias("samples"), F.sum("pages").alias("pages"), F.sum("blocks").alias("blocks"))
    index.write.mode("overwrite").json(f"{folder}/index")
