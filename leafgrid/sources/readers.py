"""Readers and writers of jobs, annotations, JSON lines and page images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafgrid.functions import text as T
from leafgrid.operators.catalog import latest, repeated_keys

BLOCK = (
    "struct<id:string,text:string,bbox:array<double>,bbox_1000:array<double>,model_bbox:array<double>,page_id:int,block_type:string,label:string,type:string,description:string,"
    "chart_description:string,level:string,source:string,modified:boolean,modified_fields:array<string>>"
)
PAGE = (
    f"struct<page_id:int,image_url:string,image_path:string,width:int,height:int,status:string,blocks:array<{BLOCK}>,model_input:struct<system:string,user:string>,"
    "model_image_url:string,model_width:int,model_height:int,model_content_bbox:array<double>,error:string,elapsed_time:double>"
)
JOB = (
    f"job_id string, filename string, file_name string, document_name string, name string, status string, page_count int, completed_pages int, pages array<{PAGE}>, "
    f"result struct<image_path:string,blocks:array<{BLOCK}>>, warnings array<string>, errors array<string>, config struct<base_url:string,model:string,model_dir:string>, model string, model_name string, "
    "prompt_template struct<id:string,name:string,category:string>"
)


def read_jobs(spark: SparkSession, *paths: str) -> DataFrame:
    """Job or annotation files below the given globs, one row per file, with its path; a file matched twice counts once."""
    jobs = spark.read.schema(JOB).option("multiLine", True).option("mode", "PERMISSIVE").json(list(paths))
    return jobs.withColumn("path", F.col("_metadata.file_path")).dropDuplicates(["path"])


def preferred_results(files: DataFrame) -> DataFrame:
    """Only files named result.json if there are any, else all but dataset_state.json."""
    name = T.base_name(F.col("path"))
    files = files.where(name != "dataset_state.json").withColumn("_r", (name == "result.json").cast("int"))
    best = files.agg(F.max("_r").alias("_b"), F.lit(1).alias("_one"))
    return files.withColumn("_one", F.lit(1)).join(best, "_one").where("_r = _b").drop("_r", "_b", "_one")


def latest_versions(files: DataFrame) -> DataFrame:
    """Of each folder the annotation_v2_* file with the greatest name."""
    versions = files.where(T.base_name(F.col("path")).startswith("annotation_v2_")).withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    return latest(versions, ["folder"], F.col("path").desc()).drop("folder")


def keyed(files: DataFrame) -> DataFrame:
    """Adds the document key of each file."""
    return files.withColumn("doc", T.document_key([F.col("file_name"), F.col("filename"), F.col("document_name"), F.col("name")], F.col("path")))


def check_unique(files: DataFrame, key: str = "doc") -> DataFrame:
    """The files, if no key occurs twice; else an error that names some."""
    twice = [r[key] for r in repeated_keys(files, [key]).limit(5).collect()]
    if twice:
        raise ValueError(f"duplicate documents: {twice}")
    return files


def blocks_of(files: DataFrame) -> DataFrame:
    """Blocks of keyed files: doc, page_id, idx, id, label, level, x1, y1, x2, y2, text; rows without a proper box are dropped.

    A long document may lie in several files, numbered by a column ``part``; idx goes on from part to part, and no task holds more than a part's blocks.
    """
    part = F.col("part") if "part" in files.columns else F.lit(0).alias("part")
    pages = files.select("doc", part, F.posexplode("pages").alias("pn", "page")).where("page is not null")
    rows = pages.select("doc", "part", "pn", F.coalesce("page.page_id", F.lit(0)).alias("page_id"), F.posexplode("page.blocks").alias("bn", "b")).where("b is not null and size(b.bbox) = 4")
    box = [F.get(F.col("b.bbox"), F.lit(i)) for i in range(4)]
    rows = rows.select(
        "doc", "part", "pn", "bn", "page_id", F.coalesce(T.filled(F.col("b.id")), F.format_string("p%03d_b%03d", F.col("page_id"), F.col("bn"))).alias("id"),
        T.label_or(F.col("b.label"), F.col("b.block_type")).alias("label"), F.coalesce(T.filled(F.col("b.level")), F.lit("none")).alias("level"),
        F.least(box[0], box[2]).alias("x1"), F.least(box[1], box[3]).alias("y1"), F.greatest(box[0], box[2]).alias("x2"), F.greatest(box[1], box[3]).alias("y2"), F.coalesce("b.text", F.lit("")).alias("text"),
    ).where("x1 < x2 and y1 < y2")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("doc", "part").orderBy("pn", "bn")) - 1
    if "part" not in files.columns:
        return rows.withColumn("idx", place).drop("part", "pn", "bn")
    before = Window.partitionBy("doc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("doc", "part").agg(F.count(F.lit(1)).alias("_n")).select("doc", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.withColumn("idx", place).join(sizes, ["doc", "part"]).withColumn("idx", (F.col("idx") + F.col("_before")).cast("int")).drop("part", "pn", "bn", "_before")


def failed_pages(files: DataFrame) -> DataFrame:
    """(doc, page_id) that error texts of keyed files name."""
    return files.select("doc", F.explode("errors").alias("e")).select("doc", T.failed_page(F.col("e")).alias("page_id")).where("page_id is not null").distinct()


def with_job_defaults(jobs: DataFrame, template: tuple[str, str, str] = ("default_template_1", "默认模板 1", "layout")) -> DataFrame:
    """Jobs with missing fields filled in."""
    from leafgrid.operators.catalog import model_folder, model_name

    pages = F.coalesce("pages", F.array().cast(f"array<{PAGE}>"))
    finished = F.size(F.filter(pages, lambda p: p["status"].isin("done", "error")))
    model = model_name(F.col("config.model"), F.col("model"), F.col("model_name"))
    first = F.struct(*[F.lit(v).alias(k) for k, v in zip(("id", "name", "category"), template, strict=True)])
    return jobs.withColumns({
        "filename": F.coalesce("filename", F.lit("未知文件")), "status": F.coalesce("status", F.lit("complete")), "completed_pages": F.coalesce("completed_pages", finished), "pages": pages,
        "warnings": F.coalesce("warnings", F.array().cast("array<string>")), "errors": F.coalesce("errors", F.array().cast("array<string>")), "prompt_template": F.coalesce("prompt_template", first),
        "config": F.struct(F.col("config.base_url").alias("base_url"), model.alias("model"), F.coalesce(F.col("config.model_dir"), model_folder(model)).alias("model_dir")),
    })


def read_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines; blank lines and values other than objects are skipped, a malformed line fails the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.parse_json("value")
    objects = lines.where(F.schema_of_variant(parsed).startswith("OBJECT"))
    return objects.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_lines(rows: DataFrame, path: str) -> None:
    """Compact JSON lines with nulls kept."""
    rows.select(F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def image_rows(spark: SparkSession, path: str, dataset: Column) -> DataFrame:
    """Image files as rows: id from the name, default size; pixels are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    name = T.base_name(F.col("path"))
    return files.where(~name.startswith(".")).select(dataset.alias("dataset_id"), T.image_id(name).alias("id"), name.alias("filename"), F.lit(800).alias("width"), F.lit(600).alias("height"))


def first_annotations(spark: SparkSession, *paths: str) -> DataFrame:
    """First annotations below the globs: the files named result.json, each with its document key; two files of one document fail the read."""
    return check_unique(keyed(read_jobs(spark, *paths).where(T.base_name(F.col("path")) == "result.json")))
