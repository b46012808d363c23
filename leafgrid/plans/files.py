"""Round trips of sources and sinks: files are written to the cluster's shared folder and read back, with DuckDB SQL for the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrid.functions import text as T
from leafgrid.operators import export as X
from leafgrid.plans.registry import Registry
from leafgrid.plans.tables import _UNITS, units
from leafgrid.sources import readers as R
from leafgrid.sources import views as V
from leafgrid.sources.job_store import JobStore, copy_images, listing, page_images, write_files
from leafgrid.streaming.incremental import shared_folder

REGISTRY = Registry()
#: Pages in a part of a long document.
PART = 1000


def _one_file_each(rows, folder: str, *dirs: str) -> None:
    """A text file per value of the directory columns, from the column ``value``."""
    rows.repartition(_writers(rows), *dirs).write.mode("append").partitionBy(*dirs).text(folder)


def _writers(rows) -> int:
    """Tasks that write small files: two a core of the cluster."""
    return max(8, 2 * rows.sparkSession.sparkContext.defaultParallelism)


@REGISTRY.query("s1_p1_scanned_jobs", """
SELECT 'j' || CAST(s_suppkey AS VARCHAR) AS job_id, CASE WHEN s_suppkey % 3 = 0 THEN '未知文件' ELSE s_name END AS filename, CASE WHEN s_suppkey % 2 = 0 THEN 'complete' ELSE 'running' END AS status, CAST(s_suppkey % 4 - s_suppkey % 4 // 2 AS INTEGER) AS completed_pages,
       CASE WHEN s_suppkey % 5 = 0 THEN 'm/x' ELSE '未知' END AS model FROM supplier""")
def s1(spark, d):
    """Jobs in two directory depths of nested roots; each file counts once without a shuffle, retired keys are not read, missing fields get defaults."""
    return R.with_job_defaults(_job_store(spark, d).scan()).select("job_id", "filename", "status", "completed_pages", F.col("config.model").alias("model"))


@REGISTRY.query("s2_job_lookup", """
SELECT 'j' || CAST(s_suppkey AS VARCHAR) AS job_id, CASE WHEN s_suppkey % 2 = 0 THEN 'complete' ELSE 'running' END AS status, CAST(s_suppkey AS VARCHAR) AS job FROM supplier WHERE s_suppkey BETWEEN 1 AND 10""")
def s2_lookup(spark, d):
    """Ten jobs and one that is not there, by their folders: even ones are flat, odd ones one level deeper. Only their files are read."""
    found = _job_store(spark, d).find([*map(str, range(1, 11)), "nowhere"])
    return R.with_job_defaults(found).select("job_id", "status", "job")


def _job_store(spark, d):
    k = F.col("s_suppkey")
    pages = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < k % 4), lambda i: F.struct(i.cast("int").alias("page_id"), F.when(i % 2 == 0, "done").otherwise("pending").alias("status"), F.lit("x").alias("retired")))
    job = F.struct(F.concat(F.lit("j"), k.cast("string")).alias("job_id"), F.when(k % 3 != 0, F.col("s_name")).alias("filename"), F.when(k % 2 == 1, "running").alias("status"), pages.alias("pages"), F.when(k % 5 == 0, "m/x").alias("model"), F.lit("gone").alias("layout_prompt"))
    rows = V.table(spark, d, "supplier").select(k.alias("job"), (k % 3).alias("user"), F.to_json(job).alias("value"))
    root = f"{shared_folder(spark)}/store"
    _one_file_each(rows.where("job % 2 = 0").drop("user"), root, "job")
    _one_file_each(rows.where("job % 2 = 1"), root, "user", "job")
    return JobStore(spark, root, f"{root}/user=0", file="part-*.txt", folder="job={}")


@REGISTRY.query("k9_r24_copied_images", """
WITH p AS (
  SELECT page_id, 'j' || CAST(page_id // 5 AS VARCHAR) AS job, page_id % 5 AS no, page_id % 6 AS m, html FROM pages)
SELECT page_id, CASE WHEN m <> 2 THEN printf('images/set_1/%s/page_%03d.png', job, no) END AS target, CAST(CASE WHEN m = 4 THEN 0 WHEN m <> 2 THEN 1 END AS INTEGER) AS rank,
       CASE WHEN m <> 2 THEN sha256(coalesce(html, '')) END AS sha256, CASE WHEN m = 2 THEN 'no file at the url or the page''s places' END AS reason FROM p""")
def k9_r24(spark, d):
    """Page images found by URL or by their place in the job's folder, copied byte for byte; those that are missing have a reason."""
    p, i = V.table(spark, d, "pages"), F.col("page_id")
    job = F.concat(F.lit("j"), F.floor(i / 5).cast("string"))
    own = F.format_string("pages/page_%03d.png", (i % 5).cast("int"))
    folder = shared_folder(spark)
    place = F.concat_ws("/", job, F.when(i % 6 == 4, F.concat(F.lit("extra/p"), i.cast("string"), F.lit(".png"))).otherwise(own))
    write_files(p.where(i % 6 != 2).select(place.alias("name"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("content")), f"{folder}/jobs")
    base = F.lit(f"{folder}/jobs/")
    url = F.concat(F.lit("/jobs/"), job, F.when(i % 6 == 4, F.concat(F.lit("/extra/p"), i.cast("string"), F.lit(".png"))).otherwise("/gone.png"))
    asked = p.select("page_id", job.alias("job"), F.regexp_replace(F.concat(base, job), "^(file:)?/+", "file:/").alias("folder"), (i % 5).cast("int").alias("page_no"), url.alias("image_url"), url.alias("model_image_url"))
    asked = asked.select(F.col("page_id").alias("id"), "job", "folder", F.col("page_no").alias("page_id"), "image_url", "model_image_url")
    found = page_images(asked, listing(spark, f"{folder}/jobs/*"))
    out = copy_images(found, f"{folder}/export", F.lit("set 1"))
    back = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/export/images").select(F.regexp_extract("path", "(images/.*)$", 1).alias("target"), F.sha2("content", 256).alias("sha256"))
    return out.join(back, "target", "left").select(F.col("id").alias("page_id"), "target", "rank", "sha256", "reason")


@REGISTRY.query("s3_json_lines", "SELECT event_id, event_type, user_id FROM events WHERE event_id % 5 <> 1 AND event_id % 5 <> 2")
def s3(spark, d):
    """Blank lines and values that are no objects are skipped."""
    i = F.col("event_id")
    line = F.when(i % 5 == 1, "  ").when(i % 5 == 2, F.to_json(F.array(i))).otherwise(F.to_json(F.struct("event_id", "event_type", "user_id")))
    folder = shared_folder(spark)
    V.table(spark, d, "events").select(line.alias("value")).write.text(f"{folder}/lines")
    return R.read_lines(spark, f"{folder}/lines", "event_id long, event_type string, user_id long")


@REGISTRY.query("s4_evaluator_scan", V.with_views("gt") + """,
f AS (SELECT *, doc % 25 AS file, CAST(doc // 25 * 5 + page_id AS INTEGER) AS page FROM gt),
g AS (SELECT *, row_number() OVER (PARTITION BY file, page ORDER BY doc, idx) - 1 AS bn FROM f)
SELECT 'f' || CAST(file AS VARCHAR) AS doc, page AS page_id, CASE WHEN bn % 3 = 0 THEN 'b' || CAST(bn AS VARCHAR) ELSE printf('p%03d_b%03d', page, bn) END AS id, label, level, x1, y1, x2, y2, text,
       CAST(row_number() OVER (PARTITION BY file ORDER BY page, bn) - 1 AS INTEGER) AS idx FROM g WHERE bn % 7 <> 6""")
def s4(spark, d):
    """Blocks of job files: swapped boxes are ordered, boxes without area dropped, missing ids and levels filled in."""
    from pyspark.sql import Window

    g = V.gt_blocks(spark, d).withColumns({"file": F.col("doc") % 25, "page": (F.floor(F.col("doc") / 25) * 5 + F.col("page_id")).cast("int")})
    g = g.withColumn("bn", F.row_number().over(Window.partitionBy("file", "page").orderBy("doc", "idx")) - 1)
    box = F.when(F.col("bn") % 7 == 6, F.array("x1", "y1", "x1", "y2")).when(F.col("bn") % 2 == 1, F.array("x2", "y2", "x1", "y1")).otherwise(F.array("x1", "y1", "x2", "y2"))
    block = F.struct("bn", F.when(F.col("bn") % 3 == 0, F.concat(F.lit("b"), F.col("bn").cast("string"))).alias("id"), F.when(F.col("bn") % 4 != 1, F.col("label")).alias("label"), F.col("label").alias("block_type"), F.nullif("level", F.lit("none")).alias("level"), box.alias("bbox"), "text")
    pages = g.groupBy("file", "page").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    # A document is as long as the corpus, so its result lies in parts of some pages; a part is what one row has to hold.
    files = pages.groupBy("file", F.floor(F.col("page") / PART).alias("part")).agg(F.array_sort(F.collect_list(F.struct(F.col("page").alias("page_id"), "blocks"))).alias("pages"))
    folder = shared_folder(spark)
    rows = files.select("file", "part", F.to_json(F.struct(F.concat(F.lit("f"), F.col("file").cast("string"), F.lit(".pdf")).alias("file_name"), "pages")).alias("value"))
    rows.write.partitionBy("file", "part").text(folder)
    jobs = R.keyed(R.read_jobs(spark, f"{folder}/*/*/*.txt")).withColumn("part", F.regexp_extract("path", "/part=([0-9]+)/", 1).cast("int"))
    return R.blocks_of(jobs)


@REGISTRY.query("s13_gold_lines", _UNITS + "\nSELECT i AS unit_id, lang AS document_id, '第' || CAST(i AS VARCHAR) || '条' AS unit_number, kind FROM un")
def s13(spark, d):
    """Gold units written as JSON lines and read with their schema."""
    u = units(spark, d)
    folder = shared_folder(spark)
    R.write_lines(u, f"{folder}/gold")
    kept = R.read_lines(spark, f"{folder}/gold", u.schema)
    return kept.select("unit_id", "document_id", "unit_number", F.col("answer.rules")[0]["kind"].alias("kind"))


@REGISTRY.query("k1_k2_compact_lines", """SELECT '{"event_id":' || CAST(event_id AS VARCHAR) || ',"kind":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"' || event_type || '"' END || ',"tags":["' || event_type || '",null]}' AS line FROM events""")
def k2(spark, d):
    """Compact separators and nulls in the written text; a second write replaces the first as a whole."""
    rows = V.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("kind"), F.array(F.col("event_type"), F.lit(None)).alias("tags"))
    folder = shared_folder(spark)
    R.write_lines(rows.where("event_id < 10"), f"{folder}/lines")
    R.write_lines(rows, f"{folder}/lines")
    return spark.read.text(f"{folder}/lines").withColumnRenamed("value", "line")


@REGISTRY.query("k6_convert_files", r"""
WITH t AS (SELECT 'ds' || CAST(n_nationkey AS VARCHAR) AS id, n_name, n_regionkey AS r, n_nationkey AS k FROM nation),
u AS (SELECT *, '  cd ' || id || chr(10) || '  swift sft --model <model> --dataset val.jsonl --train_type lora' || chr(10) AS usage FROM t)
SELECT id AS dataset_id, 'dataset_info.json' AS path, '{"format":"swift","files":["val.jsonl"],"columns":{"messages":"messages","images":"images"}}' AS content FROM u
UNION ALL SELECT id, 'convert_config.json', '{"source_datasets":["' || id || '","' || n_name || '"],"target_format":"swift","merge":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ',"split_type":"val","created_at":"2024-01-01T00:00:00","operator":"","output_path":"' || id || '"}' FROM u
UNION ALL SELECT id, 'convert_log.txt', 'start' || chr(10) || n_name || chr(10) || 'skipped_samples=' || CAST(r AS VARCHAR) || chr(10) || chr(10) || usage FROM u
UNION ALL SELECT id, 'README_ms_swift.txt', usage FROM u""")
def k6(spark, d):
    """The small files of a conversion, one text file each, read back as whole files."""
    k = F.col("n_nationkey")
    name = F.concat(F.lit("ds"), k.cast("string"))
    tasks = V.table(spark, d, "nation").select(name.alias("dataset_id"), F.array(name, "n_name").alias("sources"), (k % 2 == 0).alias("merge"), F.lit("2024-01-01T00:00:00").alias("created_at"), F.array(F.lit("start"), "n_name").alias("logs"), F.col("n_regionkey").alias("skipped"))
    folder = shared_folder(spark)
    files = X.convert_files(tasks, "swift", "val")
    files.repartition(8, "dataset_id", "path").select("dataset_id", "path", F.col("content").alias("value")).write.partitionBy("dataset_id", "path").option("lineSep", "\u0000").text(folder)
    back = spark.read.text(folder, wholetext=True)
    return back.select("dataset_id", "path", F.regexp_replace("value", "\u0000$", "").alias("content"))


@REGISTRY.query("k7_pretty_json", "SELECT event_id, event_type, CAST(4 AS BIGINT) AS lines FROM events")
def k7(spark, d):
    """Indented JSON objects, read back; an object of two fields takes four lines."""
    folder = shared_folder(spark)
    X.write_pretty(V.table(spark, d, "events").select("event_id", "event_type"), f"{folder}/pretty")
    whole = spark.read.text(f"{folder}/pretty", wholetext=True)
    objects = whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)\{.*?\n\}"), F.lit(0))).alias("o"))
    parsed = F.from_json("o", "event_id long, event_type string")
    return objects.select(parsed.alias("p"), F.size(F.split("o", "\n")).cast("long").alias("lines")).select("p.event_id", "p.event_type", "lines")


_FILES = V.with_views("gt") + """,
fl AS (SELECT 'c' || CAST(doc % 3 AS VARCHAR) AS category, doc, page_id, count(*) FILTER (label <> 'text') AS blocks FROM gt GROUP BY ALL)"""


@REGISTRY.query("k8_category_export", _FILES + """,
m AS (SELECT category, count(*) FILTER (blocks > 0) AS samples, count(*) AS pages, CAST(sum(blocks) AS BIGINT) AS blocks, count(DISTINCT doc) AS files FROM fl GROUP BY category)
SELECT category, category || '.jsonl' AS dataset, samples, pages, blocks, files, samples AS written, (SELECT CAST(sum(samples) AS BIGINT) FROM m) AS total_samples FROM m""")
def k8(spark, d):
    """Samples by category, manifests and index, written and read back."""
    pages = V.gt_blocks(spark, d).groupBy(F.concat(F.lit("c"), (F.col("doc") % 3).cast("string")).alias("category"), "doc", "page_id").agg(F.count_if(F.col("label") != "text").alias("blocks"))
    files = pages.groupBy("category", F.col("doc").cast("string").alias("file")).agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("blocks") > 0).alias("samples"), F.sum("blocks").alias("blocks"))
    folder = shared_folder(spark)
    X.export_categories(pages.where("blocks > 0").select("category", "doc", "page_id", "blocks"), files, folder)
    written = spark.read.json(f"{folder}/data").groupBy("category").agg(F.count(F.lit(1)).alias("written"))
    index = spark.read.json(f"{folder}/index").select(F.col("samples").alias("total_samples"), F.explode("categories").alias("category"))
    manifests = spark.read.json(f"{folder}/manifests").select("category", "dataset", "samples", "pages", "blocks", F.size("files").cast("long").alias("files"))
    return manifests.join(written, "category").join(index, "category")


@REGISTRY.query("k5_split_files", "SELECT conv_id, turn, role FROM conversations")
def k5(spark, d):
    """A split's JSON lines by directory, read back."""
    folder = shared_folder(spark)
    X.write_split(V.table(spark, d, "conversations").select("conv_id", "turn", "role"), folder, "all")
    return spark.read.json(folder).where("split = 'train'").select("conv_id", "turn", "role")


@REGISTRY.query("s6_first_annotations", "SELECT 'r' || CAST(n_nationkey AS VARCHAR) AS doc, CAST(n_regionkey + 1 AS INTEGER) AS pages FROM nation")
def s6(spark, d):
    """Annotation files keyed by document name; a key that occurs twice would fail."""
    k = F.col("n_nationkey")
    pages = F.transform(F.sequence(F.lit(0), F.col("n_regionkey").cast("int")), lambda i: F.struct(i.alias("page_id")))
    names = F.struct(F.when(k % 2 == 0, F.concat(F.lit("r"), k.cast("string"), F.lit(".pdf"))).alias("file_name"), F.concat(F.lit("r"), k.cast("string"), F.lit(".pdf")).alias("filename"), pages.alias("pages"))
    folder = shared_folder(spark)
    _one_file_each(V.table(spark, d, "nation").select(k.alias("job"), F.to_json(names).alias("value")), folder, "job")
    files = R.check_unique(R.keyed(R.read_jobs(spark, f"{folder}/*/*.txt")))
    return files.select("doc", F.size("pages").alias("pages"))


@REGISTRY.query("s12_image_rows", "SELECT region.r_regionkey AS n, 'd1' AS dataset_id, CAST(800 AS INTEGER) AS width, CAST(600 AS INTEGER) AS height FROM region")
def s12(spark, d):
    """Files of a folder as image rows with the default size."""
    folder = shared_folder(spark)
    _one_file_each(V.table(spark, d, "region").select(F.col("r_regionkey").alias("n"), F.col("r_name").alias("value")), folder, "n")
    rows = R.image_rows(spark, f"{folder}/*/*", F.lit("d1")).where(F.col("filename").endswith(".txt") & (F.col("id") != ""))
    n = spark.read.format("binaryFile").load(f"{folder}/*/*").select(T.base_name(F.col("path")).alias("filename"), F.regexp_extract("path", "/n=([0-9]+)/", 1).cast("int").alias("n"))
    return n.join(rows, "filename").select("n", "dataset_id", "width", "height").distinct()
