"""Job folders: scans and lookups over two directory depths, and page images found and copied.

A store has roots; a job's folder lies in a root (``<root>/<job>/``) or one level below (``<root>/<model>/<job>/``) and holds a result file.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from leafgrid.functions import text as T
from leafgrid.sources.readers import JOB

#: Ids that one glob pattern names.
_IDS = 500


def _escaped(name: str) -> str:
    return re.sub(r"([\\{}\[\]*?,])", r"\\\1", name)


class JobStore:
    """``file`` is the name (or pattern) of a job's result file, ``folder`` the name of its folder for an id."""

    def __init__(self, spark: SparkSession, *roots: str, file: str = "result.json", folder: str = "{}") -> None:
        self.spark, self.roots, self.file, self.folder = spark, list(dict.fromkeys(r.rstrip("/") for r in roots)), file, folder

    def _glob(self, pattern: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(pattern)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(s.getPath().toString() for s in found or [])

    def _any(self, pattern: str) -> bool:
        """Whether a file fits: one of the first folders tells most often, else a count of all. No list of files comes to Python."""
        folder, file = posixpath.split(pattern)
        path = lambda p: self.spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path(folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for s in islice(fs.globStatus(path(folder)) or [], 20):
            if self._glob(f"{_escaped(s.getPath().toString())}/{file}"):
                return True
        return len(fs.globStatus(path(pattern)) or []) > 0

    def patterns(self) -> list[str]:
        """Globs that name every result file once: those of a root's own folders are left out where another root's second depth has them."""
        inner = [r for r in self.roots if posixpath.dirname(r) in self.roots]
        any_job = self.folder.format("*")
        return [f"{r}/{any_job}/{self.file}" for r in self.roots if r not in inner] + [f"{r}/*/{any_job}/{self.file}" for r in self.roots]

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], f"{JOB}, path string, job string")
        # No directory columns are inferred, so that a folder's name can't clash with a field.
        rows = self.spark.read.schema(JOB).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(paths)
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # the field is encoded as a URI
        before, after = self.folder.split("{}")
        name = F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)
        return rows.withColumns({"path": path, "job": F.substring(name, F.lit(len(before) + 1), F.length(name) - len(before) - len(after))})

    def scan(self) -> DataFrame:
        """All jobs, one row per result file, with its path and the job's folder name."""
        return self._read([p for p in self.patterns() if self._any(p)])

    def find(self, jobs: list[str]) -> DataFrame:
        """The jobs of the ids, each from the first place that has it: root by root, the flat folder before the deeper ones. Reads their files only."""
        left, paths = dict.fromkeys(j for j in jobs if j and "/" not in j), []
        for root in self.roots:
            for deep in ("", "*/"):
                for at in range(0, len(names := list(left)), _IDS):
                    wanted = ",".join(self.folder.format(_escaped(j)) for j in names[at : at + _IDS])
                    found: dict[str, list[str]] = {}
                    for path in self._glob(f"{root}/{deep}{{{wanted}}}/{self.file}"):
                        found.setdefault(posixpath.dirname(path), []).append(path)
                    for folder, files in found.items():
                        before, after = self.folder.split("{}")
                        base = posixpath.basename(folder)
                        job = base[len(before) : len(base) - len(after)]
                        if job in left:
                            del left[job]
                            paths += map(_escaped, files)  # Spark reads paths as globs
        return self._read(paths)

    def lookup(self, job: str) -> DataFrame:
        """One job; ``FileNotFoundError`` if no folder has it."""
        found = self.find([job])
        if not found.inputFiles():
            raise FileNotFoundError(f"job not found: {job}")
        return found


# --- images --------------------------------------------------------------------------------------------------------------


def listing(spark: SparkSession, *globs: str) -> DataFrame:
    """(file, length) of the files below the globs, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(globs)).select(F.col("path").alias("file"), "length")


def _below(url: Column, job: Column) -> Column:
    """What follows the job's name in a URL path; null if the name is no part of it or nothing follows."""
    parts = F.split(F.trim(url, F.lit("/")), "/")
    at = F.array_position(parts, job)
    rest = F.slice(parts, (at + 1).cast("int"), F.greatest(F.size(parts) - at, F.lit(0)).cast("int"))
    return F.when((at > 0) & (F.size(rest) > 0), F.array_join(rest, "/"))


def page_images(pages: DataFrame, files: DataFrame, source: str = "page") -> DataFrame:
    """Pages (job, folder, page_id, image_url, model_image_url) with ``image`` (the file found), ``rank`` (which candidate it is) and ``reason`` (why there is none).

    Candidates in order: the place that the URL names below the job's folder, then (for ``source`` "model") the model's page and the page, or the page only.
    The candidates are joined with the file listing by path; no file is opened.
    """
    if source not in ("page", "model"):
        raise ValueError("source is 'page' or 'model'")
    url = F.col("model_image_url" if source == "model" else "image_url")
    number = F.coalesce("page_id", F.lit(0))
    places = [_below(url, F.col("job"))]
    if source == "model":
        places.append(F.format_string("model_pages/page_%03d_qwen.png", number))
    places.append(F.format_string("pages/page_%03d.png", number))
    key = F.struct("job", "folder", "page_id")
    asked = pages.withColumn("_key", key).select("_key", F.posexplode(F.array(*places)).alias("rank", "place")).where("place is not null")
    asked = asked.withColumn("file", F.concat_ws("/", F.col("_key.folder"), "place"))
    best = asked.join(files.select("file").distinct(), "file").groupBy("_key").agg(F.min_by(F.struct(F.col("file").alias("image"), "rank"), "rank").alias("_found"))
    out = pages.withColumn("_key", key).join(best, "_key", "left")
    reason = F.when(F.col("_found").isNull(), F.when(url.isNull(), "no url and no page file").otherwise("no file at the url or the page's places"))
    return out.select(*pages.columns, F.col("_found.image").alias("image"), F.col("_found.rank").alias("rank"), reason.alias("reason"))


def portable_path(dataset: Column, job: Column, page_id: Column) -> Column:
    """Path of an exported page image below the export's folder."""
    return F.concat_ws("/", F.lit("images"), T.safe_name(dataset), job, F.format_string("page_%03d.png", F.coalesce(page_id, F.lit(0))))


@dataclass
class _Copied(WriterCommitMessage):
    files: int
    size: int


class FileSink(DataSource):
    """Sink of (name, content): a file per row below ``path``, written by the executors. A file is written under a temporary name and renamed, so a task that fails
    or runs twice leaves whole files only; the commit writes ``_copied-<id>.json`` with the number of files and bytes."""

    @classmethod
    def name(cls) -> str:
        return "leafgrid_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _FileWriter(self.options["path"])


class _FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path, self.id = path, uuid.uuid4().hex

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def _put(self, store, base: str, name: str, content: bytes) -> None:
        target = f"{base}/{name}"
        if ".." in name.split("/") or name.startswith("/"):
            raise ValueError(f"not a name below the folder: {name}")
        store.create_dir(posixpath.dirname(target), recursive=True)
        draft = f"{posixpath.dirname(target)}/.{posixpath.basename(target)}.{uuid.uuid4().hex}"
        try:
            with store.open_output_stream(draft) as out:
                out.write(content)
            store.move(draft, target)
        except BaseException:
            store.delete_file(draft)
            raise

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, base = self._open()
        files = size = 0
        for batch in iterator:
            for name, content in zip(batch["name"], batch["content"], strict=True):  # one row's bytes at a time
                data = content.as_buffer() if content.is_valid else b""
                self._put(store, base, name.as_py(), data)
                files, size = files + 1, size + len(data)
        return _Copied(files, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = self._open()
        done = [m for m in messages if m is not None]
        self._put(store, base, f"_copied-{self.id}.json", json.dumps({"files": sum(m.files for m in done), "bytes": sum(m.size for m in done)}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Whole files of finished tasks stay: a repeated copy overwrites them with the same bytes."""


def write_files(rows: DataFrame, folder: str) -> None:
    """Write (name, content) rows as files below a folder."""
    rows.sparkSession.dataSource.register(FileSink)
    rows.select("name", "content").write.format("leafgrid_files").mode("append").save(folder)


def copy_images(found: DataFrame, folder: str, dataset: Column) -> DataFrame:
    """Copy the images of ``page_images`` below ``folder``; returns the pages with ``target`` (relative, so the folder can be moved), null where there is no image."""
    spark = found.sparkSession
    out = found.withColumn("target", F.when(F.col("image").isNotNull(), portable_path(dataset, F.col("job"), F.col("page_id"))))
    parents = [r[0] for r in out.where("image is not null").select(F.regexp_extract("folder", r"^(.*)/[^/]*$", 1)).distinct().limit(10_001).collect()]
    if not parents:
        return out
    if len(parents) > 10_000:
        raise ValueError("copy the jobs of at most 10,000 parent folders at once")
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(parents).select(F.col("path").alias("image"), "content")
    write_files(content.join(out.select("image", F.col("target").alias("name")), "image"), folder)
    return out
