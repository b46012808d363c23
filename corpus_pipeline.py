"""A corpus pipeline: quality, exact copies, near copies, source weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of ``documents``, unchanged, whatever their names.

Defined results of all stages: null and empty texts are documents without words (the classifier scores them like any
text, they are copies of each other, link to no near copy, take no part of the budget and stay once in the mix, and pack as pieces
of size 0); a null id or source is a value of its own; of rows equal in id and text exact dedup keeps one; ties go to the
larger id in exact dedup and to the smaller one among near copies; an empty table stays empty.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from leafgrid.llm.common import read
from leafgrid.llm.exact_dedup import drop_exact_copies
from leafgrid.llm.mixing import mixed_rows
from leafgrid.llm.near_copies import drop_near_copies
from leafgrid.llm.packing import pack
from leafgrid.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is 1."""
    return keep_good(docs, read(spark, sf_dir, "labels")).select(docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the document with the largest id."""
    return drop_exact_copies(docs).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return drop_near_copies(docs).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or twice. A document without words takes no part of the
    budget and stays once.
    """
    return mixed_rows(docs).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of at most 2048 words: one row per piece of a document."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("simhash near-dedup", near_copies),
    ("mixing to target weights", mixture),
    ("best-fit packing", packing),
]

#: SQL can't express the trained classifier; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="leafgrid-pipeline-")
    base = f"{folder}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{n}")
        docs = spark.read.parquet(f"{base}/{n}")
    return docs
