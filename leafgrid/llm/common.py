"""Shared column expressions and lineage helpers of the training-data operators."""

from __future__ import annotations

import functools
import inspect
import string
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII space and the controls TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that on pure ASCII and is much faster than ``translate``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def word_count(text: Column) -> Column:
    """Number of words as long; null text counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local session without that setting gets a temporary folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="leafgrid-checkpoint-")
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with an eager reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder: smaller than a checkpoint where rows are many and narrow."""
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir() or _shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows (of a few short columns) that are sent to every executor; beyond, a join shuffles both sides.
BROADCAST_ROWS = 250_000


def counted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A materialised table of narrow rows, with a broadcast hint if a count finds at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def running_sums(numbers: Column) -> Column:
    """Sums of the first 1, 2, ... elements of an array: each step adds what lies 1, 2, 4, ... places before (n log n in all)."""

    def add(sums: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        shifted = F.concat(F.array_repeat(F.lit(0), back), F.slice(sums, F.lit(1), F.size(sums) - back))
        return F.zip_with(sums, shifted, lambda x, y: x + y)

    steps = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k) < F.size(numbers))
    return F.aggregate(steps, numbers, add)


def under_own_names(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Decorator of a function of ``docs`` that keeps the columns of its input: inside they are called in_0, in_1, ..., so no name
    of the input meets a helper column. Arguments id_col, text_col and source_col follow."""

    @functools.wraps(step)
    def run(docs: DataFrame, *args, **named) -> DataFrame:
        bound = inspect.signature(step).bind(docs, *args, **named)
        bound.apply_defaults()
        inner = {c: f"in_{k}" for k, c in enumerate(docs.columns)}
        bound.arguments |= {p: inner[bound.arguments[p]] for p in ("id_col", "text_col", "source_col") if p in bound.arguments}
        bound.arguments["docs"] = docs.toDF(*inner.values())
        return step(*bound.args, **bound.kwargs).select(*inner.values()).toDF(*docs.columns)

    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
