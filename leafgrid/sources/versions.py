"""Tables in versions: an append-only log of commits, put if absent, over immutable Parquet folders.

``_log/<version>.json`` names the data folder of each hash bucket of the keys. A commit writes new folders for the buckets
it touches, then puts the next log entry, which succeeds for one writer only; the other writer's folder is never
named by the log, so no reader sees it. A failed or killed write leaves the version before readable, a new object finds the last version in the log, and
every version can be read until ``vacuum`` removes it. What the driver holds is one log entry: as many names as there are buckets.

A stream's commits carry the stream's name and batch number; a batch that is replayed after a failure finds its number
in the log and changes nothing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafgrid.operators.catalog import latest


class Conflict(RuntimeError):
    """Another commit has taken the version."""


def _local(path: str) -> str | None:
    """The path of a local or mounted folder; None for a store that only Spark's file systems reach."""
    return path.removeprefix("file://") if path.startswith("file:///") else None if "://" in path else path


class Folder:
    """Listing, reading, removing and putting small files, through the file system of the path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.local = spark, path.rstrip("/"), _local(path.rstrip("/"))

    def _far(self, name: str = ""):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def names(self) -> list[str]:
        if self.local is not None:
            return sorted(os.listdir(self.local)) if os.path.isdir(self.local) else []
        fs, at = self._far()
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def get(self, name: str) -> str:
        if self.local is not None:
            with open(f"{self.local}/{name}", encoding="utf-8") as f:
                return f.read()
        fs, at = self._far(name)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """The whole file or nothing; ``Conflict`` if the name exists."""
        temporary = f".{name}.{uuid.uuid4().hex}"
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            with open(f"{self.local}/{temporary}", "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(f"{self.local}/{temporary}", f"{self.local}/{name}")
            except FileExistsError as error:
                raise Conflict(name) from error
            finally:
                os.unlink(f"{self.local}/{temporary}")
            return
        fs, at = self._far(name)
        _, draft = self._far(temporary)
        stream = fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if fs.exists(at) or not fs.rename(draft, at):
            fs.delete(draft, False)
            raise Conflict(name)

    def remove(self, name: str) -> None:
        fs, at = Folder(self.spark, f"file://{os.path.abspath(self.local)}")._far(name) if self.local is not None else self._far(name)
        fs.delete(at, True)


class VersionedTable:
    """Rows by keys in ``buckets`` hash buckets under a version log."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.log = Folder(spark, f"{self.folder}/_log")

    # --- log -------------------------------------------------------------------------------------------------------------

    @property
    def version(self) -> int:
        """The last version, -1 before the first commit."""
        return max((int(n.removesuffix(".json")) for n in self.log.names() if n.endswith(".json") and not n.startswith(".")), default=-1)

    def entry(self, version: int | None = None) -> dict:
        version = self.version if version is None else version
        if version < 0:
            return {"version": -1, "revision": "", "buckets": {}, "touched": [], "streams": {}, "info": {}}
        return json.loads(self.log.get(f"{version:020d}.json"))

    def history(self) -> list[dict]:
        return [json.loads(self.log.get(n)) for n in self.log.names() if n.endswith(".json") and not n.startswith(".")]

    # --- reading ---------------------------------------------------------------------------------------------------------

    def bucket(self) -> Column:
        """The bucket of a row, from its keys as text (so integers of any width agree)."""
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (the last one by default), of all buckets or of the given ones."""
        named = self.entry(version)["buckets"]
        paths = [f"{self.folder}/data/{txn}/bucket={b}" for b, txn in named.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def lookup(self, *key) -> DataFrame:
        """The rows of one key: reads its bucket only."""
        one = self.spark.createDataFrame([tuple(str(k) for k in key)], ", ".join(f"{k} string" for k in self.keys))
        found = self.read(buckets=[one.select(self.bucket()).first()[0]])
        for name, value in zip(self.keys, key, strict=True):
            found = found.where(F.col(name) == value)
        return found

    # --- writing ---------------------------------------------------------------------------------------------------------

    def commit(self, rows: DataFrame, touched: list[int], base: int, info: dict | None = None, stream: tuple[str, int] | None = None, alone: bool = False) -> int:
        """Put ``rows`` as the whole content of the touched buckets, on top of version ``base``.

        Commits that came in between and touch other buckets are kept; one that touches the same buckets is a ``Conflict``, and so is any
        with ``alone``.
        """
        txn = uuid.uuid4().hex
        path = f"{self.folder}/data/{txn}"
        rows = rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).withColumn("bucket", self.bucket())
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)  # a large bucket is several tasks' work, small ones are one task's
        written = {n.removeprefix("bucket=") for n in Folder(self.spark, path).names() if n.startswith("bucket=")}
        if strays := {int(b) for b in written} - set(touched):
            raise ValueError(f"rows of buckets that were not announced: {sorted(strays)[:5]}")
        while True:
            before = self.entry(self.version)
            for later in range(base + 1, before["version"] + 1):
                if alone or set(self.entry(later)["touched"]) & set(touched):
                    raise Conflict(f"version {later} came first")
            buckets = {b: t for b, t in before["buckets"].items() if int(b) not in set(touched)} | {b: txn for b in written}
            streams = before["streams"] | ({stream[0]: stream[1]} if stream else {})
            version = before["version"] + 1
            entry = {"version": version, "revision": f"{version}-{txn}", "buckets": buckets, "touched": sorted(touched), "streams": streams, "info": info or {}}
            try:
                self.log.put(f"{version:020d}.json", json.dumps(entry))
                return version
            except Conflict:
                continue  # look again whether the other commit touched the same buckets

    def merge(self, batch: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], stream: tuple[str, int] | None = None, info: dict | None = None) -> int:
        """Commit ``how(old rows, batch)`` for the buckets that the batch's keys touch; other buckets are neither read nor written."""
        while True:
            base = self.entry()
            if stream and base["streams"].get(stream[0], -1) >= stream[1]:
                return base["version"]
            touched = sorted(r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect())  # at most ``buckets`` numbers
            if not touched and not stream:
                return base["version"]
            try:
                return self.commit(how(self.read(base["version"], touched), batch), touched, base["version"], info, stream)
            except Conflict:
                continue

    def upsert(self, batch: DataFrame, order: list[str] | None = None, stream: tuple[str, int] | None = None) -> int:
        """Rows of the batch replace those of equal keys; with ``order`` the row with the greatest values wins, old or new."""

        def how(old: DataFrame, new: DataFrame) -> DataFrame:
            new = new.select(self.schema.names)
            if order:
                return latest(old.unionByName(new), self.keys, *[F.col(c).desc() for c in order])
            return old.join(new.select(self.keys), self.keys, "left_anti").select(self.schema.names).unionByName(new)

        return self.merge(batch, how, stream)

    def delete(self, keys: DataFrame, stream: tuple[str, int] | None = None) -> int:
        """Drop the rows of the keys."""
        return self.merge(keys, lambda old, gone: old.join(gone.select(self.keys).distinct(), self.keys, "left_anti"), stream)

    def vacuum(self, keep: int = 2) -> int:
        """Remove all but the last ``keep`` versions, with the folders that only they name; returns how many folders went."""
        past = self.history()
        kept = past[-max(1, keep) :]
        used = {t for e in kept for t in e["buckets"].values()}
        old = {t for e in past for t in e["buckets"].values()} - used
        for e in past[: -max(1, keep)]:
            self.log.remove(f"{e['version']:020d}.json")
        data = Folder(self.spark, f"{self.folder}/data")
        for txn in sorted(old):
            data.remove(txn)
        return len(old)


def switched(rows: DataFrame, folder: str, file_format: str = "json") -> int:
    """Write rows as the next whole version of a folder: readers see the old files or the new ones, never a mix."""
    log, txn = Folder(rows.sparkSession, f"{folder}/_log"), uuid.uuid4().hex
    rows.write.format(file_format).option("ignoreNullFields", "false").save(f"{folder}/data/{txn}")
    while True:
        version = len(_versions(log))
        try:
            log.put(f"{version:020d}.json", json.dumps({"version": version, "data": txn, "format": file_format}))
            return version
        except Conflict:
            continue


def _versions(log: Folder) -> list[str]:
    return [n for n in log.names() if n.endswith(".json") and not n.startswith(".")]


def read_switched(spark: SparkSession, folder: str, schema: str, version: int | None = None) -> DataFrame:
    log = Folder(spark, f"{folder}/_log")
    names = _versions(log)
    if not names:
        return spark.createDataFrame([], schema)
    entry = json.loads(log.get(names[-1] if version is None else f"{version:020d}.json"))
    return spark.read.schema(schema).format(entry["format"]).load(f"{folder}/data/{entry['data']}")
