"""Incremental forms: page commits as upserts, headings of pages that finish out of order, failed pages as dead letters.

All three run with ``trigger(availableNow=True)`` or continuously; state lives in the checkpoint, tables in a folder
that all executors share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from leafgrid.functions import text as T
from leafgrid.sources.shared import checkpointed, fresh_folder
from leafgrid.sources.versions import VersionedTable


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared one."""
    return fresh_folder(spark, "stream")


def run_to_end(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """All that is there, batch by batch, through ``each``."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upserts(table: VersionedTable, order: list[str], name: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: the rows with the greatest ``order`` of each key; a replayed batch changes nothing."""
    return lambda batch, number: table.upsert(batch, order, (name, number)) and None


class PageQueue:
    """Results of page runs: pages that are done, and dead letters with the number of attempts so far.

    A result has the keys, payload, error (null: it worked) and at (its time). Both tables are sinks of one batch; each knows the batches it has
    seen, so a batch that is replayed after a kill between the two commits completes the second and leaves the first. A page that
    is done stays done, with its first payload and all attempts up to it; later results of it change nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: str = "job_id long, page_id int", buckets: int = 16) -> None:
        names = [k.split()[0] for k in keys.split(",")]
        self.keys = [n.strip() for n in names]
        self.done = VersionedTable(spark, f"{folder}/done", f"{keys}, attempts long, payload string", self.keys, buckets)
        self.dead = VersionedTable(spark, f"{folder}/dead", f"{keys}, attempts long, error string", self.keys, buckets)

    def sink(self, name: str, pause: Callable[[int], None] = lambda number: None) -> Callable[[DataFrame, int], None]:
        """``foreachBatch`` sink of a stream called ``name``; ``pause`` runs between the two commits (for tests of kills)."""

        def run(batch: DataFrame, number: int) -> None:
            won, n = F.col("error").isNull(), F.count(F.lit(1))
            first = F.min(F.when(won, F.col("at")))
            per = batch.join(batch.groupBy(*self.keys).agg(first.alias("_won")), self.keys)
            upto = F.col("_won").isNull() | (F.col("at") <= F.col("_won"))
            per = per.groupBy(*self.keys).agg(
                F.count_if(upto).alias("tries"), F.bool_or(won).alias("ok"), F.min_by(F.when(won, F.struct("payload")), F.when(won, F.col("at")))["payload"].alias("payload"),
                F.max_by("error", F.struct("at", "error")).alias("error"),
            )
            per = checkpointed(per)
            self.done.merge(per.where("ok"), self._finish, (name, number))
            pause(number)
            self.dead.merge(per, self._bury, (name, number))

        return run

    def _touched(self, table: VersionedTable, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(table.bucket().alias("b")).distinct().collect()]  # at most ``buckets`` numbers

    def _finish(self, old: DataFrame, new: DataFrame) -> DataFrame:
        before = self.dead.read(buckets=self._touched(self.dead, new)).select(*self.keys, F.col("attempts").alias("_before"))
        new = new.join(old.select(self.keys), self.keys, "left_anti").join(before, self.keys, "left")
        return old.unionByName(new.select(*self.keys, (F.col("tries") + F.coalesce("_before", F.lit(0))).alias("attempts"), "payload"))

    def _bury(self, old: DataFrame, new: DataFrame) -> DataFrame:
        over = self.done.read(buckets=self._touched(self.done, new)).select(self.keys)
        both = old.join(new.select(*self.keys, "tries", F.col("error").alias("_error")), self.keys, "full_outer")
        n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
        return both.select(*self.keys, (n("attempts") + n("tries")).alias("attempts"), F.coalesce("_error", "error").alias("error")).join(over, self.keys, "left_anti")

    def waiting(self, most: int | None = None) -> DataFrame:
        """Dead letters, of fewer than ``most`` attempts."""
        dead = self.dead.read()
        return dead if most is None else dead.where(F.col("attempts") < most)

    def rerun(self, process: Callable[[DataFrame], DataFrame], most: int = 3) -> int:
        """One more attempt at each waiting page: ``process`` turns their keys into results. Returns how many were tried."""
        number = self.dead.entry()["streams"].get("rerun", -1) + 1
        results = checkpointed(process(self.waiting(most).select(self.keys)))
        self.sink("rerun")(results, number)
        return results.count()


class _InPageOrder(StatefulProcessor):
    """Holds pages until those before them have come; a gap that lasts for ``patience`` ms of event time is passed over."""

    def __init__(self, patience: int | None) -> None:
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "page int, last int")
        self.held = handle.getMapState("held", "page int", "ord array<int>, kind array<string>, level array<string>")

    def _release(self, doc, page: int, last: int, skip: bool, come: dict[int, tuple]) -> Iterator[pd.DataFrame]:
        """``come`` has the pages of this call: only those that still wait for an earlier one go into the state."""
        out: list[tuple] = []
        while True:
            held = self.held.containsKey((page,))
            if page not in come and not held:
                later = [k[0] for k in self.held.keys()] if skip else []
                if not later:
                    break
                page, skip = min(later), False
                held = True
            ords, kinds, levels = come.pop(page) if page in come else self.held.getValue((page,))
            if held:
                self.held.removeKey((page,))
            for o, kind, level in zip(ords, kinds, levels, strict=True):
                last, repaired = clamped(last, kind, level)
                out.append((doc, o, repaired, False))
            page += 1
        for no, items in come.items():
            self.held.updateValue((no,), items)
        self.at.update((page, last))
        if out:
            yield pd.DataFrame(out, columns=["doc", "ord", "repaired", "late"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        page, last = self.at.get() if self.at.exists() else (0, 0)
        late: list[tuple] = []
        come: dict[int, tuple] = {}
        for part in rows:
            for no, ords, kinds, levels in zip(part["page_no"], part["ords"], part["kinds"], part["levels"], strict=True):
                if no < page:  # passed over or repeated: its titles are no part of the state any more
                    late += [(key[0], int(o), None, True) for o in ords]
                else:
                    come[int(no)] = ([int(o) for o in ords], list(kinds), list(levels))
        yield from self._release(key[0], page, last, False, come)
        if late:
            yield pd.DataFrame(late, columns=["doc", "ord", "repaired", "late"])
        if self.patience is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
            if any(True for _ in self.held.keys()):
                self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.patience)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        page, last = self.at.get()
        yield from self._release(key[0], page, last, True, {})
        if any(True for _ in self.held.keys()):
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.patience)

    def close(self) -> None:
        pass


def clamped(last: int, kind: str, level: str | None) -> tuple[int, str | None]:
    """The rank of the last title after a heading, and the heading's repaired level (null for what is no title)."""
    rank = {"H1": 1, "H2": 2, "H3": 3, "H4": 4}.get(level) if kind == "paragraph_title" else None
    return (last, None) if rank is None else (min(rank, last + 1), f"H{min(rank, last + 1)}")


def clamp_pages(pages: DataFrame, patience: int | None = None, time: str = "at", delay: str = "0 seconds") -> DataFrame:
    """(doc, ord, repaired, late) of pages (doc, page_no, items) that finish in any order: levels are repaired in the order of pages.

    ``page_no`` counts a document's pages from 0 without gaps; items is an array of (ord, block_type, level). The state of a document is two
    integers and the pages that wait for an earlier one. With ``patience`` (ms of the event time ``time``) a missing page is passed over when the
    watermark has moved on that far; if it comes later, its rows are ``late`` and unrepaired. Needs the RocksDB state store, which is set here for the session.
    """
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    each = lambda name: F.transform("items", lambda x: x[name])
    flat = pages.select("doc", "page_no", each("ord").alias("ords"), each("block_type").alias("kinds"), each("level").alias("levels"), *([time] if patience is not None else []))
    if patience is not None:
        flat = flat.withWatermark(time, delay)
    mode = "none" if patience is None else "eventTime"
    return flat.groupBy("doc").transformWithStateInPandas(_InPageOrder(patience), "doc long, ord int, repaired string, late boolean", "append", mode)


def page_rows(headings: DataFrame) -> DataFrame:
    """Headings (doc, page_id, ord, block_type, level) as one row per page: doc, page_no (from 0, without gaps), items in order."""
    pages = headings.groupBy("doc", "page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "block_type", "level"))).alias("items"))
    return pages.withColumn("page_no", F.row_number().over(Window.partitionBy("doc").orderBy("page_id")) - 1)


def parsed_answers(raw: DataFrame, column: str = "text") -> DataFrame:
    """Streaming-safe: the model's object, and an error text where there is none."""
    from leafgrid.functions.jsonx import model_object

    out = raw.withColumn("payload", model_object(F.col(column)))
    return out.withColumn("error", F.when(F.col("payload").isNull() & (T.clean(F.col(column)) != ""), "no JSON object").when(F.col("payload").isNull(), "empty"))
