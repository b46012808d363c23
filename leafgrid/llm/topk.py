"""Exact top-k search by block-at-a-time pruning.

Vectors become integer vectors, floor(64 * x) per component. Candidates are cut into document-range blocks
(consecutive rows of the id order), each with its per-term (component) minima and maxima. For a query q the
score of any row of a block is at most the sum over terms of q_t * max_t (or q_t * min_t where q_t < 0).
Per query, blocks are taken in descending order of that bound and scored through the block's forward index
(its rows of integer components) until the bound falls below the query's k-th best score; a block whose bound
equals it is still scored, since a tie may go to a smaller id.

Queries travel in fixed blocks of at most ``QUERY_BLOCK`` rows, gathered by the driver one block at a time and
broadcast (QUERY_BLOCK * dimensions * 8 bytes at most); all candidate partitions of the cluster work on each
block. Partitions are searched in waves, each of all so far times ``WAVE_GROWTH``: after a wave the k best rows of each query are kept,
and their k-th score is the floor below which the next wave's blocks and rows are left out. So about WAVE_GROWTH * k rows
a query come back from a wave, and their number grows with the logarithm of the table.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, neither as
queries nor as candidates; shorter vectors count as padded with zeros; a query's own id never is its answer;
ties go to the smaller id; a repeated candidate row is a candidate each time, a repeated query id is asked once, with its
least vector; an empty table gives an empty result; extra columns
are ignored. Scaled components and scores beyond 64 bits count as the nearest number of the range -(2**63 - 1) to 2**63 - 1; products are exact
before that (in Python's integers for the rows that need it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.llm.common import checkpointed

SCALE, K = 64, 20
BLOCK, QUERY_BLOCK = 256, 8192
#: Rows of one partition of candidates: bounds a task's memory.
PARTITION_ROWS = 65536
#: Partitions of the first wave, and growth of what all waves so far have searched.
FIRST_PARTS, WAVE_GROWTH = 64, 4
#: Stands for no score: below every score. Falling order is the rising order of ~score, which no score overflows.
NONE = -(2**63)
_OUT = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<long>) of the rows that take part."""
    v = F.col(vec_col)
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    scaled = lambda x: F.greatest(F.floor(x.cast("double") * SCALE), F.lit(-(2**63 - 1)))  # noqa: E731  floor stays within 64 bits
    return vectors.where(v.isNotNull() & ~F.exists(v, odd)).select(F.col(id_col).cast("long").alias("id"), F.transform(v, scaled).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as an int64 matrix, padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -(2**63 - 1), 2**63 - 1).astype(np.int64)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products a @ b.T, exact or at the end of the range; in floating point (fast) for rows whose sums stay below 2**53."""
    small = (2**52 / max(1, a.shape[1])) ** 0.5
    large_a, large_b = (np.abs(x.astype(np.float64)).max(axis=1, initial=0) > small for x in (a, b))
    if not large_a.any() and not large_b.any():
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    out = np.empty((len(a), len(b)), np.int64)
    for rows in (large_a, ~large_a):
        for columns in (large_b, ~large_b):
            out[np.ix_(rows, columns)] = _exact(a[rows], b[columns])
    return out


def search_blocks(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, block: int, floor: np.ndarray | None = None):
    """Top k of rows (sorted by id) for each query: arrays (query number, id, score). Also the blocks scored.

    ``floor`` has a score per query that k other rows reach; rows below it may be left out.
    """
    floor = np.full(len(queries), NONE) if floor is None else floor
    starts = np.arange(0, len(ids), block)
    highest, lowest = np.maximum.reduceat(rows, starts), np.minimum.reduceat(rows, starts)
    positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = _dot(np.concatenate([positive, negative], axis=1), np.concatenate([highest, lowest], axis=1))
    order = np.argsort(~bounds, axis=1, kind="stable")
    n = len(queries)
    best_s, best_i = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)
    live, scored = np.arange(n), 0
    for turn in range(len(starts)):
        at = order[live, turn]
        live = live[bounds[live, at] >= np.maximum(best_s[live, k - 1], floor[live])]
        if not len(live):
            break
        at = order[live, turn]
        scored += len(live)
        by = np.argsort(at, kind="stable")
        for group in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
            q, b = live[group], at[group[0]]
            own, vectors = ids[b * block : (b + 1) * block], rows[b * block : (b + 1) * block]
            s = _dot(queries[q], vectors)
            self_row = query_ids[q][:, None] == own[None, :]
            s = np.concatenate([best_s[q], np.where(self_row, NONE, s)], axis=1)
            i = np.concatenate([best_i[q], np.where(self_row, np.iinfo(np.int64).max, own[None, :])], axis=1)
            if s.shape[1] > 4 * k:  # a row below the k-th score can't be among the first k; ties are kept for the exact order
                kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                for r in range(len(q)):
                    keep = np.flatnonzero(s[r] >= kth[r])
                    first = keep[np.lexsort((i[r, keep], ~s[r, keep]))[:k]]
                    best_s[q[r]], best_i[q[r]] = s[r, first], i[r, first]
            else:
                first = np.lexsort((i, ~s), axis=1)[:, :k]
                best_s[q], best_i[q] = np.take_along_axis(s, first, 1), np.take_along_axis(i, first, 1)
    return best_s, best_i, scored


def top_k(vectors: DataFrame, query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
          query_block: int = QUERY_BLOCK, block: int = BLOCK, wave_parts: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``query`` holds, its k best other rows."""
    spark = vectors.sparkSession
    usable = integer_vectors(vectors, id_col, vec_col)
    asked = integer_vectors(vectors.where(query), id_col, vec_col)
    # Row numbers, fixed by the checkpoint, let a repeated id fill several partitions.
    usable = checkpointed(usable.withColumn("row", F.monotonically_increasing_id()))
    size = usable.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    rows, dims = size["n"], size["d"] or 0
    parts = max(1, min(-(-rows // PARTITION_ROWS), 100_000))
    parts = max(parts, min(spark.sparkContext.defaultParallelism, -(-rows // (4 * block))))
    ranges = usable.repartitionByRange(parts, "id", "row").sortWithinPartitions("id").select("id", "v")
    asked = checkpointed(asked.groupBy("id").agg(F.min("v").alias("v")))
    cuts = asked.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    n_blocks = max(1, -(-cuts // query_block))
    if n_blocks > 1:
        asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(2 * n_blocks)))
        turns = [asked.where(F.col("part") == p).drop("part") for p in range(2 * n_blocks)]
    else:
        turns = [asked]
    waves = waves_of(parts, wave_parts or max(FIRST_PARTS, 2 * spark.sparkContext.defaultParallelism))
    if n_blocks > 1 or waves > 1:
        ranges = checkpointed(ranges.withColumn("wave", wave_of(F.spark_partition_id(), parts, waves)))
    else:
        ranges = ranges.withColumn("wave", F.lit(0))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    found = None
    for turn in turns:
        table = turn.toArrow()  # about query_block rows or fewer: the stated block of queries
        if table.num_rows == 0:
            continue
        q_ids = table["id"].combine_chunks().to_numpy()
        q_rows = _matrix(table["v"].combine_chunks(), dims)
        best = None
        for wave in range(waves):
            # The k-th scores so far: rows below them are of no use, so a later wave sends back a few times k rows a query, not k a partition.
            shared = spark.sparkContext.broadcast((q_ids, q_rows, _floors(best, q_ids, k)))
            part = ranges.where(F.col("wave") == wave).select("id", "v").mapInArrow(_score(shared, dims, k, block), _OUT)
            part = part if best is None else best.unionByName(part)
            if waves > 1:
                part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
            # A block of queries is finished before the next is gathered, so that its broadcast can go.
            best = checkpointed(part) if len(turns) > 1 or waves > 1 else part
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def waves_of(parts: int, first: int) -> int:
    """Number of waves of partitions: ``first`` in the first one, and with each further wave WAVE_GROWTH times as many in all."""
    waves, done = 1, first
    while done < parts:
        waves, done = waves + 1, done * WAVE_GROWTH
    return waves


def wave_of(part: Column, parts: int, waves: int) -> Column:
    """The wave of a partition: places are shuffled, so that a wave samples all of the id range."""
    place = F.pmod(F.xxhash64(part), F.lit(1 << 30)) / (1 << 30)
    out = F.lit(waves - 1)
    for w in range(waves - 2, -1, -1):
        out = F.when(place < WAVE_GROWTH ** (w + 1 - waves), F.lit(w)).otherwise(out)
    return out


def _floors(best: DataFrame | None, query_ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query so far (one number a query of the block)."""
    floors = np.full(len(query_ids), NONE)
    if best is None:
        return floors
    full = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).toArrow()
    at = np.argsort(query_ids)
    floors[at[np.searchsorted(query_ids[at], full["query_id"].to_numpy())]] = full["s"].to_numpy()
    return floors


def _score(shared, dims: int, k: int, block: int):
    """Kernel over a partition of candidates sorted by id: the rows that may be among the k best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mats = [], []
        for b in batches:
            if b.num_rows:
                ids.append(b["id"].to_numpy(zero_copy_only=False))
                mats.append(_matrix(b["v"], dims))
        if not ids:
            return
        query_ids, queries, floors = shared.value
        own, matrix = np.concatenate(ids), np.concatenate(mats)
        for at in range(0, len(query_ids), 1024):
            part = slice(at, at + 1024)
            s, i, _ = search_blocks(query_ids[part], queries[part], own, matrix, k, block, floors[part])
            some = (s > NONE) & (s >= floors[part][:, None])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.broadcast_to(query_ids[part][:, None], s.shape)[some]), pa.array(i[some]), pa.array(s[some])],
                names=["query_id", "vec_id", "score"],
            )

    return run
