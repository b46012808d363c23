"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Each document is cut into pieces of at most ``capacity`` words; full pieces fill a bin each, the remainder (or
a shorter document) is packed best-fit decreasing. Open bins are kept in order of residual capacity; each
carries bitmaps of the sources (one plane per allowed repetition) and of the duplicate clusters of its
contents. For each piece the successor search starts at the least residual that holds it and goes on, residual
by residual, until it finds the tightest bin with room for one more document of that source (at most
``per_source`` of a source in a bin) and none of its duplicate cluster; if there is none, a new bin opens. Bins of one
residual are held by bitmap signature, since bins with equal bitmaps are interchangeable.

Shards of documents are packed independently, one shard per task: the number of shards follows the number of
rows (``SHARD_ROWS`` each on average) and rows are dealt to them by a hash of id, content and row number, so a hot
source, a hot cluster or a row repeated many times is spread evenly, a task's memory is bounded, and no text travels. Row numbers follow
the input's partitions, so the bins of a table are the same in each run that reads it in the same splits. Cluster bitmaps
need bits only for clusters that recur in a shard.

Defined results: null text has size 0; pieces of size 0 go to one bin of their shard each time there is room (they take no
capacity but keep the conflict rules); a null source counts as a source of its own; repeated rows are packed as
documents of their own, apart if their cluster is the same; an empty table gives an empty result; extra columns of the input are
ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid.llm.common import ascii_lower, checkpointed, word_count

CAPACITY, PER_SOURCE, SHARD_ROWS = 2048, 2, 20_000


class Bins:
    """Open bins of one shard by residual; a residual maps bitmap signatures to bin numbers."""

    def __init__(self, capacity: int, per_source: int) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.by_residual: list[dict[tuple, list[int]]] = [{} for _ in range(capacity + 1)]
        self.open = 0  # bit r is set if some bin has residual r
        self.count = 0

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin number and offset in it for a piece; source and cluster are bit masks (cluster 0: no conflict)."""
        room = self.open >> size << size
        while room:
            r = (room & -room).bit_length() - 1
            bins = self.by_residual[r]
            for sign in bins:
                planes, clusters = sign
                if not (clusters & cluster) and not (planes[-1] & source):
                    return self._take(r, sign, size, source, cluster), self.capacity - r
            room &= room - 1
        number = self.count
        self.count += 1
        self._put(number, self.capacity - size, (source, *[0] * (self.per_source - 1)), cluster)
        return number, 0

    def _take(self, r: int, sign: tuple, size: int, source: int, cluster: int) -> int:
        bins = self.by_residual[r]
        number = bins[sign].pop()
        if not bins[sign]:
            del bins[sign]
            if not bins:
                self.open &= ~(1 << r)
        planes, carry = list(sign[0]), source
        for k in range(self.per_source):
            planes[k], carry = planes[k] | carry, planes[k] & carry
        self._put(number, r - size, tuple(planes), sign[1] | cluster)
        return number

    def _put(self, number: int, residual: int, planes: tuple, clusters: int) -> None:
        self.by_residual[residual].setdefault((planes, clusters), []).append(number)
        self.open |= 1 << residual


def pack_shard(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """Pieces of one shard: rows have id, source, cluster, size, order; adds bin, piece, start, words, offset."""
    bins = Bins(capacity, per_source)
    recurring = rows["cluster"].value_counts()
    bit = {c: 1 << i for i, c in enumerate(sorted(recurring.index[recurring > 1]))}
    sources: dict[object, int] = {}
    out: list[tuple] = []
    rest: list[tuple] = []
    for n, (size, order) in enumerate(zip(rows["size"], rows["order"], strict=True)):
        full = size // capacity
        for k in range(full):
            out.append((n, k, k * capacity, capacity, bins.count, 0))
            bins.count += 1
        if size % capacity or not size:
            rest.append((-(size % capacity), order, n, full))
    rest.sort()
    src, cluster = rows["source"].tolist(), rows["cluster"].tolist()
    for minus, _, n, k in rest:
        key = None if src[n] is None or src[n] != src[n] else src[n]
        mask = sources.setdefault(key, 1 << len(sources))
        number, offset = bins.place(-minus, mask, bit.get(cluster[n], 0))
        out.append((n, k, k * capacity, -minus, number, offset))
    made = pd.DataFrame(out, columns=["n", "piece", "start", "words", "bin", "offset"])
    made["id"] = rows["id"].to_numpy()[made["n"]] if len(made) else []
    made["source"] = rows["source"].to_numpy()[made["n"]] if len(made) else []
    made["cluster"] = rows["cluster"].to_numpy()[made["n"]] if len(made) else []
    return made


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         cluster: Column | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE,
         shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: id, source, cluster, piece, start_word, words, bin_id (``shard-number``), bin_offset.

    ``cluster`` names a document's duplicate cluster (any long); by default the hash of its text with A-Z lower-cased.
    """
    if cluster is None:
        cluster = F.xxhash64(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))))
    kind = docs.schema[id_col].dataType.simpleString()
    id_ = F.col(id_col)
    sized = docs.select(
        id_.alias("id"), F.col(source_col).cast("string").alias("source"), cluster.cast("long").alias("cluster"),
        word_count(F.col(text_col)).alias("size"),
    )
    sized = checkpointed(sized.withColumns({"order": F.xxhash64("id", "cluster", "source"), "row": F.monotonically_increasing_id()}))
    shards = max(1, -(-sized.count() // shard_rows))
    shape = f"id {kind}, source string, cluster long, piece int, start_word long, words long, bin_id string, bin_offset int"

    def pack_one(rows: pd.DataFrame) -> pd.DataFrame:
        made = pack_shard(rows.sort_values(["order", "size"], kind="stable").reset_index(drop=True), capacity, per_source)
        shard = int(rows["shard"].iloc[0])
        return pd.DataFrame({
            "id": made["id"], "source": made["source"], "cluster": made["cluster"], "piece": made["piece"], "start_word": made["start"],
            "words": made["words"], "bin_id": str(shard) + "-" + made["bin"].astype(str), "bin_offset": made["offset"],
        })

    dealt = sized.withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "order", "row"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInPandas(pack_one, shape)
    return packed.withColumnRenamed("id", id_col)
