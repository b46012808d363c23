"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a fixed shuffled order (md5 of the id). A document's virtual
finish time is the cumulative size of its source up to and including it, divided by the source's target;
a second lap over the queue follows the first, since a target may be up to ``max_repeat`` = 2 times its
source. Documents are taken in order of finish time until the total budget is used up.

Defined results: null text has size 0; null source is a source of its own, last in order; a source
without words has target 0 and nothing is taken of it; an empty table gives an empty result; repeated
rows queue as separate documents (ties in finish time go by source, shuffle key, id, lap). Extra columns
of the input are ignored.

No task holds a whole source: cumulative sizes come from per-(source, bucket) sums over hash buckets, whose number
follows the number of rows (``BUCKET_ROWS`` each on average, or fewer), plus a window inside one bucket, and the global cut from sums of finish-time bins, of finer bins inside
the bin where the budget runs out, and a window inside the one finer bin where it does. Only those sums (at most
3 * BINS + 1 numbers) and one row reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.llm.common import WORD, checkpointed, counted, under_own_names, word_count

#: Most rows a bucket holds on average. Buckets are runs of the queue's order (leading hex digits of the md5), so their number changes no result.
BUCKET_ROWS = 1 << 17
#: Leading digits that name a bucket, at least.
MIN_DIGITS = 3
#: Bins of finish time between 0 and 1 (times from 2 on share the last bin).
BINS = 4096
WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Water filling in closed form: with sources in ascending order of cap / weight, the level is the
    greatest of (budget - caps before) / (weights from here on); a target is min(cap, weight * level).
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    per = per.select("source", "source_size", weight.cast("long").alias("w"))
    per = per.withColumn("cap", F.lit(max_repeat) * F.col("source_size"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy((F.col("cap").cast("double") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    budget = F.sum("source_size").over(everything).cast("double") * share
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(rest)
    per = per.withColumn("level", level)
    target = F.least(F.col("cap").cast("double"), F.col("w") * F.max("level").over(everything))
    return per.select("source", "source_size", target.alias("target"))


def _laps(n: int):
    return range(1, n + 1)


def _cut(sums: list[tuple[int, int]], used: float, total: float) -> tuple[float, int | None]:
    """Words taken before the first bin that does not fit whole, and that bin (None if all fit)."""
    for b, s in sums:
        if used + s > total:
            return used, b
        used += s
    return used, None


def bucket_digits(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Hex digits that split ``rows`` rows into buckets of at most ``bucket_rows`` on average."""
    digits = MIN_DIGITS
    while 16**digits * bucket_rows < rows:
        digits += 1
    return digits


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_repeat: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken (words, repeats counted)."""
    key = F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        key.alias("key"),
    )
    sized = checkpointed(sized)
    # Equally long hex strings sort like their numbers; the empty key of a null id sorts first, in a bucket of its own.
    sized = sized.withColumn("bucket", F.substring("key", 1, bucket_digits(sized.count(), bucket_rows)))
    targets = source_targets(sized, weights, share, max_repeat)
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("ahead", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)))
    same = offsets["source"].eqNullSafe(targets["source"])
    offsets = checkpointed(
        offsets.join(targets, same).select(offsets["source"].alias("s"), F.col("bucket").alias("b"), "ahead", "source_size", "target")
    )
    within = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = sized.withColumn("cum", F.sum("size").over(within))
    queued = queued.join(offsets, queued["source"].eqNullSafe(offsets["s"]) & (queued["bucket"] == offsets["b"]))
    cum = F.col("ahead") + F.col("cum")
    finish = {
        f"f{k}": F.when(F.col("size") > 0, (cum + (k - 1) * F.col("source_size")).cast("double") / F.nullif("target", F.lit(0.0)))
        for k in _laps(max_repeat)
    }
    laid = checkpointed(queued.select("id", "source", "key", "size", "source_size", "target", *[c.alias(n) for n, c in finish.items()]))

    entries = laid.select(
        "size", F.explode(F.array(*[F.struct(F.col(f"f{k}").alias("f"), F.col("source").isNull().alias("last"), "source", "key", "id", F.lit(k).alias("lap")) for k in _laps(max_repeat)])).alias("e")
    ).where("e.f is not null").withColumn("bin", F.least(F.floor(F.col("e.f") * BINS), F.lit(2 * BINS)).cast("int"))
    # Bounded by the number of bins, whatever the number of documents.
    in_bins = sorted((r["bin"], r["s"]) for r in entries.groupBy("bin").agg(F.sum("size").alias("s")).collect())
    total = targets.agg(F.sum("target").alias("t")).first()["t"] or 0.0
    used, cut = _cut(in_bins, 0, total)
    edge = None
    if cut is not None:
        # The bin of the cut is split once more, so that the window orders a BINS ** 2-th of the queue.
        fine = F.least(F.floor((F.col("e.f") * BINS - cut) * BINS), F.lit(BINS - 1)).cast("int")
        near = entries.where(F.col("bin") == cut).select("e", "size", fine.alias("fine"))
        in_fine = sorted((r["fine"], r["s"]) for r in near.groupBy("fine").agg(F.sum("size").alias("s")).collect())
        used, fine_cut = _cut(in_fine, used, total)
        order = Window.partitionBy(F.lit(0)).orderBy("e").rowsBetween(Window.unboundedPreceding, 0)
        inside = near.where(F.col("fine") == fine_cut).withColumn("run", F.sum("size").over(order)).where(F.col("run") <= F.lit(total - used))
        edge = near.where(F.col("fine") < fine_cut).select("e").union(inside.select("e")).agg(F.max("e").alias("e")).first()["e"]

    def taken(k: int):
        f = F.col(f"f{k}")
        if cut is None:
            yes = f.isNotNull()
        else:
            yes = F.least(F.floor(f * BINS), F.lit(2 * BINS)) < cut
            if edge is not None:
                at = F.struct(f.alias("f"), F.col("source").isNull().alias("last"), "source", "key", "id", F.lit(k).alias("lap"))
                kind = entries.schema["e"].dataType
                limit = F.struct(*[F.lit(edge[x.name]).cast(x.dataType).alias(x.name) for x in kind.fields])
                yes = yes | (f.isNotNull() & (at <= limit))
        return F.when(yes, F.col("size")).otherwise(F.lit(0).cast("long"))

    return laid.select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target",
        sum((taken(k) for k in _laps(max_repeat)), F.lit(0).cast("long")).alias("taken"),
    )


@under_own_names
def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The input's rows, each as often as the mix takes it; rows without words stay once.

    A source's queue is taken from its start, so all but a few of its buckets are taken a whole number of times. Their rows follow a table
    of buckets (broadcast if small), and only rows of the buckets in which a lap ends are joined by id. Rows that agree in id, source and size
    share the laps of all of them, the first rows one more if the number does not divide.
    """
    taken = checkpointed(mix(docs.select(id_col, text_col, source_col), id_col, text_col, source_col).where("size > 0").select(
        F.col(id_col).alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), (F.col("taken") / F.col("size")).cast("int").alias("t")
    ))
    place = lambda c: F.substring(F.coalesce(F.md5(F.col(c).cast("string")), F.lit("")), 1, 3)
    buckets = taken.groupBy("__source", place("__id").alias("__place")).agg(F.min("t").alias("__t"), F.max("t").alias("most"))
    buckets = counted(checkpointed(buckets.select("__source", "__place", F.when(F.col("__t") == F.col("most"), F.col("__t")).alias("__t"))))
    ends = counted(checkpointed(buckets.where("__t is null").select("__source", "__place")))
    part = taken.join(ends, taken["__source"].eqNullSafe(ends["__source"]) & (place("__id") == ends["__place"]), "left_semi")
    laps = checkpointed(part.groupBy("__id", "__source", "__size").agg(F.count(F.lit(1)).alias("__count"), F.sum("t").alias("__laps")))

    rows = docs.withColumns({"__row_place": place(id_col), "__words": F.regexp_like(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD))})
    at = rows["__row_place"].eqNullSafe(buckets["__place"]) & rows[source_col].eqNullSafe(buckets["__source"]) & rows["__words"]
    rows = rows.join(buckets, at, "left").drop("__source", "__place")
    times = lambda frame, t: frame.select(*docs.columns, F.explode(F.sequence(F.lit(1), t)).alias("__lap")).select(docs.columns)
    whole = times(rows.where("not __words or __t > 0"), F.when(F.col("__words"), F.col("__t")).otherwise(1))
    ending = rows.where("__words and __t is null").withColumn("__words_of", word_count(F.col(text_col)))
    key = ending[id_col].eqNullSafe(laps["__id"]) & ending[source_col].eqNullSafe(laps["__source"]) & (ending["__words_of"] == laps["__size"])
    ending = ending.join(laps, key)
    even = times(ending.where("__laps % __count = 0 and __laps > 0"), (F.col("__laps") / F.col("__count")).cast("int"))
    odd = checkpointed(ending.where("__laps % __count <> 0").withColumn("__part", F.spark_partition_id()))
    return whole.unionByName(even).unionByName(times(_shared_laps(odd), F.col("__mine")).select(docs.columns))


def _shared_laps(odd: DataFrame) -> DataFrame:
    """Rows with ``__mine`` laps each, more than none; rows are numbered within partitions, and partitions by their counts."""
    key = ["__id", "__source", "__size"]
    counts = odd.groupBy(*key, "__part").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias("_" + k) for k in key], F.col("__part").alias("__p"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*key, "__part").orderBy(F.lit(0))
    numbered = odd.withColumn("__n", F.row_number().over(within))
    same = F.col("__part") == F.col("__p")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col("_" + k))
    mine = F.floor(F.col("__laps") / F.col("__count")) + (F.col("__before") + F.col("__n") <= F.col("__laps") % F.col("__count")).cast("long")
    return numbered.join(counts, same).withColumn("__mine", mine.cast("int")).where("__mine > 0")
