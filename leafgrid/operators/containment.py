"""Verbatim containment of passages in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of passages up to which they are broadcast as one list.
BROADCAST_BYTES = 4 << 20
#: Words of an anchor; a passage needs two more to have one.
ANCHOR = 3


def _anchors(words: Column, first: Column, last: Column) -> Column:
    """Hashes of the runs of ``ANCHOR`` words that start at first..last (zero-based)."""
    starts = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(ANCHOR)]))


def contained(texts: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage",
              broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, item) of passages that occur in texts character by character.

    A small list, by its measured size, is broadcast. A larger one is joined by an anchor: a passage's second to fourth words (between spaces) stand in any
    text that contains it, so texts and passages meet by an equi-join on their hashes, and the containment itself is then tested. Passages of fewer
    than five words have no anchor; they are broadcast in blocks of about half the default bound.

    Defined results: null texts and null passages take no part, the empty passage is in every text; a null id finds nothing in the anchored way; repeated
    rows give one row per (id, item) there and one per text otherwise; empty tables give an empty result.
    """
    texts, passages = texts.select(F.col(id_col), F.col(text_col)), passages.select(F.col(item_col), F.col(passage_col)).where(F.col(passage_col).isNotNull())

    def listed(rows: DataFrame) -> DataFrame:
        one = rows.agg(F.collect_list(F.struct(item_col, passage_col)).alias("_p"), F.lit(1).alias("_one"))
        both = texts.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one")
        return both.select(id_col, F.explode(F.filter("_p", lambda x: F.contains(F.col(text_col), x[passage_col]))).alias("_h")).select(id_col, f"_h.{item_col}")

    size = lambda rows: rows.agg(F.sum(F.octet_length(passage_col)).alias("n")).first()["n"] or 0
    in_all = size(passages)
    if in_all <= broadcast_bytes:
        return listed(passages)
    split = passages.withColumn("_w", F.split(passage_col, " ", -1))
    short, long = split.where(F.size("_w") < ANCHOR + 2).drop("_w"), split.where(F.size("_w") >= ANCHOR + 2)
    # Only ids and anchors meet; the texts of the few candidates come back by their ids.
    keyed = long.select(item_col, F.get(_anchors(F.col("_w"), F.lit(1), F.lit(1)), F.lit(0)).alias("_a"))
    words = texts.withColumn("_w", F.split(text_col, " ", -1))
    anchors = words.select(id_col, F.explode(F.array_distinct(_anchors(F.col("_w"), F.lit(0), F.size("_w") - ANCHOR))).alias("_a"))
    candidates = anchors.join(keyed, "_a").select(id_col, item_col).distinct()
    found = candidates.join(texts, id_col).join(long.select(item_col, passage_col), item_col).where(F.contains(F.col(text_col), F.col(passage_col))).select(id_col, item_col)
    # Passages without an anchor go in blocks of half the default bound, each against all texts.
    blocks = -(-2 * size(short) // BROADCAST_BYTES)
    for k in range(blocks):
        block = short.where(F.pmod(F.xxhash64(passage_col, item_col), F.lit(blocks)) == k)
        found = found.unionByName(listed(block))
    return found.distinct()
