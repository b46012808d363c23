"""Exact dedup: group by a 128-bit content hash, keep one stable id, compare bytes inside groups.

Texts are equal when identical after lower-casing A-Z. Defined results for odd input:

* null text counts as the empty text, so null and empty texts form one group;
* a null id sorts below every other id; ``kept`` is true for exactly one row of each group, also when
  an id or a whole row is repeated;
* an empty table gives an empty result; extra columns of the input are ignored.

No step gathers a group: counts and the kept id are partial aggregates, the byte comparison is a hash
aggregate whose key is the text itself (so copies collapse before the shuffle), and the way back from
groups to rows is a plain join whose hot keys adaptive execution splits. Lists of repeated hashes and of
dropped rows are broadcast if a count finds at most ``BROADCAST_ROWS``, so that no text is shuffled but
one copy of each repeated one; larger lists are joined by shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid.llm.common import BROADCAST_ROWS, ascii_lower, checkpointed, counted, under_own_names

#: Tasks that share the texts of one hash.
SALTS = 32


def _normal(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` names the id that stays in a group: "min" (the smallest stable id) or "max".
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    texts = docs.select(F.col(id_col).alias("doc_id"), _normal(F.col(text_col)).alias("norm"))
    hashed = texts.select(
        "doc_id",
        F.unhex(F.md5("norm")).alias("h"),
        F.sha2("norm", 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = checkpointed(hashed)  # fixes the row numbers; 16 + 64 bytes a row instead of the text
    best, by = (F.min, F.min_by) if keep == "min" else (F.max, F.max_by)
    classes = (
        rows.groupBy("h", "text_sha256")
        .agg(
            F.count(F.lit(1)).alias("n"),
            best("doc_id").alias("keep_id"),
            F.coalesce(by("row", "doc_id"), best("row")).alias("keep_row"),
        )
        .where("n > 1")
    )
    classes = checkpointed(classes)
    # Only texts whose hash occurs more than once are compared: a filter before the shuffle while those hashes are few, else a
    # salted join, so that a hot group's texts meet in many tasks, each of which passes on one copy to the aggregate whose key is the bytes.
    few = classes.count() <= BROADCAST_ROWS
    repeated = classes.select("h").distinct()
    repeated = F.broadcast(repeated) if few else repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(SALTS)).cast("int")
    compared = (
        docs.select(_normal(F.col(text_col)).alias("norm"), salt.alias("salt"))
        .withColumn("h", F.unhex(F.md5("norm")))
        .join(repeated, ["h"] if few else ["h", "salt"], "left_semi")
        .groupBy("h", "norm")
        .agg(F.lit(1).alias("one"))
        .groupBy("h", F.sha2("norm", 256).alias("text_sha256"))
        .agg(F.count(F.lit(1)).alias("texts"))
    )
    # md5 collisions are told apart by (h, text_sha256); were two texts to share both hashes, the run fails loudly.
    proven = classes.join(compared, ["h", "text_sha256"]).select(
        "h",
        "text_sha256",
        F.when(F.col("texts") == 1, F.col("n"))
        .otherwise(F.raise_error(F.lit("different texts share md5 and sha256")).cast("long"))
        .alias("n"),
        "keep_id",
        "keep_row",
    )
    proven = counted(checkpointed(proven))
    return rows.join(proven, ["h", "text_sha256"], "left").select(
        rows["doc_id"].alias(id_col),
        F.when(F.col("n").isNull(), rows["doc_id"]).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (F.coalesce("keep_row", "row") == F.col("row")).alias("kept"),
        "text_sha256",
    )


@under_own_names
def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The input's rows without copies: one row of each group stays, all columns unchanged.

    Rows go by (id, content hash). Copies that have the kept row's own id can't be told from it so; such rows are reduced
    to one in a further pass over them alone.
    """
    dropped = exact_dedup(docs, id_col, text_col, keep).where("not kept").select(
        F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"), F.col(id_col).eqNullSafe(F.col("keep_id")).alias("twin")
    )
    dropped = checkpointed(dropped)
    others, twins = (counted(checkpointed(dropped.where(x).drop("twin").distinct())) for x in ("not twin", "twin"))
    tagged = docs.withColumn("__sha2", F.sha2(_normal(F.col(text_col)), 256))
    same = lambda keys: tagged[id_col].eqNullSafe(keys["__id"]) & (tagged["__sha2"] == keys["__sha"])
    out = tagged.join(others, same(others), "left_anti")
    if not twins.isEmpty():
        first = tagged.join(twins, same(twins), "left_semi").dropDuplicates([id_col, "__sha2"])
        out = out.join(twins, same(twins), "left_anti").unionByName(first)
    return out.drop("__sha2")
