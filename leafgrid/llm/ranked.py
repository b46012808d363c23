"""Ranked lexical search by the threshold algorithm.

Terms are maximal runs of ASCII letters, digits and all characters beyond ASCII; only A-Z is lower-cased. A document's
score for an item sums, over the item's terms with repeats, w * ((10**9 * tf) div (1000 * tf + 8 * m)) with the term's
weight w = floor(1000 * ln((2N + 2) / (2 df + 1))) and the document's length factor m = 25 + (75 * n * N) div L. N, L and
df count all documents.

Spark makes the postings (one row per document and term that an item asks for) by joining the exploded terms with the
items' vocabulary, adds each posting's impact, and deals the documents to shards of about ``SHARD`` postings. In a shard
every term has a list sorted by falling impact and every document a forward index. An item reads its lists in round-robin
turns, looks up each newly met document's other terms in the forward index, and stops when the threshold (the sum of
the next impacts of its lists) is strictly below its k-th score, so that ties are decided by the id. The k best of a shard
are merged by one window per item, which Spark cuts to k rows a task before the shuffle.

Items are dealt to parts of about ``ITEM_PART``; a part's lists hold its own terms only. Shards and parts meet as cells of
one job, so nothing of the items or the documents passes through the driver. The vocabulary and the weights
are broadcast if a count finds at most ``BROADCAST_ROWS`` rows, and joined by shuffles beyond.

Defined results: a null or empty text has no terms and is never found; a repeated row is a document of its own, so an id may
be found more than once; equal scores go to the smaller id, null last; items without terms find nothing; of items with one id
(null included) the least text is asked; empty tables give an empty result; extra columns are ignored. Ids of documents
are integers. Sums are 64-bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.llm.common import ascii_lower, checkpointed, counted, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 10
#: Postings of a shard and items of a part: they bound a task's memory.
SHARD, ITEM_PART = 400_000, 1024
#: Entries that each list gives in an item's first turn; every turn doubles them.
TURN = 16


def terms(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0))


class Shard:
    """Impact-sorted lists and forward index of the postings (document number, term number, impact)."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int, n_terms: int) -> None:
        by_doc = np.argsort(doc, kind="stable")
        self.terms, self.impacts = term[by_doc], impact[by_doc]
        self.first = np.searchsorted(doc[by_doc], np.arange(docs + 1))
        by_impact = np.lexsort((doc, -impact, term))
        self.listed, self.falling = doc[by_impact], impact[by_impact]
        self.starts = np.searchsorted(term[by_impact], np.arange(n_terms + 1))
        self.weight = np.zeros(n_terms, np.int64)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores of documents by their forward index, under the weights set for one item."""
        low, size = self.first[docs], self.first[docs + 1] - self.first[docs]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(low - ends + size, size)
        return np.add.reduceat(self.weight[self.terms[at]] * self.impacts[at], ends - size)

    def search(self, asked: np.ndarray, times: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best documents of one item (falling score, then ``order``), their scores, and how many were looked up."""
        self.weight[asked] = times
        low, high = self.starts[asked], self.starts[asked + 1]
        seen = np.zeros(len(order), bool)
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        step, looked = TURN, 0
        while (low < high).any():
            upto = np.minimum(low + step, high)
            met = np.concatenate([self.listed[a:b] for a, b in zip(low, upto, strict=True)])
            fresh = np.unique(met[~seen[met]])
            if len(fresh):
                seen[fresh] = True
                looked += len(fresh)
                best, score = np.concatenate([best, fresh]), np.concatenate([score, self.scores(fresh)])
                first = np.lexsort((order[best], -score))[:k]
                best, score = best[first], score[first]
            low = upto
            open_ = low < high
            threshold = (times[open_] * self.falling[low[open_]]).sum()
            if len(best) == k and threshold < score[-1]:
                break
            step *= 2
        self.weight[asked] = 0
        some = score > 0
        return best[some], score[some], looked


def _search_cell(k: int, id_type: pa.DataType):
    """Kernel of one cell: postings of a shard and items of a part -> the items' k best documents of the shard."""

    def run(postings: pa.Table, wanted: pa.Table) -> pa.Table:
        out: dict[str, list] = {"q": [], "doc": [], "row": [], "score": []}
        if postings.num_rows and wanted.num_rows:
            rows, at, doc = np.unique(postings["row"].to_numpy(), return_index=True, return_inverse=True)
            ids = postings["doc"].combine_chunks().take(pa.array(at))
            # Documents in the order of ties: id, null last, then row.
            key = ids.fill_null(0).to_numpy(zero_copy_only=False)
            order = np.empty(len(rows), np.int64)
            order[np.lexsort((rows, key, ids.is_null().to_numpy(zero_copy_only=False)))] = np.arange(len(rows))
            codes, term = np.unique(postings["code"].to_numpy(), return_inverse=True)
            shard = Shard(doc, term, postings["impact"].to_numpy(), len(rows), len(codes))
            q, code, times = (wanted[c].to_numpy() for c in ("q", "code", "times"))
            place = np.searchsorted(codes, code)
            known = np.flatnonzero(codes[np.minimum(place, len(codes) - 1)] == code)
            known = known[np.argsort(q[known], kind="stable")]
            for one in np.split(known, np.flatnonzero(np.diff(q[known])) + 1) if len(known) else []:
                best, score, _ = shard.search(place[one], times[one], order, k)
                out["q"].append(np.full(len(best), q[one[0]]))
                out["doc"].append(best)
                out["row"].append(rows[best])
                out["score"].append(score)
        flat = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()}
        found = ids.take(pa.array(flat["doc"])) if len(flat["doc"]) else pa.array([], id_type)
        return pa.table({"q": flat["q"], "doc": found, "row": flat["row"], "score": flat["score"]})

    return run


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text: str = "text", k: int = K, shard: int = SHARD, item_part: int = ITEM_PART) -> DataFrame:
    """(item_col, rank, id_col, score): the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    asked = items.groupBy(F.col(item_col).alias("item")).agg(F.min(item_text).alias("text"))
    asked = checkpointed(asked.withColumn("q", F.monotonically_increasing_id()))
    parts = -(-asked.count() // item_part) or 1
    part = F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int")
    wanted = asked.select("q", part.alias("part"), F.explode(terms(F.col("text"))).alias("term")).groupBy("q", "part", "term").agg(F.count(F.lit(1)).alias("times"))
    codes = checkpointed(wanted.select("term").distinct().withColumn("code", F.monotonically_increasing_id()))
    wanted = checkpointed(wanted.join(codes, "term"))
    vocabulary = counted(checkpointed(wanted.select("part", "term", "code").distinct()))

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    n = F.coalesce(F.regexp_count("text", F.lit(TERM)), F.lit(0)).cast("long")
    total = texts.select(n.alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    split = texts.select(F.monotonically_increasing_id().alias("row"), "doc", terms(F.col("text")).alias("terms")).withColumn("n", F.size("terms").cast("long"))
    hits = split.select("row", "doc", "n", F.explode("terms").alias("term")).join(vocabulary, "term")
    postings = stored(hits.groupBy("part", "row", "doc", "n", "code").agg(F.count(F.lit(1)).alias("tf")))

    weight = F.floor(1000 * F.log((2 * F.lit(total["docs"]) + 2) / (2 * F.col("df") + 1)))
    weights = counted(checkpointed(postings.groupBy("part", "code").agg(F.count(F.lit(1)).alias("df")).select("part", "code", weight.alias("w"))))
    factor = f"(25 + (75 * n * {total['docs']}L) div {max(total['terms'], 1)}L)"
    impact = F.col("w") * F.expr(f"(1000000000L * tf) div (1000 * tf + 8 * {factor})")
    shards = max(2 * spark.sparkContext.defaultParallelism, -(-postings.count() // shard))
    left = postings.join(weights, ["part", "code"]).select("part", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "row", "doc", "code", impact.alias("impact"))
    right = wanted.select("part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "q", "code", "times")
    cells = left.groupBy("part", "shard").cogroup(right.groupBy("part", "shard"))
    found = cells.applyInArrow(_search_cell(k, pa.int64()), "q long, doc long, row long, score long")
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last(), "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("q", "item"), "q").select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
