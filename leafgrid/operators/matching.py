"""Matching of ground-truth and predicted blocks.

Blocks have doc, page_id, idx (position in the document), label, level, x1, y1, x2, y2 and text. All joins are on
(doc, page_id): a page bounds every group, candidate list and component, so nothing grows with the corpus
but the number of pages, and the overlap test is a residual condition of a hash or merge join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.functions.geometry import Box, area, coverage, group_coverage, intersection, iou, let, max_pair_overlap, overlaps
from leafgrid.functions.text import fold_text

#: Labels whose boxes are not held against each other.
BBOX_EXEMPT, LABEL_ONLY = ("footer",), ("header",)
#: Labels that may stand for a flowchart on listed pages, and the coverage one of them must reach.
FLOWCHART_LABELS, FLOWCHART_COVERAGE = ("flowchart", "image", "text"), 0.10
FIELDS = ("idx", "label", "level", "x1", "y1", "x2", "y2", "text")
_KEYS = ("doc", "page_id")


def _threshold(name: str, value: float) -> None:
    if not 0.0 <= value <= 1.0:
        raise ValueError(f"{name} must lie between 0 and 1, got {value}")


def _side(blocks: DataFrame, prefix: str) -> DataFrame:
    return blocks.select(*_KEYS, *[F.col(c).alias(prefix + c) for c in FIELDS])


def without_pages(blocks: DataFrame, failed: DataFrame) -> DataFrame:
    """Blocks of pages that are not listed in ``failed`` (doc, page_id)."""
    return blocks.join(failed.select(*_KEYS).distinct(), list(_KEYS), "left_anti")


def candidate_pairs(gt: DataFrame, pred: DataFrame, min_iou: float = 0.5, min_coverage: float | None = None) -> DataFrame:
    """Pairs of one page with IoU (and coverage of the ground truth) at or above the thresholds."""
    _threshold("min_iou", min_iou)
    a, b = Box.named("g_"), Box.named("p_")
    on = [F.col("g_doc_") == F.col("p_doc_"), F.col("g_page_") == F.col("p_page_")]
    left = _side(gt, "g_").withColumnsRenamed({"doc": "g_doc_", "page_id": "g_page_"})
    right = _side(pred, "p_").withColumnsRenamed({"doc": "p_doc_", "page_id": "p_page_"})
    if min_iou > 0:
        on.append(overlaps(a, b))
    pairs = left.join(right, on).withColumn("iou", iou(a, b)).withColumn("gt_coverage", coverage(a, b)).where(F.col("iou") >= min_iou)
    if min_coverage is not None:
        _threshold("min_coverage", min_coverage)
        pairs = pairs.where(F.col("gt_coverage") >= min_coverage)
    return pairs.select(
        F.col("g_doc_").alias("doc"), F.col("g_page_").alias("page_id"), F.col("g_idx").alias("gt_idx"), F.col("p_idx").alias("pred_idx"), "gt_coverage", "iou"
    )


def greedy_matches(gt: DataFrame, pred: DataFrame, min_iou: float = 0.5, min_coverage: float | None = None) -> DataFrame:
    """One-to-one matches (doc, page_id, gt_idx, pred_idx, gt_coverage, iou): best IoU first, then coverage, then indices.

    Candidates never cross pages, so a fold over each page's sorted candidates is the global greedy choice.
    """
    pairs = candidate_pairs(gt, pred, min_iou, min_coverage)
    row = F.struct("iou", "gt_coverage", "gt_idx", "pred_idx")
    kind = "struct<g:array<int>,p:array<int>,out:array<struct<iou:double,gt_coverage:double,gt_idx:int,pred_idx:int>>>"
    start = F.from_json(F.lit('{"g":[],"p":[],"out":[]}'), kind)

    def step(acc: Column, x: Column) -> Column:
        free = ~F.array_contains(acc["g"], x["gt_idx"]) & ~F.array_contains(acc["p"], x["pred_idx"])
        taken = F.struct(
            F.array_append(acc["g"], x["gt_idx"]).alias("g"), F.array_append(acc["p"], x["pred_idx"]).alias("p"), F.array_append(acc["out"], x).alias("out")
        )
        return F.when(free, taken).otherwise(acc)

    pages = pairs.groupBy(*_KEYS).agg(F.sort_array(F.collect_list(row), asc=False).alias("c"))
    return pages.select(*_KEYS, F.explode(F.aggregate("c", start, step)["out"]).alias("m")).select(
        *_KEYS, "m.gt_idx", "m.pred_idx", "m.gt_coverage", "m.iou"
    )


def label_pairs(gt: DataFrame, pred: DataFrame, labels: tuple[str, ...] = (*BBOX_EXEMPT, *LABEL_ONLY)) -> DataFrame:
    """The k-th block of a label on a page with the k-th prediction of that label, in box order; no threshold."""
    order = Window.partitionBy(*_KEYS, "label").orderBy("x1", "y1", "x2", "y2", "idx")

    def ranked(blocks: DataFrame, prefix: str) -> DataFrame:
        kept = blocks.where(F.col("label").isin(*labels)).withColumn("k", F.row_number().over(order))
        return kept.select(*_KEYS, "label", "k", F.col("idx").alias(f"{prefix}idx"), *[F.col(c).alias(prefix + c) for c in ("x1", "y1", "x2", "y2")])

    both = ranked(gt, "g_").join(ranked(pred, "p_"), [*_KEYS, "label", "k"])
    a, b = Box.named("g_"), Box.named("p_")
    return both.select(*_KEYS, F.col("g_idx").alias("gt_idx"), F.col("p_idx").alias("pred_idx"), coverage(a, b).alias("gt_coverage"), iou(a, b).alias("iou"))


def plain_text(text: Column) -> Column:
    """Lower-cased letters and digits only (compatibility folding is ``functions.text.fold_text``)."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def shared_characters(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two strings' characters."""
    length_without = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    distinct = F.array_distinct(F.split(a, ""))
    each = F.transform(F.filter(distinct, lambda c: c != ""), lambda c: F.least(length_without(a, c), length_without(b, c)))
    return F.aggregate(each, F.lit(0), lambda s, n: s + n)


def regions(gt: DataFrame, pred: DataFrame, keys: tuple[str, ...] = ("label",), excluded: tuple[str, ...] = (*BBOX_EXEMPT, *LABEL_ONLY)) -> DataFrame:
    """Connected components of overlapping blocks of one page and key: one row per component.

    Columns: doc, page_id, component number, g and p (arrays of block structs). Components merge in a fold over
    the page's edges; ground truth has even node numbers, predictions odd ones.
    """
    on = [*_KEYS, *keys]
    fields = F.struct(*[F.col(c) for c in FIELDS])
    pick = lambda blocks, name: blocks.where(~F.col("label").isin(*excluded)).select(*on, fields.alias(name))
    edges = pick(gt, "g").join(pick(pred, "p"), on).where(intersection(Box.of(F.col("g")), Box.of(F.col("p"))) > 0)
    pages = edges.groupBy(*on).agg(
        F.collect_list(F.array(F.col("g.idx") * 2, F.col("p.idx") * 2 + 1)).alias("e"),
        F.collect_set("g").alias("gs"), F.collect_set("p").alias("ps"),
    )

    def step(acc: Column, edge: Column) -> Column:
        touched = F.filter(acc, lambda c: F.arrays_overlap(c, edge))
        others = F.filter(acc, lambda c: ~F.arrays_overlap(c, edge))
        return F.array_append(others, F.array_distinct(F.concat(F.flatten(touched), edge)))

    merged = F.aggregate("e", F.array().cast("array<array<int>>"), step)
    each = pages.select(*on, "gs", "ps", F.posexplode(merged).alias("component", "nodes"))
    return each.select(
        *on, "component",
        F.filter("gs", lambda b: F.array_contains("nodes", b["idx"] * 2)).alias("g"),
        F.filter("ps", lambda b: F.array_contains("nodes", b["idx"] * 2 + 1)).alias("p"),
    )


def equivalent_regions(gt: DataFrame, pred: DataFrame, keys: tuple[str, ...] = ("label",), min_coverage: float = 0.8,
                       excluded: tuple[str, ...] = (*BBOX_EXEMPT, *LABEL_ONLY), fold=fold_text) -> DataFrame:
    """Blocks that count as correct because their region holds the same content: (doc, side, idx), side g or p.

    A component counts if both texts cover each other; or it is one to one and the prediction covers the ground
    truth's text; or it is not one to one, neither side overlaps itself, and each box is covered by the other side.
    """
    _threshold("min_coverage", min_coverage)
    found = regions(gt, pred, keys, excluded)
    joined = lambda side: F.array_join(F.transform(side, lambda b: F.coalesce(b["text"], F.lit(""))), "")
    found = found.withColumns({"gt_text": fold(joined("g")), "pred_text": fold(joined("p"))})
    boxes = lambda side: F.transform(side, lambda b: Box.of(b).struct())

    def covered(side: Column, other: Column) -> Column:
        return F.forall(side, lambda b: group_coverage(Box.of(b), other) >= min_coverage)

    def by_box(b: Column) -> Column:
        apart = (max_pair_overlap(b["g"]) <= 0.5) & (max_pair_overlap(b["p"]) <= 0.5)
        return F.when(apart, F.when(covered(b["g"], b["p"]), covered(b["p"], b["g"])).otherwise(False)).otherwise(False)

    def judged(t: Column) -> Column:
        common = F.when((t["gt"] == "") | (t["pred"] == ""), 0).otherwise(shared_characters(t["gt"], t["pred"]))

        def by_share(c: Column) -> Column:
            share = lambda text: F.coalesce(c / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))
            single = (F.size("g") == 1) & (F.size("p") == 1)
            by_text = ((share(t["gt"]) >= min_coverage) & (share(t["pred"]) >= min_coverage)) | (single & (share(t["gt"]) >= 0.9))
            return F.when(by_text, True).when(single, False).otherwise(let(F.struct(boxes("g").alias("g"), boxes("p").alias("p")), by_box))

        return let(common, by_share)

    # One expression, each part bound once: a filter repeats whatever it refers to.
    right = found.where(let(F.struct(F.col("gt_text").alias("gt"), F.col("pred_text").alias("pred")), judged))
    members = lambda side, name: F.transform(side, lambda b: F.struct(F.lit(name).alias("side"), b["idx"].alias("idx")))
    return right.select("doc", F.explode(F.concat(members(F.col("g"), "g"), members(F.col("p"), "p"))).alias("m")).select("doc", "m.side", "m.idx")


def flowchart_matches(gt: DataFrame, pred: DataFrame, pages: DataFrame) -> DataFrame:
    """Flowcharts on the listed pages (doc, page_id), each accepted by all free predictions that overlap it.

    In order of position, a flowchart takes the predictions with an accepted label that overlap it and are not taken; it
    counts if one of them covers ``FLOWCHART_COVERAGE`` of it. Returns doc, page_id, gt_idx, pred_idx (the best one),
    gt_coverage (of all together, if greater), iou, and accepted (all predictions taken).
    """
    listed = pages.select(*_KEYS).distinct()
    block = F.struct("idx", "x1", "y1", "x2", "y2")
    charts = gt.where(F.col("label") == "flowchart").join(listed, list(_KEYS), "left_semi").groupBy(*_KEYS).agg(F.array_sort(F.collect_list(block)).alias("g"))
    answers = pred.where(F.col("label").isin(*FLOWCHART_LABELS)).groupBy(*_KEYS).agg(F.array_sort(F.collect_list(block)).alias("p"))
    kind = "struct<used:array<int>,out:array<struct<gt_idx:int,pred_idx:int,gt_coverage:double,iou:double,accepted:array<int>>>>"
    start = F.from_json(F.lit('{"used":[],"out":[]}'), kind)

    def step(acc: Column, g: Column) -> Column:
        free = F.filter("p", lambda p: ~F.array_contains(acc["used"], p["idx"]) & (intersection(Box.of(g), Box.of(p)) > 0) & (area(Box.of(g)) > 0))
        ranked = F.transform(free, lambda p: F.struct(coverage(Box.of(g), Box.of(p)).alias("c"), iou(Box.of(g), Box.of(p)).alias("i"), p["idx"].alias("idx")))
        best = F.array_max(ranked)
        together = group_coverage(Box.of(g), F.transform(free, lambda p: Box.of(p).struct()))
        ids = F.transform(free, lambda p: p["idx"])
        one = F.struct(g["idx"].alias("gt_idx"), best["idx"].alias("pred_idx"), F.greatest(best["c"], together).alias("gt_coverage"), best["i"].alias("iou"), ids.alias("accepted"))
        taken = F.struct(F.concat(acc["used"], ids).alias("used"), F.array_append(acc["out"], one).alias("out"))
        return F.when(F.coalesce(best["c"], F.lit(0.0)) >= FLOWCHART_COVERAGE, taken).otherwise(acc)

    both = charts.join(answers, list(_KEYS))
    return both.select(*_KEYS, F.explode(F.aggregate("g", start, step)["out"]).alias("m")).select(*_KEYS, "m.*")


def overlay(gt: DataFrame, pred: DataFrame, flowchart_pages: DataFrame | None = None, loose: tuple[str, ...] = (*BBOX_EXEMPT, *LABEL_ONLY),
            min_iou: float = 0.5, min_coverage: float | None = None) -> DataFrame:
    """Matches (doc, page_id, gt_idx, pred_idx, kind) of geometry, of labels and of flowcharts; the last named wins a block."""
    columns = [*_KEYS, "gt_idx", "pred_idx"]
    solid = lambda b: b.where(~F.col("label").isin(*loose))
    out = greedy_matches(solid(gt), solid(pred), min_iou, min_coverage).select(*columns, F.lit("geometry").alias("kind"))
    out = out.unionByName(label_pairs(gt, pred, loose).select(*columns, F.lit("label").alias("kind")))
    if flowchart_pages is None:
        return out
    charts = flowchart_matches(gt, pred, flowchart_pages).select(*columns, F.lit("flowchart").alias("kind"))
    return out.join(charts.select("doc", "gt_idx"), ["doc", "gt_idx"], "left_anti").unionByName(charts)
