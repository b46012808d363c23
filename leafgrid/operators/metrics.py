"""Evaluation of predicted blocks: outcomes per block, then counts, rates and confusion tables.

``evaluate`` makes one row per ground-truth block and per prediction; every report is a sum over the numbers of blocks of each kind of outcome.
Categories are a grouping column of the same pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, ByteType, StringType, StructField, StructType

from leafgrid.functions import text as T
from leafgrid.operators import matching as M
from leafgrid.operators import outcomes as O
from leafgrid.sources.shared import checkpointed

MISSING, EXTRA = "__missing__", "__extra__"
#: What tells outcomes apart in ``Outcomes.tally``.
KINDS = ("side", "label", "level", "pred_label", "pred_level", "used", "strict", "correct", "correct_level", "known")


@dataclass(frozen=True)
class Outcomes:
    """``rows``: one row per block: doc, side (1 ground truth, 2 prediction), idx, label, level, pred_idx, pred_label, pred_level (ground truth only), used, strict, correct,
    correct_level, known (its document has ground truth)."""

    rows: DataFrame

    @property
    def gt(self) -> DataFrame:
        """doc, idx, label, level, pred_idx, pred_label, pred_level, matched, strict, correct, correct_level."""
        kept = self.rows.where(F.col("side") == O.GT).withColumn("matched", F.col("used"))
        return kept.select("doc", "idx", "label", "level", "pred_idx", "pred_label", "pred_level", "matched", "strict", "correct", "correct_level")

    @property
    def pred(self) -> DataFrame:
        """doc, idx, label, level, used, correct, correct_level, known."""
        return self.rows.where(F.col("side") == O.PRED).select("doc", "idx", "label", "level", "used", "correct", "correct_level", "known")

    @cached_property
    def tally(self) -> DataFrame:
        """Number of blocks (n) of each kind of outcome. All reports of the corpus are sums over it, so it is made once, as a checkpoint of some hundred rows."""
        return checkpointed(self.rows.groupBy(*KINDS).agg(F.count(F.lit(1)).alias("n")))


def evaluate(gt: DataFrame, pred: DataFrame, min_iou: float = 0.5, min_coverage: float | None = None, region_coverage: float | None = 0.8,
             exempt: tuple[str, ...] = M.BBOX_EXEMPT, label_only: tuple[str, ...] = M.LABEL_ONLY, flowchart_pages: DataFrame | None = None,
             failed_pages: DataFrame | None = None, gt_docs: DataFrame | None = None, fold=T.fold_text) -> Outcomes:
    """Outcomes of all blocks. ``region_coverage`` None leaves out region equivalence; ``gt_docs`` lists documents
    that have ground truth, also those without blocks (default: those with blocks).

    Each side is read once: the rows of both meet in one window of their document, ordered by page, and whole pages are matched there.
    """
    for name, value in (("min_iou", min_iou), ("min_coverage", min_coverage), ("region_coverage", region_coverage)):
        if value is not None:
            M._threshold(name, value)
    if failed_pages is not None:
        gt_docs = gt if gt_docs is None else gt_docs
        gt, pred = M.without_pages(gt, failed_pages), M.without_pages(pred, failed_pages)
    fields = gt.schema
    text = ["text"] if region_coverage is not None else []
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in fields}
    columns = ("doc", "page_id", "idx", "label", "level", "x1", "y1", "x2", "y2", *text)

    def side(k: int, rows: DataFrame, *given: str) -> DataFrame:
        value = lambda c: none[c] if c not in given else fold(F.col(c)).alias(c) if c == "text" else F.col(c).cast(fields[c].dataType).alias(c)
        return rows.select(F.lit(k).cast("tinyint").alias("side"), *map(value, columns))

    both = side(O.GT, gt, *columns).union(side(O.PRED, pred, *columns))
    if gt_docs is not None:
        both = both.union(side(O.DOCUMENT, gt_docs.select("doc").distinct(), "doc"))
    if flowchart_pages is not None:
        both = both.union(side(O.CHARTS, flowchart_pages.select("doc", "page_id"), "doc", "page_id"))
    document = Window.partitionBy("doc").orderBy("page_id", "side").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = both.withColumn("known", F.max((F.col("side") == (O.GT if gt_docs is None else O.DOCUMENT)) & F.col("doc").isNotNull()).over(document))
    rules = O.Rules(min_iou, min_coverage, region_coverage, tuple(exempt), (*exempt, *label_only), M.FLOWCHART_LABELS, M.FLOWCHART_COVERAGE)
    flag = StructType([StructField(c, BooleanType()) for c in ("used", "strict", "correct", "correct_level", "known")])
    said = [StructField("pred_idx", fields["idx"].dataType), StructField("pred_label", StringType()), StructField("pred_level", StringType())]
    schema = StructType([StructField("side", ByteType()), *[StructField(c, fields[c].dataType) for c in ("doc", "idx", "label", "level")], *said, *flag])
    arrow = to_arrow_schema(schema)

    def judged(batches):
        for pages in O.whole_pages(batches):
            yield from O.Pages(pages, rules).outcomes(arrow).to_batches()

    return Outcomes(both.mapInArrow(judged, schema))


def rate(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.lit(2.0) * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))


def with_rates(t: DataFrame) -> DataFrame:
    """Adds recall, precision and f1 to support, correct, pred_correct, predicted."""
    t = t.withColumn("recall", rate(F.col("correct"), F.col("support"))).withColumn("precision", rate(F.col("pred_correct"), F.col("predicted")))
    return t.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def _number(where: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0).cast("long"))


def _counts(kinds: DataFrame, name: str, correct: str, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    gt = F.col("side") == O.GT
    return with_rates(kinds.groupBy(*extra_keys, name).agg(
        _number(gt).alias("support"), _number(gt & F.col(correct)).alias("correct"), _number(~gt & F.col(correct)).alias("pred_correct"), _number(~gt).alias("predicted"),
    ))


def per_label(o: Outcomes) -> DataFrame:
    return _counts(o.tally, "label", "correct")


def per_level(o: Outcomes) -> DataFrame:
    """By level over all blocks; correct needs label and level."""
    return _counts(o.tally, "level", "correct_level")


def title_levels(o: Outcomes) -> DataFrame:
    """By level over paragraph titles."""
    return _counts(o.tally.where(F.col("label") == "paragraph_title"), "level", "correct_level")


def per_category(o: Outcomes, category: DataFrame) -> DataFrame:
    """Per label within each category; ``category`` maps doc to category. Predictions of unknown documents are left out."""
    known = o.rows.where((F.col("side") == O.GT) | F.col("known"))
    # The numbers of each document first, so that the join carries as few rows as there are kinds in it.
    kinds = known.groupBy("doc", "side", "label", "correct").agg(F.count(F.lit(1)).alias("n"))
    return _counts(kinds.join(category, "doc"), "label", "correct", ("category",))


def level_rank(level: Column) -> Column:
    """Sort key of levels: H1, H2, ..., then other names, then none."""
    return F.when(level.rlike("^H[0-9]+$"), F.struct(F.lit(0), F.try_to_number(F.substring(level, 2, 9), F.lit("999999999")).cast("int"), level)).when(
        level == "none", F.struct(F.lit(2), F.lit(0), level)
    ).otherwise(F.struct(F.lit(1), F.lit(0), level))


def label_confusion(o: Outcomes) -> DataFrame:
    """(gt_label, pred_label, n) of blocks that are not correct, with missing and extra ones."""
    gt, t = F.col("side") == O.GT, o.tally.where(~F.col("correct"))
    wrong = t.where(gt).select(F.col("label").alias("gt_label"), F.when(F.col("used"), F.col("pred_label")).otherwise(MISSING).alias("pred_label"), "n")
    extra = t.where(~gt & ~F.col("used")).select(F.lit(EXTRA).alias("gt_label"), F.col("label").alias("pred_label"), "n")
    return wrong.unionByName(extra).groupBy("gt_label", "pred_label").agg(F.sum("n").alias("n"))


def level_confusion(o: Outcomes, titles_only: bool = False) -> DataFrame:
    """(gt_level, pred_level, n): the predicted level where labels agree, else the predicted label."""
    gt, t = F.col("side") == O.GT, o.tally.where(F.col("label") == "paragraph_title") if titles_only else o.tally
    said = F.when(~F.col("used"), MISSING).when(F.col("pred_label") == F.col("label"), F.col("pred_level")).otherwise(F.col("pred_label"))
    wrong = t.where(gt & ~F.col("correct_level")).select(F.col("level").alias("gt_level"), said.alias("pred_level"), "n")
    extra = t.where(~gt & F.col("known") & ~F.col("used") & ~F.col("correct")).select(F.lit(EXTRA).alias("gt_level"), F.col("level").alias("pred_level"), "n")
    return wrong.unionByName(extra).groupBy("gt_level", "pred_level").agg(F.sum("n").alias("n"))


def top_confusions(confusion: DataFrame, n: int = 20) -> DataFrame:
    a, b = confusion.columns[:2]
    return confusion.orderBy(F.col("n").desc(), a, b).limit(n)


def per_document(o: Outcomes) -> DataFrame:
    gt = F.col("side") == O.GT
    both = o.rows.where(gt | F.col("known")).groupBy("doc").agg(
        F.count_if(gt).alias("gt"), F.count_if(~gt).alias("predicted"), F.count_if(gt & F.col("used")).alias("matched"), F.count_if(gt & F.col("strict")).alias("strict"),
        F.count_if(gt & F.col("correct")).alias("correct"), F.count_if(~gt & F.col("correct")).alias("pred_correct"),
        F.count_if(gt & ~F.col("used") & ~F.col("correct")).alias("missing"), F.count_if(~gt & ~F.col("used") & ~F.col("correct")).alias("extra"),
    )
    return both.select(
        "doc", "gt", "predicted", "matched", "correct", "pred_correct", rate(F.col("matched"), F.col("gt")).alias("detection_recall"),
        rate(F.col("strict"), F.col("matched")).alias("classification_accuracy"), rate(F.col("correct"), F.col("gt")).alias("end_to_end_recall"), "missing", "extra",
    )


def totals(o: Outcomes) -> DataFrame:
    """One row: totals, detection, classification and end-to-end rates."""
    gt, used, right = F.col("side") == O.GT, F.col("used"), F.col("correct")
    t = o.tally.agg(
        _number(gt).alias("total_gt"), _number(gt & used).alias("total_matched"), _number(gt & F.col("strict")).alias("strict"), _number(gt & right).alias("total_correct"),
        _number(gt & ~used & ~right).alias("missing"), _number(~gt).alias("total_predicted"), _number(~gt & right).alias("total_pred_correct"), _number(~gt & ~used & ~right).alias("extra"),
    )
    t = t.withColumns({
        "detection_precision": rate(F.col("total_matched"), F.col("total_predicted")), "detection_recall": rate(F.col("total_matched"), F.col("total_gt")),
        "classification_accuracy": rate(F.col("strict"), F.col("total_matched")),
        "precision": rate(F.col("total_pred_correct"), F.col("total_predicted")), "recall": rate(F.col("total_correct"), F.col("total_gt")),
    })
    return t.withColumns({"detection_f1": f1(F.col("detection_precision"), F.col("detection_recall")), "f1": f1(F.col("precision"), F.col("recall"))}).drop("strict")


def report_json(o: Outcomes) -> DataFrame:
    """The whole result as one JSON text: totals, labels, title levels, documents."""
    rows = lambda t, key: t.select(F.struct(*[F.col(c) for c in t.columns]).alias("r"), F.lit(1).alias("one")).groupBy("one").agg(F.sort_array(F.collect_list("r")).alias(key))
    t = totals(o)
    t = t.select(F.struct(*[F.col(c) for c in t.columns]).alias("totals"), F.lit(1).alias("one"))
    for key, part in (("per_label", per_label(o)), ("paragraph_title_by_level", title_levels(o)), ("job_rows", per_document(o))):
        t = t.join(rows(part, key), "one", "left")
    return t.select(F.to_json(F.struct("totals", "per_label", "paragraph_title_by_level", "job_rows"), {"ignoreNullFields": "false"}).alias("report"))


def report_lines(o: Outcomes, labels: int = 20, levels: int = 10) -> DataFrame:
    """The printed report as rows (section, pos, line): documents, labels, levels, title levels, totals, and the most frequent label and level errors.

    Every section is formatted where its table is; ``sort("section", "pos")`` puts the lines together.
    """
    share = lambda c, width, digits=1: F.lpad(F.format_string(f"%.{digits}f%%", F.col(c) * 100), width, " ")
    number = lambda c, width: F.lpad(F.col(c).cast("string"), width, " ")
    name = lambda c, width: F.when(F.length(c) >= width, F.col(c)).otherwise(F.rpad(F.col(c), width, " "))

    def section(k: int, rows: DataFrame, order, *parts) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(F.lit(k)).orderBy(*order))
        return rows.select(F.lit(k).alias("section"), place.alias("pos"), F.concat(F.lit("  "), *parts).alias("line"))

    def rates(k: int, rows: DataFrame, key: str, order) -> DataFrame:
        score = F.lpad(F.format_string("%.3f", F.col("f1")), 8, " ")
        return section(k, rows, order, name(key, 20), number("support", 9), number("correct", 9), share("recall", 9), share("precision", 11), score)

    def errors(k: int, rows: DataFrame, width: int, other: int) -> DataFrame:
        a, b = rows.columns[:2]
        return section(k, rows, [F.col("n").desc(), a, b], name(a, width), F.lit(" -> "), name(b, other), F.lit(" "), F.col("n").cast("string"))

    docs = per_document(o).withColumn("doc", F.col("doc").cast("string"))
    doc_line = (
        F.rpad(F.substring("doc", 1, 24), 24, " "), *[number(c, 7) for c in ("gt", "predicted", "matched")], number("correct", 10), share("end_to_end_recall", 12), number("missing", 7), number("extra", 7)
    )
    # Rows of documents are as many as documents, so they are numbered by document instead of one window over all.
    lines = docs.select(F.lit(1).alias("section"), F.lit(0).alias("pos"), F.concat(F.lit("  "), *doc_line).alias("line"))
    lines = lines.union(rates(2, per_label(o), "label", ["label"])).union(rates(3, per_level(o), "level", [level_rank(F.col("level"))])).union(rates(4, title_levels(o), "level", [level_rank(F.col("level"))]))
    t = totals(o)
    counts = F.format_string("GT=%d, 预测=%d, 几何匹配=%d, 区域等价正确 GT/预测=%d/%d", "total_gt", "total_predicted", "total_matched", "total_correct", "total_pred_correct")
    detection = F.format_string("Precision=%.2f%%, Recall=%.2f%%, F1=%.2f%%", *[F.col(c) * 100 for c in ("detection_precision", "detection_recall", "detection_f1")])
    whole = F.format_string("Precision=%.2f%%, Recall=%.2f%%, F1=%.2f%%", *[F.col(c) * 100 for c in ("precision", "recall", "f1")])
    said = F.array(counts, detection, F.format_string("%.2f%%", F.col("classification_accuracy") * 100), whole, F.format_string("漏检=%d, 误检=%d", "missing", "extra"))
    lines = lines.union(t.select(F.lit(5).alias("section"), F.posexplode(said)).select("section", (F.col("pos") + 1).alias("pos"), F.concat(F.lit("  "), "col")))
    lines = lines.union(errors(6, top_confusions(label_confusion(o), labels), 20, 20))
    return lines.union(errors(7, top_confusions(level_confusion(o, titles_only=True), levels), 10, 16))
