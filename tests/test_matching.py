"""The reference cases of matching and evaluation, and order-dependent operators against brute force."""

import random

from pyspark.sql import functions as F

from leafgrid.functions.text import fold_text
from leafgrid.operators import matching as M
from leafgrid.operators import metrics as E

SCHEMA = "doc long, page_id int, idx int, label string, level string, x1 double, y1 double, x2 double, y2 double, text string"


def blocks(spark, rows, doc=1):
    return spark.createDataFrame([(doc, 0, i, label, level, *map(float, box), text) for i, (label, level, box, text) in enumerate(rows)], SCHEMA)


def b(label, box, text="", level="none"):
    return (label, level, box, text)


def matches(spark, gt, pred, **k):
    return {(r["gt_idx"], r["pred_idx"]) for r in M.greedy_matches(blocks(spark, gt), blocks(spark, pred), **k).collect()}


def region(spark, gt, pred):
    out = M.equivalent_regions(blocks(spark, gt), blocks(spark, pred), fold=fold_text).collect()
    return {r["idx"] for r in out if r["side"] == "g"}, {r["idx"] for r in out if r["side"] == "p"}


def test_greedy_match_ignores_labels_and_huge_boxes(spark):
    full = [0, 0, 100, 100]
    assert matches(spark, [b("text", full)], [b("text", [0, 0, 70, 100]), b("paragraph_title", full)]) == {(0, 1)}
    assert matches(spark, [b("text", full)], [b("text", [0, 0, 1000, 1000])]) == set()


def test_region_equivalence_cases(spark):
    full, text = [0, 0, 100, 100], "某软件股份有限公司提供技术支持，确保系统正常运行。"
    three = ["项目名称：迁移上线项目", "委托方：某公司", "受托方：某软件公司"]
    parts = ["第一段正文", "第二段正文", "第三段正文"]
    rows = [[0, 0, 100, 20], [0, 40, 100, 60], [0, 80, 100, 100]]
    cases = [
        ([b("text", [0, 0, 100, 45]), b("text", [0, 55, 100, 100])], [b("text", full)], ({0, 1}, {0})),
        ([b("image", full)], [b("image", [0, 0, 50, 100]), b("image", [50, 0, 100, 100])], ({0}, {0, 1})),
        ([b("image", full)], [b("image", full), b("image", full)], (set(), set())),
        ([b("text", [0, 0, 100, 20]), b("text", [0, 80, 100, 100])], [b("text", full)], (set(), set())),
        ([b("text", r, t) for r, t in zip(rows, three)], [b("text", full, " ".join(three))], ({0, 1, 2}, {0})),
        ([b("text", full, " ".join(parts))], [b("text", r, t) for r, t in zip(rows, parts)], ({0}, {0, 1, 2})),
        ([b("text", full, " ".join(parts))], [b("text", full, parts[1])], (set(), set())),
        ([b("paragraph_title", full, "治理升级，筑牢风险防控底线")], [b("paragraph_title", [60, 60, 160, 160], "治理升级，筑牢风险防控底线")], ({0}, {0})),
        ([b("text", [10, 40, 90, 80], text)], [b("text", full, "1、技术咨询的目标：" + text)], ({0}, {0})),
        ([b("text", [10, 40, 90, 80], "无")], [b("text", full, "4、本合同履行完毕后：无")], ({0}, {0})),
    ]
    for gt, pred, want in cases:
        assert region(spark, gt, pred) == want


def totals(spark, gt, pred, **k):
    return E.totals(E.evaluate(blocks(spark, gt), blocks(spark, pred), **k)).first()


def test_evaluation_cases(spark):
    full = [0, 0, 100, 100]
    r = totals(spark, [b("text", full)], [b("text", [0, 0, 70, 100]), b("paragraph_title", full)])
    assert (r["total_matched"], r["total_correct"], r["classification_accuracy"], r["f1"]) == (1, 0, 0.0, 0.0)
    r = totals(spark, [b("footer", full)], [b("footer", [300, 300, 320, 320])])
    assert (r["total_matched"], r["recall"], r["precision"]) == (1, 1.0, 1.0)
    assert totals(spark, [b("footer", full)], [])["recall"] == 1.0
    assert totals(spark, [b("header", full)], [b("header", [300, 300, 320, 320])])["recall"] == 1.0
    assert totals(spark, [b("header", full)], [])["recall"] == 0.0
    r = totals(spark, [b("text", [0, 0, 100, 50]), b("text", [0, 50, 100, 100])], [b("text", full)])
    assert (r["recall"], r["precision"]) == (1.0, 1.0)
    wrong_level = E.evaluate(blocks(spark, [b("paragraph_title", full, "", "H3")]), blocks(spark, [b("paragraph_title", full, "", "H2")]))
    assert E.per_label(wrong_level).first()["correct"] == 1
    assert {x["level"]: x["correct"] for x in E.title_levels(wrong_level).collect()} == {"H3": 0, "H2": 0}


def test_failed_pages_are_left_out(spark):
    gt = blocks(spark, [b("text", [0, 0, 10, 10])]).union(blocks(spark, [b("text", [0, 0, 10, 10])]).withColumns({"page_id": F.lit(1), "idx": F.lit(1)}))
    failed = spark.createDataFrame([(1, 1)], "doc long, page_id int")
    r = E.totals(E.evaluate(gt, gt, failed_pages=failed)).first()
    assert (r["total_gt"], r["total_predicted"]) == (1, 1)


def overlap(a, c):
    return max(0, min(a[2], c[2]) - max(a[0], c[0])) * max(0, min(a[3], c[3]) - max(a[1], c[1]))


def test_flowcharts_equal_brute_force(spark):
    rng = random.Random(3)

    def boxes(n):
        return [(x, y, x + rng.randrange(5, 40), y + rng.randrange(5, 40)) for x, y in ((rng.randrange(60), rng.randrange(60)) for _ in range(n))]

    gt = [b("flowchart", x) for x in boxes(12)]
    pred = [b(rng.choice(["text", "image", "table", "flowchart"]), [v + rng.randrange(-2, 3) for v in x[2]]) for x in gt for _ in range(2)]
    pred = [p for p in pred if p[2][0] < p[2][2] and p[2][1] < p[2][3]]
    used, want = set(), {}
    for g, (_, _, box, _) in enumerate(gt):
        area = (box[2] - box[0]) * (box[3] - box[1])
        free = [(overlap(box, q[2]) / area, p) for p, q in enumerate(pred) if p not in used and q[0] in ("flowchart", "image", "text") and overlap(box, q[2]) > 0]
        if free and max(free)[0] >= 0.10:
            want[g] = {p for _, p in free}
            used |= want[g]
    pages = spark.createDataFrame([(1, 0)], "doc long, page_id int")
    got = {r["gt_idx"]: set(r["accepted"]) for r in M.flowchart_matches(blocks(spark, gt), blocks(spark, pred), pages).collect()}
    assert got == want


def test_flowchart_cases(spark):
    pages = spark.createDataFrame([(1, 0)], "doc long, page_id int")
    chart = blocks(spark, [b("flowchart", [0, 0, 100, 100])])
    covers = lambda y: M.flowchart_matches(chart, blocks(spark, [b("text", [0, 0, 100, y])]), pages).collect()
    assert [r["accepted"] for r in covers(40)] == [[0]] and [r["gt_coverage"] for r in covers(10)] == [0.1] and covers(9) == []
    # A table matches the chart by geometry, then an image is accepted for it: the table stays used, so it is no extra block.
    said = blocks(spark, [b("table", [0, 0, 100, 90]), b("image", [0, 0, 100, 30])])
    out = E.evaluate(chart, said, flowchart_pages=pages)
    assert {(r["idx"], r["used"], r["correct"]) for r in out.pred.collect()} == {(0, True, False), (1, True, True)}
    assert [(r["pred_idx"], r["correct"], r["strict"]) for r in out.gt.collect()] == [(1, True, False)]
    assert E.totals(out).first()["extra"] == 0 and E.label_confusion(out).collect() == []
    assert [(r["pred_idx"], r["kind"]) for r in M.overlay(chart, said, pages).collect()] == [(1, "flowchart")]
    assert [(r["pred_idx"], r["kind"]) for r in M.overlay(chart, said).collect()] == [(0, "geometry")]


def test_empty_sides(spark):
    none = blocks(spark, [])
    assert M.greedy_matches(none, none).collect() == [] and M.equivalent_regions(none, none).collect() == []
    r = E.totals(E.evaluate(none, blocks(spark, [b("text", [0, 0, 1, 1])]))).first()
    assert (r["total_gt"], r["extra"], r["recall"], r["f1"]) == (0, 1, 0.0, 0.0)
