"""Printed reports, bulk deletions and replaced blocks on literal cases."""

from leafgrid.operators import catalog as C
from leafgrid.operators import metrics as E
from tests.test_matching import b, blocks


def test_report_lines(spark):
    full = [0, 0, 100, 100]
    gt = blocks(spark, [b("text", full), b("paragraph_title", [200, 0, 300, 50], "", "H2"), b("table", [400, 0, 500, 50])])
    pred = blocks(spark, [b("text", full), b("paragraph_title", [200, 0, 300, 50], "", "H3"), b("image", [600, 0, 700, 50])])
    lines = {(r["section"], r["pos"]): r["line"] for r in E.report_lines(E.evaluate(gt, pred)).collect()}
    assert lines[1, 0] == f"  {'1':<24}{3:>7}{3:>7}{2:>7}{2:>10}{2 / 3:>12.1%}{1:>7}{1:>7}"
    labels = [("image", 0, 0, 0.0, 0.0, 0.0), ("paragraph_title", 1, 1, 1.0, 1.0, 1.0), ("table", 1, 0, 0.0, 0.0, 0.0), ("text", 1, 1, 1.0, 1.0, 1.0)]
    for k, (label, support, correct, recall, precision, f1) in enumerate(labels):
        assert lines[2, k + 1] == f"  {label:<20}{support:>9}{correct:>9}{recall:>9.1%}{precision:>11.1%}{f1:>8.3f}"
    assert [lines[4, k][:6] for k in (1, 2)] == ["  H2  ", "  H3  "] and (4, 3) not in lines
    assert lines[5, 1] == "  GT=3, 预测=3, 几何匹配=2, 区域等价正确 GT/预测=2/2" and lines[5, 5] == "  漏检=1, 误检=1"
    assert lines[5, 2] == "  Precision=66.67%, Recall=66.67%, F1=66.67%" and lines[5, 3] == "  100.00%"
    assert {lines[6, 1], lines[6, 2]} == {f"  {'__extra__':<20} -> {'image':<20} 1", f"  {'table':<20} -> {'__missing__':<20} 1"}
    assert lines[7, 1] == f"  {'H2':<10} -> {'H3':<16} 1"


def test_deletions_have_an_error_each(spark):
    jobs = spark.createDataFrame([("j1", "d1", "a.pdf"), ("j2", "d2", "b.pdf"), ("j3", None, None)], "job_id string, dataset_id string, filename string")
    ids = spark.createDataFrame([(0, "d1"), (1, "j1"), (2, "nowhere"), (3, "  "), (4, None), (5, "b.pdf"), (6, "nowhere")], "pos int, wanted string")
    kept, report = C.deleted(jobs, ids)
    assert [r["job_id"] for r in kept.collect()] == ["j3"]
    error = "FileNotFoundError: dataset not found: "
    assert {(r["pos"], r["job_id"], r["error"]) for r in report.collect()} == {
        (0, "j1", None), (1, "j1", error + "j1"), (2, None, error + "nowhere"), (5, "j2", None), (6, None, error + "nowhere")}
    assert C.deleted(jobs, ids.limit(0))[0].count() == 3


def test_corrections_replace_pages(spark):
    from leafgrid.sources.readers import BLOCK

    def block(i, label, level=None):
        return {"id": i, "label": label, "text": f"t{i}", "level": level, "description": "seen"}

    page = f"doc string, page_id int, blocks array<{BLOCK}>"
    fixes = spark.createDataFrame([("d", 1, [block("a", "chart"), block("b", "no such label")], 0), ("d", 1, [block("c", "paragraph_title", "H2")], 1), ("d", 9, [block("x", "text")], 0), ("e", 0, [], 0)], page + ", pos int")
    own = spark.createDataFrame([("d", 0, [block("o", "text")]), ("d", 1, [block("p", "text")]), ("e", 0, [block("q", "text")]), ("f", 0, [])], page)
    from pyspark.sql import functions as F

    from leafgrid.operators.blocks import job_block

    replaced, listed = C.with_replaced_blocks(own.withColumn("blocks", F.transform("blocks", job_block)), fixes)
    got = {(r["doc"], r["page_id"]): ([(x["id"], x["block_type"], x["level"], x["description"]) for x in r["blocks"]], r["replaced"]) for r in replaced.collect()}
    assert got[("d", 1)] == ([("c", "paragraph_title", "H2", "")], True) and got[("e", 0)] == ([], True) and got[("d", 0)][1] is False and len(got) == 4
    assert {r["doc"]: [x["id"] for x in r["blocks"]] for r in listed.collect()} == {"d": ["c"], "e": [], "f": []}
