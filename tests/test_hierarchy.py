"""The reference cases of headings, and order-dependent or texts-only operators against plain Python."""

import json
import unicodedata

from pyspark.sql import functions as F

from leafgrid.functions import geometry as G
from leafgrid.functions import jsonx as J
from leafgrid.functions import text as T
from leafgrid.operators import blocks as B
from leafgrid.operators import export as X
from leafgrid.operators import hierarchy as H
from leafgrid.operators import metrics as E
from leafgrid.sources import readers as R
from leafgrid.sources import views as V

SCHEMA = "doc long, page_id int, ord int, block_type string, level string, x1 int, y1 int, text string"


def titles(spark, rows, pages=None, lefts=None):
    n = range(len(rows))
    return spark.createDataFrame([(1, pages[i] if pages else 0, i + 1, "paragraph_title", rows[i][0], lefts[i] if lefts else 10, i * 20, rows[i][1]) for i in n], SCHEMA)


def column(frame, name):
    return [r[name] for r in frame.orderBy("ord").collect()]


def test_clamp_cases(spark):
    one = lambda *levels: column(H.clamp_levels(titles(spark, [(x, "t") for x in levels])), "repaired")
    assert one("H1", "H3") == ["H1", "H2"] and one("H1", "H2", "H3", "H1", "H3") == ["H1", "H2", "H3", "H1", "H2"]
    assert one("H4", None, "H4", "H4") == ["H1", None, "H2", "H3"]


def test_document_pass_raises_only(spark):
    rows = [("H1", "第三章 项目实施"), ("H2", "3.1 总体"), ("H4", "3.1.1 甲"), ("H2", "3.1.2 乙"), ("H3", "3.1.2.1 丙")]
    out = H.reconcile_document(titles(spark, rows, lefts=[40, 70, 100, 100, 130])).orderBy("ord").collect()
    assert [r["new_level"] for r in out] == ["H1", "H2", "H4", "H3", "H4"]
    assert sum(r["old_level"] != r["new_level"] for r in out) == 2


def test_local_numbering_cases(spark):
    rows = [("H1", "第一章 总则"), ("H2", "一、范围"), ("H3", "（一）甲"), ("H2", "（二）乙"), ("H3", "（三）丙"), ("H3", "（四）丁")]
    out = H.reconcile_locally(titles(spark, rows)).collect()
    assert [(r["ord"], r["old_level"], r["new_level"]) for r in out] == [(4, "H2", "H3")]
    rows = [("H1", "第一节 甲"), ("H2", "1、a"), ("H1", "第二节 乙"), ("H3", "1、b"), ("H3", "2、c"), ("H3", "3、d")]
    assert H.reconcile_locally(titles(spark, rows)).collect() == []


def test_financial_chain_case(spark):
    rows = [("H1", "第二节 会计"), ("H1", "2、政策"), ("H2", "（一）甲"), ("H3", "1、乙")]
    assert column(H.financial_chain(titles(spark, rows)), "fixed") == ["H1", "H2", "H3", "H4"]


def outline(rows, page, following):
    """The outline of a page in plain Python; rows are (page, level, text) in order."""
    o, repaired, last = H.OUTLINE, [], 0
    for p, level, text in rows:
        last = min(int(level[1]), last + 1)
        repaired.append((p, last, text, level))
    past = [x for x in repaired if x[0] < page]
    path = {}
    for _, rank, text, _ in past:
        path = {k: v for k, v in path.items() if k < rank} | {rank: text}
    depth = min(max(path, default=0) + 1, 4)
    names = ["H1", "H2", "H3", "H4"]
    seen = [n for n in names if any(x[1] == int(n[1]) for x in past)]
    lines = [o["header"], o["path"], *([f"{'  ' * k}H{k}: {v}" for k, v in sorted(path.items())] or ["  无"]), o["recent"], *([f"  H{x[1]} {x[2]}" for x in past[-12:]] or ["  无"]),
             o["appeared"], "  " + (", ".join(seen) or "无"), o["allowed"], "  " + ", ".join(names[:depth]), o["forbidden"], "  " + (", ".join(names[depth:]) or "无")]
    if following:
        after = [x for x in repaired if x[0] > page][:12]
        lines += ["", o["following_header"], o["following"], *([f"  page {x[0] + 1}: {x[3]} {x[2]}" for x in after] or ["  无"])]
    return "\n".join(lines)


def test_outlines_equal_plain_python(spark):
    rows = [(i // 6, f"H{(i * 7) % 4 + 1}", f"title {i}") for i in range(30)]
    frame = titles(spark, [(x[1], x[2]) for x in rows], pages=[x[0] for x in rows])
    for following in (None, 12):
        got = {r["page_id"]: r["outline"] for r in H.page_outlines(frame, following=following).collect()}
        assert got == {p: outline(rows, p, following) for p in range(5)}


def test_answers_and_training_lines(spark):
    h = titles(spark, [("H1", "修正标题"), ("H2", "next")], pages=[0, 1])
    b = F.struct(F.lit("b").alias("id"), "text", F.array(*map(F.lit, (10, 20, 50, 100))).alias("bbox"), "page_id", F.col("block_type").alias("label"), "block_type", F.lit("").alias("description"), "level")
    box = B.export_box(F.struct(F.lit(None).cast("array<int>").alias("bbox_1000"), F.array(*map(F.lit, (10, 20, 50, 100))).alias("bbox")), F.lit(100), F.lit(200), F.lit(1000), F.lit(2000), F.array(*map(F.lit, (0, 0, 1000, 2000))), F.lit(True))
    pages = X.page_answers(h.select("doc", "page_id", "ord", B.export_block(b, box).alias("b"))).withColumns({"width": F.lit(100), "height": F.lit(200), "image": F.lit("pages/p.png")})
    old = pages.select("doc", "page_id", "image", F.lit("").alias("system"), F.lit("old").alias("user"), F.lit("old").alias("assistant"))
    fresh = X.refreshed_answers(old, pages, H.page_outlines(h))
    rows = {r["page_id"]: r for r in fresh.collect()}
    assert json.loads(rows[0]["assistant"])["blocks"][0]["bbox"] == [100, 100, 500, 500]
    assert "H1: 修正标题" in rows[1]["user"] and rows[0]["user"].startswith("当前页面 page_id=0")
    swift = X.samples(fresh, "swift").collect()
    assert len(swift) == 2 and all(r["messages"][1]["content"].startswith("<image>\n当前页面") for r in swift)
    line = X.training_lines(pages, H.page_outlines(h)).where("page_id = 1").first()
    assert "H1: 修正标题" in line["input"]["user"] and line["output"]["blocks"][0]["text"] == "next"


def test_coordinates_and_json_cases(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    ints = lambda *v: F.array(*map(F.lit, v))
    block = lambda box, grid=None: F.struct((ints(*grid) if grid else F.lit(None).cast("array<int>")).alias("bbox_1000"), ints(*box).alias("bbox"))
    export = lambda blk, size, model, content, on: one(B.export_box(blk, F.lit(size[0]), F.lit(size[1]), F.lit(model[0]), F.lit(model[1]), ints(*content), F.lit(on)))
    assert export(block((10, 20, 50, 100)), (100, 200), (1000, 2000), (0, 0, 1000, 2000), True) == [100, 100, 500, 500]
    assert export(block((0, 0, 100, 100)), (100, 100), (200, 300), (0, 50, 200, 250), True) == [0, 167, 1000, 833]
    assert export(block((0, 0, 100, 100)), (100, 100), (200, 300), (0, 50, 200, 250), False) == [0, 0, 1000, 1000]
    assert export(block((0, 0, 100, 100), (101, 102, 501, 502)), (100, 100), (200, 300), (0, 50, 200, 250), True) == [101, 102, 501, 502]
    square = G.Box(*map(F.lit, (0.0, 0.0, 2.0, 2.0)))
    assert one(G.union_area(F.array(square.struct(), G.Box(*map(F.lit, (1.0, 1.0, 3.0, 3.0))).struct()))) == 7.0
    assert one(J.model_object(F.lit('first {"a": 1} then {"b": {"c": "}"}} end'))) == '{"b": {"c": "}"}}'
    assert one(J.model_object(F.lit("```json\n{\"a\": 1}\n```\n```json\n{\"b\": 2}\n```"))) == '{"b": 2}'
    assert one(J.model_object(F.lit("<think>{\"x\": 1}</think>\n{\"y\": \"a\nb\"}"))) == '{"y": "a\nb"}'
    assert one(J.model_object(F.lit("no json"))) is None and one(J.model_object(F.lit("[1, 2]"))) is None


def test_folding_equals_python(spark):
    texts = ["Ａｂ１ ﬁ", "①第", None, "", "İ ß", "x-y_z"]
    got = [r["v"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.fold_text("t").alias("v")).collect()]
    assert got == ["".join(c for c in unicodedata.normalize("NFKC", t or "").lower() if c.isalnum()) for t in texts]


def test_report_holds_all_parts(spark):
    d = "/root/testdata/sf0.001"
    gt, pred = V.gt_blocks(spark, d).where("doc < 2"), V.pred_blocks(spark, d).where("doc < 2")
    outcomes = E.evaluate(gt, pred)
    report = json.loads(E.report_json(outcomes).first()["report"])
    assert report["totals"]["total_gt"] == gt.count() and len(report["job_rows"]) == 2
    assert {r["label"]: r["support"] for r in report["per_label"]} == {r["label"]: r["count"] for r in gt.groupBy("label").count().collect()}


def test_readers_find_versions_failures_and_blocks(spark, tmp_path):
    def put(path, value):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")

    page = lambda level: {"pages": [{"page_id": 0, "blocks": [{"label": "paragraph_title", "level": level, "bbox": [0, 0, 9, 9]}, {"bbox": [1, 1, 1, 5]}]}]}
    put("truth/a/annotation_v2_20260608_100000.json", page("H1"))
    put("truth/a/annotation_v2_20260608_110000.json", page("H3"))
    put("model/m/a/result.json", page("H2") | {"filename": "up/a.pdf", "errors": ["第 2 页分析失败: timeout", "x"]})
    put("model/m/a/other.json", page("H4"))
    truth = R.check_unique(R.keyed(R.latest_versions(R.read_jobs(spark, str(tmp_path / "truth/*/*.json")))))
    model = R.keyed(R.preferred_results(R.read_jobs(spark, str(tmp_path / "model/*/*/*.json"))))
    assert [(r["doc"], r["level"]) for r in R.blocks_of(truth).collect()] == [("a", "H3")]
    assert [(r["doc"], r["level"], r["id"]) for r in R.blocks_of(model).collect()] == [("a", "H2", "p000_b000")]
    assert [tuple(r) for r in R.failed_pages(model).collect()] == [("a", 1)]
    assert R.with_job_defaults(model).first()["config"]["model"] == "未知"
    (tmp_path / "q.jsonl").write_text('{"page_id": 1}\n\n[1]\n{"page_id": 2}\n')
    lines = R.read_lines(spark, str(tmp_path / "q.jsonl"), "page_id int")
    assert sorted(r["page_id"] for r in lines.collect()) == [1, 2]
    R.write_lines(lines.withColumn("x", F.lit(None).cast("string")), str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"page_id":1,"x":null}', '{"page_id":2,"x":null}']
