"""The page-wise evaluator against the operators on joins, batches that end inside pages, and how often it reads its input."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from leafgrid.operators import matching as M
from leafgrid.operators import metrics as E
from leafgrid.operators import outcomes as O

SCHEMA = "doc long, page_id int, idx int, label string, level string, x1 double, y1 double, x2 double, y2 double, text string"


def _random_blocks(spark, seed):
    rng, rows = random.Random(seed), []
    for doc in range(12):
        for idx in range(36):
            x, y = rng.randrange(60), rng.randrange(60)
            label = rng.choice(["text", "table", "footer", "header", "image"])
            rows.append((doc, idx // 12, idx, label, rng.choice(["H1", "none"]), float(x), float(y), float(x + rng.randrange(1, 40)), float(y + rng.randrange(1, 40)), rng.choice(["ab", "ａｂ", "cde", "", None])))
    return spark.createDataFrame(rows, SCHEMA)


def test_evaluator_equals_the_operators(spark):
    gt, pred = _random_blocks(spark, 1), _random_blocks(spark, 2).where("doc <> 3")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        rows = E.evaluate(gt, pred, 0.2).rows.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == gt.count() + pred.count()
    solid = lambda b: b.where(~F.col("label").isin("footer", "header"))
    want = {(r["doc"], r["gt_idx"], r["pred_idx"]) for t in (M.greedy_matches(solid(gt), solid(pred), 0.2), M.label_pairs(gt, pred)) for r in t.collect()}
    assert {(r["doc"], r["idx"], r["pred_idx"]) for r in rows if r["side"] == O.GT and r["used"]} == want
    label = {(s, r["doc"], r["idx"]): r["label"] for s, t in (("g", gt), ("p", pred)) for r in t.collect()}
    right = {("g" if s == "g" else "p", r["doc"], r["idx"]) for s in "gp" for r in M.equivalent_regions(gt, pred).where(F.col("side") == s).collect()}
    for d, g, p in want:
        if label["g", d, g] == label["p", d, p]:
            right |= {("g", d, g), ("p", d, p)}
    right |= {k for k, v in label.items() if v == "footer"}
    assert {("g" if r["side"] == O.GT else "p", r["doc"], r["idx"]) for r in rows if r["correct"]} == right


def test_each_side_is_read_once(spark, tmp_path):
    for name, seed in (("g", 1), ("p", 2)):
        _random_blocks(spark, seed).write.parquet(f"{tmp_path}/{name}")
    rows = E.evaluate(*(spark.read.parquet(f"{tmp_path}/{n}") for n in "gp")).rows
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2


def test_pages_stay_whole():
    t = pa.table({"doc": [1, 1, 1, 2, 2, 2, 3], "page_id": [0, 0, 1, 1, 1, 1, 1]})
    for size in range(1, 8):
        cut = [x.to_pydict() for x in O.whole_pages(iter(t.to_batches(max_chunksize=size)))]
        keys = [set(zip(x["doc"], x["page_id"])) for x in cut]
        assert sum(len(x["doc"]) for x in cut) == 7 and sum(map(len, keys)) == 4
