"""Queries on tables that have grown: results that small tables can't tell apart."""

import duckdb

from leafgrid.plans import catalog, files

SMALL = "/root/testdata/sf0.001"


def _rows(frame):
    return sorted(map(str, (tuple(r) for r in frame.collect())))


def _wanted(name, frame, **tables):
    c = duckdb.connect()
    for table, path in tables.items():
        c.execute(f"create view {table} as select * from '{path}'")
    cursor = c.execute(catalog.REGISTRY.oracles[name])
    at = [[x[0] for x in cursor.description].index(n) for n in frame.columns]
    return sorted(str(tuple(r[i] for i in at)) for r in cursor.fetchall())


def test_migrated_prompts_beyond_100000_parts(spark, tmp_path):
    part = f"{tmp_path}/part.parquet"
    duckdb.execute(f"copy (select * replace (cast(p_partkey + r as bigint) as p_partkey) from '{SMALL}/part.parquet', (values (0), (100000)) q(r)) to '{part}'")
    got = catalog.REGISTRY.queries["r22_migrated_prompts"](spark, str(tmp_path))
    assert _rows(got) == _wanted("r22_migrated_prompts", got, part=part)


def test_a_long_document_lies_in_parts(spark, monkeypatch):
    monkeypatch.setattr(files, "PART", 4)
    got = catalog.REGISTRY.queries["s4_evaluator_scan"](spark, SMALL)
    folders = {f.rsplit("/", 2)[1] for f in got.inputFiles()}
    assert len(folders) > 1 and all(f.startswith("part=") for f in folders)
    assert _rows(got) == _wanted("s4_evaluator_scan", got, lineitem=f"{SMALL}/lineitem.parquet")


def test_document_pass_needs_no_group_per_document(spark):
    frame = catalog.REGISTRY.queries["w6_reconcile_document"](spark, SMALL)
    whole = _rows(frame)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert _rows(catalog.REGISTRY.queries["w6_reconcile_document"](spark, SMALL)) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in frame._jdf.queryExecution().toString()


def test_outlines_need_one_shuffle_and_sort_no_lists_by_title(spark):
    """Every page's text comes from one shuffle of the headings: no second scan for the pages, no join of lists."""
    frame = catalog.REGISTRY.queries["w3_page_outlines"](spark, SMALL)
    plan = frame._jdf.queryExecution().sparkPlan().toString() + frame._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert _rows(frame) == _wanted("w3_page_outlines", frame, lineitem=f"{SMALL}/lineitem.parquet")


def test_outlines_keep_rows_without_page_or_titles(spark):
    rows = [(1, None, 1, "paragraph_title", "H1", "a"), (1, 0, 2, "text", None, "b"), (1, 1, 3, "paragraph_title", "H2", "c"), (1, 2, 4, "text", "H1", "d"), (None, 0, 1, "paragraph_title", "H1", "e"), (None, 1, 2, "text", None, "f")]
    from leafgrid.operators import hierarchy

    got = hierarchy.page_outlines(spark.createDataFrame(rows, "doc long, page_id int, ord int, block_type string, level string, text string"), following=12)
    seen = {(r["doc"], r["page_id"]): r["outline"] for r in got.collect()}
    assert sorted(seen, key=str) == sorted({(r[0], r[1]) for r in rows}, key=str)
    assert "H2 c" in seen[1, 2] and "H1 a" not in seen[1, 1] and "page 2: H2 c" in seen[1, 0] and "H1 e" not in seen[None, 1]


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_shape_checks_open_each_object_once(spark):
    frame = catalog.REGISTRY.queries["f28_recursive_shape"](spark, SMALL)
    assert "json_object_keys" not in _plan(frame)
    assert _rows(frame) == _wanted("f28_recursive_shape", frame, events=f"{SMALL}/events.parquet")


def test_plain_answers_are_parsed_without_the_fold(spark):
    frame = catalog.REGISTRY.queries["r12_annotation_samples"](spark, SMALL)
    assert _plan(frame).count("filter(array(") < 8  # 12 where all candidates, the fold over tokens among them, were made for each answer
    assert _rows(frame) == _wanted("r12_annotation_samples", frame, lineitem=f"{SMALL}/lineitem.parquet")


def test_replaced_blocks_read_each_side_once_a_result(spark):
    frame = catalog.REGISTRY.queries["j11_r10_job_blocks"](spark, SMALL)
    assert _plan(frame).count("parquet") == 4
    assert _rows(frame) == _wanted("j11_r10_job_blocks", frame, lineitem=f"{SMALL}/lineitem.parquet")


def test_heading_texts_are_not_shuffled(spark):
    frame = catalog.REGISTRY.queries["j10_r9_refreshed_answers"](spark, SMALL)
    assert "rid" not in _plan(frame)
    assert _rows(frame) == _wanted("j10_r9_refreshed_answers", frame, lineitem=f"{SMALL}/lineitem.parquet")


def test_a_bucket_may_be_several_tasks_work(spark, tmp_path):
    from leafgrid.sources.versions import VersionedTable

    table = VersionedTable(spark, f"file://{tmp_path}/t", "k long, v string", ["k"], 2)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        table.upsert(spark.range(20_000).selectExpr("id as k", "sha2(cast(id as string), 256) as v"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    rows = table.read()
    assert rows.count() == 20_000 and rows.select("k").distinct().count() == 20_000 and len(rows.inputFiles()) > 4


def test_pages_in_order_leave_the_map_state_alone():
    import pandas as pd

    from leafgrid.streaming import incremental

    class Value:
        def __init__(self):
            self.v = None

        exists, get = lambda self: self.v is not None, lambda self: self.v

        def update(self, v):
            self.v = v

    class Held(dict):
        wrote = 0
        containsKey, getValue, removeKey = dict.__contains__, dict.__getitem__, dict.__delitem__

        def updateValue(self, k, v):
            self.wrote += 1
            self[k] = v

    one = incremental._InPageOrder(None)
    one.at, one.held = Value(), Held()
    page = lambda *numbers: pd.DataFrame([(n, [n], ["paragraph_title"], ["H3"]) for n in numbers], columns=["page_no", "ords", "kinds", "levels"])
    out = lambda *numbers: [tuple(r) for part in one.handleInputRows((1,), iter([page(*numbers)]), None) for r in part.itertuples(index=False)]
    assert out(1, 0) == [(1, 0, "H1", False), (1, 1, "H2", False)] and one.held.wrote == 0
    assert out(4, 3) == [] and one.held.wrote == 2
    assert out(2, 3) == [(1, 2, "H3", False), (1, 3, "H3", False), (1, 4, "H3", False)] and not one.held
