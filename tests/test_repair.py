"""Repairs, stores, configuration and recursive JSON checks on small cases."""

import json
import random

from pyspark.sql import functions as F

from leafgrid.functions import config
from leafgrid.operators import catalog, containment, export, hierarchy, shapes


def test_env_lines(spark):
    lines = ["A=1", " B = 'x y' ", '# C=1', "", "no", "1D=2", 'E="a\\nb\\"c"', "F='it\"s'", "A=2", "G=", "H=a=b"]
    frame = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "f int, n int, line string")
    got = {r["key"]: r["value"] for r in config.env_values(frame, ["f"], "n").collect()}
    assert got == {"A": "2", "B": "x y", "E": 'a\nb"c', "F": 'it"s', "G": "", "H": "a=b"}
    written = spark.createDataFrame([(v,) for v in ("", "a/b.c", 'q" \\', "x\ny")], "v string").select(config.env_text(F.col("v")).alias("w"))
    assert [r["w"] for r in written.collect()] == ["", "a/b.c", '"q\\" \\\\"', '"x\\ny"']


def brute_leaves(value, path=()):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from brute_leaves(v, (*path, k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from brute_leaves(v, (*path, str(i)))
    else:
        yield ".".join(path), value


def brute_shape(value, template, path="gold_answer"):
    if isinstance(template, dict):
        if not isinstance(value, dict):
            return [("schema_type", path)]
        out = [("schema_missing", f"{path}.{k}") for k in set(template) - set(value)] + [("schema_extra", f"{path}.{k}") for k in set(value) - set(template)]
        return out + [x for k in template.keys() & value.keys() for x in brute_shape(value[k], template[k], f"{path}.{k}")]
    if isinstance(template, list):
        if not isinstance(value, list):
            return [("schema_type", path)]
        if not template:
            return [("schema_type", f"{path}[{i}]") for i, x in enumerate(value) if not isinstance(x, str)]
        return [x for i, v in enumerate(value) for x in brute_shape(v, template[0], f"{path}[{i}]")]
    return [] if value is None or isinstance(value, str) else [("schema_type", path)]


def random_json(rng, depth):
    kind = rng.randrange(6 if depth else 4)
    if kind == 4:
        return {k: random_json(rng, depth - 1) for k in rng.sample("abcd", rng.randrange(4))}
    if kind == 5:
        return [random_json(rng, depth - 1) for _ in range(rng.randrange(3))]
    return [None, "s{}", rng.randrange(9), True][kind]


def test_recursive_json_equals_brute_force(spark):
    rng = random.Random(5)
    template = {"a": None, "b": [], "c": [{"a": None, "b": {"d": None}}], "d": {"a": None}}
    values = [{k: random_json(rng, 4) for k in rng.sample("abcde", rng.randrange(1, 5))} for _ in range(150)] + [{}, [], "x", None, {"c": [{"a": "x", "b": {"d": 1}}]}]
    frame = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(999, None)], "i int, raw string")
    text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    want = sorted((i, p, text(v)) for i, x in enumerate(values) for p, v in brute_leaves(x))
    assert sorted(map(tuple, shapes.leaves(frame, "i", "raw").collect()), key=str) == sorted(want, key=str)
    got = {(r["i"], r["code"], r["path"]) for r in shapes.shape_problems(frame, "i", "raw", template).collect()}
    assert got == {(i, *x) for i, v in enumerate(values) for x in brute_shape(v, template)} | {(999, "schema_type", "gold_answer")}


def test_box_store_keeps_versions_and_drafts(spark):
    stored = spark.createDataFrame([("d", 1, "annotation", "a0"), ("d", 2, "draft", "x"), ("d", 3, "annotation", "c0")], "dataset_id string, image_id int, kind string, boxes string")
    saves = spark.createDataFrame([("d", 1, 1, "draft", "a1"), ("d", 1, 2, "submit", "a2"), ("d", 3, 3, "delete", None), ("d", 4, 4, "draft", "n")], "dataset_id string, image_id int, n int, mode string, boxes string")
    assert sorted((r["image_id"], r["kind"], r["boxes"]) for r in catalog.saved_boxes(stored, saves).collect()) == [(1, "annotation", "a2"), (1, "version", "a0"), (2, "draft", "x"), (4, "draft", "n")]


def test_category_without_samples_fails(spark):
    import pytest

    files = spark.createDataFrame([("a", "f", 2, 0, 0)], "category string, file string, pages int, samples int, blocks int")
    with pytest.raises(Exception, match="no usable samples"):
        export.category_manifests(files).collect()


def test_outlines_of_a_long_document_are_linear(spark):
    """A document of 200 pages: a title row holds at most twelve earlier titles, and a page a single state."""
    rows = [(1, p, p * 3 + k, "paragraph_title", f"H{k % 4 + 1}", 0, 0, f"t{p}.{k}") for p in range(200) for k in range(3)]
    h = spark.createDataFrame(rows, "doc long, page_id int, ord int, block_type string, level string, x1 int, y1 int, text string")
    out = {r["page_id"]: r["outline"] for r in hierarchy.page_outlines(h, following=12).collect()}
    assert len(out) == 200 and max(len(x) for x in out.values()) < 2500
    assert "t149.2" in out[150] and "t150.0" not in out[150] and "page 152: H1 t151.0" in out[150]
    assert hierarchy.visible_bounds(h.select("doc", "page_id").distinct(), "staggered", 4).count() == 200


def test_passages_by_anchor_and_short_ones_in_blocks(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "the quick brown fox jumps over"), (2, "nothing here"), (3, None), (1, "again nothing here")], "doc_id long, text string")
    passages = spark.createDataFrame([("a", "quick brown fox jumps over"), ("b", "nothing here"), ("c", "brown fox jumped over the"), ("d", None), ("e", "ick")], "item_id string, passage string")
    monkeypatch.setattr(containment, "BROADCAST_BYTES", 8)
    out = containment.contained(texts, passages, broadcast_bytes=0)
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (1, "b"), (1, "e"), (2, "b")]
