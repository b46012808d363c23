"""Every registered query of the layout engine runs on the smallest tables and, where it has SQL, equals DuckDB's result."""

import os

import pytest

import __spark_entry__ as entry
from leafgrid.plans import catalog

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The heaviest queries are left to the oracle comparison on larger tables.
NAMES = sorted(set(catalog.REGISTRY.queries) - {"k15_report_json"})


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        connection.sql(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return connection


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "NULL"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    frame = catalog.REGISTRY.queries[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    if name not in catalog.REGISTRY.oracles:
        assert got
        return
    cursor = duck.execute(catalog.REGISTRY.oracles[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_box_metrics_cover_all_pairs_of_a_page(spark):
    from leafgrid.sources import views

    counts = [f(spark, DATA).groupBy("doc", "page_id").count() for f in (views.gt_blocks, views.pred_blocks)]
    want = sum(r["a"] * r["b"] for r in counts[0].withColumnRenamed("count", "a").join(counts[1].withColumnRenamed("count", "b"), ["doc", "page_id"]).collect())
    assert entry.queries()["f15_f16_box_metrics_all"](spark, DATA).count() == want
