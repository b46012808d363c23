"""Layout-shaped views derived from the driver's tables, with the same derivation as DuckDB SQL.

The driver ships no layout data, so documents, pages, boxes and headings are computed from ``lineitem`` with integer
arithmetic: forty order keys make a document, eight a page. Everything is keyed by document, so the only
shuffle is the one that numbers a document's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ALL = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)
_ALL_SQL = ", ".join(_ALL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with document and page."""
    li = table(spark, sf_dir, "lineitem")
    doc = F.floor(F.col("l_orderkey") / 40).cast("long")
    return li.withColumn("doc", doc).withColumn("page_id", (F.floor(F.col("l_orderkey") / 8) % 5).cast("int"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with document, page and position in the document (rid)."""
    return _placed(spark, sf_dir).withColumn("rid", F.row_number().over(Window.partitionBy("doc").orderBy(*_ALL)))


LI_SQL = f"""
  SELECT *, l_orderkey // 40 AS doc, CAST((l_orderkey // 8) % 5 AS INTEGER) AS page_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey // 40 ORDER BY {_ALL_SQL}) AS INTEGER) AS rid
  FROM lineitem"""


def _label() -> F.Column:
    n = F.col("l_linenumber")
    return (
        F.when(n == 1, "paragraph_title").when(n == 7, "footer").when(n == 6, "header")
        .when(F.col("l_returnflag") == "R", "table").when(F.col("l_linestatus") == "F", "text").otherwise("image")
    )


_LABEL_SQL = """CASE WHEN l_linenumber = 1 THEN 'paragraph_title' WHEN l_linenumber = 7 THEN 'footer' WHEN l_linenumber = 6 THEN 'header'
         WHEN l_returnflag = 'R' THEN 'table' WHEN l_linestatus = 'F' THEN 'text' ELSE 'image' END"""


def _corner() -> tuple:
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    x1, y1 = (p * 37 + n * 211) % 900, (s * 53 + p * 17) % 900
    return x1, y1, x1 + 20 + (p * 13) % 180, y1 + 20 + (p * 7) % 180


_X1, _Y1 = "(l_partkey * 37 + l_linenumber * 211) % 900", "(l_suppkey * 53 + l_partkey * 17) % 900"
_X2, _Y2 = f"{_X1} + 20 + (l_partkey * 13) % 180", f"{_Y1} + 20 + (l_partkey * 7) % 180"


def gt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground-truth blocks: doc, page_id, idx, label, level, x1, y1, x2, y2, text."""
    x1, y1, x2, y2 = _corner()
    level = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("H"), (F.col("l_partkey") % 4 + 1).cast("string"))).otherwise("none")
    return items(spark, sf_dir).where(F.col("l_orderkey") % 19 != 0).select(
        "doc", "page_id", F.col("rid").alias("idx"), _label().alias("label"), level.alias("level"),
        *[c.cast("double").alias(n) for c, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))],
        F.concat(F.lit("Part "), (F.col("l_partkey") % 97).cast("string"), F.lit(" of "), F.col("l_suppkey").cast("string")).alias("text"),
    )


GT_SQL = f"""
  SELECT doc, page_id, rid AS idx, {_LABEL_SQL} AS label,
         CASE WHEN l_linenumber = 1 THEN 'H' || CAST(l_partkey % 4 + 1 AS VARCHAR) ELSE 'none' END AS level,
         CAST({_X1} AS DOUBLE) AS x1, CAST({_Y1} AS DOUBLE) AS y1, CAST({_X2} AS DOUBLE) AS x2, CAST({_Y2} AS DOUBLE) AS y2,
         'Part ' || CAST(l_partkey % 97 AS VARCHAR) || ' of ' || CAST(l_suppkey AS VARCHAR) AS text
  FROM li WHERE l_orderkey % 19 <> 0"""


def pred_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted blocks: the same boxes shifted, with some labels, levels and texts wrong and some rows missing."""
    x1, y1, x2, y2 = _corner()
    p = F.col("l_partkey")
    level = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("H"), ((p + (p % 9 == 0).cast("int")) % 4 + 1).cast("string"))).otherwise("none")
    return items(spark, sf_dir).where(F.col("l_orderkey") % 17 != 0).select(
        "doc", "page_id", F.col("rid").alias("idx"), F.when(p % 10 == 0, "text").otherwise(_label()).alias("label"), level.alias("level"),
        (x1 + p % 23 - 11).cast("double").alias("x1"), (y1 + p % 17 - 8).cast("double").alias("y1"),
        (x2 + p % 13 - 6).cast("double").alias("x2"), (y2 + p % 11 - 5).cast("double").alias("y2"),
        F.concat(F.lit("Part "), (p % 97).cast("string"), F.when(p % 6 == 0, "").otherwise(F.concat(F.lit(" of "), F.col("l_suppkey").cast("string")))).alias("text"),
    )


PRED_SQL = f"""
  SELECT doc, page_id, rid AS idx, CASE WHEN l_partkey % 10 = 0 THEN 'text' ELSE {_LABEL_SQL} END AS label,
         CASE WHEN l_linenumber = 1 THEN 'H' || CAST((l_partkey + CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE 0 END) % 4 + 1 AS VARCHAR) ELSE 'none' END AS level,
         CAST({_X1} + l_partkey % 23 - 11 AS DOUBLE) AS x1, CAST({_Y1} + l_partkey % 17 - 8 AS DOUBLE) AS y1,
         CAST({_X2} + l_partkey % 13 - 6 AS DOUBLE) AS x2, CAST({_Y2} + l_partkey % 11 - 5 AS DOUBLE) AS y2,
         'Part ' || CAST(l_partkey % 97 AS VARCHAR) || CASE WHEN l_partkey % 6 = 0 THEN '' ELSE ' of ' || CAST(l_suppkey AS VARCHAR) END AS text
  FROM li WHERE l_orderkey % 17 <> 0"""


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading rows in reading order: doc, page_id, ord, block_type, level, x1, text."""
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    order = Window.partitionBy("doc").orderBy("page_id", "y1", "x1", *_ALL)  # rid numbers the order of _ALL, so that rid itself need not be found
    x1, y1, _, _ = _corner()
    ok, cn = F.col("l_orderkey") % 40, F.array(*map(F.lit, ("一", "二", "三", "四", "五")))
    text = (
        F.when(n == 1, F.concat(F.lit("第"), F.element_at(cn, (p % 5 + 1).cast("int")), F.lit("章 总则")))
        .when(n == 2, F.concat((ok + 1).cast("string"), F.lit("."), (p % 4 + 1).cast("string"), F.lit(" Scope")))
        .when(n == 3, F.concat((ok + 1).cast("string"), F.lit("."), (p % 4 + 1).cast("string"), F.lit("."), (p % 3 + 1).cast("string"), F.lit("  Terms")))
        .when(n == 4, F.concat(F.lit("（"), F.element_at(cn, (p % 5 + 1).cast("int")), F.lit("）范围")))
        .when(n == 5, F.concat((p % 9 + 1).cast("string"), F.lit("、Item")))
        .otherwise(F.concat(F.lit("Plain heading "), p.cast("string")))
    )
    base = _placed(spark, sf_dir).withColumn("x1", x1.cast("int")).withColumn("y1", y1.cast("int"))
    base = base.withColumn("ord", F.row_number().over(order))  # before the texts are made, so that they are not shuffled
    kind = F.when(p % 11 == 0, "text").otherwise("paragraph_title")
    level = F.when(p % 13 == 0, F.lit(None)).otherwise(F.concat(F.lit("H"), ((n + p) % 4 + 1).cast("string")))
    return base.select(
        "doc", "page_id", "ord", kind.alias("block_type"), level.alias("level"), "x1", "y1", text.alias("text")
    )


_CN = "['一', '二', '三', '四', '五'][l_partkey % 5 + 1]"
HEADINGS_SQL = f"""
  SELECT doc, page_id, CAST(row_number() OVER (PARTITION BY doc ORDER BY page_id, {_Y1}, {_X1}, rid) AS INTEGER) AS ord,
         CASE WHEN l_partkey % 11 = 0 THEN 'text' ELSE 'paragraph_title' END AS block_type,
         CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE 'H' || CAST((l_linenumber + l_partkey) % 4 + 1 AS VARCHAR) END AS level,
         CAST({_X1} AS INTEGER) AS x1, CAST({_Y1} AS INTEGER) AS y1,
         CASE l_linenumber WHEN 1 THEN '第' || {_CN} || '章 总则'
              WHEN 2 THEN CAST(l_orderkey % 40 + 1 AS VARCHAR) || '.' || CAST(l_partkey % 4 + 1 AS VARCHAR) || ' Scope'
              WHEN 3 THEN CAST(l_orderkey % 40 + 1 AS VARCHAR) || '.' || CAST(l_partkey % 4 + 1 AS VARCHAR) || '.' || CAST(l_partkey % 3 + 1 AS VARCHAR) || '  Terms'
              WHEN 4 THEN '（' || {_CN} || '）范围'
              WHEN 5 THEN CAST(l_partkey % 9 + 1 AS VARCHAR) || '、Item'
              ELSE 'Plain heading ' || CAST(l_partkey AS VARCHAR) END AS text
  FROM li"""

_SQL = {"gt": GT_SQL, "pred": PRED_SQL, "hd": HEADINGS_SQL}


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the named views for DuckDB."""
    return "WITH li AS (" + LI_SQL + ")" + "".join(f",\n{n} AS ({_SQL[n]})" for n in names)
