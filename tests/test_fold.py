"""Text folding against plain Python, over every character of the Basic Multilingual Plane."""

import unicodedata

from pyspark.sql import functions as F

from leafgrid.functions.text import PLAIN, fold_text


def plain(t):
    return "".join(c for c in unicodedata.normalize("NFKC", t or "").lower() if c.isalnum())


def test_every_character_folds_as_in_python(spark):
    texts = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x1D400, 0x1D800)]
    texts += [None, "", "Ａ１ a-1，第一章（总则）", "STRASSE ß", "①②", "İstanbul", "a\n\tb"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["f"] for r in frame.select("i", fold_text(F.col("t")).alias("f")).collect()}
    assert [i for i, t in enumerate(texts) if got[i] != plain(t)] == []


def test_plain_texts_are_folded_natively(spark):
    frame = spark.createDataFrame([("第十条 本办法“自”发布之日起施行。A-1（x）",), ("ñ",)], "t string")
    assert [r[0] for r in frame.select(F.col("t").rlike(PLAIN)).collect()] == [True, False]
