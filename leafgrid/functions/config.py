"""Environment files, time stamps and nested text fragments as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def env_pair(line: Column) -> Column:
    """struct(key, value) of a line ``KEY=value``; null for blank lines, comments and improper keys.

    White space around key and value goes, then one pair of equal quotes; in a line with double quotes the escapes for newline, quote and
    backslash are undone, in this order.
    """
    text = F.regexp_replace(line, r"^\s+|\s+$", "")
    key = F.regexp_extract(text, r"^([^=]*?)\s*=", 1)
    raw = F.regexp_replace(F.regexp_extract(text, r"(?s)^[^=]*=(.*)$", 1), r"^\s+|\s+$", "")
    bare = F.regexp_replace(raw, r"""(?s)^(["'])(.*)\1$""", "$2")
    undone = F.replace(F.replace(F.replace(bare, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    value = F.when(line.contains('"'), undone).otherwise(bare)
    good = ~text.startswith("#") & text.contains("=") & key.rlike("^[A-Za-z_][A-Za-z0-9_]*$")
    return F.when(good, F.struct(key.alias("key"), value.alias("value")))


def env_values(lines: DataFrame, by: list[str], order: str, line: str = "line") -> DataFrame:
    """(by.., key, value) of files given as numbered lines; the last line of a key counts."""
    pairs = lines.select(*by, order, env_pair(F.col(line)).alias("p")).where("p is not null").select(*by, order, "p.*")
    last = Window.partitionBy(*by, "key").orderBy(F.col(order).desc())
    return pairs.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", order)


def env_text(value: Column) -> Column:
    """A value as it is written: plain if it needs no quotes, else in double quotes with escapes."""
    escaped = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.when(value == "", "").when(value.rlike("^[A-Za-z0-9_./:@+-]+$"), value).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def epoch(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def new_id(prefix: str, ts: Column, random: Column) -> Column:
    """prefix_yyyyMMddHHmmss_xxxxxx with six hex digits of a random value."""
    tail = F.concat(F.date_format(ts, "yyyyMMddHHmmss"), F.lit("_"), F.substring(F.md5(random.cast("string")), 1, 6))
    return F.concat(F.lit(prefix + "_"), tail) if prefix else tail


def fragment(defaults: Column, path: tuple[str, ...], default: str = "") -> Column:
    """The string at a path of a JSON object, else the default; values that are no strings count as missing."""
    found = F.try_parse_json(defaults)
    at = "$" + "".join(f'["{p}"]' for p in path)
    kind = F.schema_of_variant(F.try_variant_get(found, at, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(found, at, "string")).otherwise(F.lit(default))
