"""Recursive checks of JSON values, one level per step."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid.functions.geometry import let


def depth_of(raw: Column) -> Column:
    """Greatest nesting of objects and arrays in a JSON text; strings are skipped."""
    marks = F.regexp_extract_all(raw, F.lit(r'"(?:[^"\\]|\\.)*"|[\[\]{}]'), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, m: Column) -> Column:
        now = a["now"] + F.when(m.isin("{", "["), 1).when(m.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(marks, start, step, lambda a: a["most"])


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def leaves(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, leaf): every value of a JSON text that is neither object nor array, with its path joined by dots.

    One step per level of the deepest text (its number is read once); leaf is the value as text, null for JSON null. Objects and arrays
    without members have no leaves; null texts have none.
    """
    depth = rows.agg(F.max(depth_of(F.col(json_col))).alias("d")).first()["d"] or 0
    now = rows.where(F.col(json_col).isNotNull()).select(F.col(id_col), F.lit("").alias("path"), F.parse_json(json_col).alias("v"))
    found = None
    for level in range(depth + 1):
        typed = now.withColumn("kind", _kind(F.col("v")))
        here = typed.where(~F.col("kind").isin("OBJECT", "ARRAY")).select(id_col, F.substring("path", 2, 1 << 30).alias("path"), F.col("v").cast("string").alias("leaf"))
        found = here if found is None else found.unionByName(here)
        if level == depth:
            break
        inside = F.when(F.col("kind") == "OBJECT", F.transform(F.map_entries(F.col("v").cast("map<string,variant>")), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
        inside = inside.when(F.col("kind") == "ARRAY", F.transform(F.col("v").cast("array<variant>"), lambda e, i: F.struct(i.cast("string").alias("k"), e.alias("v"))))
        now = typed.where(F.col("kind").isin("OBJECT", "ARRAY")).select(id_col, "path", F.explode(inside).alias("e")).select(id_col, F.concat("path", F.lit("."), "e.k").alias("path"), F.col("e.v").alias("v"))
    return found


def exact_shape(v: Column, template: object, path: Column) -> Column:
    """Issues (code, path) of a variant against a template of objects, one-item lists and strings, at all depths.

    An object needs just the template's keys, a list only items of its template's item (strings if it is empty), and any other value is a string or null.
    """
    issue = lambda code, p: F.struct(F.lit(code).alias("code"), p.alias("path"))
    none = F.array().cast("array<struct<code:string,path:string>>")
    wrong = F.array(issue("schema_type", path))
    if isinstance(template, dict):
        want = F.array(*map(F.lit, sorted(template))) if template else F.array().cast("array<string>")
        named = lambda code, keys: F.transform(F.array_sort(keys), lambda k: issue(code, F.concat(path, F.lit("."), k)))

        def members(m: Column) -> Column:
            have = F.map_keys(m)
            parts = [named("schema_missing", F.array_except(want, have)), named("schema_extra", F.array_except(have, want))]
            for key in sorted(template):
                child = exact_shape(F.try_element_at(m, F.lit(key)), template[key], F.concat(path, F.lit("." + key)))
                parts.append(F.when(F.map_contains_key(m, key), child).otherwise(none))
            return F.when(m.isNotNull(), F.concat(*parts)).otherwise(wrong)

        return let(v.try_cast("map<string,variant>"), members)  # each object and list is opened once
    if isinstance(template, list):
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        if template:
            item = lambda x, i: exact_shape(x, template[0], at(i))
        else:
            item = lambda x, i: F.when(F.coalesce(_kind(x), F.lit("VOID")) == "STRING", none).otherwise(F.array(issue("schema_type", at(i))))
        return let(v.try_cast("array<variant>"), lambda a: F.when(a.isNotNull(), F.flatten(F.transform(a, item))).otherwise(wrong))
    return F.when(F.coalesce(_kind(v), F.lit("VOID")).isin("STRING", "VOID"), none).otherwise(wrong)


def shape_problems(rows: DataFrame, id_col: str, json_col: str, template: object, name: str = "gold_answer") -> DataFrame:
    """(id, code, path) of all issues; a text that is no JSON has one schema_type issue."""
    if isinstance(template, str):
        template = json.loads(template)
    parsed = rows.select(F.col(id_col), F.try_parse_json(json_col).alias("v"))
    found = F.when(F.col("v").isNull(), F.array(F.struct(F.lit("schema_type").alias("code"), F.lit(name).alias("path")))).otherwise(exact_shape(F.col("v"), template, F.lit(name)))
    return parsed.select(id_col, F.explode(found).alias("_i")).select(id_col, "_i.code", "_i.path")
