"""Model answers and JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafgrid.functions import text as T
from leafgrid.functions.geometry import let


def last_json_fence(c: Column) -> Column:
    """Content of the last fenced block marked json, else null."""
    return F.element_at(F.filter(F.array(F.get(F.reverse(F.regexp_extract_all(c, F.lit(r"(?is)```json\s*(.*?)\s*```"), F.lit(1))), F.lit(0))), lambda x: F.lit(True)), 1)


def without_fence(c: Column) -> Column:
    """Content of a fence around the whole text, else the text."""
    whole = r"(?s)^\s*```[A-Za-z0-9_-]*\s*\n?(.*?)\s*```\s*$"
    return F.when(c.rlike(whole), F.regexp_extract(c, whole, 1)).otherwise(c)


def last_object(c: Column) -> Column:
    """The last complete top-level {...} of a text, strings respected; null if there is none.

    Outside of strings only quotes and braces matter, so the fold runs over tokens: string literals, braces, other runs.
    """
    tokens = F.regexp_extract_all(c, F.lit(r'(?s)"(?:[^"\\]|\\.)*(?:"|$)|[{}]|[^"{}]+'), F.lit(0))
    start = F.from_json(F.lit('{"depth":0,"at":0,"open":0,"s":-1,"e":-1}'), "struct<depth:int,at:int,open:int,s:int,e:int>")

    def step(a: Column, t: Column) -> Column:
        opens, closes = t == "{", (t == "}") & (a["depth"] > 0)
        depth = a["depth"] + opens.cast("int") - closes.cast("int")
        done = closes & (depth == 0)
        end = a["at"] + F.length(t)
        return F.struct(
            depth.alias("depth"), end.alias("at"), F.when(opens & (a["depth"] == 0), a["at"]).otherwise(a["open"]).alias("open"),
            F.when(done, a["open"]).otherwise(a["s"]).alias("s"), F.when(done, end).otherwise(a["e"]).alias("e"),
        )

    found = F.transform(F.array(F.aggregate(tokens, start, step)), lambda r: F.when(r["e"] >= 0, F.substr(c, r["s"] + 1, r["e"] - r["s"])))
    return found[0]


def model_object(c: Column) -> Column:
    """The model's JSON object as text: the last json fence, the unfenced text or the last object, whichever parses first; null if none
    is a JSON object. Raw control characters inside strings are let pass.
    """
    clean = F.trim(T.stripped(T.after_thinking(c)))
    plain = lambda x: F.regexp_replace(x, r"[\x00-\x1F]", " ")
    parsed = lambda x: F.coalesce(F.try_parse_json(x), F.try_parse_json(plain(x)))
    valid = lambda x: F.when(x.isNotNull() & (x != "") & parsed(x).isNotNull(), x)
    first = F.coalesce(valid(T.stripped(last_json_fence(clean))), valid(T.stripped(without_fence(clean))), valid(last_object(clean)))  # the fold runs where all else fails
    return let(first, lambda x: F.when(x.rlike(r"^\s*\{"), x))


def review_decision(c: Column) -> Column:
    """struct(deeper, confidence) of a review answer; deeper is null for an invalid one, confidence lies in 0..1."""
    clean = T.stripped(T.after_thinking(c))
    body = F.coalesce(T.filled(F.regexp_extract(clean, r"(?s)(\{.*?\})", 1)), clean)
    got = F.from_json(body, "decision string, confidence string")
    word = F.upper(F.trim(F.coalesce(got["decision"], F.lit(""))))
    number = F.coalesce(got["confidence"].try_cast("double"), F.lit(0.0))
    known = word.isin("KEEP", "DEEPER")
    return F.struct(F.when(known, word == "DEEPER").alias("deeper"), F.when(known, F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))).otherwise(number).alias("confidence"))


def compact(c: Column) -> Column:
    """A struct as JSON with nulls kept."""
    return F.to_json(c, {"ignoreNullFields": "false"})
