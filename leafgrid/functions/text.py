"""Text, label and numbering functions as column expressions.

``\\s`` and ``\\d`` below are Unicode-aware through ``(?U)``. Fixed values are grouped at the top.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Block types and the names that stand for them.
BLOCK_TYPES = (
    "doc_title", "paragraph_title", "text", "table_of_contents", "table", "formula", "chart", "flowchart", "diagram", "image",
    "vision_footnote", "header", "footer", "caption", "handwriting", "seal",
)
TYPE_ALIASES = {
    "list": "table_of_contents", "title": "paragraph_title", "figure_title": "caption", "figure": "image",
    "footnote": "vision_footnote", "reference": "vision_footnote", "other": "text",
}
LEVELS = ("H1", "H2", "H3", "H4")
COORDINATE_MODES = {
    "pixel": "pixel", "pixels": "pixel", "absolute": "pixel", "absolute_pixel": "pixel", "absolute_pixels": "pixel",
    "normalized": "normalized_1000", "normalized_1000": "normalized_1000", "relative": "normalized_1000", "relative_1000": "normalized_1000", "0-1000": "normalized_1000",
}
CN_DIGITS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
DESCRIBED_TYPES = ("chart", "flowchart")
_CN = "一二三四五六七八九十"


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def filled(c: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(c, F.lit(""))


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeezed(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def clean(c: Column, default: str = "") -> Column:
    return F.coalesce(filled(stripped(c)), F.lit(default))


def block_type(c: Column, default: str = "text") -> Column:
    label = stripped(F.coalesce(filled(c), F.lit(default)))
    return F.coalesce(F.try_element_at(_map(TYPE_ALIASES), label), label)


def label_or(c: Column, other: Column | None = None, default: str = "unknown") -> Column:
    """First non-empty of two columns, else the default."""
    return F.coalesce(filled(c), filled(other) if other is not None else F.lit(None), F.lit(default))


@F.pandas_udf(StringType())
def _fold_any(texts: pd.Series) -> pd.Series:
    """Spark has no NFKC of its own."""
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t or "").lower() if c.isalnum())
    return texts.map(fold, na_action="ignore")


#: Texts of these characters fold without NFKC: ASCII, Han, and the punctuation (also full-width) that Chinese texts use, all of which goes.
PLAIN = r"^[\x00-\x7F\u4E00-\u9FFF\u2014\u2018\u2019\u201C\u201D\u2026\u3001-\u3003\u3008-\u3011\uFF01-\uFF0F\uFF1A-\uFF20\uFF3B-\uFF40\uFF5B-\uFF5E]*$"


def fold_text(text: Column | str) -> Column:
    """NFKC, lower case, letters and digits only; null gives the empty text. Plain texts fold in the JVM, and only the others reach a Python worker."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.coalesce(text, F.lit("")).rlike(PLAIN)
    native = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^0-9a-z\u4E00-\u9FFF]", "")
    return F.coalesce(_fold_any(F.when(~plain, text)), native)


def normalized_span(c: Column) -> Column:
    """For containment tests: white space, ``---`` and ``#`` runs go, two old spellings are folded."""
    folded = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("責任"), F.lit("责任")), F.lit("行為"), F.lit("行为"))
    return F.regexp_replace(folded, r"(?U)\s+|---|#{1,6}", "")


def clip(c: Column, limit: int = 40) -> Column:
    """White space collapsed, at most ``limit`` characters and an ellipsis."""
    compact = stripped(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(compact) > limit, F.concat(F.substring(compact, 1, limit), F.lit("…"))).otherwise(compact)


def after_thinking(c: Column) -> Column:
    """What follows the last closing think tag, without leading white space; the text itself if there is none."""
    text = F.coalesce(c, F.lit(""))
    tag = r"(?is)^.*</think\s*>"
    return F.when(text.rlike(tag), F.regexp_replace(F.regexp_replace(text, tag, ""), r"(?U)^\s+", "")).otherwise(text)


def infer_level(text: Column) -> Column:
    """Heading level from the leading enumerator, null without one."""
    t = squeezed(text)
    has = lambda p: t.rlike("(?U)" + p)
    decimal = F.when(has(r"^\d+[.．]\d+[.．]\d+"), "H4").when(has(r"^\d+[.．]\d+"), "H3").otherwise("H2")
    return (
        F.when(has(rf"^第[{_CN}百\d]+[章节]") | has(rf"^[{_CN}]+[、.．]"), "H1").when(has(r"^\d+[、.．]"), decimal)
        .when(has(rf"^(（[{_CN}\d]+）|\([{_CN}\d]+\)|\d+[）)])"), "H3")
    )


def heading_level(level: Column, kind: Column, text: Column) -> Column:
    """A paragraph title's own valid level, else the inferred one; null for other blocks."""
    return F.when(kind == "paragraph_title", F.when(level.isin(*LEVELS), level).otherwise(infer_level(text)))


def stored_level(level: Column, kind: Column) -> Column:
    return F.when((kind == "paragraph_title") & level.isin(*LEVELS), level)


def level_rank(level: Column) -> Column:
    return F.coalesce(F.try_element_at(_map({n: i + 1 for i, n in enumerate(LEVELS)}), level), F.lit(0))


def rank_level(rank: Column) -> Column:
    return F.try_element_at(_map({i + 1: n for i, n in enumerate(LEVELS)}), rank.cast("int"))


def decimal_number(text: Column) -> Column:
    """Leading dotted number of two or more parts as array<int>, else null."""
    found = F.regexp_extract(squeezed(text), r"(?U)^(\d+(?:[.．]\d+)+)(?=$|[^\d])", 1)
    return F.when(found != "", F.transform(F.split(found, "[.．]"), lambda x: x.cast("int")))


def is_chapter_root(text: Column) -> Column:
    return squeezed(text).rlike(rf"(?U)^(第[{_CN}百\d]+[章节]|[{_CN}]+[、.．])")


def chinese_ordinal(c: Column) -> Column:
    """Value of a Chinese ordinal up to 99, null for others."""
    v = stripped(F.coalesce(c, F.lit("")))
    digit = lambda x: F.try_element_at(_map(CN_DIGITS), x)
    tens, units = F.regexp_extract(v, "^([二三四五六七八九]?)十([一二三四五六七八九]?)$", 1), F.regexp_extract(v, "^([二三四五六七八九]?)十([一二三四五六七八九]?)$", 2)
    compound = v.rlike("^[二三四五六七八九]?十[一二三四五六七八九]?$")
    value = F.coalesce(digit(tens), F.lit(1)) * 10 + F.coalesce(digit(units), F.lit(0))
    return F.when(compound, value).otherwise(digit(v))


def number_schema(text: Column) -> Column:
    """Leading enumerator as struct(kind, family, ordinal), null without one."""
    t = squeezed(text)
    got = lambda p: F.regexp_extract(t, "(?U)" + p, 1)
    number = lambda s: F.coalesce(F.expr("null").cast("int"), s.try_cast("int"))
    make = lambda kind, family, ordinal: F.struct(kind.alias("kind"), family.alias("family"), ordinal.alias("ordinal"))
    plain = lambda kind, ordinal: make(F.lit(kind), F.lit(kind), ordinal)
    dec = decimal_number(text)
    parts = F.size(dec)
    dotted = make(
        F.concat(F.lit("decimal_"), parts.cast("string")),
        F.concat_ws(".", F.lit("decimal"), F.array_join(F.transform(F.slice(dec, F.lit(1), F.greatest(parts - 1, F.lit(0))), lambda x: x.cast("string")), ".")), F.element_at(dec, -1),
    )
    cn_paren, ar_paren = got(rf"^[（(]([{_CN}]+)[）)]"), got(r"^[（(](\d+)[）)]")
    cn_comma, ar_dot, article = got(rf"^([{_CN}]+)[、.．]"), got(r"^(\d+)[、.．]"), got(rf"^第([{_CN}\d]+)条")
    return (
        F.when(dec.isNotNull(), dotted).when(cn_paren != "", plain("cn_paren", chinese_ordinal(cn_paren))).when(ar_paren != "", plain("arabic_paren", number(ar_paren)))
        .when(cn_comma != "", plain("cn_comma", chinese_ordinal(cn_comma))).when(ar_dot != "", plain("arabic_dot", number(ar_dot)))
        .when(article != "", plain("legal_article", F.coalesce(number(article), chinese_ordinal(article))))
    )


# --- identifiers and paths -------------------------------------------------------------------------------------------


def safe_name(c: Column) -> Column:
    """Only ASCII letters, digits, ``_.-`` and Chinese characters; other runs become ``_``."""
    text = F.regexp_replace(stripped(F.coalesce(c, F.lit(""))), r"[^A-Za-z0-9_.\-一-鿿]+", "_")
    return F.coalesce(filled(F.regexp_replace(text, r"^[._ ]+|[._ ]+$", "")), F.lit("dataset"))


def template_id(c: Column) -> Column:
    """Prompt id: lower case, other runs than letters, digits, ``_`` and ``-`` become ``_``."""
    return F.regexp_replace(F.regexp_replace(F.lower(stripped(F.coalesce(c, F.lit("")))), r"[^a-z0-9_\-]+", "_"), r"^_+|_+$", "")


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


def stem(c: Column) -> Column:
    """Last path part without its extension; leading dots belong to the stem."""
    name = base_name(c)
    return F.regexp_replace(name, r"^(\.*[^.].*)\.[^.]*$", "$1")


def document_key(names: list[Column], path: Column) -> Column:
    """Stem of the first non-empty name, if it is not blank; else the path's stem, or its folder for result and versioned files."""
    first = F.coalesce(*[filled(n) for n in names])
    own = stem(path)
    folder = F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)
    by_path = F.when((own == "result") | own.startswith("annotation_v2_"), folder).otherwise(own)
    return F.when(clean(first) != "", stem(stripped(first))).otherwise(by_path)


def failed_page(error: Column) -> Column:
    """Zero-based page of an error text that names a page, else null."""
    return (filled(F.regexp_extract(error, r"(?U)第\s*(\d+)\s*页", 1)).try_cast("int") - 1).cast("int")


def image_id(name: Column) -> Column:
    """Leading ``letters_<14 digits>_<6 hex digits>`` of a stored name, else its stem."""
    return F.coalesce(filled(F.regexp_extract(name, r"^([A-Za-z]+_\d{14}_[0-9a-f]{6})(?:_|$)", 1)), stem(name))


def clamp_int(c: Column, default: int, low: int, high: int) -> Column:
    number = F.coalesce(F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("int")), F.lit(default))
    return F.least(F.greatest(number, F.lit(low)), F.lit(high))


def factor_floor(c: Column, factor: Column) -> Column:
    return F.greatest(factor, (F.floor(c / factor) * factor).cast("int"))


def factor_ceil(c: Column, factor: Column) -> Column:
    return F.greatest(factor, (F.ceil(c / factor) * factor).cast("int"))


def factor_round(c: Column, factor: Column) -> Column:
    return F.greatest(factor, (F.rint(c / factor) * factor).cast("int"))


def smart_size(width: Column, height: Column, max_pixels: Column, factor: int = 32) -> Column:
    """struct(width, height) on the factor grid within a budget of pixels."""
    f = F.lit(factor)
    least = F.lit(factor * factor * 4)
    most = F.greatest(least, max_pixels)
    first = F.struct(factor_round(width, f).alias("w"), factor_round(height, f).alias("h"))

    def fit(x: Column) -> Column:
        area, own = x["w"] * x["h"], width * height
        down, up = F.sqrt(own / most), F.sqrt(least / F.greatest(own, F.lit(1)))
        shrunk = F.struct(factor_floor(width / down, f).alias("w"), factor_floor(height / down, f).alias("h"))
        grown = F.struct(factor_ceil(width * up, f).alias("w"), factor_ceil(height * up, f).alias("h"))
        return F.when(area > most, shrunk).when(area < least, grown).otherwise(x)

    def trim(x: Column) -> Column:
        beta = F.sqrt(x["w"] * x["h"] / most)
        cut = F.struct(factor_floor(x["w"] / beta, f).alias("w"), factor_floor(x["h"] / beta, f).alias("h"))
        return F.when(x["w"] * x["h"] > most, cut).otherwise(x)

    out = F.transform(F.transform(F.array(first), fit), trim)[0]
    return F.struct(out["w"].alias("width"), out["h"].alias("height"))


def relative_path(c: Column, roots: dict[str, str]) -> Column:
    """Text with absolute roots replaced, the longest first."""
    out = c
    for root, name in sorted(roots.items(), key=lambda x: -len(x[0])):
        out = F.replace(out, F.lit(root + "/"), F.lit(name + "/" if name else ""))
        out = F.replace(out, F.lit(root), F.lit(name or "."))
    return out


# --- prompts ---------------------------------------------------------------------------------------------------------

VARIABLE = r"^[A-Za-z_][A-Za-z0-9_]*$"


def render(template: Column, values: Column) -> Column:
    """``{{ name }}`` placeholders replaced by a map's values, literally; unknown names become empty."""
    names = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}"), F.lit(1)))
    canonical = F.regexp_replace(template, r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}", "{{$1}}")
    pieces = F.split(canonical, r"(?=\{\{[A-Za-z_][A-Za-z0-9_]*\}\})|(?<=[A-Za-z0-9_]\}\})", -1)
    fill = lambda p: F.when(p.rlike(r"^\{\{[A-Za-z_][A-Za-z0-9_]*\}\}$"), F.coalesce(F.try_element_at(values, F.regexp_extract(p, r"^\{\{(.*)\}\}$", 1)), F.lit(""))).otherwise(p)
    return F.when(F.size(names) == 0, template).otherwise(F.array_join(F.transform(pieces, fill), ""))


def next_version(c: Column) -> Column:
    """vA.B -> vA.(B+1); v1.1 for other texts."""
    major, minor = F.regexp_extract(c, r"^v(\d+)\.(\d+)$", 1), F.regexp_extract(c, r"^v(\d+)\.(\d+)$", 2)
    return F.when(c.rlike(r"^v\d+\.\d+$"), F.concat(F.lit("v"), major, F.lit("."), (minor.try_cast("int") + 1).cast("string"))).otherwise("v1.1")


def with_image_token(c: Column) -> Column:
    return F.when(c.contains("<image>"), c).otherwise(F.concat(F.lit("<image>\n"), c))


def data_url(raw: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(raw))


def revision(raw: Column) -> Column:
    """First 16 hex digits of the SHA-256 of some bytes."""
    return F.substring(F.sha2(raw.cast("binary"), 256), 1, 16)


def page_text(page_id: Column, width: Column, height: Column) -> Column:
    """The user text that introduces a page."""
    return F.format_string("当前页面 page_id=%s，图像尺寸为 %sx%s。", page_id.cast("string"), width.cast("string"), height.cast("string"))


def short_count(n: Column) -> Column:
    """1234 -> 1.2K, 3400000 -> 3.4M."""
    one = lambda x: F.format_string("%.1f", x.cast("double"))
    return F.when(n >= 1_000_000, F.concat(one(n / 1_000_000), F.lit("M"))).when(n >= 1000, F.concat(one(n / 1000), F.lit("K"))).otherwise(n.cast("string"))


def percent(c: Column) -> Column:
    """Clamped to 0..100, three decimals, half up."""
    return F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0)), 3)
