"""Heading hierarchy: ordered operators over (doc, ord) as window functions.

Headings have doc, page_id, ord (reading order within the document), block_type, level, x1 and text. Windows are keyed by document.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from leafgrid.functions import text as T
from leafgrid.sources.shared import checkpointed


def _order(*more: str) -> WindowSpec:
    return Window.partitionBy("doc", *more).orderBy("ord")


def _up_to(*more: str) -> WindowSpec:
    return _order(*more).rowsBetween(Window.unboundedPreceding, 0)


def _before(*more: str) -> WindowSpec:
    return _order(*more).rowsBetween(Window.unboundedPreceding, -1)


#: Scores of the document pass.
WEIGHTS = {
    "model_match": 4, "model_change": -3, "chapter_root": 8, "decimal_relative_depth": 5, "direct_parent_match": 9, "direct_parent_conflict": -8,
    "sibling_match": 7, "sibling_conflict": -7, "legal_same_level": 2, "legal_descend": 3, "legal_ascend": 1, "skip_one_level": -10, "skip_two_levels": -16,
    "missing_parent_deep_level": -8, "cross_page_parent": 8, "cross_page_sibling": 7, "same_level_indent": 2, "deeper_indent": 2, "indent_conflict": -2,
}
#: Scores of the local numbering pass.
LOCAL_WEIGHTS = {
    "same_family_target": 3, "consecutive_neighbour": 5, "bidirectional_continuity": 4, "decimal_parent": 5, "indent_cluster": 2, "conflicting_family": -4,
    "direct_root": 12,
}
#: Texts of the heading outline.
OUTLINE = {
    "header": "【前序页面已识别的 paragraph_title 层级（仅供保持层级一致性参考，请勿当作当前页内容输出）】", "path": "当前有效标题路径：",
    "recent": "最近识别的 paragraph_title 序列：", "appeared": "当前文档已出现过的标题层级：", "allowed": "当前允许的下一个 paragraph_title 层级：",
    "forbidden": "当前禁止的 paragraph_title 层级：", "empty": "无",
    "following_header": "【后续页面已识别的 paragraph_title 层级（仅供判断当前标题与后续标题的相对层级，请勿当作当前页内容输出）】", "following": "后续页面标题序列：",
}


def clamp_levels(h: DataFrame, *more: str) -> DataFrame:
    """Adds ``repaired``: each title's level, at most one deeper than the title before it (of the document and of ``more`` columns); null for other rows.

    With k counting the valid titles, the sequential rule r = min(level, r_before + 1) unrolls to
    r_k = k + min(0, min over j <= k of level_j - j): a running minimum, one window.
    """
    rank = F.when(F.col("block_type") == "paragraph_title", F.nullif(T.level_rank(F.col("level")), F.lit(0)))
    h = h.withColumn("_l", rank).withColumn("_k", F.count("_l").over(_up_to(*more)).cast("int"))
    slack = F.min(F.when(F.col("_l").isNotNull(), F.col("_l") - F.col("_k"))).over(_up_to(*more))
    repaired = F.when(F.col("_l").isNotNull(), F.col("_k") + F.least(F.lit(0), slack))
    return h.withColumn("repaired", T.rank_level(repaired)).drop("_l", "_k")


def _last(where: Column, value: Column, window) -> Column:
    return F.last_value(F.when(where, value), ignoreNulls=True).over(window)


def active_path(h: DataFrame, *more: str, level: str = "repaired", before: bool = False) -> DataFrame:
    """Adds path1..path4: clipped text of the open heading of each level at (or before) each row (of the document and of ``more`` columns)."""
    window = _before(*more) if before else _up_to(*more)
    rank = T.level_rank(F.coalesce(F.col(level), F.lit("")))
    h = h.withColumn("_r", rank)
    opened = {n: _last(F.col("_r") == n, F.col("ord"), window) for n in range(1, 5)}
    closed = {n: _last((F.col("_r") > 0) & (F.col("_r") < n), F.col("ord"), window) for n in range(1, 5)}
    texts = {n: _last(F.col("_r") == n, T.clip(F.col("text")), window) for n in range(1, 5)}
    last = F.last_value(F.nullif(F.col("_r"), F.lit(0)), ignoreNulls=True).over(window)
    h = h.withColumns({f"path{n}": F.when((last >= n) & (opened[n] > F.coalesce(closed[n], F.lit(-1))), texts[n]) for n in range(1, 5)})
    return h.drop("_r")


def scopes(h: DataFrame) -> DataFrame:
    """Adds scope_h1, scope_h2: ord of the open H1 and H2 before each heading."""
    rank = T.level_rank(F.coalesce(F.col("level"), F.lit("")))
    h = h.withColumn("_r", rank)
    h1, h2 = (_last(F.col("_r") == n, F.col("ord"), _before()) for n in (1, 2))
    return h.withColumns({"scope_h1": h1, "scope_h2": F.when(h2 > F.coalesce(h1, F.lit(-1)), h2)}).drop("_r")


def _joined(parts: list[Column]) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "\n")


def page_outlines(h: DataFrame, recent: int = 12, following: int | None = None) -> DataFrame:
    """One row per page (doc, page_id, outline): what earlier pages say about the hierarchy, as prompt text.

    Levels are those of the continuous repair. With ``following`` set, the next titles of later pages are listed as well.
    """
    # Titles and other rows are windows of their own in one partition, so that a page without titles needs no join.
    is_title = F.coalesce((F.col("block_type") == "paragraph_title") & F.col("level").isin(*T.LEVELS), F.lit(False))
    only = lambda c: F.when(F.col("_t"), F.col(c))
    rows = h.select("doc", "page_id", "ord", is_title.alias("_t"), "block_type", "level", "text").withColumns({c: only(c) for c in ("block_type", "level", "text")})
    titles = clamp_levels(rows, "_t").withColumn("rank", T.level_rank(F.col("repaired"))).withColumn("text", T.clip(F.col("text")))
    # A page's context is the state at the last title before it, so each page's last title keeps its path, recent titles and seen levels.
    at_title = active_path(titles, "_t")
    line = F.concat(F.lit("  "), F.col("repaired"), F.lit(" "), F.col("text"))
    back = _order("_t").rowsBetween(1 - recent, 0)
    state = F.struct(
        F.array(*[F.col(f"path{n}") for n in range(1, 5)]).alias("path"), F.collect_list(line).over(back).alias("listed"),
        F.array(*[F.max(F.col("rank") == n).over(_up_to("_t")) for n in range(1, 5)]).alias("seen"),
    )
    turns = lambda beside: F.coalesce(beside(F.col("page_id")).over(_order("_t")) != F.col("page_id"), F.lit(True))
    at_title = at_title.withColumns({"state": state, "_last": turns(F.lead), "_first": turns(F.lag)})
    at = F.when(F.col("_t") & F.col("doc").isNotNull() & F.col("page_id").isNotNull(), F.col("ord"))
    aggregates = [F.max_by("state", at).alias("last")]
    if following is not None:
        ahead = F.concat(F.lit("  page "), (F.col("page_id") + 1).cast("string"), F.lit(": "), F.col("level"), F.lit(" "), F.col("text"))
        at_title = at_title.withColumn("ahead", F.collect_list(ahead).over(_order("_t").rowsBetween(0, following - 1)))
        aggregates.append(F.min_by("ahead", at).alias("first"))
    # Only the ends of a page's runs of rows go on: the lists of all other titles are dropped before they are sorted by page.
    ends = at_title.where(F.col("_last") | (F.col("_first") & F.col("_t")) if following is not None else F.col("_last"))
    all_pages = ends.groupBy("doc", "page_id").agg(*aggregates)
    by_page = Window.partitionBy("doc").orderBy("page_id")
    all_pages = all_pages.withColumn("state", F.last("last", True).over(by_page.rowsBetween(Window.unboundedPreceding, -1)))
    texts = F.array().cast("array<string>")
    path = F.coalesce(F.col("state.path"), F.array_repeat(F.lit(None).cast("string"), 4))
    empty = F.lit("  " + OUTLINE["empty"])
    lines = F.filter(F.transform(path, lambda t, i: F.concat(F.repeat(F.lit("  "), i + 1), F.lit("H"), (i + 1).cast("string"), F.lit(": "), t)), lambda x: x.isNotNull())
    listed = F.coalesce(F.col("state.listed"), texts)
    none = lambda a: F.when(F.size(a) == 0, empty).otherwise(F.array_join(a, "\n"))
    names = F.array(*map(F.lit, T.LEVELS))
    seen = F.filter(names, lambda n, i: F.coalesce(F.get(F.col("state.seen"), i), F.lit(False)))
    depth = F.coalesce(F.array_max(F.transform(path, lambda t, i: F.when(t.isNotNull(), i + 1))), F.lit(0))
    allowed = F.least(depth + 1, F.lit(4))
    named = lambda a: F.concat(F.lit("  "), F.coalesce(T.filled(F.array_join(a, ", ")), F.lit(OUTLINE["empty"])))
    parts = [
        F.lit(OUTLINE["header"]), F.lit(OUTLINE["path"]), none(lines), F.lit(OUTLINE["recent"]), none(listed), F.lit(OUTLINE["appeared"]), named(seen),
        F.lit(OUTLINE["allowed"]), named(F.slice(names, F.lit(1), allowed)), F.lit(OUTLINE["forbidden"]), named(F.slice(names, allowed + 1, F.lit(4))),
    ]
    if following is not None:
        more = F.coalesce(F.first("first", True).over(by_page.rowsBetween(1, Window.unboundedFollowing)), texts)
        parts += [F.lit(""), F.lit(OUTLINE["following_header"]), F.lit(OUTLINE["following"]), none(more)]
    return all_pages.select("doc", "page_id", _joined(parts).alias("outline"), allowed.alias("allowed_rank"))


def financial_chain(h: DataFrame) -> DataFrame:
    """Adds ``fixed``: levels of titles under a “第X节” root moved one deeper where list markers show a shifted chain.

    The state (in a section, an H2 seen, an H3 seen) is folded over the document's ordered titles.
    """
    t = T.squeezed(F.col("text"))
    has = lambda p: t.rlike("(?U)" + p)
    kind = F.struct(
        "ord", T.level_rank(F.coalesce(F.col("level"), F.lit(""))).alias("rank"), has("^第[一二三四五六七八九十]+节").alias("root"), has(r"^\d+[、]").alias("item"),
        (has("^[（(][一二三四五六七八九十]+[）)]") | has(r"^\d+\.\d+(?!\.)")).alias("paren"),
    )
    titles = h.where(F.col("block_type") == "paragraph_title")
    docs = titles.groupBy("doc").agg(F.array_sort(F.collect_list(kind)).alias("t"))
    start = F.from_json(F.lit('{"on":false,"h2":false,"h3":false,"out":[]}'), "struct<on:boolean,h2:boolean,h3:boolean,out:array<struct<ord:int,rank:int>>>")

    def step(a: Column, x: Column) -> Column:
        on = a["on"] & ~x["root"]
        first, second = on & (x["rank"] == 1) & x["item"], on & (x["rank"] == 2) & x["paren"] & a["h2"]
        third = on & (x["rank"] == 3) & x["item"] & a["h3"]
        rank = x["rank"] + (first | second | third).cast("int")
        return F.struct(
            (a["on"] | x["root"]).alias("on"), (~x["root"] & (a["h2"] | first)).alias("h2"), (~x["root"] & (a["h3"] | second)).alias("h3"),
            F.array_append(a["out"], F.struct(x["ord"].alias("ord"), rank.alias("rank"))).alias("out"),
        )

    fixed = docs.select("doc", F.explode(F.aggregate("t", start, step)["out"]).alias("o")).select("doc", "o.ord", T.rank_level(F.col("o.rank")).alias("_f"))
    return h.join(fixed, ["doc", "ord"], "left").withColumn("fixed", F.coalesce("_f", "level")).drop("_f")


def numbered_titles(h: DataFrame) -> DataFrame:
    """Titles with a level and an enumerator: rank, kind, family, ordinal, decimal, scopes, and n (their order)."""
    titles = scopes(h.where((F.col("block_type") == "paragraph_title") & F.col("level").isin(*T.LEVELS)))
    titles = titles.withColumn("rank", T.level_rank(F.col("level"))).withColumn("s", T.number_schema(F.col("text"))).where("s is not null")
    return titles.select("doc", "page_id", "ord", "level", "rank", "x1", "text", "s.kind", "s.family", "s.ordinal", T.decimal_number(F.col("text")).alias("decimal"),
                         "scope_h1", "scope_h2", F.row_number().over(_order()).alias("n"))


def _same_scope(a: Column, b: Column, target: Column) -> Column:
    get = lambda side, f: F.col(f"{side}.{f}")
    return (get(a, "scope_h1") == get(b, "scope_h1")) & ((target < 4) | get(a, "scope_h2").eqNullSafe(get(b, "scope_h2")))


def root_parents(titles: DataFrame) -> DataFrame:
    """(doc, n, parent_n): for titles with three or more number parts, the nearest earlier H1 whose number is the parent's, at most a page back."""
    a = titles.where((F.size("decimal") >= 3) & (F.element_at("decimal", -1) < 100)).withColumn("up", F.slice("decimal", F.lit(1), F.size("decimal") - 1)).alias("a")
    b = titles.where("rank = 1 and decimal is not null").alias("b")
    near = a.join(b, (F.col("a.doc") == F.col("b.doc")) & (F.col("a.up") == F.col("b.decimal")) & (F.col("b.n") < F.col("a.n")) & (F.col("a.page_id") - F.col("b.page_id") <= 1))
    return near.groupBy(F.col("a.doc").alias("doc"), F.col("a.n").alias("n")).agg(F.max("b.n").alias("parent_n"))


def neighbourhood(titles: DataFrame, reach: int = 8, pages: int = 5) -> DataFrame:
    """Pairs (doc, n, o) of titles of one numbering family, within reach and pages of each other, in one scope."""
    a, b = titles.where("rank in (2, 3)").alias("a"), titles.alias("b")
    target = F.col("a.rank") + 1
    on = (
        (F.col("a.doc") == F.col("b.doc")) & (F.col("a.kind") == F.col("b.kind")) & (F.col("a.family") == F.col("b.family")) & (F.col("a.n") != F.col("b.n"))
        & (F.abs(F.col("a.n") - F.col("b.n")) <= reach) & (F.abs(F.col("a.page_id") - F.col("b.page_id")) <= pages) & _same_scope("a", "b", target)
    )
    return a.join(b, on).select(
        F.col("a.doc").alias("doc"), F.col("a.n").alias("n"), F.col("b.n").alias("o"), F.col("a.rank").alias("rank"), F.col("b.rank").alias("o_rank"),
        F.col("a.ordinal").alias("ordinal"), F.col("b.ordinal").alias("o_ordinal"), F.col("a.x1").alias("x1"), F.col("b.x1").alias("o_x1"),
    )


def reconcile_locally(h: DataFrame) -> DataFrame:
    """Events (doc, ord, old_level, new_level, score): titles that the local numbering says are one level deeper.

    All evidence comes from the levels before the pass, so no change feeds another: joins and aggregates suffice.
    """
    titles = checkpointed(numbered_titles(h))  # read by five joins
    near = neighbourhood(titles)
    aim = F.col("o_rank") == F.col("rank") + 1
    facts = near.groupBy("doc", "n").agg(
        F.count_if(aim).alias("support"), F.count_if(F.col("o_rank") == F.col("rank")).alias("conflicts"),
        F.bool_or(aim & (F.col("o_ordinal") == F.col("ordinal") - 1)).alias("prev"), F.bool_or(aim & (F.col("o_ordinal") == F.col("ordinal") + 1)).alias("next"),
        (F.count_if(aim & (F.abs(F.col("o_x1") - F.col("x1")) <= 36)) >= 2).alias("indent"),
    )
    a = titles.where("rank in (2, 3) and decimal is not null").withColumn("up", F.slice("decimal", F.lit(1), F.size("decimal") - 1)).alias("a")
    b = titles.where("decimal is not null").alias("b")
    parents = a.join(b, (F.col("a.doc") == F.col("b.doc")) & (F.col("a.up") == F.col("b.decimal")) & (F.col("b.rank") == F.col("a.rank")) & _same_scope("a", "b", F.col("a.rank") + 1))
    parents = parents.select(F.col("a.doc").alias("doc"), F.col("a.n").alias("n"), F.lit(True).alias("by_number")).distinct()
    all_ = titles.where("rank in (2, 3)").join(facts, ["doc", "n"], "left").join(root_parents(titles), ["doc", "n"], "left").join(parents, ["doc", "n"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    root = F.col("parent_n").isNotNull()
    support, conflicts = F.coalesce("support", F.lit(0)), F.coalesce("conflicts", F.lit(0))
    number = root | yes("by_number")
    w = LOCAL_WEIGHTS
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = (
        support * w["same_family_target"] + points(root, w["direct_root"]) + points(yes("prev"), w["consecutive_neighbour"]) + points(yes("next"), w["consecutive_neighbour"])
        + points(yes("prev") & yes("next"), w["bidirectional_continuity"]) + points(number, w["decimal_parent"]) + points(yes("indent"), w["indent_cluster"])
        + points(conflicts > support, w["conflicting_family"])
    )
    evidence = sum((c.cast("int") for c in (support > 0, root, yes("prev"), yes("next"), number, yes("indent"))), F.lit(0))
    all_ = all_.withColumns({"score": score.cast("long"), "evidence": evidence, "root": root, "sup": support})
    kept = all_.where(((F.col("sup") >= 2) | ((F.col("rank") == 2) & F.col("root"))) & ((F.col("evidence") >= 2) | F.col("root")) & (F.col("score") >= 12))
    return kept.select("doc", "ord", F.col("level").alias("old_level"), T.rank_level(F.col("rank") + 1).alias("new_level"), "score")


_CHAPTER = re.compile(r"^(第[一二三四五六七八九十百\d]+[章节]|[一二三四五六七八九十]+[、.．])")
_CHOSEN = pa.schema([("doc", pa.int64()), ("ord", pa.int32()), ("old_level", pa.string()), ("new_level", pa.string()), ("score", pa.int64()), ("margin", pa.int64())])
_DOTTED = re.compile(r"^(\d+(?:[.．]\d+)+)(?=$|[^\d])")


def _steps() -> list[list[int]]:
    """By deepest open rank, the points of each next rank for how far it goes down; rank 1 of a first title has none."""
    w, out = WEIGHTS, []
    for deepest in range(5):
        down = {1: w["legal_descend"], 2: w["skip_one_level"]}
        points = [0, w["legal_ascend"]]
        for rank in (2, 3, 4):
            if deepest == 0:
                points.append(w["missing_parent_deep_level"] if rank >= 3 else 0)
            elif rank <= deepest:
                points.append(w["legal_same_level"] if rank == deepest else w["legal_ascend"])
            else:
                points.append(down.get(rank - deepest, w["skip_two_levels"]))
        out.append(points)
    return out


def _decide(titles: Iterable[tuple]) -> list[tuple]:
    """One document's titles (page_id, ord, level, x1, text) in order: choose each title's rank among four by a score that looks back on the ranks chosen so far."""
    w, steps, ranks = WEIGHTS, _steps(), {"H1": 1, "H2": 2, "H3": 3, "H4": 4}
    by_number: dict[tuple, tuple] = {}  # records are rank, number, page, left edge
    by_parent: dict[tuple, tuple] = {}
    last_left: list[float | None] = [None] * 5
    path: list[tuple | None] = [None] * 5
    deepest, out = 0, []
    for n, (page, at, level, x1, text) in enumerate(titles):
        compact = "".join((text or "").split())
        found = _DOTTED.match(compact)
        number = tuple(map(int, re.split("[.．]", found[1]))) if found else None
        own = ranks.get(level, 0)
        left = None if x1 is None or x1 != x1 else float(x1)
        parent = sibling = same_depth = None
        scores = [w["model_change"]] * 5
        scores[own] = w["model_match"]
        if _CHAPTER.match(compact):
            scores[1] += w["chapter_root"]
            for rank in (2, 3, 4):
                scores[rank] -= w["chapter_root"]
        if number:
            up = number[:-1]
            parent, sibling, same_depth = by_number.get(up), by_parent.get(up), by_parent.get((len(number), up))
            if parent:
                for rank in (1, 2, 3, 4):
                    scores[rank] += w["direct_parent_conflict"]
                if parent[0] < 4:
                    scores[parent[0] + 1] += w["direct_parent_match"] - w["direct_parent_conflict"] + (w["cross_page_parent"] if parent[2] != page else 0)
            else:
                scores[3] += w["missing_parent_deep_level"]
                scores[4] += w["missing_parent_deep_level"]
            if sibling and len(sibling[1]) == len(number):
                for rank in (1, 2, 3, 4):
                    scores[rank] += w["sibling_conflict"]
                scores[sibling[0]] += w["sibling_match"] - w["sibling_conflict"] + (w["cross_page_sibling"] if sibling[2] != page else 0)
            if parent or sibling:
                scores[min(max(len(number), 2), 4)] += w["decimal_relative_depth"]
        step = steps[deepest]
        best = second = -(1 << 30)
        chosen = 0
        for rank in (1, 2, 3, 4):
            s = scores[rank] + (step[rank] if rank > 1 or n else 0)
            if left is not None:
                if (last := last_left[rank]) is not None:
                    s += w["same_level_indent"] if abs(left - last) <= 36 else w["indent_conflict"]
                above = path[rank - 1]
                if above and above[3] is not None:
                    s += w["deeper_indent"] if left >= above[3] - 12 else w["indent_conflict"]
            scores[rank] = s
            if s > best or (s == best and rank == own):
                best, second, chosen = s, best, rank
            elif s > second:
                second = s
        margin = best - second
        if own and chosen != own:
            recent = same_depth is not None and page - same_depth[2] <= 3
            if not (own in (2, 3) and chosen == own + 1 and margin >= 6 and (parent or recent)):
                chosen = own
        record = (chosen, number, page, left)
        for rank in range(chosen, deepest + 1):
            path[rank] = None
        path[chosen], deepest = record, chosen
        if left is not None:
            last_left[chosen] = left
        if number:
            by_number[number] = by_parent[up] = by_parent[len(number), up] = record
        out.append((at, level, f"H{chosen}", scores[chosen], margin))
    return out


def reconcile_document(h: DataFrame) -> DataFrame:
    """(doc, ord, old_level, new_level, score, margin) of all titles after the raise-only document pass.

    A choice depends on the choices before it, so each document's titles go to one Python fold; documents are independent. The titles come in order and in
    batches of many documents, and what is held back between batches is one document.
    """
    titles = h.where(F.col("block_type") == "paragraph_title").select("doc", "page_id", "ord", "level", "x1", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b[c].to_pylist() for c in ("doc", "page_id", "ord", "level", "x1", "text"))))
        folded = ((doc, *one) for doc, own in groupby(rows, itemgetter(0)) for one in _decide(r[1:] for r in own))
        while some := list(islice(folded, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), _CHOSEN.types)], schema=_CHOSEN)

    return titles.repartition("doc").sortWithinPartitions("doc", "ord").mapInArrow(run, "doc long, ord int, old_level string, new_level string, score long, margin long")


def review_candidates(h: DataFrame, limit: int = 32) -> DataFrame:
    """Per document, the first ``limit`` H2 and H3 titles with an enumerator and a parent signal before them."""
    titles = h.where(F.col("block_type") == "paragraph_title").withColumn("rank", T.level_rank(F.coalesce(F.col("level"), F.lit(""))))
    titles = titles.withColumn("decimal", T.decimal_number(F.col("text")))
    listed = T.squeezed(F.col("text")).rlike(r"(?U)^(?:\d+(?:[.．]\d+)+|[（(][一二三四五六七八九十\d]+[)）]|\d+[、.)）])")
    # A parent by number: the first title of the doc and rank with the shorter number. By indent: the leftmost earlier title of the page and rank.
    earlier = Window.partitionBy("doc", "rank", "page_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    titles = titles.withColumn("leftmost", F.min("x1").over(earlier))
    numbered = titles.where("decimal is not null").groupBy("doc", "rank", F.col("decimal").alias("parent")).agg(F.min("ord").alias("first"))
    wanted = titles.where(F.col("rank").isin(2, 3) & (listed | ((F.col("rank") == 2) & (F.coalesce(F.size("decimal"), F.lit(0)) >= 3))))
    wanted = wanted.withColumn("parent", F.slice(F.col("decimal"), F.lit(1), F.greatest(F.size("decimal") - 1, F.lit(0))))
    both = wanted.join(numbered, ["doc", "rank", "parent"], "left")
    backed = both.where((F.col("first") < F.col("ord")) | (F.col("x1") >= F.col("leftmost") + 24))
    place = F.row_number().over(_order())
    return backed.withColumn("k", place).where(F.col("k") <= limit).select("doc", "ord", "level", "text", "k")


def review_context(h: DataFrame, reach: int = 3) -> DataFrame:
    """(doc, ord, context): the titles around each title, one line each."""
    titles = h.where(F.col("block_type") == "paragraph_title")
    line = F.concat(F.lit(": page "), (F.col("page_id") + 1).cast("string"), F.lit("; 当前="), F.coalesce("level", F.lit("None")), F.lit("; 文本="), F.substring("text", 1, 120))
    around = F.collect_list(F.struct("ord", line.alias("line"))).over(_order().rowsBetween(-reach, reach))
    titles = titles.withColumn("around", around)
    mark = F.transform("around", lambda x: F.concat(F.when(x["ord"] == F.col("ord"), "目标").otherwise("邻近"), x["line"]))
    return titles.select("doc", "ord", F.array_join(mark, "\n").alias("context"))


def apply_reviews(candidates: DataFrame, decisions: DataFrame, confidence: float = 0.9) -> DataFrame:
    """Candidates with their review (doc, ord, decision, confidence): applied if DEEPER with enough confidence."""
    both = candidates.join(decisions, ["doc", "ord"], "left")
    applied = (F.col("decision") == "DEEPER") & (F.col("confidence") >= confidence) & F.col("level").isin("H2", "H3")
    deeper = T.rank_level(T.level_rank(F.col("level")) + 1)
    return both.select("doc", "ord", F.col("level").alias("old_level"), F.when(F.coalesce(applied, F.lit(False)), deeper).otherwise(F.col("level")).alias("new_level"), F.coalesce(applied, F.lit(False)).alias("applied"))


def prior_blocks(h: DataFrame) -> DataFrame:
    """(doc, page_id, prior): number of blocks on earlier pages."""
    per = h.groupBy("doc", "page_id").agg(F.count(F.lit(1)).alias("n"))
    window = Window.partitionBy("doc").orderBy("page_id").rangeBetween(Window.unboundedPreceding, -1)
    return per.select("doc", "page_id", F.coalesce(F.sum("n").over(window), F.lit(0)).alias("prior"))


def visible_bounds(pages: DataFrame, schedule: str, concurrency: int) -> DataFrame:
    """(doc, page_id, through, evens): a page sees all earlier pages up to ``through``, and of the pages from ``evens`` on every second one.

    ``contiguous`` and ``contiguous_cascade``: all earlier pages. ``contiguous_anchor``: a batch's first page sees all earlier pages, the
    others only pages up to the first. ``staggered``: in windows of twice the concurrency, even offsets see earlier windows and
    earlier even offsets; odd offsets see all earlier pages. One row per page.
    """
    page = F.col("page_id")
    before, no = page - 1, F.lit(None).cast("int")
    if schedule in ("contiguous", "contiguous_cascade"):
        through, evens = before, no
    elif schedule == "contiguous_anchor":
        first = (F.floor(page / concurrency) * concurrency).cast("int")
        through, evens = F.when(page == first, before).otherwise(first), no
    elif schedule == "staggered":
        start = (F.floor(page / (2 * concurrency)) * (2 * concurrency)).cast("int")
        even = (page - start) % 2 == 0
        through, evens = F.when(even, start - 1).otherwise(before), F.when(even, start)
    else:
        raise ValueError(f"unknown schedule {schedule}")
    return pages.select("doc", "page_id", through.cast("int").alias("through"), evens.cast("int").alias("evens"))


def visible_pages(pages: DataFrame, schedule: str, concurrency: int) -> DataFrame:
    """(doc, page_id, prior_page): the earlier pages whose headings a page sees; the rows that ``visible_bounds`` stands for."""
    bounds = visible_bounds(pages, schedule, concurrency)
    low = pages.groupBy("doc").agg(F.min("page_id").alias("low"))
    none = F.array().cast("array<int>")
    dense = F.when(F.col("through") >= F.col("low"), F.sequence("low", "through")).otherwise(none)
    second = F.when(F.col("page_id") - 2 >= F.col("evens"), F.sequence(F.col("evens"), F.col("page_id") - 2, F.lit(2))).otherwise(none)
    every = bounds.join(low, "doc").select("doc", "page_id", F.explode(F.concat(dense, second)).alias("prior_page"))
    return every.join(pages.select("doc", F.col("page_id").alias("prior_page")), ["doc", "prior_page"], "left_semi").select("doc", "page_id", "prior_page")


def prompt_pages(pages: DataFrame, schedule: str, concurrency: int) -> DataFrame:
    """(doc, page_id, before, also, step, until): the pages whose titles the request for a page lists, as they are known when it is sent.

    All pages below ``before``; and the pages from ``also`` to ``until`` in steps of ``step`` (null: none). Pages of a batch are sent together, so they know the
    batches before; ``contiguous_cascade`` sends the first page ahead, so the others know it too. ``staggered`` sends the even offsets of
    a window first; an odd offset then knows them all, those after it as look-ahead.
    """
    page = F.col("page_id")
    size = 2 * concurrency if schedule == "staggered" else concurrency
    start = (F.floor(page / size) * size).cast("int")
    if schedule in ("contiguous", "contiguous_anchor"):
        extra = F.lit(False)
    elif schedule == "contiguous_cascade":
        extra = page > start
    elif schedule == "staggered":
        extra = (page - start) % 2 == 1
    else:
        raise ValueError(f"unknown schedule {schedule}")
    until = start if schedule != "staggered" else start + size - 2
    return pages.select("doc", "page_id", start.alias("before"), F.when(extra, start).alias("also"), F.when(extra, F.lit(2 if schedule == "staggered" else 1)).alias("step"), F.when(extra, until).cast("int").alias("until"))
