"""Review of gold extraction units: data-quality issue rows, summaries, lists and guarded updates.

A unit has unit_id, document_id, document_name, unit_number, input_text, source_text, source_markdown, source_sha256, review_status and answer, a
struct(name, clause, rules), where rules is an array of struct(kind, subjects, actions, objects, limits, consequences, references). Each rule
check is a projection that yields issue structs; a unit's issues are the concatenation, exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid.functions import text as T

#: What a rule of some kind must have.
ROLE_OF_KIND = {"审批": "审批主体", "责任": "责任主体", "许可": "权利主体"}
PENALTY = "处罚"
UNREVIEWED, REVIEWED = "requires_independent_human_review", "human_reviewed"
STATUSES = (UNREVIEWED, "in_progress", REVIEWED)
#: Shape of answers for reading JSON.
ANSWER = (
    "name string, clause string, rules array<struct<kind:string,subjects:array<struct<name:string,aliases:array<string>,role:string>>,actions:array<struct<name:string,type:string>>,"
    "objects:array<struct<name:string,type:string>>,limits:array<struct<type:string,text:string,origin:string,topic:string>>,"
    "consequences:array<struct<trigger:string,type:string,measure:string,target:string,actor:string>>,references:array<struct<target:string,type:string,number:string>>>>"
)
_ISSUE = "struct<code:string,path:string>"
_FAMILIES = {"subjects": "name", "actions": "name", "objects": "name", "limits": "text", "references": "target"}
_LEAVES = {"subjects": ("name",), "actions": ("name",), "objects": ("name",), "limits": ("text", "topic"), "consequences": ("trigger", "measure", "target", "actor"), "references": ("target", "number")}


def _issue(code: str, path: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), path.alias("path"))


def _one(bad: Column, code: str, path: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(_issue(code, F.lit(path)))).otherwise(F.array().cast(f"array<{_ISSUE}>"))


def _per_rule(build) -> Column:
    rules = F.coalesce(F.col("answer.rules"), F.array().cast(f"array<{_rule_type()}>"))
    return F.flatten(F.transform(rules, build))


def _rule_type() -> str:
    return ANSWER[ANSWER.index("array<struct<kind") + len("array<"):-1]


def _repeated(family: str, key: str, put, at):
    """Check of a rule: values of a family that occur twice once normalised."""

    def build(r: Column, i: Column) -> Column:
        names = F.transform(F.filter(r[family], lambda x: F.coalesce(x[key], F.lit("")) != ""), lambda x: T.normalized_span(x[key]))
        return put(F.size(names) > F.size(F.array_distinct(names)), "duplicate_entity", at(i, family))

    return build


def _each(code: str, family: str, field: str, bad, at, no: Column):
    """Check of a rule: one issue for each member of a family whose field is bad."""

    def build(r: Column, i: Column) -> Column:
        members = F.transform(r[family], lambda x, k: F.struct(x[field].alias("v"), k.alias("k")))
        found = F.filter(members, lambda x: bad(x["v"]))
        return F.coalesce(F.transform(found, lambda x: _issue(code, F.concat(at(i, family), F.lit("."), x["k"].cast("string"), F.lit("." + field)))), no)

    return build


def _not_in(allowed: tuple[str, ...]):
    return lambda v: v.isNotNull() & ~v.isin(*allowed)


def answer_issues(vocabularies: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The issues of a unit's answer as an array, from the unit's columns and ``_e``, its normalised input_text."""
    grounded = lambda v: (F.coalesce(v, F.lit("")) == "") | F.contains(F.col("_e"), T.normalized_span(v))
    no = F.array().cast(f"array<{_ISSUE}>")
    put = lambda bad, code, path: F.when(F.coalesce(bad, F.lit(False)), F.array(_issue(code, path))).otherwise(no)
    at = lambda i, name: F.concat(F.lit("rules."), i.cast("string"), F.lit("." + name))
    empty = lambda a: F.coalesce(F.size(a), F.lit(0)) <= 0
    parts = [
        _one(~F.col("answer.name").eqNullSafe(F.col("document_name")), "document_name", "answer.name"),
        _one(~F.col("answer.clause").eqNullSafe(F.col("input_text")), "clause_text", "answer.clause"),
        _per_rule(lambda r, i: put(empty(r["actions"]), "missing_action", at(i, "actions"))),
        _per_rule(lambda r, i: put((r["kind"] == PENALTY) & empty(r["consequences"]), "missing_consequence", at(i, "consequences"))),
        _per_rule(lambda r, i: put(
            F.when(r["kind"].isin(*ROLE_OF_KIND), ~((r["kind"] == "许可") & empty(r["subjects"])) & ~F.exists(F.coalesce(r["subjects"], F.array()), lambda s: F.coalesce(s["role"] == _role(r["kind"]), F.lit(False)))),
            "subject_role", at(i, "subjects"))),
    ]
    for family, key in _FAMILIES.items():
        parts.append(_per_rule(_repeated(family, key, put, at)))
    for family, fields in _LEAVES.items():
        for field in fields:
            parts.append(_per_rule(_each("evidence_span", family, field, lambda v: ~grounded(v), at, no)))
    if vocabularies:
        kinds = vocabularies.get("kind")
        if kinds:
            parts.append(_per_rule(lambda r, i: put(r["kind"].isNotNull() & ~r["kind"].isin(*kinds), "controlled_value", at(i, "kind"))))
        for name, (family, field) in {"role": ("subjects", "role"), "action_type": ("actions", "type"), "object_type": ("objects", "type"), "limit_type": ("limits", "type"), "origin": ("limits", "origin"),
                                      "consequence_type": ("consequences", "type"), "reference_type": ("references", "type")}.items():
            allowed = vocabularies.get(name)
            if allowed:
                parts.append(_per_rule(_each("controlled_value", family, field, _not_in(allowed), at, no)))
    return F.concat(*parts)


def source_issues(units: DataFrame, sources: DataFrame) -> DataFrame:
    """The issue rows of units against the files they come from."""
    s = sources.select("source_markdown", F.col("sha256").alias("_h"), T.normalized_span(F.regexp_replace("text", r"(?m)^\s*(---|\d+)\s*$", "")).alias("_t"), F.lit(True).alias("_s"))
    both = units.join(s, "source_markdown", "left")
    have = F.coalesce(F.col("_s"), F.lit(False))
    absent = lambda c: ~F.contains(F.col("_t"), T.normalized_span(F.col(c)))
    tests = F.concat(
        _one(~have, "source_path", "source_markdown"), _one(have & ~F.col("_h").eqNullSafe(F.col("source_sha256")), "source_hash", "source_sha256"),
        _one(have & absent("source_text"), "source_text_grounding", "source_text"), _one(have & absent("document_name"), "document_name_grounding", "document_name"),
    )
    return _rows(both, tests)


def _rows(units: DataFrame, found: Column) -> DataFrame:
    return units.select("unit_id", F.explode(found).alias("i")).select("unit_id", F.lit("error").alias("severity"), "i.code", "i.path")


def issues(units: DataFrame, sources: DataFrame | None = None, vocabularies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(unit_id, severity, code, path). ``sources`` has source_markdown, sha256 and text of the files that exist; without it files are not tested.

    ``vocabularies`` gives the allowed values of kind, role, action_type, object_type, limit_type, origin, consequence_type, reference_type.
    """
    found = _rows(units.withColumn("_e", T.normalized_span(F.col("input_text"))), answer_issues(vocabularies))
    return found if sources is None else found.unionByName(source_issues(units, sources))


def _role(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLE_OF_KIND.items() for x in kv]), kind)


def shape_issues(raw: Column, keys: tuple[str, ...], path: str) -> Column:
    """Missing and extra keys of a JSON object text against a list of keys, as an array of issues; schema_type if it is no object."""
    have = F.json_object_keys(raw)
    want = F.array(*map(F.lit, sorted(keys)))
    named = lambda code, a: F.transform(F.array_sort(a), lambda k: _issue(code, F.concat(F.lit(path + "."), k)))
    return F.when(have.isNull(), F.array(_issue("schema_type", F.lit(path)))).otherwise(F.concat(named("schema_missing", F.array_except(want, have)), named("schema_extra", F.array_except(have, want))))


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def status_of(c: Column) -> Column:
    return F.coalesce(T.filled(c), F.lit(UNREVIEWED))


def summary(units: DataFrame, found: DataFrame) -> DataFrame:
    """Per document: units, reviewed units, rules, units with errors."""
    bad = found.select("unit_id").distinct().withColumn("bad", F.lit(True))
    both = units.join(bad, "unit_id", "left")
    return both.groupBy("document_id").agg(
        F.min("document_name").alias("document_name"), F.count(F.lit(1)).alias("unit_count"),
        F.count_if(F.col("review_status") == REVIEWED).alias("reviewed_count"), F.sum(F.greatest(F.size("answer.rules"), F.lit(0))).alias("rule_count"), F.count_if("bad").alias("invalid_count"),
    )


def list_units(units: DataFrame, document_id: str = "", status: str = "", query: str = "") -> DataFrame:
    """Units by document, status and a search over number, name and text; with a preview of 140 characters."""
    out = units.withColumn("status", status_of(F.col("review_status")))
    if document_id:
        out = out.where(F.col("document_id") == document_id)
    if status:
        out = out.where(F.col("status") == status)
    if query.strip():
        out = out.where(F.lower(F.concat_ws(" ", "unit_id", "unit_number", "document_name", "input_text")).contains(query.strip().lower()))
    return out.select("unit_id", "document_id", "status", F.substring("input_text", 1, 140).alias("preview"), F.greatest(F.size("answer.rules"), F.lit(0)).alias("rule_count"))


def reviewed(units: DataFrame, edits: DataFrame, revision: str, current: str, found: DataFrame) -> DataFrame:
    """Units after edits (unit_id, review_status, reviewer): refused as a whole if the revision is stale; a unit with errors can't become reviewed."""
    if revision != current:
        raise ValueError("the data changed since it was read")
    e = edits.select("unit_id", F.col("review_status").alias("_s"), F.col("reviewer").alias("_r"))
    bad = found.select("unit_id").distinct().withColumn("_bad", F.lit(True))
    both = units.join(e, "unit_id", "left").join(bad, "unit_id", "left")
    taken = F.col("_s").isin(*STATUSES) & ~((F.col("_s") == REVIEWED) & F.coalesce(F.col("_bad"), F.lit(False)))
    return both.withColumns({"review_status": F.when(F.coalesce(taken, F.lit(False)), F.col("_s")).otherwise(F.col("review_status")), "refused": F.col("_s").isNotNull() & ~F.coalesce(taken, F.lit(False))}).drop("_s", "_r", "_bad")


def guarded_reviews(units: DataFrame, edits: DataFrame, found: DataFrame) -> DataFrame:
    """Units after edits that each carry the revision of the unit their editor saw (unit_id, review_status, reviewer, revision).

    ``units`` has the current ``revision``. An edit of another revision is stale and refused, as is a review of a unit with errors; ``outcome``
    is saved, stale, invalid or untouched.
    """
    e = edits.select("unit_id", F.col("review_status").alias("_s"), F.col("reviewer").alias("_r"), F.col("revision").alias("_v"))
    bad = found.select("unit_id").distinct().withColumn("_bad", F.lit(True))
    both = units.join(e, "unit_id", "left").join(bad, "unit_id", "left")
    refused = ~F.col("_s").isin(*STATUSES) | ((F.col("_s") == REVIEWED) & F.coalesce(F.col("_bad"), F.lit(False)))
    outcome = F.when(F.col("_s").isNull(), "untouched").when(~F.col("_v").eqNullSafe(F.col("revision")), "stale").when(refused, "invalid").otherwise("saved")
    both = both.withColumn("outcome", outcome)
    return both.withColumn("review_status", F.when(F.col("outcome") == "saved", F.col("_s")).otherwise(F.col("review_status"))).drop("_s", "_r", "_v", "_bad")
