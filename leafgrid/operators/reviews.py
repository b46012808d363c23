"""Gold review as transactions: edits of units are validated, recorded in the unit's history and committed as one version.

An edit has unit_id, seq (order among the edits of a batch), answer, adjudication_notes (null: those of the unit), review_status (empty: that of
the unit, else in_progress), reviewer, review_note and expected_revision. Outcomes, first that holds: ``stale`` (a revision is expected that is not the
current one; without one the lock is skipped), ``missing_unit``, ``missing_answer``, ``invalid_status``, ``invalid`` (to be reviewed, but the *edited* unit
has issues), ``saved``.

Units are written once, as they were created; a commit writes what edits have made of the units they saved, and readers join both. Of texts that are
the same as a unit's input_text (its source_text, the clause of an answer) only the first is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafgrid.functions import text as T
from leafgrid.functions.geometry import let
from leafgrid.operators import quality as Q
from leafgrid.sources.shared import checkpointed
from leafgrid.sources.versions import Conflict, VersionedTable

HISTORY = "array<struct<reviewer:string,reviewed_at:string,status:string,note:string,previous_revision:string>>"
ANSWER = f"struct<name:string,clause:string,rules:{Q.ANSWER[Q.ANSWER.index('array<') :]}>"
EDIT = f"unit_id long, seq int, answer {ANSWER}, adjudication_notes array<string>, review_status string, reviewer string, review_note string, expected_revision string"
UNIT = (
    "unit_id long, document_id string, document_name string, unit_number string, input_text string, source_text string, source_markdown string, source_sha256 string, review_status string, "
    f"answer {ANSWER}, adjudication_notes array<string>, reviewed_by string, reviewed_at string, review_history {HISTORY}"
)
_CHANGED = ("answer", "adjudication_notes", "review_status", "reviewed_by", "reviewed_at", "review_history")
_TEXTS = ("input_text", "source_text")
#: Units as created: a number for each row, which tells units of one id apart, and whether a text is that of input_text.
_CREATED = UNIT + ", _row long, _same_source boolean, _same_clause boolean"
_EDITED = f"unit_id long, _row long, _same_clause boolean, answer {ANSWER}, adjudication_notes array<string>, review_status string, reviewed_by string, reviewed_at string, review_history {HISTORY}"


def _same(text: Column, unit_text: Column) -> Column:
    return F.coalesce(text == unit_text, F.lit(False))


def _without(same: Column, answer: Column) -> Column:
    """The answer as it is written: without its clause if that is the unit's text."""
    return F.when(same, answer.withField("clause", F.lit(None).cast("string"))).otherwise(answer)


def with_open(edits: DataFrame, revision: str) -> DataFrame:
    """Edits with ``_open``: whether they may be saved, as far as they say themselves. Only these need their answer and their unit's texts."""
    expects, status = F.coalesce("expected_revision", F.lit("")), T.filled(F.col("review_status"))
    return edits.withColumn("_open", ((expects == "") | (expects == revision)) & F.col("answer").isNotNull() & (status.isNull() | status.isin(*Q.STATUSES)))


def apply_edits(units: DataFrame, edits: DataFrame, revision: str, now: str, sources: DataFrame | None = None, vocabularies: dict[str, tuple[str, ...]] | None = None) -> tuple[DataFrame, DataFrame]:
    """The units that edits change, as they are written, and (unit_id, seq, outcome) of every edit.

    Units have a ``_row``, edits are those of ``with_open``. Edits of one unit follow each other by ``seq``: a later one sees what an earlier one saved, and
    is stale if it expects a revision. The work on a unit is as long as its history; units are independent. Edits and units meet once, and their texts stay
    behind there.
    """
    only = lambda c: F.when(F.col("_open"), F.col(c)).alias(c)
    asked = edits.select("unit_id", "_open", F.col("answer").isNull().alias("_unanswered"), only("answer"), F.struct("seq", only("adjudication_notes"), "review_status", "reviewer", "review_note", "expected_revision").alias("_edit"))
    both = asked.join(units.drop("answer"), "unit_id", "left")
    checked = F.col("_open") & F.col("_row").isNotNull() & (F.coalesce(T.filled(F.col("_edit.review_status")), F.lit(Q.REVIEWED)) == Q.REVIEWED)
    both = both.withColumn("_checked", checked).withColumn("_e", F.when(F.col("_checked"), T.normalized_span(F.col("input_text"))))
    bad = F.size(Q.answer_issues(vocabularies)) > 0
    if sources is not None:
        named = edits.where("_open").select("unit_id").distinct()
        both = both.join(Q.source_issues(units.join(named, "unit_id", "left_semi"), sources).select("unit_id").distinct().withColumn("_astray", F.lit(True)), "unit_id", "left")
        bad = F.coalesce(bad, F.lit(False)) | F.col("_astray").isNotNull()
    same = _same(F.col("answer.clause"), F.col("input_text"))
    one = F.struct("_edit.*", "_unanswered", same.alias("same"), _without(same, F.col("answer")).alias("answer"), F.coalesce(F.when(F.col("_checked"), bad), F.lit(False)).alias("bad"))
    # Edits of unknown units need no common fold, and those without an id may be many.
    per = both.groupBy("unit_id", "_row", F.when(F.col("_row").isNull(), F.col("_edit.seq"))).agg(F.first(F.struct(*_CHANGED[1:])).alias("_unit"), F.collect_list(one).alias("_edits"))
    order = lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)
    start = F.struct(
        F.lit(False).alias("_same_clause"), F.lit(None).cast(ANSWER).alias("answer"), *[F.col(f"_unit.{c}").alias(c) for c in _CHANGED[1:5]], F.coalesce("_unit.review_history", F.array().cast(HISTORY)).alias("review_history"),
        F.lit(False).alias("saved"), F.array().cast("array<struct<seq:int,outcome:string>>").alias("out"),
    )

    def step(acc: Column, e: Column) -> Column:
        stale = (F.coalesce(e["expected_revision"], F.lit("")) != "") & (acc["saved"] | (e["expected_revision"] != revision))
        status = F.coalesce(T.filled(e["review_status"]), T.filled(acc["review_status"]), F.lit("in_progress"))

        def judged(s: Column) -> Column:
            said = (
                F.when(stale, "stale").when(F.col("_row").isNull(), "missing_unit").when(e["_unanswered"], "missing_answer").when(~s.isin(*Q.STATUSES), "invalid_status")
                .when((s == Q.REVIEWED) & e["bad"], "invalid").otherwise("saved")
            )
            return let(said, lambda o: moved(s, o))

        def moved(s: Column, o: Column) -> Column:
            reviewer = F.coalesce(T.filled(F.trim(e["reviewer"])), F.lit("independent_human"))
            entry = F.struct(
                reviewer.alias("reviewer"), F.lit(now).alias("reviewed_at"), s.alias("status"), F.trim(F.coalesce(e["review_note"], F.lit(""))).alias("note"), F.lit(revision).alias("previous_revision")
            )
            ok = o == "saved"
            pick = lambda new, name: F.when(ok, new).otherwise(acc[name]).alias(name)
            return F.struct(
                pick(e["same"], "_same_clause"), pick(e["answer"], "answer"), pick(F.coalesce(e["adjudication_notes"], acc["adjudication_notes"]), "adjudication_notes"), pick(s, "review_status"), pick(reviewer, "reviewed_by"),
                pick(F.lit(now), "reviewed_at"), pick(F.array_append(acc["review_history"], entry), "review_history"), (acc["saved"] | ok).alias("saved"),
                F.array_append(acc["out"], F.struct(e["seq"].alias("seq"), o.alias("outcome"))).alias("out"),
            )

        return let(status, judged)

    folded = per.withColumn("_after", F.aggregate(F.array_sort("_edits", order), start, step))
    new = ("_same_clause", *_CHANGED)
    folded = checkpointed(folded.select("unit_id", "_row", F.when(F.col("_after.saved"), F.struct(*[F.col(f"_after.{c}").alias(c) for c in new])).alias("_new"), F.col("_after.out").alias("_out")))
    changed = folded.where("_new is not null").select("unit_id", "_row", *[F.col(f"_new.{c}").alias(c) for c in new])
    return changed, folded.select("unit_id", F.explode("_out").alias("o")).select("unit_id", "o.seq", "o.outcome")


class GoldStore:
    """Units in versions. ``save`` is all edits of a batch or none; of two batches that were read at one revision, the second is stale or, without an
    expected revision, made anew on what the first one left. The version before stays readable as the backup."""

    def __init__(self, spark: SparkSession, folder: str, vocabularies: dict[str, tuple[str, ...]] | None = None, sources: DataFrame | None = None, buckets: int = 16) -> None:
        self.table = VersionedTable(spark, folder, _EDITED, ["unit_id"], buckets)
        self.created = VersionedTable(spark, f"{self.table.folder}/units", _CREATED, ["unit_id"], buckets)
        self.sources, self.vocabularies = sources, vocabularies

    @property
    def revision(self) -> str:
        return self.table.entry()["revision"]

    def create(self, units: DataFrame) -> int:
        if self.table.version >= 0:
            raise Conflict("the store exists")
        rows = units.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(UNIT)])
        rows = rows.withColumns({"_row": F.monotonically_increasing_id(), "_same_source": _same(F.col("source_text"), F.col("input_text")), "_same_clause": _same(F.col("answer.clause"), F.col("input_text"))})
        rows = rows.withColumns({"source_text": F.when(~F.col("_same_source"), F.col("source_text")), "answer": _without(F.col("_same_clause"), F.col("answer"))})
        every = list(range(self.table.buckets))
        # Units that no log entry of the store names (the one below failed) are seen by no reader.
        at = self.created.commit(rows, every, self.created.version, alone=True)
        return self.table.commit(self.table.read(-1), every, -1, {"by": "create", "units": at}, alone=True)

    def units(self, version: int | None = None) -> DataFrame:
        return self._units(self.table.entry(version)).select(StructType.fromDDL(UNIT).names)

    def _units(self, entry: dict, buckets: list[int] | None = None, bare: list[int] | None = None) -> DataFrame:
        """The units of all buckets or of the given ones, and those of ``bare`` without their texts."""
        at = entry["info"]["units"] if entry["version"] >= 0 else -1
        rows, edited = self.created.read(at, buckets), self.table.read(entry["version"], None if buckets is None else buckets + bare)
        if bare:
            rows = rows.unionByName(self.created.read(at, bare).withColumns({c: F.lit(None).cast("string") for c in _TEXTS}))
        if entry["buckets"]:
            new = edited.select("unit_id", F.struct("_row", "_same_clause", *_CHANGED).alias("_new"))
            # Rows meet by id only: no key besides it that what follows would have to be shuffled for.
            rows = rows.join(new, (rows["unit_id"] == new["unit_id"]) & (rows["_row"] - new["_new._row"] == 0), "left").drop(new["unit_id"])
            rows = rows.withColumns({c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in ("_same_clause", *_CHANGED)})
        text, answer = F.col("input_text"), F.col("answer")
        return rows.withColumns({"source_text": F.when(F.col("_same_source"), text).otherwise(F.col("source_text")), "answer": F.when(F.col("_same_clause"), answer.withField("clause", text)).otherwise(answer)})

    def save(self, edits: DataFrame, now: str, pause: Callable[[], None] = lambda: None) -> tuple[int, DataFrame]:
        """The version after the batch, and the outcome of each edit. ``pause`` runs before each commit (for tests of concurrent batches)."""
        while True:
            base = self.table.entry()
            said = with_open(edits, base["revision"])
            named = dict(said.groupBy(self.table.bucket()).agg(F.max("_open")).collect())  # at most ``buckets`` rows
            touched, others = sorted(b for b, o in named.items() if o), sorted(b for b, o in named.items() if not o)
            changed, outcomes = apply_edits(self._units(base, touched, others), said, base["revision"], now, self.sources, self.vocabularies)
            if changed.isEmpty():
                return base["version"], outcomes
            rows = self.table.read(base["version"], touched).join(changed, ["unit_id", "_row"], "left_anti").select(changed.columns).unionByName(changed)
            pause()
            try:
                return self.table.commit(rows, touched, base["version"], {"by": "review", "backup": base["version"], "units": base["info"]["units"]}, alone=True), outcomes
            except Conflict:
                continue
