"""Tables in versions: commits, conflicts, failures, as-of reads; and gold review on top of them."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from leafgrid.operators import quality as Q
from leafgrid.operators import reviews as W
from leafgrid.sources import versions as V

SCHEMA = "k long, n int, s string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def table(spark, tmp_path, **options):
    return V.VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], **options)


def batch(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_commits_equal_a_dictionary(spark, tmp_path):
    rnd, t, now, past = random.Random(1), table(spark, tmp_path, buckets=8), {}, []
    assert t.version == -1 and rows(t.read()) == []
    for step in range(6):
        new = {rnd.randrange(30): (rnd.randrange(100), rnd.choice("ab")) for _ in range(8)}
        if step % 3 == 2:
            t.delete(spark.createDataFrame([(k,) for k in new], "k long"))
            now = {k: v for k, v in now.items() if k not in new}
        else:
            t.upsert(batch(spark, *[(k, *v) for k, v in new.items()]))
            now = now | new
        past.append(sorted(((k, *v) for k, v in now.items()), key=str))
    again = table(spark, tmp_path, buckets=8)  # a new object finds the last version
    assert again.version == 5 and rows(again.read()) == past[-1]
    assert [rows(again.read(v)) for v in range(6)] == past
    some = past[-1][0]
    assert rows(again.lookup(some[0])) == [some] and again.lookup(-5).count() == 0
    assert again.vacuum(keep=1) > 0 and rows(again.read()) == past[-1] and len(again.history()) == 1


def test_small_batches_touch_few_buckets(spark, tmp_path):
    t = table(spark, tmp_path, buckets=64)
    t.upsert(spark.range(5000).select(F.col("id").alias("k"), F.lit(0).alias("n"), F.lit("x").alias("s")))
    t.upsert(batch(spark, *[(k, 1, "y") for k in range(10)]))
    before, after = t.history()
    changed = {b for b, txn in after["buckets"].items() if before["buckets"].get(b) != txn}
    assert len(changed) <= 10 and t.read().where("n = 1").count() == 10 and t.read().count() == 5000
    # A lookup plans one bucket's files.
    assert len(t.lookup(7).inputFiles()) == 1


def test_order_decides_between_old_and_new(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(batch(spark, (1, 5, "old"), (1, 4, "older"), (2, 1, "old")), order=["n"])
    t.upsert(batch(spark, (1, 3, "late"), (2, 2, "new"), (3, 0, "first")), order=["n"])
    assert rows(t.read()) == [(1, 5, "old"), (2, 2, "new"), (3, 0, "first")]


def test_replayed_batches_change_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(batch(spark, (1, 1, "a")), stream=("s", 0))
    assert t.upsert(batch(spark, (1, 2, "b")), stream=("s", 0)) == 0
    assert t.upsert(batch(spark, (1, 3, "c")), stream=("other", 0)) == 1
    assert rows(t.read()) == [(1, 3, "c")]


def test_failed_writes_leave_the_old_version(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(batch(spark, (1, 1, "a"), (2, 2, "b")))
    broken = batch(spark, (1, 9, "z"), (2, 9, "z")).withColumn("s", F.when(F.col("k") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("s")))
    with pytest.raises(Exception, match="no"):
        t.upsert(broken)
    assert t.version == 0 and rows(t.read()) == [(1, 1, "a"), (2, 2, "b")]
    folder = f"file://{tmp_path}/whole"
    V.switched(batch(spark, (1, None, "a")), folder)
    with pytest.raises(Exception, match="no"):
        V.switched(broken, folder)
    assert rows(V.read_switched(spark, folder, SCHEMA)) == [(1, None, "a")]
    assert V.switched(batch(spark, (2, 2, "b")), folder) == 1 and rows(V.read_switched(spark, folder, SCHEMA, 0)) == [(1, None, "a")]


def test_concurrent_commits(spark, tmp_path):
    t = table(spark, tmp_path, buckets=4)
    t.upsert(batch(spark, *[(k, 0, "x") for k in range(40)]))
    at = {k: r for k, r in t.read().select("k", t.bucket()).collect()}
    one, other = next(k for k in at if at[k] == 0), next(k for k in at if at[k] == 1)
    base = t.version
    keep = lambda k, n: t.read(base, [at[k]]).withColumn("n", F.when(F.col("k") == k, n).otherwise(F.col("n")))
    t.commit(keep(one, 1), [at[one]], base)
    assert t.commit(keep(other, 2), [at[other]], base) == base + 2  # other buckets: both are kept
    with pytest.raises(V.Conflict):
        t.commit(keep(one, 3), [at[one]], base)
    with pytest.raises(V.Conflict):
        t.commit(keep(other, 3), [at[other]], base + 1, alone=True)
    assert {r["k"]: r["n"] for r in t.read().where("n > 0").collect()} == {one: 1, other: 2}
    with pytest.raises(V.Conflict):
        t.log.put(f"{0:020d}.json", "{}")


def test_log_in_a_store_that_only_spark_reaches(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.versions.link./in", f"file://{tmp_path}")
    t = V.VersionedTable(spark, "viewfs://versions/in/t", SCHEMA, ["k"])
    t.upsert(batch(spark, (1, 1, "a")))
    t.upsert(batch(spark, (1, 2, "b")))
    assert rows(t.read()) == [(1, 2, "b")] and rows(t.read(0)) == [(1, 1, "a")]
    with pytest.raises(V.Conflict):
        t.log.put(f"{1:020d}.json", "{}")
    assert t.vacuum(keep=1) == 1 and rows(t.read()) == [(1, 2, "b")]


# --- gold review -------------------------------------------------------------------------------------------------------


def unit(i, **more):
    answer = more.pop("answer", (f"d{i}", "text a", [("审批", [("a", [], "审批主体")], [("text", "做")], None, None, None, None)]))
    return (i, "doc", f"d{i}", str(i), "text a", "text a", "/s", "h", more.pop("status", None), answer, more.pop("notes", None), None, None, more.pop("history", None))


def edit(i, seq=1, answer="good", status="human_reviewed", expected="", reviewer="me", notes=None, note=" n "):
    said = {"good": (f"d{i}", "text a", []), "bad": ("other", "text a", []), None: None}[answer]
    return (i, seq, said, notes, status, reviewer, note, expected)


def store(spark, tmp_path, *units):
    s = W.GoldStore(spark, f"file://{tmp_path}/gold", buckets=4)
    s.create(spark.createDataFrame(list(units), W.UNIT))
    return s


def edits(spark, *some):
    return spark.createDataFrame(list(some), W.EDIT)


def said(outcomes):
    return {(r["unit_id"], r["seq"]): r["outcome"] for r in outcomes.collect()}


def test_edits_equal_one_by_one_updates(spark, tmp_path):
    """A batch equals a loop over its edits, unit by unit, that validates each edited unit."""
    rnd = random.Random(5)
    units = [unit(i, status=rnd.choice([None, "", "in_progress"]), history=rnd.choice([None, [("r", "t", "in_progress", "", "x")]])) for i in range(20)]
    s = store(spark, tmp_path, *units)
    revision = s.revision
    some = [edit(rnd.randrange(24), n, rnd.choice(["good", "bad", None]), rnd.choice(["human_reviewed", "in_progress", "", None, "odd"]), rnd.choice(["", revision, "gone", None]), rnd.choice(["me", "", None]), rnd.choice([None, ["x"]])) for n in range(60)]
    _, outcomes = s.save(edits(spark, *some), "now")
    have = {u[0]: {"status": u[8], "notes": u[10], "answer": u[9], "by": None, "history": [tuple(h) for h in u[13] or []]} for u in units}
    want, touched = {}, set()
    for i, seq, answer, notes, status, reviewer, note, expected in sorted(some, key=lambda e: e[1]):
        u = have.get(i)
        if expected and (expected != revision or i in touched):
            want[i, seq] = "stale"
        elif u is None:
            want[i, seq] = "missing_unit"
        elif answer is None:
            want[i, seq] = "missing_answer"
        else:
            asked = status or u["status"] or "in_progress"
            if asked not in ("requires_independent_human_review", "in_progress", "human_reviewed"):
                want[i, seq] = "invalid_status"
            elif asked == "human_reviewed" and answer[0] != f"d{i}":
                want[i, seq] = "invalid"
            else:
                want[i, seq] = "saved"
                touched.add(i)
                by = reviewer or "independent_human"
                u.update(status=asked, answer=answer, by=by, notes=notes if notes is not None else u["notes"])
                u["history"].append((by, "now", asked, "n", revision))
    assert said(outcomes) == want and set(want.values()) >= {"saved", "stale", "invalid", "missing_unit", "missing_answer", "invalid_status"}
    got = {r["unit_id"]: r for r in s.units().collect()}
    assert len(got) == 20
    for i, u in have.items():
        r = got[i]
        assert (r["review_status"], r["adjudication_notes"], r["reviewed_by"], r["answer"]["name"]) == (u["status"], u["notes"], u["by"], u["answer"][0])
        assert [tuple(h) for h in r["review_history"] or []] == u["history"]
    # The backup: the version before is as it was.
    assert {r["reviewed_by"] for r in s.units(0).collect()} == {None}
    found = Q.issues(s.units()).select("unit_id").distinct().collect()
    assert {r[0] for r in found} <= {i for i, u in have.items() if u["status"] != "human_reviewed"}


def test_of_two_concurrent_batches_one_is_refused(spark, tmp_path):
    s = store(spark, tmp_path, unit(1), unit(2))
    revision, meet, out = s.revision, threading.Barrier(2), {}

    def work(name, i):
        waits = iter([lambda: meet.wait(timeout=120)])  # only before the first commit
        own = W.GoldStore(spark, s.table.folder, buckets=4)
        out[name] = said(own.save(edits(spark, edit(i, expected=revision, reviewer=name)), name, pause=lambda: next(waits, lambda: None)())[1])

    threads = [threading.Thread(target=work, args=(n, i)) for n, i in (("a", 1), ("b", 2))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(x for o in out.values() for x in o.values()) == ["saved", "stale"] and s.table.version == 1
    winner = "a" if out["a"] == {(1, 1): "saved"} else "b"
    assert [r["reviewed_by"] for r in s.units().where("reviewed_by is not null").collect()] == [winner]


def test_concurrent_batches_without_a_revision_follow_each_other(spark, tmp_path):
    s = store(spark, tmp_path, unit(1))
    inner = W.GoldStore(spark, s.table.folder, buckets=4)
    done = []

    def first():
        if not done:
            done.append(inner.save(edits(spark, edit(1, reviewer="b")), "t1"))

    version, outcomes = s.save(edits(spark, edit(1, reviewer="a")), "t2", pause=first)
    assert version == 2 and said(outcomes) == {(1, 1): "saved"}
    assert [h["reviewer"] for h in s.units().first()["review_history"]] == ["b", "a"]


def test_batches_without_a_saved_edit_make_no_version(spark, tmp_path):
    s = store(spark, tmp_path, unit(1))
    version, outcomes = s.save(edits(spark, edit(1, answer="bad"), edit(9)), "now")
    assert version == 0 and said(outcomes) == {(1, 1): "invalid", (9, 1): "missing_unit"}
    assert s.save(edits(spark), "now")[0] == 0


def bytes_under(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_texts_are_written_once(spark, tmp_path):
    """A store of units whose source and clause are their text is as large as the text, and commits don't write it again."""
    texts = [random.Random(i).randbytes(4000).hex() for i in range(60)]
    size = sum(len(t) for t in texts) / 2  # hexadecimal digits: half a byte each
    units = [unit(i)[:4] + (t, t, "/s", "h", None, (f"d{i}", t, [])) + (None,) * 4 for i, t in enumerate(texts)]
    s = store(spark, tmp_path, *units)
    created = bytes_under(tmp_path / "gold")
    given = [(i, 1, (f"d{i}", t, []), None, "human_reviewed", "me", "n", "") for i, t in enumerate(texts)]
    _, outcomes = s.save(edits(spark, *given), "now")
    assert set(said(outcomes).values()) == {"saved"} and len(said(outcomes)) == 60
    assert created < 2.6 * size and bytes_under(tmp_path / "gold") - created < 0.5 * size  # uncompressed digits are 2 x size
    after = {r["unit_id"]: (r["input_text"], r["source_text"], r["answer"]["clause"], r["review_status"]) for r in s.units().collect()}
    assert after == {i: (t, t, t, "human_reviewed") for i, t in enumerate(texts)}


def test_odd_units_stay_as_they_are(spark, tmp_path):
    """Rows without an id, of one id, without texts or answers, and clauses that are not the unit's text; before and after a commit."""
    some = [unit(1), unit(None), unit(None, status="in_progress"), unit(2, answer=None), unit(3, answer=("d3", None, None)), unit(4, answer=("d4", "other", [])), unit(5)[:4] + (None, None) + unit(5)[6:], unit(6)[:5] + (None,) + unit(6)[6:], unit(6)[:4] + ("b", "c") + unit(6)[6:], unit(7)]
    s = store(spark, tmp_path, *some)
    given = rows(spark.createDataFrame(some, W.UNIT))
    assert rows(s.units()) == given
    s.save(edits(spark, edit(7, status="in_progress"), edit(None), (6, 1, ("d6", "b", []), None, "in_progress", "me", "", "")), "now")
    assert rows(s.units(0)) == given
    same = lambda t: [r for r in t if r[0] not in (6, 7)]
    assert same(rows(s.units())) == same(given) and len(rows(s.units())) == len(given)
    assert sorted((r["input_text"], r["source_text"], r["answer"]["clause"]) for r in s.units().where("unit_id = 6").collect() if r["source_text"]) == [("b", "c", "b")]
    assert {(r["answer"]["clause"], len(r["review_history"])) for r in s.units().where("unit_id = 6").collect()} == {("b", 1)}
    s.table.vacuum(keep=1)
    assert len(rows(s.units())) == len(given) and s.units().where("reviewed_by = 'me'").count() == 3


def test_edits_that_cannot_be_saved_read_no_texts(spark, tmp_path, monkeypatch):
    s, seen = store(spark, tmp_path, unit(1), unit(2)), []
    apply = W.apply_edits
    monkeypatch.setattr(W, "apply_edits", lambda units, *a: (seen.append([r["input_text"] for r in units.collect()]), apply(units, *a))[1])
    version, outcomes = s.save(edits(spark, edit(1, expected="gone"), edit(1, 2, answer=None), edit(2, status="odd"), edit(9)), "now")
    assert version == 0 and said(outcomes) == {(1, 1): "stale", (1, 2): "missing_answer", (2, 1): "invalid_status", (9, 1): "missing_unit"}
    touched = s.created.read().where(s.table.bucket() == spark.createDataFrame([(9,)], "unit_id long").select(s.table.bucket()).first()[0]).count()
    assert sum(t is not None for t in seen[0]) == touched  # the edit of the unknown unit is open, so its bucket is read whole


def test_units_are_tested_against_their_files(spark, tmp_path):
    files = spark.createDataFrame([("/s", "h", "d1 d2 text a")], "source_markdown string, sha256 string, text string")
    s = W.GoldStore(spark, f"file://{tmp_path}/gold", sources=files, buckets=4)
    s.create(spark.createDataFrame([unit(1), unit(2)[:6] + ("/gone",) + unit(2)[7:], unit(3)], W.UNIT))
    _, outcomes = s.save(edits(spark, *[edit(i, answer="good") for i in (1, 2, 3)]), "now")
    assert said(outcomes) == {(1, 1): "saved", (2, 1): "invalid", (3, 1): "invalid"}


def test_a_failed_create_can_be_made_again(spark, tmp_path):
    s = W.GoldStore(spark, f"file://{tmp_path}/gold", buckets=4)
    put, s.table.log.put = s.table.log.put, lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):
        s.create(spark.createDataFrame([unit(1)], W.UNIT))
    s.table.log.put = put
    assert s.units().count() == 0 and s.create(spark.createDataFrame([unit(2)], W.UNIT)) == 0
    assert [r["unit_id"] for r in s.units().collect()] == [2]
    with pytest.raises(V.Conflict):
        s.create(spark.createDataFrame([unit(3)], W.UNIT))
