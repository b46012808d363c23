"""Saved annotations and convert tasks in versions against plain folds."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from leafgrid.operators import annotations as A

START = datetime(2024, 1, 1)


def test_saves_equal_a_plain_store(spark, tmp_path):
    rnd, store = random.Random(2), A.AnnotationStore(spark, f"file://{tmp_path}/a", buckets=4)
    have, state, past, n = {}, {}, [], 0
    for _ in range(4):
        batch = []
        for _ in range(12):
            n += 1
            batch.append((rnd.choice("abcde"), rnd.choice(["draft", "overwrite", "submit", "other"]), f"p{n}", START + timedelta(seconds=n)))
        store.save(spark.createDataFrame(batch, "job_id string, mode string, pages string, saved_at timestamp"))
        for job, mode, pages, at in batch:
            name = {"draft": "draft", "overwrite": "first_annotation"}.get(mode, f"annotation_v2_{at:%Y%m%d_%H%M%S}")
            have.setdefault(job, {})[name] = pages
            second = state.get(job, (None, None))[1]
            state[job] = ({"draft": "second_annotating", "overwrite": "first_annotated"}.get(mode, "second_annotated"), at if mode in ("submit", "other") else second)
        want = {}
        for job, names in have.items():
            best = "draft" if "draft" in names else max((x for x in names if x.startswith("annotation_v2_")), default="first_annotation")
            want[job] = (best, names[best], *state[job])
        past.append(want)
    get = lambda v: {r["job_id"]: (r["active_version"], r["pages"], r["annotation_status"], r["second_annotated_at"]) for r in store.active(v).collect()}
    assert [get(v) for v in range(4)] == past and get(None) == past[-1]


def test_a_failed_save_leaves_all_as_it_was(spark, tmp_path):
    store = A.AnnotationStore(spark, f"file://{tmp_path}/a")
    saves = spark.createDataFrame([("a", "submit", "p", START), ("b", "draft", "q", START)], "job_id string, mode string, pages string, saved_at timestamp")
    store.save(saves)
    before = sorted(map(tuple, store.active().collect()))
    try:
        store.save(saves.withColumn("pages", F.when(F.col("job_id") == "b", F.raise_error(F.lit("no"))).otherwise("new")))
        raise AssertionError("the save should fail")
    except Exception as error:
        assert "no" in str(error)
    assert store.table.version == 0 and sorted(map(tuple, store.active().collect())) == before


def plain(events, now=None, patience=None, restarted=None):
    out = {}
    for task, _, at, status, fields in sorted({(e[0], e[1]): e for e in events}.values(), key=lambda e: (e[2], e[1])):
        s = out.setdefault(task, {"status": "", "fields": {}, "at": None, "refused": 0})
        if status is not None and status not in {"": ("converting", "failed"), "converting": ("converting", "success", "partial_success", "failed")}.get(s["status"], ()):
            s["refused"] += 1
            continue
        s["status"] = status if status is not None else s["status"]
        s["fields"] |= fields or {}
        s["at"] = at
    for s in out.values():
        gone = restarted is not None and s["at"] is not None and s["at"] < restarted
        if s["status"] == "converting" and (gone or (now is not None and s["at"] < now - patience)):
            s["status"] = "failed"
            s["fields"] = {k: v for k, v in s["fields"].items() if k not in ("message", "error")} | {"message": "转换任务已中断", "error": A.RESTARTED if gone else "timeout"}
    return {t: (s["status"], s["fields"], s["at"], s["refused"]) for t, s in out.items()}


def events(seed, n=120):
    rnd = random.Random(seed)
    kinds = ["converting", "converting", "success", "partial_success", "failed", None, "odd"]
    return [(f"t{rnd.randrange(15)}", k, START + timedelta(seconds=rnd.randrange(400)), rnd.choice(kinds), rnd.choice([None, {"message": f"m{k}"}, {"a": "1", "error": ""}, {}])) for k in range(n)]


def got(frame):
    return {r["task_id"]: (r["status"], r["fields"], r["at"], r["refused"]) for r in frame.collect()}


def test_task_events_out_of_order_and_repeated(spark, tmp_path):
    rnd, some = random.Random(6), events(7)
    log = A.TaskLog(spark, f"file://{tmp_path}/t", buckets=4)
    mixed = some + rnd.sample(some, 40)
    rnd.shuffle(mixed)
    for at in range(0, len(mixed), 40):
        log.append(spark.createDataFrame(mixed[at : at + 40], A.EVENT), stream=("events", at))
    log.append(spark.createDataFrame([("t0", 999, START, "odd", None)], A.EVENT), stream=("events", 0))  # a replayed batch
    assert got(log.states()) == plain(some)
    now, limit = START + timedelta(seconds=500), timedelta(seconds=200)
    assert got(log.states(now=F.lit(now), patience="200 seconds")) == plain(some, now, limit)
    restart = START + timedelta(seconds=300)
    assert got(log.states(restarted=F.lit(restart))) == plain(some, restarted=restart)
    assert got(log.task("t3")) == {k: v for k, v in plain(some).items() if k == "t3"}
    assert log.states(as_of=0).count() <= 15


def test_converted_formats(spark):
    fields = lambda ids, f: {"dataset_ids": ids, "target_format": f}
    some = [("t1", 1, START, "converting", fields("a,b", "swift")), ("t1", 2, START + timedelta(seconds=5), "success", None), ("t2", 1, START + timedelta(seconds=9), "converting", fields("b", "llamafactory")),
            ("t3", 1, START, "converting", fields("c", "swift")), ("t3", 2, START, "failed", None), ("t4", 1, START, "converting", None)]
    states = spark.createDataFrame([("a", "none", ["llamafactory"]), ("b", None, None), ("c", "success", ["swift"]), ("d", "", None)], "job_id string, convert_status string, converted_formats array<string>")
    out = A.converted_formats(states, A.task_states(spark.createDataFrame(some, A.EVENT)))
    assert {r["job_id"]: (r["convert_status"], r["converted_formats"]) for r in out.collect()} == {
        "a": ("success", ["llamafactory", "swift"]), "b": ("converting", ["swift"]), "c": ("failed", ["swift"]), "d": ("none", [])}
