"""Streams: pages that finish in any order, upserts, dead letters, and queries that are killed and go on from their checkpoint."""

import random

import pytest
from pyspark.sql import functions as F

from leafgrid.operators import hierarchy as H
from leafgrid.sources.versions import VersionedTable
from leafgrid.streaming import incremental as S

HEADINGS = "doc long, page_id int, ord int, block_type string, level string"


def headings(seed, docs=6):
    rnd, out = random.Random(seed), []
    for doc in range(docs):
        n = 0
        for page in range(0, rnd.randint(1, 14) * 2, 2):
            for _ in range(rnd.randint(1, 4)):
                n += 1
                out.append((doc, page, n, rnd.choice(["paragraph_title", "paragraph_title", "text"]), rnd.choice(["H1", "H2", "H3", "H4", "H4", None, "odd"])))
    return out


def run_pages(spark, folder, pages, **options):
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = S.clamp_pages(stream, **options).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("doc long, ord int, repaired string, late boolean").parquet(f"{folder}/out")


def test_shuffled_pages_equal_the_batch_clamp(spark, tmp_path):
    rows = spark.createDataFrame(headings(3), HEADINGS)
    want = sorted(map(tuple, H.clamp_levels(rows).select("doc", "ord", "repaired").collect()))
    pages = S.page_rows(rows).cache()
    folder = f"file://{tmp_path}"
    for part in range(5):  # one file a batch; pages of a document are spread over all of them
        pages.where(F.pmod(F.xxhash64("page_no", "doc"), F.lit(5)) == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = run_pages(spark, folder, pages)
    assert sorted(map(tuple, out.where("not late").select("doc", "ord", "repaired").collect())) == want and out.count() == len(want)


def test_a_lasting_gap_is_passed_over(spark, tmp_path):
    folder = f"file://{tmp_path}"
    schema = "doc long, page_no int, items array<struct<ord:int,block_type:string,level:string>>, at timestamp"

    def page(no, level, second, doc=1):
        return spark.createDataFrame([(doc, no, [(no + 1, "paragraph_title", level)])], "doc long, page_no int, items array<struct<ord:int,block_type:string,level:string>>").withColumn("at", F.timestamp_seconds(F.lit(second)))

    def add(*pages):
        for p in pages:
            p.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        shape = spark.createDataFrame([], schema)
        return sorted((r["doc"], r["ord"], r["repaired"], r["late"]) for r in run_pages(spark, folder, shape, patience=10_000).collect())

    assert add(page(0, "H1", 1), page(2, "H3", 1)) == [(1, 1, "H1", False)]  # page 1 is missing: page 2 waits
    assert add(page(0, "H2", 5, doc=2)) == [(1, 1, "H1", False), (2, 1, "H1", False)]
    after = add(page(1, "H4", 100, doc=2), page(2, "H1", 101, doc=2))  # the watermark passes page 1's time
    assert (1, 3, "H2", False) in after and (2, 2, "H2", False) in after
    last = add(page(1, "H2", 102))
    assert (1, 2, None, True) in last and len(last) == 6


def results(seed, n):
    """(job, page, payload, error, at): pages with one to four results, some of which work."""
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        for a in range(rnd.randint(1, 4)):
            out.append((k % 3, k, f"p{k}.{a}", None if rnd.random() < 0.4 else f"e{a}", a))
    return out


RESULT = "job_id long, page_id int, payload string, error string, at int"


def folded(rows):
    done, dead = {}, {}
    for job, page, payload, error, _ in sorted(rows, key=lambda r: r[4]):
        key = (job, page)
        if key in done:
            continue
        tries = dead.pop(key, (0, None))[0] + 1
        if error is None:
            done[key] = (tries, payload)
        else:
            dead[key] = (tries, error)
    return done, dead


def state(queue):
    return {(r["job_id"], r["page_id"]): (r["attempts"], r["payload"]) for r in queue.done.read().collect()}, {(r["job_id"], r["page_id"]): (r["attempts"], r["error"]) for r in queue.waiting().collect()}


def test_dead_letters_survive_a_kill_between_the_sinks(spark, tmp_path):
    rows, folder = results(4, 40), f"file://{tmp_path}"
    frame = spark.createDataFrame(rows, RESULT)
    for a in range(4):  # results in the order of attempts, a file each
        frame.where(F.col("at") == a).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def stream():
        return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def kill(number):
        if number == 2:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        S.run_to_end(stream(), folder, S.PageQueue(spark, f"{folder}/q").sink("pages", kill))
    half = S.PageQueue(spark, f"{folder}/q")
    assert half.done.entry()["streams"]["pages"] == 2 and half.dead.entry()["streams"]["pages"] == 1
    S.run_to_end(stream(), folder, S.PageQueue(spark, f"{folder}/q").sink("pages"))
    assert state(S.PageQueue(spark, f"{folder}/q")) == folded(rows)
    # The same rows in one batch.
    whole = S.PageQueue(spark, f"{folder}/whole")
    whole.sink("pages")(frame, 0)
    whole.sink("pages")(frame, 0)
    assert state(whole) == folded(rows)


def test_a_page_that_fails_twice_is_counted_once(spark, tmp_path):
    queue = S.PageQueue(spark, f"file://{tmp_path}/q")
    queue.sink("pages")(spark.createDataFrame([(1, 1, "a", None, 0), (1, 2, None, "e0", 0), (1, 3, None, "e0", 0)], RESULT), 0)
    seen = []

    def process(keys):
        seen.append(sorted(r["page_id"] for r in keys.collect()))
        works = (F.col("page_id") == 2) & F.lit(len(seen) == 2)
        return keys.select("job_id", "page_id", F.lit(f"again {len(seen)}").alias("payload"), F.when(~works, f"e{len(seen)}").alias("error"), F.lit(len(seen)).alias("at"))

    assert [queue.rerun(process, most=3) for _ in range(4)] == [2, 2, 0, 0]
    assert state(queue) == ({(1, 1): (1, "a"), (1, 2): (3, "again 2")}, {(1, 3): (3, "e2")})
    queue.sink("pages")(spark.createDataFrame([(1, 2, "late", None, 9), (1, 1, None, "late", 9)], RESULT), 1)
    assert state(queue)[0] == {(1, 1): (1, "a"), (1, 2): (3, "again 2")} and seen == [[2, 3], [2, 3], [], []]


def test_upserts_go_on_from_the_checkpoint(spark, tmp_path):
    folder = f"file://{tmp_path}"
    frame = spark.range(300).select((F.col("id") % 40).alias("k"), F.col("id").alias("v"))
    for part in range(3):
        frame.where(F.col("v") % 3 == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    new = lambda: VersionedTable(spark, f"{folder}/t", "k long, v long", ["k"], 8)
    stream = lambda: spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def dies(batch, number):
        S.upserts(new(), ["v"], "s")(batch, number)
        if number == 1:
            raise RuntimeError("killed")  # after the commit of batch 1, before the stream notes it

    with pytest.raises(Exception, match="killed"):
        S.run_to_end(stream(), folder, dies)
    S.run_to_end(stream(), folder, S.upserts(new(), ["v"], "s"))
    assert new().version == 2
    assert {r["k"]: r["v"] for r in new().read().collect()} == {k: max(v for v in range(300) if v % 40 == k) for k in range(40)}
