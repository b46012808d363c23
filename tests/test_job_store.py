"""Job folders in two depths, image resolution against the directory itself, and copies."""

import json
import os

import pytest
from pyspark.sql import functions as F

from leafgrid.sources import job_store as J


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else json.dumps(content).encode())


@pytest.fixture
def store(tmp_path):
    put(tmp_path / "a/j1/result.json", {"job_id": "j1", "status": "flat"})
    put(tmp_path / "a/m/j1/result.json", {"job_id": "j1", "status": "deep"})
    put(tmp_path / "a/m/j2/result.json", {"job_id": "j2", "status": "deep"})
    put(tmp_path / "a/n/j2/result.json", {"job_id": "j2", "status": "deeper name"})
    put(tmp_path / "a/m/x/j9/result.json", {"job_id": "j9"})
    put(tmp_path / "a/j{3},4/result.json", {"job_id": "odd"})
    put(tmp_path / "b/j1/result.json", {"job_id": "j1", "status": "other root"})
    put(tmp_path / "b/j5/other.json", {"job_id": "j5"})
    return f"file://{tmp_path}"


def test_scan_names_every_file_once(spark, store):
    jobs = J.JobStore(spark, f"{store}/a", f"{store}/b", f"{store}/a/m", f"{store}/a/")
    rows = jobs.scan()
    assert sorted((r["job"], r["status"]) for r in rows.collect()) == sorted(
        [("j1", "flat"), ("j1", "deep"), ("j2", "deep"), ("j2", "deeper name"), ("j{3},4", None), ("j1", "other root"), ("j9", None)])
    assert len({r["path"] for r in rows.select("path").collect()}) == 7
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_lookup_reads_one_job(spark, store):
    jobs = J.JobStore(spark, f"{store}/a", f"{store}/b")
    one = jobs.lookup("j1")
    assert [r["status"] for r in one.collect()] == ["flat"] and len(one.inputFiles()) == 1
    assert [r["status"] for r in jobs.lookup("j2").collect()] == ["deep"]
    assert [r["status"] for r in J.JobStore(spark, f"{store}/b", f"{store}/a").lookup("j1").collect()] == ["other root"]
    assert [r["job_id"] for r in jobs.lookup("j{3},4").collect()] == ["odd"]
    many = jobs.find(["j2", "j1", "nowhere", "a/b", "", "j5"])
    assert sorted((r["job"], r["status"]) for r in many.collect()) == [("j1", "flat"), ("j2", "deep")] and len(many.inputFiles()) == 2
    with pytest.raises(FileNotFoundError):
        jobs.lookup("j5")
    assert J.JobStore(spark, f"{store}/none").scan().count() == 0


def reference(folder, job, page, url, source):
    """Where a page's image is, by the directory itself."""
    parts = (url or "").strip("/").split("/")
    below = parts[parts.index(job) + 1 :] if job in parts else []
    names = ["/".join(below)] if below else []
    names += [f"model_pages/page_{page:03d}_qwen.png"] if source == "model" else []
    names.append(f"pages/page_{page:03d}.png")
    return next((f"{folder}/{n}" for n in names if os.path.isfile(f"{folder}/{n}")), None)


def test_images_are_found_and_copied(spark, tmp_path):
    rows = []
    for job in ("j1", "j2"):
        folder = tmp_path / "jobs/m" / job
        put(folder / "pages/page_000.png", b"page 0 " + job.encode())
        put(folder / "pages/page_001.png", b"page 1")
        put(folder / "model_pages/page_001_qwen.png", b"model 1")
        put(folder / "extra/deep/a.png", bytes(range(256)) * 1000)
        for page, url in ((0, None), (1, f"/jobs/m/{job}/extra/deep/a.png"), (1, f"/jobs/m/{job}/gone.png"), (2, f"/{job}/"), (3, "/elsewhere/x.png"), (None, f"/x/{job}/pages/page_001.png")):
            rows.append((job, str(folder), page, url, url))
    pages = spark.createDataFrame(rows, "job string, folder string, page_id int, image_url string, model_image_url string").withColumn("folder", F.concat(F.lit("file:"), "folder"))
    files = J.listing(spark, f"file://{tmp_path}/jobs/*/*")
    for source in ("page", "model"):
        for number in range(len(rows) // 2):  # a page of each job at a time, as a page names one image
            some = pages.where(F.col("job").isin("j1", "j2")).collect()
            one = [r for k, r in enumerate(some) if k % (len(rows) // 2) == number]
            frame = spark.createDataFrame(one, pages.schema)
            got = {r["job"]: r for r in J.page_images(frame, files, source).collect()}
            for r in one:
                want = reference(r["folder"].removeprefix("file:"), r["job"], r["page_id"] or 0, r["image_url"], source)
                assert (got[r["job"]]["image"] or "").removeprefix("file:") == (want or "") and (got[r["job"]]["reason"] is None) == (want is not None)
    one_each = spark.createDataFrame([r for k, r in enumerate(pages.collect()) if k % 6 in (0, 1, 3)], pages.schema)
    out = J.copy_images(J.page_images(one_each, files), f"{tmp_path}/export", F.lit("set 1"))
    targets = {(r["job"], r["page_id"]): (r["image"], r["target"], r["reason"]) for r in out.collect()}
    assert len(targets) == 6 and sum(t[1] is None for t in targets.values()) == 2
    for (job, page), (image, target, reason) in targets.items():
        if target:
            assert target == f"images/set_1/{job}/page_{page:03d}.png"
            assert (tmp_path / "export" / target).read_bytes() == open(image.removeprefix("file:"), "rb").read()
        else:
            assert reason
    manifest = [n for n in os.listdir(tmp_path / "export") if n.startswith("_copied-")]
    assert json.loads((tmp_path / "export" / manifest[0]).read_text())["files"] == 4


def test_failed_copies_leave_no_half_file(spark, tmp_path):
    rows = spark.range(6).select(F.concat(F.lit("d/f"), F.col("id").cast("string")).alias("name"), F.encode(F.when(F.col("id") == 5, F.raise_error(F.lit("broken"))).otherwise(F.lit("abc")), "utf-8").alias("content"))
    with pytest.raises(Exception, match="broken"):
        J.write_files(rows.coalesce(1), f"{tmp_path}/out")
    left = [n for _, _, names in os.walk(tmp_path / "out") for n in names if not n.endswith(".crc")]
    assert all(n.startswith("f") for n in left) and not any(n.startswith("_copied") for n in left)
    assert all((tmp_path / "out/d" / n).read_bytes() == b"abc" for n in left)
    with pytest.raises(Exception, match="below the folder"):
        J.write_files(spark.createDataFrame([("../x", b"1")], "name string, content binary"), f"{tmp_path}/out")
    J.write_files(rows.where("id < 5"), f"{tmp_path}/out")
    assert sorted(n for n in os.listdir(tmp_path / "out/d") if not n.startswith(".")) == [f"f{i}" for i in range(5)]


def test_a_scan_lists_no_store_in_python(spark, tmp_path, monkeypatch):
    for i in range(5):
        (tmp_path / f"j{i}").mkdir()
        (tmp_path / f"j{i}" / "result.json").write_text("{}")
    asked, glob = [], J.JobStore._glob

    def noted(self, pattern):
        asked.append(pattern)
        return glob(self, pattern)

    monkeypatch.setattr(J.JobStore, "_glob", noted)
    assert J.JobStore(spark, str(tmp_path)).scan().count() == 5
    assert all("*" not in p for p in asked)
