"""Each stage of the pipeline against a plain version of its rule, on the rows of the stage before."""

from collections import Counter, defaultdict

import corpus_pipeline as P
from leafgrid.llm import mixing, quality
from leafgrid.llm.common import read

DATA = "/root/testdata/sf0.001"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def test_stages(spark, tmp_path):
    docs = read(spark, DATA, "documents")
    columns, seen = docs.columns, [docs.collect()]
    for n, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if n < len(P.STAGES) - 1:
            assert docs.columns == columns
        seen.append(docs.collect())
    start, good, exact, near, mixed, packed = seen

    scores = {r["doc_id"]: r["predicted"] for r in quality.score_quality(read(spark, DATA, "documents"), read(spark, DATA, "labels")).collect()}
    assert {r["doc_id"] for r in good} == {i for i, p in scores.items() if p == 1}

    groups = defaultdict(list)
    for r in good:
        groups[r["text"].lower() if r["text"].isascii() else "".join(c.lower() if c.isascii() else c for c in r["text"])].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in exact) == sorted(max(g) for g in groups.values())

    sets = {r["doc_id"]: shingles(r["text"]) for r in exact if r["text"].split()}
    kept = {r["doc_id"] for r in near}
    assert kept <= {r["doc_id"] for r in exact}
    for i, s in sets.items():
        alike = [similarity(s, t) for j, t in sets.items() if j != i]
        if max(alike, default=0) < 0.65:
            assert i in kept
        if i not in kept:
            assert any(j < i and similarity(s, sets[j]) > 0.65 for j in sets)
    assert not any(similarity(sets[i], sets[j]) > 0.92 for i in kept for j in kept if i < j and i in sets and j in sets)

    frame = spark.read.parquet(f"{tmp_path}/2")
    times = {r["doc_id"]: r["taken"] // r["size"] if r["size"] else 1 for r in mixing.mix(frame).collect()}
    assert Counter(r["doc_id"] for r in mixed) == {i: t for i, t in times.items() if t}

    words = Counter()
    for r in mixed:
        words[r["doc_id"]] += len(r["text"].split())
    placed = Counter()
    for r in packed:
        placed[r["doc_id"]] += r["words"]
    assert placed == words
    bins = defaultdict(list)
    for r in packed:
        bins[r["bin_id"]].append(r)
    assert all(sum(r["words"] for r in b) <= 2048 and max(Counter(r["cluster"] for r in b).values()) == 1 for b in bins.values())


def test_run_equals_the_stages(spark):
    out = P.run(spark, DATA)
    assert out.count() > 0 and P.ORACLE_SQL is None and [n for n, _ in P.STAGES][0] == "quality classifier"
