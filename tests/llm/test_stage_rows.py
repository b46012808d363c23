"""Pipeline stages on odd rows: nulls, repeated rows, ties, empty tables and columns with clashing names."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from leafgrid.llm import mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n long, t int, score double, predicted int, h string, size int"


def rows(spark, some):
    return spark.createDataFrame([(i, t, None, s, 1, 2, 0.5, 7, "h", 3) for i, t, s in some], SCHEMA)


def test_mixed_rows_follow_the_mix(spark):
    rng = random.Random(3)
    some = [(i, "w " * rng.randrange(1, 60), rng.choice(["a", "b", None])) for i in range(400)]
    some += [(7, "x " * 10, "a")] * 40 + [(9, None, "a"), (9, "", None), (None, "y z", "b"), (None, "y z", "b")]
    frame = rows(spark, some)
    words = lambda t: len((t or "").split())
    took = Counter()
    for r in mixing.mix(frame.select("doc_id", "text", "source")).collect():
        took[r["doc_id"], r["source"], r["size"]] += r["taken"] // r["size"] if r["size"] else 1
    out = mixing.mixed_rows(frame)
    assert out.columns == frame.columns
    got = Counter((r["doc_id"], r["source"], words(r["text"])) for r in out.collect())
    assert got == Counter({k: n for k, n in took.items() if n})
    each = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert each[7, "x " * 10] == took[7, "a", 10]
    assert mixing.mixed_rows(frame.limit(0)).collect() == []


def test_stages_leave_columns_alone(spark):
    some = [(1, "A clean sentence about the town.", "a"), (1, "A clean sentence about the town.", "a"), (2, None, None), (3, "", "b"), (None, "words " * 30, "b"), (4, "words " * 30, "b")]
    frame = rows(spark, some)
    for _, stage in P.STAGES[:4]:
        out = stage(spark, frame, "/root/testdata/sf0.001")
        assert out.columns == frame.columns
        assert all((r["score"], r["predicted"], r["n"], r["t"], r["size"]) == (0.5, 7, 1, 2, 3) for r in out.collect())
        assert stage(spark, frame.limit(0), "/root/testdata/sf0.001").collect() == []
    exact = P.exact_copies(spark, frame, "").collect()
    assert sorted((r["doc_id"] or 0) for r in exact) == [1, 3, 4]


def test_helper_names_in_the_input_stay(spark):
    """Columns called like the stages' own helpers come back unchanged."""
    names = ["__sha2", "__own", "__words", "__lap", "__id", "__t", "__place", "__source", "__node", "in_0", "in_1", "kept", "bin_id", "key", "row", "y", "x"]
    frame = rows(spark, [(1, "A clean sentence about the town.", "a"), (1, "A clean sentence about the town.", "a"), (2, None, None), (4, "words " * 30, "b"), (5, "words " * 30 + "more", "b")])
    for k, name in enumerate(names):
        frame = frame.withColumn(name, F.lit(k))
    for _, stage in P.STAGES[:4]:
        out = stage(spark, frame, "/root/testdata/sf0.001")
        assert out.columns == frame.columns
        assert all([r[n] for n in names] == list(range(len(names))) for r in out.collect())
    assert P.packing(spark, frame, "").count() > 0


def test_bradley_terry_weights_maximise_the_likelihood():
    """An independent gradient climb over the same pairs ends at the same weights."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, quality.N_FEATURES)) + 0.0
    label = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=300) > 0).astype(int)
    model = quality.fit(x, label)
    z = ((x - x.mean(0)) / x.std(0)).clip(-8, 8)
    draw = np.random.default_rng(0)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    pairs = quality.PAIRS_PER_ROW * len(x)
    d = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(4000):
        w += 0.3 * ((d * (1 / (1 + np.exp(d @ w)))[:, None]).mean(0) - quality.RIDGE * w)
    assert np.allclose(w, model.weight, atol=2e-3)
    strength = np.sort(z @ w)
    cut = np.quantile(strength, len(bad) / len(x))
    scores = 1 / (1 + np.exp(-(z @ w - cut + np.log(0.3 / 0.7))))
    assert np.allclose(scores, model.scores(x), atol=2e-3)
    assert abs((model.scores(x) < quality.THRESHOLD).mean() - len(bad) / len(x)) < 0.02
