"""Dual-tree Lloyd: trees, assignment and whole runs against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from leafgrid.llm import clustering

ROWS = "vec_id long, embedding array<double>, cluster int, distance string, v int"


def brute(rows, k=16, rounds=3, dims=64):
    kept = [(i, [min(max(math.floor(64 * x), -(2**63)), 2**63 - 1) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, n, d if d < 2**63 else None) for i, v in kept for d, n in [nearest(v)]), key=str), centroids


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], ROWS)
    found, centroids = clustering.lloyd(df, **options)
    return sorted(map(tuple, found.select("vec_id", "cluster", "distance").collect()), key=str), centroids.tolist(), found


def blobs(seed, n, dims=64, blobs=10, noise=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(blobs, dims))
    return centres[rng.integers(0, blobs, n)] + noise * rng.normal(size=(n, dims))


def test_cover_tree_holds_its_conditions():
    rows = np.floor(64 * blobs(1, 700, dims=6, noise=0.3)).astype(np.int64)
    rows[100:140] = rows[99]
    for crowded in (True, False):
        order, tree = clustering.cover_tree(rows, crowded=crowded)
        assert sorted(order.tolist()) == list(range(700)) and (rows[order] == tree.rows).all()
        for i in range(len(tree.begin)):
            centre, own = tree.rows[tree.begin[i]], tree.rows[tree.begin[i] : tree.end[i]]
            assert np.sqrt(((own - centre) ** 2).sum(1)).max() <= tree.radius[i]
            below = tree.children(i)
            if below:
                assert [tree.begin[c] for c in below] == [tree.begin[i], *(tree.end[c] for c in below[:-1])] and tree.end[below[-1]] == tree.end[i]
                heads = tree.rows[tree.begin[below]].astype(float)
                apart = np.sqrt(((heads[:, None] - heads) ** 2).sum(-1)) + np.eye(len(below)) * 1e18
                assert apart.min() > tree.radius[i] / clustering.BASE * (1 - 1e-6)


@pytest.mark.parametrize("k", [1, 3, 16, 200])
def test_assignment_prunes_and_equals_all_distances(k):
    rows = np.floor(64 * blobs(2, 2000, dims=16)).astype(np.int64)
    centroids = rows[:k].copy()
    centroids[k // 2] = centroids[0]  # equal centroids: the smaller number
    _, tree = clustering.cover_tree(rows)
    got, compared = clustering.assign(tree, centroids)
    assert got.tolist() == clustering.squares(tree.rows, centroids).argmin(1).tolist()
    assert compared < 0.6 * len(rows) * k


def test_lloyd_equals_brute_force(spark):
    rows = list(enumerate(blobs(3, 400).tolist()))
    for options in ({}, {"shard": 50}):
        want, centroids = brute(rows)
        got, found, _ = run(spark, rows, **options)
        assert got == want and found == centroids


def test_lloyd_on_odd_rows(spark):
    rnd = random.Random(4)
    some = [[rnd.choice([-1.5, 0.0, 0.25, 2.0]) for _ in range(64)] for _ in range(40)]
    rows = [(i, v) for i, v in enumerate(some)] + [(3, some[3]), (3, some[4]), (None, some[5]), (None, some[6]), (90, None), (91, []), (92, [1.0] * 63), (93, [1.0] * 65)]
    rows += [(94, [math.nan] + [0.0] * 63), (95, [math.inf] + [0.0] * 63), (96, [None] + [0.0] * 63)]
    want, centroids = brute(rows)
    got, found, labelled = run(spark, rows)
    assert got == want and found == centroids
    digest = clustering.cluster_digest(labelled, np.array(found)).collect()
    assert len(digest) == len(want) and {r["inertia"] for r in digest} == {sum(d for _, _, d in want)}


def test_lloyd_beyond_64_bits(spark):
    rows = [(i, [float(2**31 * (i % 3)) + i] + [1e300 if i == 20 else -(2.0**40)] * 2 + [0.5] * 61) for i in range(30)]
    want, centroids = brute(rows)
    got, found, labelled = run(spark, rows)
    assert got == want and found == centroids
    assert clustering.cluster_digest(labelled, np.array(found, object)).where("inertia is null").count() in (0, 30)


def test_lloyd_on_few_rows(spark):
    assert run(spark, [])[0] == []
    assert run(spark, [(7, [0.5] * 64)])[0] == [(7, 0, 0)]
    assert clustering.cluster_digest(*clustering.lloyd(spark.createDataFrame([], ROWS))).count() == 0
