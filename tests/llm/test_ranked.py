"""Ranked search: the threshold algorithm and the whole operator against brute force."""

import math
import random
import re
import string
from collections import Counter

import numpy as np

from leafgrid.llm import ranked

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOCS = "doc_id long, text string, item_id string, q long, row string, score string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=10):
    split = [Counter(terms(t)) for _, t in docs]
    n_docs, n_terms = sum(bool(c) for c in split), sum(sum(c.values()) for c in split)
    df = Counter(t for c in split for t in c)
    least = {}
    for i, t in items:
        least[i] = min([x for x in (least.get(i), t) if x is not None], default=None)
    out = []
    for item, text in least.items():
        found = []
        for (doc, _), c in zip(docs, split, strict=True):
            m = 25 + (75 * sum(c.values()) * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                found.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "x", 1, "x", "x") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 7, "x") for i, t in items], "item_id long, text string, doc_id int, term string")
    return sorted(map(tuple, ranked.rank_documents(d, b, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_threshold_search_equals_all_scores():
    rng = np.random.default_rng(5)
    docs, n_terms = 4000, 60
    pairs = np.unique(rng.integers(0, docs, 40000) * n_terms + np.minimum(rng.geometric(0.08, 40000), n_terms) - 1)
    doc, term = pairs // n_terms, pairs % n_terms
    impact = rng.integers(1, 50, len(pairs)) * np.where(term > 30, 40, 1)
    shard = ranked.Shard(doc, term, impact, docs, n_terms)
    order = rng.permutation(docs)
    stopped = 0
    for _ in range(40):
        asked = rng.choice(n_terms, 6, replace=False)
        times = rng.integers(1, 4, 6)
        best, score, looked = shard.search(asked, times, order, 10)
        whole = np.zeros(docs, np.int64)
        for t, n in zip(asked, times, strict=True):
            np.add.at(whole, doc[term == t], n * impact[term == t])
        want = [x for x in np.lexsort((order, -whole))[:10] if whole[x] > 0]
        assert best.tolist() == want and score.tolist() == whole[want].tolist()
        stopped += looked < (whole > 0).sum()
    assert stopped > 20  # most searches stop before they have met every document


def test_search_on_odd_rows(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Éa", "ÉA", "中文", "x-y", "don't", "A1"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))) for i in range(200)]
    docs += [(500, None), (501, ""), (502, "-- !"), (None, "w1 w2 w3"), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (None, "w1 w2 w3"), (900, "w5 long " * 30000), (901, "W5 éa")]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 9)))) for i in range(12)]
    items += [(100, None), (101, ""), (102, "nowhere"), (None, "w1 w2"), (103, "w1 W1 w1 w3"), (103, "w1 W1 w1 w3"), (104, "w9"), (104, "w8"), (105, "...")]
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, shard=100, item_part=3) == want  # many cells


def test_search_in_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a")], []) == []
    assert run(spark, [(1, None)], [(1, "a")]) == []
