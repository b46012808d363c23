import random

import numpy as np
import xxhash

from leafgrid.llm import graph, simhash
from leafgrid.llm.common import read

SCHEMA = "doc_id long, text string, component_id int, fp string"


def brute_print(text, words=3):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def check(spark, rows):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = {r[0]: brute_print(r[1]) for r in rows}
    components = brute_components(prints)
    assert got == {i: (f"{prints[i]:016x}", components[i]) for i in prints}


def test_odd_texts_equal_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choices(words, k=n)) for n in (3, 40, 200, 3000)]
    texts = [None, "", " \t\n", "One", "one", "Two words", "Ärger Ä b c", *base, *base, *(b.upper() for b in base), *(b + " x" for b in base), *(b.replace("w1 ", "w2 ", 1) for b in base)]
    check(spark, [(i * 3 + 1, t, 0, "x") for i, t in enumerate(texts)])


def test_empty_and_repeated_rows(spark):
    assert simhash.near_components(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(5, "a b c d", 0, ""), (5, "a b c d", 0, ""), (None, "a b c d", 0, ""), (None, "zz", 0, "")]
    got = sorted(map(tuple, simhash.near_components(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (None, None)], key=str)


def test_hot_shards_are_dealt_anew_and_lose_no_link(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    near = {centre ^ (1 << a) ^ (1 << b) ^ (1 << c) for a, b, c in (rng.sample(range(64), 3) for _ in range(500))}
    far = {rng.getrandbits(64) for _ in range(300)}
    values = sorted(near | far)
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    edges = simhash.fingerprint_links(frame, 2, shard=20)
    got = {r["node"]: r["root"] for r in graph.connected_components(edges).collect()}
    want = brute_components({simhash._signed(v): v for v in values})
    sizes = {}
    for r in want.values():
        sizes[r] = sizes.get(r, 0) + 1
    assert got == {k: v for k, v in want.items() if sizes[v] > 1}


def test_masks_follow_the_pigeonhole():
    levels = simhash.levels_of_masks(2)
    assert all(len(ms) == 3 for level in levels for ms in level.values())
    assert max((~m & (2**64 - 1)).bit_count() for ms in levels[-1].values() for m in ms) <= simhash.LAST_BITS


def test_bk_tree_equals_all_pairs():
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 2**12, 900).astype(np.uint64) * np.uint64(2**40 + 1))
    sets = simhash._Sets(len(values))
    simhash.bk_links(values, 2, sets)
    want = brute_components({i: int(v) for i, v in enumerate(values)})
    assert sets.roots(np.arange(len(values))).tolist() == [want[i] for i in range(len(values))]


def test_whole_table_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = read(spark, d, "documents").select("doc_id", "text").collect()
    prints = {r[0]: brute_print(r[1]) for r in rows}
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(read(spark, d, "documents")).collect()}
    assert got == brute_components(prints)
