import random

from leafgrid.llm import near_copies as N

SCHEMA = "doc_id long, text string, node int, tile string"


def edited(rng, words, changes):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"new{rng.random()}"
    return " ".join(out)


def corpus():
    rng = random.Random(7)
    vocabulary = [f"word{i}" for i in range(2000)]
    rows, groups = [], {}
    for g in range(30):
        words = rng.choices(vocabulary, k=rng.choice([60, 150, 600]))
        copies = [" ".join(words), *(edited(rng, words, max(1, len(words) // 100)) for _ in range(3))]
        for text in copies:
            groups[len(rows)] = g
            rows.append((len(rows), text, 0, ""))
        rows.append((len(rows), edited(rng, words, len(words) // 3), 0, ""))  # far from all others
    return rows, groups


def similarity(a, b):
    s = [set(zip(*(t.split()[i:] for i in range(5)))) for t in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_one_document_of_each_group_stays(spark):
    rows, groups = corpus()
    for tile in (2048, 8):
        before, N.TILE = N.TILE, tile
        try:
            kept = {r["doc_id"] for r in N.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
        finally:
            N.TILE = before
        assert kept == {i for i in range(len(rows)) if i not in groups or i % 5 == 0}


def test_links_are_above_the_similarity(spark):
    rng = random.Random(8)
    words = rng.choices([f"w{i}" for i in range(500)], k=400)
    texts = [edited(rng, words, k) for k in (0, 2, 4, 8, 16, 40, 80)]
    kept = {r["doc_id"] for r in N.drop_near_copies(spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], SCHEMA)).collect()}
    for i in range(1, len(texts)):
        alike = max(similarity(texts[i], texts[j]) for j in range(len(texts)) if j != i)
        assert i in kept if alike < 0.65 else (i not in kept if alike > 0.92 else True)


def test_pairs_near_the_threshold_link_by_exact_similarity(spark):
    """Pairs of similarity 0.778 and 0.794 both stay; of pairs of 0.802 and 0.810 one stays."""
    rng, rows, want = random.Random(11), [], set()
    for g in range(160):
        words = [f"g{g}w{i}" for i in range(1004)]
        copy = list(words)
        for at in rng.sample(range(5, 995, 10), (21, 22, 23, 25)[g % 4]):  # no two changes touch one shingle
            copy[at] = f"new{rng.random()}"
        pair = [" ".join(words), " ".join(copy)]
        rows += [(2 * g + k, t, 0, "") for k, t in enumerate(pair)]
        want |= {2 * g} | ({2 * g + 1} if similarity(*pair) < 0.8 else set())
    assert len(want) == 240
    assert {r["doc_id"] for r in N.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_odd_rows(spark):
    assert N.drop_near_copies(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, 1, "a"), (2, "", 1, "a"), (3, "", 1, "a"), (None, "a b", 1, "a"), (4, "a b", 1, "b"), (4, "a b", 1, "b"), (5, "A  B", 2, "c"), (6, "x " * 30000, 1, "a")]
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in N.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect())
    assert kept == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 4), (False, 6)]


def test_large_group_is_joined_without_all_pairs(spark):
    """One hot group beside small ones: the kept rows do not depend on the tiles, and the tile pairs stay few."""
    rng = random.Random(9)
    words = rng.choices([f"w{i}" for i in range(900)], k=500)
    rows = [(i, edited(rng, words, rng.choice([1, 2, 3])), 0, "") for i in range(300)]
    half = words[:400] + rng.choices([f"v{i}" for i in range(900)], k=100)  # shares bands with the hot group, links to none of it
    rows += [(300 + i, edited(rng, half, 2), 0, "") for i in range(20)]
    docs, seen, plain = spark.createDataFrame(rows, SCHEMA), [], N.second_tiles

    def watched(*args):
        seen.append(plain(*args).count())
        return plain(*args)

    kept, before = {}, N.TILE
    try:
        N.second_tiles = watched
        for tile in (2048, 16):
            N.TILE = tile
            kept[tile] = {r["doc_id"] for r in N.drop_near_copies(docs).collect()}
    finally:
        N.TILE, N.second_tiles = before, plain
    assert kept[16] == kept[2048] == {0, 300}
    assert len(seen) == 1 and seen[0] < N.BANDS * 300 * 5  # all pairs of tiles would be 12 * 300 * 19 rows


def test_second_tiles_pair_all_groups_and_no_group_with_itself(spark):
    cut = spark.createDataFrame([(k, n) for k in (1, 2) for n in range(60)] + [(3, n) for n in range(40)], "key long, node long")
    groups = spark.createDataFrame([(n, 0) for n in range(40)] + [(n, 41) for n in range(41, 52)], "node long, root long")
    root = {n: 0 for n in range(40)} | {n: 41 for n in range(41, 52)}
    meet = {}
    for r in N.second_tiles(cut, groups, 8).collect():
        meet.setdefault((r["key"], r["tile"]), set()).add(r["node"])
    assert not any(k == 3 for k, _ in meet)
    for key in (1, 2):
        pairs = {(a, b) for (k, _), nodes in meet.items() if k == key for a in nodes for b in nodes if a < b}
        assert all((a, b) in pairs for a in range(60) for b in range(a + 1, 60) if root.get(a, a) != root.get(b, b))
