"""Registered opN queries on the smallest tables against DuckDB, and operators on odd rows against brute force."""

import hashlib
import math
import os
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from leafgrid.llm import exact_dedup, language_id, licenses, mixing, oracles, quality, topk, url_filter
from leafgrid.llm.common import read
from leafgrid.llm.queries import REGISTRY

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(REGISTRY.oracles))
def test_oracle(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        path = f"{DATA}/{t}.parquet"
        duck.sql(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    frame = REGISTRY.queries[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    cursor = duck.execute(REGISTRY.oracles[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


# --- exact dedup -------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, keep_id int, size int, row int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, "h", 1, 2, 3) for i, t, s in rows], DOCS)


def lower(t):
    return (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


ODD = [(1, None, "a"), (2, "", "a"), (3, "X", None), (4, "x", "b"), (4, "x", "b"), (5, "Éé", "b"), (6, "éé", "b"), (None, "x", "c"), (7, "w " * 40000, "a"), (8, "W " * 40000, "a"), (9, "solo", "")]


def test_exact_dedup_on_odd_rows(spark):
    for keep, best in (("max", max), ("min", min)):
        out = exact_dedup.exact_dedup(docs(spark, ODD), keep=keep).collect()
        groups = defaultdict(list)
        for i, t, _ in ODD:
            groups[lower(t)].append(i)
        want = Counter()
        for i, t, _ in ODD:
            g = groups[lower(t)]
            want[i, best(x for x in g if x is not None), len(g), hashlib.sha256(lower(t).encode()).hexdigest()] += 1
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == want
        assert Counter(r["text_sha256"] for r in out if r["kept"]) == {hashlib.sha256(k.encode()).hexdigest(): 1 for k in groups}


def test_drop_exact_copies_keeps_columns_and_one_row(spark):
    out = exact_dedup.drop_exact_copies(docs(spark, ODD))
    assert out.columns == docs(spark, ODD).columns
    assert sorted(lower(r["text"]) for r in out.collect()) == sorted({lower(t) for _, t, _ in ODD})
    assert exact_dedup.exact_dedup(docs(spark, [])).collect() == [] and exact_dedup.drop_exact_copies(docs(spark, [])).collect() == []


def test_drop_exact_copies_with_a_recurring_id_in_other_case(spark):
    rows = [(1, "Abc", "a"), (1, "abc", "a"), (2, None, "a"), (2, "", "a"), (3, "x", "a")]
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_copies(docs(spark, rows)).collect()) == [1, 2, 3]


# --- language ----------------------------------------------------------------------------------------------------------


def brute_bits(samples, text, order=language_id.ORDER):
    """Code length of a text by plain recursion over dictionaries of contexts that occur twice or more in all samples."""
    counts = {lang: defaultdict(Counter) for lang in samples}
    joint = Counter()
    alphabet = {b for ts in samples.values() for t in ts for b in t}
    for lang, texts in samples.items():
        for t in texts:
            for i, b in enumerate(t):
                for k in range(min(order, i) + 1):
                    counts[lang][t[i - k : i]][b] += 1
                    joint[t[i - k : i]] += 1
    tree = {b""}
    for k in range(1, order + 1):
        tree |= {c for c, n in joint.items() if len(c) == k and n >= 2 and c[1:] in tree}
    out = {}
    for lang in samples:
        def cost(context, b, lang=lang):
            seen = counts[lang].get(context, Counter())
            total, distinct = sum(seen.values()), len(seen)
            if not total:
                return 8.0 if not context else cost(context[1:], b)
            if b in seen:
                return np.log2((total + distinct) / seen[b])
            return np.log2((total + distinct) / distinct) + (cost(context[1:], b) if context else 8.0)

        bits = 0.0
        for i, b in enumerate(text):
            context = text[max(0, i - order) : i]
            while context and (any(x not in alphabet for x in context) or context not in tree):
                context = context[1:]
            bits += cost(context, b)
        out[lang] = bits
    return out


def test_code_lengths_are_exact():
    samples = {"a": [b"the cat sat on the mat", b"that hat"], "b": ["der hund ist groß".encode(), b"die der das", b""]}
    model = language_id.fit(samples)
    texts = [b"", b"the mat", b"der das!", "größe Ω".encode(), b"t" * 50]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    before, got = language_id.WINDOW, []
    try:
        for window in (1 << 20, 7, 1):
            language_id.WINDOW = window
            got.append(language_id.code_lengths(model, data, offsets))
    finally:
        language_id.WINDOW = before
    want = [[brute_bits(samples, t)[k] for k in model.langs] for t in texts]
    for g in got:
        assert np.allclose(g, want, rtol=1e-5, atol=1e-4)


def test_contexts_counted_on_executors_give_the_same_trees(spark):
    rng = random.Random(4)
    words = {"aa": "der die und nicht haus größe straße", "bb": "the and not house size street", "cc": "le la et ne pas maison rue"}
    rows = [(i, " ".join(rng.choices(words[k].split(), k=rng.choice([3, 40, 900]))), k) for i in range(90) for k in [sorted(words)[i % 3]]]
    frame = spark.createDataFrame([(i, t, k, "s", 1, "h", 1, 2, 3) for i, t, k in rows], DOCS)
    kept = [(t, k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 5]
    want = language_id.fit({k: [t.encode() for t, x in kept if x == k] for k in words})
    (got,) = language_id.learn(frame)
    assert got.langs == want.langs and got.size == want.size
    for name in ("symbol", "state", "bits"):
        assert np.array_equal(getattr(got, name), getattr(want, name)), name
    before = language_id.WINDOW
    try:
        language_id.WINDOW = 64
        short = language_id.count_contexts([t.encode() for t, _ in kept])
    finally:
        language_id.WINDOW = before
    for (a, n), (b, m) in zip(short, language_id.count_contexts([t.encode() for t, _ in kept])):
        assert np.array_equal(a, b) and np.array_equal(n, m)


def test_language_contract_and_accuracy(spark):
    frame = read(spark, DATA, "documents")
    truth = {r["doc_id"]: r["lang"] for r in frame.collect()}
    out = language_id.identify(frame).collect()
    assert {r["doc_id"]: r["held_out"] for r in out} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in truth}
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_on_odd_rows(spark):
    rows = [(i, t, lang, "s", None, "", 0, 0, 0) for i, (t, lang) in enumerate([("the cat", "en"), ("le chat", "fr"), ("the dog", "en"), ("le chien", None), (None, "en"), ("", "en"), ("123 !", "en"), ("é", "fr"), ("the " * 200000, None), ("le", "fr")])]
    out = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(out) == len(rows) and [out[i]["lang_pred"] for i in (4, 5, 6)] == ["und"] * 3 and out[7]["lang_pred"] != "und"
    assert language_id.identify(spark.createDataFrame([], DOCS)).collect() == []
    unknown = spark.createDataFrame([(1, "abc", None, "s", None, "", 0, 0, 0)], DOCS)
    assert [(r["lang_pred"], r["score"]) for r in language_id.identify(unknown).collect()] == [("und", 0.0)]


def test_all_languages_are_learned(spark):
    rng, rows = random.Random(12), []
    for k in range(70):  # the last ones are the least frequent
        words = ["".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(12)]
        rows += [(len(rows) + i, " ".join(rng.choices(words, k=40)), f"l{k:02}", "s", None, "", 0, 0, 0) for i in range(12 if k < 64 else 10)]
    truth = {r[0]: r[2] for r in rows}
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == truth


# --- quality -----------------------------------------------------------------------------------------------------------


def test_quality_contract_and_accuracy(spark):
    d = "/root/testdata/sf0.01"
    frame, labels = read(spark, d, "documents"), read(spark, d, "labels")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = quality.score_quality(frame, labels).collect()
    assert len(out) == frame.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert {zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in held} == {0}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.9


def test_quality_on_odd_rows(spark):
    labels = "doc_id long, quality int, toxic int"
    frame = docs(spark, [(i, t, "s") for i, t in enumerate(["Fine words here.", None, "", "### $$$ %%%", "x " * 100000, "Good text again."])])
    no_labels = quality.score_quality(frame, spark.createDataFrame([], labels)).collect()
    assert [r["score"] for r in no_labels] == [0.5] * 6
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(6)] + [(0, 1, 0), (None, 1, 0)], labels)
    assert len(quality.score_quality(frame, some).collect()) == 6
    assert quality.score_quality(docs(spark, []), some).collect() == []


def test_bradley_terry_ranks_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 1] - x[:, 3] + 0.1 * rng.normal(size=400) > -0.8).astype(int)
    model = quality.fit(x, y)
    s = model.scores(x)
    assert s[y == 1].min() > np.quantile(s[y == 0], 0.5) and abs((s >= 0.3).mean() - y.mean()) < 0.05
    assert quality.fit(x, np.ones(400)) is None


# --- search ------------------------------------------------------------------------------------------------------------


def test_pruned_search_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * (1 + (i // 50) % 3) for _ in range(6)], 0, "x") for i in range(300)]
    rows += [(400, None, 0, ""), (401, [0.1, None], 0, ""), (402, [float("nan")], 0, ""), (403, [float("inf"), 1.0], 0, ""), (404, [], 0, ""), (405, [1.0], 0, ""), (40, rows[40][1], 0, "again")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, rank string")
    from pyspark.sql import functions as F

    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for q, v in good:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:20]
            want.update((q, i, -s) for s, i in scored)
    for size in (8192, 4):
        out = topk.top_k(frame, F.col("vec_id") % 20 == 0, query_block=size, block=16).collect()
        got = Counter((r["query_id"], r["vec_id"], r["score"]) for r in out)
        assert set(got) == set(want)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_ranks_repeated_candidates_and_waves(spark):
    """Every row of the answer, ranks and repeats included, for one wave and for many."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(1500)]
    rows += [(17, rows[17][1])] * 40 + [(40, rows[40][1])] * 3
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    want = []
    for q in range(0, 1500, 20):
        v = good[q][1]
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:20]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    before = topk.PARTITION_ROWS
    try:
        for part_rows, wave in ((before, None), (50, 2)):
            topk.PARTITION_ROWS = part_rows
            out = topk.top_k(frame, F.col("vec_id") % 20 == 0, block=16, wave_parts=wave)
            assert sorted(map(tuple, out.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)
    finally:
        topk.PARTITION_ROWS = before
    assert topk.waves_of(31, 2) == 3 and topk.waves_of(4, 8) == 1


def test_large_components_are_exact_to_the_end_of_64_bits(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    end = 2**63 - 1
    rows = [(i, [float(rng.choice([0, 1, -1, 3.5, 2.0**24, -(2.0**24), 2.0**30, -(2.0**30), 4e7, 1e30, -1e300]) if rng.random() < 0.3 else rng.uniform(-9, 9)) for _ in range(8)]) for i in range(90)]
    rows += [(100, [2.0**24] * 8), (101, [2.0**24] * 8), (102, [4e7, 1.0]), (103, [-(2.0**24)] * 8)]
    clip = lambda x: max(-end, min(end, x))
    whole = {i: [clip(math.floor(64 * x)) for x in v] for i, v in rows}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k, block in ((20, 16), (200, 7)):
        out = topk.top_k(frame, F.col("vec_id") % 20 == 0, k=k, block=block).collect()
        got = {q: [(r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] for q in whole if q % 20 == 0}
        for q in got:
            scores = [(clip(sum(x * y for x, y in zip(whole[q], v, strict=False))), i) for i, v in whole.items() if i != q]
            assert got[q] == [(i, s) for s, i in sorted(scores, key=lambda x: (-x[0], x[1]))[:k]]
    two = spark.createDataFrame([(0, [2.0**24] * 8), (1, [2.0**24] * 8), (2, [4e7, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(two, F.col("vec_id") == 0).collect()] == [(1, end), (2, 2**30 * (64 * 40000000 + 64))]


def test_blocks_below_the_bound_are_skipped():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.integers(-3, 4, (64, 8)) + 40, rng.integers(-3, 4, (640, 8))]).astype(np.int64)
    best, ids, scored = topk.search_blocks(np.array([-1]), np.ones((1, 8), np.int64), np.arange(704), rows, 5, 32)
    order = np.lexsort((np.arange(704), -rows.sum(1)))[:5]
    assert ids[0].tolist() == order.tolist() and best[0].tolist() == rows.sum(1)[order].tolist() and scored <= 3


# --- mixing ------------------------------------------------------------------------------------------------------------


def test_mix_reaches_targets_and_repeats_at_most_twice(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["hot"] * 6 + ["b", "c", "", None])) for i in range(900)]
    out = mixing.mix(docs(spark, rows)).collect()
    assert {r["doc_id"]: r["size"] for r in out} == {i: len(t.split()) for i, t, _ in rows}
    taken, size, target = Counter(), Counter(), {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert all(r["source_size"] == size[r["source"]] for r in out)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    weights = dict(zip(["", "b", "c", "hot", None], [3, 1, 2, 3, 1]))
    free = [target[s] / weights[s] for s in target if target[s] < 2 * size[s] - 1e-9]
    assert max(free) - min(free) < 1e-6 and all(target[s] <= 2 * size[s] for s in target)
    assert all(abs(taken[s] - target[s]) <= 61 for s in target) and sum(taken.values()) <= 1.5 * sum(size.values())
    again = mixing.mix(docs(spark, rows[::-1])).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mix_is_the_same_with_more_buckets(spark):
    assert [mixing.bucket_digits(n, 10) for n in (0, 40960, 40961, 16**4 * 10 + 1)] == [3, 3, 4, 5]
    rows = [(None if i % 50 == 0 else i, "w " * (i % 7), "ab"[i % 3 == 0]) for i in range(400)] + [(7, "w w", "a")] * 3
    few, many = (Counter(map(tuple, mixing.mix(docs(spark, rows), bucket_rows=n).collect())) for n in (1 << 17, 0.001))
    assert few == many and sum(few.values()) == 403


def test_mix_on_odd_rows(spark):
    assert mixing.mix(docs(spark, [])).collect() == []
    out = mixing.mix(docs(spark, [(1, None, "a"), (2, "", None), (None, " ", "a")])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in out] == [(0, 0, 0.0)] * 3
    out = mixing.mix(docs(spark, ODD)).collect()
    assert len(out) == len(ODD)


# --- licenses ----------------------------------------------------------------------------------------------------------


def brute_licenses(text, templates):
    """Templates of which some stretch of the text, as long as the template or longer by its slack, holds 80% of the shingles."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    own = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    have, out = set(own), set()
    for k, (_, line) in enumerate(templates):
        w = re.findall(r"[^\W_]+", line.lower())
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        if not s or len(have & s) < 0.8 * len(s):
            continue
        slack = licenses.SLACK + len(w) // 5
        at = [i for i, x in enumerate(own) if x in s]
        starts = {i + d for i in at for d in (0, -slack, -len(w), -len(w) - slack)}
        if any(len({own[i] for i in at if a <= i <= a + len(w) + 2 * slack - 5} & s) >= 0.8 * len(s) for a in starts):
            out.add(k)
    return out


@pytest.mark.parametrize("templates", [licenses.TEMPLATES, licenses.ALL_TEMPLATES])
def test_licenses_equal_brute_force(spark, templates):
    d = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"], "s") for r in read(spark, d, "documents").select("doc_id", "text").collect()]
    full = " ".join(t for _, t in templates)
    rows += [(10**6, None, "s"), (10**6 + 1, "", "s"), (10**6 + 2, "MIT License", "s"), (10**6 + 3, "x " * 50000 + full, "s"), (10**6 + 4, "a b c " + licenses.TEMPLATES[6][1].replace("modify", "alter") + " z", "s")]
    rows += [rows[-1], rows[-1]]  # repeated rows
    got = defaultdict(set)
    phrases = 0
    for r in licenses.scan_licenses(docs(spark, rows), templates=templates).collect():
        phrases += r["notice"] >= len(templates)
        if r["notice"] < len(templates):
            got[r["doc_id"]].add(r["notice"])
        assert r["containment"] >= 0.8 and r["start_word"] < r["end_word"]
    assert dict(got) == {i: s for i, t, _ in rows if (s := brute_licenses(t, templates))}
    assert licenses.scan_licenses(docs(spark, []), templates=templates).collect() == []


def test_many_notices_in_one_long_text(spark):
    notice = licenses.TEMPLATES[6][1]
    rng = random.Random(4)
    text = " ".join(f"{' '.join(rng.choice('abcdefgh') * 3 for _ in range(40))} {notice}" for _ in range(600))
    out = licenses.scan_licenses(docs(spark, [(1, text, "s")])).where("notice = 6").collect()
    assert len(out) == 600 and all(r["containment"] == 1.0 for r in out)


NOTICES = {
    "SPDX-License-Identifier: MIT": "MIT", "MIT License\n\nCopyright (c) 2020 Someone": "MIT", "GNU GENERAL PUBLIC LICENSE Version 3": "GPL-3.0", "Released under the BSD 3-Clause License": "BSD-3-Clause",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.': "as-is-disclaimer",
    "Licensed under CC BY-ND 4.0": "CC-BY-ND-4.0", "Licensed under the MIT License.": "MIT", "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
}


def test_usual_notices_are_found(spark):
    lines = list(NOTICES)
    rows = [(i, f"some words before it and {t} and some words after it", "s") for i, t in enumerate(lines)]
    found = defaultdict(set)
    for r in licenses.scan_licenses(docs(spark, rows), templates=licenses.ALL_TEMPLATES).collect():
        found[r["doc_id"]].add(r["license"])
    assert all(NOTICES[t] in found[i] for i, t in enumerate(lines)), dict(found)


def test_long_texts_are_found_with_edits_and_each_occurrence_counts(spark):
    """Every eleventh word of a license text changed keeps too few shingles; every thirtieth keeps enough. Repeats are rows of their own."""
    rng, rows, want = random.Random(3), [], {}
    base = len(licenses.TEMPLATES) + len(licenses.MORE_NOTICES)
    for k, (_, text) in enumerate(licenses.LONG_TEXTS):
        words = re.findall(r"[^\W_]+", text)
        shingles = {tuple(w.lower() for w in words[i : i + 5]) for i in range(len(words) - 4)}
        for every in (11, 30, 40, 1000):
            for _ in range(5):
                cut = [f"edit{rng.random()}".replace(".", "") if i % every == every - 1 else w for i, w in enumerate(words)]
                own = {tuple(w.lower() for w in cut[i : i + 5]) for i in range(len(cut) - 4)}
                want[len(rows), base + k] = len(own & shingles) / len(shingles)
                lead = [f"lead{i}" for i in range(rng.randrange(40))]
                rows.append((len(rows), " ".join([*lead, *cut, "tail"]), "s"))
    twice = len(rows)
    line = licenses.TEMPLATES[5][1]
    rows.append((twice, f"a {line} {line} between {line} z", "s"))
    spans, got = [], {}
    for r in licenses.scan_licenses(docs(spark, rows), templates=licenses.ALL_TEMPLATES).collect():
        if r["doc_id"] == twice and r["notice"] == 5:
            spans.append((r["start_word"], r["end_word"]))
        got[r["doc_id"], r["notice"]] = r["containment"]
    assert sorted(spans) == [(1, 13), (13, 25), (26, 38)]
    for key, share in want.items():
        assert (key in got) == (share >= 0.8), (key, share)
        assert key not in got or abs(got[key] - share) < 1e-9


# --- URLs --------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, host int, verdict string"


def judged(spark, urls, **k):
    frame = spark.createDataFrame([(i, u, None, 1, "z") for i, u in enumerate(urls)], PAGES)
    return {r["page_id"]: r for r in url_filter.judge_urls(frame, **k).collect()}


def test_url_rules_and_odd_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7x?q", "https://x.com/en/1", "https://com/en/1", "ftp://b.example.net/de/8#t", "//net/de/1", "http://q.net/de/2", "http://org/es/", "http://notorg/es/", "a://b://c/en/", "http://h.com?x=/en/", "http://x.com/en/1"]
    out = judged(spark, urls)
    assert [(out[i]["host"], out[i]["path"]) for i in (0, 1, 2)] == [("", "")] * 3 and out[0]["verdict"] == "allow"
    assert [out[i]["rule"] for i in (3, 4, 5, 6, 8, 9, 10)] == ["example.com/en/7", "com/en/", "com/en/", "example.net/de/8", "net/de/", "org/es/", None]
    assert [out[i]["verdict"] for i in (3, 4, 6, 8, 9, 10)] == ["allow", "block", "block", "allow", "block", "allow"]
    assert (out[11]["host"], out[11]["path"], out[12]["path"], len(out)) == ("b:", "//c/en/", "", len(urls))
    assert judged(spark, []) == {}


def test_url_templates_generalise_from_two_branches(spark):
    rules = (("block", "bad.com/a/"), ("block", "bad.com/b/"), ("block", "one.com/a/"))
    urls = [f"http://bad.com/{s}/{i}" for s in "abc" for i in range(30)] + [f"http://one.com/{s}/{i}" for s in "ac" for i in range(30)]
    out = judged(spark, urls, rules=rules)
    assert out[75]["rule"] is None and out[75]["verdict"] == "block" and out[75]["template"] == "/*/#"
    # One labelled branch: the rest of the host takes the purity of the nearest node with enough labels, the host.
    assert out[140]["rule"] is None and out[140]["verdict"] == "block" and out[140]["template"] == "/c/#"
    few = judged(spark, [f"http://one.com/{s}/{i}" for s in "ac" for i in range(7)], rules=rules)
    assert few[10]["rule"] is None and few[10]["verdict"] == "allow"  # seven labels are too few to speak for others


def test_url_templates_use_the_whole_path(spark):
    """Paths that differ from the fifth segment on have templates of their own."""
    rules = (("block", "h.com/a/b/c/d/bad/x/"), ("block", "h.com/a/b/c/d/bad/y/"), ("allow", "h.com/a/b/c/d/good/"))
    urls = [f"http://h.com/a/b/c/d/{s}/{i}" for s in ("bad/x", "bad/y", "good/z") for i in range(30)] + ["http://h.com/a/b/c/d/other/1"]
    out = judged(spark, urls, rules=rules)
    assert out[0]["template"] == "/a/b/c/d/bad/*/#" and out[60]["template"] == "/a/b/c/d/good/z/#"
    assert out[90]["rule"] is None and out[90]["template"] not in (out[0]["template"], out[60]["template"])


def test_wide_nodes_keep_labelled_branches_that_differ(spark):
    rules = (("block", "w.com/a/"), ("block", "v.com/a/"), ("block", "v.com/b/"), ("allow", "v.com/c/"))
    letters = [x + y for x in string.ascii_lowercase[3:9] for y in string.ascii_lowercase[:7]]
    urls = [f"http://{h}.com/{s}/{i}" for h in "wv" for s in [*"abc", *letters] for i in range(12)]
    out = judged(spark, urls, rules=rules)
    by = {u: out[i] for i, u in enumerate(urls)}
    assert by["http://w.com/dc/3"]["verdict"] == "block" and by["http://w.com/a/3"]["template"] == "/a/#" and by["http://w.com/dc/3"]["template"] == "/*/#"
    assert by["http://v.com/c/3"]["template"] == "/c/#" and by["http://v.com/dc/3"]["template"] == "/*/#" and by["http://v.com/dc/3"]["verdict"] == "allow"


def plain_tree(urls, rules):
    """Template and verdict of each URL by a recursion over plain dictionaries."""
    hosts, ruled = defaultdict(Counter), defaultdict(lambda: [0, 0])
    for host, path in urls:
        fits = [(len(r), v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        shape = re.sub("[0-9]+", "#", re.sub("^/", "", path))
        hosts[host][shape] += 1
        if fits:
            ruled[host, shape][0] += max(fits)[1] == "block"
            ruled[host, shape][1] += 1
    out = {}

    def walk(host, shapes, t, evidence):
        alive = {s: seg for s, seg in shapes.items() if seg}
        for s in shapes.keys() - alive.keys():
            b, n = evidence
            out[host, s] = (t, "block" if (b + 1) * 100 >= (n + 2) * 90 else "allow")
        children = defaultdict(lambda: [0, 0])
        for s, seg in alive.items():
            children[seg[0]] = [x + y for x, y in zip(children[seg[0]], ruled[host, s], strict=True)]
        labelled = [c for c in children if children[c][1]]
        tb, tn = (sum(children[c][k] for c in children) for k in (0, 1))
        below = defaultdict(dict)
        for s, seg in alive.items():
            b, n = children[seg[0]]
            if n:
                wild = len(labelled) >= 2 and (b * tn - n * tb) ** 2 <= 3.841459 * n * tb * (tn - tb)
            else:
                wild = len(children) > 32 or len(labelled) >= 2
            below["*" if wild and seg[0] else seg[0]][s] = seg[1:]
        for name, group in below.items():
            b, n = (sum(ruled[host, s][k] for s in group) for k in (0, 1))
            walk(host, group, f"{t}/{name}", (b, n) if n >= 8 else evidence)

    for host, shapes in hosts.items():
        b, n = (sum(ruled[host, s][k] for s in shapes) for k in (0, 1))
        walk(host, {s: s.split("/") for s in shapes}, "", (b, n) if n >= 8 else (0, 0))
    return out


def test_url_trees_equal_a_recursion(spark):
    rng = random.Random(11)
    rules = (("block", "a.com/x/"), ("allow", "a.com/x/y/"), ("block", "a.com/u/"), ("allow", "b.a.com/v/"), ("block", "c.com/"), ("allow", "c.com/w/w/w/w/w/w"), ("block", "d.com/p/q/r/s/t/u"))
    urls = []
    for _ in range(2500):
        host = rng.choice(["a.com", "b.a.com", "c.com", "d.com", "e.com"])
        depth = rng.randint(0, 7)
        urls.append((host, "".join("/" + rng.choice(["x", "y", "u", "v", "w", "", "p", f"n{rng.randrange(60)}x", str(rng.randrange(9)), "*"]) for _ in range(depth))))
    urls += [("d.com", f"/p/q/r/s/t/{c}{k}") for c in "uvw" for k in range(20)] + [("a.com", f"/k{chr(97 + k % 26)}{chr(97 + k // 26)}/z") for k in range(40)]
    want = plain_tree(urls, rules)
    out = judged(spark, [f"http://{h}{p}" for h, p in urls], rules=rules)
    for i, (host, path) in enumerate(urls):
        template, verdict = want[host, re.sub("[0-9]+", "#", re.sub("^/", "", path))]
        assert out[i]["template"] == template and (out[i]["rule"] or out[i]["verdict"] == verdict)
    assert {out[i]["verdict"] for i in out if out[i]["rule"] is None} == {"allow", "block"}


def test_long_and_repeated_urls(spark):
    urls = ["http://h.com/" + "a/" * 3000, "http://h.com/" + "b" * 100000, "http://h.com/a/b", "http://h.com/a/b", "http://h.com//", "http://h.com"]
    out = judged(spark, urls)
    assert len(out) == 6 and {r["verdict"] for r in out.values()} == {"allow"}
    assert out[2]["template"] == out[3]["template"] == "/a/b" and out[0]["template"] == "/" + "a/" * 3000 and out[4]["template"] == "//"


def test_rules_are_sorted_by_length():
    assert oracles.OP8.index("example.com/en/7") < oracles.OP8.index("'com/en/'")
