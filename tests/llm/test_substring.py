"""Substring dedup: filing, suffix trees and the whole operator against brute force."""

import random

import numpy as np
import pytest

from leafgrid.llm import substring

DOCS = "doc_id long, text string, lang string, d long, h long, g string, spans string"
SPACE = " \t\n\x0b\x0c\r"


def split(text):
    words, now = [], ""
    for c in text or "":
        if c in SPACE:
            words, now = words + [now] if now else words, ""
        else:
            now += c
    return words + [now] if now else words


def brute(rows, window):
    first = {}
    for i, t in rows:
        w = split(t)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, 2**63), 2**63 - 1 if i is None else i)
    out = []
    for i, t in rows:
        w, gone = split(t), set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (2**63 - 1 if i is None else i):
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1, 2, "g", "s") for i, t in rows], DOCS)
    return sorted(map(tuple, substring.drop_repeats(df, **options).select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


def texts(seed, n):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "c", "dd", "é", "x\x00y", "中"]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randint(4, 40))] for _ in range(6)]
    out = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(0, 4)):
            words += rnd.choice(passages) if rnd.random() < 0.5 else [rnd.choice(vocabulary) + str(rnd.randint(0, 3)) for _ in range(rnd.randint(0, 30))]
        out.append((i, "".join(w + rnd.choice([" ", "\n", " \t "]) for w in words)))
    return out


@pytest.mark.parametrize(("window", "prefix", "group"), [(5, 2, 4096), (5, 2, 3), (12, 8, 6), (7, 7, 4096), (10, 1, 2)])
def test_repeats_equal_brute_force(spark, window, prefix, group):
    rows = texts(window, 60)
    rows += [(None, rows[3][1]), (None, "q r s t u v w x y z a b c d"), (70, None), (71, ""), (3, rows[3][1]), (3, rows[4][1]), (72, rows[5][1].upper()), (80, "z " * 300), (81, "z " * 200), (82, "z y " * 90)]
    rows += [(90, "w" * 5000 + " a b c d e f g h i j k l"), (91, "w" * 5000 + " a b c d e f g h i j k l"), (92, "w" * 5001 + " a b c d e f g h i j k l")]
    assert run(spark, rows, window=window, prefix=prefix, group=group) == brute(rows, window)


def test_windows_of_fifty_words(spark):
    rnd = random.Random(1)
    new = lambda n: [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
    a, b, c = new(49), new(50), new(300)
    rows = [(5, " ".join(new(20) + a + new(3))), (6, " ".join(a + new(90))), (7, " ".join(new(70) + b)), (4, " ".join(b + new(1))), (9, " ".join(c)), (8, " ".join(c[:100] + ["other"] + c[101:])), (11, " ".join(c[40:90])), (12, " ".join(c))]
    got = run(spark, rows)
    assert got == brute(rows, 50)
    assert {i: n for i, _, n, _ in got} == {5: 0, 6: 0, 7: 50, 4: 0, 9: 299, 8: 0, 11: 50, 12: 300}


def test_long_texts_in_pieces(monkeypatch):
    rnd = random.Random(2)
    words = [rnd.choice("abcdef").encode() for _ in range(5000)]
    whole = substring.filed([b" ".join(words)], 20, 4, {})
    monkeypatch.setattr(substring, "PIECE", 300)
    monkeypatch.setattr(substring, "CHUNK", 1000)
    parts = substring.filed([b"", b" ".join(words), b"short text"], 20, 4, {})

    def windows(number, gram, span, digest, offsets, los):
        return sorted((lo + k, g) for g, n, a, z in zip(gram, span, offsets[:-1], offsets[1:], strict=True) for lo in los[a:z] for k in range(n + 1))

    assert windows(*whole) == windows(*parts) and set(parts[0].tolist()) == {1}
    assert [s for s, _ in windows(*parts)] == list(range(4981))
    assert len(substring.filed([b"z " * 500], 20, 4, {})[0]) == 1  # repeated places share a row


def test_nodes_are_equal_prefixes():
    words = np.random.default_rng(3).integers(0, 3, 400)
    for depth in (1, 2, 3, 5, 8, 11):
        node = substring.deep_nodes(words, depth)
        seen = {}
        assert all(seen.setdefault(tuple(words[i : i + depth]), node[i]) == node[i] for i in range(400 - depth + 1))
        assert len(seen) == len(set(node.tolist()))


def test_forests_end_where_groups_do(spark, monkeypatch):
    rows = texts(9, 80)
    monkeypatch.setattr(substring, "FOREST", 40)
    assert run(spark, rows, window=6, prefix=2) == brute(rows, 6)


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (None, " \n")]) == [(1, 0, 0, ""), (None, 0, 0, "")]
