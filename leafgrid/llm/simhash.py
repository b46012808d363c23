"""SimHash near-dedup with BK-trees.

Fingerprints: A-Z is lower-cased, words are runs of anything but ASCII space and the controls TAB to CR,
shingles are ``words`` consecutive words joined by one space (repeats count; a shorter text is one shingle).
A bit of the fingerprint is set if it is set in more than half of the shingles' XXH64 values (seed 42).
Texts without words, and null texts, have fingerprint zero, which links like any other.

Search: fingerprints within ``radius`` bits agree in one of radius + 1 segments of their bits (pigeonhole), so
each distinct fingerprint goes to radius + 1 shards, keyed by the value of one segment. A shard's BK-tree (children
keyed by their Hamming distance to the parent; only edges within the radius are followed) lives in the one task that the
shard's members meet in: a broadcast of all trees would grow with the corpus. Every shard of two or more has a tree; a task
builds and asks those of its shards side by side. A shard of more than ``SHARD`` fingerprints is not
gathered: its members are dealt anew by segments of the bits that they do not share, level by level; the last
level leaves at most ``LAST_BITS`` free bits, so no tree ever has more than 2**LAST_BITS nodes, and no pair is lost.
A shard emits a spanning star per group of linked members, never all pairs; groups are merged by
``connected_components``.

Defined results: copies share a fingerprint and count once in the search; repeated ids are kept as separate
rows; a null id belongs to its group but never names it unless all ids are null; an empty table gives an empty
result; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid.llm.common import checkpointed
from leafgrid.llm.graph import connected_components

RADIUS, SHARD, LAST_BITS = 2, 4096, 14
#: Rows that ask the trees at once.
CHUNK = 8192


def fingerprints(texts: list[bytes], words: int, seeds: tuple[int, ...]) -> np.ndarray:
    """One row per text, one SimHash (uint64) per seed."""
    out = np.zeros((len(texts), len(seeds)), np.uint64)
    table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
    place = (np.arange(8) * 256).astype(np.int16)
    weights = np.left_shift(np.uint64(1), np.arange(63, -1, -1, dtype=np.uint64))
    join = b" ".join
    for row, text in enumerate(texts):
        tokens = text.lower().split()
        if not tokens:
            continue
        if len(tokens) <= words:
            shingles = [join(tokens)]
        else:
            shingles = list(map(join, zip(*(tokens[i:] for i in range(words)))))
        for col, seed in enumerate(seeds):
            n, total = len(shingles), np.zeros(2048, np.int64)
            for at in range(0, n, 65536):  # bounds the memory of very long texts
                part = shingles[at : at + 65536]
                h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in part), np.uint64, len(part))
                total += np.bincount((h.astype(">u8").view(np.uint8).reshape(-1, 8) + place).ravel(), minlength=2048)
            ones = (total.reshape(8, 256) @ table).ravel()
            out[row, col] = weights[ones * 2 > n].sum(dtype=np.uint64)
    return out


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """(id, f0, f1, ...): signed 64-bit fingerprints, one per seed."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [f"f{i}" for i in range(len(seeds))]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["text"].cast(pa.binary()).to_pylist()
            f = fingerprints(texts, words, seeds).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["id"], *(pa.array(f[:, i]) for i in range(len(seeds)))], names=["id", *names])

    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return plain.mapInArrow(compute, f"id {kind}, " + ", ".join(f"{n} long" for n in names))


def _segments(free: int, parts: int) -> list[int]:
    """Masks that split the set bits of ``free`` into so many runs of nearly equal length."""
    bits = [b for b in range(64) if free >> b & 1]
    step = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in bits[step[i] : step[i + 1]]) for i in range(parts)]


def levels_of_masks(radius: int) -> list[dict[int, list[int]]]:
    """Per level, the masks of agreeing bits that follow from each mask of the level before (0 at first)."""
    out, now = [], {0: _segments(2**64 - 1, radius + 1)}
    while True:
        out.append(now)
        after = {m: [m | s for s in _segments(~m & (2**64 - 1), radius + 1)] for ms in now.values() for m in ms}
        if max((~m & (2**64 - 1)).bit_count() for ms in now.values() for m in ms) <= LAST_BITS:
            return out
        now = after


class _Sets:
    """Disjoint sets of 0..n-1 with array-at-a-time union; a root is the least member."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        r = p[x]
        while (up := p[r]).tolist() != r.tolist() if len(r) < 64 else not np.array_equal(up := p[r], r):
            r = up
        return r

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def forest_pairs(values: np.ndarray, shard: np.ndarray, radius: int, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of values of one shard within the radius of each other, by one BK-tree per shard.

    Rows of a shard stand together. The trees of all shards are built level by level: a node's pivot is its first row, its children
    are the other rows by distance to the pivot. The rows then ask, ``chunk`` at a time: a row goes from a node to the children whose
    distance differs from its own by the radius at most, and leaves where all rows come after it, since those meet it as askers.
    """
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    items, key = np.arange(len(values)), shard
    root = np.zeros(len(values), np.int64)
    while len(items):
        first = np.concatenate([[True], key[1:] != key[:-1]])
        node, pivots = np.cumsum(first) - 1, items[first]
        if not levels:
            root = node
        items, node = items[~first], node[~first]
        # a key is 128 * node + distance
        key = node * 128 + np.bitwise_count(values[items] ^ values[pivots[node]])
        order = np.argsort(key, kind="stable")
        items, key = items[order], key[order]
        levels.append((pivots, key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key))
    for at in range(0, len(values), chunk):
        asked = np.arange(at, min(len(values), at + chunk))
        node = root[asked]
        for pivots, children in levels:
            later = asked > pivots[node]
            asked, node = asked[later], node[later]
            if not len(asked):
                break
            away = np.bitwise_count(values[asked] ^ values[pivots[node]]).astype(np.int64)
            near = away <= radius
            if near.any():
                yield pivots[node[near]], asked[near]
            low = np.searchsorted(children, node * 128 + np.maximum(away - radius, 0))
            count = np.searchsorted(children, node * 128 + away + radius, side="right") - low
            asked = np.repeat(asked, count)
            node = np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(asked))


def bk_links(values: np.ndarray, radius: int, sets: _Sets, offset: int = 0) -> None:
    """Join in ``sets`` all values (distinct uint64) within the radius of each other, by a BK-tree."""
    for i, j in forest_pairs(values, np.zeros(len(values), np.int64), radius):
        sets.union(i + offset, j + offset)


def _solve(radius: int):
    """Kernel over rows (mask, key, fp) sorted by all three: spanning stars (a, b) of each shard's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = np.zeros((3, 0), np.int64)

        def stars(m: np.ndarray) -> pa.RecordBatch:
            mask, key, fp = m
            n, values = len(fp), fp.view(np.uint64)
            sets = _Sets(n)
            if n:
                shard = np.cumsum(np.concatenate([[False], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]))
                for i, j in forest_pairs(values, shard, radius):
                    sets.union(i, j)
            root = sets.roots(np.arange(n)) if n else np.zeros(0, int)
            linked = np.flatnonzero(root != np.arange(n))
            return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], names=["a", "b"])

        for b in batches:
            now = np.stack([b[c].to_numpy(zero_copy_only=False) for c in ("mask", "key", "fp")])
            now = np.concatenate([left, now], axis=1)
            if not now.shape[1]:
                continue
            other = np.flatnonzero((now[0] != now[0, -1]) | (now[1] != now[1, -1]))
            last = int(other[-1]) + 1 if len(other) else 0
            left = now[:, last:]  # the shard at the end may go on in the next batch
            if last:
                yield stars(np.ascontiguousarray(now[:, :last]))
        yield stars(np.ascontiguousarray(left))

    return run


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp) within ``radius`` bits of each other."""
    spark = fps.sparkSession
    rows, found = None, None
    levels = levels_of_masks(radius)
    for depth, level in enumerate(levels):
        if depth == 0:
            masks = F.array(*[F.lit(_signed(m)) for m in level[0]])
            base = fps.select("fp", F.explode(masks).alias("mask"))
        else:
            after = F.create_map(*[x for m, ms in level.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in ms]))])
            base = rows.select("fp", F.explode(F.element_at(after, F.col("mask"))).alias("mask"))
        rows = base.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        counts = checkpointed(rows.groupBy("mask", "key").count().where("count > 1"))
        last = depth == len(levels) - 1
        hot = counts.where(F.col("count") > shard).select("mask", "key")
        any_hot = not last and not hot.isEmpty()
        members = rows.join(counts.select("mask", "key") if not any_hot else counts.where(F.col("count") <= shard).select("mask", "key"), ["mask", "key"], "left_semi")
        members = members.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        links = checkpointed(members.mapInArrow(_solve(radius), "a long, b long"))
        found = links if found is None else found.union(links)
        if not any_hot:
            break
        rows = checkpointed(rows.join(hot, ["mask", "key"], "left_semi").select("fp", "mask"))
    return found if found is not None else spark.createDataFrame([], "a long, b long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (the smallest id that links reach)."""
    prints = checkpointed(with_fingerprints(docs, id_col, text_col, words).withColumnRenamed("f0", "fp"))
    least = checkpointed(prints.groupBy("fp").agg(F.min("id").alias("least")))
    components = connected_components(fingerprint_links(least.select("fp"), radius))
    components = checkpointed(components.withColumnRenamed("node", "fp").join(least, "fp"))
    names = checkpointed(components.groupBy("root").agg(F.min("least").alias("name")))
    linked = components.join(names, "root").select(F.col("fp").alias("lfp"), "name")
    named = checkpointed(
        least.join(linked, least["fp"] == linked["lfp"], "left").select("fp", F.coalesce("name", "least").alias("component_id"))
    )
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
