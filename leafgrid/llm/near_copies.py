"""Near copies by SimHash with BK-trees at a chosen Jaccard similarity of word shingles.

Texts of Jaccard similarity 0.8 on five-word shingles differ in about ten bits of a 64-bit SimHash, beyond what a
pigeonhole over fingerprint bits can shard. So the shards of this operator come from MinHash bands
(``BANDS`` bands of ``ROWS`` values: at similarity 0.8 a pair misses every shard with probability 0.2%); within a shard
a BK-tree over the SimHashes finds the pairs within ``RADIUS`` bits (four standard deviations above the mean at 0.8).
A pair of which at least the share ``similarity - SLACK`` of the ``VALUES`` MinHash values agree (an estimate with standard error 0.025
at 0.8, so the slack is six of them) is then compared exactly: it is a link if the Jaccard similarity of its shingle sets (as sorted 64-bit
hashes) is ``similarity`` or more. Groups are the connected components of the links; the document with the smallest id of each group stays.

A shard of more than ``TILE`` documents is cut into tiles of about that size. First each tile is searched together with up to
``PIVOTS`` documents of the whole shard, which joins large groups at a cost linear in the shard. Then pairs of tiles are
searched, each pair in a task of its own, but only pairs between different groups (``second_tiles``): a pair of documents
already in one group needs no comparison, and no other pair is lost. What stays quadratic is the part of a shard that shares a band
with many documents and links to none of them. A task emits a spanning star per group of linked documents. Only documents
that share a band travel with their sketches and sets, and of shards with the same members only one is searched.

Defined results: A-Z is lower-cased; words are runs of anything but ASCII space and the controls TAB to CR; a text of
fewer words than a shingle is one shingle; null texts and texts without words link to nothing and stay; rows that agree in id and
text are one document, and all stay or go; an empty table gives an empty result; all input columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.llm.common import checkpointed, counted, under_own_names
from leafgrid.llm.graph import connected_components
from leafgrid.llm.simhash import _Sets, forest_pairs

VALUES, BANDS, ROWS, RADIUS, TILE, PIVOTS = 256, 12, 4, 22, 2048, 64
#: Taken off the similarity before an estimate is held against it: six standard errors at 0.8. Pairs above are compared exactly.
SLACK = 0.15
#: Pairs compared exactly before those joined meanwhile are left out.
VERIFY = 256


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, VALUES, dtype=np.uint64)


def shingle_set(text: bytes, words: int) -> np.ndarray | None:
    """Sorted distinct hashes of a text's shingles; None without words."""
    tokens = text.lower().split()
    if not tokens:
        return None
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = list(map(b" ".join, zip(*(tokens[i:] for i in range(words)))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles)))


def sketch(text: bytes, words: int, a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray] | None:
    """SimHash (of distinct shingles) and MinHash values of a text; None without words."""
    h = shingle_set(text, words)
    if h is None:
        return None
    ones, least = np.zeros(64, np.int64), np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 512):
        part = h[at : at + 512]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        mixed = part[:, None] * a + b
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(0))
    weights = np.left_shift(np.uint64(1), np.arange(63, -1, -1, dtype=np.uint64))
    return int(weights[ones * 2 > len(h)].sum(dtype=np.uint64)), least


def node_of(id_col: str, text_col: str) -> Column:
    """Name of a document: 128 bits (md5, base 64) of its id and text."""
    both = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col(text_col), F.lit("")))
    return F.substring(F.base64(F.unhex(F.md5(both))), 1, 22)


def _sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients()
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for n, text in enumerate(batch["text"].cast(pa.binary()).to_pylist()):
                made = sketch(text, words, a, b)
                if made is None:
                    continue
                f, least = made
                out[0].append(n)
                out[1].append(f - 2**64 if f >= 2**63 else f)
                out[2].append((least % np.uint64(251)).astype(np.uint8).tobytes())
                out[3].append([xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) - 2**63 for k in range(BANDS)])
            rows = batch.take(pa.array(out[0], pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [rows["id"], rows["node"], pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int64()))],
                names=["id", "node", "f", "values", "keys"],
            )

    plain = docs.select(F.col(id_col).alias("id"), node_of(id_col, text_col).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return plain.mapInArrow(run, f"id {kind}, node string, f long, values binary, keys array<long>")


def _shingle_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(node, shingles) of the given nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(t, words).tobytes() for t in batch["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(made, pa.binary())], names=["node", "shingles"])

    texts = docs.select(node_of(id_col, text_col).alias("node"), F.col(text_col).alias("text"))
    return texts.join(nodes, "node", "left_semi").mapInArrow(run, "node string, shingles binary").dropDuplicates(["node"])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def tree_links(f: np.ndarray, shard: np.ndarray, values: np.ndarray, shingles: list[np.ndarray], similarity: float, sets: _Sets, radius: int = RADIUS) -> None:
    """Join in ``sets`` all documents of one shard whose SimHashes lie within the radius and whose shingle sets are similar enough.

    Rows of a shard stand together; the BK-trees of all shards are searched side by side.
    """
    lengths = np.array([len(s) for s in shingles])

    def apart(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        two = sets.roots(p) != sets.roots(q)
        return p[two], q[two]

    for i, j in forest_pairs(f, shard, radius):
        for at in range(0, len(i), 20000):
            p, q = apart(i[at : at + 20000], j[at : at + 20000])
            if not len(p):
                continue
            alike = np.minimum(lengths[p], lengths[q]) / np.maximum(lengths[p], lengths[q]) >= similarity
            p, q = p[alike], q[alike]
            alike = (values[p] == values[q]).mean(1) >= similarity - SLACK
            p, q = p[alike], q[alike]
            while len(p):
                now = np.array([jaccard(shingles[x], shingles[y]) >= similarity for x, y in zip(p[:VERIFY], q[:VERIFY])])
                sets.union(p[:VERIFY][now], q[:VERIFY][now])
                p, q = apart(p[VERIFY:], q[VERIFY:])


def _blobs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8), offsets


def _solve(similarity: float):
    """Kernel over rows sorted by (key, tile): spanning stars (a, b) of each shard's links."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(held).combine_chunks()
        column = lambda c: rows[c].chunk(0)
        key, tile = column("key").to_numpy(), column("tile").to_numpy()
        shard = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])]))
        data, offsets = _blobs(column("values"))
        values = data[offsets[0] : offsets[-1]].reshape(-1, VALUES)
        data, offsets = _blobs(column("shingles"))
        shingles = [data[a:b].view(np.uint64) if a % 8 == 0 else np.frombuffer(data[a:b].tobytes(), np.uint64) for a, b in zip(offsets[:-1], offsets[1:])]
        sets = _Sets(len(shard))
        tree_links(column("f").to_numpy().view(np.uint64), shard, values, shingles, similarity, sets)
        root = sets.roots(np.arange(len(shard)))
        some = np.flatnonzero(root != np.arange(len(shard)))
        if not len(some):
            return None
        nodes = column("node")
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(some)), nodes.take(pa.array(root[some]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows up to the last shard's, which may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            key, tile = b["key"].to_numpy(), b["tile"].to_numpy()
            if held and (held[-1]["key"][-1].as_py(), held[-1]["tile"][-1].as_py()) != (key[0], tile[0]):
                if (out := stars(held)) is not None:
                    yield out
                held = []
            other = np.flatnonzero((key != key[-1]) | (tile != tile[-1]))
            if len(other):
                if (out := stars([*held, b.slice(0, int(other[-1]) + 1)])) is not None:
                    yield out
                held = [b.slice(int(other[-1]) + 1)]
            else:
                held.append(b)
        if held and (out := stars(held)) is not None:
            yield out

    return run


def _span(low: Column, high: Column) -> Column:
    """The numbers from low up to, not including, high."""
    return F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))


def _tiles_of(count: Column, tile: int) -> Column:
    return F.ceil(count / tile).cast("long")


def _tile(node: str, tiles: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), node), tiles)


def first_tiles(shared: DataFrame, tile: int) -> DataFrame:
    """(key, node, tile): each member of a shard in one tile, plus up to ``PIVOTS`` pivots of a cut shard in all its tiles."""
    own = shared.select("key", "node", _tile("node", _tiles_of(F.col("count"), tile)).alias("tile"))
    cut = shared.where(F.col("count") > tile)
    pivots = cut.groupBy("key", "count", F.pmod(F.xxhash64(F.lit(4), "node"), F.lit(PIVOTS)).alias("slot")).agg(F.min("node").alias("node"))
    everywhere = pivots.select("key", "node", F.explode(_span(F.lit(0).cast("long"), _tiles_of(F.col("count"), tile))).alias("tile"))
    return own.unionByName(everywhere)


def second_tiles(cut: DataFrame, groups: DataFrame, tile: int) -> DataFrame:
    """(key, node, tile): the pairs of tiles of cut shards that can still hold a link between two groups.

    A group with at least ``tile`` members in a shard has tiles of its own, and two tiles of one group are never paired. All other
    members share the tiles 0 .. rest - 1 of the shard, which are paired with every tile. So a shard that is one group has no pairs, and
    a shard of one group and at most a tile of others costs as many rows as it has members, plus the others once a tile.
    """
    named = checkpointed(cut.join(groups, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    big = checkpointed(named.groupBy("key", "root").count().where(F.col("count") >= tile).withColumn("n", _tiles_of(F.col("count"), tile)))
    placed = named.join(big.select("key", "root", "n"), ["key", "root"], "left")
    placed = checkpointed(placed)
    rest = placed.where("n is null").groupBy("key").count().select("key", _tiles_of(F.col("count"), tile).alias("rest"))
    before = Window.partitionBy("key").orderBy("root").rowsBetween(Window.unboundedPreceding, -1)
    spans = big.join(rest, "key", "left").select(
        "key", "root", "n", (F.coalesce("rest", F.lit(0)) + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("low")
    )
    totals = spans.groupBy("key").agg(F.max(F.col("low") + F.col("n")).alias("total"))
    spans = checkpointed(spans.join(totals, "key").select("key", "root", "low", "total"))
    alone = rest.join(totals, "key", "left").select("key", "rest", F.coalesce("total", "rest").alias("total"))
    alone = checkpointed(alone)
    zero = F.lit(0).cast("long")
    of_rest = placed.where("n is null").select("key", "node").join(alone, "key").select(
        "key", "node", "total", _tile("node", F.col("rest")).alias("mine"), _span(zero, F.col("total")).alias("others")
    )
    of_big = placed.where("n is not null").join(spans, ["key", "root"]).select(
        "key", "node", "total", (F.col("low") + _tile("node", F.col("n"))).alias("mine"),
        F.concat(_span(zero, F.col("low")), _span(F.col("low") + F.col("n"), F.col("total"))).alias("others"),
    )
    every = of_rest.unionByName(of_big).select("key", "node", "total", "mine", F.explode("others").alias("other"))
    pair = F.least("mine", "other") * F.col("total") + F.greatest("mine", "other")
    return every.select("key", "node", pair.alias("tile"))


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, id, keeper) of the documents in groups of two or more; keeper is true for the one that stays."""
    sketches = checkpointed(_sketches(docs, id_col, text_col, words))
    keyed = sketches.select("node", F.explode("keys").alias("key")).distinct()
    members = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("count"), *[F.bit_xor(F.xxhash64(F.lit(10 + k), "node")).alias(f"x{k}") for k in (0, 1)])
    # Shards of the same members (told by 128 bits) have the same links.
    shards = checkpointed(members.where("count > 1").groupBy("count", "x0", "x1").agg(F.min("key").alias("key")).select("key", "count"))
    shared = keyed.join(shards, "key").select("key", "node", "count")
    sets = _shingle_sets(docs, counted(checkpointed(shared.select("node").distinct())), id_col, text_col, words)
    known = checkpointed(sets.join(sketches.select("node", "f", "values").dropDuplicates(["node"]), "node"))

    def solved(members: DataFrame) -> DataFrame:
        placed = checkpointed(members.distinct()).join(known, "node").select("key", "tile", "node", "f", "values", "shingles")
        placed = placed.repartition("key", "tile").sortWithinPartitions("key", "tile")
        return checkpointed(placed.mapInArrow(_solve(similarity), "a string, b string"))

    cut = shards.where(F.col("count") > TILE)
    groups = checkpointed(connected_components(solved(first_tiles(shared, TILE))))
    if not cut.isEmpty():
        more = solved(second_tiles(checkpointed(keyed.join(cut.select("key"), "key", "left_semi")), groups, TILE))
        if not more.isEmpty():
            stars = groups.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
            groups = checkpointed(connected_components(stars.union(more)))
    named = groups.join(sketches.select("node", "id").distinct(), "node")
    first = checkpointed(named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "node")).alias("m")))
    return named.join(first, "root").select("node", "id", (F.col("node") == F.col("m.node")).alias("keeper"))


@under_own_names
def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The input's rows and columns without near copies: one document of each group stays."""
    losers = near_copy_groups(docs, id_col, text_col, words, similarity).where("not keeper").select(F.col("node").alias("__node"))
    losers = counted(checkpointed(losers))
    return docs.withColumn("__own", node_of(id_col, text_col)).join(losers, F.col("__own") == F.col("__node"), "left_anti").drop("__own")
