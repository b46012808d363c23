"""Lloyd's k-means over integer vectors, by two trees.

Components become floor(64 * x). Every task builds cover trees over its vectors, one per ``SHARD`` rows of its input, once:
a node has a centre (one of its vectors), a radius that covers its members, and children whose centres are more than
radius / ``BASE`` apart and cover their members within it; the centre is the centre of its first child too. A tree is
stored as its vectors in preorder: a row that begins nodes carries their ends and radii, outermost first, so a node is
an interval of rows and its centre the first of them.

Each round builds a cover tree over the centroids (k rows) and walks both trees: for a pair of nodes the distance of the
centres less both radii bounds all distances below; centroid nodes whose bound exceeds the least upper bound of the vector node
fall away. A vector node with one centroid left is assigned as a whole, and pairs of leaves are compared exactly, in
integers (Python's where 64 bits might not do). A round sends k rows of counts and component sums from each task, which
Spark adds up; k * dimensions sums reach the driver, as many as the centroids have. Trees are read from the
checkpoint in every round, and no vector is shuffled.

Defined results: vectors that are null, of other length than ``dims``, or hold null, NaN or infinite components are left out;
repeated ids and vectors are vectors of their own; a null id takes part (its hash is that of an empty number); equal hashes go by
id, then vector; fewer vectors than k give fewer centroids; equal distances go to the smaller centroid; scaled components beyond 64 bits
count as the nearest 64-bit number; a distance or inertia beyond 64 bits is null (the assignment is exact all the same);
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid.llm.common import checkpointed

SCALE, DIMS, K, ROUNDS = 64, 64, 16, 3
#: Rows of a cover tree, members up to which a node is a leaf, and how much smaller a child's radius is.
SHARD, LEAF, BASE = 2048, 8, 1.3
#: Share by which bounds are widened: far above the rounding of square roots.
SLACK = 1e-9


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    """(id, v array<long>) of the rows that take part."""
    v = F.col(vec_col)
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    down = lambda x: F.floor(x.cast("double") * SCALE)  # noqa: E731  saturates at the ends of 64 bits
    return vectors.where(v.isNotNull() & (F.size(v) == dims) & ~F.exists(v, odd)).select(F.col(id_col).cast("long").alias("id"), F.transform(v, down).alias("v"))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a (int64) to all rows of b: int64, or Python integers where sums might pass 64 bits."""
    most = 4.0 * a.shape[1] * max(float(np.abs(a.astype(np.float64)).max(initial=0)), float(np.abs(b.astype(np.float64)).max(initial=0))) ** 2
    if most < 2**52:  # exact in floating point, with a fast product
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)).astype(np.int64)
    if most >= 2**62:
        a, b = a.astype(object), b.astype(object)
    return np.stack([((a - row) ** 2).sum(1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


def _away(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(squares(points, centre[None, :])[:, 0].astype(np.float64))


class Tree:
    """A cover tree: rows in preorder and nodes [begin, end) with radii; ``after`` is the node behind a node's subtree."""

    def __init__(self, rows: np.ndarray, begin: np.ndarray, end: np.ndarray, radius: np.ndarray) -> None:
        self.rows, self.begin, self.end, self.radius = rows, begin, end, radius
        self.after = np.empty(len(begin), np.int64)
        above: list[int] = []
        for i in range(len(begin)):
            while above and end[above[-1]] <= begin[i]:
                self.after[above.pop()] = i
            above.append(i)
        self.after[above] = len(begin)

    def children(self, i: int) -> list[int]:
        out, j = [], i + 1
        while j < self.after[i]:
            out.append(j)
            j = int(self.after[j])
        return out


def cover_tree(rows: np.ndarray, leaf: int = LEAF, crowded: bool = True) -> tuple[np.ndarray, Tree]:
    """The order of the rows in preorder, and their tree. ``crowded``: a node whose members are nearly all apart is left whole, as a leaf."""
    order, nodes = [], []
    # A stack of (rows with the centre first, their distances to it) instead of recursion.
    stack = [(np.arange(len(rows)), _away(rows, rows[0]))] if len(rows) else []
    while stack:
        own, away = stack.pop()
        at, radius = len(order), float(away.max())
        nodes.append((at, at + len(own), radius * (1 + SLACK)))
        parts = []
        if len(own) > leaf and radius > 0:
            left, far = own, away
            while len(left):
                near = far <= radius / BASE
                parts.append((left[near], far[near]))
                left = left[~near]
                if crowded and len(parts) * 4 > len(own):
                    parts = []
                    break
                far = _away(rows[left], rows[left[0]]) if len(left) else far
        if len(parts) > 1:
            stack += parts[::-1]
        else:
            order += own.tolist()
    begin, end, radius = (np.array(x) for x in zip(*nodes, strict=True)) if nodes else (np.zeros(0, np.int64),) * 3
    at = np.array(order, np.int64)
    return at, Tree(rows[at], begin, end, radius)


def assign(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid (smallest number among equals) of each row of the tree, and how many distances of rows were compared."""
    numbers, right = cover_tree(centroids, leaf=1, crowded=False)
    out, compared = np.empty(len(tree.rows), np.int64), 0
    leafs = lambda node: right.after[node] == node + 1
    stack = [(0, np.zeros(1, np.int64))] if len(tree.rows) else []
    while stack:
        node, near = stack.pop()
        radius, below = tree.radius[node], tree.children(node)
        while len(wide := np.flatnonzero((right.radius[near] > (radius if below else -1)) & ~leafs(near))):
            near = np.concatenate([np.delete(near, wide), *(np.array(right.children(i)) for i in near[wide])])
        away = _away(right.rows[right.begin[near]], tree.rows[tree.begin[node]])
        least = (away + radius).min()
        near = near[away - radius - right.radius[near] <= least * (1 + SLACK)]
        own = slice(tree.begin[node], tree.end[node])
        if len(near) == 1 and right.end[near[0]] == right.begin[near[0]] + 1:
            out[own] = numbers[right.begin[near[0]]]
        elif below:
            stack += [(child, near) for child in below]
        else:
            some = np.sort(np.concatenate([numbers[right.begin[i] : right.end[i]] for i in near]))
            compared += (tree.end[node] - tree.begin[node]) * len(some)
            out[own] = some[squares(tree.rows[own], centroids[some]).argmin(axis=1)]
    return out, compared


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _plant(dims: int, shard: int):
    """Kernel: rows (id, v) -> rows in preorder of their cover trees, with the nodes that begin there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, shard):
                part = b.slice(at, shard)
                order, tree = cover_tree(_matrix(part["v"], dims))
                ends, radii = [[] for _ in order], [[] for _ in order]
                for begin, end, radius in zip(tree.begin.tolist(), tree.end.tolist(), tree.radius.tolist(), strict=True):
                    ends[begin].append(end)
                    radii[begin].append(radius)
                rows = part.take(pa.array(order))
                arrays = [rows["id"], rows["v"], pa.array(np.arange(len(order), dtype=np.int32)), pa.array(ends, pa.list_(pa.int32())), pa.array(radii, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "v", "pos", "ends", "radii"])

    return run


def _trees(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, Tree]]:
    """The trees of a partition, with the ids of their rows."""

    def grown(table: pa.Table) -> tuple[pa.Array, Tree]:
        ends, radii = table["ends"].combine_chunks(), table["radii"].combine_chunks()
        begin = np.repeat(np.arange(table.num_rows), np.diff(ends.offsets.to_numpy()))
        tree = Tree(_matrix(table["v"].combine_chunks(), dims), begin, ends.flatten().to_numpy().astype(np.int64), radii.flatten().to_numpy())
        return table["id"].combine_chunks(), tree

    rest = None
    for b in batches:
        table = pa.Table.from_batches([b])
        table = table if rest is None else pa.concat_tables([rest, table])
        cuts = np.flatnonzero(table["pos"].to_numpy() == 0)  # a tree may go on in the next batch
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            yield grown(table.slice(a, z - a))
        rest = table.slice(cuts[-1]) if len(cuts) else table
    if rest is not None and rest.num_rows:
        yield grown(rest)


def _sums(centroids: np.ndarray, dims: int):
    """Kernel of a round: (cluster, dim, n, high, low); a component sum is high * 2**32 + low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * len(centroids), [[0] * dims for _ in centroids]
        for _, tree in _trees(batches, dims):
            numbers, _ = assign(tree, centroids)
            for c in np.unique(numbers):
                own = tree.rows[numbers == c]
                small = float(np.abs(own.astype(np.float64)).max()) * len(own) < 2**62
                total = (own if small else own.astype(object)).sum(axis=0).tolist()
                counts[c] += len(own)
                sums[c] = [x + y for x, y in zip(sums[c], total, strict=True)]
        rows = [(c, d, n, sums[c][d] >> 32, sums[c][d] & 0xFFFFFFFF) for c, n in enumerate(counts) if n for d in range(dims)]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["cluster", "dim", "n", "high", "low"])

    return run


def _labels(centroids: np.ndarray, dims: int):
    """Kernel of the last pass: (id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches, dims):
            numbers, _ = assign(tree, centroids)
            distance = np.zeros(len(numbers), object)
            for c in np.unique(numbers):
                distance[numbers == c] = squares(tree.rows[numbers == c], centroids[c : c + 1])[:, 0].tolist()
            exact = pa.array([x if x < 2**63 else None for x in distance], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(numbers.astype(np.int32)), exact], names=["id", "cluster", "distance"])

    return run


def lloyd(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: int = 1, shard: int = SHARD) -> tuple[DataFrame, np.ndarray]:
    """(id_col, cluster, distance) of every vector after ``rounds`` rounds, and the final centroids.

    Centroids start as the k vectors with the smallest SHA-256 of "<seed>:<id>".
    """
    kept = integer_vectors(vectors, id_col, vec_col, dims)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = kept.orderBy(key, "id", "v").limit(k).select("v").collect()
    if not start:
        return kept.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dims), np.int64)
    centroids = np.array([r["v"] for r in start], np.int64)
    trees = checkpointed(kept.mapInArrow(_plant(dims, shard), "id long, v array<long>, pos int, ends array<int>, radii array<double>"))
    for _ in range(rounds):
        parts = trees.mapInArrow(_sums(centroids, dims), "cluster int, dim int, n long, high long, low long")
        total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
        for r in parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), total("high"), total("low")).collect():  # k * dims rows
            centroids[r["cluster"], r["dim"]] = (int(r["high"]) * 2**32 + int(r["low"])) // r["n"]
    found = trees.mapInArrow(_labels(centroids, dims), "id long, cluster int, distance long")
    return checkpointed(found).withColumnRenamed("id", id_col), centroids


def cluster_digest(labelled: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Each vector with the inertia of its cluster and of all, and the SHA-256 of its centroid."""
    spark = labelled.sparkSession
    whole = F.when(F.count(F.lit(1)) == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    per = {r["cluster"]: r["s"] for r in labelled.groupBy("cluster").agg(whole.alias("s")).collect()}  # k rows
    fits = lambda x: int(x) if x is not None and x < 2**63 else None
    inertia = None if None in per.values() else fits(sum(per.values()))
    rows = [(c, fits(per.get(c)), inertia, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labelled.join(F.broadcast(table), "cluster")  # k rows
