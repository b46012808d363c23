"""Substring dedup by prefix-partitioned suffix trees over words.

A window is ``WINDOW`` consecutive words of one document; a word goes if a window covers it whose word sequence also starts in a
document with a smaller id. A window is a suffix of its document, cut at ``WINDOW`` words. Suffixes are not shipped one by
one: each is filed under the prefix of a sparse suffix, the ``PREFIX``-word gram with the least hash among its grams (leftmost
among equals). Equal windows have the same least gram at the same place, so they meet under one prefix, and neighbouring
windows share theirs: about one row (prefix, document, first and last window) stands for 22 windows, and places of one document that
agree in all their words share a row.

1. Exact copies of a text in a smaller id are set aside: all of their windows start there too.
2. Prefixes that occur in one document only fall away by an aggregate. The others are counted.
3. Prefixes with at most ``GROUP`` rows are groups that a task can hold. Their rows bring the words around them, and a task
   builds the suffix trees of its groups level by level: the nodes at depth 2d follow from those at depth d. Internal nodes at
   depth ``WINDOW`` over two or more documents are the repeats; leaves of larger ids than the node's least are covered.
4. The rows of a more frequent prefix that agree in all their words (128 bits of their SHA-256) collapse: those of larger ids than the least are covered
   as a whole, first within salted shares of such a class, then among what the shares leave. What is left of a prefix goes to step 3 if it is a group
   now; else the prefix is lengthened to the whole window: its subtrees have one deep node each, named by the window's SHA-256,
   whose least id an aggregate finds. So no hot prefix is gathered, and hot windows are joined back by a join that Spark can split.
5. Spans return to their documents; texts are shuffled once for steps 3 to 5.

Defined results: null text has no words; a null id counts as larger than every id and is not smaller than another null; repeated
rows are equal documents, none smaller, so both stay as they are; a document repeats itself without loss; documents
under ``WINDOW`` words lose nothing; an empty table gives an empty result; extra columns are ignored. Words of more than
``LONG_WORD`` bytes are compared by their SHA-256. Very long texts are hashed in pieces that overlap by a window. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.llm.common import checkpointed, counted, stored

WINDOW, PREFIX, GROUP = 50, 8, 4096
LONG_WORD = 64
#: Bytes of text whose grams are hashed at once, words of a piece of a long text, and words of the trees that are built at once.
CHUNK, PIECE, FOREST = 1 << 20, 100_000, 400_000
#: Salted shares of the rows of a hot prefix that agree: at least so many, and one more for so many rows in all.
SHARES, SHARE_ROWS = 32, 250_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = np.uint64((1 << 22) - 1)
_LAST = 2**63 - 1


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        v, size = np.minimum(v[:-size], v[size:]), size * 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size :]) if width > size else v


def filed(texts: list[bytes], window: int, prefix: int, tables: dict) -> tuple[np.ndarray, ...]:
    """All windows of the texts by their least gram: text number, gram, windows less one, digest of the words, and the first windows of
    all places of the text that agree in these (offsets and values)."""
    out: list[tuple[np.ndarray, ...]] = []
    digests: list[bytes] = []
    buffer: list[bytes] = []
    pieces: list[tuple[int, int, int]] = []  # text number, place of the first word, words
    held = 0

    def flush() -> None:
        nonlocal held
        data = b"".join(buffer)
        raw = np.frombuffer(data, np.uint8)
        if len(raw) > len(tables.get("up", ())):
            tables["up"], tables["down"] = _powers(_BASE, len(raw)), _powers(_BACK, len(raw))
        ends = np.flatnonzero(raw == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * tables["up"][: len(raw)], dtype=np.uint64)])
        grams = len(ends) - prefix + 1
        h = _mixed((sums[ends[prefix - 1 :]] - sums[starts[:grams]]) * tables["down"][starts[:grams]])
        least = _sliding_min((h & ~_PLACE) | np.arange(grams, dtype=np.uint64), window - prefix + 1)
        sizes = np.array([n for _, _, n in pieces])
        first = np.cumsum(sizes) - sizes
        windows = sizes - window + 1
        piece = np.repeat(np.arange(len(pieces)), windows)
        begin = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows) + first[piece]
        at = (least[begin] & _PLACE).astype(np.int64)
        run = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])]))
        last = np.concatenate([run[1:], [len(at)]]) - 1
        number, offset = (np.array([p[i] for p in pieces]) for i in (0, 1))
        shift = (offset - first)[piece[run]]
        spans = zip(starts[begin[run]].tolist(), ends[begin[last] + window - 1].tolist(), strict=True)
        digests.extend(hashlib.sha256(data[a:z]).digest()[:16] for a, z in spans)
        out.append((number[piece[run]], h[at[run]].view(np.int64), begin[run] + shift, begin[last] - begin[run]))
        buffer.clear()
        pieces.clear()
        held = 0

    for number, text in enumerate(texts):
        words = text.split()
        for at in range(0, max(1, len(words) - window + 1), PIECE):
            part = words[at : at + PIECE + window - 1]
            if len(part) < window:
                continue
            buffer.append(b" ".join(part) + b" ")
            pieces.append((number, at, len(part)))
            held += len(buffer[-1])
            if held >= CHUNK:
                flush()
    if pieces:
        flush()
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros((0, 16), np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64))
    number_, gram, lo, span = (np.concatenate(x) for x in zip(*out, strict=True))
    digest = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)
    high, low = np.ascontiguousarray(digest).view(np.int64).T
    order = np.lexsort((lo, low, high, gram, number_))
    number_, gram, lo, span, digest, high, low = (x[order] for x in (number_, gram, lo, span, digest, high, low))
    new = np.concatenate([[True], (number_[1:] != number_[:-1]) | (gram[1:] != gram[:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
    return number_[new], gram[new], span[new], digest[new], np.concatenate([np.flatnonzero(new), [len(lo)]]), lo


def _file(window: int, prefix: int):
    """Kernel: (d, h, text) -> (g, d, h, span, r, los)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict = {}
        for b in batches:
            number, g, span, digest, offsets, los = filed(b["text"].cast(pa.binary()).to_pylist(), window, prefix, tables)
            at = pa.array(number)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(los.astype(np.int32)))
            r = pa.array([x.tobytes() for x in digest], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(g), b["d"].take(at), b["h"].take(at), pa.array(span.astype(np.int32)), r, lists], names=["g", "d", "h", "span", "r", "los"])

    return run


def _short(words: list[bytes]) -> list[bytes]:
    return [w if len(w) <= LONG_WORD else b"\0" + hashlib.sha256(w).hexdigest().encode() for w in words]


def _regions(window: int):
    """Kernel: (d, h, text, marks of (g, span, los)) -> (g, d, h, los, words from the first window's start to the last one's end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for d, h, text, marks in zip(b["d"].to_pylist(), b["h"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), b["marks"].to_pylist(), strict=True):
                words = _short(text.split())
                rows += [(m["g"], d, h, m["los"], b" ".join(words[m["los"][0] : m["los"][0] + m["span"] + window])) for m in marks]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            for at in range(0, len(rows), 10_000):  # bounded batches
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 10_000], t) for c, t in zip(columns, kinds, strict=True)], names=["g", "d", "h", "los", "words"])

    return run


def _windows(window: int):
    """Kernel: (d, h, text, marks) -> (w, d, h, starts): the SHA-256 of every window of the marks, and where it starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, h, text, marks in zip(b["d"].to_pylist(), b["h"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), b["marks"].to_pylist(), strict=True):
                words = _short(text.split())
                found = [(m["los"], k) for m in marks for k in range(m["span"] + 1)]
                for at in range(0, len(found), 100_000):
                    part = found[at : at + 100_000]
                    w = [hashlib.sha256(b" ".join(words[los[0] + k : los[0] + k + window])).digest() for los, k in part]
                    starts = [[lo + k for lo in los] for los, k in part]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array([d] * n, pa.int64()), pa.array([h] * n, pa.int64()), pa.array(starts, pa.list_(pa.int32()))], names=["w", "d", "h", "starts"])

    return run


def deep_nodes(words: np.ndarray, depth: int) -> np.ndarray:
    """For each place but the last depth - 1, the number of its suffix's node at the depth (equal for equal words only)."""
    node, size = words, 1
    while size < depth:
        step = min(size, depth - size)
        pair = node[:-step] * (int(node.max()) + 1) + node[step:]
        node, size = np.unique(pair, return_inverse=True)[1], size + step
    return node


def covered(d: np.ndarray, bodies: list[bytes], window: int) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) within its body of the words of each row that windows cover which also start in a row of a smaller d."""
    names: dict[bytes, int] = {}
    split = [body.split(b" ") for body in bodies]
    sizes = np.array([len(x) for x in split])
    words = np.fromiter((names.setdefault(w, len(names)) for x in split for w in x), np.int64, int(sizes.sum()))
    row = np.repeat(np.arange(len(bodies)), sizes - window + 1)
    first = np.cumsum(sizes) - sizes
    windows = sizes - window + 1
    at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    node = deep_nodes(words, window)[at + first[row]]
    least = np.full(int(node.max()) + 1, _LAST)
    np.minimum.at(least, node, d[row])
    gone = np.flatnonzero(d[row] > least[node])
    if len(gone):
        cut = np.concatenate([[True], (row[gone][1:] != row[gone][:-1]) | (at[gone][1:] != at[gone][:-1] + 1)])
        begin, end = gone[cut], gone[np.concatenate([cut[1:], [True]])]
        yield from zip(row[begin].tolist(), at[begin].tolist(), (at[end] + window).tolist(), strict=True)


def _trees(window: int):
    """Kernel over (g, d, h, los, words) sorted by g: the spans (d, h, array of start and end) that the groups' suffix trees cover."""
    most = max(1, FOREST // (2 * window))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        d, h = (t[c].to_numpy() for c in ("d", "h"))
        found = list(covered(d, t["words"].to_pylist(), window)) if t.num_rows else []
        row = np.array([f[0] for f in found], np.int64)
        los = t["los"].combine_chunks().take(pa.array(row)).to_pylist()
        spans = [[{"start": lo + a, "end": lo + z} for lo in own] for own, (_, a, z) in zip(los, found, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(d[row]), pa.array(h[row]), pa.array(spans, kind)], names=["d", "h", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            at = 0
            g = b["g"].to_numpy()
            while at < b.num_rows:
                upto = min(b.num_rows, at + most)
                # A forest ends where a group does: at the last change of the prefix up to here.
                change = np.flatnonzero(g[at:upto] != np.concatenate([[_last(held, g, at)], g[at : upto - 1]]))
                if rows + upto - at >= most and len(change) and (held or change[-1] > 0):
                    end = at + int(change[-1])
                    yield solve([*held, b.slice(at, end - at)])
                    held, rows, at = [], 0, end
                held.append(b.slice(at, upto - at))
                rows, at = rows + upto - at, upto
        if held:
            yield solve(held)

    return run


def _last(held: list[pa.RecordBatch], g: np.ndarray, at: int) -> int:
    """The prefix of the row before ``at`` (its own, if it is the first)."""
    return int(g[at - 1]) if at else held[-1]["g"][held[-1].num_rows - 1].as_py() if held else int(g[0])


def _keep(window: int):
    """Kernel: (doc, text, spans) -> (doc, n_words, n_removed, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, kept = [], [], []
            for text, spans in zip(b["text"].cast(pa.binary()).to_pylist(), b["spans"].to_pylist(), strict=True):
                words = text.split()
                n, at, left = len(words), 0, []
                for s in sorted((x["start"], x["end"]) for x in spans or []) if n >= window else ():
                    left += words[at : max(at, s[0])]
                    at = max(at, s[1])
                left += words[at:]
                total.append(n)
                removed.append(n - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([b["doc"], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc", "n_words", "n_removed", "kept"])

    return run


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """(id_col, n_words, n_removed, kept): each document without the words that repeat a smaller document's windows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.col(id_col).cast("long")
    rows = docs.select(doc.alias("doc"), F.coalesce(doc, F.lit(_LAST)).alias("d"), text.alias("text")).select("doc", "d", "text", F.unhex(F.sha2("text", 256)).alias("sha"))
    twins = rows.groupBy("sha").agg(F.min("d").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "lead")
    rows = rows.join(counted(checkpointed(twins)), "sha", "left")
    copy = F.coalesce(F.col("lead") < F.col("d"), F.lit(False))
    own = rows.where(~copy).select("doc", "d", F.xxhash64("sha").alias("h"), "text")
    files = stored(own.select("d", "h", "text").mapInArrow(_file(window, prefix), "g long, d long, h long, span int, r binary, los array<int>"))
    shared = files.groupBy("g").agg(F.min("d").alias("a"), F.max("d").alias("z"), F.count(F.lit(1)).alias("n")).where("a < z")
    shared = stored(shared.select("g", (F.col("n") > group).alias("hot")))
    place = ["g", "d", "h", "span", "los"]
    marked, whole = files.select(place).join(shared.where("not hot").select("g"), "g"), None
    span = lambda starts, length: F.transform(starts, lambda s: F.struct(s.alias("start"), (s + length).alias("end")))
    spans = []
    if not shared.where("hot").isEmpty():
        # Hot prefixes are at most rows / group many.
        shares = max(SHARES, files.count() // SHARE_ROWS)
        rows_of_hot = files.join(counted(shared.where("hot").select("g")), "g").withColumn("share", F.pmod(F.xxhash64("d"), F.lit(shares)))
        twin = lambda *keys: F.col("d") > F.min("d").over(Window.partitionBy(*keys))
        within = stored(rows_of_hot.withColumn("twin", twin("g", "r", "share")))
        rest = stored(within.where("not twin").withColumn("twin", twin("g", "r")))  # at most ``shares`` documents a class
        gone = within.where("twin").select(place).union(rest.where("twin").select(place))
        spans.append(gone.select("d", "h", span("los", F.col("span") + window).alias("spans")))
        sizes = checkpointed(rest.where("not twin").groupBy("g").agg((F.count(F.lit(1)) > group).alias("hot")))
        left = lambda hot: rest.where("not twin").select(place).join(counted(sizes.where(F.col("hot") == hot).select("g")), "g")
        marked = marked.union(left(False))
        whole = None if sizes.where("hot").isEmpty() else left(True)
    marks = lambda rows: rows.groupBy("d", "h").agg(F.collect_list(F.struct("g", "span", "los")).alias("marks"))
    dealt = own.repartition("d", "h")  # one exchange of the texts, read by the joins below
    near = dealt.join(marks(marked), ["d", "h"]).select("d", "h", "text", "marks").mapInArrow(_regions(window), "g long, d long, h long, los array<int>, words binary")
    kind = "d long, h long, spans array<struct<start:int,end:int>>"
    spans.append(near.repartition("g").sortWithinPartitions("g").mapInArrow(_trees(window), kind))
    if whole is not None:
        whole = dealt.join(marks(whole), ["d", "h"]).select("d", "h", "text", "marks").mapInArrow(_windows(window), "w binary, d long, h long, starts array<int>")
        least = whole.groupBy("w").agg(F.min("d").alias("a"), F.max("d").alias("z")).where("a < z").select("w", "a")
        spans.append(whole.join(least, "w").where("d > a").select("d", "h", span("starts", F.lit(window)).alias("spans")))
    spans = reduce(DataFrame.union, spans).groupBy("d", "h").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.lit(2**31 - 1).alias("end")))
    split = dealt.join(spans, ["d", "h"], "left").select("doc", "text", "spans").union(rows.where(copy).select("doc", "text", all_of_it.alias("spans")))
    return split.mapInArrow(_keep(window), "doc long, n_words long, n_removed long, kept string").withColumnRenamed("doc", id_col)
