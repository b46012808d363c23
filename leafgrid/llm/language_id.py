"""Language ID by prediction by partial matching (PPM) over bytes.

Per language, a context tree counts the bytes that follow each context of 0 to ``ORDER`` bytes in a sample of
labelled texts. A byte seen in a context codes with log2((total + distinct) / count) bits; an unseen one first
pays the escape, log2((total + distinct) / distinct), and is then coded in the context one byte shorter, down to a
uniform code over 256 bytes. A context that a language's tree lacks falls to its longest suffix at no
cost. With statistics frozen after training, the cost of a byte depends only on its longest context in the trees,
so all trees are compiled into one table (state, byte) -> bits per language, where the states are the joint contexts
of all languages (the ``MAX_STATES`` most frequent of the longest order; variable order comes from the suffix rule). A text's
code length is the exact sum over all its bytes; the language with the shortest code wins (ties: the first in
order), and the score is its posterior probability under equal priors.

All languages are learned. More than ``TABLE_LANGS`` are dealt evenly to several tables of ``MAX_STATES / TABLE_LANGS`` states per
language, of which a worker holds one at a time; a text is coded with each table, so time grows with the number of languages.
The sample has about ``SAMPLE_ROWS`` whole texts per language, chosen by a hash of id and text: a bound of fitting only. Their contexts are counted by a
grouped aggregate on the executors; no text reaches the driver. Every text is scored whole, in windows of ``WINDOW`` bytes that carry their context.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing could be learned; a null id
counts as the empty text in the fold rule and so is held out; repeated rows give repeated results; an empty table
gives an empty result; extra columns are ignored. A broadcast table is bounded by MAX_STATES * alphabet * TABLE_LANGS.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.llm.common import checkpointed

ORDER, MAX_STATES, TABLE_LANGS = 3, 8192, 4
#: Tables whose samples are counted in one job.
READ_TABLES = 16
SAMPLE_ROWS, WINDOW = 250, 1 << 20
_LETTER = re.compile(rb"[A-Za-z]")


def held_out(id_col: str) -> Column:
    """The fold rule: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


class Model:
    """Compiled context trees: langs, byte -> symbol (0: unseen), (3 symbols) -> state, (state, symbol) -> bits."""

    def __init__(self, langs: list[str], symbol: np.ndarray, size: int, state: np.ndarray, bits: np.ndarray) -> None:
        self.langs, self.symbol, self.size, self.state, self.bits = langs, symbol, size, state, bits


#: Counts of one language: per order k, arrays (context code * 256 + byte, count); a context's code has its bytes as base-256 digits.
Counts = list[tuple[np.ndarray, np.ndarray]]


def count_contexts(texts: list[bytes]) -> Counts:
    """How often each byte follows each context of 0 to ``ORDER`` bytes; texts start with the empty context."""
    grams: list[list[np.ndarray]] = [[] for _ in range(ORDER + 1)]
    for t in texts:
        for at in range(0, len(t), WINDOW):  # windows carry their context, so that long texts need no more memory
            low = max(0, at - ORDER)
            s = np.frombuffer(t, np.uint8)[low : at + WINDOW].astype(np.int64)
            code = s
            for k in range(ORDER + 1):
                grams[k].append(code[max(0, at - low - k) :])
                if len(s) <= k + 1:
                    break
                code = s[: len(s) - k - 1] * 256 ** (k + 1) + code[1:]
    empty = np.zeros(0, np.int64)
    return [np.unique(np.concatenate(g), return_counts=True) if g else (empty, empty) for g in grams]


def fit(samples: dict[str, list[bytes]], limit: int = MAX_STATES) -> Model | None:
    """Context trees of each language's texts, compiled to at most ``limit`` states."""
    counts = {k: count_contexts(texts) for k, texts in samples.items() if any(texts)}
    total: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(1, ORDER + 1):
        codes = np.concatenate([c[k][0] // 256 for c in counts.values()]) if counts else np.zeros(0, np.int64)
        keys, at = np.unique(codes, return_inverse=True)
        total.append((keys, np.bincount(at, np.concatenate([c[k][1] for c in counts.values()]) if counts else None, len(keys)).astype(np.int64)))
    return compile_trees(counts, choose_contexts(total, limit))


def choose_contexts(total: list[tuple[np.ndarray, np.ndarray]], limit: int) -> list[np.ndarray]:
    """Sorted codes of the contexts of each order: the most frequent ones with two or more occurrences, within ``limit`` in all."""
    contexts: list[np.ndarray] = [np.zeros(1, np.int64)]
    for k, (keys, n) in enumerate(total, 1):
        room = limit - sum(map(len, contexts))
        best = np.lexsort((keys, -n))[: max(0, room)]
        keep = np.sort(keys[best[n[best] >= 2]])
        # a context needs its suffix in the tree
        contexts.append(keep[np.isin(keep % 256 ** (k - 1), contexts[k - 1])])
    return contexts


def compile_trees(by_lang: dict[str, Counts], coded: list[np.ndarray]) -> Model | None:
    """One table of exact code lengths for the trees of all languages over the chosen contexts (base-256 codes)."""
    langs = sorted(by_lang)
    if not langs:
        return None
    used = np.unique(np.concatenate([by_lang[k][0][0] for k in langs]))
    size = len(used) + 1
    symbol = np.zeros(256, np.int64)
    symbol[used] = np.arange(1, size)

    def recoded(codes: np.ndarray, digits: int) -> np.ndarray:
        out = np.zeros(len(codes), np.int64)
        for p in range(digits):
            out += symbol[codes // 256**p % 256] * size**p
        return out

    counts = [[(recoded(c, k + 1), n) for k, (c, n) in enumerate(by_lang[lang])] for lang in langs]
    contexts = [recoded(c, k) for k, c in enumerate(coded)]  # symbols keep the order of bytes, so codes stay sorted
    first = np.cumsum([0, *map(len, contexts)])
    bits = np.full((first[-1], size, len(langs)), 8.0, np.float64)  # order -1: uniform over 256 bytes
    for j in range(len(langs)):
        for k in range(ORDER + 1):
            own = contexts[k]
            rows = np.arange(first[k], first[k + 1])
            parent = np.full((len(own), size), 8.0) if k == 0 else bits[first[k - 1] + np.searchsorted(contexts[k - 1], own % size ** (k - 1)), :, j]
            code, n = counts[j][k]
            at = np.searchsorted(own, code // size)
            inside = (at < len(own)) & (own[np.minimum(at, max(0, len(own) - 1))] == code // size) if len(own) else np.zeros(len(code), bool)
            seen = np.zeros((len(own), size))
            seen[at[inside], code[inside] % size] = n[inside]
            total, distinct = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                coded = np.log2((total + distinct) / seen)
                escaped = np.log2((total + distinct) / distinct) + parent
            bits[rows, :, j] = np.where(total == 0, parent, np.where(seen > 0, coded, escaped))
    # the longest suffix of three symbols that is a context; symbol 0 (unseen byte, text start) ends a context
    every = np.arange(size**ORDER)
    state = np.zeros(size**ORDER, np.int32)
    for k in range(1, ORDER + 1):
        suffix = every % size**k
        at = np.searchsorted(contexts[k], suffix)
        if len(contexts[k]):
            hit = contexts[k][np.minimum(at, len(contexts[k]) - 1)] == suffix
            for p in range(k):
                hit &= suffix // size**p % size != 0
            state[hit] = first[k] + at[hit]
    return Model(langs, symbol.astype(np.int32), size, state, bits.reshape(-1, len(langs)).astype(np.float32))


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits per text and language; text i is data[offsets[i]:offsets[i + 1]]."""
    out = np.zeros((len(offsets) - 1, len(model.langs)))
    size, end = model.size, int(offsets[-1])
    starts = np.unique(offsets[:-1])
    for s in range(int(offsets[0]), end, WINDOW):
        e = min(end, s + WINDOW)
        low = max(int(offsets[0]), s - ORDER)
        sym = model.symbol[data[low:e]]
        here = starts[(starts > s - ORDER) & (starts < e)]
        context = np.zeros(e - s, np.int32)
        for k in range(ORDER, 0, -1):
            before = np.zeros(e - s, np.int32)
            have = min(k, s - low)  # symbols before the window
            got = sym[s - low - have : e - low - k] if have == k else sym[: max(0, e - low - k)]
            before[len(before) - len(got) :] = got
            for j in range(k):  # the first bytes of a text have no such context
                at = here + j - s
                before[at[(at >= 0) & (at < e - s)]] = 0
            context = context * size + before
        cell = model.state[context] * size + sym[s - low :]
        cost = model.bits[cell]
        first = np.searchsorted(offsets, s, side="right") - 1
        last = np.searchsorted(offsets, e, side="left")
        cut = np.maximum(offsets[first:last], s) - s
        texts = np.arange(first, last)
        some = np.minimum(offsets[first + 1 : last + 1], e) - s > cut
        if some.any():
            out[texts[some]] += np.add.reduceat(cost, cut[some], axis=0, dtype=np.float64)
    return out


def _has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def classify(models: Iterable[Model], column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a string column."""
    n = len(column)
    langs, scores = ["und"] * n, np.zeros(n)
    if not n:
        return langs, scores
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    names: list[str] = []
    costs: list[np.ndarray] = []
    for model in models:
        names += model.langs
        costs.append(code_lengths(model, data, offsets))
    if not costs:
        return langs, scores
    bits = np.concatenate(costs, axis=1)
    best = bits.argmin(1)
    post = 1.0 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(n):
        if valid[i] and _has_letter(data[offsets[i] : offsets[i + 1]].tobytes()):
            langs[i], scores[i] = names[best[i]], post[i]
    return langs, scores


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Iterator[Model]:
    """Models of the documents outside the held-out fold, each of some of the languages, in order of language.

    Contexts are counted where the sampled texts are. Only counts leave the tasks, and the driver gets those of the chosen
    contexts alone: at most MAX_STATES * 256 * TABLE_LANGS numbers for a table, however long the texts are.
    """
    usable = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull())
    share = {r["lang"]: min(1.0, SAMPLE_ROWS / r["count"]) for r in usable.groupBy(F.col(lang_col).alias("lang")).count().collect()}
    langs, count = sorted(share), -(-len(share) // TABLE_LANGS)
    tables = [langs[len(langs) * i // count : len(langs) * (i + 1) // count] for i in range(count)]
    for at in range(0, count, READ_TABLES):
        rate, table_of = F.lit(None).cast("double"), F.lit(None).cast("int")
        for i, table in enumerate(tables[at : at + READ_TABLES]):
            for lang in table:
                rate = F.when(F.col(lang_col) == lang, F.lit(share[lang])).otherwise(rate)
                table_of = F.when(F.col(lang_col) == lang, F.lit(i)).otherwise(table_of)
        draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text_col), F.lit(1_000_000)) < rate * 1_000_000
        rows = usable.where(draw).select(table_of.alias("t"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        counted = rows.mapInArrow(_count_batches, "t int, lang string, k int, code long, n long").groupBy("t", "lang", "k", "code").agg(F.sum("n").alias("n"))
        counted = checkpointed(counted.withColumn("context", F.shiftright("code", 8)))
        limit = {i: MAX_STATES if count == 1 else MAX_STATES // TABLE_LANGS * len(t) for i, t in enumerate(tables[at : at + READ_TABLES])}
        chosen = _chosen(counted, limit)
        spark, known = docs.sparkSession, [(i, k, int(c)) for i, orders in chosen.items() for k, codes in enumerate(orders) for c in codes]
        wanted = spark.createDataFrame(known, "t int, k int, context long")  # at most MAX_STATES rows a table
        # Order 0 has one context, which every tree has.
        got = counted.join(F.broadcast(wanted), ["t", "k", "context"], "left_semi").select("t", "lang", "k", "code", "n").toArrow()
        part = {c: got[c].to_numpy() for c in ("t", "lang", "k", "code", "n")}
        for i, table in enumerate(tables[at : at + READ_TABLES]):
            by_lang: dict[str, Counts] = {}
            for lang in table:
                own = (part["t"] == i) & (part["lang"] == lang)
                if own.any():
                    by_lang[lang] = [_sorted(part["code"][own & (part["k"] == k)], part["n"][own & (part["k"] == k)]) for k in range(ORDER + 1)]
            if (model := compile_trees(by_lang, chosen.get(i, [np.zeros(1, np.int64)]))) is not None:
                yield model


def _sorted(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes)
    return codes[order], n[order]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts: dict[tuple[int, str], list[bytes]] = {}
        for t, lang, text in zip(b["t"].to_pylist(), b["lang"].to_pylist(), b["text"].cast(pa.large_binary()).to_pylist(), strict=True):
            texts.setdefault((t, lang), []).append(text)
        for (t, lang), own in texts.items():
            for k, (codes, n) in enumerate(count_contexts(own)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(codes), t, np.int32)), pa.array([lang] * len(codes), pa.string()), pa.array(np.full(len(codes), k, np.int32)), pa.array(codes), pa.array(n.astype(np.int64))],
                    names=["t", "lang", "k", "code", "n"],
                )


def _chosen(counted: DataFrame, limit: dict[int, int]) -> dict[int, list[np.ndarray]]:
    """The contexts of each table by order, chosen as ``choose_contexts`` does from at most MAX_STATES candidates an order."""
    total = counted.where("k > 0").groupBy("t", "k", "context").agg(F.sum("n").alias("n")).where("n >= 2")
    best = Window.partitionBy("t", "k").orderBy(F.col("n").desc(), "context")
    most = max(limit.values())
    top = total.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most).select("t", "k", "context", "n").toArrow()
    got = {c: top[c].to_numpy() for c in ("t", "k", "context", "n")}
    out = {}
    for i, most in limit.items():
        own = [(got["t"] == i) & (got["k"] == k) for k in range(1, ORDER + 1)]
        out[i] = choose_contexts([_sorted(got["context"][o], got["n"][o]) for o in own], most)
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    # Plain arrays: workers need not import this module to read them.
    sc = docs.sparkSession.sparkContext
    shared = [sc.broadcast((m.langs, m.symbol, m.size, m.state, m.bits)) for m in learn(docs, id_col, text_col, lang_col)]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def known() -> Iterator[Model]:
            for table in shared:
                yield Model(*table.value)
                if len(shared) > 1:
                    vars(table).pop("_value", None)  # read again for the next batch, so that one table is in memory

        for b in batches:
            langs, scores = classify(known(), b["text"])
            yield pa.RecordBatch.from_arrays([b["id"], b["held_out"], pa.array(langs, pa.string()), pa.array(scores)], names=["id", "held_out", "lang_pred", "score"])

    plain = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
