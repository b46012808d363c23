"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its text. Preference pairs put a document labelled 1 above one
labelled 0; the weights minimise the logistic loss of the feature differences (with a small ridge), by Newton
steps. Strengths are then set against the score quantile of the training sample that leaves out as many
documents as are labelled 0: a document at that quantile gets the threshold score, so that predicted = score >=
threshold is a cut by score quantile.

Features come from a text's bytes and words: shares of byte classes, of odd words, of repeated words and lines,
and sizes. All bytes of every text count, in chunks of bounded size.

The sample has at most about ``SAMPLE_ROWS`` labelled rows outside the held-out fold, chosen by a hash of the id (a
documented bound of fitting only). Labels of an id that contradict each other are left out.

Defined results: null and empty texts get the score of the all-zero text; without labels of both kinds every
score is 0.5; a null id is held out; repeated rows give repeated results; an empty table gives an empty
result; extra columns are ignored. The broadcast sample of ids and the weights are of fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS, PAIRS_PER_ROW, THRESHOLD, RIDGE = 6000, 8, 0.3, 1e-3
CHUNK = 1 << 20
#: Byte classes by their members.
CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c",
    b".", b",", b";:", b"!?", b"'\"`", b"()", b"[]{}", b"<>", b"|", b"*#", b"$%&", b"@", b"/\\", b"-_", b"+=~^", bytes(range(128, 256)),
    bytes([*range(9), *range(14, 32), 127]),
)
_ODD_WORD = re.compile(rb"(?:^|(?<=[\x20\x09-\x0D]))[^\x20\x09-\x0D]*[^A-Za-z0-9\x80-\xff.,;:!?'\"()\x20\x09-\x0D-][^\x20\x09-\x0D]*")
_UPPER_WORD = re.compile(rb"(?:^|(?<=[\x20\x09-\x0D]))[A-Z\x80-\xff]{2,}[^a-z\x20\x09-\x0D]*(?=[\x20\x09-\x0D]|$)")
N_FEATURES = len(CLASSES) + 9


def _class_matrix() -> np.ndarray:
    out = np.zeros((256, len(CLASSES)))
    for k, members in enumerate(CLASSES):
        out[list(members), k] = 1
    return out


def features(texts: list[bytes]) -> np.ndarray:
    """One row of features per text."""
    by_class, out = _class_matrix(), np.zeros((len(texts), N_FEATURES))
    for i, text in enumerate(texts):
        if not text:
            continue
        data = np.frombuffer(text, np.uint8)
        counts = np.zeros(256, np.int64)
        for at in range(0, len(data), CHUNK):
            counts += np.bincount(data[at : at + CHUNK], minlength=256)
        words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
        n, m = max(1, len(words)), max(1, len(lines))
        odd, upper = len(_ODD_WORD.findall(text)), len(_UPPER_WORD.findall(text))
        out[i, : len(CLASSES)] = np.sqrt(counts @ by_class / len(text))
        out[i, len(CLASSES) :] = (
            np.log1p(n), min(20.0, (len(text) - counts[32]) / n), odd / n, upper / n, 1 - len(set(words)) / n, 1 - len(set(lines)) / m,
            np.log1p(n / m), float(n < 4), float(len(words) > 0 and words[0][:1].isupper()),
        )
    return out


class Model:
    """Standardised linear strength and its shift to scores."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, shift: float) -> None:
        self.mean, self.scale, self.weight, self.shift = mean, scale, weight, shift

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weight + self.shift
        return 1 / (1 + np.exp(-z.clip(-500, 500)))


def fit(x: np.ndarray, label: np.ndarray, threshold: float = THRESHOLD) -> Model | None:
    """Bradley-Terry weights from all rows; pairs are drawn with a fixed seed."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = ((x - mean) / scale).clip(-8, 8)
    rng = np.random.default_rng(0)
    pairs = PAIRS_PER_ROW * len(x)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-(d @ w).clip(-500, 500)))
        slope = d.T @ (1 - p) / pairs - RIDGE * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    strength = z @ w
    cut = np.quantile(strength, len(bad) / len(x))
    return Model(mean, scale, w, float(np.log(threshold / (1 - threshold)) - cut))


def held_out(id_col: str):
    """The fold rule: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """A model of the labelled documents outside the held-out fold."""
    known = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("lid"))
    known = known.agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2")).where("y = y2").select("lid", "y")
    n = known.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64(F.col("lid").cast("string")), F.lit(1_000_000)) < min(1.0, SAMPLE_ROWS / n) * 1_000_000
    sample = known.where(draw)  # about SAMPLE_ROWS rows of two numbers, whatever the table's size
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(sample), F.col("id") == F.col("lid")).select("id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b["text"].cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([b["id"], b["y"].cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.mapInArrow(run, f"id {kind}, y int, x array<double>").orderBy("id", "x").toArrow()
    if not got.num_rows:
        return None
    x = np.array(got["x"].to_pylist(), float).reshape(got.num_rows, N_FEATURES)
    return fit(x, np.array(got["y"].to_pylist()))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    score = scorer(docs, labels, id_col, text_col)(F.coalesce(F.col(text_col), F.lit("")))
    scored = docs.select(id_col, held_out(id_col).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The input's rows and columns with a score of ``threshold`` or more."""
    return docs.where(scorer(docs, labels, id_col, text_col)(F.coalesce(F.col(text_col), F.lit(""))) >= threshold)


def scorer(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str):
    """A function of a non-null text column that gives its score under the model of these documents and labels."""
    model = learn(docs, labels, id_col, text_col)
    # Plain arrays: workers need not import this module to read them.
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.mean, model.scale, model.weight, model.shift))

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        if shared.value is None:
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(Model(*shared.value).scores(features([t.encode("utf-8", "surrogatepass") for t in texts])))

    return score
