"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features of a whole text, in four blocks of hashed n-grams: lower-case words and pairs of them, and word shapes (upper
and lower case, digits and marks, repeats squeezed) and pairs of those. A block's values are its counts over its total,
times a scale, so a text's length does not matter. The score is the logistic of a sparse dot product with 2^BITS
weights; an empty text is scored by the bias alone.

Training reads a sample of labelled rows, bounded in expectation by SAMPLE (each labelled row is taken with the same
probability, by a hash of its id), in one task, online: FTRL-proximal with per-coordinate rates, EPOCHS passes in the
order of that hash. Features are made in parallel; the trainer sees indices and values alone. The weights, a fixed
1 MB, are sent to every task. Scoring reads each text once.

Edges: null texts are scored like empty ones; rows with a null id or label train nothing; without any label the score
is 0.5; repeated labels of an id are averaged, and of rows that repeat a labelled id one (the least by its features)
trains; extra columns are ignored; an empty table gives no rows; ids are cast to long, and ids that are no numbers raise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infotraj.llm.common import table, text_slices

BITS = 18
SAMPLE = 4000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-5, 1e-4
#: Weight of a block's features: words, word pairs, shapes, shape pairs.
SCALE = (16.0, 16.0, 16.0, 16.0)
THRESHOLD = 0.7

_SHAPE = bytes(ord("x") if chr(b).islower() and b < 128 or b >= 128 else ord("X") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else 32 if b in b" \t\n\x0b\x0c\r" else b for b in range(256))


def _hashes(words: list[bytes], salt: int) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter([h(w, salt) for w in words], np.uint64, len(words))


def _pairs(h: np.ndarray) -> np.ndarray:
    return (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93) if len(h) > 1 else h[:0]


def shapes(raw: bytes) -> list[bytes]:
    """The shape of each word: repeats of a class are squeezed to one."""
    a = np.frombuffer(raw.translate(_SHAPE), dtype=np.uint8)
    if not a.size:
        return []
    keep = np.ones(a.size, dtype=bool)
    keep[1:] = a[1:] != a[:-1]
    return a[keep].tobytes().split()


def blocks(text: str, known: dict[bytes, int]) -> list[np.ndarray]:
    """Feature indices of each block, with repeats. known: hashes of shapes seen so far (there are few)."""
    raw = text.encode()
    w = _hashes(raw.lower().split() if raw.isascii() else text.lower().encode().split(), 1)
    found = shapes(raw)
    if len(known) > 1 << 16:
        known.clear()
    for x in {*found} - known.keys():
        known[x] = xxhash.xxh64_intdigest(x, 2)
    s = np.fromiter([known[x] for x in found], np.uint64, len(found))
    return [(x >> np.uint64(64 - BITS)).astype(np.int32) for x in (w, _pairs(w), s, _pairs(s))]


def sparse(text: str, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct feature indices and their values."""
    each = blocks(text, known)
    index = np.concatenate(each)
    value = np.concatenate([np.full(len(b), c / max(1, len(b))) for b, c in zip(each, SCALE, strict=True)])
    distinct, at = np.unique(index, return_inverse=True)
    return distinct, np.bincount(at, value, len(distinct))


def score_text(text: str, weights: np.ndarray, known: dict[bytes, int]) -> float:
    total = float(weights[-1])
    for index, scale in zip(blocks(text, known), SCALE, strict=True):
        if len(index):
            total += scale * float(weights[index].sum(dtype=np.float64)) / len(index)
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, total))))


class Ftrl:
    """FTRL-proximal for the logistic loss; the last coordinate is the bias."""

    def __init__(self, size: int = 1 << BITS):
        self.z = np.zeros(size + 1)
        self.n = np.zeros(size + 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: float) -> None:
        i, x = np.append(index, len(self.z) - 1), np.append(value, 1.0)
        w = self.at(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g

    def weights(self) -> np.ndarray:
        return self.at(np.arange(len(self.z))).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", usable: Column | None = None) -> np.ndarray:
    """The weights, bias last, learned from the texts of docs whose labels are 0 or 1 and usable (a condition on the labels' id)."""
    marked = labels.select(F.col(id_col).cast("long").alias("key"), F.col(label_col).cast("double").alias("y")).where("key is not null and y in (0, 1)")
    marked = marked.where(usable) if usable is not None else marked
    marked = table(marked.groupBy("key").agg(F.avg("y").alias("y")), "labelled")
    share = min(1.0, SAMPLE / max(1, marked.count()))
    order = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    chosen = marked.withColumn("order", order).where(F.col("order") < int(share * (1 << 30)))  # about SAMPLE distinct ids

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                each = [sparse(x, known) for x in texts]
                cols = [pa.array([i.tobytes() for i, _ in each], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in each], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("order"), part.column("y"), *cols], names=["key", "order", "y", "i", "v"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32).astype(float), y) for b in batches for i, v, y in zip(*(b.column(c).to_pylist() for c in "ivy"), strict=True)]
        model = Ftrl()
        for _ in range(EPOCHS):
            for i, v, y in rows:
                model.learn(i, v, y)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().tobytes()], pa.binary())], names=["w"])

    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "key")
    made = texts.mapInArrow(features, "key long, order long, y double, i binary, v binary")
    made = made.groupBy("key", "order", "y").agg(F.min(F.struct("i", "v")).alias("f")).select("key", "order", "y", "f.*")
    fitted = made.repartition(1).sortWithinPartitions("order", "key").mapInArrow(fit, "w binary").collect()  # one row of fixed size
    return np.frombuffer(fitted[0].w, np.float32) if fitted else np.zeros((1 << BITS) + 1, np.float32)


def score(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row of df."""
    sent = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, known = sent.value, {}
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                out = [score_text(x, w, known) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out, pa.float64())], names=["id", "score"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double")


def held_out(id_col: str, modulus: int, rest: int) -> Column:
    """Whether the id's remainder keeps it out of training; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def keep_good(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows that score under the threshold; the labels of every fourth id are left for testing."""
    weights = train(df, labels, id_col, text_col, usable=~held_out("key", 4, 2))
    sent = df.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        known: dict[bytes, int] = {}
        return pd.Series([score_text(x or "", sent.value, known) for x in texts], dtype="float64")

    return df.where(scored(F.col(text_col).cast("string")) >= threshold)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    weights = train(docs, labels, usable=~held_out("key", 4, 2))
    scored = score(docs, weights)
    return scored.select(F.col("id").alias("doc_id"), held_out("id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
