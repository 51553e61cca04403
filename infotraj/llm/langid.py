"""Language identification by n-gram filters that answer for all languages at once.

An n-gram is four bytes of the lower-case text in which everything that is no letter counts as a space. A bit-sliced
Bloom filter holds, at each of its positions, one bit a language; the AND of an n-gram's HASHES positions says which
languages contain it. A text's n-grams are looked up, the answers counted per language, and each count is corrected by
that language's rate of false positives: (count / n - f) / (1 - f), f being its share of set bits to the HASHES-th
power. The largest corrected share wins, ties going to the language with more training texts, then by name.

Training counts n-grams in a sample of labelled texts, bounded in expectation by SAMPLE texts a language (taken by a
hash of the id), whole. A language's filter gets its KEPT most frequent n-grams, but none that is under CONTRAST times
as frequent in it as in another language. The filter has a power of two positions, at least 12 for each n-gram
entered, so its size is bounded by the languages' number. Prediction reads every whole text once.

Edges: null texts and texts without a letter are `und` with score 0, as is everything when nothing could be learned; a
text too short for an n-gram gets the most frequent language and score 0; null ids and langs train nothing; repeated
rows and extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from infotraj.llm.common import text_slices
from infotraj.llm.quality import held_out

SAMPLE, KEPT, CONTRAST, HASHES = 1500, 20_000, 0.15, 3
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_LETTERS = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], dtype=np.uint8)
_LETTER = regex.compile(r"\p{L}")


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-byte n-grams of some texts as numbers, and how many each text has."""
    raw = [b" " + x.lower().encode() + b" " for x in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    a = _LETTERS[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    if a.size < 4:
        return np.zeros(0, np.uint32), np.zeros(len(raw), np.int64)
    w = a.astype(np.uint32)
    grams = w[:-3] | w[1:-2] << np.uint32(8) | w[2:-1] << np.uint32(16) | w[3:] << np.uint32(24)
    blank = (a == 32).astype(np.int8)
    doc = np.repeat(np.arange(len(raw)), sizes)
    good = (blank[:-3] + blank[1:-2] + blank[2:-1] + blank[3:] <= 1) & (doc[:-3] == doc[3:])
    return grams[good], np.bincount(doc[:-3][good], minlength=len(raw))


class Filter:
    """Bit-sliced Bloom filter: planes[p][position] holds the bits of languages 64p..64p+63."""

    def __init__(self, entries: list[np.ndarray]):
        n = sum(map(len, entries))
        self.bits = max(10, int(np.ceil(np.log2(max(1, 12 * n)))))
        kind = next(t for bits, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (1 << 60, np.uint64)) if len(entries) <= bits)
        self.planes = [np.zeros(1 << self.bits, dtype=kind) for _ in range(max(1, -(-len(entries) // 64)))]
        self.false = []
        for k, grams in enumerate(entries):
            plane, bit = self.planes[k // 64], kind(1 << k % 64)
            for at in self.positions(grams):
                plane[at] |= bit
            self.false.append(float((plane & bit != 0).mean() ** HASHES))

    def positions(self, grams: np.ndarray) -> list[np.ndarray]:
        g = grams.astype(np.uint64) + np.uint64(1)
        return [(g * np.uint64(m) ^ (g * np.uint64(m)) >> np.uint64(31)) * np.uint64(_ODD[3]) >> np.uint64(64 - self.bits) for m in _ODD[:HASHES]]

    def counts(self, grams: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """For each text and language, how many n-grams the filter says the language has."""
        out = np.zeros((len(per_text), len(self.false)))
        full = np.flatnonzero(per_text)
        if not full.size:
            return out
        starts = (np.cumsum(per_text) - per_text)[full]
        at = self.positions(grams)
        for p, plane in enumerate(self.planes):
            found = plane[at[0]] & plane[at[1]] & plane[at[2]]
            for k in range(64 * p, min(len(self.false), 64 * p + 64)):
                out[full, k] = np.add.reduceat((found >> found.dtype.type(k % 64) & found.dtype.type(1)), starts, dtype=np.int64)
        return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", usable: Column | None = None) -> tuple[list[str], Filter]:
    """The languages, those with more texts first, and their filter."""
    marked = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).where("key is not null and lang is not null and text is not null")
    marked = marked.where(usable) if usable is not None else marked
    sizes = {r.lang: r["count"] for r in marked.groupBy("lang").count().collect()}  # a row a language
    langs = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not langs:
        return [], Filter([])
    share = F.lit(0.0)
    for name in langs:
        share = F.when(F.col("lang") == name, F.lit(min(1.0, SAMPLE / sizes[name]))).otherwise(share)
    sample = marked.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                names = part.column("lang").to_pylist()
                for name in sorted(set(names)):
                    grams, n = np.unique(ngrams([x for x, y in zip(texts, names, strict=True) if y == name])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_lang, by_gram = Window.partitionBy("lang"), Window.partitionBy("gram")
    rates = counts.where("n > 1").withColumn("rate", F.col("n") / F.sum("n").over(by_lang))
    own = rates.withColumn("most", F.max("rate").over(by_gram)).where(F.col("rate") >= CONTRAST * F.col("most"))
    top = own.withColumn("k", F.row_number().over(by_lang.orderBy(F.desc("n"), "gram"))).where(F.col("k") <= KEPT)
    found: dict[str, list[int]] = {name: [] for name in langs}
    for r in top.select("lang", "gram").orderBy("lang", "gram").collect():  # at most KEPT a language
        found[r.lang].append(r.gram)
    return langs, Filter([np.array(found[name], dtype=np.uint32) for name in langs])


def identify(df: DataFrame, langs: list[str], filt: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row of df."""
    sent = df.sparkSession.sparkContext.broadcast(vars(filt))  # plain arrays: a worker need not have this package

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filter.__new__(Filter)
        vars(f).update(sent.value)
        false = np.array(f.false)
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                lettered = np.array([bool(_LETTER.search(x)) for x in texts], dtype=bool)
                grams, n = ngrams(texts)
                if langs:
                    share = (f.counts(grams, n) / np.maximum(n, 1)[:, None] - false) / np.maximum(1e-9, 1 - false)
                    best = share.argmax(axis=1)
                    top = np.where(lettered & (n > 0), np.clip(share.max(axis=1), 0, 1), 0.0)
                    named = [langs[b] if y else "und" for b, y in zip(np.where(n > 0, best, 0).tolist(), lettered.tolist(), strict=True)]
                else:
                    named, top = ["und"] * len(texts), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(named, pa.string()), pa.array(top)], names=["id", "lang_pred", "score"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, lang_pred string, score double")


def op3_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, filt = learn(docs, usable=~held_out("key", 3, 1))
    return identify(docs, langs, filt).select(F.col("id").alias("doc_id"), held_out("id", 3, 1).alias("held_out"), "lang_pred", "score")
