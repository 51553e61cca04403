"""Quality rules: per-document counts, and lines that too many documents of one host share.

Every whole text is counted in one pass: words, their characters, symbols, repeated lines, and words inside 8-word
windows that occur twice. The same pass gives the hash of each of its distinct normalised lines (lower case, digits
as 0, white space squeezed). Documents of equal text within a host count as one: copies
of a clean text do not condemn each other.

A line is boilerplate where more than `min_docs` distinct documents of its host hold it, however large the host is: a
footer is one in a host of any size. `min_share`, 0 unless given, asks for more than that share of the host's distinct
documents too. Boilerplate lines are cut out of the texts (clean_texts); a document whose cleaned
text has less than `min_left` of its words is depleted and rejected. Documents have no host name here: their source
stands for it.

Counts are per (host, line) after each document has made its lines distinct, so a plain count, combined before its
shuffle, serves; a hot host or line is one key of a pre-aggregated sum. Only lines above the limits are joined back,
and only texts that hold some pass through Python again.

Edges: a null or empty text has no words and fails the base rules; a null host is a host of its own; repeated rows are
equal texts; rows that share an id are judged each by its own text; extra columns are ignored; an empty table gives no rows; ids are
cast to long, and ids that are no numbers raise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infotraj.llm.common import WHITE, free, table, text_slices

WINDOW = 8
MIN_DOCS, MIN_SHARE, MIN_LEFT = 20, 0.0, 0.3
_SYMBOLS = "#*$%&|<>"
_DIGITS = re.compile(rb"[0-9]+")

COUNTS = "id long, host string, row long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<long>"


def repeat_words(texts: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """For each list of words, how many of them lie in windows found twice or more in that list."""
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(counts.sum())
    out = np.zeros(len(texts), dtype=np.int64)
    if total < window:
        return out
    word = np.fromiter((hash(w) for x in texts for w in x), np.int64, total).view(np.uint64)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)
    h = doc[: total - window + 1] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(window):  # each place has its own odd multiplier; a shift between them mixes high bits into low ones
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word[k : total - window + 1 + k]
    h ^= h >> np.uint64(32)
    inside = np.flatnonzero(doc[: total - window + 1] == doc[window - 1 :])
    if not inside.size:
        return out
    h = h[inside]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = inside[order[twice]]
    if at.size:
        mark = np.zeros(total + 1, dtype=np.int64)
        np.add.at(mark, at, 1)
        np.add.at(mark, at + window, -1)
        covered = np.cumsum(mark[:-1]) > 0
        np.add.at(out, doc[covered].astype(np.int64), 1)
    return out


def normal(line: str) -> bytes:
    """Lower case, white space squeezed, each number as 0."""
    return _DIGITS.sub(b"0", b" ".join(line.lower().encode().split()))


def count_texts(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row for each row of df: its counts, and the hashes of its distinct normalised lines with the words that each takes up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                words = [x.encode().split() for x in texts]
                chars = [len(x) - sum(map(x.count, WHITE)) for x in texts]
                symbols = [sum(map(x.count, _SYMBOLS)) for x in texts]
                dups, lines, sizes = [], [], []
                for x in texts:
                    full = [line for line in x.split("\n") if line.strip(WHITE)]
                    dups.append(len(full) - len(set(full)))
                    own: dict[int, int] = {}
                    for line in map(normal, full):
                        h = xxhash.xxh64_intdigest(line) - (1 << 63)
                        own[h] = own.get(h, 0) + line.count(b" ") + 1
                    lines.append(list(own))
                    sizes.append(list(own.values()))
                cols = [part.column("id"), part.column("host"), part.column("row"), list(map(len, words)), chars, symbols, dups, repeat_words(words), lines, sizes]
                names = ["id", "host", "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"]
                types = [pa.int64(), pa.string(), *[pa.int64()] * 6, *[pa.list_(pa.int64())] * 2]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return slim_texts(df, id_col, text_col, host_col).mapInArrow(run, COUNTS)


def slim_texts(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(id, host, text, row) of each row of df: a null host apart from any name, row the hash of the text."""
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"))


def without_lines(text: str, cut: set[int]) -> str:
    """A text without the lines whose normalised form has one of these hashes."""
    return "\n".join(x for x in text.split("\n") if not x.strip(WHITE) or xxhash.xxh64_intdigest(normal(x)) - (1 << 63) not in cut)


JUDGED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "left_words", "kept"]


def judged(df: DataFrame, id_col: str, text_col: str, host_col: str, min_docs: int, min_share: float, min_left: float) -> DataFrame:
    """(id, host, row, cut, n_words, ..., kept) for each row of df; cut: the hashes of its lines above the limits."""
    counted = table(count_texts(df, id_col, text_col, host_col), "line-counts")
    distinct = counted.select("host", "row", F.arrays_zip("lines", "line_words").alias("lines")).dropDuplicates(["host", "row"])
    lines = table(distinct.select("host", "row", F.explode("lines").alias("x")).select("host", "row", F.col("x.lines").alias("h"), F.col("x.line_words").alias("n")), "host-lines")
    above = lines.groupBy("host", "h").agg(F.count("*").alias("docs_with")).where(F.col("docs_with") > min_docs)
    if min_share > 0:
        sizes = distinct.groupBy("host").agg(F.count("*").alias("docs"))
        above = above.join(sizes, "host").where(F.col("docs_with") > min_share * F.col("docs"))
    cuts = table(lines.join(above.select("host", "h"), ["host", "h"]).groupBy("host", "row").agg(F.collect_list("h").alias("cut"), F.sum("n").alias("lost")), "cut-lines")
    free(lines)
    out = counted.drop("lines", "line_words").join(cuts, ["host", "row"], "left").withColumn("left_words", F.col("n_words") - F.coalesce("lost", F.lit(0)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept = ~failed & (F.col("left_words") >= min_left * F.col("n_words"))
    return out.withColumns({"base_failed": failed, "kept": kept}).select("id", "host", "row", "cut", *JUDGED)


def clean_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """(id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, left_words, kept) for each row of df.

    The text is without its boilerplate lines; a null text stays null. The counts but left_words are of the whole text.
    """

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else without_lines(t, set(c)) for t, c in zip(texts, cuts, strict=True)], dtype="object")

    verdicts = judged(df, id_col, text_col, host_col, min_docs, min_share, min_left).drop("id").dropDuplicates(["host", "row"])
    texts = slim_texts(df, id_col, text_col, host_col).join(verdicts.hint("merge"), ["host", "row"])
    texts = texts.withColumn("clean", cleaned(F.when(F.col("cut").isNotNull(), F.col("text")), "cut"))
    return texts.select("id", F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.col("clean")).alias("text"), *JUDGED)


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """clean_texts without the texts, which are read once and never shuffled."""
    return judged(df, id_col, text_col, host_col, min_docs, min_share, min_left).select("id", *JUDGED)


def op2_linefreq(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).withColumnRenamed("id", "doc_id")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
f AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM f GROUP BY doc_id),
w AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM w) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM t, range(0, 8) AS x(k) GROUP BY doc_id),
z AS (SELECT doc_id, source, text, regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[0-9]+', '0', 'g') AS line, n FROM f),
y AS (SELECT DISTINCT source, text, line FROM z),
a AS (SELECT source, line FROM y GROUP BY source, line HAVING count(*) > 20),
g AS (SELECT doc_id, sum(n)::BIGINT AS lost FROM z JOIN a ON z.source IS NOT DISTINCT FROM a.source AND z.line = a.line GROUP BY doc_id),
b AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(ws)::BIGINT - coalesce(lost, 0) AS left_words
  FROM d LEFT JOIN u USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN g USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND left_words >= 0.3 * n_words AS kept FROM b
"""
