"""Phrase collocations: frequent phrases by pivot partitioning, scored by how far their parts belong together.

1. Words are counted by language, and neighbouring words in a table of 2^22 cells by hash that each task fills up to the least count.
   Sums of full cells tell which neighbours may be frequent; cells of several neighbours let too many through, never too few.
2. All words have one order: the rarer ones (by the log of their own cell's count, then by hash) come last. A phrase belongs to its
   last word, its pivot, at that word's leftmost place in it.
3. Texts are rewritten for each pivot: the words before and after one of its places, up to the first that is rarer, stands behind
   infrequent neighbours, or would make the phrase too long. Equal fragments of a slice of text become one with a count and are routed
   by pivot, a row for each slice and bucket of pivots; those of very frequent words are dealt over several parts.
4. Each bucket counts the phrases of its pivots, and none else. Phrases below the least count go, at once where the pivot is whole.
5. Each phrase is cut in two at every place; both parts are themselves frequent, so joins find their counts. The lowest score
   counts. Phrases that stand nearly always inside a longer one are dropped: the longer by one word suffices, as it is the most frequent.

Tables sent to all tasks are of fixed size (2^20 bytes of word cells, 2^19 of neighbour bits), whatever the input. A word that stands in
all texts is a row a slice after counting.

Edges: a null or empty text has no words; a null language is `und`; repeated rows count again; ids are not read; an empty table gives no rows;
extra columns are ignored. Words are what stands between blanks, tabs and the marks that part pieces; only A to Z become lower case.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from infotraj.llm.common import free, sorted_runs, table, text_slices

MIN_COUNT, MOST_WORDS, TOP, CONTAINED = 100, 5, 2000, 100
#: Bits of the tables of word cells and of cells of neighbours; cells of a row; rows of one pivot that a part gets, as bits.
WORD_BITS, PAIR_BITS, ROW_BITS, PART_BITS = 20, 22, 16, 18
#: Words of the input for each bucket of pivots that is mined at a time.
BUCKET_WORDS = 1 << 20
#: Characters of text a slice, and words that a task remembers.
SLICE, REMEMBERED = 8 << 20, 1_000_000
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_EVEN = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of one language that a task has met, numbered, and the hash of each."""

    def __init__(self, lang: str):
        self.start = lang.encode() + b"\0"
        self.number: dict[bytes, int] = {b"": -2, b"\n": -1}
        self.words: list[bytes] = []
        self.hash = np.empty(0, dtype=np.uint64)

    def read(self, texts: list[str]) -> np.ndarray:
        """The numbers of all words in a row, -1 between pieces."""
        found = "\n".join(texts).encode().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        new = set(found) - self.number.keys()
        for w in new:
            self.number[w] = len(self.words)
            self.words.append(w)
        self.hash = np.append(self.hash, np.fromiter((xxhash.xxh64_intdigest(self.start + w, 42) for w in new), np.uint64, len(new)))
        ids = np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))
        return ids[ids != -2]

    def pair_cells(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        h = (self.hash[one] ^ (self.hash[one] >> np.uint64(31))) * _EVEN + self.hash[two]
        h = (h ^ (h >> np.uint64(29))) * _EVEN
        return (h >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def slices_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    for batch in batches:
        for part, texts in text_slices(batch, "text", SLICE):
            by: dict[str, list[str]] = defaultdict(list)
            for lang, x in zip(part.column("lang").to_pylist(), texts, strict=True):
                if x:
                    by[lang].append(x)
            yield from by.items()


def count_words(slim: DataFrame, min_count: int) -> DataFrame:
    """Rows (lang, word, n) of word counts and rows (part, row, cells) of cells of neighbours, filled up to min_count or 255."""
    full = min(min_count, 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        names = ["lang", "word", "n", "part", "row", "cells"]

        def counts(lang: str) -> pa.RecordBatch:
            w, n = seen[lang].words, sums.pop(lang)
            cols = [pa.array([lang] * len(w), pa.string()), pa.array(w, pa.binary()).cast(pa.string()), pa.array(n), *[pa.nulls(len(w), k) for k in kinds[3:]]]
            return pa.RecordBatch.from_arrays(cols, names=names)

        cells = np.zeros(1 << PAIR_BITS, dtype=np.uint32)
        seen: dict[str, Words] = {}
        sums: dict[str, np.ndarray] = {}
        for lang, texts in slices_by_language(batches):
            w = seen.setdefault(lang, Words(lang))
            ids = w.read(texts)
            n = np.bincount(ids[ids >= 0], minlength=len(w.words))
            if lang in sums:
                n[: len(sums[lang])] += sums[lang]
            sums[lang] = n
            at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            np.add.at(cells, w.pair_cells(ids[at], ids[at + 1]), 1)
            np.minimum(cells, full, out=cells)
            if len(w.words) > REMEMBERED:
                yield counts(lang)
                del seen[lang]
        for lang in list(sums):
            yield counts(lang)
        rows = cells.astype(np.uint8).reshape(-1, 1 << ROW_BITS)
        at = np.flatnonzero(rows.any(axis=1))
        part = TaskContext.get().partitionId() % 1024
        if at.size:
            cols = [*[pa.nulls(len(at), k) for k in kinds[:3]], pa.array(np.full(len(at), part), pa.int32()), pa.array(at, pa.int32()), pa.array([rows[k].tobytes() for k in at], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return slim.mapInArrow(run, "lang string, word string, n long, part int, row int, cells binary")


def frequent_neighbours(counted: DataFrame, min_count: int) -> np.ndarray:
    """A bit for each cell of neighbours that is full in all tasks together: PAIR_BITS bits, whatever the input."""
    full = min(min_count, 255)

    def added(t: pa.Table) -> pa.Table:
        out = np.zeros(1 << ROW_BITS, dtype=np.uint16)
        for x in t.column("cells").to_pylist():
            out = np.minimum(out + np.frombuffer(x, np.uint8), full)
        return pa.table({"row": t.column("row").slice(0, 1), "cells": pa.array([out.astype(np.uint8).tobytes()], pa.binary())})

    rows = counted.where("cells is not null").select("part", "row", "cells")
    for keys in (["part", "row"], ["row"]):
        rows = rows.groupBy(*keys).applyInArrow(added, "row int, cells binary")
    bits = np.zeros(1 << PAIR_BITS, dtype=bool)
    packed = F.udf(lambda x: np.packbits(np.frombuffer(x, np.uint8) >= full).tobytes(), "binary")
    for r in rows.select("row", packed("cells").alias("bits")).collect():
        bits[r["row"] << ROW_BITS : (r["row"] + 1) << ROW_BITS] = np.unpackbits(np.frombuffer(r["bits"], np.uint8))
    return bits


def word_codes(words: DataFrame, min_count: int) -> np.ndarray:
    """For each word cell 1 + the log of its count to base 2, 0 below min_count: 2^WORD_BITS bytes, whatever the input."""
    h = F.xxhash64(F.concat("lang", F.lit("\0"), "word"))
    cells = words.groupBy(F.shiftrightunsigned(h, 64 - WORD_BITS).cast("int").alias("cell")).agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    got = cells.select("cell", (F.floor(F.log2("n")) + 1).cast("byte").alias("code")).toArrow()
    codes = np.zeros(1 << WORD_BITS, dtype=np.uint8)
    codes[got.column("cell").to_numpy()] = got.column("code").to_numpy()
    return codes


def windows(key: np.ndarray, link: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the words before and after that its fragment takes: link[i] tells whether i+1 may follow i.

    Words before must come earlier in the order than the pivot, words after may equal it: so a phrase has one owner,
    the leftmost of its last words.
    """
    n = len(key)
    left, right = np.zeros(n, dtype=np.int8), np.zeros(n, dtype=np.int8)
    go_l, go_r = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    for k in range(1, most):
        go_l[:k] = go_r[max(0, n - k) :] = False
        if n > k:
            go_l[k:] &= link[: n - k] & (key[: n - k] < key[k:])
            go_r[: n - k] &= link[k - 1 : n - 1] & (key[k:] <= key[: n - k])
        left += go_l
        right += go_r
    return left, right


def fragments(slim: DataFrame, bits: np.ndarray, codes: np.ndarray, most: int, buckets: int, part_bits: int = PART_BITS) -> DataFrame:
    """(lang, bucket, pivot, parts, before, after, n): fragments of all texts, a row for each bucket of pivots and slice of text.

    From pivot on all are arrays: a distinct fragment's pivot, how many parts that pivot is dealt over, the words before and after it,
    and how often it is found.
    """
    sent = slim.sparkSession.sparkContext.broadcast((np.packbits(bits), codes))
    names = ["lang", "bucket", "pivot", "parts", "before", "after", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, code_of = sent.value
        frequent = np.unpackbits(packed).astype(bool)
        seen: dict[str, Words] = {}
        for lang, texts in slices_by_language(batches):
            w = seen.setdefault(lang, Words(lang))
            ids = w.read(texts)
            code = code_of[(w.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)]
            key = ((np.uint64(63) - code.astype(np.uint64)) << np.uint64(58)) | (w.hash >> np.uint64(6))
            fit = ids >= 0
            fit[fit] = code[ids[fit]] > 0
            link = np.append(fit[:-1] & fit[1:], False) if len(fit) else fit
            at = np.flatnonzero(link)
            link[at] = frequent[w.pair_cells(ids[at], ids[at + 1])]
            keep = link.copy()
            keep[1:] |= link[:-1]
            ids, link = ids[keep], link[keep]
            left, right = windows(key[ids], link, most)
            place = np.flatnonzero(left + right > 0)
            if place.size:
                yield distinct(lang, w, ids, place, left[place], right[place], code)
            if len(w.words) > REMEMBERED:
                del seen[lang]

    def distinct(lang: str, w: Words, ids: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
        reach = np.arange(1 - most, most)
        grid = ids[np.clip(place[:, None] + reach, 0, len(ids) - 1)]
        grid[(reach < -left[:, None]) | (reach > right[:, None])] = -1
        mix = np.random.default_rng(7).integers(1, 1 << 63, len(reach), dtype=np.uint64)
        h = (grid.astype(np.uint64) * mix).sum(axis=1)
        _, first, inverse, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        if (grid[first][inverse] != grid).any():  # two fragments of one hash
            rows, n = np.unique(grid, axis=0, return_counts=True)
        else:
            rows = grid[first]
        words, mid = w.words, most - 1
        before = [b" ".join([words[i] for i in r if i >= 0]) for r in rows[:, :mid].tolist()]
        after = [b" ".join([words[i] for i in r if i >= 0]) for r in rows[:, most:].tolist()]
        pivot = rows[:, mid]
        parts = 1 << np.maximum(0, code[pivot].astype(np.int64) - part_bits)
        part = np.zeros(len(rows), dtype=np.int64)
        for k in np.flatnonzero(parts > 1).tolist():
            part[k] = xxhash.xxh64_intdigest(before[k] + b"\0" + after[k]) % int(parts[k])
        owner, owned = np.unique(np.stack([pivot, part]), axis=1, return_inverse=True)
        home = np.fromiter((xxhash.xxh64_intdigest(w.start + words[p] + b"\0%d" % k) % buckets for p, k in owner.T.tolist()), np.int64, owner.shape[1])
        order = np.lexsort((pivot, home[owned.ravel()]))
        bucket = home[owned.ravel()][order]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = pa.array(np.append(starts, len(rows)).astype(np.int32))
        text = lambda x: pa.array(x, pa.binary()).cast(pa.string())
        at = order.tolist()
        lists = [text([words[i] for i in pivot[order].tolist()]), pa.array(parts[order]), text([before[k] for k in at]), text([after[k] for k in at]), pa.array(n[order], pa.int64())]
        cols = [pa.array([lang] * len(starts), pa.string()), pa.array(bucket[starts]), *(pa.ListArray.from_arrays(ends, x) for x in lists)]
        return pa.RecordBatch.from_arrays(cols, names=names)

    return slim.mapInArrow(run, "lang string, bucket long, pivot array<string>, parts array<long>, before array<string>, after array<string>, n array<long>")


def mine(routed: DataFrame, min_count: int, most: int) -> DataFrame:
    """(lang, phrase, n): how often each phrase that a pivot owns is in its fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in sorted_runs(batches, ["bucket", "lang"]):
            lang, lists = t.column("lang").to_pylist(), [t.column(c) for c in ("pivot", "parts", "before", "after", "n")]
            out: tuple[list[str], list[str], list[int]] = ([], [], [])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                whole: dict[str, int] = defaultdict(int)
                partial: dict[str, int] = defaultdict(int)
                for row in range(s, e):
                    for head, parts, left, right, m in zip(*(x[row].as_py() for x in lists), strict=True):
                        count = whole if parts == 1 else partial
                        ends = [""]
                        for w in right.split(" ") if right else ():
                            ends.append(f"{ends[-1]} {w}")
                        for end in ends[1:most]:
                            count[head + end] += m
                        for i, w in enumerate(reversed(left.split(" ")) if left else (), 1):
                            head = f"{w} {head}"
                            for end in ends[: most - i]:
                                count[head + end] += m
                good = [(p, c) for p, c in whole.items() if c >= min_count] + list(partial.items())
                out[0].extend([lang[s]] * len(good))
                out[1].extend(p for p, _ in good)
                out[2].extend(c for _, c in good)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["lang", "phrase", "n"])

    dealt = routed.repartition("bucket").sortWithinPartitions("bucket", "lang")
    found = dealt.mapInArrow(run, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, most: int = MOST_WORDS, top: int = TOP, contained: int = CONTAINED, part_bits: int = PART_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `most` words found min_count times or more.

    a: how often the phrase is found, l and r: its parts at the cut of the lowest score floor(1000 a n / (l r)), n: the
    language's words. A phrase inside a longer one with 100 f(longer) >= contained * a is left out. A pivot's fragments
    are dealt over parts of about 2^part_bits.
    """
    slim = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = table(count_words(slim, min_count), "word-counts")
    words = table(counted.where("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    bits, codes = frequent_neighbours(counted, min_count), word_codes(words, min_count)
    free(counted)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    single = words.where(F.col("n") >= min_count).select("lang", F.col("word").alias("phrase"), "n")
    buckets = 64 + (totals.agg(F.sum("total")).first()[0] or 0) // BUCKET_WORDS
    phrases = table(mine(fragments(slim, bits, codes, most, buckets, part_bits), min_count, most).unionByName(single).join(totals, "lang"), "phrases")
    free(words)

    parts = F.split("phrase", " ")
    long = phrases.withColumn("words", parts).where(F.size("words") > 1)
    cuts = long.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.array_join(F.slice("words", F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ")})
    side = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"over": (F.lit(1000) * F.col("n")).cast("decimal(19,0)") * wide("total"), "under": wide("l") * wide("r")}).withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase", "n", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    inner = long.where(F.size("words") > 2).select("lang", "n", F.explode(F.array(F.array_join(F.slice("words", F.lit(1), F.size("words") - 1), " "), F.array_join(F.slice("words", F.lit(2), F.size("words") - 1), " "))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("n")))
    flat = kept.select("lang", "phrase", F.col("n").alias("a"), "b.l", "b.r", F.col("total").alias("n"), "b.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))  # tasks keep their own first ones before the shuffle
    return flat.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
o AS (SELECT lang, m, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS phrase FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 6) AS x(m) WHERE len(ws) >= m)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM o GROUP BY ALL HAVING f >= 100 OR m = 1),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, m, phrase, string_split(phrase, ' ') AS gram, f AS a FROM f WHERE f >= 100 AND m > 1),
k AS (SELECT *, array_to_string(list_slice(gram, 1, k), ' ') AS head, array_to_string(list_slice(gram, k + 1, m), ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = head JOIN f y ON y.lang = k.lang AND y.phrase = tail JOIN t ON t.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
j AS (SELECT lang, longer, array_to_string(list_slice(gram, o, o + q - 1), ' ') AS phrase FROM (SELECT *, unnest(range(1, m - q + 2)) AS o FROM (SELECT lang, a AS longer, m, gram, unnest(range(2, m)) AS q FROM c))),
e AS (SELECT lang, phrase, max(longer) AS longer FROM j GROUP BY lang, phrase)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b LEFT JOIN e ON e.lang = b.lang AND e.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY rank <= 2000
"""
