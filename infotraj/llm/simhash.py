"""Near duplicates by SimHash: 64-bit fingerprints, linked by multi-index hashing.

A fingerprint is cut into two segments of 32 bits. Of two fingerprints at d <= 4 differing bits, either the upper
segments differ in at most 2 bits or the lower ones in at most 1. Each fingerprint is entered, in a table per
segment, under every value of its Hamming ball of radius 1; two that are at most 2 bits apart in a segment so meet
under a value between them. What meets is verified over all 64 bits. 66 entries a fingerprint and 33-bit keys keep
chance meetings rare up to billions of fingerprints. A greater distance raises the balls' radius.

Exact copies fall together before any search, and an entry's fingerprints yield a spanning forest of their links,
found breadth first, so a group of near copies never gives all its pairs.

keep_one goes by the Jaccard similarity of sets of shingles, at 0.8 or more, where 64-bit fingerprints differ in far
more than 4 bits. Its SimHash of a set has 64 * WORDS bits. Tables take many short segments of them, as many as bring
RECALL of pairs at exactly that similarity together; the last 128 bits are in no segment and thin out what meets. Of
a bucket each node gives its first link; sets of shingles verify those, and a second pass compares only what they have
not joined, so its links are those of all candidates. Equal sets fall together before any search.

Edges: a null or empty text has fingerprint zero and is linked like any other. Null ids are a node of none: the row
gets a null component. Repeated ids share one component if their fingerprints link. Extra columns are ignored. An
empty table gives no rows; ids are cast to long, and ids that are no numbers raise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infotraj.llm.common import components, forest, free, sorted_runs, table, text_hash, text_slices

#: Words of the SimHash that keep_one takes, the last two apart from the tables; recall of the tables at the least similarity.
WORDS, RECALL = 10, 0.999
#: Rows to remove up to which their names are sent to all executors instead of shuffling whole texts.
FEW = 1 << 18


def shingle_hashes(text: str, words: int, seed: int = 42) -> list[int]:
    """XXH64 of each shingle of a text, repeats included; of the whole sequence where it is shorter."""
    found = text.encode().lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone separates
    if not found:
        return []
    joined = b" ".join(found)
    h = xxhash.xxh64_intdigest
    if len(found) <= words:
        return [h(joined, seed)]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    return [h(joined[a:b], seed) for a, b in zip((ends - sizes)[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)] if words > 1 else [h(w, seed) for w in found]


def majority_bits(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes, the bits set in over half of them; zero for an empty run."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = counts > 0
    if full.any():
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts[full], axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * ones > counts[full][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp long): the SimHash of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                each = [shingle_hashes(x, words, seed) for x in texts]
                counts = np.fromiter(map(len, each), np.int64, len(each))
                flat = np.fromiter((h for x in each for h in x), np.uint64, int(counts.sum()))
                fp = majority_bits(flat, np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def _ball(value: Column, bits: int, radius: int, table_no: int) -> list[Column]:
    """Keys of a segment's values within `radius` of it, of one table."""
    flips = [sum(1 << b for b in at) for r in range(radius + 1) for at in combinations(range(bits), r)]
    return [value.bitwiseXOR(F.lit(m)) + F.lit(table_no << 32) for m in flips]


def linked(nodes: DataFrame, max_distance: int = 4) -> DataFrame:
    """Edges (u, v) over nodes(rep long, fp long; fp distinct) whose components are those of all links at max_distance bits.

    Radius r in both tables covers 2r bits of difference in a segment: 4r + 1 in all, as one segment has at most half.
    """
    radius = -(-max(0, max_distance - 1) // 4)
    keys = F.array(*_ball(F.shiftrightunsigned("fp", 32), 32, radius, 0), *_ball(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), 32, radius, 1))
    entries = nodes.select("rep", "fp", F.explode(keys).alias("key")).repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in sorted_runs(batches, ["key"]):
            ends = np.append(starts[1:], t.num_rows)
            fp, rep = t.column("fp").to_numpy().view(np.uint64), t.column("rep").to_numpy()
            size = ends - starts
            two = starts[size == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_distance]
            us, vs = [rep[two]], [rep[two + 1]]
            for a, b in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
                f, r = fp[a:b], rep[a:b]
                if pairs := forest(b - a, lambda i, others, f=f: np.bitwise_count(f[others] ^ f[i]) <= max_distance):
                    e = np.array(pairs)
                    us.append(r[e[:, 0]])
                    vs.append(r[e[:, 1]])
            u, v = np.concatenate(us), np.concatenate(vs)
            if len(u):
                e = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], names=["u", "v"])

    return entries.mapInArrow(run, "u long, v long").distinct()


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_distance: int = 4) -> DataFrame:
    """(id, fp, component): for each row the smallest id that links of at most max_distance bits reach."""
    fps = table(fingerprints(df, id_col, text_col, words), "simhash")
    nodes = table(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "simhash-nodes")
    found = components(linked(nodes, max_distance)).select(F.col("node").alias("rep"), "component")
    named = nodes.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return fps.join(named, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def distinct_shingles(text: str, words: int) -> np.ndarray:
    """The set of a text's shingles, letters of all scripts lowered."""
    return np.unique(np.array(shingle_hashes(text.lower(), words), dtype=np.uint64))


def set_hash(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def wide_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(runs, 8 * WORDS): the SimHash of 64 * WORDS bits of each run of hashes, packed; zero for an empty run."""
    out = np.zeros((len(counts), 64 * WORDS), dtype=np.uint8)
    full = counts[counts > 0]
    if full.size:
        pieces = -(-full // 255)  # rows that counters of eight bits can take
        first = np.cumsum(pieces) - pieces
        starts = np.repeat(np.cumsum(full) - full, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
        for k in range(WORDS):
            z = hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
            for s in range(8):  # eight bits of a word are counted at once, each in a byte of its own
                lanes = np.add.reduceat((z >> np.uint64(s)) & np.uint64(0x0101010101010101), starts)
                ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
                out[counts > 0, 64 * k + s : 64 * (k + 1) : 8] = 2 * ones > full[:, None]
    return np.packbits(out, axis=1, bitorder="little")


def chance(similarity: float) -> float:
    """The greatest chance that a bit of the SimHashes of two sets at this Jaccard similarity differs."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables_for(rows: int, similarity: float) -> np.ndarray:
    """(tables, width): the bits that make the key of each table, enough tables for RECALL at exactly this similarity.

    The share of differing bits varies from pair to pair about its chance: the recall is its mean over that binomial.
    """
    width, bits, p = int(np.clip(math.ceil(math.log2(max(2, rows))) - 2, 8, 32)), 64 * (WORDS - 2), chance(similarity)
    d = np.arange(bits - width)
    logs = np.array([math.lgamma(bits + 1) - math.lgamma(x + 1) - math.lgamma(bits - x + 1) for x in d])
    share = np.exp(logs + d * math.log(p) + (bits - d) * math.log1p(-p)) if p > 0 else (d == 0) * 1.0
    meet = np.prod([(bits - d - i) / (bits - i) for i in range(width)], axis=0)
    tables = 1
    while (share * (1 - (1 - meet) ** tables)).sum() < RECALL:
        tables += 1
    rng = np.random.default_rng(7)
    return np.stack([rng.choice(bits, width, replace=False) for _ in range(tables)])


def most_bits(bits: int, similarity: float) -> int:
    """Differing bits of all these that candidates may have: five standard deviations above the mean at this similarity."""
    p = chance(similarity)
    return min(bits, math.ceil(bits * p + 5 * math.sqrt(bits * p * (1 - p))))


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, th, component): for each row the smallest id that links of sets of shingles at this Jaccard similarity reach.

    th is the hash of its text.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                sets = [distinct_shingles(x, words) for x in texts]
                fp = wide_bits(np.concatenate(sets), np.fromiter(map(len, sets), np.int64, len(sets)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.array(list(map(set_hash, sets)), pa.int64()), pa.array([x.tobytes() for x in fp], pa.binary())], names=["id", "th", "h", "fp"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch, "text"):
                sets = [distinct_shingles(x, words) for x in texts]
                yield pa.RecordBatch.from_arrays([pa.array(list(map(set_hash, sets)), pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["h", "set"])

    texts = df.select(F.col(id_col).cast("long").alias("id"), text_hash(F.col(text_col)).alias("th"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    rows = table(texts.mapInArrow(coded, "id long, th long, h long, fp binary"), "wide-simhash")
    nodes = table(rows.groupBy("h").agg(F.min("id").alias("rep"), F.first("fp").alias("fp")), "wide-nodes")
    chosen = tables_for(nodes.count(), similarity)
    near, near_all = most_bits(128, similarity), most_bits(64 * WORDS, similarity)

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, h, label, a, b) of each node in each table; a and b are bits that no key takes."""
        weights = 1 << np.arange(chosen.shape[1], dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                fp = np.frombuffer(b"".join(part.column("fp").to_pylist()), dtype=np.uint8).reshape(-1, 8 * WORDS)
                bits = np.unpackbits(fp, axis=1, bitorder="little")
                keys = np.stack([(t << 32) + bits[:, c] @ weights for t, c in enumerate(chosen)], axis=1)
                last = fp.view(np.int64)[:, -2:]
                n = len(chosen)
                cols = [keys.ravel(), *(np.repeat(part.column(c).to_numpy(), n) for c in ("h", "label")), *(np.repeat(last[:, i], n) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["key", "h", "label", "a", "b"])

    def buckets(part: DataFrame) -> DataFrame:
        return part.mapInArrow(entered, "key long, h long, label long, a long, b long").repartition("key").sortWithinPartitions("key", "label", "h")

    def edges(us: list, vs: list) -> Iterator[pa.RecordBatch]:
        u, v = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (us, vs))
        if len(u):
            e = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], names=["u", "v"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A link or two of each node that has any in a bucket; a spanning forest of a large bucket."""
        for t, starts in sorted_runs(batches, ["key"]):
            h, a, b = t.column("h").to_numpy(), *(t.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))  # bitwise_count takes a sign off
            size = np.diff(np.append(starts, t.num_rows))
            left = np.repeat(np.where(size > 64, 0, starts + size), size) - np.arange(t.num_rows)  # rows from here to a small run's end
            lead, follow = np.full(t.num_rows, t.num_rows), np.full(t.num_rows, -1)
            at, step = np.flatnonzero(left > 1), 1
            while at.size:
                ok = at[np.bitwise_count(a[at] ^ a[at + step]).astype(np.int64) + np.bitwise_count(b[at] ^ b[at + step]) <= near]
                lead[ok + step] = ok  # steps grow: the last one written is the earliest row
                follow[ok] = np.where(follow[ok] < 0, ok + step, follow[ok])
                step += 1
                at = at[left[at] > step]
            led = np.flatnonzero(lead < t.num_rows)
            alone = np.flatnonzero((lead == t.num_rows) & (follow >= 0))
            us, vs = [h[led], h[alone]], [h[lead[led]], h[follow[alone]]]
            for lo, hi in zip(starts[size > 64].tolist(), (starts + size)[size > 64].tolist(), strict=True):
                x, y, own = a[lo:hi], b[lo:hi], h[lo:hi]
                if found := forest(hi - lo, lambda i, others, x=x, y=y: np.bitwise_count(x[others] ^ x[i]).astype(np.int64) + np.bitwise_count(y[others] ^ y[i]) <= near):
                    e = np.array(found)
                    us.append(own[e[:, 0]])
                    vs.append(own[e[:, 1]])
            yield from edges(us, vs)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All links of a bucket between nodes of different labels."""
        for t, starts in sorted_runs(batches, ["key"]):
            h, label = (t.column(c).to_numpy() for c in ("h", "label"))
            a, b = (t.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
            ends = np.append(starts[1:], t.num_rows)
            new = np.ones(t.num_rows, dtype=bool)
            new[1:] = label[1:] != label[:-1]
            new[starts] = True
            cut = np.append(np.flatnonzero(new), t.num_rows)
            after = np.repeat(cut[1:], np.diff(cut))
            end = np.repeat(ends, ends - starts)  # rows of a label stand together: the others begin at `after`
            us, vs = [], []
            at, to = np.flatnonzero(after < end), after[after < end]
            while at.size:
                ok = np.bitwise_count(a[at] ^ a[to]).astype(np.int64) + np.bitwise_count(b[at] ^ b[to]) <= near
                us.append(h[at[ok]])
                vs.append(h[to[ok]])
                to = to + 1
                at, to = at[to < end[at]], to[to < end[at]]
            yield from edges(us, vs)

    close = table(buckets(nodes.select("h", F.lit(0).cast("long").alias("label"), "fp")).mapInArrow(nearest, "u long, v long").distinct(), "close")
    ends = close.select(F.col("u").alias("h")).unionByName(close.select(F.col("v").alias("h"))).distinct()
    found = table(nodes.join(ends, "h"), "found")
    sets = texts.join(found.select(F.col("rep").alias("id")).distinct().hint("merge"), "id", "left_semi").select("text").mapInArrow(listed, "h long, set array<long>")
    sets = table(sets.dropDuplicates(["h"]), "shingle-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs whose bits are near enough over the whole SimHash, and whose sets are similar indeed."""
        fp = found.select("h", "fp")
        x, y = fp.select(F.col("h").alias("u"), F.col("fp").alias("x")), fp.select(F.col("h").alias("v"), F.col("fp").alias("y"))

        def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p in batches:
                a, b = (np.frombuffer(b"".join(p.column(c).to_pylist()), dtype=np.uint64).reshape(-1, WORDS) for c in ("x", "y"))
                ok = pa.array(np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= near_all)
                yield pa.RecordBatch.from_arrays([p.column(c).filter(ok) for c in ("u", "v")], names=["u", "v"])

        pairs = pairs.join(x, "u").join(y, "v").mapInArrow(fine, "u long, v long")
        pairs = pairs.join(sets.select(F.col("h").alias("u"), F.col("set").alias("x")), "u").join(sets.select(F.col("h").alias("v"), F.col("set").alias("y")), "v")
        both = F.size(F.array_intersect("x", "y"))
        return table(pairs.where(both >= F.lit(similarity) * (F.size("x") + F.size("y") - both) - F.lit(1e-9)).select("u", "v"), "similar")

    linked = verified(close)
    first = components(linked).select(F.col("node").alias("h"), F.col("component").alias("label"))
    labelled = found.join(first, "h", "left").select("h", F.coalesce("label", "h").alias("label"), "fp")
    more = table(buckets(labelled).mapInArrow(across, "u long, v long").distinct().join(close, ["u", "v"], "left_anti"), "across")
    whole = components(linked.unionByName(verified(more))).select(F.col("node").alias("h"), F.col("component").alias("group"))
    groups = nodes.join(whole, "h", "left").select("h", "rep", F.coalesce("group", "h").alias("group"))
    named = table(groups.join(groups.groupBy("group").agg(F.min("rep").alias("component")), "group").select("h", "component"), "named")
    free(nodes, close, found, sets, linked)
    return rows.select("id", "th", "h").join(named, "h").select("id", "th", "component")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """df without, of each component of similar texts, the rows of other ids than its smallest. Rows without an id stay."""
    found = similar_components(df, id_col, text_col, words, similarity)
    lost = table(found.where("id <> component").select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct(), "lost")
    mine = (F.col(id_col).cast("long") == F.col("__id")) & (text_hash(F.col(text_col)) == F.col("__th"))
    return df.join(F.broadcast(lost) if lost.count() <= FEW else lost.hint("merge"), mine, "left_anti")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs).select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
