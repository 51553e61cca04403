"""Near-duplicate vectors: binary codes by iterative quantisation, multi-index Hamming tables, reranking by cosine.

Index: on a sample of at most about FIT vectors, rotations of the centred principal axes are learned so that the signs
lose little (alternating codes and orthogonal Procrustes). Codes are cut into tables of about log2(rows) bits, so a
bucket stays small as the input grows, and tables (from further rotations where one gives too few bits) are added
until RECALL of made pairs at exactly the threshold, and of the sample's own links, meet in one. Where MOST_TABLES miss
that, segments are narrowed: buckets grow, down to two bits where all meet. Every vector is indexed.

Dense groups, whose codes are noise about the mean, do not go through the tables. Where DENSE vectors of the sample lie
within half the threshold's angle of one of them, that one is a pivot: all vectors so near to it are linked with each
other, by the triangle inequality, and are counted without a comparison. Their links to other vectors, which can only
be those within one and a half times the angle, are found by comparing blocks of the ones with blocks of the others.

Search of the rest: a vector enters each table under its segment and the values one bit away; two that differ in at
most two bits of a segment meet. What meets is kept if the whole codes are near enough (a bound that nearly all sampled
pairs pass), and reranked by cosine in double precision on the original vectors. Each pair has one bucket to count: the
first table where it meets, the least value that they share. Members of a bucket of over BLOCK vectors are divided into
blocks before any comparison, every two of which are one unit of work.

Equal vectors are one vertex with a multiplicity. Pairs are not emitted: each unit of work gives each vertex's number of
links and a spanning forest. Each length of vector is searched on its own; lengths of at most RARE vectors are compared
outright.

Edges: vectors that are null, zero or hold null or non-finite components link with nothing; null ids get n_links 0 and
a null component; rows that repeat an id count each, by their own vectors; an empty table gives no rows; labels and
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infotraj.llm.common import components, forest, free, sorted_runs, table

FIT, RECALL, BLOCK, ROUNDS, MOST_TABLES = 4096, 0.998, 4096, 30, 40
#: Vectors of the sample that make a pivot, most pivots, and vectors of one length that are compared outright.
DENSE, PIVOTS, RARE = 16, 256, 1024
#: Buckets over BLOCK up to which their names are sent to all executors.
FEW = 1 << 18


@dataclass
class Index:
    mean: np.ndarray
    planes: np.ndarray  # dimensions x bits
    width: int
    tables: int
    near: int  # differing bits that candidates may have

    def segments(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): each unit vector's code, a number a table."""
        return _segments(x, self.mean, self.planes, self.width, self.tables)


def _segments(x: np.ndarray, mean: np.ndarray, planes: np.ndarray, width: int, tables: int) -> np.ndarray:
    bits = ((x - mean) @ planes[:, : width * tables] > 0).reshape(len(x), tables, width)
    return bits @ (1 << np.arange(width, dtype=np.int64))


def rotation(v: np.ndarray, seed: int) -> np.ndarray:
    """An orthogonal matrix for which the signs of v times it are close to v times it."""
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1], v.shape[1])))[0]
    for _ in range(ROUNDS):
        codes = np.where(v @ r > 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(v.T @ codes)
        r = u @ w
    return r


def fit(sample: np.ndarray, rows: int, threshold: float, seed: int = 0) -> Index:
    """Learn an index for `rows` vectors from a sample of unit vectors."""
    d = sample.shape[1]
    mean = sample.mean(axis=0)
    axes = np.linalg.eigh(np.cov((sample - mean).T) if len(sample) > 1 else np.eye(d))[1].reshape(d, d)[:, ::-1][:, : min(d, 64)]
    width = int(np.clip(np.ceil(np.log2(max(2, rows))), min(8, axes.shape[1]), min(28, axes.shape[1])))
    rng = np.random.default_rng(seed)
    toward = np.concatenate([rng.normal(size=sample.shape), sample[rng.permutation(len(sample))] - mean])
    at = np.concatenate([sample, sample])
    toward -= (toward * at).sum(axis=1, keepdims=True) * at
    norm = np.linalg.norm(toward, axis=1, keepdims=True)
    moved = threshold * at + np.sqrt(1 - threshold**2) * np.divide(toward, norm, out=np.zeros_like(toward), where=norm > 1e-9)
    made = len(at)
    own = np.argwhere(np.triu(sample @ sample.T >= threshold, 1))
    own = own if len(own) <= 4 * FIT else own[rng.choice(len(own), 4 * FIT, replace=False)]
    at, moved = np.concatenate([at, sample[own[:, 0]]]), np.concatenate([moved, sample[own[:, 1]]])

    def least(per_pair: np.ndarray, of) -> float:
        return min(of(x) for x in (per_pair[:made], per_pair[made:]) if len(x))

    turned: list[np.ndarray] = []
    while True:
        planes, met, k, used = np.zeros((d, 0)), np.zeros(len(at), dtype=bool), 0, 0
        while k < MOST_TABLES and (not k or least(met, np.mean) < RECALL):
            while planes.shape[1] < (k + 1) * width:
                if used == len(turned):
                    turned.append(axes @ rotation((sample - mean) @ axes, seed + used))
                r, used = turned[used], used + 1
                planes = np.concatenate([planes, r[:, : r.shape[1] // width * width]], axis=1)
            k += 1
            last = planes[:, (k - 1) * width : k * width]
            met |= np.bitwise_count(_segments(at, mean, last, width, 1) ^ _segments(moved, mean, last, width, 1))[:, 0] <= 2
        if least(met, np.mean) >= RECALL or width <= 2:
            break
        width = max(2, width - 3)
    apart = np.bitwise_count(_segments(at, mean, planes, width, k) ^ _segments(moved, mean, planes, width, k)).sum(axis=1)
    return Index(mean, planes[:, : k * width], width, k, int(max(np.ceil(np.quantile(x, 0.9995)) for x in (apart[:made], apart[made:]) if len(x))))


def first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For codes (rows, tables), the key of the one bucket that counts each pair; -1 where they meet in none."""
    x = a ^ b
    d = np.bitwise_count(x)
    t = (d <= 2).argmax(axis=1)
    rows = np.arange(len(a))
    a, b, x, d = a[rows, t], b[rows, t], x[rows, t], d[rows, t]
    low = x & -x
    value = np.where(d == 2, np.minimum(a ^ low, b ^ low), np.minimum(a, b))
    return np.where(d <= 2, t.astype(np.int64) << 32 | value, -1)


def pivots_of(sample: np.ndarray, threshold: float) -> np.ndarray:
    """Vectors of the sample about which others lie densely, greedily, each apart from what those before it cover."""
    near = sample @ sample.T >= radius(threshold)
    free_rows, found = np.ones(len(sample), dtype=bool), []
    while len(found) < PIVOTS and len(sample):
        counts = np.where(free_rows, (near & free_rows).sum(axis=1), 0)
        best = int(counts.argmax())
        if counts[best] < DENSE:
            break
        found.append(best)
        free_rows &= ~near[best]
    return sample[found]


def radius(threshold: float) -> float:
    """The least cosine to a pivot at which any two vectors are linked with each other."""
    return float(np.cos(np.arccos(threshold) / 2 - 1e-9))


def reach(threshold: float) -> float:
    """The least cosine to a pivot at which a vector may be linked with one that is within its radius."""
    return float(np.cos(min(np.pi, 1.5 * np.arccos(threshold) + 1e-9)))


def vectors(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dims)


LINKS = "u long, v long, n long"


def links_batch(us: list, vs: list, ns: list) -> pa.RecordBatch:
    """(u, null, links) for vertices, (u, v, null) for edges of a spanning forest."""
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (us, vs, ns)], names=["u", "v", "n"])


def add_links(links: np.ndarray, nodes: np.ndarray, many: np.ndarray, us: list, vs: list, ns: list) -> None:
    """Append what a symmetric matrix of links says."""
    total = links @ many
    full = np.flatnonzero(total)
    us += nodes[full].tolist()
    vs += [None] * len(full)
    ns += total[full].tolist()
    if full.size:
        own, links = nodes[full], links[np.ix_(full, full)]
        for a, b in forest(len(full), lambda i, others: links[i, others]):
            us.append(int(own[a]))
            vs.append(int(own[b]))
            ns.append(None)


def compared(nodes: DataFrame, threshold: float) -> DataFrame:
    """The links of nodes(node, many, u, dims) of which no length has more than a few, by comparing all of a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in sorted_runs(batches, ["dims"]):
            us, vs, ns = [], [], []
            for lo, hi in zip(starts.tolist(), np.append(starts[1:], t.num_rows).tolist(), strict=True):
                part = t.slice(lo, hi - lo)
                x = vectors(part.column("u"), part.column("dims")[0].as_py())
                links = x @ x.T >= threshold
                np.fill_diagonal(links, False)
                add_links(links, part.column("node").to_numpy(), part.column("many").to_numpy(), us, vs, ns)
            yield links_batch(us, vs, ns)

    return nodes.repartition("dims").sortWithinPartitions("dims", "node").mapInArrow(run, LINKS)


def dense_links(nodes: DataFrame, pivots: np.ndarray, threshold: float, dims: int) -> tuple[list[DataFrame], DataFrame]:
    """The links of all vectors that are near a pivot, and the vectors that are not."""
    sent = nodes.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS rows at most
    inner, outer = radius(threshold), reach(threshold)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector with the pivot it belongs to, -1 for none, and the other pivots whose vectors may be linked with it.

        Of two that belong to different pivots the one of the later pivot does the asking.
        """
        for b in batches:
            c = vectors(b.column("u"), dims) @ sent.value.T
            first = np.where((c >= inner).any(axis=1), (c >= inner).argmax(axis=1), -1)
            asks = (c >= outer) & ((first[:, None] < 0) | (np.arange(c.shape[1]) < first[:, None]))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("many"), b.column("u"), pa.array(first), pa.array([np.flatnonzero(r) for r in asks], pa.list_(pa.int64()))], names=["node", "many", "u", "cell", "asks"])

    cells = table(nodes.select("node", "many", "u").mapInArrow(placed, "node long, many long, u binary, cell long, asks array<long>"), "cells")
    members = cells.where("cell >= 0")
    sizes = members.groupBy("cell").agg(F.sum("many").alias("size"), F.min("node").alias("lead"), F.count("*").alias("rows"))
    sizes = sizes.collect()  # PIVOTS rows at most
    asking = {r.cell: r["count"] for r in cells.select(F.explode("asks").alias("cell")).groupBy("cell").count().collect()}

    def per_cell(values: dict, cell):
        return F.create_map(*[F.lit(int(x)) for kv in values.items() for x in kv])[cell] if values else F.lit(None).cast("long")

    whole, lead = per_cell({r.cell: r["size"] for r in sizes}, F.col("cell")), per_cell({r.cell: r.lead for r in sizes}, F.col("cell"))
    counted = members.select(F.col("node").alias("u"), F.lit(None).cast("long").alias("v"), (whole - F.col("many")).cast("long").alias("n"))
    joined = members.select(F.col("node").alias("u"), lead.cast("long").alias("v"), F.lit(None).cast("long").alias("n")).where("u <> v")
    own_blocks = {r.cell: -(-r.rows // BLOCK) for r in sizes}
    ask_blocks = {c: -(-n // BLOCK) for c, n in asking.items()}
    found = [counted, joined]
    if asking:
        cell = F.col("cell")
        own, ask = F.coalesce(per_cell(own_blocks, cell), F.lit(0)), F.coalesce(per_cell(ask_blocks, cell), F.lit(0))
        at = F.xxhash64("node")
        inside = members.withColumn("i", F.pmod(at, own)).where(ask > 0).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), (ask - 1).cast("long")))).withColumn("side", F.lit(0))
        asked = cells.withColumn("cell", F.explode("asks")).where(own > 0).withColumn("j", F.pmod(at, ask)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), (own - 1).cast("long")))).withColumn("side", F.lit(1))
        cols = ["cell", "i", "j", "side", "node", "many", "u"]
        units = inside.select(*[F.col(c).cast("long") if c in ("i", "j", "side") else F.col(c) for c in cols]).unionByName(asked.select(*[F.col(c).cast("long") if c in ("i", "j", "side") else F.col(c) for c in cols]))

        def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, starts in sorted_runs(batches, ["cell", "i", "j"]):
                us, vs, ns = [], [], []
                for lo, hi in zip(starts.tolist(), np.append(starts[1:], t.num_rows).tolist(), strict=True):
                    part = t.slice(lo, hi - lo)
                    x, side, node, many = vectors(part.column("u"), dims), part.column("side").to_numpy(), part.column("node").to_numpy(), part.column("many").to_numpy()
                    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                    near = x[a] @ x[b].T >= threshold
                    for rows, total in ((a, near @ many[b]), (b, near.T @ many[a])):
                        full = np.flatnonzero(total)
                        us += node[rows[full]].tolist()
                        vs += [None] * len(full)
                        ns += total[full].tolist()
                    met = np.flatnonzero(near.any(axis=0))  # one edge each: the others are joined already
                    us += node[b[met]].tolist()
                    vs += node[a[near.argmax(axis=0)[met]]].tolist() if met.size else []
                    ns += [None] * len(met)
                yield links_batch(us, vs, ns)

        found.append(units.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side", "node").mapInArrow(across, LINKS))
    return found, cells.where("cell < 0").select("node", "many", "u")


def table_links(nodes: DataFrame, index: Index, threshold: float, dims: int) -> DataFrame:
    """The links of nodes(node, many, u) by the index's tables."""
    state = nodes.sparkSession.sparkContext.broadcast((index.mean, index.planes, index.width, index.tables))
    tables, width, near = index.tables, index.width, index.near

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _segments(vectors(b.column("u"), dims), *state.value)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("many"), b.column("u"), pa.array([r.tobytes() for r in s], pa.binary()), pa.array(s.tolist(), pa.list_(pa.int64()))], names=["node", "many", "u", "code", "segs"])

    codes = table(nodes.mapInArrow(coded, "node long, many long, u binary, code binary, segs array<long>"), "codes")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(width)])
    keys = F.flatten(F.transform("segs", lambda s, t: F.transform(flips, lambda m: s.bitwiseXOR(m) + F.shiftleft(t.cast("long"), 32))))
    entries = codes.select("node", "code", F.explode(keys).alias("key"))
    heavy = table(entries.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK), "heavy")
    n_heavy = heavy.count()
    known = F.broadcast(heavy) if n_heavy <= FEW else heavy.hint("merge")
    light = entries.join(known, "key", "left_anti") if n_heavy else entries

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members of each bucket that have a candidate in it."""
        for t, starts in sorted_runs(batches, ["key"]):
            size = np.diff(np.append(starts, t.num_rows))
            key, node = t.column("key").to_numpy(), t.column("node").to_numpy()
            code = np.frombuffer(b"".join(t.column("code").to_pylist()), dtype=np.int64).reshape(-1, tables)
            left = np.repeat(starts + size, size) - np.arange(t.num_rows)  # rows from here to the run's end
            some = np.zeros(t.num_rows, dtype=bool)
            at, step = np.flatnonzero(left > 1), 1
            while at.size:  # every pair of a run, by the distance between its rows
                for part in np.array_split(at, -(-at.size // 200_000)):
                    a, b = code[part], code[part + step]
                    ok = np.bitwise_count(a ^ b).sum(axis=1) <= near
                    part = part[ok]
                    part = part[first_meeting(a[ok], b[ok]) == key[part]]
                    some[part] = some[part + step] = True
                step += 1
                at = at[left[at] > step]
            zero = np.zeros(int(some.sum()), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (key[some], zero, zero, zero, node[some])], names=["key", "i", "j", "block", "node"])

    hits = light.repartition("key").sortWithinPartitions("key").mapInArrow(candidates, "key long, i long, j long, block long, node long")
    if n_heavy:
        blocks = F.ceil(F.col("rows") / BLOCK).cast("long")
        dealt = entries.join(known, "key").withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        hits = hits.unionByName(dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node"))
    hits = table(hits, "hits")
    work = hits.join(codes.drop("segs"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in sorted_runs(batches, ["key", "i", "j"]):
            us, vs, ns = [], [], []
            ends = np.append(starts[1:], t.num_rows).tolist()
            cols = {c: t.column(c).to_numpy() for c in ("key", "i", "j", "block", "node", "many")}
            for lo, hi in zip(starts.tolist(), ends, strict=True):
                part = t.slice(lo, hi - lo)
                x = vectors(part.column("u"), dims)
                code = np.frombuffer(b"".join(part.column("code").to_pylist()), dtype=np.int64).reshape(-1, tables)
                block, links = cols["block"][lo:hi], np.zeros((hi - lo, hi - lo), dtype=bool)
                apart = cols["i"][lo] != cols["j"][lo]
                for k in range(0, hi - lo, 512):
                    a, b = np.nonzero(x[k : k + 512] @ x.T >= threshold)
                    a += k
                    fine = (a != b) & (block[a] != block[b]) if apart else a != b
                    a, b = a[fine], b[fine]
                    fine = first_meeting(code[a], code[b]) == cols["key"][lo]
                    links[a[fine], b[fine]] = True
                add_links(links, cols["node"][lo:hi], cols["many"][lo:hi], us, vs, ns)
            yield links_batch(us, vs, ns)

    found = table(work.mapInArrow(rerank, LINKS), "links")
    free(codes, heavy, hits)
    return found


def near_components(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component) for each row of df."""
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            size = pa.compute.fill_null(pa.compute.list_value_length(v), 0).to_numpy(zero_copy_only=False)
            out: list[bytes | None] = [None] * b.num_rows
            for dims in set(size.tolist()) - {0}:
                rows = np.flatnonzero(size == dims)
                x = np.array(v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)
                with np.errstate(all="ignore"):
                    top = np.abs(x).max(axis=1, keepdims=True)
                    x = x / top  # no overflow in the squares
                    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                fine = np.isfinite(top[:, 0]) & (top[:, 0] > 0) & np.isfinite(x).all(axis=1)
                for k, row in zip(rows[fine].tolist(), x[fine], strict=True):
                    out[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], names=["id", "u"])

    units = table(slim.mapInArrow(unit, "id long, u binary").withColumns({"h1": F.xxhash64("u"), "h2": F.xxhash64("u", F.lit(1))}), "units")
    good = F.col("u").isNotNull() & F.col("id").isNotNull()
    groups = units.where(good).groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("many"), F.first("u").alias("u"))
    nodes = table(groups.withColumns({"node": F.monotonically_increasing_id(), "dims": (F.octet_length("u") / 8).cast("long")}), "vertices")  # a vector's number, fixed by the table
    lengths = {r.dims: r["count"] for r in nodes.groupBy("dims").count().collect()}  # a row a length
    found = [compared(nodes.where(F.col("dims").isin([d for d, n in lengths.items() if n <= RARE])), threshold)]
    for dims, rows in sorted(lengths.items()):
        if rows <= RARE:
            continue
        mine = nodes.where(F.col("dims") == dims).select("node", "many", "u")
        part = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(min(1.0, FIT / rows) * (1 << 30))
        got = mine.where(part).orderBy("node").limit(2 * FIT).select("u").collect()
        sample = np.frombuffer(b"".join(bytes(r.u) for r in got), dtype=np.float64).reshape(-1, dims)
        pivots = pivots_of(sample, threshold)
        if len(pivots):
            more, mine = dense_links(mine, pivots, threshold, dims)
            found += more
            rest = sample[~(sample @ pivots.T >= radius(threshold)).any(axis=1)]
            sample, rows = rest if len(rest) > 1 else sample, mine.count()
        if rows > 1:
            found.append(table_links(mine, fit(sample, rows, threshold), threshold, dims))
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    every = table(every, "links")
    counts = every.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    comps = components(every.where("v is not null").select("u", "v")).select("node", F.col("component").alias("top"))
    named = nodes.select("node", "h1", "h2", "rep", "many").join(counts, "node", "left").join(comps, "node", "left").withColumn("top", F.coalesce("top", "node"))
    named = named.join(named.groupBy("top").agg(F.min("rep").alias("component")), "top").select("h1", "h2", "component", (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("n"))
    named = table(named, "named")
    free(every)
    out = units.select("id", F.when(good, F.col("h1")).alias("h1"), F.when(good, F.col("h2")).alias("h2")).join(named, ["h1", "h2"], "left")
    return out.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))


def op4_embeddings(spark, sf_dir: str) -> DataFrame:
    found = near_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


OP4_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, v FROM e WHERE list_sum(list_transform(v, lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a, u b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a
"""
