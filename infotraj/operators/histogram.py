"""Histograms over growing prefixes of the frames, of one coordinate or of pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infotraj.operators.small import MAX_BROADCAST_ROWS, if_small, is_local


#: Steps up to which each has a conditional sum of its own.
MANY_STEPS = 32


@dataclass(frozen=True)
class Steps:
    """Every stride-th frame from start on, in nsteps equal steps; frames beyond a multiple of the step are left out."""

    n_frames: int
    nsteps: int = 20
    start: int = 0
    stride: int = 1

    @property
    def size(self) -> int:
        return max(0, -(-(self.n_frames - self.start) // self.stride)) // self.nsteps

    def assign(self, df: DataFrame) -> DataFrame:
        """df with a column step; its frames filtered by a range that scans can use, and the stride."""
        past = F.col("frame") - self.start
        last = self.start + self.stride * self.size * self.nsteps
        kept = df.where((F.col("frame") >= self.start) & (F.col("frame") < last))
        if self.stride > 1:
            kept = kept.where(past % self.stride == 0)
        return kept.withColumn("step", F.floor(past / (self.stride * max(1, self.size))).cast("int"))


def cumulative(counts: DataFrame, keys: list[str], nsteps: int) -> DataFrame:
    """From counts(keys, step, cnt) those of all steps up to each: one aggregate on the keys gives the row of steps.

    A cell gets a count for each step, zero before it is first hit. No window or grid of empty cells is needed. Beyond MANY_STEPS
    a sum for each would be too long an aggregate: the few steps of a cell are gathered and summed up along the row.
    """
    if nsteps > MANY_STEPS:
        hit = counts.groupBy(*keys, "step").agg(F.sum("cnt").alias("cnt")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("step", "cnt"))).alias("hit"))
        each = F.transform(F.sequence(F.lit(0), F.lit(nsteps - 1)), lambda k: F.coalesce(F.element_at("hit", k), F.lit(0).cast("long")))
        start = F.struct(F.array().cast("array<bigint>").alias("row"), F.lit(0).cast("long").alias("sum"))
        upto = F.aggregate(each, start, lambda got, x: F.struct(F.array_append(got["row"], got["sum"] + x).alias("row"), (got["sum"] + x).alias("sum")), lambda got: got["row"])
        return hit.select(*keys, F.posexplode(upto).alias("step", "cnt"))
    upto = F.array(*[F.sum(F.when(F.col("step") <= k, F.col("cnt")).otherwise(0)) for k in range(nsteps)])
    return counts.groupBy(*keys).agg(upto.alias("row")).select(*keys, F.posexplode("row").alias("step", "cnt"))


def hist1d(bins: DataFrame, steps: Steps) -> DataFrame:
    """hist1d(dof_type, dof, scheme, nbins, bin, step, cnt)"""
    keys = ["dof_type", "dof", "scheme", "nbins", "bin"]
    return cumulative(steps.assign(bins).groupBy(*keys, "step").agg(F.count("*").alias("cnt")), keys, steps.nsteps)


PAIR = ["pair_type", "t1", "d1", "t2", "d2"]
CELL = [*PAIR, "scheme", "nbins", "b1", "b2"]


def hist2d(bins: DataFrame, pairs: DataFrame, steps: Steps, form: str = "auto") -> DataFrame:
    """hist2d(pair_type, t1, d1, t2, d2, scheme, nbins, b1, b2, step, cnt) of pairs, from bins in a long table.

    Form "join" is an equi-join on the frame; it shuffles a row for each frame and pair. Form "arrow" brings the bins
    of a frame together, a row for each frame and coordinate, and counts blocks of pairs in numpy, so only counts
    are shuffled again. "tiles" packs the bins and brings blocks of coordinates together (operators.tiles), for catalogues
    of any size. "auto" takes "arrow" while the catalogue of pairs is of a size to send to all workers, else "tiles".
    Where frames are still rows of arrays, hist2d_frames spares even that shuffle.
    """
    from infotraj.operators import tiles  # which builds on this module

    cells = steps.assign(bins)
    if form == "auto":
        form = "arrow" if is_local(pairs) or pairs.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else "tiles"
    if form == "tiles":
        return tiles.hist2d_tiles(tiles.pack_long(bins), pairs, steps)
    if form == "join":
        return cumulative(_joined(cells, pairs), CELL, steps.nsteps)
    return _counted(cells, pairs, steps.nsteps)


def hist2d_frames(wide: DataFrame, ext: DataFrame, schemes: Sequence[int], pairs: DataFrame, steps: Steps) -> DataFrame:
    """hist2d as above, straight off frames (frame, bond array, angle array, torsion array) and extents.

    Arrays are binned and counted in the scan's own tasks; only counts are shuffled, once. ext and pairs go to all
    workers: their sizes are to be checked before.
    """
    found, listed, slots, pair_table = _catalogue(ext, pairs)
    types = [t for t in ("bond", "angle", "torsion") if t in wide.columns and t in found["dof_type"]]
    geometry = {}
    for t in types:
        mine = [k for k, x in enumerate(found["dof_type"]) if x == t and (t, found["dof"][k]) in slots]
        if mine:
            dof = np.array([found["dof"][k] for k in mine])
            geometry[t] = dof, *(np.array([found[c][k] for k in mine], dtype=float) for c in ("min", "max", "phase")), np.array([slots[t, d] for d in dof.tolist()])
    n_slots, counted, plans = len(slots), _pair_counter(listed, slots), list(enumerate(schemes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = batch.column("step").to_numpy()
            grids = [np.full((batch.num_rows, n_slots), -1, dtype=np.int64) for _ in plans]
            for t, (dof, low, high, phase, slot) in geometry.items():
                x = _matrix(batch.column(t), int(dof.max()) + 1)[:, dof]
                with np.errstate(invalid="ignore"):
                    x = np.where(phase != 0, np.fmod(x + phase, 2 * math.pi), x)
                    for k, n in plans:
                        place = np.minimum(np.floor((x - low) / ((high - low) / n)), n - 1)
                        grids[k][:, slot] = np.where(np.isnan(place), -1, place)
            for k, n in plans:
                for s in np.unique(step).tolist():
                    yield from counted(grids[k][step == s], k, s, n)

    cols = ["frame", *geometry]
    counts = steps.assign(wide.select(*cols)).select("step", *geometry).mapInArrow(run, COUNTS) if geometry else wide.sparkSession.createDataFrame([], COUNTS)
    return _named(counts, pair_table, steps.nsteps)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of so many values of a list column, NaN where there is none."""
    out = np.full((len(lists), width), np.nan)
    sizes = pa.compute.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = place < width
    out[row[keep], place[keep]] = lists.flatten().to_numpy(zero_copy_only=False)[keep]
    return out


COUNTS = "pair int, scheme int, step int, nbins int, cell int, cnt long"


def _catalogue(ext: DataFrame | None, pairs: DataFrame) -> tuple[dict, list[tuple], dict, DataFrame]:
    """Extents and pairs on the driver, a slot for each coordinate of a pair, and the numbered pairs as a table."""
    got = pairs.select(*PAIR).toArrow().to_pydict()  # a checked number of pairs
    listed = sorted(set(zip(*got.values(), strict=True)))
    slots = {d: i for i, d in enumerate(sorted({r[1:3] for r in listed} | {r[3:5] for r in listed}))}
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32())
    cols = {"pair": pa.array(range(len(listed)), pa.int32())} | {c: pa.array([r[k] for r in listed], t) for k, (c, t) in enumerate(zip(PAIR, kinds, strict=True))}
    return ext.toArrow().to_pydict() if ext is not None else {}, listed, slots, pairs.sparkSession.createDataFrame(pa.table(cols))


def _pair_counter(listed: list[tuple], slots: dict):
    """A function that counts the cells of all pairs over a grid (frames, slots) of bins, -1 for none, in blocks of pairs."""
    a = np.array([slots[r[1:3]] for r in listed], dtype=np.int64)
    b = np.array([slots[r[3:5]] for r in listed], dtype=np.int64)
    names = ["pair", "scheme", "step", "nbins", "cell", "cnt"]

    def counted(g: np.ndarray, scheme: int, step: int, n: int) -> Iterator[pa.RecordBatch]:
        block = max(1, min((1 << 20) // (n * n), (1 << 21) // max(1, len(g))))
        for at in range(0, len(a), block):
            x, y = g[:, a[at : at + block]], g[:, b[at : at + block]]
            codes = np.arange(x.shape[1]) * (n * n) + x * n + y
            count = np.bincount(codes[(x >= 0) & (y >= 0)], minlength=1)
            full = np.flatnonzero(count)
            cols = [at + full // (n * n), np.full(len(full), scheme), np.full(len(full), step), np.full(len(full), n), full % (n * n), count[full]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64 if k == "cnt" else np.int32)) for k, c in zip(names, cols, strict=True)], names=names)

    return counted


def _named(counts: DataFrame, pair_table: DataFrame, nsteps: int) -> DataFrame:
    """hist2d from counts of numbered pairs: one aggregate adds them up and makes them cumulative."""
    whole = cumulative(counts, ["pair", "scheme", "nbins", "cell"], nsteps).join(F.broadcast(pair_table), "pair")
    return whole.select(*PAIR, "scheme", "nbins", F.floor(F.col("cell") / F.col("nbins")).cast("int").alias("b1"), (F.col("cell") % F.col("nbins")).alias("b2"), "step", "cnt")


def _joined(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    one = cells.select(F.col("dof_type").alias("t1"), F.col("dof").alias("d1"), "frame", "step", "scheme", "nbins", F.col("bin").alias("b1"))
    two = cells.select(F.col("dof_type").alias("t2"), F.col("dof").alias("d2"), "frame", "scheme", F.col("bin").alias("b2"))
    both = one.join(if_small(pairs), ["t1", "d1"]).join(two, ["t2", "d2", "frame", "scheme"])
    return both.groupBy(*CELL, "step").agg(F.count("*").alias("cnt"))


def _counted(cells: DataFrame, pairs: DataFrame, nsteps: int) -> DataFrame:
    _, listed, slots, pair_table = _catalogue(None, pairs)
    kinds = (pa.string(), pa.int32(), pa.int32())
    slot_table = cells.sparkSession.createDataFrame(pa.table({n: pa.array(c, k) for n, c, k in zip(("dof_type", "dof", "slot"), ([d[0] for d in slots], [d[1] for d in slots], list(slots.values())), kinds, strict=True)}))
    n_slots, counted = len(slots), _pair_counter(listed, slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scheme, step, nbins = (batch.column(c).to_numpy() for c in ("scheme", "step", "nbins"))
            lists = batch.column("row")
            flat, sizes = lists.flatten(), lists.value_lengths().to_numpy()
            grid = np.full((batch.num_rows, n_slots), -1, dtype=np.int64)
            grid[np.repeat(np.arange(batch.num_rows), sizes), flat.field("slot").to_numpy()] = flat.field("bin").to_numpy()
            for key in np.unique(np.stack([scheme, step, nbins], axis=1), axis=0).tolist():
                yield from counted(grid[(scheme == key[0]) & (step == key[1])], *key)

    rows = cells.join(F.broadcast(slot_table), ["dof_type", "dof"]).groupBy("frame", "step", "scheme", "nbins").agg(F.collect_list(F.struct("slot", "bin")).alias("row"))
    return _named(rows.select("step", "scheme", "nbins", "row").mapInArrow(run, COUNTS), pair_table, nsteps)


def step_window(hist: DataFrame, first: int, stride: int = 1) -> DataFrame:
    """The steps of a histogram that are to be written: from the first on, every stride-th."""
    return hist.where((F.col("step") >= first) & ((F.col("step") - first) % stride == 0))
