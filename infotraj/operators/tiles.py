"""Bins packed as bytes in tiles of some frames by BLOCK coordinates, and histograms counted from tiles.

A tile is a row: type, block of coordinates, scheme, the frames it holds and a byte for each frame and coordinate (NONE where there
is no value). For pairs, the tiles of a block of coordinates meet those of another once for each pair of blocks that the
catalogue names, and counts alone leave: neither the catalogue nor a row for each frame and pair is sent anywhere. The
catalogue is a table of pairs of blocks with the pairs inside each, BLOCK squared at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infotraj.operators.histogram import Steps, _matrix, cumulative
from infotraj.operators.small import if_small
from infotraj.sources.selection import PAIR_TYPES
from infotraj.sources.trajectory import TYPES

#: Coordinates of a tile, the byte for no value, frames of a tile at most, frames of a part of one pair of blocks, values of a slice of frames.
BLOCK, NONE, FRAMES, GROUP, VALUES = 64, 255, 4096, 1 << 20, 1 << 23
#: Cells up to which the counts of a pair of blocks are kept as an array between tiles.
DENSE = 1 << 22
TILE = "t int, c int, scheme int, nbins int, first long, frames binary, cells binary"
_NAMES = [x.split()[0] for x in TILE.split(", ")]
_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def _place(column: Column) -> Column:
    """The number of a type."""
    return F.array_position(F.array(*map(F.lit, TYPES)), column).cast("int") - 1


def _type(column: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TYPES)), column + 1)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(_KINDS), _KINDS, strict=True)], names=_NAMES)


def geometry_of(wide: DataFrame, ext: DataFrame) -> dict[str, np.ndarray]:
    """(min, max, phase) by dof of each type that wide has, NaN where there is none, up to whole blocks."""
    found = ext.select("dof_type", "dof", "min", "max", "phase").toArrow().to_pydict()
    geometry = {}
    for t in TYPES:
        mine = [k for k, x in enumerate(found["dof_type"]) if x == t]
        if t in wide.columns and mine:
            dof = np.array([found["dof"][k] for k in mine])
            values = np.full((3, -(-(int(dof.max()) + 1) // BLOCK) * BLOCK), np.nan)
            values[:, dof] = [[found[c][k] for k in mine] for c in ("min", "max", "phase")]
            geometry[t] = values
    return geometry


def binned(batch: pa.RecordBatch, geometry: dict[str, np.ndarray], schemes: Sequence[int]) -> Iterator[tuple[str, int, int, np.ndarray]]:
    """(type, scheme, nbins, bytes of frames by dofs) of a batch of frames."""
    for t, (low, high, phase) in geometry.items():
        x = _matrix(batch.column(t), len(low))
        with np.errstate(invalid="ignore"):
            x = np.where(phase != 0, np.fmod(x + phase, 2 * math.pi), x)
            for k, n in enumerate(schemes):
                bins = np.minimum(np.floor((x - low) / ((high - low) / n)), n - 1)
                yield t, k, n, np.where(np.isnan(bins), NONE, bins).astype(np.uint8)


def pack(wide: DataFrame, ext: DataFrame, schemes: Sequence[int]) -> DataFrame:
    """Tiles of frames (frame, bond array, angle array, torsion array), binned in the scan's own tasks.

    Extents go to all workers: their number is to be checked before. Bins are those of discretize.bins.
    """
    geometry = geometry_of(wide, ext)
    width, schemes = sum(v.shape[1] for v in geometry.values()), list(schemes)
    if not geometry:
        return wide.sparkSession.createDataFrame([], TILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            each = max(1, min(FRAMES, VALUES // width))
            for at in range(0, whole.num_rows, each):
                batch = whole.slice(at, each)
                frames, rows = batch.column("frame").to_numpy(), []
                for t, k, n, bins in binned(batch, geometry, schemes):
                    for c in range(0, bins.shape[1], BLOCK):
                        rows.append((TYPES.index(t), c // BLOCK, k, n, int(frames[0]), frames.tobytes(), np.ascontiguousarray(bins[:, c : c + BLOCK]).tobytes()))
                yield _batch(rows)

    return wide.select("frame", *geometry).mapInArrow(run, TILE)


def pack_long(bins: DataFrame) -> DataFrame:
    """Tiles of bins(dof_type, dof, frame, scheme, nbins, bin): one for each FRAMES frames and block of coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lists = [], batch.column("held")
            flat, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
            at, col, bin_ = (flat.field(k).to_numpy() for k in range(3))
            for t, c, k, n, f, start, end in zip(*(batch.column(x).to_pylist() for x in ("t", "c", "scheme", "nbins", "f")), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                grid = np.full((FRAMES, BLOCK), NONE, dtype=np.uint8)
                grid[at[start:end], col[start:end]] = bin_[start:end]
                rows.append((t, c, k, n, f * FRAMES, np.arange(f * FRAMES, (f + 1) * FRAMES, dtype=np.int64).tobytes(), grid.tobytes()))
            yield _batch(rows)

    cells = bins.select(_place(F.col("dof_type")).alias("t"), F.floor(F.col("dof") / BLOCK).cast("int").alias("c"), "scheme", "nbins", F.floor(F.col("frame") / FRAMES).alias("f"),
                        F.struct((F.col("frame") % FRAMES).cast("int").alias("at"), (F.col("dof") % BLOCK).alias("col"), "bin").alias("x"))
    return cells.groupBy("t", "c", "scheme", "nbins", "f").agg(F.collect_list("x").alias("held")).mapInArrow(run, TILE)


def _by_step(frames: np.ndarray, steps: Steps) -> list[tuple[int, np.ndarray]]:
    """The steps that some frames belong to, and where those frames are."""
    past = frames - steps.start
    keep = (past >= 0) & (past < steps.stride * steps.size * steps.nsteps) & (past % steps.stride == 0)
    step = past // (steps.stride * max(1, steps.size))
    return [(s, np.flatnonzero(keep & (step == s))) for s in np.unique(step[keep]).tolist()]


def hist1d_tiles(tiles: DataFrame, steps: Steps) -> DataFrame:
    """hist1d(dof_type, dof, scheme, nbins, bin, step, cnt) from tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["t", "dof", "scheme", "nbins", "bin", "step", "cnt"], [*[pa.int32()] * 6, pa.int64()]
        for batch in batches:
            for t, c, k, n, frames, cells in zip(*(batch.column(x).to_pylist() for x in ("t", "c", "scheme", "nbins", "frames", "cells")), strict=True):
                grid = np.frombuffer(cells, np.uint8).reshape(-1, BLOCK)
                for s, at in _by_step(np.frombuffer(frames, np.int64), steps):
                    count = np.bincount((np.arange(BLOCK) * 256 + grid[at]).ravel(), minlength=BLOCK * 256).reshape(BLOCK, 256)
                    col, bin_ = np.nonzero(count[:, :NONE])
                    full = lambda v, m=len(col): np.full(m, v)
                    cols = (full(t), c * BLOCK + col, full(k), full(n), bin_, full(s), count[col, bin_])
                    yield pa.RecordBatch.from_arrays([pa.array(v.astype(x.to_pandas_dtype())) for v, x in zip(cols, kinds, strict=True)], names=names)

    counts = tiles.mapInArrow(run, "t int, dof int, scheme int, nbins int, bin int, step int, cnt long")
    return cumulative(counts.withColumn("dof_type", _type(F.col("t"))), ["dof_type", "dof", "scheme", "nbins", "bin"], steps.nsteps)


def block_pairs(pairs: DataFrame) -> DataFrame:
    """(blocks long, t1, c1, t2, c2, inside array<int>) of pairs: which pairs of each two blocks are asked for, as place * BLOCK + place."""
    ends = [_place(F.col(f"t{k}")).alias(f"t{k}") for k in (1, 2)] + [F.floor(F.col(f"d{k}") / BLOCK).cast("int").alias(f"c{k}") for k in (1, 2)]
    inside = ((F.col("d1") % BLOCK) * BLOCK + F.col("d2") % BLOCK).cast("int")
    got = pairs.select(*ends, inside.alias("p")).groupBy("t1", "c1", "t2", "c2").agg(F.collect_set("p").alias("inside"))
    code = F.shiftleft((F.col("t1") * 4 + F.col("t2")).cast("long"), 56) + F.shiftleft(F.col("c1").cast("long"), 28) + F.col("c2")
    return got.select(code.alias("blocks"), "t1", "c1", "t2", "c2", "inside")


def hist2d_tiles(tiles: DataFrame, pairs: DataFrame, steps: Steps) -> DataFrame:
    """hist2d(pair_type, t1, d1, t2, d2, scheme, nbins, b1, b2, step, cnt) of pairs of any number, from tiles.

    Shuffled are the tiles, once for each pair of blocks they belong to, and counts. A task streams through the tiles of
    a pair of blocks in the order of frames; frames beyond GROUP are another part of it.
    """
    catalogue = block_pairs(pairs)
    own = catalogue.select("blocks", "t1", "c1", "t2", "c2")
    hint = if_small(own, 100_000)
    same = (F.col("t1") == F.col("t2")) & (F.col("c1") == F.col("c2"))
    row = ["blocks", F.floor(F.col("first") / GROUP).alias("part"), "scheme", "nbins", "first"]
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    sides = [tiles.join(hint, (F.col("t") == F.col(f"t{k}")) & (F.col("c") == F.col(f"c{k}"))).where(F.lit(True) if k == 1 else ~same)
             .select(*row, F.lit(k).alias("side"), "frames", "cells", none("inside", "array<int>")) for k in (1, 2)]
    groups = (steps.n_frames - 1) // GROUP if steps.n_frames else 0
    heads = catalogue.select("blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups).cast("long"))).alias("part"), F.lit(-1).alias("scheme"), none("nbins", "int"), none("first", "long"), F.lit(0).alias("side"), none("frames", "binary"), none("cells", "binary"), "inside")
    meet = sides[0].unionByName(sides[1]).unionByName(heads)
    meet = meet.repartition("blocks", "part").sortWithinPartitions("blocks", "part", "scheme", "first", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["blocks", "scheme", "nbins", "cell", "step", "cnt"]
        blocks, scheme, nbins = -1, -1, 0
        inside = i = j = np.empty(0, dtype=np.int64)
        sums: dict[int, np.ndarray] = {}

        def out(step: int, cell: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
            cell = inside[cell // (nbins * nbins)] * (nbins * nbins) + cell % (nbins * nbins)
            cols = [np.full(len(cell), blocks), np.full(len(cell), scheme, np.int32), np.full(len(cell), nbins, np.int32), cell, np.full(len(cell), step, np.int32), count]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

        def flush(step: int) -> pa.RecordBatch:
            count = sums.pop(step)
            cell = np.flatnonzero(count)
            return out(step, cell, count[cell])

        def counted(step: int, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            square = nbins * nbins
            dense = len(i) * square <= DENSE
            if dense and step not in sums:
                if len(sums) > 1:  # frames come in order, so the least step is over, or nearly so
                    yield flush(min(sums))
                sums[step] = np.zeros(len(i) * square, dtype=np.int64)
            each = max(1, min(max(1, (1 << 20) // square), (1 << 21) // max(1, len(x))))
            for at in range(0, len(i), each):
                a, b = x[:, i[at : at + each]].astype(np.int64), y[:, j[at : at + each]]
                code = np.arange(a.shape[1]) * square + a * nbins + b
                count = np.bincount(code[(a != NONE) & (b != NONE)], minlength=a.shape[1] * square if dense else 1)
                if dense:
                    sums[step][at * square : at * square + len(count)] += count
                else:
                    cell = np.flatnonzero(count)
                    yield out(step, at * square + cell, count[cell])

        held = None
        for batch in batches:
            for b, k, n, side, frames, cells, pairs_ in zip(*(batch.column(c).to_pylist() for c in ("blocks", "scheme", "nbins", "side", "frames", "cells", "inside")), strict=True):
                if (b, k) != (blocks, scheme):
                    for s in list(sums):
                        yield flush(s)
                    if b != blocks or pairs_ is not None:
                        inside = i = j = np.empty(0, dtype=np.int64)
                    blocks, scheme, nbins = b, k, n
                if pairs_ is not None:
                    inside = np.sort(np.array(pairs_, dtype=np.int64))
                    i, j = inside // BLOCK, inside % BLOCK
                    one_block = (b >> 58) == ((b >> 56) & 3) and ((b >> 28) & 0xFFFFFFF) == (b & 0xFFFFFFF)
                    continue
                grid = np.frombuffer(cells, np.uint8).reshape(-1, BLOCK)
                if side == 1 and not one_block:
                    held = frames, grid
                    continue
                if not one_block and (held is None or held[0] != frames):
                    raise ValueError("tiles of two blocks do not hold the same frames")
                for s, at in _by_step(np.frombuffer(frames, np.int64), steps):
                    yield from counted(s, (grid if one_block else held[1])[at], grid[at])
                held = None
        for s in list(sums):
            yield flush(s)

    counts = meet.mapInArrow(run, "blocks long, scheme int, nbins int, cell long, step int, cnt long")
    whole = cumulative(counts, ["blocks", "scheme", "nbins", "cell"], steps.nsteps)
    square = F.col("nbins") * F.col("nbins")
    pair, cell = F.floor(F.col("cell") / square), F.col("cell") % square
    high, low = (F.shiftright("blocks", k).bitwiseAND(F.lit(0xFFFFFFF)) for k in (28, 0))
    types = {k: _type(F.shiftright("blocks", s).bitwiseAND(F.lit(3)).cast("int")) for k, s in (("t1", 58), ("t2", 56))}
    named = whole.select(types["t1"].alias("t1"), (high * BLOCK + F.floor(pair / BLOCK)).cast("int").alias("d1"), types["t2"].alias("t2"), (low * BLOCK + pair % BLOCK).cast("int").alias("d2"), "scheme", "nbins",
                         F.floor(cell / F.col("nbins")).cast("int").alias("b1"), (cell % F.col("nbins")).cast("int").alias("b2"), "step", "cnt")
    kind = None
    for name, (_, a, b) in PAIR_TYPES.items():
        kind = (F if kind is None else kind).when((F.col("t1") == a) & (F.col("t2") == b), name)
    return named.select(kind.alias("pair_type"), *named.columns)
