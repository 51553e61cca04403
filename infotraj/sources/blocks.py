"""Trajectories stored by coordinate: a row holds the values that one coordinate takes in some successive frames.

A table of frames holds all coordinates of a frame together, so that reading one coordinate reads them all. Here frames x
coordinates are turned into rows (dof_type, dof, first, x array): the coordinate's values in frames first, first + 1, ...,
NaN where there is none. Rows are cut at multiples of SPAN frames, at gaps, and where a scan's batch ends.

Turning happens in the scan's own tasks. What they make is shuffled once, by (type, block of BLOCK coordinates, chunk of
CHUNK frames), so that a partition's size is bounded however long the trajectory is, and sorted by coordinate in each file. Parquet's
statistics of row groups and pages then leave out what a scan of some coordinates or frames does not ask for: n of N
coordinates read about n/N of the bytes.

Edges: null arrays and arrays of several lengths give no value where they end; null and NaN values are left out when read;
frames in any order are taken, scattered ones make shorter rows; a null frame is left out; frames that repeat stay
repeated; an empty table makes an empty store; other columns are ignored. A frame below 0 raises.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from infotraj.operators.histogram import _matrix
from infotraj.sources.trajectory import TYPES, Trajectory

#: Frames of a row at most, coordinates of a block, frames of a chunk, values of a slice of a batch, bytes of a row group.
SPAN, BLOCK, CHUNK, VALUES, GROUP = 4096, 64, 1 << 20, 1 << 22, 4 << 20
STORE = "dof_type string, dof int, first long, x array<double>"


def _runs(frames: np.ndarray, span: int) -> list[tuple[int, int]]:
    """[from, to) of successive frames, cut at multiples of span."""
    cut = (np.diff(frames) != 1) | (frames[1:] % span == 0)
    at = [0, *(np.flatnonzero(cut) + 1).tolist(), len(frames)]
    return list(zip(at[:-1], at[1:], strict=True))


def turned(wide: DataFrame, span: int = SPAN) -> DataFrame:
    """Rows (dof_type, dof, first, x) of frames (frame, bond array, angle array, torsion array)."""
    types = [t for t in TYPES if t in wide.columns]
    if not types:
        raise ValueError("no column bond, angle or torsion")

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        frames = batch.column("frame").to_numpy()
        order = np.argsort(frames, kind="stable")
        frames = frames[order]
        if frames[0] < 0:
            raise ValueError(f"frame {frames[0]} is below 0")
        runs = _runs(frames, span)
        for t in types:
            width = int(pa.compute.max(batch.column(t).value_lengths()).as_py() or 0)
            if not width:
                continue
            x = np.ascontiguousarray(_matrix(batch.column(t), width)[order].T)
            for a, b in runs:
                values = pa.array(np.ascontiguousarray(x[:, a:b]).ravel())
                ends = pa.array(np.arange(width + 1, dtype=np.int32) * (b - a))
                cols = [pa.array([t] * width), pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, frames[a])), pa.ListArray.from_arrays(ends, values)]
                yield pa.RecordBatch.from_arrays(cols, names=["dof_type", "dof", "first", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            width = max(1, sum(int(pa.compute.max(batch.column(t).value_lengths()).as_py() or 0) for t in types))
            each = max(1, VALUES // width)
            for at in range(0, batch.num_rows, each):
                yield from rows(batch.slice(at, each))

    lists = [F.col(t).cast("array<double>").alias(t) for t in types]
    return wide.where(F.col("frame").isNotNull()).select(F.col("frame").cast("long").alias("frame"), *lists).mapInArrow(run, STORE)


def _end(store: DataFrame) -> int:
    """One more than the last frame: no values are read for it, only first and the arrays' lengths of the last rows."""
    last = store.agg(F.max("first")).first()[0]
    if last is None:
        return 0
    return last + store.where(F.col("first") == last).agg(F.max(F.size("x"))).first()[0]


def write_blocks(wide: DataFrame, path: str, append: bool = False, partitions: int | None = None, span: int = SPAN) -> None:
    """Write frames as a store that read_blocks reads; appended frames follow on those that it holds, whose rows are not read again."""
    frames = wide
    if append:
        frames = wide.withColumn("frame", F.col("frame").cast("long") + F.lit(_end(wide.sparkSession.read.schema(STORE).parquet(path))))
    keys = ["dof_type", F.shiftright("dof", BLOCK.bit_length() - 1), F.floor(F.col("first") / CHUNK)]
    dealt = turned(frames, span).repartition(*([partitions] if partitions else []), *keys)
    sorted_ = dealt.sortWithinPartitions("dof_type", "dof", "first")
    sorted_.write.mode("append" if append else "errorifexists").option("parquet.block.size", GROUP).option("parquet.page.size", 1 << 18).parquet(path)


def _wanted(dofs: dict[str, Sequence[int] | range | None]) -> Column:
    """The rows of these coordinates by type; None stands for all of a type, a range without gaps is asked for by its ends."""
    parts = []
    for t, chosen in dofs.items():
        mine = F.col("dof_type") == t
        if isinstance(chosen, range) and chosen.step == 1:
            mine &= F.col("dof").between(chosen.start, chosen.stop - 1)
        elif chosen is not None:
            mine &= F.col("dof").isin([int(d) for d in chosen])
        parts.append(mine)
    out = F.lit(False)
    for k, p in enumerate(parts):
        out = p if k == 0 else out | p
    return out


def scan(spark: SparkSession, path: str, dofs: dict[str, Sequence[int] | range | None] | None = None, start: int = 0, end: int | None = None, stride: int = 1, span: int = SPAN) -> DataFrame:
    """(dof_type, dof, frame, x) of some coordinates, all unless stated, in every stride-th frame from start to before end.

    Coordinates and rows of other frames are left out by the Parquet reader; what a row holds outside start and end goes
    before the arrays are taken apart. span is that of the writer, or more.
    """
    if start < 0 or stride < 1:
        raise ValueError("start is 0 or more, stride 1 or more")
    rows = spark.read.schema(STORE).parquet(path)
    if dofs is not None:
        rows = rows.where(_wanted(dofs))
    rows = rows.where(F.col("first") > start - span)
    if end is not None:
        rows = rows.where(F.col("first") < end)
    # Spark may take arrays apart before it filters rows, so lengths are never negative;
    # places of the row's array from skip on: the first frame from start that is on the stride
    ahead = F.col("first") - F.lit(start)
    skip = F.when(ahead <= 0, -ahead).otherwise((stride - ahead % stride) % stride)
    most = F.size("x").cast("long") if end is None else F.least(F.size("x").cast("long"), F.lit(end) - F.col("first"))
    cut = rows.select("dof_type", "dof", "first", "x", skip.alias("skip"), most.alias("most")).where(F.col("skip") < F.col("most"))
    if stride == 1:
        taken = cut.select("dof_type", "dof", (F.col("first") + F.col("skip")).alias("from"), F.slice("x", F.col("skip").cast("int") + 1, F.greatest(F.lit(0), F.col("most") - F.col("skip")).cast("int")).alias("x"))
    else:
        at = F.sequence(F.col("skip"), F.greatest(F.col("skip"), F.col("most") - 1), F.lit(stride).cast("long"))
        taken = cut.select("dof_type", "dof", (F.col("first") + F.col("skip")).alias("from"), F.transform(at, lambda i: F.get("x", i.cast("int"))).alias("x"))
    long = taken.select("dof_type", "dof", "from", F.posexplode("x").alias("at", "x"))
    return long.where(F.col("x").isNotNull() & ~F.isnan("x")).select("dof_type", "dof", (F.col("from") + F.col("at").cast("long") * stride).alias("frame"), "x")


def read_blocks(spark: SparkSession, path: str) -> Trajectory:
    """A store as a trajectory: filters on coordinates reach the reader, and block() also leaves out other frames' rows."""
    rows = spark.read.schema(STORE).parquet(path)
    return Trajectory(scan(spark, path), _end(rows), None, path)
