"""Trajectories: coordinates of bonds, angles and torsions by frame, from tables of arrays or long tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("bond", "angle", "torsion")
TWO_PI = 2 * math.pi
#: Columns that tell a run's tables.
KINDS = {
    "blocks": {"dof_type", "dof", "first", "x"}, "hist2d": {"pair_type", "b1", "b2", "step", "cnt"}, "hist1d": {"dof_type", "bin", "step", "cnt"}, "bins": {"dof_type", "frame", "bin"},
    "entropy2d": {"pair_type", "step", "s"}, "entropy1d": {"dof_type", "step", "s"},
}


@dataclass(frozen=True)
class Trajectory:
    """coords(dof_type, dof int, frame long, x double); frames are numbered 0 to n_frames - 1.

    Coordinates that are null or no number are left out. wide holds the same as a row of arrays for each frame; store is
    the path of the same by coordinate, if it was read from one.
    """

    coords: DataFrame
    n_frames: int
    wide: DataFrame | None = None
    store: str | None = None

    def limited(self, n_frames: int) -> Trajectory:
        """The first so many frames."""
        n = min(n_frames, self.n_frames)
        return Trajectory(self.coords.where(F.col("frame") < n), n, None if self.wide is None else self.wide.where(F.col("frame") < n), self.store)

    def expect(self, counts: dict[str, int]) -> None:
        """Refuse a trajectory that has other numbers of coordinates than these; 0 stands for any."""
        if wanted := {t: n for t, n in counts.items() if n}:
            got = {r.dof_type: r.n for r in self.coords.where(F.col("dof_type").isin(list(wanted))).groupBy("dof_type").agg((F.max("dof") + 1).alias("n")).collect()}
            if any(got.get(t, 0) != n for t, n in wanted.items()):
                raise ValueError(f"coordinates expected {wanted}, found {got}")

    def block(self, dof_type: str, first_dof: int, n_dofs: int, first_frame: int = 0, n_frames: int | None = None) -> DataFrame:
        """The coordinates of some successive degrees of freedom in some successive frames."""
        last = self.n_frames if n_frames is None else min(self.n_frames, first_frame + n_frames)
        if self.store is not None:
            from infotraj.sources import blocks  # it builds on this module

            return blocks.scan(self.coords.sparkSession, self.store, {dof_type: range(first_dof, first_dof + n_dofs)}, first_frame, last)
        return self.coords.where((F.col("dof_type") == dof_type) & F.col("dof").between(first_dof, first_dof + n_dofs - 1) & (F.col("frame") >= first_frame) & (F.col("frame") < last))


def _frames(df: DataFrame) -> int:
    """One more than the last frame; Parquet answers this from its footers or one narrow column."""
    last = df.agg(F.max("frame")).first()[0]
    return 0 if last is None else last + 1


def _clean(df: DataFrame) -> DataFrame:
    return df.where(F.col("x").isNotNull() & ~F.isnan("x"))


def from_wide(df: DataFrame) -> Trajectory:
    """From frames (frame, bond array, angle array, torsion array). Any of the arrays may be missing."""
    parts = []
    for dof_type in TYPES:
        if dof_type in df.columns:
            parts.append(df.select(F.lit(dof_type).alias("dof_type"), F.col("frame").cast("long").alias("frame"), F.posexplode(dof_type).alias("dof", "x")))
    if not parts:
        raise ValueError("no column bond, angle or torsion")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return Trajectory(_clean(every.select("dof_type", "dof", "frame", F.col("x").cast("double").alias("x"))), _frames(df), df.select(F.col("frame").cast("long").alias("frame"), *[F.col(t).cast("array<double>").alias(t) for t in TYPES if t in df.columns]))


def read_wide(spark: SparkSession, paths: str | Sequence[str]) -> Trajectory:
    return from_wide(spark.read.parquet(*([paths] if isinstance(paths, str) else paths)))


def write_wide(frames: DataFrame, path: str, append: bool = False) -> None:
    """Frames (frame, bond array, angle array, torsion array) as Parquet that read_wide reads; appended frames follow on."""
    cols = ["frame", *[t for t in TYPES if t in frames.columns]]
    if len(cols) == 1:
        raise ValueError("no column bond, angle or torsion")
    kept = frames.select(F.col("frame").cast("long").alias("frame"), *[F.col(t).cast("array<double>").alias(t) for t in cols[1:]])
    if append:
        kept = kept.withColumn("frame", F.col("frame") + _frames(frames.sparkSession.read.parquet(path)))
    kept.write.mode("append" if append else "errorifexists").parquet(path)


def kind_of(spark: SparkSession, path: str) -> str:
    """What a Parquet table holds, by its columns: trajectory, bins, hist1d, hist2d, entropy1d, entropy2d or unknown."""
    have = set(spark.read.parquet(path).columns)
    for kind, need in KINDS.items():
        if need <= have:
            return kind
    return "trajectory" if "frame" in have and have & set(TYPES) else "unknown"


def from_embeddings(spark: SparkSession, sf_dir: str) -> Trajectory:
    """Vectors read as frames: places 0-19 are bonds, 20-39 angles, 40-63 torsions."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("e"))
    turn = F.transform(F.slice("e", 41, 24), lambda v: ((v * 12) % TWO_PI + TWO_PI) % TWO_PI)
    return from_wide(e.select("frame", F.transform(F.slice("e", 1, 20), lambda v: v + 1.5).alias("bond"), F.transform(F.slice("e", 21, 20), lambda v: v + 1.6).alias("angle"), turn.alias("torsion")))


def from_events(spark: SparkSession, sf_dir: str) -> Trajectory:
    """The values of all events in the order of their ids, as one bond."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("frame"), F.array("value").alias("bond"))
    return from_wide(ev)
