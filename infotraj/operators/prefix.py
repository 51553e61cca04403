"""Stored running counts of bins over blocks of frames: histograms of any steps that fall on blocks, without the frames.

A row says how many of a cell's frames lie in its block and all before; only blocks that hit the cell have one. A histogram over
frames a to b is the difference of two running counts. Appended frames add their own blocks to the last counts, and no
stored block or earlier frame is looked at again. What is stored holds for one set of extents: frames beyond them are refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from infotraj.operators import discretize
from infotraj.operators.histogram import Steps
from infotraj.operators.small import if_small

CELL = ["dof_type", "dof", "scheme", "nbins", "bin"]


@dataclass(frozen=True)
class Running:
    """A folder with a table `counts`, parts of which each append adds, and the extents that bins were made with.

    Frames 0 to n_frames - 1 are counted; n_frames is a multiple of the block.
    """

    spark: SparkSession
    path: str
    block: int

    @property
    def counts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/counts")

    @property
    def extents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/extents")

    @property
    def n_frames(self) -> int:
        last = self.spark.read.parquet(f"{self.path}/frames").agg(F.max("n_frames")).first()[0]
        return last or 0

    def _add(self, bins: DataFrame, n_frames: int, before: DataFrame | None) -> None:
        if n_frames % self.block:
            raise ValueError(f"{n_frames} frames are not whole blocks of {self.block}")
        hits = bins.withColumn("block", F.floor(F.col("frame") / self.block)).groupBy(*CELL, "block").agg(F.count("*").alias("cnt"))
        running = hits.withColumn("upto", F.sum("cnt").over(Window.partitionBy(*CELL).orderBy("block")))  # a cell has a row a block at most
        if before is not None:
            held = before.groupBy(*CELL).agg(F.max("upto").alias("was"))
            running = running.join(held, CELL, "left").withColumn("upto", F.col("upto") + F.coalesce("was", F.lit(0)))
        running.select(*CELL, "block", "upto").write.mode("append").parquet(f"{self.path}/counts")
        self.spark.createDataFrame([(n_frames,)], "n_frames long").write.mode("append").parquet(f"{self.path}/frames")

    def hist1d(self, steps: Steps) -> DataFrame:
        """hist1d(dof_type, dof, scheme, nbins, bin, step, cnt), as histogram.hist1d of the same frames.

        Start and step size must be multiples of the block, the stride 1.
        """
        if steps.stride != 1 or steps.start % self.block or steps.size % self.block:
            raise ValueError(f"steps of {steps.size} frames from {steps.start} on do not fall on blocks of {self.block}")
        if steps.n_frames > self.n_frames:
            raise ValueError(f"{self.n_frames} frames are counted, {steps.n_frames} asked for")
        ends = [(steps.start + steps.size * (k + 1)) // self.block for k in range(steps.nsteps)]
        upto = lambda end: F.coalesce(F.max(F.when(F.col("block") < end, F.col("upto"))), F.lit(0))  # noqa: E731  counts never fall
        wanted = self.counts.where(F.col("block") < ends[-1]).groupBy(*CELL).agg(upto(steps.start // self.block).alias("was"), F.array(*map(upto, ends)).alias("row"))
        return wanted.where(F.get("row", F.lit(steps.nsteps - 1)) > F.col("was")).select(*CELL, F.posexplode("row").alias("step", "upto"), "was").select(*CELL, "step", (F.col("upto") - F.col("was")).alias("cnt"))

    def append(self, coords: DataFrame, n_frames: int, schemes: list[int]) -> None:
        """Count coords(dof_type, dof, frame, x) of n_frames further frames, numbered from 0, behind what is counted."""
        ext, moved = self.extents, F.when(F.col("phase") != 0, (F.col("x") + F.col("phase")) % discretize.TWO_PI).otherwise(F.col("x"))
        turned = coords.join(if_small(ext.select("dof_type", "dof", "min", "max", "phase")), ["dof_type", "dof"]).select("dof_type", "dof", "min", "max", moved.alias("x"))
        out = turned.groupBy("dof_type", "dof").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.first("min").alias("min"), F.first("max").alias("max")).where("lo < min or hi > max")
        if beyond := out.orderBy("dof_type", "dof").limit(3).collect():
            raise ValueError("extents have moved, count anew: " + ", ".join(f"{r.dof_type} {r.dof} has {r.lo:.6g} to {r.hi:.6g} of {r['min']:.6g} to {r['max']:.6g}" for r in beyond))
        first = self.n_frames
        bins = discretize.bins(coords.withColumn("frame", F.col("frame") + first), ext, schemes)
        self._add(bins, first + n_frames, self.counts)


def count(coords: DataFrame, n_frames: int, ext: DataFrame, schemes: list[int], path: str, block: int) -> Running:
    """Count all frames of coords once, in blocks, into a new folder."""
    spark = coords.sparkSession
    ext.write.parquet(f"{path}/extents")
    out = Running(spark, path, block)
    out._add(discretize.bins(coords, ext, schemes), n_frames, None)
    return out
