"""Binning of coordinates into equal bins between their extents, which are taken over all frames."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from infotraj.operators.small import held, if_small, like

#: By how much a range is extended, the least range and what it is widened by, and the difference of ranges that counts as none.
DX, LEAST_RANGE, WIDEN, SAME_RANGE = 5e-9, 1e-4, 0.05, 0.1
PI, TWO_PI = math.pi, 2 * math.pi
REFERENCE_BINS = 30


def _widened(df: DataFrame, ceiling: Column) -> DataFrame:
    """min and max of raw extremes lo and hi: extended, clamped to 0 and the ceiling, then widened if too narrow."""
    low, high = F.greatest(F.col("lo") - DX, F.lit(0.0)), F.least(F.col("hi") + DX, ceiling)
    return df.withColumn("min", low).withColumn("max", high).withColumn("max", F.when(F.col("max") - F.col("min") < LEAST_RANGE, F.col("max") + WIDEN).otherwise(F.col("max")))


def linear_extents(coords: DataFrame) -> DataFrame:
    """extents(dof_type, dof, min, max, avg, phase) of bonds and angles; the phase is 0."""
    seen = coords.where(F.col("dof_type") != "torsion").groupBy("dof_type", "dof").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("avg"))
    ceiling = F.when(F.col("dof_type") == "angle", F.lit(PI)).otherwise(F.lit(float("inf")))
    return _widened(seen, ceiling).select("dof_type", "dof", "min", "max", "avg", F.lit(0.0).alias("phase"))


def torsion_extents(coords: DataFrame) -> DataFrame:
    """Extents of torsions as they are or turned by half a circle, whichever are clearly narrower."""
    turned = (F.col("x") + PI) % TWO_PI
    t = coords.where(F.col("dof_type") == "torsion").groupBy("dof_type", "dof").agg(
        F.min("x").alias("lo1"), F.max("x").alias("hi1"), F.min(turned).alias("lo2"), F.max(turned).alias("hi2"), F.avg("x").alias("raw"))
    r1, r2 = F.col("hi1") - F.col("lo1"), F.col("hi2") - F.col("lo2")
    t = t.withColumn("turn", (F.abs(r1 - r2) > SAME_RANGE) & (r1 >= r2))
    t = t.select("dof_type", "dof", "raw", F.when(F.col("turn"), F.col("lo2")).otherwise(F.col("lo1")).alias("lo"), F.when(F.col("turn"), F.col("hi2")).otherwise(F.col("hi1")).alias("hi"), F.when(F.col("turn"), PI).otherwise(0.0).alias("phase"))
    avg = F.when(F.col("phase") == 0, F.col("raw")).otherwise((F.col("raw") + F.col("phase")) % TWO_PI)
    return _widened(t, F.lit(TWO_PI)).select("dof_type", "dof", "min", "max", avg.alias("avg"), "phase")


def _circles(coords: DataFrame, reference_bins: int) -> DataFrame:
    """(dof_type, dof, raw, cut, phase, ends): the mean, the best cut, and the extremes of each half of each full cell.

    One scan: a coarse histogram of at most 180 cells is all that leaves it. The cut is in the middle of a cell, so that
    each half of a cell lies on one side of it, and the extremes of the turned circle are among those of halves.
    """
    m = min(3 * reference_bins, 180)
    size = (TWO_PI + DX) / m
    x, cell = F.col("x"), F.least(F.abs(F.floor(F.col("x") / size)), F.lit(m - 1)).cast("int")
    upper = x >= (F.col("cell") + 0.5) * size
    ends = [f(F.when(upper if up else ~upper, x)) for up in (False, True) for f in (F.min, F.max)]
    halves = coords.where(F.col("dof_type") == "torsion").withColumn("cell", cell).groupBy("dof_type", "dof", "cell")
    halves = halves.agg(F.count("*").alias("cnt"), F.sum("x").alias("sum"), F.array_compact(F.array(*ends)).alias("ends"))
    cells = halves.groupBy("dof_type", "dof").agg(
        F.sort_array(F.collect_list("cell")).alias("full"), F.min(F.struct("cnt", "cell")).alias("least"), F.flatten(F.collect_list("ends")).alias("ends"), (F.sum("sum") / F.sum("cnt")).alias("raw"))

    def run(c: Column, i: Column) -> Column:
        following = F.coalesce(F.get("full", i + 1), F.get("full", F.lit(0)) + m)
        return F.struct((following - c - 1).alias("len"), (-((c + 1) % m)).alias("start"))

    best = F.array_max(F.transform("full", run))
    cut = F.when(best["len"] > 0, -best["start"]).otherwise(F.col("least.cell"))
    return cells.select("dof_type", "dof", "raw", "ends", cut.alias("cut")).withColumn("phase", TWO_PI - (F.col("cut") + 0.5) * size)


def torsion_cuts(coords: DataFrame, reference_bins: int = REFERENCE_BINS) -> DataFrame:
    """(dof_type, dof, cut, phase): where each circle is best cut, and the turn that brings the cut to the end.

    The cut is the first cell of the longest circular run of empty cells, the earliest of equal ones; where no cell is
    empty it is the emptiest cell.
    """
    return _circles(coords, reference_bins).select("dof_type", "dof", "cut", "phase")


def torsion_extents_optimized(coords: DataFrame, reference_bins: int = REFERENCE_BINS) -> DataFrame:
    """Extents of torsions after the turn that torsion_cuts finds."""
    t = _circles(coords, reference_bins)
    t = t.withColumn("moved", F.transform("ends", lambda x: (x + F.col("phase")) % TWO_PI)).withColumns({"lo": F.array_min("moved"), "hi": F.array_max("moved")})
    return _widened(t, F.lit(TWO_PI)).select("dof_type", "dof", "min", "max", ((F.col("raw") + F.col("phase")) % TWO_PI).alias("avg"), "phase")


def extents(coords: DataFrame, optimize: bool = True, reference_bins: int = REFERENCE_BINS) -> DataFrame:
    """The extents of all coordinates, kept: every later step needs them, and they are one row a degree of freedom."""
    torsions = torsion_extents_optimized(coords, reference_bins) if optimize else torsion_extents(coords)
    return held(linear_extents(coords).unionByName(torsions))


def bins(coords: DataFrame, ext: DataFrame, schemes: Sequence[int]) -> DataFrame:
    """bins(dof_type, dof, frame, scheme int, nbins int, bin int): each coordinate under each number of bins.

    A torsion is turned by its phase first. The join is a broadcast one while extents are few; no row is shuffled.
    """
    joined = coords.join(if_small(like(ext.select("dof_type", "dof", "min", "max", "phase"), ext)), ["dof_type", "dof"])
    x = F.when(F.col("phase") != 0, (F.col("x") + F.col("phase")) % TWO_PI).otherwise(F.col("x"))
    plans = F.array(*[F.struct(F.lit(i).alias("scheme"), F.lit(n).alias("nbins")) for i, n in enumerate(schemes)])
    each = joined.select("dof_type", "dof", "frame", "min", "max", x.alias("x"), F.explode(plans).alias("s"))
    place = F.floor((F.col("x") - F.col("min")) / ((F.col("max") - F.col("min")) / F.col("s.nbins")))
    return each.select("dof_type", "dof", "frame", "s.scheme", "s.nbins", F.least(place, F.col("s.nbins") - 1).cast("int").alias("bin"))


def permutation(df: DataFrame, seed: int, per_dof: bool = False) -> DataFrame:
    """(frame, to), or (dof_type, dof, frame, to), of the frames of (dof_type, dof, frame, ...).

    A permutation sorts frames by a seeded hash. Its ranks are counted within 4,096 ranges of the hash and offset by
    the sizes of the ranges below, so that no task holds all frames.
    """
    keys = ["dof_type", "dof"] if per_dof else []
    h = F.xxhash64(F.lit(seed), *keys, "frame")
    frames = df.select(*keys, "frame").distinct().withColumn("h", h).withColumn("part", F.shiftrightunsigned("h", 52))
    ranked = frames.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "part").orderBy("h", "frame")))
    sizes = ranked.groupBy(*keys, "part").agg(F.max("k").alias("size"))
    below = sizes.select(*keys, "part", (F.sum("size").over(Window.partitionBy(*keys).orderBy("part")) - F.col("size")).alias("off"))
    return ranked.join(below, [*keys, "part"]).select(*keys, "frame", (F.col("off") + F.col("k") - 1).cast("long").alias("to"))


def permuted(df: DataFrame, to: DataFrame) -> DataFrame:
    """df with its frames renumbered by a permutation."""
    keys = [c for c in to.columns if c != "to"]
    return df.join(to, keys).drop("frame").withColumnRenamed("to", "frame").select(df.columns)


def shuffled_frames(df: DataFrame, seed: int, per_dof: bool = False) -> DataFrame:
    """Frames of (dof_type, dof, frame, ...) permuted: one permutation for all, or one for each degree of freedom."""
    return permuted(df, permutation(df, seed, per_dof))
