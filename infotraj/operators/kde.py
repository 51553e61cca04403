"""States of torsions: the basins between the minima of a von Mises kernel density."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infotraj.functions.vonmises import GRID, density_of_moments, minima, smoothing, weights
from infotraj.operators.small import if_small


def moments(coords: DataFrame, most: int) -> DataFrame:
    """(dof, k, c, s): sums of cos kx and sin kx of each torsion, k from 0 (the number of angles) to most - 1.

    Built-in functions all the way: what leaves a task is `most` rows a torsion, however many frames it has.
    """
    t = coords.where(F.col("dof_type") == "torsion").select("dof", "x", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("k"))
    return t.groupBy("dof", "k").agg(F.sum(F.cos(F.col("k") * F.col("x"))).alias("c"), F.sum(F.sin(F.col("k") * F.col("x"))).alias("s"))


def density(coords: DataFrame, n_frames: int, kappa: float = 1.0) -> DataFrame:
    """(dof, degree, density, gradient, second) of each torsion at 0 to 360 degrees.

    The kernel is a low-pass filter of the circle's moments, so their sums are all that is needed of the frames; a torsion's own
    moments, a row of two arrays, then give its 361 values.
    """
    n = max(1, n_frames)
    w = weights(smoothing(n, kappa))
    names = ["dof", "degree", "density", "gradient", "second"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                c, s = (part.column(x).flatten().to_numpy().reshape(part.num_rows, -1) for x in ("c", "s"))
                degree = np.tile(np.arange(len(GRID), dtype=np.int32), part.num_rows)
                dof = np.repeat(part.column("dof").to_numpy(), len(GRID))
                yield pa.RecordBatch.from_arrays([pa.array(dof), pa.array(degree), *(pa.array(x.ravel()) for x in density_of_moments(c, s, n, w))], names=names)

    gathered = moments(coords, len(w)).groupBy("dof").agg(F.sort_array(F.collect_list(F.struct("k", "c", "s"))).alias("m")).select("dof", F.col("m.c").alias("c"), F.col("m.s").alias("s"))
    return gathered.mapInArrow(run, "dof int, degree int, density double, gradient double, second double")


def torsion_minima(dens: DataFrame, nmaxconf: int = 5, step: float = 5.0, rounds: int = 1000, tolerance: float = 1e-4) -> DataFrame:
    """minima(dof, k, minima array<double>) in radians, ascending; a group is the 361 rows of one torsion."""

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("degree")
        got = minima(rows["gradient"].to_numpy(), rows["second"].to_numpy(), nmaxconf, step, rounds, tolerance)
        return pd.DataFrame({"dof": [rows["dof"].iloc[0]], "k": [len(got)], "minima": [got]})

    return dens.groupBy("dof").applyInPandas(find, "dof int, k int, minima array<double>")


def states(coords: DataFrame, found: DataFrame, nmaxconf: int = 5) -> DataFrame:
    """bins(dof_type, dof, frame, scheme, nbins, bin): the number of the basin, 0 for that over the circle's seam.

    A value equal to a boundary, and any value where fewer than two minima part the circle, has state 0.
    """
    t = coords.where(F.col("dof_type") == "torsion").join(if_small(found), "dof")
    below = F.size(F.filter("minima", lambda m: m < F.col("x")))
    state = F.when((F.col("k") < 2) | (below == F.col("k")) | F.array_contains("minima", F.col("x")), 0).otherwise(below)
    return t.select("dof_type", "dof", "frame", F.lit(0).alias("scheme"), F.lit(nmaxconf).alias("nbins"), state.cast("int").alias("bin"))
