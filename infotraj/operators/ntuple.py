"""Histograms and entropies of stated tuples of coordinates, of any number each.

A tuple's cell is the code of its bins, refined coordinate by coordinate: the codes of (a, b) serve all (a, b, c), so tuples in
order share their prefixes. Codes are sparse: only cells that frames hit are ever counted, whatever their number could be.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infotraj.operators.estimators import log_jacobian
from infotraj.operators.histogram import Steps, cumulative
from infotraj.operators.small import MAX_LOCAL_ROWS, if_small
from infotraj.operators.tiles import NONE, binned, geometry_of

Tuples = Sequence[Sequence[tuple[str, int]]]


def refined(grids: dict[str, np.ndarray], tuples: list[list[tuple[str, int]]], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number, codes) of each tuple, -1 where a frame lacks a coordinate; tuples come in an order that shares prefixes."""
    path: list[tuple[tuple[str, int], np.ndarray]] = []
    for number in sorted(range(len(tuples)), key=lambda k: tuples[k]):
        own = tuples[number]
        shared = 0
        while shared < min(len(path), len(own)) and path[shared][0] == own[shared]:
            shared += 1
        del path[shared:]
        for t, d in own[shared:]:
            bins = grids[t][:, d].astype(np.int64)
            code = np.where(bins == NONE, -1, bins)
            if path:
                code = np.where((path[-1][1] < 0) | (code < 0), -1, path[-1][1] * n + code)
            path.append(((t, d), code))
        yield number, path[len(own) - 1][1]


def histnd(wide: DataFrame, ext: DataFrame, schemes: Sequence[int], tuples: Tuples, steps: Steps) -> DataFrame:
    """(tuple, scheme, nbins, cell, step, cnt): tuple is the number in the list, cell the code of its bins, the first coordinate highest.

    Frames are binned and counted in the scan's own tasks; counts alone are shuffled. Tuples and extents go to all workers.
    """
    listed = [list(map(tuple, x)) for x in tuples]
    if len(listed) > MAX_LOCAL_ROWS or any(max(schemes) ** len(x) > 1 << 62 for x in listed):
        raise ValueError("too many tuples, or too long ones for 64 bits")
    geometry = geometry_of(wide, ext)
    if missing := sorted({t for x in listed for t, d in x if t not in geometry or d >= geometry[t].shape[1] or np.isnan(geometry[t][0, d])}):
        raise ValueError(f"tuples of coordinates that are not there, of {missing}")
    plans = list(schemes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["tuple", "scheme", "nbins", "cell", "step", "cnt"], [np.int32, np.int32, np.int32, np.int64, np.int32, np.int64]
        for batch in batches:
            step = batch.column("step").to_numpy()
            grids: dict[int, dict[str, np.ndarray]] = {}
            for t, k, _, bins in binned(batch, geometry, plans):
                grids.setdefault(k, {})[t] = bins
            for k, by_type in grids.items():
                for number, code in refined(by_type, listed, plans[k]):
                    for s in np.unique(step).tolist():
                        cell, count = np.unique(code[(step == s) & (code >= 0)], return_counts=True)
                        cols = [np.full(len(cell), number), np.full(len(cell), k), np.full(len(cell), plans[k]), cell, np.full(len(cell), s), count]
                        yield pa.RecordBatch.from_arrays([pa.array(c.astype(x)) for c, x in zip(cols, kinds, strict=True)], names=names)

    counts = steps.assign(wide.select("frame", *geometry)).select("step", *geometry).mapInArrow(run, "tuple int, scheme int, nbins int, cell long, step int, cnt long")
    return cumulative(counts, ["tuple", "scheme", "nbins", "cell"], steps.nsteps)


def entropynd(hist: DataFrame, geo: DataFrame, tuples: Tuples, step_size: int, miller_madow: bool = False, jacobian: bool = True) -> DataFrame:
    """(tuple, scheme, step, s): maximum-likelihood entropies of tuples, or Miller-Madow ones, with geometry of estimators.geometry."""
    rows = [(i, k, len(x) - 1 - k, t, d) for i, x in enumerate(tuples) for k, (t, d) in enumerate(x)]
    ends = hist.sparkSession.createDataFrame(rows, "tuple int, place int, above int, dof_type string, dof int").join(if_small(geo), ["dof_type", "dof"])
    ends = ends.groupBy("tuple", "scheme").agg(F.sort_array(F.collect_list(F.struct("place", "above", "dof_type", "min", "w"))).alias("ends"))
    bin_of = lambda e: F.floor(F.col("cell") / F.pow(F.col("nbins").cast("double"), e["above"])).cast("long") % F.col("nbins")
    mid = lambda e: log_jacobian(e["dof_type"], e["min"] + (bin_of(e) + 0.5) * e["w"])
    total = lambda f: F.aggregate("ends", F.lit(0.0), lambda got, e: got + f(e))
    n = ((F.col("step") + 1) * step_size).cast("double")
    cells = hist.where("cnt > 0").join(if_small(ends), ["tuple", "scheme"]).withColumn("p", F.col("cnt") / n)
    space = total(lambda e: F.log(e["w"])) + (total(mid) if jacobian else F.lit(0.0))
    plain = F.sum(-F.col("p") * (F.log("p") - space))
    extra = (F.count("*") - 1) / (2 * F.first(n)) if miller_madow else F.lit(0.0)
    return cells.groupBy("tuple", "scheme", "step").agg((plain + extra).alias("s"))
