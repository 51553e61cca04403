"""Mutual information, the expansion by it, and the maximum-information spanning tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infotraj.sources.selection import PAIR_TYPES

RUN = ["estimator", "scheme", "step"]
EDGE = "pair_type string, t1 string, d1 int, t2 string, d2 int, mi double"
#: Edges that a task takes at most, about, and forests that meet in one.
EDGES, MEET = 250_000, 16


def mutual_information(s1: DataFrame, s2: DataFrame) -> DataFrame:
    """(pair_type, t1, d1, t2, d2, estimator, scheme, step, s, mi) with mi = S(d1) + S(d2) - S(d1, d2)."""
    one = s1.select(*RUN, F.col("dof_type").alias("t1"), F.col("dof").alias("d1"), F.col("s").alias("sa"))
    two = s1.select(*RUN, F.col("dof_type").alias("t2"), F.col("dof").alias("d2"), F.col("s").alias("sb"))
    both = s2.join(one, [*RUN, "t1", "d1"]).join(two, [*RUN, "t2", "d2"])
    return both.select("pair_type", "t1", "d1", "t2", "d2", *RUN, "s", (F.col("sa") + F.col("sb") - F.col("s")).alias("mi"))


def convergence(s1: DataFrame, mi: DataFrame, step_size: int, edges: DataFrame | None = None) -> DataFrame:
    """A row for each estimator, scheme and step: sums by type, S1 = sum of entropies, S2 = S1 - sum of informations.

    With edges (of spanning trees) the informations are those of edges only; entropies of pairs are summed over all.
    """
    kinds = [("BOND", "bond"), ("ANGLE", "angle"), ("DIHED", "torsion")]

    def total(column: str, value: str, kind: str):
        return F.sum(F.when(F.col(column) == kind, F.col(value)).otherwise(0.0))

    ones = s1.groupBy(*RUN).agg(*[total("dof_type", "s", t).alias(f"{n}_S1") for n, t in kinds], F.sum("s").alias("S1"))
    pairs = mi.groupBy(*RUN).agg(*[total("pair_type", "s", t).alias(f"{t}_S2") for t in PAIR_TYPES])
    infos = (mi if edges is None else edges).groupBy(*RUN).agg(*[total("pair_type", "mi", t).alias(f"{t}_I2") for t in PAIR_TYPES], F.sum("mi").alias("I"))
    out = ones.join(pairs, RUN, "left").join(infos, RUN, "left").na.fill(0.0)
    middle = [c for t in PAIR_TYPES for c in (f"{t}_S2", f"{t}_I2")]
    return out.select(*RUN, ((F.col("step") + 1) * step_size).cast("long").alias("TIME"), *[f"{n}_S1" for n, _ in kinds], *middle, "S1", (F.col("S1") - F.col("I")).alias("S2"))


def _forest(edges: pd.DataFrame) -> pd.DataFrame:
    """The maximum spanning forest of some edges, ties in the order of pair types and numbers. One edge a time, heaviest first."""
    place = edges["pair_type"].map({t: i for i, t in enumerate(("BB", "BA", "BD", "AA", "AD", "DD"))}).to_numpy()
    order = np.lexsort((edges["d2"], edges["d1"], place, -edges["mi"]))
    tips = pd.MultiIndex.from_frame(pd.concat([edges[["t1", "d1"]].set_axis(["t", "d"], axis=1), edges[["t2", "d2"]].set_axis(["t", "d"], axis=1)]))
    codes, _ = pd.factorize(tips)
    parent = list(range(codes.max() + 1 if len(codes) else 0))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    a, b, taken = codes[: len(edges)].tolist(), codes[len(edges) :].tolist(), []
    for k in order.tolist():
        x, y = root(a[k]), root(b[k])
        if x != y:
            parent[x] = y
            taken.append(k)
    return edges.iloc[taken]


def spanning_tree(mi: DataFrame, parts: int | None = None) -> DataFrame:
    """The edges of the maximum spanning tree (forest, where disconnected) of each estimator, scheme and step.

    Edges outside the forest of some of the edges are outside that of all. So a run's edges are dealt into parts of
    about EDGES, each is cut to its forest, and MEET forests at a time meet until one is left: a task holds MEET times
    the number of coordinates at most. Informations of zero and less count as edges too. Edges whose information is
    null are left out.
    """
    schema = f"estimator string, scheme int, step int, {EDGE}"
    e = mi.where("mi is not null").select(*RUN, "pair_type", "t1", "d1", "t2", "d2", "mi")
    if parts is None:
        parts = 1 + (e.groupBy(*RUN).count().agg(F.max("count")).first()[0] or 0) // EDGES
    e = e.withColumn("part", F.pmod(F.xxhash64("t1", "d1", "t2", "d2"), F.lit(parts)).cast("int"))
    while parts > 1:
        e = e.groupBy(*RUN, "part").applyInPandas(_forest, f"{schema}, part int").withColumn("part", F.floor(F.col("part") / MEET).cast("int"))
        parts = -(-parts // MEET)
    return e.drop("part").groupBy(*RUN).applyInPandas(_forest, schema)
