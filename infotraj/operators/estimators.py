"""Entropies of histograms: maximum likelihood (ML), Miller-Madow (MM), Chao-Shen (CS) and James-Stein (JS).

With p = cnt / n, w the width (area) of a bin and J its Jacobian, each is a sum over bins of -q ln(q / (w J)), where q
is p or a corrected p. James-Stein gives weight to empty bins too; their sum has a closed form, so no grid of all bins
is built: it is what all bins of a coordinate would give less what the listed ones do.

Defined where the formulas are not: Chao-Shen is 0 if every observation is in a bin of its own; James-Stein shrinks
wholly to its target (lambda 1) if the histogram equals it or holds one observation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from infotraj.operators.small import held, if_small

ESTIMATORS = ("ML", "MM", "CS", "JS")


def log_jacobian(dof_type: Column, mid: Column) -> Column:
    """ln r^2 of a bond, ln sin of an angle, 0 of a torsion, at the middle of a bin."""
    return F.when(dof_type == "bond", 2 * F.log(mid)).when(dof_type == "angle", F.log(F.sin(mid))).otherwise(0.0)


def geometry(ext: DataFrame, schemes: Sequence[int], jacobian: bool = True, kde: bool = False) -> DataFrame:
    """(dof_type, dof, scheme, min, w, all_lnj): bin widths, and the sum of ln J over all bins, for each coordinate.

    For kernel density states the width is 1 and nothing depends on the middle.
    """
    plans = F.array(*[F.struct(F.lit(i).alias("scheme"), F.lit(n).alias("nb")) for i, n in enumerate(schemes)])
    g = ext.select("dof_type", "dof", "min", "max", F.explode(plans).alias("s")).select("dof_type", "dof", "min", "max", "s.scheme", "s.nb")
    g = g.withColumn("w", F.lit(1.0) if kde else (F.col("max") - F.col("min")) / F.col("nb"))
    total = F.lit(0.0)
    if jacobian:
        total = F.aggregate(F.sequence(F.lit(0), F.col("nb") - 1), F.lit(0.0), lambda acc, i: acc + log_jacobian(F.col("dof_type"), F.col("min") + (i + 0.5) * F.col("w")))
    return held(g.select("dof_type", "dof", "scheme", "min", "w", total.alias("all_lnj")))


def _estimate(cells: DataFrame, keys: list[str], step_size: int, estimators: Sequence[str]) -> DataFrame:
    """From cells(keys, step, cnt, lnw, lnj, lnj_cs, bins, target, all_lnj) one row for keys, step and estimator."""
    wanted = [e.upper() for e in estimators]
    if not wanted or set(wanted) - set(ESTIMATORS):
        raise ValueError(f"estimators are of {ESTIMATORS}, not {estimators}")
    keys = [*keys, "step"]
    n = ((F.col("step") + 1) * step_size).cast("double")
    df = cells.withColumn("n", n).withColumn("p", F.col("cnt") / F.col("n"))
    group = Window.partitionBy(*keys)  # a histogram: as many rows as bins at most
    out = {}
    plain = F.sum(F.when(F.col("cnt") > 0, -F.col("p") * (F.log("p") - F.col("lnw") - F.col("lnj"))).otherwise(0.0))
    out["ML"] = plain
    out["MM"] = plain + (F.sum((F.col("cnt") > 0).cast("int")) - 1) / (2 * F.first("n"))
    if "CS" in wanted:
        df = df.withColumn("cover", 1 - F.sum((F.col("cnt") == 1).cast("int")).over(group) / F.col("n"))
        q = F.col("cover") * F.col("p")
        seen = 1 - F.pow(1 - q, F.col("n"))
        out["CS"] = F.sum(F.when(q > 0, -q * (F.log(q) - F.col("lnw") - F.col("lnj_cs")) / seen).otherwise(0.0))
    if "JS" in wanted:
        t, p = F.col("target"), F.col("p")
        df = df.withColumn("listed", F.count("*").over(group)).withColumn("p2", F.sum(p * p).over(group))
        df = df.withColumn("off", F.sum((t - p) * (t - p)).over(group) + (F.col("bins") - F.col("listed")) * t * t)
        bottom = (F.col("n") - 1) * F.col("off")
        df = df.withColumn("lam", F.when(bottom > 0, (1 - F.col("p2")) / F.when(bottom > 0, bottom)).otherwise(1.0))
        q = F.col("lam") * t + (1 - F.col("lam")) * p
        listed = F.sum(F.when(q > 0, -q * (F.log(F.when(q > 0, q)) - F.col("lnw") - F.col("lnj"))).otherwise(0.0))
        e, empties = F.first("lam") * F.first("target"), F.first("bins") - F.first("listed")
        rest = -e * (empties * (F.log(F.when(e > 0, e)) - F.first("lnw")) - (F.first("all_lnj") - F.sum("lnj")))
        out["JS"] = listed + F.when((e > 0) & (empties > 0), rest).otherwise(0.0)
    values = F.explode(F.array(*[F.struct(F.lit(e).alias("estimator"), F.col(e).alias("s")) for e in wanted])).alias("v")
    return df.groupBy(*keys).agg(*[out[e].alias(e) for e in wanted]).select(*keys, values).select(*keys, "v.estimator", "v.s")


def entropy1d(hist: DataFrame, geo: DataFrame, step_size: int, estimators: Sequence[str] = ESTIMATORS, jacobian: bool = True) -> DataFrame:
    """entropy1d(dof_type, dof, scheme, step, estimator, s)"""
    h = hist.join(if_small(geo), ["dof_type", "dof", "scheme"])
    lnj = log_jacobian(F.col("dof_type"), F.col("min") + (F.col("bin") + 0.5) * F.col("w")) if jacobian else F.lit(0.0)
    cells = h.select("dof_type", "dof", "scheme", "step", "cnt", F.log("w").alias("lnw"), lnj.alias("lnj"), F.col("nbins").cast("long").alias("bins"), (1.0 / F.col("nbins")).alias("target"), "all_lnj")
    return _estimate(cells.withColumn("lnj_cs", F.col("lnj")), ["dof_type", "dof", "scheme"], step_size, estimators)


def entropy2d(hist: DataFrame, geo: DataFrame, step_size: int, estimators: Sequence[str] = ESTIMATORS, jacobian: bool = True, strict_math: bool = False) -> DataFrame:
    """entropy2d(pair_type, t1, d1, t2, d2, scheme, step, estimator, s)

    As by default known results have it, Chao-Shen takes the second Jacobian at the row's number, and James-Stein's
    target is one over the bins of one coordinate. strict_math corrects both.
    """
    small = if_small(geo)
    one = small.select(F.col("dof_type").alias("t1"), F.col("dof").alias("d1"), "scheme", F.col("min").alias("min1"), F.col("w").alias("w1"), F.col("all_lnj").alias("all1"))
    two = small.select(F.col("dof_type").alias("t2"), F.col("dof").alias("d2"), "scheme", F.col("min").alias("min2"), F.col("w").alias("w2"), F.col("all_lnj").alias("all2"))
    h = hist.join(one, ["t1", "d1", "scheme"]).join(two, ["t2", "d2", "scheme"])

    def lnj(i: str, b: str) -> Column:
        return log_jacobian(F.col(f"t{i}"), F.col(f"min{i}") + (F.col(b) + 0.5) * F.col(f"w{i}")) if jacobian else F.lit(0.0)

    nb = F.col("nbins")
    cells = h.select("pair_type", "t1", "d1", "t2", "d2", "scheme", "step", "cnt", (F.log("w1") + F.log("w2")).alias("lnw"), (lnj("1", "b1") + lnj("2", "b2")).alias("lnj"),
        (lnj("1", "b1") + lnj("2", "b2" if strict_math else "b1")).alias("lnj_cs"), (nb * nb).cast("long").alias("bins"), (1.0 / (nb * nb if strict_math else nb)).alias("target"), (nb * (F.col("all1") + F.col("all2"))).alias("all_lnj"))
    return _estimate(cells, ["pair_type", "t1", "d1", "t2", "d2", "scheme"], step_size, estimators)
