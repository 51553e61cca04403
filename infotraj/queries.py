"""The engine's registered queries over the vectors table read as a trajectory, and the SQL they are held against.

The SQL counts over dense grids of all bins; the engine does not build those.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import cached_property, partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from infotraj.operators import discretize, estimators, kde, ntuple, permute, prefix, score, tiles
from infotraj.operators.histogram import Steps, hist1d, hist2d, hist2d_frames, step_window
from infotraj.operators.small import held, if_small, is_local, like
from infotraj.sources import blocks, classic, selection
from infotraj.sources.trajectory import TYPES, from_embeddings, from_events

NBINS, NSTEPS = 10, 4


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns])


class Plan:
    """The usual chain over one folder's trajectory; each link is built when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, schemes=(NBINS,), start: int = 0, stride: int = 1, types=TYPES, n_frames: int | None = None):
        self.t, self.schemes = from_embeddings(spark, sf_dir), list(schemes)
        self.coords = self.t.coords if set(types) == set(TYPES) else self.t.coords.where(F.col("dof_type").isin(*types))
        self.steps = Steps(min(n_frames or self.t.n_frames, self.t.n_frames), NSTEPS, start, stride)
        self.ext = discretize.extents(self.coords)

    @cached_property
    def bins(self) -> DataFrame:
        return discretize.bins(self.coords, self.ext, self.schemes)

    def hist1d(self) -> DataFrame:
        return hist1d(self.bins, self.steps)

    def pairs(self, pair_types=tuple(selection.PAIR_TYPES)) -> DataFrame:
        return selection.known_pairs(like(self.ext.select("dof_type", "dof"), self.ext), pair_types)

    def hist2d(self, form: str = "auto", pair_types=tuple(selection.PAIR_TYPES)) -> DataFrame:
        pairs = self.pairs(pair_types)
        if form == "tiles":
            return tiles.hist2d_tiles(tiles.pack(self.t.wide, self.ext, self.schemes), pairs, self.steps)
        if form != "join" and is_local(pairs):
            return hist2d_frames(self.t.wide, self.ext, self.schemes, pairs, self.steps)
        return hist2d(self.bins, pairs, self.steps, form)

    def entropy1d(self, est=estimators.ESTIMATORS, jacobian: bool = True) -> DataFrame:
        return estimators.entropy1d(self.hist1d(), estimators.geometry(self.ext, self.schemes, jacobian), self.steps.size, est, jacobian)

    def scored(self, est=("ML",), pair_types=tuple(selection.PAIR_TYPES)) -> tuple[DataFrame, DataFrame]:
        """Entropies of coordinates and informations of pairs, each computed once."""
        s1 = held(self.entropy1d(est))
        return s1, held(score.mutual_information(s1, self.entropy2d(est, pair_types)))

    def entropy2d(self, est=estimators.ESTIMATORS, pair_types=tuple(selection.PAIR_TYPES), strict_math: bool = False) -> DataFrame:
        return estimators.entropy2d(self.hist2d(pair_types=pair_types), estimators.geometry(self.ext, self.schemes), self.steps.size, est, strict_math=strict_math)

    def mi(self, est=("ML",), pair_types=tuple(selection.PAIR_TYPES)) -> DataFrame:
        return score.mutual_information(held(self.entropy1d(est)), self.entropy2d(est, pair_types))


def q_extents(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    c = from_embeddings(spark, sf_dir).coords
    ext = discretize.torsion_extents(c) if kind == "torsion" else discretize.linear_extents(c).where(F.col("dof_type") == kind)
    return rounded(ext, "min", "max", "avg", "phase")


def q_bins(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    c = from_embeddings(spark, sf_dir).coords.where(F.col("dof_type") == kind)
    ext = discretize.torsion_extents(c) if kind == "torsion" else discretize.linear_extents(c)
    return discretize.bins(c, held(ext), [NBINS]).select("dof", "frame", "bin")


def q_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(discretize.torsion_extents_optimized(from_embeddings(spark, sf_dir).coords), "min", "max", "avg", "phase")


def q_hist1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Plan(spark, sf_dir).hist1d().drop("scheme", "nbins")


def q_hist1d_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Plan(spark, sf_dir)
    return tiles.hist1d_tiles(tiles.pack(p.t.wide, p.ext, p.schemes), p.steps).drop("scheme", "nbins")


def _store_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors mount: under spark.checkpoint.dir where that is set, else a local session's own."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.gettempdir()
    path = f"{top.removeprefix('file://').removeprefix('file:').rstrip('/')}/stores-{uuid.uuid4().hex}"
    os.makedirs(path)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def q_store_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins written as stores of the classic layout, one a type, and every third frame from the tenth on read back and counted."""
    p, folder = Plan(spark, sf_dir), _store_folder(spark)
    packed, back = tiles.pack(p.t.wide, p.ext, p.schemes), None
    for t in TYPES:
        classic.write_bins(packed, p.ext, p.schemes, p.t.n_frames, t, f"{folder}/{t}.nc")
        read = classic.read_bins(spark, f"{folder}/{t}.nc", 10, 3)
        back = read if back is None else back.unionByName(read)
    frames = len(range(10, p.t.n_frames, 3))
    return hist1d(back, Steps(frames, NSTEPS)).drop("scheme", "nbins")


def q_store_hist2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of all pairs of a bond and a torsion, written as a store and read back, empty cells left out."""
    p, path = Plan(spark, sf_dir), f"{_store_folder(spark)}/hist.nc"
    classic.write_histograms(p.hist2d(pair_types=("BD",)), p.ext, p.schemes, p.steps, "BD", path)
    ids, cell = F.col("ids"), F.col("cell")
    return classic.read_histograms(spark, path).select(ids[0].alias("d1"), ids[1].alias("d2"), F.floor(cell / NBINS).cast("int").alias("b1"), (cell % NBINS).cast("int").alias("b2"), "step", "cnt")


def q_blocks_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trajectory stored by coordinate, its second half appended to the first; successive coordinates of one type read from frame 100 on."""
    t, path = from_embeddings(spark, sf_dir), f"{_store_folder(spark)}/blocks"
    half = t.n_frames // 2
    blocks.write_blocks(t.wide.where(F.col("frame") < half), path)
    blocks.write_blocks(t.wide.where(F.col("frame") >= half).withColumn("frame", F.col("frame") - half), path, append=True)
    return rounded(blocks.read_blocks(spark, path).block("torsion", 5, 7, 100).select("dof", "frame", "x"), "x")


def q_blocks_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of every third frame from the tenth on, of coordinates stated one by one, off the store by coordinate."""
    p, path = Plan(spark, sf_dir), f"{_store_folder(spark)}/blocks"
    blocks.write_blocks(p.t.wide, path)
    chosen = {"bond": [0, 3, 17], "angle": range(4, 9), "torsion": [23]}
    read = blocks.scan(spark, path, chosen, 10, stride=3)
    steps = Steps(p.t.n_frames, NSTEPS, 10, 3)
    return hist1d(discretize.bins(read, p.ext, p.schemes), steps).drop("scheme", "nbins")


def q_running(append: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual steps from stored running counts; with append the second half of the frames is counted behind the first."""
    p, path = Plan(spark, sf_dir), f"{_store_folder(spark)}/running"
    n, size = p.t.n_frames, max(1, p.steps.size)
    block = max(d for d in range(1, max(1, size // 5) + 1) if size % d == 0)
    half = n // (2 * block) * block if append else n // block * block
    kept = prefix.count(p.coords.where(F.col("frame") < half), half, p.ext, p.schemes, path, block)
    if append:
        rest = n // block * block - half
        later = p.coords.where((F.col("frame") >= half) & (F.col("frame") < half + rest)).withColumn("frame", F.col("frame") - half)
        kept.append(later, rest, p.schemes)
    return kept.hist1d(Steps(size * NSTEPS, NSTEPS)).drop("scheme", "nbins")


def q_hist2d(form: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return Plan(spark, sf_dir).hist2d(form).select("pair_type", "d1", "d2", "b1", "b2", "step", "cnt")


def q_entropy1d(est: str, jacobian: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Plan(spark, sf_dir).entropy1d([est], jacobian).select("dof_type", "dof", "step", "s"), "s")


def q_entropy2d(est: str, strict_math: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Plan(spark, sf_dir).entropy2d([est], strict_math=strict_math).select("pair_type", "d1", "d2", "step", "s"), "s")


#: Triples of successive torsions, of torsions that share their first two, and of a bond, an angle and a torsion.
TRIPLES = [[("torsion", i), ("torsion", i + 1), ("torsion", i + 2)] for i in range(22)] + [[("torsion", 0), ("torsion", 1), ("torsion", i)] for i in range(3, 9)] + [[("bond", i), ("angle", i), ("torsion", i)] for i in range(20)]


def q_entropy3d(miller_madow: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Plan(spark, sf_dir)
    hist = ntuple.histnd(p.t.wide, p.ext, p.schemes, TRIPLES, p.steps)
    return rounded(ntuple.entropynd(hist, estimators.geometry(p.ext, p.schemes), TRIPLES, p.steps.size, miller_madow).select("tuple", "step", "s"), "s")


def q_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Plan(spark, sf_dir, start=10, stride=3).hist1d().drop("scheme", "nbins")


def q_frame_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Plan(spark, sf_dir, start=7, stride=2, n_frames=301).hist1d().drop("scheme", "nbins")


def q_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Plan(spark, sf_dir)
    p.bins = p.bins.join(if_small(like(p.ext.where("dof % 2 = 0").select("dof_type", "dof"), p.ext)), ["dof_type", "dof"], "left_semi")
    return rounded(p.entropy1d(["ML"]).select("dof_type", "dof", "step", "s"), "s")


def q_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.all_pairs(discretize.linear_extents(from_embeddings(spark, sf_dir).coords).unionByName(discretize.torsion_extents(from_embeddings(spark, sf_dir).coords)).select("dof_type", "dof"), max_apart=3)


def q_subset_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As q_subset, the subset written to a file and read from it."""
    p, path = Plan(spark, sf_dir), f"{_store_folder(spark)}/subset"
    selection.write_subset(p.ext, p.ext.where("dof % 2 = 0"), path)
    p.bins = p.bins.join(if_small(selection.read_subset(spark, path)), ["dof_type", "dof"], "left_semi")
    return rounded(p.entropy1d(["ML"]).select("dof_type", "dof", "step", "s"), "s")


def q_neighbor_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As q_neighbors, the pairs written to a neighbour file and read from it."""
    path = f"{_store_folder(spark)}/neighbours"
    selection.write_neighbors(q_neighbors(spark, sf_dir), path)
    return selection.read_neighbors(spark, path)


def q_mi(pair_type: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Plan(spark, sf_dir, types=set(selection.PAIR_TYPES[pair_type][1:]))
    return rounded(p.mi(("MM",), (pair_type,)).select("pair_type", "d1", "d2", "step", "mi"), "mi")


def q_mie(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Plan(spark, sf_dir)
    s1, mi = p.scored()
    out = score.convergence(s1, mi, p.steps.size).drop("estimator", "scheme")
    return rounded(out, *[c for c in out.columns if c not in ("step", "TIME")])


def q_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Plan(spark, sf_dir, (5, 12))
    return rounded(p.entropy1d(["ML"]).select("dof_type", "dof", "scheme", "step", "s"), "s")


def q_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return step_window(Plan(spark, sf_dir).hist1d().drop("scheme", "nbins"), 1, 2)


def q_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = from_events(spark, sf_dir)
    ext = held(discretize.linear_extents(t.coords))
    return hist1d(discretize.bins(t.coords, ext, [NBINS]), Steps(t.n_frames, NSTEPS)).select("bin", "step", "cnt")


def q_shuffled(per_dof: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    out = discretize.shuffled_frames(from_embeddings(spark, sf_dir).coords, 1000, per_dof)
    frame = [F.count("*").alias("n"), F.countDistinct("frame").alias("frames"), F.min("frame").alias("first"), F.max("frame").alias("last")]
    return rounded(out.groupBy("dof_type", "dof").agg(*frame, F.sum("x").alias("total")), "total")


def q_permuted(per_dof: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a keyed permutation sends each frame of each coordinate."""
    t = from_embeddings(spark, sf_dir)
    return permute.shuffled_frames(t.coords.select("dof_type", "dof", "frame"), t.n_frames, 1000, per_dof)


def q_permuted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = from_embeddings(spark, sf_dir)
    return permute.shuffled_blocks(t.wide.select("frame"), t.n_frames, 7 * NSTEPS, 1000)


def _mist_of(spark: SparkSession, sf_dir: str) -> tuple[Plan, DataFrame, DataFrame, DataFrame]:
    p = Plan(spark, sf_dir)
    s1, mi = p.scored()
    return p, s1, mi, score.spanning_tree(mi)


def q_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_mist_of(spark, sf_dir)[3], "mi").drop("estimator", "scheme")


def q_mist(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s1, mi, tree = _mist_of(spark, sf_dir)
    out = score.convergence(s1, mi, p.steps.size, tree).drop("estimator", "scheme")
    return rounded(out, *[c for c in out.columns if c not in ("step", "TIME")])


def _kde(spark: SparkSession, sf_dir: str) -> tuple:
    t = from_embeddings(spark, sf_dir)
    return t, held(kde.torsion_minima(kde.density(t.coords, t.n_frames), 3))


def q_kde_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = from_embeddings(spark, sf_dir)
    return rounded(kde.density(t.coords, t.n_frames), "density", "gradient", "second")


def q_kde_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kde(spark, sf_dir)[1]


def q_kde_minima_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each minimum, numbered from 0 along the circle."""
    return rounded(_kde(spark, sf_dir)[1].select("dof", "k", F.posexplode("minima").alias("place", "minimum")), "minimum")


def q_kde_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, found = _kde(spark, sf_dir)
    return kde.states(t.coords, found, 3).select("dof", "frame", "bin")


def q_kde_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, found = _kde(spark, sf_dir)
    steps = Steps(t.n_frames, NSTEPS)
    none: list[Column] = [F.lit(None).cast("double").alias(c) for c in ("min", "max")]
    geo = estimators.geometry(found.select(F.lit("torsion").alias("dof_type"), "dof", *none), [3], False, True)
    return rounded(estimators.entropy1d(hist1d(kde.states(t.coords, found, 3), steps), geo, steps.size, ["ML"], False).select("dof", "step", "s"), "s")


QUERIES = {f"extents_{k}": partial(q_extents, k) for k in TYPES}
QUERIES |= {f"bins_{k}": partial(q_bins, k) for k in TYPES}
QUERIES |= {"torsion_optimal_phase": q_phase, "hist1d_cumulative": q_hist1d, "hist2d_cumulative": partial(q_hist2d, "join"), "hist2d_blocks": partial(q_hist2d, "arrow"), "hist2d_tiles": partial(q_hist2d, "tiles"), "hist1d_tiles": q_hist1d_tiles, "running_hist": partial(q_running, False), "running_hist_appended": partial(q_running, True), "entropy3d_ml": partial(q_entropy3d, False), "entropy3d_mm": partial(q_entropy3d, True)}
QUERIES |= {"blocks_scan": q_blocks_scan, "blocks_hist": q_blocks_hist}
QUERIES |= {"store_stride_hist": q_store_stride, "store_hist2d": q_store_hist2d}
QUERIES |= {f"entropy1d_{e.lower()}": partial(q_entropy1d, e, True) for e in estimators.ESTIMATORS}
QUERIES |= {"entropy1d_nojac": partial(q_entropy1d, "ML", False)}
QUERIES |= {f"entropy2d_{e.lower()}": partial(q_entropy2d, e, False) for e in estimators.ESTIMATORS}
QUERIES |= {f"entropy2d_{e.lower()}_strict": partial(q_entropy2d, e, True) for e in ("CS", "JS")}
QUERIES |= {"frame_stride_hist": q_stride, "frame_limit_hist": q_frame_limit, "subset_entropy": q_subset, "neighbor_pairs": q_neighbors, "subset_file_entropy": q_subset_file, "neighbor_file_pairs": q_neighbor_file}
QUERIES |= {f"mi_{k.lower()}": partial(q_mi, k) for k in selection.PAIR_TYPES}
QUERIES |= {"mie_convergence": q_mie, "multi_scheme_entropy": q_schemes, "hist_step_window": q_window, "events_histogram": q_events}
QUERIES |= {"shuffled_frames": partial(q_shuffled, False), "shuffled_dofs": partial(q_shuffled, True), "permuted_frames": partial(q_permuted, False), "permuted_dofs": partial(q_permuted, True), "permuted_blocks": q_permuted_blocks}
QUERIES |= {"mist_tree": q_tree, "mist_convergence": q_mist, "kde_density": q_kde_density, "kde_minima": q_kde_minima, "kde_minima_places": q_kde_minima_places, "kde_states": q_kde_states, "kde_entropy": q_kde_entropy}

# The SQL, in common table expressions that build on each other. Numbers with an exponent are doubles there.
_TP, _PI = "6.283185307179586e0", "3.141592653589793e0"
_CLAMP = "greatest(lo - 5e-9, 0e0) AS mn"
_COORDS = f"""e AS (SELECT vec_id AS frame, unnest(range(64))::INT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
coords AS (SELECT CASE WHEN i < 20 THEN 'bond' WHEN i < 40 THEN 'angle' ELSE 'torsion' END AS dof_type, CASE WHEN i < 20 THEN i WHEN i < 40 THEN i - 20 ELSE i - 40 END AS dof, frame,
  CASE WHEN i < 20 THEN v + 1.5e0 WHEN i < 40 THEN v + 1.6e0 ELSE ((v * 12e0) % {_TP} + {_TP}) % {_TP} END AS x FROM e),
total AS (SELECT max(frame) + 1 AS n FROM coords)"""
_WIDE = "SELECT dof_type, dof, mn, CASE WHEN mx - mn < 1e-4 THEN mx + 0.05e0 ELSE mx END AS mx, av, phase"
_LINEAR = f"""l0 AS (SELECT dof_type, dof, min(x) AS lo, max(x) AS hi, avg(x) AS av FROM coords WHERE dof_type <> 'torsion' GROUP BY ALL),
lin AS ({_WIDE} FROM (SELECT *, {_CLAMP}, CASE WHEN dof_type = 'angle' THEN least(hi + 5e-9, {_PI}) ELSE hi + 5e-9 END AS mx, 0e0 AS phase FROM l0))"""
_PLAIN = f"""t0 AS (SELECT dof_type, dof, min(x) AS a, max(x) AS b, min((x + {_PI}) % {_TP}) AS c, max((x + {_PI}) % {_TP}) AS d, avg(x) AS raw FROM coords WHERE dof_type = 'torsion' GROUP BY ALL),
t1 AS (SELECT *, abs((b - a) - (d - c)) > 0.1e0 AND b - a >= d - c AS turn FROM t0),
tor AS ({_WIDE} FROM (SELECT dof_type, dof, greatest(CASE WHEN turn THEN c ELSE a END - 5e-9, 0e0) AS mn, least(CASE WHEN turn THEN d ELSE b END + 5e-9, {_TP}) AS mx,
  CASE WHEN turn THEN (raw + {_PI}) % {_TP} ELSE raw END AS av, CASE WHEN turn THEN {_PI} ELSE 0e0 END AS phase FROM t1))"""
_OPTIMAL = f"""o0 AS (SELECT dof_type, dof, least(abs(floor(x / (({_TP} + 5e-9) / 90))), 89)::INT AS cell, count(*) AS c FROM coords WHERE dof_type = 'torsion' GROUP BY ALL),
o1 AS (SELECT *, coalesce(lead(cell) OVER (PARTITION BY dof ORDER BY cell), min(cell) OVER (PARTITION BY dof) + 90) - cell - 1 AS gap FROM o0),
o2 AS (SELECT dof_type, dof, max(gap) AS longest, min(c) AS fewest FROM o1 GROUP BY ALL),
o3 AS (SELECT o1.dof, CASE WHEN any_value(longest) > 0 THEN min((cell + 1) % 90) FILTER (gap = longest) ELSE min(cell) FILTER (c = fewest) END AS cut FROM o1 JOIN o2 USING (dof) GROUP BY o1.dof),
o4 AS (SELECT dof, {_TP} - (cut + 0.5e0) * (({_TP} + 5e-9) / 90) AS phase FROM o3),
o5 AS (SELECT dof_type, dof, phase, min((x + phase) % {_TP}) AS lo, max((x + phase) % {_TP}) AS hi, avg(x) AS raw FROM coords JOIN o4 USING (dof) WHERE dof_type = 'torsion' GROUP BY ALL),
opt AS ({_WIDE} FROM (SELECT *, {_CLAMP}, least(hi + 5e-9, {_TP}) AS mx, (raw + phase) % {_TP} AS av FROM o5))"""
_EXT = f"{_COORDS},\n{_LINEAR},\n{_OPTIMAL},\next AS (SELECT * FROM lin UNION ALL SELECT * FROM opt)"


def _bins(ext: str, schemes=(NBINS,)) -> str:
    plans = ", ".join(f"({i}, {n})" for i, n in enumerate(schemes))
    return f"""plans(scheme, nb) AS (VALUES {plans}),
bins AS (SELECT dof_type, dof, frame, scheme, nb, least(floor((CASE WHEN phase <> 0 THEN (x + phase) % {_TP} ELSE x END - mn) / ((mx - mn) / nb)), nb - 1)::INT AS bin FROM coords JOIN {ext} USING (dof_type, dof), plans)"""


def _steps(start: int = 0, stride: int = 1, most: int = 1 << 62) -> str:
    return f"""size AS (SELECT ((least(n, {most}) - {start} + {stride - 1}) // {stride}) // {NSTEPS} AS size FROM total),
b AS (SELECT * FROM (SELECT *, ((frame - {start}) // {stride}) // size AS step FROM bins, size WHERE frame >= {start} AND (frame - {start}) % {stride} = 0) WHERE step < {NSTEPS}),
ks AS (SELECT unnest(range({NSTEPS}))::INT AS k)"""


_H1 = "h1 AS (SELECT dof_type, dof, scheme, nb, bin, k AS step, sum(CASE WHEN step <= k THEN c ELSE 0 END)::BIGINT AS cnt FROM (SELECT dof_type, dof, scheme, nb, bin, step, count(*) AS c FROM b GROUP BY ALL), ks GROUP BY ALL)"
_PAIRS = """ds AS (SELECT dof_type, dof FROM ext), kinds(pair_type, t1, t2) AS (VALUES ('BB', 'bond', 'bond'), ('AA', 'angle', 'angle'), ('DD', 'torsion', 'torsion'), ('BA', 'bond', 'angle'), ('BD', 'bond', 'torsion'), ('AD', 'angle', 'torsion')),
pairs AS (SELECT pair_type, t1, x.dof AS d1, t2, y.dof AS d2 FROM kinds JOIN ds x ON x.dof_type = t1 JOIN ds y ON y.dof_type = t2 WHERE t1 <> t2 OR x.dof < y.dof)"""
_H2 = f"""{_PAIRS},
j AS (SELECT pair_type, t1, d1, t2, d2, x.bin AS b1, y.bin AS b2, x.step, count(*) AS c FROM pairs JOIN b x ON x.dof_type = t1 AND x.dof = d1 JOIN b y ON y.dof_type = t2 AND y.dof = d2 AND y.frame = x.frame GROUP BY ALL),
h2 AS (SELECT pair_type, t1, d1, t2, d2, b1, b2, k AS step, sum(CASE WHEN step <= k THEN c ELSE 0 END)::BIGINT AS cnt FROM j, ks GROUP BY ALL)"""


def _lnj(kind: str, mid: str, jacobian: bool = True) -> str:
    return f"CASE {kind} WHEN 'bond' THEN 2 * ln({mid}) WHEN 'angle' THEN ln(sin({mid})) ELSE 0e0 END" if jacobian else "0e0"


def _estimate(est: str, keys: str) -> str:
    """s for each of keys from a dense grid g(keys, n, p, lnw, lnj, lnj_cs, t)."""
    if est in ("ML", "MM"):
        extra = " + (count(*) FILTER (p > 0) - 1) / (2 * any_value(n))" if est == "MM" else ""
        return f"SELECT {keys}, sum(CASE WHEN p > 0 THEN -p * (ln(p) - lnw - lnj) ELSE 0e0 END){extra} AS s FROM g GROUP BY {keys}"
    if est == "CS":
        inner = f"SELECT *, (1 - count(*) FILTER (cnt = 1) OVER (PARTITION BY {keys}) / n) * p AS q FROM g"
        return f"SELECT {keys}, sum(CASE WHEN q > 0 THEN -q * (ln(q) - lnw - lnj_cs) / (1 - (1 - q) ** n) ELSE 0e0 END) AS s FROM ({inner}) GROUP BY {keys}"
    lam = f"SELECT *, (1 - sum(p * p) OVER (PARTITION BY {keys})) / ((n - 1) * sum((t - p) * (t - p)) OVER (PARTITION BY {keys})) AS lam FROM g"
    return f"SELECT {keys}, sum(CASE WHEN q > 0 THEN -q * (ln(q) - lnw - lnj) ELSE 0e0 END) AS s FROM (SELECT *, lam * t + (1 - lam) * p AS q FROM ({lam})) GROUP BY {keys}"


def _s1(est: str, jacobian: bool = True) -> str:
    mid = "(mn + (i + 0.5e0) * w)"
    grid = f"""g AS (SELECT dof_type, dof, scheme, step, cnt, n, cnt / n AS p, ln(w) AS lnw, {_lnj('dof_type', mid, jacobian)} AS lnj, {_lnj('dof_type', mid, jacobian)} AS lnj_cs, t
  FROM (SELECT x.*, coalesce(cnt, 0) AS cnt FROM (SELECT dof_type, dof, scheme, nb, k AS step, unnest(range(nb))::INT AS i, mn, (mx - mn) / nb AS w, ((k + 1) * size)::DOUBLE AS n, 1e0 / nb AS t FROM ext, plans, ks, size) x
    LEFT JOIN h1 ON h1.dof_type = x.dof_type AND h1.dof = x.dof AND h1.scheme = x.scheme AND h1.step = x.step AND h1.bin = x.i))"""
    return f"s1 AS (WITH {grid} {_estimate(est, 'dof_type, dof, scheme, step')})"


def _s2(est: str, strict: bool = False) -> str:
    m1, m2, row = "(mn1 + (i1 + 0.5e0) * w1)", "(mn2 + (i2 + 0.5e0) * w2)", "(mn2 + (i1 + 0.5e0) * w2)"
    grid = f"""g AS (SELECT pair_type, d1, d2, step, cnt, n, cnt / n AS p, ln(w1) + ln(w2) AS lnw, {_lnj('t1', m1)} + {_lnj('t2', m2)} AS lnj, {_lnj('t1', m1)} + {_lnj('t2', m2 if strict else row)} AS lnj_cs, {'1e0 / 100' if strict else '1e0 / 10'} AS t
  FROM (SELECT x.*, coalesce(cnt, 0) AS cnt FROM (SELECT p.*, k AS step, r1.i AS i1, r2.i AS i2, u.mn AS mn1, (u.mx - u.mn) / 10 AS w1, v.mn AS mn2, (v.mx - v.mn) / 10 AS w2, ((k + 1) * size)::DOUBLE AS n
      FROM pairs p JOIN ext u ON u.dof_type = t1 AND u.dof = d1 JOIN ext v ON v.dof_type = t2 AND v.dof = d2, ks, size, (SELECT unnest(range(10))::INT AS i) r1, (SELECT unnest(range(10))::INT AS i) r2) x
    LEFT JOIN h2 ON h2.pair_type = x.pair_type AND h2.d1 = x.d1 AND h2.d2 = x.d2 AND h2.step = x.step AND h2.b1 = x.i1 AND h2.b2 = x.i2))"""
    return f"s2 AS (WITH {grid} {_estimate(est, 'pair_type, d1, d2, step')})"


_R = "round({0}, 6) + 0e0 AS {1}"
_EXTENT = ", ".join(_R.format(a, b) for a, b in (("mn", '"min"'), ("mx", '"max"'), ("av", '"avg"'), ("phase", "phase")))
_BASE = f"WITH {_EXT},\n{_bins('ext')},\n{_steps()},\n{_H1}"
_MI = "m AS (SELECT s2.*, a.s + z.s - s2.s AS mi FROM s2 JOIN kinds USING (pair_type) JOIN s1 a ON a.dof_type = t1 AND a.dof = d1 AND a.step = s2.step JOIN s1 z ON z.dof_type = t2 AND z.dof = d2 AND z.step = s2.step)"


def _chain(est: str) -> str:
    return f"{_BASE},\n{_H2},\n{_s1(est)},\n{_s2(est)},\n{_MI}"


def _mie() -> str:
    ones = ", ".join(f"sum(s) FILTER (dof_type = '{t}') AS {n}_S1" for n, t in (("BOND", "bond"), ("ANGLE", "angle"), ("DIHED", "torsion")))
    twos = ", ".join(f"sum(s) FILTER (pair_type = '{t}') AS {t}_S2, sum(mi) FILTER (pair_type = '{t}') AS {t}_I2" for t in selection.PAIR_TYPES)
    names = ["BOND_S1", "ANGLE_S1", "DIHED_S1", *[f"{t}_{x}" for t in selection.PAIR_TYPES for x in ("S2", "I2")], "S1"]
    return f"""{_chain('ML')}, a1 AS (SELECT step, {ones}, sum(s) AS S1 FROM s1 GROUP BY step), a2 AS (SELECT step, {twos}, sum(mi) AS info FROM m GROUP BY step)
SELECT step, ((step + 1) * size)::BIGINT AS "TIME", {', '.join(_R.format(n, n) for n in names)}, {_R.format('S1 - info', 'S2')} FROM a1 JOIN a2 USING (step), size"""


def _tree() -> str:
    """tree: the edges that have the best rank on the best path between their ends, which is what a spanning tree of ranks holds.

    A path's rank is that of its worst edge; six doublings reach all paths over 64 coordinates.
    """
    doubled = ", ".join(f"w{i + 1} AS MATERIALIZED (SELECT x.step, x.u, y.v, min(greatest(x.r, y.r)) AS r FROM w{i} x JOIN w{i} y ON x.step = y.step AND x.v = y.u GROUP BY ALL)" for i in range(6))
    return f"""{_chain('ML')},
ranked AS MATERIALIZED (SELECT m.*, t1, t2, row_number() OVER (PARTITION BY step ORDER BY mi DESC, list_position(['BB', 'BA', 'BD', 'AA', 'AD', 'DD'], pair_type), d1, d2) AS r FROM m JOIN kinds USING (pair_type)),
ends AS (SELECT step, t1 || d1 AS u, t2 || d2 AS v, r FROM ranked),
w0 AS MATERIALIZED (SELECT * FROM ends UNION ALL SELECT step, v, u, r FROM ends UNION ALL SELECT k, dof_type || dof, dof_type || dof, 0 FROM ds, ks), {doubled},
tree AS (SELECT ranked.* FROM ranked JOIN w6 ON w6.step = ranked.step AND w6.u = t1 || d1 AND w6.v = t2 || d2 WHERE w6.r = ranked.r)"""


def _mist() -> str:
    ones = ", ".join(f"sum(s) FILTER (dof_type = '{t}') AS {n}_S1" for n, t in (("BOND", "bond"), ("ANGLE", "angle"), ("DIHED", "torsion")))
    twos = ", ".join(f"sum(s) FILTER (pair_type = '{t}') AS {t}_S2" for t in selection.PAIR_TYPES)
    infos = ", ".join(f"coalesce(sum(mi) FILTER (pair_type = '{t}'), 0e0) AS {t}_I2" for t in selection.PAIR_TYPES)
    names = ["BOND_S1", "ANGLE_S1", "DIHED_S1", *[f"{t}_{x}" for t in selection.PAIR_TYPES for x in ("S2", "I2")], "S1"]
    return f"""{_tree()}, a1 AS (SELECT step, {ones}, sum(s) AS S1 FROM s1 GROUP BY step), a2 AS (SELECT step, {twos} FROM m GROUP BY step), a3 AS (SELECT step, {infos}, sum(mi) AS info FROM tree GROUP BY step)
SELECT step, ((step + 1) * size)::BIGINT AS "TIME", {', '.join(_R.format(n, n) for n in names)}, {_R.format('S1 - info', 'S2')} FROM a1 JOIN a2 USING (step) JOIN a3 USING (step), size"""


def _bessel(n: int, x: str) -> str:
    """I_n(x) e^-x by the mean over 4096 equal steps of the circle."""
    return f"(SELECT avg(exp({x} * (cos(i * {_TP} / 4096) - 1)) * cos({n} * i * {_TP} / 4096)) FROM range(4096) AS c(i))"


_DENSITY = f"""{_COORDS},
nu AS (SELECT n, power(3 * n * {_bessel(2, '2e0')} / (4 * sqrt({_PI}) * power({_bessel(0, '1e0')}, 2)), 0.4e0) AS nu FROM total),
scale AS (SELECT nu, {_TP} * n * {_bessel(0, 'nu')} AS scale FROM nu),
kernel AS (SELECT dof, degree::INT AS degree, nu, scale, cos(radians(degree) - x) AS c, sin(radians(degree) - x) AS s, exp(nu * (cos(radians(degree) - x) - 1)) AS e FROM coords, scale, range(361) AS g(degree) WHERE dof_type = 'torsion'),
dens AS MATERIALIZED (SELECT dof, degree, sum(e) / any_value(scale) AS density, -sum(s * e) * any_value(nu) / any_value(scale) AS gradient, sum((nu * s * s - c) * e) * any_value(nu) / any_value(scale) AS second FROM kernel GROUP BY dof, degree)"""


def _minima(most: int = 3, step: float = 5.0, rounds: int = 1000, tolerance: float = 1e-4) -> str:
    """minima(dof, k, place, minimum): downhill from midway between maxima, one step of all of them a round."""
    return f"""{_DENSITY.replace("e AS (SELECT", "RECURSIVE e AS (SELECT", 1)},
crossing AS (SELECT a.dof, a.degree, (a.second + b.second) / 2 AS sharp FROM dens a JOIN dens b ON b.dof = a.dof AND b.degree = a.degree + 1 WHERE a.gradient * b.gradient <= 0 AND b.second < -1e-4),
nine AS (SELECT * FROM crossing QUALIFY row_number() OVER (PARTITION BY dof ORDER BY degree) <= 9),
tops AS (SELECT dof, degree + 0.5e0 AS top FROM nine QUALIFY row_number() OVER (PARTITION BY dof ORDER BY sharp, degree) <= {most}),
start AS (SELECT dof, top, count(*) OVER (PARTITION BY dof) AS k, (coalesce(lag(top) OVER (PARTITION BY dof ORDER BY top), max(top) OVER (PARTITION BY dof) - 360) + top) / 2 AS x FROM tops),
walk AS (SELECT dof, top, k, CASE WHEN x < 0 THEN x + 360 ELSE x END AS x, 0 AS n, k = 1 AS done FROM start
  UNION ALL SELECT dof, top, k, CASE WHEN abs(slope) < {tolerance} THEN x WHEN y < 0 THEN y + 360 WHEN y >= 360 THEN y - 360 ELSE y END, n + 1, abs(slope) < {tolerance}
  FROM (SELECT *, x - greatest(-5e0, least(5e0, {step} * slope)) AS y FROM (SELECT walk.*, (a.degree + 1 - x) * a.gradient + (x - a.degree) * b.gradient AS slope
    FROM walk JOIN dens a ON a.dof = walk.dof AND a.degree = floor(x) JOIN dens b ON b.dof = walk.dof AND b.degree = floor(x) + 1 WHERE NOT done AND n < {rounds}))),
ended AS (SELECT dof, top, any_value(k) AS k, radians(arg_max(x, n)) AS minimum FROM walk GROUP BY dof, top),
minima AS MATERIALIZED (SELECT dof, k::INT AS k, (row_number() OVER (PARTITION BY dof ORDER BY minimum) - 1)::INT AS place, minimum FROM ended)"""


_STATES = f"""{_minima()},
below AS (SELECT coords.dof, frame, coalesce(any_value(k), 0) AS k, count(*) FILTER (minimum < x) AS c, coalesce(bool_or(minimum = x), false) AS on_edge FROM coords LEFT JOIN minima ON minima.dof = coords.dof WHERE dof_type = 'torsion' GROUP BY coords.dof, frame),
bins AS (SELECT dof, frame, CASE WHEN k < 2 OR c = k OR on_edge THEN 0 ELSE c END::INT AS bin FROM below)"""

ORACLES = {f"extents_{k}": f"WITH {_COORDS}, {_LINEAR} SELECT dof_type, dof, {_EXTENT} FROM lin WHERE dof_type = '{k}'" for k in ("bond", "angle")}
ORACLES["extents_torsion"] = f"WITH {_COORDS}, {_PLAIN} SELECT dof_type, dof, {_EXTENT} FROM tor"
ORACLES |= {f"bins_{k}": f"WITH {_COORDS}, {_LINEAR}, {_bins('lin')} SELECT dof, frame, bin FROM bins WHERE dof_type = '{k}'" for k in ("bond", "angle")}
ORACLES["bins_torsion"] = f"WITH {_COORDS}, {_PLAIN}, {_bins('tor')} SELECT dof, frame, bin FROM bins"
ORACLES["torsion_optimal_phase"] = f"WITH {_COORDS}, {_OPTIMAL} SELECT dof_type, dof, {_EXTENT} FROM opt"
ORACLES["hist1d_cumulative"] = ORACLES["hist1d_tiles"] = ORACLES["running_hist"] = ORACLES["running_hist_appended"] = f"{_BASE} SELECT dof_type, dof, bin, step, cnt FROM h1"
ORACLES |= {k: f"{_BASE},\n{_H2} SELECT pair_type, d1, d2, b1, b2, step, cnt FROM h2" for k in ("hist2d_cumulative", "hist2d_blocks", "hist2d_tiles")}


def _s3(miller_madow: bool) -> str:
    rows = ", ".join(f"({i}, {', '.join(f"'{t}', {d}" for t, d in x)})" for i, x in enumerate(TRIPLES))
    sides = "\n".join(f"JOIN b b{k} ON b{k}.dof_type = t{k} AND b{k}.dof = d{k}" + (" AND b{0}.frame = b1.frame".format(k) if k > 1 else "") for k in (1, 2, 3))
    space = " + ".join(f"ln((x{k}.mx - x{k}.mn) / 10) + {_lnj(f'x{k}.dof_type', f'(x{k}.mn + (i{k} + 0.5e0) * ((x{k}.mx - x{k}.mn) / 10))')}" for k in (1, 2, 3))
    extra = " + (count(*) - 1) / (2 * any_value(n))" if miller_madow else ""
    return f"""{_BASE}, triples(tuple, t1, d1, t2, d2, t3, d3) AS (VALUES {rows}),
h3 AS (SELECT tuple, t1, d1, t2, d2, t3, d3, b1.bin AS i1, b2.bin AS i2, b3.bin AS i3, k AS step, count(*) AS cnt FROM triples {sides} JOIN ks ON b1.step <= k GROUP BY ALL),
p3 AS (SELECT *, ((step + 1) * size)::DOUBLE AS n, cnt / ((step + 1) * size)::DOUBLE AS p FROM h3, size)
SELECT tuple, step, {_R.format(f"sum(-p * (ln(p) - ({space}))){extra}", "s")} FROM p3 {" ".join(f"JOIN ext x{k} ON x{k}.dof_type = t{k} AND x{k}.dof = d{k}" for k in (1, 2, 3))} GROUP BY tuple, step"""


ORACLES["entropy3d_ml"], ORACLES["entropy3d_mm"] = _s3(False), _s3(True)
ORACLES["store_hist2d"] = f"{_BASE},\n{_H2} SELECT d1, d2, b1, b2, step, cnt FROM h2 WHERE pair_type = 'BD' AND cnt > 0"
ORACLES |= {f"entropy1d_{e.lower()}": f"{_BASE}, {_s1(e)} SELECT dof_type, dof, step, {_R.format('s', 's')} FROM s1" for e in estimators.ESTIMATORS}
ORACLES["entropy1d_nojac"] = f"{_BASE}, {_s1('ML', False)} SELECT dof_type, dof, step, {_R.format('s', 's')} FROM s1"
ORACLES |= {f"entropy2d_{e.lower()}": f"{_BASE},\n{_H2},\n{_s2(e)} SELECT pair_type, d1, d2, step, {_R.format('s', 's')} FROM s2" for e in estimators.ESTIMATORS}
ORACLES |= {f"entropy2d_{e.lower()}_strict": f"{_BASE},\n{_H2},\n{_s2(e, True)} SELECT pair_type, d1, d2, step, {_R.format('s', 's')} FROM s2" for e in ("CS", "JS")}
ORACLES["frame_stride_hist"] = ORACLES["store_stride_hist"] = f"WITH {_EXT},\n{_bins('ext')},\n{_steps(10, 3)},\n{_H1} SELECT dof_type, dof, bin, step, cnt FROM h1"
ORACLES["blocks_hist"] = f"{ORACLES['frame_stride_hist']} WHERE (dof_type = 'bond' AND dof IN (0, 3, 17)) OR (dof_type = 'angle' AND dof BETWEEN 4 AND 8) OR (dof_type = 'torsion' AND dof = 23)"
ORACLES["blocks_scan"] = f"WITH {_COORDS} SELECT dof, frame, {_R.format('x', 'x')} FROM coords WHERE dof_type = 'torsion' AND dof BETWEEN 5 AND 11 AND frame >= 100"
ORACLES["frame_limit_hist"] = f"WITH {_EXT},\n{_bins('ext')},\n{_steps(7, 2, 301)},\n{_H1} SELECT dof_type, dof, bin, step, cnt FROM h1"
ORACLES["subset_entropy"] = ORACLES["subset_file_entropy"] = f"{_BASE}, {_s1('ML')} SELECT dof_type, dof, step, {_R.format('s', 's')} FROM s1 WHERE dof % 2 = 0"
ORACLES["neighbor_pairs"] = ORACLES["neighbor_file_pairs"] = f"WITH {_EXT}, {_PAIRS} SELECT * FROM pairs WHERE abs(d1 - d2) <= 3"
ORACLES |= {f"mi_{k.lower()}": f"{_chain('MM')} SELECT pair_type, d1, d2, step, {_R.format('mi', 'mi')} FROM m WHERE pair_type = '{k}'" for k in selection.PAIR_TYPES}
ORACLES["mie_convergence"] = _mie()
ORACLES["multi_scheme_entropy"] = f"WITH {_EXT},\n{_bins('ext', (5, 12))},\n{_steps()},\n{_H1},\n{_s1('ML')} SELECT dof_type, dof, scheme, step, {_R.format('s', 's')} FROM s1"
ORACLES["hist_step_window"] = f"{_BASE} SELECT dof_type, dof, bin, step, cnt FROM h1 WHERE step IN (1, 3)"
ORACLES["events_histogram"] = f"""WITH coords AS (SELECT 'bond' AS dof_type, 0 AS dof, event_id AS frame, value AS x FROM events WHERE value IS NOT NULL), total AS (SELECT max(event_id) + 1 AS n FROM events),
{_LINEAR}, {_bins('lin')}, {_steps()}, {_H1} SELECT bin, step, cnt FROM h1"""
ORACLES |= {k: f"WITH {_COORDS} SELECT dof_type, dof, count(*) AS n, count(*) AS frames, 0::BIGINT AS first, (SELECT n - 1 FROM total) AS last, {_R.format('sum(x)', 'total')} FROM coords GROUP BY dof_type, dof" for k in ("shuffled_frames", "shuffled_dofs")}


def _permuted(numbers: str, n: str) -> str:
    """CTEs that end in walk(key, x, y): where the permutation of numbers below n with each key of numbers(key) sends x."""
    p, rounds = permute.PRIME, []
    for k, (times, plus) in enumerate(permute.MIX):
        one, other = ("l", "h") if k % 2 else ("h", "l")
        mixed = f"((m * m) % {p} * {times} % {p})"
        moved = f"({one} + {mixed}) % {'b' if k % 2 else 'a'} AS {one}, {other}"
        rounds.append(f"r{k + 1} AS (SELECT key, x, a, b, {moved} FROM (SELECT *, ({other} + (key * {times} + {plus}) % {p}) % {p} AS m FROM r{k}))")
    return f"""many AS ({n}), root AS (SELECT n, greatest(1, floor(sqrt(n))::BIGINT) AS root FROM many),
radix AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT n, unnest(range(root - least(1000, root // 2), root + least(1000, root // 2) + 1)) AS a FROM root) ORDER BY a * greatest(1, (n + a - 1) // a), abs(a - greatest(1, (n + a - 1) // a)), a LIMIT 1),
keys AS ({numbers}),
r0 AS (SELECT key, x, a, b, x // b AS h, x % b AS l FROM (SELECT a, b, unnest(range(a * b)) AS x FROM radix), keys),
{", ".join(rounds)},
net AS MATERIALIZED (SELECT key, x, h * b + l AS y FROM r{permute.ROUNDS}),
walk AS (SELECT key, x, y, 0 AS i FROM net UNION ALL SELECT walk.key, walk.x, net.y, i + 1 FROM walk JOIN net ON net.key = walk.key AND net.x = walk.y, many WHERE walk.y >= n)"""


_FRAMES = "SELECT n FROM total"
_KEY = "(((1000::BIGINT * 48271 + list_position(['bond', 'angle', 'torsion'], dof_type) + 12345) % 2147483647) * 48271 + dof + 12345) % 2147483647"
for _name, _keys, _on in (("permuted_frames", "SELECT 1000::BIGINT AS key", "1000"), ("permuted_dofs", f"SELECT DISTINCT {_KEY} AS key FROM coords", _KEY)):
    ORACLES[_name] = f"WITH RECURSIVE {_COORDS}, {_permuted(_keys, _FRAMES)} SELECT dof_type, dof, frame, y AS \"to\" FROM coords JOIN walk ON walk.key = {_on} AND walk.x = frame, many WHERE y < n"
ORACLES["permuted_blocks"] = f"""WITH RECURSIVE {_COORDS}, {_permuted("SELECT 1000::BIGINT AS key", f"SELECT least({7 * NSTEPS}, n) AS n FROM total")}
SELECT DISTINCT frame, CASE WHEN frame < size * {7 * NSTEPS} THEN y * size + frame % size ELSE frame END AS "to"
FROM coords, (SELECT greatest(1, n // {7 * NSTEPS}) AS size FROM total), many LEFT JOIN walk ON walk.x = frame // size AND y < n WHERE y IS NOT NULL OR frame >= size * {7 * NSTEPS}"""
ORACLES["mist_tree"] = f"{_tree()} SELECT step, pair_type, t1, d1, t2, d2, {_R.format('mi', 'mi')} FROM tree"
ORACLES["mist_convergence"] = _mist()
ORACLES["kde_density"] = f"WITH {_DENSITY} SELECT dof, degree, {', '.join(_R.format(c, c) for c in ('density', 'gradient', 'second'))} FROM dens"
ORACLES["kde_minima_places"] = f"WITH {_minima()} SELECT dof, k, place, {_R.format('minimum', 'minimum')} FROM minima"
ORACLES["kde_states"] = f"WITH {_STATES} SELECT dof, frame, bin FROM bins"
ORACLES["kde_entropy"] = f"""WITH {_STATES}, {_steps()}, h AS (SELECT dof, k, bin, sum(CASE WHEN step <= k THEN 1 ELSE 0 END) / ((k + 1) * any_value(size))::DOUBLE AS p FROM b, ks GROUP BY dof, k, bin)
SELECT dof, k AS step, {_R.format('sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0e0 END)', 's')} FROM h GROUP BY dof, k"""
