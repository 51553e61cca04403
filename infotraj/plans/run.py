"""The three stages of a run: discretise, entropies, reports. Each reads what the one before wrote, so each can run alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from infotraj.operators import discretize, estimators, kde, permute, score, tiles
from infotraj.operators.histogram import Steps, step_window
from infotraj.operators.small import held, if_small, is_local, release
from infotraj.plans import reports
from infotraj.plans.config import Config
from infotraj.plans.progress import Progress
from infotraj.sources import selection
from infotraj.sources.blocks import read_blocks
from infotraj.sources.trajectory import Trajectory, kind_of, read_wide


class Run:
    """A run's tables lie in the config's outfilepath: bins, tiles (the same, packed), extents, minima, hist1d, hist2d, entropy1d, entropy2d and reports.

    The trajectory is read from the tables of frames that the config names, or from one store by coordinate.
    Histograms are counted from tiles, so that no row for a frame is shuffled.

    Histograms are written if writefreq is set, of the coordinates and pairs of writeset and the steps of the window.
    Shuffled frames leave their permutation as a table shuffled. Reports and the progress file, which is written while the run goes on, are single text files.
    Tables that exist are not overwritten unless overwrite is set.
    """

    def __init__(self, spark: SparkSession, config: Config, trajectory: Trajectory | None = None, overwrite: bool = False):
        self.spark, self.config, self.mode = spark, config, "overwrite" if overwrite else "errorifexists"
        if trajectory is None and config.discretize:
            paths = [f"{config.infilepath}/{n}" if config.infilepath else n for n in config.fname]
            stored = len(paths) == 1 and kind_of(spark, paths[0]) == "blocks"
            trajectory = read_blocks(spark, paths[0]) if stored else read_wide(spark, paths)
        if trajectory is not None:
            trajectory = trajectory.limited(sum(config.inputframes)) if config.inputframes else trajectory
            trajectory.expect({"bond": config.nbond, "angle": config.nangle, "torsion": config.ndihed})
        self.trajectory = trajectory

    def path(self, name: str) -> str:
        return f"{self.config.outfilepath}/{name}"

    def _write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        df.write.mode(self.mode).partitionBy(*by).parquet(self.path(name))
        return self._read(name)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @property
    def schemes(self) -> list[int]:
        return [self.config.nmaxconf] if self.config.kde else self.config.nbins

    def discretise(self) -> None:
        c, t = self.config, self.trajectory
        coords = t.coords.where(F.col("dof_type").isin(c.parts(c.workset)[0]))
        if c.kde:
            found = self._write(kde.torsion_minima(kde.density(coords, t.n_frames, c.kappa), c.nmaxconf, c.sdosteps, c.sdoiterations, c.sdoconvlimit), "minima")
            out = kde.states(coords, found, c.nmaxconf)
            ext = found.select(F.lit("torsion").alias("dof_type"), "dof", *[F.lit(None).cast("double").alias(x) for x in ("min", "max", "avg", "phase")])
        else:
            ext = discretize.extents(coords, c.optimizedih, c.referencenbins)
            out = discretize.bins(coords, ext, c.nbins)
        if c.shuffleframes or c.shuffledofs:
            moved = permute.shuffled_frames(out, t.n_frames, c.randseed + 1000, c.shuffledofs)
            frames = self.spark.range(t.n_frames).select(F.col("id").alias("frame"))
            self._write(moved.where("scheme = 0").select("dof_type", "dof", "frame", "to") if c.shuffledofs else permute.shuffled_frames(frames, t.n_frames, c.randseed + 1000), "shuffled")
            out = moved.withColumn("frame", F.col("to")).drop("to")
        self._write(ext, "extents")
        packable = is_local(ext) and t.wide is not None and not (c.kde or c.shuffleframes or c.shuffledofs)
        out = self._write(out, "bins", "dof_type")
        self._write(tiles.pack(t.wide, ext, c.nbins) if packable else tiles.pack_long(out), "tiles")
        self._write(self.spark.createDataFrame([(t.n_frames,)], "n_frames long"), "frames")

    def steps(self) -> Steps:
        c = self.config
        every = self._read("frames").first()[0]
        return Steps(min(c.nframe or every, every), c.nsteps, c.startframe, c.strideframe)

    def _window(self, hist: DataFrame) -> DataFrame:
        return step_window(hist, min(self.config.writestepstart, self.config.nsteps - 1), self.config.writestepstride)

    def entropies(self) -> None:
        c, packed, ext, steps = self.config, self._read("tiles"), self._read("extents"), self.steps()
        types, pair_types = c.parts(c.workset)
        dofs = ext.select("dof_type", "dof").where(F.col("dof_type").isin(types))
        if c.usesubset:
            dofs = dofs.join(if_small(selection.read_subset(self.spark, c.subsetfile)), ["dof_type", "dof"], "left_semi")
        geo = estimators.geometry(ext, self.schemes, c.jacobian and not c.kde, c.kde)
        one, (write_types, write_pairs) = tiles.hist1d_tiles(packed, steps).join(if_small(dofs), ["dof_type", "dof"], "left_semi"), c.parts(c.writeset)
        if c.writefreq:
            one = self._write(one, "hist1d_all")
            self._write(self._window(one.where(F.col("dof_type").isin(write_types))), "hist1d")
        self._write(estimators.entropy1d(one, geo, steps.size, c.estimator, c.jacobian and not c.kde), "entropy1d")
        if not pair_types:
            return
        pairs = selection.read_neighbors(self.spark, c.neighborfile).where(F.col("pair_type").isin(pair_types)) if c.useneighbor else selection.all_pairs(dofs, pair_types)
        two = tiles.hist2d_tiles(packed, selection.within(pairs, dofs), steps)
        if c.writefreq:
            two = self._write(two, "hist2d_all")
            self._write(self._window(two.where(F.col("pair_type").isin(write_pairs))), "hist2d")
        self._write(estimators.entropy2d(two, geo, steps.size, c.estimator, c.jacobian and not c.kde, c.strict_math), "entropy2d")

    def report(self) -> None:
        c, size = self.config, self.steps().size
        s1, mi = self._read("entropy1d"), None
        if c.kde:
            reports.write_minima(self._read("minima"), self.path("vmkde_torsions_minimas.out"))
        if not c.parts(c.workset)[1]:
            return
        mi = self._write(score.mutual_information(s1, self._read("entropy2d")), "mi")
        kinds = [("MIE", None)]
        if c.scoringmethod in ("MIST", "AMIST"):
            kinds.append(("MIST", self._write(score.spanning_tree(mi), "tree")))
        for name, edges in kinds:
            rows = held(score.convergence(s1, mi, size, edges))
            for e in c.estimator:
                for i, n in enumerate(self.schemes):
                    mine = (F.col("estimator") == e) & (F.col("scheme") == i)
                    reports.write_convergence(rows.where(mine), self.path(f"{name}-{e}_convergence_b-{n}.{c.reportfileext}"))
                    if edges is not None:
                        for k in range(c.nsteps):
                            reports.write_tree(edges.where(mine & (F.col("step") == k)), self.path(f"Tree-MIST-{e}_b-{n}_s-{k}.{c.reportfileext}"))
            release(rows)

    def __call__(self) -> None:
        c = self.config
        stages = [(name, stage) for wanted, name, stage in ((c.discretize, "discretise", self.discretise), (c.calcentropy, "entropies", self.entropies), (c.genconvgdata, "reports", self.report)) if wanted]
        progress = Progress(self.spark, self.path(c.infofile), [name for name, _ in stages], overwrite=self.mode == "overwrite")
        for name, stage in stages:
            with progress.stage(name):
                stage()
