"""Layout of reports, settings, files of trajectories, and the kernel density against plain numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from infotraj.functions import vonmises
from infotraj.operators import discretize, kde
from infotraj.plans import config, progress, reports
from infotraj.plans.run import Run
from infotraj.sources import trajectory

COLUMNS = ["TIME", "BOND_S1", "ANGLE_S1", "DIHED_S1", *[f"{p}_{x}" for p in ("BB", "AA", "DD", "BA", "BD", "AD") for x in ("S2", "I2")], "S1", "S2"]
#: Lines of known reports.
CONVERGENCE = [
    "TIME         , BOND-S1      , ANGLE-S1     , DIHED-S1     , B/B-S2       , B/B-I2       , A/A-S2       , A/A-I2       , D/D-S2       , D/D-I2       , B/A-S2       , B/A-I2       , B/D-S2       , B/D-I2       , A/D-S2       , A/D-I2       , S1           , S2           ",
    "2500         , -36.3163     , -41.0386     , -11.2629     , -691.3338    , 22.5054      , -829.7166    , 25.2737      , -364.6472    , 56.4102      , -1615.9167   , 47.9276      , -1289.2907   , 66.4615      , -1453.5212   , 65.9129      , -88.6178     , -373.1091    ",
    "5000         , -36.2418     , -40.9708     , -11.1525     , -680.0015    , 12.5604      , -818.6064    , 15.7917      , -343.0419    , 37.5572      , -1591.6545   , 27.0056      , -1255.6867   , 37.0682      , -1420.5238   , 37.2465      , -88.3651     , -255.5948    ",
]
TREE = ["TD1, TD2, IndexDim1, IndexDim2, MI", "T  , T  , 5        , 8        , 2.135213", "T  , T  , 4        , 7        , 0.798550", "T  , T  , 1        , 11       , 0.692798"]
MINIMA = ["torsion      0 1 0.00872665;", "torsion      2 1 6.27445866;", "torsion      3 1 3.13286601;"]


def test_reports_have_the_known_layout():
    values = [[float(x) for x in line.split(",")] for line in CONVERGENCE[1:]]
    rows = [dict(zip(COLUMNS, [int(v[0]), *v[1:]], strict=True)) for v in values]
    assert reports.convergence_lines(COLUMNS, rows) == CONVERGENCE
    for r in rows:  # what the engine's own reports hold too: the expansion's sums
        assert math.isclose(r["S1"], r["BOND_S1"] + r["ANGLE_S1"] + r["DIHED_S1"], abs_tol=2e-4)
        assert math.isclose(r["S2"], r["S1"] - sum(r[c] for c in COLUMNS if c.endswith("_I2")), abs_tol=5e-4)
    name = {"B": "bond", "A": "angle", "T": "torsion"}
    cells = [[c.strip() for c in line.split(",")] for line in TREE[1:]]
    assert reports.tree_lines([{"t1": name[a], "t2": name[b], "d1": int(i), "d2": int(j), "mi": float(m)} for a, b, i, j, m in cells]) == TREE
    words = [line.rstrip(";").split() for line in MINIMA]
    assert reports.minima_lines([{"dof": int(w[1]), "k": int(w[2]), "minima": [float(x) for x in w[3:]]} for w in words]) == MINIMA


def frames(spark, n):
    rng = np.random.default_rng(2)
    rows = [(f, (1 + rng.random(2)).tolist(), (1 + rng.random(2)).tolist(), (rng.random(2) * 6).tolist()) for f in range(n)]
    return spark.createDataFrame(rows, "frame long, bond array<double>, angle array<double>, torsion array<double>")


def test_counts_of_frames_and_coordinates_are_honoured(spark, tmp_path):
    t = trajectory.from_wide(frames(spark, 60))
    text = "[control]\noutfilepath = {out}\nnsteps = 2\ninfofile = p.info\n[discretization]\nnframe = 50\nnbond = {n}\nshuffleframes = true\n[histogram]\nnbins = 4\nwritefreq = true\nwriteset = A1D\nwritestepstart = 1\n[entropy]\nworkset = 1D\nestimator = ML\nnframe = 41\nstartframe = 1\nstrideframe = 2\n"
    with pytest.raises(ValueError, match="bond"):
        Run(spark, config.parse(text.format(out=tmp_path / "no", n=3)), t)
    run = Run(spark, config.parse(text.format(out=tmp_path / "out", n=2)), t)
    run()
    assert run.trajectory.n_frames == 50 and run.steps().size == 10
    hist = spark.read.parquet(f"{tmp_path}/out/hist1d")
    assert {tuple(r) for r in hist.select("dof_type", "step").distinct().collect()} == {("angle", 1)}
    assert hist.groupBy("dof").agg(F.sum("cnt").alias("n")).select("n").distinct().collect()[0][0] == 20
    assert spark.read.parquet(f"{tmp_path}/out/bins").agg(F.max("frame")).first()[0] == 49
    to = spark.read.parquet(f"{tmp_path}/out/shuffled").collect()
    assert sorted(r["to"] for r in to) == sorted(r["frame"] for r in to) == list(range(50))
    assert [r[0].split()[0] for r in spark.read.text(f"{tmp_path}/out/p.info").collect()] == ["discretise", "entropies", "reports"]
    assert [trajectory.kind_of(spark, f"{tmp_path}/out/{x}") for x in ("bins", "hist1d", "entropy1d", "extents")] == ["bins", "hist1d", "entropy1d", "unknown"]


def test_unknown_settings_are_refused_and_known_ones_without_effect_are_not():
    for text in ("[entropy]\nnframes = 3", "[other]\nnbins = 3", "[histogram]\nkappa = 1", "[entropy]\nnframe = -1"):
        with pytest.raises(ValueError):
            config.parse(text)
    c = config.parse("[control]\ncachedscrtdimspercpu = 1\nentcinfofreq = 40\n[discretization]\nnframe = 10, 20\n[entropy]\nnframe = 25\nshuffleblocks = true")
    assert c.inputframes == [10, 20] and c.nframe == 25


def test_trajectories_are_written_and_appended_to(spark, tmp_path):
    path = str(tmp_path / "t")
    trajectory.write_wide(frames(spark, 5), path)
    trajectory.write_wide(frames(spark, 3), path, append=True)
    t = trajectory.read_wide(spark, path)
    assert t.n_frames == 8 and t.block("angle", 1, 1, 5).count() == 3 and trajectory.kind_of(spark, path) == "trajectory"
    assert t.block("bond", 0, 2, 2, 3).select("frame").distinct().count() == 3
    with pytest.raises(ValueError):
        trajectory.write_wide(spark.range(2).withColumnRenamed("id", "frame"), path)


def bessel(n, x):
    """The power series."""
    return sum((x / 2) ** (2 * k + n) / (math.factorial(k) * math.factorial(k + n)) for k in range(80))


def test_densities_are_sums_of_kernels(spark):
    rng = np.random.default_rng(3)
    angles = np.concatenate([rng.normal(1.0, 0.2, 60), rng.normal(4.0, 0.3, 40)]) % (2 * math.pi)
    nu = (3 * 100 * bessel(2, 2.0) / (4 * math.sqrt(math.pi) * bessel(0, 1.0) ** 2)) ** 0.4
    assert math.isclose(vonmises.smoothing(100, 1.0), nu, rel_tol=1e-9)
    c = spark.createDataFrame([("torsion", 0, f, float(x)) for f, x in enumerate(angles)], "dof_type string, dof int, frame long, x double")
    got = {r["degree"]: r for r in kde.density(c, 100).collect()}

    def density(x):
        return sum(math.exp(nu * math.cos(x - a)) for a in angles) / (100 * 2 * math.pi * bessel(0, nu))

    for degree in (0, 17, 57, 120, 229, 360):
        x, h = math.radians(degree), 1e-4
        assert math.isclose(got[degree]["density"], density(x), rel_tol=1e-8)
        assert math.isclose(got[degree]["gradient"], (density(x + h) - density(x - h)) / (2 * h), rel_tol=1e-4, abs_tol=1e-6)
        assert math.isclose(got[degree]["second"], (density(x + h) - 2 * density(x) + density(x - h)) / (h * h), rel_tol=1e-3, abs_tol=1e-4)
    assert abs(sum(got[d]["density"] for d in range(360)) * math.radians(1) - 1) < 1e-6
    found = kde.torsion_minima(kde.density(c, 100), 3).first()
    grid = np.array([density(x) for x in np.arange(0, 2 * math.pi, 0.002)])
    lows = [0.002 * i for i in range(len(grid)) if grid[i] <= grid[i - 1] and grid[i] < grid[(i + 1) % len(grid)]]
    assert found["k"] == len(lows) == 2
    for m in found["minima"]:  # where the density is flat enough, downhill steps end before the bottom
        assert min(abs(density(m) - density(x)) for x in lows) < 1e-3
    states = {r["frame"]: r["bin"] for r in kde.states(c, kde.torsion_minima(kde.density(c, 100), 3), 3).collect()}
    low, high = found["minima"]
    assert all(states[f] == (1 if low < x < high else 0) for f, x in enumerate(angles))


def test_tree_order_and_maxima(spark):
    second = np.zeros(361)
    gradient = np.ones(361)
    for top, sharp in ((30, -1.0), (150, -3.0), (260, -2.0)):
        gradient[top + 1 : top + 40] = -1.0
        second[top : top + 2] = sharp
    two = vonmises.minima(gradient, second, 2, 5.0, 200, 1e-4)
    assert len(two) == 2 and len(vonmises.minima(gradient, second, 3, 5.0, 200, 1e-4)) == 3
    assert discretize.TWO_PI > max(two) > math.radians(150) > 0


def test_moments_leave_a_few_rows_a_torsion_and_skip_missing_angles(spark):
    rng = np.random.default_rng(8)
    x = rng.random((5, 40)) * 2 * math.pi
    rows = [("torsion", d, f, float(v)) for d, xs in enumerate(x) for f, v in enumerate(xs) if (d, f) != (1, 7)] + [("bond", 0, 0, 1.0)]
    c = spark.createDataFrame(rows, "dof_type string, dof int, frame long, x double")
    nu = vonmises.smoothing(40, 1.0)
    w = vonmises.weights(nu)
    for k in (0, 1, 5, len(w) - 1):
        assert math.isclose(w[k], vonmises.scaled_bessel(k, nu) / vonmises.scaled_bessel(0, nu), rel_tol=1e-3, abs_tol=1e-15)
    assert kde.moments(c, len(w)).count() == 5 * len(w)
    got = {(r["dof"], r["degree"]): (r["density"], r["gradient"], r["second"]) for r in kde.density(c, 40).collect()}
    assert len(got) == 5 * 361
    scale = 2 * math.pi * 40 * vonmises.scaled_bessel(0, nu)
    for d, degree in ((0, 0), (1, 90), (4, 271)):
        e = [(math.cos(math.radians(degree) - v), math.sin(math.radians(degree) - v)) for _, dd, _, v in rows[:-1] if dd == d]
        k = [math.exp(nu * (a - 1)) for a, _ in e]
        wanted = sum(k) / scale, -nu * sum(q * b for q, (_, b) in zip(k, e, strict=True)) / scale, nu * sum((nu * b * b - a) * q for q, (a, b) in zip(k, e, strict=True)) / scale
        assert np.allclose(got[d, degree], wanted, rtol=1e-10, atol=1e-12)
    plan = kde.moments(c, len(w))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_progress_counts_rise_while_a_run_goes_on(spark, tmp_path):
    import threading
    import time

    def slow(batches):
        for b in batches:
            time.sleep(0.3)
            yield b

    path, seen = str(tmp_path / "p.info"), []
    p = progress.Progress(spark, path, ["one", "two"], interval=0.1)
    assert [x.split()[1] for x in (tmp_path / "p.info").read_text().splitlines()] == ["Waiting", "Waiting"]
    over = threading.Event()

    def look():
        while not over.wait(0.05):
            lines = (tmp_path / "p.info").read_text().splitlines()
            if len(lines) == 2 and "Running" in lines[0]:
                seen.append(int(lines[0].split()[-5]))

    watcher = threading.Thread(target=look)
    watcher.start()
    with p.stage("one"):
        spark.range(40).repartition(40).mapInPandas(slow, "id long").write.format("noop").mode("overwrite").save()
    over.set()
    watcher.join()
    assert len({*seen}) > 3 and seen == sorted(seen) and max(seen) < p.counts["one"][1]
    with pytest.raises(ZeroDivisionError), p.stage("two"):
        1 / 0
    lines = [x.split() for x in (tmp_path / "p.info").read_text().splitlines()]
    assert [x[1] for x in lines] == ["Completed", "Failed"] and lines[0][-5] == lines[0][-4] == str(p.counts["one"][1]) and p.counts["one"][1] >= 48
    with pytest.raises(Exception, match="(?i)exist"):
        progress.Progress(spark, path, ["one"])
