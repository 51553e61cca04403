"""Small fixtures: edges of extents and cuts, estimators against plain loops, files, settings and whole runs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from infotraj.operators import discretize, estimators, histogram, ntuple, permute, prefix, score, small, tiles
from infotraj.plans import config
from infotraj.plans.run import Run
from infotraj.sources import selection
from infotraj.sources.trajectory import from_wide

TAU = 2 * math.pi


def coords(spark, kind, columns):
    return spark.createDataFrame([(kind, d, f, float(x)) for d, xs in enumerate(columns) for f, x in enumerate(xs)], "dof_type string, dof int, frame long, x double")


def test_a_constant_coordinate_is_widened_and_the_top_edge_is_in_the_last_bin(spark):
    c = coords(spark, "bond", [[1.5] * 4, [0.0, 1.0, 2.0, 3.0]])
    ext = discretize.linear_extents(c).orderBy("dof").collect()
    assert math.isclose(ext[0]["max"] - ext[0]["min"], 0.05 + 1e-8, rel_tol=1e-6) and ext[1]["min"] == 0.0
    got = discretize.bins(c, discretize.linear_extents(c), [3]).where("dof = 1").orderBy("frame").collect()
    assert [r["bin"] for r in got] == [0, 0, 1, 2]


def test_a_circle_is_cut_in_its_longest_gap_the_earliest_of_equal_ones(spark):
    full = [(i + 0.5) * TAU / 90 for i in range(90)]
    two_gaps = [x for i, x in enumerate(full) if i % 45 >= 10]
    seam = [0.01, 0.05, TAU - 0.01]
    cut = {r["dof"]: r["cut"] for r in discretize.torsion_cuts(coords(spark, "torsion", [full, two_gaps, seam, full + full[:7] + full[8:]])).collect()}
    assert cut == {0: 0, 1: 0, 2: 1, 3: 7}


def test_split_torsion_is_narrow_after_its_turn(spark):
    c = coords(spark, "torsion", [[0.1, 0.2, TAU - 0.1, TAU - 0.2]])
    for ext in (discretize.torsion_extents(c), discretize.torsion_extents_optimized(c)):
        r = ext.first()
        assert r["max"] - r["min"] < 0.5 and r["phase"] != 0


def loops(counts, mids, w, kind, nb):
    jac = [{"bond": m * m, "angle": math.sin(m), "torsion": 1.0}[kind] for m in mids]
    n = sum(counts)
    p = [c / n for c in counts]

    def plain(q):
        return -sum(x * math.log(x / (w * j)) for x, j in zip(q, jac, strict=True) if x > 0)

    f1 = counts.count(1)
    cs = [(1 - f1 / n) * x for x in p]
    lam = (1 - sum(x * x for x in p)) / ((n - 1) * sum((1 / nb - x) ** 2 for x in p))
    return {"ML": plain(p), "MM": plain(p) + (sum(c > 0 for c in counts) - 1) / (2 * n),
            "CS": -sum(x * math.log(x / (w * j)) / (1 - (1 - x) ** n) for x, j in zip(cs, jac, strict=True) if x > 0), "JS": plain([lam / nb + (1 - lam) * x for x in p])}


@pytest.mark.parametrize("kind", ["bond", "angle", "torsion"])
def test_estimators_equal_plain_loops(spark, kind):
    rng = random.Random(kind)
    xs = [0.5 + rng.random() ** 3 for _ in range(60)]
    c = coords(spark, kind, [xs])
    ext = discretize.extents(c, optimize=False)
    e, steps = ext.first(), histogram.Steps(60, 1)
    h = histogram.hist1d(discretize.bins(c, ext, [12]), steps)
    counts = [0] * 12
    for r in h.collect():
        counts[r["bin"]] = r["cnt"]
    w = (e["max"] - e["min"]) / 12
    wanted = loops(counts, [e["min"] + (i + 0.5) * w for i in range(12)], w, kind, 12)
    for r in estimators.entropy1d(h, estimators.geometry(ext, [12]), steps.size).collect():
        assert math.isclose(r["s"], wanted[r["estimator"]], abs_tol=1e-9), r


def test_undefined_estimates_have_defined_values(spark):
    c = coords(spark, "bond", [[1.0, 2.0, 3.0, 4.0]])
    ext = discretize.extents(c)
    h = histogram.hist1d(discretize.bins(c, ext, [4]), histogram.Steps(4, 1))
    s = {r["estimator"]: r["s"] for r in estimators.entropy1d(h, estimators.geometry(ext, [4], False), 4, jacobian=False).collect()}
    w = (3 + 1e-8) / 4
    assert s["CS"] == 0.0 and math.isclose(s["JS"], math.log(4 * w)) and math.isclose(s["ML"], math.log(4 * w))


def test_frames_beyond_a_multiple_of_the_step_are_left_out(spark):
    df = histogram.Steps(23, 4, start=2, stride=2).assign(spark.range(23).withColumnRenamed("id", "frame"))
    assert [(r["frame"], r["step"]) for r in df.orderBy("frame").collect()] == [(2, 0), (4, 0), (6, 1), (8, 1), (10, 2), (12, 2), (14, 3), (16, 3)]


def test_forests_of_parts_meet_in_the_tree_of_all(spark):
    rng = random.Random(7)
    edges = [("BB", "bond", i, "bond", j, rng.choice([0.0, -1.0, 0.5, 0.25, 2.0])) for i in range(9) for j in range(i + 1, 9) if (i < 6) == (j < 6)]
    df = spark.createDataFrame([("ML", 0, 0, *e) for e in edges], "estimator string, scheme int, step int, pair_type string, t1 string, d1 int, t2 string, d2 int, mi double")
    parent, wanted = list(range(9)), []
    for e in sorted(edges, key=lambda e: (-e[5], e[2], e[4])):
        a, b = parent[e[2]], parent[e[4]]
        if a != b:
            parent = [b if x == a else x for x in parent]
            wanted.append((e[2], e[4]))
    for parts in (None, 1, 5, 40):
        assert sorted((r["d1"], r["d2"]) for r in score.spanning_tree(df, parts).collect()) == sorted(wanted)
    assert len(wanted) == 7  # two components


def test_permutations_are_whole_and_repeat(spark):
    c = coords(spark, "bond", [range(300), range(300)])
    for per_dof in (False, True):
        got = {(r["dof"], r["frame"]): r["x"] for r in discretize.shuffled_frames(c, 5, per_dof).collect()}
        again = {(r["dof"], r["frame"]): r["x"] for r in discretize.shuffled_frames(c.repartition(7), 5, per_dof).collect()}
        assert got == again and {k[1] for k in got} == set(range(300)) and sorted(got.values()) == sorted([*range(300)] * 2)
        assert all(got[0, f] == got[1, f] for f in range(300)) != per_dof


def test_selection_files(spark, tmp_path):
    (tmp_path / "s").write_text("# a comment;\nbond 5 3 0 2\n 4;\nangle 9 0;\nbond 5 1 1;torsion 3 1 2;")
    (tmp_path / "n").write_text("bond 0 2 2 4;\nbond 0 1 3;\nbdcross 2 1 2;# x 1 1 1;")
    s = selection.read_subset(spark, str(tmp_path / "s"))
    n = selection.read_neighbors(spark, str(tmp_path / "n"))
    assert sorted(map(tuple, s.collect())) == [("bond", 0), ("bond", 2), ("bond", 4), ("torsion", 2)]
    assert sorted(map(tuple, selection.within(n, s).collect())) == [("BB", "bond", 0, "bond", 2), ("BB", "bond", 0, "bond", 4), ("BD", "bond", 2, "torsion", 2)]


def test_both_forms_of_pair_counts_agree_with_missing_values(spark):
    rng = random.Random(3)
    rows = [(f, [rng.random() for _ in range(3)], [None if f % 5 == 0 else rng.random(), rng.random() * 6]) for f in range(50)]
    t = from_wide(spark.createDataFrame(rows, "frame long, bond array<double>, torsion array<double>"))
    ext = discretize.extents(t.coords)
    b, pairs = discretize.bins(t.coords, ext, [4, 6]), selection.all_pairs(ext.select("dof_type", "dof"))
    a, c = (sorted(map(tuple, histogram.hist2d(b, pairs, histogram.Steps(t.n_frames, 3), form).collect())) for form in ("join", "arrow"))
    assert a == c and len(a) > 100


INI = """[control]
outfilepath = {out}
nsteps = 2
[discretization]
pdfmethod = {method}
[histogram]
nbins = 4 6
writefreq = true
writeset = BB2D
writestepstart = 1
[vonmiseskde]
nmaxconf = 3
[entropy]
workset = 2D
scoringmethod = MIST
estimator = ML MM
"""


@pytest.mark.parametrize("method", ["histogram", "vonmiseskde"])
def test_a_whole_run_and_its_reports(spark, tmp_path, method):
    rng = random.Random(1)
    rows = [(f, [1 + rng.random() for _ in range(3)], [1 + rng.random() for _ in range(2)], [rng.random() * 6 for _ in range(3)]) for f in range(41)]
    t = from_wide(spark.createDataFrame(rows, "frame long, bond array<double>, angle array<double>, torsion array<double>"))
    c = config.parse(INI.format(out=tmp_path / "out", method=method))
    Run(spark, c, t)()
    nb = 3 if method == "vonmiseskde" else 6
    lines = [r[0] for r in spark.read.text(str(tmp_path / f"out/MIST-MM_convergence_b-{nb}.csv")).collect()]
    assert len(lines) == 3 and len(lines[0].split(",")) == 18 and [x.split(",")[0].strip() for x in sorted(lines)[:2]] == ["20", "40"]
    tree = spark.read.text(str(tmp_path / f"out/Tree-MIST-ML_b-{nb}_s-1.csv")).count()
    assert tree == (3 if method == "vonmiseskde" else 8)
    if method == "histogram":
        kept = spark.read.parquet(str(tmp_path / "out/hist2d"))
        assert kept.select("step").distinct().collect()[0][0] == 1 and kept.where("pair_type <> 'BB'").count() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        Run(spark, c, t)()


def test_settings_that_are_unknown_are_refused():
    for text in ("[entropy]\nestimator = XX", "[entropy]\nworkset = 9D", "[discretization]\npdfmethod = other"):
        with pytest.raises(ValueError):
            config.parse(text)
    assert config.parse("[histogram]\nnbins = 10, 20").nbins == [10, 20]
    assert config.Config().parts(["BB2D"]) == (["bond"], ["BB"])


def test_empty_tables(spark):
    t = from_wide(spark.createDataFrame([], "frame long, bond array<double>"))
    assert t.n_frames == 0
    ext = discretize.extents(t.coords)
    assert ext.count() == 0 and discretize.bins(t.coords, ext, [4]).count() == 0
    assert t.coords.where(F.col("x") > 0).count() == 0


def small_frames(spark, n=50, dofs=(3, 2), seed=3):
    rng = random.Random(seed)
    rows = [(f, [rng.random() for _ in range(dofs[0])], [None if f % 5 == 0 else rng.random(), *[rng.random() * 6 for _ in range(dofs[1] - 1)]]) for f in range(n)]
    return from_wide(spark.createDataFrame(rows, "frame long, bond array<double>, torsion array<double>").repartition(3))


def listed(df):
    return sorted(map(tuple, df.collect()))


def test_tiles_count_what_the_join_counts(spark, monkeypatch):
    t = small_frames(spark, 50, (70, 66))  # two blocks of each type
    ext = discretize.extents(t.coords)
    steps = histogram.Steps(t.n_frames, 3, 1, 2)
    b = discretize.bins(t.coords, ext, [4, 6])
    pairs = selection.all_pairs(ext.select("dof_type", "dof")).where("(d1 + d2) % 9 = 0").persist()
    wanted = listed(histogram.hist2d(b, pairs, steps, "join"))
    assert len(wanted) > 10_000 and wanted == listed(histogram.hist2d(b, pairs, steps, "arrow"))
    forms = [tiles.pack(t.wide, ext, [4, 6]), tiles.pack_long(b)]
    assert all(listed(tiles.hist2d_tiles(f, pairs, steps)) == wanted for f in forms)
    assert listed(tiles.hist1d_tiles(forms[0], steps)) == listed(tiles.hist1d_tiles(forms[1], steps)) == listed(histogram.hist1d(b, steps).select(*tiles.hist1d_tiles(forms[0], steps).columns))
    monkeypatch.setattr(histogram, "MAX_BROADCAST_ROWS", 10)
    assert listed(histogram.hist2d(b, pairs, steps)) == wanted


def test_tiles_of_many_cells_frames_and_parts(spark, monkeypatch):
    t = small_frames(spark, 60, (3, 2))
    ext = discretize.extents(t.coords)
    b, steps = discretize.bins(t.coords, ext, [255]), histogram.Steps(60, 7)
    pairs = selection.all_pairs(ext.select("dof_type", "dof"))
    wanted = listed(histogram.hist2d(b, pairs, steps, "join"))
    monkeypatch.setattr(tiles, "GROUP", 20)  # tiles of 20 frames are parts of their own
    wide = t.wide.where("frame >= 0").repartitionByRange(3, "frame")
    assert listed(tiles.hist2d_tiles(tiles.pack(wide, ext, [255]), pairs, steps)) == wanted
    none = pairs.where("d1 > 100")
    assert tiles.hist2d_tiles(tiles.pack(wide, ext, [4]), none, steps).count() == 0


def test_plans_of_tiles_shuffle_neither_frames_nor_pairs(spark):
    t = small_frames(spark)
    ext = discretize.extents(t.coords)
    pairs = selection.all_pairs(ext.select("dof_type", "dof"))
    plan = tiles.hist2d_tiles(tiles.pack(t.wide, ext, [4]), pairs, histogram.Steps(50, 2))._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert shuffles and not any("frame#" in line for line in shuffles)


def test_many_steps_are_summed_along_the_row(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(255), rng.randrange(1, 9)) for k in range(3) for _ in range(200)]
    got = {(r["k"], r["step"]): r["cnt"] for r in histogram.cumulative(spark.createDataFrame(rows, "k int, step int, cnt long"), ["k"], 255).collect()}
    assert got == {(k, s): sum(c for a, b, c in rows if a == k and b <= s) for k in range(3) for s in range(255)}


def test_a_held_table_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    for most, local in ((10_000, True), (1_000, False)):
        before = seen.value
        df = small.held(spark.range(6_000).repartition(4).mapInPandas(count, "id long"), most)
        assert small.is_local(df) == local
        assert df.count() == 6_000 and df.agg(F.sum("id")).first()[0] == 5_999 * 3_000
        assert seen.value - before == 6_000
        small.release(df)
        assert not df.is_cached


@pytest.mark.parametrize("n", [1, 2, 3, 5, 97, 500, 1999])
def test_keyed_permutations_are_bijections(spark, n):
    df = spark.range(-1, n + 1).select(F.col("id").alias("frame"), F.lit("bond").alias("dof_type"), F.lit(3).alias("dof"))
    got = {r.frame: r.to for r in permute.shuffled_frames(df, n, 77).collect()}
    assert sorted(got) == sorted(got.values()) == list(range(-1, n + 1)) and got[-1] == -1 and got[n] == n
    assert [got[x] for x in range(n)] == [permute.plain_permutation(x, n, 77) for x in range(n)]
    if n > 90:
        own = {r.frame: r.to for r in permute.shuffled_frames(df, n, 77, per_dof=True).collect()}
        assert own != got and sorted(own.values()) == sorted(got.values())
        assert sum(abs(got[x] - got[x + 1]) == 1 for x in range(n - 1)) < n / 10  # neighbours part


def test_blocks_change_places_whole(spark):
    got = [r.to for r in permute.shuffled_blocks(spark.range(23).withColumnRenamed("id", "frame"), 23, 5, 3).orderBy("frame").collect()]
    assert sorted(got) == list(range(23)) and got[20:] == [20, 21, 22]
    assert all(got[k + 1] - got[k] == 1 for k in range(20) if k % 4 < 3)
    plan = permute.shuffled_frames(spark.range(9).withColumnRenamed("id", "frame"), 9, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and permute.radices(10**12)[0] == 10**6


def test_records_are_parted_across_tasks_and_the_first_of_a_key_counts(spark, tmp_path):
    rng = random.Random(2)
    lines = [f"bond {i % 400} 2 {i} {i + 1 + rng.randrange(9)}" for i in range(3000)]
    (tmp_path / "n").write_text(";\n".join(lines) + ";\n# bond 5 1 1;\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = selection.read_neighbors(spark, str(tmp_path / "n"))
        assert spark.read.option("lineSep", ";").text(str(tmp_path / "n")).rdd.getNumPartitions() > 8
        first = {int(x.split()[1]): x.split()[3:] for x in reversed(lines)}
        assert sorted((r.d1, r.d2) for r in got.collect()) == sorted({(k, int(v)) for k, vs in first.items() for v in vs})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_running_counts_answer_any_steps_on_blocks(spark, tmp_path):
    t = small_frames(spark, 60, (2, 2))
    ext = discretize.extents(t.coords)
    bins = discretize.bins(t.coords, ext, [4, 6])
    kept = prefix.count(t.coords.where("frame < 40"), 40, ext, [4, 6], str(tmp_path / "r"), 5)
    held = kept.counts.count()
    later = t.coords.where("frame >= 40").withColumn("frame", F.col("frame") - 40)
    kept.append(later, 20, [4, 6])
    assert kept.n_frames == 60 and kept.counts.where("block < 8").count() == held  # what was counted is not touched
    for steps in (histogram.Steps(60, 3), histogram.Steps(60, 12), histogram.Steps(60, 2, 10), histogram.Steps(45, 3, 15), histogram.Steps(60, 1, 20)):
        got = kept.hist1d(steps)
        assert listed(got) == listed(histogram.hist1d(bins, steps).select(*got.columns)), steps
    for steps in (histogram.Steps(60, 3, 1), histogram.Steps(60, 3, 0, 2), histogram.Steps(60, 8), histogram.Steps(80, 4)):
        with pytest.raises(ValueError):
            kept.hist1d(steps)
    with pytest.raises(ValueError, match="moved.*bond 0"):
        kept.append(spark.createDataFrame([("bond", 0, f, 9.0) for f in range(5)], "dof_type string, dof int, frame long, x double"), 5, [4, 6])
    with pytest.raises(ValueError, match="whole blocks"):
        kept.append(later.where("frame < 3"), 3, [4, 6])
    assert kept.n_frames == 60


def test_tuples_of_any_length_are_counted_sparsely(spark):
    t = small_frames(spark, 45, (3, 2))
    ext = discretize.extents(t.coords)
    steps, b = histogram.Steps(45, 4), discretize.bins(t.coords, ext, [3, 7])
    listed_tuples = [[("torsion", 0), ("bond", 2)], [("bond", 0)], [("bond", 0), ("bond", 1), ("torsion", 1)], [("bond", 0), ("bond", 1)], [("bond", 0), ("bond", 1), ("torsion", 0), ("bond", 2), ("torsion", 1)], [("bond", 0), ("bond", 1)]]
    place = {(r.dof_type, r.dof, r.scheme, r.frame): r.bin for r in b.collect()}
    wanted: dict = {}
    for i, own in enumerate(listed_tuples):
        for k, n in enumerate((3, 7)):
            for f in range(44):
                bins = [place.get((*c, k, f)) for c in own]
                if None not in bins:
                    cell = sum(x * n ** (len(bins) - 1 - j) for j, x in enumerate(bins))
                    for s in range(f // 11, 4):
                        wanted[i, k, cell, s] = wanted.get((i, k, cell, s), 0) + 1
    hist = ntuple.histnd(t.wide, ext, [3, 7], listed_tuples, steps)
    assert {(r.tuple, r.scheme, r.cell, r.step): r.cnt for r in hist.collect() if r.cnt} == wanted
    s = {(r.tuple, r.scheme, r.step): r.s for r in ntuple.entropynd(hist, estimators.geometry(ext, [3, 7]), listed_tuples, steps.size).collect()}
    one = {(r.scheme, r.step): r.s for r in estimators.entropy1d(histogram.hist1d(b, steps), estimators.geometry(ext, [3, 7]), steps.size, ["ML"]).where("dof_type = 'bond' and dof = 0").collect()}
    assert all(math.isclose(s[1, k, step], v, abs_tol=1e-9) for (k, step), v in one.items()) and math.isclose(s[3, 0, 3], s[5, 0, 3], abs_tol=1e-12)
    with pytest.raises(ValueError, match="not there"):
        ntuple.histnd(t.wide, ext, [3], [[("bond", 9)]], steps)
    with pytest.raises(ValueError, match="64 bits"):
        ntuple.histnd(t.wide, ext, [255], [[("bond", 0)] * 8], steps)
