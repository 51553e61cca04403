"""The store by coordinate: what is written is read, and only what is asked for."""

from __future__ import annotations

import glob
import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from infotraj.plans import config
from infotraj.plans.run import Run
from infotraj.sources import blocks, trajectory

WIDE = "frame long, bond array<double>, torsion array<double>, extra string"


def table(spark, n, bonds=3, torsions=5, first=0):
    rng = np.random.default_rng(n)
    return spark.createDataFrame([(first + f, (1 + rng.random(bonds)).tolist(), (6 * rng.random(torsions)).tolist(), "x") for f in range(n)], WIDE)


def plain(wide):
    out = {}
    for r in wide.collect():
        for t in ("bond", "torsion"):
            for d, x in enumerate(r[t] or []):
                if x is not None and not math.isnan(x) and r["frame"] is not None:
                    out.setdefault((t, d, r["frame"]), []).append(x)
    return {k: sorted(v) for k, v in out.items()}


def got(long):
    out = {}
    for r in long.collect():
        out.setdefault((r.dof_type, r.dof, r.frame), []).append(r.x)
    return {k: sorted(v) for k, v in out.items()}


def test_runs_are_successive_and_cut_at_multiples():
    assert blocks._runs(np.array([2, 3, 4, 5, 9, 9, 10]), 4) == [(0, 2), (2, 4), (4, 5), (5, 7)]
    assert blocks._runs(np.array([7]), 4) == [(0, 1)]


@pytest.mark.parametrize("span", [1, 7, 4096])
def test_what_is_written_is_read_by_coordinate_frame_and_stride(spark, tmp_path, span):
    wide, path = table(spark, 100), str(tmp_path / "b")
    blocks.write_blocks(wide.repartition(3), path, span=span)
    want = plain(wide)
    assert got(blocks.scan(spark, path, span=span)) == want
    for start, end, stride in ((0, None, 3), (11, 60, 1), (11, 60, 4), (99, None, 2), (0, 1, 5), (60, 60, 1)):
        chosen = {k: v for k, v in want.items() if (k[0] == "bond" and k[1] == 1 or k[0] == "torsion" and k[1] in (2, 3)) and k[2] in range(start, 100 if end is None else end, stride)}
        assert got(blocks.scan(spark, path, {"bond": [1], "torsion": range(2, 4)}, start, end, stride, span)) == chosen
    assert blocks.scan(spark, path, {}).count() == 0 and blocks.scan(spark, path, {"angle": None}).count() == 0
    with pytest.raises(ValueError):
        blocks.scan(spark, path, start=-1)


def test_missing_values_ragged_arrays_and_repeated_frames(spark, tmp_path):
    rows = [(5, [1.0, None, 3.0], None, ""), (0, [math.nan], [2.0], ""), (5, [4.0], [], ""), (None, [9.0], [9.0], ""), (2, None, None, None), (1, [7.0, 8.0], [0.5, 0.25], "")]
    wide, path = spark.createDataFrame(rows, WIDE), str(tmp_path / "b")
    blocks.write_blocks(wide, path)
    assert got(blocks.scan(spark, path)) == plain(wide)
    blocks.write_blocks(wide.limit(0), str(tmp_path / "none"))
    t = blocks.read_blocks(spark, str(tmp_path / "none"))
    assert t.n_frames == 0 and t.coords.count() == 0
    with pytest.raises(ValueError):
        blocks.turned(spark.range(3).withColumnRenamed("id", "frame"))


def test_appended_frames_follow_on_and_leave_files_alone(spark, tmp_path):
    path = str(tmp_path / "b")
    blocks.write_blocks(table(spark, 50), path)
    before = set(glob.glob(f"{path}/*.parquet"))
    blocks.write_blocks(table(spark, 30), path, append=True)
    assert before < set(glob.glob(f"{path}/*.parquet"))
    t = blocks.read_blocks(spark, path)
    want = plain(table(spark, 50)) | {(k[0], k[1], k[2] + 50): v for k, v in plain(table(spark, 30)).items()}
    assert t.n_frames == 80 and got(t.coords) == want and trajectory.kind_of(spark, path) == "blocks"
    assert got(t.block("torsion", 1, 2, 40, 20)) == {k: v for k, v in want.items() if k[0] == "torsion" and k[1] in (1, 2) and 40 <= k[2] < 60}
    short = t.limited(60)
    assert got(short.block("bond", 0, 3, 55)) == {k: v for k, v in want.items() if k[0] == "bond" and 55 <= k[2] < 60}


def test_some_coordinates_read_some_of_the_bytes(spark, tmp_path):
    """Row groups whose statistics meet the pushed filters, by their bytes; the plan pushes those filters."""
    path, n, dofs = str(tmp_path / "b"), 2000, 512
    wide = spark.range(0, n, 1, 4).select(F.col("id").alias("frame"), F.transform(F.sequence(F.lit(0), F.lit(dofs - 1)), lambda i: F.rand(3) + i).alias("bond"))
    blocks.write_blocks(wide, path, partitions=4)
    every = some = 0
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            s = next(group.column(c).statistics for c in range(group.num_columns) if group.column(c).path_in_schema == "dof")
            every += group.total_byte_size
            some += group.total_byte_size if s.max >= 70 and s.min <= 79 else 0
    assert every >= n * dofs * 8 * 0.8
    assert some < every / 3  # 10 of 512 coordinates: the row groups of their blocks alone
    read = blocks.scan(spark, path, {"bond": range(70, 80)}, 100)
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    try:
        plan = blocks.scan(spark, path, {"bond": range(70, 80)}, 100)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(dof,70)" in plan and "LessThanOrEqual(dof,79)" in plan and "EqualTo(dof_type,bond)" in plan
    assert "Exchange" not in plan and read.count() == 10 * (n - 100)


def test_a_run_from_a_store_gives_what_a_run_from_frames_gives(spark, tmp_path):
    wide = table(spark, 40, 3, 2)
    trajectory.write_wide(wide, str(tmp_path / "frames"))
    blocks.write_blocks(wide, str(tmp_path / "store"))
    found = []
    for name in ("frames", "store"):
        text = f"""[control]\ndiscretize = true\ncalcentropy = true\ngenconvgdata = true\nnsteps = 2\ninfilepath = {tmp_path}\noutfilepath = {tmp_path}/out-{name}
[discretization]\nfname = {name}\n[histogram]\nnbins = 4\n[entropy]\nworkset = BB2D, DD2D, BD2D\nestimator = ML"""
        Run(spark, config.parse(text))()
        # means may differ in their last digit by the order of their sums
        found.append({k: sorted(map(str, spark.read.parquet(f"{tmp_path}/out-{name}/{k}").drop("avg").collect())) for k in ("extents", "entropy1d", "entropy2d")})
    assert found[0] == found[1] and len(found[0]["entropy2d"]) == 20


def test_one_shuffle_writes_a_store(spark, tmp_path):
    plan = blocks.turned(table(spark, 10))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
