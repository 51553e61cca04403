"""Stores in the classic layout: a file made by hand, round trips, parts, pushed filters and failed writers."""

from __future__ import annotations

import json
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from infotraj.operators import discretize, histogram, tiles
from infotraj.sources import classic, selection
from infotraj.sources.trajectory import from_wide


def by_hand(path, dofs, schemes, frames, coords):
    """The bytes of a store of bins, written down one after another."""
    name = lambda x: struct.pack(">q", len(x)) + x.encode() + b"\0" * (-len(x) % 4)
    none = struct.pack(">iq", 0, 0)
    dims = struct.pack(">iq", 10, 4) + b"".join(name(n) + struct.pack(">q", k) for n, k in (("dims", 0), ("extremes", 4), ("bin_scheme_count", len(schemes)), ("frames", frames)))
    about = struct.pack(">iq", 12, 3) + name("content") + struct.pack(">iq", 2, 1) + b"T\0\0\0" + name("nbinSchemes") + struct.pack(">iq", 7, 1) + bytes([len(schemes), 0, 0, 0]) + name("binSchemes") + struct.pack(">iq", 7, len(schemes)) + bytes(schemes) + b"\0" * (-len(schemes) % 4)
    slab = -(-len(schemes) * frames // 4) * 4
    head = b"CDF\x05" + struct.pack(">q", len(dofs)) + dims + about + struct.pack(">iq", 11, 3)
    variables = [("dimid", [0], 9, 4), ("extreme", [0, 1], 6, 32), ("coord", [0, 2, 3], 7, slab)]
    begin = len(head) + sum(len(name(n)) + 8 + 8 * len(d) + 12 + 20 for n, d, _, _ in variables)
    for n, d, kind, size in variables:
        head += name(n) + struct.pack(">q", len(d)) + struct.pack(f">{len(d)}q", *d) + none + struct.pack(">iqq", kind, size, begin)
        begin += size
    body = b"".join(struct.pack(">I", d) + struct.pack(">4d", 0.5, 1.5, 1.0, 0.25) + bytes(c) + b"\0" * (slab - len(c)) for d, c in zip(dofs, coords, strict=True))
    path.write_bytes(head + body)


def test_a_file_made_by_hand_is_read(spark, tmp_path):
    rng = random.Random(1)
    coords = [[rng.randrange(5) for _ in range(2 * 23)] for _ in range(3)]
    by_hand(tmp_path / "t.nc", [4, 7, 2], [5, 9], 23, coords)
    path = str(tmp_path / "t.nc")
    for start, stride in ((0, 1), (3, 4)):
        got = {(r.dof, r.scheme, r.frame): (r.nbins, r.bin, r.dof_type) for r in classic.read_bins(spark, path, start, stride).collect()}
        wanted = {(d, k, i): ((5, 9)[k], c[k * 23 + f], "torsion") for d, c in zip([4, 7, 2], coords, strict=True) for k in (0, 1) for i, f in enumerate(range(start, 23, stride))}
        assert got == wanted
    assert classic.read_bins(spark, path, 1, 2, frames=3).agg(F.max("frame")).first()[0] == 2
    raw = spark.read.format("infotraj_bins").load("file://" + path)
    assert raw.select("dof", "min", "phase").distinct().where("min = 0.5 and phase = 0.25").count() == 3
    about = json.loads(classic.described(path))
    assert about["records"] == 3 and about["variables"]["coord"] == [">u1", [2, 23]]
    (tmp_path / "no.nc").write_bytes(b"CDF\x01" + b"\0" * 100)
    (tmp_path / "cut.nc").write_bytes((tmp_path / "t.nc").read_bytes()[:150])
    for name in ("no.nc", "cut.nc"):
        with pytest.raises(ValueError):
            classic.layout_of(str(tmp_path / name))


def test_filters_on_dof_choose_records_and_parts_cover_frames_once(spark, tmp_path, monkeypatch):
    by_hand(tmp_path / "t.nc", list(range(10)), [5], 40, [[d % 5] * 40 for d in range(10)])
    reader = classic._BinsReader({"path": str(tmp_path / "t.nc"), "start": "1", "stride": "3"})
    from pyspark.sql.datasource import EqualTo, In

    left = list(reader.pushFilters([In(("dof",), (3, 8)), EqualTo(("nbins",), 5)]))
    assert len(left) == 1 and reader.partitions()[0].records == [3, 8]
    monkeypatch.setattr(classic, "PART", 12)
    parts = reader.partitions()
    assert [(p.records, p.start, p.end) for p in parts[:4]] == [([3], 0, 4), ([3], 4, 8), ([3], 8, 12), ([3], 12, 13)] and len(parts) == 8
    plan = classic.read_bins(spark, str(tmp_path / "t.nc"), dofs=[3, 8])
    assert {r.dof for r in plan.collect()} == {3, 8} and plan.count() == 80


def frames(spark, n=61, missing=False):
    rng = np.random.default_rng(5)
    rows = [(f, rng.random(70).tolist(), [None if missing and f == 3 else float(rng.random()) for _ in range(2)]) for f in range(n)]
    return from_wide(spark.createDataFrame(rows, "frame long, bond array<double>, torsion array<double>").repartition(5))


def test_bins_that_are_written_are_read(spark, tmp_path):
    t = frames(spark)
    ext = discretize.extents(t.coords)
    wanted = sorted(map(tuple, discretize.bins(t.coords, ext, [4, 7]).where("dof_type = 'bond'").collect()))
    for k, packed in enumerate((tiles.pack(t.wide, ext, [4, 7]), tiles.pack_long(discretize.bins(t.coords, ext, [4, 7])))):
        path = str(tmp_path / f"b{k}.nc")
        classic.write_bins(packed, ext, [4, 7], t.n_frames, "bond", path)
        assert sorted(map(tuple, classic.read_bins(spark, path).collect())) == wanted and len(wanted) == 61 * 70 * 2
    with pytest.raises(Exception, match="(?i)exist"):
        classic.write_bins(packed, ext, [4, 7], t.n_frames, "bond", path)
    classic.write_bins(packed, ext, [4, 7], t.n_frames, "bond", path, overwrite=True)
    assert [x for x in os.listdir(tmp_path) if "part" in x] == []


def test_a_failed_writer_leaves_no_file(spark, tmp_path):
    t = frames(spark, missing=True)
    ext = discretize.extents(t.coords)
    with pytest.raises(Exception, match="without a bin"):
        classic.write_bins(tiles.pack(t.wide, ext, [4]), ext, [4], t.n_frames, "torsion", str(tmp_path / "x.nc"))
    with pytest.raises(Exception, match="bytes were given"):
        classic.write_bins(tiles.pack(t.wide.where("frame <> 9"), ext, [4]), ext, [4], t.n_frames, "bond", str(tmp_path / "y.nc"))
    assert os.listdir(tmp_path) == []


def test_histograms_that_are_written_are_read(spark, tmp_path):
    t = frames(spark, 40)
    ext = discretize.extents(t.coords)
    steps, b = histogram.Steps(t.n_frames, 4), discretize.bins(t.coords, ext, [3, 5])
    one = histogram.hist1d(b, steps)
    path = str(tmp_path / "h1.nc")
    classic.write_histograms(one, ext, [3, 5], steps, "bond", path, 1, 2)
    got = {(r.ids[0], r.step, r.scheme, r.nbins, r.cell): r.cnt for r in classic.read_histograms(spark, path).collect()}
    assert got == {(r.dof, r.step, r.scheme, r.nbins, r.bin): r.cnt for r in one.where("dof_type = 'bond' and step in (1, 3) and cnt > 0").collect()}
    pairs = selection.all_pairs(ext.select("dof_type", "dof"), ("BD",)).where("(d1 + d2) % 3 = 0")
    two = histogram.hist2d(b, pairs, steps)
    path = str(tmp_path / "h2.nc")
    classic.write_histograms(two, ext, [3, 5], steps, "BD", path)
    rows = classic.read_histograms(spark, path).collect()
    assert {(*r.ids, r.step, r.scheme, r.cell): r.cnt for r in rows} == {(r.d1, r.d2, r.step, r.scheme, r.b1 * r.nbins + r.b2): r.cnt for r in two.where("cnt > 0").collect()}
    layout = classic.layout_of(path)
    with open(path, "rb") as f:
        f.seek(layout.at("mid", 1))
        mids = np.frombuffer(f.read(16 * 8), ">f8")
    ids = spark.read.format("infotraj_histograms").load(path).where("record = 1").first()["ids"]
    e = {(r.dof_type, r.dof): r for r in ext.collect()}
    ends = [e["bond", ids[0]], e["torsion", ids[1]]]
    assert np.allclose(mids, [x["min"] + (i + 0.5) * (x["max"] - x["min"]) / n for n in (3, 5) for x in ends for i in range(n)])
