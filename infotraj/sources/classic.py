"""Stores of bins and histograms in NetCDF's classic 64-bit data layout (CDF-5), as data sources that read and write in parallel.

The layout is plain: a header, then records of one size, each holding every record variable in turn, padded to four bytes. So a
range of records or frames is a range of bytes, readers need no more than the header, and writers place each part at the
offset it belongs to. No NetCDF library is used.

Formats, after register(spark):

* infotraj_bins: one file for each type of coordinate. Rows content, record, dof, scheme, nbins, min, max, avg, phase, first, bins (a
  byte for each frame from first on). Options start, stride and frames read every stride-th frame from start on alone;
  filters on dof keep records from being read; parts are ranges of records and frames.
* infotraj_histograms: rows content, record, ids, extrema, step, scheme, nbins, counts of every record, step and scheme.

Writing: tasks write into one file beside the target, which takes its name when all tasks have ended and their bytes add up to
the whole; a failed job leaves no file. So the target must lie on a file system that the driver and all executors mount.
Reading goes through pyarrow's file systems (local, HDFS, object stores).
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from infotraj.operators.histogram import Steps
from infotraj.operators.small import MAX_LOCAL_ROWS, if_small
from infotraj.operators.tiles import BLOCK, NONE
from infotraj.sources.selection import PAIR_TYPES
from infotraj.sources.trajectory import TYPES

#: Tags of the header's lists, number types by their code, and what a store's content attribute calls each type of coordinate.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
LETTERS = {"bond": "B", "angle": "A", "torsion": "T"}
CODES = {"S1": 2, ">f8": 6, ">u1": 7, ">u4": 9, ">u8": 11}
#: Bytes of a part that is read, values of a row of bins.
PART, ROW = 64 << 20, 1 << 20
BINS = "content string, record long, dof int, scheme int, nbins int, min double, max double, avg double, phase double, first long, bins binary"
HISTOGRAMS = "content string, record long, ids array<int>, extrema array<double>, step int, scheme int, nbins int, counts array<bigint>"


@dataclass
class Variable:
    name: str
    dims: list[int]
    kind: str
    begin: int = 0

    def shape(self, sizes: Sequence[int]) -> list[int]:
        return [sizes[d] for d in self.dims if sizes[d]]

    def bytes(self, sizes: Sequence[int]) -> int:
        """Of one record, or of the whole where it has no records; padded to four."""
        n = int(np.prod(self.shape(sizes), dtype=np.int64)) * np.dtype(self.kind).itemsize
        return -(-n // 4) * 4


class Layout:
    """A header: dimensions (the one of size 0 counts records), attributes and variables, and where each variable begins."""

    def __init__(self, dims: list[tuple[str, int]], attributes: dict, variables: list[Variable], records: int = 0):
        self.dims, self.attributes, self.variables, self.records = dims, attributes, variables, records
        self.sizes = [n for _, n in dims]
        self.by_name = {v.name: v for v in variables}
        self.in_records = [v for v in variables if v.dims and not self.sizes[v.dims[0]]]

    @property
    def record_bytes(self) -> int:
        if len(self.in_records) == 1:  # a single record variable is not padded
            v = self.in_records[0]
            return int(np.prod(v.shape(self.sizes), dtype=np.int64)) * np.dtype(v.kind).itemsize
        return sum(v.bytes(self.sizes) for v in self.in_records)

    def at(self, name: str, record: int) -> int:
        return self.by_name[name].begin + record * self.record_bytes

    @staticmethod
    def parse(raw: bytes) -> Layout:
        """From a file's first bytes; IndexError or struct.error if they do not hold the header whole."""
        if raw[:4] != b"CDF\x05":
            raise ValueError("not a classic NetCDF file of 64-bit data")
        at = 4

        def number(form: str = ">q") -> int:
            nonlocal at
            n = struct.unpack_from(form, raw, at)[0]
            at += struct.calcsize(form)
            return n

        def chars(n: int) -> bytes:
            nonlocal at
            if at + n > len(raw):
                raise IndexError("the header goes on")
            out = raw[at : at + n]
            at += -(-n // 4) * 4
            return out

        def listed(tag: int) -> int:
            found, n = number(">i"), number()
            if found not in (0, tag):
                raise ValueError("damaged header")
            return n

        def attributes() -> dict:
            out = {}
            for _ in range(listed(ATTRIBUTE)):
                name, kind, n = chars(number()).decode(), KINDS[number(">i")], number()
                value = chars(n * np.dtype(kind).itemsize)
                out[name] = value.decode() if kind == "S1" else np.frombuffer(value, kind).tolist()
            return out

        records = number()
        dims = [(chars(number()).decode(), number()) for _ in range(listed(DIMENSION))]
        about, variables = attributes(), []
        for _ in range(listed(VARIABLE)):
            name = chars(number()).decode()
            own = [number() for _ in range(number())]
            attributes()
            kind, _size, begin = KINDS[number(">i")], number(), number()
            variables.append(Variable(name, own, kind, begin))
        return Layout(dims, about, variables, records)

    def write(self) -> bytes:
        """The header; sets where the variables begin."""

        def name(x: str) -> bytes:
            raw = x.encode()
            return struct.pack(">q", len(raw)) + raw + b"\0" * (-len(raw) % 4)

        def head(tag: int, n: int) -> bytes:
            return struct.pack(">iq", tag if n else 0, n)

        out = b"CDF\x05" + struct.pack(">q", self.records) + head(DIMENSION, len(self.dims)) + b"".join(name(n) + struct.pack(">q", size) for n, size in self.dims)
        out += head(ATTRIBUTE, len(self.attributes))
        for key, value in self.attributes.items():
            kind = "S1" if isinstance(value, str) else value[0]
            raw = value.encode() if isinstance(value, str) else np.array(value[1], dtype=kind).tobytes()
            out += name(key) + struct.pack(">iq", CODES[kind], len(raw) // np.dtype(kind).itemsize) + raw + b"\0" * (-len(raw) % 4)
        out += head(VARIABLE, len(self.variables))
        ends = len(out) + sum(len(name(v.name)) + 8 + 8 * len(v.dims) + 12 + 20 for v in self.variables)
        for v in self.variables:
            v.begin, ends = ends, ends + v.bytes(self.sizes)
            out += name(v.name) + struct.pack(">q", len(v.dims)) + b"".join(struct.pack(">q", d) for d in v.dims) + head(ATTRIBUTE, 0) + struct.pack(">iqq", CODES[v.kind], v.bytes(self.sizes), v.begin)
        return out

    @property
    def total(self) -> int:
        return self.variables[0].begin + self.records * self.record_bytes


def bins_layout(content: str, records: int, schemes: Sequence[int], n_frames: int) -> Layout:
    about = {"title": f"{content} Integer Vectors", "content": content, "ncoordims": (">u4", [records]), "nbinSchemes": (">u1", [len(schemes)]), "binSchemes": (">u1", list(schemes))}
    return Layout([("dims", 0), ("extremes", 4), ("bin_scheme_count", len(schemes)), ("frames", n_frames)], about, [Variable("dimid", [0], ">u4"), Variable("extreme", [0, 1], ">f8"), Variable("coord", [0, 2, 3], ">u1")], records)


def histograms_layout(content: str, records: int, schemes: Sequence[int], order: int, nsteps: int, first: int = 0, stride: int = 1) -> Layout:
    about = {"content": content, "order": (">u1", [order]), "firstStep": (">u1", [first]), "nsteps": (">u1", [nsteps]), "stepStride": (">u1", [stride]), "ndims": (">u1", [order]), "nbinSchemes": (">u1", [len(schemes)]), "binSchemes": (">u1", list(schemes))}
    dims = [("records", 0), ("dimsXbin_sum", order * sum(schemes)), ("bin_pow_dims_sum", sum(n**order for n in schemes)), ("nsteps_eff", len(range(first, nsteps, stride))), ("ids", order), ("extremes", 4)]
    return Layout(dims, about, [Variable("id", [0, 4], ">u4"), Variable("extrema", [0, 4, 5], ">f8"), Variable("mid", [0, 1], ">f8"), Variable("freq", [0, 3, 2], ">u8")], records)


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        system, inner = pyarrow.fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return pyarrow.fs.LocalFileSystem().open_input_file(path)


def layout_of(path: str) -> Layout:
    with _open(path) as f:
        size, n = f.size(), 1 << 14
        while True:
            try:
                return Layout.parse(f.read_at(min(n, size), 0))
            except (IndexError, struct.error):
                if n >= size:
                    raise ValueError("the file ends within its header") from None
                n *= 8


def _read(f, layout: Layout, name: str, record: int) -> np.ndarray:
    v = layout.by_name[name]
    shape = v.shape(layout.sizes)
    n = int(np.prod(shape, dtype=np.int64)) * np.dtype(v.kind).itemsize
    return np.frombuffer(f.read_at(n, layout.at(name, record)), v.kind).reshape(shape)


class Range(InputPartition):
    """Some records, and a range of the frames that are wanted."""

    def __init__(self, records: list[int], start: int = 0, end: int = 0):
        super().__init__(0)
        self.records, self.start, self.end = records, start, end


class _BinsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.layout = layout_of(self.path)
        every = self.layout.sizes[self.layout.by_name["coord"].dims[2]]
        self.start, self.stride = int(options.get("start", 0)), int(options.get("stride", 1))
        most = len(range(self.start, every, self.stride))
        self.frames = min(most, int(options.get("frames", most)))
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on dof alone decide which records are read."""
        signs = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            if type(f) in signs and f.attribute == ("dof",):
                self.tests.append((signs[type(f)], f.value))
            else:
                yield f

    def _wanted(self, dof: int) -> bool:
        tests = {"==": lambda v: dof == v, ">": lambda v: dof > v, ">=": lambda v: dof >= v, "<": lambda v: dof < v, "<=": lambda v: dof <= v, "in": lambda v: dof in v}
        return all(tests[s](v) for s, v in self.tests)

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as f:
            records = [r for r in range(self.layout.records) if self._wanted(int(_read(f, self.layout, "dimid", r)))] if self.tests else list(range(self.layout.records))
        schemes = self.layout.attributes["nbinSchemes"][0]
        span = max(1, min(self.frames, PART // (schemes * self.stride)))  # frames of a part of one record
        each = max(1, PART // max(1, schemes * self.stride * self.frames))
        return [Range(records[k : k + each], a, min(a + span, self.frames)) for k in range(0, len(records), each) for a in range(0, self.frames, span)] or [Range([])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        about, every = self.layout.attributes, self.layout.sizes[self.layout.by_name["coord"].dims[2]]
        names = [x.split()[0] for x in BINS.split(", ")]
        kinds = [pa.string(), pa.int64(), *[pa.int32()] * 3, *[pa.float64()] * 4, pa.int64(), pa.binary()]
        with _open(self.path) as f:
            for r in partition.records:
                dof, ext = int(_read(f, self.layout, "dimid", r)), _read(f, self.layout, "extreme", r).tolist()
                rows = []
                for k, n in enumerate(about["binSchemes"]):
                    for a in range(partition.start, partition.end, ROW):
                        b = min(a + ROW, partition.end)
                        at = self.layout.at("coord", r) + k * every + self.start + a * self.stride
                        raw = f.read_at((b - a - 1) * self.stride + 1, at)
                        rows.append((about["content"], r, dof, k, n, *ext, a, np.frombuffer(raw, np.uint8)[:: self.stride].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class _HistogramsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.layout = layout_of(self.path)

    def partitions(self) -> list[InputPartition]:
        each = max(1, PART // max(1, self.layout.record_bytes))
        return [Range(list(range(k, min(k + each, self.layout.records)))) for k in range(0, self.layout.records, each)] or [Range([])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        about = self.layout.attributes
        order, schemes = about["order"][0], about["binSchemes"]
        steps = range(about["firstStep"][0], about["nsteps"][0], about["stepStride"][0])
        ends = np.cumsum([0, *[n**order for n in schemes]])
        names = [x.split()[0] for x in HISTOGRAMS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()), *[pa.int32()] * 3, pa.list_(pa.int64())]
        with _open(self.path) as f:
            for r in partition.records:
                ids, ext, freq = (_read(f, self.layout, x, r) for x in ("id", "extrema", "freq"))
                rows = [(about["content"], r, ids.tolist(), ext.ravel().tolist(), s, k, n, freq[i, ends[k] : ends[k + 1]].tolist()) for i, s in enumerate(steps) for k, n in enumerate(schemes)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class _Written(WriterCommitMessage):
    def __init__(self, n: int):
        self.bytes = n


class _PlacingWriter(DataSourceArrowWriter):
    """Rows (place long, bytes binary): bytes go to their place in a file that is given its name at the end."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        if "://" in self.path:
            raise ValueError(f"{self.path}: parts are placed by offset, which needs a mounted file system")
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        self.part, self.total = f"{self.path}.part-{uuid.uuid4().hex}", int(options["total"])
        self.header = bytes.fromhex(options["header"])
        with open(self.part, "wb") as f:
            f.write(self.header)
            f.truncate(self.total)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        n = 0
        with open(self.part, "r+b") as f:
            for batch in iterator:
                for place, raw in zip(batch.column("place").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                    os.pwrite(f.fileno(), raw, place)
                    n += len(raw)
            os.fsync(f.fileno())
        return _Written(n)

    def commit(self, messages: list) -> None:
        got = len(self.header) + sum(m.bytes for m in messages if m)
        if got != self.total:
            os.unlink(self.part)
            raise ValueError(f"{got} of {self.total} bytes were given")
        os.replace(self.part, self.path)

    def abort(self, messages: list) -> None:
        if os.path.exists(self.part):
            os.unlink(self.part)


class BinsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "infotraj_bins"

    def schema(self) -> str:
        return BINS

    def reader(self, schema) -> DataSourceReader:
        return _BinsReader(dict(self.options))


class HistogramsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "infotraj_histograms"

    def schema(self) -> str:
        return HISTOGRAMS

    def reader(self, schema) -> DataSourceReader:
        return _HistogramsReader(dict(self.options))


class PlacedSource(DataSource):
    """The writer under both formats."""

    @classmethod
    def name(cls) -> str:
        return "infotraj_placed"

    def schema(self) -> str:
        return "place long, bytes binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _PlacingWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> SparkSession:
    for source in (BinsSource, HistogramsSource, PlacedSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def _place(df: DataFrame, layout: Layout, path: str, overwrite: bool) -> None:
    header = layout.write()
    assert len(header) == layout.variables[0].begin
    register(df.sparkSession)
    df.write.format("infotraj_placed").mode("overwrite" if overwrite else "append").option("header", header.hex()).option("total", layout.total).save(path)


def write_bins(packed: DataFrame, ext: DataFrame, schemes: Sequence[int], n_frames: int, dof_type: str, path: str, overwrite: bool = False) -> None:
    """One type's bins, from tiles (operators.tiles) and extents, as a store in the order of dofs. No row is shuffled.

    Every frame of every coordinate must have a bin; extents are held by the driver (one row a coordinate).
    """
    rows = ext.where(F.col("dof_type") == dof_type).select("dof", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("min", "max", "avg", "phase")]).orderBy("dof").limit(MAX_LOCAL_ROWS + 1).toArrow().to_pydict()
    if len(rows["dof"]) > MAX_LOCAL_ROWS:
        raise ValueError(f"more than {MAX_LOCAL_ROWS} coordinates of one type")
    layout = bins_layout(LETTERS[dof_type], len(rows["dof"]), schemes, n_frames)
    layout.write()
    heads = [(layout.at("dimid", r), struct.pack(">I", d)) for r, d in enumerate(rows["dof"])]
    pads = layout.by_name["coord"].bytes(layout.sizes) - len(schemes) * n_frames
    heads += [(layout.at("extreme", r), struct.pack(">4d", *(rows[c][r] for c in ("min", "max", "avg", "phase")))) for r in range(len(rows["dof"]))]
    heads += [(layout.at("coord", r) + len(schemes) * n_frames, b"\0" * pads) for r in range(len(rows["dof"]) if pads else 0)]
    begins = {d: layout.at("coord", r) for r, d in enumerate(rows["dof"])}
    spark = packed.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, k, frames, cells in zip(*(batch.column(x).to_pylist() for x in ("c", "scheme", "frames", "cells")), strict=True):
                frame, grid, out = np.frombuffer(frames, np.int64), np.frombuffer(cells, np.uint8).reshape(-1, BLOCK), []
                keep = (frame >= 0) & (frame < n_frames)
                order = np.flatnonzero(keep)[np.argsort(frame[keep], kind="stable")]
                frame, grid = frame[order], grid[order]
                starts = np.flatnonzero(np.diff(frame, prepend=-2) != 1)
                for col in range(BLOCK):
                    if (begin := begins.get(c * BLOCK + col)) is not None:
                        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(frame)], strict=True):
                            if (grid[a:b, col] == NONE).any():
                                raise ValueError(f"{dof_type} {c * BLOCK + col} has frames without a bin")
                            out.append((begin + k * n_frames + int(frame[a]), grid[a:b, col].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["place", "bytes"])

    mine = packed.where(F.col("t") == TYPES.index(dof_type)).select("c", "scheme", "frames", "cells").mapInArrow(run, "place long, bytes binary")
    first = spark.createDataFrame(pa.table({"place": pa.array([x[0] for x in heads], pa.int64()), "bytes": pa.array([x[1] for x in heads], pa.binary())}))
    _place(mine.unionByName(first), layout, path, overwrite)


def read_bins(spark: SparkSession, path: str, start: int = 0, stride: int = 1, frames: int | None = None, dofs: Sequence[int] | None = None) -> DataFrame:
    """bins(dof_type, dof, frame, scheme, nbins, bin) of a store: every stride-th frame from start on, numbered from 0."""
    df = register(spark).read.format("infotraj_bins").options(start=start, stride=stride, **({} if frames is None else {"frames": frames})).load(path)
    df = df if dofs is None else df.where(F.col("dof").isin(list(dofs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dof_type", "dof", "frame", "scheme", "nbins", "bin"]
        types = {c: t for t, c in LETTERS.items()}
        for batch in batches:
            for content, dof, k, n, first, raw in zip(*(batch.column(x).to_pylist() for x in ("content", "dof", "scheme", "nbins", "first", "bins")), strict=True):
                bins, m = np.frombuffer(raw, np.uint8), len(raw)
                cols = [pa.array([types.get(content, content)] * m, pa.string()), pa.array(np.full(m, dof, np.int32)), pa.array(np.arange(first, first + m)), *(pa.array(np.full(m, x, np.int32)) for x in (k, n)), pa.array(bins.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.select("content", "dof", "scheme", "nbins", "first", "bins").mapInArrow(run, "dof_type string, dof int, frame long, scheme int, nbins int, bin int")


def write_histograms(hist: DataFrame, ext: DataFrame, schemes: Sequence[int], steps: Steps, kind: str, path: str, first: int = 0, stride: int = 1, overwrite: bool = False) -> None:
    """hist1d of one type (kind bond, angle or torsion) or hist2d of one pair type (kind BB, ...) as a store, in the order of dofs.

    Steps first, first + stride, ... are written. Only a record's cells meet in a row; records are numbered within their
    first coordinate, so no task sees all of them.
    """
    order = 2 if kind in PAIR_TYPES else 1
    types = PAIR_TYPES[kind][1:] if order == 2 else (kind,)
    where = F.col("pair_type") == kind if order == 2 else F.col("dof_type") == kind
    ids = ["d1", "d2"] if order == 2 else ["dof"]
    ends = np.cumsum([0, *[n**order for n in schemes]]).tolist()
    off = F.element_at(F.array(*[F.lit(x) for x in ends]), F.col("scheme") + 1)
    cell = off + (F.col("b1") * F.col("nbins") + F.col("b2") if order == 2 else F.col("bin"))
    kept = hist.where(where & (F.col("step") >= first) & ((F.col("step") - first) % stride == 0) & (F.col("cnt") > 0))
    rows = kept.select(*ids, ((F.col("step") - first) / stride).cast("int").alias("s"), cell.cast("int").alias("cell"), "cnt").groupBy(*ids).agg(F.collect_list(F.struct("s", "cell", "cnt")).alias("cells"))
    listed = kept.select(*ids).distinct()
    sizes = listed.groupBy(ids[0]).count().orderBy(ids[0]).collect()  # a row a coordinate
    bases = hist.sparkSession.createDataFrame([(r[0], b) for r, b in zip(sizes, np.cumsum([0, *[r[1] for r in sizes]])[:-1].tolist(), strict=True)], f"{ids[0]} int, base long")
    rank = F.row_number().over(Window.partitionBy(ids[0]).orderBy(*ids[1:])) - 1 if order == 2 else F.lit(0)
    numbered = rows.join(listed.withColumn("k", rank), ids).join(F.broadcast(bases), ids[0]).withColumn("record", F.col("base") + F.col("k"))
    for i, t in zip(ids, types, strict=True):
        side = ext.where(F.col("dof_type") == t).select(F.col("dof").alias(i), F.array(*[F.coalesce(c, F.lit(0.0)) for c in ("min", "max", "avg", "phase")]).alias(f"ext_{i}"))
        numbered = numbered.join(if_small(side), i)
    layout = histograms_layout("".join(LETTERS[t] for t in types) if order == 2 else LETTERS[kind], sum(r[1] for r in sizes), schemes, order, steps.nsteps, first, stride)
    layout.write()
    begin, size, eff = layout.variables[0].begin, layout.record_bytes, len(range(first, steps.nsteps, stride))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            lists = batch.column("cells")
            flat, last = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
            s, c, n = (flat.field(k).to_numpy() for k in range(3))
            exts = [batch.column(f"ext_{i}").to_pylist() for i in ids]
            for k, (r, *own) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("record", *ids)), strict=True)):
                a, b = (int(last[k - 1]) if k else 0), int(last[k])
                freq = np.zeros((eff, ends[-1]), dtype=">u8")
                freq[s[a:b], c[a:b]] = n[a:b]
                mids = [(e[k][0] + (np.arange(m) + 0.5) * ((e[k][1] - e[k][0]) / m)) for m in schemes for e in exts]
                raw = np.array(own, ">u4").tobytes() + np.array([e[k] for e in exts], ">f8").tobytes() + np.concatenate(mids).astype(">f8").tobytes() + freq.tobytes()
                out.append((begin + r * size, raw))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["place", "bytes"])

    _place(numbered.select("record", *ids, *[f"ext_{i}" for i in ids], "cells").mapInArrow(run, "place long, bytes binary"), layout, path, overwrite)


def read_histograms(spark: SparkSession, path: str, empty: bool = False) -> DataFrame:
    """(ids, step, scheme, nbins, cell, cnt) of a store, without empty cells unless asked for."""
    df = register(spark).read.format("infotraj_histograms").load(path)
    out = df.select("ids", "step", "scheme", "nbins", F.posexplode("counts").alias("cell", "cnt"))
    return out if empty else out.where("cnt > 0")


def described(path: str) -> str:
    """A store's dimensions, attributes and variables, as JSON."""
    layout = layout_of(path)
    return json.dumps({"records": layout.records, "dims": dict(layout.dims), "attributes": layout.attributes, "variables": {v.name: [v.kind, v.shape(layout.sizes)] for v in layout.variables}})
