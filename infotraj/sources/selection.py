"""Which degrees of freedom and which pairs take part: files, defaults and joins with them.

Both files, or folders of such files, hold records that end in a semicolon; tasks read ranges of bytes and part them there. A subset record is `type total n id...`, a neighbour record is
`kind id n id...`. Records that begin with # are comments, those with n = 0 say nothing, and of records with the same
key the first counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from infotraj.operators.small import MAX_BROADCAST_ROWS, is_local, like
from infotraj.sources.trajectory import TYPES

#: The name of each pair type, its record name in neighbour files and its two types.
PAIR_TYPES = {
    "BB": ("bond", "bond", "bond"),
    "AA": ("angle", "angle", "angle"),
    "DD": ("torsion", "torsion", "torsion"),
    "BA": ("bacross", "bond", "angle"),
    "BD": ("bdcross", "bond", "torsion"),
    "AD": ("adcross", "angle", "torsion"),
}


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(at, key, second, n, ids): the records that count, and where they stand: file, first byte of the split, place in it."""
    text = spark.read.option("lineSep", ";").text(path)
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place"))
    words = F.filter(F.split(F.trim(F.regexp_replace("record", r"\s+", " ")), " "), lambda w: w != "")
    good = text.select(at.alias("at"), F.col("value").alias("record")).withColumn("w", words).where((F.size("w") >= 3) & ~F.startswith(F.get("w", F.lit(0)), F.lit("#")))
    good = good.select("at", F.lower(F.get("w", F.lit(0))).alias("key"), F.get("w", F.lit(1)).cast("int").alias("second"), F.get("w", F.lit(2)).cast("int").alias("n"), F.slice("w", F.lit(4), F.size("w")).cast("array<int>").alias("ids"))
    return good.where("n > 0").withColumn("ids", F.slice("ids", F.lit(1), F.col("n")))


def _first(records: DataFrame, *keys: str) -> DataFrame:
    return records.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("at"))).where("__k = 1").drop("__k")


def read_subset(spark: SparkSession, path: str) -> DataFrame:
    """subset(dof_type, dof) from a subset file."""
    return _first(_records(spark, path).where(F.col("key").isin(*TYPES)), "key").select(F.col("key").alias("dof_type"), F.explode("ids").alias("dof")).distinct()


def _kinds(column: Column, place: int) -> Column:
    """The pair type (0), first type (1) or second type (2) of a record's kind."""
    out = None
    for name, (kind, a, b) in PAIR_TYPES.items():
        out = (F if out is None else out).when(column == kind, (name, a, b)[place])
    return out


def _write(records: DataFrame, path: str) -> None:
    records.select(F.col("record").alias("value")).write.option("lineSep", ";\n").text(path)


def _ids(column: str) -> Column:
    ids = F.sort_array(F.collect_set(column))
    return F.concat_ws(" ", F.size(ids).cast("string"), F.array_join(ids.cast("array<string>"), " "))


def write_subset(dofs: DataFrame, subset: DataFrame, path: str) -> None:
    """A folder of records of the degrees of freedom of a subset (dof_type, dof), with the number of all dofs of their type."""
    total = dofs.groupBy("dof_type").agg(F.countDistinct("dof").alias("total"))
    rows = subset.groupBy("dof_type").agg(_ids("dof").alias("ids")).join(total, "dof_type")
    _write(rows.select(F.concat_ws(" ", "dof_type", "total", "ids").alias("record")), path)


def write_neighbors(pairs: DataFrame, path: str) -> None:
    """A folder of records of pairs (pair_type, d1, d2): one for each kind and first coordinate."""
    kind = None
    for name, (record, _, _) in PAIR_TYPES.items():
        kind = (F if kind is None else kind).when(F.col("pair_type") == name, record)
    rows = pairs.select(kind.alias("kind"), "d1", "d2").groupBy("kind", "d1").agg(_ids("d2").alias("ids"))
    _write(rows.select(F.concat_ws(" ", "kind", "d1", "ids").alias("record")), path)


def read_neighbors(spark: SparkSession, path: str) -> DataFrame:
    """pairs(pair_type, t1, d1, t2, d2) from a neighbour file."""
    got = _first(_records(spark, path), "key", "second")
    key = F.col("key")
    return got.select(_kinds(key, 0).alias("pair_type"), _kinds(key, 1).alias("t1"), F.col("second").alias("d1"), _kinds(key, 2).alias("t2"), F.explode("ids").alias("d2")).where("pair_type is not null").distinct()


def all_pairs(dofs: DataFrame, pair_types=tuple(PAIR_TYPES), max_apart: int | None = None) -> DataFrame:
    """Every i < j within a type and every combination across types, of dofs(dof_type, dof).

    This is the catalogue of pairs of coordinates, not of rows: its size is the number of two-dimensional entropies
    asked for. max_apart keeps neighbours by number only.
    """
    out = None
    for name in pair_types:
        _, a, b = PAIR_TYPES[name]
        x = dofs.where(F.col("dof_type") == a).select(F.lit(name).alias("pair_type"), F.col("dof_type").alias("t1"), F.col("dof").alias("d1"))
        y = dofs.where(F.col("dof_type") == b).select(F.col("dof_type").alias("t2"), F.col("dof").alias("d2"))
        both = x.join(y, F.col("d1") < F.col("d2")) if a == b else x.crossJoin(y)
        if max_apart is not None:
            both = both.where(F.abs(F.col("d1") - F.col("d2")) <= max_apart)
        out = both if out is None else out.unionByName(both)
    return out


def known_pairs(dofs: DataFrame, pair_types=tuple(PAIR_TYPES), max_apart: int | None = None, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """all_pairs of dofs that the driver holds, as a local table too if there are at most max_rows pairs."""
    if not is_local(dofs):
        return all_pairs(dofs, pair_types, max_apart)
    found = dofs.select("dof_type", "dof").toArrow().to_pydict()
    by = {t: np.unique([d for k, d in zip(*found.values(), strict=True) if k == t]) for t in TYPES}
    if sum(len(by[a]) * len(by[b]) for _, a, b in map(PAIR_TYPES.get, pair_types)) > max_rows:
        return all_pairs(dofs, pair_types, max_apart)
    cols: list[list] = [[], [], [], [], []]
    for name in pair_types:
        _, a, b = PAIR_TYPES[name]
        x, y = np.repeat(by[a], len(by[b])), np.tile(by[b], len(by[a]))
        keep = (x < y) if a == b else np.ones(len(x), dtype=bool)
        if max_apart is not None:
            keep &= np.abs(x - y) <= max_apart
        n = int(keep.sum())
        for c, v in zip(cols, ([name] * n, [a] * n, x[keep].tolist(), [b] * n, y[keep].tolist()), strict=True):
            c += v
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32())
    table = pa.table({n: pa.array(c, k) for n, c, k in zip(("pair_type", "t1", "d1", "t2", "d2"), cols, kinds, strict=True)})
    return like(dofs.sparkSession.createDataFrame(table), dofs)


def within(pairs: DataFrame, subset: DataFrame) -> DataFrame:
    """The pairs of which both ends are in the subset."""
    one = subset.select(F.col("dof_type").alias("t1"), F.col("dof").alias("d1"))
    two = subset.select(F.col("dof_type").alias("t2"), F.col("dof").alias("d2"))
    return pairs.join(one, ["t1", "d1"], "left_semi").join(two, ["t2", "d2"], "left_semi").select("pair_type", "t1", "d1", "t2", "d2")
