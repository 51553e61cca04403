"""What the corpus operators share: shared-folder tables, Arrow batch helpers, connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A Python worker takes texts in slices of about so many characters, whatever the Arrow batch holds.
SLICE_CHARS = 1 << 20

#: ASCII white space, the separators of a word.
WHITE = " \t\n\x0b\x0c\r"

_made: dict[str, str] = {}

#: Spark's switch for deleting a query's shuffle files as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, a local session gets
    one of its own; a cluster has no folder that would do, so there it must be set."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _made.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="checkpoint-")
        _made[context.applicationId] = found
        context.setCheckpointDir(found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have gone first
        pass


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: the lineage is cut and a lost executor costs nothing.

    The write's shuffle files go as soon as it has ended, the table when free() is called or the application ends.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if top not in _made:
        _made[top] = top
        atexit.register(_remove, spark, top)
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t.shared_path)


def text_hash(text: Column) -> Column:
    """What tells rows of one id apart: the hash of the text, a null one like an empty one."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def text_slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with about `chars` characters of text each (one text at least), null texts as empty ones."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars, side="right")))
        part = batch.slice(at, to - at)
        yield part, [x or "" for x in part.column(column).to_pylist()]
        at = to


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys (never null), and where each run starts, from batches that are sorted by those keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        same_as_last = np.ones(batch.num_rows, dtype=bool)
        for c in cols:
            same_as_last &= c == c[-1]
        cut = batch.num_rows - int(same_as_last.sum())
        if held and (cut or any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys)):
            if any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
                yield _with_starts(pa.Table.from_batches(held), keys)
                held = []
        if cut:
            yield _with_starts(pa.Table.from_batches([*held, batch.slice(0, cut)]), keys)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _with_starts(pa.Table.from_batches(held), keys)


def _with_starts(t: pa.Table, keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    change = np.zeros(t.num_rows, dtype=bool)
    change[0] = True
    for k in keys:
        c = t.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return t, np.flatnonzero(change)


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a graph on 0..n-1. near(i, others) says which of the others are linked to i.

    Breadth first over what has not been reached yet: a dense group costs about its size, not its square.
    """
    edges: list[tuple[int, int]] = []
    rest, queue = np.arange(1, n), [0]
    while rest.size:
        if not queue:
            queue.append(int(rest[0]))
            rest = rest[1:]
            continue
        i = queue.pop()
        hit = near(i, rest)
        if hit.any():
            found = rest[hit].tolist()
            edges += [(i, j) for j in found]
            queue += found
            rest = rest[~hit]
    return edges


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node in edges(u long, v long).

    Alternating large-star and small-star steps. Each keeps at most one edge a node and neighbour, each minimum is
    an aggregate combined before its shuffle, and each round is a table in the shared folder.
    """
    spark = edges.sparkSession
    now = table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("w"))
        small = small.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("w").alias("u"), "v"))).alias("e")).select("e.*").where("u > v").distinct()
        was, now = now, table(small, "edges")
        free(was)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def columns_free_of(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to add, whatever their letters' case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])
