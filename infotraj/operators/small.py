"""Tables that are small as a rule: their size is counted before anything is broadcast or held by the driver."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows (of a few numbers each) up to which a table is sent to all executors, and up to which the driver holds it.
MAX_BROADCAST_ROWS, MAX_LOCAL_ROWS = 1_000_000, 200_000


def held(df: DataFrame, max_rows: int = MAX_LOCAL_ROWS) -> DataFrame:
    """df computed once: by the driver as a local table if it has at most max_rows rows, else persisted.

    Plans over a local table need neither a scan nor a count of it. The caller unpersists a larger one (release).
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)  # before it is counted, so that what the count computes is kept
    found = df.limit(max_rows + 1).toArrow()
    if found.num_rows > max_rows:
        return df
    df.unpersist()
    out = df.sparkSession.createDataFrame(found, df.schema)
    out.local = True
    return out


def release(*tables: DataFrame) -> None:
    """Let go of held tables that nothing reads any more; local ones need nothing."""
    for t in tables:
        if not is_local(t):
            t.unpersist()


def like(df: DataFrame, of: DataFrame) -> DataFrame:
    """df, known to have no more rows than `of`."""
    df.local = is_local(of)
    return df


def is_local(df: DataFrame) -> bool:
    return getattr(df, "local", False)


def if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, else df for a shuffled join."""
    return F.broadcast(df) if is_local(df) or df.limit(max_rows + 1).count() <= max_rows else df
