"""Shards of nearly equal bytes by histogram sort, with equal texts kept in one shard.

Rows are ordered by the 64-bit hash of their text. Splitters are found by counting: each round places probes in the
key interval that still holds a splitter, every partition sums the bytes below each probe exactly, and the interval
narrows, until each splitter is within `tolerance` of the bytes wanted below it or no key is left to divide. Only the
probes' sums reach the driver. Then every row is dealt once.

A group of equal texts that weighs over 1/SMALL of a shard would pull a splitter off its place. There are at most
SMALL * shards of those; they are dealt first, the heaviest to the emptiest shard, and the splitters divide what is
left of each shard. Only a group heavier than a whole shard is itself divided: its rows are ordered by the hash of their
id, and splitters found by the same counting fill the room left in each shard. So equal texts share a shard unless their
group outweighs one, and rows equal in id and text always do, whatever they weigh.

Slots count from 0 in each shard without gaps: rows are numbered inside blocks of a shard, and the blocks' exact
counts give each block its offset, so no shard passes through one task.

Edges: a null text counts and hashes as an empty one; null ids and repeated rows are numbered like any other; an empty
table gives no rows; extra columns are carried along, those named like an added column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from infotraj.llm.common import columns_free_of, table

#: Groups over 1/SMALL of a shard are dealt by weight.
SMALL = 50
PROBES = 64
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def bytes_below(keyed: DataFrame, probes: np.ndarray) -> np.ndarray:
    """Exact bytes of rows(key long, size long) with key < probe, for each of the sorted probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(probes) + 1, dtype=np.int64)
        for b in batches:
            at = np.searchsorted(probes, b.column("key").to_numpy(zero_copy_only=False), side="right")
            np.add.at(total, at, b.column("size").to_numpy(zero_copy_only=False))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["at", "size"])

    sums = np.zeros(len(probes) + 1, dtype=np.int64)
    for at, size in keyed.select("key", "size").mapInArrow(run, "at long, size long").groupBy("at").agg(F.sum("size")).collect():  # a row a probe
        sums[at] = size
    return np.cumsum(sums)[:-1]


def splitters(keyed: DataFrame, wanted: list[float], tolerance: float) -> list[int]:
    """For each number of bytes wanted, a key with about that many bytes below it."""
    total = keyed.agg(F.sum("size")).first()[0] or 0
    low, high = [(LOW, 0)] * len(wanted), [(HIGH, total)] * len(wanted)
    while True:
        probes: set[int] = set()
        for w, (a, _), (b, _) in zip(wanted, low, high, strict=True):
            step = max(1, (b - a) // (PROBES + 1))
            probes.update(range(a + step, b, step))
        if not probes:
            break
        at = np.array(sorted(probes), dtype=np.int64)
        for p, n in zip(at.tolist(), bytes_below(keyed, at).tolist(), strict=True):
            for i, w in enumerate(wanted):
                if n <= w and p > low[i][0]:
                    low[i] = (p, n)
                if n > w and p < high[i][0]:
                    high[i] = (p, n)
        for i, w in enumerate(wanted):  # an end that is close enough settles it
            if min(w - low[i][1], high[i][1] - w) <= tolerance or low[i][1] == high[i][1]:
                best = min(low[i], high[i], key=lambda x: abs(x[1] - w))
                low[i] = high[i] = best
    return [min(a, b, key=lambda x: abs(x[1] - w))[0] for w, a, b in zip(wanted, low, high, strict=True)]


def deal_heavy(heavy: list[tuple[int, int]], total: int, shards: int) -> tuple[list[tuple[int, float, int]], list[float]]:
    """(key, upper end of its part of the group's bytes, shard) of heavy groups [(key, bytes)], and the room left in each shard."""
    room, dealt = [total / shards] * shards, []
    for key, size in sorted(heavy, key=lambda x: (-x[1], x[0])):
        best = max(range(shards), key=lambda s: (room[s], -s))
        if size <= total / shards:
            dealt.append((key, 1.0, best))
            room[best] -= size
            continue
        free, at, left = [s for s in range(shards) if room[s] > 0], 0.0, size
        for s in sorted(free, key=lambda s: (-room[s], s)):
            part = min(left, room[s])
            if part > 0:
                at += part / size
                dealt.append((key, at, s))
                room[s] -= part
                left -= part
        dealt[-1] = (key, 1.0, dealt[-1][2])
    return dealt, [max(0.0, r) for r in room]


def shard_documents(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002) -> DataFrame:
    """df with size, shard and slot."""
    df = columns_free_of(df, "size", "shard", "slot")
    text = F.coalesce(F.col(text_col), F.lit(""))
    cols = {"__key": F.xxhash64(text), "size": (F.octet_length(text) + 1).cast("long"), "__id": F.xxhash64(F.col(id_col), text)}
    keyed = table(df.select(*(c.alias(k.strip("_")) for k, c in cols.items())), "shard-keys")
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    heavy = keyed.groupBy("key").agg(F.sum("size").alias("size")).where(F.col("size") > max(total, 1) / (shards * SMALL)).collect()  # at most shards * SMALL
    dealt, room = deal_heavy([(r.key, r.size) for r in heavy], total, shards)
    own = [r.key for r in heavy]
    parts: dict[int, list[tuple[int, int]]] = {}
    for r in heavy:
        shares = [(end, s) for key, end, s in dealt if key == r.key]
        ends = [end * r.size for end, _ in shares[:-1]]
        cuts = splitters(keyed.where(F.col("key") == r.key).select(F.col("id").alias("key"), "size"), ends, tolerance * max(total, 1) / shards) if ends else []
        parts[r.key] = list(zip([c - 1 for c in cuts] + [HIGH], [s for _, s in shares], strict=True))
    light = keyed.where(~F.col("key").isin(own)) if own else keyed
    rest, share = total - sum(r.size for r in heavy), sum(room) or 1
    found = splitters(light, [rest * x / share for x in np.cumsum(room)[:-1].tolist()], tolerance * max(total, 1) / shards)

    def shard_of(key: Column, id_hash: Column) -> Column:
        out = F.lit(0)
        for s in found:
            out = out + (key >= F.lit(s)).cast("int")
        if dealt:
            table_of = F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(end).cast("long").alias("end"), F.lit(s).alias("s")) for end, s in v]))])
            hit = F.filter(table_of[key], lambda p: id_hash <= p["end"])
            out = F.when(key.isin(own), hit[0]["s"]).otherwise(out)
        return out.cast("int")

    blocks = max(1, round((rows / shards) ** 0.5))
    where = {"shard": shard_of(F.col("__key"), F.col("__id")), "__block": F.pmod(F.col("__id"), F.lit(blocks))}
    counts = keyed.select(shard_of(F.col("key"), F.col("id")).alias("shard"), F.pmod(F.col("id"), F.lit(blocks)).alias("block")).groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias("__shard"), F.col("block").alias("__at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    placed = df.withColumns(cols).withColumns(where)
    inside = Window.partitionBy("shard", "__block").orderBy("__id", id_col)
    out = placed.withColumn("slot", F.row_number().over(inside) - 1)
    out = out.join(offsets, (F.col("shard") == F.col("__shard")) & (F.col("__block") == F.col("__at")))
    return out.withColumn("slot", (F.col("slot") + F.col("__offset")).cast("long")).drop("__key", "__id", "__block", "__shard", "__at", "__offset")


def write_shards(df: DataFrame, path: str, shards: int = 8, **options) -> None:
    """Write df as Parquet, a folder a shard."""
    shard_documents(df, shards, **options).write.partitionBy("shard").parquet(path)


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    return shard_documents(docs).select("doc_id", "size", crc, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
