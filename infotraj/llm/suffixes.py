"""Suffix-array dedup: bytes that lie in a 50-byte string which an earlier document has too, by merged Burrows-Wheeler transforms.

Strings are judged on the input: a string that also starts in a document of a smaller id goes from every later one, whatever else goes.

1. Equal texts are one (by 128 bits of hash); later documents of an equal text go whole. Distinct texts form blocks of about BLOCK bytes.
2. Every 50-byte string is named by its anchor, the smallest hash of its 20-byte pieces: equal strings have equal anchors. Neighbouring strings
   mostly share one, so anchors are few. Those that one document alone has cannot repeat and are done with. A block sends its anchors
   packed, a row for each of MEET buckets, and gets the shared ones back packed.
3. The strings of the other anchors, as segments of up to 80 bytes, are routed by anchor to buckets of about BUCKET bytes, one row for each
   block and distinct segment. An anchor with more than HEAVY is split: its strings go singly, dealt by their own hash. Such anchors, one
   for each HEAVY bytes of segments at most, are told to all tasks, so that no segment is shuffled to find them.
4. In a bucket, shards of segments each get the Burrows-Wheeler transform of their own suffixes. The shards are then merged: starting
   with the rows of one shard after another, the interleave is refined by stable distributions on the two preceding symbols, through each
   shard's own last-to-first mapping; no suffix is compared or sorted again. A round takes the rows alone that lead to the start of a
   50-byte string, as many as there are such strings. Rows not parted after 50 symbols form the repeated intervals.
   Anchors with one distinct segment are intervals already.
5. The smallest document of each interval goes back to the blocks, where what later documents hold is cut.

Texts are shuffled by block, never by anchor; a passage or text that a third of all documents hold is a row a block. Split anchors alone are broadcast.

Edges: a null or empty text has no bytes, and texts under 50 bytes keep all; a null id is larger than any other; rows of equal id do not
remove each other's strings, so repeated rows fare alike; ids are cast to long; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infotraj.llm.common import free, sorted_runs, table

#: Bytes of a string, of the pieces whose hashes name it, and how many strings may share an anchor at a stretch.
SPAN, PIECE = 50, 20
STRETCH = SPAN - PIECE + 1
#: Bytes of a block of texts, of a bucket of segments, of a shard, and windows hashed at a time.
BLOCK, BUCKET, SHARD, CHUNK = 8 << 20, 1 << 20, 1 << 16, 1 << 15
#: Buckets that blocks' anchors meet in, and stretches copied at a time.
MEET, COPY = 2048, 1 << 13
#: Bytes of one anchor's segments from which they are split.
HEAVY = 4 << 20
LAST = (1 << 63) - 1
_U = np.uint64


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random odd number for each byte, and powers of an odd number and of its inverse modulo 2^64."""
    n, p = CHUNK + 2 * SPAN, 0x9E3779B97F4A7C15
    up, down = np.full(n, p, dtype=_U), np.full(n, pow(p, -1, 1 << 64), dtype=_U)
    up[0] = down[0] = 1
    return np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=_U) * _U(2) + _U(1), np.cumprod(up), np.cumprod(down)


def string_hashes(data: np.ndarray, span: int) -> np.ndarray:
    """A hash of each span-byte string of data, for up to CHUNK + SPAN bytes."""
    byte, up, down = _powers()
    v = byte[data]
    v *= up[: len(v)]
    sums = np.append(_U(0), np.cumsum(v))
    h = sums[span:] - sums[:-span]
    h *= down[: len(h)]
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    return h


def string_anchors(data: np.ndarray) -> np.ndarray:
    """The anchor of each SPAN-byte string of data, for up to CHUNK strings."""
    h, size = string_hashes(data, PIECE), 1
    while size * 2 <= STRETCH:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (STRETCH - size)], h[STRETCH - size :]) if size < STRETCH else h


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first, strings): runs of up to STRETCH neighbouring strings with one anchor, in texts that end at `ends`."""
    starts = np.append(0, ends[:-1])
    found = [(np.empty(0, dtype=_U), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))]
    for at in range(0, max(0, len(data) - SPAN + 1), CHUNK):
        h = string_anchors(data[at : at + CHUNK + SPAN - 1])
        new = np.append(True, h[1:] != h[:-1])
        new[starts[np.searchsorted(starts, at, side="right") : np.searchsorted(starts, at + len(h))] - at] = True
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(h)))
        if size.max() > STRETCH:  # a text that repeats itself
            pieces = -(-size // STRETCH)
            begin = np.repeat(begin, pieces) + STRETCH * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            size = np.diff(np.append(begin, len(h)))
        found.append((h[begin], begin + at, size))
    h, begin, n = (np.concatenate(x) for x in zip(*found, strict=True))
    text = np.searchsorted(ends, begin, side="right")
    n = np.minimum(n, ends[np.minimum(text, len(ends) - 1)] - SPAN + 1 - begin) if len(ends) else n
    keep = n > 0
    h, text, begin, n = h[keep], text[keep], begin[keep], n[keep]
    return h.view(np.int64), text, begin - starts[text], n


def bytes_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column in a row, and where each value ends."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    offsets = np.frombuffer(a.buffers()[1], np.int32 if pa.types.is_binary(a.type) else np.int64)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:] - offsets[0]


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The binary column whose values lie in a row in data and end, in bytes, at `ends`: what bytes_of takes apart."""
    offsets = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def slices(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of `size` values each, one slice after another."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each key among the distinct ones, from 1, or 0 for key 0; and the keys' order, equal ones by their place."""
    bits = _U(len(key).bit_length())
    if int(key.max()) >> (64 - int(bits)):
        order = np.argsort(key, kind="stable")
        same = key[order]
    else:  # key and place in one number
        same = np.sort(key << bits | np.arange(len(key), dtype=_U))
        order = (same & ((_U(1) << bits) - _U(1))).astype(np.int64)
        same >>= bits
    rank = np.empty(len(key), dtype=_U)
    rank[order] = np.cumsum(np.append(same[:1] > 0, same[1:] != same[:-1])).astype(_U)
    return rank, order


class Shard:
    """The Burrows-Wheeler transform of some byte strings without 255: symbols are bytes + 1, 0 ends a string.

    Rows are suffixes in order, equal ones by their string; `last` is the symbol before each, `back` the row of the suffix
    that starts there (last-to-first mapping), `string` and `left` whose suffix it is and how many bytes it has.
    """

    def __init__(self, strings: list[bytes]):
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8) + np.uint8(1)  # 255 + 1 is 0
        string = np.repeat(np.arange(len(strings)), sizes + 1)
        ends = np.cumsum(sizes + 1)
        left = ends[string] - np.arange(len(text)) - 1

        def ahead(x: np.ndarray, k: int) -> np.ndarray:
            return np.where(left > k, np.append(x[k:], np.zeros(min(k, len(x)), dtype=_U)), _U(0))

        one = text.astype(_U)
        key = one << _U(8) | ahead(one, 1)
        key = (key << _U(16) | ahead(key, 2)) << _U(8) | ahead(one, 4)
        reach, distinct, bits = 5, 0, _U(len(text).bit_length())
        rank, order = _ranks(key)
        while reach < sizes.max() and rank.max() > distinct:  # suffixes told apart by twice as many symbols each time
            distinct = rank.max()
            rank, order = _ranks(rank << bits | ahead(rank, reach))
            reach *= 2
        self.strings, self.sizes = len(strings), sizes
        before = np.roll(text, 1)
        before[ends - sizes - 1] = 0
        self.last, self.string, self.left = before[order], string[order], left[order]
        full = np.flatnonzero(self.last)
        self.back = np.full(len(text), -1, dtype=np.int64)
        self.back[full[np.argsort(self.last[full], kind="stable")]] = np.arange(len(strings), len(text))


def repeated_intervals(shards: list[Shard], span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(rows, interval): the merged order of all shards' rows by their first `span` symbols, and a number for each run of rows that agree in them."""
    base = np.cumsum([0, *[len(s.last) for s in shards]])
    back = np.concatenate([np.where(s.last > 0, s.back + b, 0) for s, b in zip(shards, base, strict=False)])
    kind = np.int32 if len(back) < 1 << 23 else np.int64  # 24 bits of rows
    step = (back << 8 | np.concatenate([s.last for s in shards])).astype(kind)  # a row's preceding symbol, and above it the row to go back to
    ends = np.concatenate([np.arange(b, b + s.strings) for s, b in zip(shards, base, strict=False)])
    rows, interval, n = np.arange(len(step), dtype=kind), np.zeros(len(step), dtype=np.int32), len(ends)
    for _ in range(span):
        way = step[rows]
        to = np.argsort((way & 255).astype(np.uint8), kind="stable")
        way, was = way[to], interval[to]
        symbol = (way & 255).astype(np.uint8)
        before, interval = interval[-1], np.zeros(len(step), dtype=np.int32)
        interval[n:] = 1  # as many rows have no symbol before them as there are strings: they go to the strings' ends, which come first
        interval[n + 1 :] = (symbol[n + 1 :] != symbol[n:-1]) | (was[n + 1 :] != was[n:-1])
        np.cumsum(interval, out=interval)
        rows = way >> 8
        rows[:n] = ends
        if interval[-1] == before:
            break
    return rows, interval


def string_intervals(shards: list[Shard], span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(rows, interval): of repeated_intervals' rows those alone that have `span` symbols.

    Before the last h symbols are at hand, only rows h symbols or more after their string's start and span - h or more before its
    end lead there. So a round takes as many rows as there are strings of `span` symbols, and none that starts a string; it
    distributes them on the two preceding symbols.
    """
    base = np.cumsum([0, *[len(s.last) for s in shards]])
    back = np.concatenate([np.where(s.last > 0, s.back + b, 0) for s, b in zip(shards, base, strict=False)])
    last = np.concatenate([s.last for s in shards]).astype(np.uint16)
    back = back.astype(np.int32 if len(back) < 1 << 31 else np.int64)
    rows = np.flatnonzero(np.concatenate([s.left <= s.sizes[s.string] - span for s in shards])).astype(back.dtype)
    interval = np.zeros(len(rows), dtype=np.int32)
    for symbols, way in [(last, back)] * (span % 2) + [(last[back] << np.uint16(8) | last, back[back])] * (span // 2):
        symbol = symbols[rows]
        to = np.argsort(symbol, kind="stable")
        symbol, was, rows = symbol[to], interval[to], way[rows[to]]
        interval[1:] = (symbol[1:] != symbol[:-1]) | (was[1:] != was[:-1])
        np.cumsum(interval, out=interval)
    return rows, interval


def least_in_a_row(strings: list[bytes], doc: np.ndarray, span: int = SPAN, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """(least, ends): for each span-byte string, of one string after another, the smallest doc of all strings that have it; where each string's end."""
    shards, first, at = [], [], 0
    while at < len(strings):
        to, size = at, 0
        while to < len(strings) and (to == at or size < shard):
            size += len(strings[to])
            to += 1
        shards.append(Shard(strings[at:to]))
        first.append(at)
        at = to
    rows, interval = string_intervals(shards, span)
    string = np.concatenate([s.string + f for s, f in zip(shards, first, strict=True)])[rows]
    left = np.concatenate([s.left for s in shards])[rows]
    starts = np.flatnonzero(np.diff(interval, prepend=-1))
    least = np.repeat(np.minimum.reduceat(doc[string], starts), np.diff(np.append(starts, len(string))))
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    windows = np.maximum(0, sizes - span + 1)
    out = np.empty(int(windows.sum()), dtype=np.int64)
    out[(np.cumsum(windows) - windows)[string] + sizes[string] - left] = least
    return out, np.cumsum(windows)


def least_documents(strings: list[bytes], doc: np.ndarray, span: int = SPAN, shard: int = SHARD) -> list[np.ndarray]:
    """For each string the smallest doc of all strings that have its first, second, ... span-byte string."""
    least, ends = least_in_a_row(strings, doc, span, shard)
    return np.split(least, ends[:-1])


def distinct_texts(df: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(documents, texts): doc_id, h1, h2, n_bytes, whole (digest of a short text); and block, row, doc, h1, h2, text of the distinct long ones."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashes = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]
    n = F.octet_length(text).cast("long")
    short = F.when(n < SPAN, F.sha2(text.cast("binary"), 256))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), *hashes, n.alias("n_bytes"), short.alias("whole"))
    long = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), *hashes, text.cast("binary").alias("text")).where(F.length("text") >= SPAN)
    one = long.groupBy("h1", "h2").agg(F.min("doc").alias("doc"), F.first("text").alias("text"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, row, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            blocks, rows = [], []
            for size in pa.compute.binary_length(batch.column("text")).to_pylist():
                if held and held + size > block_bytes:
                    block, row, held = block + 1, 0, 0
                blocks.append(block)
                rows.append(row)
                row, held = row + 1, held + size
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(rows, pa.int32()), *[batch.column(c) for c in ("doc", "h1", "h2", "text")]], names=["block", "row", "doc", "h1", "h2", "text"])

    return docs, table(one.mapInArrow(numbered, "block long, row int, doc long, h1 long, h2 long, text binary"), "distinct-texts")


def shared_anchors(texts: DataFrame) -> DataFrame:
    """(block, hashes): the anchors that more than one document, or block, has, in each block that has them, packed by bucket."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = bytes_of(batch.column("text"))
            h, text, _, _ = stretches(data, ends)
            block, doc = (batch.column(c).to_numpy() for c in ("block", "doc"))
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            for row, a, b in zip(cuts.tolist(), *(np.searchsorted(text, x).tolist() for x in (cuts, np.append(cuts[1:], len(block)))), strict=True):
                if a == b:
                    continue
                order = np.argsort(h[a:b])
                own, of = h[a:b][order], doc[text[a:b]][order]
                at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                alone = np.minimum.reduceat(of, at) == np.maximum.reduceat(of, at)
                own = own[at]
                key = ((own.view(_U) % _U(MEET)) << _U(1) | alone).astype(np.uint16)
                to = np.argsort(key, kind="stable")  # by bucket, and first what several of the block's own documents have
                key = key[to]
                at = np.flatnonzero(np.append(True, key[1:] >> 1 != key[:-1] >> 1))
                cols = [pa.array((key[at] >> 1).astype(np.int32)), pa.array(np.full(len(at), block[row])), pa.array(np.add.reduceat(1 - (key & 1).astype(np.int32), at), pa.int32())]
                yield pa.RecordBatch.from_arrays([*cols, binary(own[to].view(np.uint8), 8 * np.append(at[1:], len(to)))], names=["bucket", "block", "several", "hashes"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in sorted_runs(batches, ["bucket"]):
            data, ends = bytes_of(t.column("hashes"))
            h, starts = data.view(np.int64), np.append(0, ends[:-1]) // 8
            here = np.zeros(len(h), dtype=bool)
            here[slices(starts, t.column("several").to_numpy().astype(np.int64))] = True
            order = np.argsort(h)
            same = h[order]
            at = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
            size = np.diff(np.append(at, len(h)))
            keep = np.empty(len(h), dtype=bool)
            keep[order] = np.repeat((size > 1) | np.logical_or.reduceat(here[order], at), size)
            kept = np.add.reduceat(keep.astype(np.int64), starts)
            yield pa.RecordBatch.from_arrays([pa.array(t.column("block").to_numpy()[kept > 0]), binary(h[keep].view(np.uint8), 8 * np.cumsum(kept)[kept > 0])], names=["block", "hashes"])

    found = texts.mapInArrow(anchors, "bucket int, block long, several int, hashes binary")  # the first `several` of a row are in several of the block's own documents
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(several, "block long, hashes binary")


def segments(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows (block, seg, hash, lo, hi, bytes) of a block's distinct segments, and one (block, rows, firsts, strings, segs) of where they are."""
    kinds = "block long, seg int, hash long, lo long, hi long, bytes binary, rows binary, firsts binary, strings binary, segs binary"
    names = [x.split()[0] for x in kinds.split(", ")]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 5]

    def cut(held: pa.Table, found: pa.Table) -> pa.Table:
        held = held.sort_by("row")
        data, ends = bytes_of(held.column("text"))
        h, text, first, n = stretches(data, ends)
        shared = np.sort(bytes_of(found.column("hashes"))[0].view(np.int64))
        keep = shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h if len(shared) else np.zeros(len(h), dtype=bool)
        h, text, first, n = h[keep], text[keep], first[keep], n[keep]
        begin, size = (np.append(0, ends[:-1])[text] + first, n + SPAN - 1) if len(h) else (text, n)
        raw, to = np.empty(int(size.sum()), dtype=np.uint8), np.cumsum(size)
        for at in range(0, len(h), COPY):
            places = slices(begin[at : at + COPY], size[at : at + COPY])
            raw[to[at] - size[at] :][: len(places)] = data[places]
        coded = binary(raw, to).dictionary_encode()
        segs, m = coded.indices.to_numpy(), len(coded.dictionary)
        doc = held.column("doc").to_numpy()[text]
        lo, hi, anchor = np.full(m, LAST), np.full(m, -LAST - 1), np.empty(m, dtype=np.int64)
        np.minimum.at(lo, segs, doc)
        np.maximum.at(hi, segs, doc)
        anchor[segs] = h  # the bytes tell the anchor
        block = held.column("block")[0].as_py() if held.num_rows else 0
        packed = [pa.array([None] * m + [x.tobytes()], pa.binary()) for x in (text.astype(np.int32), first.astype(np.int32), n.astype(np.uint8), segs.astype(np.int32))]
        last = np.arange(m + 1) == m  # the row of places
        cols = [pa.array(np.full(m + 1, block)), *(pa.array(np.append(x, 0), k, mask=last) for x, k in zip((np.arange(m), anchor, lo, hi), types[1:5], strict=True)), pa.concat_arrays([coded.dictionary, pa.nulls(1, types[5])])]
        return pa.table([*cols, *packed], names=names)

    right = shared.select(F.col("block").alias("of_block"), "hashes")
    return texts.groupBy("block").cogroup(right.groupBy("of_block")).applyInArrow(cut, kinds)


def least_by_segment(segs: DataFrame, bucket_bytes: int, heavy_bytes: int) -> DataFrame:
    """(block, seg, off, least): for the strings from off on of a segment, the smallest documents that have them, one for all where off is -1; not where the block's own are no larger."""
    size = segs.agg(F.sum(F.length("bytes"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    heavy = segs.groupBy("hash").agg(F.sum(F.length("bytes")).alias("size")).where(F.col("size") > heavy_bytes)
    heavy = table(heavy.select("hash", F.ceil(F.col("size") * 20 / bucket_bytes).alias("parts")), "heavy-anchors")  # strings sent singly take up to 19 times the bytes
    whole = segs.select(F.pmod("hash", F.lit(buckets)).alias("bucket"), "hash", "block", "seg", F.lit(0).alias("off"), "lo", "hi", "bytes")
    if heavy.limit(1).count():
        names, few = whole.columns, F.broadcast(heavy)  # a number or two for each `heavy_bytes` of segments at most; else all segments are shuffled for it, twice

        def singly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                data, ends = bytes_of(batch.column("bytes"))
                n = np.diff(ends, prepend=0) - SPAN + 1
                row, off = np.repeat(np.arange(len(n)), n), slices(np.zeros(len(n), dtype=np.int64), n)
                begin = (ends - n - SPAN + 1)[row] + off
                own = np.concatenate([string_hashes(data[at : at + CHUNK + SPAN - 1], SPAN) for at in range(0, len(data), CHUNK) if at + SPAN <= len(data)])[begin]
                anchor, parts = (batch.column(c).to_numpy().view(_U)[row] for c in ("hash", "parts"))
                bucket = (((anchor + own % parts) * _U(0xD6E8FEB86659FD93)) >> _U(2)).view(np.int64) + buckets
                for at in range(0, len(row), COPY):
                    k, size = pa.array(row[at : at + COPY]), np.full(len(row[at : at + COPY]), SPAN)
                    kept = {c: batch.column(c).take(k) for c in ("hash", "block", "seg", "lo", "hi")}
                    kept |= {"bucket": pa.array(bucket[at : at + COPY]), "off": pa.array(off[at : at + COPY].astype(np.int32)), "bytes": binary(data[slices(begin[at : at + COPY], size)], np.cumsum(size))}
                    yield pa.RecordBatch.from_arrays([kept[c] for c in names], names=names)

        split = segs.join(few, "hash").mapInArrow(singly, "bucket long, hash long, block long, seg int, off int, lo long, hi long, bytes binary")
        whole = whole.join(few, "hash", "left_anti").select(names).unionByName(split)

    def merge(t: pa.Table) -> pa.Table:
        coded = t.column("bytes").combine_chunks().dictionary_encode()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        mine, strings = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        order = np.argsort(mine, kind="stable")
        starts = np.flatnonzero(np.diff(mine[order], prepend=-1))
        doc = np.minimum.reduceat(t.column("lo").to_numpy()[order], starts)
        _, of, own = np.unique(t.column("hash").to_numpy()[order[starts]], return_inverse=True, return_counts=True)  # a segment has one anchor
        several = np.flatnonzero(own[of] > 1)
        size = np.ones(len(strings), dtype=np.int64)  # numbers of each: one for each of its strings, or one for all
        size[several] = pa.compute.binary_length(coded.dictionary).to_numpy()[several] - SPAN + 1
        begin, least = np.cumsum(size) - size, np.repeat(doc, size)
        if several.size:
            least[slices(begin[several], size[several])] = least_in_a_row([strings[k] for k in several.tolist()], doc[several])[0]
        at = np.flatnonzero(np.minimum.reduceat(least, begin)[mine] < t.column("hi").to_numpy())
        off, told = t.column("off").to_numpy()[at], mine[at]
        alone = (own[of] == 1) & (pa.compute.binary_length(coded.dictionary).to_numpy() > SPAN)
        said = least[slices(begin[told], size[told])]
        cols = [t.column(c).take(pa.array(at)).combine_chunks() for c in ("block", "seg")]
        return pa.table([*cols, pa.array(np.where(alone[told], -1, off).astype(np.int32)), binary(said.view(np.uint8), 8 * np.cumsum(size[told]))], names=["block", "seg", "off", "least"])

    return whole.groupBy("bucket").applyInArrow(merge, "block long, seg int, off int, least binary")


def dedup_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK, bucket_bytes: int = BUCKET, heavy_bytes: int = HEAVY, kept_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of df; with kept_text also what is left, as `kept` (binary)."""
    docs, texts = distinct_texts(df, id_col, text_col, block_bytes)
    shared = table(shared_anchors(texts), "shared-anchors")
    cut = table(segments(texts, shared), "segments")
    free(shared)
    found = table(least_by_segment(cut.where("seg is not null").select("block", "seg", "hash", "lo", "hi", "bytes"), bucket_bytes, heavy_bytes), "least-documents")
    places = cut.where("seg is null").select("block", "rows", "firsts", "strings", "segs")
    none = lambda *cols: [F.lit(None).cast(k).alias(c) for c, k in cols]
    right = places.select(F.col("block").alias("of_block"), *places.columns[1:], *none(("seg", "int"), ("off", "int"), ("least", "binary")))
    right = right.unionByName(found.select(F.col("block").alias("of_block"), *none(*[(c, "binary") for c in places.columns[1:]]), "seg", "off", "least"))

    def remove(held: pa.Table, told: pa.Table) -> pa.Table:
        held = held.sort_by("row")
        data, ends = bytes_of(held.column("text"))
        doc, starts = held.column("doc").to_numpy(), np.append(0, ends[:-1])
        said = told.filter(pa.compute.is_valid(told.column("seg")))
        gone = np.zeros(len(data), dtype=np.int32)  # where strings start that go
        if said.num_rows:
            places = told.filter(pa.compute.is_valid(told.column("rows")))
            text, first, n, seg = (np.frombuffer(places.column(c)[0].as_py(), k).astype(np.int64) for c, k in (("rows", np.int32), ("firsts", np.int32), ("strings", np.uint8), ("segs", np.int32)))
            least = np.full((int(seg.max()) + 1, STRETCH), LAST)
            s, off, m = said.column("seg").to_numpy(), said.column("off").to_numpy(), pa.compute.binary_length(said.column("least")).to_numpy() // 8
            got = bytes_of(said.column("least"))[0].view(np.int64)
            whole = off < 0
            least[s[whole]] = got[np.cumsum(m)[whole] - 1][:, None]
            place = np.repeat(s.astype(np.int64) * STRETCH, m) + slices(off.astype(np.int64), m)
            each = np.repeat(~whole, m)
            least.reshape(-1)[place[each]] = got[each]
            some = np.zeros(len(least), dtype=bool)
            some[s] = True
            text, first, n, seg = (x[some[seg]] for x in (text, first, n, seg))
            for at in range(0, len(n), COPY):
                few = slice(at, at + COPY)
                hit = least.reshape(-1)[slices(seg[few] * STRETCH, n[few])] < np.repeat(doc[text[few]], n[few])
                gone[slices((starts[text] + first)[few], n[few])[hit]] = 1
        np.cumsum(gone, out=gone)
        lost = gone > 0
        lost[SPAN:] = gone[SPAN:] > gone[:-SPAN]
        runs = lost.copy()
        runs[1:] &= ~lost[:-1]
        runs[starts] = lost[starts]
        left = [data[a:b][~lost[a:b]].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        cols = {"h1": held.column("h1"), "h2": held.column("h2"), "first_doc": held.column("doc"), "n_removed": pa.array(np.add.reduceat(lost.astype(np.int64), starts)), "n_spans": pa.array(np.add.reduceat(runs.astype(np.int64), starts)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in left])}
        return pa.table(cols | ({"kept": pa.array(left, pa.binary())} if kept_text else {}))

    kinds = "h1 long, h2 long, first_doc long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept_text
    judged = table(texts.groupBy("block").cogroup(right.groupBy("of_block")).applyInArrow(remove, kinds), "judged-texts")
    free(texts, cut, found)
    both = docs.join(judged, ["h1", "h2"], "left")
    later, short = F.coalesce("doc_id", F.lit(LAST)) > F.col("first_doc"), F.col("whole").isNotNull()
    out = both.select(
        "doc_id", "n_bytes", F.when(short, 0).when(later, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(short, 0).when(later, 1).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(short, F.col("whole")).when(later, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *([F.when(short, None).when(later, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if kept_text else []),
    )
    return out


def op12_suffixes(spark, sf_dir: str) -> DataFrame:
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT row, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
r AS (SELECT row, i, i > lag(i, 1, -100) OVER (PARTITION BY row ORDER BY i) + 50 AS new FROM g JOIN f USING (s) WHERE first < doc_id),
p AS (SELECT row, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(new::INT) OVER (PARTITION BY row ORDER BY i) AS k FROM r) GROUP BY row, k),
e AS (SELECT row, a, b FROM p UNION ALL SELECT row, len(h) // 2, len(h) // 2 FROM d),
k AS (SELECT row, a, b, lag(b, 1, 0) OVER (PARTITION BY row ORDER BY a, b) AS z FROM e),
o AS (SELECT k.row, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a, b) AS kept, sum(b - a)::BIGINT AS n_removed, count(*) FILTER (b > a) AS n_spans FROM k JOIN d USING (row) GROUP BY k.row)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN o USING (row)
"""
