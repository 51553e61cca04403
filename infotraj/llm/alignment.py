"""Cross-tokenizer alignment: tokens of two tokenizers over the same bytes, linked through a dictionary of groups.

Where tokens of both end at one byte, a text is cut into groups; a group is the ids of both sides. Texts hold few distinct
groups, so they are interned:

1. A task encodes its texts, chunk by chunk between blanks where both tokenizers cut (each distinct chunk once), and writes a
   row for each text and, for each block of texts and distinct group, a row with the texts that hold it and how often.
2. Distinct groups, of all blocks, are expanded into their links once each. Two token sequences over the same bytes have no
   more links than tokens.
3. A pair of ids that one group alone holds is linked in as many documents as that group is in. The other pairs' documents are
   counted as unions of the texts of their groups, block by block.
4. Links, best links and counts are added up for each distinct group, joined back to the blocks by the group's key, multiplied by
   how often a text holds the group, and added up for each text.

A group in all documents is a row a block, so no key has more rows than there are blocks; a block is about BLOCK_CHARS of text.
Each row of the input is a document of its own. Both vocabulary files are read where the driver is and sent along.

Edges: a null or empty text, and one that either tokenizer does not give back byte for byte, has no tokens: zeros and an empty
groups_sha256. Repeated rows each count as documents; ids are cast to long (null stays null); an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infotraj.llm.bpe import byte_characters
from infotraj.llm.common import free, sorted_runs, table, text_slices

#: Characters and texts of a block; chunks that a task remembers, and bytes of their groups' text.
BLOCK_CHARS, BLOCK_TEXTS, REMEMBERED, REMEMBERED_TEXT = 8 << 20, 1 << 16, 300_000, 64 << 20
#: Characters from which a chunk goes to the tokenizer that merges long words in n log n.
SLOW = 512
#: The pre-tokenizer of byte-level BPE files (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD = re.compile(r"\s ")
CODED = "block long, place int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, key string, df long, places binary, times binary"


class Aligner:
    """Tokenizer A (byte-level BPE, JSON text) and B (sentencepiece, model bytes) side by side."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(a_json)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        pre = spec["pre_tokenizer"]
        if spec.get("normalizer") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or made != sorted(made):
            raise ValueError("not a plain byte-level BPE file whose ids follow its merges")
        byte = {c: b for b, c in enumerate(byte_characters())}
        added = {t["content"] for t in spec["added_tokens"]}
        a_bytes = {i: bytes(map(byte.__getitem__, s)) for s, i in vocab.items() if s not in added}
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={b: i for i, b in a_bytes.items()}, special_tokens={})
        self.slow = Tokenizer.from_str(a_json)
        self.slow.encode_special_tokens = True
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)  # no piece goes on over a blank
        top = max(a_bytes) + 1
        self.a_bytes, self.b_bytes = [a_bytes.get(i, b"") for i in range(top)], b_bytes
        self.a_size, self.b_size = np.fromiter(map(len, self.a_bytes), np.int64), np.fromiter(map(len, b_bytes), np.int64)
        self.a_text = [np.array([f"{i}{c}" for i in range(top)], dtype=object) for c in ",|"]
        self.b_text = [np.array([f"{i}{c}" for i in range(len(pieces))], dtype=object) for c in ",;"]

    def chunks(self, text: str) -> list[str]:
        """Parts of blank+text, each without its first blank, between which both tokenizers always cut."""
        if not self.apart:
            return [text]
        parts = text.split(" ")
        if text[:1] != " " and text[-1:] != " " and "  " not in text and not _ODD.search(text):
            return parts
        out = parts[:1]
        for p in parts[1:]:
            if not out[-1] or out[-1][-1].isspace():  # a blank after a blank, or after other white space, is no safe place
                out[-1] += " " + p
            else:
                out.append(p)
        if not out[-1]:  # one blank at the end stands with what is before it
            out.pop()
            out[-1] += " "
        return out

    def encode_a(self, text: str) -> list[int]:
        return self.fast.encode_ordinary(text) if len(text) < SLOW else self.slow.encode(text, add_special_tokens=False).ids

    def align(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """For each word after a blank: tokens of A (-1: not given back) and B, number of groups; and all groups' keys in a row."""
        a, b = [self.encode_a(" " + w) for w in words], self.sp.encode(words) if words else []
        for k, w in enumerate(words):
            raw = (" " + w).encode()
            if b"".join(map(self.a_bytes.__getitem__, a[k])) != raw or b"".join(map(self.b_bytes.__getitem__, b[k])) != raw:
                a[k], b[k] = [], []
        n_a, n_b = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
        i_a, i_b = np.fromiter(chain.from_iterable(a), np.int64, n_a.sum()), np.fromiter(chain.from_iterable(b), np.int64, n_b.sum())
        end_a, end_b = np.cumsum(self.a_size[i_a]), np.cumsum(self.b_size[i_b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        g_a, g_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        last_a, last_b = np.diff(g_a, append=len(both)) > 0, np.diff(g_b, append=len(both)) > 0
        text = np.empty(len(i_a) + len(i_b), dtype=object)
        text[np.arange(len(i_a)) + np.searchsorted(g_b, g_a, side="left")] = np.where(last_a, self.a_text[1][i_a], self.a_text[0][i_a])
        text[np.arange(len(i_b)) + np.searchsorted(g_a, g_b, side="right")] = np.where(last_b, self.b_text[1][i_b], self.b_text[0][i_b])
        groups = np.bincount(np.repeat(np.arange(len(words)), n_a)[last_a], minlength=len(words))
        keys = "".join(text.tolist())[:-1].split(";") if len(both) else []
        return np.where(n_a > 0, n_a, -1), n_b, groups, keys


def links_of(key: str, a_size: np.ndarray, b_size: np.ndarray) -> dict[tuple[int, int], int]:
    """A group's linked id pairs, and how often each is linked in it."""
    a, b = (list(map(int, side.split(","))) for side in key.split("|"))
    out: dict[tuple[int, int], int] = {}
    i = j = 0
    end_a, end_b = a_size[a[0]], b_size[b[0]]
    while True:
        pair = (a[i], b[j])
        out[pair] = out.get(pair, 0) + 1
        step_a, step_b = end_a <= end_b, end_b <= end_a
        if step_a:
            i += 1
            if i == len(a):
                return out
            end_a += a_size[a[i]]
        if step_b:
            j += 1
            end_b += b_size[b[j]]


class _Interned:
    """A task's chunks and groups, numbered."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.known: dict[str, int] = {}
        self.keys: list[str] = []
        self.number: dict[str, int] = {}
        self.held = 0
        self.n_a, self.n_b, self.count, self.first, self.flat, self.text = [], [], [], [], [], []

    def learn(self, words: list[str]) -> None:
        n_a, n_b, groups, keys = self.aligner.align(words)
        at, ends = len(self.flat), np.cumsum(groups).tolist()
        number = self.number
        for k in keys:
            if k not in number:
                number[k] = len(self.keys)
                self.keys.append(k)
        self.flat += map(number.__getitem__, keys)
        before = 0
        for w, end in zip(words, ends, strict=True):
            self.known[w] = len(self.first)
            self.first.append(at + before)
            self.text.append(";".join(keys[before:end]))
            before = end
        self.held += sum(map(len, keys))
        self.n_a += n_a.tolist()
        self.n_b += n_b.tolist()
        self.count += groups.tolist()


def code_texts(df: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS, remembered: int = REMEMBERED) -> DataFrame:
    """Rows of texts (key null) and rows of groups in blocks of texts (doc columns null)."""
    context = df.sparkSession.sparkContext
    with open(a_path, encoding="utf-8") as fa, open(b_path, "rb") as fb:  # on the driver: files of the installation
        files = context.broadcast((fa.read(), fb.read()))
    names = [x.split()[0] for x in CODED.split(", ")]

    def rows(n: int, **cols: pa.Array) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(n, t) for c, t in zip(names, kinds, strict=True)], names=names)

    def postings(block: int, seen: _Interned, codes: list[np.ndarray], times: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        code, n = np.concatenate(codes), np.concatenate(times)
        order = np.argsort(code & 0xFFFFFFFF, kind="stable")  # texts stay in order
        code, n = code[order], n[order]
        distinct = np.flatnonzero(np.diff(code & 0xFFFFFFFF, prepend=-1))
        df_ = np.diff(np.append(distinct, len(code)))
        parts = -(-n // 255)  # a count beyond a byte takes several entries
        ends = np.append(0, np.cumsum(parts))
        place = np.repeat((code >> 32).astype(np.uint16), parts)
        byte = np.full(len(place), 255, dtype=np.uint8)
        byte[ends[1:] - 1] = n - 255 * (parts - 1)
        starts = np.append(ends[distinct], len(place)).astype(np.int32)
        keys = pa.array([seen.keys[g] for g in (code[distinct] & 0xFFFFFFFF).tolist()], pa.string())
        made = [pa.Array.from_buffers(pa.binary(), len(distinct), [None, pa.py_buffer((starts * w).astype(np.int32)), pa.py_buffer(x)]) for w, x in ((2, place), (1, byte))]
        yield rows(len(distinct), block=pa.array(np.full(len(distinct), block)), key=keys, df=pa.array(df_), places=made[0], times=made[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*files.value)
        seen, codes, times, held, place = _Interned(aligner), [], [], 0, 0
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, texts in text_slices(batch, "text", block_chars // 4):
                for at in range(0, len(texts), BLOCK_TEXTS):
                    some = texts[at : at + BLOCK_TEXTS]
                    if codes and (held > block_chars or place + len(some) > BLOCK_TEXTS):
                        yield from postings(block, seen, codes, times)
                        codes, times, held, place, block = [], [], 0, 0, block + 1
                    if not codes and (len(seen.known) > remembered or seen.held > REMEMBERED_TEXT):
                        seen = _Interned(aligner)
                    cut = [aligner.chunks(x) if x else [] for x in some]
                    new = list(set().union(*cut) - seen.known.keys())
                    seen.learn(new)
                    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
                    words = np.fromiter(map(seen.known.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
                    doc = np.repeat(np.arange(len(cut)), sizes)
                    n_a = np.array(seen.n_a, dtype=np.int64)[words]
                    lost = np.bincount(doc[n_a < 0], minlength=len(cut)) > 0
                    keep = ~lost[doc]
                    words, doc = words[keep], doc[keep]
                    count, first = np.array(seen.count, dtype=np.int64)[words], np.array(seen.first, dtype=np.int64)[words]
                    add = lambda x, of=doc, n=len(cut): np.bincount(of, weights=x, minlength=n).astype(np.int64)
                    group = np.array(seen.flat, dtype=np.int64)[np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
                    code, n = np.unique((np.repeat(doc, count) + place) << 32 | group, return_counts=True)
                    if code.size:
                        codes.append(code)
                        times.append(n)
                    digests, text = [], seen.text
                    ends = np.cumsum(np.where(lost, 0, sizes)).tolist()
                    whole = words.tolist()
                    for k, end in enumerate(ends):
                        mine = whole[ends[k - 1] if k else 0 : end]
                        digests.append(hashlib.sha256(";".join([text[w] for w in mine]).encode()).hexdigest() if mine else "")
                    yield rows(len(some), block=pa.array(np.full(len(some), block)), place=pa.array(np.arange(place, place + len(some)), pa.int32()), doc_id=part.column("doc_id").slice(at, len(some)),
                               n_a=pa.array(add(n_a[keep])), n_b=pa.array(add(np.array(seen.n_b, dtype=np.int64)[words])), n_groups=pa.array(add(count)), groups_sha256=pa.array(digests))
                    held += sum(map(len, some))
                    place += len(some)
        if codes:
            yield from postings(block, seen, codes, times)

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, CODED)


def pair_counts(links: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, count, best): documents that hold each linked pair of ids, and whether no pair of the same A id is in more."""

    def unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in sorted_runs(batches, ["a", "b", "block"]):
            out, ends = [], [*starts[1:].tolist(), t.num_rows]
            for s, e in zip(starts.tolist(), ends, strict=True):
                raw = t.column("places").slice(s, e - s).to_pylist()
                out.append(len(np.unique(np.frombuffer(b"".join(raw), np.uint16))))
            yield pa.RecordBatch.from_arrays([t.column("a").take(pa.array(starts)).combine_chunks(), t.column("b").take(pa.array(starts)).combine_chunks(), pa.array(out, pa.int64())], names=["a", "b", "count"])

    pairs = links.groupBy("a", "b").agg(F.count("*").alias("groups"), F.sum("df").alias("count"))
    several = links.join(pairs.where("groups > 1").select("a", "b"), ["a", "b"], "left_semi").groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    held = groups.select("key", "block", "places").join(several, "key").select("block", "places", F.explode("pairs").alias("p")).select("p.a", "p.b", "block", "places")
    shared = held.repartition("a", "b", "block").sortWithinPartitions("a", "b", "block").mapInArrow(unions, "a int, b int, count long")
    shared = shared.groupBy("a", "b").agg(F.sum("count").alias("count"))
    counts = table(pairs.where("groups = 1").select("a", "b", "count").unionByName(shared), "pair-counts")
    best = counts.groupBy("a").agg(F.max("count").alias("most"))
    out = counts.join(best, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    out.made = counts
    return out


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, remembered: int = REMEMBERED) -> tuple[DataFrame, DataFrame]:
    """(texts, pairs): doc_id, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum for each row of df; a, b, count, best for each linked pair of ids."""
    coded = table(code_texts(df, a_path, b_path, id_col, text_col, block_chars, remembered), "coded")
    groups = coded.where("key is not null").select("key", "block", "df", "places", "times")
    context = df.sparkSession.sparkContext
    with open(a_path, encoding="utf-8") as fa, open(b_path, "rb") as fb:
        own = Aligner(fa.read(), fb.read())
        sizes = context.broadcast((own.a_size, own.b_size))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_size, b_size = sizes.value
        for batch in batches:
            found = [links_of(k, a_size, b_size) for k in batch.column("key").to_pylist()]
            at = np.repeat(np.arange(len(found)), list(map(len, found)))
            flat = [x for f in found for x in f]
            cols = [batch.column("key").take(pa.array(at)), pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), pa.array([n for f in found for n in f.values()], pa.int64()), batch.column("df").take(pa.array(at))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "a", "b", "times", "df"])

    distinct = groups.groupBy("key").agg(F.sum("df").alias("df"))
    links = table(distinct.mapInArrow(expand, "key string, a int, b int, times long, df long"), "group-links")
    pairs = pair_counts(links, groups)
    sums = links.join(pairs, ["a", "b"]).groupBy("key").agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    sums = table(sums, "group-sums")
    free(links)
    names = ["n_links", "n_best", "count_sum"]
    texts = coded.where("key is null").select("block", "place", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    back = groups.select("key", "block", "places", "times").join(sums, "key").select(F.col("block").alias("of_block"), "places", "times", *names)

    def add_up(docs: pa.Table, held: pa.Table) -> pa.Table:
        place = docs.column("place").to_numpy()
        out = np.zeros((3, int(place.max(initial=-1)) + 1), dtype=np.int64)
        if held.num_rows:
            at = [np.frombuffer(b"".join(held.column(c).to_pylist()), kind).astype(np.int64) for c, kind in (("places", np.uint16), ("times", np.uint8))]
            entries = pa.compute.binary_length(held.column("times")).to_numpy()
            for k, c in enumerate(names):
                np.add.at(out[k], at[0], at[1] * np.repeat(held.column(c).to_numpy(), entries))
        cols = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")} | {c: pa.array(out[k][place]) for k, c in enumerate(names)}
        return pa.table(cols)

    kinds = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long"
    return texts.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(add_up, kinds), pairs


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
