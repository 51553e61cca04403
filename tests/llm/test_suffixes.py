"""Suffix-array dedup against a dictionary of all 50-byte strings, and its transforms against plainly sorted suffixes."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from infotraj.llm import suffixes

NONE = 1 << 63


def plain(rows, span=50):
    first: dict[bytes, int] = {}
    docs = [(NONE if i is None else i, (x or "").encode()) for i, x in rows]
    for d, b in docs:
        for k in range(len(b) - span + 1):
            w = b[k : k + span]
            first[w] = min(d, first.get(w, d))
    out = []
    for (i, _), (d, b) in zip(rows, docs, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if first[b[k : k + span]] < d:
                gone[k : k + span] = b"\1" * span
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def order(r):
    return r[0] is None, r[0] or 0, r


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, x, "x") for i, x in rows], "doc_id long, text string, block string").repartition(4)
    return sorted((tuple(r) for r in suffixes.dedup_bytes(df, **how).collect()), key=order)


def texts():
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, other = letters(140), letters(70)
    rows = [(i, letters(rng.randint(0, 300)) + (passage if i % 3 == 0 else "") + letters(rng.randint(0, 80)) + (other[: 45 + i % 9] if i % 4 == 1 else "")) for i in range(60)]
    rows += [(100 + i, x) for i, (_, x) in enumerate(rows[:12])] + [(200, rows[3][1]), (200, rows[3][1]), (None, rows[6][1]), (None, rows[6][1] + "more")]
    rows += [(300, None), (301, ""), (302, "a" * 3000), (303, "b" + "a" * 2000 + "ü" * 500), (304, "ab" * 700), (305, "ba" * 300 + "\0" * 200), (306, "x" * 50), (307, "x" * 49), (308, "yx" + "x" * 49)]
    return rows + [(400 + i, passage[: 20 + i] + letters(60)) for i in range(60)] + [(-5, passage[20:90])]


@pytest.mark.parametrize("how", [{}, {"block_bytes": 900, "bucket_bytes": 1500, "heavy_bytes": 300}, {"block_bytes": 5000, "bucket_bytes": 700}])
def test_removed_bytes_are_those_of_all_strings_compared(spark, how):
    rows = texts()
    assert found(spark, rows, **how) == sorted(plain(rows), key=order)


def test_query_gives_what_its_sql_gives(same_as_sql):
    same_as_sql(suffixes.op12_suffixes, suffixes.OP12_SQL)


def test_what_is_kept(spark):
    df = spark.createDataFrame([(1, "s" * 10 + "0123456789" * 6), (2, "0123456789" * 6 + "tail"), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: r.kept and bytes(r.kept) for r in suffixes.dedup_bytes(df, kept_text=True).collect()}
    assert got[1].startswith(b"ssssssssss01") and got[2] == b"tail" and got[3] is None
    assert suffixes.dedup_bytes(df.limit(0)).collect() == []


def suffix_rows(strings):
    return sorted((s[k:], i) for i, s in enumerate(strings) for k in range(len(s) + 1))


def strings_of(rng, n):
    return [bytes(rng.choice(b"\0ab\xc3") for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_a_shards_transform_is_that_of_its_sorted_suffixes():
    strings = [*strings_of(random.Random(1), 40), b"abab", b"abab", b"\0", b"\0\0\0"]
    shard, rows = suffixes.Shard(strings), suffix_rows(strings)
    assert list(zip(shard.left.tolist(), shard.string.tolist(), strict=True)) == [(len(s), i) for s, i in rows]
    whole = [strings[i] for _, i in rows]
    assert shard.last.tolist() == [w[len(w) - len(s) - 1] + 1 if len(s) < len(w) else 0 for (s, _), w in zip(rows, whole, strict=True)]
    at = {r: k for k, r in enumerate(zip(shard.string.tolist(), shard.left.tolist(), strict=True))}
    assert all(b == (at[i, n + 1] if c else -1) for b, c, i, n in zip(shard.back.tolist(), shard.last.tolist(), shard.string.tolist(), shard.left.tolist(), strict=True))


@pytest.mark.parametrize("span", [1, 3, 7, 40])
def test_merged_rows_part_where_their_first_bytes_differ(span):
    rng = random.Random(span)
    groups = [strings_of(rng, n) for n in (30, 1, 12, 25)]
    shards = [suffixes.Shard(g) for g in groups]
    rows, interval = suffixes.repeated_intervals(shards, span)
    all_rows = [(g[i][len(g[i]) - n :], len(g[i])) for g, s in zip(groups, shards, strict=True) for i, n in zip(s.string.tolist(), s.left.tolist(), strict=True)]
    assert sorted(rows.tolist()) == list(range(len(all_rows)))
    heads = [all_rows[r][0][:span] for r in rows.tolist()]
    assert [h for h in heads if len(h) == span] == sorted(h for h in heads if len(h) == span)
    by: dict[int, set] = {}
    for k, h in zip(interval.tolist(), heads, strict=True):
        by.setdefault(k, set()).add(h)
    long = [h for hs in by.values() for h in hs if len(h) == span]
    assert all(len(hs) == 1 for hs in by.values() if any(len(h) == span for h in hs)) and len(long) == len(set(long))


def test_least_documents_of_all_strings():
    rng = random.Random(9)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(3, 20))) for _ in range(200)]
    doc = np.array([rng.randint(-5, 50) for _ in strings])
    first: dict[bytes, int] = {}
    for s, d in zip(strings, doc.tolist(), strict=True):
        for k in range(len(s) - 5):
            first[s[k : k + 6]] = min(d, first.get(s[k : k + 6], d))
    got = suffixes.least_documents(strings, doc, 6, 150)
    assert [x.tolist() for x in got] == [[first[s[k : k + 6]] for k in range(len(s) - 5)] for s in strings]


def test_anchors_depend_on_the_string_alone():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 4000).astype(np.uint8)
    own = suffixes.string_anchors(data)
    assert all(suffixes.string_anchors(data[k : k + 50])[0] == own[k] for k in range(0, 3950, 37))
    ends = np.array([1000, 1000, 1049, 1100, 4000])
    h, text, first, n = suffixes.stretches(data, ends)
    got = {(int(t), int(f) + k) for t, f, c in zip(text, first, n, strict=True) for k in range(int(c))}
    assert got == {(0, k) for k in range(951)} | {(3, 0), (3, 1)} | {(4, k) for k in range(2851)} and n.max() <= suffixes.STRETCH


@pytest.mark.parametrize("span", [1, 2, 5, 8])
def test_merging_rows_of_whole_strings_alone_gives_what_merging_all_rows_gives(span):
    rng = random.Random(span)
    shards = [suffixes.Shard([*strings_of(rng, n), b"ab" * 9]) for n in (30, 1, 12)]
    rows, interval = suffixes.string_intervals(shards, span)
    left = np.concatenate([s.left for s in shards])
    every, parts = suffixes.repeated_intervals(shards, span)
    groups = lambda r, k: sorted(sorted(r[k == x].tolist()) for x in set(k.tolist()))
    long = left[every] >= span
    assert groups(rows, interval) == groups(every[long], parts[long]) and len(rows) < len(every)


def test_shared_anchors_come_in_few_rows(spark):
    rng = random.Random(4)
    letters = "".join(rng.choice("abcdefgh") for _ in range(70_000))
    df = spark.createDataFrame([(1, letters), (2, "x" + letters), (3, letters[::-1])], "doc_id long, text string")
    _, texts = suffixes.distinct_texts(df.coalesce(1), "doc_id", "text", 1 << 20)
    rows = suffixes.shared_anchors(texts).collect()
    got = np.concatenate([np.frombuffer(r.hashes, np.int64) for r in rows])
    mine, _, _, _ = suffixes.stretches(np.frombuffer(letters.encode(), np.uint8), np.array([len(letters)]))
    assert {*mine.tolist()} <= {*got.tolist()} and len({*got.tolist()}) < 1.01 * len({*mine.tolist()})
    blocks = texts.select("block").distinct().count()
    assert len(rows) <= blocks * suffixes.MEET < blocks * len({*mine.tolist()})


def test_split_anchors_are_found_without_shuffling_segments(spark):
    df = spark.createDataFrame([(i, x) for i, x in texts()], "doc_id long, text string")
    _, long = suffixes.distinct_texts(df, "doc_id", "text", 5000)
    cut = suffixes.table(suffixes.segments(long, suffixes.shared_anchors(long)), "cut").where("seg is not null").select("block", "seg", "hash", "lo", "hi", "bytes")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = suffixes.least_by_segment(cut, 1500, 300)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
