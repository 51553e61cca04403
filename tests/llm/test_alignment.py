"""Cross-tokenizer alignment against the two libraries and a plain walk over all token pairs."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from conftest import SF
from pyspark.sql import functions as F

from infotraj.llm import alignment
from infotraj.llm.bpe import byte_characters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "  x", "a  b   c", " lead", "tail ", " ", "  ", " \n x", "x \n y", "x\n \n y", "a▁b", "<|endoftext|> <s> x</s>", "a　 b", "b" * 3000 + " " + "xyz" * 700, None, "x\ty \t z", "é ẛ̣", "日本語 テキスト", "aaaa aaaa " * 400 + "a" * 700, "it's we'll  don't ", "x\x1c y\x85 z  w", "a\0b"]


def plain(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    t, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    byte = {c: b for b, c in enumerate(byte_characters())}
    docs = []
    for x in texts:
        raw = (" " + (x or "")).encode()
        a, b = t.encode(" " + (x or ""), add_special_tokens=False).ids, sp.encode(x or "")
        one = [bytes(map(byte.__getitem__, t.id_to_token(i))) for i in a]
        two = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not x or b"".join(one) != raw or b"".join(two) != raw:
            docs.append(None)
            continue
        ends = [np.cumsum(list(map(len, s))).tolist() for s in (one, two)]
        cuts, groups, links = sorted({*ends[0]} & {*ends[1]}), [], []
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            groups.append(",".join(str(i) for i, e in zip(a, ends[0], strict=True) if lo < e <= hi) + "|" + ",".join(str(i) for i, e in zip(b, ends[1], strict=True) if lo < e <= hi))
        i = j = 0
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            i, j = i + (ends[0][i] <= ends[1][j]), j + (ends[1][j] <= ends[0][i])
        docs.append((len(a), len(b), ";".join(groups), len(groups), links))
    count = Counter(p for d in docs if d for p in set(d[4]))
    best: Counter = Counter()
    for (a, _), c in count.items():
        best[a] = max(best[a], c)
    rows = [(d[0], d[1], d[3], hashlib.sha256(d[2].encode()).hexdigest(), len(d[4]), sum(count[p] == best[p[0]] for p in d[4]), sum(count[p] for p in d[4])) if d else (0, 0, 0, "", 0, 0, 0) for d in docs]
    return rows, count


def aligned(df, **how):
    texts, pairs = alignment.align(df, A, B, **how)
    got = [(r.doc_id, (r.n_a, r.n_b, r.n_groups, r.groups_sha256, r.n_links, r.n_best, r.count_sum)) for r in texts.collect()]
    return got, {(r.a, r.b): r["count"] for r in pairs.collect()}


def test_links_groups_and_counts_are_the_plain_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy(F.length("text")).limit(150).select("doc_id", "text").collect()
    rows = [tuple(r) for r in docs] + [(10**6 + i, x) for i, x in enumerate([*ODD, "again and again"])] + [(10**6, "again and again"), (None, "the same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("block", F.lit(1)).repartition(4)
    got, pairs = aligned(df)
    wanted, count = plain([x for _, x in rows])
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted(zip([i for i, _ in rows], wanted, strict=True), key=order)
    assert pairs == dict(count)


def test_blocks_and_forgetting_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").limit(200).select("doc_id", "text").collect()
    rows = [tuple(r) for r in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert alignment.code_texts(df, A, B, "doc_id", "text", 20_000).agg(F.countDistinct("block")).first()[0] > 5
    got, pairs = aligned(df, block_chars=20_000, remembered=300)
    wanted, count = plain([x for _, x in rows])
    assert sorted(got) == sorted(zip([i for i, _ in rows], wanted, strict=True))
    assert pairs == dict(count)


def test_parts_of_the_method():
    own = alignment.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    seen = alignment._Interned(own)
    seen.learn(["the", "retokenised", ""])
    assert [own.encode_a(" the")] == [[262]] and seen.n_a[0] == 1 and seen.count[0] == 1
    assert alignment.links_of("1,2|3,4", np.array([0, 1, 2]), np.array([0, 0, 0, 2, 1])) == {(1, 3): 1, (2, 3): 1, (2, 4): 1}
    for x in ODD:
        assert " ".join(own.chunks(x)) == x if x else True


def test_empty_table_gives_no_rows(spark):
    assert aligned(spark.createDataFrame([], "doc_id long, text string")) == ([], {})
