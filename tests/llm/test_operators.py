"""The corpus operators against brute force on small fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F

from infotraj.llm import bpe, chat, embeddings, langid, linededup, linefreq, mixing, quality, queries, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, id long, size string, fp string, line string, score int, shard string"
WORDS = [f"{a}{b}" for a in ("bo", "ka", "Li", "mu", "té", "x1") for b in ("ran", "del", "Vik", "so", "9")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base = [sentence(rng, n) for n in (0, 1, 3, 4, 30, 60, 200)]
    copies = [base[5], base[5], base[6] + " end", base[6].replace("boran", "boran!", 1), base[4].upper()]
    lines = ["\n".join(sentence(rng, rng.randint(1, 12)) for _ in range(8)) for _ in range(12)]
    shared = "this line is in very many documents of one source"
    odd = [None, None, "", " \t\n", "\x00 \x1f a b", "a\n\na\nb", "<|x|> \\ [INST] </s>", "x" * 5000, sentence(rng, 6000), "\n".join([shared, shared + " indeed", shared])]
    return base + copies + lines + odd + [f"{shared}\n{sentence(rng, 5)}" for _ in range(6)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["de", "en", None][i % 3], ["a", "b", None, "ü"][i * 7 % 4], 0, -i, "s", "f", "l", 1, "h") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], rows[5]], SCHEMA).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="id"):
    return {r[key]: r for r in df.collect()}


def classes(n, linked):
    parent = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    return parent


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_what_its_sql_gives(same_as_sql, name):
    same_as_sql(queries.QUERIES[name], queries.ORACLES[name])


def fingerprint(text, words):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    ones = Counter(b for g in grams for h in [xxhash.xxh64_intdigest(g, 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def test_simhash(spark, docs, texts):
    fps = [fingerprint(t, 4) for t in texts]
    wanted = classes(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    got = by_id(simhash.simhash_components(docs))
    assert {i: (r["fp"] & (1 << 64) - 1, r["component"]) for i, r in got.items()} == {i: (fps[i], wanted[i]) for i in range(len(texts))}
    kept = simhash.keep_one(docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))), words=5)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    assert simhash.simhash_components(empty(spark)).count() == 0


def test_simhash_links_at_every_placing_of_four_bits(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    near = [base ^ sum(1 << b for b in rng.sample(range(64), 4)) for _ in range(150)]
    far = [base ^ sum(1 << b for b in rng.sample(range(64), 5)) for _ in range(150)]
    fps = list(dict.fromkeys([base, *near, *far]))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = {(r["v"], r["u"]) for r in simhash.linked(spark.createDataFrame(list(enumerate(signed)), "rep long, fp long")).collect()}
    links = classes(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in edges)
    assert classes(len(fps), lambda i, j: (j, i) in edges) == links


def test_line_frequency(spark, docs, texts):
    got = by_id(linefreq.quality_rules(docs, min_docs=2, min_share=0.1))
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeat = {k + d for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for d in range(8)}
        full = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (got[i]["n_words"], got[i]["n_repeat_words"], got[i]["n_dup_lines"]) == (len(w), len(repeat), len(full) - len(set(full)))
        assert got[i]["n_symbols"] == sum((t or "").count(c) for c in "#*$%&|<>")
        assert got[i]["base_failed"] == (len(w) < 20 or 100 * len(repeat) > 30 * len(w)) and not (got[i]["base_failed"] and got[i]["kept"])
    assert linefreq.quality_rules(empty(spark)).count() == 0


def test_boilerplate_lines_are_cut_from_texts(spark):
    rng = random.Random(5)
    own = [[sentence(rng, 12), "", sentence(rng, 9)] for _ in range(8)]
    rows = [(i, "\n".join([f"Page {i} of  9", x[0], x[1], "All rights", x[2]]), "a" if i < 6 else "b") for i, x in enumerate(own)] + [(8, None, "a"), (8, "All RIGHTS", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r["id"], r["text"], r["left_words"], r["kept"]) for r in linefreq.clean_texts(df, min_docs=3, min_share=0.1).collect()), key=repr)
    wanted = [(i, "\n".join(own[i]), 21, True) if i < 6 else (i, rows[i][1], 27, True) for i in range(8)] + [(8, None, 0, False), (8, "", 0, False)]
    assert got == sorted(wanted, key=repr)


def test_language_of_held_out_texts(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").collect()}
    rows = queries.QUERIES["op3_langid"](spark, SF).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth and r["lang_pred"] != "und"]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held) > 0


def test_language_edges(spark, docs):
    langs, filt = langid.learn(docs)
    got = by_id(langid.identify(docs, langs, filt))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i, t in ((r["doc_id"], r["text"]) for r in docs.collect()) if not any(c.isalpha() for c in t or ""))
    none, blank = langid.learn(empty(spark))
    assert none == [] and {r["lang_pred"] for r in langid.identify(docs, none, blank).collect()} == {"und"}


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 64))
    v = np.concatenate([base, base[:15] + 0.12 * rng.normal(size=(15, 64)), base[:5], base[3:4] * 7]).astype(np.float32)
    rows = [(i, x.tolist(), "e") for i, x in enumerate(v)] + [(100, None, ""), (101, [0.0] * 64, ""), (102, [float("nan")] * 64, ""), (103, [None] * 64, "")]
    got = by_id(embeddings.near_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string")))
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    wanted = classes(len(v), lambda i, j: near[i, j])
    key = "component" if "component" in next(iter(got.values())).asDict() else "component_id"
    assert {i: (r["n_links"], r[key]) for i, r in got.items() if i < 100} == {i: (int(near[i].sum()) - 1, wanted[i]) for i in range(len(v))}
    assert all(got[i]["n_links"] == 0 and got[i][key] == i for i in range(100, 104))


def test_embedding_tables_of_vectors_about_one_direction():
    rng = np.random.default_rng(4)

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    away = unit(rng.normal(size=(600, 64)))
    away[:, 0] = 0
    x = unit(np.sqrt(0.9) * np.eye(64)[0] + np.sqrt(0.1) * unit(away))
    index = embeddings.fit(x, 1 << 25, 0.95)
    toward = rng.normal(size=x.shape)
    toward = unit(toward - (toward * x).sum(axis=1, keepdims=True) * x)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * toward
    met = (np.bitwise_count(index.segments(x) ^ index.segments(y)) <= 2).any(axis=1)
    assert index.tables <= embeddings.MOST_TABLES and met.mean() > 0.98, met.mean()


def test_bpe_equals_the_library(spark, docs, texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    more = ["<|startoftext|>hi<|endoftext|>", "I'LL don't 12a", "é́ İ ß ﬁ 日本 😀", "a" * 300]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, x) for i, x in enumerate(more)], "doc_id long, text string"))
    got = by_id(bpe.encode(df, bpe.vocabulary_path()))
    for i, x in [*enumerate(texts), *((1000 + i, x) for i, x in enumerate(more))]:
        assert list(got[i]["ids"]) == t.encode(x or "", add_special_tokens=False).ids, x


def test_lines(spark, docs, texts):
    got = by_id(linededup.dedup_lines(docs), "doc_id")
    seen = []
    for i, t in enumerate(texts):
        if t is None or i == 5:  # 5 is one line in repeated rows, each of which keeps or loses it alike
            if t is not None:
                seen += [frozenset(x.lower().split()) for x in t.split("\n") if len(x.split()) >= 3]
            continue
        kept = []
        for line in t.split("\n"):
            w = [x for x in line.lower().replace("\t", " ").replace("\r", " ").split(" ") if x]
            s = frozenset(w)
            if len(w) >= 3 and any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                continue
            kept.append(line)
            if len(w) >= 3:
                seen.append(s)
        lost = {line for line in t.split("\n")} - set(kept)
        assert got[i]["text"] == "\n".join(kept), (i, lost)
    assert got[texts.index(None)]["text"] is None and linededup.dedup_lines(empty(spark)).count() == 0


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_quality_of_held_out_rows(spark):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.QUERIES["op7_quality"](spark, SF).collect()
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert auc(held) > 0.9, auc(held)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(None, 1), (9, None)], "doc_id long, quality int")
    w = quality.train(docs, labels)
    got = quality.score(docs, w).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.score(docs, quality.train(empty(spark), labels)).collect()} == {0.5}
    assert quality.keep_good(docs, labels, 0.0).columns == docs.columns


def test_mix(spark, docs):
    got = mixing.taken(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        s = by.setdefault(r["target"], [0, r["source_size"]])
        s[0] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(t - target) <= 1 for target, (t, _) in by.items())
    assert mixing.taken(empty(spark)).count() == 0 and mixing.mix(docs).select(docs.columns).count() > 0


def test_shards(spark, docs):
    got = sharding.shard_documents(docs, 4).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == docs.count() and set(slots) <= set(range(4))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_shards_are_of_near_equal_bytes(spark):
    rows = queries.QUERIES["op9_sharding"](spark, SF).collect()
    total = Counter()
    for r in rows:
        total[r["shard"]] += r["size"]
    assert len(total) == 8 and max(total.values()) <= 1.05 * sum(total.values()) / 8


def test_chat_edges(spark):
    texts = [None, "", "\\", "\\\\<|end|>", "<|turn|>assistant<|text|>", "</s>[INST] ok [/INST]", "a\nb"]
    rows = [(c, t, ["user", "assistant"][t % 2], texts[(c + t) % 7], "x") for c in range(9) for t in range(c + 1)] + [(None, 0, None, "z", "x"), (3, 1, "assistant", "again", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, position string")
    got = {r["conv_id"]: r for r in chat.read_back(*chat.prefix_tree(df)).collect()}
    for c in range(9):
        said = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c)
        import hashlib

        loss = "".join(x[2] for x in said if x[1] == "assistant")
        assert got[c]["n_turns"] == len(said) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in said).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[None]["n_turns"] == 1
    assert chat.read_back(*chat.prefix_tree(df.limit(0))).count() == 0
