"""Each stage of the pipeline against brute force, on nulls, empty and long texts, ties, repeated rows, clashing columns and no rows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_operators import SCHEMA, classes, empty, sentence

import corpus_pipeline
from infotraj.llm import bpe, mixing, quality


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def near_copies():
    rng = random.Random(17)
    out = []
    for n in (14, 40, 120, 400):
        for _ in range(12):
            words = sentence(rng, n).split()
            out.append(" ".join(words))
            for edits in range(1, max(2, n // 30)):
                again = list(words)
                for at in rng.sample(range(n), edits):
                    again[at] = f"new{rng.randrange(10**6)}"
                out.append(" ".join(again))
            out.append(" ".join(words[:-1]))
    rng.shuffle(out)
    return [*out, out[3], out[3].upper()]


def test_near_duplicates_at_similarity_four_fifths(spark):
    texts = near_copies()
    sets = [shingles(t) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 0.8 <= jaccard(sets[i], sets[j])]
    assert sum(jaccard(sets[i], sets[j]) < 0.95 for i, j in near) > 50
    links = set(near)
    group = classes(len(texts), lambda i, j: (i, j) in links)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t), 0, "s", "f", "l", 1, "h") for i, t in enumerate(texts)], SCHEMA)
    got = corpus_pipeline.without_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(group))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(23)
    texts = [sentence(rng, rng.randint(5, 80)) for _ in range(40)]
    texts += [None, "", " \n\t", sentence(rng, 7000), texts[3], texts[4] + " and more", "one line\n" + texts[5], "\n".join([texts[6], texts[6], "", texts[7]])]
    rows = [(i, t, "en", ["a", "b", None, "a"][i % 4], len(t or ""), -i, "s", "f", "l", 1, "h") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[8], rows[8], (None, texts[9], "en", "b", 0, 0, "s", "f", "l", 1, "h")], SCHEMA).cache()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_take_no_rows_and_keep_the_columns(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, empty(spark), SF)
        assert none.count() == 0
        assert name == "bpe_encoding" or none.columns == docs.columns == stage(spark, docs, SF).columns


def test_quality_stage_keeps_what_scores_enough(spark, docs):
    train = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(300)
    everything = docs.unionByName(train, allowMissingColumns=True)
    w = quality.train(everything, spark.read.parquet(f"{SF}/labels.parquet"), usable=~quality.held_out("key", 4, 2))
    wanted = [tuple(r) for r in everything.collect() if quality.score_text(r["text"] or "", w, {}) >= quality.THRESHOLD]
    got = rows_of(corpus_pipeline.good_quality(spark, everything, SF))
    assert got == sorted(wanted, key=repr) and 0 < len(got) < everything.count()


def test_line_stage_takes_later_lines_and_emptied_documents(spark, docs):
    seen, wanted, done = [], [], {}
    for r in sorted((r for r in docs.collect() if r["doc_id"] is not None), key=lambda r: r["doc_id"]):
        if r["doc_id"] not in done:
            kept = []
            for line in (r["text"] or "").split("\n"):
                words = [x for x in line.lower().replace("\t", " ").split(" ") if x]
                if len(words) >= 3:
                    s = frozenset(words)
                    if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                        seen.append(s)
                        continue
                    seen.append(s)
                kept.append(line)
            done[r["doc_id"]] = None if r["text"] is None else "\n".join(kept)
        text = done[r["doc_id"]]
        if text == r["text"]:
            wanted.append(tuple(r))
        elif text.split():
            wanted.append(tuple({**r.asDict(), "text": text, "n_chars": len(text)}[c] for c in docs.columns))
    wanted += [tuple(r) for r in docs.where("doc_id is null").collect()]
    got = rows_of(corpus_pipeline.without_repeated_lines(spark, docs, SF))
    assert got == sorted(wanted, key=repr) and len(got) < docs.count()


def test_near_duplicate_stage_keeps_one_of_each_group_and_all_rows_without_an_id(spark, docs):
    sets = {r["doc_id"]: shingles(r["text"] or "") if (r["text"] or "").split() else set() for r in docs.collect() if r["doc_id"] is not None}
    ids = sorted(sets)
    near = lambda i, j: (not sets[ids[i]] and not sets[ids[j]]) or (bool(sets[ids[i]] | sets[ids[j]]) and jaccard(sets[ids[i]], sets[ids[j]]) >= 0.8)
    group = classes(len(ids), near)
    keep = {ids[g] for g in group}
    got = rows_of(corpus_pipeline.without_near_duplicates(spark, docs, SF))
    assert got == sorted((tuple(r) for r in docs.collect() if r["doc_id"] is None or r["doc_id"] in keep), key=repr)
    assert len(keep) < len(ids)


def test_mixing_stage_lays_documents_end_to_end_up_to_each_target(spark, docs):
    rows = [r for r in corpus_pipeline.mixed(spark, docs, SF).collect()]
    target = {r["source"]: int(r["target"]) for r in mixing.taken(docs).select("source", "target").distinct().collect()}
    words = Counter()
    for r in rows:
        words[r["source"]] += len((r["text"] or "").split())
        assert r["text"].split()
    assert dict(words) == {s: t for s, t in target.items() if t}
    whole = {(r["doc_id"], r["source"]): r["text"] for r in docs.collect()}
    cut = [r for r in rows if r["text"] != whole[r["doc_id"], r["source"]]]
    assert len(cut) <= len(target) and all(whole[r["doc_id"], r["source"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in cut)
    sizes = Counter()
    copies = defaultdict(int)
    for r in docs.collect():
        sizes[r["source"]] += len((r["text"] or "").split())
        copies[r["doc_id"], r["source"]] += bool((r["text"] or "").split())
    times = Counter((r["doc_id"], r["source"]) for r in rows)
    for key, n in copies.items():  # each row as often as its source's target holds its source, give or take one
        often = target[key[1]] / sizes[key[1]]
        assert n * int(often) <= times[key] <= n * -int(-often // 1)


def test_bpe_stage_encodes_like_the_library(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    wanted = sorted(((r["doc_id"], t.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()), key=repr)
    got = corpus_pipeline.encoded(spark, docs, SF).collect()
    assert sorted(((r["doc_id"], list(r["ids"])) for r in got), key=repr) == wanted
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    read = {r["id"]: r["decoded"] for r in bpe.encode(docs.where("doc_id is not null"), bpe.vocabulary_path()).collect()}
    assert all(read[i] == t.decode(ids, skip_special_tokens=False) for i, ids in wanted if i is not None)


def test_run_applies_the_stages_in_order(spark, tmp_path):
    part = spark.read.parquet(f"{SF}/documents.parquet").limit(250)
    part.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert sorted(map(tuple, got)) == sorted(map(tuple, docs.collect())) and got
    assert docs.agg(F.max("n_tokens")).first()[0] > 0
