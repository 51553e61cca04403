"""The methods of the operators against plain versions, and cases that have lost rows before."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from conftest import SF
from pyspark.sql import functions as F
from test_operators import classes, sentence

from infotraj.llm import chat, common, embeddings, langid, linededup, linefreq, mixing, quality, queries, sharding


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def links_of(spark, rows):
    got = embeddings.near_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    return sorted(((r["id"], r["n_links"], r["component"]) for r in got), key=lambda r: (r[0] is None, r))


def brute_links(vectors):
    """n_links and components of a list of unit vectors numbered by place."""
    near = vectors @ vectors.T >= 0.95
    return near, classes(len(vectors), lambda i, j: near[i, j])


def test_vectors_of_one_dense_group_all_link(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([unit(np.eye(64)[0] + 0.02 * unit(rng.normal(size=(3000, 64)))), unit(rng.normal(size=(500, 64)))])
    got = links_of(spark, [(i, x.tolist()) for i, x in enumerate(v)])
    assert got == [(i, 2999, 0) if i < 3000 else (i, 0, i) for i in range(3500)]


def test_vectors_about_a_dense_group_link_as_compared(spark):
    rng = np.random.default_rng(2)
    spread = np.concatenate([rng.uniform(0.02, 0.3, 900), rng.uniform(0.3, 0.6, 600)])
    v = unit(np.eye(32)[0] + spread[:, None] * unit(rng.normal(size=(1500, 32))))
    near, _ = brute_links(v)
    got = links_of(spark, [(i, x.tolist()) for i, x in enumerate(v)])
    wanted = int(near.sum()) - len(v)
    found = sum(n for _, n, _ in got)
    assert 0.98 * wanted <= found <= wanted, found / wanted
    assert all(n <= near[i].sum() - 1 for i, n, _ in got)


def test_separate_pairs_at_the_threshold_are_found(spark):
    rng = np.random.default_rng(3)
    x = unit(rng.normal(size=(1500, 64)))
    toward = rng.normal(size=x.shape)
    toward = unit(toward - (toward * x).sum(axis=1, keepdims=True) * x)
    c = rng.uniform(0.9501, 0.97, 1500)[:, None]
    y = c * x + np.sqrt(1 - c * c) * toward
    got = {i: (n, top) for i, n, top in links_of(spark, [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))])}
    recall = sum(got[1500 + i] == (1, i) for i in range(1500)) / 1500
    assert recall >= 0.99, recall


def test_vectors_of_repeated_ids_and_of_several_lengths_count(spark):
    a, b = np.eye(8)[0], np.eye(8)[1]
    rows = [(1, a), (1, b), (2, a + 0.01 * np.eye(8)[2]), (3, b + 0.01 * np.eye(8)[2]), (4, np.ones(3)), (5, np.ones(3)), (6, np.ones(5)), (2, a)]
    got = links_of(spark, [(i, x.tolist()) for i, x in rows] + [(None, a.tolist()), (7, [])])
    assert got == [(1, 1, 1), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 1, 1), (4, 1, 4), (5, 1, 4), (6, 0, 6), (7, 0, 7), (None, 0, None)]


def test_lines_of_rows_that_share_an_id(spark):
    said = "alpha beta gamma delta eps"
    other = "wholly unrelated text that nobody else has"
    rows = [(1, said, "x"), (2, other, "y"), (2, said, "z"), (None, said, "n"), (3, said, "r"), (3, said, "r"), (4, f"{other} too\none two\none two", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    got = sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in linededup.dedup_lines(df).collect())
    assert got == sorted([("1", said, 0), ("2", other, 0), ("2", "", 1), ("None", said, 0), ("3", "", 1), ("3", "", 1), ("4", "one two\none two", 1)])
    named = df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert sum(r["n_removed"] for r in linededup.dedup_lines(named).collect()) == 4
    short = linededup.dedup_lines(df.where("doc_id = 4"), min_words=1).collect()[0]
    assert (short["text"], short["n_removed"]) == (f"{other} too\none two", 1)


def test_similar_long_lines_go(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(260)]
    texts = [" ".join(base)]
    for kept in (250, 235, 233, 231, 229, 225):  # of 260 words, in sets that replace the others
        texts.append(" ".join([*base[:kept], *(f"n{rng.randrange(10**6)}" for _ in range(260 - kept))]))
    sets = [frozenset(t.split()) for t in texts]
    wanted = [any(5 * len(s & o) >= 4 * len(s | o) for o in sets[:i]) for i, s in enumerate(sets)]
    got = linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["n_removed"] == 1 for r in sorted(got, key=lambda r: r["doc_id"])] == wanted and {*wanted} == {True, False}


def test_words_of_lines_are_split_once_for_sets_and_ranks(spark):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        reads.add(1)
        return text

    said = "alpha beta gamma delta eps zeta"
    rows = [(1, said), (2, f"{said} eta\nother words that nobody has"), (3, "one two three four"), (4, None), (5, said)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", told.asNondeterministic()("text").alias("text"))
    assert sorted((r["doc"], r["no"]) for r in linededup.similar_lines(df).collect()) == [(2, 0), (5, 0)]
    assert reads.value == 2 * len(rows)  # for the sets, and for the texts of candidates


def test_prefixes_of_repeated_lines_are_not_written(spark, monkeypatch):
    written = {}

    def told(df, name):
        out = common.table(df, name)
        written.setdefault(name, (out.columns, out.count()))
        return out

    monkeypatch.setattr(linededup, "table", told)
    texts = ["one line that all rows hold\n" + f"own words a{i} b{i} c{i} d{i}" for i in range(20)]
    lost = linededup.similar_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted((r["doc"], r["no"]) for r in lost.collect()) == [(i, 0) for i in range(1, 20)]
    assert {n for columns, n in written.values() if "prefix" in columns} == {21}  # sets, of 40 lines


def test_lines_whose_words_begin_late_have_them_counted(spark):
    lines = [" " * 100 + "a b c", "x" * 90 + " b c", "x" * 90 + " b ", "a b" + " " * 100, "a b" + "\t" * 100 + "c", "é" * 47 + " b c", "", "a b c"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r[0] for r in df.select(linededup.has_words(F.col("line"), 3)).collect()] == [len(x.split()) >= 3 for x in lines]


def test_codes_sort_rare_words_first_and_tell_all_hashes_apart(spark):
    lines = [" ".join(f"w{j}" for j in range(i, 30)) for i in range(30)]  # w29 is in all, w0 in one
    sets = spark.createDataFrame([(x,) for x in lines], "line string").select(linededup.set_of(F.col("line")).alias("set"))
    ranks = linededup.rarity(sets)
    rows = sets.select("set", linededup.codes_of(F.col("set"), ranks).alias("codes")).collect()
    counts = Counter(h for r in rows for h in r["set"])
    place = {}
    for r in rows:
        assert len({*r["codes"]}) == len(r["set"]) and {c & (1 << 48) - 1 for c in r["codes"]} == {h & (1 << 48) - 1 for h in r["set"]}
        place |= {h: next(c for c in r["codes"] if c & (1 << 48) - 1 == h & (1 << 48) - 1) for h in r["set"]}
    by_code = sorted(counts, key=place.get)
    assert [counts[h] for h in by_code] == sorted(counts.values())


def test_lines_above_the_limits_go_and_depleted_documents_are_rejected(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        host = ["a", "b", None][i % 3]
        own = [sentence(rng, rng.randint(8, 20)) for _ in range(rng.randint(0, 4))]
        foot = [f"Copyright {i} of host {host} and all of its many friends", "follow us here and there and everywhere you may go", "menu home about contact news shop help terms and more"]
        rows.append((i, "\n".join([*foot[: rng.randint(1, 3)], *own, " "]), host))
    rows += [(200 + i, rows[5][1], rows[5][2]) for i in range(40)]  # copies of one text count once
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts = defaultdict(dict)
    for _, t, h in rows:
        texts[h][t] = {linefreq.normal(x) for x in t.split("\n") if x.strip()}
    above = {h: {x for x, n in Counter(y for lines in d.values() for y in lines).items() if n > 15 and n > 0.3 * len(d)} for h, d in texts.items()}
    cleaned = {r["id"]: r for r in linefreq.clean_texts(df, min_docs=15, min_share=0.3).collect()}
    counted = {r["id"]: r for r in linefreq.quality_rules(df, min_docs=15, min_share=0.3).collect()}
    verdicts = Counter()
    for i, t, h in rows:
        left = "\n".join(x for x in t.split("\n") if not x.strip() or linefreq.normal(x) not in above[h])
        kept = not counted[i]["base_failed"] and len(left.split()) >= 0.3 * len(t.split())
        assert (cleaned[i]["text"], cleaned[i]["left_words"], cleaned[i]["kept"]) == (left, len(left.split()), kept)
        assert {k: v for k, v in cleaned[i].asDict().items() if k != "text"} == counted[i].asDict()
        verdicts[counted[i]["base_failed"], kept] += 1
    assert verdicts[False, True] and verdicts[False, False] and all(above.values())


def test_language_filter_answers_for_each_language_like_sets():
    rng = np.random.default_rng(5)
    entries = [np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint32)) for n in (4000, 2500, 50, 0)]
    f = langid.Filter(entries)
    texts = [rng.choice(np.concatenate(entries[:3]), 300), rng.integers(0, 1 << 32, 20000, dtype=np.uint32), np.zeros(0, np.uint32), entries[2]]
    counts = f.counts(np.concatenate(texts), np.array([len(t) for t in texts]))
    for i, t in enumerate(texts):
        for k, e in enumerate(entries):
            true = int(np.isin(t, e).sum())
            assert counts[i, k] >= true
            assert counts[i, k] - true <= 5 + 3 * len(t) * f.false[k], (i, k)
    many = [np.array([k], dtype=np.uint32) for k in range(70)]  # over two planes
    wide = langid.Filter(many)
    got = wide.counts(np.arange(70, dtype=np.uint32), np.ones(70, dtype=np.int64))
    assert all(got[k, k] == 1 for k in range(70)) and got.sum() <= 70 + 70


def test_languages_are_those_that_plain_sets_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400).cache()
    langs, filt = langid.learn(docs)
    got = {r["id"]: r["lang_pred"] for r in langid.identify(docs, langs, filt).collect()}
    by = defaultdict(Counter)
    for r in docs.collect():
        if r["lang"] is not None and r["text"] is not None:
            by[r["lang"]].update(langid.ngrams([r["text"]])[0].tolist())
    rates = {x: {g: n / sum(m for m in c.values() if m > 1) for g, n in c.items() if n > 1} for x, c in by.items()}
    own = {x: {g for g, p in c.items() if p >= langid.CONTRAST * max(rates[y].get(g, 0) for y in rates)} for x, c in rates.items()}
    agree = total = 0
    for r in docs.collect():
        grams = langid.ngrams([r["text"] or ""])[0].tolist()
        if len(grams) >= 20:
            total += 1
            agree += got[r["doc_id"]] == max(langs, key=lambda x: sum(g in own[x] for g in grams))
    assert agree >= 0.99 * total > 0, (agree, total)


def test_follow_the_regularised_leader_like_a_plain_loop():
    rng = random.Random(4)
    rows = [(sorted(rng.sample(range(40), 6)), [rng.uniform(0, 3) for _ in range(6)], rng.choice([0.0, 1.0, 0.5])) for _ in range(200)]
    model, z, n = quality.Ftrl(40), defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for index, value, label in rows:
        model.learn(np.array(index), np.array(value), label)
        x = {**dict(zip(index, value, strict=True)), 40: 1.0}
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
        for i, v in x.items():
            g = (p - label) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
            n[i] += g * g
    assert np.allclose(model.weights(), [weight(i) for i in range(41)], atol=1e-6)


def test_score_is_the_sparse_dot_product():
    rng = np.random.default_rng(6)
    w = rng.normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    for text in ("", "One two TWO 22 three!", "été ünder\n" * 30):
        i, v = quality.sparse(text, {})
        p = 1 / (1 + math.exp(-(float(w[-1]) + float((w[i].astype(float) * v).sum()))))
        assert math.isclose(p, quality.score_text(text, w, {}), rel_tol=1e-6)


def test_many_labels_of_one_id_and_rows_of_one_id_train(spark):
    docs = spark.createDataFrame([(i, f"good words number {i}" if i % 2 else f"BAD stuff!!! {i}") for i in range(20)] + [(3, "again"), (3, "again")], "doc_id long, text string")
    labels = spark.range(20000).select(F.lit(3).cast("long").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    labels = labels.unionByName(spark.createDataFrame([(i, i % 2) for i in range(20) if i != 3], "doc_id long, quality int"))
    w = quality.train(docs, labels)
    scores = {r["id"]: r["score"] for r in quality.score(docs, w).collect()}
    assert min(scores[i] for i in (1, 5, 7)) > max(scores[i] for i in (0, 2, 4))


def test_equal_texts_share_a_shard_unless_their_group_outweighs_one(spark):
    rng = random.Random(9)
    light = [(i, sentence(rng, rng.randint(1, 40))) for i in range(600)] + [(1000 + i, "a copied text of some words") for i in range(12)]
    heavy = [(2000 + i, "heavy " * 80) for i in range(200)]
    one_id = [(7, "always together " * 30)] * 40
    rows = light + heavy + one_id + [(9, None), (9, None), (None, "no id")]
    got = sharding.shard_documents(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string"), 8).collect()
    assert len(got) == len(rows)
    total, where, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        total[r["shard"]] += r["size"]
        where[r["text"] or ""].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    share = sum(total.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for t, s in where.items() if not t.startswith("heavy"))
    assert max(total.values()) <= 1.05 * share and min(total.values()) >= 0.95 * share, total


def test_sharding_query_gives_sizes_sums_and_its_law(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    where, weight = defaultdict(set), Counter()
    rows = queries.QUERIES["op9_sharding"](spark, SF).collect()
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        where[raw].add(r["shard"])
        weight[raw] += r["size"]
    assert all(len(s) == 1 for raw, s in where.items() if weight[raw] <= sum(weight.values()) / 8)


def test_prefix_tree_like_a_naive_one(spark):
    rng = random.Random(12)
    first = [("system", "be brief"), ("user", "hi"), ("assistant", "hello <|end|>"), ("user", "more")]
    convs = {c: [first[k] if k < rng.randint(1, 4) and k < len(first) else (rng.choice(["user", "assistant"]), f"{c}-{k} \\ [INST]") for k in range(rng.randint(1, 7))] for c in range(40)}
    convs[41] = list(convs[3])  # the same conversation again
    rows = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    nodes, paths = chat.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    nodes = {r["start"]: r for r in nodes.collect()}
    packed = "".join(nodes[s]["body"] for s in sorted(nodes))
    assert all(packed[s : s + n["chars"]] == n["body"] for s, n in nodes.items())
    assert len(nodes) == len({tuple(turns[: k + 1]) for turns in convs.values() for k in range(len(turns))})
    walk = defaultdict(list)
    for r in sorted(paths.collect(), key=lambda r: (r["conv"], r["place"])):
        walk[r["conv"]].append(r["start"])
    for c, turns in convs.items():
        assert len(walk[c]) == len(turns)
        before = ""
        for start in walk[c]:
            n = nodes[start]
            seen = "".join(packed[a:b] for a, b in n["attends"])
            assert seen == before and n["position"] == len(before)  # what it attends to is all that its conversation said so far
            assert all(x[1] <= y[0] for x, y in zip(n["attends"], n["attends"][1:], strict=False))
            before += n["body"]
    order = [walk[c][k] for c in sorted(walk, key=lambda c: walk[c]) for k in range(len(walk[c]))]
    assert list(dict.fromkeys(order)) == sorted(nodes)  # depth first: each emits its new turns after what went before


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Bare:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "x"
            getConf = staticmethod(lambda: Bare.conf)

    try:
        common.shared_dir(Bare)
    except RuntimeError as e:
        assert "spark.checkpoint.dir" in str(e)
    else:
        raise AssertionError


def test_targets_are_those_of_sharing_again_and_again(spark):
    rng = random.Random(6)
    for n in (1, 2, 5, 9, 14):
        sizes = {f"s{i:02}": rng.choice([1, 3, 10, 200, 5000, rng.randint(1, 10**6)]) for i in range(n)}
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
        wanted, left = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values())
        while left > 1e-9 and (below := [s for s in sizes if wanted[s] < 2 * sizes[s] - 1e-12]):
            share = left / sum(weight[s] for s in below)
            left = 0.0
            for s in below:
                wanted[s] += share * weight[s]
                left += max(0.0, wanted[s] - 2 * sizes[s])
                wanted[s] = min(wanted[s], 2.0 * sizes[s])
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got.keys() == wanted.keys() and all(math.isclose(got[s], wanted[s], rel_tol=1e-9) for s in sizes), (sizes, got, wanted)
