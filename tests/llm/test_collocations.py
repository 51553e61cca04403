"""Collocations against counting all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from infotraj.llm import collocations


def plain(rows, min_count, most, top=2000):
    counts = defaultdict(Counter)
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            for m in range(1, most + 1):
                counts["und" if lang is None else lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        good = {g: a for g, a in f.items() if a >= min_count and len(g) > 1}
        inner = {g[i : i + m] for g, a in good.items() for m in range(2, len(g)) for i in range(len(g) - m + 1) if a >= good[g[i : i + m]]}
        rated = []
        for g, a in good.items():
            if g not in inner:
                score, k = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                rated.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]], n))
        out += [(lang, i, p.decode(), -a, left, r, n, -s) for i, (s, a, p, left, r, n) in enumerate(sorted(rated)[:top], 1)]
    return sorted(out)


def found(df, **how):
    return sorted(map(tuple, collocations.collocations(df, **how).collect()))


def test_query_gives_what_its_sql_gives(same_as_sql):
    same_as_sql(collocations.op13_collocations, collocations.OP13_SQL)


def test_all_phrases_of_small_counts(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").limit(150).collect()]
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("part", F.lit(1)).withColumn("n", F.lit("x")).repartition(3)
    assert found(df, min_count=12) == plain(rows, 12, 5)


@pytest.mark.parametrize("parts", [18, 2])
def test_repeats_ties_and_odd_texts(spark, parts):
    rng = random.Random(3)
    words = ["A", "a", "b", "c d", "É", "é", "x\x1cy", "\0", "-"]
    rows = [(rng.choice(["en", None, "und", "x\0y"]), "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ".", "\n", " , ", "\r"]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    rows += [("en", None), ("en", ""), (None, " \t.\n"), ("en", "b b b b b b b b " * 2000), *[("en", "to be or not to be")] * 30]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    for how in ({"min_count": 3}, {"min_count": 8, "top": 7}, {"min_count": 300, "most": 3}):
        assert found(df, part_bits=parts, **how) == plain(rows, how["min_count"], how.get("most", 5), how.get("top", 2000))


def test_a_phrase_has_one_owner():
    key = np.array([5, 9, 5, 9, 9, 2], dtype=np.uint64)
    left, right = collocations.windows(key, np.array([1, 1, 1, 0, 1, 0], dtype=bool), 5)
    assert left.tolist() == [0, 1, 0, 1, 0, 0] and right.tolist() == [0, 2, 0, 0, 1, 0]


def test_exact_beyond_64_bits(spark):
    rows = [("en", "a b c")] * 200
    assert found(spark.createDataFrame(rows, "lang string, text string")) == plain(rows, 100, 5)
    assert found(spark.createDataFrame([], "lang string, text string")) == []
