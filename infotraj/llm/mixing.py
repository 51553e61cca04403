"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions alone.

Targets: sources in code-point order (null last) take the weights of a repeating cycle and share a budget that is a
multiple of all words. A target stops at `cap` times its source's size and the excess is shared again by weight. That
ends where every target is min(cap * size, level * weight); the level follows from one running sum over sources
ordered by cap * size / weight.

Curriculum: a source's weight moves linearly from a start to an end multiplier over training time 0..1. Its integral,
scaled to the source's target, is the words demanded by a time; inverted, it gives each document the time at which its
first word is due. A source's documents are laid end to end in the order of md5(doc_id), once and then again, until
the target is reached; the last one is cut there. Sorting by that time is a range sort.

The running sums never put a source into one task: documents are dealt by md5 prefix into about sqrt(rows) blocks a
source, blocks are summed and their offsets joined back. Rows are placed one by one, whole, without a join by id.

Edges: null and empty texts have size 0 and are never taken; a null source is a source of its own, the last; null ids
sort as an empty string and lie in blocks by their texts; rows that repeat an id follow one another, each taken or not on
its own; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from infotraj.llm.common import columns_free_of, table

WEIGHTS = (5, 2, 1)
#: Multipliers of a weight at the start and the end of training, by place in the cycle.
SCHEDULE = ((1.0, 0.5), (1.0, 1.0), (0.5, 1.5))
SHARE, CAP = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, place, target) from sizes(source, source_size): one row a source."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sizes.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place") + 1))
    ranked = ranked.withColumn("full_at", F.lit(cap) * F.col("source_size") / F.col("weight"))
    filled = F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    level = (F.lit(share) * F.sum("source_size").over(everything) - filled) / left
    levels = ranked.withColumn("level", level)
    # taking a source as full raises the level while it is full below it, and lowers it from there on
    levels = levels.withColumn("level", F.max("level").over(everything))
    return levels.select("source", "source_size", "place", F.least(F.lit(cap) * F.col("source_size").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def due(words: Column, target: Column, place: Column, schedule: tuple[tuple[float, float], ...] = SCHEDULE) -> Column:
    """The training time at which a source has demanded so many of its target's words."""
    done = words / target
    out = done
    for k, (a, b) in enumerate(schedule):
        if a != b:
            out = F.when(place == k, (F.sqrt(F.lit(a * a) + F.lit((b - a) * (a + b)) * done) - F.lit(a)) / F.lit(b - a)).otherwise(out)
    return out


def laid(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """df with __id, __source, __size and __h, its place in the order of its source."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return df.withColumns({"__id": F.col(id_col), "__source": F.col(source_col), "__size": word_count(F.col(text_col)), "__h": F.md5(key.cast("binary")), "__alone": F.when(F.col(id_col).isNull(), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))})


def placed(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """laid rows with __first and __again, the words taken of each in the first and the second round, and source_size,
    target, first_due and again_due. narrow: the same rows, with laid()'s columns at least."""
    digits = max(1, round(math.log(max(narrow.count(), 1), 16) / 2))
    block = F.concat(F.substring("__h", 1, digits), F.coalesce(F.substring("__alone", 1, digits), F.lit("")))
    blocks = table(narrow.groupBy(F.col("__source").alias("source"), block.alias("block")).agg(F.sum("__size").alias("words")), "mix-blocks")
    aims = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")))
    by_block = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("offset", F.coalesce(F.sum("words").over(by_block), F.lit(0)))
    offsets = offsets.join(aims.withColumnRenamed("source", "aim_source"), F.col("source").eqNullSafe(F.col("aim_source")))
    offsets = offsets.select(*[F.col(c).alias(f"__{n}") for c, n in (("source", "at_source"), ("block", "at_block"), ("offset", "offset"), ("place", "place"), ("source_size", "source_size"), ("target", "target"))])
    out = rows.withColumn("__block", block).join(offsets, F.col("__source").eqNullSafe(F.col("__at_source")) & (F.col("__block") == F.col("__at_block")))
    inside = Window.partitionBy("__source", "__block").orderBy("__h", "__id", "__alone", "__size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("__before", F.col("__offset") + F.sum("__size").over(inside) - F.col("__size"))
    words = F.floor("__target")
    first = F.greatest(F.lit(0), F.least(F.col("__size"), words - F.col("__before")))
    again = F.greatest(F.lit(0), F.least(F.col("__size"), words - F.col("__source_size") - F.col("__before")))
    out = out.withColumns({"__first": first, "__again": again})
    return out.withColumns({
        "__first_due": F.when(F.col("__first") > 0, due(F.col("__before"), F.col("__target"), F.col("__place"))),
        "__again_due": F.when(F.col("__again") > 0, due(F.col("__source_size") + F.col("__before"), F.col("__target"), F.col("__place"))),
    })


def taken(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, taken, first_due, again_due) for every row of df."""
    rows = table(laid(df, id_col, text_col, source_col).select("__id", "__source", "__size", "__h", "__alone"), "mix-sizes")
    whole = (F.col("__first") + F.col("__again")).cast("long").alias("taken")
    names = [F.col(f"__{c}").alias(c) for c in ("id", "source", "size", "source_size", "target")]
    return placed(rows, rows).select(*names, whole, F.col("__first_due").alias("first_due"), F.col("__again_due").alias("again_due"))


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), n.cast("int")), "")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of df in training order, once for each time they are taken; a row that is not taken is left out.

    The text that reaches a source's target is cut there, after the last word taken. Extra columns stay; `due`, `size`
    and `taken` (words in the text, and of them in this row) are added and replace columns of these names.
    """
    narrow = table(laid(df, id_col, text_col, source_col).select("__id", "__source", "__size", "__h", "__alone"), "mix-sizes")
    out = placed(laid(columns_free_of(df, "due", "size", "taken"), id_col, text_col, source_col), narrow)
    times = F.array_compact(F.array(*[F.when(F.col(f"__{x}") > 0, F.struct(F.col(f"__{x}_due").alias("due"), F.col(f"__{x}").alias("taken"))) for x in ("first", "again")]))
    out = out.withColumn("__time", F.explode(times))
    cut = F.when(F.col("__time.taken") < F.col("__size"), first_words(F.col(text_col), F.col("__time.taken"))).otherwise(F.col(text_col))
    out = out.withColumns({text_col: cut, "due": F.col("__time.due"), "size": F.col("__size"), "taken": F.col("__time.taken").cast("long")})
    return out.drop(*[c for c in out.columns if c.startswith("__")]).orderBy("due", id_col)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return taken(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_due", "again_due")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT AS place FROM s),
w AS (SELECT *, CASE place WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
f AS (SELECT *, (2 * source_size)::DOUBLE / weight AS full_at FROM w),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(2 * source_size) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS own_level FROM f),
m AS (SELECT *, max(own_level) OVER () AS level FROM l),
t AS (SELECT source, source_size, place, least((2 * source_size)::DOUBLE, level * weight) AS target FROM m),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.place, floor(t.target)::BIGINT AS words,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, greatest(0, least(size, words - before)) AS a, greatest(0, least(size, words - source_size - before)) AS b,
    before::DOUBLE / nullif(target, 0) AS x, (source_size + before)::DOUBLE / nullif(target, 0) AS y FROM c)
SELECT doc_id, size, source_size, target, (a + b)::BIGINT AS taken,
  CASE WHEN a > 0 THEN CASE place WHEN 0 THEN (sqrt(1::DOUBLE + -0.75::DOUBLE * x) - 1::DOUBLE) / -0.5::DOUBLE WHEN 1 THEN x ELSE (sqrt(0.25::DOUBLE + 2::DOUBLE * x) - 0.5::DOUBLE) / 1::DOUBLE END END AS first_due,
  CASE WHEN b > 0 THEN CASE place WHEN 0 THEN (sqrt(1::DOUBLE + -0.75::DOUBLE * y) - 1::DOUBLE) / -0.5::DOUBLE WHEN 1 THEN y ELSE (sqrt(0.25::DOUBLE + 2::DOUBLE * y) - 0.5::DOUBLE) / 1::DOUBLE END END AS again_due
FROM k
"""
