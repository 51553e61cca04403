"""Line dedup: an exact set-similarity join over lines, in DataFrame functions alone.

A line is a \\n-separated piece of a text with MIN_WORDS words or more; its set is that of its lower-case words, held as
64-bit hashes. A line goes if an earlier one (by id, text hash, number) has a Jaccard similarity of at least 4/5, be
that one removed or not. Words are told apart by those hashes alone: nothing else is inexact.

1. Rarity: all words of all sets are counted in a table of 2^16 cells by hash. A word's place in the order that all
   sets share is (its cell's rank by count, rest of its hash): rare words first. Any fixed order gives right
   results; this one keeps prefixes rare. A rank is put in a hash's upper 16 bits in place of the cell, so that the
   number that is sorted still tells all hashes apart.
2. Lines of equal sets become one vertex, named by its first line: all others go.
3. Prefix filter: similar sets share a word among the first n - ceil(4n/5) + 1. Vertices meet by those words. Length,
   positional and bitmap filters are conditions of the join (the parity of words in 64 cells, and in 128 for sets of
   over SHORT words, differs in no more bits than the sets in words). A left semi join keeps what has any possible
   partner by a word: it gives a row at most for each it reads, however many variants of one line there are.
4. Verification: the sets of those vertices alone are fetched from the texts. Each is first compared, at each word left
   to it, with the earliest one there; only what that leaves unmatched is joined with all that is earlier, so that variants of
   one line do not meet each other in pairs.
5. Line numbers to remove are gathered by text, and texts rebuilt.

Joins of two sides that both grow with the input ask for a sort-merge join, so that plans and their growth are the
same at every size. Functions of each word have as few steps as can be: Spark interprets them. Sets are made once, and
held on the executors' disks until their vertices are written: of the lines themselves names alone become a table. Tables are deleted as soon as what reads them is written.

Edges: shorter and blank lines stay where they are; null texts stay null; rows with a null id stay as they are. Rows
that share an id are told apart by their texts; equal rows count as one, and keep or lose a line alike. Ids are
compared in the order of their own type. Extra columns are carried along, those named n_lines or n_removed replaced.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infotraj.llm.common import columns_free_of, free, table, text_hash

MIN_WORDS = 3
CELLS = 1 << 16
#: Words up to which a set has a bitmap of 64 cells alone.
SHORT = 64

#: What names a line: its document's id, the hash of its text, the line's number.
NAME = ("doc", "th", "no")


def words_of(line: Column) -> Column:
    """Lower-case words of a line, and empty strings where white space repeats."""
    other = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c"))
    return F.split(F.lower(F.when(other, F.regexp_replace(line, r"[\x09-\x0D]", " ")).otherwise(line)), " ")


def prefix_length(n: Column) -> Column:
    return (n - F.ceil(4 * n / 5) + 1).cast("int")


def sized(n: Column, pos: Column) -> Column:
    """A set's size and its words from this place on as one number: rows of the join stay narrow."""
    return F.shiftleft(n.cast("long"), 32).bitwiseOR((n - pos).cast("long"))


def possible(x: str, y: str) -> Column:
    """Whether rows x and y that share a prefix word can be similar: bitmap, length and positional filters.

    Similar sets of a and b words share (4/9)(a + b) at least, and differ in (a + b)/9 at most.
    """
    nx, ny = (F.shiftright(F.col(f"{v}.at"), 32) for v in (x, y))
    left = F.least(*[F.col(f"{v}.at").bitwiseAND(F.lit(0xFFFFFFFF)) for v in (x, y)])
    folded, upper = (F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")) for c in ("parity", "upper"))
    wide = F.bit_count(folded.bitwiseXOR(upper)) + F.bit_count(upper)
    near = (9 * F.bit_count(folded) <= nx + ny) & ((nx <= SHORT) | (ny <= SHORT) | (9 * wide <= nx + ny))
    return near & (5 * nx >= 4 * ny) & (5 * ny >= 4 * nx) & (9 * left >= 4 * (nx + ny))


def has_words(line: Column, least: int) -> Column:
    """Whether a line has so many words: its start mostly tells, so that the whole is seldom decoded for this."""
    pattern = rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{least - 1}}}[^\x20\x09-\x0D]"
    return F.substring(line, 1, 16 * least).rlike(pattern) | line.rlike(pattern)


def set_of(line: Column) -> Column:
    """A line's set as hashes of its distinct words."""
    return F.array_distinct(F.array_remove(F.transform(words_of(line), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))


def constants(values: list[int]) -> Column:
    """Numbers of 64 bits as an array constant."""
    return F.split(F.lit(",".join(str((v + (1 << 63)) % (1 << 64) - (1 << 63)) for v in values)), ",").cast("array<bigint>")


def at_place(table: Column, place: Column) -> Column:
    return F.coalesce(F.get(table, place), F.lit(0).cast("long"))  # never null: sorts stay those of plain longs


def codes_of(words: Column, ranks: Column) -> Column:
    """A set as sorted numbers, in the order of rarity."""
    return F.sort_array(F.transform(words, lambda h: h.bitwiseXOR(at_place(ranks, F.shiftrightunsigned(h, 48)))))


def parity_of(codes: Column, upper: bool = False) -> Column:
    """The parity of a set's words in 64 cells; or, of 128 cells that fold into these, in the upper half."""
    bits = constants([*[0] * 64, *(1 << i for i in range(64))] if upper else [1 << i for i in range(64)])
    last = F.lit(127 if upper else 63).cast("long")
    return F.aggregate(codes, F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(at_place(bits, c.bitwiseAND(last))))


def lines_of(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(doc, th, no, line) of each line that takes part."""
    text = F.col(text_col).cast("string")
    lines = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), text_hash(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("no", "line"))
    return lines.where(has_words(F.col("line"), max(1, min_words)))


def rarity(sets: DataFrame) -> Column:
    """What turns each cell, the upper 16 bits of a hash, into its rank by count: an array constant of numbers for xor."""
    cell = F.shiftrightunsigned("word", 48).alias("cell")
    counts = dict(sets.select(F.explode("set").alias("word")).groupBy(cell).count().collect())  # CELLS rows at most
    rank = {c: i for i, c in enumerate(sorted(range(CELLS), key=lambda c: counts.get(c, 0)))}
    return constants([(c ^ rank[c] ^ CELLS // 2) << 48 for c in range(CELLS)])  # the least number is the most negative one


def picked(text: Column, at: Column, make) -> Column:
    """make(lines, places) of a text: a lambda binds its lines, so that they are split once and not once a place."""
    return F.get(F.transform(F.array(F.split(text, "\n")), lambda lines: make(lines, at)), 0)


def similar_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, th, no): the lines of df to remove, in a table."""
    sets = lines_of(df, id_col, text_col, min_words).select(*NAME, set_of(F.col("line")).alias("set")).persist(StorageLevel.DISK_ONLY)
    ranked = sets.select(*NAME, codes_of(F.col("set"), rarity(sets)).alias("codes"))
    n = F.size("codes")
    upper = F.when(n > SHORT, parity_of(F.col("codes"), upper=True)).otherwise(F.lit(0).cast("long"))
    prefix = F.slice("codes", F.lit(1), prefix_length(n))
    lines = ranked.select(*NAME, F.xxhash64("codes").alias("h"), n.alias("n"), parity_of(F.col("codes")).alias("parity"), upper.alias("upper"), prefix.alias("prefix"))

    # equal sets agree in h and parity, others in hardly any
    vertices = table(lines.groupBy("h", "parity").agg(F.min(F.struct(*NAME, "n", "upper", "prefix")).alias("first")).select("h", "parity", "first.*"), "vertices")
    names = table(sets.select(*NAME), "names")
    sets.unpersist(blocking=True)
    token = F.col("code").bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int").alias("token")
    entries = vertices.select("h", "parity", "upper", "n", F.posexplode("prefix").alias("pos", "code")).select("h", "parity", "upper", sized(F.col("n"), F.col("pos")).alias("at"), token)
    other = (F.col("x.h") != F.col("y.h")) | (F.col("x.parity") != F.col("y.parity"))
    paired = entries.alias("y").join(entries.alias("x").hint("merge"), (F.col("x.token") == F.col("y.token")) & possible("x", "y") & other, "left_semi")
    met = table(paired, "met")
    candidates = table(vertices.select("h", "parity", *NAME).join(met.select("h", "parity").distinct().hint("merge"), ["h", "parity"], "left_semi"), "candidates")
    small = table(met.join(candidates.hint("merge"), ["h", "parity"]).select(*NAME, "parity", "upper", "at", "token"), "met")
    free(met)

    places = candidates.groupBy("doc", "th").agg(F.collect_list("no").alias("at"))
    text = F.col(text_col).cast("string")
    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), text_hash(text).alias("th"), text.alias("text"))
    told = picked(F.col("text"), F.col("at"), lambda all_lines, at: F.transform(at, lambda i: F.struct(i.alias("no"), F.get(all_lines, i).alias("line"))))
    fetched = texts.join(places.hint("merge"), ["doc", "th"]).select("doc", "th", F.explode(told).alias("p"))
    held = table(fetched.select("doc", "th", F.col("p.no").alias("no"), set_of(F.col("p.line")).alias("set")), "sets")
    if held.count() > candidates.count():  # rows repeat
        again, held = held, table(held.dropDuplicates(list(NAME)), "sets")
        free(again)

    def verified(pairs: DataFrame) -> DataFrame:
        """The later vertex of each pair (y, x) that is similar indeed."""
        named = pairs.select(*[F.col(f"{v}.{c}").alias(f"{v}_{c}") for v in "yx" for c in NAME]).distinct()
        for v in "yx":
            named = named.join(held.alias(v).hint("merge"), [F.col(f"{v}_{c}") == F.col(f"{v}.{c}") for c in NAME])
        a, b = F.col("y.set"), F.col("x.set")
        both = F.size(F.array_intersect(a, b))
        return named.where(5 * both >= 4 * (F.size(a) + F.size(b) - both)).select(*[F.col(f"y_{c}").alias(c) for c in NAME]).distinct()

    doc, th, no = ([F.col(f"{v}.{c}") for v in "xy"] for c in NAME)
    before = (doc[0] < doc[1]) | ((doc[0] == doc[1]) & ((th[0] < th[1]) | ((th[0] == th[1]) & (no[0] < no[1]))))
    leaders = small.groupBy("token").agg(F.min(F.struct(*NAME, "parity", "upper", "at")).alias("x"))
    led = small.alias("y").join(leaders.select("token", "x.*").alias("x").hint("merge"), F.col("x.token") == F.col("y.token"))
    matched = table(verified(led.where(possible("x", "y") & before)), "matched")
    rest = small.join(matched.hint("merge"), list(NAME), "left_anti").alias("y")
    pairs = rest.join(small.alias("x").hint("merge"), (F.col("x.token") == F.col("y.token")) & possible("x", "y") & before)
    more = table(verified(pairs), "matched")
    free(candidates, small, held)

    repeated = names.join(vertices.select(*NAME).hint("merge"), list(NAME), "left_anti")
    lost = table(repeated.unionByName(matched).unionByName(more), "lost")
    free(names, vertices, matched, more)
    return lost


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """df with the similar lines taken out of its texts, and n_lines and n_removed added."""
    gone = similar_lines(df, id_col, text_col, min_words).groupBy("doc", "th").agg(F.collect_set("no").alias("__gone")).withColumnsRenamed({"doc": "__doc", "th": "__th"})
    whole = F.col(text_col).cast("string")
    kept = picked(whole, F.col("__gone"), lambda lines, cut: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), cut), lambda i: F.get(lines, i)), "\n"))
    text = F.when(F.col("__gone").isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(kept)
    out = columns_free_of(df, "n_lines", "n_removed")
    out = out.join(gone.hint("merge"), (F.col(id_col) == F.col("__doc")) & (text_hash(F.col(text_col)) == F.col("__th")), "left")
    n_lines = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    counted = out.withColumn("n_lines", F.coalesce(n_lines, F.lit(0)).cast("long")).withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
    return counted.withColumn(text_col, text).drop("__gone", "__doc", "__th")


def op6_linededup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
