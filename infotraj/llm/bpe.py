"""BPE encoding and decoding with a contiguous rank array a word.

A word's symbols are held as part boundaries, beside an array of the ranks of adjacent parts. The smallest rank is
found by scanning that array; its boundary is deleted and the two ranks beside it are refreshed, until no pair has a
rank. Words are short, so a scan beats a heap; a run of over LONG characters without a break keeps its ranks in a
heap over linked parts, which gives the same merges (lowest rank first, leftmost among equals) in n log n.

A word is encoded once and kept, up to a fixed number of words, as the text of its ids; texts are whole and memory
does not grow with the input. The vocabulary file is read where the driver is and sent along with the function.

The file's own steps are followed: special tokens are cut out of the raw text, then Unicode NFC, character-wise lower
case, split into contractions, letter runs, single digits and runs of other marks (white space goes), bytes as
printable characters, and the word-end suffix on the last. Files of another make are refused.

Edges: a null or empty text has no tokens and decodes to the empty text. Symbols the vocabulary lacks are dropped, as
its library does where there is no unknown token. Repeated rows and extra columns do not matter.
An empty table gives no rows; ids are cast to long, and ids that are no numbers raise.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infotraj.llm.common import text_slices

#: Characters from which a word's ranks go into a heap.
LONG = 64
#: Words remembered by a task, in two halves: when the newer is full, the older is dropped.
REMEMBERED = 3 << 16
NONE = 1 << 62


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A tokenizer of the kind described above, from its JSON text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or split["behavior"] != "Removed" or model.get("dropout") or model.get("unk_token"):
            raise ValueError("not a lower-case word-end BPE file")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # a pair of ids, as one number -> its rank above the id of what it makes, as one number
        self.ranks = {self.vocab[a] << 32 | self.vocab[b]: r << 32 | self.vocab[a + b] for r, (a, b) in enumerate(pairs)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = added
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.names = {i: s for s, i in {**self.vocab, **added}.items()}
        shown = byte_characters()
        self.inner = [self.vocab.get(c, -1) for c in shown]
        self.last = [self.vocab.get(c + self.suffix, -1) for c in shown]
        self.whole = min(*self.inner, *self.last) >= 0

    def symbols(self, word: str) -> list[int]:
        raw = word.encode()
        parts = [*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]
        return parts if self.whole else [i for i in parts if i >= 0]

    def word(self, word: str) -> list[int]:
        parts = self.symbols(word)
        if len(parts) < 2:
            return parts
        return self.by_heap(parts) if len(parts) > LONG else self.by_scan(parts)

    def by_scan(self, parts: list[int]) -> list[int]:
        get = self.ranks.get
        ranks = [get(a << 32 | b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != NONE:
            i = ranks.index(best)
            parts[i] = best & 0xFFFFFFFF
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] << 32 | parts[i + 1], NONE)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | parts[i], NONE)
        return parts

    def by_heap(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.ranks.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r >> 32, i, parts[i], parts[i + 1], r & 0xFFFFFFFF) for i in range(n - 1) if (r := get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:  # one of the two has been merged meanwhile
                continue
            parts[i], parts[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (r := get(parts[x] << 32 | parts[y])) is not None:
                    heapq.heappush(heap, (r >> 32, x, parts[x], parts[y], r & 0xFFFFFFFF))
        return [p for p in parts if p >= 0]

    def words(self, text: str) -> Iterator[tuple[str, bool]]:
        """The words of a text, and whether each is a special token."""
        for k, piece in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                yield piece, True
            elif piece:
                for w in self.pattern.findall(self.normal(piece)):
                    yield w, False

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then each character's own lower case (a final sigma is like any other)."""
        text = unicodedata.normalize("NFC", text) if not text.isascii() else text
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    def encode(self, text: str) -> list[int]:
        return [i for w, special in self.words(text) for i in ([self.special[w]] if special else self.word(w))]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder of its own the file joins the tokens' names by a space."""
        return " ".join(self.names[i] for i in ids if i in self.names)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, n_tokens, ids, decoded), or with digests (id, n_tokens, ids_sha256, decoded_sha256) for each row of df."""
    with open(path, encoding="utf-8") as f:  # on the driver: a local file of the installation, not of the corpus
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(spec.value)
        known: dict[str, tuple[str, str, int]] = {}
        older: dict[str, tuple[str, str, int]] = {}

        def learn(w: str, special: bool) -> tuple[str, str, int]:
            nonlocal known, older
            if special or not (found := older.get(w)):
                ids = [bpe.special[w]] if special else bpe.word(w)
                found = (" ".join(map(str, ids)), bpe.decode(ids), len(ids))
            if not special and len(w) <= LONG:
                if len(known) >= REMEMBERED // 2:
                    known, older = {}, known
                known[w] = found
            return found

        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                count, coded, read = [], [], []
                for x in texts:
                    if bpe.cut and bpe.cut.search(x):
                        got = [learn(w, s) for w, s in bpe.words(x)]
                    else:
                        got = [known.get(w) or learn(w, False) for w in bpe.pattern.findall(bpe.normal(x))]
                    count.append(sum(g[2] for g in got))
                    a, b = " ".join([g[0] for g in got if g[2]]), " ".join([g[1] for g in got if g[2]])
                    coded.append(hashlib.sha256(a.encode()).hexdigest() if digests else list(map(int, a.split())))
                    read.append(hashlib.sha256(b.encode()).hexdigest() if digests else b)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(count, pa.int64()), pa.array(coded, pa.string() if digests else pa.list_(pa.int32())), pa.array(read, pa.string())], names=names)

    names = ["id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]
    kinds = ["long", "long", *(["string", "string"] if digests else ["array<int>", "string"])]
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, vocabulary_path(), digests=True).withColumnRenamed("id", "doc_id")
