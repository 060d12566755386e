"""Token counts under a byte-level BPE vocabulary with word ends.

Offline, once on the driver, every vocabulary string that ends a word is run through the merges; those that come out as one
token form the whole-token table, which is broadcast with the merges. A text's pre-tokens that stand in the table count one
each without any merging. Only the rest are merged, once per distinct string and worker.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table
from .texts import lean

VOCABULARY, LIMIT, END = "word_bpe_49k.json", 2048, "</w>"
#: Distinct merged strings that a worker remembers.
REMEMBERED = 200_000


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself if printable, else the next free code from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Counter:
    """Counts tokens as the tokenizer file ``path`` gives them, without added begin or end."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.letters = byte_letters()
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.merged: dict[str, int] = {}  # of this process alone
        back = {c: b for b, c in enumerate(self.letters)}
        self.whole: dict[str, int] = {}
        for piece in spec["model"]["vocab"]:
            if piece.endswith(END) and len(piece) > len(END) and self.merge([*piece[: -len(END) - 1], piece[-len(END) - 1 :]]) == 1:
                try:
                    word = bytes(back[c] for c in piece[: -len(END)]).decode()
                except (UnicodeDecodeError, KeyError):  # a part of a character never stands alone
                    continue
                self.whole[word] = 1

    def __getstate__(self) -> dict:
        return {**self.__dict__, "merged": {}}

    def merge(self, parts: list[str]) -> int:
        """Tokens left when the best-ranked neighbours, leftmost first, have been joined as long as any can be."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue
            parts[i], parts[j], left = a + b, "", left - 1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return left

    def rest(self, word: str) -> int:
        if (n := self.merged.get(word)) is None:
            parts = [self.letters[b] for b in word.encode()]
            parts[-1] += END
            n = self.merge(parts)
            if len(self.merged) >= REMEMBERED:
                self.merged.clear()
            self.merged[word] = n
        return n

    def plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case letter by letter: no final sigma
        words = self.words.findall(text.lower())
        counts = [*map(self.whole.get, words)]
        if None not in counts:
            return len(counts)
        return sum(c or self.rest(w) for c, w in zip(counts, words, strict=True))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special and "<|" in text:
            parts = self.special.split(text)
            return sum(map(self.plain, parts)) + len(parts) - 1
        return self.plain(text)


@functools.cache
def counter(path: str) -> Counter:
    """The counter of a file, made once in the driver; the vocabulary bounds its size."""
    return Counter(path)


def sent(spark: SparkSession, path: str) -> Broadcast[Counter]:
    """The counter as tasks read it: a worker process keeps it, and what it remembers, for all of its tasks."""
    return spark.sparkContext.broadcast(counter(path))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens``, ``over_limit`` for every row.

    Null and empty texts have no tokens; repeated rows are counted each; other columns are ignored. A worker
    holds one Arrow batch and the strings it remembers.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    table = sent(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = table.value
        for b in batches:
            texts = b.column("__text")
            counts = [c.count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("n_bytes"), pa.array(counts, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(lean(run), f"`{id_col}` {id_type}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
