"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at the vocabulary's added tokens, then into the words of its
pre-tokeniser; each word is a linked list of byte symbols and a heap of adjacent
pairs by rank. The lowest-rank pair is popped and merged until none is left, and
the count is the initial symbols less the merges. Identifiers are never produced.

It is a map over rows: no shuffle, and per task a bounded cache of word counts.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_bytes, tokenizer_path, without

#: Fixed value: the word pattern of the byte-level pre-tokeniser.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS = 400_000
CACHED_CHARS = 48


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file.

    Printable Latin-1 bytes stand for themselves; the others take the code points
    from 256 on, in order.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class BytePairs:
    """The merges by rank over symbol numbers; symbols below 256 are bytes."""

    def __init__(self, vocabulary: bytes) -> None:
        file = json.loads(vocabulary)
        model, pre = file["model"], file.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not file.get("normalizer")
        if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level BPE vocabularies without normaliser or prefix space are supported")
        symbols = dict(byte_names())
        self.pairs: dict[int, int] = {}
        self.left, self.right, self.made = [], [], []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            for of_rank, x in ((self.left, a), (self.right, b), (self.made, a + b)):
                of_rank.append(symbols.setdefault(x, len(symbols)))
            self.pairs.setdefault(self.left[-1] << 20 | self.right[-1], rank)
        if len(symbols) >= 1 << 20:
            raise ValueError("a vocabulary of over a million symbols isn't supported")
        added = file.get("added_tokens") or []
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
            raise ValueError("added tokens that strip or need word bounds aren't supported")
        self.added = [t["content"] for t in added]
        self._start()

    def _start(self) -> None:
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.words = regex.compile(WORDS)
        self.cache: dict[str, int] = {}

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("pairs", "left", "right", "made", "added")}

    def __setstate__(self, state) -> None:
        self.__dict__ |= state
        self._start()

    def merged(self, word: bytes) -> int:
        """Symbols that are left of one word.

        A heap entry is one integer: the rank of a pair above the place of its left
        symbol, so that the lowest rank, leftmost, is popped first. An entry is stale
        if its place no longer holds the pair of its rank.
        """
        n = len(word)
        if n < 2:
            return n
        shift, pairs, left, right, made = n.bit_length(), self.pairs, self.left, self.right, self.made
        place, symbol = (1 << shift) - 1, [*word, -1]
        heap = []
        for i in range(n - 1):
            rank = pairs.get(symbol[i] << 20 | symbol[i + 1])
            if rank is not None:
                heap.append(rank << shift | i)
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            entry = heapq.heappop(heap)
            i, rank = entry & place, entry >> shift
            j = after[i]
            if symbol[i] != left[rank] or symbol[j] != right[rank] or j == n:
                continue
            merges += 1
            new = symbol[i] = made[rank]
            symbol[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = pairs.get(new << 20 | symbol[k])
                if rank is not None:
                    heapq.heappush(heap, rank << shift | i)
            h = before[i]
            if h >= 0:
                rank = pairs.get(symbol[h] << 20 | new)
                if rank is not None:
                    heapq.heappush(heap, rank << shift | h)
        return n - merges

    def word(self, word: str) -> int:
        known = self.cache.get(word)
        if known is None:
            known = self.merged(word.encode("utf-8", "replace"))
            if len(word) <= CACHED_CHARS:
                if len(self.cache) >= CACHED_WORDS:
                    self.cache.clear()
                self.cache[word] = known
        return known

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts, special = [text], 0
        if self.cut and (special := len(self.cut.findall(text))):
            parts = self.cut.split(text)
        total = special
        for part in parts:
            for word, n in Counter(self.words.findall(part)).items():
                total += n * self.word(word)
        return total


def count_tokens(df: DataFrame, vocabulary: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """Adds ``out`` (long): tokens of the text under the vocabulary file ``vocabulary``.

    Null and empty texts have 0 tokens. Words of any length are merged whole. A column
    already called ``out`` is replaced. The file is read on the driver and broadcast,
    so executors need no copy of it.
    """
    shared = df.sparkSession.sparkContext.broadcast(BytePairs(read_bytes(vocabulary)))

    @F.arrow_udf(T.LongType())
    def tokens(texts: pa.Array) -> pa.Array:
        count = shared.value.count
        return pa.array([count(t) for t in texts.to_pylist()], pa.int64())

    return without(df, [out], (text_col,)).withColumn(out, tokens(F.col(f"`{text_col}`").cast("string")))


def token_query(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """Contract query over all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = count_tokens(docs, tokenizer_path(vocabulary))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
