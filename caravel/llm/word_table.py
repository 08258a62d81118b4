"""Corpus-wide word tables: counting, and telling frequent words from rare ones.

Counts are combined in every task before they are shuffled by word. A word that makes up
at least ``share`` of all tokens is *frequent*; there can be at most ``1 / share`` of those, so
a table of them may be broadcast at any size of the corpus. The other words, none of which
is a hot key, are joined by shuffling.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different words that a task holds before it hands its counts on.
HELD_WORDS = 150_000


def word_counts(rows: DataFrame, split: Callable[[str | None], list[bytes]], share: float = 0.0) -> DataFrame:
    """(word, n, n_train) over ``rows`` (text, train): tokens of all rows and of those with train true.

    With a ``share``, a task leaves out the words that are below that share of its own tokens. A
    word that reaches the share of all tokens reaches it in one task at least, so no such
    word is missing, but counts are then lower bounds. Only for choosing what to broadcast.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def flushed() -> pa.RecordBatch:
            every, train = held
            words = list(every.keys() | train.keys())
            if share:
                least = max(2.0, share * (every.total() + train.total()))
                words = [w for w in words if every.get(w, 0) + train.get(w, 0) >= least]
            n_train = [train.get(w, 0) for w in words]
            n = [every.get(w, 0) + t for w, t in zip(words, n_train, strict=True)]
            every.clear()
            train.clear()
            return pa.record_batch([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(n_train, pa.int64())], ["word", "n", "n_train"])

        for batch in batches:
            for text, train in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[bool(train)].update(split(text))
                if len(held[0]) + len(held[1]) > HELD_WORDS:
                    yield flushed()
        yield flushed()

    parts = rows.select("text", "train").mapInArrow(count, "word string, n long, n_train long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train"))
