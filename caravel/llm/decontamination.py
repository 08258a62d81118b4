"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all benchmark items form one automaton. A document's words are
streamed through it once while the length of the longest match that ends at each word is
tracked; where it reaches the window, the window's words are hit, and the state that
stands for the window names the items it occurs in. Work is linear in the words of the
documents and does not depend on the number of items.

Documents are only mapped over, never shuffled. The automaton is broadcast; its size is
checked, and a benchmark of more than ``block_words`` words is dealt by a hash into blocks of about that size. Blocks are
passes one after another whose hits are written with the rows, so a task holds one block's automaton at a time whatever the
benchmark's size. A long item is cut into parts that overlap by a window less one word, so no window is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy, unused, without, written

WINDOW = 10
BLOCK_WORDS = 100_000
#: A-Z in lower case; every other ASCII character but digits and a-z becomes a space.
_BYTES = bytes(b if b > 127 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b | 32 if 65 <= b <= 90 else 32 for b in range(256))
_POINTS = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def words_of(text: str | None) -> list[bytes]:
    """Normalised words as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split(b" ") if text else []


def _words(text: str | None) -> list[bytes]:
    return [w for w in words_of(text) if w]


class Automaton:
    """Generalised suffix automaton over words, with the items of each window."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        """``items`` are (id, text); an id may have several texts."""
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = []
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in _words(text)]
            if words:
                texts.append((item, words))
                at = 0
                for w in words:
                    at = self._extend(at, w)
        # what a match that ends in a state stands for
        self.full: dict[int, set] = {}
        self.short: dict[int, dict[int, set]] = {}
        for item, words in texts:
            at, matched = 0, 0
            for w in words:
                at, matched = self.next[at][w], matched + 1
                while self.length[self.link[at]] >= window:
                    at = self.link[at]
                matched = min(matched, self.length[at])
                if matched >= window:
                    self.full.setdefault(at, set()).add(item)
            if len(words) < window:
                self.short.setdefault(at, {}).setdefault(len(words), set()).add(item)
        # the least match length that means a hit, by state
        never = 1 << 60
        self.fires = [never] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = min(self.short.get(s, {never: 0}))
            if self.length[s] >= window:
                own = min(own, window)
            self.fires[s] = min(own, self.fires[self.link[s]])

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, w, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """(words, hit spans of words with exclusive ends, items whose windows occur)."""
        words = _words(text)
        nxt, link, length, fires, window = self.next, self.link, self.length, self.fires, self.window
        spans: list[list[int]] = []
        items: set = set()
        seen: set[int] = set()
        state = matched = 0
        for i, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                state = matched = 0
                continue
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nxt[state].get(w)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= fires[state]:
                reach = matched if matched >= window else 0
                if state not in seen:
                    # a state stands for matches of several lengths; only a full one is remembered
                    if matched == length[state]:
                        seen.add(state)
                    at = state
                    while at > 0:
                        if matched >= window and length[at] >= window > length[link[at]]:
                            items |= self.full.get(at, set())
                        for n, found in self.short.get(at, {}).items():
                            if n <= matched:
                                items |= found
                        at = link[at]
                if not reach:
                    at = state
                    while at > 0:
                        reach = max([reach, *(n for n in self.short.get(at, {}) if n <= matched)])
                        at = link[at]
                if spans and spans[-1][1] >= i + 1 - reach:
                    spans[-1][1] = i + 1
                    # a long match may reach back over earlier spans
                    while len(spans) > 1 and spans[-2][1] >= i + 1 - reach:
                        spans[-2][1] = i + 1
                        spans.pop()
                    spans[-1][0] = min(spans[-1][0], i + 1 - reach)
                else:
                    spans.append([i + 1 - reach, i + 1])
        return len(words), [tuple(x) for x in spans], sorted(str(x) for x in items if x is not None)


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _hits(rows: list[tuple[int, list[tuple[int, int]], list[str]]]) -> pa.StructArray:
    spans = pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in rows], _SPANS)
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int64()), spans, pa.array([r[2] for r in rows], pa.list_(pa.string()))], ["n_words", "spans", "items"])


def _joined(parts: list[dict | None]) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Hits of several blocks as one."""
    spans: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for p in parts for s in p["spans"]):
        if spans and spans[-1][1] >= a:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return max(p["n_words"] for p in parts), [tuple(x) for x in spans], sorted({i for p in parts for i in p["items"]})


def find_leaks(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, out: str = "leaks", cut_words: int | None = None) -> DataFrame:
    """Adds ``out``: n_words, hit spans (of words, exclusive ends, merged) and the items found.

    An item shorter than the window is one window; an item without words is none. Null
    and empty texts have no words, repeated rows have the same hits, and an empty table stays empty. Items with a null id hit but aren't listed; an id given
    to several items is listed once. With ``cut_words``, and a benchmark of one block, ``out`` also holds the text without
    spans of so many words, so that one Python function does both. Without items nothing is hit. A column already called
    ``out`` is replaced.
    """
    spark = df.sparkSession
    normal = F.regexp_extract_all(F.translate(F.col(item_text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    listed = items.select(F.col(item_col).cast("string").alias("i"), normal.alias("w")).where(F.size("w") > 0)
    # parts of long items begin ``step`` words apart and reach a window less one word into the next
    step = max(1, block_words // 8)
    last = F.greatest(F.size("w") - window, F.lit(0))
    parts = listed.select("i", "w", F.explode(F.sequence(F.lit(0), F.floor(last / step).cast("int") * step, F.lit(step))).alias("at"))
    rows = parts.select("i", F.array_join(F.slice("w", F.col("at") + 1, step + window - 1), " ").alias("t"))
    total = parts.agg(F.sum(F.least(F.lit(step + window - 1), F.size("w") - F.col("at"))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_words))

    def scanner(block: int):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("t", "i"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(Automaton([(r["i"], r["t"]) for r in own.collect()], window))

        both = blocks == 1 and cut_words is not None

        @F.arrow_udf(T.StructType([*HITS.fields, T.StructField("cut", T.StringType())]) if both else HITS)
        @tidy
        def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            of = shared.value.scan
            for batch in texts:
                rows, cut = [], []
                for i in range(0, len(batch), 256):
                    listed = batch.slice(i, 256).to_pylist()
                    new = [of(t) for t in listed]
                    rows += new
                    if both:
                        cut.append(pa.array([cut_text(t, r[1], cut_words) for t, r in zip(listed, new, strict=True)], pa.string()))
                found = _hits(rows)
                if both:
                    cut = pa.concat_arrays(cut) if cut else pa.array([], pa.string())
                    found = pa.StructArray.from_arrays([*found.flatten(), cut], ["n_words", "spans", "items", "cut"])
                yield found

        return scan(F.col(f"`{text_col}`").cast("string"))

    base = without(df, [out], (text_col,))
    if blocks == 1:
        return base.withColumn(out, scanner(0))

    @F.arrow_udf(HITS)
    def join(parts: pa.Array) -> pa.Array:
        return _hits([_joined(p) for p in parts.to_pylist()])

    # rows are numbered once; a pass reads their texts and writes the hits of rows that have any, and the texts meet the hits at the end
    row, text = unused("row", base), F.col(f"`{text_col}`")
    numbered = written(base.withColumn(row, F.monotonically_increasing_id()), "numbered")
    passes = None
    for block in range(blocks):
        found = numbered.select(F.col(row), text).withColumn("_hits", scanner(block)).select(row, "_hits")
        # the first pass counts the words of all
        found = written(found if block == 0 else found.where(F.size("_hits.spans") > 0), "hits")
        passes = found if passes is None else passes.unionByName(found)
    merged = passes.groupBy(row).agg(F.collect_list("_hits").alias("_all")).select(row, join("_all").alias(out))
    return numbered.join(merged, row).select(*[F.col(f"`{c}`") for c in base.columns], out)


def cut_text(text: str | None, spans: list[tuple[int, int]], span_words: int) -> str | None:
    """The text without its hit spans of ``span_words`` words or more."""
    long = [(a, b) for a, b in spans if b - a >= span_words]
    if not long:
        return text
    places = [m.span() for m in _POINTS.finditer(text)]
    parts, at = [], 0
    for a, b in long:
        parts.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*parts, text[at:]])


def cut_spans(text_col: str, leaks: str, span_words: int):
    """``cut_text`` of a text column and the spans that ``find_leaks`` added."""

    @F.arrow_udf(T.StringType())
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([cut_text(t, [(s["start"], s["end"]) for s in found or []], span_words) for t, found in pairs], pa.string())

    return cut(F.col(f"`{text_col}`").cast("string"), F.col(f"{leaks}.spans"))


def decontaminate(df: DataFrame, items: DataFrame, text_col: str = "text", span_words: int = WINDOW, max_coverage: float = 0.5, **options) -> DataFrame:
    """Removes hit spans of ``span_words`` words or more, and rows whose hit share is over ``max_coverage``.

    Columns stay as they are; a column ``n_chars`` follows its shortened text.
    Rows without hits pass unchanged, null texts too.
    """
    leaks = unused("leaks", df)
    cut_text = unused("cut", df)
    found = find_leaks(df, items, text_col, out=leaks, cut_words=span_words, **options)
    text = F.col(f"{leaks}.cut") if "cut" in found.schema[leaks].dataType.names else cut_spans(text_col, leaks, span_words)
    hit = F.aggregate(f"{leaks}.spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    kept = found.where(hit <= F.lit(max_coverage) * F.col(f"{leaks}.n_words"))
    touched = F.exists(f"{leaks}.spans", lambda s: s["end"] - s["start"] >= span_words)
    cut = kept.withColumn(cut_text, F.when(touched, text).otherwise(F.col(text_col)))
    out = []
    for c in df.columns:
        if c == text_col:
            out.append(F.col(cut_text).alias(c))
        elif c == "n_chars":
            out.append(F.when(touched, F.length(cut_text).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return cut.select(*out)


def leaks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: hits of all ``documents`` against all of ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_leaks(docs, items).select("doc_id", "leaks.*")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def brute_leaks(text: str | None, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> tuple[int, set[int], set[str]]:
    """(words, hit words, items) by comparing every window with every place (for tests)."""
    normal = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = normal(text), set(), set()
    for item, t in items:
        w = normal(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(item)
    return len(words), hit, {str(x) for x in found if x is not None}


_WORDS_SQL = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
LEAKS_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents), b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS g FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS n, unnest(range(len(w) - least({WINDOW}, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw), dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY 1),
q AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)"""
