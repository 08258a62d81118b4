"""SentencePiece encoding and decoding over a relational lattice.

The text is normalised as the vocabulary's library does (one space in front, spaces as
``▁``) and cut wherever no piece can reach over: between two characters that stand side by side in no
piece, so every path passes there and the best path falls into those of the segments. For a segment's
lattice all substrings up to the longest piece are exploded (up to the longest piece that begins alike)
and equi-joined to the piece table; the edges are grouped by segment, sorted by
their end and folded to the best path with ``aggregate``: the greatest sum of the vocabulary's
scores, on ties the longest last piece. Characters without a piece are spelled in byte pieces.

Plan. Every different segment is solved once:

1. Segments are counted (combined and pruned per task). Frequent ones, at most ``1 / share`` of them
   at any corpus size, are solved and broadcast as two Arrow columns (segment, path).
2. Texts are taken in blocks of about ``BLOCK_BYTES``. The other segments of a block are dealt by a hash
   into buckets, one row for each block and bucket. Within a bucket each different segment is solved
   once, and the paths go back to the blocks that asked, in the order they were asked for.
3. A block (packed) meets its paths and becomes rows again. Ids are looked up for all pieces of the
   block's different segments at once and spread over its texts; no text is a Python object.

So texts are shuffled once and the rest is one row of packed segments or paths a block and
bucket. Buckets and partitions follow the number of tokens, so a task's edges stay bounded. A
path holds one character a piece. The lattice of one segment is one row: about a hundred bytes a
character of the segment, and the fold copies the lengths found so far (one byte a character) at every character.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, read_bytes, tidy, tokenizer_path, without, written

SPACE = "▁"
SHARE = 5e-7
#: Bytes of text in a block, about; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Tokens of a partition, about.
TASK_TOKENS = 2_000_000
#: Buckets of segments at least, and tokens for which there is one more. A block has a row for each bucket that it has
#: segments of, so there are never more rows than segments.
BUCKETS, BUCKET_TOKENS = 1024, 4_000_000
#: Different segments that a counting task holds before it hands its counts on.
HELD_SEGMENTS = 300_000
#: Characters up to which a segment is its own key; the digest of a longer one is.
KEY_CHARS = 64
#: Places of a segment whose substrings are cut out of one slice of it.
SLICE = 64
#: Characters of a piece by which substrings are bounded.
PREFIX = 3


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    longest: int
    unknown_score: float

    @classmethod
    def load(cls, model: bytes) -> Vocabulary:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = tuple(p.id_to_piece(i) for i in range(p.get_piece_size()))
        scores = tuple(p.get_score(i) for i in range(len(pieces)))
        usable = [i for i in range(len(pieces)) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        if any(SPACE in pieces[i].lstrip(SPACE) or "\n" in pieces[i] for i in usable):
            raise ValueError("a piece reaches over a space or a line break")
        keep = set(usable)
        named = tuple(x if i in keep or p.is_byte(i) else "" for i, x in enumerate(pieces))
        low = min(scores[i] for i in usable if scores[i] > -1e8)
        return cls(named, scores, max(len(pieces[i]) for i in usable), low - 10)

    def table(self) -> list[tuple[str, int, float]]:
        return [(x, i, self.scores[i]) for i, x in enumerate(self.pieces) if x and not re.fullmatch("<0x[0-9A-F]{2}>", x)]

    @cached_property
    def known(self) -> dict[str, tuple[int, float]]:
        return {x: (i, s) for x, i, s in self.table()}

    @cached_property
    def pairs(self) -> set[str]:
        """Characters that stand side by side in a piece, with spaces as spaces."""
        return {x[i : i + 2] for x, _, _ in self.table() for x in (x.replace(SPACE, " "),) for i in range(len(x) - 1)}

    def segments(self, text: str | None) -> list[str]:
        """Segments of the normalised text, with spaces still as spaces; none for null and empty (for tests)."""
        if not text:
            return []
        led, pairs = " " + text, self.pairs
        plain = led.replace(SPACE, " ")
        cuts = [0, *[i for i in range(1, len(led)) if plain[i - 1 : i + 1] not in pairs], len(led)]
        return [led[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def spelled(self) -> dict[int, int]:
        """Id of each byte."""
        return {int(m[1], 16): i for i, x in enumerate(self.pieces) if (m := re.fullmatch("<0x([0-9A-F]{2})>", x))}


# --- the lattice ---------------------------------------------------------------------------------


def best_path(segment: str, known: dict[str, tuple[int, float]], longest: int, unknown: float) -> list[tuple[int, int, int]]:
    """(start, end, id or -1) of the best path, in a plain loop (for tests)."""
    n = len(segment)
    best: list[tuple[float, int, int]] = [(0.0, 0, -1)]
    for j in range(1, n + 1):
        top = None
        for i in range(max(0, j - longest), j):
            if (e := known.get(segment[i:j])) is not None:
                s = best[i][0] + e[1]
                if top is None or s > top[0]:
                    top = (s, i, e[0])
        if segment[j - 1] not in known and (top is None or best[j - 1][0] + unknown > top[0]):
            top = (best[j - 1][0] + unknown, j - 1, -1)
        best.append(top)
    path, j = [], n
    while j:
        _, i, piece = best[j]
        path.append((i, j, piece))
        j = i
    return path[::-1]


def _fold(edges: Column, longest: int) -> Column:
    """From edges (end, start, score) sorted by end and start: for every place the length of the piece that the
    best path ends there with, a character each, behind one more character.

    The state holds the place whose edges are being read with its best score and the length of that piece, the scores
    of the ``longest`` places before it, and the lengths of all places before it.
    """
    state = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("best"), F.lit(0).alias("length"), F.array(*[F.lit(None).cast("double")] * longest).alias("last"), F.lit("").alias("back"))

    def settled(acc: Column) -> Column:
        return F.concat(acc["back"], F.char(acc["length"].cast("long")))

    def step(acc: Column, e: Column) -> Column:
        length = e["end"] - e["start"]
        same = F.get(acc["last"], longest - length) + e["score"]
        better = F.struct(acc["at"].alias("at"), same.alias("best"), length.alias("length"), acc["last"].alias("last"), acc["back"].alias("back"))
        moved = F.when(length == 1, acc["best"]).otherwise(F.get(acc["last"], longest + 1 - length)) + e["score"]
        last = F.concat(F.slice(acc["last"], 2, longest - 1), F.array(acc["best"]))
        next_ = F.struct(e["end"].alias("at"), moved.alias("best"), length.alias("length"), last.alias("last"), settled(acc).alias("back"))
        return F.when(e["end"] == acc["at"], F.when(same > acc["best"], better).otherwise(acc)).otherwise(next_)

    return F.aggregate(edges, state, step, settled)


def walked(backs: pa.Array) -> pa.Array:
    """Paths (lengths of the pieces in order) from the results of ``_fold``, all walked back together."""
    at, data = _bytes(_one_byte(backs))
    place = np.diff(at) - 1
    row = np.flatnonzero(place > 0)
    rows, lengths, ends = [], [], []
    while row.size:
        length = data[at[row] + place[row]].astype(np.int64)
        rows.append(row)
        lengths.append(length)
        ends.append(place[row])
        place[row] -= length
        row = row[place[row] > 0]
    if not rows:
        return pa.array([""] * len(backs), pa.large_string())
    rows, lengths, ends = (np.concatenate(x) for x in (rows, lengths, ends))
    order = np.lexsort((ends, rows))
    offsets = np.append(0, np.cumsum(np.bincount(rows, minlength=len(backs))))
    path = lengths[order].astype(np.uint8)
    if path.max() < 128:
        return _strings(offsets, pa.py_buffer(path))
    return pa.array([path[a:b].tobytes().decode("latin-1") for a, b in zip(offsets, offsets[1:], strict=False)], pa.large_string())


def _one_byte(strings: pa.Array) -> pa.Array:
    """Strings of characters up to 255 with one byte each (for reading their bytes only)."""
    _, data = _bytes(strings)
    if not (data > 127).any():
        return strings if not strings.offset else pa.concat_arrays([strings])
    return pa.array([x.encode("latin-1") for x in strings.to_pylist()], pa.large_binary())


def key_of(segment: Column) -> Column:
    """The segment itself, or a digest of a long one, which no segment equals."""
    return F.when(F.length(segment) <= KEY_CHARS, segment).otherwise(F.concat(F.lit("\n"), F.sha2(segment.cast("binary"), 256)))


def solve(segments: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(bucket, key, back) of different segments (bucket, segment) that are dealt by ``bucket``: that stays, nothing is exchanged."""
    spark, table = segments.sparkSession, vocabulary.table()
    pieces = spark.createDataFrame([(x, s) for x, _, s in table], "piece string, score double")
    reach: dict[str, int] = {}
    for x, _, _ in table:
        if len(x) >= PREFIX:
            reach[x[:PREFIX]] = max(reach.get(x[:PREFIX], 0), len(x))
    prefixes = spark.createDataFrame(list(reach.items()), "prefix string, reach int")
    whole = segments.select("bucket", key_of(F.col("segment")).alias("key"), F.regexp_replace("segment", " ", SPACE).alias("s"))
    # slices first, so that a substring of a long segment isn't searched from its beginning
    at = whole.select("bucket", "key", "s", F.explode(F.sequence(F.lit(0), F.greatest(F.length("s") - 1, F.lit(0)), F.lit(SLICE))).alias("base"))
    parts = at.select("bucket", "key", "base", F.expr(f"substring(s, base + 1, {SLICE + vocabulary.longest - 1})").alias("part"))
    starts = parts.select("bucket", "key", "base", "part", F.explode(F.sequence(F.lit(0), F.least(F.lit(SLICE), F.length("part")) - 1)).alias("i"))
    ahead = starts.select("bucket", "key", (F.col("base") + F.col("i")).alias("start"), F.expr(f"substring(part, i + 1, {vocabulary.longest})").alias("ahead"))
    bound = ahead.withColumn("prefix", F.substring("ahead", 1, PREFIX)).join(F.broadcast(prefixes), "prefix", "left")
    lengths = F.sequence(F.lit(1), F.least(F.coalesce("reach", F.lit(PREFIX - 1)), F.length("ahead")))
    subs = bound.select("bucket", "key", "start", "ahead", F.explode(lengths).alias("n")).select("bucket", "key", "start", "n", F.expr("substring(ahead, 1, n)").alias("piece"))
    met = subs.join(F.broadcast(pieces), "piece", "left").where("score is not null or n = 1")
    edge = F.struct((F.col("start") + F.col("n")).alias("end"), "start", F.coalesce("score", F.lit(vocabulary.unknown_score)).alias("score"))
    edges = met.groupBy("bucket", "key").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    return edges.select("bucket", "key", _fold(F.col("edges"), vocabulary.longest).alias("back"))


# --- texts as Arrow columns ------------------------------------------------------------------------


def _strings(offsets: np.ndarray, data: pa.Buffer) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), data)


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of large strings without nulls that begin at 0."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _large(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.cast(texts, pa.large_string())


class Cutter:
    """Cuts texts between characters that are side by side in no piece."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        pairs = sorted(vocabulary.pairs)
        alphabet = sorted({c for p in pairs for c in p} | {" "})
        self.kind = np.zeros(0x110000, np.uint16)  # 0: in no pair
        for n, c in enumerate(alphabet):
            self.kind[ord(c)] = n + 1
        self.kind[ord(SPACE)] = self.kind[ord(" ")]
        self.kinds = len(alphabet) + 1
        self.parted = np.ones(self.kinds * self.kinds, bool)
        for a, b in pairs:
            self.parted[int(self.kind[ord(a)]) * self.kinds + int(self.kind[ord(b)])] = False

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(segments of all texts, how many each text has); the segments are views of one buffer."""
        counts = np.zeros(len(texts), np.int64)
        real = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
        if not real.size:
            return pa.array([], pa.large_string()), counts
        led = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.take(pa.array(real)), pa.scalar("", pa.large_string()))
        at, data = _bytes(led)
        data = data[: at[-1]]
        points = np.flatnonzero((data & 0xC0) != 0x80)
        kind = self.kind[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)].astype(np.int32)
        begins = np.append(True, self.parted[kind[:-1] * self.kinds + kind[1:]])
        first = np.searchsorted(points, at[:-1])
        begins[first] = True
        counts[real] = np.add.reduceat(begins.astype(np.int64), first)
        return _strings(np.append(points[begins], at[-1]), led.buffers()[2]), counts


def keys_of(segments: pa.Array) -> pa.Array:
    """``key_of`` for an array."""
    long = np.flatnonzero(pc.greater(pc.utf8_length(segments), KEY_CHARS).to_numpy(zero_copy_only=False))
    if not long.size:
        return segments
    keys = segments.to_pylist()
    for i in long:
        keys[i] = "\n" + hashlib.sha256(keys[i].encode()).hexdigest()
    return pa.array(keys, pa.large_string())


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _own_memory() -> None:
    """Arrow's memory in a worker comes from the system, which takes large pieces back at once."""
    pa.set_memory_pool(pa.system_memory_pool())


def blocks_of(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[int, pa.Table]]:
    """(number, rows) of blocks; where they end depends on the texts of ``column`` alone, not on batches."""
    _own_memory()
    part, n, held, room = TaskContext.get().partitionId() << 36, 0, [], BLOCK_BYTES
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        done = 0
        while done < batch.num_rows:
            ends = np.cumsum(sizes[done:])
            k = int(np.searchsorted(ends, room))
            if k == len(ends):
                # a copy, as a slice would hold the whole batch
                held.append(batch.take(pa.array(np.arange(done, batch.num_rows))))
                room -= int(ends[-1])
                break
            held.append(batch.slice(done, k + 1))
            yield part + n, pa.Table.from_batches(held)
            done, n, held, room = done + k + 1, n + 1, [], BLOCK_BYTES
        # let go before the next batch is read
        batch = sizes = ends = None
    if held:
        yield part + n, pa.Table.from_batches(held)


def _check(texts: pa.Array) -> int:
    """Tells blocks of different texts apart."""
    sizes = pc.fill_null(pc.binary_length(texts), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    at, data = _bytes(pc.fill_null(texts, ""))
    return zlib.crc32(data[at[0] : at[-1]], zlib.crc32(sizes.tobytes()))


class Coder:
    """Paths to ids and ids to text, for whole blocks."""

    def __init__(self, vocabulary: Vocabulary, keys: pa.Array | None = None, paths: pa.Array | None = None) -> None:
        self.vocabulary = vocabulary
        self.keys = pa.array([], pa.large_string()) if keys is None else keys
        self.paths = pa.array([], pa.large_string()) if paths is None else paths
        self._table: pa.Array | None = None

    def __getstate__(self):
        return (self.vocabulary, self.keys, self.paths)

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def _load(self) -> None:
        if self._table is None:
            rows = self.vocabulary.table()
            spelled = self.vocabulary.spelled()
            self._table = pa.array([x for x, _, _ in rows], pa.large_string())
            self._ids = np.array([i for _, i, _ in rows], np.int32)
            self._byte_ids = np.array([spelled.get(b, -1) for b in range(256)], np.int32)
            byte_of = {i: b for b, i in spelled.items()}
            out = [bytes([byte_of[i]]) if i in byte_of else x.replace(SPACE, " ").encode() for i, x in enumerate(self.vocabulary.pieces)]
            self._out = np.frombuffer(b"".join(out), np.uint8)
            self._out_ends = np.cumsum([len(x) for x in out])
            self._out_sizes = np.diff(self._out_ends, prepend=0)
            self._cutter = Cutter(self.vocabulary)

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        self._load()
        return self._cutter.cut(texts)

    def rare(self, segments: pa.Array, buckets: int) -> tuple[pa.Array, np.ndarray]:
        """(different segments that aren't frequent by bucket and first place, their buckets)."""
        unsolved = pc.is_null(pc.index_in(keys_of(segments), value_set=self.keys))
        found = segments.filter(unsolved)
        bucket = np.array([zlib.crc32(s) % buckets for s in found.cast(pa.large_binary()).to_pylist()], np.int64)
        order = np.argsort(bucket, kind="stable")
        return found.take(pa.array(order)), bucket[order]

    def ids(self, texts: pa.Array, rare_paths: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each text has); ``rare_paths`` are those of ``rare``'s segments, joined."""
        self._load()
        segments, per_text = self.cut(texts)
        if not len(segments):
            return np.zeros(0, np.int32), per_text
        coded = segments.dictionary_encode()
        different, place = coded.dictionary, coded.indices.to_numpy()
        rare, _ = self.rare(different, buckets)
        known = pc.index_in(keys_of(different), value_set=self.keys)
        frequent = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))
        ordered = pa.concat_arrays([different.take(pa.array(frequent)), rare])
        # frequent ones first, then the rare ones in the order of their paths
        rank = np.empty(len(different), np.int64)
        rank[frequent] = np.arange(len(frequent))
        where = pc.index_in(rare, value_set=different).to_numpy()
        rank[where] = len(frequent) + np.arange(len(rare))
        _, data = _bytes(_one_byte(pa.concat_arrays([self.paths.take(pc.drop_null(known)), pa.array([rare_paths], pa.large_string())])))
        ends = np.cumsum(data, dtype=np.int64)

        marked = pc.replace_substring(ordered, " ", SPACE)
        at, raw = _bytes(marked)
        raw = raw[: at[-1]]
        points = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        last = np.searchsorted(ends, np.cumsum(pc.utf8_length(marked).to_numpy()))  # last piece of each segment
        if len(ends) == 0 or ends[-1] != len(points) - 1:
            raise RuntimeError("paths and segments of a block don't fit: its input gives other rows when read again")
        cuts = points[np.append(0, ends)]
        pieces = _strings(cuts, marked.buffers()[2])
        found = pc.index_in(pieces, value_set=self._table)
        lost = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        sizes = np.ones(len(pieces), np.int64)
        sizes[lost] = cuts[lost + 1] - cuts[lost]
        ids = np.repeat(self._ids[pc.fill_null(found, 0).to_numpy()], sizes)
        if lost.size:
            first = np.cumsum(sizes) - sizes
            ids[_ragged(first[lost], sizes[lost])] = self._byte_ids[raw[_ragged(cuts[lost], sizes[lost])]]
        upto = np.cumsum(sizes)[last]
        count = np.diff(upto, prepend=0)
        token = rank[place]
        spread = ids[_ragged((upto - count)[token], count[token])]
        sums = np.append(0, np.cumsum(count[token]))
        text_ends = np.append(0, np.cumsum(per_text))
        return spread, np.diff(sums[text_ends])

    def texts(self, ids: np.ndarray, per_text: np.ndarray) -> pa.Array:
        """Texts of ids; broken byte runs become U+FFFD."""
        self._load()
        sizes = self._out_sizes[ids]
        data = self._out[_ragged(self._out_ends[ids] - sizes, sizes)]
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(per_text))]
        # without the space that the normalisation put in front
        begins = ends[:-1] + ((np.diff(ends) > 0) & (np.append(data, 0)[ends[:-1]] == 32))
        kept = np.ones(len(data), bool)
        kept[ends[:-1][begins > ends[:-1]]] = False
        offsets = np.append(0, np.cumsum(ends[1:] - begins))
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(per_text), [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data[kept]))])
        try:
            return pc.cast(found, pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in found.to_pylist()], pa.large_string())

    def looped(self, segment: str) -> list[int]:
        """Ids of a segment by the plain loop (for tests)."""
        self._load()
        v = self.vocabulary
        t, out = segment.replace(" ", SPACE), []
        for a, _, i in best_path(t, v.known, v.longest, v.unknown_score):
            out += [i] if i >= 0 else [self._byte_ids[b] for b in t[a].encode()]
        return out


def _lists(ids: np.ndarray, counts: np.ndarray, valid: np.ndarray) -> pa.Array:
    offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()), mask=pa.array(~valid))


# --- the operators ---------------------------------------------------------------------------------


def frequent_segments(texts: DataFrame, vocabulary: Vocabulary, share: float) -> tuple[DataFrame, int]:
    """(segment) of at least ``share`` of all segments, and the number of all.

    A task leaves out what is below the share of its own; a segment that reaches the share of
    all reaches it in one task at least, and may then count less than it occurs. Only for choosing what to broadcast.
    """

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter(vocabulary).cut
        held, size, tokens, since = [], 0, 0, 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("segment").aggregate([("n", "sum")]).rename_columns(["segment", "n"])

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            kept = table.filter(pc.greater_equal(table["n"], max(2, share * since)))
            yield from kept.cast(pa.schema([("segment", pa.string()), ("n", pa.int64())])).to_batches()

        for _, rows in blocks_of(batches):
            found = pc.value_counts(cut(_large(rows.column(0)))[0])
            n = pc.sum(found.field("counts")).as_py() or 0
            tokens, since = tokens + n, since + n
            held.append(pa.table({"segment": found.field("values"), "n": found.field("counts")}))
            size += len(found)
            if size > HELD_SEGMENTS:
                held = [merged()]
                size = held[0].num_rows
                if size > HELD_SEGMENTS // 2:
                    yield from out(held[0])
                    held, size, since = [], 0, 0
        if held:
            yield from out(merged())
        yield pa.record_batch([pa.array([None], pa.string()), pa.array([tokens], pa.int64())], ["segment", "n"])

    counted = texts.mapInArrow(count, "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))
    counted = written(counted.where("n > 1 or segment is null"), "segments")
    tokens = counted.where("segment is null").agg(F.sum("n")).first()[0] or 0
    # a line break parts segments where they are listed, so it is always known
    often = counted.where((F.col("n") >= max(2, share * tokens)) & F.col("segment").isNotNull() & (F.col("segment") != "\n")).select("segment")
    return often.unionByName(texts.sparkSession.createDataFrame([("\n",)], "segment string")), tokens


def encode(df: DataFrame, vocabulary: bytes, text_col: str = "text", share: float = SHARE, out: str = "piece_ids", round_trip: str | None = None) -> DataFrame:
    """Adds ``out``: array<int>, the ids of the best path. Null text: null; empty text: empty.
    ``round_trip`` names a boolean column to add: whether decoding the ids gives the text back (true for null).

    Repeated rows are encoded alike, texts and segments of any length whole, and an empty table
    gives an empty result. Other columns travel packed, so their names clash with nothing; a column
    already called ``out`` is replaced. ``df`` must give its rows in one order whenever it is read, as tables
    do; blocks that change fail the job.
    """
    spark = df.sparkSession
    v = Vocabulary.load(vocabulary)
    base = without(df, [out, *([round_trip] if round_trip else [])], (text_col,))
    base = base.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    texts, place = base.select(F.col(f"`{text_col}`").alias("text")), base.columns.index(text_col)
    frequent, tokens = frequent_segments(texts, v, share)
    n = max(2 * spark.sparkContext.defaultParallelism, -(-tokens // TASK_TOKENS))
    buckets = max(BUCKETS, -(-tokens // BUCKET_TOKENS))
    solved = solve(frequent.select(F.pmod(F.xxhash64("segment"), F.lit(buckets)).cast("int").alias("bucket"), "segment").repartition(min(n, buckets), "bucket"), v).select("key", "back").toArrow()
    shared = spark.sparkContext.broadcast(Coder(v, _large(solved["key"]), walked(_large(solved["back"]))))

    @tidy
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in blocks_of(batches):
            own = _large(rows.column(0))
            found, bucket = shared.value.rare(shared.value.cut(own)[0].unique(), buckets)
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            lists = pa.LargeListArray.from_arrays(pa.array(np.append(first, len(found))), found)
            columns = [pa.array(bucket[first], pa.int32()), pa.array(np.full(len(first), block), pa.int64()), pc.binary_join(lists, pa.scalar("\n", pa.large_string())).cast(pa.string())]
            yield pa.record_batch(columns, ["bucket", "block", "segments"])

    @tidy
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for block, rows in blocks_of(batches, place):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as stream:
                stream.write_table(rows.combine_chunks())
            columns = [pa.array([block], pa.int64()), pa.array([_check(_large(rows.column(place)))], pa.int64()), pa.array([pack(sink.getvalue())], pa.binary())]
            yield pa.record_batch(columns, ["block", "check", "rows"])

    dealt = texts.mapInArrow(asked, "bucket int, block long, segments string").repartition(min(n, buckets), "bucket")
    different = dealt.select("bucket", F.explode(F.split("segments", "\n")).alias("segment")).distinct()
    solved = solve(different, v)

    def answered(asking: pa.Table, found: pa.Table) -> pa.Table:
        _own_memory()
        lists = pc.split_pattern(_large(asking["segments"]), "\n")
        at = pc.index_in(keys_of(_large(pc.list_flatten(lists))), value_set=_large(found["key"]))
        got = pa.LargeListArray.from_arrays(pc.cast(lists.offsets, pa.int64()), walked(_large(found["back"])).take(at))
        joined = pc.binary_join(got, pa.scalar("", pa.large_string())).cast(pa.string())
        lists = at = got = None
        give_back()
        return pa.table({"block": asking["block"], "bucket": asking["bucket"], "paths": joined})

    answers = dealt.groupBy("bucket").cogroup(solved.select(F.col("bucket").alias("own"), "key", "back").groupBy("own")).applyInArrow(answered, "block long, bucket int, paths string")
    fields = [*base.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(round_trip, T.BooleanType())] if round_trip else [])]

    def coded(blocks: pa.Table, paths: pa.Table) -> pa.Table:
        _own_memory()
        own = shared.value
        rare = "".join(paths.sort_by("bucket")["paths"].to_pylist())
        tables = []
        for check, rows in zip(blocks["check"].to_pylist(), blocks["rows"], strict=True):
            table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rows.as_py())).read_all()
            own_texts = _large(table.column(place))
            if _check(own_texts) != check:
                raise RuntimeError("a block was damaged on its way")
            ids, counts = own.ids(own_texts, rare, buckets)
            valid = own_texts.is_valid().to_numpy(zero_copy_only=False)
            table = table.append_column(out, _lists(ids, counts, valid))
            if round_trip:
                same = pc.fill_null(pc.equal(own.texts(ids, counts), own_texts), True)
                table = table.append_column(round_trip, same)
            tables.append(table)
        rare = own_texts = ids = counts = None
        give_back()
        return pa.concat_tables(tables)

    blocks = base.mapInArrow(packed, "block long, check long, rows binary").repartition(n, "block")
    return blocks.groupBy("block").cogroup(answers.select(F.col("block").alias("own"), "bucket", "paths").repartition(n, "own").groupBy("own")).applyInArrow(coded, T.StructType(fields))


def decode(df: DataFrame, vocabulary: bytes, ids_col: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the text of the ids. Null ids: null; no ids: empty. Broken byte runs become U+FFFD."""
    shared = df.sparkSession.sparkContext.broadcast(Coder(Vocabulary.load(vocabulary)))

    @F.arrow_udf(T.StringType())
    def text(ids: pa.Array) -> pa.Array:
        counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = shared.value.texts(pc.list_flatten(ids).to_numpy(zero_copy_only=False), counts).cast(pa.string())
        return pc.if_else(ids.is_valid(), found, pa.scalar(None, pa.string()))

    return without(df, [out], (ids_col,)).withColumn(out, text(F.col(f"`{ids_col}`")))


def subword_query(spark: SparkSession, sf_dir: str, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """Every document with its piece ids, and whether decoding them gives the text back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = read_bytes(tokenizer_path(vocabulary))
    coded = encode(docs, model, round_trip="round_trip")
    return coded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "round_trip")
