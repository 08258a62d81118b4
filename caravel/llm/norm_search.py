"""Exact top-k inner products by norm-bucketed retrieval (operator 11).

All vectors are sorted by length, longest first, and cut into buckets of a fixed number of rows, so
neither a common length nor a group of copies makes a bucket larger. A query that already
has k scores of at least t finds nothing in a bucket whose longest vector is l unless some cosine there
reaches the *local threshold* t / (|q| l). Above 1 the bucket is left out. From ``coordinate_from``
on, the query's largest coordinates bound those of any vector that reaches the threshold, and
sorted coordinate lists give the candidates; below it, that bound says little, and only the vectors that are
long enough are candidates: a prefix of the bucket. The products of all candidates are then
computed exactly.

Queries are read in passes of at most ``pass_bytes``, whatever their number: a pass is broadcast, finds first thresholds in the longest
buckets, and then scans the buckets that are still long enough for it, each once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, written
from .vectors import as_long, matrix, products, sound

#: No score yet; and the id that stands for null, behind all others.
NONE, NO_ID = -(2**63 - 1), 2**63 - 1
#: Relative room for rounding in bounds; it only lets more candidates through.
ROOM = 1e-9
#: Queries multiplied with a bucket at once.
TOGETHER = 1024

PACKED = "part int, seq int, n int, width int, longest double, ids array<long>, kind string, codes binary"


def _with_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = np.floor(256 * matrix(b.column(1)))
        yield pa.record_batch([b.column(0), pa.array(np.sqrt(np.square(rows).sum(axis=1))), b.column(1)], ["vec_id", "length", "v"])


def _packer(size: int):
    """Sorted rows as blocks of at most ``size`` vectors."""

    def block(part: int, seq: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        rows = np.floor(256 * matrix(table["v"].combine_chunks()))
        most = np.abs(rows).max(initial=0)
        kind = "i2" if most < 2**15 else "i4" if most < 2**31 else "f8"
        cells = (part, seq, len(rows), rows.shape[1], float(table["length"][0].as_py()), table["vec_id"].to_pylist(), kind, rows.astype(kind).tobytes())
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.string(), pa.binary())
        return pa.record_batch([pa.array([c], t) for c, t in zip(cells, types, strict=True)], [f.split()[0] for f in PACKED.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            while b.num_rows:
                head = b.slice(0, size - n)
                held.append(head)
                n += head.num_rows
                b = b.slice(head.num_rows)
                if n == size:
                    yield block(part, seq, held)
                    seq, held, n = seq + 1, [], 0
        if held:
            yield block(part, seq, held)

    return pack


def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(vec_id, length, v) as a table of blocks of vectors of falling length; ids rise among equal lengths."""
    order = [F.desc("length"), F.asc_nulls_last("vec_id")]
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_packer(size), PACKED), name)


class Block:
    """Unpacked vectors: ids, whole numbers as float64, lengths."""

    def __init__(self, ids: list[int | None], kind: str, codes: bytes, width: int) -> None:
        self.ids = np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)
        self.rows = np.frombuffer(codes, kind).reshape(len(ids), width).astype(np.float64)
        self.lengths = np.sqrt(np.square(self.rows).sum(axis=1))
        self._lists: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors, and by coordinate the sorted values and whose they are; built when a query needs them."""
        if self._lists is None:
            units = self.rows / np.maximum(self.lengths, 1e-300)[:, None]
            order = np.argsort(units, axis=0, kind="stable").T
            self._lists = units, np.take_along_axis(units.T, order, axis=1), order
        return self._lists


class Tops:
    """The k best (score, id) of every query so far; ties to smaller ids."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.scores = np.full((queries, k), NONE, dtype=np.int64)
        self.ids = np.full((queries, k), NO_ID, dtype=np.int64)

    def add(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        old = np.unique(q)
        q = np.concatenate([q, np.repeat(old, self.k)])
        scores = np.concatenate([scores, self.scores[old].ravel()])
        ids = np.concatenate([ids, self.ids[old].ravel()])
        order = np.lexsort((ids, -scores, q))
        q, scores, ids = q[order], scores[order], ids[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        best = rank < self.k
        self.scores[q[best], rank[best]] = scores[best]
        self.ids[q[best], rank[best]] = ids[best]


def _by_coordinates(unit: np.ndarray, local: float, block: Block, focus: int) -> np.ndarray:
    """Rows of ``block`` whose cosine with ``unit`` can reach ``local``, by the query's largest coordinates.

    A vector within the angle b of the query, which is at the angle a from an axis, is at an
    angle of a - b to a + b from that axis.
    """
    units, values, order = block.lists()
    width = min(len(unit), values.shape[0])
    most = np.argsort(-np.abs(unit[:width]), kind="stable")[:focus]
    a, b = np.arccos(np.clip(unit[most], -1, 1)), math.acos(min(local, 1.0))
    low, high = np.cos(np.minimum(a + b, math.pi)) - ROOM, np.cos(np.maximum(a - b, 0)) + ROOM
    ends = [(np.searchsorted(values[f], lo, "left"), np.searchsorted(values[f], hi, "right")) for f, lo, hi in zip(most, low, high, strict=True)]
    if not ends:
        return np.arange(len(units))
    least = min(range(len(ends)), key=lambda i: ends[i][1] - ends[i][0])
    found = order[most[least], ends[least][0] : ends[least][1]]
    near = units[found][:, most]
    return found[((near >= low) & (near <= high)).all(axis=1)]


def search_block(queries: Block, tops: Tops, block: Block, coordinate_from: float, focus: int = 3, counts: dict | None = None) -> None:
    """Raises ``tops`` by what ``block`` holds."""
    k, longest = tops.k, block.lengths.max(initial=0.0)
    least = tops.scores[:, -1]
    with np.errstate(divide="ignore", over="ignore"):
        local = np.where(least > 0, least / (queries.lengths * longest), -1.0) * (1 - ROOM)
    by_coordinates = (local >= coordinate_from) & (local <= 1)
    for i in np.flatnonzero(by_coordinates):
        found = _by_coordinates(queries.rows[i] / queries.lengths[i], float(local[i]), block, focus)
        found = found[block.ids[found] != queries.ids[i]]
        scores = as_long(products(queries.rows[i : i + 1], block.rows[found])[0])
        good = scores >= least[i]
        tops.add(np.full(good.sum(), i), scores[good], block.ids[found[good]])
        if counts is not None:
            counts["coordinate"] = counts.get("coordinate", 0) + len(found)
    rest = np.flatnonzero((local <= 1) & ~by_coordinates)
    # long enough for each query: rows are in order of falling length
    with np.errstate(divide="ignore", over="ignore"):
        needed = np.where(least[rest] > 0, least[rest] / queries.lengths[rest], 0.0) * (1 - ROOM)
    reaching = np.searchsorted(-block.lengths, -needed, "right")
    rest = rest[np.argsort(-reaching, kind="stable")]
    reaching = np.sort(reaching)[::-1]
    where = np.argsort(block.ids, kind="stable")
    for at in range(0, len(rest), TOGETHER):
        some, n = rest[at : at + TOGETHER], int(reaching[at])
        scores, ids = as_long(products(queries.rows[some], block.rows[:n])), block.ids[:n]
        if counts is not None:
            counts["length"] = counts.get("length", 0) + scores.size
        # a query's own row, and other rows of its id
        for j, q in enumerate(queries.ids[some]):
            lo, hi = np.searchsorted(block.ids, [q, q + 1], sorter=where) if q != NO_ID else (0, 0)
            own = where[lo:hi]
            scores[j, own[own < n]] = NONE
        floor, floor_id = tops.scores[some, -1], tops.ids[some, -1]
        if n > k:
            kth = np.partition(scores, n - k, axis=1)[:, n - k]
            floor_id = np.where(kth > floor, NO_ID, floor_id)
            floor = np.maximum(kth, floor)
        better = (scores > floor[:, None]) | ((scores == floor[:, None]) & (ids <= floor_id[:, None]))
        q, row = np.nonzero(better & (scores > NONE))
        tops.add(some[q], scores[q, row], ids[row])


def _scanner(shared, k: int, coordinate_from: float):
    """Blocks to (q, vec_id, score): each task's best k of every query that reach what is known of it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, scores, best = shared.value
        queries = Block(list(ids), "f8", rows.tobytes(), rows.shape[1])
        tops = Tops(len(ids), k)
        tops.scores[:], tops.ids[:] = scores, best
        for b in batches:
            for found, kind, codes, width in zip(*(b.column(c).to_pylist() for c in ("ids", "kind", "codes", "width")), strict=True):
                search_block(queries, tops, Block(found, kind, codes, width), coordinate_from)
        new = (tops.scores > NONE) & ~((tops.scores[:, :, None] == scores[:, None, :]) & (tops.ids[:, :, None] == best[:, None, :])).any(axis=2)
        q, at = np.nonzero(new)
        found = tops.ids[q, at]
        yield pa.record_batch([pa.array(q, pa.int32()), pa.array(found, mask=found == NO_ID), pa.array(tops.scores[q, at])], ["q", "vec_id", "score"])

    return scan


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _passes(blocks: DataFrame, pass_bytes: int) -> Iterator[list[tuple[int, int]]]:
    """Which blocks (part, seq) of queries go together; their small rows are read one partition at a time."""
    some, room = [], pass_bytes
    for part, seq, n, width in blocks.select("part", "seq", "n", "width").orderBy("part", "seq").toLocalIterator():
        if some and n * width * 8 > room:
            yield some
            some, room = [], pass_bytes
        some.append((part, seq))
        room -= n * width * 8
    if some:
        yield some


def top_k(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", bucket_rows: int = 2048, head_buckets: int = 2, coordinate_from: float = 0.75, pass_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products with other rows, ties to smaller ids.

    Components become floor(256 x). Vectors that are null or hold null or non-finite components take no part. Rows that
    repeat id and vector count once; different vectors of one id are queries and candidates of their own, but
    none is a candidate of a query of its own id. Without an id a row is no query; as a candidate it
    stands behind others of its score. Vectors of unequal size meet in the components that
    both have. A score beyond a long is held at the long's limit. Fewer candidates than ``k`` give all of them, an empty table no row. Other columns aren't read.
    """
    spark = df.sparkSession
    kept = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(sound("v"))
    kind = kept.schema["v"].dataType.simpleString()
    rows = kept.groupBy("vec_id", "v").agg(F.max("asks").alias("asks"))
    lengths = lambda d: d.select("vec_id", "v").mapInArrow(_with_length, f"vec_id long, length double, v {kind}")
    buckets = packed(lengths(rows), bucket_rows, "buckets")
    asking = packed(lengths(rows.where(F.col("asks") & F.col("vec_id").isNotNull())), min(bucket_rows, TOGETHER), "queries")
    path = fresh_path(spark, "top")
    spark.createDataFrame([], "query_id long, rank int, vec_id long, score long").write.parquet(path)
    head = (F.col("part") == 0) & (F.col("seq") < head_buckets)
    schema = "q int, vec_id long, score long"
    for some in _passes(asking, pass_bytes):
        held = asking.where(F.struct("part", "seq").isin([F.struct(F.lit(a), F.lit(b)) for a, b in some])).collect()
        width = max(r["width"] for r in held)
        read = [Block(r["ids"], r["kind"], bytes(r["codes"]), r["width"]) for r in held]
        ids = np.concatenate([b.ids for b in read])
        q_rows = np.vstack([np.pad(b.rows, ((0, 0), (0, width - b.rows.shape[1]))) for b in read])
        tops = Tops(len(ids), k)
        send = lambda t: spark.sparkContext.broadcast((ids, q_rows, t.scores, t.ids))
        first = _best(buckets.where(head).mapInArrow(_scanner(send(tops), k, coordinate_from), schema), k).collect()
        if first:
            q, found, scores = (np.array(x, dtype=np.int64) for x in zip(*((r["q"], NO_ID if r["vec_id"] is None else r["vec_id"], r["score"]) for r in first), strict=True))
            tops.add(q, scores, found)
        # the shortest length at which some query can still find something
        least, lengths_of = tops.scores[:, -1], np.sqrt(np.square(q_rows).sum(axis=1))
        enough = float(np.where(least > 0, least / np.maximum(lengths_of, 1e-300), 0.0).min()) * (1 - ROOM)
        more = buckets.where(~head & (F.col("longest") >= enough)).mapInArrow(_scanner(send(tops), k, coordinate_from), schema)
        known = spark.createDataFrame([(r["q"], r["vec_id"], r["score"]) for r in first], schema)
        names = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(ids)), pa.int32()), "query_id": ids}))
        out = _best(known.unionByName(more), k).join(names, "q")
        out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").write.mode("append").parquet(path)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)


def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the five best of every vector whose id is divisible by 50, among all others."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


SEARCH_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v AS q JOIN v AS c ON c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id ASC NULLS LAST)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
