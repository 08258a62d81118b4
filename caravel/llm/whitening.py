"""Whitening of embeddings by hierarchical SVD merging (operator 13).

A summary of some vectors is their count, their exact sums, and the singular values and right vectors of the
vectors about their mean, at full rank. Two summaries merge without loss: the scaled right vectors are stacked, with
one more row for the way between both means, weighted by sqrt(a b / (a + b)), and decomposed again. Every task
makes one summary of what it reads; summaries merge in groups of ``FAN``, level by level, up to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .vectors import matrix, sound

#: Summaries that one task merges.
FAN = 32
SUMMARY = "part int, n long, sums string, values binary, vectors binary"


def whole(rows: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 as int64, or as Python integers where one is too large for that."""
    rows = np.floor(1024 * rows)
    if np.abs(rows).max(initial=0.0) < 2**62:
        return rows.astype(np.int64) + 100_000
    return np.array([[int(x) + 100_000 for x in r] for r in rows], dtype=object).reshape(rows.shape)


@dataclass
class Summary:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Summary:
        """Of whole numbers. What they share is taken away before they become floats."""
        near = (rows - rows[0]).astype(np.float64)
        _, values, vectors = np.linalg.svd(near - near.mean(axis=0), full_matrices=False)
        return Summary(len(rows), [sum(map(int, c)) if rows.dtype == object or abs(int(c.max())) > 2**40 or abs(int(c.min())) > 2**40 else int(c.sum()) for c in rows.T], values, vectors)

    def merged(self, other: Summary) -> Summary:
        a, b = self.n, other.n
        apart = np.array([float((x * b - y * a) / (a * b)) for x, y in zip(self.sums, other.sums, strict=True)])
        stacked = np.vstack([self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, np.sqrt(a * b / (a + b)) * apart])
        _, values, vectors = np.linalg.svd(stacked, full_matrices=False)
        return Summary(a + b, [x + y for x, y in zip(self.sums, other.sums, strict=True)], values, vectors)

    def row(self, part: int) -> pa.RecordBatch:
        cells = (part, self.n, ",".join(map(str, self.sums)), self.values.tobytes(), self.vectors.tobytes())
        types = (pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array([c], t) for c, t in zip(cells, types, strict=True)], [f.split()[0] for f in SUMMARY.split(", ")])

    @staticmethod
    def read(n: int, sums: str, values: bytes, vectors: bytes) -> Summary:
        s = list(map(int, sums.split(",")))
        return Summary(n, s, np.frombuffer(values), np.frombuffer(vectors).reshape(-1, len(s)))


def _summaries(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if b.num_rows:
                own = Summary.of(whole(matrix(b.column(0), width)))
                held = own if held is None else held.merged(own)
        if held is not None:
            yield held.row(TaskContext.get().partitionId())

    return run


def _merge(table: pa.Table) -> pa.Table:
    rows = sorted(table.select([f.split()[0] for f in SUMMARY.split(", ")]).to_pylist(), key=lambda r: r["part"])
    held = None
    for r in rows:
        own = Summary.read(r["n"], r["sums"], r["values"], r["vectors"])
        held = own if held is None else held.merged(own)
    return pa.Table.from_batches([held.row(rows[0]["part"] // FAN)])


def fit(vectors: DataFrame, width: int) -> Summary | None:
    """The summary of all rows of ``vectors`` (v); None of an empty table. One row comes to the driver."""
    level = written(vectors.mapInArrow(_summaries(width), SUMMARY), "summaries")
    parts = (level.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        level = level.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(_merge, SUMMARY)
        parts = -(-parts // FAN)
    r = level.first()
    return r and Summary.read(r["n"], r["sums"], bytes(r["values"]), bytes(r["vectors"]))


@dataclass
class Whitening:
    """Components by falling variance; those without variance have no scale."""

    n: int
    sums: list[int]
    variance: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @staticmethod
    def of(s: Summary, components: int) -> Whitening:
        width = len(s.sums)
        e = np.zeros(width)
        e[: len(s.values)] = np.square(s.values) / s.n
        noise = np.square(s.values[0] * max(s.n, width) * np.finfo(float).eps) / s.n if len(s.values) else 0.0
        m = min(components, width)
        vectors = np.zeros((m, width))
        vectors[: len(s.vectors)] = s.vectors[:m]
        trace = e.sum()
        return Whitening(s.n, s.sums, np.where(e[:m] > noise, e[:m], 0.0), vectors, e[:m] / trace if trace else np.full(m, np.nan))

    def apply(self, rows: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Whitened values (nan without variance) and exact deviations (null beyond a long)."""
        most = max([1, abs(int(rows.max())), abs(int(rows.min())), *(abs(s) // self.n + 1 for s in self.sums)])
        exact = rows if 2 * most * self.n < 2**62 else rows.astype(object)
        off = exact * self.n - np.array(self.sums, dtype=exact.dtype if exact.dtype == object else np.int64)
        largest = max(abs(int(off.max())), abs(int(off.min())))
        squares = np.square(off if largest**2 * len(self.sums) < 2**63 else off.astype(object)).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (off / self.n).astype(np.float64) @ self.vectors.T / np.sqrt(self.variance)
        return np.where(self.variance > 0, out, np.nan), [int(x) if x < 2**63 else None for x in squares.tolist()]


def _moments(shared, width: int):
    """Each task's sums of products of whitened values about its own mean, and of the values: (i, j, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        m = len(model.variance)
        n, mean, square = 0, np.zeros(m), np.zeros((m, m))
        for b in batches:
            if b.num_rows:
                w, _ = model.apply(whole(matrix(b.column("v"), width)))
                own, k = w.mean(axis=0), len(w)
                apart = own - mean
                square += (w - own).T @ (w - own) + np.outer(apart, apart) * (n * k / (n + k))
                mean += apart * (k / (n + k))
                n += k
        if n:
            i, j = np.indices((m, m))
            # about the mean of all vectors, which is 0 in whitened values
            total = square + n * np.outer(mean, mean)
            yield pa.record_batch([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "total"])

    return run


def identity_error(vectors: DataFrame, model: Whitening, width: int) -> float | None:
    """The largest absolute entry of the whitened values' covariance minus the identity, over components with variance."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    rows = vectors.mapInArrow(_moments(shared, width), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total")).collect()
    found = [abs(t / model.n - (i == j)) for i, j, t in rows if model.variance[i] > 0 and model.variance[j] > 0]
    return float(max(found)) if found else None


def _whitened(shared, width: int, error: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        m = len(model.variance)
        for b in batches:
            if not b.num_rows:
                continue
            w, deviation = model.apply(whole(matrix(b.column("v"), width)))
            k = len(w)
            value, part = w.ravel(), np.tile(model.explained, k)
            yield pa.record_batch(
                [
                    b.column("vec_id").take(pa.array(np.repeat(np.arange(k), m))),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)),
                    pa.array(np.full(k * m, model.n)),
                    pa.array([d for d in deviation for _ in range(m)], pa.int64()),
                    pa.array(value, mask=np.isnan(value)),
                    pa.array(part, mask=np.isnan(part)),
                    pa.array([error] * (k * m), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(df: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): rows of ``components`` per vector.

    Vectors that are null or hold null or non-finite entries are dropped, and so are those of another size than most
    (of equally frequent sizes the smaller counts). Repeated rows and null ids are vectors like others. A component without variance
    has a null ``whitened`` and is left out of ``identity_error``; without any variance ``explained`` is null too. A deviation beyond a long
    is null. Vectors of fewer entries than ``components`` have as many components as entries. An empty table gives no
    row. Other columns aren't read.
    """
    spark = df.sparkSession
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kept = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v")).where(sound("v") & (F.size("v") > 0))
    sizes = kept.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return spark.createDataFrame([], out)
    width = sizes["size"]
    kept = kept.where(F.size("v") == width)
    model = Whitening.of(fit(kept.select("v"), width), components)
    error = identity_error(kept, model, width)
    return kept.mapInArrow(_whitened(spark.sparkContext.broadcast(model), width, error), out)


def whiten_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the first eight whitened components of all embeddings."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
