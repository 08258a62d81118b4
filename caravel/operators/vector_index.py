"""An inverted-file index of vectors: cells around centroids, probed nearest first or, exactly, as far as the angle allows.

Centroids are fitted on at most ``sample`` rows, drawn by a hash of the key; every row is then assigned to the cell of its
nearest centroid, so none is missing from the index. A row at the angle r from its centroid can be within
the angle t of a query at the angle a from that centroid only if a - r <= t. With the greatest r of each cell, the exact mode leaves
out cells that can't hold a match, and nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravel.session import cut_lineage


def _units(column: pa.Array) -> np.ndarray:
    rows = np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)
    return rows / np.sqrt(np.square(rows).sum(axis=1))[:, None]


def fitted(units: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids by a few rounds of spherical k-means; the first are rows at equal distances."""
    centroids = units[np.linspace(0, len(units) - 1, min(cells, len(units))).astype(int)].copy()
    for _ in range(rounds):
        of = (units @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, units)
        length = np.sqrt(np.square(sums).sum(axis=1))
        moved = length > 1e-12
        centroids[moved] = sums[moved] / length[moved, None]
    return centroids


@dataclass
class VectorIndex:
    """``rows``: id, kind, v, cell, chunk; ``radius``: of each cell the greatest angle of its rows; ``chunks``: into how many parts it is cut."""

    rows: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    chunks: np.ndarray

    @staticmethod
    def build(df: DataFrame, key: str, vector: str, kind: str, sample: int = 20_000, cells: int | None = None, chunk: int = 20_000) -> VectorIndex | None:
        """None without a usable vector. Left out are null ids and vectors that are null, empty, of norm 0 or hold null or non-finite numbers; all others have one length."""
        v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
        own = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{kind}`").alias("kind"), v.alias("v"))
        own = own.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
        total = own.count()
        if not total:
            return None
        drawn = own.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()["v"].combine_chunks()
        centroids = fitted(_units(drawn), cells or max(1, min(int(math.sqrt(total)), len(drawn) // 8)))
        shared = df.sparkSession.sparkContext.broadcast(centroids)

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    near = _units(b.column("v")) @ shared.value.T
                    cell = near.argmax(axis=1)
                    angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                    yield pa.record_batch([*b.columns, pa.array(cell, pa.int32()), pa.array(angle)], ["id", "kind", "v", "cell", "angle"])

        types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields)
        placed = cut_lineage(own.mapInArrow(assigned, f"{types}, cell int, angle double"))
        radius, chunks = np.full(len(centroids), -1.0), np.ones(len(centroids), dtype=np.int64)
        for r in placed.groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect():
            radius[r["cell"]], chunks[r["cell"]] = r["r"], -(-r["n"] // chunk)
        parts = F.element_at(F.array(*[F.lit(int(c)) for c in chunks]), F.col("cell") + 1)
        return VectorIndex(placed.drop("angle").withColumn("chunk", F.pmod(F.xxhash64("id"), parts).cast("int")), centroids, radius, chunks)

    def search(self, is_query: Column, least: float, k: int, probes: int | None = None) -> DataFrame:
        """(a, b, kind, similarity, rank): of each query row, the ``k`` most similar rows of every *other* kind, from the cosine ``least`` on, ties to smaller ids.

        ``probes`` cells are looked at, nearest first; with None all that can hold a match, so the result is exact. Queries and rows meet by
        cell; a large cell is cut into chunks that each meet its queries, and each chunk hands on its own best only.
        """
        spark = self.rows.sparkSession
        shared = spark.sparkContext.broadcast((self.centroids, self.radius, self.chunks))
        kind = self.rows.schema["kind"].dataType.simpleString()
        id_ = self.rows.schema["id"].dataType.simpleString()
        reach = math.acos(max(-1.0, min(1.0, least)))

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, radius, chunks = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                angle = np.arccos(np.clip(_units(b.column("v")) @ centroids.T, -1, 1))
                if probes is None:
                    row, cell = np.nonzero((angle - radius <= reach + 1e-9) & (radius >= 0))
                else:
                    cell = np.argsort(np.where(radius >= 0, angle, np.inf), axis=1, kind="stable")[:, :probes].ravel()
                    row = np.repeat(np.arange(b.num_rows), len(cell) // b.num_rows)
                row, cell = np.repeat(row, chunks[cell]), np.repeat(cell, chunks[cell])
                first = np.flatnonzero(np.diff(cell, prepend=-1) | np.diff(row, prepend=-1))
                part = np.arange(len(cell)) - np.repeat(first, np.diff(np.append(first, len(cell))))
                yield pa.record_batch([*[b.column(c).take(pa.array(row)) for c in ("id", "kind", "v")], pa.array(cell, pa.int32()), pa.array(part, pa.int32())], ["id", "kind", "v", "cell", "chunk"])

        def met(rows: pa.Table, queries: pa.Table) -> pa.Table:
            out: dict[str, list] = {"a": [], "b": [], "kind": [], "similarity": []}
            if rows.num_rows and queries.num_rows:
                ids, kinds = (np.array(rows.column(c).to_pylist(), dtype=object) for c in ("id", "kind"))
                units = _units(rows.column("v").combine_chunks())
                groups = {g: np.flatnonzero(np.array([x == g for x in kinds])) for g in dict.fromkeys(kinds)}
                for at in range(0, queries.num_rows, 1024):
                    part = queries.slice(at, 1024)
                    near = _units(part.column("v").combine_chunks()) @ units.T
                    for q, (a, own) in enumerate(zip(part.column("id").to_pylist(), part.column("kind").to_pylist(), strict=True)):
                        for g, members in groups.items():
                            if g == own:
                                continue
                            good = members[near[q, members] >= least]
                            for i in sorted(good, key=lambda i: (-near[q, i], ids[i]))[:k]:  # noqa: B023
                                for name, x in zip(out, (a, ids[i], g, float(near[q, i])), strict=True):
                                    out[name].append(x)
            return pa.table({"a": pa.array(out["a"], rows.schema.field("id").type), "b": pa.array(out["b"], rows.schema.field("id").type), "kind": pa.array(out["kind"], rows.schema.field("kind").type), "similarity": pa.array(out["similarity"], pa.float64())})

        asked = self.rows.where(is_query).select("id", "kind", "v")
        asked = asked.mapInArrow(probed, f"id {id_}, kind {kind}, v array<double>, cell int, chunk int")
        pairs = self.rows.groupBy("cell", "chunk").cogroup(asked.groupBy("cell", "chunk")).applyInArrow(met, f"a {id_}, b {id_}, kind {kind}, similarity double")
        best = Window.partitionBy("a", "kind").orderBy(F.desc("similarity"), "b")
        return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def concepts(clusters: DataFrame, rows: DataFrame, key: str, kind: str, leader: str = "leader") -> DataFrame:
    """DOC15. (leader, n, kinds) of leader clusters that hold more than one kind of item."""
    met = clusters.join(rows.select(key, kind), key)
    return met.groupBy(leader).agg(F.count("*").alias("n"), F.count_distinct(kind).alias("kinds")).where("kinds > 1")
