"""Exact k-means over whole numbers with Hamerly's bounds (operator 12).

Each vector keeps, beside its cluster, one upper bound of the distance to its centroid and one lower bound
of the distance to the second nearest. When centroids move, the upper bound grows by what its own one moved and the
lower bound falls by the most that any other moved. As long as the upper bound is below
the lower one, or below half the way from its centroid to the next, the vector stays without looking at a centroid.
Else its own distance is computed, and only if that doesn't settle it, those to all centroids, in whole numbers.

The bounds are a Parquet table a round; the one before is deleted once the next is whole. The new centroids come from exact
sums, to which only vectors that changed their cluster are added or from which they are taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_table, fresh_path
from .vectors import matrix, products, sound

#: Codes are held within this, so that a squared distance of 64 components fits a long.
MOST = 2**27
#: Room for rounding in bounds, upwards and downwards; it only makes vectors unsure.
UP, DOWN = 1 + 1e-12, 1 - 1e-12


def codes(column: pa.Array, width: int) -> np.ndarray:
    return np.clip(np.floor(256 * matrix(column, width)), -MOST, MOST).astype(np.int64)


def squared(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    dots = products(rows.astype(np.float64), centroids.astype(np.float64)).astype(np.int64)
    return np.square(rows).sum(axis=1)[:, None] + np.square(centroids).sum(axis=1)[None, :] - 2 * dots


def assign(rows: np.ndarray, centroids: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, moved: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, rows scanned in full) from the state before ``centroids`` ``moved``."""
    n, k = len(rows), len(centroids)
    if state is None:
        cluster, upper, lower, unsure = np.zeros(n, dtype=np.int32), np.zeros(n), np.zeros(n), np.arange(n)
    else:
        cluster, upper, lower = (a.copy() for a in state)
        apart = squared(centroids, centroids).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        half = np.sqrt(apart.min(axis=1)) / 2 * DOWN
        most = int(moved.argmax())
        others = np.full(k, moved[most])
        others[most] = np.delete(moved, most).max(initial=0.0)
        upper = (upper + moved[cluster]) * UP
        lower = np.maximum(lower - others[cluster] * UP, 0.0) * DOWN
        least = np.maximum(lower, half[cluster])
        unsure = np.flatnonzero(upper >= least)
        upper[unsure] = np.sqrt(np.square(rows[unsure] - centroids[cluster[unsure]]).sum(axis=1)) * UP
        unsure = unsure[upper[unsure] >= least[unsure]]
    if len(unsure):
        d = squared(rows[unsure], centroids)
        best = d.argmin(axis=1)  # the first of equals
        each = np.arange(len(unsure))
        upper[unsure] = np.sqrt(d[each, best]) * UP
        rest = d.astype(np.float64)
        rest[each, best] = np.inf
        lower[unsure] = np.sqrt(rest.min(axis=1)) * DOWN
        cluster[unsure] = best
    return cluster, upper, lower, len(unsure)


def _pass(shared, width: int):
    """A round's assignment; ``was`` is the cluster before it, -1 in the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, moved, last = shared.value
        for b in batches:
            rows = codes(b.column("v"), width)
            state = None if moved is None else tuple(b.column(c).to_numpy() for c in ("cluster", "upper", "lower"))
            was = pa.array(np.full(len(rows), -1, dtype=np.int32)) if moved is None else b.column("cluster")
            cluster, upper, lower, scanned = assign(rows, centroids, state, moved)
            full = np.zeros(len(rows), dtype=np.int64)
            full[:1] = scanned
            distance = np.square(rows - centroids[cluster]).sum(axis=1) if last else np.zeros(len(rows), dtype=np.int64)
            yield pa.record_batch([b.column("vec_id"), b.column("v"), was, pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(distance), pa.array(full)], ["vec_id", "v", "was", "cluster", "upper", "lower", "distance", "scanned"])

    return run


def _sums(width: int):
    """Of rows that changed cluster: what each cluster gains and loses, by component; component -1 counts rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            rows = codes(b.column("v"), width)
            rows = np.hstack([np.ones((len(rows), 1), dtype=np.int64), rows])
            for name, sign in (("cluster", 1), ("was", -1)):
                of = b.column(name).to_numpy()
                for c in np.unique(of[of >= 0]).tolist():
                    held[c] = held.get(c, 0) + sign * rows[of == c].sum(axis=0)
        n = len(held)
        yield pa.record_batch([pa.array(np.repeat(np.array(list(held), dtype=np.int32), width + 1)), pa.array(np.tile(np.arange(-1, width, dtype=np.int32), n)), pa.array(np.concatenate([*held.values(), np.zeros(0, dtype=np.int64)]), pa.int64())], ["cluster", "dim", "total"])

    return run


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, key: str = "vec_id", vector: str = "embedding", width: int = 64, seed: str = "2:", stats: list | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept are vectors of exactly ``width`` components, none null or non-finite; components become floor(256 x), held
    within 2^27. Seeds are the vectors with the ``k`` least sha256 of ``seed`` and id (of one id, the least vector). Repeated rows
    are vectors of their own; a null id is clustered but no seed. Fewer than ``k`` vectors with an id make as many clusters. Without
    any, as of an empty table, the result is empty. Other columns aren't read. Sums beyond a long are null.
    ``stats`` gets the number of vectors scanned in full of each round.
    """
    spark = df.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    kept = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v")).where(sound("v") & (F.size("v") == width))
    named = kept.where("vec_id is not null").withColumn("hash", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256))
    seeds = named.orderBy("hash", "v").limit(k).select("v").toArrow()["v"].combine_chunks()
    if not len(seeds):
        return spark.createDataFrame([], schema)
    centroids, moved = codes(seeds, width), None
    total: dict[tuple[int, int], int] = {}
    state = f"vec_id long, v {kept.schema['v'].dataType.simpleString()}, was int, cluster int, upper double, lower double, distance long, scanned long"
    rows, before = kept, None
    for i in range(rounds + 1):
        shared = spark.sparkContext.broadcast((centroids, moved, i == rounds))
        path = fresh_path(spark, "bounds")
        rows.mapInArrow(_pass(shared, width), state).write.parquet(path)
        if before:
            delete_table(spark, before)
        rows, before = spark.read.schema(state).parquet(path), path
        if stats is not None:
            stats.append(rows.agg(F.sum("scanned")).first()[0])
        if i == rounds:
            break
        changed = rows.where("cluster <> was").select("v", "was", "cluster").mapInArrow(_sums(width), "cluster int, dim int, total long")
        for c, d, t in changed.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect():
            total[c, d] = total.get((c, d), 0) + int(t)
        new = centroids.copy()
        for c in range(len(centroids)):
            if n := total.get((c, -1), 0):
                new[c] = [total[c, d] // n for d in range(width)]
        moved = np.sqrt(np.square(new - centroids).sum(axis=1)) * UP
        centroids = new
    own = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    every = sum((r["s"] for r in own), Decimal(0))
    long = lambda s: int(s) if s < 2**63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(r["cluster"], long(r["s"]), long(every), sha[r["cluster"]]) for r in own], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: forty clusters of all embeddings after five rounds."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _cluster_sql(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    """The rounds one after another: distances to all centroids, the nearest, floors of exact means."""
    floor = "CAST((s - ((s % n) + n) % n) / n AS BIGINT)"
    ctes = [
        f"""v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) - 1)::INTEGER AS cluster, x AS c FROM v ORDER BY cluster LIMIT {k})",
    ]
    for i in range(rounds + 1):
        ctes.append(
            f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, x, min(cluster::HUGEINT + d::HUGEINT * {k}) AS best FROM (
    SELECT r, vec_id, x, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i}
  ) GROUP BY r, vec_id, x
)"""
        )
        if i < rounds:
            ctes.append(
                f"""c{i + 1} AS MATERIALIZED (
  SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{i} AS o LEFT JOIN (
    SELECT cluster, list({floor} ORDER BY d) AS c FROM (
      SELECT (best % {k})::INTEGER AS cluster, d, sum(x[d])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i}, range(1, {width + 1}) AS t(d) GROUP BY 1, 2
    ) GROUP BY cluster
  ) AS m USING (cluster)
)"""
            )
    return (
        "WITH "
        + ", ".join(ctes)
        + f""", e AS (SELECT vec_id, (best % {k})::INTEGER AS cluster, (best // {k})::BIGINT AS distance FROM a{rounds})
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM e JOIN c{rounds} USING (cluster)"""
    )


CLUSTER_SQL = _cluster_sql()
