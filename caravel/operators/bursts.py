"""Bursts of pictures: groups in time, alike ones within them, and the best of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.operators import dedup, ordered
from caravel.session import cut_lineage


def selection(df: DataFrame, by: Sequence[str], ts: str, key: str, score: str, window_seconds: float, alike: Sequence[tuple[str, type[dedup.Leaders], float]] = ()) -> DataFrame:
    """SET13, SRT8. (by, key, burst, leader, kept, reason) of rows with a time; ``key`` is unique within ``by``.

    Rows are grouped by time from a burst's first row, then within a burst by ``alike``: (column, kind of likeness, limit) by greedy leaders. None: the burst is the group. Of several, each before the last is a
    prefilter: only its leaders go on, the others are out (``prefilter``). Of a group the row with the best score is kept (``best``), of equal ones the least key; a row without a
    score, whose evaluation failed, counts 0. Of a group where all failed nothing is thrown away (``unrated``).
    """
    rows = ordered.anchored_groups(df, by, ts, window_seconds)
    rows = cut_lineage(rows.where(F.col("burst").isNotNull()))
    place = [*by, "burst"]
    here = lambda d, c: F.struct(*[F.col(f"`{x}`") for x in by], F.col(c).alias("k"))
    out = None
    for i, (column, kind, limit) in enumerate(alike):
        led = dedup.leader_clusters(rows, place, key, column, kind, limit).select(here(rows, key).alias("_here"), "leader")
        rows = rows.drop("leader").withColumn("_here", here(rows, key)).join(led, "_here").drop("_here")
        if i + 1 < len(alike):
            rows = cut_lineage(rows)
            gone = rows.where(F.col(key) != F.col("leader")).select(*place, key, "leader", F.lit(False).alias("kept"), F.lit("prefilter").alias("reason"))
            out = gone if out is None else out.unionByName(gone)
            rows = rows.where(F.col(key) == F.col("leader"))
    if not alike:
        rows = rows.withColumn("leader", F.lit(None).cast(rows.schema[key].dataType))
    keys = ordered.plain_keys(rows, [*place, "leader"])
    rated = F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    best = rows.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.min(F.struct((-rated).alias("s"), F.col(key).alias("k"))).alias("_best"), F.count(score).alias("_rated"))
    met = rows.withColumns(keys).join(best, list(keys))
    unrated = F.col("_rated") == 0
    chosen = F.col(key) == F.col("_best.k")
    reason = F.when(unrated, "unrated").when(chosen, "best").otherwise("worse")
    found = met.select(*place, key, "leader", (unrated | chosen).alias("kept"), reason.alias("reason"))
    return found if out is None else found.unionByName(out)
