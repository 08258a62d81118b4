"""Range joins by time bins, k nearest points by grid cells, and best overlaps.

Intervals are spread over bins of the length ``width`` and meet in an equi-join on the bin;
a pair that meets in several bins counts in the first it shares. No side is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravel.functions.geo import EARTH_M, haversine
from caravel.operators.ordered import asof
from caravel.session import cut_lineage


#: Points for each of ``k`` that the fullest first cell may hold, and the most columns of a grid (about 10 m).
_CROWD, _MOST_COLUMNS = 16, 1 << 22


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(F.unix_seconds(start) / width), F.floor(F.unix_seconds(end) / width))


def overlaps(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], width: int = 3600, by: Sequence[str] = ()) -> DataFrame:
    """Pairs whose closed spans overlap; equal ends touch. Column names of both sides must differ but for ``by``."""
    t = lambda c: F.col(c).cast("timestamp")
    x = a.withColumn("_a0", F.floor(F.unix_seconds(t(a_span[0])) / width)).withColumn("_bin", F.explode(_bins(t(a_span[0]), t(a_span[1]), width)))
    y = b.withColumn("_b0", F.floor(F.unix_seconds(t(b_span[0])) / width)).withColumn("_bin", F.explode(_bins(t(b_span[0]), t(b_span[1]), width)))
    met = x.join(y, ["_bin", *by])
    hit = (F.col(a_span[0]) <= F.col(b_span[1])) & (F.col(a_span[1]) >= F.col(b_span[0])) & (F.col("_bin") == F.greatest("_a0", "_b0"))
    return met.where(hit).drop("_bin", "_a0", "_b0")


def best_interval(items: DataFrame, tracks: DataFrame, item_span: tuple[str, str], track_span: tuple[str, str], item_key: str, track_key: str, by: Sequence[str]) -> DataFrame:
    """JN13. The best track of each item within ``by``: one that contains it (smallest), else that overlaps it
    most, else the nearest; ties by track key. Adds ``mode`` and ``metric`` (seconds).

    Items meet the tracks they touch through time bins. Those that touch none look for the last track that ended before
    them and the first one that begins behind them (as-of joins), so no item meets all tracks of its key.
    """
    s = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    i0, i1, t0, t1 = s(item_span[0]), s(item_span[1]), s(track_span[0]), s(track_span[1])
    met = overlaps(items, tracks, item_span, track_span, 86_400, by)
    shared = F.least(i1, t1) - F.greatest(i0, t0)
    rank = F.when((t0 <= i0) & (t1 >= i1), 0).when(shared > 0, 1).otherwise(2)
    metric = F.when(rank == 0, t1 - t0).when(rank == 1, -shared).otherwise(F.lit(0.0))
    choice = F.struct(rank.alias("rank"), metric.alias("metric"), F.col(track_key).alias("track"))
    touched = met.select(*by, item_key, choice.alias("b"))
    # the nearest behind and before; of equal ones the least key
    ends = tracks.groupBy(*by, F.col(track_span[1]).alias("_edge")).agg(F.min(track_key).alias("_track"))
    begins = tracks.groupBy(*by, F.col(track_span[0]).alias("_edge")).agg(F.min(track_key).alias("_track"))
    found = items.select(*by, item_key, F.col(item_span[0]).alias("_edge"), F.col(item_span[1]).alias("_to"))
    back = asof(found, ends, "_edge", F.struct("_edge", "_track"), by)
    forth = asof(found.select(*by, item_key, F.col("_to").alias("_edge")), begins, "_edge", F.struct("_edge", "_track"), by, back=False, ahead=True)
    gap = lambda a, b: s(a) - s(b)
    near = lambda df, way, away: df.where(F.col(way).isNotNull()).select(*by, item_key, F.struct(F.lit(2).alias("rank"), away.alias("metric"), F.col(f"{way}._track").alias("track")).alias("b"))
    apart = near(back, "prev", gap("_edge", "prev._edge")).unionByName(near(forth, "next", gap("next._edge", "_edge")))
    best = touched.unionByName(apart).groupBy(item_key).agg(F.min("b").alias("b"))
    names = F.array(F.lit("contains"), F.lit("overlaps"), F.lit("nearest"))
    return best.select(item_key, F.col("b.track").alias(track_key), F.get(names, F.col("b.rank")).alias("mode"), F.abs("b.metric").alias("metric"))


def nearest_points(items: DataFrame, points: DataFrame, item: tuple[str, str, str], point: tuple[str, str, str], k: int = 2, degrees: float = 1.0) -> DataFrame:
    """JN14. (item, point, metres, rank): the ``k`` nearest points of each item, ties by the point's key.

    Points at one place are equally far from any item, so only the ``k`` of the least keys go on; items at one place have one
    answer, which is looked for once. A pyramid of grids: a place looks at the nine cells around it, and leaves as soon as its k-th
    distance is within what they cover for sure; the others look again with cells twice as wide, so each round costs nine cells a place
    whatever the distance. The first cells are ``degrees`` wide, or so narrow that the fullest one holds few points for each of ``k``. Columns wrap
    at 180 degrees. ``item`` and ``point`` are (key, lat, lon) names; rows without a position are left out, and an item gets fewer
    than ``k`` only if there are fewer points.
    """
    ik, ia, io = item
    pk, pa_, po = point
    placed = items.where(F.col(ia).isNotNull() & F.col(io).isNotNull()).select(F.col(ik).alias("_i"), F.col(ia).alias("_ia"), F.col(io).alias("_io"))
    here = ["_ia", "_io"]
    near = points.where(F.col(pa_).isNotNull() & F.col(po).isNotNull()).select(F.col(pk).alias("_p"), F.col(pa_).alias("_pa"), F.col(po).alias("_po"))
    least = F.row_number().over(Window.partitionBy("_pa", "_po").orderBy("_p"))
    near = cut_lineage(near.withColumn("_nth", least).where(F.col("_nth") <= k).drop("_nth"))
    total = near.count()
    if total == 0:
        return placed.where("false").select(F.col("_i").alias(ik), F.lit(None).cast(points.schema[pk].dataType).alias(pk), F.lit(0.0).alias("metres"), F.lit(0).alias("rank"))
    row = lambda c, size: F.floor((F.col(c) + 90) / size).cast("int")
    column = lambda c, size, columns: F.pmod(F.floor(F.col(c) / size), F.lit(columns)).cast("int")
    w = Window.partitionBy(*here).orderBy("_m", "_p")
    columns = 1 << max(2, math.floor(math.log2(360 / degrees)))
    while columns < _MOST_COLUMNS:
        counts = near.groupBy(row("_pa", 360.0 / columns), column("_po", 360.0 / columns, columns)).count()
        fullest = counts.agg(F.max("count")).first()[0]
        if fullest <= _CROWD * k:
            break
        columns = min(columns << max(1, math.ceil(math.log2(fullest / (_CROWD * k)) / 2)), _MOST_COLUMNS)
    open_ = cut_lineage(placed.select(*here).distinct())
    out = None
    while True:
        size = 360.0 / columns
        # the widest grid is one cell
        whole = columns <= 4
        at = lambda y, x: (F.lit(0), F.lit(0)) if whole else (row(y, size), column(x, size, columns))  # noqa: B023, E731
        ring = F.array(F.lit(0)) if whole else F.array(F.lit(-1), F.lit(0), F.lit(1))
        cells = open_.withColumn("_dy", F.explode(ring)).withColumn("_dx", F.explode(ring))
        (cy, cx), (py, px) = at("_ia", "_io"), at("_pa", "_po")
        cells = cells.withColumn("_cy", cy + F.col("_dy")).withColumn("_cx", F.pmod(cx + F.col("_dx"), F.lit(max(columns, 1))))
        met = cells.join(near.withColumn("_cy", py).withColumn("_cx", px), ["_cy", "_cx"]).withColumn("_m", haversine("_ia", "_io", "_pa", "_po"))
        best = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        # metres to the nearest edge of the nine cells: along the meridian, and to the meridian one cell away
        aside = F.asin(F.cos(F.radians("_ia")) * math.sin(math.radians(min(size, 90.0))))
        sure = EARTH_M * F.least(F.lit(math.radians(size)), aside) * 0.999
        each = Window.partitionBy(*here)
        tested = best.withColumn("_kth", F.max("_m").over(each)).withColumn("_n", F.count("*").over(each))
        done = tested if whole else tested.where((F.col("_n") >= min(k, total)) & (F.col("_kth") <= sure))
        part = cut_lineage(done.select(*here, "_p", F.col("_m").alias("metres"), "rank"))
        out = part if out is None else out.unionByName(part)
        if not whole:
            open_ = cut_lineage(open_.join(part.select(*here).distinct(), here, "left_anti"))
        if whole or open_.isEmpty():
            return placed.join(out, here).select(F.col("_i").alias(ik), F.col("_p").alias(pk), "metres", "rank")
        columns //= 2
