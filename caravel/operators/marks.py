"""Marks along a route: coarse samples, positions with a source, transitions, and what is emitted."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravel.operators.ordered import lagged, running_sums, with_neighbours

EARTH_M = 6_371_000.0


def coarse(df: DataFrame, by: Sequence[str], offset: str, every: float) -> DataFrame:
    """SEQ9. The samples that are nearest to a multiple of ``every`` (up to the last offset), each once; of two equally near the earlier.

    A sample knows from its neighbours which offsets are nearest to it, so no multiple is made a row.
    ``offset`` is unique within ``by``.
    """
    block = F.floor(F.col(offset) / 86_400)
    rows = with_neighbours(df, [offset], F.col(offset), by, block, back=True, ahead=True, names=("_lower", "_upper"))
    o = F.col(offset)
    low = (F.col("_lower") + o) / 2
    # behind the last sample there is no multiple that counts
    high = F.coalesce((F.col("_upper") + o) / 2, o)
    greatest = F.floor(high / every + 1e-12) * every
    return rows.where(F.when(F.col("_lower").isNull(), greatest >= 0).otherwise(greatest > low + 1e-9)).drop("_lower", "_upper")


def scene_spans(cuts: Column, duration: Column, shortest: float = 0.05) -> Column:
    """SEQ17. (start, end) structs between 0, the cuts inside and the end, rounded to tenths; spans under ``shortest`` go. None without a length."""
    inside = F.filter(cuts, lambda c: (c > 0) & (c < duration))
    places = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), inside, F.array(duration.cast("double")))))
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size(places) - 1, F.lit(1))), lambda i: F.struct(F.get(places, i - 1).alias("start"), F.get(places, i).alias("end")))
    kept = F.filter(spans, lambda s: s["end"] - s["start"] >= shortest)
    return F.when(duration > 0, F.transform(kept, lambda s: F.struct(F.round(s["start"], 1).alias("start"), F.round(s["end"], 1).alias("end")))).otherwise(F.slice(kept, 1, 0))


def split_spans(spans: Column, most: float, tail: float = 0.05) -> Column:
    """SEQ18. Spans of at most ``most`` seconds, one after another; a last piece of no more than ``tail`` is left out."""
    def pieces(s: Column) -> Column:
        n = F.greatest(F.ceil((s["end"] - s["start"]) / most).cast("int"), F.lit(1))
        cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((s["start"] + i * most).alias("start"), F.least(s["end"], s["start"] + (i + 1) * most).alias("end")))
        return F.filter(cut, lambda p: (p["end"] - p["start"] > tail) | (n == 1))

    return F.flatten(F.transform(spans, pieces))


def position_cascade(track: Column, estimate: Column, own: Column) -> Column:
    """SEQ10. Struct (lat, lon, ele, source) of the first known of three (lat, lon, ele) structs: on the track, along its points, the item's own."""
    tagged = lambda c, name: F.when(c["lat"].isNotNull() & c["lon"].isNotNull(), F.struct(c["lat"].alias("lat"), c["lon"].alias("lon"), c["ele"].alias("ele"), F.lit(name).alias("source")))
    return F.coalesce(tagged(track, "track_interpolado"), tagged(estimate, "estimado"), tagged(own, "gps_propio"))


def along(start: Column, end: Column, share: Column) -> Column:
    """SEQ10. (lat, lon, ele) between two such structs; the elevation is known only if both are."""
    mixed = lambda f: start[f] + (end[f] - start[f]) * share
    return F.struct(mixed("lat").alias("lat"), mixed("lon").alias("lon"), mixed("ele").alias("ele"))


def place_transitions(df: DataFrame, by: Sequence[str], order: Sequence[str], place: str) -> DataFrame:
    """SEQ7. Rows whose known place differs from that of the row before; an unknown place resets."""
    rows = lagged(df, by, order, {"before": F.col(place)})
    return rows.where(F.col(place).isNotNull() & ~F.col(place).eqNullSafe(F.col("before")))


def weather_transitions(df: DataFrame, by: Sequence[str], order: Sequence[str], label: str, temperature: str, step: float) -> DataFrame:
    """SEQ7. Rows whose label changes, or whose temperature is ``step`` or more from the last known one.

    A row without a label resets both. A stretch between resets is a running count, so neighbours are found
    within it; the last known temperature may be several rows back.
    """
    numbered = running_sums(df, order, {"_stretch": F.col(label).isNull().cast("long")}, by).where(F.col(label).isNotNull())
    keys = [*by, "_stretch"]
    rows = lagged(numbered, keys, order, {"label_before": F.col(label)})
    rows = with_neighbours(rows, order, F.col(temperature), keys).withColumnRenamed("prev", "temperature_before")
    far = F.coalesce(F.abs(F.col(temperature) - F.col("temperature_before")) >= step, F.lit(False))
    return rows.where(~F.col(label).eqNullSafe(F.col("label_before")) | far).drop("_stretch")


def _metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    la, oa, lb, ob = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - oa) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(h)))


class Emission:
    """SEQ11. What is emitted of one key's samples in order: the state is the last emitted place and whether it rests."""

    def __init__(self, metres: float, slow_kmh: float) -> None:
        self.metres, self.slow = metres, slow_kmh
        self.last = self.kept = None
        self.resting = False

    def keeps(self, place: tuple[float, float], kmh: float, final: bool) -> bool:
        """The first sample always; a moving one from ``metres`` on; of a rest its first; the final one. Of those, none nearer than ``metres`` to the one kept before."""
        moving = kmh >= self.slow
        if self.last is None:
            emit = True
            moving = True
        elif moving:
            emit = _metres(self.last, place) >= self.metres
        else:
            emit = not self.resting
        self.resting = not moving
        if emit:
            self.last = place
        if not (emit or final):
            return False
        if self.kept is not None and _metres(self.kept, place) < self.metres:
            return False
        self.kept = place
        return True


def emitted(df: DataFrame, by: Sequence[str], ts: str, tie: str, lat: str, lon: str, metres: float, slow_kmh: float = 0.0) -> DataFrame:
    """SEQ11. The rows that ``Emission`` keeps; rows without a position are left out, and the last row of a key is its final sample.

    The rule looks back at what it kept, so a key is read in order. Rows are dealt by key and sorted, and a task streams
    through them with one state: memory doesn't follow the size of a key.
    """
    known = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    rows = lagged(known, by, [ts, tie], {"_lat": F.col(lat), "_lon": F.col(lon), "_ts": F.col(ts)})
    rows = lagged(rows, by, [ts, tie], {"_more": F.lit(True)}, ahead=True)
    from caravel.functions.geo import haversine

    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_ts").cast("timestamp"))) / 1e6
    kmh = F.coalesce(F.try_divide(haversine("_lat", "_lon", lat, lon), F.when(seconds > 0, seconds)) * 3.6, F.lit(0.0))
    slim = rows.select(*by, F.col(tie).alias("_tie"), F.col(ts).alias("_at"), F.struct(*by).alias("_key"), F.col(lat).alias("_y"), F.col(lon).alias("_x"), kmh.alias("_kmh"), F.col("_more").isNull().alias("_final"))
    names = [*by, "_tie"]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keep = []
            for k, y, x, kmh_, final in zip(*[batch.column(c).to_pylist() for c in ("_key", "_y", "_x", "_kmh", "_final")], strict=True):
                if state is None or k != key:
                    key, state = k, Emission(metres, slow_kmh)
                keep.append(state.keeps((y, x), kmh_, final))
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    schema = slim.select(*names).schema
    found = slim.repartition(*by).sortWithinPartitions(*by, "_at", "_tie").mapInArrow(kept, schema).withColumnRenamed("_tie", tie)
    # a struct equals another field by field, nulls too
    here = F.struct(*[F.col(f"`{c}`") for c in (*by, tie)])
    return df.withColumn("_here", here).join(found.select(here.alias("_here")), "_here", "left_semi").drop("_here")
