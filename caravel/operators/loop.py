"""The loop of chosen hours: segments, placement, scores, ambient events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6


def loop_segments(hours: Sequence[int], seconds: float) -> list[dict]:
    """The N - 1 arcs between consecutive chosen hours: arc hours (an arc that doesn't rise wraps at 24), equal shares of the loop."""
    if len(hours) < 2 or seconds <= 0:
        raise ValueError("a loop needs two hours or more and a positive length")
    share = seconds / (len(hours) - 1)
    return [{"seg": i, "h_from": a, "h_to": b, "arc": b - a if b > a else b - a + 24, "t_from": i * share, "t_to": (i + 1) * share} for i, (a, b) in enumerate(zip(hours, hours[1:], strict=False))]


def placed(df: DataFrame, hour: Column, hours: Sequence[int], seconds: float) -> DataFrame:
    """Adds (seg, fraction, t_loop) of the first arc that holds the hour; rows outside all arcs or [0, 24) go.

    The arcs are literals of the plan, so it is a chain of conditions on one pass over the rows.
    """
    spot = F.lit(None).cast("struct<seg: int, fraction: double, t_loop: double>")
    for s in reversed(loop_segments(hours, seconds)):
        wraps = s["h_from"] + s["arc"] > 24 or s["h_to"] <= s["h_from"]
        h = F.when(hour < s["h_from"] - EPS, hour + 24).otherwise(hour) if wraps else hour
        inside = (h >= s["h_from"] - EPS) & (h <= s["h_from"] + s["arc"] + EPS)
        fraction = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (h - s["h_from"]) / s["arc"]))
        here = F.struct(F.lit(s["seg"]).alias("seg"), fraction.alias("fraction"), (s["t_from"] + fraction * (s["t_to"] - s["t_from"])).alias("t_loop"))
        spot = F.when(inside, here).otherwise(spot)
    spot = F.when((hour >= 0) & (hour < 24), spot)
    return df.withColumn("_spot", spot).where("_spot is not null").select(*df.columns, "_spot.*")


def hour_range(hours: Sequence[int]) -> tuple[float, float]:
    """Hard filter of chosen hours: none is the whole day, one is that instant, else from least to greatest."""
    return (0.0, 23.0) if not hours else (float(min(hours)), float(max(hours)))


def local_hour(ts: Column, offset_hours: int = -3) -> Column:
    """Fractional hour of a UTC time at a fixed offset."""
    seconds = F.unix_micros(ts.cast("timestamp")) / 1e6 + offset_hours * 3600
    return F.pmod(seconds, F.lit(86_400.0)) / 3600


def priority(kind: Column, colors: Sequence[Column], wanted_colors: Sequence[str], tags: Column, wanted_tags: Sequence[str]) -> Column:
    """Matching colour slots (images only) plus wanted tags that occur in the tag text."""
    score = F.lit(0)
    for c in colors:
        score = score + F.coalesce((kind.eqNullSafe("image") & c.isin(*wanted_colors)).cast("int"), F.lit(0)) if wanted_colors else score
    for t in wanted_tags:
        score = score + F.coalesce(F.contains(F.lower(tags), F.lit(t)).cast("int"), F.lit(0))
    return score


def ambient_events(elevation: Column, temperature: Column, wind: Column, rain: Column) -> Column:
    """M15. Texts of the ambient rules that hold, in the order of the rules; an unknown measure holds none."""
    rules = ((elevation.between(0, 3), "sun at the horizon"), (elevation >= 60, "sun overhead"), (temperature >= 30, "heat"), (temperature <= 5, "cold"), (wind >= 30, "wind"), (rain > 0, "rain"), (elevation < -6, "night"))
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))


def first_events(df: DataFrame, text: str, hour: str, score: str, key: str) -> DataFrame:
    """One row for each text and whole hour: the earliest, then the best, then the least key."""
    order = F.struct(F.col(hour).alias("h"), (-F.col(score)).alias("s"), F.col(key).alias("k"))
    return df.groupBy(F.col(text).alias("text"), F.floor(hour).cast("int").alias("h")).agg(F.min(order).alias("o")).select("text", "h", F.col("o.h").alias("hour"), F.col("o.k").alias("key"))
