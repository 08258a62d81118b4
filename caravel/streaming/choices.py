"""Streams of choices: bursts that end in silence, parsed into hours and filters; windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The groups of choices that a burst may hold.
GROUPS = ("horas", "municipios", "colores", "tags", "dias", "clima")


def bursts(messages: DataFrame, quiet: str = "700 milliseconds", late: str = "10 seconds") -> DataFrame:
    """SRC15, STR1. (sender, start, end, choices) of each burst of (sender, ts, group, value): one per sender and silence of ``quiet``.

    Works on a stream (append mode; a burst goes out when the watermark has passed its end) and
    on a table alike. Unknown groups are ignored. Values are distinct and sorted.
    """
    known = messages.where(F.col("group").isin(*GROUPS))
    if known.isStreaming:
        known = known.withWatermark("ts", late)
    grouped = known.groupBy("sender", F.session_window("ts", quiet).alias("w")).agg(F.array_sort(F.collect_set(F.struct("group", "value"))).alias("choices"))
    return grouped.select("sender", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "choices")


def parsed(burst: DataFrame) -> DataFrame:
    """STR2. Hours (from ``HH:MM``, distinct, sorted) and filters by group of each burst; texts that are no hour go."""
    of = lambda g: F.transform(F.filter("choices", lambda c: c["group"] == g), lambda c: c["value"])
    hours = F.array_sort(F.array_distinct(F.filter(F.transform(of("horas"), lambda v: F.regexp_extract(v, r"^(\d{1,2}):\d{2}$", 1).try_cast("int")), lambda h: h.between(0, 23))))
    return burst.select("sender", "start", hours.alias("hours"), *[of(g).alias(g) for g in GROUPS[1:]])


def windowed_counts(events: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n): tumbling, or sliding with ``slide``; late rows up to ``late`` count."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
