"""Timestamps of files and messages: parsing, local hours, weekdays, intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the archive's local time, without daylight saving.
LOCAL = "-03:00"
#: Forms of a time without an offset, which count as local.
NAIVE_FORMS = ("yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss")
#: Weekday names from Monday on.
WEEKDAYS = ("lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parsed(text) -> Column:
    """D1. Struct of ts and note (``offset``, ``local`` or ``unreadable``; null for null)."""
    t = F.trim(_c(text))
    has_offset = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
    aware = F.when(has_offset, F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, " ", "T"), r"([+-]\d{2})(\d{2})$", "$1:$2")))
    naive = F.coalesce(*[F.try_to_timestamp(F.concat(F.regexp_replace(t, r"\.\d+$", ""), F.lit(LOCAL)), F.lit(f"{f}XXX")) for f in NAIVE_FORMS])
    note = F.when(t.isNull(), None).when(aware.isNotNull(), "offset").when(naive.isNotNull(), "local").otherwise("unreadable")
    return F.struct(F.coalesce(aware, naive).alias("ts"), note.alias("note"))


def _of_groups(n: Column, at: str) -> Column:
    """The local time in the six groups of a pattern, missing ones 00; null where it doesn't match or is no time."""
    part = lambda i: F.lpad(F.coalesce(F.nullif(F.regexp_extract(n, at, i), F.lit("")), F.lit("0")), 2, "0")
    text = F.concat(F.regexp_extract(n, at, 1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), part(4), F.lit(":"), part(5), F.lit(":"), part(6), F.lit(LOCAL))
    return F.when(F.regexp_extract(n, at, 1) != "", F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ssXXX")))


def of_filename(name) -> Column:
    """Local time in a file name: date with six, five, four or three fields, missing ones 00; null where there is none."""
    return _of_groups(_c(name), r"(20\d{2})[-_]?(\d{2})[-_]?(\d{2})(?:[-_ ]?(\d{2})(?:[-_.]?(\d{2}))?(?:[-_.]?(\d{2}))?)?")


def of_prefix(name) -> Column:
    """D2. Local time that a file name begins with: date and up to three more fields, joined by hyphens and ended by an underscore."""
    return _of_groups(F.trim(_c(name)), r"^(\d{4})-(\d{2})-(\d{2})(?:-(\d{2})(?:-(\d{2})(?:-(\d{2}))?)?)?_")


def end_time(ts, seconds) -> Column:
    """D4. Start plus duration; the start itself without a duration."""
    return F.timestamp_micros(F.unix_micros(_c(ts)) + (F.coalesce(_c(seconds), F.lit(0.0)) * 1_000_000).cast("long"))


def weekday(ts, hours: int = -3) -> Column:
    """D6."""
    local = F.timestamp_micros(F.unix_micros(_c(ts)) + hours * 3_600_000_000)
    return F.get(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(local))


def span_text(seconds) -> Column:
    """D9. ``2h 15m`` from an hour on, else ``mm:ss``."""
    s = F.floor(_c(seconds)).cast("long")
    hours = F.concat((s / 3600).cast("long").cast("string"), F.lit("h "), (F.pmod(s, F.lit(3600)) / 60).cast("long").cast("string"), F.lit("m"))
    short = F.concat(F.lpad((s / 60).cast("long").cast("string"), 2, "0"), F.lit(":"), F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"))
    return F.when(s >= 3600, hours).otherwise(short)


def between_places(t1, d1, t2, d2, most: float = 2000.0) -> Column:
    """D11. Instant between two passes, weighted by the other's distance; null if both are farther than ``most`` metres."""
    a, b = F.unix_micros(_c(t1)), F.unix_micros(_c(t2))
    x, y = _c(d1), _c(d2)
    mixed = F.when(x + y == 0, a).otherwise(a + (b - a) * (x / (x + y)))
    return F.when(F.least(x, y) <= most, F.timestamp_micros(mixed.cast("long")))


def mark_time(base, offset_s) -> Column:
    """D10. The instant of a mark: its item's start and the offset in it."""
    return F.timestamp_micros(F.unix_micros(_c(base)) + F.round(_c(offset_s) * 1_000_000).cast("long"))
