"""Windows of a chat that follow an hour of the day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.operators import ordered
from caravel.operators.ordered import plain_keys

DAY_US = 86_400_000_000


def windows(messages: DataFrame, probes: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, hour: str, size: int, offset_hours: int = -3) -> DataFrame:
    """SEQ24. Rows of ``messages`` joined to the probes that show them: ``size`` messages from the one whose hour of the day is nearest to the probe's, with ``place`` (1 ... size).

    ``messages`` have a running number within ``by``, in ``order`` (which begins with a time); ``probes`` hold ``hour`` (0 to 24) beside ``by``. Hours go round: 23:00 and 1:00 are two hours apart. Of equally near
    messages the first one counts. A window doesn't reach beyond the last message: it begins earlier there. In a chat without times, it begins at the hour's share of the chat.

    Nearest hours are found by as-of joins over the chat's *different* hours, with one copy a day earlier and one a day later; window and messages meet in blocks of ``size``
    numbers, two a probe. So a chat may hold any share of the messages.
    """
    numbered = ordered.running_sums(messages, order, {"_n": F.lit(1)}, by)
    total = numbered.groupBy(*[c.alias(n) for n, c in plain_keys(numbered, by).items()]).agg(F.count("*").alias("_total"), F.count(ts).alias("_timed"))
    keys = list(plain_keys(numbered, by))
    rows = numbered.withColumns(plain_keys(numbered, by))
    asked = probes.withColumns({n: c for n, c in zip(keys, _like(probes, by, keys), strict=True)}).withColumn("_probe", F.pmod(F.round(F.col(hour) * 3_600_000_000).cast("long"), F.lit(DAY_US)))
    # of each different hour the first message
    local = F.pmod(F.unix_micros(F.col(ts).cast("timestamp")) + offset_hours * 3_600_000_000, F.lit(DAY_US))
    firsts = rows.where(F.col(ts).isNotNull()).groupBy(*keys, local.alias("_hour")).agg(F.min("_n").alias("_n"))
    around = firsts.withColumn("_shown", F.explode(F.array(F.col("_hour") - DAY_US, F.col("_hour"), F.col("_hour") + DAY_US)))
    right = around.select(*keys, F.timestamp_micros("_shown").alias("_t"), "_shown", "_n")
    left = asked.select(*keys, "_probe").distinct().withColumn("_t", F.timestamp_micros("_probe"))
    near = ordered.asof(left, right, "_t", F.struct("_shown", "_n"), keys, ahead=True)
    back, forth = F.col("_probe") - F.col("prev._shown"), F.col("next._shown") - F.col("_probe")
    best = F.when(back < forth, F.col("prev._n")).when(forth < back, F.col("next._n")).otherwise(F.least("prev._n", "next._n"))
    starts = near.select(*keys, "_probe", F.coalesce(best, F.col("prev._n"), F.col("next._n")).alias("_best"))
    shown = asked.join(starts, [*keys, "_probe"], "left").join(total, keys)
    last = F.greatest(F.col("_total") - size, F.lit(0))
    share = F.floor(F.col("_probe") / DAY_US * last + 0.5)
    start = F.when(F.col("_timed") > 0, F.least(F.col("_best") - 1, last)).otherwise(F.least(share, last))
    shown = shown.withColumn("_start", start).withColumn("_block", F.explode(F.array(F.floor(F.col("_start") / size), F.floor(F.col("_start") / size) + 1)))
    shown = shown.select(*[F.col(f"`{c}`").alias(f"_probe_{i}") for i, c in enumerate(probes.columns)], *[F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)], "_start", "_block")
    cut = rows.withColumn("_block", F.floor((F.col("_n") - 1) / size))
    met = cut.join(shown, [cut["_block"] == shown["_block"], *[cut[k] == shown[f"_of{i}"] for i, k in enumerate(keys)]])
    place = F.col("_n") - F.col("_start")
    own = [F.col(f"`{c}`") for c in messages.columns]
    extra = [F.col(f"_probe_{i}").alias(c) for i, c in enumerate(probes.columns) if c not in by]
    return met.where((place >= 1) & (place <= size)).select(*own, *extra, place.cast("int").alias("place"))


def _like(df: DataFrame, by: Sequence[str], keys: list[str]) -> list:
    """Key columns of ``df`` under the names that another table's keys have."""
    own = plain_keys(df, by)
    return [own.get(k, F.lit(False)) for k in keys]
