"""Order-dependent operators without a single global partition.

A global sequence (a route, a time axis) is cut into buckets of time. Windows run
within a bucket; what a bucket needs from the ones before or after it (the last known
row, the running total) is a one-row-per-bucket summary, so the only unpartitioned window has as many
rows as there are buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caravel.session import cut_lineage

DAY = 86_400


def bucket_of(ts: str | Column, seconds: int = DAY) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(c.cast("timestamp")) / seconds)


def plain_keys(df: DataFrame, by: Sequence[str], name: str = "_key") -> dict[str, Column]:
    """Columns that are never null and equal for rows whose ``by`` are equal, nulls being equal: a value, and beside a nullable one whether it is null.

    So windows, summaries and plain equi-joins all need the same partitioning, and rows are exchanged once.
    """
    out: dict[str, Column] = {}
    for i, c in enumerate(by):
        field, own = df.schema[c], F.col(f"`{c}`")
        if not field.nullable:
            out[f"{name}{i}"] = own
        elif isinstance(field.dataType, (T.NumericType, T.StringType, T.BooleanType, T.TimestampType, T.DateType)):
            zero = {T.StringType: F.lit(""), T.BooleanType: F.lit(False), T.TimestampType: F.timestamp_seconds(F.lit(0)), T.DateType: F.date_from_unix_date(F.lit(0))}.get(type(field.dataType), F.lit(0))
            out[f"{name}{i}"] = F.coalesce(own, zero.cast(field.dataType))
            out[f"{name}{i}_null"] = own.isNull()
        else:
            out[f"{name}{i}"] = F.struct(own)
    return out


def _keyed(df: DataFrame, by: Sequence[str], bucket: Column) -> tuple[DataFrame, list[str], list[str]]:
    """``df`` with its place columns; those of a key, and those of a key's bucket."""
    keys = plain_keys(df, by)
    return df.withColumns({**keys, "_bucket": bucket}), list(keys), [*keys, "_bucket"]


def with_neighbours(df: DataFrame, order: Sequence[str], value: Column, by: Sequence[str] = (), bucket: Column | None = None, back: bool = True, ahead: bool = False, current: bool = False, value_ahead: Column | None = None, names: tuple[str, str] = ("prev", "next")) -> DataFrame:
    """SEQ12, DOC3. Adds ``prev`` and/or ``next`` (or other ``names``): the nearest non-null ``value`` before / behind each row.

    ``current``: the row itself counts. ``order`` begins with the time column of the buckets. ``value_ahead`` is
    looked for behind each row instead of ``value``. Rows without a time are in a bucket of their own, before all others; keys
    ``by`` may be null.
    """
    own = F.coalesce(bucket if bucket is not None else bucket_of(order[0]), F.lit(-(1 << 62)))
    rows, key, place = _keyed(df, by, own)
    rows = rows.withColumn("_value", value).withColumn("_value_ahead", value if value_ahead is None else value_ahead)
    up, down = [F.col(c).asc() for c in order], [F.col(c).desc() for c in order]
    edge = 0 if current else -1
    at = F.struct(*order)
    inside, over = Window.partitionBy(*place), Window.partitionBy(*key)
    found, edges, carries = [], [], []
    for wanted, name, column, direction, outermost, buckets in ((back, names[0], "_value", up, F.max_by, F.asc("_bucket")), (ahead, names[1], "_value_ahead", down, F.min_by, F.desc("_bucket"))):
        if not wanted:
            continue
        n = len(found)
        near = F.last(column, ignorenulls=True).over(inside.orderBy(*direction).rowsBetween(Window.unboundedPreceding, edge))
        found.append((name, near.alias(f"_near{n}")))
        # of each bucket the outermost known value, then the last one of the buckets before
        edges.append(outermost(column, F.when(F.col(column).isNotNull(), at)).alias(f"_edge{n}"))
        carries.append(F.last(f"_edge{n}", ignorenulls=True).over(over.orderBy(buckets).rowsBetween(Window.unboundedPreceding, -1)).alias(f"_carry{n}"))
    summary = rows.groupBy(*place).agg(*edges).select(*place, *carries)
    kept = [c for c in df.columns if c not in names[:2] or c not in {n for n, _ in found}]
    both = rows.select(*place, *[F.col(f"`{c}`") for c in kept], *[c for _, c in found]).join(summary, place)
    return both.select(*[F.col(f"`{c}`") for c in kept], *[F.coalesce(f"_near{n}", f"_carry{n}").alias(name) for n, (name, _) in enumerate(found)])


def running_sums(df: DataFrame, order: Sequence[str], sums: dict[str, Column], by: Sequence[str] = (), bucket: Column | None = None) -> DataFrame:
    """Adds running totals, the row itself included; null counts as 0."""
    rows, key, place = _keyed(df, by, F.coalesce(bucket if bucket is not None else bucket_of(order[0]), F.lit(-(1 << 62))))
    rows = rows.withColumns({f"_sum_of_{k}": F.coalesce(v, F.lit(0)) for k, v in sums.items()})
    total = rows.groupBy(*place).agg(*[F.sum(f"_sum_of_{k}").alias(f"_sum_{k}") for k in sums])
    earlier = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*place, *[F.coalesce(F.sum(f"_sum_{k}").over(earlier), F.lit(0)).alias(f"_base_{k}") for k in sums])
    inside = Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({f"_run_{k}": F.sum(f"_sum_of_{k}").over(inside) for k in sums})
    kept = [F.col(f"`{c}`") for c in df.columns if c not in sums]
    return own.join(total, place).select(*kept, *[(F.col(f"_run_{k}") + F.col(f"_base_{k}")).alias(k) for k in sums])


def asof(left: DataFrame, right: DataFrame, ts: str, value: Column, by: Sequence[str] = (), back: bool = True, ahead: bool = False, strict: bool = False, seconds: int = DAY, right_order: Sequence[str] = ()) -> DataFrame:
    """JN10, JN11. Adds to ``left`` the nearest ``value`` of ``right`` at or before (``prev``) and at or after (``next``) ``ts``.

    strict: an equal time doesn't count. Both sides meet in one sorted stream of time buckets;
    no side is broadcast and no pair is enumerated. ``right_order`` breaks ties of equal times. Every row
    of ``left`` stays once, repeated and null ones too; a null time has no neighbour.
    """
    order = list(right_order)
    ties = [f"_o{i}" for i in range(len(order))]
    l = left.withColumn("_left", F.struct(*[F.col(f"`{c}`") for c in left.columns])).select(*by, F.col(ts).alias("_ts"), F.lit(1).alias("_at"), "_left")
    r = right.where(F.col(ts).isNotNull()).select(*by, F.col(ts).alias("_ts"), value.alias("_right"), *[F.col(c).alias(t) for c, t in zip(order, ties, strict=True)])
    # of equal times, what counts backwards stands before the left rows and what counts ahead behind them; if strict the other way round
    before, behind = (2, 0) if strict else (0, 2)
    none = F.lit(None).cast(r.schema["_right"].dataType)
    union = l
    if back:
        union = union.unionByName(r.withColumn("_at", F.lit(before)).withColumn("_ahead", none), allowMissingColumns=True)
    if ahead or not back:
        union = union.unionByName(r.withColumn("_at", F.lit(behind)).withColumn("_ahead", F.col("_right")).withColumn("_right", none), allowMissingColumns=True)
    got = with_neighbours(union, ["_ts", "_at", *ties], F.col("_right"), by, bucket_of("_ts", seconds), back=back, ahead=ahead or not back, value_ahead=F.col("_ahead"))
    names = (["prev"] if back else []) + (["next"] if ahead or not back else [])
    own = [F.col(f"_left.`{c}`") for c in left.columns if c not in names]
    return got.where("_left is not null").select(*own, *[F.when(F.col("_ts").isNotNull(), F.col(n)).alias(n) for n in names])


def lagged(df: DataFrame, by: Sequence[str], order: Sequence[str], values: dict[str, Column], ahead: bool = False) -> DataFrame:
    """Adds the values of the row just before (or behind) within ``by``; null at the end of a key.

    A key may hold any share of the rows: it is cut into time buckets.
    """
    row = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values.values())])
    rows = with_neighbours(df, order, row, by, back=not ahead, ahead=ahead, names=("_beside", "_beside"))
    return rows.withColumns({k: F.col(f"_beside.v{i}") for i, k in enumerate(values)}).drop("_beside")


def sessions(df: DataFrame, by: Sequence[str], ts: str, gap_seconds: float, tie: str, out: str = "session") -> DataFrame:
    """SEQ14. Adds the session number within ``by``: a new one behind a gap of more than ``gap_seconds``.

    Gaps are counted in time buckets, so one key may hold any share of the rows; the gaps between and in the buckets before come
    from their first and last times. Rows without a time are in the first session.
    """
    rows, key, place = _keyed(df, by, F.coalesce(bucket_of(ts), F.lit(-(1 << 62))))
    rows = rows.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    far = lambda later, earlier: F.coalesce((later - earlier > F.lit(gap_seconds * 1e6)).cast("long"), F.lit(0))
    inside = Window.partitionBy(*place).orderBy(ts, tie)
    gaps = rows.withColumn("_gap", far(F.col("_at"), F.lag("_at").over(inside)))
    ends = gaps.groupBy(*place).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.sum("_gap").alias("_gaps"))
    over = Window.partitionBy(*key).orderBy("_bucket")
    ends = ends.withColumn("_gap_before", far(F.col("_first"), F.lag("_last").over(over)))
    base = F.sum(F.col("_gaps") + F.col("_gap_before")).over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_gaps")
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    own = gaps.withColumn("_run", F.sum("_gap").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return own.join(ends.select(*place, base.alias("_base")), place).select(*kept, (F.col("_run") + F.col("_base")).alias(out))


def anchored_groups(df: DataFrame, by: Sequence[str], ts: str, window_seconds: float, tie: str = "", out: str = "burst") -> DataFrame:
    """SEQ13. Adds a group number within ``by``: a group ends where a row is more than ``window_seconds`` behind its *first* row.

    Of each time of a key (rows of one time share their group) an as-of join finds the next group's first time, were it
    the first of a group itself. Which times are first ones is then a matter of following these links from those behind a silence, which
    are first ones for sure. Links are joined with themselves, so that each table of links reaches twice as far as the one before it;
    taken from the farthest to the nearest, each one finds the first times in the middle between those known. So a key may hold any
    share of the rows, and the rounds follow the logarithm of the groups between two silences. Every row stays once, repeated ones
    and null keys too; rows without a time have no group. ``tie`` isn't needed any more.
    """
    micros = int(window_seconds * 1e6)
    rows, n = df.withColumn("_at", F.col(ts).cast("timestamp")), len(by)
    keys = [f"_by{i}" for i in range(n)]
    times = rows.where("_at is not null").select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], "_at").distinct()
    near = lagged(times, keys, ["_at"], {"_before": F.col("_at")})
    silent = F.col("_before").isNull() | (F.unix_micros("_at") - F.unix_micros("_before") > micros)
    # one struct, which is equal for equal fields, nulls too
    here = lambda c: F.struct(*keys, F.col(c).alias("t"))
    nodes = cut_lineage(near.select(*keys, "_at", silent.alias("_root")))
    probes = nodes.select(*keys, here("_at").alias("a"), F.timestamp_micros(F.unix_micros("_at") + micros).alias("_end"))
    ends = nodes.select(*keys, F.col("_at").alias("_end"), "_root")
    step = asof(probes, ends, "_end", F.struct("_end", "_root"), keys, back=False, ahead=True, strict=True)
    step = step.where("next is not null and not next._root").select("a", F.struct(*keys, F.col("next._end").alias("t")).alias("b"))
    links = []
    while True:
        step = cut_lineage(step)
        if step.isEmpty():
            break
        links.append(step)
        step = step.join(step.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
    first = nodes.where("_root").select(here("_at").alias("a"))
    for link in reversed(links):
        first = cut_lineage(first.unionByName(first.join(link, "a").select(F.col("b").alias("a"))))
    marked = nodes.withColumn("a", here("_at")).join(first.withColumn("_first", F.lit(1).cast("long")), "a", "left")
    numbered = running_sums(marked, ["_at"], {"_n": F.col("_first")}, keys).select(here("_at").alias("_time"), (F.col("_n") - 1).alias(out))
    own = F.struct(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], F.col("_at").alias("t"))
    return rows.drop(out).withColumn("_time", own).join(numbered, "_time", "left").drop("_time", "_at")


def changes(df: DataFrame, by: Sequence[str], order: Sequence[str], state: Column, out: str = "state") -> DataFrame:
    """SEQ5. Rows at which a known state differs from the row before; an unknown state resets, so the next known one counts."""
    rows = lagged(df.withColumn(out, state), by, order, {"before": F.col(out), "_any": F.lit(True)})
    return rows.where(F.col(out).isNotNull() & F.col("_any").isNotNull() & ~F.col(out).eqNullSafe(F.col("before"))).drop("_any")


def numbered(df: DataFrame, order: Sequence[str], name: str, start: Column | int = 0) -> DataFrame:
    """SNK1. Adds ``name``: ``start`` and the place of each row in ``order``, from 1 on, without a task that holds all rows.

    Rows are split into ranges and written with their range's number, so that it is the same for every later reader; a window counts within a range, and
    one row for each range tells how many come before it. ``order`` should tell rows apart: equal ones are in one range.
    """
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = cut_lineage(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    begin = start if isinstance(start, Column) else F.lit(start)
    placed = rows.withColumn("_own", own).join(F.broadcast(before), "_range")  # at most as many rows as ranges
    return placed.withColumn(name, (begin + F.col("_before") + F.col("_own")).cast("long")).drop("_range", "_own", "_before")
