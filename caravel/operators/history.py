"""A log of before-images: what a batch wrote, and taking it back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravel.operators.ordered import plain_keys


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def changes_of(before: DataFrame, after: DataFrame, key: Sequence[str], batch: int | str, at: Column) -> DataFrame:
    """QRY18. (batch, at, key, op, changed, old, new): rows that a batch inserted, updated or deleted, with their images before and after.

    Both tables have the same columns; ``key`` is unique in each. Unchanged rows leave no entry, so the log grows with what was written.
    """
    keys = plain_keys(before, key)
    keys_after = plain_keys(after, key)
    names = list(keys_after) if len(keys_after) > len(keys) else list(keys)
    side = lambda df, name: df.select(*[c.alias(n) for n, c in _aligned(df, key, names).items()], F.struct(*[F.col(f"`{c}`") for c in before.columns]).alias(name))
    both = side(before, "old").join(side(after, "new"), names, "full_outer")
    rest = [c for c in before.columns if c not in key]
    changed = F.array_compact(F.array(*[F.when(~F.col(f"old.`{c}`").eqNullSafe(F.col(f"new.`{c}`")), F.lit(c)) for c in rest])) if rest else F.array().cast("array<string>")
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.size(changed) > 0, "update")
    rows = both.withColumn("op", op).where("op is not null")
    own = [F.coalesce(F.col(f"new.`{c}`"), F.col(f"old.`{c}`")).alias(c) for c in key]
    return rows.select(F.lit(batch).alias("batch"), at.alias("at"), *own, "op", F.when(F.col("op") == "update", changed).otherwise(F.array().cast("array<string>")).alias("changed"), "old", "new")


def _aligned(df: DataFrame, key: Sequence[str], names: list[str]) -> dict[str, Column]:
    """Key columns under the names that both sides need; a side that can't hold nulls says that none is null."""
    own = plain_keys(df, key)
    return {n: own.get(n, F.lit(False)) for n in names}


def batches(log: DataFrame) -> DataFrame:
    """AG7. (batch, at, n, inserted, updated, deleted) of each batch."""
    count = lambda op: F.count_if(F.col("op") == op)
    return log.groupBy("batch").agg(F.min("at").alias("at"), F.count("*").alias("n"), count("insert").alias("inserted"), count("update").alias("updated"), count("delete").alias("deleted"))


def undone(table: DataFrame, log: DataFrame, key: Sequence[str], batch: int | str) -> DataFrame:
    """QRY18. ``table`` without what ``batch`` wrote, in one join with its entries.

    Rows it inserted go. Of rows it updated, each changed column gets its value of before, unless a later batch has written that column since, whose value stays.
    Rows it deleted come back, unless there is one of their key again. Undoing batches from the last to the first gives the table before them.
    """
    own = log.where(F.col("batch") == F.lit(batch))
    names = list(plain_keys(table, key))
    more = list(plain_keys(own, key))
    names = more if len(more) > len(names) else names
    now = table.select(*[c.alias(n) for n, c in _aligned(table, key, names).items()], F.struct(*[F.col(f"`{c}`") for c in table.columns]).alias("now"))
    entries = own.select(*[c.alias(n) for n, c in _aligned(own, key, names).items()], "op", "changed", "old", "new")
    met = now.join(entries, names, "full_outer")
    back = F.col("op") == "delete"
    gone = F.coalesce((F.col("op") == "insert"), F.lit(False)) | (F.col("now").isNull() & ~F.coalesce(back, F.lit(False)))
    cells = []
    for c in table.columns:
        current, old, new = (F.col(f"{s}.`{c}`") for s in ("now", "old", "new"))
        reverted = F.array_contains("changed", F.lit(c)) & current.eqNullSafe(new) & (F.col("op") == "update")
        cells.append(F.when(F.col("now").isNull(), old).when(F.coalesce(reverted, F.lit(False)), old).otherwise(current).alias(c))
    return met.where(~gone).select(*cells)
