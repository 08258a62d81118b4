"""Facets, shares, clouds and attribute tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_hours(df: DataFrame, hour: Column) -> DataFrame:
    """(hour, n, weight) for all of 0 to 23; weight is n over the greatest n, 3 decimals."""
    counts = df.groupBy(hour.cast("int").alias("hour")).agg(F.count("*").alias("n"))
    dense = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour")).join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))
    return dense.withColumn("weight", F.round(F.col("n") / F.greatest(F.max("n").over(Window.partitionBy()), F.lit(1)), 3))


def values_share(df: DataFrame, value: str) -> DataFrame:
    """(value, n, pct): counts and percent of all rows; null is a value of its own."""
    counts = df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))


def unpivoted(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Text columns as (ids, key, value) rows, nulls left out."""
    return df.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(list(ids), list(columns), "key", "value").where("value is not null")


def pivoted(eav: DataFrame, keys: Sequence[str], id_col: str = "media_id") -> DataFrame:
    """One row per id with a column per key; the keys are named, so the plan has no extra pass."""
    return eav.where(F.col("key").isin(*keys)).groupBy(id_col).agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])


def top_quartile(df: DataFrame, word: Column, keep: Callable[[Column], Column] | None = None, cap: int = 200) -> DataFrame:
    """(word, n) of the most frequent quarter of the words, at least 1 and at most ``cap``; ties by word.

    ``keep`` is asked once for each different word. The number of words is an aggregate, so the ranking is a top-``cap`` and no global window.
    """
    counts = df.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = counts.where(keep(F.col("word"))) if keep else counts
    size = counts.agg(F.count("*").alias("words"))
    top = counts.orderBy(F.desc("n"), "word").limit(cap)
    ranked = top.withColumn("_r", F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "word")))
    return ranked.join(F.broadcast(size)).where(F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("words") / 4))).select("word", "n")


def tag_cloud(df: DataFrame, word: Column, top: int = 50, least: int = 3, stop: Sequence[str] = ()) -> DataFrame:
    """(tag, n, weight) of normalised words: letters only, ``least`` characters, no stop words, once-only phrases out.

    Raw words are counted first, so that each different one is normalised once.
    """
    raw = df.select(word.alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    tag = F.trim(F.regexp_replace(F.lower("w"), r"[^\p{L} ]", ""))
    tags = raw.select(tag.alias("tag"), "n").where((F.length("tag") >= least) & ~F.col("tag").isin(*stop) if stop else F.length("tag") >= least)
    counts = tags.groupBy("tag").agg(F.sum("n").alias("n")).where((F.col("n") > 1) | ~F.col("tag").contains(" "))
    best = counts.orderBy(F.desc("n"), "tag").limit(top)
    return best.withColumn("weight", F.round(F.col("n") / F.max("n").over(Window.partitionBy()), 2))


def majority(df: DataFrame, key: Sequence[str], value: str, order: str) -> DataFrame:
    """The most frequent value per key; ties go to the value seen first by ``order``."""
    counts = df.groupBy(*key, value).agg(F.count("*").alias("votes"), F.min(order).alias("first"))
    best = F.max_by(F.struct(value, "votes"), F.struct("votes", -F.col("first")))
    return counts.groupBy(*key).agg(best.alias("b")).select(*key, f"b.{value}", "b.votes")


def text_search(tables: dict[str, tuple[DataFrame, str, Sequence[str]]], pattern: str) -> DataFrame:
    """(source, id, column, value) of every text column that matches ``ilike``; tables by name as (frame, id, columns)."""
    found = None
    for name, (df, key, columns) in tables.items():
        rows = unpivoted(df, [key], columns).where(F.col("value").ilike(pattern)).select(F.lit(name).alias("source"), F.col(key).cast("long").alias("id"), F.col("key").alias("column"), "value")
        found = rows if found is None else found.unionByName(rows)
    return found


def sample_per_group(df: DataFrame, group: str, key: str, n: int, order: Column) -> DataFrame:
    """``n`` rows of each group by a hash order, the same in every run."""
    w = Window.partitionBy(group).orderBy(order, key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def portable_hash(key: str, seed: int = 1) -> Column:
    """An integer scramble of a key that any engine computes alike."""
    return F.pmod((F.col(key).cast("long") + seed) * 1_103_515_245 + 12_345, F.lit(2_147_483_648))


def palette(df: DataFrame, slots: Sequence[tuple[str, str]]) -> DataFrame:
    """(name, hex, n) of distinct colours over several slots: least hex and number of different ones, by name."""
    rows = None
    for name, code in slots:
        part = df.select(F.col(name).alias("name"), F.col(code).alias("hex"))
        rows = part if rows is None else rows.union(part)
    return rows.where("name is not null").distinct().groupBy("name").agg(F.min("hex").alias("hex"), F.count("*").alias("n"))


def color_meanings(df: DataFrame, key: str, slots: Sequence[str], meanings: DataFrame) -> DataFrame:
    """(key, meaning, slot): meanings (color, meaning) of an item's colours with the first slot that has it."""
    placed = df.select(key, F.posexplode(F.array(*slots)).alias("slot", "color"))
    return placed.join(F.broadcast(meanings), "color").groupBy(key, "meaning").agg(F.min(F.col("slot") + 1).alias("slot"))
