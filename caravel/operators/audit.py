"""Audits of descriptions: how they begin, what is left in their midst, and which language lags behind the other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravel.session import cut_lineage


def openings(texts: DataFrame, text: str, least: int, depth: int = 8) -> DataFrame:
    """QRY17. (words, opening, n): beginnings that at least ``least`` texts share, of one word up to ``depth``, in lower case.

    A prefix tree counted level by level. A beginning can't be more frequent than the one it goes on from, so each level reads only texts whose
    beginning was frequent on the level before, and the tree ends where none is. What is shuffled are counts combined per task.
    """
    words = F.filter(F.split(F.lower(F.trim(F.col(text))), r"\s+"), lambda w: w != "")
    rows = cut_lineage(texts.select(F.slice(words, 1, depth).alias("w")).where(F.size("w") > 0))
    out = None
    for level in range(1, depth + 1):
        head = F.array_join(F.slice("w", 1, level), " ")
        found = cut_lineage(rows.where(F.size("w") >= level).groupBy(head.alias("opening")).agg(F.count("*").alias("n")).where(F.col("n") >= least))
        part = found.select(F.lit(level).alias("words"), "opening", "n")
        out = part if out is None else out.unionByName(part)
        if level == depth or found.isEmpty():
            return out
        rows = rows.withColumn("_opening", head).join(found.select(F.col("opening").alias("_opening")), "_opening", "left_semi").drop("_opening")
    return out


def description_audit(descriptions: DataFrame, prefixes: dict[str, Sequence[str]], residues: Sequence[tuple[str, str | None, str, int]], openers: Sequence[str]) -> DataFrame:
    """QRY17. (section, name, n) of descriptions (media_id, key, value).

    Sections: ``count`` by key; ``prefix``: values of a key that begin with one of its ``prefixes``; ``residue``: values (of a key, or of any) that hold a text at a position of at least so many
    characters, as (name, key, text, position); ``only``: items one of whose keys has a prefix and whose other key hasn't; ``opener``: values with legitimate beginnings, which a cleaning must
    leave alone. Two passes: one over values, one over items.
    """
    keys = list(prefixes)
    low = F.lower(F.trim("value"))
    begins = lambda texts: F.coalesce(_any([low.startswith(t) for t in texts]), F.lit(False))
    prefixed = F.lit(False)
    for k, texts in prefixes.items():
        prefixed = F.when(F.col("key") == k, begins(texts)).otherwise(prefixed)
    rows = descriptions.withColumn("_prefixed", prefixed)
    asked: list[tuple[str, str, Column]] = [("count", k, F.col("key") == k) for k in keys]
    asked += [("prefix", k, (F.col("key") == k) & F.col("_prefixed")) for k in keys]
    for name, key, text, position in residues:
        at = F.instr(F.lower("value"), F.lit(text))
        asked.append(("residue", name, (at >= position) & (F.col("key") == key if key else F.lit(True))))
    asked += [("opener", o, F.col("key").isin(*keys) & low.startswith(o)) for o in openers]
    counted = rows.agg(*[F.count_if(c).alias(f"n{i}") for i, (_, _, c) in enumerate(asked)])
    listed = counted.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), F.col(f"n{i}").alias("n")) for i, (s, n, _) in enumerate(asked)])).alias("r")).select("r.*")
    by_item = rows.groupBy("media_id").agg(*[F.coalesce(F.bool_or((F.col("key") == k) & F.col("_prefixed")), F.lit(False)).alias(f"k{i}") for i, k in enumerate(keys)])
    alone = by_item.agg(*[F.count_if(F.col(f"k{i}") & ~_any([F.col(f"k{j}") for j in range(len(keys)) if j != i])).alias(f"o{i}") for i in range(len(keys))])
    crossed = alone.select(F.explode(F.array(*[F.struct(F.lit("only").alias("section"), F.lit(k).alias("name"), F.col(f"o{i}").alias("n")) for i, k in enumerate(keys)])).alias("r")).select("r.*")
    return listed.unionByName(crossed)


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
