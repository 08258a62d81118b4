"""Enrichment steps: a registry with dependencies, their order, and pending work."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """``pending`` tells the rows that still need it; ``run`` maps tables to changed tables."""

    name: str
    pending: Column
    run: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]
    needs: tuple[str, ...] = ()


def in_order(steps: dict[str, Step], wanted: list[str]) -> list[str]:
    """The wanted steps and all they need, each behind its needs; a circle is an error."""
    out: list[str] = []
    open_: set[str] = set()

    def visit(name: str) -> None:
        if name in out:
            return
        if name in open_:
            raise ValueError(f"{name} needs itself")
        open_.add(name)
        for n in steps[name].needs:
            visit(n)
        open_.discard(name)
        out.append(name)

    for name in wanted:
        visit(name)
    return out


def status(items: DataFrame, steps: dict[str, Step]) -> DataFrame:
    """(step, total, pending, done) of all steps in one pass over the items."""
    counts = items.agg(F.count("*").alias("total"), *[F.count_if(s.pending).alias(n) for n, s in steps.items()])
    rows = counts.select("total", F.explode(F.array(*[F.struct(F.lit(n).alias("step"), F.col(n).alias("pending")) for n in steps])).alias("s"))
    return rows.select("s.step", "total", "s.pending", (F.col("total") - F.col("s.pending")).alias("done"))


def run_steps(tables: dict[str, DataFrame], steps: dict[str, Step], wanted: list[str]) -> dict[str, DataFrame]:
    for name in in_order(steps, wanted):
        tables = tables | steps[name].run(tables)
    return tables


# --- results that are out of date ----------------------------------------------------------------


def derived_from(derivations: dict[str, tuple[str, ...]]) -> dict[str, set[str]]:
    """Of each key, all keys that are made from it, directly or through others. ``derivations``: of each made key, what it is made from; a circle is an error."""
    makes: dict[str, set[str]] = {}
    for made, sources in derivations.items():
        for s in sources:
            makes.setdefault(s, set()).add(made)
    out: dict[str, set[str]] = {}

    def after(key: str, path: tuple[str, ...]) -> set[str]:
        if key in path:
            raise ValueError(f"{key} is made from itself")
        if key not in out:
            found = set(makes.get(key, ()))
            for k in makes.get(key, ()):
                found |= after(k, (*path, key))
            out[key] = found
        return out[key]

    for key in makes:
        after(key, ())
    return {k: v for k, v in out.items() if v}


def enriched(attributes: DataFrame, results: DataFrame, derivations: dict[str, tuple[str, ...]], mode: str = "skip") -> DataFrame:
    """JOB6, JOB8, JOB19. The table of attributes (media_id, key, value) after a step's ``results``, as one table to write.

    skip: only results of keys that an item lacks. update: all, over the older values. Where a value is new or another one, everything of
    that item that is derived from it goes, through all later steps, but for what ``results`` bring themselves; so the later steps find it pending. A result that says what was there
    already invalidates nothing. ``results`` hold a key of an item once.
    """
    if mode not in ("skip", "update"):
        raise ValueError(f"unknown mode {mode!r}")
    place = ["media_id", "key"]
    new = results.join(attributes.select(place), place, "left_anti") if mode == "skip" else results
    was = attributes.select(*place, F.struct("value").alias("_was"))
    changed = new.join(was, place, "left").where(F.col("_was").isNull() | ~F.col("_was.value").eqNullSafe(F.col("value"))).select(*place)
    links = [(k, made) for k, later in derived_from(derivations).items() for made in sorted(later)]
    spark = attributes.sparkSession
    table = spark.createDataFrame(links, "key string, made string")
    stale = changed.join(F.broadcast(table), "key").select("media_id", F.col("made").alias("key"))
    gone = stale.unionByName(new.select(place)).distinct()
    return attributes.join(gone, place, "left_anti").select(*place, "value").unionByName(new.select(*place, "value"))
