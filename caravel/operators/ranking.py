"""Predicates of users, pages, orders and samples."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that a predicate must not hold.
BARRED = ("DROP", "ALTER", "DELETE", "INSERT", "UPDATE", "CREATE", "ATTACH", "DETACH", "REINDEX", "VACUUM")


def where_text(df: DataFrame, predicate: str) -> DataFrame:
    """FLT10. Rows that a user's SQL predicate holds for; a barred word, an unknown column or a subquery is an error."""
    if re.search(rf"\b({'|'.join((*BARRED, 'SELECT'))})\b", predicate, re.IGNORECASE):
        raise ValueError("the predicate holds a barred word")
    return df.where(F.expr(predicate))


def checked_column(df: DataFrame, name: str) -> str:
    """FLT10. The name, if the table has such a column."""
    if name not in df.columns:
        raise ValueError(f"no column {name!r}")
    return name


def word_count(text: str | Column) -> Column:
    """FLT13. Words between runs of white space; 0 for null and blank."""
    t = F.col(text) if isinstance(text, str) else text
    plain = F.regexp_replace(t, r"^\s+|\s+$", "")
    return F.when(F.coalesce(plain, F.lit("")) == "", 0).otherwise(F.size(F.split(plain, r"\s+")))


def page(df: DataFrame, order: Sequence[str | Column], number: int, size: int = 500) -> DataFrame:
    """SRT10. Page ``number`` from 0 on of the rows in ``order``."""
    return df.orderBy(*order).offset(number * size).limit(size)


def preferred_first(df: DataFrame, preferred: Column, order: Sequence[str | Column]) -> DataFrame:
    """SRT4, SRT11. Rows that are preferred before the others; within both by ``order``."""
    return df.orderBy(F.coalesce(preferred, F.lit(False)).desc(), *order)


def similar_top(df: DataFrame, similarity: str, length: str, least: float, shortest: float, k: int, tie: str) -> DataFrame:
    """SRT9. The ``k`` most similar rows of at least that similarity and length; ties by ``tie``."""
    return df.where((F.col(similarity) >= least) & (F.col(length) >= shortest)).orderBy(F.desc(similarity), tie).limit(k)


def once(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """SRT13. The first row of each key by ``order``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
