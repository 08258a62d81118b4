"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caravel.session import shared_folder


def unused(name: str, df: DataFrame) -> str:
    """A column name that ``df`` doesn't have in any case: ``name`` with underscores in front."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    It cuts the lineage: a lost executor costs a read of the table and not the
    work before it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):
    _trim = None


def give_back() -> None:
    """Hands freed memory back to the system. Workers stay in their executor between tasks, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(work: Callable) -> Callable:
    """``work``, a generator over a task's batches, that gives its memory back at the end."""

    @wraps(work)
    def run(*args):
        yield from work(*args)
        give_back()

    return run


def delete_table(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def without(df: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without the columns that an operator is about to add (any case)."""
    held = {x.lower() for x in keep}
    taken = {x.lower() for x in names} - held
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fold_of(doc_id: str | Column = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(folds)


def read_bytes(path: str) -> bytes:
    """A driver-side file such as a vocabulary."""
    with open(path, "rb") as f:
        return f.read()


def tokenizer_path(name: str) -> str:
    """Place of an installed public vocabulary file; ``TOKENIZER_DIR`` overrides it."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
