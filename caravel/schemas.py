"""Table schemas and the incremental model: ensure columns, skip / update / replace, upserts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StringType, StructField, StructType, TimestampType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


_L, _S, _D, _T = LongType(), StringType(), DoubleType(), TimestampType()
ITEM = _struct(id=_L, filename_original=_S, filepath_absoluto=_S, filepath_relativo=_S, carpeta=_S, type=_S, subtype=_S, file_hash=_S, content_hash=_S, timestamp_utc=_S, duration_secs=_D, end_time=_S, latitude=_D, longitude=_D, altitude=_D, provincia=_S, municipio=_S, author=_S, ingest_batch_id=_L)
ATTRIBUTE = _struct(media_id=_L, key=_S, value=_S)
MARK = _struct(media_id=_L, timestamp_offset_secs=_D, timestamp_absolute=_S, key=_S, value=_S, source=_S)
EMBEDDING = _struct(media_id=_L, embedding=ArrayType(FloatType()), modelo=_S)
TRACK = _struct(id=_L, name=_S, source_url=_S, start_time=_S, end_time=_S, total_points=_L)
WAYPOINT = _struct(track_id=_L, name=_S, description=_S, category=_S, type=_S, latitude=_D, longitude=_D, timestamp=_S)
TRACK_POINT = _struct(latitude=_D, longitude=_D, elevation=_D, time=_S)
CONFIG = _struct(key=_S, value=_S)


def ensure_columns(df: DataFrame, schema: StructType) -> DataFrame:
    """DDL3. Adds the columns of ``schema`` that are missing, as typed nulls, and leaves the others."""
    held = {c.lower() for c in df.columns}
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name.lower() not in held})


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SNK2. Rows of ``new`` take the place of those with the same keys."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True).select(*existing.columns)


def insert_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """SNK3. Adds rows whose keys are new; null values are left out and of equal keys the least value goes in."""
    fresh = new.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(F.col(value).cast("string")).alias(value))
    return existing.unionByName(fresh.join(existing, list(keys), "left_anti"), allowMissingColumns=True)


def apply_mode(existing: DataFrame, source: DataFrame, compute: Callable[[DataFrame], DataFrame], keys: Sequence[str], mode: str = "skip") -> DataFrame:
    """STR3. One enrichment step. skip: only source rows without a result; update: all, over the old ones;
    replace: old results go first. ``compute`` maps source rows to result rows."""
    if mode == "skip":
        return existing.unionByName(compute(source.join(existing, list(keys), "left_anti")), allowMissingColumns=True)
    if mode == "update":
        return upsert(existing, compute(source), keys)
    if mode == "replace":
        return compute(source)
    raise ValueError(f"unknown mode {mode!r}")


def update_columns(df: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """SNK4. Columns of ``computed`` written back by key; a null result keeps the old value."""
    names = [c for c in computed.columns if c != key]
    both = df.alias("o").join(computed.alias("n"), key, "left")
    return both.select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in names else (F.col(key) if c == key else F.col(f"o.{c}")) for c in df.columns])


def delete_cascade(parent: DataFrame, doomed: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, str]]) -> dict[str, DataFrame]:
    """SNK6, SNK7. Parent without the doomed keys; children by name as (table, foreign key, "cascade" or "null")."""
    gone = doomed.select(key).distinct()
    out = {"": parent.join(gone, key, "left_anti")}
    for name, (table, fk, rule) in children.items():
        named = gone.withColumnRenamed(key, fk)
        if rule == "cascade":
            out[name] = table.join(named, fk, "left_anti")
        else:
            hit = table.join(named.withColumn("_gone", F.lit(True)), fk, "left")
            out[name] = hit.withColumn(fk, F.when(F.col("_gone").isNull(), F.col(fk))).select(*table.columns)
    return out


MESSAGE = _struct(id=_L, chat_id=_L, message_id=_L, text=_S, date_utc=_S)


def _with_config(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Version 2: a table of settings."""
    return _with_empty(tables, "config", CONFIG)


def _with_embeddings(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """DDL2. Version 3: one embedding for each item and model. An older table is rebuilt: a missing model is the first one that was
    used, columns that are no longer known go, rows without an item or vector go, and of several the latest stays."""
    if "media_embeddings" not in tables:
        return _with_empty(tables, "media_embeddings", EMBEDDING)
    old = ensure_columns(tables["media_embeddings"], _struct(modelo=_S, fecha=_S)).where("media_id is not null and embedding is not null")
    rows = old.withColumn("modelo", F.coalesce("modelo", F.lit("nomic-embed-text"))).withColumn("fecha", F.coalesce("fecha", F.lit("")))
    best = rows.groupBy("media_id", "modelo").agg(F.max(F.struct("fecha", "embedding")).alias("b"))
    return tables | {"media_embeddings": best.select("media_id", "b.embedding", "modelo", "b.fecha")}


def _with_messages(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Version 4: messages, and each item's message."""
    tables = _with_empty(tables, "telegram_messages", MESSAGE)
    if "media" in tables:
        tables = tables | {"media": ensure_columns(tables["media"], _struct(telegram_message_id=_L))}
    return tables


def _with_empty(tables: dict[str, DataFrame], name: str, schema: StructType) -> dict[str, DataFrame]:
    if name in tables or not tables:
        return tables
    return tables | {name: next(iter(tables.values())).sparkSession.createDataFrame([], schema)}


#: Table versions: each entry takes the tables of the version before it to its own.
MIGRATIONS: dict[int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]] = {2: _with_config, 3: _with_embeddings, 4: _with_messages}


def migrate(tables: dict[str, DataFrame], version: int, migrations: dict[int, Callable] | None = None) -> tuple[dict[str, DataFrame], int]:
    """DDL1. Applies the migrations above ``version`` in order; version 0 counts as 1. Running it twice changes nothing."""
    steps = MIGRATIONS if migrations is None else migrations
    at = max(version, 1)
    for target in sorted(steps):
        if target > at:
            tables = steps[target](tables)
            at = target
    return tables, at
