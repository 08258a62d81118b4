"""Sinks: CSV export, snapshot, loop document, GeoJSON, versioned backups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export_csv(df: DataFrame, path: str, vector: str = "embedding", hidden_keys: tuple[str, ...] = ("transcript", "transcript_segments")) -> None:
    """SNK8. A table as CSV with header, without its vector column and without the long transcript attributes. Each file begins with a byte order mark, which spreadsheets look for."""
    rows = df.drop(vector)
    if {"key", "value"} <= set(rows.columns):
        rows = rows.where(~F.col("key").isin(*hidden_keys))
    rows = rows.toDF("\ufeff" + rows.columns[0], *rows.columns[1:])
    rows.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def loop_document(looped: DataFrame, segments: DataFrame) -> DataFrame:
    """SNK10. One row, one JSON text: segments, placed items in order and counts per kind. For a loop's worth of items."""
    order = F.array_sort(F.collect_list(F.struct("t_loop", "media_id", "kind", "score")))
    placed = looped.agg(order.alias("items"), F.count("*").alias("n"))
    kinds = looped.groupBy("kind").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("by_kind"))
    segs = segments.agg(F.array_sort(F.collect_list(F.struct(*segments.columns))).alias("segments"))
    return segs.join(placed).join(kinds).select(F.to_json(F.struct("segments", "items", "by_kind", "n")).alias("document"))


def geojson_lines(segments: DataFrame) -> DataFrame:
    """SNK13. One GeoJSON feature text per route segment (lat0, lon0, lat1, lon1, band)."""
    line = F.struct(F.lit("LineString").alias("type"), F.array(F.array("lon0", "lat0"), F.array("lon1", "lat1")).alias("coordinates"))
    return segments.select(F.to_json(F.struct(F.lit("Feature").alias("type"), line.alias("geometry"), F.struct("band").alias("properties"))).alias("feature"))


def snapshot_tables(tables: dict[str, DataFrame], folder: str, version: str) -> None:
    """SNK15. A backup: every table under ``folder/version``; an earlier one of that name is replaced."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{version}/{name}")


def _entries(spark: SparkSession, folder: str) -> list:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x for x in files.listStatus(place) if x.isDirectory()] if files.exists(place) else []


def snapshots(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """SNK15. (version, milliseconds of its last change), newest first."""
    found = [(x.getPath().getName(), x.getModificationTime()) for x in _entries(spark, folder)]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def restored(spark: SparkSession, folder: str, version: str) -> dict[str, DataFrame]:
    """SNK15. The tables of a backup, by name; an unknown version is an error."""
    found = _entries(spark, f"{folder}/{version}")
    if not found:
        raise ValueError(f"no backup {version!r}")
    return {x.getPath().getName(): spark.read.parquet(x.getPath().toString()) for x in found}
