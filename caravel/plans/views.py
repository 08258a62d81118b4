"""The archive's views over the driver's tables: items, attributes, track points, marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The palette that items take their three colours from, by number.
PALETTE = ("black", "white", "grey", "red", "orange", "yellow", "green", "blue", "violet", "brown", "pink")
KINDS = {"view": "image", "click": "video", "purchase": "audio", "signup": "text"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item; nation and region are tables of fixed size."""
    e = table(spark, sf_dir, "events")
    places = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    places = places.select(F.col("n_nationkey").cast("long").alias("_n"), F.col("n_name").alias("place"), F.col("r_name").alias("province"))
    i = F.col("event_id")
    kind = F.lit("other")
    for k, v in KINDS.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    names = F.array(*[F.lit(c) for c in PALETTE])
    color = lambda k: F.get(names, ((i * k) % len(PALETTE)).cast("int"))
    has_fix = i % 7 != 3
    base = e.select(
        i.alias("media_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("folder"),
        kind.alias("kind"),
        F.when(has_fix, -34.0 + ((i * 7919) % 10000) / 2500.0).alias("lat"),
        F.when(has_fix, -64.0 + ((i * 104729) % 10000) / 2500.0).alias("lon"),
        F.when(i % 10 != 0, ((i * 31) % 2000) / 2.0).alias("alt"),
        F.when(F.col("event_type").isin("click", "purchase"), (i * 13) % 900).otherwise(0).alias("duration_s"),
        color(1).alias("color1"),
        color(3).alias("color2"),
        color(5).alias("color3"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").alias("k"),
        (F.col("user_id") % 25).alias("_n"),
    )
    out = base.join(F.broadcast(places), "_n", "left").drop("_n")
    return out.withColumn("end_ts", F.timestamp_micros(F.unix_micros("ts") + F.col("duration_s") * 1_000_000))


ITEM_SQL = f"""item AS (
  SELECT event_id AS media_id, ts, user_id AS folder,
    CASE event_type WHEN 'view' THEN 'image' WHEN 'click' THEN 'video' WHEN 'purchase' THEN 'audio' WHEN 'signup' THEN 'text' ELSE 'other' END AS kind,
    CASE WHEN event_id % 7 <> 3 THEN -34.0::DOUBLE + ((event_id * 7919) % 10000) / 2500.0::DOUBLE END AS lat,
    CASE WHEN event_id % 7 <> 3 THEN -64.0::DOUBLE + ((event_id * 104729) % 10000) / 2500.0::DOUBLE END AS lon,
    CASE WHEN event_id % 10 <> 0 THEN ((event_id * 31) % 2000) / 2.0::DOUBLE END AS alt,
    CASE WHEN event_type IN ('click', 'purchase') THEN (event_id * 13) % 900 ELSE 0 END AS duration_s,
    ([{", ".join(f"'{c}'" for c in PALETTE)}])[1 + event_id % 11] AS color1,
    ([{", ".join(f"'{c}'" for c in PALETTE)}])[1 + (event_id * 3) % 11] AS color2,
    ([{", ".join(f"'{c}'" for c in PALETTE)}])[1 + (event_id * 5) % 11] AS color3,
    event_type, value, props ->> '$.k' AS k, n_name AS place, r_name AS province,
    ts + to_seconds(CASE WHEN event_type IN ('click', 'purchase') THEN (event_id * 13) % 900 ELSE 0 END) AS end_ts
  FROM events LEFT JOIN nation ON n_nationkey = user_id % 25 LEFT JOIN region ON r_regionkey = n_regionkey)"""


def attributes(item: DataFrame) -> DataFrame:
    """(media_id, key, value) of the items' dynamic attributes."""
    from caravel.operators.facets import unpivoted

    return unpivoted(item.select("media_id", "event_type", F.round("value", 4).alias("value"), "k").withColumnRenamed("value", "amount"), ["media_id"], ["event_type", "k"])


EAV_SQL = """eav AS (
  SELECT media_id, 'event_type' AS key, event_type AS value FROM item WHERE event_type IS NOT NULL
  UNION ALL SELECT media_id, 'k', k FROM item WHERE k IS NOT NULL)"""


def track_points(item: DataFrame) -> DataFrame:
    return item.where("media_id % 20 = 0 and lat is not null").select(F.col("media_id").alias("point_id"), "ts", F.col("lat").alias("plat"), F.col("lon").alias("plon"), F.col("alt").alias("ele"))


TRACK_SQL = """track AS (
  SELECT media_id AS point_id, ts, lat AS plat, lon AS plon, alt AS ele FROM item WHERE media_id % 20 = 0 AND lat IS NOT NULL)"""


def marks(item: DataFrame) -> DataFrame:
    """Every seventh item of the archive is a mark of its folder."""
    return item.where("media_id % 7 = 0").select(F.col("folder"), F.col("ts"), F.concat(F.col("kind"), F.lit(":"), F.col("media_id").cast("string")).alias("mark"))
