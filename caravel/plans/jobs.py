"""Jobs over the archive's tables as DataFrame plans, each with a query and its SQL. Imported for its registrations.

A job reads tables and returns the table that it would write. What is pending, skipped, updated or replaced goes
through ``caravel.schemas``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravel import schemas
from caravel.functions import geo, metadata, text, time
from caravel.operators import facets, ordered
from caravel.plans.queries import query
from caravel.plans.views import EAV_SQL, ITEM_SQL, TRACK_SQL, attributes, items, table, track_points


def upserted_texts(existing: DataFrame, sections: DataFrame, mode: str) -> DataFrame:
    """JOB2. Sections (origin_key, body) into the table of texts: by key, those there are skipped or updated."""
    return schemas.apply_mode(existing, sections, lambda rows: rows, ["origin_key"], mode)


def distinct_attachments(files: DataFrame, content: str, key: str) -> DataFrame:
    """JOB4. (hash, first, copies): one row for each different content, combined before the shuffle."""
    return files.groupBy(F.sha2(F.col(content), 256).alias("hash")).agg(F.min(key).alias("first"), F.count("*").alias("copies"))


def transcript_marks(existing: DataFrame, transcripts: DataFrame) -> DataFrame:
    """JOB10. Marks of transcripts (media_id, segments): blank texts are skipped, and only an item's older transcription marks go."""
    rows = transcripts.select("media_id", F.explode("segments").alias("s")).select("media_id", F.col("s.start").alias("offset_s"), F.trim("s.text").alias("value"), F.lit("transcription").alias("source")).where("value <> ''")
    redone = transcripts.select("media_id").distinct().withColumn("source", F.lit("transcription"))
    return existing.join(redone, ["media_id", "source"], "left_anti").select(*rows.columns).unionByName(rows)


def refined_attribute(attribute: DataFrame, synonyms: dict[str, str], stop: Sequence[str] = ()) -> DataFrame:
    """JOB16. Adds ``refined`` and ``changed`` to (media_id, value) rows of keyword lists."""
    refined = F.array_join(text.refined(text.keyword_list("value"), synonyms, tuple(stop)), ", ")
    return attribute.withColumn("refined", refined).withColumn("changed", ~F.col("value").eqNullSafe(F.col("refined")))


def lacking_all(item: DataFrame, eav: DataFrame, keys: Sequence[str], id_col: str = "media_id") -> DataFrame:
    """JOB20. Items that have none of the keys."""
    return item.join(eav.where(F.col("key").isin(*keys)).select(id_col), id_col, "left_anti")


def pending_voice(item: DataFrame, eav: DataFrame) -> DataFrame:
    """JOB9. Sounds and videos without a state mark; an item once found without a voice isn't tried again."""
    return item.where(F.col("kind").isin("audio", "video")).join(eav.where("key = 'voice_state'").select("media_id"), "media_id", "left_anti")


def altitudes(item: DataFrame, points: DataFrame, most_seconds: int) -> DataFrame:
    """JOB3. The own altitude, else that of the nearest track point within ``most_seconds``, of equally near ones the later."""
    near = ordered.asof(item, points, "ts", F.struct("ts", "ele"), ahead=True)
    back, forth, most = F.unix_micros("ts") - F.unix_micros("prev.ts"), F.unix_micros("next.ts") - F.unix_micros("ts"), most_seconds * 1_000_000
    later = forth.isNotNull() & (back.isNull() | (forth <= back))
    found = F.when(later & (forth <= most), F.col("next.ele")).when(~later & (back <= most), F.col("prev.ele"))
    return near.select("media_id", F.coalesce("alt", found).alias("alt"))


def weather_rows(item: DataFrame, hourly: DataFrame, step: int) -> DataFrame:
    """JOB28. (media_id, key, value): the label of the item's cell and day at the nearest hour that is a multiple of ``step``, of equally near ones the earlier."""
    kept = hourly.where(F.col("h") % step == 0)
    near = F.struct(F.abs(F.col("h") - F.hour("ts")).alias("d"), "h")
    best = item.join(kept, ["day", "cy", "cx"]).groupBy("media_id").agg(F.min_by("code", near).alias("code"))
    return best.select("media_id", F.lit("clima").alias("key"), geo.weather_label("code").alias("value"))


def without_parts(rows: DataFrame, predicate: Column, columns: Sequence[str]) -> DataFrame:
    """SNK5. The columns set to null where the predicate holds."""
    return rows.withColumns({c: F.when(~F.coalesce(predicate, F.lit(False)), F.col(c)) for c in columns})


def free_names(df: DataFrame, path: Column, order: Sequence[str]) -> DataFrame:
    """SNK17. Adds ``path``: the first of equal ones stays, the others get ``_1``, ``_2`` … before the extension, leaving out numbers whose name a row bears itself.

    Of the numbers t1 < t2 < … that are taken for a path, t_j has t_j - j free ones before it, so the r-th free number
    is r and as many taken ones as have less than r free ones before them: a running count over both.
    """
    split = r"^(.*?)(\.[^./]*)?$"
    rows = df.withColumn("_path", path)
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_path").orderBy(*order)) - 1)
    numbered = r"^(.*)_([1-9][0-9]{0,17})(\.[^./]*)?$"
    names = rows.select(F.col("_path").alias("p")).distinct()
    part = lambda i: F.regexp_extract("p", numbered, i)
    taken = names.where(F.col("p").rlike(numbered)).select(F.concat(part(1), part(3)).alias("_path"), part(2).cast("long").alias("t"))
    free = F.col("t") - F.row_number().over(Window.partitionBy("_path").orderBy("t"))
    taken = taken.select("_path", (free + 0.5).alias("_at"), F.lit(1).alias("_taken"))
    wanted = rows.where("_r > 0").select("_path", "_r").distinct().select("_path", F.col("_r").cast("double").alias("_at"), F.lit(0).alias("_taken"))
    before = F.sum("_taken").over(Window.partitionBy("_path").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    given = wanted.unionByName(taken).withColumn("_skip", before).where("_taken = 0").select("_path", F.col("_at").cast("int").alias("_r"), "_skip")
    stem, end = F.regexp_extract("_path", split, 1), F.regexp_extract("_path", split, 2)
    n = (F.col("_r") + F.coalesce("_skip", F.lit(0))).cast("string")
    out = rows.join(given, ["_path", "_r"], "left")
    return out.withColumn("path", F.when(F.col("_r") == 0, F.col("_path")).otherwise(F.concat(stem, F.lit("_"), n, end))).select(*[c for c in df.columns if c != "path"], "path")


def blocks(counts: DataFrame, order: Sequence[str]) -> DataFrame:
    """SNK12, STR4. (place, block, n): counts per block in a stable order, with an end that tells their sum."""
    listed = F.array(*[F.lit(x) for x in order])
    rows = counts.where(F.col("block").isin(*order)).select(F.array_position(listed, F.col("block")).cast("int").alias("place"), "block", "n")
    end = counts.where(F.col("block").isin(*order)).agg(F.lit(len(order) + 1).alias("place"), F.lit("end").alias("block"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return rows.unionByName(end)


# --- the same over the test tables ---------------------------------------------------------------


@query("""WITH n AS (SELECT source || '::' || doc_id AS origin_key, length(text) AS chars, doc_id FROM documents) SELECT origin_key, CASE WHEN doc_id % 2 = 0 THEN -1 ELSE chars END::BIGINT AS chars FROM n""")
def job_texts(spark, d):
    """JOB2, SNK1."""
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("::", "source", F.col("doc_id").cast("string")).alias("origin_key"), F.length("text").cast("long").alias("chars"))
    existing = docs.where("doc_id % 2 = 0").select("origin_key", F.lit(-1).cast("long").alias("chars"))
    return upserted_texts(existing, docs.select("origin_key", "chars"), "skip")


@query("SELECT sha256(text) AS hash, min(doc_id) AS first, count(*)::BIGINT AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def job_attachments(spark, d):
    """JOB4, SET5."""
    return distinct_attachments(table(spark, d, "documents").where("text is not null"), "text", "doc_id")


@query("""WITH s AS (SELECT event_id AS media_id, unnest(range(3)) AS i, event_type FROM events WHERE event_id % 2 = 0), n AS (SELECT media_id, i * 2.0::DOUBLE AS offset_s, CASE WHEN i = 1 AND media_id % 3 = 0 THEN '' ELSE event_type || ' ' || i END AS value FROM s)
SELECT media_id, offset_s, value, 'transcription' AS source FROM n WHERE value <> '' UNION ALL SELECT event_id, 9.0::DOUBLE, 'old', CASE WHEN event_id % 5 = 0 THEN 'manual' ELSE 'transcription' END FROM events WHERE event_id % 5 = 0 OR event_id % 2 <> 0""")
def job_transcript_marks(spark, d):
    """JOB10, SNK6."""
    e = table(spark, d, "events").withColumnRenamed("event_id", "media_id")
    existing = e.select("media_id", F.lit(9.0).alias("offset_s"), F.lit("old").alias("value"), F.when(F.col("media_id") % 5 == 0, "manual").otherwise("transcription").alias("source"))
    piece = lambda i: F.struct(F.lit(i * 2.0).alias("start"), F.when((F.lit(i) == 1) & (F.col("media_id") % 3 == 0), "  ").otherwise(F.concat("event_type", F.lit(f" {i} "))).alias("text"))
    return transcript_marks(existing, e.where("media_id % 2 = 0").select("media_id", F.array(*[piece(i) for i in range(3)]).alias("segments")))


@query(f"""WITH {ITEM_SQL}, k AS (SELECT media_id, list_filter([CASE color1 WHEN 'grey' THEN 'gray' ELSE color1 END, CASE color2 WHEN 'grey' THEN 'gray' ELSE color2 END, CASE media_id % 5 WHEN 0 THEN 'sierra' END], lambda w: w IS NOT NULL AND w <> 'red') AS w FROM item)
SELECT media_id, array_to_string(list_filter(w, lambda v, i: list_position(w, v) = i), ', ') AS refined FROM k""")
def job_keywords(spark, d):
    """JOB16, S1, S3, S6: colours, and of four kinds of noise and one word one each."""
    more = F.element_at(F.array(*[F.lit(x) for x in ("sierra", "dsc0123", "una frase de cuatro", "por ejemplo", "ab")]), (F.col("media_id") % 5 + 1).cast("int"))
    rows = items(spark, d).select("media_id", F.concat_ws(", ", F.upper("color1"), "color2", more).alias("value"))
    return refined_attribute(rows, {"grey": "gray"}, ("red",)).select("media_id", "refined")


@query(f"WITH {ITEM_SQL}, {EAV_SQL} SELECT media_id, kind FROM item WHERE media_id NOT IN (SELECT media_id FROM eav WHERE key = 'k' AND value < '5') AND media_id NOT IN (SELECT media_id FROM eav WHERE key = 'event_type' AND value IN ('view', 'click'))")
def job_lacking_all(spark, d):
    """JOB20, JN7, JN8."""
    item = items(spark, d)
    eav = attributes(item).where("key = 'k' and value < '5' or key = 'event_type' and value in ('view', 'click')")
    return lacking_all(item, eav, ["k", "event_type"]).select("media_id", "kind")


@query(f"WITH {ITEM_SQL} SELECT media_id, kind FROM item WHERE kind IN ('audio', 'video') AND NOT (k IS NOT NULL AND k < '6')")
def job_pending_voice(spark, d):
    """JOB9."""
    item = items(spark, d)
    states = attributes(item).where("key = 'k' and value < '6'").select("media_id", F.lit("voice_state").alias("key"), F.lit("sin_voz").alias("value"))
    return pending_voice(item, states).select("media_id", "kind")


@query(f"""WITH {ITEM_SQL}, {TRACK_SQL}, b AS (SELECT media_id, i.alt, i.ts, t.ts AS t0, t.ele AS e0 FROM item i ASOF LEFT JOIN track t ON i.ts >= t.ts), f AS (SELECT media_id, t.ts AS t1, t.ele AS e1 FROM item i ASOF LEFT JOIN track t ON i.ts <= t.ts),
g AS (SELECT media_id, alt, e0, e1, epoch_us(ts) - epoch_us(t0) AS d0, epoch_us(t1) - epoch_us(ts) AS d1 FROM b JOIN f USING (media_id))
SELECT media_id, coalesce(alt, CASE WHEN d1 IS NOT NULL AND (d0 IS NULL OR d1 <= d0) THEN CASE WHEN d1 <= 36000000000 THEN e1 END WHEN d0 <= 36000000000 THEN e0 END) AS alt FROM g""")
def job_altitudes(spark, d):
    """JOB3, JN10."""
    item = items(spark, d)
    return altitudes(item.select("media_id", "ts", "alt"), track_points(item), 36_000)


@query(f"""WITH {ITEM_SQL}, c AS (SELECT media_id, ts, ts::DATE AS day, round(lat, 0) AS cy, round(lon, 0) AS cx FROM item WHERE lat IS NOT NULL), w AS (SELECT day, cy, cx, hour(ts) AS h, min(media_id) % 4 AS code FROM c WHERE hour(ts) % 3 = 0 GROUP BY ALL)
SELECT media_id, 'clima' AS key, (['despejado', 'mayormente despejado', 'parcialmente nublado', 'nublado'])[1 + code] AS value FROM c JOIN w USING (day, cy, cx) QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY abs(h - hour(ts)), h) = 1""")
def job_weather(spark, d):
    """JOB28, JN16, M8."""
    cy, cx = geo.cell("lat", "lon", 0)
    item = items(spark, d).where("lat is not null").select("media_id", "ts", F.to_date("ts").alias("day"), cy.alias("cy"), cx.alias("cx"))
    hourly = item.groupBy("day", "cy", "cx", F.hour("ts").alias("h")).agg((F.min("media_id") % 4).alias("code"))
    return weather_rows(item, hourly, 3)


@query(f"""WITH {ITEM_SQL} SELECT media_id, 'dia_semana' AS key, CASE WHEN media_id % 4 = 0 THEN 'x' ELSE (['lunes', 'martes', 'miércoles', 'jueves', 'viernes', 'sábado', 'domingo'])[isodow(ts - INTERVAL 3 HOUR)] END AS value FROM item""")
def job_weekday(spark, d):
    """JOB29, D6, SNK2."""
    item = items(spark, d)
    existing = item.where("media_id % 4 = 0").select("media_id", F.lit("dia_semana").alias("key"), F.lit("x").alias("value"))
    compute = lambda rows: rows.select("media_id", F.lit("dia_semana").alias("key"), time.weekday("ts").alias("value"))
    return schemas.apply_mode(existing, item, compute, ["media_id"])


@query(f"WITH {ITEM_SQL}, {EAV_SQL} SELECT key, count(*)::BIGINT AS n FROM eav WHERE media_id NOT IN (SELECT media_id FROM item WHERE kind = 'text' AND k = '7') GROUP BY 1")
def job_stickers(spark, d):
    """JOB24, SNK7: doomed items take their attributes with them."""
    item = items(spark, d)
    out = schemas.delete_cascade(item, item.where("kind = 'text' and k = '7'"), "media_id", {"eav": (attributes(item), "media_id", "cascade")})
    return out["eav"].groupBy("key").agg(F.count("*").alias("n"))


@query(f"""WITH {ITEM_SQL}, v AS (SELECT color1 AS en, color2 AS es, count(*) AS votes, min(media_id) AS first FROM item WHERE color1 <> color2 GROUP BY ALL) SELECT en, es, votes::BIGINT AS votes FROM v QUALIFY row_number() OVER (PARTITION BY en ORDER BY votes DESC, first) = 1""")
def job_glossary(spark, d):
    """JOB22, AG17: the most frequent partner of a word."""
    pairs = items(spark, d).where("color1 <> color2").select(F.col("color1").alias("en"), F.col("color2").alias("es"), "media_id")
    return facets.majority(pairs, ["en"], "es", "media_id")


@query(f"""WITH {ITEM_SQL}, s AS (SELECT media_id, kind, 1000 + media_id % 4000 AS w, 500 + media_id % 1500 AS h FROM item WHERE kind IN ('image', 'video')), f AS (SELECT *, least(1, 1600 / greatest(w, h)::DOUBLE) AS k FROM s)
SELECT media_id, (floor(w * k / 2) * 2)::INT AS width, (floor(h * k / 2) * 2)::INT AS height, media_id % 11 = 0 OR (w >= 3840 AND w = 2 * h) AS sphere FROM f""")
def deploy_plan(spark, d):
    """JOB31, JOB32, M16: target sizes, and whether a picture is a sphere by its mark or its shape."""
    w, h = (1000 + F.col("media_id") % 4000), (500 + F.col("media_id") % 1500)
    rows = items(spark, d).where(F.col("kind").isin("image", "video")).select("media_id", w.alias("w"), h.alias("h"))
    tags = F.create_map(F.lit("spherical"), F.when(F.col("media_id") % 11 == 0, "true").otherwise("no"))
    size = metadata.fitted("w", "h", 1600)
    return rows.select("media_id", size.alias("s"), metadata.is_360(tags, "w", "h").alias("sphere")).select("media_id", "s.width", "s.height", "sphere")


@query(f"WITH {ITEM_SQL} SELECT media_id, CASE WHEN NOT coalesce(alt > 800, false) THEN lat END AS lat, CASE WHEN NOT coalesce(alt > 800, false) THEN alt END AS alt FROM item")
def undone_positions(spark, d):
    """SNK5."""
    return without_parts(items(spark, d).select("media_id", "lat", "alt"), F.col("alt") > 800, ["lat", "alt"])


@query("""WITH p AS (SELECT event_id, user_id || '/' || event_type || '.jpg' AS path FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY event_id) - 1 AS n FROM p) SELECT event_id, CASE WHEN n = 0 THEN path ELSE regexp_replace(path, '\\.jpg$', '') || '_' || n || '.jpg' END AS path FROM n""")
def copied_names(spark, d):
    """SNK17."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return free_names(rows, F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type", F.lit(".jpg")), ["event_id"]).select("event_id", "path")


@query(f"""WITH {ITEM_SQL}, c AS (SELECT kind AS block, count(*) AS n FROM item WHERE kind IN ('image', 'video', 'audio', 'text') GROUP BY 1) SELECT CASE block WHEN 'image' THEN 1 WHEN 'video' THEN 2 WHEN 'audio' THEN 3 ELSE 4 END AS place, block, n::BIGINT AS n FROM c
UNION ALL SELECT 5, 'end', coalesce(sum(n), 0)::BIGINT FROM c""")
def message_blocks(spark, d):
    """SNK12, STR4."""
    counts = items(spark, d).groupBy(F.col("kind").alias("block")).agg(F.count("*").alias("n"))
    return blocks(counts, ("image", "video", "audio", "text"))


@query(f"""WITH {ITEM_SQL} SELECT media_id, '{{"id":' || media_id || ',"kind":"' || kind || '"' || CASE WHEN place IS NULL THEN '' ELSE ',"place":"' || place || '"' END || '}}' AS body FROM item""")
def json_rows(spark, d):
    """SNK11: unknown fields are left out."""
    return items(spark, d).select("media_id", F.to_json(F.struct(F.col("media_id").alias("id"), "kind", "place")).alias("body"))
