"""Queries over the reference's operators, each with the SQL that says the same.

``QUERIES[name](spark, sf_dir)`` runs over whole tables. ``ORACLE_SQL[name]`` is the same
result in SQL; it is missing where the operator is a stateful fold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caravel.functions import color, geo, image, sun, text
from caravel.operators import dedup, facets, intervals, loop, ordered
from caravel.operators import marks as marks_
from caravel.plans.views import EAV_SQL, ITEM_SQL, TRACK_SQL, attributes, items, table, track_points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL for the same result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _stamp(c: str | Column) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss")


def _seconds(c: str) -> Column:
    return F.unix_micros(F.col(c)) / 1e6


# --- facets and exploration ------------------------------------------------------------------


@query("""SELECT h::INT AS hour, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / greatest(max(coalesce(n, 0)) OVER (), 1)::DOUBLE, 3) AS weight
FROM range(24) t(h) LEFT JOIN (SELECT hour(ts) AS x, count(*) AS n FROM events GROUP BY 1) ON x = h""")
def facet_hours_dense(spark, d):
    """AG8, AG12, D7, QRY5."""
    return facets.dense_hours(table(spark, d, "events"), F.hour("ts"))


@query("""SELECT n_name AS value, count(*)::BIGINT AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS pct
FROM events LEFT JOIN nation ON n_nationkey = user_id % 25 GROUP BY 1""")
def facet_values_share(spark, d):
    """AG2, AG3, QRY2."""
    return facets.values_share(items(spark, d), "place")


@query("""SELECT isodow(ts - INTERVAL 3 HOUR)::INT AS day, count(*)::BIGINT AS n FROM events GROUP BY 1""")
def facet_weekday(spark, d):
    """AG10, AG24."""
    local = F.col("ts").cast("timestamp") - F.expr("INTERVAL 3 HOURS")
    return table(spark, d, "events").groupBy((F.weekday(local) + 1).cast("int").alias("day")).agg(F.count("*").alias("n"))


@query("""SELECT folded, count(*)::BIGINT AS n, min(w) AS example FROM (
  SELECT lower(w) AS lw, strip_accents(lower(w)) AS folded, w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-záéíóúñüößäàâçèêëîïôûùÁÉÍÓÚÑ]+')) AS w FROM documents))
WHERE regexp_full_match(lw, '[a-záéíóúñüöäàâçèêëîïôûù]+') GROUP BY 1""")
def facet_fold_order(spark, d):
    """AG9, S15."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-záéíóúñüößäàâçèêëîïôûùÁÉÍÓÚÑ]+"), F.lit(0))).alias("w"))
    # each different word is looked at and folded once
    counts = words.groupBy("w").agg(F.count("*").alias("n"))
    plain = counts.where(F.lower("w").rlike("^[a-záéíóúñüöäàâçèêëîïôûù]+$"))
    return plain.groupBy(text.folded("w").alias("folded")).agg(F.sum("n").alias("n"), F.min("w").alias("example"))


@query(f"""WITH {ITEM_SQL}, {EAV_SQL} SELECT key, count(*)::BIGINT AS n FROM eav GROUP BY 1 ORDER BY n DESC, key LIMIT 50""")
def metadata_top_keys(spark, d):
    """AG5, SRT1, QRY1."""
    return attributes(items(spark, d)).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(50)


@query(f"""WITH {ITEM_SQL}, {EAV_SQL} SELECT kind, eav.value AS value, count(*)::BIGINT AS n FROM eav JOIN item USING (media_id) WHERE key = 'k' GROUP BY 1, 2""")
def metadata_key_values(spark, d):
    """JN1, JN2, AG4, QRY3."""
    item = items(spark, d)
    return attributes(item).where("key = 'k'").join(item.select("media_id", "kind"), "media_id").groupBy("kind", "value").agg(F.count("*").alias("n"))


@query(f"""WITH {ITEM_SQL}, {EAV_SQL} SELECT media_id, max(value) FILTER (key = 'event_type') AS event_type, max(value) FILTER (key = 'k') AS k FROM eav GROUP BY 1""")
def eav_pivot(spark, d):
    """PRJ3, PRJ4."""
    return facets.pivoted(attributes(items(spark, d)), ["event_type", "k"])


@query("""SELECT 'part' AS source, p_partkey AS id, 'p_name' AS "column", p_name AS value FROM part WHERE p_name ILIKE '%an%'
UNION ALL SELECT 'part', p_partkey, 'p_type', p_type FROM part WHERE p_type ILIKE '%an%'
UNION ALL SELECT 'supplier', s_suppkey, 's_name', s_name FROM supplier WHERE s_name ILIKE '%an%'
UNION ALL SELECT 'customer', c_custkey, 'c_name', c_name FROM customer WHERE c_name ILIKE '%an%'
UNION ALL SELECT 'customer', c_custkey, 'c_mktsegment', c_mktsegment FROM customer WHERE c_mktsegment ILIKE '%an%'""")
def text_search(spark, d):
    """FLT6, PRJ2, SET2, QRY4."""
    t = lambda n: table(spark, d, n)
    return facets.text_search({"part": (t("part"), "p_partkey", ["p_name", "p_type"]), "supplier": (t("supplier"), "s_suppkey", ["s_name"]), "customer": (t("customer"), "c_custkey", ["c_name", "c_mktsegment"])}, "%an%")


@query(f"""WITH {ITEM_SQL}, {EAV_SQL} SELECT kind, count(*)::BIGINT AS total, count(lat)::BIGINT AS done, count(*) FILTER (lat IS NULL)::BIGINT AS pending,
  count(*) FILTER (NOT EXISTS (SELECT 1 FROM eav e WHERE e.media_id = i.media_id AND e.key = 'k' AND e.value > '5'))::BIGINT AS without_k FROM item i GROUP BY 1""")
def pending_status(spark, d):
    """FLT5, JN7, AG1, AG16, QRY14."""
    item = items(spark, d)
    has = attributes(item).where("key = 'k' and value > '5'").select("media_id").distinct().withColumn("_has", F.lit(True))
    return item.join(has, "media_id", "left").groupBy("kind").agg(F.count("*").alias("total"), F.count("lat").alias("done"), F.count_if(F.col("lat").isNull()).alias("pending"), F.count_if(F.col("_has").isNull()).alias("without_k"))


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def anti_chained(spark, d):
    """JN8, SET4."""
    line = table(spark, d, "lineitem")
    key = lambda c: line.where(c).select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(key("l_returnflag = 'R'"), "o_orderkey", "left_anti").join(key("l_quantity > 45"), "o_orderkey", "left_anti")


@query("""SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30) GROUP BY 1""")
def semi_facet(spark, d):
    """JN5, JN6."""
    big = table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(big, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(f"""WITH {ITEM_SQL}, {EAV_SQL} SELECT a.value AS event_type, b.value AS k, count(*)::BIGINT AS n FROM eav a JOIN eav b USING (media_id) WHERE a.key = 'event_type' AND b.key = 'k' GROUP BY ALL""")
def self_join_keys(spark, d):
    """JN3."""
    eav = attributes(items(spark, d))
    a = eav.where("key = 'event_type'").select("media_id", F.col("value").alias("event_type"))
    b = eav.where("key = 'k'").select("media_id", F.col("value").alias("k"))
    return a.join(b, "media_id").groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag, count(DISTINCT l_partkey)::BIGINT AS parts, count(DISTINCT l_suppkey)::BIGINT AS suppliers, count(l_tax)::BIGINT AS taxed, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1""")
def distinct_counts(spark, d):
    """AG6, AG7."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.count("l_tax").alias("taxed"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


@query(f"""WITH {ITEM_SQL}, u AS (SELECT color1 AS name, kind AS hex FROM item UNION SELECT color2, kind FROM item UNION SELECT color3, kind FROM item)
SELECT name, min(hex) AS hex, count(*)::BIGINT AS n FROM u GROUP BY 1""")
def palette_union(spark, d):
    """AG14, SET1, SET3, QRY10."""
    return facets.palette(items(spark, d), [(c, "kind") for c in ("color1", "color2", "color3")])


@query(f"""WITH {ITEM_SQL} SELECT media_id, color1, color2, color3 FROM item WHERE (color1 IN ('red', 'blue') OR color2 IN ('red', 'blue') OR color3 IN ('red', 'blue')) AND kind = 'image' AND province IS NOT NULL""")
def any_slot_match(spark, d):
    """FLT2, FLT4."""
    wanted = F.arrays_overlap(F.array("color1", "color2", "color3"), F.array(F.lit("red"), F.lit("blue")))
    return items(spark, d).where(wanted & (F.col("kind") == "image") & F.col("province").isNotNull()).select("media_id", "color1", "color2", "color3")


@query("""SELECT doc_id FROM documents WHERE list_contains(list_transform(string_split(text, ','), lambda x: lower(trim(x, ' '))), 'the') OR list_contains(list_transform(string_split(text, ' '), lambda x: lower(x)), 'nicht')""")
def list_membership(spark, d):
    """FLT3."""
    parts = lambda sep: F.transform(F.split("text", sep), lambda x: F.lower(F.trim(x)))
    return table(spark, d, "documents").where(F.array_contains(parts(","), "the") | F.array_contains(F.transform(F.split("text", " "), F.lower), "nicht")).select("doc_id")


@query("""SELECT CAST(props ->> '$.k' AS BIGINT) % 10 AS bucket, count(*)::BIGINT AS n, sum(TRY_CAST(props ->> '$.k' AS BIGINT))::BIGINT AS total FROM events GROUP BY 1""")
def json_attributes(spark, d):
    """S26."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").groupBy((k % 10).alias("bucket")).agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query("""SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE regexp_full_match(word, '[a-z]{5,}')
GROUP BY 1 QUALIFY row_number() OVER (ORDER BY n DESC, word) <= greatest(1, least(200, ceil(count(*) OVER () / 4)))""")
def keyword_quartile(spark, d):
    """AG11."""
    words = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("w"))
    return facets.top_quartile(words, F.col("w"), lambda w: w.rlike("^[a-z]{5,}$"))


@query("""WITH t AS (SELECT unnest(string_split(text, ' ')) AS w FROM documents), n AS (SELECT trim(regexp_replace(lower(w), '[^\\p{L} ]', '', 'g')) AS tag FROM t),
c AS (SELECT tag, count(*)::BIGINT AS n FROM n WHERE length(tag) >= 3 AND tag NOT IN ('the', 'and') GROUP BY 1 HAVING count(*) > 1 OR NOT contains(tag, ' ') ORDER BY n DESC, tag LIMIT 50)
SELECT tag, n, round(n / max(n) OVER ()::DOUBLE, 2) AS weight FROM c""")
def tag_cloud(spark, d):
    """AG13, QRY11."""
    words = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("w"))
    return facets.tag_cloud(words, F.col("w"), stop=("the", "and"))


@query("""SELECT l_suppkey, l_returnflag, votes FROM (SELECT l_suppkey, l_returnflag, count(*)::BIGINT AS votes, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, first) = 1""")
def majority_vote(spark, d):
    """AG17."""
    line = table(spark, d, "lineitem").withColumn("_o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return facets.majority(line, ["l_suppkey"], "l_returnflag", "_o")


@query(f"""WITH {ITEM_SQL}, m(color, meaning) AS (VALUES ('red', 'fire'), ('red', 'love'), ('blue', 'water'), ('green', 'field'), ('yellow', 'fire')),
s AS (SELECT media_id, color1 AS color, 1 AS slot FROM item UNION ALL SELECT media_id, color2, 2 FROM item UNION ALL SELECT media_id, color3, 3 FROM item)
SELECT media_id, meaning, min(slot)::INT AS slot FROM s JOIN m USING (color) GROUP BY ALL""")
def color_meaning(spark, d):
    """DOC10."""
    rows = [("red", "fire"), ("red", "love"), ("blue", "water"), ("green", "field"), ("yellow", "fire")]
    return facets.color_meanings(items(spark, d), "media_id", ["color1", "color2", "color3"], spark.createDataFrame(rows, "color string, meaning string"))


@query(f"""WITH {ITEM_SQL}, {EAV_SQL} SELECT media_id FROM item i WHERE color1 IN ('red', 'orange') OR place ILIKE '%an%' OR EXISTS (SELECT 1 FROM eav e WHERE e.media_id = i.media_id AND key = 'k' AND value = '7')""")
def cross_modal_any(spark, d):
    """DOC12."""
    item = items(spark, d)
    by_key = attributes(item).where("key = 'k' and value = '7'").select("media_id")
    return item.where(F.col("color1").isin("red", "orange") | F.col("place").ilike("%an%")).select("media_id").union(by_key).distinct()


@query(f"""WITH {ITEM_SQL} SELECT media_id, kind FROM item QUALIFY row_number() OVER (PARTITION BY kind ORDER BY ((media_id + 1) * 1103515245 + 12345) % 2147483648, media_id) <= 20""")
def sample_per_type(spark, d):
    """SRT5."""
    return facets.sample_per_group(items(spark, d).select("media_id", "kind"), "kind", "media_id", 20, facets.portable_hash("media_id"))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1""")
def best_of_group(spark, d):
    """SRT8."""
    line = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return dedup.best_of_group(line, ["l_suppkey"], "l_extendedprice", ["l_orderkey", "l_linenumber"]).drop("rank")


@query("""SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first, count(*) OVER (PARTITION BY sha256(text))::BIGINT AS copies FROM documents""")
def dedup_first(spark, d):
    """SET5, SET6, S28."""
    return dedup.first_of(table(spark, d, "documents").select("doc_id", "text"), F.sha2("text", 256), "doc_id").select("doc_id", "first", "copies")


@query("""SELECT doc_id, length(text) AS chars, round(len(list_intersect(list_distinct(regexp_extract_all(text, '[A-Za-z]+')), ['the', 'of', 'and', 'der', 'die'])) / 5.0::DOUBLE, 4) AS coverage FROM documents""")
def coverage(spark, d):
    """AG22."""
    wanted = F.array(*[F.lit(w) for w in ("the", "of", "and", "der", "die")])
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), F.round(F.size(F.array_intersect(words, wanted)) / 5.0, 4).alias("coverage"))


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS words FROM documents), u AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS p FROM w),
f AS (SELECT doc_id, w, p, row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY p) AS r FROM u)
SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS merged FROM f WHERE r = 1 GROUP BY 1""")
def merge_keywords_ci(spark, d):
    """SET7."""
    return table(spark, d, "documents").select("doc_id", text.merged_words("text").alias("merged"))


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS a, string_split(upper(text), ' ') AS b FROM documents)
SELECT lower(x) AS word, count(*)::BIGINT AS n FROM (SELECT unnest(a) AS x, unnest(b) AS y FROM w WHERE len(a) = len(b)) WHERE x = y AND regexp_full_match(x, '[A-Z]+') GROUP BY 1""")
def zip_positions(spark, d):
    """JN19."""
    a, b = F.split("text", " "), F.split(F.upper("text"), " ")
    rows = table(spark, d, "documents").select(a.alias("a"), b.alias("b")).where(F.size("a") == F.size("b")).select(F.explode(F.arrays_zip("a", "b")).alias("z"))
    return rows.where((F.col("z.a") == F.col("z.b")) & F.col("z.a").rlike("^[A-Z]+$")).groupBy(F.lower("z.a").alias("word")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'service' WHEN length(text) > 400 THEN 'long' WHEN contains(text, '?') THEN 'question' ELSE 'text' END AS type,
  length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS chars FROM conversations""")
def chat_attachments(spark, d):
    """S23, S25."""
    kind = F.when(F.col("role") == "system", "service").when(F.length("text") > 400, "long").when(F.contains("text", F.lit("?")), "question").otherwise("text")
    return table(spark, d, "conversations").select("conv_id", "turn", kind.alias("type"), F.length(text.compact("text")).cast("long").alias("chars"))


@query(f"""WITH {ITEM_SQL}, {EAV_SQL} SELECT media_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M') AS time, kind, place, province, coalesce(lat IS NOT NULL, false) AS placed, list_distinct([color1, color2, color3]).list_sort().array_to_string(',') AS colors, e.k AS k
FROM item LEFT JOIN (SELECT media_id, max(value) AS k FROM eav WHERE key = 'k' GROUP BY 1) e USING (media_id)""")
def snapshot(spark, d):
    """SNK9, PRJ1, JN9, SET8, D8, QRY9."""
    item = items(spark, d)
    wide = facets.pivoted(attributes(item), ["k"])
    colors = F.array_join(F.array_sort(F.array_distinct(F.array("color1", "color2", "color3"))), ",")
    return item.drop("k").join(wide, "media_id", "left").select("media_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "HH:mm").alias("time"), "kind", "place", "province", F.col("lat").isNotNull().alias("placed"), colors.alias("colors"), "k")


# --- the loop --------------------------------------------------------------------------------

HOURS, LOOP_SECONDS = (7, 16, 13, 18), 300.0
# by hand: three arcs of 100 seconds; 16 to 13 doesn't rise, so it goes round midnight
_SEGMENTS_SQL = "(0, 7, 9, 0::DOUBLE, 100::DOUBLE), (1, 16, 21, 100::DOUBLE, 200::DOUBLE), (2, 13, 5, 200::DOUBLE, 300::DOUBLE)"
_LOOP_SQL = f"""{ITEM_SQL}, seg(seg, h_from, arc, t_from, t_to) AS (VALUES {_SEGMENTS_SQL}),
h AS (SELECT *, (epoch(ts - INTERVAL 3 HOUR)::DOUBLE - 86400.0 * floor(epoch(ts - INTERVAL 3 HOUR) / 86400.0)) / 3600 AS hour,
  (CASE WHEN kind = 'image' THEN (color1 IN ('red', 'blue'))::INT + (color2 IN ('red', 'blue'))::INT + (color3 IN ('red', 'blue'))::INT ELSE 0 END + contains(lower(coalesce(place, '')), 'an')::INT) AS score FROM item),
p AS (SELECT h.*, seg.*, CASE WHEN h_from + arc > 24 AND hour < h_from - 1e-6 THEN hour + 24 ELSE hour END AS hh FROM h, seg),
q AS (SELECT * FROM p WHERE hour BETWEEN 7 AND 18 AND hh >= h_from - 1e-6 AND hh <= h_from + arc + 1e-6 QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY seg) = 1),
looped AS (SELECT *, greatest(0, least(1, (hh - h_from) / arc)) AS fraction, t_from + greatest(0, least(1, (hh - h_from) / arc)) * (t_to - t_from) AS t_loop FROM q)"""


def _looped(spark, d) -> DataFrame:
    item = items(spark, d).withColumn("hour", loop.local_hour(F.col("ts")))
    low, high = loop.hour_range(HOURS)
    kept = item.where(F.col("hour").between(low, high))
    colors = [F.col(c) for c in ("color1", "color2", "color3")]
    scored = kept.withColumn("score", loop.priority(F.col("kind"), colors, ("red", "blue"), F.col("place"), ("an",)))
    return loop.placed(scored, F.col("hour"), HOURS, LOOP_SECONDS)


@query(f"""WITH {_LOOP_SQL} SELECT media_id, kind, score::INT AS score, seg::INT AS seg, round(fraction, 6) AS fraction, round(t_loop, 4) AS t_loop FROM looped""")
def loop_items(spark, d):
    """FLT8, D5, M13, M14, QRY6."""
    return _looped(spark, d).select("media_id", "kind", F.col("score").cast("int").alias("score"), "seg", F.round("fraction", 6).alias("fraction"), F.round("t_loop", 4).alias("t_loop"))


@query(f"""WITH {_LOOP_SQL} SELECT kind, seg::INT AS seg, count(*)::BIGINT AS n, round(avg(score), 6) AS mean_score, count(*) FILTER (score = 0)::BIGINT AS zero FROM looped GROUP BY ALL""")
def loop_summary(spark, d):
    """AG18, AG23."""
    return _looped(spark, d).groupBy("kind", "seg").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.count_if(F.col("score") == 0).alias("zero"))


@query(f"""WITH {_LOOP_SQL}, e AS (SELECT media_id, hour, score, unnest(['sun at the horizon', 'sun overhead', 'heat', 'cold', 'wind', 'rain', 'night']) AS text, unnest([alt / 20 BETWEEN 0 AND 3, alt / 20 >= 60, value * 2 >= 30, value * 2 <= 5, alt / 25 >= 30, CASE WHEN media_id % 11 = 0 THEN 1 ELSE 0 END > 0, alt / 20 < -6]) AS holds FROM looped)
SELECT text, floor(hour)::INT AS h, round(hour, 6) AS hour, media_id AS key FROM e WHERE holds QUALIFY row_number() OVER (PARTITION BY text, floor(hour) ORDER BY e.hour, score DESC, media_id) = 1""")
def loop_events(spark, d):
    """SRT7, SET9, M15. Measures are stand-ins; altitude in steps of 20 m is the sun's elevation."""
    texts = loop.ambient_events(F.col("alt") / 20, F.col("value") * 2, F.col("alt") / 25, F.when(F.col("media_id") % 11 == 0, 1).otherwise(0))
    rows = _looped(spark, d).withColumn("text", F.explode(texts))
    return loop.first_events(rows, "text", "hour", "score", "media_id").withColumn("hour", F.round("hour", 6))


@query(f"""WITH {_LOOP_SQL} SELECT g.seg::INT AS seg, g.h_from::INT AS h_from, g.arc::INT AS arc, g.t_from, g.t_to, coalesce(n, 0)::BIGINT AS n FROM seg g LEFT JOIN (SELECT seg, count(*) AS n FROM looped GROUP BY 1) USING (seg)""")
def loop_segments(spark, d):
    """M12: the loop's segments, with the items that fall in each."""
    known = spark.createDataFrame([(s["seg"], s["h_from"], s["arc"], s["t_from"], s["t_to"]) for s in loop.loop_segments(HOURS, LOOP_SECONDS)], "seg int, h_from int, arc int, t_from double, t_to double")
    return known.join(_looped(spark, d).groupBy("seg").agg(F.count("*").alias("n")), "seg", "left").withColumn("n", F.coalesce("n", F.lit(0)))


# --- routes ----------------------------------------------------------------------------------

_HAV = "2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)))"
_ROUTE_SQL = f"""{ITEM_SQL}, fix AS (SELECT media_id, ts, lat, lon, alt FROM item WHERE lat IS NOT NULL),
lagged AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(alt) OVER w AS palt FROM fix WINDOW w AS (ORDER BY ts, media_id)),
pair AS (SELECT *, {_HAV.format(a="plat", b="plon", c="lat", d="lon")} AS metres, alt - palt AS rise FROM lagged)"""


def _route(spark, d) -> DataFrame:
    fix = items(spark, d).where("lat is not null").select("media_id", "ts", "lat", "lon", "alt")
    rows = ordered.with_neighbours(fix, ["ts", "media_id"], F.struct("lat", "lon", "alt"))
    metres = geo.haversine("prev.lat", "prev.lon", "lat", "lon")
    rows = rows.withColumn("metres", metres).withColumn("rise", F.col("alt") - F.col("prev.alt"))
    return rows.withColumn("pct", geo.gradient_pct("rise", "metres"))


@query(f"""WITH {_ROUTE_SQL} SELECT media_id, round(metres, 2) AS metres, round(rise, 2) AS rise, round(CASE WHEN rise IS NULL OR metres IS NULL THEN NULL WHEN metres = 0 THEN 0 ELSE rise / metres * 100 END, 4) AS pct,
  (sum(coalesce(round(metres * 100)::BIGINT, 0)) OVER w)::BIGINT AS run_cm, (sum(CASE WHEN rise > 0 THEN round(rise * 100)::BIGINT ELSE 0 END) OVER w)::BIGINT AS gain_cm FROM pair WINDOW w AS (ORDER BY ts, media_id)""")
def route_gradient(spark, d):
    """SEQ1, SEQ2, SEQ3, QRY26."""
    cm = lambda c: F.round(c * 100).cast("long")
    rows = ordered.running_sums(_route(spark, d), ["ts", "media_id"], {"run_cm": cm(F.col("metres")), "gain_cm": F.when(F.col("rise") > 0, cm(F.col("rise")))})
    return rows.select("media_id", F.round("metres", 2).alias("metres"), F.round("rise", 2).alias("rise"), F.round("pct", 4).alias("pct"), "run_cm", "gain_cm")


@query(f"""WITH {_ROUTE_SQL} SELECT count(*)::BIGINT AS points, sum(round(metres * 100)::BIGINT)::BIGINT AS run_cm, sum(CASE WHEN rise > 0 THEN round(rise * 100)::BIGINT END)::BIGINT AS gain_cm, sum(CASE WHEN rise < 0 THEN round(rise * 100)::BIGINT END)::BIGINT AS loss_cm,
  round(min(lat), 6) AS south, round(max(lat), 6) AS north, round(avg(lat), 6) AS mid_lat, round(avg(lon), 6) AS mid_lon FROM pair""")
def route_totals(spark, d):
    """AG21, AG26."""
    cm = lambda c: F.round(F.col(c) * 100).cast("long")
    return _route(spark, d).agg(F.count("*").alias("points"), F.sum(cm("metres")).alias("run_cm"), F.sum(F.when(F.col("rise") > 0, cm("rise"))).alias("gain_cm"), F.sum(F.when(F.col("rise") < 0, cm("rise"))).alias("loss_cm"), F.round(F.min("lat"), 6).alias("south"), F.round(F.max("lat"), 6).alias("north"), F.round(F.avg("lat"), 6).alias("mid_lat"), F.round(F.avg("lon"), 6).alias("mid_lon"))


@query(f"""WITH {_ROUTE_SQL} SELECT media_id, round(plat, 6) AS lat0, round(plon, 6) AS lon0, round(lat, 6) AS lat1, round(lon, 6) AS lon1,
  CASE WHEN rise IS NULL THEN 'unknown' WHEN metres = 0 THEN 'flat' WHEN rise / metres * 100 < -6 THEN 'steep down' WHEN rise / metres * 100 < -2 THEN 'down' WHEN rise / metres * 100 <= 2 THEN 'flat' WHEN rise / metres * 100 <= 6 THEN 'up' ELSE 'steep up' END AS band FROM pair WHERE plat IS NOT NULL""")
def route_segments(spark, d):
    """SEQ16, M11."""
    return _route(spark, d).where("prev is not null").select("media_id", F.round("prev.lat", 6).alias("lat0"), F.round("prev.lon", 6).alias("lon0"), F.round("lat", 6).alias("lat1"), F.round("lon", 6).alias("lon1"), geo.gradient_band("pct").alias("band"))


@query(f"""WITH {ITEM_SQL}, s AS (SELECT media_id, CASE WHEN media_id % 9 = 0 THEN -lat ELSE lat END AS lat, nullif(alt, 0) AS alt FROM item)
SELECT media_id, round(CASE WHEN NOT lat BETWEEN -35 AND -30 AND -lat BETWEEN -35 AND -30 THEN -lat ELSE lat END, 6) AS lat, alt FROM s""")
def sign_fix(spark, d):
    """FLT11, M7."""
    turned = F.when(F.col("media_id") % 9 == 0, -F.col("lat")).otherwise(F.col("lat"))
    return items(spark, d).select("media_id", F.round(geo.sign_fixed(turned, -35, -30), 6).alias("lat"), F.nullif("alt", F.lit(0)).alias("alt"))


# --- as-of joins and ranges ------------------------------------------------------------------


@query(f"""WITH {ITEM_SQL}, {TRACK_SQL}, b AS (SELECT media_id, i.ts, t.ts AS t0, t.ele AS e0, t.point_id AS p0 FROM item i ASOF LEFT JOIN track t ON i.ts >= t.ts),
f AS (SELECT media_id, t.ts AS t1, t.ele AS e1, t.point_id AS p1 FROM item i ASOF LEFT JOIN track t ON i.ts <= t.ts)
SELECT media_id, CASE WHEN p0 IS NULL OR epoch_us(t1) - epoch_us(b.ts) <= epoch_us(b.ts) - epoch_us(t0) THEN p1 ELSE p0 END AS point_id, CASE WHEN p0 IS NULL OR epoch_us(t1) - epoch_us(b.ts) <= epoch_us(b.ts) - epoch_us(t0) THEN e1 ELSE e0 END AS ele FROM b JOIN f USING (media_id)""")
def asof_nearest_altitude(spark, d):
    """JN10."""
    item = items(spark, d)
    both = ordered.asof(item.select("media_id", "ts"), track_points(item), "ts", F.struct("ts", "point_id", "ele"), ahead=True)
    ahead = F.unix_micros("next.ts") - F.unix_micros("ts") <= F.unix_micros("ts") - F.unix_micros("prev.ts")
    pick = F.when(F.col("prev").isNull() | ahead, F.col("next")).otherwise(F.col("prev"))
    return both.withColumn("p", pick).select("media_id", "p.point_id", "p.ele")


@query(f"""WITH {ITEM_SQL}, {TRACK_SQL}, n AS (SELECT *, lead(ts) OVER w AS ts1, lead(plat) OVER w AS lat1, lead(plon) OVER w AS lon1, lead(ele) OVER w AS ele1 FROM track WINDOW w AS (ORDER BY ts, point_id)),
j AS (SELECT i.media_id, i.ts, n.ts AS ts0, n.ts1, plat, plon, ele, lat1, lon1, ele1 FROM item i ASOF JOIN n ON i.ts > n.ts)
SELECT media_id, round(plat + (lat1 - plat) * f, 6) AS lat, round(plon + (lon1 - plon) * f, 6) AS lon, round(ele + (ele1 - ele) * f, 4) AS ele, round(gap, 3) AS gap FROM
(SELECT *, (epoch_us(ts) - epoch_us(ts0)) / (epoch_us(ts1) - epoch_us(ts0))::DOUBLE AS f, (epoch_us(ts1) - epoch_us(ts0)) / 1e6 AS gap FROM j WHERE ts1 IS NOT NULL)""")
def asof_bracket_position(spark, d):
    """JN11, SEQ12."""
    item = items(spark, d)
    point = F.struct("ts", "plat", "plon", "ele")
    steps = ordered.with_neighbours(track_points(item), ["ts", "point_id"], point, back=False, ahead=True)
    both = ordered.asof(item.select("media_id", "ts"), steps, "ts", F.struct("ts", "plat", "plon", "ele", F.col("next").alias("to")), strict=True)
    at = both.where("prev.to is not null").withColumn("f", (F.unix_micros("ts") - F.unix_micros("prev.ts")) / (F.unix_micros("prev.to.ts") - F.unix_micros("prev.ts")))
    mixed = lambda c, n: F.round(F.col(f"prev.{c}") + (F.col(f"prev.to.{c}") - F.col(f"prev.{c}")) * F.col("f"), n)
    return at.select("media_id", mixed("plat", 6).alias("lat"), mixed("plon", 6).alias("lon"), mixed("ele", 4).alias("ele"), F.round((F.unix_micros("prev.to.ts") - F.unix_micros("prev.ts")) / 1e6, 3).alias("gap"))


@query(f"""WITH {ITEM_SQL}, x AS (SELECT media_id, ts, lat, last_value(CASE WHEN lat IS NOT NULL THEN {{'t': ts, 'v': lat}} END IGNORE NULLS) OVER (ORDER BY ts, media_id) AS p,
  first_value(CASE WHEN lat IS NOT NULL THEN {{'t': ts, 'v': lat}} END IGNORE NULLS) OVER (ORDER BY ts, media_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM item)
SELECT media_id, round(CASE WHEN p IS NULL THEN n.v WHEN n IS NULL THEN p.v WHEN n.t = p.t THEN p.v ELSE p.v + (n.v - p.v) * ((epoch_us(ts) - epoch_us(p.t)) / (epoch_us(n.t) - epoch_us(p.t))::DOUBLE) END, 6) AS lat FROM x""")
def fill_position(spark, d):
    """JN12, JOB12."""
    known = F.when(F.col("lat").isNotNull(), F.struct(F.col("ts").alias("t"), F.col("lat").alias("v")))
    x = ordered.with_neighbours(items(spark, d).select("media_id", "ts", "lat"), ["ts", "media_id"], known, ahead=True, current=True)
    f = F.try_divide(F.unix_micros("ts") - F.unix_micros("prev.t"), F.unix_micros("next.t") - F.unix_micros("prev.t"))
    value = F.when(F.col("prev").isNull(), F.col("next.v")).when(F.col("next").isNull() | (F.col("next.t") == F.col("prev.t")), F.col("prev.v")).otherwise(F.col("prev.v") + (F.col("next.v") - F.col("prev.v")) * f)
    return x.select("media_id", F.round(value, 6).alias("lat"))


@query(f"""WITH {ITEM_SQL}, sp AS (SELECT folder, min(ts) AS t0, max(ts) AS t1 FROM item GROUP BY folder, date_trunc('day', ts) HAVING count(*) > 1), span AS (SELECT *, folder * 1000 + dayofyear(t0) AS track_id FROM sp),
c AS (SELECT media_id, track_id, CASE WHEN t0 <= ts AND t1 >= end_ts THEN 0 WHEN least(end_ts, t1) > greatest(ts, t0) THEN 1 ELSE 2 END AS rank, epoch_us(ts) / 1e6 AS i0, epoch_us(end_ts) / 1e6 AS i1, epoch_us(t0) / 1e6 AS a, epoch_us(t1) / 1e6 AS b FROM item JOIN span USING (folder)),
m AS (SELECT *, CASE rank WHEN 0 THEN b - a WHEN 1 THEN greatest(i0, a) - least(i1, b) ELSE greatest(a - i1, i0 - b) END AS metric FROM c)
SELECT media_id, track_id, (['contains', 'overlaps', 'nearest'])[rank + 1] AS mode, round(abs(metric), 3) AS metric FROM m QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY rank, metric, track_id) = 1""")
def interval_best_track(spark, d):
    """JN13."""
    item = items(spark, d)
    span = item.groupBy("folder", F.to_date("ts").alias("day")).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count("*").alias("_n")).where("_n > 1")
    span = span.select("folder", "t0", "t1", (F.col("folder") * 1000 + F.dayofyear("t0")).alias("track_id"))
    best = intervals.best_interval(item.select("media_id", "folder", "ts", "end_ts"), span, ("ts", "end_ts"), ("t0", "t1"), "media_id", "track_id", ["folder"])
    return best.withColumn("metric", F.round("metric", 3))


@query(f"""WITH {ITEM_SQL}, {TRACK_SQL}, m AS (SELECT media_id, point_id, {_HAV.format(a="lat", b="lon", c="plat", d="plon")} AS metres FROM item, track WHERE lat IS NOT NULL)
SELECT media_id, point_id, round(metres, 2) AS metres, (row_number() OVER (PARTITION BY media_id ORDER BY m.metres, point_id))::INT AS rank FROM m QUALIFY rank <= 2""")
def knn_two_points(spark, d):
    """JN14."""
    item = items(spark, d)
    near = intervals.nearest_points(item, track_points(item), ("media_id", "lat", "lon"), ("point_id", "plat", "plon"), 2, 0.25)
    return near.select("media_id", "point_id", F.round("metres", 2).alias("metres"), F.col("rank").cast("int").alias("rank"))


@query(f"""WITH {ITEM_SQL}, w AS (SELECT date_trunc('day', ts)::DATE AS day, round(lat, 0) AS cy, round(lon, 0) AS cx, hour(ts) AS h, min(value) AS temp FROM item WHERE media_id % 3 = 0 AND lat IS NOT NULL GROUP BY ALL)
SELECT media_id, h::INT AS h, round(temp, 4) AS temp FROM item i JOIN w ON w.day = i.ts::DATE AND w.cy = round(i.lat, 0) AND w.cx = round(i.lon, 0) QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY abs(h - hour(i.ts)), h) = 1""")
def cell_nearest_hour(spark, d):
    """JN16."""
    item = items(spark, d)
    cy, cx = geo.cell("lat", "lon", 0)
    celled = item.where("lat is not null").withColumn("day", F.to_date("ts")).withColumn("cy", cy).withColumn("cx", cx)
    weather = celled.where("media_id % 3 = 0").groupBy("day", "cy", "cx", F.hour("ts").alias("h")).agg(F.min("value").alias("temp"))
    near = F.struct(F.abs(F.col("h") - F.hour("ts")).alias("d"), "h")
    return celled.join(weather, ["day", "cy", "cx"]).groupBy("media_id").agg(F.min_by(F.struct("h", "temp"), near).alias("w")).select("media_id", "w.h", F.round("w.temp", 4).alias("temp"))


@query(f"""WITH {ITEM_SQL}, r AS (SELECT min(ts) AS a, max(ts) AS b FROM item WHERE folder = 7) SELECT media_id, kind FROM item, r WHERE ts BETWEEN a AND b AND kind = 'text'""")
def date_range_messages(spark, d):
    """FLT7, JN15, QRY8."""
    item = items(spark, d)
    span = item.where("folder = 7").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return item.where("kind = 'text'").join(F.broadcast(span), F.col("ts").between(F.col("a"), F.col("b"))).select("media_id", "kind")


@query(f"""WITH {ITEM_SQL}, t(target) AS (VALUES (0), (6), (13), (22)), x AS (SELECT media_id, hour(ts) + minute(ts) / 60.0::DOUBLE AS h FROM item)
SELECT media_id, target::INT AS target, round(least(abs(h - target), 24 - abs(h - target)), 6) AS away FROM x, t QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY least(abs(h - target), 24 - abs(h - target)), target) = 1""")
def circular_hour_match(spark, d):
    """JN21."""
    h = F.hour("ts") + F.minute("ts") / 60.0
    away = lambda t: F.least(F.abs(h - t), 24 - F.abs(h - t))
    best = F.array_min(F.array(*[F.struct(away(t).alias("away"), F.lit(t).alias("target")) for t in (0, 6, 13, 22)]))
    return items(spark, d).select("media_id", best.alias("b")).select("media_id", "b.target", F.round("b.away", 6).alias("away"))


@query(f"""WITH {ITEM_SQL}, p AS (SELECT range AS n, TIMESTAMP '2024-01-05 00:00:00' + to_hours(range) AS t FROM range(24))
SELECT n::INT AS n, media_id, kind FROM p JOIN item ON ts <= t AND end_ts >= t""")
def active_at(spark, d):
    """DOC1."""
    probes = spark.range(24).select(F.col("id").cast("int").alias("n"), F.timestamp_seconds(F.lit(1_704_412_800) + F.col("id") * 3600).alias("t"))
    return intervals.overlaps(items(spark, d).select("media_id", "kind", "ts", "end_ts"), probes, ("ts", "end_ts"), ("t", "t")).select("n", "media_id", "kind")


@query(f"""WITH {ITEM_SQL}, w AS (SELECT date_trunc('hour', ts) AS t0, date_trunc('hour', ts) + INTERVAL 59 MINUTE AS t1 FROM item GROUP BY ALL)
SELECT strftime(t0, '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n FROM w JOIN item ON ts <= t1 AND end_ts >= t0 GROUP BY 1""")
def overlap_windows(spark, d):
    """DOC2."""
    item = items(spark, d).select("media_id", "ts", "end_ts")
    hours = item.select(F.date_trunc("hour", "ts").alias("t0")).distinct().withColumn("t1", F.col("t0") + F.expr("INTERVAL 59 MINUTES"))
    return intervals.overlaps(item, hours, ("ts", "end_ts"), ("t0", "t1")).groupBy(_stamp("t0").alias("start")).agg(F.count("*").alias("n"))


@query(f"""WITH {ITEM_SQL} SELECT media_id, lag(media_id) OVER w AS previous, lead(media_id) OVER w AS next FROM item WINDOW w AS (PARTITION BY folder ORDER BY ts, media_id)""")
def next_previous_item(spark, d):
    """DOC3, DOC4."""
    rows = ordered.with_neighbours(items(spark, d).select("media_id", "folder", "ts"), ["ts", "media_id"], F.col("media_id"), ["folder"], back=True, ahead=True)
    return rows.select("media_id", F.col("prev").alias("previous"), "next")


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n FROM events GROUP BY 1""")
def daily_distribution(spark, d):
    """DOC6."""
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query(f"""WITH {ITEM_SQL} SELECT a.media_id AS point, b.media_id AS segment FROM item a JOIN item b ON a.province = b.province AND a.kind = 'image' AND b.kind IN ('video', 'audio') AND a.ts >= b.ts AND a.ts <= b.end_ts""")
def points_in_segments(spark, d):
    """DOC7."""
    item = items(spark, d).where("province is not null")
    a = item.where("kind = 'image'").select(F.col("media_id").alias("point"), "province", F.col("ts").alias("p0"))
    b = item.where("kind in ('video', 'audio')").select(F.col("media_id").alias("segment"), "province", F.col("ts").alias("s0"), F.col("end_ts").alias("s1"))
    return intervals.overlaps(a, b, ("p0", "p0"), ("s0", "s1"), by=["province"]).select("point", "segment")


@query(f"""WITH {ITEM_SQL}, m AS (SELECT folder, ts, kind || ':' || media_id AS mark FROM item WHERE media_id % 7 = 0)
SELECT media_id, mark FROM item i ASOF LEFT JOIN m ON i.folder = m.folder AND i.ts >= m.ts""")
def latest_mark_at_item(spark, d):
    """DOC8."""
    from caravel.plans.views import marks

    item = items(spark, d)
    return ordered.asof(item.select("media_id", "folder", "ts"), marks(item), "ts", F.col("mark"), by=["folder"]).select("media_id", F.col("prev").alias("mark"))


# --- sequences -------------------------------------------------------------------------------


@query(f"""WITH {ITEM_SQL} SELECT media_id, o::INT AS offset_s FROM (SELECT media_id, unnest(range(0, duration_s + 1, 75)) AS o FROM item WHERE duration_s > 0)""")
def fixed_samples(spark, d):
    """SEQ8."""
    return items(spark, d).where("duration_s > 0").select("media_id", F.explode(F.sequence(F.lit(0), F.col("duration_s").cast("int"), F.lit(75))).alias("offset_s"))


@query(f"""WITH {ITEM_SQL}, l AS (SELECT media_id, folder, alt - lag(alt) OVER (PARTITION BY folder ORDER BY ts, media_id) AS rise FROM item)
SELECT media_id, CASE WHEN rise > 0 THEN 'up' ELSE 'down' END AS direction, round(rise, 2) AS rise FROM l WHERE abs(rise) >= 300""")
def elevation_marks(spark, d):
    """SEQ4."""
    rows = ordered.lagged(items(spark, d), ["folder"], ["ts", "media_id"], {"before": F.col("alt")})
    rows = rows.withColumn("rise", F.col("alt") - F.col("before")).where(F.abs("rise") >= 300)
    return rows.select("media_id", F.when(F.col("rise") > 0, "up").otherwise("down").alias("direction"), F.round("rise", 2).alias("rise"))


_SUN = """s0 AS (SELECT media_id, folder, ts, lat, lon, epoch_us(ts) / 86400000000.0 + 2440587.5 AS jd FROM item),
s1 AS (SELECT *, (jd - 2451545.0) / 36525.0 AS t FROM s0),
s2 AS (SELECT *, 280.46646 + t * (36000.76983 + t * 0.0003032) AS l, radians(357.52911 + t * (35999.05029 - 0.0001537 * t)) AS m, 0.016708634 - t * (0.000042037 + 0.0000001267 * t) AS e, radians(125.04 - 1934.136 * t) AS om FROM s1),
s3 AS (SELECT *, l - 360 * floor(l / 360) AS ml, sin(m) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * m) * (0.019993 - 0.000101 * t) + sin(3 * m) * 0.000289 AS c,
  radians(23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60 + 0.00256 * cos(om)) AS eps FROM s2),
s4 AS (SELECT *, asin(sin(eps) * sin(radians(ml + c - 0.00569 - 0.00478 * sin(om)))) AS decl, pow(tan(eps / 2), 2) AS y, radians(ml) AS lr FROM s3),
s5 AS (SELECT *, 4 * degrees(y * sin(2 * lr) - 2 * e * sin(m) + 4 * e * y * sin(m) * cos(2 * lr) - 0.5 * y * y * sin(4 * lr) - 1.25 * e * e * sin(2 * m)) AS eqt, epoch_us(ts) / 60000000.0 AS mi FROM s4),
s6 AS (SELECT *, mi - 1440 * floor(mi / 1440) + eqt + 4 * lon AS tst FROM s5),
sun AS (SELECT media_id, folder, ts, lat, CASE WHEN lat IS NOT NULL THEN 90 - degrees(acos(greatest(-1, least(1, sin(radians(lat)) * sin(decl) + cos(radians(lat)) * cos(decl) * cos(radians((tst - 1440 * floor(tst / 1440)) / 4 - 180)))))) END AS el FROM s6)"""
_LIGHT = "CASE WHEN el IS NULL THEN NULL WHEN el >= 12 THEN 'day' WHEN el >= 6 THEN 'low sun' WHEN el >= 0 THEN 'golden' WHEN el >= -6 THEN 'civil' WHEN el >= -12 THEN 'nautical' WHEN el >= -18 THEN 'astronomical' ELSE 'night' END"


@query(f"""WITH {ITEM_SQL}, {_SUN} SELECT media_id, round(el, 5) AS elevation, {_LIGHT} AS light FROM sun WHERE lat IS NOT NULL""")
def sun_position(spark, d):
    """M1, M2, M4, QRY25."""
    rows = items(spark, d).where("lat is not null").withColumn("el", sun.elevation("ts", "lat", "lon"))
    return rows.select("media_id", F.round("el", 5).alias("elevation"), sun.twilight("el").alias("light"))


@query(f"""WITH {ITEM_SQL}, {_SUN}, k AS (SELECT media_id, folder, ts, {_LIGHT} AS light FROM sun), l AS (SELECT *, lag(light) OVER w AS before, row_number() OVER w AS n FROM k WINDOW w AS (PARTITION BY folder ORDER BY ts, media_id))
SELECT media_id, before, light FROM l WHERE n > 1 AND light IS NOT NULL AND light IS DISTINCT FROM before""")
def twilight_changes(spark, d):
    """SEQ5."""
    rows = items(spark, d).withColumn("el", sun.elevation("ts", "lat", "lon"))
    return ordered.changes(rows, ["folder"], ["ts", "media_id"], sun.twilight("el"), "light").select("media_id", "before", "light")


@query(f"""WITH {ITEM_SQL}, g AS (SELECT media_id, folder, ts, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS dt, row_number() OVER w AS n FROM item WINDOW w AS (PARTITION BY folder ORDER BY ts, media_id)),
s AS (SELECT media_id, folder, ts, CASE WHEN plat IS NULL OR lat IS NULL THEN 'none' WHEN {_HAV.format(a="plat", b="plon", c="lat", d="lon")} / dt * 3.6 >= 30 THEN 'moving' ELSE 'stopped' END AS state FROM g WHERE n > 1 AND (plat IS NULL OR lat IS NULL OR dt > 0)),
l AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY folder ORDER BY ts, media_id), 'none') AS before FROM s)
SELECT media_id, nullif(before, 'none') AS before, state FROM l WHERE state <> 'none' AND state <> before""")
def motion_changes(spark, d):
    """SEQ6: a step without time leaves the state as it is; an unknown position resets it."""
    rows = ordered.lagged(items(spark, d), ["folder"], ["ts", "media_id"], {"_lat": F.col("lat"), "_lon": F.col("lon"), "_ts": F.col("ts")}).where("_ts is not null")
    seconds = (F.unix_micros("ts") - F.unix_micros("_ts")) / 1e6
    known = F.col("lat").isNotNull() & F.col("_lat").isNotNull()
    kmh = F.try_divide(geo.haversine("_lat", "_lon", "lat", "lon"), seconds) * 3.6
    states = rows.where(~known | (seconds > 0)).withColumn("state", F.when(~known, "none").when(kmh >= 30, "moving").otherwise("stopped"))
    steps = ordered.lagged(states, ["folder"], ["ts", "media_id"], {"before": F.col("state")}).withColumn("before", F.coalesce("before", F.lit("none")))
    return steps.where("state <> 'none' and state <> before").select("media_id", F.nullif("before", F.lit("none")).alias("before"), "state")


@query(f"""WITH {ITEM_SQL}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 7200000000 THEN 1 ELSE 0 END AS new FROM item WINDOW w AS (PARTITION BY folder ORDER BY ts, media_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY folder ORDER BY ts, media_id) AS session FROM g) SELECT folder, session::BIGINT AS session, count(*)::BIGINT AS n, min(media_id) AS first FROM s GROUP BY ALL""")
def bursts_by_gap(spark, d):
    """SEQ14."""
    rows = ordered.sessions(items(spark, d).select("folder", "ts", "media_id"), ["folder"], "ts", 7200, "media_id")
    return rows.groupBy("folder", "session").agg(F.count("*").alias("n"), F.min("media_id").alias("first"))


@query(f"""WITH RECURSIVE {ITEM_SQL}, o AS (SELECT folder, media_id, ts, row_number() OVER (PARTITION BY folder ORDER BY ts, media_id) AS r FROM item),
b AS (SELECT folder, media_id, ts, r, ts AS first, 0 AS burst FROM o WHERE r = 1 UNION ALL
  SELECT o.folder, o.media_id, o.ts, o.r, CASE WHEN epoch_us(o.ts) - epoch_us(b.first) > 86400000000 THEN o.ts ELSE b.first END, b.burst + CASE WHEN epoch_us(o.ts) - epoch_us(b.first) > 86400000000 THEN 1 ELSE 0 END FROM b JOIN o ON o.folder = b.folder AND o.r = b.r + 1)
SELECT folder, media_id, burst::BIGINT AS burst FROM b""")
def bursts_anchored(spark, d):
    """SEQ13."""
    rows = items(spark, d).select("folder", "ts", "media_id")
    return ordered.anchored_groups(rows, ["folder"], "ts", 86_400, "media_id").select("folder", "media_id", F.col("burst").cast("long").alias("burst"))


@query("""WITH c AS (SELECT l_orderkey AS id, list_sort(list_distinct(list_concat([0.0], list(l_quantity), [60.0]))) AS cuts FROM lineitem GROUP BY 1),
s AS (SELECT id, unnest(cuts[1:len(cuts) - 1]) AS a, unnest(cuts[2:]) AS b FROM c), p AS (SELECT id, a, b, unnest(range(CAST(ceil((b - a) / 20) AS BIGINT))) AS i FROM s)
SELECT id, round(a + i * 20, 1) AS start, round(least(b, a + (i + 1) * 20), 1) AS stop FROM p""")
def scene_split(spark, d):
    """SEQ17, SEQ18."""
    cuts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_quantity").alias("q"))
    spans = marks_.split_spans(marks_.scene_spans(F.col("q"), F.lit(60.0)), 20.0)
    return cuts.select("id", F.explode(spans).alias("s")).select("id", F.round("s.start", 1).alias("start"), F.round("s.end", 1).alias("stop"))


@query(f"""WITH {ITEM_SQL}, o AS (SELECT media_id, folder, row_number() OVER (PARTITION BY folder ORDER BY media_id) AS pos, CASE WHEN media_id % 4 <> 1 THEN epoch_us(ts) END AS t FROM item),
x AS (SELECT *, last_value(CASE WHEN t IS NOT NULL THEN {{'p': pos, 't': t}} END IGNORE NULLS) OVER (PARTITION BY folder ORDER BY pos) AS a, first_value(CASE WHEN t IS NOT NULL THEN {{'p': pos, 't': t}} END IGNORE NULLS) OVER (PARTITION BY folder ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM o)
SELECT media_id, round((a.t + (b.t - a.t) / (b.p - a.p)::DOUBLE * (pos - a.p)) / 1e6, 3) AS at FROM x WHERE t IS NULL AND a IS NOT NULL AND b IS NOT NULL""")
def timestamps_rank_interp(spark, d):
    """SEQ15, JOB11."""
    # in blocks of ids, so that a folder may hold any share of the items
    block = F.floor(F.col("media_id") / 10_000)
    rows = ordered.running_sums(items(spark, d), ["media_id"], {"pos": F.lit(1)}, ["folder"], block).select("media_id", "folder", "pos", F.when(F.col("media_id") % 4 != 1, F.unix_micros("ts")).alias("t"))
    known = F.when(F.col("t").isNotNull(), F.struct(F.col("pos").alias("p"), "t"))
    x = ordered.with_neighbours(rows, ["media_id"], known, ["folder"], block, back=True, ahead=True, current=True).withColumnsRenamed({"prev": "a", "next": "b"})
    value = (F.col("a.t") + (F.col("b.t") - F.col("a.t")) / (F.col("b.p") - F.col("a.p")) * (F.col("pos") - F.col("a.p"))) / 1e6
    return x.where("t is null and a is not null and b is not null").select("media_id", F.round(value, 3).alias("at"))


@query(f"""WITH {ITEM_SQL}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000 THEN 1 ELSE 0 END AS new FROM item WINDOW w AS (PARTITION BY kind ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY kind ORDER BY ts) AS session FROM g)
SELECT kind, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n FROM s GROUP BY kind, session""")
def session_bursts(spark, d):
    return items(spark, d).groupBy("kind", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("t")).select("kind", _stamp("t").alias("start"), "n")


# --- similarity ------------------------------------------------------------------------------


@query("""SELECT DISTINCT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name)::INT AS distance FROM (SELECT DISTINCT p_name FROM part) a, (SELECT DISTINCT p_name FROM part) b WHERE a.p_name < b.p_name AND abs(length(a.p_name) - length(b.p_name)) <= 1 AND levenshtein(a.p_name, b.p_name) <= 1""")
def fuzzy_names(spark, d):
    """JN18, S16."""
    part = table(spark, d, "part")
    return dedup.similar_names(part, part, "p_name", "p_name", 1).where("a < b")


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id""")
def cosine_pairs(spark, d):
    """JN17 as a search: every vector whose id is divisible by 100 against all others of its label."""
    return dedup.similarity_search(table(spark, d, "embeddings"), "vec_id", "embedding", "label").select("a", "b", F.round("similarity", 5).alias("similarity"))


@query("""WITH RECURSIVE o AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
b AS (SELECT label, vec_id, r, vec_id AS leader, [{'id': vec_id, 'e': e}] AS leaders FROM o WHERE r = 1
  UNION ALL SELECT label, vec_id, r, coalesce(hit, vec_id), CASE WHEN hit IS NULL THEN list_append(leaders, {'id': vec_id, 'e': e}) ELSE leaders END FROM (SELECT o.label, o.vec_id, o.r, o.e, leaders, (list_filter(leaders, lambda l: list_cosine_similarity(l.e, o.e) >= 0.7)[1]).id AS hit FROM b JOIN o ON o.label = b.label AND o.r = b.r + 1))
SELECT label, vec_id, leader FROM b""")
def cosine_leader_clusters(spark, d):
    """SET12."""
    return dedup.leader_clusters(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding", dedup.CosineLeaders, 0.7).select("label", "vec_id", "leader")


# --- more of the archive's own questions -----------------------------------------------------


@query("""SELECT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents) GROUP BY 1 HAVING count(*) = 1""")
def words_once(spark, d):
    """AG25."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n = 1").select("word")


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def tumbling_counts(spark, d):
    from caravel.streaming.choices import windowed_counts

    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(rows, "1 hour").withColumn("start", _stamp("start"))


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n FROM events, range(2) r(k) GROUP BY ALL""")
def sliding_counts(spark, d):
    from caravel.streaming.choices import windowed_counts

    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(rows, "2 hours", "1 hour").withColumn("start", _stamp("start"))


@query("""SELECT event_id, (['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSO', 'SO', 'OSO', 'O', 'ONO', 'NO', 'NNO'])[1 + CAST(floor((floor(event_id * 17.7)::BIGINT % 360) / 22.5 + 0.5) AS BIGINT) % 16] AS wind,
  CASE event_id % 100 WHEN 0 THEN 'despejado' WHEN 1 THEN 'mayormente despejado' WHEN 2 THEN 'parcialmente nublado' WHEN 3 THEN 'nublado' WHEN 45 THEN 'niebla' WHEN 48 THEN 'niebla con escarcha'
    WHEN 51 THEN 'llovizna ligera' WHEN 53 THEN 'llovizna moderada' WHEN 55 THEN 'llovizna densa' WHEN 56 THEN 'llovizna helada' WHEN 57 THEN 'llovizna helada densa' WHEN 61 THEN 'lluvia ligera' WHEN 63 THEN 'lluvia moderada'
    WHEN 65 THEN 'lluvia intensa' WHEN 66 THEN 'lluvia helada ligera' WHEN 67 THEN 'lluvia helada intensa' WHEN 71 THEN 'nieve ligera' WHEN 73 THEN 'nieve moderada' WHEN 75 THEN 'nieve intensa' WHEN 80 THEN 'tormenta ligera'
    WHEN 81 THEN 'tormenta moderada' WHEN 82 THEN 'tormenta intensa' WHEN 95 THEN 'tormenta eléctrica' WHEN 96 THEN 'tormenta con granizo ligero' WHEN 99 THEN 'tormenta con granizo intenso' ELSE 'codigo_' || event_id % 100 END AS weather FROM events""")
def weather_names(spark, d):
    """M8."""
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", geo.wind_point(i * F.lit(17.7)).alias("wind"), geo.weather_label(i % 100).alias("weather"))


@query("""SELECT event_id, strftime(date_trunc('second', ts) + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS utc FROM events""")
def filename_times(spark, d):
    """D2."""
    from caravel.functions.time import of_filename

    name = F.concat(F.lit("VID_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_01.mp4"))
    return table(spark, d, "events").select("event_id", _stamp(of_filename(name)).alias("utc"))


@query("""SELECT event_id, CASE WHEN user_id % 10 = 1 THEN '/nas/trip/' || user_id || '/' || event_id ELSE '/media/u' || (user_id % 10) || '/' || user_id || '/' || event_id END AS path FROM events""")
def path_moves(spark, d):
    """S18, JOB30."""
    from caravel.functions.metadata import moved_path

    path = F.concat(F.lit("/media/u"), (F.col("user_id") % 10).cast("string"), F.lit("/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", moved_path(path, "/media/u1", "/nas/trip").alias("path"))


@query(f"""WITH {ITEM_SQL} SELECT media_id, kind FROM item ORDER BY media_id DESC LIMIT 20""")
def latest_items(spark, d):
    """SRT2, QRY15."""
    return items(spark, d).select("media_id", "kind").orderBy(F.desc("media_id")).limit(20)


@query(f"""WITH {ITEM_SQL} SELECT kind, array_to_string(list_sort(list(DISTINCT province)), ',') AS provinces, count(DISTINCT place)::BIGINT AS places FROM item GROUP BY 1""")
def places_per_kind(spark, d):
    """AG20."""
    return items(spark, d).groupBy("kind").agg(F.array_join(F.array_sort(F.collect_set("province")), ",").alias("provinces"), F.countDistinct("place").alias("places"))


@query(f"""WITH {ITEM_SQL} SELECT kind, province, count(*)::BIGINT AS n FROM item GROUP BY ROLLUP (kind, province)""")
def facet_rollup(spark, d):
    return items(spark, d).rollup("kind", "province").agg(F.count("*").alias("n"))


@query(f"""WITH {ITEM_SQL} SELECT media_id, kind, color1 FROM item WHERE kind IN ('image', 'video') AND place NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 1) AND hour(ts) BETWEEN 7 AND 18
QUALIFY row_number() OVER (PARTITION BY kind ORDER BY ((media_id + 7) * 1103515245 + 12345) % 2147483648, media_id) <= 5""")
def filtered_media(spark, d):
    """FLT1, FLT9, QRY7."""
    barred = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("place"))
    kept = items(spark, d).where(F.col("kind").isin("image", "video") & F.hour("ts").between(7, 18) & F.col("place").isNotNull()).join(F.broadcast(barred), "place", "left_anti")
    return facets.sample_per_group(kept.select("media_id", "kind", "color1"), "kind", "media_id", 5, facets.portable_hash("media_id", 7))


_COLORS_SQL = ", ".join(f"('{n}', {int(h[1:3], 16)}, {int(h[3:5], 16)}, {int(h[5:7], 16)}, {n in color.NO_COLOR})" for n, h in color.CSS.items())


@query(f"""WITH c(name, r, g, b, plain) AS (VALUES {_COLORS_SQL}), e AS (SELECT event_id, (event_id * 7919) % 16777216 AS x FROM events), k AS (SELECT event_id, x // 65536 AS r, (x // 256) % 256 AS g, x % 256 AS b FROM e),
d AS (SELECT event_id, name, plain, sqrt((2 + (k.r + c.r) / 2.0::DOUBLE / 256) * (k.r - c.r) * (k.r - c.r) + 4 * (k.g - c.g) * (k.g - c.g) + (2 + (255 - (k.r + c.r) / 2.0::DOUBLE) / 256) * (k.b - c.b) * (k.b - c.b)) AS d FROM k, c),
m AS (SELECT event_id, min({{'d': d, 'name': name}}) AS a, arg_min(plain, {{'d': d, 'name': name}}) AS plain, min({{'d': d, 'name': name}}) FILTER (NOT plain) AS b FROM d GROUP BY 1)
SELECT event_id, CASE WHEN plain AND b.d < a.d * 1.5 THEN b.name ELSE a.name END AS name FROM m""")
def color_names(spark, d):
    """M9."""
    code = F.concat(F.lit("#"), F.lower(F.lpad(F.hex((F.col("event_id") * 7919) % 16_777_216), 6, "0")))
    return table(spark, d, "events").select("event_id", color.nearest_name(code).alias("name"))


@query()
def phash_leaders(spark, d):
    """SET10: documents of a source by the hash of their whole texts' bytes, read as grey rows of 64."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.rpad(F.coalesce("text", F.lit("")).cast("binary"), (F.ceil(F.octet_length(F.coalesce("text", F.lit(" "))) / 64) * 64).cast("int"), F.lit(b" ")).alias("b"))
    hashed = docs.select("source", "doc_id", image.perceptual_hash("b", F.lit(64)).alias("h"))
    return dedup.leader_clusters(hashed, ["source"], "doc_id", "h", dedup.HammingLeaders, 10).select("source", "doc_id", "leader")
