"""More queries over the archive, each with its own SQL where SQL can say it. Imported for its registrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from caravel.functions import color, geo, metadata, text
from caravel.operators import audio, bursts, dedup, intervals, marks, ordered, ranking
from caravel.plans.queries import _HAV, _stamp, query
from caravel.plans.views import EAV_SQL, ITEM_SQL, TRACK_SQL, attributes, items, table, track_points

# --- predicates, pages, orders -----------------------------------------------------------------


@query(f"WITH {ITEM_SQL} SELECT media_id, kind, alt FROM item WHERE kind = 'image' AND alt > 500 OR place LIKE 'A%' ORDER BY media_id LIMIT 25")
def predicate_filter(spark, d):
    """FLT10, SRT3, QRY2."""
    found = ranking.where_text(items(spark, d), "kind = 'image' AND alt > 500 OR place LIKE 'A%'")
    return found.select("media_id", ranking.checked_column(found, "kind"), "alt").orderBy("media_id").limit(25)


@query(r"SELECT doc_id, CASE WHEN w = '' THEN 0 ELSE len(string_split_regex(w, '\s+')) END::INT AS words FROM (SELECT doc_id, text, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS w FROM documents) WHERE length(text) >= 300 AND len(string_split_regex(w, '\s+')) >= 50")
def long_texts(spark, d):
    """FLT13."""
    return table(spark, d, "documents").select("doc_id", "text", ranking.word_count("text").alias("words")).where("words >= 50 and length(text) >= 300").select("doc_id", "words")


@query(f"WITH {ITEM_SQL} SELECT media_id, strftime(ts, '%Y-%m-%d') AS day FROM item ORDER BY ts DESC, media_id LIMIT 500 OFFSET 500")
def second_page(spark, d):
    """SRT10."""
    return ranking.page(items(spark, d).select("media_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts"), [F.desc("ts"), "media_id"], 1).drop("ts")


@query(f"WITH {ITEM_SQL} SELECT media_id, kind FROM item ORDER BY (kind = 'video') DESC, ((media_id + 3) * 1103515245 + 12345) % 2147483648, media_id LIMIT 40")
def preferred_kind(spark, d):
    """SRT4, SRT11, SRT12: videos first, then a hash order that stands for chance."""
    from caravel.operators.facets import portable_hash

    rows = items(spark, d).select("media_id", "kind")
    return ranking.preferred_first(rows, F.col("kind") == "video", [portable_hash("media_id", 3), "media_id"]).limit(40)


@query(f"WITH {ITEM_SQL} SELECT media_id, folder FROM item WHERE lat IS NULL ORDER BY ((media_id + 5) * 1103515245 + 12345) % 2147483648, media_id LIMIT 15")
def sample_without_position(spark, d):
    """SRT6."""
    from caravel.operators.facets import portable_hash

    return items(spark, d).where("lat is null").select("media_id", "folder").orderBy(portable_hash("media_id", 5), "media_id").limit(15)


@query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY (p_partkey * 1103515245 + 12345) % 2147483648, p_partkey) = 1")
def once_per_brand(spark, d):
    """SRT13."""
    from caravel.operators.facets import portable_hash

    return ranking.once(table(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", [portable_hash("p_partkey", 0), "p_partkey"])


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS a, e.vec_id AS b, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS x FROM q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id)
SELECT a, b, round(x, 5) AS similarity FROM s WHERE x >= 0.1 AND b >= 20 ORDER BY x DESC, a * 1000000 + b LIMIT 30""")
def similar_best(spark, d):
    """SRT9, JN17."""
    pairs = dedup.similarity_search(table(spark, d, "embeddings"), "vec_id", "embedding", "label").withColumn("tie", F.col("a") * 1_000_000 + F.col("b"))
    return ranking.similar_top(pairs, "similarity", "b", 0.1, 20, 30, "tie").select("a", "b", F.round("similarity", 5).alias("similarity"))


@query(f"WITH {ITEM_SQL} SELECT media_id, lat IS NOT NULL AS placed, CASE WHEN lat IS NOT NULL THEN round(lat, 4) END AS lat, CASE WHEN value IS NOT NULL THEN round(value, 2) END AS temp, kind FROM item")
def item_structs(spark, d):
    """PRJ5: parts that are unknown are null structs."""
    i = items(spark, d)
    place = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct(F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon")))
    weather = F.when(F.col("value").isNotNull(), F.struct(F.round("value", 2).alias("temp")))
    rows = i.select("media_id", F.struct("kind", place.alias("place"), weather.alias("weather")).alias("item"))
    return rows.select("media_id", F.col("item.place").isNotNull().alias("placed"), "item.place.lat", "item.weather.temp", "item.kind")


@query(f"WITH {ITEM_SQL} SELECT media_id, turn, length(c.text) AS chars FROM item JOIN conversations c ON c.conv_id = CASE WHEN media_id % 3 = 0 THEN media_id % 500 END AND c.turn = 1")
def item_messages(spark, d):
    """JN4: items without a message are left out; messages are few for their key."""
    linked = items(spark, d).select("media_id", F.when(F.col("media_id") % 3 == 0, F.col("media_id") % 500).alias("conv_id")).where("conv_id is not null")
    messages = table(spark, d, "conversations").where("turn = 1").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.length("text").cast("long").alias("chars"))
    return linked.join(messages, "conv_id").select("media_id", "turn", "chars")


# --- routes and marks --------------------------------------------------------------------------


@query(f"""WITH {ITEM_SQL}, s AS (SELECT media_id, unnest(range(0, duration_s + 1, 75)) AS o FROM item WHERE duration_s > 0), m AS (SELECT media_id, unnest(range(0, max(o) + 1, 200)) AS k FROM s GROUP BY media_id),
b AS (SELECT media_id, k, o FROM m JOIN s USING (media_id) QUALIFY row_number() OVER (PARTITION BY media_id, k ORDER BY abs(o - k), o) = 1) SELECT DISTINCT media_id, o::INT AS offset_s FROM b""")
def coarse_samples(spark, d):
    """SEQ9, SEQ8."""
    fine = items(spark, d).where("duration_s > 0").select("media_id", F.explode(F.sequence(F.lit(0), F.col("duration_s").cast("int"), F.lit(75))).alias("offset_s"))
    return marks.coarse(fine, ["media_id"], "offset_s", 200).select("media_id", "offset_s")


@query(f"""WITH {ITEM_SQL}, {TRACK_SQL}, n AS (SELECT *, lead(ts) OVER w AS ts1, lead(plat) OVER w AS lat1, lead(plon) OVER w AS lon1, lead(ele) OVER w AS ele1 FROM track WINDOW w AS (ORDER BY ts, point_id)),
s AS (SELECT media_id, lat, lon, alt, duration_s, ts AS t0, unnest(range(0, duration_s + 1, 300)) AS o FROM item WHERE duration_s > 0), p AS (SELECT *, t0 + to_seconds(o) AS ts FROM s),
j AS (SELECT p.media_id, p.o, p.lat, p.lon, p.alt, p.duration_s, (epoch_us(p.ts) - epoch_us(n.ts)) / (epoch_us(n.ts1) - epoch_us(n.ts))::DOUBLE AS f, plat, plon, lat1, lon1, n.ts1 IS NOT NULL AND epoch_us(n.ts1) - epoch_us(n.ts) <= 3600000000 AS near FROM p ASOF LEFT JOIN n ON p.ts > n.ts)
SELECT media_id, o::INT AS offset_s, CASE WHEN near THEN 'track_interpolado' WHEN lat IS NULL THEN NULL WHEN media_id % 2 = 0 THEN 'estimado' ELSE 'gps_propio' END AS source,
  round(CASE WHEN near THEN plat + (lat1 - plat) * f WHEN media_id % 2 = 0 THEN lat + (lat + 0.01::DOUBLE - lat) * (o / duration_s::DOUBLE) ELSE lat END, 10) AS lat FROM j""")
def sample_positions(spark, d):
    """SEQ10, SEQ8, SEQ12, JN11: on a track of points at most an hour apart, else along the item's own two points (every second item), else its own position."""
    item = items(spark, d)
    steps = ordered.with_neighbours(track_points(item), ["ts", "point_id"], F.struct("ts", "plat", "plon", "ele"), back=False, ahead=True)
    at = item.where("duration_s > 0").select("media_id", "lat", "lon", "alt", "duration_s", F.col("ts").alias("t0"), F.explode(F.sequence(F.lit(0), F.col("duration_s").cast("int"), F.lit(300))).alias("offset_s"))
    at = at.withColumn("ts", F.timestamp_micros(F.unix_micros("t0") + F.col("offset_s").cast("long") * 1_000_000))
    got = ordered.asof(at, steps, "ts", F.struct("ts", F.struct(F.col("plat").alias("lat"), F.col("plon").alias("lon"), "ele").alias("a"), F.struct(F.col("next.plat").alias("lat"), F.col("next.plon").alias("lon"), F.col("next.ele").alias("ele")).alias("b"), F.col("next.ts").alias("ts1")), strict=True)
    long = F.unix_micros("prev.ts1") - F.unix_micros("prev.ts")
    track = F.when(long <= 3_600_000_000, marks.along(F.col("prev.a"), F.col("prev.b"), (F.unix_micros("ts") - F.unix_micros("prev.ts")) / long))
    own = F.struct("lat", "lon", F.col("alt").alias("ele"))
    moved = F.struct((F.col("lat") + 0.01).alias("lat"), F.col("lon"), F.col("alt").alias("ele"))
    estimate = F.when(F.col("media_id") % 2 == 0, marks.along(own, moved, F.col("offset_s") / F.col("duration_s")))
    rows = got.withColumn("p", marks.position_cascade(track, estimate, own))
    return rows.select("media_id", "offset_s", "p.source", F.round("p.lat", 10).alias("lat"))


@query(f"""WITH {ITEM_SQL}, k AS (SELECT media_id, folder, ts, CASE WHEN media_id % 6 <> 0 THEN color1 END AS spot FROM item), l AS (SELECT *, lag(spot) OVER (PARTITION BY folder ORDER BY ts, media_id) AS before FROM k)
SELECT media_id, before, spot FROM l WHERE spot IS NOT NULL AND spot IS DISTINCT FROM before""")
def place_changes(spark, d):
    """SEQ7, QRY22."""
    rows = items(spark, d).select("media_id", "folder", "ts", F.when(F.col("media_id") % 6 != 0, F.col("color1")).alias("spot"))
    return marks.place_transitions(rows, ["folder"], ["ts", "media_id"], "spot").select("media_id", "before", "spot")


@query(f"""WITH {ITEM_SQL}, k AS (SELECT media_id, folder, ts, CASE WHEN media_id % 9 <> 0 THEN 'w' || (media_id // 3) % 2 END AS label, CASE WHEN media_id % 5 <> 0 THEN value END AS temp FROM item),
g AS (SELECT *, count(*) FILTER (label IS NULL) OVER (PARTITION BY folder ORDER BY ts, media_id) AS stretch FROM k),
l AS (SELECT *, lag(label) OVER w AS before, last_value(temp IGNORE NULLS) OVER (PARTITION BY folder, stretch ORDER BY ts, media_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM g WHERE label IS NOT NULL WINDOW w AS (PARTITION BY folder, stretch ORDER BY ts, media_id))
SELECT media_id, label, round(temp, 2) AS temp FROM l WHERE label IS DISTINCT FROM before OR abs(temp - known) >= 40""")
def weather_changes(spark, d):
    """SEQ7, QRY22."""
    i = F.col("media_id")
    rows = items(spark, d).select("media_id", "folder", "ts", F.when(i % 9 != 0, F.concat(F.lit("w"), (F.floor(i / 3) % 2).cast("string"))).alias("label"), F.when(i % 5 != 0, F.col("value")).alias("temp"))
    found = marks.weather_transitions(rows, ["folder"], ["ts", "media_id"], "label", "temp", 40)
    return found.select("media_id", "label", F.round("temp", 2).alias("temp"))


_AWAY = lambda a, b: _HAV.format(a=a, b=b, c="o.lat", d="o.lon")


@query(f"""WITH RECURSIVE {ITEM_SQL}, f AS (SELECT folder, media_id, ts, lat, lon, row_number() OVER w AS r, count(*) OVER (PARTITION BY folder) AS n, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS dt FROM item WHERE lat IS NOT NULL WINDOW w AS (PARTITION BY folder ORDER BY ts, media_id)),
o AS (SELECT folder, media_id, lat, lon, r, r = n AS final, CASE WHEN dt > 0 THEN {_HAV.format(a="plat", b="plon", c="lat", d="lon")} / dt * 3.6 ELSE 0 END >= 20 AS moving FROM f),
e AS (SELECT folder, media_id, r, lat AS elat, lon AS elon, false AS resting, lat AS klat, lon AS klon, true AS kept FROM o WHERE r = 1
  UNION ALL SELECT folder, media_id, r, CASE WHEN emit THEN lat ELSE elat END, CASE WHEN emit THEN lon ELSE elon END, NOT moving, CASE WHEN keep THEN lat ELSE klat END, CASE WHEN keep THEN lon ELSE klon END, keep FROM (
    SELECT *, (emit OR final) AND away >= 150000 AS keep FROM (SELECT o.folder, o.media_id, o.r, o.lat, o.lon, o.moving, o.final, elat, elon, klat, klon, {_AWAY("klat", "klon")} AS away,
      CASE WHEN o.moving THEN {_AWAY("elat", "elon")} >= 150000 ELSE NOT resting END AS emit FROM e JOIN o ON o.folder = e.folder AND o.r = e.r + 1)))
SELECT folder, media_id FROM e WHERE kept""")
def emission_fold(spark, d):
    """SEQ11, QRY23."""
    rows = items(spark, d).select("folder", "media_id", "ts", "lat", "lon")
    return marks.emitted(rows, ["folder"], "ts", "media_id", "lat", "lon", 150_000, 20).select("folder", "media_id")


@query(f"WITH {ITEM_SQL} SELECT media_id, strftime(ts + to_milliseconds(((media_id * 13) % 90) * 100), '%Y-%m-%d %H:%M:%S') AS at FROM item WHERE duration_s > 0")
def mark_times(spark, d):
    """D10."""
    from caravel.functions.time import mark_time

    return items(spark, d).where("duration_s > 0").select("media_id", _stamp(mark_time("ts", ((F.col("media_id") * 13) % 90) / 10.0)).alias("at"))


@query(f"""WITH {ITEM_SQL}, {EAV_SQL}, p AS (SELECT province, max(ts) AS t FROM item WHERE duration_s > 0 GROUP BY 1), a AS (SELECT item.province, media_id, kind, ts, end_ts FROM item JOIN p ON item.province IS NOT DISTINCT FROM p.province AND ts <= t AND end_ts >= t AND epoch_us(t) - epoch_us(ts) <= 43200000000),
l AS (SELECT province, CASE kind WHEN 'image' THEN 'visual' WHEN 'video' THEN 'visual' WHEN 'audio' THEN 'auditory' ELSE 'textual' END AS layer, media_id FROM a UNION ALL SELECT province, 'metadata:' || key, media_id FROM a JOIN eav USING (media_id))
SELECT province, layer, count(*)::BIGINT AS n, min(media_id) AS first FROM l GROUP BY ALL""")
def layers_at(spark, d):
    """DOC5, DOC9, DOC11: of each province, what covers the instant at which its last item with a length begins, layer by layer, among starts of the twelve hours before it; and these items' attributes."""
    item = items(spark, d)
    instants = item.where("duration_s > 0").groupBy("province").agg(F.max("ts").alias("t")).select(F.col("province").alias("_p"), "t")
    covers = F.col("province").eqNullSafe(F.col("_p")) & (F.col("ts") <= F.col("t")) & (F.col("end_ts") >= F.col("t")) & (F.unix_micros("t") - F.unix_micros("ts") <= 43_200_000_000)
    active = item.join(instants, covers).select("province", "media_id", "kind")
    layer = F.when(F.col("kind").isin("image", "video"), "visual").when(F.col("kind") == "audio", "auditory").otherwise("textual")
    kinds = active.select("province", layer.alias("layer"), "media_id")
    known = active.join(attributes(item), "media_id").select("province", F.concat(F.lit("metadata:"), "key").alias("layer"), "media_id")
    return kinds.unionByName(known).groupBy("province", "layer").agg(F.count("*").alias("n"), F.min("media_id").alias("first"))


@query(f"""WITH {ITEM_SQL}, m AS (SELECT folder, ts, media_id AS message FROM item WHERE kind = 'text'), b AS (SELECT i.media_id, i.ts, m.ts AS t0, m.message AS m0 FROM item i ASOF LEFT JOIN m ON i.folder = m.folder AND i.ts >= m.ts WHERE i.kind = 'image'),
f AS (SELECT i.media_id, m.ts AS t1, m.message AS m1 FROM item i ASOF LEFT JOIN m ON i.folder = m.folder AND i.ts <= m.ts WHERE i.kind = 'image'), g AS (SELECT media_id, m0, m1, epoch_us(ts) - epoch_us(t0) AS d0, epoch_us(t1) - epoch_us(ts) AS d1 FROM b JOIN f USING (media_id))
SELECT media_id, CASE WHEN d0 <= 43200000000 AND (d1 IS NULL OR d0 <= d1) THEN m0 WHEN d1 <= 43200000000 THEN m1 END AS message FROM g""")
def nearest_message(spark, d):
    """DOC13: the nearest message of the folder within twelve hours, of equally near ones the earlier."""
    item = items(spark, d)
    messages = item.where("kind = 'text'").select("folder", "ts", F.col("media_id").alias("message"))
    rows = ordered.asof(item.where("kind = 'image'").select("media_id", "folder", "ts"), messages, "ts", F.struct("ts", "message"), ["folder"], ahead=True)
    back, forth, most = F.unix_micros("ts") - F.unix_micros("prev.ts"), F.unix_micros("next.ts") - F.unix_micros("ts"), 43_200_000_000
    pick = F.when((back <= most) & (forth.isNull() | (back <= forth)), F.col("prev.message")).when(forth <= most, F.col("next.message"))
    return rows.select("media_id", pick.alias("message"))


@query(f"""WITH {ITEM_SQL}, c AS (SELECT media_id, CASE WHEN media_id % 4 = 0 THEN place END AS a, CASE WHEN media_id % 3 = 0 THEN province END AS b, CASE WHEN media_id % 2 = 0 THEN kind END AS c FROM item)
SELECT media_id, coalesce(a, b, c) AS author, CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 WHEN c IS NOT NULL THEN 3 END AS source FROM c""")
def source_cascade(spark, d):
    """D3, DOC14."""
    of = lambda n, c: F.when(F.col("media_id") % n == 0, F.col(c))
    return items(spark, d).select("media_id", metadata.first_known(of(4, "place"), of(3, "province"), of(2, "kind")).alias("x")).select("media_id", F.col("x.value").alias("author"), "x.source")


# --- sounds and scenes --------------------------------------------------------------------------


@query("""WITH s AS (SELECT l_orderkey AS id, l_linenumber AS n, l_quantity AS start, l_discount * 100 AS dur FROM lineitem), t AS (SELECT *, CASE WHEN dur <= 0 THEN 1 ELSE greatest(1, least(10, floor(dur)::INT + 1)) END AS k FROM s)
SELECT id, n, i::INT AS i, CASE WHEN dur <= 0 THEN start ELSE round(start + dur * i / k, 1) END AS at FROM (SELECT *, unnest(range(k)) AS i FROM t)""")
def scene_samples(spark, d):
    """SEQ19."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.posexplode(audio.uniform_samples(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") * 100)).alias("i", "at"))
    return rows


@query("""WITH w AS (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(0, len(embedding) - 8 + 1, 2)) AS i FROM embeddings) SELECT vec_id, i::INT AS start, round(sqrt(list_sum(list_transform(v[i + 1:i + 8], lambda x: x * x)) / 8), 6) AS energy FROM w""")
def sound_energies(spark, d):
    """SEQ20: vectors stand for samples."""
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(audio.energies("embedding", 8, 2)).alias("i", "e"))
    return rows.select("vec_id", (F.col("i") * 2).alias("start"), F.round("e", 6).alias("energy"))


@query("""WITH q AS (SELECT vec_id AS a, label, embedding[5:20]::DOUBLE[] AS s FROM embeddings WHERE vec_id % 100 = 0), qa AS (SELECT a, label, list_transform(s, lambda x: x - list_avg(s)) AS s FROM q),
b AS (SELECT vec_id AS b, label, embedding::DOUBLE[] AS v FROM embeddings), ba AS (SELECT b, label, list_transform(v, lambda x: x - list_avg(v)) AS v FROM b),
p AS (SELECT a, b, s, v, unnest(range(len(v) - 15)) AS i FROM qa JOIN ba USING (label) WHERE a <> b), c AS (SELECT a, b, i, list_dot_product(s, v[i + 1:i + 16]) / sqrt(list_dot_product(v[i + 1:i + 16], v[i + 1:i + 16]) * list_dot_product(s, s)) AS x FROM p)
SELECT a, b, round(max(x), 4) AS similarity FROM c GROUP BY a, b""")
def sound_matches(spark, d):
    """SEQ21: a stretch of every vector whose id is divisible by 100 against all others of its label."""
    e = table(spark, d, "embeddings")
    short = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("a"), "label", F.slice("embedding", 5, 16).alias("s"))
    long = e.select(F.col("vec_id").alias("b"), "label", F.col("embedding").alias("v"))
    return audio.best_matches(short, long, "label").select("a", "b", F.round("similarity", 4).alias("similarity"))


@query(f"WITH {ITEM_SQL}, w AS (SELECT media_id, duration_s, unnest(range(least(30, CAST(ceil(duration_s / 10.0) AS BIGINT)))) AS i FROM item WHERE duration_s > 0) SELECT media_id, i * 10.0::DOUBLE AS start, least((i + 1) * 10, duration_s)::DOUBLE AS stop FROM w")
def sound_windows(spark, d):
    """SEQ22."""
    return items(spark, d).select("media_id", F.explode(audio.tumbling("duration_s")).alias("w")).select("media_id", "w.start", F.col("w.end").alias("stop"))


@query("""WITH w AS (SELECT l_orderkey AS id, l_linenumber AS n, l_quantity AS a, l_quantity + l_discount * 50 AS b FROM lineitem), r AS (SELECT *, floor(a / 2.5)::INT + 1 AS x, floor((b - 0.000001) / 2.5)::INT + 1 AS y FROM w)
SELECT id, n, unnest(range(x, greatest(x, y) + 1))::INT AS frame FROM r""")
def window_frames(spark, d):
    """JN20."""
    a = F.col("l_quantity").cast("double")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.explode(audio.frames(a, a + F.col("l_discount").cast("double") * 50, 2.5)).alias("frame"))


@query("""WITH s AS (SELECT l_orderkey AS id, l_returnflag || l_linestatus AS label, sum(round(l_discount * 100)::BIGINT)::BIGINT AS total FROM lineitem GROUP BY ALL)
SELECT id, label, total, (row_number() OVER (PARTITION BY id ORDER BY total DESC, label))::INT AS rank FROM s QUALIFY rank <= 2""")
def sound_labels(spark, d):
    """AG19, JOB18."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("label"), F.round(F.col("l_discount") * 100).cast("long").alias("p"))
    return audio.top_labels(rows, "id", "label", "p", 2).select("id", "label", "total", F.col("rank").cast("int").alias("rank"))


@query("""WITH RECURSIVE t AS (SELECT l_orderkey AS id, l_linenumber AS line, l_quantity::DOUBLE AS seconds, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS r FROM lineitem WHERE l_quantity > 0 QUALIFY r <= 18),
p AS (SELECT id, 0 AS r, NULL::BIGINT AS line, NULL::DOUBLE AS start, NULL::DOUBLE AS length, 0.0::DOUBLE AS upto FROM t WHERE r = 1
  UNION ALL SELECT id, r, line, CASE WHEN a < 90 THEN a END, CASE WHEN a < 90 THEN least(seconds, 90 - a) END, CASE WHEN a < 90 THEN a + least(seconds, 90 - a) ELSE a END FROM (
    SELECT t.id, t.r, t.line, t.seconds, CASE WHEN t.r > 1 AND p.upto + 3 <= 90 THEN p.upto + 3 ELSE p.upto END AS a FROM p JOIN t ON t.id = p.id AND t.r = p.r + 1))
SELECT id, line, start, length FROM p WHERE start IS NOT NULL""")
def sound_schedule(spark, d):
    """SEQ23, STR5: a list within 90 seconds with 3 of silence."""
    line = F.struct(F.col("l_linenumber").cast("long").alias("id"), F.col("l_quantity").cast("double").alias("seconds"))
    lists = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(line)).alias("xs"))
    return lists.select("id", F.explode(audio.schedule(F.col("xs"), 90.0, 3.0)).alias("p")).select("id", F.col("p.id").alias("line"), "p.start", "p.length")


@query(f"""WITH {ITEM_SQL}, c AS (SELECT media_id, (media_id * 7919) % 90000000 AS bitrate, CASE media_id % 4 WHEN 0 THEN 24.0::DOUBLE WHEN 3 THEN NULL ELSE 29.97::DOUBLE END AS fps, ((media_id % 12) - 4)::DOUBLE AS hours FROM item)
SELECT media_id, CASE WHEN fps IS NULL THEN 'desconocida' WHEN fps = 24 AND bitrate BETWEEN 35000000 AND 55000000 THEN 'B (fps cambiado)' WHEN fps > 29 AND bitrate >= 55000000 THEN 'A (LA +7h)' WHEN fps > 29 AND bitrate > 25000000 THEN 'B (UTC+1 −1h)' ELSE 'desconocida' END AS camera,
  CASE WHEN hours < 0 THEN '-' ELSE '+' END || abs(hours)::INT || '.0h' AS clock FROM c""")
def camera_clocks(spark, d):
    """SEQ25, M17, JOB26."""
    i = F.col("media_id")
    fps = F.when(i % 4 == 0, 24.0).when(i % 4 != 3, 29.97)
    named = F.timestamp_micros(F.unix_micros("ts") - ((i % 12) - 4) * 3_600_000_000)
    return items(spark, d).select("media_id", metadata.camera_class((i * 7919) % 90_000_000, fps).alias("camera"), metadata.signed_hours(metadata.clock_offset("ts", named)).alias("clock"))


# --- words and names ----------------------------------------------------------------------------


@query(r"""WITH w AS (SELECT DISTINCT lower(unnest(string_split(text, ' '))) AS w FROM documents) SELECT w AS word FROM w WHERE length(w) < 3 OR regexp_matches(w, 'g[eé]nero fotogr[aá]fico|elige una|deben describir|no incluyas|ejemplo|ning[uú]n otro texto|separa|palabra clave|this is|spanish|primera palabra|^\.\.\.$|no inventes|separ[aá]las|no incluesas|^sa_\d+$|^dsc\d+|^\d+x\d+$|^\d+\s*[a-z]') OR w IN ('que', 'the')""")
def junk_words(spark, d):
    """S3."""
    words = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("w")).select(F.lower("w").alias("word")).distinct()
    return words.where(text.is_junk("word", ("que", "the")))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(p_name, '\bred\b', 'rojo', 'gi'), '\bsteel\b', 'acero', 'gi') AS name FROM part""")
def word_replacements(spark, d):
    """S20."""
    return table(spark, d, "part").select("p_partkey", text.replaced_words("p_name", {"red": "rojo", "steel": "acero"}).alias("name"))


@query("""WITH e AS (SELECT lower(trim(p_type)) AS key, p_brand AS value, p_size % 3 AS priority, p_partkey AS pos FROM part) SELECT key, value, priority FROM e WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY priority DESC, pos DESC) = 1""")
def glossary_merge(spark, d):
    """S21: of entries for a key that of the highest origin, and of those the latest."""
    e = table(spark, d, "part").select(F.lower(F.trim("p_type")).alias("key"), F.col("p_brand").alias("value"), (F.col("p_size") % 3).alias("priority"), F.col("p_partkey").alias("at"))
    best = e.where("key <> ''").groupBy("key").agg(F.max(F.struct("priority", "at", "value")).alias("b"))
    return best.select("key", "b.value", "b.priority")


@query("""WITH t AS (SELECT p_brand, unnest(string_split(lower(p_name), ' ')) AS token FROM part) SELECT token, count(*)::BIGINT AS n, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS brands FROM t WHERE token <> '' GROUP BY 1""")
def token_contexts(spark, d):
    """AG27: brands are a fixed set, so the list stays short."""
    t = table(spark, d, "part").select("p_brand", F.explode(F.split(F.lower("p_name"), " ")).alias("token")).where("token <> ''")
    return t.groupBy("token").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))


@query("""WITH n AS (SELECT DISTINCT p_name FROM part), t AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS t FROM part WHERE p_name <> '') SELECT t, p_name AS o FROM t JOIN n ON len(list_distinct(string_split(p_name, ' '))) > 1 AND t <> '' AND list_contains(string_split(p_name, ' '), t)""")
def token_subsets(spark, d):
    """S17, JN18: a part meets the names that hold its first word, then all its words are looked for."""
    names = table(spark, d, "part").select("p_name").distinct()
    parts = table(spark, d, "part").select(F.get(F.split("p_name", " "), 0).alias("t")).where("t <> ''").distinct()
    held = names.select(F.col("p_name").alias("o"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("t"))
    return parts.join(held, "t").where(text.is_token_subset("t", "o")).select("t", "o")


@query(f"""WITH {ITEM_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, round(lat, 0) AS cy, round(lon, 0) AS cx, hour(ts)::INT AS hour, count(*)::BIGINT AS n, min(media_id) AS first FROM item WHERE lat IS NOT NULL GROUP BY ALL""")
def day_cells(spark, d):
    """AG15, as a row for each hour of a cell's day, so that no list grows with the cell."""
    cy, cx = geo.cell("lat", "lon", 0)
    rows = items(spark, d).where("lat is not null")
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), cy.alias("cy"), cx.alias("cx"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.min("media_id").alias("first"))


@query("""WITH s AS (SELECT event_id, event_type, unnest(range(4)) AS i FROM events), k AS (SELECT *, -(event_id + i) % 12 / 10.0 >= -0.8 AND (event_id + i) % 4 >= 1.5 AS ok FROM s)
SELECT event_id, coalesce(string_agg(event_type || ' ' || i, ' ' ORDER BY i) FILTER (ok), '') AS transcript, (count(*) FILTER (ok))::INT AS kept, CASE WHEN bool_or(ok) THEN 'ok' ELSE 'sin_voz' END AS state FROM k GROUP BY 1""")
def segment_filter(spark, d):
    """FLT12, S13, S30."""
    def piece(i):
        n = F.col("event_id") + i
        return F.struct(F.lit(i * 2.0).alias("start"), (F.lit(i * 2.0) + n % 4).alias("end"), F.concat(F.col("event_type"), F.lit(f" {i} ")).alias("text"), (-(n % 12) / 10).alias("logprob"), F.lit(0.1).alias("no_speech"), F.when(F.col("event_id") % 3 != 0, 1.5).alias("compression"))

    rows = table(spark, d, "events").select("event_id", F.array(*[piece(i) for i in range(4)]).cast(text.SEGMENT).alias("s"))
    return rows.select("event_id", text.transcript(text.good_segments(F.col("s"))).alias("transcript"), F.size(text.good_segments(F.col("s"))).alias("kept"), text.voice_state(F.col("s")).alias("state"))


_DAY_COLORS = [(10 * h, 250 - 10 * h, (h * 37) % 256) for h in range(24)]


@query(f"""WITH {ITEM_SQL}, h AS (SELECT media_id, hour(ts) + minute(ts) / 60.0::DOUBLE AS x FROM item), p AS (SELECT media_id, x - floor(x) AS t, floor(x)::INT AS a, (floor(x)::INT + 1) % 24 AS b FROM h)
SELECT media_id, floor(10 * a + (10 * b - 10 * a) * t + 0.5)::INT AS r, floor(250 - 10 * a + (10 * a - 10 * b) * t + 0.5)::INT AS g, floor((a * 37) % 256 + ((b * 37) % 256 - (a * 37) % 256) * t + 0.5)::INT AS b FROM p""")
def hour_colors(spark, d):
    """M19."""
    return items(spark, d).select("media_id", color.of_hour(F.hour("ts") + F.minute("ts") / 60.0, _DAY_COLORS).alias("c")).select("media_id", "c.*")


# --- bursts -------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {ITEM_SQL}, o AS (SELECT folder, media_id, ts, value, row_number() OVER (PARTITION BY folder ORDER BY ts, media_id) AS r FROM item),
b AS (SELECT folder, media_id, ts, value, r, ts AS first, 0 AS burst FROM o WHERE r = 1 UNION ALL
  SELECT o.folder, o.media_id, o.ts, o.value, o.r, CASE WHEN epoch_us(o.ts) - epoch_us(b.first) > 86400000000 THEN o.ts ELSE b.first END, b.burst + CASE WHEN epoch_us(o.ts) - epoch_us(b.first) > 86400000000 THEN 1 ELSE 0 END FROM b JOIN o ON o.folder = b.folder AND o.r = b.r + 1)
SELECT media_id, burst::BIGINT AS burst, row_number() OVER (PARTITION BY folder, burst ORDER BY coalesce(value, 0) DESC, media_id) = 1 AS kept FROM b""")
def burst_cleaning(spark, d):
    """SET13 by time, SEQ13, SRT8: the best item of a burst stays."""
    rows = items(spark, d).select("folder", "ts", "media_id", F.coalesce("value", F.lit(0.0)).alias("value"))
    grouped = ordered.anchored_groups(rows, ["folder"], "ts", 86_400, "media_id")
    best = grouped.groupBy("folder", "burst").agg(F.min(F.struct((-F.col("value")).alias("v"), "media_id")).alias("b"))
    return grouped.join(best, ["folder", "burst"]).select("media_id", F.col("burst").cast("long").alias("burst"), (F.col("media_id") == F.col("b.media_id")).alias("kept"))


@query(f"""WITH {ITEM_SQL}, a AS (SELECT media_id, province, ts, end_ts FROM item WHERE kind = 'video' AND province IS NOT NULL), b AS (SELECT media_id, province, ts, end_ts FROM item WHERE kind = 'audio')
SELECT a.media_id AS video, count(*)::BIGINT AS n, min(b.media_id) AS first FROM a JOIN b USING (province) WHERE a.ts <= b.end_ts AND a.end_ts >= b.ts GROUP BY 1""")
def videos_with_sound(spark, d):
    """DOC2, JN20: sounds that overlap a video of their province."""
    i = items(spark, d).where("province is not null")
    a = i.where("kind = 'video'").select(F.col("media_id").alias("video"), "province", F.col("ts").alias("a0"), F.col("end_ts").alias("a1"))
    b = i.where("kind = 'audio'").select("media_id", "province", F.col("ts").alias("b0"), F.col("end_ts").alias("b1"))
    return intervals.overlaps(a, b, ("a0", "a1"), ("b0", "b1"), by=["province"]).groupBy("video").agg(F.count("*").alias("n"), F.min("media_id").alias("first"))


@query(f"""WITH RECURSIVE {ITEM_SQL}, o AS (SELECT folder, media_id, [color1, color2, color3] AS tags, row_number() OVER (PARTITION BY folder ORDER BY media_id) AS r FROM item),
b AS (SELECT folder, media_id, r, media_id AS leader, [{{'id': media_id, 'tags': tags}}] AS leaders FROM o WHERE r = 1
  UNION ALL SELECT folder, media_id, r, coalesce(hit, media_id), CASE WHEN hit IS NULL THEN list_append(leaders, {{'id': media_id, 'tags': tags}}) ELSE leaders END FROM (SELECT o.folder, o.media_id, o.r, o.tags, leaders, (list_filter(leaders, lambda l: len(list_intersect(l.tags, o.tags)) >= 2)[1]).id AS hit FROM b JOIN o ON o.folder = b.folder AND o.r = b.r + 1))
SELECT folder, media_id, leader FROM b""")
def tag_leaders(spark, d):
    """SET11: items of a folder by two shared colours."""
    rows = items(spark, d).select("folder", "media_id", F.array("color1", "color2", "color3").alias("tags"))
    return dedup.leader_clusters(rows, ["folder"], "media_id", "tags", dedup.TagLeaders, 2).select("folder", "media_id", "leader")


@query(f"""WITH RECURSIVE {ITEM_SQL}, o AS (SELECT folder, media_id, ts, row_number() OVER (PARTITION BY folder ORDER BY ts, media_id) AS r FROM item),
b AS (SELECT folder, media_id, ts, r, ts AS first, 0 AS burst FROM o WHERE r = 1 UNION ALL
  SELECT o.folder, o.media_id, o.ts, o.r, CASE WHEN epoch_us(o.ts) - epoch_us(b.first) > 172800000000 THEN o.ts ELSE b.first END, b.burst + CASE WHEN epoch_us(o.ts) - epoch_us(b.first) > 172800000000 THEN 1 ELSE 0 END FROM b JOIN o ON o.folder = b.folder AND o.r = b.r + 1),
t AS (SELECT b.folder, burst, media_id, [color1, color2, color3] AS tags, CASE WHEN media_id % 3 > 0 THEN value END AS score, row_number() OVER (PARTITION BY b.folder, burst ORDER BY media_id) AS q FROM b JOIN item USING (media_id)),
l AS (SELECT folder, burst, media_id, q, score, media_id AS leader, [{{'id': media_id, 'tags': tags}}] AS leaders FROM t WHERE q = 1
  UNION ALL SELECT folder, burst, media_id, q, score, coalesce(hit, media_id), CASE WHEN hit IS NULL THEN list_append(leaders, {{'id': media_id, 'tags': tags}}) ELSE leaders END FROM (SELECT t.*, leaders, (list_filter(leaders, lambda x: len(list_intersect(x.tags, t.tags)) >= 1)[1]).id AS hit FROM l JOIN t ON t.folder = l.folder AND t.burst = l.burst AND t.q = l.q + 1)),
g AS (SELECT *, row_number() OVER (PARTITION BY folder, burst, leader ORDER BY coalesce(score, 0) DESC, media_id) AS place, count(score) OVER (PARTITION BY folder, burst, leader) AS rated FROM l)
SELECT media_id, burst::BIGINT AS burst, leader, rated = 0 OR place = 1 AS kept, CASE WHEN rated = 0 THEN 'unrated' WHEN place = 1 THEN 'best' ELSE 'worse' END AS reason FROM g""")
def burst_selection(spark, d):
    """SET13 by tags, SRT8: of pictures of two days that share a colour with the group's first one, the best; every third evaluation failed."""
    rows = items(spark, d).select("folder", "media_id", "ts", F.array("color1", "color2", "color3").alias("tags"), F.when(F.col("media_id") % 3 > 0, F.col("value")).alias("score"))
    found = bursts.selection(rows, ["folder"], "ts", "media_id", "score", 172_800, [("tags", dedup.TagLeaders, 1)])
    return found.select("media_id", "burst", "leader", "kept", "reason")


@query(f"""WITH {ITEM_SQL}, e AS (SELECT folder, end_ts, max(media_id) AS last FROM item GROUP BY ALL) SELECT media_id, e.last AS before FROM item i ASOF LEFT JOIN e ON i.folder = e.folder AND i.ts > e.end_ts""")
def ended_before(spark, d):
    """DOC4: the item of the folder that ended last before each one began, of several that ended together the one of the greatest id."""
    item = items(spark, d)
    ends = item.select("folder", F.col("end_ts").alias("ts"), F.col("media_id").alias("before"))
    return ordered.asof(item.select("media_id", "folder", "ts"), ends, "ts", F.col("before"), ["folder"], strict=True, right_order=["before"]).select("media_id", F.col("prev").alias("before"))
