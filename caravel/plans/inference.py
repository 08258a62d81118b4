"""What the archive infers from its tracks, as plans with their SQL. Imported for its registrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.functions import geo, time
from caravel.operators import audit, chat, dedup, history, intervals, names, ordered, vector_index
from caravel.plans import steps
from caravel.plans.queries import _HAV, query
from caravel.plans.views import ITEM_SQL, items, table


def pass_times(items_: DataFrame, points: DataFrame, item: tuple[str, str, str], point: tuple[str, str, str, str, str], metres: float = 2000.0, hours: float = 2.0, degrees: float = 1.0) -> DataFrame:
    """JN14, D11. (item key, at, metres, same_pass): when a track passed each item, by the two points nearest to it.

    ``item`` is (key, lat, lon), ``point`` (key, track, time, lat, lon). Where the two points are more than ``hours`` apart, the track came by twice: the second
    one gives way to the first one's neighbour on its own track, the nearer of the two (of equally near ones the earlier). The instant lies between both, weighted by
    the other's distance. Points carry their neighbours, found in buckets of time, so an item never meets a whole track. No row for items without a
    position; a null instant if the nearest point is farther than ``metres``, or if there is one point only.
    """
    ik, ia, io = item
    pk, track, ts, pa, po = point
    known = points.where(F.col(ts).isNotNull() & F.col(pa).isNotNull() & F.col(po).isNotNull())
    place = F.struct(F.col(ts).alias("t"), F.col(pa).alias("lat"), F.col(po).alias("lon"))
    carried = ordered.with_neighbours(known, [ts, pk], place, [track], ahead=True, names=("_earlier", "_later")).select(F.col(pk).alias("_p"), place.alias("_at"), "_earlier", "_later")
    near = intervals.nearest_points(items_, known, item, (pk, pa, po), 2, degrees).select(F.col(ik).alias("_i"), F.col(pk).alias("_p"), F.col("metres").alias("_m"), "rank")
    met = near.join(carried, "_p")
    of = lambda n: F.max(F.when(F.col("rank") == n, F.struct(F.col("_m").alias("m"), "_at", "_earlier", "_later")))
    pairs = met.groupBy("_i").agg(of(1).alias("a"), of(2).alias("b"))
    here = items_.select(F.col(ik).alias("_i"), F.col(ia).alias("_y"), F.col(io).alias("_x"))
    rows = pairs.join(here, "_i")
    away = lambda side: geo.haversine("_y", "_x", f"a.{side}.lat", f"a.{side}.lon")
    beside = lambda side: F.when(F.col(f"a.{side}").isNotNull(), F.struct(away(side).alias("m"), F.col(f"a.{side}.t").alias("t")))
    back, forth = beside("_earlier"), beside("_later")
    neighbour = F.when(back.isNotNull() & (forth.isNull() | (back["m"] <= forth["m"])), back).otherwise(forth)
    apart = F.abs(F.unix_micros("b._at.t") - F.unix_micros("a._at.t")) > int(hours * 3.6e9)
    second = F.when(apart & neighbour.isNotNull(), neighbour).otherwise(F.struct(F.col("b.m").alias("m"), F.col("b._at.t").alias("t")))
    rows = rows.withColumn("_second", second).withColumn("_same", ~F.coalesce(apart, F.lit(False)))
    at = time.between_places("a._at.t", "a.m", "_second.t", "_second.m", metres)
    # the first point decides whether the track came near at all
    return rows.select(F.col("_i").alias(ik), F.when(F.col("a.m") <= metres, at).alias("at"), F.col("a.m").alias("metres"), F.col("_same").alias("same_pass"))


def inferred_times(texts: DataFrame, points: DataFrame, mode: str = "skip", metres: float = 2000.0, hours: float = 2.0, degrees: float = 1.0) -> DataFrame:
    """QRY24. Texts (media_id, ts, lat, lon) with ``state`` and, where a time was inferred, ``ts`` and ``source``.

    Mode ``skip`` leaves texts that have a time; ``update`` infers anew where a track came near. States: has_time, no_position, too_far, inferred.
    """
    asked = texts.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.lit(mode == "update") | F.col("ts").isNull()))
    found = pass_times(asked, points, ("media_id", "lat", "lon"), ("point_id", "track", "ts", "plat", "plon"), metres, hours, degrees)
    rows = texts.join(found.select(F.col("media_id").alias("_i"), "at"), F.col("media_id") == F.col("_i"), "left").drop("_i")
    placeless = F.col("lat").isNull() | F.col("lon").isNull()
    state = F.when(F.col("at").isNotNull(), "inferred").when(F.col("ts").isNotNull(), "has_time").when(placeless, "no_position").otherwise("too_far")
    return rows.withColumn("state", state).withColumn("ts", F.coalesce("at", "ts")).withColumn("source", F.when(F.col("state") == "inferred", "track_interpolado")).drop("at")


# --- over the test tables ------------------------------------------------------------------------

_METRES, _HOURS = 20_000.0, 2.0


def _points(item: DataFrame) -> DataFrame:
    """Four tracks of every twentieth item; ids are far apart in space, so near points are mostly of different passes."""
    return item.where("media_id % 20 = 0 and lat is not null").select(F.col("media_id").alias("point_id"), (F.floor(F.col("media_id") / 20) % 4).alias("track"), "ts", F.col("lat").alias("plat"), F.col("lon").alias("plon"))


def _texts(item: DataFrame) -> DataFrame:
    """Texts, of which every third has a time."""
    return item.where("kind = 'text'").select("media_id", F.when(F.col("media_id") % 3 == 0, F.col("ts")).alias("ts"), "lat", "lon")


_TIMES_SQL = f"""{ITEM_SQL}, point AS (SELECT media_id AS point_id, (media_id // 20) % 4 AS track, ts, lat AS plat, lon AS plon FROM item WHERE media_id % 20 = 0 AND lat IS NOT NULL),
carried AS (SELECT *, lag({{'t': ts, 'y': plat, 'x': plon}}) OVER w AS e, lead({{'t': ts, 'y': plat, 'x': plon}}) OVER w AS l FROM point WINDOW w AS (PARTITION BY track ORDER BY ts, point_id)),
texts AS (SELECT media_id, CASE WHEN media_id % 3 = 0 THEN ts END AS ts, lat, lon FROM item WHERE kind = 'text'),
near AS (SELECT media_id, t.lat, t.lon, c.ts AS pt, e, l, {_HAV.format(a="lat", b="lon", c="plat", d="plon")} AS m, row_number() OVER (PARTITION BY media_id ORDER BY {_HAV.format(a="lat", b="lon", c="plat", d="plon")}, point_id) AS r FROM texts t, carried c WHERE t.ts IS NULL AND lat IS NOT NULL QUALIFY r <= 2),
pair AS (SELECT a.media_id, a.m AS m1, a.pt AS t1, b.m AS m2, b.pt AS t2, abs(epoch_us(a.pt) - epoch_us(b.pt)) > {int(_HOURS * 3.6e9)} AS apart, a.e.t AS et, a.l.t AS lt,
  {_HAV.format(a="a.lat", b="a.lon", c="a.e.y", d="a.e.x")} AS em, {_HAV.format(a="a.lat", b="a.lon", c="a.l.y", d="a.l.x")} AS lm FROM near a JOIN near b ON a.media_id = b.media_id AND a.r = 1 AND b.r = 2),
second AS (SELECT media_id, m1, t1, CASE WHEN NOT apart OR (et IS NULL AND lt IS NULL) THEN m2 WHEN et IS NOT NULL AND (lt IS NULL OR em <= lm) THEN em ELSE lm END AS m2, CASE WHEN NOT apart OR (et IS NULL AND lt IS NULL) THEN t2 WHEN et IS NOT NULL AND (lt IS NULL OR em <= lm) THEN et ELSE lt END AS t2 FROM pair),
inferred AS (SELECT media_id, CASE WHEN m1 + m2 = 0 THEN epoch_us(t1) ELSE trunc(epoch_us(t1) + (epoch_us(t2) - epoch_us(t1)) * (m1 / (m1 + m2)))::BIGINT END AS us FROM second WHERE m1 <= {_METRES}),
states AS (SELECT media_id, coalesce(make_timestamp(us), ts) AS ts, CASE WHEN us IS NOT NULL THEN 'inferred' WHEN ts IS NOT NULL THEN 'has_time' WHEN lat IS NULL THEN 'no_position' ELSE 'too_far' END AS state FROM texts LEFT JOIN inferred USING (media_id))"""


@query(f"WITH {_TIMES_SQL} SELECT media_id, strftime(ts, '%Y-%m-%d %H:%M') AS at, state, CASE WHEN state = 'inferred' THEN 'track_interpolado' END AS source FROM states")
def text_times(spark, d):
    """QRY24, JN14, D11."""
    item = items(spark, d)
    return inferred_times(_texts(item), _points(item), "skip", _METRES, _HOURS, 0.25).select("media_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), "state", "source")


@query(f"WITH {_TIMES_SQL} SELECT state, count(*)::BIGINT AS n, strftime(min(ts), '%Y-%m-%d') AS first FROM states GROUP BY 1")
def text_time_report(spark, d):
    """QRY24: what the job says of its texts."""
    item = items(spark, d)
    found = inferred_times(_texts(item), _points(item), "skip", _METRES, _HOURS, 0.25)
    return found.groupBy("state").agg(F.count("*").alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first"))


# --- names of places -----------------------------------------------------------------------------

_COMMON = ("irak", "mesa", "casa")


def _tags(item: DataFrame, nation: DataFrame) -> DataFrame:
    """Words of items: names of places, misspelt, cut, or of other places (nations are a table of fixed size)."""
    low, region = F.lower("place"), F.lower("province")
    others = nation.select(F.col("n_nationkey").cast("long").alias("_n"), F.lower("n_name").alias("_other"))
    item = item.withColumn("_n", F.floor(F.col("media_id") / 7) % 25).join(F.broadcast(others), "_n", "left")
    other = F.col("_other")
    word = {0: F.concat(low, F.lit("x")), 1: F.substring(low, 2, 100), 2: F.get(F.split(low, " "), 0), 4: region, 5: F.get(F.split(region, " "), 0)}
    tag = F.when(F.col("media_id") % 14 == 10, "buildin").when(F.col("media_id") % 7 == 3, "irak").when(F.col("media_id") % 7 == 6, F.concat(F.lit("q"), other))
    for n, c in word.items():
        tag = tag.when(F.col("media_id") % 7 == n, c)
    rows = item.select("media_id", "province", tag.alias("tag")).where("tag is not null")
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("province")).alias("provinces"))


def _names(item: DataFrame, customer: DataFrame) -> DataFrame:
    of = lambda c, kind: item.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("name")).agg(F.array_sort(F.collect_set("province")).alias("provinces")).select("name", F.lit(kind).alias("kind"), "provinces")
    points = customer.select(F.col("c_mktsegment").alias("name")).where("name is not null").distinct().select("name", F.lit("waypoint").alias("kind"), F.array().cast("array<string>").alias("provinces"))
    return of("place", "municipio").unionByName(of("province", "provincia")).unionByName(points)


_NORM = "regexp_replace(lower(strip_accents(trim({0}))), '\\s+', ' ', 'g')"


@query(f"""WITH {ITEM_SQL}, w AS (SELECT media_id, province, CASE WHEN media_id % 14 = 10 THEN 'buildin' WHEN media_id % 7 = 3 THEN 'irak' WHEN media_id % 7 = 6 THEN 'q' || lower(o.n_name) WHEN media_id % 7 = 0 THEN lower(place) || 'x' WHEN media_id % 7 = 1 THEN substr(lower(place), 2)
  WHEN media_id % 7 = 2 THEN split_part(lower(place), ' ', 1) WHEN media_id % 7 = 4 THEN lower(province) ELSE split_part(lower(province), ' ', 1) END AS tag FROM item LEFT JOIN nation o ON o.n_nationkey = (media_id // 7) % 25),
tag AS (SELECT tag, count(*) AS n, list(DISTINCT province) FILTER (province IS NOT NULL) AS tp, {_NORM.format("tag")} AS nt FROM w WHERE tag IS NOT NULL GROUP BY tag),
off AS (SELECT place AS name, 'municipio' AS kind, 1 AS pos, list(DISTINCT province) FILTER (province IS NOT NULL) AS op FROM item WHERE place IS NOT NULL GROUP BY 1 UNION ALL SELECT province, 'provincia', 3, list(DISTINCT province) FROM item WHERE province IS NOT NULL GROUP BY 1
  UNION ALL SELECT DISTINCT c_mktsegment, 'waypoint', 4, [] FROM customer WHERE c_mktsegment IS NOT NULL),
pair AS (SELECT tag, n, name, kind, pos, nt, nt IN {_COMMON} AS common, {_NORM.format("name")} AS no, levenshtein(nt, {_NORM.format("name")}) AS d, coalesce(len(op), 0) = 0 OR (len(tp) = 1 AND list_has_all(op, tp)) AS conc FROM tag, off WHERE length(nt) >= 3),
step AS (SELECT *, CASE WHEN d = 0 THEN 'A' WHEN d <= 2 AND conc THEN 'B' WHEN len(list_distinct(string_split(no, ' '))) > 1 AND list_has_all(string_split(no, ' '), string_split(nt, ' ')) AND conc THEN 'C' END AS step FROM pair WHERE NOT common),
best AS (SELECT tag, n, step, name, kind, CASE WHEN step = 'C' THEN len(string_split(no, ' ')) ELSE d END AS distance FROM step WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tag ORDER BY step, CASE WHEN step = 'C' THEN 0 ELSE d END, pos, name) = 1),
miss AS (SELECT tag, n, name, kind, d, concat_ws(' + ', CASE WHEN common THEN 'comun' END, CASE WHEN NOT conc THEN 'no concentrada' END) AS note FROM pair WHERE d <= 2 AND tag NOT IN (SELECT tag FROM best) QUALIFY row_number() OVER (PARTITION BY tag ORDER BY d, pos, name) = 1)
SELECT CASE step WHEN 'A' THEN 'exactos' WHEN 'B' THEN 'cercanos' ELSE 'token-subset' END AS section, tag, n::BIGINT AS n, name, kind, distance::INT AS distance, '' AS note FROM best
UNION ALL SELECT 'ambiguos', tag, n, name, kind, distance, '' FROM best WHERE step = 'C' AND kind = 'provincia'
UNION ALL SELECT 'propuesta', tag, n, lower(name), kind, distance, '' FROM best WHERE step <> 'A' AND kind <> 'provincia' AND tag <> 'chinax' AND lower(name) <> 'peru'
UNION ALL SELECT 'excluidos', tag, n, name, kind, d, note FROM miss WHERE note <> ''""")
def synonym_report(spark, d):
    """QRY16, JN18, AG27."""
    item = items(spark, d)
    tags = _tags(item, table(spark, d, "nation"))
    return names.synonym_report(tags, _names(item, table(spark, d, "customer")), _COMMON, {"chinax": "catay", "pirou": "peru"})


# --- concepts across kinds -----------------------------------------------------------------------


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, b.label AS kind, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.label <> b.label AND a.vec_id % 100 = 0)
SELECT a, b, kind, round(s, 5) AS similarity, (row_number() OVER (PARTITION BY a, kind ORDER BY s DESC, b))::INT AS rank FROM p WHERE s >= 0.15 QUALIFY rank <= 3""")
def concept_neighbours(spark, d):
    """DOC15: of every vector whose id is divisible by 100, the three nearest of every other kind, exactly."""
    index = vector_index.VectorIndex.build(table(spark, d, "embeddings"), "vec_id", "embedding", "label")
    found = index.search(F.col("id") % 100 == 0, 0.15, 3)
    return found.select("a", "b", "kind", F.round("similarity", 5).alias("similarity"), "rank")


@query()
def concept_groups(spark, d):
    """DOC15: groups of vectors of several kinds around their first one."""
    rows = table(spark, d, "embeddings")
    clusters = dedup.leader_clusters(rows, [], "vec_id", "embedding", dedup.CosineLeaders, 0.35)
    return vector_index.concepts(clusters, rows, "vec_id", "label")


# --- taking a batch back -------------------------------------------------------------------------


def _archive_before(item: DataFrame) -> DataFrame:
    return item.select("media_id", "alt", "place", F.lit(None).cast("string").alias("origin"))


def _written(before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The archive after altitudes were taken from a track, and after a second batch that corrects some, brings rows and deletes others."""
    filled = before.withColumn("origin", F.when(F.col("alt").isNull(), "track_gps").otherwise(F.col("origin"))).withColumn("alt", F.coalesce("alt", (F.col("media_id") % 500).cast("double")))
    corrected = filled.where("media_id % 77 <> 5").withColumn("alt", F.when(F.col("media_id") % 30 == 0, F.col("alt") + 1).otherwise(F.col("alt"))).withColumn("place", F.when(F.col("media_id") % 41 == 0, F.lit("somewhere")).otherwise(F.col("place")))
    new = before.where("media_id % 100 = 0").select((F.col("media_id") + 1_000_000_000).alias("media_id"), F.lit(7.0).alias("alt"), "place", F.lit("card").alias("origin"))
    return filled, corrected.unionByName(new)


def _log(before: DataFrame, filled: DataFrame, after: DataFrame) -> DataFrame:
    when = lambda s: F.timestamp_seconds(F.lit(s))
    return history.changes_of(before, filled, ["media_id"], 1, when(1_700_000_000)).unionByName(history.changes_of(filled, after, ["media_id"], 2, when(1_700_000_600)))


_WRITTEN_SQL = f"""{ITEM_SQL}, filled AS (SELECT media_id, alt AS old, coalesce(alt, (media_id % 500)::DOUBLE) AS alt, place, CASE WHEN alt IS NULL THEN 'track_gps' END AS origin FROM item),
late AS (SELECT media_id, alt + CASE WHEN media_id % 30 = 0 THEN 1 ELSE 0 END AS alt, CASE WHEN media_id % 41 = 0 THEN 'somewhere' ELSE place END AS place, origin, old FROM filled WHERE media_id % 77 <> 5),
new AS (SELECT media_id + 1000000000 AS media_id, 7.0::DOUBLE AS alt, place, 'card' AS origin FROM item WHERE media_id % 100 = 0)"""


@query(f"""WITH {_WRITTEN_SQL} SELECT 1 AS batch, '2023-11-14 22:13:20' AS at, count(*)::BIGINT AS n, 0::BIGINT AS inserted, count(*)::BIGINT AS updated, 0::BIGINT AS deleted FROM filled WHERE old IS NULL
UNION ALL SELECT 2, '2023-11-14 22:23:20', (i + u + x)::BIGINT, i, u, x FROM (SELECT (SELECT count(*) FROM new)::BIGINT AS i, (SELECT count(*) FROM late WHERE media_id % 30 = 0 OR (media_id % 41 = 0 AND place IS DISTINCT FROM (SELECT place FROM item WHERE item.media_id = late.media_id)))::BIGINT AS u, (SELECT count(*) FROM filled WHERE media_id % 77 = 5)::BIGINT AS x)""")
def batch_list(spark, d):
    """QRY18, AG7: what can be taken back."""
    before = _archive_before(items(spark, d))
    return history.batches(_log(before, *_written(before))).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {_WRITTEN_SQL} SELECT media_id, CASE WHEN old IS NULL AND media_id % 30 <> 0 THEN NULL ELSE alt END AS alt, place, NULL::VARCHAR AS origin FROM late UNION ALL SELECT * FROM new""")
def undo_track(spark, d):
    """QRY18, SNK5: a track's altitudes taken back from under a later batch; what that one wrote stays."""
    before = _archive_before(items(spark, d))
    filled, after = _written(before)
    return history.undone(after, _log(before, filled, after), ["media_id"], 1)


@query(f"""WITH {ITEM_SQL} SELECT media_id, alt, place, NULL::VARCHAR AS origin FROM item""")
def undo_all(spark, d):
    """QRY18, SNK6: both batches taken back, the last one first; the table is as it was."""
    before = _archive_before(items(spark, d))
    filled, after = _written(before)
    log = _log(before, filled, after)
    return history.undone(history.undone(after, log, ["media_id"], 2), log, ["media_id"], 1)


# --- chat windows --------------------------------------------------------------------------------


@query(f"""WITH {ITEM_SQL}, m AS (SELECT province, media_id, ts, (epoch_us(ts) - 10800000000) % 86400000000 AS h, row_number() OVER w AS n, count(*) OVER (PARTITION BY province) AS total FROM item WHERE kind = 'text' AND province IS NOT NULL WINDOW w AS (PARTITION BY province ORDER BY ts, media_id)),
p AS (SELECT DISTINCT province, unnest(range(24)) AS hour FROM m), b AS (SELECT p.province, hour, arg_min(n, least(abs(h - hour * 3600000000), 86400000000 - abs(h - hour * 3600000000)) * 1000000 + n) AS best, min(total) AS total FROM p JOIN m ON m.province = p.province GROUP BY 1, 2),
s AS (SELECT province, hour, least(best - 1, greatest(total - 12, 0)) AS start FROM b)
SELECT m.province, hour::INT AS hour, media_id, (n - start)::INT AS place FROM s JOIN m ON m.province = s.province AND n > start AND n <= start + 12""")
def chat_windows(spark, d):
    """SEQ24, STR5: twelve messages of each province's chat for every hour of the day."""
    chat_ = items(spark, d).where("kind = 'text' and province is not null").select("province", "media_id", "ts")
    probes = chat_.select("province").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return chat.windows(chat_, probes, ["province"], ["ts", "media_id"], "ts", "hour", 12).select("province", "hour", "media_id", "place")


# --- audits and results that are out of date -----------------------------------------------------

_WORDS = r"list_filter(string_split_regex(lower(trim(text)), '\s+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT {_WORDS} AS w FROM documents), h AS (SELECT unnest(range(1, least(len(w), 6) + 1)) AS words, w FROM w)
SELECT words::INT AS words, array_to_string(w[1:words], ' ') AS opening, count(*)::BIGINT AS n FROM h GROUP BY ALL HAVING count(*) >= 3""")
def beginning_tree(spark, d):
    """QRY17: beginnings that at least three texts share, up to six words."""
    return audit.openings(table(spark, d, "documents"), "text", 3, 6)


_PREFIXES = {"en": ("the ", "and the", "of "), "es": ("de ", "la ", "en ")}
_RESIDUES = (("the of, midst", "en", "the of", 2), ("que la, midst", "es", "que la", 2), ("anywhere", None, "nd the", 1))


def _descriptions(spark, d) -> DataFrame:
    """Texts as descriptions: an item has one of an even and one of an odd document."""
    docs = table(spark, d, "documents")
    return docs.select(F.floor(F.col("doc_id") / 2).alias("media_id"), F.when(F.col("doc_id") % 2 == 0, "en").otherwise("es").alias("key"), F.col("text").alias("value"))


@query("""WITH x AS (SELECT doc_id // 2 AS media_id, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'es' END AS key, text AS value, lower(trim(text)) AS low FROM documents),
p AS (SELECT *, CASE key WHEN 'en' THEN starts_with(low, 'the ') OR starts_with(low, 'and the') OR starts_with(low, 'of ') ELSE starts_with(low, 'de ') OR starts_with(low, 'la ') OR starts_with(low, 'en ') END AS pre FROM x),
i AS (SELECT media_id, coalesce(bool_or(key = 'en' AND pre), false) AS a, coalesce(bool_or(key = 'es' AND pre), false) AS b FROM p GROUP BY 1)
SELECT 'count' AS section, key AS name, count(*)::BIGINT AS n FROM p GROUP BY key UNION ALL SELECT 'prefix', key, count(*) FILTER (pre) FROM p GROUP BY key
UNION ALL SELECT 'residue', 'the of, midst', count(*) FILTER (key = 'en' AND strpos(lower(value), 'the of') > 1) FROM p UNION ALL SELECT 'residue', 'que la, midst', count(*) FILTER (key = 'es' AND strpos(lower(value), 'que la') > 1) FROM p
UNION ALL SELECT 'residue', 'anywhere', count(*) FILTER (strpos(lower(value), 'nd the') > 0) FROM p UNION ALL SELECT 'opener', o, count(*) FILTER (starts_with(low, o)) FROM p, (VALUES ('is '), ('to '), ('le ')) t(o) GROUP BY o
UNION ALL SELECT 'only', 'en', count(*) FILTER (a AND NOT b) FROM i UNION ALL SELECT 'only', 'es', count(*) FILTER (b AND NOT a) FROM i""")
def description_audit(spark, d):
    """QRY17: counts, prefixes, residues, legitimate openers, and which language lags behind."""
    return audit.description_audit(_descriptions(spark, d), _PREFIXES, _RESIDUES, ("is ", "to ", "le "))


_DERIVED = {"vision_es": ("vision_en",), "keywords": ("vision_es",), "embedding": ("keywords", "transcript"), "summary": ("embedding",)}


def _made(item: DataFrame) -> DataFrame:
    """Five results of every item, and transcripts of sounds."""
    of = lambda key, value: item.select("media_id", F.lit(key).alias("key"), value.alias("value"))
    out = of("vision_en", F.col("color1"))
    for key, c in (("vision_es", "color2"), ("keywords", "color3"), ("embedding", "place"), ("summary", "province")):
        out = out.unionByName(of(key, F.col(c)))
    return out.unionByName(of("transcript", F.col("event_type")).where("value = 'purchase'"))


_MADE_SQL = f"""{ITEM_SQL}, made AS (SELECT media_id, 'vision_en' AS key, color1 AS value FROM item UNION ALL SELECT media_id, 'vision_es', color2 FROM item UNION ALL SELECT media_id, 'keywords', color3 FROM item
  UNION ALL SELECT media_id, 'embedding', place FROM item UNION ALL SELECT media_id, 'summary', province FROM item UNION ALL SELECT media_id, 'transcript', event_type FROM item WHERE event_type = 'purchase')"""


@query(f"""WITH {_MADE_SQL}, redone AS (SELECT media_id, media_id % 5 = 0 AND media_id % 10 <> 0 AS seen, media_id % 7 = 0 AND event_type IS DISTINCT FROM 'purchase' OR media_id % 14 = 0 AS heard FROM item)
SELECT media_id, key, CASE WHEN key = 'vision_en' AND seen THEN 'new' WHEN key = 'transcript' AND media_id % 7 = 0 THEN CASE WHEN media_id % 14 = 0 THEN 'heard' ELSE 'purchase' END ELSE value END AS value FROM made JOIN redone USING (media_id)
WHERE NOT (seen AND key IN ('vision_es', 'keywords', 'embedding', 'summary')) AND NOT (heard AND key IN ('embedding', 'summary'))
UNION ALL SELECT media_id, 'transcript', CASE WHEN media_id % 14 = 0 THEN 'heard' ELSE 'purchase' END FROM item WHERE media_id % 7 = 0 AND event_type IS DISTINCT FROM 'purchase'""")
def stale_results(spark, d):
    """JOB6, JOB8, JOB19: pictures and sounds seen again; what was made from another result than before is gone, through all later steps."""
    item = items(spark, d)
    i = F.col("media_id")
    seen = item.where(i % 5 == 0).select("media_id", F.lit("vision_en").alias("key"), F.when(i % 10 == 0, F.col("color1")).otherwise("new").alias("value"))
    heard = item.where(i % 7 == 0).select("media_id", F.lit("transcript").alias("key"), F.when(i % 14 == 0, "heard").otherwise("purchase").alias("value"))
    return steps.enriched(_made(item), seen.unionByName(heard), _DERIVED, "update")
