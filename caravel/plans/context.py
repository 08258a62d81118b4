"""Context marks of clips: from the track that fits a clip best to what changes along it. Imported for its registrations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.functions import geo, sun
from caravel.operators import intervals, marks, ordered
from caravel.plans.queries import _HAV, _LIGHT, _SUN, query
from caravel.plans.views import ITEM_SQL, items
from caravel.session import cut_lineage

PREFIX = "contexto_"


def choose_tracks(clips: DataFrame, tracks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """JN13. (media_id, track_id, mode) of ``clips`` (media_id, t0, t1): the track that contains the clip in the least span, else overlaps it most, else is nearest;
    ``no_range`` and the first track where no track of its ``by`` has a range. No row where there is no track."""
    ranged = tracks.where(F.col("begins").isNotNull() & F.col("ends").isNotNull())
    best = intervals.best_interval(clips.select(*by, "media_id", "t0", "t1"), ranged, ("t0", "t1"), ("begins", "ends"), "media_id", "track_id", by).select("media_id", "track_id", "mode")
    keys = ordered.plain_keys(tracks, by)
    first = tracks.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.min("track_id").alias("track_id"))
    left = clips.join(best.select("media_id"), "media_id", "left_anti").select("media_id", *[c.alias(n) for n, c in ordered.plain_keys(clips, by).items()])
    rest = left.join(first, list(keys)) if keys else left.crossJoin(F.broadcast(first.where("track_id is not null")))
    return best.unionByName(rest.select("media_id", "track_id", F.lit("no_range").alias("mode")))


def samples(clips: DataFrame, every: int) -> DataFrame:
    """SEQ8. ``clips`` with ``offset_s`` and ``at``: every so many seconds from the start to the end, both included."""
    long = F.greatest(F.floor((F.unix_micros("t1") - F.unix_micros("t0")) / 1e6), F.lit(0))
    rows = clips.withColumn("offset_s", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(long, F.lit(0)), F.lit(every).cast("long"))))
    return rows.withColumn("at", F.timestamp_micros(F.unix_micros("t0") + F.col("offset_s") * 1_000_000))


def positions(rows: DataFrame, timed: DataFrame, untimed: DataFrame) -> DataFrame:
    """SEQ10, SEQ12. Samples with ``p``: (lat, lon, ele, source) between the two points of their track around them, else at their share of the clip along the
    track's points without time, else of the clip itself.

    ``timed``: track_id, seq, ts, lat, lon, ele. ``untimed``: track_id, seq, lat, lon, ele; the n-th of them is found by its rank, so a sample meets
    one point and not its track.
    """
    place = F.struct("lat", "lon", "ele")
    steps = ordered.with_neighbours(timed.select("track_id", "seq", F.col("ts").alias("at"), "lat", "lon", "ele"), ["at", "seq"], F.struct("at", place.alias("b")), ["track_id"], back=False, ahead=True, names=("", "_to"))
    got = ordered.asof(rows, steps, "at", F.struct("at", place.alias("a"), "_to"), ["track_id"], strict=True).withColumnRenamed("prev", "_on")
    span = F.unix_micros("_on._to.at") - F.unix_micros("_on.at")
    track = F.when(F.col("_on._to").isNotNull(), marks.along(F.col("_on.a"), F.col("_on._to.b"), (F.unix_micros("at") - F.unix_micros("_on.at")) / span))
    block = F.floor(F.col("seq") / 100_000)
    numbered = ordered.running_sums(untimed, ["seq"], {"_rank": F.lit(1)}, ["track_id"], block)
    numbered = ordered.with_neighbours(numbered, ["seq"], place, ["track_id"], block, back=False, ahead=True, names=("", "_to"))
    points = numbered.select("track_id", (F.col("_rank") - 1).alias("_i"), place.alias("_a"), F.coalesce("_to", place).alias("_b"))
    counts = untimed.groupBy("track_id").agg(F.count("*").alias("_n")).where("_n > 1")
    long = (F.unix_micros("t1") - F.unix_micros("t0")) / 1e6
    share = F.when(long > 0, F.col("offset_s") / long) * (F.col("_n") - 1)
    at = got.join(counts, "track_id", "left").withColumn("_f", share).withColumn("_i", F.floor("_f")).join(points, ["track_id", "_i"], "left")
    estimate = F.when(F.col("_a").isNotNull(), marks.along(F.col("_a"), F.col("_b"), F.col("_f") - F.col("_i")))
    own = F.struct("lat", "lon", F.col("alt").alias("ele"))
    return at.withColumn("p", marks.position_cascade(track, estimate, own)).select(*[F.col(f"`{c}`") for c in rows.columns], "p")


def transitions(found: DataFrame, places: DataFrame, weather: DataFrame, coarse_every: float = 300, elevation: float = 50.0, movement: float = 5.0, temperature: float = 5.0, decimals: tuple[int, int] = (3, 1)) -> DataFrame:
    """SEQ4-SEQ7, SEQ9. (media_id, offset_s, at, key, value, source): what changes along clips, of samples (media_id, offset_s, at, lat, lon, ele, source).

    ``places``: lat, lon (rounded to the first of ``decimals``), place; ``weather``: day, lat, lon (rounded to the second), hour, label, temperature. An unknown
    position resets light, motion, place and weather.
    """
    key, order = ["media_id"], ["offset_s"]
    mark = lambda df, name, value: df.select("media_id", "offset_s", "at", F.lit(PREFIX + name).alias("key"), value.alias("value"), "source")
    # offsets are cut into days, as a clip of any length is
    block = F.floor(F.col("offset_s") / 86_400)
    # height, light and motion in one stream of samples; a light that is unknown resets
    lit = found.withColumn("_light", sun.twilight(sun.elevation("at", "lat", "lon")))
    rows = ordered.with_neighbours(lit, order, F.struct("lat", "lon", "ele", "at", "_light"), key, block, names=("_prev", ""))
    rise = F.col("ele") - F.col("_prev.ele")
    text = F.concat(F.when(rise > 0, "subida").otherwise("bajada"), F.lit(" sostenida "), F.when(rise > 0, "+").otherwise("-"), F.abs(F.bround(rise)).cast("long").cast("string"), F.lit("m"))
    known = F.col("lat").isNotNull() & F.col("_prev.lat").isNotNull()
    seconds = (F.unix_micros("at") - F.unix_micros("_prev.at")) / 1e6
    kmh = F.try_divide(geo.haversine("_prev.lat", "_prev.lon", "lat", "lon"), seconds) * 3.6
    motion = F.when(F.col("_prev").isNotNull(), F.when(~known, "").when(kmh >= movement, "en movimiento").otherwise("detenido"))
    turned = F.col("_light").isNotNull() & ~F.col("_light").eqNullSafe(F.col("_prev._light"))
    slim = rows.select("media_id", "offset_s", "at", "source", F.when(F.abs(rise) >= elevation, text).alias("_rise"), F.when(turned, F.col("_light")).alias("_turn"), motion.alias("_state"))
    moved = ordered.with_neighbours(slim, order, F.col("_state"), key, block, names=("_before", ""))
    other = (F.col("_state") != "") & ~F.col("_state").eqNullSafe(F.col("_before"))
    made = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(PREFIX + name).alias("key"), value.alias("value")))
    each = F.array_compact(F.array(made("elevacion", F.col("_rise")), made("astronomia", F.col("_turn")), made("movimiento", F.when(other, F.col("_state")))))
    out = moved.withColumn("_mark", F.explode(each)).select("media_id", "offset_s", "at", "_mark.key", "_mark.value", "source")
    # places and weather at coarse samples
    few = marks.coarse(found, key, "offset_s", coarse_every)
    near, wide = decimals
    y, x = geo.cell("lat", "lon", near)
    placed = few.withColumn("_y", y).withColumn("_x", x).join(places.select(F.col("lat").alias("_y"), F.col("lon").alias("_x"), "place"), ["_y", "_x"], "left")
    placed = ordered.with_neighbours(placed, order, F.coalesce("place", F.lit("")), key, block, names=("_before", ""))
    out = out.unionByName(mark(placed.where(F.col("place").isNotNull() & ~F.col("place").eqNullSafe(F.col("_before"))), "ubicacion", F.col("place")))
    y, x = geo.cell("lat", "lon", wide)
    there = weather.select(F.col("day").alias("_d"), F.col("lat").alias("_y"), F.col("lon").alias("_x"), F.col("hour").alias("_h"), "label", "temperature")
    aired = few.withColumn("_d", F.to_date("at")).withColumn("_y", y).withColumn("_x", x).withColumn("_h", F.hour("at")).join(there, ["_d", "_y", "_x", "_h"], "left")
    changed = marks.weather_transitions(aired.withColumn("_at", F.col("at")), key, ["_at"], "label", "temperature", temperature)
    degrees = F.concat(F.lit(", "), F.regexp_replace(F.col("temperature").cast("double").cast("string"), r"\.0$", ""), F.lit("°C"))
    return out.unionByName(mark(changed, "clima", F.concat(F.lit("clima: "), F.col("label"), F.coalesce(degrees, F.lit("")))))


def context(clips: DataFrame, tracks: DataFrame, timed: DataFrame, untimed: DataFrame, places: DataFrame, weather: DataFrame, by: Sequence[str] = (), every: int = 30, **limits) -> tuple[DataFrame, DataFrame]:
    """QRY22. (marks, states) of ``clips`` (media_id, t0, t1, lat, lon, alt), F1 to F4: track, samples with positions, cheap transitions, places and weather.

    A state is ``ok`` or, without a mark, ``sin_datos``; clips without a start have no sample and are ``sin_datos``. Samples with their positions are a table of their own, as five kinds of
    transitions read them.
    """
    chosen = choose_tracks(clips.where("t0 is not null"), tracks, by).select("media_id", "track_id")
    end = F.when(F.col("t1").isNull() | (F.col("t1") < F.col("t0")), F.col("t0")).otherwise(F.col("t1"))
    rows = samples(clips.where("t0 is not null").withColumn("t1", end).join(chosen, "media_id"), every)
    found = cut_lineage(positions(rows, timed, untimed).select("media_id", "offset_s", "at", "p.lat", "p.lon", "p.ele", "p.source"))
    made = cut_lineage(transitions(found, places, weather, **limits))
    ok = made.select("media_id").distinct().withColumn("_ok", F.lit("ok"))
    states = clips.select("media_id").join(ok, "media_id", "left").select("media_id", F.coalesce("_ok", F.lit("sin_datos")).alias("state"))
    return made, states


def context_step(old_marks: DataFrame, old_states: DataFrame, clips: DataFrame, mode: str, run) -> tuple[DataFrame, DataFrame]:
    """STR3. The tables of marks and states after a run over ``clips``; ``run`` maps clips to (marks, states).

    skip: clips that have neither a context mark nor a state. update: all, whose older context marks go. replace: all older context marks and states go
    first. Other marks stay.
    """
    is_context = F.col("key").startswith(PREFIX)
    if mode == "skip":
        done = old_marks.where(is_context).select("media_id").unionByName(old_states.select("media_id")).distinct()
        made, states = run(clips.join(done, "media_id", "left_anti"))
        return old_marks.unionByName(made), old_states.unionByName(states)
    made, states = run(clips)
    if mode == "update":
        kept = old_marks.where(~is_context).unionByName(old_marks.where(is_context).join(clips.select("media_id"), "media_id", "left_anti").select(old_marks.columns))
        return kept.unionByName(made), old_states.join(clips.select("media_id"), "media_id", "left_anti").unionByName(states)
    if mode == "replace":
        return old_marks.where(~is_context).unionByName(made), states
    raise ValueError(f"unknown mode {mode!r}")


# --- over the test tables ------------------------------------------------------------------------

#: Seconds between samples, between coarse ones, and limits of the queries below.
_EVERY, _COARSE, _RISE, _KMH, _DEGREES = 60, 300, 5.0, 30.0, 3.0


def _run(spark, d) -> tuple[DataFrame, DataFrame]:
    """Videos have tracks of 36 hours, every third of which is missing, partly with points that lost their time; sounds have two tracks without any time."""
    item = items(spark, d)
    clips = item.where("duration_s > 0").select("media_id", "kind", F.col("ts").alias("t0"), F.col("end_ts").alias("t1"), "lat", "lon", "alt")
    span = F.floor(F.unix_micros("ts") / 1e6 / 129_600)
    known = item.where("lat is not null").select(F.col("media_id").alias("seq"), span.alias("track_id"), "ts", "lat", "lon", F.col("alt").alias("ele"))
    timed = known.where("seq % 20 = 0 and track_id % 3 <> 2")
    lost = known.where("seq % 20 = 5 and track_id % 3 = 0").select("track_id", "seq", "lat", "lon", "ele")
    bare = known.where("seq % 20 = 10").select((F.floor(F.col("seq") / 20) % 2 + 900).alias("track_id"), "seq", "lat", "lon", "ele")
    tracks = timed.groupBy("track_id").agg(F.min("ts").alias("begins"), F.max("ts").alias("ends")).select(F.lit("video").alias("kind"), "track_id", "begins", "ends")
    none = F.lit(None).cast("timestamp")
    tracks = tracks.unionByName(bare.select("track_id").distinct().select(F.lit("audio").alias("kind"), "track_id", none.alias("begins"), none.alias("ends")))
    y, x = geo.cell("lat", "lon", 0)
    places = item.where("lat is not null").groupBy(y.alias("lat"), x.alias("lon")).agg(F.min("place").alias("place"))
    aired = item.where("lat is not null and media_id % 3 > 0").groupBy(F.to_date("ts").alias("day"), y.alias("lat"), x.alias("lon"), F.hour("ts").alias("hour"))
    weather = aired.agg(F.concat(F.lit("w"), (F.min("media_id") % 3).cast("string")).alias("label"), F.floor(F.max("value")).cast("double").alias("temperature"))
    return context(clips, tracks, timed, lost.unionByName(bare), places, weather, ["kind"], _EVERY, coarse_every=_COARSE, elevation=_RISE, movement=_KMH, temperature=_DEGREES, decimals=(0, 0))


_CONTEXT_SQL = f"""{ITEM_SQL}, clip AS (SELECT media_id, kind, ts AS t0, end_ts AS t1, duration_s, lat, lon, alt FROM item WHERE duration_s > 0),
known AS (SELECT media_id AS seq, floor(epoch_us(ts) / 1e6 / 129600)::BIGINT AS track_id, ts, lat, lon, alt AS ele FROM item WHERE lat IS NOT NULL),
timed AS (SELECT * FROM known WHERE seq % 20 = 0 AND track_id % 3 <> 2),
untimed AS (SELECT track_id, seq, lat, lon, ele FROM known WHERE seq % 20 = 5 AND track_id % 3 = 0 UNION ALL SELECT (seq // 20) % 2 + 900, seq, lat, lon, ele FROM known WHERE seq % 20 = 10),
track AS (SELECT track_id, min(ts) AS a, max(ts) AS b FROM timed GROUP BY 1),
cand AS (SELECT media_id, track_id, CASE WHEN a <= t0 AND b >= t1 THEN 0 WHEN least(t1, b) > greatest(t0, a) THEN 1 ELSE 2 END AS rank, epoch_us(t0) AS i0, epoch_us(t1) AS i1, epoch_us(a) AS a, epoch_us(b) AS b FROM clip, track WHERE kind = 'video'),
choice AS (SELECT media_id, track_id FROM cand QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY rank, CASE rank WHEN 0 THEN b - a WHEN 1 THEN greatest(i0, a) - least(i1, b) ELSE greatest(a - i1, i0 - b, 0) END, track_id) = 1 UNION ALL SELECT media_id, (SELECT min(track_id) FROM untimed WHERE track_id >= 900) FROM clip WHERE kind = 'audio'),
s AS (SELECT clip.*, track_id, unnest(range(0, duration_s + 1, {_EVERY})) AS o FROM clip JOIN choice USING (media_id)), sam AS (SELECT *, t0 + to_seconds(o) AS stamp FROM s),
n AS (SELECT track_id, ts, lat AS ya, lon AS xa, ele AS za, lead(ts) OVER w AS ts1, lead(lat) OVER w AS yb, lead(lon) OVER w AS xb, lead(ele) OVER w AS zb FROM timed WINDOW w AS (PARTITION BY track_id ORDER BY ts, seq)),
j AS (SELECT sam.*, (epoch_us(stamp) - epoch_us(n.ts)) / (epoch_us(n.ts1) - epoch_us(n.ts))::DOUBLE AS f, ya, xa, za, yb, xb, zb FROM sam ASOF LEFT JOIN n ON sam.track_id = n.track_id AND sam.stamp > n.ts),
u AS (SELECT track_id, row_number() OVER w - 1 AS i, lat AS ua, lon AS va, ele AS wa, coalesce(lead(lat) OVER w, lat) AS ub, coalesce(lead(lon) OVER w, lon) AS vb, CASE WHEN lead(lat) OVER w IS NULL THEN ele ELSE lead(ele) OVER w END AS wb FROM untimed WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
un AS (SELECT track_id, count(*) AS cnt FROM untimed GROUP BY 1 HAVING count(*) > 1),
k AS (SELECT j.*, (o / duration_s::DOUBLE) * (cnt - 1) AS g FROM j LEFT JOIN un USING (track_id)),
q AS (SELECT k.*, ua, va, wa, ub, vb, wb FROM k LEFT JOIN u ON u.track_id = k.track_id AND u.i = floor(g)),
pos AS (SELECT media_id, o, stamp, CASE WHEN f IS NOT NULL THEN 'track_interpolado' WHEN ua IS NOT NULL THEN 'estimado' WHEN lat IS NOT NULL THEN 'gps_propio' END AS source,
  CASE WHEN f IS NOT NULL THEN ya + (yb - ya) * f WHEN ua IS NOT NULL THEN ua + (ub - ua) * (g - floor(g)) ELSE lat END AS lat, CASE WHEN f IS NOT NULL THEN xa + (xb - xa) * f WHEN ua IS NOT NULL THEN va + (vb - va) * (g - floor(g)) ELSE lon END AS lon,
  CASE WHEN f IS NOT NULL THEN za + (zb - za) * f WHEN ua IS NOT NULL THEN wa + (wb - wa) * (g - floor(g)) WHEN lat IS NOT NULL THEN alt END AS ele FROM q),
{_SUN.replace("FROM item", "FROM (SELECT media_id * 10000 + o AS media_id, media_id AS folder, stamp AS ts, lat, lon FROM pos)")},
x AS (SELECT pos.*, el, {_LIGHT} AS light FROM pos JOIN sun ON sun.media_id = pos.media_id * 10000 + o),
y AS (SELECT *, lag(ele) OVER w AS pele, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(stamp) OVER w AS pat, lag(light) OVER w AS plight, row_number() OVER w AS r FROM x WINDOW w AS (PARTITION BY media_id ORDER BY o)),
mv AS (SELECT media_id, o, source, CASE WHEN lat IS NULL OR plat IS NULL THEN '' WHEN {_HAV.format(a="plat", b="plon", c="lat", d="lon")} / ((epoch_us(stamp) - epoch_us(pat)) / 1e6) * 3.6 >= {_KMH} THEN 'en movimiento' ELSE 'detenido' END AS state FROM y WHERE r > 1),
mw AS (SELECT *, lag(state) OVER (PARTITION BY media_id ORDER BY o) AS before FROM mv),
mult AS (SELECT media_id, unnest(range(0, max(o) + 1, {_COARSE})) AS m FROM pos GROUP BY 1),
few AS (SELECT DISTINCT media_id, o, stamp, source, lat, lon FROM (SELECT media_id, m, o, stamp, source, lat, lon FROM mult JOIN pos USING (media_id) QUALIFY row_number() OVER (PARTITION BY media_id, m ORDER BY abs(o - m), o) = 1)),
place_ AS (SELECT round(lat, 0) AS cy, round(lon, 0) AS cx, min(place) AS place FROM item WHERE lat IS NOT NULL GROUP BY ALL),
pl AS (SELECT few.*, place, lag(place) OVER (PARTITION BY media_id ORDER BY o) AS before FROM few LEFT JOIN place_ ON cy = round(lat, 0) AND cx = round(lon, 0)),
air AS (SELECT ts::DATE AS day, round(lat, 0) AS cy, round(lon, 0) AS cx, hour(ts) AS h, 'w' || (min(media_id) % 3) AS label, floor(max(value))::DOUBLE AS temp FROM item WHERE lat IS NOT NULL AND media_id % 3 > 0 GROUP BY ALL),
wa_ AS (SELECT few.*, label, temp, count(*) FILTER (label IS NULL) OVER (PARTITION BY media_id ORDER BY o) AS stretch FROM few LEFT JOIN air ON day = stamp::DATE AND cy = round(lat, 0) AND cx = round(lon, 0) AND h = hour(stamp)),
wb_ AS (SELECT *, lag(label) OVER w AS before, last_value(temp IGNORE NULLS) OVER (PARTITION BY media_id, stretch ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS told FROM wa_ WHERE label IS NOT NULL WINDOW w AS (PARTITION BY media_id, stretch ORDER BY o)),
marks AS (SELECT media_id, o, 'contexto_elevacion' AS key, CASE WHEN ele > pele THEN 'subida sostenida +' ELSE 'bajada sostenida -' END || abs(round_even(ele - pele, 0))::BIGINT || 'm' AS value, source FROM y WHERE abs(ele - pele) >= {_RISE}
  UNION ALL SELECT media_id, o, 'contexto_astronomia', light, source FROM y WHERE light IS NOT NULL AND light IS DISTINCT FROM plight
  UNION ALL SELECT media_id, o, 'contexto_movimiento', state, source FROM mw WHERE state <> '' AND state IS DISTINCT FROM before
  UNION ALL SELECT media_id, o, 'contexto_ubicacion', place, source FROM pl WHERE place IS NOT NULL AND place IS DISTINCT FROM before
  UNION ALL SELECT media_id, o, 'contexto_clima', 'clima: ' || label || coalesce(', ' || regexp_replace(temp::VARCHAR, '\\.0$', '') || '°C', ''), source FROM wb_ WHERE label IS DISTINCT FROM before OR abs(temp - told) >= {_DEGREES})"""


@query(f"WITH {_CONTEXT_SQL} SELECT media_id, o::BIGINT AS offset_s, key, value, source FROM marks")
def context_marks(spark, d):
    """QRY22, JN13, SEQ4-SEQ10, SEQ12: all marks of all clips."""
    return _run(spark, d)[0].select("media_id", "offset_s", "key", "value", "source")


@query(f"WITH {_CONTEXT_SQL} SELECT media_id, CASE WHEN media_id IN (SELECT media_id FROM marks) THEN 'ok' ELSE 'sin_datos' END AS state FROM clip")
def context_states(spark, d):
    """QRY22, STR3: which clips have marks; the others aren't tried again in skip mode."""
    return _run(spark, d)[1]
