"""Files, chat exports and tracks on their way into the archive, as tables that are read and tables that are written. Imported for its registrations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from caravel import schemas
from caravel.functions import geo, metadata, replies, time
from caravel.operators import ordered
from caravel.plans.jobs import altitudes
from caravel.plans.queries import _stamp, query
from caravel.plans.views import ITEM_SQL, TRACK_SQL, table, track_points
from caravel.plans.views import items as items_
from caravel.session import cut_lineage
from caravel.sources import files as sources

#: The metadata keys that hold a time, by kind; the first known one counts.
TIME_KEYS = {
    "image": ("exif_datetimeoriginal", "exif_createdate", "exif_modifydate", "xmp_datetimeoriginal", "xmp_createdate"),
    "video": ("sony_creationdate", "fmt_tag_creation_time", "fmt_tag_com_apple_quicktime_creationdate"),
    "audio": ("fmt_tag_creation_time",),
}
#: The keys that name who made a picture, and those of a camera's maker and model.
ARTIST_KEYS = ("exif_artist", "xmp_creator", "iptc_byline", "exif_owner", "quicktime_artist", "quicktime_author")
MAKER_KEYS, MODEL_KEYS = ("xml_devicemanufacturer", "sony_device_manufacturer"), ("xml_devicemodelname", "sony_device_modelName")
GPS_KEYS = ("composite_gpsposition", "exif_gpslatitude", "exif_gpslatituderef", "exif_gpslongitude", "exif_gpslongituderef", "exif_gpsaltitude", "exif_gpsaltituderef")
_KEYS = tuple(dict.fromkeys([*(k for ks in TIME_KEYS.values() for k in ks), *ARTIST_KEYS, *MAKER_KEYS, *MODEL_KEYS, *GPS_KEYS, "duration_secs"]))


def _first(keys: Sequence[str]) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.col(f"`{k}`")), F.lit("")) for k in keys])


def says_sphere(key, value) -> Column:
    """FLT14. Whether one attribute says that a video is a sphere."""
    k, v = F.lower(key), F.lower(value)
    return F.coalesce((k.rlike("spherical|equirectangular|stereo") & v.rlike("true|1|equirectangular")) | (k.contains("projection") & v.contains("equirectangular")), F.lit(False))


def _sidecars(seen: DataFrame) -> DataFrame:
    """(path, sidecar): a video's ``C0001M01.XML``, a picture's ``.AAE`` in the same folder."""
    xml = seen.where(F.col("name").rlike(r"^[Cc]\d{4}M01\.XML$")).select("dir", F.substring("name", 1, 5).alias("stem"), F.col("path").alias("sidecar"))
    aae = seen.where(F.col("name").endswith(".AAE")).select("dir", F.regexp_replace("name", r"\.AAE$", "").alias("stem"), F.col("path").alias("sidecar"))
    videos = seen.where((F.col("kind") == "video") & F.col("name").rlike(r"^[Cc]\d{4}")).select("path", "dir", F.substring("name", 1, 5).alias("stem"))
    pictures = seen.where("kind = 'image'").select("path", "dir", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"))
    return videos.join(xml, ["dir", "stem"]).unionByName(pictures.join(aae, ["dir", "stem"])).select("path", "sidecar")


def _author(folders: dict[str, str]) -> Column:
    """S27 as (value, source number): who is named, whose folder it is, the camera, the folder itself unless it is a camera's."""
    folder, visual = F.lower("folder"), F.col("kind").isin("image", "video")
    held = [F.when(F.contains(folder, F.lit(k.lower())) | F.contains(F.lit(k.lower()), folder), v) for k, v in folders.items()]
    model = _first(MODEL_KEYS)
    camera = F.when(F.col("kind") == "video", F.concat_ws(" ", F.coalesce(_first(MAKER_KEYS), F.when(model.isNotNull(), "?")), model))
    own = F.when(~F.col("folder").startswith("SONY"), F.col("folder"))
    found = metadata.first_known(_first(ARTIST_KEYS), F.coalesce(*held, F.lit(None).cast("string")), F.when(model.isNotNull(), camera), own)
    return F.when(visual, found)


def ingest_files(existing: DataFrame, files: DataFrame, facts: DataFrame, folders: dict[str, str] | None = None, allow_undated: bool = False) -> dict[str, DataFrame]:
    """JOB1. New items of a folder's files: ``items``, their ``attributes``, the ``outcomes`` of all files and a ``report``.

    ``existing`` holds media_id, file_hash and content_hash; ``files`` path, size, fingerprint and content_hash; ``facts`` the attributes (path, key, value) that
    were read from files, sidecars included. In order of path: sidecars aren't items but lend their facts to their video or picture; a file whose fingerprint is
    there is a ``duplicate``; one without a time is ``undated`` and, unless that is allowed, left out, so that a later copy with a time in its name still comes in. Equal contents are
    reported and come in. Ids go on from the greatest one in order of path.

    As a file waits for no other but the first accepted one of its fingerprint, that is a minimum by fingerprint and a join: no order over all files. A null fingerprint equals
    no other, rows of one path count once, and a null path is no file.
    """
    one = files.where("path is not null").groupBy("path").agg(F.min(F.struct("size", "fingerprint", "content_hash")).alias("f")).select("path", "f.*")
    name, folder = F.regexp_extract("path", r"[^/]*$", 0), F.regexp_replace("path", r"/?[^/]*$", "")
    seen = one.withColumns({"name": name, "dir": folder, "kind": sources.media_type("path")})
    seen = seen.withColumn("folder", F.nullif(F.regexp_extract("dir", r"[^/]*$", 0), F.lit(""))).withColumn("fingerprint", F.coalesce("fingerprint", F.concat(F.lit("path:"), F.col("path"))))
    side = F.when(F.col("name").rlike(r"(?i)^C\d{4}M01\.XML$"), "sidecar_xml").when(F.lower("name").endswith(".aae"), "sidecar_aae")
    seen = cut_lineage(seen.withColumn("side", side))

    pairs = _sidecars(seen)
    lent = pairs.where(F.col("sidecar").endswith(".XML")).join(facts.withColumnRenamed("path", "sidecar"), "sidecar")
    held = facts.select("path", "key", "value", F.lit(0).alias("rank")).unionByName(lent.select("path", "key", "value", F.lit(1).alias("rank")))
    held = held.where("value is not null").groupBy("path", "key").agg(F.max_by("value", F.struct("rank", "value")).alias("value"))
    wide = held.groupBy("path").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in _KEYS], F.bool_or(says_sphere("key", "value")).alias("sphere"))
    rows = seen.where("side is null").join(pairs, "path", "left").join(wide, "path", "left")

    raw = F.coalesce(*[F.when(F.col("kind") == k, _first(keys)) for k, keys in TIME_KEYS.items()])
    rows = rows.withColumns({"raw": raw, "named": time.of_prefix("name"), "duration_s": F.when(F.col("kind").isin("video", "audio"), F.col("duration_secs").try_cast("double"))})
    rows = rows.withColumn("at", F.when(F.col("raw").isNotNull(), time.parsed("raw")).when(F.col("named").isNotNull(), F.struct(F.col("named").alias("ts"), F.lit("file name").alias("note"))))
    is_image = F.col("kind") == "image"
    whole = geo.position("composite_gpsposition")
    degrees = lambda c, ref: geo.dms(F.concat_ws(" ", F.col(c), F.substring(F.trim(F.col(ref)), 1, 1)))
    halves = F.struct(degrees("exif_gpslatitude", "exif_gpslatituderef").alias("lat"), degrees("exif_gpslongitude", "exif_gpslongituderef").alias("lon"))
    known = lambda p: F.when(p["lat"].isNotNull() & p["lon"].isNotNull(), p)
    height = F.col("exif_gpsaltitude").try_cast("double") * F.when(F.col("exif_gpsaltituderef").eqNullSafe("1"), -1.0).otherwise(1.0)
    rows = rows.withColumns({"ts": F.col("at.ts"), "place": F.when(is_image, F.coalesce(known(whole), known(halves))), "author": _author(folders or {})})
    content = F.when(F.col("kind").isin("image", "audio", "text"), F.col("content_hash")).otherwise(F.col("fingerprint"))
    rows = rows.select(
        "path", "name", "folder", "kind", F.when((F.col("kind") == "video") & F.col("sphere"), "360").alias("subtype"), "size", "fingerprint", content.alias("content_hash"), "ts", F.col("at.note").alias("time_note"),
        "duration_s", F.when(F.col("ts").isNotNull(), time.end_time("ts", "duration_s")).alias("end_ts"), "place.lat", "place.lon", F.when(is_image, height).alias("alt"),
        F.col("author.value").alias("author"), F.when(F.col("author.source").isin(1, 3), "exif").when(F.col("author.source").isin(2, 4), "folder").alias("author_source"), "sidecar",
    )
    rows = cut_lineage(rows)

    accepted = F.lit(True) if allow_undated else F.col("ts").isNotNull()
    first = rows.where(accepted).groupBy("fingerprint").agg(F.min("path").alias("first"))
    there = existing.where("file_hash is not null").groupBy(F.col("file_hash").alias("fingerprint")).agg(F.lit(True).alias("there"))
    judged = rows.join(first.join(there, "fingerprint", "full"), "fingerprint", "left")
    outcome = F.when(F.col("there") | (F.col("path") > F.col("first")), "duplicate").when(F.col("path") == F.col("first"), "inserted").otherwise("undated")
    judged = judged.withColumn("outcome", outcome).drop("there", "first")

    last = existing.agg(F.coalesce(F.max("media_id"), F.lit(0)).cast("long").alias("last"))
    items = ordered.numbered(judged.where("outcome = 'inserted'").crossJoin(F.broadcast(last)), ["path"], "media_id", F.col("last")).drop("last", "outcome")
    held_content = existing.where("content_hash is not null").groupBy("content_hash").agg(F.min("media_id").alias("of"))
    own_content = items.where("content_hash is not null").groupBy("content_hash").agg(F.min("media_id").alias("head"))
    alike = own_content.join(held_content, "content_hash", "left")
    items = items.join(alike, "content_hash", "left").withColumn("same_content", F.coalesce("of", F.when(F.col("head") < F.col("media_id"), F.col("head")))).drop("of", "head")
    items = cut_lineage(items.withColumnRenamed("fingerprint", "file_hash"))

    of_kind = items.where(F.col("kind").isin("image", "video", "audio")).select("path", "media_id")
    attributes = of_kind.join(held, "path").where("key <> 'duration_secs'").select("media_id", "key", "value")
    aae = items.where("kind = 'image' and sidecar is not null").select("media_id", F.lit("sidecar_aae").alias("key"), F.col("sidecar").alias("value"))
    outcomes = judged.select("path", "outcome").join(items.select("path", "media_id", "same_content"), "path", "left")
    outcomes = outcomes.unionByName(seen.where("side is not null").select("path", F.col("side").alias("outcome")), allowMissingColumns=True)
    counts = outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
    noted = items.agg(F.count("same_content").alias("same_content"), F.count_if(F.col("ts").isNull()).alias("inserted_undated"))
    report = counts.unionByName(noted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("outcome"), F.col(c).alias("n")) for c in noted.columns])).alias("r")).select("r.*"))
    return {"items": items, "attributes": attributes.unionByName(aae), "outcomes": outcomes, "report": report}


# --- chat exports ----------------------------------------------------------------------------------

#: Columns that an export's messages may lack.
OPTIONAL = schemas._struct(
    **dict.fromkeys(("from", "from_id", "actor", "actor_id", "action", "poll", "reactions", "members", "edited_unixtime", "date_unixtime", "grouped_id", "thumbnail", "file_name"), StringType()),
    **dict.fromkeys(("file_size", "photo_file_size", "reply_to_message_id"), LongType()), duration_seconds=DoubleType(), width=IntegerType(), height=IntegerType(),
)


def _export(messages: DataFrame) -> DataFrame:
    return schemas.ensure_columns(messages, OPTIONAL)


def message_rows(messages: DataFrame) -> DataFrame:
    """S22, S23. An export's messages as the archive keeps them."""
    service = F.col("type").eqNullSafe("service")
    date = F.trim(F.coalesce("date", F.lit("")))
    utc = F.when((date == "") | date.endswith("Z"), date).otherwise(F.concat(date, F.lit("Z")))
    only = lambda c: F.when(service, F.col(c))
    return _export(messages).select(
        "chat_id", F.col("id").alias("message_id"), F.coalesce("type", F.lit("message")).alias("type"), sources.message_type(_export(messages)).alias("message_type"), service.alias("is_system"),
        F.coalesce(F.nullif("from", F.lit("")), "actor", F.lit("")).alias("from_name"), F.coalesce(F.nullif("from_id", F.lit("")), "actor_id", F.lit("")).alias("from_id"), F.coalesce(sources.flat_text("text"), F.lit("")).alias("text"),
        F.coalesce(F.col("date_unixtime").try_cast("long"), F.lit(0)).alias("date_unixtime"), utc.alias("date_utc"), F.col("edited_unixtime").try_cast("long").alias("edited_unixtime"), "reply_to_message_id", "grouped_id", "reactions",
        sources.entity_hashtags("text").alias("hashtags"), only("action").alias("action"), only("actor").alias("actor"), only("actor_id").alias("actor_id"), "members",
    )


def attachment_rows(messages: DataFrame) -> DataFrame:
    """S23. (chat_id, message_id, place, kind, file, file_name, mime_type, file_size, width, height, duration_s, thumbnail) of photo, file and position, in that order; stickers included."""
    base = lambda path: F.regexp_extract(path, r"[^/]*$", 0)
    null = lambda t: F.lit(None).cast(t)

    def part(present, kind, file, name, mime, size, width, height, duration, thumbnail):
        values = dict(kind=kind, file=file, file_name=name, mime_type=mime, file_size=size, width=width, height=height, duration_s=duration, thumbnail=thumbnail)
        return F.when(present, F.struct(*[v.alias(k) for k, v in values.items()]))

    c = F.col
    photo = part(c("photo").isNotNull(), F.lit("photo"), c("photo"), base("photo"), F.lit("image/jpeg"), c("photo_file_size"), c("width"), c("height"), null("double"), null("string"))
    file = part(c("file").isNotNull(), F.coalesce("media_type", F.lit("document")), c("file"), F.coalesce(F.nullif("file_name", F.lit("")), base("file")), F.coalesce("mime_type", F.lit("")), c("file_size"), c("width"), c("height"), c("duration_seconds"), c("thumbnail"))
    location = part(c("location").isNotNull(), F.lit("location"), F.lit(""), null("string"), F.lit("application/geo+json"), null("long"), null("int"), null("int"), null("double"), null("string"))
    listed = F.array_compact(F.array(photo, file, location))
    return _export(messages).select("chat_id", F.col("id").alias("message_id"), F.posexplode(listed).alias("place", "a")).select("chat_id", "message_id", "place", "a.*")


def import_chat(state: dict[str, DataFrame], messages: DataFrame, available: DataFrame, mode: str = "skip", include_system: bool = True, take_items: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """QRY21, JOB4. The archive's tables behind an import of ``messages`` (rows of ``chat_messages``), and a report (name, n).

    ``state``: ``messages``, ``attachments`` (chat_id, message_id, place, kind, file, mime_type, media_id and more), ``items`` (media_id, file_hash, type, chat_id, message_id: the message that an item came with, and
    more) and ``attributes``. ``available`` holds file and file_hash of the files that are there.

    skip: only messages that aren't there come in; update: an export's messages take the place of theirs, attachments included; replace: the export's chats go first. Of rows with an equal id the
    first holds in skip mode, else the last; rows without an id, and service messages unless ``include_system``, are left out, and all that don't hold are counted as skipped. Then files that are there become items by
    their hash: those of new attachments, in the export's order, then those that are missing from earlier imports. A hash that is there keeps its item, whose type and message are those of the last attachment of it;
    others are numbered in order of their first attachment. Stickers and positions stay attachments. An item whose message went has none unless one comes in again.

    A file that is sent in a third of all messages is one aggregate by hash and one row that they join.
    """
    if mode not in ("skip", "update", "replace"):
        raise ValueError(f"unknown mode {mode!r}")
    keys = ["chat_id", "message_id"]
    held_messages, held_attachments = state["messages"], state["attachments"]
    rows = messages.withColumn("message_id", F.col("id"))
    good = F.col("id").isNotNull() & (F.col("id") != 0) & F.col("chat_id").isNotNull()
    wanted = rows.where(good if include_system else good & ~F.col("type").eqNullSafe("service"))
    if mode == "skip":
        wanted = wanted.join(held_messages.select(*keys).distinct(), keys, "left_anti")
    choose = F.min_by if mode == "skip" else F.max_by
    new = wanted.groupBy(*keys).agg(choose(F.struct(*[F.col(f"`{c}`") for c in messages.columns]), F.col("place")).alias("m")).select("m.*")
    new = cut_lineage(new)
    gone = {"skip": None, "update": new.select("chat_id", F.col("id").alias("message_id")), "replace": rows.where("chat_id is not null").select("chat_id").distinct()}[mode]
    stay = (lambda df: df) if gone is None else (lambda df: df.join(gone, gone.columns, "left_anti"))
    out_messages = stay(held_messages).unionByName(message_rows(new), allowMissingColumns=True)

    fresh = attachment_rows(new)
    old = stay(held_attachments)
    sent = _export(new).select("chat_id", F.col("id").alias("message_id"), F.col("place").alias("at"), F.coalesce("from", F.lit("")).alias("sender"), F.coalesce("date", F.lit("")).alias("date"))
    authors = held_messages.groupBy(*keys).agg(F.max("from_name").alias("sender"), F.max("date_utc").alias("date"))
    shown = ["file", "kind", "mime_type", "file_size", "duration_s"]
    tried = fresh.join(sent, keys).select(F.lit(0).alias("stage"), F.col("at").cast("long").alias("at"), *keys, "place", *shown, "sender", "date")
    pending = schemas.ensure_columns(old, fresh.select("file_size", "duration_s").schema).where("media_id is null").join(authors, keys)
    tried = tried.unionByName(pending.select(F.lit(1).alias("stage"), F.lit(0).cast("long").alias("at"), *keys, "place", *shown, "sender", "date"))
    files = available.where("file <> '' and file_hash is not null").groupBy("file").agg(F.min("file_hash").alias("file_hash"))
    found = tried.where("kind <> 'sticker' and file <> ''").join(files, "file").withColumn("type", sources.item_type("kind", "mime_type"))
    found = cut_lineage(found if take_items else found.where("false"))

    turn = F.struct("stage", "at", *keys, "place")
    facts = F.struct("stage", "at", *keys, "place", "file", "file_size", "duration_s", "sender", "date")
    by_hash = cut_lineage(found.groupBy("file_hash").agg(F.min_by(facts, turn).alias("first"), F.max_by(F.struct("type", *keys), turn).alias("last")))
    ids = state["items"].where("file_hash is not null").groupBy("file_hash").agg(F.min("media_id").alias("media_id"))
    greatest = state["items"].agg(F.coalesce(F.max("media_id"), F.lit(0)).cast("long").alias("greatest"))
    unknown = by_hash.join(ids, "file_hash", "left_anti").select("file_hash", "first.*", F.col("last.type").alias("type"), F.col("last.chat_id").alias("to_chat"), F.col("last.message_id").alias("to_message"))
    born = cut_lineage(ordered.numbered(unknown.crossJoin(F.broadcast(greatest)), ["stage", "at", *keys, "place"], "media_id", F.col("greatest")))

    linked = found.join(ids.unionByName(born.select("file_hash", "media_id")), "file_hash").select(*keys, "place", F.col("media_id").alias("new_id"))
    attachments = old.unionByName(fresh.withColumn("media_id", F.lit(None).cast("long")), allowMissingColumns=True).join(linked, [*keys, "place"], "left")
    attachments = attachments.withColumn("media_id", F.coalesce("media_id", "new_id")).drop("new_id")

    item_columns = state["items"].columns
    kept = state["items"]
    if gone is not None:
        lost = gone.withColumn("lost", F.lit(True))
        kept = kept.join(lost, gone.columns, "left").withColumns({c: F.when(F.col("lost").isNull(), F.col(c)) for c in keys}).drop("lost")
    kept = kept.join(by_hash.select("file_hash", "last"), "file_hash", "left").withColumns({"type": F.coalesce("last.type", "type"), **{c: F.when(F.col("last").isNotNull(), F.col(f"last.{c}")).otherwise(F.col(c)) for c in keys}}).select(*item_columns)
    date = F.trim("date")
    added = born.select("media_id", "file_hash", "type", F.col("to_chat").alias("chat_id"), F.col("to_message").alias("message_id"), F.regexp_extract("file", r"[^/]*$", 0).alias("name"), F.col("file").alias("path"), F.col("file_size").alias("size"), "duration_s", F.try_to_timestamp(F.when(date.endswith("Z"), date).otherwise(F.concat(date, F.lit("Z")))).alias("ts"), F.col("sender").alias("author"))
    items = kept.unionByName(added.select(*[c for c in added.columns if c in item_columns]), allowMissingColumns=True)
    marks = {"fuente": F.lit("telegram"), "telegram_chat": F.col("sender")}
    provenance = born.select("media_id", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in marks.items()])).alias("a")).select("media_id", "a.*")

    n = lambda df, name, c=F.lit(True): df.agg(F.count_if(c).alias("n")).select(F.lit(name).alias("name"), "n")
    report = n(rows, "total").unionByName(n(new, "messages")).unionByName(n(rows, "system", good & F.col("type").eqNullSafe("service")))
    report = report.unionByName(n(fresh, "registered")).unionByName(n(found, "ingested")).unionByName(n(found, "recovered", F.col("stage") == 1))
    both = report.where("name in ('total', 'messages')").agg(F.sum(F.when(F.col("name") == "total", F.col("n")).otherwise(-F.col("n"))).alias("n"))
    report = report.unionByName(both.select(F.lit("skipped").alias("name"), "n"))
    return {**state, "messages": out_messages, "attachments": attachments, "items": items, "attributes": schemas.insert_absent(state["attributes"], provenance, ["media_id", "key"])}, report


# --- tracks ---------------------------------------------------------------------------------------------


def import_track(state: dict[str, DataFrame], points: DataFrame, waypoints: DataFrame, mode: str = "skip") -> tuple[dict[str, DataFrame], DataFrame]:
    """JOB3. ``tracks``, ``waypoints`` and ``items`` behind an import of points (file, ts, latitude, longitude, elevation) and waypoints (file and more), with a report (name, n).

    Each file becomes a track, numbered by name; waypoints name it. Items with a position and a time take the altitude of the point nearest in time, of equally near ones the later: in skip mode only items that
    have none, else all. Fewer than two points with time and elevation give none.
    """
    last = state["tracks"].agg(F.coalesce(F.max("track_id"), F.lit(0)).cast("long").alias("last"))
    head = points.groupBy("file").agg(F.min("ts").alias("begins"), F.max("ts").alias("ends"), F.count("*").alias("total_points"))
    new = cut_lineage(ordered.numbered(head.crossJoin(F.broadcast(last)), ["file"], "track_id", F.col("last")).drop("last"))
    tracks = state["tracks"].unionByName(new, allowMissingColumns=True)
    named = waypoints.join(new.select("file", "track_id"), "file").drop("file")
    good = points.where("ts is not null and elevation is not null").select("ts", F.col("elevation").alias("ele"))
    enough = good.agg((F.count("*") >= 2).alias("enough"))
    asked = state["items"].where("lat is not null and ts is not null")
    asked = asked.where("alt is null") if mode == "skip" else asked
    asked = asked.crossJoin(F.broadcast(enough)).where("enough").select("media_id", "ts", F.lit(None).cast("double").alias("alt"))
    found = cut_lineage(altitudes(asked, good, 1 << 40).where("alt is not null").select("media_id", F.col("alt").alias("new_alt")))
    items = schemas.ensure_columns(state["items"], StructType([StructField("geo_source", StringType())])).join(found, "media_id", "left")
    items = items.withColumns({"alt": F.coalesce("new_alt", "alt"), "geo_source": F.when(F.col("new_alt").isNotNull(), "track_gps").otherwise(F.col("geo_source"))}).drop("new_alt")
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    out = {**state, "tracks": tracks, "waypoints": state["waypoints"].unionByName(named, allowMissingColumns=True), "items": items}
    report = n(tracks, "tracks").unionByName(n(out["waypoints"], "waypoints")).unionByName(n(items.where("geo_source = 'track_gps'"), "altitudes")).unionByName(n(points, "points"))
    return out, report


# --- attributes that are filled in later -------------------------------------------------------------------


def video_metadata(items: DataFrame, attributes: DataFrame, facts: DataFrame, mode: str = "skip") -> tuple[DataFrame, DataFrame]:
    """JOB13. (items, attributes) with what was read anew from videos, as facts (media_id, key, value).

    skip: only videos without a camera's maker; update and replace: all that have facts, whose older camera attributes and kind of picture go. Other attributes that are there stay. A video is a sphere if one of its
    new facts says so, and one without an author gets maker and model.
    """
    videos = items.where("type = 'video'").select("media_id")
    if mode == "skip":
        videos = videos.join(attributes.where("key = 'xml_devicemanufacturer'").select("media_id"), "media_id", "left_anti")
    read = facts.where("value is not null").join(videos, "media_id", "left_semi")
    key = lambda keys: F.coalesce(*[F.max(F.when(F.col("key") == k, F.nullif(F.col("value"), F.lit("")))) for k in keys])
    seen = cut_lineage(read.groupBy("media_id").agg(F.bool_or(says_sphere("key", "value")).alias("sphere"), key(MAKER_KEYS).alias("maker"), key(MODEL_KEYS).alias("model")))
    if mode != "skip":
        camera = F.col("key").rlike(r"(?i)^(xml|xmp).") | (F.col("key") == "video_spherical_projection")
        old = attributes.join(seen.select("media_id", F.lit(True).alias("anew")), "media_id", "left")
        attributes = old.where(~(camera & F.col("anew").isNotNull()) | F.col("key").isNull()).drop("anew")
    filled = schemas.insert_absent(attributes, read.select("media_id", "key", "value"), ["media_id", "key"])
    camera_name = F.nullif(F.trim(F.concat_ws(" ", "maker", "model")), F.lit(""))
    lacks = F.coalesce("author", F.lit("")) == ""
    both = items.join(seen.withColumns({"camera": camera_name, "anew": F.lit(True)}).drop("maker", "model"), "media_id", "left")
    base = F.when(F.col("anew").isNotNull(), F.lit(None).cast("string")).otherwise(F.col("subtype")) if mode != "skip" else F.col("subtype")
    both = both.withColumns({"subtype": F.when(F.col("sphere"), "360").otherwise(base), "author_source": F.when(lacks & F.col("camera").isNotNull(), "exif").otherwise(F.col("author_source")), "author": F.when(lacks, F.coalesce("camera", "author")).otherwise(F.col("author"))})
    return both.select(*items.columns), filled


def transcript_attributes(transcripts: DataFrame) -> DataFrame:
    """JOB21. (media_id, key, value): whole text, segments and facts of transcripts (media_id, segments of start, end, text; language, probability, model)."""
    s = F.col("segments")
    text = F.array_join(F.transform(s, lambda x: F.coalesce(x["text"], F.lit(""))), " ")
    end = F.coalesce(F.get(s, F.size(s) - 1)["end"], F.lit(0.0))
    facts = F.struct(F.col("model").alias("modelo"), F.col("language").alias("idioma"), F.round("probability", 2).alias("probabilidad_idioma"), F.round(end, 1).alias("duracion_seg"), F.size(s).alias("segmentos"))
    listed = F.to_json(F.transform(s, lambda x: F.struct(x["start"].alias("inicio"), x["end"].alias("fin"), x["text"].alias("texto"))))
    pairs = {"transcript": text, "transcript_segments": listed, "transcript_info": F.to_json(facts)}
    return transcripts.where("segments is not null").select("media_id", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()])).alias("a")).select("media_id", "a.*")


def store_transcripts(attributes: DataFrame, transcripts: DataFrame) -> DataFrame:
    """JOB21. Attributes in which each transcript's three rows take the place of its older ones."""
    return schemas.upsert(attributes, transcript_attributes(transcripts), ["media_id", "key"])


def clean_descriptions(attributes: DataFrame, keys: Sequence[str], clean: Callable[[Column], Column] = replies.reply_description, openers: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """JOB23. (attributes, report): values of ``keys`` without their openings, where that loses nothing but a beginning.

    ``changed``: written; ``refused``: what is left isn't the end of the old text, which stays; ``violations``: changed ones that had begun with a legitimate opener, which must be none.
    """
    asked = F.col("key").isin(*keys) & F.col("value").isNotNull()
    found = cut_lineage(attributes.where(asked).withColumn("new", clean(F.col("value"))))
    differs = F.col("new").isNotNull() & (F.col("new") != F.col("value"))
    safe = replies.lossless(F.col("value"), F.col("new"))
    begins = F.lit(False)
    for o in openers:
        begins = begins | F.lower(F.trim("value")).startswith(o)
    written = found.withColumn("value", F.when(differs & safe, F.col("new")).otherwise(F.col("value"))).drop("new")
    report = found.agg(F.count("*").alias("checked"), F.count_if(differs & safe).alias("changed"), F.count_if(differs & ~safe).alias("refused"), F.count_if(differs & safe & begins).alias("violations"))
    return attributes.where(~F.coalesce(asked, F.lit(False))).unionByName(written), report


# --- what pages of the archive ask for ------------------------------------------------------------------------

#: MIME types by extension.
MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "mp3": "audio/mpeg", "wav": "audio/wav", "ogg": "audio/ogg", "m4a": "audio/mp4",
    "aac": "audio/aac", "wma": "audio/x-ms-wma", "mp4": "video/mp4", "mov": "video/quicktime", "avi": "video/x-msvideo", "webm": "video/webm", "mkv": "video/x-matroska",
}


def lookup(asked: DataFrame, items: DataFrame, files: DataFrame, roots: Sequence[str] = ()) -> DataFrame:
    """QRY19. (media_id, status, path, mime) of each asked id: 400 for an id that is none, 404 where the item or its file isn't there.

    The file is at the item's path or, for older archives, at that path below the first of ``roots`` that holds it; ``files`` (path) are those that are there.
    """
    ids = asked.select("media_id").distinct()
    held = ids.join(items.select("media_id", "path"), "media_id", "left")
    places = F.array(F.col("path"), *[F.concat(F.lit(r.rstrip("/") + "/"), F.col("path")) for r in roots])
    tried = held.where("media_id > 0 and path <> ''").select("media_id", F.posexplode(places).alias("turn", "path"))
    best = tried.join(files.select("path").distinct(), "path").groupBy("media_id").agg(F.min_by("path", "turn").alias("path"))
    out = ids.join(best, "media_id", "left")
    status = F.when(F.col("media_id").isNull() | (F.col("media_id") <= 0), 400).when(F.col("path").isNull(), 404).otherwise(200)
    mime = F.when(F.col("path").isNotNull(), F.coalesce(*[F.when(sources.extension("path") == k, v) for k, v in MIME.items()], F.lit("application/octet-stream")))
    return out.select("media_id", status.alias("status"), "path", mime.alias("mime"))


def unseen_texts(items: DataFrame, excluded: DataFrame, seed: int, most: int = 8) -> DataFrame:
    """QRY12. ``most`` items (1 to 20) with a transcript that aren't ``excluded``, those of the chat folder last, else in an order that ``seed`` draws; blanks compacted."""
    rows = items.where("transcript <> ''").join(excluded.select("media_id").distinct(), "media_id", "left_anti")
    drawn = F.md5(F.concat_ws(":", F.col("media_id").cast("string"), F.lit(str(seed))))
    best = rows.orderBy(F.coalesce(F.col("folder") == "telegram", F.lit(False)), drawn, "media_id").limit(max(1, min(20, most)))
    return best.withColumn("transcript", F.trim(F.regexp_replace("transcript", r"(?U)\s+", " ")))


def sidebar(items: DataFrame, colors: Sequence[str]) -> DataFrame:
    """QRY20. (section, name, n) of the summary beside the map: items by kind (``otro`` without one), first and last day, different provinces, places and colours."""
    kinds = items.groupBy(F.coalesce("kind", F.lit("otro")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("kind").alias("section"), "name", "n")
    day = lambda c: F.date_format(c, "MM-dd")
    dates = items.agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("ts").alias("n")).select(F.lit("dates").alias("section"), F.concat_ws("-", day("a"), day("b")).alias("name"), "n")
    values = items.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.col(c).alias("name")) for s, c in [("province", "province"), ("place", "place"), *[("color", c) for c in colors]]])).alias("v")).select("v.*")
    names = values.where("name is not null and name <> ''").groupBy("section", "name").agg(F.count("*").alias("n"))
    different = names.groupBy("section").agg(F.count("*").alias("n")).select("section", F.lit("different").alias("name"), "n")
    return kinds.unionByName(dates).unionByName(different)


def place_provinces(items: DataFrame, order: str) -> DataFrame:
    """QRY20. (place, province): of each place the province that comes last in ``order``."""
    known = items.where("place <> '' and province <> ''")
    return known.groupBy("place").agg(F.max_by("province", F.struct(order, "province")).alias("province"))


# --- the same over the test tables --------------------------------------------------------------------------

_TWO = lambda c: F.lpad(c.cast("string"), 2, "0")


def _test_files(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(existing, files, facts): every document is a file of one of six kinds; a tenth is in the archive."""
    i = F.col("doc_id")
    block = F.floor(i / 60)
    folder = F.concat(F.when(block % 3 == 0, "SONY ").when(block % 3 == 1, "Lucas ").otherwise("viaje "), block.cast("string"))
    camera = lambda n: F.concat(F.lit("C"), F.lpad((n % 10_000).cast("string"), 4, "0"))
    s = i.cast("string")
    stamped = F.concat(F.lit("2024-"), _TWO(1 + i % 12), F.lit("-"), _TWO(1 + i % 28), F.lit("-"), _TWO(i % 24), F.lit("-"), _TWO(i % 60), F.lit("_"), s, F.lit(".jpg"))
    name = F.when(i % 6 == 0, stamped).when(i % 6 == 1, F.concat(camera(i), F.lit(".MP4"))).when(i % 6 == 2, F.concat(F.lit("IMG_"), s, F.lit(".jpg"))).when(i % 6 == 3, F.concat(F.lit("voice_"), s, F.lit(".ogg")))
    name = name.when((i % 6 == 4) & (i % 4 == 0), F.concat(F.lit("IMG_"), (i - 2).cast("string"), F.lit(".AAE"))).when(i % 6 == 4, F.concat(F.lit("note_"), s, F.lit(".txt"))).otherwise(F.concat(camera(i - 4), F.lit("M01.XML")))
    docs = table(spark, d, "documents").select(i, F.concat(F.lit("a/"), folder, F.lit("/"), name).alias("path"), F.length("text").cast("long").alias("size"), F.concat(F.md5("text"), F.lit("-"), (i % 2).cast("string")).alias("fingerprint"), F.md5("text").alias("content_hash"))
    day = _TWO(1 + i % 28)
    of = lambda kind, rest, key, value: F.when((i % 6 == kind) & rest, F.struct(F.lit(key).alias("key"), value.alias("value")))
    pairs = F.array(
        of(2, i % 5 == 0, "exif_datetimeoriginal", F.concat(F.lit("2024:03:"), day, F.lit(" 10:20:30"))),
        of(2, i % 5 == 1, "exif_createdate", F.concat(F.lit("2024-04-"), day, F.lit("T10:20:30+02:00"))),
        of(2, i % 5 == 2, "exif_modifydate", F.lit("bad")),
        of(2, i % 4 == 2, "composite_gpsposition", F.concat(F.lit("-"), (30 + i % 10).cast("string"), F.lit(".5 -"), (60 + i % 5).cast("string"), F.lit(".25"))),
        of(2, i % 7 == 0, "exif_artist", F.lit(" Ana ")),
        of(1, i % 5 < 3, "fmt_tag_creation_time", F.concat(F.lit("2024-05-"), day, F.lit("T01:02:03Z"))),
        of(1, F.lit(True), "duration_secs", F.concat((i % 300).cast("string"), F.lit(".5"))),
        of(1, i % 7 == 0, "xmp_spherical", F.lit("true")),
        of(5, i % 5 == 0, "sony_creationdate", F.concat(F.lit("2024-06-"), day, F.lit("T01:02:03-03:00"))),
        of(5, i % 5 < 2, "sony_device_modelName", F.lit("ILCE")),
        of(3, i % 5 < 4, "fmt_tag_creation_time", F.concat(F.lit("2024-07-"), day, F.lit("T05:06:07Z"))),
        of(3, F.lit(True), "duration_secs", F.concat((i % 90).cast("string"), F.lit(".25"))),
    )
    facts = docs.select("path", F.explode(F.array_compact(pairs)).alias("a")).select("path", "a.*")
    existing = docs.where(i % 10 == 0).select(i.alias("media_id"), F.concat("content_hash", F.lit("-0")).alias("file_hash"), "content_hash")
    return existing, docs.drop("doc_id"), facts


_FILES_SQL = """f AS (SELECT doc_id, (CASE (doc_id // 60) % 3 WHEN 0 THEN 'SONY ' WHEN 1 THEN 'Lucas ' ELSE 'viaje ' END) || (doc_id // 60) AS folder, lpad((1 + doc_id % 28)::VARCHAR, 2, '0') AS dd,
  CASE doc_id % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'image' WHEN 3 THEN 'audio' WHEN 4 THEN CASE WHEN doc_id % 4 = 0 THEN 'sidecar_aae' ELSE 'text' END ELSE 'sidecar_xml' END AS kind,
  CASE doc_id % 6 WHEN 0 THEN '2024-' || lpad((1 + doc_id % 12)::VARCHAR, 2, '0') || '-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || '-' || lpad((doc_id % 24)::VARCHAR, 2, '0') || '-' || lpad((doc_id % 60)::VARCHAR, 2, '0') || '_' || doc_id || '.jpg'
    WHEN 1 THEN 'C' || lpad((doc_id % 10000)::VARCHAR, 4, '0') || '.MP4' WHEN 2 THEN 'IMG_' || doc_id || '.jpg' WHEN 3 THEN 'voice_' || doc_id || '.ogg'
    WHEN 4 THEN CASE WHEN doc_id % 4 = 0 THEN 'IMG_' || (doc_id - 2) || '.AAE' ELSE 'note_' || doc_id || '.txt' END ELSE 'C' || lpad(((doc_id - 4) % 10000)::VARCHAR, 4, '0') || 'M01.XML' END AS name,
  md5(text) AS content, doc_id % 6 AS m FROM documents),
t AS (SELECT f.*, 'a/' || f.folder || '/' || f.name AS path, coalesce(f.content || '-' || (f.doc_id % 2), 'path:a/' || f.folder || '/' || f.name) AS fp, s.doc_id IS NOT NULL AS lent,
  CASE f.m WHEN 0 THEN make_timestamp(2024, 1 + f.doc_id % 12, 1 + f.doc_id % 28, f.doc_id % 24, f.doc_id % 60, 0) + INTERVAL 3 HOUR
    WHEN 1 THEN CASE WHEN s.doc_id % 5 = 0 THEN ('2024-06-' || s.dd || ' 04:02:03')::TIMESTAMP WHEN f.doc_id % 5 < 3 THEN ('2024-05-' || f.dd || ' 01:02:03')::TIMESTAMP END
    WHEN 2 THEN CASE f.doc_id % 5 WHEN 0 THEN ('2024-03-' || f.dd || ' 13:20:30')::TIMESTAMP WHEN 1 THEN ('2024-04-' || f.dd || ' 08:20:30')::TIMESTAMP END
    WHEN 3 THEN CASE WHEN f.doc_id % 5 < 4 THEN ('2024-07-' || f.dd || ' 05:06:07')::TIMESTAMP END END AS ts,
  CASE f.m WHEN 1 THEN f.doc_id % 300 + 0.5 WHEN 3 THEN f.doc_id % 90 + 0.25 END::DOUBLE AS dur, s.doc_id % 5 < 2 AS model, s.doc_id AS sid
  FROM f LEFT JOIN f s ON f.m = 1 AND s.doc_id = f.doc_id + 4),
x AS (SELECT doc_id AS media_id, md5(text) || '-0' AS fp, md5(text) AS content FROM documents WHERE doc_id % 10 = 0),
g AS (SELECT t.*, min(path) FILTER (ts IS NOT NULL) OVER (PARTITION BY fp) AS first, fp IN (SELECT fp FROM x WHERE fp IS NOT NULL) AS there FROM t WHERE kind NOT LIKE 'sidecar%'),
o AS (SELECT *, CASE WHEN there OR path > first THEN 'duplicate' WHEN path = first THEN 'inserted' ELSE 'undated' END AS outcome, CASE WHEN kind = 'video' THEN fp WHEN content IS NULL THEN NULL ELSE content END AS body FROM g),
n AS (SELECT *, (SELECT max(media_id) FROM x) + row_number() OVER (ORDER BY path) AS media_id FROM o WHERE outcome = 'inserted'),
c AS (SELECT n.*, coalesce((SELECT min(media_id) FROM x WHERE x.content = n.body), CASE WHEN body IS NOT NULL AND min(media_id) OVER (PARTITION BY body) < media_id THEN min(media_id) OVER (PARTITION BY body) END) AS same_content FROM n)"""


@query(f"""WITH {_FILES_SQL} SELECT o.path, o.outcome, c.media_id, c.same_content FROM o LEFT JOIN c USING (path) UNION ALL SELECT path, kind, NULL, NULL FROM t WHERE kind LIKE 'sidecar%'""")
def ingest_outcomes(spark, d):
    """JOB1, SET5, SET6: what becomes of each file."""
    return ingest_files(*_test_files(spark, d), folders={"Lucas": "Lucas P"})["outcomes"]


@query(f"""WITH {_FILES_SQL} SELECT media_id, kind, CASE WHEN m = 1 AND doc_id % 7 = 0 THEN '360' END AS subtype, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, strftime(ts + to_milliseconds((coalesce(dur, 0) * 1000)::BIGINT), '%Y-%m-%d %H:%M:%S') AS until, dur AS duration_s,
CASE WHEN m = 2 AND doc_id % 4 = 2 THEN -(30 + doc_id % 10 + 0.5)::DOUBLE END AS lat, CASE WHEN m = 2 AND doc_id % 4 = 2 THEN -(60 + doc_id % 5 + 0.25)::DOUBLE END AS lon,
CASE WHEN kind NOT IN ('image', 'video') THEN NULL WHEN m = 2 AND doc_id % 7 = 0 THEN 'Ana' WHEN folder LIKE 'Lucas%' THEN 'Lucas P' WHEN m = 1 AND model THEN '? ILCE' WHEN folder NOT LIKE 'SONY%' THEN folder END AS author,
CASE WHEN kind NOT IN ('image', 'video') THEN NULL WHEN m = 2 AND doc_id % 7 = 0 THEN 'exif' WHEN folder LIKE 'Lucas%' THEN 'folder' WHEN m = 1 AND model THEN 'exif' WHEN folder NOT LIKE 'SONY%' THEN 'folder' END AS author_source FROM c""")
def ingest_items(spark, d):
    """JOB1, SRC7, D1, D2, D4, S27, FLT14: the items with what their metadata say."""
    items = ingest_files(*_test_files(spark, d), folders={"Lucas": "Lucas P"})["items"]
    return items.select("media_id", "kind", "subtype", _stamp("ts").alias("at"), _stamp("end_ts").alias("until"), "duration_s", "lat", "lon", "author", "author_source")


@query(f"""WITH {_FILES_SQL}, u AS (SELECT * FROM o UNION ALL BY NAME SELECT *, NULL AS first, false AS there, kind AS outcome, NULL AS body FROM t WHERE kind LIKE 'sidecar%')
SELECT outcome, count(*)::BIGINT AS n FROM u GROUP BY 1 UNION ALL SELECT 'same_content', count(same_content)::BIGINT FROM c UNION ALL SELECT 'inserted_undated', 0""")
def ingest_report(spark, d):
    """JOB1, AG1."""
    return ingest_files(*_test_files(spark, d), folders={"Lucas": "Lucas P"})["report"]


def _test_export(spark, d) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(state, messages, available files): turns of conversations as messages of three chats, those of every fourth conversation already there without their files."""
    r, null = F.col("r"), F.lit(None).cast("string")
    rows = table(spark, d, "conversations").select("*", (F.col("conv_id") * 1000 + F.col("turn")).alias("r"))
    number = lambda n: F.floor(r / n).cast("string")
    file = F.when(r % 4 == 1, F.concat(F.lit("files/"), number(5), F.lit(".bin")))
    media = F.when(r % 4 == 1, F.when(r % 5 == 0, "voice_message").when(r % 5 == 1, "video_file").when(r % 5 == 2, "sticker"))
    export = rows.select(
        "conv_id", (F.col("conv_id") % 3 + 1).alias("chat_id"), F.when(r % 17 != 0, r).alias("id"), F.when(r % 13 == 0, "service").otherwise("message").alias("type"), r.alias("place"), F.lit("2025-08-08T11:21:29").alias("date"), F.col("role").alias("from"), "text",
        F.when(r % 3 == 0, F.concat(F.lit("photos/"), number(7), F.lit(".jpg"))).alias("photo"), file.alias("file"), media.alias("media_type"), F.when((r % 4 == 1) & (r % 5 == 3), "audio/ogg").otherwise(null).alias("mime_type"),
        F.when(r % 11 == 0, F.struct(F.lit(1.5).alias("latitude"), F.lit(2.5).alias("longitude"))).alias("location"),
    )
    files = rows.where(F.floor(r / 7) % 4 != 0).select(F.concat(F.lit("photos/"), number(7), F.lit(".jpg")).alias("file"), F.md5(F.concat(F.lit("p"), number(14))).alias("file_hash"))
    files = files.unionByName(rows.where(F.floor(r / 5) % 4 != 0).select(F.concat(F.lit("files/"), number(5), F.lit(".bin")).alias("file"), F.md5(F.concat(F.lit("f"), number(5))).alias("file_hash"))).distinct()
    there = export.where("conv_id % 4 = 0 and id is not null").drop("conv_id")
    items = rows.where(F.floor(r / 14) % 3 == 0).select((F.floor(r / 14) + 1).alias("media_id"), F.md5(F.concat(F.lit("p"), number(14))).alias("file_hash"), F.lit("other").alias("type")).distinct()
    items = items.withColumns({"chat_id": F.lit(None).cast("long"), "message_id": F.lit(None).cast("long")})
    attributes_ = items.select("media_id", F.lit("fuente").alias("key"), F.lit("camera").alias("value")).limit(0)
    state = {"messages": message_rows(there), "attachments": attachment_rows(there).withColumn("media_id", F.lit(None).cast("long")), "items": items, "attributes": attributes_}
    return state, export.drop("conv_id"), files


_CHAT_SQL = """r AS (SELECT *, conv_id * 1000 + turn AS r FROM conversations),
e AS (SELECT *, conv_id % 3 + 1 AS chat_id, CASE WHEN r % 17 <> 0 THEN r END AS id, conv_id % 4 = 0 AS there FROM r),
a AS (SELECT chat_id, id, there, r, 'photo' AS kind, 'photos/' || (r // 7) || '.jpg' AS file, 'image' AS type, 0 AS sub FROM e WHERE id IS NOT NULL AND r % 3 = 0
  UNION ALL SELECT chat_id, id, there, r, CASE r % 5 WHEN 0 THEN 'voice_message' WHEN 1 THEN 'video_file' WHEN 2 THEN 'sticker' ELSE 'document' END, 'files/' || (r // 5) || '.bin', CASE r % 5 WHEN 0 THEN 'audio' WHEN 1 THEN 'video' WHEN 3 THEN 'audio' ELSE 'other' END, 1 FROM e WHERE id IS NOT NULL AND r % 4 = 1
  UNION ALL SELECT chat_id, id, there, r, 'location', '', 'other', 2 FROM e WHERE id IS NOT NULL AND r % 11 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY chat_id, id ORDER BY sub) - 1 AS place FROM a),
v AS (SELECT DISTINCT 'photos/' || (r // 7) || '.jpg' AS file, md5('p' || (r // 14)) AS hash FROM r WHERE (r // 7) % 4 <> 0 UNION SELECT DISTINCT 'files/' || (r // 5) || '.bin', md5('f' || (r // 5)) FROM r WHERE (r // 5) % 4 <> 0),
y AS (SELECT DISTINCT r // 14 + 1 AS media_id, md5('p' || (r // 14)) AS hash FROM r WHERE (r // 14) % 3 = 0),
k AS (SELECT p.*, v.hash, row_number() OVER (ORDER BY there, CASE WHEN there THEN 0 ELSE r END, chat_id, id, place) AS turn FROM p JOIN v USING (file) WHERE kind <> 'sticker' AND file <> ''),
h AS (SELECT hash, min(turn) AS first, arg_max(type, turn) AS type, arg_max(chat_id, turn) AS chat_id, arg_max(id, turn) AS message_id, arg_min(r, turn) AS r0 FROM k GROUP BY 1),
b AS (SELECT h.*, (SELECT coalesce(max(media_id), 0) FROM y) + row_number() OVER (ORDER BY first) AS media_id FROM h WHERE hash NOT IN (SELECT hash FROM y)),
i AS (SELECT hash, media_id FROM y UNION ALL SELECT hash, media_id FROM b)"""


@query(f"""WITH {_CHAT_SQL} SELECT y.media_id, y.hash AS file_hash, coalesce(h.type, 'other') AS type, h.chat_id, h.message_id FROM y LEFT JOIN h USING (hash) UNION ALL SELECT media_id, hash, type, chat_id, message_id FROM b""")
def chat_items(spark, d):
    """QRY21, JOB4, JN4: items behind an import, with those that were there, their types mended."""
    return import_chat(*_test_export(spark, d))[0]["items"]


@query(f"""WITH {_CHAT_SQL} SELECT p.chat_id, p.id AS message_id, p.place, p.kind, p.file, i.media_id FROM p LEFT JOIN k ON p.chat_id = k.chat_id AND p.id = k.id AND p.place = k.place LEFT JOIN i ON k.hash = i.hash""")
def chat_links(spark, d):
    """QRY21, S23: attachments and their items; files that were missing before are found again."""
    out = import_chat(*_test_export(spark, d))[0]["attachments"]
    return out.select("chat_id", "message_id", F.col("place").cast("long").alias("place"), "kind", "file", "media_id")


@query(f"""WITH {_CHAT_SQL} SELECT chat_id, id AS message_id, CASE WHEN r % 13 = 0 THEN 'system' WHEN r % 3 = 0 THEN 'photo' WHEN r % 11 = 0 THEN 'location' WHEN r % 4 <> 1 THEN 'text' WHEN r % 5 = 0 THEN 'voice' WHEN r % 5 = 1 THEN 'video' WHEN r % 5 = 2 THEN 'sticker' WHEN r % 5 = 3 THEN 'audio' ELSE 'document' END AS message_type,
r % 13 = 0 AS is_system, role AS from_name, '2025-08-08T11:21:29Z' AS date_utc, length(text) AS chars FROM e WHERE id IS NOT NULL""")
def chat_rows(spark, d):
    """QRY21, S22, S23, SNK2: messages behind an update, each once."""
    out = import_chat(*_test_export(spark, d), mode="update")[0]["messages"]
    return out.select("chat_id", "message_id", "message_type", "is_system", "from_name", "date_utc", F.length("text").cast("long").alias("chars"))


@query(f"""WITH {_CHAT_SQL}, z AS (SELECT 'total' AS name, count(*) AS n FROM e UNION ALL SELECT 'messages', count(*) FROM e WHERE id IS NOT NULL AND NOT there UNION ALL SELECT 'system', count(*) FROM e WHERE id IS NOT NULL AND r % 13 = 0
UNION ALL SELECT 'registered', count(*) FROM p WHERE NOT there UNION ALL SELECT 'ingested', count(*) FROM k UNION ALL SELECT 'recovered', count(*) FROM k WHERE there UNION ALL SELECT 'skipped', count(*) FROM e WHERE id IS NULL OR there) SELECT name, n::BIGINT AS n FROM z""")
def chat_report(spark, d):
    """QRY21, AG1."""
    return import_chat(*_test_export(spark, d))[1]


def _test_track(spark, d, mode: str):
    item = items_(spark, d)
    points = track_points(item).select(F.concat(F.lit("t"), (F.col("point_id") % 3).cast("string")).alias("file"), "ts", F.col("plat").alias("latitude"), F.col("plon").alias("longitude"), F.col("ele").alias("elevation"))
    nation = table(spark, d, "nation").select(F.concat(F.lit("t"), (F.col("n_nationkey") % 3).cast("string")).alias("file"), F.col("n_name").alias("name"))
    tracks = item.where("media_id < 2").select((F.col("media_id") + 1).alias("track_id"), F.concat(F.lit("old"), F.col("media_id").cast("string")).alias("file"), F.lit(0).cast("long").alias("total_points"))
    state = {"tracks": tracks.withColumns({"begins": F.lit(None).cast("timestamp"), "ends": F.lit(None).cast("timestamp")}), "waypoints": nation.select(F.lit(1).cast("long").alias("track_id"), "name").where("name < 'B'"), "items": item.select("media_id", "ts", "lat", "lon", "alt")}
    return import_track(state, points, nation, mode)


@query(f"""WITH {ITEM_SQL}, {TRACK_SQL}, q AS (SELECT ts, ele FROM track WHERE ele IS NOT NULL), l AS (SELECT * FROM item WHERE lat IS NOT NULL), b AS (SELECT media_id, l.ts, q.ts AS t0, q.ele AS e0 FROM l ASOF LEFT JOIN q ON l.ts >= q.ts), f AS (SELECT media_id, q.ts AS t1, q.ele AS e1 FROM l ASOF LEFT JOIN q ON l.ts <= q.ts),
w AS (SELECT media_id, CASE WHEN t0 IS NULL OR epoch_us(t1) - epoch_us(ts) <= epoch_us(ts) - epoch_us(t0) THEN e1 ELSE e0 END AS alt FROM b JOIN f USING (media_id))
SELECT i.media_id, coalesce(w.alt, i.alt) AS alt, CASE WHEN w.alt IS NOT NULL THEN 'track_gps' END AS geo_source FROM item i LEFT JOIN w USING (media_id)""")
def track_altitudes(spark, d):
    """JOB3, JN10: every item with a position gets the track's altitude."""
    return _test_track(spark, d, "update")[0]["items"].select("media_id", "alt", "geo_source")


@query(f"""WITH {ITEM_SQL}, {TRACK_SQL}, h AS (SELECT 't' || (point_id % 3) AS file, min(ts) AS a, max(ts) AS b, count(*) AS n FROM track GROUP BY 1), g AS (SELECT 2 + row_number() OVER (ORDER BY file) AS track_id, * FROM h)
SELECT track_id, file, strftime(a, '%Y-%m-%d %H:%M:%S') AS begins, strftime(b, '%Y-%m-%d %H:%M:%S') AS ends, n::BIGINT AS total_points, (SELECT count(*) FROM nation WHERE 't' || (n_nationkey % 3) = file)::BIGINT AS waypoints FROM g
UNION ALL SELECT media_id + 1, 'old' || media_id, NULL, NULL, 0, CASE WHEN media_id = 0 THEN (SELECT count(*) FROM nation WHERE n_name < 'B') ELSE 0 END FROM item WHERE media_id < 2""")
def track_headers(spark, d):
    """JOB3, SNK1: tracks with their waypoints."""
    out = _test_track(spark, d, "skip")[0]
    per = out["waypoints"].groupBy("track_id").agg(F.count("*").alias("n"))
    return out["tracks"].join(per, "track_id", "left").select("track_id", "file", _stamp("begins").alias("begins"), _stamp("ends").alias("ends"), "total_points", F.coalesce("n", F.lit(0)).alias("waypoints"))


def _test_videos(spark, d, mode: str):
    item = items_(spark, d)
    i = F.col("media_id")
    rows = item.select("media_id", F.col("kind").alias("type"), F.when(i % 3 == 0, "360").alias("subtype"), F.when(i % 4 == 0, "Ana").otherwise(F.when(i % 4 == 1, "")).alias("author"), F.lit(None).cast("string").alias("author_source"))
    old = F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))) for c, k, v in ((i % 5 == 0, "xml_devicemanufacturer", "Old"), (i % 2 == 0, "xmp_lens", "old"), (i % 3 == 0, "iso", "100"))])))
    new = F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))) for c, k, v in ((i % 2 == 1, "xml_devicemanufacturer", "Sony"), (i % 4 > 1, "xml_devicemodelname", "ILCE"), (i % 6 == 0, "xmp_ProjectionType", "equirectangular"), (i % 7 > 0, "iso", "200"))])))
    pairs = lambda e: item.select("media_id", e.alias("a")).select("media_id", "a.*")
    return video_metadata(rows, pairs(old), pairs(new), mode)


_VIDEO_SQL = f"""{ITEM_SQL}, v AS (SELECT media_id, kind, CASE WHEN media_id % 3 = 0 THEN '360' END AS subtype, CASE media_id % 4 WHEN 0 THEN 'Ana' WHEN 1 THEN '' END AS author, kind = 'video' AND (media_id % 2 = 1 OR media_id % 4 > 1 OR media_id % 6 = 0 OR media_id % 7 > 0) AS anew FROM item),
od AS (SELECT media_id, 'xml_devicemanufacturer' AS key, 'Old' AS value FROM item WHERE media_id % 5 = 0 UNION ALL SELECT media_id, 'xmp_lens', 'old' FROM item WHERE media_id % 2 = 0 UNION ALL SELECT media_id, 'iso', '100' FROM item WHERE media_id % 3 = 0),
nw AS (SELECT media_id, 'xml_devicemanufacturer' AS key, 'Sony' AS value FROM v WHERE anew AND media_id % 2 = 1 UNION ALL SELECT media_id, 'xml_devicemodelname', 'ILCE' FROM v WHERE anew AND media_id % 4 > 1 UNION ALL SELECT media_id, 'xmp_ProjectionType', 'equirectangular' FROM v WHERE anew AND media_id % 6 = 0 UNION ALL SELECT media_id, 'iso', '200' FROM v WHERE anew AND media_id % 7 > 0),
st AS (SELECT od.* FROM od JOIN v USING (media_id) WHERE NOT (anew AND key LIKE 'xm%'))"""


@query(f"""WITH {_VIDEO_SQL} SELECT * FROM st UNION ALL SELECT * FROM nw WHERE (media_id, key) NOT IN (SELECT (media_id, key) FROM st)""")
def video_attributes(spark, d):
    """JOB13, SNK3, SNK6: attributes behind an update from what was read anew from videos."""
    return _test_videos(spark, d, "update")[1]


@query(f"""WITH {_VIDEO_SQL}, cam AS (SELECT media_id, trim(CASE WHEN media_id % 2 = 1 THEN 'Sony ' ELSE '' END || CASE WHEN media_id % 4 > 1 THEN 'ILCE' ELSE '' END) AS camera FROM v WHERE anew)
SELECT media_id, CASE WHEN anew THEN CASE WHEN media_id % 6 = 0 THEN '360' END ELSE subtype END AS subtype, CASE WHEN coalesce(author, '') = '' AND camera <> '' THEN camera ELSE author END AS author, CASE WHEN coalesce(author, '') = '' AND camera <> '' THEN 'exif' END AS author_source FROM v LEFT JOIN cam USING (media_id)""")
def video_cameras(spark, d):
    """JOB13, FLT14, S27: spheres and cameras behind that update."""
    return _test_videos(spark, d, "update")[0].drop("type")


@query("""WITH t AS (SELECT doc_id, text, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS media_id, 'transcript' AS key, replace(text, chr(10), ' ') AS value FROM t
UNION ALL SELECT doc_id, 'transcript_info', '{"modelo":"m","idioma":"es","probabilidad_idioma":' || round((doc_id % 7) / 8.0::DOUBLE, 2) || ',"duracion_seg":' || (n * 2 - 0.5::DOUBLE) || ',"segmentos":' || n || '}' FROM t
UNION ALL SELECT doc_id, 'keep', 'x' FROM documents UNION ALL SELECT doc_id, 'transcript', 'x' FROM documents WHERE text IS NULL""")
def transcript_store(spark, d):
    """JOB21, S13, SNK2: the lines of documents as segments of transcripts, over older rows."""
    docs = table(spark, d, "documents")
    segment = lambda x, i: F.struct((i * 2.0).alias("start"), (i * 2.0 + 1.5).alias("end"), x.alias("text"))
    spoken = docs.select(F.col("doc_id").alias("media_id"), F.transform(F.split("text", "\n"), segment).alias("segments"), F.lit("es").alias("language"), ((F.col("doc_id") % 7) / 8).alias("probability"), F.lit("m").alias("model"))
    older = docs.select(F.col("doc_id").alias("media_id"), F.explode(F.array(F.lit("transcript"), F.lit("keep"))).alias("key")).withColumn("value", F.lit("x"))
    return store_transcripts(older, spoken.where("segments is not null")).where("key <> 'transcript_segments'")


@query(f"""WITH {ITEM_SQL}, fl AS (SELECT media_id, CASE media_id % 5 WHEN 0 THEN 'n/' ELSE '' END || folder || '/' || media_id || CASE media_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.mp4' WHEN 2 THEN '.ogg' ELSE '.bin' END AS path FROM item WHERE media_id % 11 <> 0),
pa AS (SELECT media_id, folder || '/' || media_id || CASE media_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.mp4' WHEN 2 THEN '.ogg' ELSE '.bin' END AS path FROM item), q AS (SELECT DISTINCT media_id * 3 - 5 AS media_id FROM item)
SELECT q.media_id, CASE WHEN q.media_id <= 0 THEN 400 WHEN fl.path IS NULL THEN 404 ELSE 200 END AS status, CASE WHEN q.media_id > 0 THEN fl.path END AS path, CASE WHEN q.media_id <= 0 OR fl.path IS NULL THEN NULL ELSE (['image/jpeg', 'video/mp4', 'audio/ogg', 'application/octet-stream'])[q.media_id % 4 + 1] END AS mime
FROM q LEFT JOIN fl USING (media_id)""")
def media_lookup(spark, d):
    """QRY19: a third of all ids and some that are none; every fifth file lies below another root, every eleventh is gone."""
    item = items_(spark, d)
    i = F.col("media_id")
    end = F.when(i % 4 == 0, ".JPG").when(i % 4 == 1, ".mp4").when(i % 4 == 2, ".ogg").otherwise(".bin")
    paths = item.select("media_id", F.concat(F.col("folder").cast("string"), F.lit("/"), i.cast("string"), end).alias("path"))
    there = paths.where(i % 11 != 0).select(F.concat(F.when(i % 5 == 0, "n/").otherwise(""), F.col("path")).alias("path"))
    return lookup(item.select((i * 3 - 5).alias("media_id")), paths, there, ("gone", "n/"))


@query("""SELECT doc_id AS media_id, source AS folder, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS transcript FROM documents WHERE text <> '' AND doc_id % 3 <> 0 ORDER BY source = 'telegram', md5(doc_id || ':5'), doc_id LIMIT 8""")
def unseen_transcripts(spark, d):
    """QRY12, FLT9, SRT4, S25."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("media_id"), F.col("source").alias("folder"), F.col("text").alias("transcript"))
    return unseen_texts(rows, rows.where("media_id % 3 = 0"), 5)


@query(f"""WITH {ITEM_SQL}, s AS (SELECT 'kind' AS section, kind AS name, count(*) AS n FROM item GROUP BY ALL UNION ALL SELECT 'dates', strftime(min(ts), '%m-%d') || '-' || strftime(max(ts), '%m-%d'), count(ts) FROM item
UNION ALL SELECT 'different_province', '', count(DISTINCT province) FROM item UNION ALL SELECT 'different_place', '', count(DISTINCT place) FROM item UNION ALL SELECT 'different_color', '', count(DISTINCT c) FROM (SELECT color1 AS c FROM item UNION ALL SELECT color2 FROM item UNION ALL SELECT color3 FROM item))
SELECT CASE WHEN section LIKE 'different%' THEN substr(section, 11) ELSE section END AS section, CASE WHEN section LIKE 'different%' THEN 'different' ELSE name END AS name, n::BIGINT AS n FROM s""")
def sidebar_summary(spark, d):
    """QRY20, AG2, AG7."""
    return sidebar(items_(spark, d), ["color1", "color2", "color3"])


@query(f"WITH {ITEM_SQL} SELECT k AS place, arg_max(place, media_id) AS province FROM item WHERE k <> '' AND place <> '' GROUP BY 1")
def province_of_place(spark, d):
    """QRY20: the last one of each."""
    return place_provinces(items_(spark, d).select("media_id", F.col("k").alias("place"), F.col("place").alias("province")), "media_id")
