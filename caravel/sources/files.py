"""Sources: media folders, GPX, Markdown texts, chat exports, sidecars, SQLite tables."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: File extensions by media type.
EXTENSIONS = {
    "image": ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp", "heic", "heif"),
    "video": ("mp4", "mov", "avi", "mkv", "mts", "m2ts", "wmv", "flv", "webm", "mpg", "mpeg"),
    "audio": ("mp3", "wav", "aac", "flac", "ogg", "m4a", "wma", "opus"),
    "text": ("txt", "md", "csv", "json", "xml", "srt", "vtt", "doc", "docx", "pdf"),
    "archive": ("zip", "rar", "7z", "tar", "gz"),
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extension(path) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([A-Za-z0-9]+)$", 1))


def media_type(path) -> Column:
    """image, video, audio, text, archive or other, by extension in any case."""
    out = F.lit("other")
    for kind, names in EXTENSIONS.items():
        out = F.when(extension(path).isin(*names), kind).otherwise(out)
    return out


def walk(spark: SparkSession, folder: str, recursive: bool = True, kinds: tuple[str, ...] = ()) -> DataFrame:
    """SRC3. (path, modified, bytes, kind) of files; hidden folders, ``excluir/`` and ``._*`` files are left out.

    Contents aren't read: the plan only selects the file's facts.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    rows = files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), media_type("path").alias("kind"))
    seen = rows.where(~F.col("path").rlike(r"/(\.[^/]+|excluir)/") & ~F.col("path").rlike(r"/\._[^/]*$"))
    return seen.where(F.col("kind").isin(*kinds)) if kinds else seen


def fingerprint(path, modified, size) -> Column:
    """Quick identity of a file from size and time."""
    return F.md5(F.concat_ws("-", _c(size).cast("string"), F.unix_micros(_c(modified)).cast("string")))


# --- GPX ----------------------------------------------------------------------------------------


def gpx_points(spark: SparkSession, path: str) -> DataFrame:
    """SRC8. All ``trkpt`` under any segment: latitude, longitude, elevation?, time?; points without a position are left out."""
    schema = "_lat double, _lon double, ele double, time string"
    rows = spark.read.format("xml").option("rowTag", "trkpt").schema(schema).load(path)
    return rows.where("_lat is not null and _lon is not null").select(F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude"), F.col("ele").alias("elevation"), "time", F.col("_metadata.file_path").alias("file"))


def gpx_waypoints(spark: SparkSession, path: str) -> DataFrame:
    schema = "_lat double, _lon double, name string, desc string, type string, time string"
    rows = spark.read.format("xml").option("rowTag", "wpt").schema(schema).load(path)
    return rows.where("_lat is not null and _lon is not null").select("name", F.col("desc").alias("description"), "type", F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude"), F.col("time").alias("timestamp"))


def gpx_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(file, start_time, end_time, total_points) of each file."""
    return gpx_points(spark, path).groupBy("file").agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count("*").alias("total_points"))


# --- Markdown texts -------------------------------------------------------------------------------

#: The keys that a section or a front matter may begin with.
TEXT_KEYS = ("autor", "fecha", "tags", "ubicacion")


def markdown_texts(spark: SparkSession, folder: str) -> DataFrame:
    """SRC9. Sections of Markdown files: key ``path::index``, title, body and the keys of ``TEXT_KEYS``.

    Files that begin with ``_`` are left out, comments go, front matter holds for the sections
    that don't say otherwise, and a section begins at ``## ``.
    """
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"(?s)<!--.*?-->", "").alias("t"))
    files = files.where(~F.col("path").rlike(r"/_[^/]*$"))
    front = F.regexp_extract("t", r"(?s)^\s*---\n(.*?)\n---", 1)
    body = F.regexp_replace("t", r"(?s)^\s*---\n.*?\n---\n?", "")
    title = F.regexp_extract(body, r"(?m)^# (.+)$", 1)
    parts = files.select("path", front.alias("front"), F.nullif(title, F.lit("")).alias("collection"), F.posexplode(F.split(body, r"(?m)^## ")).alias("index", "part")).where("index > 0")
    head = F.regexp_extract("part", rf"(?s)^[^\n]*\n((?:\s*(?:{'|'.join(TEXT_KEYS)}):[^\n]*(?:\n|$))*)", 1)
    rows = parts.withColumn("head", head)
    value = lambda k, c: F.nullif(F.trim(F.regexp_extract(c, rf"(?m)^\s*{k}:([^\n]*)$", 1)), F.lit(""))
    keys = [F.coalesce(value(k, "head"), value(k, "front")).alias(k) for k in TEXT_KEYS]
    text = F.regexp_replace(F.substr("part", F.length(F.regexp_extract("part", r"^[^\n]*\n?", 0)) + F.length("head") + 1), r"^\s+|\s+$", "")
    return rows.select(F.concat_ws("::", "path", F.col("index").cast("string")).alias("key"), "collection", F.trim(F.regexp_extract("part", r"^([^\n]*)", 1)).alias("title"), text.alias("body"), *keys, F.col("index").cast("int").alias("index"))


# --- chat exports -----------------------------------------------------------------------------------

MESSAGE = "id long, type string, date string, date_unixtime string, `from` string, from_id string, actor string, text string, photo string, file string, media_type string, mime_type string, location struct<latitude: double, longitude: double>, reply_to_message_id long, file_name string, file_size long, photo_file_size long, duration_seconds double, width int, height int, thumbnail string, poll string, reactions string, members string, action string, actor_id string, edited_unixtime string, grouped_id string"
EXPORT = f"id long, name string, type string, messages array<struct<{', '.join(x.replace(' ', ': ', 1) for x in MESSAGE.split(', ') if 'location' not in x and 'longitude' not in x)}, location: struct<latitude: double, longitude: double>>>"


def repaired_json(text: str | None) -> str | None:
    """A cut export closed again: the text itself if it parses, else cut at the last whole message and closed."""
    if text is None:
        return None
    try:
        json.loads(text)
        return text
    except ValueError:
        pass
    ends = _last_whole(text)
    # the last message of an export's list first, then the last whole thing of any kind
    for cut, stack in sorted(ends.items(), key=lambda e: (e[1] != "{[", -e[0])):
        tail = "".join({"[": "]", "{": "}"}[c] for c in reversed(stack))
        try:
            json.loads(text[: cut + 1] + tail)
            return text[: cut + 1] + tail
        except ValueError:
            continue
    return None


def _last_whole(text: str) -> dict[int, str]:
    """Where the last object of each depth ended, with the brackets that are open there: one pass over the text."""
    open_, inside, escaped, ends = [], False, False, {}
    for i, c in enumerate(text):
        if inside:
            escaped, inside = c == "\\" and not escaped, c != '"' or escaped
        elif c == '"':
            inside = True
        elif c in "[{":
            open_.append(c)
        elif c in "]}" and open_:
            open_.pop()
            if c == "}":
                # only the last end of each depth can be the cut
                ends[len(open_)] = (i, "".join(open_))
    return dict(ends.values())


def chat_messages(spark: SparkSession, path: str) -> DataFrame:
    """SRC10. Messages of ``result.json`` exports with their ``place``, cut ones repaired; an export without messages gives no rows."""

    @F.arrow_udf("string")
    def repair(texts: pa.Array) -> pa.Array:
        return pa.array([repaired_json(t) for t in texts.to_pylist()], pa.string())

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("export"), F.from_json(repair("value"), EXPORT).alias("x"))
    return files.where("x.messages is not null").select("export", F.col("x.id").alias("chat_id"), F.col("x.name").alias("chat"), F.col("x.type").alias("chat_type"), F.posexplode("x.messages").alias("place", "m")).select("export", "chat_id", "chat", "chat_type", "place", "m.*")


def flat_text(text) -> Column:
    """S22. Plain text of a message: itself, or the joined parts of a JSON list of strings and entities."""
    t = _c(text)
    parts = F.from_json(t, "array<string>")
    plain = F.array_join(F.transform(parts, lambda p: F.coalesce(F.get_json_object(p, "$.text"), p)), "")
    return F.when(F.ltrim(t).startswith("["), F.coalesce(plain, t)).otherwise(t)


#: What a message's media type makes it; others are documents.
MESSAGE_KINDS = {"voice_message": "voice", "video_file": "video", "video_message": "video", "animation": "animation", "sticker": "sticker", "audio_file": "audio"}
#: The kind of item that an attachment's media type makes; a sticker is none of the archive's kinds.
ITEM_KINDS = {"photo": "image", "video_file": "video", "video_message": "video", "animation": "video", "voice_message": "audio", "audio_file": "audio", "audio": "audio", "sticker": "other"}


def _of_table(c: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(c == k, v) for k, v in table.items()])


def _of_mime(mime: Column) -> Column:
    return F.coalesce(*[F.when(mime.startswith(f"{k}/"), k) for k in ("video", "audio", "image")])


def message_type(messages: DataFrame) -> Column:
    """S23. system, photo, location, poll, by media type, by the file's MIME type, or text; the first that applies."""
    has = lambda c: F.col(c).isNotNull()
    by_type = F.coalesce(_of_table(F.col("media_type"), MESSAGE_KINDS), F.lit("document"))
    poll = has("poll") if "poll" in messages.columns else F.lit(False)
    by_file = F.coalesce(_of_mime(F.col("mime_type")), F.lit("document"))
    return F.when(F.col("type").eqNullSafe("service"), "system").when(has("photo"), "photo").when(has("location"), "location").when(poll, "poll").when(F.coalesce("media_type", F.lit("")) != "", by_type).when(has("file"), by_file).otherwise("text")


def item_type(media_type_, mime) -> Column:
    """S23. The kind of item that an attachment is: by its media type, else by its MIME type, else ``other``."""
    return F.coalesce(_of_table(_c(media_type_), ITEM_KINDS), _of_mime(_c(mime)), F.lit("other"))


def entity_hashtags(text) -> Column:
    """S22. Sorted different hashtags among the entities of a message, without ``#``, joined by blanks; null if there are none."""
    t = _c(text)
    parts = F.when(F.ltrim(t).startswith("["), F.from_json(t, "array<string>"))
    tags = F.transform(F.filter(parts, lambda p: F.get_json_object(p, "$.type") == "hashtag"), lambda p: F.regexp_replace(F.get_json_object(p, "$.text"), "^#+", ""))
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(F.filter(tags, lambda x: x != ""))), " "), F.lit(""))


def attachments(messages: DataFrame) -> DataFrame:
    """(chat_id, id, kind, file) of photos and files; stickers are never items."""
    pairs = F.array_compact(F.array(F.when(F.col("photo").isNotNull(), F.struct(F.lit("photo").alias("kind"), F.col("photo").alias("file"))), F.when(F.col("file").isNotNull() & ~F.col("media_type").eqNullSafe("sticker"), F.struct(F.coalesce("media_type", F.lit("file")).alias("kind"), F.col("file").alias("file")))))
    return messages.select("chat_id", "id", F.explode(pairs).alias("a")).select("chat_id", "id", "a.*")


# --- nested JSON and sidecars --------------------------------------------------------------------------


def scene_marks(df: DataFrame, key: str, analysis: str) -> DataFrame:
    """JOB14. Marks of ``{"escenas": [...]}``: per scene a keyword list, each keyword and a description; older or broken JSON gives none."""
    shape = "escenas array<struct<indice: int, inicio: double, fin: double, keywords: array<string>, descripcion: string>>"
    scenes = df.select(key, F.explode(F.from_json(analysis, shape)["escenas"]).alias("s"))
    marks = F.array_compact(F.concat(F.array(F.when(F.size("s.keywords") > 0, F.struct(F.lit("scene").alias("key"), F.array_join("s.keywords", ", ").alias("value"))), F.when(F.col("s.descripcion").isNotNull(), F.struct(F.lit("description").alias("key"), F.col("s.descripcion").alias("value")))), F.coalesce(F.transform("s.keywords", lambda k: F.struct(F.lit("keyword").alias("key"), k.alias("value"))), F.array())))
    return scenes.select(key, F.col("s.inicio").alias("offset"), F.explode(marks).alias("m")).select(key, "offset", "m.*")


def hourly(df: DataFrame, variables: tuple[str, ...]) -> DataFrame:
    """SRC11. (day, hour, variables) rows of hourly arrays; short arrays end in nulls."""
    zipped = F.arrays_zip(F.col("hourly.time").alias("time"), *[F.col(f"hourly.{v}").alias(v) for v in variables])
    others = [c for c in df.columns if c != "hourly"]
    rows = df.select(*others, F.explode(zipped).alias("h")).where("h.time is not null")
    return rows.select(*others, F.to_date(F.substring("h.time", 1, 10)).alias("day"), F.substring("h.time", 12, 2).cast("int").alias("hour"), *[f"h.{v}" for v in variables])


def xml_sidecars(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """SRC7. (file, key, value) of the attributes and texts of a camera's XML sidecars, whatever their namespaces: one row for each child of ``tag``."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"(</?|\s)[A-Za-z0-9_]+:(?=[A-Za-z])", "$1").alias("t"))
    inner = rows.select("file", F.regexp_extract("t", rf"(?s)<{tag}\b[^>]*>(.*)</{tag}>", 1).alias("t"))
    parts = inner.select("file", F.explode(F.regexp_extract_all("t", F.lit(r"(<[A-Za-z][^>]*>[^<]*)"), F.lit(1))).alias("p"))
    name = F.lower(F.regexp_extract("p", r"^<([A-Za-z0-9_]+)", 1))
    pairs = F.regexp_extract_all("p", F.lit(r'([A-Za-z0-9_]+="[^"]*")'), F.lit(1))
    attributes_ = F.transform(pairs, lambda a: F.struct(F.concat(name, F.lit("_"), F.lower(F.regexp_extract(a, "^([A-Za-z0-9_]+)", 1))).alias("key"), F.regexp_extract(a, '"([^"]*)"', 1).alias("value")))
    text = F.trim(F.regexp_extract("p", r"(?s)>([^<]*)$", 1))
    own = F.when(text != "", F.array(F.struct(name.alias("key"), text.alias("value")))).otherwise(F.array().cast("array<struct<key: string, value: string>>"))
    return parts.select("file", F.explode(F.concat(own, attributes_)).alias("x")).select("file", "x.*").where("value <> ''")


def valid_sidecars(items: DataFrame, sidecars: DataFrame, key: str) -> DataFrame:
    """SRC13. Sidecars whose fingerprint is still that of their item; stale ones and those without an item are left out."""
    now = items.select(key, F.col("fingerprint").alias("_now"))
    return sidecars.join(now, key).where(F.col("fingerprint") == F.col("_now")).drop("_now")


def cached(places: DataFrame, cache: DataFrame, decimals: int = 3) -> tuple[DataFrame, DataFrame]:
    """SRC14. (places with the cache's columns, cells that the cache lacks); both sides meet by rounded coordinates.

    A place without a position is in no cell. ``cache`` holds cy, cx and what was found for the cell.
    """
    cells = places.withColumn("cy", F.round("latitude", decimals)).withColumn("cx", F.round("longitude", decimals))
    missing = cells.where("cy is not null and cx is not null").select("cy", "cx").distinct().join(cache, ["cy", "cx"], "left_anti")
    return cells.join(cache, ["cy", "cx"], "left").drop("cy", "cx"), missing


# --- SQLite ---------------------------------------------------------------------------------------------


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns = schema.names
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", 4))

    def _connect(self):
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[_Range]:
        with self._connect() as c:
            low, high = c.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.table}"').fetchone()
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)] or [_Range(0, -1)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with self._connect() as c:
            yield from c.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """SRC1, SRC2. ``spark.read.format("caravel_sqlite").option("table", t).load(file)``: rowid ranges as partitions."""

    @classmethod
    def name(cls) -> str:
        return "caravel_sqlite"

    def schema(self) -> str:
        kinds = {"INTEGER": "bigint", "REAL": "double", "BLOB": "binary"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            rows = c.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        if not rows:
            raise ValueError(f"no table {self.options['table']!r} in {self.options['path']}")
        return ", ".join(f"`{r[1]}` {kinds.get(r[2].upper(), 'string')}" for r in rows)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(schema, self.options)
