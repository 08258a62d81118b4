"""Technical metadata: EXIF and probe JSON, 360 degree and container rules, authors, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROBE = "struct<streams: array<struct<codec_type: string, codec_name: string, width: int, height: int, avg_frame_rate: string, sample_rate: string, channels: int>>, format: struct<duration: string, bit_rate: string, tags: map<string, string>>>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flat_exif(text) -> Column:
    """SRC5. ``{"Group:Name": v}`` as a map of ``group_name`` to text."""
    found = F.from_json(_c(text), "map<string, string>")
    return F.map_from_entries(F.transform(F.map_entries(found), lambda e: F.struct(F.regexp_replace(F.lower(e["key"]), "[: ]+", "_").alias("key"), e["value"].alias("value"))))


def flat_probe(text) -> Column:
    """SRC6. First video and audio stream and the format of a probe's JSON; the frame rate has 3 decimals."""
    p = F.from_json(_c(text), PROBE)
    first = lambda kind: F.get(F.filter(p["streams"], lambda s: s["codec_type"] == kind), 0)
    video, audio = first("video"), first("audio")
    rate = F.split(video["avg_frame_rate"], "/")
    fps = F.round(F.try_divide(F.get(rate, 0).try_cast("double"), F.coalesce(F.get(rate, 1).try_cast("double"), F.lit(1.0))), 3)
    return F.struct(video["codec_name"].alias("video_codec"), video["width"].alias("width"), video["height"].alias("height"), fps.alias("fps"), audio["codec_name"].alias("audio_codec"), audio["channels"].alias("channels"), p["format"]["duration"].try_cast("double").alias("duration"), p["format"]["bit_rate"].try_cast("long").alias("bit_rate"), p["format"]["tags"].alias("tags"))


def container_state(text) -> Column:
    """S29, JOB25. video, audio, both, none or unreadable, by the streams of a probe's JSON."""
    s = F.from_json(_c(text), PROBE)["streams"]
    has = lambda k: F.exists(s, lambda x: x["codec_type"] == k)
    return F.when(s.isNull(), "unreadable").when(has("video") & has("audio"), "both").when(has("video"), "video").when(has("audio"), "audio").otherwise("none")


def is_360(tags: Column, width, height, marks: tuple[str, ...] = ("projection", "spherical", "stitch")) -> Column:
    """FLT14. A tag that names a sphere and says yes, or a picture twice as wide as high from 3840 on."""
    by_tag = F.exists(F.map_entries(tags), lambda e: F.lower(e["key"]).rlike("|".join(marks)) & F.lower(e["value"]).rlike("true|yes|1|equirectangular"))
    by_shape = (_c(width) >= 3840) & (_c(width) == 2 * _c(height))
    return F.coalesce(by_tag, F.lit(False)) | F.coalesce(by_shape, F.lit(False))


def fitted(width, height, most: int) -> Column:
    """M16. Even width and height that fit in ``most``, never larger than they are."""
    w, h = _c(width), _c(height)
    scale = F.least(F.lit(1.0), most / F.greatest(w, h))
    even = lambda x: (F.floor(x * scale / 2) * 2).cast("int")
    return F.struct(even(w).alias("width"), even(h).alias("height"))


def author(exif_artist, folder, camera, folders: dict[str, str], cameras: dict[str, str]) -> Column:
    """S27. EXIF, else a folder that contains a known name or is contained in one, else the camera's owner, else the folder."""
    f, c = F.lower(_c(folder)), F.lower(_c(camera))
    by_folder = F.coalesce(*[F.when(F.contains(f, F.lit(k.lower())) | F.contains(F.lit(k.lower()), f), v) for k, v in folders.items()], F.lit(None))
    by_camera = F.coalesce(*[F.when(F.contains(c, F.lit(k.lower())), v) for k, v in cameras.items()], F.lit(None))
    return F.coalesce(F.nullif(F.trim(_c(exif_artist)), F.lit("")), by_folder, by_camera, _c(folder))


def moved_path(path, old: str, new: str) -> Column:
    """The path under ``new`` if it lies under ``old``, which must match whole folder names."""
    p, a, b = _c(path), old.rstrip("/"), new.rstrip("/")
    return F.when((p == a) | p.startswith(a + "/"), F.concat(F.lit(b), F.substr(p, F.lit(len(a) + 1)))).otherwise(p)


def slug(text) -> Column:
    from caravel.functions.text import folded

    return F.trim(F.regexp_replace(folded(text), "[^a-z0-9]+", "-"), F.lit("-"))


def camera_class(bitrate, fps) -> Column:
    """M17. Camera by bits a second and frame rate; the first rule that applies."""
    mbps, f = _c(bitrate) / 1e6, _c(fps)
    film = F.abs(f - 29.97) < 0.5
    return F.when(f.isNull() | mbps.isNull(), "desconocida").when(f.between(23.5, 24.5) & mbps.between(35, 55), "B (fps cambiado)").when((mbps >= 55) & film, "A (LA +7h)").when((mbps > 25) & (mbps < 55) & film, "B (UTC+1 −1h)").otherwise("desconocida")


def clock_offset(embedded, named) -> Column:
    """SEQ25. Hours from the time in a file's name to its embedded time, both read as plain clock readings."""
    return (F.unix_micros(_c(embedded)) - F.unix_micros(_c(named))) / 3.6e9


def signed_hours(hours) -> Column:
    """SEQ25. ``+7.0h``."""
    h = _c(hours)
    return F.when(h.isNotNull(), F.concat(F.when(h < 0, "-").otherwise("+"), F.format_string("%.1fh", F.abs(h.cast("double")))))


def first_known(*sources: Column) -> Column:
    """D3, DOC14. Struct (value, source) of the first known of columns, with its place from 1 on."""
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("value"), F.lit(i + 1).alias("source"))) for i, c in enumerate(sources)])
