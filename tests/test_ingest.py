"""Ingestion, chat imports and later jobs against loops over the rows."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caravel.operators import ordered
from caravel.plans import ingest
from caravel.sources import files as sources

FILE = "path string, size long, fingerprint string, content_hash string"
FACT = "path string, key string, value string"
HELD = "media_id long, file_hash string, content_hash string"


def walked(existing, files, undated):
    """The rule in a loop: files in order of path, each with whether it has a time."""
    hashes, contents = {h for _, h, _ in existing if h}, {}
    for i, _, c in sorted(existing, key=lambda e: e[0]):
        if c:
            contents.setdefault(c, i)
    at, out = max([i for i, _, _ in existing], default=0), {}
    for path, fingerprint, content, dated in sorted(files):
        if fingerprint in hashes:
            out[path] = ("duplicate", None, None)
        elif not dated and not undated:
            out[path] = ("undated", None, None)
        else:
            at += 1
            out[path] = ("inserted", at, contents.get(content) if content else None)
            if content:
                contents.setdefault(content, at)
            if fingerprint:
                hashes.add(fingerprint)
    return out


@pytest.mark.parametrize("undated", [False, True])
def test_files_in_order(spark, undated):
    r = random.Random(5)
    files = []
    for i in range(200):
        dated = r.random() < 0.6
        name = f"d{r.randrange(4)}/{'2024-02-03-04_' if dated else 'x'}{i}.{r.choice(['jpg', 'txt', 'ogg'])}"
        files.append((name, r.choice([None, *"abcdefghijkl"] if i % 3 else [f"u{i}"]), r.choice([None, *"pqrstuvw"]), dated))
    existing = [(7, "a", "p"), (3, "b", "p"), (40, None, None)]
    rows = [(p, 1, f, c) for p, f, c, _ in files]
    out = ingest.ingest_files(spark.createDataFrame(existing, HELD), spark.createDataFrame(rows + rows[:20] + [(None, 1, "z", "z")], FILE), spark.createDataFrame([], FACT), allow_undated=undated)
    got = {x["path"]: (x["outcome"], x["media_id"], x["same_content"]) for x in out["outcomes"].collect()}
    want = walked(existing, files, undated)
    assert got == want
    report = {x["outcome"]: x["n"] for x in out["report"].collect()}
    counts = Counter(o for o, _, _ in want.values())
    assert {k: v for k, v in report.items() if k in counts} == counts
    assert report["same_content"] == sum(s is not None for _, _, s in want.values())


def test_sidecars_positions_and_empty_tables(spark):
    names = ["v/C0001.MP4", "v/C0001M01.XML", "w/C0001M01.XML", "v/C0002.mp4", "p/I.JPG", "p/I.AAE", "p/J.jpg", "p/c0003m01.xml"]
    files = spark.createDataFrame([(n, 1, n, n) for n in names], FILE)
    facts = spark.createDataFrame(
        [
            ("v/C0001M01.XML", "sony_creationdate", "2024-01-01T00:00:00-03:00"), ("v/C0001M01.XML", "spherical", "True"), ("w/C0001M01.XML", "sony_creationdate", "1999-01-01T00:00:00Z"),
            ("v/C0001.MP4", "duration_secs", "1.5"), ("v/C0001.MP4", "iso", "100"), ("v/C0001.MP4", "none", None), ("p/I.JPG", "exif_createdate", "03/02/2024 10:00:00"),
            ("p/I.JPG", "composite_gpsposition", "31 deg 24' 28.55\" S, 64 deg 11' 23.11\" W"), ("p/J.jpg", "xmp_createdate", "2024:01:01 00:00:00"), ("p/J.jpg", "exif_gpslatitude", "34 deg 30' 0\""),
            ("p/J.jpg", "exif_gpslatituderef", "South"), ("p/J.jpg", "exif_gpslongitude", "58.5"), ("p/J.jpg", "exif_gpslongituderef", "West"), ("p/J.jpg", "exif_gpsaltitude", "12"), ("p/J.jpg", "exif_gpsaltituderef", "1"),
        ],
        FACT,
    )
    none = spark.createDataFrame([], HELD)
    out = ingest.ingest_files(none, files, facts)
    items = {x["path"]: x for x in out["items"].withColumns({"t": F.unix_seconds("ts"), "e": F.unix_micros("end_ts") / 1e6}).collect()}
    assert set(items) == {"v/C0001.MP4", "p/I.JPG", "p/J.jpg"}
    clip = items["v/C0001.MP4"]
    assert (clip["t"], clip["e"], clip["subtype"], clip["sidecar"]) == (1704078000, 1704078001.5, "360", "v/C0001M01.XML")
    assert (items["p/I.JPG"]["lat"], items["p/I.JPG"]["lon"], items["p/I.JPG"]["t"]) == (-31.4079306, -64.1897528, 1706965200)
    assert (items["p/J.jpg"]["lat"], items["p/J.jpg"]["lon"], items["p/J.jpg"]["alt"]) == (-34.5, -58.5, -12.0)
    attributes = {(x["media_id"], x["key"]): x["value"] for x in out["attributes"].collect()}
    ids = {p: x["media_id"] for p, x in items.items()}
    assert attributes[ids["v/C0001.MP4"], "spherical"] == "True" and attributes[ids["p/I.JPG"], "sidecar_aae"] == "p/I.AAE"
    assert not any(k in ("duration_secs", "none") for _, k in attributes)
    outcomes = {x["path"]: x["outcome"] for x in out["outcomes"].collect()}
    assert outcomes["p/c0003m01.xml"] == outcomes["w/C0001M01.XML"] == "sidecar_xml" and outcomes["p/I.AAE"] == "sidecar_aae" and outcomes["v/C0002.mp4"] == "undated"
    empty = ingest.ingest_files(none, spark.createDataFrame([], FILE), spark.createDataFrame([], FACT))
    assert empty["items"].count() == empty["attributes"].count() == empty["outcomes"].count() == 0


def test_numbers_follow_the_order(spark):
    words = [f"{random.Random(i).random():.6f}" for i in range(500)]
    got = ordered.numbered(spark.createDataFrame([(w,) for w in words], "w string"), ["w"], "n", 10).collect()
    assert {x["w"]: x["n"] for x in got} == {w: 11 + i for i, w in enumerate(sorted(words))}
    assert ordered.numbered(spark.createDataFrame([], "w string"), ["w"], "n").count() == 0


# --- chat exports -------------------------------------------------------------------------------

MESSAGE = "chat_id long, id long, type string, place long, date string, `from` string, text string, photo string, file string, media_type string, mime_type string, location struct<latitude: double, longitude: double>"


def imported(state, export, available, mode, include_system):
    """The import in a loop; state holds messages {key}, attachments {key + place: [kind, file, mime, item]}, items {id: [hash, type, link]}."""
    messages, attached, items = set(state[0]), {k: list(v) for k, v in state[1].items()}, {k: list(v) for k, v in state[2].items()}
    n = Counter(total=len(export))
    good = [m for m in export if m["id"] and (include_system or m["type"] != "service")]
    n["system"] = sum(bool(m["id"]) and m["type"] == "service" for m in export)
    if mode == "replace":
        chats = {m["chat_id"] for m in export}
        drop = {k for k in messages if k[0] in chats}
    elif mode == "update":
        drop = messages & {(m["chat_id"], m["id"]) for m in good}
    else:
        drop, good = set(), [m for m in good if (m["chat_id"], m["id"]) not in messages]
    messages -= drop
    attached = {k: v for k, v in attached.items() if k[:2] not in drop}
    for item in items.values():
        if item[2] in drop:
            item[2] = None
    new = {}
    for m in good:
        if mode != "skip" or (m["chat_id"], m["id"]) not in new:
            new[m["chat_id"], m["id"]] = m
    messages |= set(new)
    n["messages"], n["skipped"] = len(new), len(export) - len(new)

    def take(key, kind, file, mime):
        h = available.get(file)
        if not file or kind == "sticker" or h is None:
            return
        table = {"photo": "image", "video_file": "video", "voice_message": "audio"}
        type_ = table.get(kind) or next((k for k in ("video", "audio", "image") if mime.startswith(k)), "other")
        held = next((i for i, x in items.items() if x[0] == h), None)
        if held is None:
            held = max(items, default=0) + 1
            items[held] = [h, type_, None]
        items[held][1], items[held][2] = type_, key[:2]
        attached[key][3] = held
        n["ingested"] += 1

    waiting = [(k, v) for k, v in sorted(attached.items()) if v[3] is None]
    for k, m in sorted(new.items(), key=lambda e: (e[1]["place"], e[0])):
        parts = [("photo", m["photo"], "image/jpeg")] if m["photo"] else []
        parts += [(m["media_type"] or "document", m["file"], m["mime_type"] or "")] if m["file"] else []
        parts += [("location", "", "application/geo+json")] if m["location"] else []
        for i, p in enumerate(parts):
            n["registered"] += 1
            attached[*k, i] = [*p, None]
            take((*k, i), *p)
    before = n["ingested"]
    for key, v in waiting:
        take(key, *v[:3])
    n["recovered"] = n["ingested"] - before
    return messages, attached, items, n


@pytest.mark.parametrize(("mode", "include_system"), [("skip", True), ("update", False), ("replace", True)])
def test_import_in_a_loop(spark, mode, include_system):
    r = random.Random(mode)
    export = []
    for place in range(150):
        has_file = r.random() < 0.5
        export.append(
            {
                "chat_id": 1 if place < 100 else 2, "id": r.choice([None, 0, *range(1, 120)]), "type": r.choice(["message", "message", "service"]), "place": place if place < 100 else place - 100, "date": "2025-01-01T00:00:00", "from": "A", "text": "t",
                "photo": f"p{r.randrange(30)}" if r.random() < 0.4 else None, "file": f"f{r.randrange(30)}" if has_file else None, "media_type": r.choice([None, "sticker", "video_file", "voice_message"]) if has_file else None,
                "mime_type": r.choice([None, "audio/ogg", "text/plain"]) if has_file else None, "location": {"latitude": 1.0, "longitude": 2.0} if r.random() < 0.1 else None,
            }
        )
    available = {f"{k}{i}": f"h{i % 12}" if k == "p" else f"g{i % 15}" for k in "pf" for i in range(30) if i % 3}
    old_messages = {(1, i) for i in range(1, 40)} | {(3, i) for i in range(1, 5)}
    old_attached = {(c, i, 0): ["photo", f"p{i % 30}", "image/jpeg", None] for c, i in old_messages if i % 2} | {(3, 2, 0): ["sticker", "f1", "", None], (3, 4, 0): ["photo", "p4", "image/jpeg", 6]}
    old_items = {5: ["h1", "other", (1, 7)], 6: ["h4", "image", (3, 4)], 9: ["unsent", "image", (1, 9)], 2: [None, "text", None]}
    state = {
        "messages": spark.createDataFrame([(c, i, "B", "2025-01-01T00:00:00Z") for c, i in old_messages], "chat_id long, message_id long, from_name string, date_utc string"),
        "attachments": spark.createDataFrame([(*k, *v) for k, v in old_attached.items()], "chat_id long, message_id long, place int, kind string, file string, mime_type string, media_id long"),
        "items": spark.createDataFrame([(i, h, t, *(link or (None, None))) for i, (h, t, link) in old_items.items()], "media_id long, file_hash string, type string, chat_id long, message_id long"),
        "attributes": spark.createDataFrame([(5, "fuente", "camera")], "media_id long, key string, value string"),
    }
    there = spark.createDataFrame(list(available.items()), "file string, file_hash string")
    out, report = ingest.import_chat(state, spark.createDataFrame(export, MESSAGE), there, mode, include_system)
    messages, attached, items, n = imported((old_messages, old_attached, old_items), export, available, mode, include_system)
    assert {(x["chat_id"], x["message_id"]) for x in out["messages"].collect()} == messages and out["messages"].count() == len(messages)
    got = {(x["chat_id"], x["message_id"], x["place"]): x["media_id"] for x in out["attachments"].collect()}
    assert got == {k: v[3] for k, v in attached.items()}
    found = {x["media_id"]: [x["file_hash"], x["type"], (x["chat_id"], x["message_id"]) if x["chat_id"] else None] for x in out["items"].collect()}
    assert found == items
    counts = {x["name"]: x["n"] for x in report.collect()}
    assert counts == {k: n[k] for k in counts}
    marked = {(x["media_id"], x["key"]): x["value"] for x in out["attributes"].collect()}
    assert marked[5, "fuente"] == "camera" and all(marked[i, "fuente"] == "telegram" for i in set(items) - set(old_items))


def test_exports_as_files(spark, tmp_path):
    body = {
        "id": 9, "name": "c", "type": "t",
        "messages": [
            {"id": 1, "type": "message", "date": "2025-08-08T11:21:29", "from": "Ana", "text": ["hola ", {"type": "hashtag", "text": "#ruta"}, {"type": "hashtag", "text": "##alto"}], "photo": "p/a.jpg", "photo_file_size": 5},
            {"id": 2, "type": "service", "actor": "Eva", "actor_id": "u1", "action": "pin", "members": ["x", "y"], "text": ""},
            {"id": 3, "type": "message", "poll": {"question": "?"}, "text": ""},
            {"id": 4, "type": "message", "file": "d/x.pdf", "text": "#no entity"},
        ],
    }
    (tmp_path / "result.json").write_text(json.dumps(body))
    m = sources.chat_messages(spark, str(tmp_path / "result.json"))
    rows = {x["message_id"]: x for x in ingest.message_rows(m).collect()}
    assert [rows[i]["message_type"] for i in (1, 2, 3, 4)] == ["photo", "system", "poll", "document"]
    assert (rows[1]["hashtags"], rows[1]["text"], rows[1]["date_utc"]) == ("alto ruta", "hola #ruta##alto", "2025-08-08T11:21:29Z")
    assert (rows[2]["from_name"], rows[2]["from_id"], rows[2]["action"], json.loads(rows[2]["members"])) == ("Eva", "u1", "pin", ["x", "y"])
    assert rows[4]["hashtags"] is None and rows[1]["action"] is None
    parts = {x["message_id"]: x for x in ingest.attachment_rows(m).collect()}
    assert (parts[1]["file_name"], parts[1]["file_size"], parts[4]["kind"], parts[4]["mime_type"]) == ("a.jpg", 5, "document", "")


# --- later jobs ----------------------------------------------------------------------------------


def test_tracks_of_too_few_points(spark):
    state = {
        "tracks": spark.createDataFrame([], "track_id long, file string, begins timestamp, ends timestamp, total_points long"),
        "waypoints": spark.createDataFrame([], "track_id long, name string"),
        "items": spark.createDataFrame([(1, 100, 1.0, 1.0, None), (2, 100, None, None, None), (3, 100, 1.0, 1.0, 7.0)], "media_id long, s long, lat double, lon double, alt double").withColumn("ts", F.timestamp_seconds("s")),
    }
    points = spark.createDataFrame([("t", 90, 1.0), ("t", 110, 2.0), ("t", 1000, None)], "file string, s long, elevation double").withColumn("ts", F.timestamp_seconds("s"))
    none = spark.createDataFrame([], "file string, name string")
    alts = lambda p, mode: {x["media_id"]: x["alt"] for x in ingest.import_track(state, p, none, mode)[0]["items"].collect()}
    assert alts(points, "skip") == {1: 2.0, 2: None, 3: 7.0}  # the later of two that are equally near
    assert alts(points, "update") == {1: 2.0, 2: None, 3: 2.0}
    assert alts(points.where("s < 100"), "update") == {1: None, 2: None, 3: 7.0}


def test_video_metadata_leaves_what_is_there(spark):
    items = spark.createDataFrame([(1, "video", "360", None, None), (2, "video", None, "Ana", "folder"), (3, "image", "360", None, None)], "media_id long, type string, subtype string, author string, author_source string")
    held = spark.createDataFrame([(1, "iso", "1"), (1, "XMP_old", "x"), (2, "xml_devicemanufacturer", "Sony")], "media_id long, key string, value string")
    facts = spark.createDataFrame([(1, "iso", "2"), (1, "xml_devicemodelname", "M1"), (2, "xmp_Spherical", "true"), (3, "iso", "5"), (1, "gone", None)], "media_id long, key string, value string")
    rows, attributes = ingest.video_metadata(items, held, facts)
    assert {tuple(x) for x in rows.collect()} == {(1, "video", "360", "M1", "exif"), (2, "video", None, "Ana", "folder"), (3, "image", "360", None, None)}
    assert {tuple(x) for x in attributes.collect()} == {(1, "iso", "1"), (1, "XMP_old", "x"), (1, "xml_devicemodelname", "M1"), (2, "xml_devicemanufacturer", "Sony")}
    rows, attributes = ingest.video_metadata(items, held, facts, "update")
    assert {(x["media_id"], x["subtype"]) for x in rows.collect()} == {(1, None), (2, "360"), (3, "360")}
    assert {tuple(x) for x in attributes.collect()} == {(1, "iso", "1"), (1, "xml_devicemodelname", "M1"), (2, "xmp_Spherical", "true")}


def test_descriptions_lose_their_openings_only(spark):
    rows = [(1, "desc", "intro: The road goes on and on"), (2, "desc", "In this image a lake"), (3, "other", "intro: stays"), (4, "desc", None), (5, "desc", "break: all of it")]
    df = spark.createDataFrame(rows, "media_id long, key string, value string")
    clean = lambda c: F.when(c.startswith("break"), "something else").otherwise(F.regexp_replace(c, "^intro: ", ""))
    out, report = ingest.clean_descriptions(df, ["desc"], clean, ["in this image"])
    assert {tuple(x) for x in out.collect()} == {(1, "desc", "The road goes on and on"), *map(tuple, rows[1:])}
    assert tuple(report.first()) == (4 - 1, 1, 1, 0)


def test_transcripts_over_older_ones(spark):
    held = spark.createDataFrame([(1, "transcript", "old"), (1, "iso", "9"), (2, "transcript", "old")], "media_id long, key string, value string")
    spoken = spark.createDataFrame([(1, [(0.0, 1.0, "a"), (1.0, 2.26, None), (3.0, 4.26, "b")], "es", 0.987, "m"), (2, [], None, None, "m"), (3, None, "es", 1.0, "m")], "media_id long, segments array<struct<start: double, end: double, text: string>>, language string, probability double, model string")
    got = {(x["media_id"], x["key"]): x["value"] for x in ingest.store_transcripts(held, spoken).collect()}
    assert got[1, "iso"] == "9" and got[1, "transcript"] == "a  b" and got[2, "transcript"] == "" and not any(i == 3 for i, _ in got)
    assert json.loads(got[1, "transcript_info"]) == {"modelo": "m", "idioma": "es", "probabilidad_idioma": 0.99, "duracion_seg": 4.3, "segmentos": 3}
    assert json.loads(got[1, "transcript_segments"])[0] == {"inicio": 0.0, "fin": 1.0, "texto": "a"} and json.loads(got[2, "transcript_info"])["duracion_seg"] == 0.0


def test_lookup_and_unseen(spark):
    items = spark.createDataFrame([(1, "a.JPG"), (2, "b.xyz"), (3, None), (4, "d.mp4")], "media_id long, path string")
    there = spark.createDataFrame([("a.JPG",), ("r/a.JPG",), ("r/b.xyz",)], "path string")
    asked = spark.createDataFrame([(x,) for x in (1, 1, 2, 3, 4, 5, 0, None)], "media_id long")
    got = {x["media_id"]: tuple(x)[1:] for x in ingest.lookup(asked, items, there, ["q", "r/"]).collect()}
    assert got == {1: (200, "a.JPG", "image/jpeg"), 2: (200, "r/b.xyz", "application/octet-stream"), 3: (404, None, None), 4: (404, None, None), 5: (404, None, None), 0: (400, None, None), None: (400, None, None)}
    texts = spark.createDataFrame([(i, "telegram" if i < 5 else None, f" a\n{i}" if i != 7 else "") for i in range(10)], "media_id long, folder string, transcript string")
    rows = ingest.unseen_texts(texts, texts.where("media_id = 9"), 1, 5).collect()
    assert {x["media_id"] for x in rows[:3]} == {5, 6, 8} and len(rows) == 5 and {x["folder"] for x in rows[3:]} == {"telegram"} and all(x["transcript"] == f"a {x['media_id']}" for x in rows)
