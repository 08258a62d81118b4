"""Operators of routes, sounds, names and jobs against plain loops; survey IDs in the names of what they test."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caravel import schemas
from caravel.functions import color, geo, metadata, sun, text
from caravel.operators import audio, intervals, marks, ordered, ranking
from caravel.plans import jobs
from caravel.sources import files

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def metres(a, b):
    return marks._metres(a, b)


def test_jn10_repeated_and_null_rows_stay_once(spark):
    """as-of joins keep every left row once, whatever its first column."""
    left = spark.createDataFrame([("f", 1, at(10)), ("f", 2, at(20)), (None, 3, at(30)), ("f", 1, at(10)), ("g", 4, None)], "folder string, id long, ts timestamp")
    right = spark.createDataFrame([(at(5), "a"), (at(20), "b"), (at(90000), "c"), (None, "d")], "ts timestamp, v string")
    rows = ordered.asof(left, right, "ts", F.col("v"), ahead=True)
    assert sorted((r["id"], r["folder"], r["prev"], r["next"]) for r in rows.collect()) == [(1, "f", "a", "b"), (1, "f", "a", "b"), (2, "f", "b", "b"), (3, None, "b", "c"), (4, "g", None, None)]
    strict = ordered.asof(left.where("id = 2"), right, "ts", F.col("v"), ahead=True, strict=True).first()
    assert (strict["prev"], strict["next"]) == ("a", "c")
    keyed = ordered.asof(left, right.withColumn("folder", F.lit("f")), "ts", F.col("v"), ["folder"])
    assert sorted((r["id"], r["prev"]) for r in keyed.collect()) == [(1, "a"), (1, "a"), (2, "b"), (3, None), (4, None)]


def test_jn14_across_the_antimeridian_and_near_the_pole(spark):
    random.seed(1)
    points = [(i, random.uniform(-89, 89), random.choice([random.uniform(-180, 180), random.uniform(179, 180), random.uniform(-180, -179)])) for i in range(300)]
    things = [(0, 0.0, 179.99), (1, 10.0, -179.99), (2, 88.5, 10.0), (3, -89.9, -170.0), (4, None, 3.0)] + [(10 + i, random.uniform(-80, 80), random.uniform(-180, 180)) for i in range(30)]
    p = spark.createDataFrame(points, "p long, y double, x double")
    q = spark.createDataFrame(things, "i long, a double, o double")
    got = {}
    for r in intervals.nearest_points(q, p, ("i", "a", "o"), ("p", "y", "x"), 3, 0.5).collect():
        got.setdefault(r["i"], {})[r["rank"]] = r["p"]
    for i, a, o in things:
        if a is not None:
            want = [k for _, k in sorted((metres((a, o), (y, x)), k) for k, y, x in points)[:3]]
            assert [got[i][n] for n in (1, 2, 3)] == want
    assert 4 not in got and intervals.nearest_points(q, p.where("false"), ("i", "a", "o"), ("p", "y", "x")).count() == 0


def test_jn13_equals_all_pairs(spark):
    random.seed(2)
    things = [(i, "f", at(s), at(s + random.choice([0, 50, 4000]))) for i in range(60) for s in [random.randint(0, 400_000)]]
    tracks = [(100 + i, "f", at(s), at(s + random.randint(1, 9000))) for i in range(25) for s in [random.randint(0, 400_000)]]
    a = spark.createDataFrame(things, "id long, k string, a timestamp, b timestamp")
    b = spark.createDataFrame(tracks, "t long, k string, c timestamp, d timestamp")
    got = {r["id"]: (r["t"], r["mode"]) for r in intervals.best_interval(a, b, ("a", "b"), ("c", "d"), "id", "t", ["k"]).collect()}
    sec = lambda x: (x - T0).total_seconds()
    for i, _, x, y in things:
        options = []
        for t, _, c, d in tracks:
            shared = min(sec(y), sec(d)) - max(sec(x), sec(c))
            rank = 0 if c <= x and d >= y else 1 if shared > 0 else 2
            options.append((rank, sec(d) - sec(c) if rank == 0 else -shared if rank == 1 else max(sec(c) - sec(y), sec(x) - sec(d)), t))
        rank, _, t = min(options)
        assert got[i] == (t, ("contains", "overlaps", "nearest")[rank])


def test_seq9_coarse_equals_a_loop(spark):
    random.seed(3)
    rows, want = [], set()
    for k in range(12):
        offsets = sorted(random.sample(range(0, 2000), random.randint(1, 30)))
        offsets[0] = 0
        rows += [(k, float(o)) for o in offsets]
        m = 0.0
        while m <= offsets[-1] + 1e-9:
            want.add((k, float(min(offsets, key=lambda o: abs(o - m)))))
            m += 170
    df = spark.createDataFrame(rows, "k long, o double")
    assert {(r["k"], r["o"]) for r in marks.coarse(df, ["k"], "o", 170).collect()} == want


def test_seq7_last_known_temperature(spark):
    rows = [("w", 10.0), ("w", None), ("w", 12.0), ("w", 13.5), ("x", 13.5), (None, None), ("x", 40.0), ("x", 41.0), ("x", None), ("x", 44.0)]
    df = spark.createDataFrame([("k", i, at(i), a, b) for i, (a, b) in enumerate(rows)], "k string, id long, ts timestamp, label string, temp double")
    found = marks.weather_transitions(df, ["k"], ["ts", "id"], "label", "temp", 2.0)
    assert sorted(r["id"] for r in found.collect()) == [0, 2, 4, 6, 9]


def test_seq11_emission_equals_a_loop(spark):
    random.seed(5)
    rows, want = [], set()
    for k in ("a", "b", None):
        y, x, t, seq = 0.0, 0.0, 0, []
        for i in range(80):
            if random.random() < 0.6:
                y, x = y + random.uniform(-0.002, 0.003), x + random.uniform(-0.002, 0.003)
            t += random.choice([5, 10, 30])
            rows.append((k, i, at(t), y, x))
            seq.append((i, t, (y, x)))
        state = marks.Emission(150, 8)
        for n, (i, t, p) in enumerate(seq):
            kmh = 0.0 if n == 0 else metres(seq[n - 1][2], p) / (t - seq[n - 1][1]) * 3.6
            if state.keeps(p, kmh, n == len(seq) - 1) and k is not None:
                want.add((k, i))
    df = spark.createDataFrame(rows, "k string, id long, ts timestamp, lat double, lon double")
    got = {(r["k"], r["id"]) for r in marks.emitted(df, ["k"], "ts", "id", "lat", "lon", 150, 8).where("k is not null").collect()}
    assert got == want and 3 < len(want) < 160


def test_seq20_and_seq21(spark):
    rng = np.random.default_rng(1)
    for _ in range(30):
        b = rng.normal(size=40)
        i = int(rng.integers(0, 30))
        found = audio.best_match(list(b[i : i + 10] * 3 + 1), list(b))
        centred, part = b - b.mean(), b[i : i + 10] - b[i : i + 10].mean()
        sims = [float(part @ centred[j : j + 10] / np.sqrt((centred[j : j + 10] ** 2).sum() * (part**2).sum())) for j in range(31)]
        assert found[1] == int(np.argmax(sims)) and math.isclose(found[0], max(sims), rel_tol=1e-9)
    assert audio.best_match([1.0], [1.0, 2.0]) == audio.best_match([2.0, 2.0], [1.0, 2.0, 3.0]) == (0.0, 0, 0)
    v = one(spark, audio.energies(F.array(*[F.lit(float(i)) for i in range(5)]), 2, 2))
    assert v == [math.sqrt(0.5), math.sqrt(6.5)] and one(spark, audio.energies(F.array(F.lit(1.0)), 2, 1)) == []


def test_seq19_seq22_seq23_jn20(spark):
    assert one(spark, audio.uniform_samples(F.lit(2.0), F.lit(3.5), 10)) == [2.0, 2.9, 3.8, 4.6]
    assert one(spark, audio.uniform_samples(F.lit(2.0), F.lit(0.0))) == [2.0]
    assert [(w["start"], w["end"]) for w in one(spark, audio.tumbling(F.lit(23.5)))] == [(0.0, 10.0), (10.0, 20.0), (20.0, 23.5)]
    assert one(spark, audio.tumbling(F.lit(0.0))) == [] and len(one(spark, audio.tumbling(F.lit(9999.0)))) == 30
    assert one(spark, audio.frames(F.lit(0.0), F.lit(10.0), 5.0)) == [1, 2] and one(spark, audio.frames(F.lit(7.0), F.lit(7.0), 5.0)) == [2]
    things = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(s).alias("seconds")) for i, s in ((1, 4.0), (2, 0.0), (3, 9.0), (4, 6.0))])
    assert [(p["id"], p["start"], p["length"]) for p in one(spark, audio.schedule(things, 16.0, 2.0))] == [(1, 0.0, 4.0), (3, 6.0, 9.0), (4, 15.0, 1.0)]


def test_flt10_user_predicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    assert [r["id"] for r in ranking.where_text(df, "name IS NULL").collect()] == [2]
    for bad in ("1=1; drop table x", "id in (select 1)", "Delete"):
        with pytest.raises(ValueError, match="barred"):
            ranking.where_text(df, bad)
    with pytest.raises(ValueError, match="no column"):
        ranking.checked_column(df, "x; y")
    assert [r["n"] for r in df.select(ranking.word_count("name").alias("n")).collect()] == [1, 0]
    assert one(spark, ranking.word_count(F.lit("\ta b\n c "))) == 3


def test_s3_s17_s20(spark):
    words = ["montaña", "ab", "DSC0123", "10x20", "this is", "uno dos tres", "bici de montaña", "1 a", "..."]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["j"] for r in df.select("w", text.is_junk("w", phrases=("Bici de montaña",)).alias("j")).collect()}
    assert [w for w in words if not got[w]] == ["montaña", "bici de montaña"]
    assert one(spark, text.is_token_subset(F.lit("rio negro"), F.lit("negro rio seco"))) and not one(spark, text.is_token_subset(F.lit(""), F.lit("a b")))
    arr = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<string>")
    assert [one(spark, text.is_concentrated(arr(*a), arr(*b))) for a, b in ((("x",), ("x", "y")), (("x", "y"), ("x", "y")), (("z",), ("x",)), ((), ("x",)), ((), ()))] == [True, False, False, False, True]
    assert one(spark, text.replaced_words(F.lit("The cat, catalog CAT."), {"cat": "gato $1"})) == "The gato $1, catalog gato $1."


def test_m8_src4_m5_m17_m19_seq25(spark):
    assert one(spark, geo.wind_point(F.lit(11.9))) == "N" and one(spark, geo.wind_point(F.lit(12))) == "NNE" and one(spark, geo.wind_point(F.lit(None).cast("double"))) == "desconocida"
    assert one(spark, geo.weather_label(F.lit(57))) == "llovizna helada densa" and one(spark, geo.weather_label(F.lit(4))) == "codigo_4" and one(spark, geo.weather_label(F.lit(None).cast("int"))) == "desconocido"
    names = {"a.HEIF": "image", "b.m2ts": "video", "c.wma": "audio", "d.vtt": "text", "e.gz": "archive", "f.gif": "other", "g": "other"}
    assert {k: one(spark, files.media_type(F.lit(k))) for k in names} == names
    assert one(spark, metadata.camera_class(F.lit(40_000_000), F.lit(24.0))) == "B (fps cambiado)" and one(spark, metadata.camera_class(F.lit(60_000_000), F.lit(30.0))) == "A (LA +7h)"
    assert one(spark, metadata.signed_hours(F.lit(-3.25))) in ("-3.2h", "-3.3h") and one(spark, metadata.signed_hours(F.lit(7))) == "+7.0h"
    palette = [(h, 0, 255 - h) for h in range(24)]
    assert tuple(one(spark, color.of_hour(F.lit(-0.5), palette))) == (12, 0, 244)
    found = one(spark, sun.since(F.lit(dt.datetime(2024, 3, 20, 15)), F.lit(-31.4), F.lit(-64.2)))
    assert 4 * 3600 < found["since_sunrise"] < 6 * 3600 and 6 * 3600 < found["to_sunset"] < 8 * 3600 and abs(found["since_sunrise"] + found["to_sunset"] - 12.1 * 3600) < 600


def test_src10_cut_exports_are_closed():
    whole = {"name": "c", "messages": [{"id": i, "text": [{"t": "x"}, "y}"]} for i in range(200)]}
    body = json.dumps(whole)
    for cut in range(40, len(body), 37):
        fixed = files.repaired_json(body[:cut])
        got = json.loads(fixed)["messages"] if fixed else []
        assert got == whole["messages"][: len(got)] and all(m in whole["messages"] for m in got)
        assert len(got) >= body[:cut].count('"y}"]}')


def test_ddl1_ddl2_migrations(spark):
    media = spark.createDataFrame([(1, "a")], "id long, type string")
    old = spark.createDataFrame([(1, [1.0], None, "x"), (1, [2.0], "m", "x"), (None, [3.0], "m", "x"), (2, None, "m", "x")], "media_id long, embedding array<float>, modelo string, media_id_ref string")
    tables, version = schemas.migrate({"media": media, "media_embeddings": old}, 0)
    assert version == 4 and set(tables) == {"media", "media_embeddings", "config", "telegram_messages"}
    assert sorted((r["media_id"], r["modelo"], r["embedding"]) for r in tables["media_embeddings"].collect()) == [(1, "m", [2.0]), (1, "nomic-embed-text", [1.0])]
    assert tables["media"].columns == ["id", "type", "telegram_message_id"] and tables["telegram_messages"].count() == 0
    again, version = schemas.migrate(tables, version)
    assert again is tables and version == 4
    fresh, _ = schemas.migrate({"media": media}, 2)
    assert fresh["media_embeddings"].columns == [f.name for f in schemas.EMBEDDING] and "config" not in fresh


def test_snk17_snk5_job9(spark):
    df = spark.createDataFrame([(1, "a/b.jpg"), (2, "a/b.jpg"), (3, "a/c"), (4, "a/c"), (5, "a/b.jpg")], "id long, p string")
    assert [r["path"] for r in jobs.free_names(df, F.col("p"), ["id"]).orderBy("id").collect()] == ["a/b.jpg", "a/b_1.jpg", "a/c", "a/c_1", "a/b_2.jpg"]
    assert [r["p"] for r in jobs.without_parts(df, F.col("id") > 3, ["p"]).orderBy("id").collect()] == ["a/b.jpg", "a/b.jpg", "a/c", None, None]


def test_one_hot_folder_is_split(spark):
    """Neighbours, sessions and changes of a table with a single folder use many partitions' worth of buckets."""
    df = spark.range(3000).select(F.lit(1).alias("folder"), "id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 700).alias("ts"))
    rows = ordered.sessions(df, ["folder"], "ts", 600, "id")
    assert rows.agg(F.max("session")).first()[0] == 2999
    plan = ordered.with_neighbours(df, ["ts", "id"], F.col("id"), ["folder"], ahead=True)
    assert plan.where("prev = id - 1 or id = 0").where("next = id + 1 or id = 2999").count() == 3000


def test_src7_src13_src14(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?><ns:Meta xmlns:ns="urn:x"><ns:Duration value="250"/><ns:Device manufacturer="S" ns:modelName="M 1">  </ns:Device><ns:Note> hi </ns:Note></ns:Meta>')
    got = {(r["key"], r["value"]) for r in files.xml_sidecars(spark, str(tmp_path), "Meta").collect()}
    assert got == {("duration_value", "250"), ("device_manufacturer", "S"), ("device_modelname", "M 1"), ("note", "hi")}
    things = spark.createDataFrame([(1, "x"), (2, "y")], "id long, fingerprint string")
    sidecars = spark.createDataFrame([(1, "x", "a"), (2, "old", "b"), (3, "z", "c")], "id long, fingerprint string, tags string")
    assert [r["tags"] for r in files.valid_sidecars(things, sidecars, "id").collect()] == ["a"]
    places = spark.createDataFrame([(1, -31.40001, -64.2), (2, 5.0, 5.0), (3, None, 1.0)], "id long, latitude double, longitude double")
    cache = spark.createDataFrame([(-31.4, -64.2, "here")], "cy double, cx double, name string")
    found, missing = files.cached(places, cache)
    assert sorted((r["id"], r["name"]) for r in found.collect()) == [(1, "here"), (2, None), (3, None)]
    assert [(r["cy"], r["cx"]) for r in missing.collect()] == [(5.0, 5.0)]


def test_seq17_seq18(spark):
    cuts = F.array(*[F.lit(x) for x in (-1.0, 3.0, 3.02, 9.0, 12.0)])
    spans = marks.scene_spans(cuts, F.lit(10.0))
    assert [(s["start"], s["end"]) for s in one(spark, spans)] == [(0.0, 3.0), (3.0, 9.0), (9.0, 10.0)]
    assert one(spark, marks.scene_spans(cuts, F.lit(0.0))) == []
    assert [(s["start"], s["end"]) for s in one(spark, marks.split_spans(spans, 2.99))] == [(0.0, 2.99), (3.0, 5.99), (5.99, 8.98), (9.0, 10.0)]


def test_seq21_blocks_of_pairs_equal_a_loop(spark):
    random.seed(5)
    values = lambda n: [random.choice([random.gauss(0, 1), 0.0, 1.0]) for _ in range(n)]
    short = [(i, i % 3 if i % 7 else None, random.choice([None, [], [2.0, 2.0, 2.0], [1.0], values(3), values(4), [0.5, None, 1.0]])) for i in range(40)]
    long = [(i, i % 3, random.choice([None, [], [0.0] * 6, values(2), values(6), values(9), [1.0, None, 2.0, 3.0, 1.0]])) for i in range(60)]
    x, y = spark.createDataFrame(short, "a long, k int, s array<double>"), spark.createDataFrame(long, "b long, k int, v array<double>")
    got = {(r["a"], r["b"]): r["similarity"] for r in audio.best_matches(x, y, "k", 4, 7).collect()}
    want = {(a, b): audio.best_match(s, v)[0] if s is not None and v is not None else 0.0 for a, g, s in short for b, h, v in long if g == h and a != b}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12, nan_ok=True) for k in want)
    assert audio.best_matches(x.where("a < 0"), y, "k").count() == 0
