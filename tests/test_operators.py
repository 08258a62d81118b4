import datetime as dt
import json
import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from caravel import schemas
from caravel.functions import geo, sun, text
from caravel.operators import dedup, intervals, loop, marks, ordered
from caravel.plans import queries
from caravel.sources import files, sinks
from caravel.streaming import choices

DIR = "/root/testdata/sf0.001"
T0 = dt.datetime(2025, 8, 10, 10)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_segments_of_the_loop():
    s = loop.loop_segments([7, 16, 13, 18], 300)
    assert [x["arc"] for x in s] == [9, 21, 5]
    assert [x["t_from"] for x in s] == [0, 100, 200] and s[-1]["t_to"] == 300
    assert len(loop.loop_segments(list(range(24)), 300)) == 23


@pytest.mark.parametrize(("hours", "seconds"), [([7], 300), ([7, 8], 0), ([7, 8], -5)])
def test_bad_loops(hours, seconds):
    with pytest.raises(ValueError):
        loop.loop_segments(hours, seconds)


@pytest.mark.parametrize(("hour", "hours", "seg", "fraction"), [(8.0, [7, 16, 13, 18], 0, 1 / 9), (22.0, [16, 13], 0, 6 / 21), (3.0, [16, 13], 0, 11 / 21), (16.0, [7, 16], 0, 1.0), (0.5, [7, 16, 13, 18], 1, 8.5 / 21)])
def test_placement(spark, hour, hours, seg, fraction):
    df = spark.createDataFrame([(1, hour)], "id int, hour double")
    (r,) = loop.placed(df, F.col("hour"), hours, 300).collect()
    assert r["seg"] == seg and math.isclose(r["fraction"], fraction)


def test_outside_the_loop(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 20.0), (3, None), (4, 24.5)], "id int, hour double")
    assert loop.placed(df, F.col("hour"), [7, 16], 300).count() == 0


def test_gradient_fixture(spark):
    alts = [10, 25, 50, 30, 45, 20, 60, 80, 100, 90, None]
    rows = [(i, at(300 * i), -34.6 + i * 0.008, -58.38 + i * 0.008, None if a is None else float(a)) for i, a in enumerate(alts)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, lat double, lon double, alt double")
    x = ordered.with_neighbours(df, ["ts", "id"], F.struct("lat", "lon", "alt")).withColumn("m", geo.haversine("prev.lat", "prev.lon", "lat", "lon")).withColumn("rise", F.col("alt") - F.col("prev.alt"))
    x = ordered.running_sums(x.withColumn("pct", geo.gradient_pct("rise", "m")), ["ts", "id"], {"run": F.col("m"), "gain": F.when(F.col("rise") > 0, F.col("rise"))})
    got = x.orderBy("id").collect()
    assert got[0]["m"] is None and got[0]["pct"] is None and got[0]["run"] == 0
    assert got[10]["m"] is not None and got[10]["rise"] is None and got[10]["pct"] is None
    assert math.isclose(got[10]["gain"], 135)


def test_neighbours_cross_buckets(spark):
    rows = [(i, at(86_400 * i * 3), 1 if i % 4 == 0 else None) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, v long")
    known = F.when(F.col("v").isNotNull(), F.col("id"))
    got = {r["id"]: (r["prev"], r["next"]) for r in ordered.with_neighbours(df, ["ts", "id"], known, ahead=True).collect()}
    assert got[0] == (None, 4) and got[4] == (0, 8) and got[5] == (4, 8) and got[8] == (4, None)


def test_asof_boundaries(spark):
    track = spark.createDataFrame([(1, at(0), 0.0), (2, at(10), None), (3, at(20), 20.0)], "pid long, ts timestamp, ele double")
    probes = spark.createDataFrame([(s, at(s)) for s in (-1, 0, 5, 10, 20, 21)], "id long, ts timestamp")
    got = {r["id"]: (r["prev"], r["next"]) for r in ordered.asof(probes, track, "ts", F.col("pid"), ahead=True).collect()}
    assert got == {-1: (None, 1), 0: (1, 1), 5: (1, 2), 10: (2, 2), 20: (3, 3), 21: (3, None)}
    strict = {r["id"]: r["prev"] for r in ordered.asof(probes, track, "ts", F.col("pid"), strict=True).collect()}
    assert strict == {-1: None, 0: None, 5: 1, 10: 1, 20: 2, 21: 3}


def test_sessions_and_bursts(spark):
    df = spark.createDataFrame([("a", i, at(s)) for i, s in enumerate((0, 50, 100, 161, 400))], "k string, id long, ts timestamp")
    assert [r["session"] for r in ordered.sessions(df, ["k"], "ts", 60, "id").orderBy("id").collect()] == [0, 0, 0, 1, 2]
    assert [r["burst"] for r in ordered.anchored_groups(df, ["k"], "ts", 60, "id").orderBy("id").collect()] == [0, 0, 1, 2, 3]


def test_anchored_equals_a_loop(spark):
    import random

    random.seed(4)
    rows = [(k, i, at(random.randint(0, 5000))) for i in range(300) for k in ("x", "y")]
    want = {}
    for k in ("x", "y"):
        first, n = None, -1
        for _, i, t in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            if first is None or (t - first).total_seconds() > 45:
                first, n = t, n + 1
            want[k, i] = n
    df = spark.createDataFrame(rows, "k string, id long, ts timestamp")
    assert {(r["k"], r["id"]): r["burst"] for r in ordered.anchored_groups(df, ["k"], "ts", 45, "id").collect()} == want


def test_emission_keeps_by_last_kept(spark):
    df = spark.createDataFrame([("a", i, at(i), 0.0, i * 0.0004) for i in range(8)], "k string, id long, ts timestamp, lat double, lon double")
    assert sorted(r["id"] for r in marks.emitted(df, ["k"], "ts", "id", "lat", "lon", 100).collect()) == [0, 3, 6]


def test_changes_reset_on_unknown(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate(["x", "x", None, "x", "y", "y"])], "k string, id long, s string")
    assert [r["id"] for r in ordered.changes(df, ["k"], ["id"], F.col("s"), "st").orderBy("id").collect()] == [3, 4]


def test_intervals(spark):
    df = spark.createDataFrame([("photo 1", at(0), at(0)), ("interview", at(300), at(1500)), ("photo 2", at(600), at(600)), ("photo 3", at(1200), at(1200))], "name string, a timestamp, b timestamp")
    probe = spark.createDataFrame([(1, at(600))], "n int, t timestamp")
    assert sorted(r["name"] for r in intervals.overlaps(df, probe, ("a", "b"), ("t", "t"), 100).collect()) == ["interview", "photo 2"]


def test_nearest_points_far_apart(spark):
    items = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 100.0), (3, None, 1.0)], "i int, la double, lo double")
    points = spark.createDataFrame([(10, 0.1, 0.1), (11, 2.0, 2.0), (12, 49.0, 101.0), (13, -40.0, -100.0)], "p int, pa double, po double")
    got = {(r["i"], r["rank"]): r["p"] for r in intervals.nearest_points(items, points, ("i", "la", "lo"), ("p", "pa", "po"), 2, 0.5).collect()}
    assert got == {(1, 1): 10, (1, 2): 11, (2, 1): 12, (2, 2): 11}


def test_nearest_points_measures_no_place_twice(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(metres):
        seen.add(1)
        return metres

    true = intervals.haversine
    monkeypatch.setattr(intervals, "haversine", lambda *places: counted(true(*places)))
    # 300 items and 300 points at each of two places, and a crowd of different points within one cell
    twice = spark.range(600).select(F.col("id").alias("i"), (F.col("id") % 2).cast("double").alias("la"), F.lit(0.0).alias("lo"))
    crowd = spark.range(1000, 1400).select(F.col("id").alias("i"), (10 + F.col("id") * 0.0005).alias("la"), (10 + F.col("id") % 7 * 0.01).alias("lo"))
    points = twice.unionByName(crowd).select((F.col("i") + 5000).alias("p"), F.col("la").alias("pa"), F.col("lo").alias("po"))
    got = intervals.nearest_points(twice.unionByName(crowd), points, ("i", "la", "lo"), ("p", "pa", "po"), 2, 0.5).collect()
    assert len(got) == 2000
    assert all(sorted(r["p"] for r in got if r["i"] == i) == [5000 + i % 2, 5002 + i % 2] for i in (0, 1, 598, 599))
    assert all(r["p"] == r["i"] + 5000 and r["metres"] == 0 for r in got if r["i"] >= 1000 and r["rank"] == 1)
    assert seen.value < 60_000


def test_leaders(spark):
    df = spark.createDataFrame([("g", 1, 0b0000), ("g", 2, 0b0001), ("g", 3, 0b1111), ("g", 4, 0b0111)], "g string, id long, h long")
    got = {r["id"]: r["leader"] for r in dedup.leader_clusters(df, ["g"], "id", "h", dedup.HammingLeaders, 1).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


def test_transitions_go_through_samples_twice(spark, monkeypatch):
    from caravel.plans import context

    calls, true = [], ordered.with_neighbours
    monkeypatch.setattr(ordered, "with_neighbours", lambda df, *a, **k: calls.append(df) or true(df, *a, **k))
    found = spark.createDataFrame([], "media_id long, offset_s long, at timestamp, lat double, lon double, ele double, source string")
    places = spark.createDataFrame([], "lat double, lon double, place string")
    weather = spark.createDataFrame([], "day date, lat double, lon double, hour int, label string, temperature double")
    context.transitions(found, places, weather)
    # light, height and motion need two passes; places are looked for among coarse samples
    assert sum("_before" not in df.columns and "place" not in df.columns and "label" not in df.columns for df in calls) == 2


def test_each_different_word_is_folded_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(word):
        seen.add(1)
        return word

    words = queries.table(spark, DIR, "documents").select(F.explode(F.split("text", "[^A-Za-zéíóúñüäàçèêôÁÉÑáößâëîïûùÍÓÚ]+")).alias("w")).where("w <> ''")
    different, whole = words.distinct().count(), words.count()
    true = text.folded
    monkeypatch.setattr(queries.text, "folded", lambda w: true(counted(F.col(w))))
    assert queries.QUERIES["facet_fold_order"](spark, DIR).agg(F.sum("n")).first()[0] <= whole
    assert 0 < seen.value <= different < whole


def test_small_keys_are_folded_once(spark):
    made = spark.sparkContext.accumulator(0)

    class Counted(dedup.HammingLeaders):
        def __init__(self, most):
            super().__init__(most)
            made.add(1)

    rows = [(i // 4 if i // 4 else None, i, h) for i, h in enumerate([0, 1, 15, None] * 300)]
    df = spark.createDataFrame(rows, "g long, id long, h long")
    got = {r["id"]: r["leader"] for r in dedup.leader_clusters(df, ["g"], "id", "h", Counted, 1).collect()}
    assert got == {i: i - 1 if i % 4 == 1 else i for _, i, _ in rows}
    assert made.value <= 300


def test_many_hashes_at_once():
    import random

    import numpy as np

    from caravel.functions import image

    random.seed(8)
    leaders = dedup.HammingLeaders(20)
    for i in range(40):
        leaders.add(i, random.getrandbits(64) - 2**63)
    asked = [None, -(2**63), 2**63 - 1] + [random.getrandbits(64) - 2**63 for _ in range(300)]
    found = leaders.firsts(asked)
    assert found == [leaders.first(h) for h in asked] and None in found and len(set(found)) > 5
    assert dedup.HammingLeaders(2).firsts([1, None]) == [None, None]
    # means of a raster as slices have them
    for size in ((1, 64), (7, 3), (40, 64), (33, 100)):
        pixels = np.random.default_rng(3).integers(0, 256, size, dtype=np.uint8)
        rows, columns = (np.minimum(np.arange(33) * n // 32, n - 1) for n in size)
        want = [[pixels[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(columns, columns[1:])] for a, b in zip(rows, rows[1:])]
        assert np.array_equal(image.shrunk(pixels), want)


def test_leaders_equal_a_loop(spark):
    import random

    random.seed(6)
    rows = [(k, i, [random.gauss(0, 1) for _ in range(3)] if i % 9 else [0.0] * 3, random.getrandbits(63) & 0xFF, random.sample("abcdef", random.randint(0, 3))) for k in ("x", None) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, id long, v array<double>, h long, t array<string>")

    def looped(place, alike):
        out = {}
        for k in ("x", None):
            leaders = []
            for r in (r for r in rows if r[0] == k):
                found = next((x for x in leaders if alike(r[place], x[place])), None)
                if found is None:
                    leaders.append(r)
                out[k, r[1]] = r[1] if found is None else found[1]
        return out

    def cosine_of(a, b):
        n = sum(x * x for x in a) * sum(x * x for x in b)
        return n > 0 and sum(x * y for x, y in zip(a, b, strict=True)) / n**0.5 >= 0.8

    for column, place, kind, limit, alike in (("v", 2, dedup.CosineLeaders, 0.8, cosine_of), ("h", 3, dedup.HammingLeaders, 1, lambda a, b: (a ^ b).bit_count() <= 1), ("t", 4, dedup.TagLeaders, 2, lambda a, b: len(set(a) & set(b)) >= 2)):
        got = {(r["g"], r["id"]): r["leader"] for r in dedup.leader_clusters(df, ["g"], "id", column, kind, limit).collect()}
        assert got == looped(place, alike)


def test_similar_names_finds_all(spark):
    import random

    random.seed(5)
    names = sorted({"".join(random.choice("abc") for _ in range(random.randint(1, 7))) for _ in range(80)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    df = spark.createDataFrame([(x,) for x in names], "n string")
    got = {(r["a"], r["b"]) for r in dedup.similar_names(df, df, "n", "n", 1).where("a < b").collect()}
    assert got == {(a, b) for a in names for b in names if a < b and distance(a, b) <= 1}


def test_modes(spark):
    old = spark.createDataFrame([(1, "k", "old")], schemas.ATTRIBUTE)
    src = spark.createDataFrame([(1,), (2,)], "media_id long")
    make = lambda df: df.select("media_id", F.lit("k").alias("key"), F.lit("new").alias("value"))
    values = lambda mode: sorted((r["media_id"], r["value"]) for r in schemas.apply_mode(old, src, make, ["media_id"], mode).collect())
    assert values("skip") == [(1, "old"), (2, "new")]
    assert values("update") == values("replace") == [(1, "new"), (2, "new")]
    with pytest.raises(ValueError):
        values("other")


def test_tables_change(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "media_id long, value string")
    assert schemas.ensure_columns(df, schemas.ATTRIBUTE).columns == ["media_id", "value", "key"]
    both = schemas.update_columns(df, spark.createDataFrame([(1, "x"), (2, None)], "media_id long, value string"), "media_id")
    assert sorted((r["media_id"], r["value"]) for r in both.collect()) == [(1, "x"), (2, "a")]
    out = schemas.delete_cascade(df, df.where("media_id = 1"), "media_id", {"c": (df, "media_id", "cascade"), "n": (df, "media_id", "null")})
    assert [out[k].count() for k in ("", "c", "n")] == [1, 1, 2] and out["n"].where("media_id is null").count() == 1
    steps = {2: lambda t: t | {"b": df}, 4: lambda t: t | {"c": df}}
    tables, version = schemas.migrate({}, 0, steps)
    assert (sorted(tables), version) == (["b", "c"], 4) and schemas.migrate(tables, version, steps)[1] == 4


def test_text_functions(spark):
    assert one(spark, text.keyword_list(F.lit('["a", "b."]'))) == ["a", "b"]
    assert one(spark, text.keyword_list(F.lit("'x', y;, ,"))) == ["x", "y"]
    assert one(spark, text.folded(F.lit("ÁrbolÑ"))) == "arboln"
    assert one(spark, text.normal_keyword(F.lit(" La Casa (grande) "))) == "casa"
    assert [one(spark, text.singular(F.lit(w))) for w in ("casas", "meses", "gas", "sol")] == ["casa", "meses", "gas", "sol"]
    assert one(spark, text.merged_ci(F.array(*[F.lit(w) for w in ("A", "b", "a", "B", "c")]))) == ["A", "b", "c"]
    assert one(spark, text.hashtags(F.lit("#B x #a #b"))) == ["a", "b"]
    assert [one(spark, text.leading_score(F.lit(x))) for x in ("7.5 good", "good")] == [7.5, 5.0]
    assert one(spark, text.cut_at_space(F.lit("aa bb cccc"), 8)) == "aa bb"
    assert one(spark, text.srt_time(F.lit(3661.5))) == "01:01:01,500"
    assert one(spark, text.refined(F.array(*[F.lit(w) for w in ("Las Casas", "casa", "xx", "perros")]), {"perro": "can"})) == ["casa", "can"]


def test_segments_filter(spark):
    rows = [(0.0, 2.0, "b", -0.9, 0.1, 1.0), (2.0, 4.0, " a ", None, None, None), (5.0, 6.0, "c", 0.0, 0.0, 1.0), (4.0, 6.0, " ", 0.0, 0.0, 1.0)]
    df = spark.createDataFrame([(rows,)], f"s {text.SEGMENT}")
    r = df.select(text.good_segments(F.col("s")).alias("g"), text.transcript(text.good_segments(F.col("s"))).alias("t")).first()
    assert len(r["g"]) == 2 and r["t"] == "a"


def test_geo_and_sun(spark):
    assert one(spark, geo.dms(F.lit("34 36 12 S"))) == -34.6033333
    assert one(spark, geo.dms(F.lit("-34.5"))) == -34.5
    assert [one(spark, geo.wind_point(F.lit(x))) for x in (0.0, 349.0, 90.0, 359.9)] == ["N", "N", "E", "N"]
    assert one(spark, geo.weather_label(F.lit(3))) == "nublado"
    assert one(spark, geo.sign_fixed(F.lit(34.6), -40, -30)) == -34.6
    noon = F.lit(dt.datetime(2024, 3, 20, 12, 7)).cast("timestamp")
    assert one(spark, sun.elevation(noon, F.lit(0.0), F.lit(0.0))) > 89
    rise, set_ = (one(spark, sun.rise_set_minutes(noon, F.lit(0.0), F.lit(0.0), r)) for r in (True, False))
    assert abs(rise - 364) < 3 and abs(set_ - 1091) < 3
    midsummer = F.lit(dt.datetime(2024, 6, 21, 12)).cast("timestamp")
    assert one(spark, sun.rise_set_minutes(midsummer, F.lit(80.0), F.lit(0.0), True)) is None
    assert one(spark, sun.twilight(F.lit(-7.0))) == "nautical"


def test_gpx_and_markdown(spark, tmp_path):
    (tmp_path / "a.gpx").write_text('<gpx><wpt lat="1" lon="2"><name>P</name></wpt><wpt lat="1"/><trk><trkseg><trkpt lat="1.5" lon="2.5"><ele>10</ele><time>2025-01-01T00:00:00Z</time></trkpt><trkpt lat="1.6" lon="2.6"/></trkseg></trk></gpx>')
    points = files.gpx_points(spark, str(tmp_path / "a.gpx")).orderBy("latitude").collect()
    assert [(p["latitude"], p["elevation"], p["time"]) for p in points] == [(1.5, 10.0, "2025-01-01T00:00:00Z"), (1.6, None, None)]
    assert [w["name"] for w in files.gpx_waypoints(spark, str(tmp_path / "a.gpx")).collect()] == ["P"]
    md = tmp_path / "t"
    md.mkdir()
    (md / "x.md").write_text("---\nautor: Ana\n---\n# Set\n<!-- no -->\n## One\nfecha: 2025-01-01\n\nBody one\n## Two\nautor: Eva\nBody two\n")
    (md / "_skip.md").write_text("## No\nno")
    rows = files.markdown_texts(spark, str(md)).orderBy("index").collect()
    assert [(r["title"], r["body"], r["autor"], r["fecha"], r["collection"]) for r in rows] == [("One", "Body one", "Ana", "2025-01-01", "Set"), ("Two", "Body two", "Eva", None, "Set")]


def test_chat_and_walk(spark, tmp_path):
    whole = json.dumps({"id": 1, "name": "c", "type": "t", "messages": [{"id": 1, "type": "message", "text": "hi", "photo": "p.jpg"}, {"id": 2, "type": "message", "text": ["a ", {"type": "bold", "text": "b"}], "file": "s.webp", "media_type": "sticker"}]})
    (tmp_path / "result.json").write_text(whole[:-2])
    m = files.chat_messages(spark, str(tmp_path / "result.json"))
    assert [r["t"] for r in m.orderBy("id").select(files.flat_text("text").alias("t")).collect()] == ["hi", "a b"]
    assert [(r["id"], r["kind"]) for r in files.attachments(m).collect()] == [(1, "photo")]
    assert files.repaired_json("nothing") is None
    media = tmp_path / "m"
    (media / "excluir").mkdir(parents=True)
    for n in ("a.JPG", "b.mp4", "._c.jpg", "excluir/d.jpg", "e.bin"):
        (media / n).write_bytes(b"x")
    assert sorted((r["path"].rsplit("/")[-1], r["kind"]) for r in files.walk(spark, str(media)).collect()) == [("a.JPG", "image"), ("b.mp4", "video"), ("e.bin", "other")]


def test_sqlite_and_sinks(spark, tmp_path):
    c = sqlite3.connect(tmp_path / "x.db")
    c.execute("create table t (id integer, name text, v real)")
    c.executemany("insert into t values (?, ?, ?)", [(i, f"n{i}", i / 2) for i in range(50)])
    c.commit()
    c.close()
    spark.dataSource.register(files.SqliteSource)
    df = spark.read.format("caravel_sqlite").option("table", "t").load(str(tmp_path / "x.db"))
    assert (df.count(), df.agg(F.sum("v")).first()[0]) == (50, 612.5)
    sinks.export_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 50
    seg = spark.createDataFrame([(0, 1)], "seg int, arc int")
    items = spark.createDataFrame([(1, "image", 2, 0.5), (2, "video", 0, 0.1)], "media_id int, kind string, score int, t_loop double")
    doc = json.loads(sinks.loop_document(items, seg).first()["document"])
    assert [x["media_id"] for x in doc["items"]] == [2, 1] and doc["by_kind"] == {"image": 1, "video": 1}


def test_scenes(spark):
    df = spark.createDataFrame([(1, '{"escenas":[{"indice":0,"inicio":1.0,"fin":2.0,"keywords":["a","b"],"descripcion":"d"}]}'), (2, "[1]"), (3, "{")], "id int, j string")
    assert sorted((r["key"], r["value"]) for r in files.scene_marks(df, "id", "j").collect()) == [("description", "d"), ("keyword", "a"), ("keyword", "b"), ("scene", "a, b")]


def test_stream_equals_table(spark, tmp_path):
    rows = [(at(0), "horas", "07:00"), (at(0.5), "horas", "16:00"), (at(0.6), "otro", "x"), (at(2), "tags", "mar"), (at(3600), "tags", "end")]
    df = spark.createDataFrame(rows, "ts timestamp, group string, value string").withColumn("sender", F.lit("a"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    table = [(r["start"], r["choices"]) for r in choices.bursts(df).orderBy("start").collect()]
    assert len(table) == 3
    p = choices.parsed(choices.bursts(df)).orderBy("start").first()
    assert p["hours"] == [7, 16] and p["tags"] == []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = choices.bursts(stream).writeStream.format("memory").queryName("b").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["start"], r["choices"]) for r in spark.table("b").collect())
    assert got == table[:2]  # the last burst waits for the watermark
    assert choices.windowed_counts(df.withColumnRenamed("group", "event_type"), "1 hour").count() == 4


def embedding_rows(spark):
    return [(r["label"], r["vec_id"], [float(x) for x in r["embedding"]]) for r in queries.table(spark, DIR, "embeddings").orderBy("vec_id").collect()]


def cosine(x, y):
    return sum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))


def test_cosine_search_meets_all_rows_of_a_label(spark):
    """Every vector whose id is divisible by 100 meets all others of its label."""
    rows = [(i, "a" if i % 3 else "b", [float(i % 7), 1.0, float(i % 5)]) for i in range(350)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    got = {(r["a"], r["b"]): r["similarity"] for r in dedup.similarity_search(df, "vec_id", "embedding", "label").collect()}
    label, vector = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    assert set(got) == {(a, b) for a in label if a % 100 == 0 for b in label if a != b and label[a] == label[b]}
    for (a, b), x in got.items():
        n = lambda v: sum(i * i for i in v) ** 0.5
        assert abs(x - sum(i * j for i, j in zip(vector[a], vector[b], strict=True)) / n(vector[a]) / n(vector[b])) < 1e-6


def test_leaders_of_whole_labels(spark, tmp_path):
    rows = [("x", i, [1.0, i / 1000]) for i in range(450)] + [("y", 450, [1.0, 0.0])]  # three blocks of 200 ids, all alike
    spark.createDataFrame(rows, "label string, vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r["leader"] for r in queries.QUERIES["cosine_leader_clusters"](spark, str(tmp_path)).collect()}
    assert got == {i: 0 for i in range(450)} | {450: 450}


def test_whole_word_lists_are_merged(spark):
    want = {}
    for r in queries.table(spark, DIR, "documents").collect():
        first = {}
        for w in r["text"].split(" "):
            first.setdefault(w.lower(), w)
        want[r["doc_id"]] = " ".join(first.values())
    assert {r["doc_id"]: r["merged"] for r in queries.QUERIES["merge_keywords_ci"](spark, DIR).collect()} == want
    assert one(spark, text.merged_words(F.lit("A b  a B c "))) == "A b  c"
    assert one(spark, text.merged_words(F.lit(None).cast("string"))) is None


def test_items_that_are_points_get_neighbours(spark):
    placed = queries.items(spark, DIR).where("lat is not null").count()
    got = queries.QUERIES["knn_two_points"](spark, DIR)
    assert got.select("media_id").distinct().count() == placed
    own = got.where("media_id % 20 = 0 and rank = 1").collect()
    assert own and all(r["metres"] == 0 for r in own)


# --- keys that are null, rows that repeat, one hot key ------------------------------------------


def _anchored(rows, window):
    """The rule in a loop: (key, time) to the number of its group."""
    out = {}
    for key in {k for k, _, _ in rows}:
        first, n = None, -1
        for t in sorted({t for k, t, _ in rows if k == key and t is not None}):
            if first is None or t - first > window:
                first, n = t, n + 1
            out[key, t] = n
    return out


@pytest.mark.parametrize(("seed", "window", "span"), [(1, 50, 5_000), (2, 300, 200_000), (3, 7, 900), (4, 100_000, 900_000)])
def test_anchored_groups_equal_the_loop(spark, seed, window, span):
    import random

    r = random.Random(seed)
    rows = [(r.choice(["hot"] * 6 + ["a", None]), r.choice([None] + [r.randrange(span)] * 30), i) for i in range(400)]
    rows += rows[:30]
    df = spark.createDataFrame(rows, "folder string, t long, id int").withColumn("ts", F.timestamp_seconds("t"))
    want = _anchored(rows, window)
    got = [(x["folder"], x["t"], x["id"], x["burst"]) for x in ordered.anchored_groups(df, ["folder"], "ts", window).collect()]
    assert sorted(got, key=repr) == sorted(((k, t, i, want.get((k, t))) for k, t, i in rows), key=repr)


def test_anchored_groups_without_keys_and_of_nothing(spark):
    df = spark.createDataFrame([(i * 10,) for i in range(40)], "t long").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(r["burst"] for r in ordered.anchored_groups(df, [], "ts", 35).collect()) == sorted(i // 4 for i in range(40))
    assert ordered.anchored_groups(df.where("t < 0"), [], "ts", 35).count() == 0


def test_no_row_holds_a_key(spark):
    df = spark.createDataFrame([("k", i) for i in range(50)], "folder string, t long").withColumn("ts", F.timestamp_seconds("t"))
    plan = ordered.anchored_groups(df, ["folder"], "ts", 5)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Arrow" not in plan


def test_sessions_over_buckets_and_null_keys(spark):
    import random

    r = random.Random(6)
    rows = [(r.choice(["a", None]), r.choice([None] + [r.randrange(2_000_000)] * 20), i) for i in range(300)]
    df = spark.createDataFrame(rows, "folder string, t long, id int").withColumn("ts", F.timestamp_seconds("t"))
    want = {}
    for key in ("a", None):
        n, before = 0, None
        for t, i in sorted((t, i) for k, t, i in rows if k == key and t is not None):
            n += before is not None and t - before > 20_000
            want[i], before = n, t
    assert {x["id"]: x["session"] for x in ordered.sessions(df, ["folder"], "ts", 20_000, "id").collect()} == {i: want.get(i, 0) for _, _, i in rows}


def test_neighbours_leave_other_columns(spark):
    """Columns called prev and next, of the caller, stay as they are."""
    df = spark.createDataFrame([(None, 1, "x", "y"), (None, 5, "x", "y"), ("a", 3, "x", "y")], "k string, t long, prev string, next string").withColumn("ts", F.timestamp_seconds("t"))
    got = ordered.lagged(df, ["k"], ["ts"], {"before": F.col("t")}).collect()
    assert sorted(((r["k"], r["t"], r["prev"], r["next"], r["before"]) for r in got), key=repr) == [("a", 3, "x", "y", None), (None, 1, "x", "y", None), (None, 5, "x", "y", 1)]


def test_emission_keeps_null_keys(spark):
    rows = [(k, i, i, 0.0, float(i)) for k in ("a", None) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, id int, t long, lat double, lon double").withColumn("ts", F.timestamp_seconds("t"))
    got = marks.emitted(df, ["k"], "ts", "id", "lat", "lon", 1000.0)
    assert sorted(((r["k"], r["id"]) for r in got.collect()), key=repr) == sorted([(k, i) for k in ("a", None) for i in range(4)], key=repr)
