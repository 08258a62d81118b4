import pytest
from pyspark.sql import functions as F

from caravel.functions import color, metadata, replies, time
from caravel.plans import steps


def values(spark, expr, *rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r["v"] for r in df.orderBy("i").select(expr.alias("v")).collect()]


def test_times(spark):
    got = values(spark, time.parsed("x"), "2025-08-10T10:00:00Z", "2025-08-10 10:00:00+0200", "2025:08:10 10:00:00", "nonsense", None)
    assert [r["note"] for r in got] == ["offset", "offset", "local", "unreadable", None]
    hours = values(spark, F.date_format(time.parsed("x")["ts"], "HH"), "2025-08-10T10:00:00Z", "2025-08-10 10:00:00+0200", "2025:08:10 10:00:00")
    assert hours == ["10", "08", "13"]
    text = F.date_format(time.of_filename("x"), "yyyy-MM-dd HH:mm:ss")
    assert values(spark, text, "VID_20250810_101112.mp4", "2025-08-10 10.mp4", "20250810.jpg", "x.jpg") == ["2025-08-10 13:11:12", "2025-08-10 13:00:00", "2025-08-10 03:00:00", None]
    assert values(spark, time.weekday(F.col("x").cast("timestamp")), "2025-08-11 02:00:00", "2025-08-11 04:00:00") == ["domingo", "lunes"]
    assert values(spark, time.span_text(F.col("x").cast("double")), "8100", "75.9") == ["2h 15m", "01:15"]


def test_colors(spark):
    assert values(spark, color.nearest_name("x"), "#fe0101", "#7f8081", "bad", None) == ["red", "gray", None, None]
    cells = spark.createDataFrame([(1, "#ff0000", 0.3, 1.0), (1, "#808080", 0.6, 0.0), (1, "#0000ff", 0.1, 0.0)], "item int, hex string, share double, centrality double")
    assert [r["hex"] for r in color.dominant(cells, "item", 2).orderBy("rank").collect()] == ["#ff0000", "#808080"]


def test_metadata(spark):
    assert values(spark, metadata.flat_exif("x"), '{"EXIF:Make": "A", "File:Size": 3}') == [{"exif_make": "A", "file_size": "3"}]
    probe = '{"streams":[{"codec_type":"audio","codec_name":"aac","channels":2},{"codec_type":"video","codec_name":"h264","width":3840,"height":1920,"avg_frame_rate":"30000/1001"}],"format":{"duration":"1.5"}}'
    (r,) = values(spark, metadata.flat_probe("x"), probe)
    assert (r["fps"], r["width"], r["audio_codec"], r["duration"]) == (29.97, 3840, "aac", 1.5)
    assert values(spark, metadata.container_state("x"), probe, '{"streams":[]}', "{") == ["both", "none", "unreadable"]
    assert values(spark, metadata.moved_path("x", "/a", "/b/c"), "/a/x", "/ab/x", "/a") == ["/b/c/x", "/ab/x", "/b/c"]
    assert values(spark, metadata.slug("x"), " Árbol & Sol! ") == ["arbol-sol"]


@pytest.mark.parametrize(("text", "want"), [('["mar", "sol",]', ["mar", "sol"]), ("{'keywords': ['a', 'e'", ["a", "e"]), ("1. Mar\n2) Sol\n- mar", ["Mar", "Sol"]), ("mar, xyz; sol", ["mar", "sol"]), ("", [])])
def test_reply_keywords(text, want):
    assert replies.keywords(text) == want


def test_reply_descriptions(spark):
    assert values(spark, replies.reply_description(F.col("x")), "Here is: the image shows a boat on a lake", "This is it", None) == ["A boat on a lake", "This is it", None]
    assert values(spark, replies.lossless(F.col("x"), F.lit("B c")), "a  b c", "a d") == [True, False]


def test_steps(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0)], "id int, lat double")
    made = []
    plan = {"a": steps.Step("a", F.col("lat").isNull(), lambda t: made.append("a") or {}), "b": steps.Step("b", F.lit(False), lambda t: made.append("b") or {}, ("a",))}
    assert steps.in_order(plan, ["b"]) == ["a", "b"]
    steps.run_steps({}, plan, ["b", "a"])
    assert made == ["a", "b"]
    assert {r["step"]: (r["pending"], r["done"]) for r in steps.status(df, plan).collect()} == {"a": (1, 1), "b": (0, 2)}
    with pytest.raises(ValueError):
        steps.in_order({"x": steps.Step("x", F.lit(True), dict, ("x",))}, ["x"])
