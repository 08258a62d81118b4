"""Names on a ladder, the vector index, undo, chat windows and context marks against loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caravel.operators import chat, history, names, vector_index
from caravel.plans import context

# --- names ------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def rung(tag, own, known, common):
    """The ladder in a loop."""
    if len(tag) < 3 or tag in common:
        return None
    order = sorted(known, key=lambda n: (names.KINDS.index(n[1]), n[0]))
    fits = lambda n: not n[2] or (len(own) == 1 and set(own) <= set(n[2]))
    for n in order:
        if n[0].lower() == tag:
            return "A", n[0], n[1], 0
    near = [(distance(tag, n[0].lower()), names.KINDS.index(n[1]), n[0], n[1]) for n in order if distance(tag, n[0].lower()) <= 2 and fits(n)]
    if near:
        return "B", min(near)[2], min(near)[3], min(near)[0]
    for n in order:
        words = n[0].lower().split()
        if len(set(words)) > 1 and set(tag.split()) <= set(words) and fits(n):
            return "C", n[0], n[1], len(words)
    return None


def test_ladder_equals_the_loop(spark):
    r = random.Random(1)
    base = ["San Lorenzo", "Rosario", "Villa Maria", "San Juan", "Funes", "Perez", "Cordoba", "Santa Fe", "Rosario Sur", "Ana"]
    known = [(n, r.choice(names.KINDS), sorted(r.sample(["x", "y", "z"], r.randint(0, 2)))) for n in base] + [("Rosario", "waypoint", [])]
    tags = {}
    for _ in range(150):
        t = list(r.choice(base).lower())
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(t))
            t[i : i + r.randint(0, 1)] = r.choice(["", "a", "q"])
        tags["".join(t).strip() or "qqq"] = sorted(r.sample(["x", "y", "z"], r.randint(0, 2)))
    for t in ("san", "villa", "sur rosario", "maria villa", "ab", "fe"):
        tags[t] = ["x"]
    common = ("funes", "san")
    tf = spark.createDataFrame([(t, p) for t, p in tags.items()], "tag string, provinces array<string>")
    nf = spark.createDataFrame(known, "name string, kind string, provinces array<string>")
    matches, missed = names.ladder(tf, nf, common)
    got = {x["tag"]: (x["step"], x["name"], x["kind"], x["distance"]) for x in matches.collect()}
    norm = lambda t: " ".join(t.split())
    assert got == {t: w for t, p in tags.items() if (w := rung(norm(t), p, known, common))}
    for x in missed.collect():
        assert x["tag"] not in got and x["distance"] <= 2 and x["reason"]
    assert "funes" in {x["tag"] for x in missed.collect()} or "funes" not in tags


# --- vectors ----------------------------------------------------------------------------------------


def test_index_is_exact_and_probes_recall(spark):
    r = np.random.default_rng(5)
    middles = r.normal(size=(30, 16))
    rows = [(i, int(r.integers(0, 4)), [float(x) for x in middles[r.integers(0, 30)] + r.normal(size=16) * 0.6]) for i in range(1500)]
    odd = [(5000, 1, None), (5001, 1, [0.0] * 16), (5002, 1, [float("nan")] * 16), (None, 1, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, "id int, kind int, v array<double>")
    units = np.array([v for _, _, v in rows])
    units /= np.linalg.norm(units, axis=1)[:, None]
    kinds = np.array([k for _, k, _ in rows])
    want = set()
    for q in range(0, 1500, 100):
        near = units @ units[q]
        for k in range(4):
            if k != kinds[q]:
                good = [i for i in np.flatnonzero(kinds == k) if near[i] >= 0.5]
                want |= {(q, int(i)) for i in sorted(good, key=lambda i: (-near[i], i))[:5]}
    index = vector_index.VectorIndex.build(df, "id", "v", "kind", sample=300, chunk=100)
    assert index.rows.count() == 1500
    exact = {(x["a"], x["b"]) for x in index.search(F.col("id") % 100 == 0, 0.5, 5).collect()}
    assert exact == want and len(want) > 50
    some = {(x["a"], x["b"]) for x in index.search(F.col("id") % 100 == 0, 0.5, 5, probes=8).collect()}
    assert len(some & want) >= 0.9 * len(want)
    assert vector_index.VectorIndex.build(df.where("id = 5000"), "id", "v", "kind") is None


# --- undo -------------------------------------------------------------------------------------------


def test_written_and_undone(spark):
    """Inserts, updates and deletes, a null in the key, batches undone in both orders."""
    schema = "id int, part string, a double, b string"
    start = spark.createDataFrame([(1, "x", 1.0, "p"), (2, None, 2.0, None), (3, "x", None, "q"), (4, "y", 4.0, "r")], schema)
    first = spark.createDataFrame([(1, "x", 10.0, "p"), (2, None, 2.0, "new"), (3, "x", 3.0, "q"), (5, "z", 5.0, "s")], schema)
    second = spark.createDataFrame([(1, "x", 11.0, "late"), (2, None, 2.0, "new"), (3, "x", 3.0, "q"), (6, "z", None, None)], schema)
    key, at = ["id", "part"], F.timestamp_seconds(F.lit(0))
    log = history.changes_of(start, first, key, 1, at).unionByName(history.changes_of(first, second, key, 2, at))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    back = history.undone(second, log, key, 2)
    assert rows(back) == rows(first) and rows(history.undone(back, log, key, 1)) == rows(start)
    # the first one alone: a was written again since, so it stays; 4 comes back, 5 is gone, 6 stays
    assert rows(history.undone(second, log, key, 1)) == sorted([(1, "x", 11.0, "late"), (2, None, 2.0, None), (3, "x", None, "q"), (4, "y", 4.0, "r"), (6, "z", None, None)], key=repr)
    assert rows(history.undone(second, log, key, 9)) == rows(second)
    assert {(r["batch"], r["n"], r["inserted"], r["updated"], r["deleted"]) for r in history.batches(log).collect()} == {(1, 5, 1, 3, 1), (2, 3, 1, 1, 1)}


# --- chat -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 4, 50])
def test_chat_windows_equal_the_loop(spark, size):
    r = random.Random(size)
    rows = [(r.choice(["a", None]), i, r.choice([None] + [r.randrange(5 * 86_400)] * 9)) for i in range(60)] + [("bare", 100 + i, None) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, id int, s long").withColumn("ts", F.timestamp_seconds("s"))
    hours = [0.0, 3.5, 12.0, 23.99]
    probes = spark.createDataFrame([(k, h) for k in ("a", None, "bare", "none") for h in hours], "k string, hour double")
    want = set()
    for k in ("a", None, "bare"):
        listed = sorted((x for x in rows if x[0] == k), key=lambda x: (x[2] is not None, x[2] or 0, x[1]))
        last = max(0, len(listed) - size)
        for h in hours:
            away = [(min(abs(d := (x[2] - 10_800) % 86_400 - h * 3600), 86_400 - abs(d)), n) for n, x in enumerate(listed) if x[2] is not None]
            begin = min(min(away)[1] if away else int(h / 24 * last + 0.5), last)
            want |= {(k, h, x[1], n) for n, x in enumerate(listed[begin : begin + size], 1)}
    got = chat.windows(df, probes, ["k"], ["ts", "id"], "ts", "hour", size)
    assert {(x["k"], x["hour"], x["id"], x["place"]) for x in got.collect()} == want


# --- context ----------------------------------------------------------------------------------------

T0 = dt.datetime(2025, 8, 10, 10)
CLIP = "media_id int, s0 long, s1 long, lat double, lon double, alt double"


def clips(spark, rows):
    return spark.createDataFrame(rows, CLIP).withColumn("t0", F.timestamp_seconds("s0")).withColumn("t1", F.timestamp_seconds("s1")).drop("s0", "s1")


def tables(spark):
    """A track at 0, 10 and 20 seconds with an unknown elevation, and one of four points without times."""
    timed = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 0.0), (1, 2, 10, 1.0, 1.0, 100.0), (1, 3, 20, 2.0, 2.0, None)], "track_id int, seq int, s long, lat double, lon double, ele double").withColumn("ts", F.timestamp_seconds("s"))
    untimed = spark.createDataFrame([(2, i, 10.0 + i, 20.0, 10.0 * i) for i in range(4)], "track_id int, seq int, lat double, lon double, ele double")
    return timed, untimed


def test_positions_at_the_edges_of_a_track(spark):
    timed, untimed = tables(spark)
    at = lambda s: F.timestamp_seconds(F.lit(s))
    rows = spark.createDataFrame([(i, 1, s) for i, s in enumerate([-1, 0, 5, 10, 15, 20, 21])], "media_id int, track_id int, s long")
    rows = rows.select("media_id", "track_id", F.timestamp_seconds("s").alias("at"), F.lit(0).cast("long").alias("offset_s"), at(0).alias("t0"), at(0).alias("t1"), F.lit(7.0).alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(1.0).alias("alt"))
    got = [x["p"] and (x["p"]["lat"], x["p"]["ele"], x["p"]["source"]) for x in context.positions(rows, timed, untimed).orderBy("media_id").collect()]
    # not before the first point nor at it, nor behind the last; an elevation only between two known ones
    assert got == [None, None, (0.5, 50.0, "track_interpolado"), (1.0, 100.0, "track_interpolado"), (1.5, None, "track_interpolado"), (2.0, None, "track_interpolado"), None]


def test_share_of_a_clip_on_a_track_without_times(spark):
    timed, untimed = tables(spark)
    rows = context.samples(clips(spark, [(1, 1000, 1060, None, None, None)]).withColumn("track_id", F.lit(2)), 15)
    got = [(x["offset_s"], round(x["p"]["lat"], 9), round(x["p"]["ele"], 9)) for x in context.positions(rows, timed, untimed).orderBy("offset_s").collect()]
    assert got == [(0, 10.0, 0.0), (15, 10.75, 7.5), (30, 11.5, 15.0), (45, 12.25, 22.5), (60, 13.0, 30.0)]


def test_track_without_a_range_is_the_last_resort(spark):
    made = clips(spark, [(1, 0, 5, 0.0, 0.0, 0.0), (2, 90, 95, 0.0, 0.0, 0.0)])
    tracks = spark.createDataFrame([(5, 0, 50), (4, 60, 80), (3, None, None)], "track_id int, a long, b long").select("track_id", F.timestamp_seconds("a").alias("begins"), F.timestamp_seconds("b").alias("ends"))
    pick = lambda t: {(x["media_id"], x["track_id"], x["mode"]) for x in context.choose_tracks(made, t).collect()}
    assert pick(tracks) == {(1, 5, "contains"), (2, 4, "nearest")}
    assert pick(tracks.where("begins is null")) == {(1, 3, "no_range"), (2, 3, "no_range")}
    assert pick(tracks.where("track_id > 9")) == set()


def test_modes_and_states(spark):
    timed, untimed = tables(spark)
    tracks = spark.createDataFrame([(1, 0, 20)], "track_id int, a long, b long").select("track_id", F.timestamp_seconds("a").alias("begins"), F.timestamp_seconds("b").alias("ends"))
    places = spark.createDataFrame([], "lat double, lon double, place string")
    weather = spark.createDataFrame([], "day date, lat double, lon double, hour int, label string, temperature double")
    run = lambda some: context.context(some, tracks, timed, untimed, places, weather, every=5)
    some = clips(spark, [(1, 0, 10, 0.0, 0.0, 0.0), (2, 500, 500, None, None, None), (3, None, None, 1.0, 1.0, 1.0)])
    none = run(some.where("media_id < 0"))
    old = spark.createDataFrame([(1, "other")], "media_id int, key string")
    old = none[0].unionByName(old, allowMissingColumns=True)
    marks, states = context.context_step(old, none[1], some, "skip", run)
    assert {(x["media_id"], x["state"]) for x in states.collect()} == {(1, "ok"), (2, "sin_datos"), (3, "sin_datos")}
    first = sorted((x["media_id"], x["offset_s"] or 0, x["key"]) for x in marks.collect())
    assert (1, 0, "other") in first and any(k == "contexto_movimiento" for _, _, k in first)
    again = context.context_step(marks, states, some, "skip", run)
    assert sorted((x["media_id"], x["offset_s"] or 0, x["key"]) for x in again[0].collect()) == first
    for mode in ("update", "replace"):
        redone = context.context_step(marks, states, some, mode, run)
        assert sorted((x["media_id"], x["offset_s"] or 0, x["key"]) for x in redone[0].collect()) == first and redone[1].count() == 3


# --- audits and stale results -------------------------------------------------------------------------


def test_openings_level_by_level(spark):
    from collections import Counter

    from caravel.operators import audit

    r = random.Random(7)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(300)] + [None, "  ", "A  B\n c"]
    want = Counter()
    for t in texts:
        w = (t or "").lower().split()
        want.update((k, " ".join(w[:k])) for k in range(1, min(len(w), 5) + 1))
    got = {(x["words"], x["opening"]): x["n"] for x in audit.openings(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 4, 5).collect()}
    assert got == {k: n for k, n in want.items() if n >= 4}


@pytest.mark.parametrize("mode", ["skip", "update"])
def test_stale_results_equal_the_loop(spark, mode):
    from caravel.plans import steps

    derivations = {"b": ("a",), "c": ("b",), "d": ("c", "x"), "e": ("d",), "z": ("y",)}
    after = {"a": "bcde", "b": "cde", "c": "de", "d": "e", "x": "de", "y": "z"}
    r = random.Random(8)
    old = {(i, k): r.choice("12") for i in range(60) for k in "abcdexyz" if r.random() < 0.8}
    new = {(i, k): r.choice("12") for i in range(60) for k in "abxy" if r.random() < 0.3}
    want = dict(old)
    brought = {p: v for p, v in new.items() if mode == "update" or p not in old}
    for (i, k), v in brought.items():
        if (i, k) not in old or old[i, k] != v:
            for made in after.get(k, ""):
                if (i, made) not in brought:
                    want.pop((i, made), None)
    want |= brought
    frame = lambda rows: spark.createDataFrame([(i, k, v) for (i, k), v in rows.items()], "media_id int, key string, value string")
    got = steps.enriched(frame(old), frame(new), derivations, mode).collect()
    assert sorted(((x["media_id"], x["key"]), x["value"]) for x in got) == sorted(want.items())


def test_circles_of_results_are_an_error():
    from caravel.plans import steps

    with pytest.raises(ValueError, match="itself"):
        steps.derived_from({"a": ("b",), "b": ("a",)})


# --- bursts and backups -----------------------------------------------------------------------------


def test_selection_with_a_prefilter(spark):
    """Two bursts; equal hashes go before vectors are compared; a group without any score stays whole."""
    from caravel.operators import bursts, dedup

    v = {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    rows = [(1, 0, 7, v["a"], 1.0), (2, 10, 7, v["b"], 9.0), (3, 20, 99_000_000, v["a"], 5.0), (4, 30, 0x7FFF00000000, v["b"], None), (5, 9000, 7, v["a"], None), (6, 9010, 0xFFFF0000, v["a"], None), (7, None, 7, v["a"], 1.0)]
    df = spark.createDataFrame([(None, *r) for r in rows], "k string, id int, s long, h long, v array<double>, score double").withColumn("ts", F.timestamp_seconds("s"))
    got = bursts.selection(df, ["k"], "ts", "id", "score", 300, [("h", dedup.HammingLeaders, 3), ("v", dedup.CosineLeaders, 0.9)])
    assert {(x["id"], x["burst"], x["leader"], x["kept"], x["reason"]) for x in got.collect()} == {
        (1, 0, 1, False, "worse"), (2, 0, 1, False, "prefilter"), (3, 0, 1, True, "best"), (4, 0, 4, True, "unrated"), (5, 1, 5, True, "unrated"), (6, 1, 5, True, "unrated")
    }
    plain = bursts.selection(df, ["k"], "ts", "id", "score", 300)
    assert {(x["id"], x["kept"]) for x in plain.collect()} == {(1, False), (2, True), (3, False), (4, False), (5, True), (6, True)}


def test_backups_and_marked_csv(spark, tmp_path):
    from caravel.sources import sinks

    df = spark.createDataFrame([(1, "ñ")], "id int, value string")
    folder = f"file://{tmp_path}/backups"
    assert sinks.snapshots(spark, folder) == []
    for v in ("one", "two"):
        sinks.snapshot_tables({"items": df.withColumn("v", F.lit(v)), "more": df}, folder, v)
    assert {v for v, _ in sinks.snapshots(spark, folder)} == {"one", "two"}
    back = sinks.restored(spark, folder, "one")
    assert set(back) == {"items", "more"} and back["items"].first()["v"] == "one"
    with pytest.raises(ValueError, match="three"):
        sinks.restored(spark, folder, "three")
    sinks.export_csv(df.coalesce(1), str(tmp_path / "csv"))
    part = next((tmp_path / "csv").glob("part-*.csv"))
    assert part.read_bytes().decode("utf-8") == "﻿id,value\n1,ñ\n"
