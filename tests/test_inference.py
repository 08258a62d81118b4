"""Times from tracks, leaders in rounds, perceptual hashes and free names against loops."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caravel.functions import image
from caravel.operators import dedup
from caravel.plans import inference, jobs

T0 = dt.datetime(2025, 8, 10, tzinfo=dt.UTC)


def metres(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


def passed(points, lat, lon, most, hours):
    """The rule in a loop; points are (key, track, seconds, lat, lon)."""
    away = sorted((metres(lat, lon, p[3], p[4]), p[0], p) for p in points)
    if len(away) < 2 or away[0][0] > most:
        return None
    (d1, _, p1), (d2, _, p2) = away[:2]
    if abs(p2[2] - p1[2]) > hours * 3600:
        own = sorted((p[2], p[0], p) for p in points if p[1] == p1[1])
        at = [p for _, _, p in own].index(p1)
        beside = [own[i][2] for i in (at - 1, at + 1) if 0 <= i < len(own)]
        if beside:
            p2 = min(beside, key=lambda p: metres(lat, lon, p[3], p[4]))
            d2 = metres(lat, lon, p2[3], p2[4])
    return p1[2] if d1 + d2 == 0 else (p1[2] * d2 + p2[2] * d1) / (d1 + d2)


def test_a_track_that_passes_twice(spark):
    """Out and back on the same road a day later: the instant is on one pass, not in the night between."""
    there = [(i, "a", i * 60, -33.0, -62.0 + i * 0.01) for i in range(50)]
    back = [(100 + i, "a", 86_400 + i * 60, -33.0005, -61.51 - i * 0.01) for i in range(50)]
    other = [(200 + i, "b", 500_000 + i * 60, -30.0, -60.0 + i * 0.01) for i in range(5)] + [(300, None, 0, 10.0, 10.0)]
    points = there + back + other
    r = random.Random(3)
    texts = [(i, -33.0 + r.uniform(-0.004, 0.004), -62.0 + r.uniform(-0.02, 0.52)) for i in range(60)] + [(60, -20.0, -20.0), (61, -33.0, -61.9), (62, 10.0, 10.0)]
    ps = spark.createDataFrame(points, "point_id int, track string, s long, plat double, plon double").withColumn("ts", F.timestamp_seconds("s"))
    ts = spark.createDataFrame([*texts, (63, None, 5.0)], "media_id int, lat double, lon double").withColumn("ts", F.lit(None).cast("timestamp"))
    got = {x["media_id"]: x for x in inference.inferred_times(ts, ps).withColumn("s", F.unix_micros("ts") / 1e6).collect()}
    for i, lat, lon in texts:
        want = passed(points, lat, lon, 2000, 2)
        assert got[i]["state"] == ("too_far" if want is None else "inferred")
        assert got[i]["s"] is None if want is None else abs(got[i]["s"] - want) < 0.01
    assert got[63]["state"] == "no_position"
    # but for the turn, whose neighbour is the way back
    assert not any(4_000 < got[i]["s"] < 80_000 for i, _, lon in texts[:60] if lon < -61.55 and got[i]["s"])


def test_times_that_are_there_stay(spark):
    ps = spark.createDataFrame([(1, "a", 0, 0.0, 0.0), (2, "a", 60, 0.0, 0.001)], "point_id int, track string, s long, plat double, plon double").withColumn("ts", F.timestamp_seconds("s"))
    texts = spark.createDataFrame([(1, 999, 0.0, 0.0)], "media_id int, s long, lat double, lon double").withColumn("ts", F.timestamp_seconds("s"))
    state = lambda mode: inference.inferred_times(texts, ps, mode).select("state", F.unix_seconds("ts").alias("s")).first()
    assert tuple(state("skip")) == ("has_time", 999)
    assert tuple(state("update")) == ("inferred", 0)
    assert inference.inferred_times(texts, ps.where("s < 0"), "update").first()["state"] == "has_time"


# --- leaders ----------------------------------------------------------------------------------------


def leaders(rows, kind, limit):
    out, states = {}, {}
    for key, i, v in sorted(rows, key=lambda r: (repr(r[0]), r[1])):
        state = states.setdefault(key, kind(limit))
        at = None if kind.alone(v) else state.first(v)
        if at is None and not kind.alone(v):
            state.add(i, v)
        out[key, i] = i if at is None else state.keys[at]
    return out


def _vectors(r, n):
    middles = [[r.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    return [r.choice([None, [0.0] * 6] + [[a + r.gauss(0, 0.5) for a in r.choice(middles)]] * 20) for _ in range(n)]


@pytest.mark.parametrize("name", ["cosine", "hamming", "tags"])
def test_leaders_in_rounds_equal_the_loop(spark, name):
    """One key with most rows, null keys, values alike to nothing; blocks and chunks so small that several rounds are needed."""
    r = random.Random(len(name))
    n = 260
    kind, limit, field, values = {
        "cosine": (dedup.CosineLeaders, 0.8, "array<double>", _vectors(r, n)),
        "hamming": (dedup.HammingLeaders, 6, "long", [r.choice([None, *[r.choice([0, 0x5555, -1, 0x0F0F0F]) ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) ^ (1 << r.randrange(40))] * 20]) for _ in range(n)]),
        "tags": (dedup.TagLeaders, 2, "array<string>", [r.choice([None, [], *[r.sample("abcdefghij", 3)] * 20]) for _ in range(n)]),
    }[name]
    rows = [(r.choice(["hot"] * 8 + ["a", None]), i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"k string, id int, v {field}").repartition(3)
    got = dedup.leader_clusters(df, ["k"], "id", "v", kind, limit, block=7, chunk=40)
    assert {(x["k"], x["id"]): x["leader"] for x in got.collect()} == leaders(rows, kind, limit)


def test_leaders_without_keys_and_of_nothing(spark):
    df = spark.createDataFrame([(i, [float(i % 3 == 0), float(i % 3 != 0)]) for i in range(30)], "id int, v array<double>")
    got = {x["id"]: x["leader"] for x in dedup.leader_clusters(df, [], "id", "v", dedup.CosineLeaders, 0.9, block=2, chunk=8).collect()}
    assert got == {i: 0 if i % 3 == 0 else 1 for i in range(30)}
    assert dedup.leader_clusters(df.where("id < 0"), [], "id", "v", dedup.CosineLeaders, 0.9).count() == 0


def test_perceptual_hashes(spark):
    """Equal to the transform's definition; small changes of brightness or size leave most bits, other pictures don't."""
    r = np.random.default_rng(4)
    picture = np.kron(r.uniform(20, 230, (8, 8)), np.ones((8, 8)))
    other = r.uniform(0, 255, (64, 64))
    rows = [(1, picture), (2, picture * 0.9 + 20), (3, picture[::2, ::2]), (4, other)]
    df = spark.createDataFrame([(i, bytearray(np.clip(p, 0, 255).astype(np.uint8).tobytes()), p.shape[1]) for i, p in rows] + [(5, None, 3), (6, bytearray(b""), 3), (7, bytearray(b"abcd"), 3)], "id int, b binary, w int")
    got = {x["id"]: x["h"] for x in df.select("id", image.perceptual_hash("b", "w").alias("h")).collect()}
    apart = lambda a, b: ((got[a] ^ got[b]) & (2**64 - 1)).bit_count()
    assert apart(1, 2) <= 4 and apart(1, 3) <= 10 and apart(1, 4) > 16
    assert got[5] is got[6] is got[7] is None
    grey = np.clip(picture, 0, 255).astype(np.uint8).reshape(32, 2, 32, 2).mean(axis=(1, 3))
    low = [[sum(grey[a, b] * math.cos(math.pi / 32 * u * (a + 0.5)) * math.cos(math.pi / 32 * v * (b + 0.5)) for a in range(32) for b in range(32)) for v in range(8)] for u in range(8)]
    flat = [z for row in low for z in row]
    middle = sorted(flat)[31:33]
    bits = "".join("1" if z > sum(middle) / 2 else "0" for z in flat)
    assert int(bits, 2) == got[1] & (2**64 - 1)


def test_only_free_names_are_given(spark):
    paths = ["x.jpg", "x.jpg", "x_1.jpg", "x.jpg", "x_3.jpg", "x.jpg", "x_1.jpg", "x_1_1.jpg", "d/x", "d/x", "d.e/x", "d.e/x", "x_01.jpg"]
    df = spark.createDataFrame(list(enumerate(paths)), "n int, p string")
    got = [r["path"] for r in jobs.free_names(df, F.col("p"), ["n"]).orderBy("n").collect()]
    assert len(set(got)) == len(paths)
    assert got == ["x.jpg", "x_2.jpg", "x_1.jpg", "x_4.jpg", "x_3.jpg", "x_5.jpg", "x_1_2.jpg", "x_1_1.jpg", "d/x", "d/x_1", "d.e/x", "d.e/x_1", "x_01.jpg"]
