"""Streams give what tables give, whatever the order in which messages come."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from caravel.streaming import choices, receiver

T0 = dt.datetime(2025, 8, 10, 10)
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(STORE, before)


def streamed(spark, tmp_path, rows, schema, work, name):
    """The rows of ``work`` over files that come one after another."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = work(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_bursts_by_timer_equal_the_table(rocks, tmp_path):
    r = random.Random(2)
    rows, at = [], T0
    for _ in range(60):
        at += dt.timedelta(milliseconds=r.choice([50, 300, 699, 700, 701, 5000]))
        rows.append((r.choice(["a", "b"]), at, r.choice([*choices.GROUPS, "unknown"]), r.choice("xyz")))
    # each message up to two seconds late, some twice; the last ones make sure that all silences are over
    mixed = sorted(rows + r.sample(rows, 5), key=lambda x: x[1] + dt.timedelta(seconds=r.uniform(0, 2)))
    last = [(s, at + dt.timedelta(hours=h), "tags", "end") for h in (1, 2) for s in ("a", "b")]
    parts = [mixed[i : i + 13] for i in range(0, len(mixed), 13)] + [last[:2], last[2:]]
    schema = "sender string, ts timestamp, `group` string, value string"
    got = streamed(rocks, tmp_path, parts, schema, receiver.silent_bursts, "by_timer")
    table = choices.bursts(rocks.createDataFrame(rows, schema)).collect()
    plain = lambda found: sorted((x["sender"], x["start"], x["end"], tuple((c["group"], c["value"]) for c in x["choices"])) for x in found)
    assert plain(x for x in got if x["start"] < at + dt.timedelta(minutes=30)) == plain(table)


def _messages(spark):
    runs = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "run long, body string")
    rows = spark.createDataFrame([(1, "image", i, f"i{i}") for i in range(5)] + [(1, "text", 1, "t"), (2, "audio", 1, "a"), (2, "other", 1, "-"), (9, "image", 1, "-")], "run long, kind string, pos long, body string")
    return receiver.sent_messages(runs, rows, ("image", "video", "audio", "text"))


def test_messages_in_a_stable_order(spark):
    got = [(x["run"], x["block"], x["kind"], x["body"]) for x in _messages(spark).orderBy("run", "seq").collect()]
    assert got[:3] == [(1, "summary", None, "one"), (1, "table", "image", "5"), (1, "row", "image", "i0")]
    assert got[7:10] == [(1, "table", "text", "1"), (1, "row", "text", "t"), (1, "end", None, "6")]
    assert got[10:] == [(2, "summary", None, "two"), (2, "table", "audio", "1"), (2, "row", "audio", "a"), (2, "end", None, "1"), (3, "summary", None, "three"), (3, "end", None, "0")]


def test_receiver_rebuilds_and_reconciles(rocks, tmp_path):
    """Run 1 is whole, though mixed up and with repeats; run 2 lost a row; run 3 is empty."""
    r = random.Random(4)
    sent = [tuple(x) for x in _messages(rocks).collect()]
    rows = [("td", T0 + dt.timedelta(milliseconds=10 * i), run, seq, block, kind, body) for i, (run, seq, block, kind, body) in enumerate(sorted(sent)) if (run, block) != (2, "row")]
    mixed = rows + r.sample(rows, 4)
    r.shuffle(mixed)
    parts = [mixed[i : i + 5] for i in range(0, len(mixed), 5)] + [[("td", T0 + dt.timedelta(hours=h), 50 + h, 0, "summary", None, "")] for h in (1, 2)]
    schema = "receiver string, ts timestamp, run long, seq long, block string, kind string, body string"
    got = streamed(rocks, tmp_path, parts, schema, receiver.received_runs, "by_run")
    plain = lambda found: sorted((x["run"], x["state"], x["expected"], x["received"], tuple(sorted(x["tables"].items()))) for x in found if x["run"] < 10)
    assert plain(got) == plain(receiver.received_table(rocks.createDataFrame(rows, schema)).collect())
    assert plain(got) == [(1, "complete", 6, 6, (("image", 5), ("text", 1))), (2, "incomplete", 1, 0, ()), (3, "complete", 0, 0, ())]


def test_writer_overwrites_its_own_batch(spark, tmp_path):
    rows = lambda runs: runs.select("run", F.lit("image").alias("kind"), F.lit(1).alias("pos"), F.lit("x").alias("body"))
    write = receiver.MessageWriter(str(tmp_path / "out"), rows, ("image",))
    one = spark.createDataFrame([(1, "s")], "run long, body string")
    for batch in (0, 0, 1):
        write(one, batch)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("batch").count().orderBy("batch").collect() == [(0, 4), (1, 4)]
