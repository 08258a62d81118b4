"""Selections that end in silence, what is sent for each of them, and the receiver that rebuilds its tables from it.

All three work on streams whose messages may come late or out of order. What the streams give equals what the same rules give on tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from caravel.streaming.choices import GROUPS

BURST = "sender string, start timestamp, end timestamp, choices array<struct<`group`: string, value: string>>"
REPORT = "receiver string, run long, state string, expected long, received long, tables map<string, long>"
EPOCH = dt.datetime(1970, 1, 1)


def _ms(t: dt.datetime) -> int:
    return (t - EPOCH) // dt.timedelta(milliseconds=1)


class SilenceTimer(StatefulProcessor):
    """Holds a sender's messages until its silence is sure: the watermark has passed the last one by ``quiet_ms``.

    A message exactly ``quiet_ms`` behind another still belongs to it, as in a session window. Messages may come in any order; those of one time are told apart by what they say, and a repeated one counts once, as a burst holds distinct choices.
    """

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "us long, grp string, value string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            us = (r["ts"] - EPOCH) // dt.timedelta(microseconds=1)
            self.held.appendValue((us, r["group"], r["value"]))
            # a timer for each possible end; those in the midst of a burst find nothing to send
            self.handle.registerTimer(us // 1000 + self.quiet_ms + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        listed = sorted({(u, g, v) for u, g, v in self.held.get()})
        open_, out = [], []
        for x in listed:
            if open_ and x[0] - open_[-1][-1][0] <= self.quiet_ms * 1000:
                open_[-1].append(x)
            else:
                open_.append([x])
        left = []
        for burst in open_:
            end = burst[-1][0] + self.quiet_ms * 1000
            if end < now_us:
                at = lambda us: EPOCH + dt.timedelta(microseconds=us)
                out.append(Row(sender=key[0], start=at(burst[0][0]), end=at(end), choices=[Row(group=g, value=v) for g, v in sorted({(g, v) for _, g, v in burst})]))
            else:
                left += burst
        if out:
            self.held.put(left) if left else self.held.clear()
        return iter(out)

    def close(self) -> None:
        pass


def silent_bursts(messages: DataFrame, quiet_ms: int = 700, late: str = "10 seconds") -> DataFrame:
    """STR1, SRC15. Bursts of a stream (sender, ts, group, value), sent by a timer once ``quiet_ms`` of silence are sure. Unknown groups are ignored. Needs the RocksDB state store."""
    known = messages.where(F.col("group").isin(*GROUPS) & F.col("ts").isNotNull()).select(F.coalesce("sender", F.lit("")).alias("sender"), F.col("ts").cast("timestamp_ntz").alias("ts"), "group", "value", F.col("ts").alias("_event"))
    known = known.withWatermark("_event", late)
    return known.groupBy("sender").transformWithState(SilenceTimer(quiet_ms), BURST, "Append", "EventTime")


# --- what is sent -----------------------------------------------------------------------------------


def sent_messages(runs: DataFrame, rows: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """SNK12. (run, seq, block, kind, body) of each run: its summary, for each of ``kinds`` that it has a table's head with its count and its rows, and the end with the count of all rows.

    ``runs``: run, body; ``rows``: run, kind, pos, body. Numbers rise in the order in which messages are to be sent: block by block, and ``pos`` within a block.
    """
    place = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    known = rows.where(F.col("kind").isin(*kinds)).join(runs.select("run"), "run", "left_semi")
    heads = known.groupBy("run", "kind").agg(F.count("*").alias("n"))
    parts = runs.select("run", F.lit(0).alias("o"), F.lit(0).alias("p"), F.lit(0).cast("long").alias("pos"), F.lit("summary").alias("block"), F.lit(None).cast("string").alias("kind"), "body")
    parts = parts.unionByName(heads.select("run", place.cast("int").alias("o"), F.lit(0).alias("p"), F.lit(0).cast("long").alias("pos"), F.lit("table").alias("block"), "kind", F.col("n").cast("string").alias("body")))
    parts = parts.unionByName(known.select("run", place.cast("int").alias("o"), F.lit(1).alias("p"), F.col("pos").cast("long").alias("pos"), F.lit("row").alias("block"), "kind", "body"))
    total = runs.select("run").join(heads.groupBy("run").agg(F.sum("n").alias("n")), "run", "left")
    end = total.select("run", F.lit(len(kinds) + 1).alias("o"), F.lit(0).alias("p"), F.lit(0).cast("long").alias("pos"), F.lit("end").alias("block"), F.lit(None).cast("string").alias("kind"), F.coalesce("n", F.lit(0)).cast("string").alias("body"))
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("run").orderBy("o", "p", "pos", "body")) - 1
    return parts.unionByName(end).select("run", seq.cast("long").alias("seq"), "block", "kind", "body")


class MessageWriter:
    """SNK12. A ``foreachBatch`` sink: the messages of a micro-batch's runs, one folder a batch. A batch that runs again overwrites its own folder, so nothing is sent twice."""

    def __init__(self, path: str, rows_of, kinds: Sequence[str]) -> None:
        self.path, self.rows_of, self.kinds = path, rows_of, tuple(kinds)

    def __call__(self, runs: DataFrame, batch: int) -> None:
        found = sent_messages(runs, self.rows_of(runs), self.kinds)
        found.repartitionByRange("run", "seq").sortWithinPartitions("run", "seq").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


# --- the receiver -----------------------------------------------------------------------------------


def reconciled(blocks: Sequence[tuple[int, str, str | None, str]]) -> tuple[str, int | None, int, dict[str, int]]:
    """(state, expected, received, rows by kind) of one run's messages (seq, block, kind, body), each counted once by its number.

    ``complete``: the end's count and each table's own count are met. ``incomplete``: an end came, but rows lack. ``open``: no end, or no summary.
    """
    by_seq = {b[0]: b for b in blocks}
    tables: dict[str, int] = {}
    promised: dict[str, int] = {}
    end, summary = None, False
    for _, block, kind, body in by_seq.values():
        if block == "row":
            tables[kind] = tables.get(kind, 0) + 1
        elif block == "table":
            promised[kind] = int(body)
        elif block == "end":
            end = int(body)
        elif block == "summary":
            summary = True
    received = sum(tables.values())
    if end is None or not summary:
        return "open", end, received, tables
    whole = received == end and all(tables.get(k, 0) == n for k, n in promised.items()) and set(tables) == set(promised)
    return ("complete" if whole else "incomplete"), end, received, tables


class Receiver(StatefulProcessor):
    """Rebuilds a receiver's tables run by run. A run is reported once it is complete, or by a timer ``wait_ms`` behind its last message; a run that is reported is forgotten but for its number."""

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one entry a message, so that a run is only as large as what belongs to it
        self.held = handle.getMapState("held", "run long, seq long", "block string, kind string, body string, ms long")
        self.done = handle.getMapState("done", "run long", "state string")

    def _report(self, receiver: str, run: int, blocks: dict) -> Row:
        state, expected, received, tables = reconciled([(seq, b, k, x) for seq, (b, k, x, _) in blocks.items()])
        for seq in blocks:
            self.held.removeKey((run, seq))
        self.done.updateValue((run,), (state,))
        return Row(receiver=receiver, run=run, state=state, expected=expected, received=received, tables=tables)

    def _runs(self) -> dict[int, dict]:
        out: dict[int, dict] = {}
        for (run, seq), value in self.held.iterator():
            out.setdefault(run, {})[seq] = tuple(value)
        return out

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        touched = set()
        for r in rows:
            if self.done.containsKey((r["run"],)):
                continue
            ms = _ms(r["ts"])
            body = r["body"] if r["block"] in ("table", "end") else None
            self.held.updateValue((r["run"], r["seq"]), (r["block"], r["kind"], body, ms))
            self.handle.registerTimer(ms + self.wait_ms)
            touched.add(r["run"])
        out = []
        for run, blocks in self._runs().items() if touched else ():
            if run in touched and reconciled([(seq, b, k, x) for seq, (b, k, x, _) in blocks.items()])[0] == "complete":
                out.append(self._report(key[0], run, blocks))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        return iter([self._report(key[0], run, blocks) for run, blocks in self._runs().items() if max(b[3] for b in blocks.values()) + self.wait_ms <= now])

    def close(self) -> None:
        pass


def received_runs(messages: DataFrame, wait_ms: int = 5_000, late: str = "10 seconds") -> DataFrame:
    """STR4. A report of each run of a stream (receiver, ts, run, seq, block, kind, body): its state, the end's count, the rows received and how many each table has.

    Messages may come in any order and more than once. Needs the RocksDB state store.
    """
    rows = messages.select(F.coalesce("receiver", F.lit("")).alias("receiver"), F.col("ts").cast("timestamp_ntz").alias("ts"), "run", "seq", "block", "kind", "body", F.col("ts").alias("_event"))
    return rows.withWatermark("_event", late).groupBy("receiver").transformWithState(Receiver(wait_ms), REPORT, "Append", "EventTime")


def received_table(messages: DataFrame) -> DataFrame:
    """The same reports of a table, by counting; runs without an end or a summary are ``open``."""
    once = messages.dropDuplicates(["receiver", "run", "seq"])
    kinds = once.where("block in ('row', 'table')").groupBy("receiver", "run", "kind").agg(F.count_if(F.col("block") == "row").alias("n"), F.max(F.when(F.col("block") == "table", F.col("body").cast("long"))).alias("promised"))
    by_run = kinds.groupBy("receiver", "run").agg(F.sum("n").alias("received"), F.bool_and(F.col("n").eqNullSafe(F.col("promised"))).alias("met"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("kind", "n"))))).alias("tables"))
    ends = once.groupBy("receiver", "run").agg(F.max(F.when(F.col("block") == "end", F.col("body").cast("long"))).alias("expected"), F.bool_or(F.col("block") == "summary").alias("summary"))
    rows = ends.join(by_run, ["receiver", "run"], "left")
    received = F.coalesce("received", F.lit(0))
    state = F.when(F.col("expected").isNull() | ~F.col("summary"), "open").when((received == F.col("expected")) & F.coalesce("met", F.lit(True)), "complete").otherwise("incomplete")
    return rows.select("receiver", "run", state.alias("state"), "expected", received.alias("received"), F.coalesce("tables", F.create_map().cast("map<string,bigint>")).alias("tables"))
