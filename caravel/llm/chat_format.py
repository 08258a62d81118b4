"""Preference formatting: one prompt, two masked completions.

A pair is a chosen and a rejected conversation. Their longest common turn prefix, by position, is
rendered once as the prompt; what follows in either is its completion, where only the turns of
the assistant are trained on. The result has one row per rendered turn, so a conversation of any
length is spread over tasks and never gathered.

Plan: turns are dealt once by (pair, block of turn numbers), and windows run within a block. What crosses blocks (the
turns before a block, the last user's words, the first difference) is one small row for each pair and block.
Conversations are compared by 128-bit digests of their turns, so texts take no part in that exchange.
Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Turn numbers of a block.
TURNS = 1024
TRAINED_ROLE = "assistant"


def rendered(role: Column, text: Column) -> Column:
    """A turn in the chat markup. The markup's own opening in a text is set apart, so a text can't end its turn."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))


def clean_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(pair_id, block, turn, role, text) of a turns table, one row per turn.

    Rows without an id or a turn number are in no conversation. A null role reads ``unknown``, a
    null text is empty. Of several rows for one turn the least (role, text) is taken, so
    repeated rows count once. Other columns are left out.
    """
    named = df.where(F.col(f"`{id_col}`").isNotNull() & F.col("turn").isNotNull())
    turn = F.struct(F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = named.select(F.col(f"`{id_col}`").alias("pair_id"), F.floor(F.col("turn") / TURNS).alias("block"), "turn", turn.alias("t")).repartition("pair_id", "block")
    return dealt.groupBy("pair_id", "block", "turn").agg(F.min("t").alias("t")).select("pair_id", "block", "turn", "t.role", "t.text")


def _bases(turns: DataFrame) -> DataFrame:
    """(pair_id, block, base): the turns of a pair before each of its blocks."""
    earlier = Window.partitionBy("pair_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = turns.groupBy("pair_id", "block").agg(F.count("*").alias("n"))
    return counts.select("pair_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))


def _placed(turns: DataFrame, bases: DataFrame) -> DataFrame:
    """``turns`` with the columns of ``bases`` and their position in the conversation, from 0 on."""
    inside = F.row_number().over(Window.partitionBy("pair_id", "block").orderBy("turn"))
    return turns.withColumn("inside", inside).join(bases, ["pair_id", "block"]).withColumn("position", F.col("base") + F.col("inside") - 1)


def first_difference(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, first): the first position at which role or text differ or only one conversation has a turn; none for equal ones."""
    def digests(turns: DataFrame, side: str) -> DataFrame:
        slim = turns.select("pair_id", "block", "turn", F.struct(F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit(1), "text", "role").alias("y")).alias("d"))
        return _placed(slim, _bases(turns)).select("pair_id", "position", F.lit(side).alias("side"), "d")

    both = digests(chosen, "a").unionByName(digests(rejected, "b"))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("d")))
    compared = both.groupBy("pair_id", "position").agg(of("a").alias("a"), of("b").alias("b"))
    return compared.where(~F.col("a").eqNullSafe(F.col("b"))).groupBy("pair_id").agg(F.min("position").alias("first"))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows (pair_id, part, position, turn, role, rendered, trained) for pairs of conversations.

    Both inputs are results of ``clean_turns``. ``part`` is prompt, chosen or rejected; ``trained`` marks
    the completion turns of the assistant. Positions count a conversation's turns, so equal conversations that are
    numbered from 0 and from 1 share all. Equal conversations are all prompt; a pair that one input lacks has an empty prompt and an
    empty completion there. Empty tables give an empty result.
    """
    first = first_difference(chosen, rejected)

    def side(turns: DataFrame, name: str) -> DataFrame:
        placed = _placed(turns, _bases(turns).join(first, "pair_id", "left"))
        shared = F.col("first").isNull() | (F.col("position") < F.col("first"))
        rows = placed.withColumn("part", F.when(shared, "prompt").otherwise(name))
        return rows if name == "chosen" else rows.where("part = 'rejected'")

    rows = side(chosen, "chosen").unionByName(side(rejected, "rejected"))
    trained = (F.col("part") != "prompt") & (F.col("role") == TRAINED_ROLE)
    return rows.select("pair_id", "part", "position", "turn", "role", rendered(F.col("role"), F.col("text")).alias("rendered"), trained.alias("trained"))


def assembled(rows: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, rejected, chosen_mask, rejected_mask) of ``format_preferences`` rows.

    Masks are arrays of trained (start, end) in characters of their completion. For
    conversations that fit in a row, as a trainer's example has to.
    """
    grouped = rows.groupBy("pair_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("part") == p, F.struct("position", "rendered", "trained")))).alias(p) for p in ("prompt", "chosen", "rejected")])
    text = lambda c: F.array_join(F.transform(c, lambda t: t["rendered"]), "").alias(c)

    def mask(c: str) -> Column:
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))

        def step(acc: Column, t: Column) -> Column:
            end = acc["at"] + F.length(t["rendered"])
            span = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(t["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(c, empty, step, lambda acc: acc["spans"]).alias(f"{c}_mask")

    return grouped.select("pair_id", text("prompt"), text("chosen"), text("rejected"), mask("chosen"), mask("rejected"))


def stale_reply(turns: DataFrame) -> DataFrame:
    """A rejected variant of each conversation: its last assistant turn only repeats the user's last words before it.

    Without a user turn before it the reply is empty; conversations without an assistant turn stay as they are.
    """
    inside, blocks = Window.partitionBy("pair_id", "block").orderBy("turn"), Window.partitionBy("pair_id")
    is_user = F.col("role") == "user"
    heard = F.last(F.when(is_user, F.col("text")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    reply = F.max(F.when(F.col("role") == TRAINED_ROLE, F.struct("turn", "heard")))
    summary = turns.withColumn("heard", heard).groupBy("pair_id", "block").agg(reply.alias("reply"), F.max(F.when(is_user, F.struct("turn", "text"))).alias("user"))
    carried = F.last("user.text", ignorenulls=True).over(blocks.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    last = F.max(F.when(F.col("reply").isNotNull(), F.col("block"))).over(blocks)
    facts = summary.withColumn("carried", carried).withColumn("last", last).where("block = last")
    echo = facts.select("pair_id", "block", F.col("reply.turn").alias("last"), F.coalesce("reply.heard", "carried", F.lit("")).alias("echo"))
    text = F.when(F.col("turn") == F.col("last"), F.col("echo")).otherwise(F.col("text"))
    return turns.join(echo, ["pair_id", "block"], "left").select("pair_id", "block", "turn", "role", text.alias("text"))


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` as chosen, their echoing variants as rejected; without an assistant turn all is prompt."""
    turns = clean_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return format_preferences(turns, stale_reply(turns))


CHAT_SQL = """
WITH turns AS (
  SELECT conv_id AS pair_id, turn, min({'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')}) AS t
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
c AS (SELECT pair_id, turn, t.role AS role, t.text AS text, row_number() OVER (PARTITION BY pair_id ORDER BY turn) - 1 AS position FROM turns),
l AS (SELECT pair_id, max(turn) AS last FROM c WHERE role = 'assistant' GROUP BY pair_id),
e AS (SELECT pair_id, max({'turn': turn, 'text': text}) AS echo FROM c JOIN l USING (pair_id) WHERE role = 'user' AND turn < last GROUP BY pair_id),
p AS (
  SELECT pair_id, turn, position, role, text AS a, CASE WHEN turn = last THEN coalesce(e.echo.text, '') ELSE text END AS b
  FROM c LEFT JOIN l USING (pair_id) LEFT JOIN e USING (pair_id)),
f AS (SELECT pair_id, min(position) AS first FROM p WHERE a <> b GROUP BY pair_id),
r AS (
  SELECT pair_id, 'prompt' AS part, position, turn, role, a AS text FROM p LEFT JOIN f USING (pair_id) WHERE first IS NULL OR position < first
  UNION ALL SELECT pair_id, 'chosen', position, turn, role, a FROM p JOIN f USING (pair_id) WHERE position >= first
  UNION ALL SELECT pair_id, 'rejected', position, turn, role, b FROM p JOIN f USING (pair_id) WHERE position >= first)
SELECT pair_id, part, position::BIGINT AS position, turn, role, '<|' || role || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS rendered,
  part <> 'prompt' AND role = 'assistant' AS trained
FROM r
"""
