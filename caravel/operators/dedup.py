"""Duplicates, leader clusters and similar pairs of small groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caravel.operators.ordered import plain_keys
from caravel.session import cut_lineage


def first_of(df: DataFrame, content: Column, order: str) -> DataFrame:
    """Adds ``first`` (least ``order`` of equal content) and ``copies``, combined before the shuffle."""
    rows = df.withColumn("_hash", content)
    best = rows.groupBy("_hash").agg(F.min(order).alias("first"), F.count("*").alias("copies"))
    return rows.join(best, "_hash").drop("_hash")


def best_of_group(df: DataFrame, by: Sequence[str], score: str, order: Sequence[str], n: int = 1) -> DataFrame:
    """The ``n`` rows of each group with the greatest score; ties by ``order``."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b))


def similarity_search(df: DataFrame, key: str, vector: str, group: str, every: int = 100) -> DataFrame:
    """JN17. (a, b, similarity): the cosine of each query row (``key`` divisible by ``every``) with all other rows of its group.

    A stated query set against all rows, not all pairs. It is an equi-join on the group
    whose hot keys adaptive execution splits; norms are worked out once a row.
    """
    own = df.where(F.col(key).isNotNull() & F.col(group).isNotNull() & F.col(vector).isNotNull())
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    rows = own.select(F.col(group).alias("_g"), F.col(key).alias("b"), v.alias("_y"), norm.alias("_ny"))
    asked = own.where(F.col(key) % every == 0).select(F.col(group).alias("_g"), F.col(key).alias("a"), v.alias("_x"), norm.alias("_nx"))
    met = rows.join(asked, "_g").where(F.col("a") != F.col("b"))
    dot = F.aggregate(F.zip_with("_x", "_y", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return met.select("a", "b", F.try_divide(dot, F.col("_nx") * F.col("_ny")).alias("similarity"))


class Leaders:
    """The leaders of one key so far: ``first`` gives the place of the first one that a value is alike to, or None."""

    def __init__(self) -> None:
        self.keys: list = []

    @staticmethod
    def alone(value) -> bool:
        """Whether a value is alike to none, itself included."""
        raise NotImplementedError

    def first(self, value) -> int | None:
        raise NotImplementedError

    def firsts(self, values: list) -> list[int | None]:
        """``first`` of each of many values."""
        return [self.first(v) for v in values]

    def add(self, key, value) -> None:
        self.keys.append(key)


class CosineLeaders(Leaders):
    """SET12. Vectors at or above a cosine; one of norm 0 is alike to none."""

    def __init__(self, least: float) -> None:
        super().__init__()
        self.least, self.units = least, np.zeros((16, 0))

    @staticmethod
    def alone(value) -> bool:
        return value is None or not any(value)

    @staticmethod
    def _unit(value) -> np.ndarray:
        v = np.asarray(value if value is not None else [], float)
        norm = np.sqrt((v * v).sum())
        return v / norm if norm else np.zeros(len(v))

    def first(self, value) -> int | None:
        n, v = len(self.keys), self._unit(value)
        if not n or not v.any() or v.shape[0] != self.units.shape[1]:
            return None
        hit = self.units[:n] @ v >= self.least
        return int(np.argmax(hit)) if hit.any() else None

    def add(self, key, value) -> None:
        n, v = len(self.keys), self._unit(value)
        if not n:
            self.units = np.zeros((16, len(v)))
        elif n == len(self.units):
            self.units = np.vstack([self.units, np.zeros_like(self.units)])
        if len(v) == self.units.shape[1]:
            self.units[n] = v
        super().add(key, value)


class HammingLeaders(Leaders):
    """SET10. 64-bit hashes that differ in few bits."""

    @staticmethod
    def alone(value) -> bool:
        return value is None

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.hashes = most, np.zeros(16, np.int64)

    def first(self, value) -> int | None:
        n = len(self.keys)
        if not n or value is None:
            return None
        hit = np.bitwise_count((self.hashes[:n] ^ np.int64(value)).view(np.uint64)) <= self.most
        return int(np.argmax(hit)) if hit.any() else None

    def firsts(self, values: list) -> list[int | None]:
        n = len(self.keys)
        if not n:
            return [None] * len(values)
        out: list[int | None] = []
        own = np.fromiter((0 if v is None else v for v in values), np.int64, len(values))
        for i in range(0, len(own), 128):
            hit = np.bitwise_count((own[i : i + 128, None] ^ self.hashes[None, :n]).view(np.uint64)) <= self.most
            out += [int(at) if any_ else None for at, any_ in zip(hit.argmax(axis=1), hit.any(axis=1), strict=True)]
        return [None if v is None else at for v, at in zip(values, out, strict=True)]

    def add(self, key, value) -> None:
        if value is None:
            return
        if len(self.keys) == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[len(self.keys)] = value
        super().add(key, value)


class TagLeaders(Leaders):
    """SET11. Lists that share some tags; one without tags is alike to none."""

    @staticmethod
    def alone(value) -> bool:
        return not value

    def __init__(self, shared: int) -> None:
        super().__init__()
        self.shared, self.tags = shared, []

    def first(self, value) -> int | None:
        own = set(value or ())
        return next((i for i, t in enumerate(self.tags) if len(own & t) >= self.shared), None) if own else None

    def add(self, key, value) -> None:
        self.tags.append(set(value or ()))
        super().add(key, value)


def _folded(rows: DataFrame, by: Sequence[str], keys: Sequence[str], kind: type[Leaders], limit: float, out: str) -> DataFrame:
    """(by, _id, out) of small keys: each one's rows in order, many keys in a task."""
    fields = [*by, "_id"]
    schema = T.StructType([*rows.select(*fields).schema.fields, T.StructField(out, rows.schema["_id"].dataType)])
    same = lambda a, b: all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = state = None
        for batch in batches:
            found = []
            for i, v, *k in zip(*[batch.column(c).to_pylist() for c in ("_id", "_value", *keys)], strict=True):
                if state is None or (k != own and not same(k, own)):
                    own, state = k, kind(limit)
                at = None if kind.alone(v) else state.first(v)
                found.append(i if at is None else state.keys[at])
                if at is None and not kind.alone(v):
                    state.add(i, v)
            leaders = pa.array(found, batch.column("_id").type)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in fields], leaders], schema.names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, F.col("_id").asc_nulls_last()).mapInArrow(fold, schema)


def leader_clusters(df: DataFrame, by: Sequence[str], key: str, value: str, kind: type[Leaders], limit: float, out: str = "leader", block: int = 2048, chunk: int = 50_000) -> DataFrame:
    """SET10, SET11, SET12. Greedy leaders within ``by``: in order of ``key``, a row joins the first leader that it is alike to, else it leads.

    A key of at most ``block`` rows is a fold: rows are dealt by key and sorted, and a task streams through many keys, one state at a time. Larger keys
    go in rounds. Of each the first ``block`` rows that are still undecided find their leaders among themselves, in order; no earlier
    leader is alike to them. Then all undecided rows are compared with these leaders, in chunks of at most about
    ``chunk`` rows dealt over all tasks: the first one that a row is alike to is its leader for good, as later leaders come later in
    the order. A key of any size is spread over tasks, a group holds a block or a chunk, and the rounds follow
    the leaders of the key that has most, ``block`` at a time. Rows that can't be alike to any are decided at once. ``key`` is unique
    within ``by``, whose nulls are keys like others.
    """
    keys = plain_keys(df, by)
    rows = cut_lineage(df.select(*by, *[c.alias(n) for n, c in keys.items()], F.col(f"`{key}`").alias("_id"), F.col(f"`{value}`").alias("_value")))
    done = None
    if keys:
        large = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > block).select(*keys, F.ceil(F.col("_n") / chunk).cast("int").alias("_chunks")))
        names = list(keys)
        done = cut_lineage(_folded(rows.join(large, names, "left_anti"), by, names, kind, limit, out).withColumnRenamed("_id", key))
        if large.isEmpty():
            return done
        rows = rows.join(large, names)
    else:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.greatest(F.ceil(F.count("*") / chunk).cast("int"), F.lit(1)).alias("_chunks"))))
    rows = cut_lineage(rows.withColumn("_chunk", F.pmod(F.xxhash64("_id"), F.col("_chunks")).cast("int")))
    schema = T.StructType([*rows.schema.fields, T.StructField(out, rows.schema["_id"].dataType)])
    lead_schema = rows.drop("_chunk", *by).schema

    def led(group: pa.Table) -> pa.Table:
        group = group.sort_by("_id")
        state, kept = kind(limit), []
        for n, (i, v) in enumerate(zip(group.column("_id").to_pylist(), group.column("_value").to_pylist(), strict=True)):
            if not kind.alone(v) and state.first(v) is None:
                state.add(i, v)
                kept.append(n)
        return group.take(pa.array(kept, pa.int64())).select(lead_schema.names)

    def joined(group: pa.Table, leaders: pa.Table) -> pa.Table:
        leaders = leaders.sort_by("_id")
        state, own = kind(limit), set()
        for i, v in zip(leaders.column("_id").to_pylist(), leaders.column("_value").to_pylist(), strict=True):
            state.add(i, v)
            own.add(i)
        ids, values = group.column("_id").to_pylist(), group.column("_value").to_pylist()
        found = [i if i in own or kind.alone(v) else None for i, v in zip(ids, values, strict=True)]
        asked = [n for n, (i, v) in enumerate(zip(ids, values, strict=True)) if not (i in own or kind.alone(v))]
        for n, at in zip(asked, state.firsts([values[n] for n in asked]), strict=True):
            found[n] = None if at is None else state.keys[at]
        return group.append_column(schema[out].name, pa.array(found, group.column("_id").type))

    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_id"))
    while True:
        first = rows.withColumn("_nth", nth).where(F.col("_nth") <= block).drop("_nth")
        leaders = cut_lineage(first.groupBy(*keys).applyInArrow(led, lead_schema))
        spread = leaders.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        names = [*keys, "_chunk"]
        tried = cut_lineage(rows.groupBy(*names).cogroup(spread.groupBy(*names)).applyInArrow(joined, schema))
        # an id that is null leads itself, which null can't say
        settled = F.col(out).isNotNull() | F.col("_id").isNull()
        part = tried.where(settled).select(*by, F.col("_id").alias(key), out)
        done = part if done is None else done.unionByName(part)
        rows = tried.where(~settled).drop(out)
        if rows.isEmpty():
            return done


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def similar_names(a: DataFrame, b: DataFrame, a_name: str, b_name: str, distance: int = 2) -> DataFrame:
    """Pairs of names within an edit distance; both sides share a piece of the name or they can't be that near.

    A name is cut in ``distance + 1`` pieces. At least one piece of it stands unchanged in a name within the distance, shifted by
    at most the distance, so pairs meet in an equi-join on (piece, its length class) and not all with all.
    """
    k = distance + 1
    n = F.length("_a")
    size = F.floor(n / k)
    piece = lambda i: F.struct(F.lit(i).alias("i"), n.alias("n"), F.substr(F.col("_a"), (size * i + 1).cast("int"), (size if i < k - 1 else n - size * i).cast("int")).alias("p"))
    left = a.select(F.col(a_name).alias("_a")).distinct().select("_a", F.explode(F.array(*[piece(i) for i in range(k)])).alias("x")).select("_a", "x.*")
    m = F.length("_b")
    lengths = b.select(F.col(b_name).alias("_b")).distinct().select("_b", F.explode(F.sequence(F.greatest(m - distance, F.lit(0)), m + distance)).alias("n"))
    indexed = lengths.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("_s", F.floor(F.col("n") / k))
    begin = F.col("_s") * F.col("i")
    length = F.when(F.col("i") < k - 1, F.col("_s")).otherwise(F.col("n") - begin)
    shifted = indexed.select("_b", "n", "i", length.alias("_l"), F.explode(F.sequence(F.greatest(begin - distance, F.lit(0)), begin + distance)).alias("_at"))
    right = shifted.select("_b", "n", "i", F.substr(F.col("_b"), (F.col("_at") + 1).cast("int"), F.col("_l").cast("int")).alias("p")).distinct()
    met = left.join(right, ["i", "n", "p"]).select("_a", "_b").distinct()
    d = F.levenshtein("_a", "_b", distance)
    return met.select(F.col("_a").alias("a"), F.col("_b").alias("b"), d.alias("distance")).where(F.col("distance") >= 0)
