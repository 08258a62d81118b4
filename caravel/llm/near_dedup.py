"""Near-duplicate classes with DartMinHash signatures and banded joining.

Method. A text is a weighted set: its shingles of five words and how often each
occurs. Darts are thrown by hashing at the region (element, weight below its own, rank):
every unit cell of weight and rank holds Poisson(1) darts, the same ones in every text.
The dart of least rank per coordinate is a consistent weighted sample, so two texts agree
in a coordinate with the probability of their weighted Jaccard similarity. Only about
``k (ln k + 2)`` darts are thrown per text however many coordinates it has to fill.
The coordinates are hashed in bands, and texts that meet in a band are candidates.

Joining. A bucket of a band gives edges to one hub each (never all pairs), the edges are
verified on the whole texts, and the verified links are contracted to components. The members
of buckets that still hold several components are dealt anew by pairs of bands, which only
texts close to each other share, and get other hubs there for a few rounds. That only
leaves fewer pairs: at the end every pair of a bucket whose components still differ is verified,
unless counts of its shingles by bins show that it can't reach the threshold. So all texts that meet
in a band and are alike are linked. That end compares the bins of a bucket's members as arrays within a task and makes rows
of possible pairs only; what it computes is quadratic in the members of a bucket that stay apart.

Scale. Equal texts share one node from the start (64-bit key of the normalised text), so
groups of copies collapse in map-side combiners. Buckets are aggregated before they are
joined, and the joins are plain equi-joins whose hot keys adaptive execution can split. Nothing
about documents is collected to the driver; tables between rounds live in the shared
folder. Shuffled per text: 25 band hashes, the text once where it meets the list of candidates (at
size Spark's own runtime Bloom filter thins that side), and candidates' texts for verifying.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, tidy, written

_WORD = re.compile(r"[^\W_]+")
_STEP, _CELL, _RANK, _PLACE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0x51ED270B, 0xA5A5A5A5, 0x7F4A7C15))
#: Cumulative probabilities of Poisson(1): a cell whose uniform hash is above entry i has more than i darts.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])

#: Bins of a text's profile.
_BINS = 256


@dataclass(frozen=True)
class Settings:
    """bands x rows coordinates. With 25 x 5, a pair of similarity 0.8 shares no band with
    probability 5e-5, one of 0.9 with 1e-10. rounds: of other hubs for buckets that still hold several components, before all
    their pairs that are left are compared; any number gives the same classes."""

    shingle: int = 5
    threshold: float = 0.8
    bands: int = 25
    rows: int = 5
    rounds: int = 2


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (shift, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def darts(elements: np.ndarray, weights: np.ndarray, max_rank: float) -> tuple[np.ndarray, np.ndarray]:
    """(dart, rank) of all darts below ``max_rank`` in the elements' regions; whole weights."""
    unit = np.arange(int(weights.sum())) - np.repeat(np.cumsum(weights) - weights, weights)
    columns = _mixed(np.repeat(elements, weights) + (unit.astype(np.uint64) + np.uint64(1)) * _STEP)
    floors = np.arange(math.ceil(max_rank))
    cells = _mixed(columns[:, None] ^ (floors.astype(np.uint64) * _STEP + _CELL)[None, :]).ravel()
    floor = np.broadcast_to(floors.astype(np.float64), (len(columns), len(floors))).ravel()
    # darts in each cell, then one entry for each dart
    count = np.searchsorted(_POISSON, _uniform(cells))
    held = np.repeat(np.arange(len(cells)), count)
    turn = np.arange(len(held)) - np.repeat(np.cumsum(count) - count, count)
    dart = _mixed(cells[held] + (turn.astype(np.uint64) + np.uint64(1)) * _STEP)
    rank = floor[held] + _uniform(_mixed(dart ^ _RANK))
    near = rank < max_rank
    return dart[near], rank[near]


def dart_minhash(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """k coordinates of the weighted set: in each the dart of least rank."""
    reach = k * (math.log(k) + 2) / float(weights.sum())
    while True:
        dart, rank = darts(elements, weights, reach)
        order = np.argsort(-rank, kind="stable")
        dart = dart[order]
        place = (_mixed(dart ^ _PLACE) % np.uint64(k)).astype(np.int64)
        found, filled = np.zeros(k, np.uint64), np.zeros(k, bool)
        found[place] = dart  # later entries, of lower rank, stay
        filled[place] = True
        if filled.all():
            return found
        reach *= 1.5


def shingles_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` word hashes; of all words if there are fewer."""
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out = _mixed(out * np.uint64(31) + words[i : len(words) - size + 1 + i] + _STEP)
    return out


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of the lower-case words of each text."""
    words = [_WORD.findall(t.lower()) if t else [] for t in texts]
    flat = [w for ws in words for w in ws]
    hashes = pd.util.hash_array(np.array(flat, dtype=object), categorize=False) if flat else np.zeros(0, np.uint64)
    return np.split(hashes, np.cumsum([len(ws) for ws in words])[:-1]) if words else []


def band_hashes(words: np.ndarray, s: Settings) -> np.ndarray:
    """One hash per band; none for texts shorter than a shingle, which only equal their copies."""
    if len(words) < s.shingle:
        return np.zeros(0, np.int64)
    elements, weights = np.unique(shingles_of(words, s.shingle), return_counts=True)
    grid = dart_minhash(elements, weights, s.bands * s.rows).reshape(s.bands, s.rows)
    out = _mixed(np.arange(1, s.bands + 1, dtype=np.uint64) * _STEP)
    for c in range(s.rows):
        out = _mixed(out ^ grid[:, c])
    return out.astype(np.int64)


@lru_cache(maxsize=64)
def _bag(text: str, size: int) -> Counter:
    words = _WORD.findall(text.lower())
    size = min(size, len(words))
    return Counter(zip(*[words[i:] for i in range(size)], strict=False)) if size else Counter()


def similarity(a: str | None, b: str | None, size: int = 5) -> float:
    """Weighted Jaccard similarity of the shingles of two texts; 0 without words."""
    x, y = _bag(a or "", size), _bag(b or "", size)
    if not x or not y:
        return 0.0
    n, m = x.total(), y.total()
    if len(y) < len(x):
        x, y = y, x
    both = sum(min(c, y[g]) for g, c in x.items() if g in y)
    return both / (n + m - both)


def text_key(text: Column) -> Column:
    """64-bit key that texts with equal words share; of the raw text if it has no word. Null for null."""
    normal = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(normal != "", F.xxhash64(normal)).when(text.isNotNull(), F.xxhash64(F.lit("raw"), text))


def _signatures(rows: DataFrame, s: Settings) -> DataFrame:
    @F.arrow_udf(T.ArrayType(T.LongType()))
    @tidy
    def bands(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            out = []
            for i in range(0, len(batch), 256):
                out += [band_hashes(w, s) for w in word_hashes(batch.slice(i, 256).to_pylist())]
            yield pa.array(out, pa.list_(pa.int64()))

    return rows.select("id", "key", bands("text").alias("bands"))


def contract(nodes_of_links: DataFrame) -> DataFrame:
    """Components of links (a, b): rows (node, label), label the least node of the component's roots.

    Every round maps each node to the least of itself and its neighbours and keeps the
    links between different images; the number of nodes at least halves on average.
    """
    links = written(nodes_of_links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    labels: DataFrame | None = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        image = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "images")
        if labels is None:
            labels = image.select("node", F.col("to").alias("label"))
        else:
            moved = image.select(F.col("node").alias("label"), "to")
            labels = written(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        left = image.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = image.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved_links = links.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        links = written(moved_links, "links")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def extended(labels: DataFrame | None, new: DataFrame) -> DataFrame:
    """Labels after more links (a, b): only the components that the new links join are contracted."""
    if labels is None:
        return contract(new)
    of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("x"))
    of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
    roots = new.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    moved = contract(roots)
    image = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
    known = labels.join(image, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return written(known.union(moved.join(labels, "node", "left_anti").select("node", "label")), "labels")


def _hub_edges(buckets: DataFrame, order: Column) -> DataFrame:
    """Candidate pairs (a, b): members of a bucket with its hub, where their components differ.

    ``buckets``: h, key, label. The hub is the member of least ``order``.
    """
    hubs = buckets.groupBy("h").agg(F.min(F.struct(order.alias("o"), "key", "label")).alias("hub"), F.min("label").alias("low"), F.max("label").alias("high"))
    hubs = hubs.where("low <> high").select("h", F.col("hub.key").alias("hub"), F.col("hub.label").alias("hub_label"))
    return buckets.join(hubs, "h").where("label <> hub_label").select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()


def profile(words: np.ndarray, size: int) -> bytes:
    """How many shingles fall in each of ``_BINS`` bins, a byte each; then those over 255, as eight bytes."""
    counts = np.bincount((shingles_of(words, size) % np.uint64(_BINS)).astype(np.int64), minlength=_BINS)
    kept = np.minimum(counts, 255)
    return kept.astype(np.uint8).tobytes() + np.array([(counts - kept).sum()], np.int64).tobytes()


def most_similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """An upper bound of the similarity of texts by their profiles (rows of bytes): they share no more than the lesser count of each bin."""
    over = [np.ascontiguousarray(p[:, _BINS:]).view(np.int64)[:, 0] for p in (x, y)]
    sums = [p[:, :_BINS].sum(axis=1, dtype=np.int64) + o for p, o in zip((x, y), over, strict=True)]
    both = np.minimum(x[:, :_BINS], y[:, :_BINS]).sum(axis=1, dtype=np.int64) + np.minimum(*over)
    return both / np.maximum(sums[0] + sums[1] - both, 1)


#: Rows of small buckets that are compared in one group, about.
GROUP_ROWS = 4096


def _rest_pairs(buckets: DataFrame, threshold: float, part: int = 256) -> DataFrame:
    """Pairs (a, b) of a bucket whose components differ and whose profiles allow the threshold.

    ``buckets``: h, key, label, profile. Profiles are compared within a task as arrays and only possible pairs become
    rows. A bucket of more than ``part`` members is cut into parts, and each two parts meet in a group of
    their own, so a group is bounded and the pairs of a large bucket are spread over tasks. Small buckets share groups.
    """
    # by the number of rows, so that a group of small buckets has about GROUP_ROWS whatever the corpus is
    groups = max(16 * max(64, buckets.sparkSession.sparkContext.defaultParallelism), -(-buckets.count() // GROUP_ROWS))

    def possible(group: pa.Table) -> pa.Table:
        h, i, j, side, key, label = (group.column(c).to_numpy() for c in ("h", "i", "j", "part", "key", "label"))
        profiles = np.frombuffer(b"".join(group.column("profile").to_pylist()), np.uint8).reshape(-1, _BINS + 8)
        order = np.lexsort((key, j, i, h))
        cuts = np.flatnonzero(np.diff(h[order], prepend=0) | np.diff(i[order], prepend=-1) | np.diff(j[order], prepend=-1))
        found = []
        for at in np.split(order, cuts[cuts > 0]):
            first = at[side[at] == i[at[0]]]
            second = at[side[at] == j[at[0]]]
            for x in first:
                # within a part a pair counts once
                others = second[(label[second] != label[x]) & ((i[x] != j[x]) | (key[second] > key[x]))]
                if others.size:
                    near = others[most_similar(profiles[x : x + 1], profiles[others]) >= threshold - 1e-9]
                    found += [(min(key[x], k), max(key[x], k)) for k in key[near]]
        profiles = None
        give_back()
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    parts = buckets.groupBy("h").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    dealt = buckets.join(parts, "h").withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    # a member of part p meets the parts from p on as the first, and those up to p as the second
    other = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
    placed = other.select("h", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "key", "label", "profile", "parts")
    group = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("h"), F.lit(groups))).otherwise(F.xxhash64("h", "i", "j"))
    return placed.withColumn("g", group).groupBy("g").applyInArrow(possible, "a long, b long").distinct()


def _labelled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return buckets.withColumn("label", F.col("key"))
    known = labels.select(F.col("node").alias("key"), "label")
    return buckets.join(known, "key", "left").withColumn("label", F.coalesce("label", "key"))


def _mixed_buckets(buckets: DataFrame) -> DataFrame:
    """Buckets (h) whose members have different labels."""
    return buckets.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("h")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """Rows (id, key, root): one for each row of ``df``, ``root`` equal for rows of a class.

    Texts with the same words are copies; others are linked from the threshold on, and
    classes are the components of the links. Texts of fewer than ``shingle`` words, or of none,
    belong with their copies only; null texts have null key and root and belong with nothing.
    """
    s = settings or Settings()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("key", text_key(F.col("text")))
    sigs = written(_signatures(rows, s), "signatures")

    # buckets with at least two different texts
    met = sigs.where("key is not null").select("key", F.explode("bands").alias("h"))
    shared = met.groupBy("h").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("h")
    buckets = written(met.join(shared, "h", "left_semi").distinct(), "buckets")

    # one row for each text that met another: the least row of its key
    firsts = buckets.select("key").distinct().join(sigs.groupBy("key").agg(F.min("id").alias("id")), "key")
    # rows meet by id, so that keys are only worked out again for the rows that are wanted
    place = lambda id_, key: F.coalesce(F.concat(F.lit("i"), F.col(id_).cast("string")), F.concat(F.lit("k"), key.cast("string")))
    wanted = firsts.select(F.col("key").alias("k"), place("id", F.col("key")).alias("j"))
    placed = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    placed = placed.select(place("id", text_key(F.col("text"))).alias("j"), "text")
    # the list of candidates is the small side: hashing it spares sorting the texts
    own = placed.join(wanted.hint("shuffle_hash"), "j").where(text_key(F.col("text")) == F.col("k")).select(F.col("k").alias("key"), "text").dropDuplicates(["key"])
    texts = written(own, "texts")

    @F.arrow_udf(T.DoubleType())
    @tidy
    def alike(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in pairs:
            found = []
            for i in range(0, len(a), 256):
                found += [similarity(x, y, s.shingle) for x, y in zip(a.slice(i, 256).to_pylist(), b.slice(i, 256).to_pylist(), strict=True)]
            yield pa.array(found, pa.float64())
        _bag.cache_clear()

    def verified(edges: DataFrame) -> DataFrame:
        first, second = texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))
        return written(edges.join(first, "a").join(second, "b").select("a", "b", (alike("ta", "tb") >= s.threshold).alias("linked")), "checked")

    # first the texts that share most buckets with others are the hubs: what a group was copied from
    sizes = buckets.groupBy("h").agg(F.count("*").alias("n"))
    met_by = buckets.join(sizes, "h").groupBy("key").agg(F.sum("n").alias("met"))
    tested = verified(_hub_edges(_labelled(buckets.join(met_by, "key"), None), F.struct(-F.col("met"), F.col("key"))))
    new = tested.where("linked").select("a", "b")
    labels = None if new.isEmpty() else extended(None, new)

    # then pairs of bands, which only texts close to each other share
    mixed = _labelled(buckets, labels)
    active = mixed.join(_mixed_buckets(mixed), "h", "left_semi").select("key").distinct()
    band = lambda i: F.get("bands", i)
    pairs = F.array(*[F.xxhash64(F.lit(i), F.lit(j % s.bands), band(i), band(j % s.bands)) for i in range(s.bands) for j in (i + 1, i + 2)])
    doubles = sigs.join(active, "key", "left_semi").dropDuplicates(["key"]).where(F.size("bands") > 0).select("key", F.explode(pairs).alias("h"))
    doubles = written(_labelled(doubles, labels), "doubles")
    doubles = written(doubles.join(_mixed_buckets(doubles), "h", "left_semi").select("h", "key"), "doubles")
    for round_ in range(s.rounds):
        edges = _hub_edges(_labelled(doubles, labels), F.xxhash64(F.lit(round_), F.col("key")))
        checked = verified(edges.join(tested, ["a", "b"], "left_anti"))
        tested = tested.union(checked)
        new = checked.where("linked").select("a", "b")
        if new.isEmpty():
            break
        labels = extended(labels, new)

    # then the rest exactly: all pairs of a bucket that are still apart, were not compared and are not excluded by a bound
    @F.arrow_udf(T.BinaryType())
    @tidy
    def profiled(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            parts = (batch.slice(i, 64).to_pylist() for i in range(0, len(batch), 64))
            yield pa.array([profile(w, s.shingle) for part in parts for w in word_hashes(part)], pa.binary())

    mixed = _labelled(buckets, labels)
    mixed = mixed.join(_mixed_buckets(mixed), "h", "left_semi")
    profiles = written(texts.join(mixed.select("key").distinct(), "key", "left_semi").select("key", profiled("text").alias("profile")), "profiles")
    rest = _rest_pairs(written(mixed.join(profiles, "key"), "mixed"), s.threshold).join(tested, ["a", "b"], "left_anti")
    new = verified(written(rest, "rest")).where("linked").select("a", "b")
    if not new.isEmpty():
        labels = extended(labels, new)
    if labels is None:
        return sigs.select("id", "key", F.col("key").alias("root"))
    known = labels.select(F.col("node").alias("key"), "label")
    return sigs.select("id", "key").join(known, "key", "left").select("id", "key", F.coalesce("label", "key").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """Rows (``id_col``, class_id, class_rows): the least id of the row's class, and its rows.

    Null texts stand alone: class_id is their own id. A class whose ids are all null has a
    null class_id. Repeated rows are rows of one class. An empty table gives an empty result.
    """
    found = classes(df, id_col, text_col, settings)
    found = written(found, "classes")
    summed = found.where("root is not null").groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_rows"))
    out = found.join(summed, "root", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_rows", F.lit(1)).cast("long").alias("class_rows"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """One row of each class: that of the least id (null last), whole and unchanged.

    Rows with a null text all stay.
    """
    found = written(classes(df, id_col, text_col, settings), "classes")
    best = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("w"))
    wins = best.select(F.col("w.id").alias("_near_dedup_win_id"), F.col("w.key").alias("_near_dedup_win_key"))
    keyed = df.withColumn("_near_dedup_key", text_key(F.col(f"`{text_col}`").cast("string")))
    kept = keyed.join(wins, (F.col("_near_dedup_key") == F.col("_near_dedup_win_key")) & F.col(f"`{id_col}`").eqNullSafe(F.col("_near_dedup_win_id")))
    once = kept.withColumn("_near_dedup_id", F.col(f"`{id_col}`")).dropDuplicates(["_near_dedup_key", "_near_dedup_id"])
    names = [F.col(f"`{c}`") for c in df.columns]
    return once.select(*names).unionByName(df.where(F.col(f"`{text_col}`").isNull()).select(*names))


def near_dup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id of its class."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
