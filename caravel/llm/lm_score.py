"""Language-model scores: marginal likelihood over a subword lattice.

A unigram model over the pieces of an existing vocabulary, weighed by the vocabulary's own scores: those of a
unigram vocabulary are log-probabilities; those of a vocabulary made by merging are an order, and the piece of rank r weighs
``1 / (r + 2.7)`` (the law of Zipf and Mandelbrot). Only the weight of the end of a text is learned for
them. With ``rounds`` the scores are a start that EM over all segmentations of the training tokens re-estimates. The probability of a text is the sum over *all* segmentations of it into
pieces. No piece reaches over white space, so the lattice of a
text falls into those of its words, and each different word is solved once: a forward
recursion in log space over its places, with byte pieces for characters that the vocabulary
lacks. A word that was seen in training is one more edge of its own lattice, from its start to its
end: the edge weighs ``(1 - u) c / N``, the ways through pieces together ``u``, where u is
the share of tokens seen once (Good-Turing's estimate of what is unseen).
Beside it, the plain word unigram model of the contract is scored.

Plan: words are counted (combined per task, shuffled by word), each different word is
solved once, frequent words (at most ``1 / share`` of them) go back to the texts in a
broadcast, rare ones by a join on the word and a sum per text. Texts are never shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, read_bytes, tokenizer_path, written
from .word_table import word_counts

SPACE = "▁"
SHARE = 1e-6
#: Rounds of EM; 0 keeps the vocabulary's own scores.
ROUNDS = 0
LN10 = math.log(10)
#: Rows whose sums are handed on together.
SLICE = 500


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end (an empty word)."""
    return [*text.encode("utf-8", "replace").lower().split(), b""] if text else [b""]


class Lattice:
    """Log-probabilities of pieces, and sums over all segmentations."""

    def __init__(self, log_p: dict[str, float], end: float) -> None:
        self.log_p, self.end = log_p, end
        self.longest = max(map(len, log_p), default=1)

    def piece_or_bytes(self, c: str) -> float | None:
        """The byte pieces of a character that is no piece itself."""
        if c in self.log_p:
            return None
        return sum(self.log_p[f"<0x{b:02X}>"] for b in c.encode("utf-8", "replace"))

    def _forward(self, s: str, edges: list | None = None) -> list[float]:
        """ln of the sums over all ways to each place; ``edges`` gets (from, to, ln p)."""
        get, longest = self.log_p.get, self.longest
        alpha = [0.0]
        for j in range(1, len(s) + 1):
            ways = []
            for i in range(j - 1, max(-1, j - 1 - longest), -1):
                p = get(s[i:j])
                if p is not None:
                    ways.append(alpha[i] + p)
                    if edges is not None:
                        edges.append((i, j, p))
            spelled = self.piece_or_bytes(s[j - 1])
            if spelled is not None:
                ways.append(alpha[j - 1] + spelled)
                if edges is not None:
                    edges.append((j - 1, j, spelled))
            top = max(ways)
            alpha.append(top if len(ways) == 1 else top + math.log(sum([math.exp(x - top) for x in ways])))
        return alpha

    def word(self, word: str) -> float:
        """ln of the marginal probability of a word, with the space before it; of the end for the empty word."""
        return self._forward(SPACE + word)[-1] if word else self.end

    def expected(self, word: str, n: int, counts: dict[str, float]) -> None:
        """Adds to ``counts`` how often each piece is expected in ``n`` times the word."""
        s, edges = SPACE + word, []
        alpha = self._forward(s, edges)
        # ways from each place to the end, relative to the whole
        beta = [0.0] * len(s) + [n]
        for i, j, p in reversed(edges):
            share = beta[j] * math.exp(alpha[i] + p - alpha[j])
            beta[i] += share
            if share > 1e-9:
                piece = s[i:j]
                if piece in self.log_p:
                    counts[piece] = counts.get(piece, 0.0) + share
                else:
                    for b in piece.encode("utf-8", "replace"):
                        name = f"<0x{b:02X}>"
                        counts[name] = counts.get(name, 0.0) + share


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SCRAMBLE = np.uint64(0xBF58476D1CE4E5B9)
#: Characters up to which words of a length are solved together; longer ones one by one.
TOGETHER = 48
BATCH = 20_000
#: Words that a task gathers before it solves them.
GATHERED = 100_000


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of about ``GATHERED`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= GATHERED:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


class Lattices:
    """The lattices of many words at once: one array operation per pair of places.

    Substrings are looked up by a 64-bit rolling hash in an open table of the pieces.
    """

    def __init__(self, one: Lattice) -> None:
        self.one = one
        self.names = list(one.log_p)
        self.log_p = np.array([*one.log_p.values(), -np.inf])
        self.hashes = np.zeros(1 << 18, np.uint64)
        self.entries = np.full(1 << 18, len(self.names), np.int32)
        self.probes = 1
        mask = len(self.hashes) - 1
        for n, name in enumerate(self.names):
            h = np.zeros(1, np.uint64)
            for c in name:
                h = h * _FACTOR + np.uint64(ord(c) + 1)
            at, steps = int(self._slot(h)[0]), 1
            while self.entries[at] < len(self.names):
                at, steps = (at + 1) & mask, steps + 1
            self.hashes[at], self.entries[at] = h[0], n
            self.probes = max(self.probes, steps)
        self.byte = [self.names.index(f"<0x{b:02X}>") if f"<0x{b:02X}>" in one.log_p else -1 for b in range(256)]

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * _SCRAMBLE) >> np.uint64(46)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes; the number of pieces where there is none."""
        at, none, mask = self._slot(h), len(self.names), len(self.hashes) - 1
        out = self.entries[at]
        rest = np.flatnonzero((out < none) & (self.hashes[at] != h))
        out[rest] = none
        for _ in range(1, self.probes):
            if not rest.size:
                break
            at[rest] = (at[rest] + 1) & mask
            here = at[rest]
            hit = self.hashes[here] == h[rest]
            out[rest[hit]] = self.entries[here[hit]]
            rest = rest[~hit & (self.entries[here] < none)]
        return out

    def _edges(self, points: np.ndarray):
        """(pieces and ln p by (from, to), characters that are spelled)."""
        n = points.shape[1]
        found, spelled = {}, {}
        for i in range(n):
            h = np.zeros(len(points), np.uint64)
            for j in range(i + 1, min(n, i + self.one.longest) + 1):
                h = h * _FACTOR + (points[:, j - 1].astype(np.uint64) + np.uint64(1))
                pieces = self._find(h)
                p = self.log_p[pieces]
                if j == i + 1 and (lost := np.isneginf(p)).any():
                    chars, back = np.unique(points[lost, i], return_inverse=True)
                    p[lost] = np.array([self.one.piece_or_bytes(chr(c)) for c in chars])[back]
                    spelled[i] = (np.flatnonzero(lost), points[lost, i])
                elif not (pieces < len(self.names)).any():
                    continue
                found[i, j] = (pieces, p)
        return found, spelled

    @staticmethod
    def _alpha(found: dict, n: int, rows: int) -> np.ndarray:
        alpha = np.full((n + 1, rows), -np.inf)
        alpha[0] = 0.0
        for i, j in sorted(found, key=lambda e: e[1]):
            np.logaddexp(alpha[j], alpha[i] + found[i, j][1], out=alpha[j])
        return alpha

    def _groups(self, words: list[str]):
        """(rows, code points with the space in front) of words of a length, and the rows of the others."""
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        for n, rows in by.items():
            if 0 < n < TOGETHER:
                for at in range(0, len(rows), BATCH):
                    part = rows[at : at + BATCH]
                    yield part, np.array([SPACE + words[k] + "." for k in part]).view(np.uint32).reshape(len(part), -1)[:, : n + 1]
            else:
                yield rows, None

    def marginals(self, words: list[str]) -> np.ndarray:
        """ln of the marginal probability of each word; of the end for an empty one."""
        out = np.zeros(len(words))
        for rows, points in self._groups(words):
            if points is None:
                out[rows] = [self.one.word(words[k]) for k in rows]
            else:
                out[rows] = self._alpha(self._edges(points)[0], points.shape[1], len(rows))[-1]
        return out

    def expected(self, words: list[str], counts: list[int]) -> dict[str, float]:
        """How often each piece is expected in the words, each so many times."""
        sums, more = np.zeros(len(self.names) + 1), {}
        weights = np.array(counts, dtype=float)
        for rows, points in self._groups(words):
            if points is None:
                for k in rows:
                    self.one.expected(words[k], counts[k], more)
                continue
            n = points.shape[1]
            found, spelled = self._edges(points)
            alpha = self._alpha(found, n, len(rows))
            beta = np.full((n + 1, len(rows)), -np.inf)
            beta[n] = 0.0
            for i, j in sorted(found, key=lambda e: -e[0]):
                np.logaddexp(beta[i], found[i, j][1] + beta[j], out=beta[i])
            for (i, j), (pieces, p) in found.items():
                share = np.exp(alpha[i] + p + beta[j] - alpha[n]) * weights[rows]
                sums += np.bincount(pieces, share, len(sums))
                if j == i + 1 and i in spelled:
                    for k, c in zip(*spelled[i], strict=True):
                        for b in chr(c).encode("utf-8", "replace"):
                            sums[self.byte[b]] += share[k]
        for k in np.flatnonzero(sums[:-1]):
            more[self.names[k]] = more.get(self.names[k], 0.0) + float(sums[k])
        return more


def vocabulary_scores(vocabulary: bytes) -> dict[str, float]:
    """ln of the pieces' probabilities, summing to 1, from the vocabulary's own scores.

    Control pieces and those that reach over a space take no part. Byte pieces without scores of their own come last in the order.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(vocabulary)
    p = sentencepiece.SentencePieceProcessor(model_proto=vocabulary)
    usable = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)) and SPACE not in p.id_to_piece(i)[1:]]
    if proto.trainer_spec.model_type == pb.TrainerSpec.UNIGRAM:
        own = {p.id_to_piece(i): p.get_score(i) for i in usable}
    else:
        order = sorted(usable, key=lambda i: (p.is_byte(i), -p.get_score(i), i))
        own = {p.id_to_piece(i): -math.log(r + 2.7) for r, i in enumerate(order, 1)}
    top = max(own.values())
    total = top + math.log(math.fsum(math.exp(x - top) for x in own.values()))
    return {x: v - total for x, v in own.items()}


def learn_pieces(words: DataFrame, vocabulary: bytes, rounds: int = ROUNDS) -> Lattice:
    """Piece probabilities for the training counts (word, n_train).

    The vocabulary's own scores, beside the end of a text with its share of the training tokens. With ``rounds``, EM over all
    segmentations follows; every piece then has half a count more, and what reaches the
    driver is one row per piece and round.
    """
    spark = words.sparkSession
    trained = words.where("n_train > 0")
    sums = trained.agg(F.sum("n_train").alias("n"), F.sum(F.when(F.col("word") == "", F.col("n_train"))).alias("ends")).first()
    n, ends = sums["n"] or 0, sums["ends"] or 0
    trained = trained.where("word <> ''").select("word", "n_train")
    end = (ends + 0.5) / (n + 1)
    own = vocabulary_scores(vocabulary)
    lattice = Lattice({x: v + math.log1p(-end) for x, v in own.items()}, math.log(end))
    inner = list(own)

    def gathered(held: dict) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.float64())], ["piece", "n"])

    def estimate(count) -> Lattice:
        sums = trained.mapInArrow(count, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        counts = {r["piece"]: r["n"] for r in sums}
        total = sum(counts.get(x, 0.0) + 0.5 for x in inner) + ends + 0.5
        return Lattice({x: math.log((counts.get(x, 0.0) + 0.5) / total) for x in inner}, math.log((ends + 0.5) / total))

    for _ in range(rounds):
        now = spark.sparkContext.broadcast(lattice)

        def expected(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            held: dict[str, float] = {}
            many = Lattices(now.value)
            for batch in _gathered(batches):
                for piece, n in many.expected(batch.column(0).to_pylist(), batch.column(1).to_pylist()).items():
                    held[piece] = held.get(piece, 0.0) + n
            yield gathered(held)

        lattice = estimate(expected)
    return lattice


def score_documents(docs: DataFrame, vocabulary: bytes, id_col: str = "doc_id", text_col: str = "text", train: str = "train", share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """Rows (``id_col``, n_tokens, n_known, train_tokens, base_score, score, lattice_score), one per row of ``docs``.

    ``lattice_score`` is the sum over all segmentations into the vocabulary's pieces alone; in ``score`` a word seen in training is one more edge of its lattice.

    ``train`` names a boolean column: the rows to learn from (null: not). Null texts count as
    empty: their only token is the end. Words of any length are summed whole. Without
    training rows every count is 0. Repeated rows score alike, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{train}`"), F.lit(False)).alias("train"))
    words = written(word_counts(rows, tokens_of), "words")
    sums = words.agg(F.sum("n_train").alias("c"), F.count_if(F.col("n_train") > 0).alias("v"), F.sum("n").alias("n"), F.count_if(F.col("n_train") == 1).alias("once")).first()
    total, distinct, tokens = int(sums["c"] or 0), int(sums["v"] or 0), int(sums["n"] or 0)
    unseen = max(1e-6, min(0.5, sums["once"] / total)) if total else 1.0
    lattice = spark.sparkContext.broadcast(learn_pieces(words, vocabulary, rounds))

    def marginals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = Lattices(lattice.value)
        for part in _gathered(batches):
            column = pa.array(many.marginals(part["word"].to_pylist()) / LN10, pa.float64())
            yield from part.append_column("pieces", column).to_batches()

    base = F.log10((F.col("n_train") + 0.5) / (F.lit(total) + 0.5 * (distinct + 1)))
    whole = F.log10((1 - unseen) * F.col("n_train") / F.lit(max(total, 1)) + unseen * F.pow(F.lit(10.0), F.col("pieces")))
    weighed = F.when(F.col("n_train") > 0, whole).otherwise(F.col("pieces") + math.log10(unseen))
    each = words.select("word", "n", "n_train").mapInArrow(marginals, "word string, n long, n_train long, pieces double")
    solved = written(each.select("word", "n", (F.col("n_train") > 0).alias("known"), base.alias("base"), weighed.alias("lattice"), F.col("pieces").alias("pure")), "solved")
    frequent = F.col("n") >= max(2, share * tokens)
    table = spark.sparkContext.broadcast({r["word"].encode(): (r["known"], r["base"], r["lattice"], r["pure"]) for r in solved.where(frequent).collect()})

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place, row = table.value, TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out, places, rare, k = [], [0], [], []
                for text in part.column(1).to_pylist():
                    n_known, base_sum, sum_, pure, tokens_ = 0, [], [], [], tokens_of(text)
                    for w, n in Counter(tokens_).items():
                        found = known.get(w)
                        if found is None:
                            rare.append(w)
                            k.append(n)
                        else:
                            n_known += n * found[0]
                            base_sum.append(n * found[1])
                            sum_.append(n * found[2])
                            pure.append(n * found[3])
                    out.append((place + row, len(tokens_), n_known, math.fsum(base_sum), math.fsum(sum_), math.fsum(pure)))
                    places.append(len(rare))
                    row += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
                pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()).cast(pa.string()), pa.array(k, pa.int64())], ["word", "k"])
                columns.append(pa.ListArray.from_arrays(pa.array(places, pa.int32()), pairs))
                yield pa.record_batch([part.column(0), *columns], ["id", "row", "n_tokens", "n_known", "base", "lattice", "pure", "rare"])

    kind = rows.select("id").schema.fields[0].dataType.simpleString()
    # written once: the row numbers stay the same whatever is computed again later
    partial = written(rows.select("id", "text").mapInArrow(sums_of, f"id {kind}, row long, n_tokens long, n_known long, base double, lattice double, pure double, rare array<struct<word: string, k: long>>"), "scores")
    pairs = partial.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.k").alias("k"))
    cold = solved.where(~frequent).select("word", "known", F.col("base").alias("b"), F.col("lattice").alias("l"), F.col("pure").alias("p"))
    rest = pairs.join(cold, "word").groupBy("row").agg(F.sum(F.col("k") * F.col("known").cast("long")).alias("k"), F.sum(F.col("k") * F.col("b")).alias("b"), F.sum(F.col("k") * F.col("l")).alias("l"), F.sum(F.col("k") * F.col("p")).alias("p"))
    both = partial.drop("rare").join(rest, "row", "left")
    return both.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("lattice") + F.coalesce("l", F.lit(0.0))).alias("score"),
        (F.col("pure") + F.coalesce("p", F.lit(0.0))).alias("lattice_score"),
    )


def lm_query(spark: SparkSession, sf_dir: str, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """Contract query: learned from the folds other than 1, scored for all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (fold_of() != 1).alias("train"))
    scored = score_documents(docs, read_bytes(tokenizer_path(vocabulary)))
    return scored.select("doc_id", F.coalesce(fold_of() == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score")
