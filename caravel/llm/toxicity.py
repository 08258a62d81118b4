"""Toxicity by weak supervision.

1. *Voters.* Words that go with the training labels far beyond chance (a likelihood
   ratio test against the number of words tried) are lexicon voters. Pattern voters look at how a text
   is written: shouting, masked words, stretched letters, piled-up marks, and lexicon words that are many, dense, shouted, repeated,
   next to each other or close behind an address. The annotators' label is one more voter.
2. *Label model.* A generative model with a hidden label: every voter speaks with a probability given the label
   and given what one other voter, its parent, says. Parents are the tree of greatest conditional mutual information, and
   EM estimates all probabilities (so accuracies and correlations), so voters that say the same count once.
3. *Classifier.* Logistic regression on the votes is trained on the model's posterior
   labels, and scores every text.

Word statistics are counted by Spark over the training sample; what reaches the driver is
the chosen lexicon (``max_lexicon``) and the votes of the sample (``max_labelled`` rows).
Scoring is a map over rows with the lexicon in a broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, tidy, without, written

_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_][*@#$%]{2,}")
_STRETCHED = re.compile(r"([^\W\d_])\1{3,}")
_PILED = re.compile(r"[!?]{3,}")
#: Words of address in English, German, French and Spanish.
ADDRESS = ("you", "your", "du", "dein", "dich", "dir", "tu", "toi", "ton", "ta", "vous", "votre", "tú", "tus", "usted", "ustedes")


@dataclass(frozen=True)
class Settings:
    """max_labelled: labelled rows in the training sample (about), drawn by a hash of the id.
    max_lexicon: learned words at most, the best by test value. rounds: of EM. trust: of the
    annotators' label at the start. penalty: of the classifier's squared weights."""

    max_labelled: int = 12_000
    max_lexicon: int = 2_000
    rounds: int = 30
    trust: float = 0.95
    penalty: float = 1.0


def words_of(text: str | None) -> Counter:
    """Lower-case words and their counts; none for null."""
    return Counter(_WORD.findall(text.lower())) if text else Counter()


PATTERNS = (
    "any hit", "two words", "three words", "five words", "rate 0.2 %", "rate 0.5 %", "rate 1 %", "rate 2 %", "repeated hit",
    "hits side by side", "hit behind an address", "shouted hit", "shouting", "masked word", "stretched letters", "piled-up marks",
)


def votes_of(text: str | None, lexicon: dict[str, int]) -> tuple[list[int], list[int]]:
    """(lexicon voters, pattern voters) that speak up."""
    if not text:
        return [], []
    words = _WORD.findall(text)
    low = _WORD.findall(text.lower())
    counts = Counter(low)
    hit = [w for w in (counts.keys() & lexicon.keys())]
    shouted = [w for w in words if len(w) > 2 and w.isupper()]
    style = (len(shouted) >= 3 and 3 * len(shouted) >= len(words), bool(_MASKED.search(text)), bool(_STRETCHED.search(text)), bool(_PILED.search(text)))
    hits = [False] * 12
    if hit:
        n = sum(counts[w] for w in hit)
        rate = n / len(low)
        at = [i for i, w in enumerate(low) if w in lexicon]
        aside = any(b == a + 1 for a, b in zip(at, at[1:], strict=False))
        addressed = any(w in ADDRESS for i in at for w in low[max(0, i - 3) : i])
        hits = [True, len(hit) >= 2, len(hit) >= 3, len(hit) >= 5, rate >= 0.002, rate >= 0.005, rate >= 0.01, rate >= 0.02, n > len(hit), aside, addressed, any(w.lower() in lexicon for w in shouted)]
    return sorted(lexicon[w] for w in hit), [i for i, x in enumerate((*hits, *style)) if x]


#: Rows of a vote matrix that are floating-point numbers at a time.
CHUNK = 1024


def _chunks(matrix: np.ndarray):
    """(rows, the rows as floating-point numbers) of a matrix of bytes."""
    for at in range(0, len(matrix), CHUNK):
        rows = slice(at, at + CHUNK)
        yield rows, matrix[rows].astype(np.float64)


def _sums(weight: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Weighted sums of the columns; ``weight`` is (kinds, rows)."""
    return sum((weight[:, rows] @ x for rows, x in _chunks(matrix)), np.zeros((len(weight), matrix.shape[1])))


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return np.concatenate([x @ vector for _, x in _chunks(matrix)]) if len(matrix) else np.zeros(0)


class LabelModel:
    """Voters that speak or stay silent, given a hidden label and a parent voter.

    ``votes`` is a 0/1 matrix (rows, voters); ``labels`` the annotators' word for each row. ``on[y, p]`` holds the
    probabilities of speaking under label ``y`` when the parent is silent (p = 0) or speaks; the tree's root has itself as
    parent and no such difference.
    """

    def __init__(self, votes: np.ndarray, labels: np.ndarray, settings: Settings) -> None:
        n, m = votes.shape
        votes = votes.astype(np.uint8)
        post = np.where(labels == 1, settings.trust, 1 - settings.trust)
        self.parent = self._tree(votes, post)
        root = self.parent == np.arange(m)
        above = np.where(root, np.uint8(0), votes[:, self.parent])
        both = votes & above
        for _ in range(settings.rounds):
            weight = np.vstack([1 - post, post])
            base = weight.sum(axis=1)
            spoken, up, joint = _sums(weight, votes), _sums(weight, above), _sums(weight, both)
            # a share of the voter's overall rate keeps cells with few rows near it
            rate = (spoken + 0.5) / (base[:, None] + 1)
            self.on = np.stack([(spoken - joint + 2 * rate) / (base[:, None] - up + 2), (joint + 2 * rate) / (up + 2)], axis=1)
            # the annotators are a voter with two error rates of their own
            told = np.array([((labels == 1) @ (1 - post) + 1) / (base[0] + 20), ((labels == 1) @ post + 19) / (base[1] + 20)])
            prior = np.clip(post.mean(), 0.001, 0.999)
            log = np.log(np.clip(self.on, 1e-9, 1 - 1e-9))
            off = np.log1p(-np.clip(self.on, 1e-9, 1 - 1e-9))
            say, hold = log[1] - log[0], off[1] - off[0]
            # a voter adds hold0, say0, hold1 or say1, which is linear in its vote, its parent's and both
            odds = math.log(prior / (1 - prior)) + hold[0].sum() + _times(votes, say[0] - hold[0]) + _times(above, hold[1] - hold[0]) + _times(both, say[1] - hold[1] - say[0] + hold[0])
            odds = odds + np.where(labels == 1, math.log(told[1] / told[0]), math.log((1 - told[1]) / (1 - told[0])))
            new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            done = np.abs(new - post).max() < 1e-4
            post = new
            if done:
                break
        self.posterior = post

    @staticmethod
    def _tree(votes: np.ndarray, post: np.ndarray) -> np.ndarray:
        """Parent of each voter: the spanning tree of greatest mutual information given the label (Chow and Liu), grown from the first voter."""
        m = votes.shape[1]
        information = np.zeros((m, m), np.float32)
        for weight in (1 - post, post):
            w = max(weight.sum(), 1e-9)
            pairs = np.zeros((m, m), np.float32)
            for rows, x in _chunks(votes):
                x = x.astype(np.float32)
                pairs += (x * weight[rows, None].astype(np.float32)).T @ x
            one = np.diag(pairs).astype(np.float64) / w
            for at in range(0, m, 256):  # a strip at a time, so that no second matrix of all pairs is held
                both, a, b = pairs[at : at + 256].astype(np.float64) / w, one[at : at + 256, None], one[None, :]
                for p, q, joint in ((a, b, both), (a, 1 - b, a - both), (1 - a, b, b - both), (1 - a, 1 - b, 1 - a - b + both)):
                    joint = np.clip(joint, 0, 1)
                    information[at : at + 256] += w * np.where(joint > 1e-12, joint * np.log(np.maximum(joint, 1e-12) / np.maximum(p * q, 1e-12)), 0.0)
        parent, best = np.zeros(m, np.int64), information[0].copy() if m else np.zeros(0)
        inside = np.zeros(m, bool)
        inside[:1] = True
        for _ in range(m - 1):
            k = int(np.argmax(np.where(inside, -np.inf, best)))
            inside[k] = True
            better = ~inside & (information[k] > best)
            parent[better], best[better] = k, information[k][better]
        return parent


#: Pairs of votes of a row that are added to the curvature at a time, about.
PAIRS = 2_000_000


def fit_linear(x: np.ndarray, target: np.ndarray, penalty: float, steps: int = 25) -> np.ndarray:
    """Logistic regression of soft targets on 0/1 columns by Newton's method; the last weight is the constant.

    Few votes are cast in a row, so sums run over the votes cast and the curvature over pairs of them.
    """
    n, m = len(x), x.shape[1] + 1
    rows, cols = np.nonzero(x)
    rows, cols = np.concatenate([rows, np.arange(n)]), np.concatenate([cols, np.full(n, m - 1)])
    order = np.argsort(rows, kind="stable")
    rows, cols = rows[order], cols[order]
    cast = np.bincount(rows, minlength=n)
    first = np.cumsum(cast) - cast
    cuts = np.searchsorted(np.cumsum(cast.astype(np.int64) ** 2), np.arange(PAIRS, int((cast.astype(np.int64) ** 2).sum()) + PAIRS, PAIRS)) + 1
    parts = list(zip(np.append(0, cuts), np.minimum(cuts, n), strict=False))
    w = np.zeros(m)
    ridge = np.full(m, penalty)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols], n), -30, 30)))
        slope = np.bincount(cols, (p - target)[rows], m) + ridge * w
        bend = np.maximum(p * (1 - p), 1e-6)
        curve = np.diag(ridge).ravel()
        for low, high in parts:
            if low >= high:
                continue
            entries = np.arange(first[low], first[high - 1] + cast[high - 1])
            many = cast[rows[entries]]
            one = np.repeat(entries, many)
            ends = np.cumsum(many)
            other = np.arange(ends[-1]) + np.repeat(first[rows[entries]] - (ends - many), many)
            curve += np.bincount(cols[one] * m + cols[other], bend[rows[one]], m * m)
        step = np.linalg.solve(curve.reshape(m, m), slope)
        w = w - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    lexicon: dict[str, int]
    weights: list[float]
    patterns: list[float]
    constant: float
    accuracies: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        words, patterns = votes_of(text, self.lexicon)
        z = self.constant + sum(self.weights[i] for i in words) + sum(self.patterns[i] for i in patterns)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(sample: list[tuple[list[int], list[int], int]], lexicon: dict[str, int], settings: Settings) -> Model:
    """Label model and classifier from (lexicon votes, pattern votes, label) rows."""
    m, k = len(lexicon), len(PATTERNS)
    if not sample or len({y for *_, y in sample}) < 2:
        rate = (sum(y for *_, y in sample) + 0.1) / (len(sample) + 1)
        return Model(lexicon, [2.0] * m, [1.0] * k, math.log(rate / (1 - min(rate, 0.99))), {})
    votes = np.zeros((len(sample), m + k), np.uint8)
    for i, (words, patterns, _) in enumerate(sample):
        votes[i, words] = 1
        votes[i, [m + p for p in patterns]] = 1
    labels = np.array([y for *_, y in sample], dtype=float)
    label_model = LabelModel(votes, labels, settings)
    w = fit_linear(votes, label_model.posterior, settings.penalty)
    names = [*sorted(lexicon, key=lexicon.get), *PATTERNS]
    right = {x: float(label_model.on[1, 0, i] / (label_model.on[0, 0, i] + label_model.on[1, 0, i])) for i, x in enumerate(names)}
    return Model(lexicon, w[:m].tolist(), w[m : m + k].tolist(), float(w[-1]), right)


def lexicon_of(per_word: DataFrame, toxic: int, clean: int, settings: Settings) -> dict[str, int]:
    """Words of (w, n1 toxic texts, n0 clean texts) whose likelihood ratio beats the number of words tried, the best first."""
    tried, total = per_word.count(), max(toxic + clean, 1)
    n1, n0 = F.col("n1"), F.col("n0")
    n = n1 + n0
    cells = ((n1, n * toxic / total), (n0, n * clean / total), (toxic - n1, (total - n) * toxic / total), (clean - n0, (total - n) * clean / total))
    value = sum((F.when((a > 0) & (e > 0), a * F.ln(a / e)).otherwise(0.0) for a, e in cells), F.lit(0.0)) * 2
    found = per_word.where(n1 * clean > n0 * toxic).select("w", value.alias("value")).where(F.col("value") > 2 * math.log(max(2, tried)))
    return {r["w"]: i for i, r in enumerate(found.orderBy(F.desc("value"), "w").limit(settings.max_lexicon).collect())}


def learn(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """From documents (doc_id, text) and labels (doc_id, toxic); null labels and ids aren't used.

    Both must hold the rows to learn from only. Several labels of an id count as toxic if half of them say so; of several texts
    of an id the least is taken. The labels are sampled before they meet the texts, so the broadcast side has ``max_labelled``
    rows at any input. Without labels of both kinds the model scores every text low.
    """
    s = settings or Settings()
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    n = usable.count()
    scale = 1 << 30
    drawn = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < min(scale, scale * s.max_labelled // max(n, 1)))
    met = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    sample = written(met.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    per_word = written(sample.select("toxic", F.explode(found).alias("w")).groupBy("w").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")), "words")
    rows = sample.agg(F.sum("toxic").alias("a"), F.count("*").alias("b")).first()
    toxic, clean = int(rows["a"] or 0), int(rows["b"]) - int(rows["a"] or 0)
    lexicon = lexicon_of(per_word, toxic, clean, s)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kind = T.StructType([T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("patterns", T.ArrayType(T.IntegerType()))])

    @F.arrow_udf(kind)
    def votes(texts: pa.Array) -> pa.Array:
        out = [votes_of(t, shared.value) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.list_(pa.int32())), pa.array([x[1] for x in out], pa.list_(pa.int32()))], ["words", "patterns"])

    rows = sample.select("doc_id", "toxic", votes("text").alias("v")).collect()
    return fit([(r["v"]["words"], r["v"]["patterns"], r["toxic"]) for r in sorted(rows, key=lambda r: r["doc_id"])], lexicon, s)


def score_toxicity(df: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """Adds ``out`` (double, 0 to 1). Null and empty texts have no hit and get the base score.

    Every text is read whole. A column already called ``out`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    @tidy
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = shared.value.score
        for batch in texts:
            yield pa.array([of(t) for i in range(0, len(batch), 256) for t in batch.slice(i, 256).to_pylist()], pa.float64())

    return without(df, [out], (text_col,)).withColumn(out, score(F.col(f"`{text_col}`").cast("string")))


def trained(spark: SparkSession, sf_dir: str) -> Model:
    """Learned from the documents and labels of the folds other than 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return learn(docs, labels.where(fold_of() != 0))


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document with its score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_toxicity(docs, trained(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
