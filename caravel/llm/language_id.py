"""Language identification by compression.

Per language, a bounded sample of pieces from all places of the training texts becomes a zstandard raw-content
dictionary. A text is folded to lower-case letters and single spaces, cut into
blocks (all of them), and every block is compressed against every dictionary; the
language with the smallest total is chosen, and the choice is marked as rejected
when the runner-up is too close.

Learning reads the corpus twice (label counts, then the sample); prediction is a map
over rows. The model is ``languages x dictionary_bytes``, fixed by parameters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, without

UNKNOWN = "und"
_GAPS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """sample_pieces: pieces of ``piece`` characters drawn per language at most (about), from all places of
    all texts, so that no text fills a dictionary alone; dictionary_bytes: of its dictionary. block: bytes
    compressed at once, for every text. level: of zstandard. margin: least lead over the runner-up, as a share
    of the smallest size, below which a choice is rejected. spread: bytes of lead that halve the
    odds of the runner-up."""

    sample_pieces: int = 600
    piece: int = 800
    dictionary_bytes: int = 96 * 1024
    block: int = 4096
    level: int = 9
    margin: float = 0.02
    spread: float = 2.0


def folded(text: str | None) -> bytes:
    """Lower-case letters with single spaces between words; empty if there is no letter."""
    return _GAPS.sub(" ", text.lower()).strip().encode("utf-8", "replace") if text else b""


@dataclass
class Model:
    """Raw dictionaries by language, the language with the most rows first; compressors are made where they are used."""

    dictionaries: dict[str, bytes]
    settings: Settings = field(default_factory=Settings)

    def __post_init__(self) -> None:
        self._own: list | None = None

    def __getstate__(self):
        return (self.dictionaries, self.settings)

    def __setstate__(self, state) -> None:
        self.dictionaries, self.settings = state
        self._own = None

    def _compressors(self) -> list:
        if self._own is None:
            params = zstandard.ZstdCompressionParameters.from_level(self.settings.level, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            self._own = []
            for lang, raw in self.dictionaries.items():
                held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(compression_params=params)
                self._own.append((lang, zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress))
        return self._own

    def sizes(self, data: bytes) -> list[tuple[int, int, str]]:
        """(bytes, place in the model, language)."""
        s = self.settings
        blocks = [data[i : i + s.block] for i in range(0, len(data), s.block)]
        return [(sum(len(pack(x)) for x in blocks), n, lang) for n, (lang, pack) in enumerate(self._compressors())]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, whether the lead is wide enough)."""
        data = folded(text)
        if not data or not self.dictionaries:
            return UNKNOWN, 0.0, False
        found = sorted(self.sizes(data))
        best, _, lang = found[0]
        score = 1 / sum(2.0 ** max(-1000.0, (best - x[0]) / self.settings.spread) for x in found)
        lead = (found[1][0] - best) / best if len(found) > 1 else 1.0
        return lang, score, lead >= self.settings.margin


def learn(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", settings: Settings | None = None) -> Model:
    """Dictionaries from the rows of ``train`` with a language and a text.

    The sample is drawn by a hash of id, text and place whose threshold follows the number of
    pieces of each language, so its size is bounded at any input; equal pieces count once. Languages without a letter
    in their sample are left out; an empty table gives a model without languages.
    """
    s = settings or Settings()
    usable = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"))
    many = F.ceil(F.length("text") / s.piece).cast("int")
    counts = {r["lang"]: (r["rows"], r["pieces"]) for r in usable.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(many).alias("pieces")).collect()}
    if not counts:
        return Model({}, s)
    scale = 1 << 30
    within = F.create_map(*[x for lang, (_, n) in counts.items() for x in (F.lit(lang), F.lit(min(scale, scale * s.sample_pieces // max(n, 1))))])
    places = usable.where(F.length("text") > 0).select("lang", "text", F.explode(F.sequence(F.lit(0), many - 1)).alias("at"), "key")
    # drawn before any text is cut
    drawn = F.pmod(F.xxhash64("key", "at"), F.lit(scale))
    rows = places.where(drawn < within[F.col("lang")]).select("lang", F.expr(f"substring(text, at * {s.piece} + 1, {s.piece})").alias("text"), drawn.alias("h")).collect()
    taken: dict[str, list[bytes]] = {lang: [] for lang in counts}
    room = dict.fromkeys(counts, s.dictionary_bytes)
    seen = set()
    for lang, text, _ in sorted(rows, key=lambda r: (r["lang"], r["h"], r["text"])):
        data = folded(text)
        if data and len(data) < room[lang] and (lang, data) not in seen:
            seen.add((lang, data))
            taken[lang].append(data)
            room[lang] -= len(data) + 1
    return Model({lang: b" ".join(taken[lang]) for lang in sorted(taken, key=lambda x: (-counts[x][0], x)) if taken[lang]}, s)


PREDICTION = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
_PREDICTION = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])


def identify(df: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """Adds ``out``: struct of lang, score (0 to 1) and accepted.

    Null texts and texts without a letter get ``und``, 0 and false; so does every text
    if the model has no language. Equal sizes go to the language with more training rows. Very long
    texts are compressed in blocks, all of them; repeated rows are predicted alike. A column already called ``out`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(PREDICTION)
    def predict(texts: pa.Array) -> pa.Array:
        choose = shared.value.predict
        langs, scores, sure = zip(*[choose(t) for t in texts.to_pylist()], strict=True) if len(texts) else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.bool_())], fields=list(_PREDICTION))

    return without(df, [out], (text_col,)).withColumn(out, predict(F.col(f"`{text_col}`").cast("string")))


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learned from the folds other than 0, predicted for all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs.where(fold_of() != 0))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.accepted").alias("accepted"))
