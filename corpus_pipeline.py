"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caravel.llm.common import fold_of, read_bytes, tokenizer_path, unused, written
from caravel.llm.decontamination import decontaminate
from caravel.llm.near_dedup import keep_one
from caravel.llm.secret_scan import find_secrets, mask_text
from caravel.llm.subword import encode
from caravel.llm.toxicity import learn, score_toxicity


def _same_columns(df: DataFrame, docs: DataFrame, text=None, changed=None) -> DataFrame:
    """The columns of ``docs``; ``text`` and the length that follows it where ``changed``."""
    out = []
    for c in docs.columns:
        if text is not None and c == "text":
            out.append(text.alias(c))
        elif text is not None and c == "n_chars":
            out.append(F.when(changed, F.length(text).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; learned from the labels of the training folds."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(fold_of() != 0)
    name = unused("toxicity", docs)
    scored = score_toxicity(docs, learn(docs, labels), out=name)
    return _same_columns(scored.where(F.col(name) < 0.5), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one of the least id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    spans, text = unused("secrets", docs), unused("masked", docs)
    # a column of its own: beside a new "text", names in a lambda would mean that one
    masked = find_secrets(docs, out=spans).withColumn(text, mask_text("text", spans))
    return _same_columns(masked, docs, F.col(text), F.size(spans) > 0)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its piece ids."""
    return encode(docs, read_bytes(tokenizer_path("piece_bpe_32k.model")))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The label model, the weighted signatures and the lattice have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
