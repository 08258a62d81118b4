"""The queries of the training-data operators and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import CHAT_SQL, chat_query
from .decontamination import LEAKS_SQL, leaks_query
from .hamerly import CLUSTER_SQL, cluster_query
from .language_id import language_query
from .lm_score import lm_query
from .media import media_query
from .near_dedup import near_dup_query
from .norm_search import SEARCH_SQL, search_query
from .secret_scan import SECRETS_SQL, secrets_query
from .subword import subword_query
from .token_count import token_query
from .toxicity import toxicity_query
from .whitening import whiten_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": near_dup_query,
    "op2_secret_scan": secrets_query,
    "op3_language_id": language_query,
    "op4_toxicity": toxicity_query,
    "op5_decontamination": leaks_query,
    "op6_chat_format": chat_query,
    "op7_media": media_query,
    "op8_token_count": token_query,
    "op9_lm_score": lm_query,
    "op10_subword": subword_query,
    "op11_norm_search": search_query,
    "op12_hamerly": cluster_query,
    "op13_whitening": whiten_query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_secret_scan": SECRETS_SQL,
    "op5_decontamination": LEAKS_SQL,
    "op6_chat_format": CHAT_SQL,
    "op11_norm_search": SEARCH_SQL,
    "op12_hamerly": CLUSTER_SQL,
}
