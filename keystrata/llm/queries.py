"""The corpus queries: each applies its operator with production parameters to its whole table.

Three can be written in SQL as a whole (``oracles``).  Of four others SQL can express some columns: those have a query
here that takes them from the operator's result.  Samplers, mined rules, tokenizers, packing and MinHash clusters have no
SQL; tests/llm holds every query against brute force, an exact round trip or properties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .chat import op9_chat_windows
from .gif import op5_gif_media
from .jaccard_join import op4_ngram_jaccard_join
from .licenses import op8_license_scan
from .mixing import op1_cube_mixing
from .packing import op6_best_fit_packing
from .paragraphs import op7_paragraph_minhash
from .quality import op10_quality_rules
from .suffix_dedup import op3_suffix_array_dedup
from .url_rules import op2_url_association_rules

OPERATORS = (
    op1_cube_mixing,
    op2_url_association_rules,
    op3_suffix_array_dedup,
    op4_ngram_jaccard_join,
    op5_gif_media,
    op6_best_fit_packing,
    op7_paragraph_minhash,
    op8_license_scan,
    op9_chat_windows,
    op10_quality_rules,
)


def _url_list_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_url_association_rules(spark, sf_dir).selectExpr("page_id", "host", "path", "rule", "IF(rule IS NOT NULL, verdict, NULL) AS listed")


def _media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_gif_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def _license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def _chat_turns_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_chat_windows(spark, sf_dir).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


#: What SQL can express of operators that it cannot express as a whole.
PARTS = {"url_list_rules": _url_list_rules, "media_payloads": _media_payloads, "license_phrases": _license_phrases, "chat_turns_read_back": _chat_turns_read_back}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS} | PARTS


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
