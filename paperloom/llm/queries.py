"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.chat_format import format_conversations
from paperloom.llm.common import table
from paperloom.llm.embedding_dedup import embedding_dedup
from paperloom.llm.language_id import language_id
from paperloom.llm.license_scan import license_scan
from paperloom.llm.packing import pack
from paperloom.llm.pieces import encode
from paperloom.llm.quality_rules import quality_rules
from paperloom.llm.simhash import simhash
from paperloom.llm.sql import ORACLES
from paperloom.llm.toxicity import toxicity
from paperloom.llm.url_filter import url_filter

Query = Callable[[SparkSession, str], DataFrame]


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id bigint, turn bigint, role string, text string")
    return format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))


def queries() -> dict[str, Query]:
    import corpus_pipeline

    documents = lambda s, d: table(s, d, "documents")
    return {
        "op1_license_scan": lambda s, d: license_scan(documents(s, d)),
        "op2_quality_rules": lambda s, d: quality_rules(documents(s, d)),
        "op3_packing": lambda s, d: pack(documents(s, d), public_tokenizers.path("word_bpe_49k.json")),
        "op4_simhash": lambda s, d: simhash(documents(s, d)),
        "op5_embedding_dedup": lambda s, d: embedding_dedup(table(s, d, "embeddings")),
        "op6_sentencepiece": lambda s, d: encode(documents(s, d), public_tokenizers.path("piece_bpe_32k.model")),
        "op7_language_id": lambda s, d: language_id(documents(s, d)),
        "op8_chat_format": chat,
        "op9_toxicity": lambda s, d: toxicity(documents(s, d), table(s, d, "labels")),
        "op10_url_filter": lambda s, d: url_filter(table(s, d, "pages")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
