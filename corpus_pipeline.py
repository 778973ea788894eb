"""The corpus pipeline: language ID, quality rules, SimHash near-dedup and packing, one after the other."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.common import drop, forget, settled, table, written
from paperloom.llm.language_id import language_filter
from paperloom.llm.packing import pack
from paperloom.llm.quality_rules import quality_filter
from paperloom.llm.simhash import simhash_filter


#: Tables that the last stage stored on its way. Its rows are written when the next stage begins, and then these go.
_LEFT: set[str] = set()


def _staged(docs: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    forget(_LEFT, but=docs)
    before = written()
    out = make(docs)
    _LEFT.clear()
    _LEFT.update(written() - before)
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that resemble no learned language go."""
    return _staged(docs, language_filter)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or the stricter rules on a marked host, go."""
    return _staged(docs, quality_filter)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return _staged(docs, simhash_filter)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 4096 tokens."""
    return _staged(docs, lambda rows: pack(rows, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language ID", language), ("quality rules", quality), ("SimHash near-dedup", near_dedup), ("packing", packing)]
#: The fitted profiles, the components and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are stored, and what the stage itself stored on the way is deleted with its input.

    Nulls, repeated rows and ids, texts of any length, extra columns of any name and empty tables go through as the
    stages define it: a null text has no language and goes, of equal rows one stays, an empty table gives no pieces.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        after = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if k:
            drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
