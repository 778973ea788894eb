"""Registered queries of the engine and their SQL. Each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import text as T
from paperloom.operators import diagnostics as D
from paperloom.operators.documents import CodeBlockChunker, DocumentStructureChunker, MarkdownChunker, SentenceChunker
from paperloom.operators.packing import groups
from paperloom.operators.prose import FixedChunker, fixed_chunks, sentence_chunks, windows
from paperloom.operators.tables import chunk, with_lines
from paperloom.operators.transcript import TranscriptChunker
from paperloom import more_queries
from paperloom.oracles import ORACLES as ORACLES
from paperloom.plans import prompts as P
from paperloom.plans.backends import ExtractiveBackend
from paperloom.plans.budget import Budgeter, ChainOptions, ContextBudget
from paperloom.plans.chains import Chain
from paperloom.plans.events import events
from paperloom.plans.structured import decoded_clean, extract_json
from paperloom.views import crash_text, json_text, log_text, markdown_text, structure_text, transcript_text

MAP_TASK, REDUCE_TASK, STUFF_TASK = "Summarise this part: ", "Merge the notes: ", "Summarise: "
TARGET, BUDGET = 120, ContextBudget.words(900)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _flat(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.select(key, "chunk_index", "text", "word_count", F.col("source_word_range.start").alias("start_word"), F.col("source_word_range.end").alias("end_word"))


def word_token_counts(s: SparkSession, d: str) -> DataFrame:
    n = T.word_count(T.normalised(F.col("text")))
    return documents(s, d).select("doc_id", n.alias("n_words"), T.estimated_tokens(n).alias("n_tokens"))


def turn_packing(s: SparkSession, d: str) -> DataFrame:
    """Turns packed by words; the order of a conversation's turns makes them one row of numbers, without their texts."""
    turns = s.read.parquet(f"{d}/conversations.parquet").select("conv_id", F.struct("turn", T.word_count(F.col("text")).alias("n")).alias("t"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    packed = rows.select("conv_id", F.explode(groups(F.col("turns"), F.col("turns.n"), TARGET)).alias("g"))
    return packed.select("conv_id", F.col("g.index").alias("chunk_index"), F.element_at("g.items", 1)["turn"].alias("first_turn"), F.size("g.items").cast("long").alias("n_turns"), F.aggregate("g.items", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_words"))


def budget_route(s: SparkSession, d: str) -> DataFrame:
    text = T.normalised(F.col("text"))
    chain = Chain(ExtractiveBackend(), budget=BUDGET)
    return documents(s, d).select("doc_id", T.word_count(text).alias("n_words"), chain.route(text, STUFF_TASK, None, ChainOptions()).alias("route"))


def route_summary(s: SparkSession, d: str) -> DataFrame:
    return budget_route(s, d).groupBy("route").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words"))


def transcript_mode(s: SparkSession, d: str) -> DataFrame:
    """Distinct speakers by a line scan, without Python."""
    lines = with_lines(transcript_text(s, d), "conv_id")
    speaker = F.nullif(F.regexp_extract("line", r"^(?:(?:\d{1,2}:\d{2}(?::\d{2})?)\s+)?([A-Za-z][A-Za-z\s]{0,30}):\s", 1), F.lit(""))
    counted = lines.groupBy("conv_id").agg(F.count_distinct(speaker).alias("n_speakers"), F.max(T.has_topics(F.col("line"))).alias("topical"))
    return counted.select("conv_id", "n_speakers", F.when(F.col("n_speakers") >= 2, "speaker").when(F.col("topical"), "topical").otherwise("temporal").alias("mode"))


def _transcript(s: SparkSession, d: str, mode: str, target: int = TARGET) -> DataFrame:
    rows = chunk(transcript_text(s, d), TranscriptChunker(target, 0, mode), "conv_id")
    return rows.select("conv_id", "chunk_index", "text", "word_count", F.col("source_word_range.start").alias("start_word"), F.array_join("speaker_labels", ",").alias("speakers"), "attribution_type", F.array_join("timestamps", ",").alias("times"))


def log_blocks(s: SparkSession, d: str) -> DataFrame:
    """Blocks by gaps and islands over lines: a running count of block starts."""
    lines = with_lines(log_text(s, d), "user_id")
    by_line = Window.partitionBy("user_id").orderBy("line_no")
    numbered = lines.withColumn("block", F.sum(D.starts_block(F.col("line")).cast("long")).over(by_line))
    return numbered.groupBy("user_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


def log_kinds(s: SparkSession, d: str) -> DataFrame:
    return log_blocks(s, d).select("user_id", "block", D.block_kind(T.trimmed(F.col("text"))).alias("k")).select("user_id", "block", "k.*")


def log_chunks(s: SparkSession, d: str) -> DataFrame:
    rows = chunk(log_text(s, d), D.LogChunker(15), "user_id")
    return rows.select("user_id", "chunk_index", "text", "word_count", F.col("source_word_range.start").alias("start_word"), F.col("log_metadata.kind").alias("kind"), F.col("log_metadata.severity").alias("severity"), F.array_join("timestamps", ",").alias("times"))


def diagnostic_labels(s: SparkSession, d: str) -> DataFrame:
    rows = chunk(log_text(s, d), D.LogChunker(15), "user_id")
    whole = F.struct(*[c for c in rows.columns if c != "user_id"])
    return rows.select("user_id", "chunk_index", D.source_label(whole).alias("label"))


def markdown_sections(s: SparkSession, d: str) -> DataFrame:
    return _flat(chunk(markdown_text(s, d), MarkdownChunker(100_000), "page_id"), "page_id")


def _prompts(style: str, size: int = 128, overlap: int = 32) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        # the number of windows follows from the number of words
        docs = documents(s, d).withColumn("total", F.ceil(T.word_count(T.normalised(F.col("text"))) / (size - overlap)))
        rows = fixed_chunks(docs, size, overlap, "doc_id", "total")
        whole = F.struct(*[c for c in rows.columns if c not in ("doc_id", "total")])
        return rows.select("doc_id", "chunk_index", P.map_prompt(MAP_TASK, whole, F.col("total"), style).alias("prompt"))

    return run


def _chain(strategy: str, budget: ContextBudget | None = BUDGET, target: int = TARGET, words: int = 20) -> Chain:
    return Chain(ExtractiveBackend(words), strategy, SentenceChunker(target), budget)


def _summary(strategy: str, budget: ContextBudget | None = BUDGET) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        results = _chain(strategy, budget).run(documents(s, d), MAP_TASK, REDUCE_TASK, STUFF_TASK)
        return results.select("doc_id", "route", "text", "error", F.col("metrics.chunk_count").alias("n_chunks"), F.col("metrics.reduce_call_count").alias("n_reduce"))

    return run


def hierarchical_labels(s: SparkSession, d: str) -> DataFrame:
    """Reduce groups of four at most under a small budget, down to one call."""
    options = ChainOptions(reserved_output_tokens=0, max_reduce_group_size=4, max_reduce_depth=8)
    results = _chain("mapReduce", ContextBudget.words(160), 60, 12).run(documents(s, d), MAP_TASK, REDUCE_TASK, options=options)
    return results.select("doc_id", "text", "error", F.size("source_chunks").cast("long").alias("n_chunks"), F.array_join(F.transform("levels", lambda x: x.cast("string")), ",").alias("levels"))


def chain_metrics(s: SparkSession, d: str) -> DataFrame:
    return _chain("adaptive").run(documents(s, d), MAP_TASK, REDUCE_TASK, STUFF_TASK).groupBy("route").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("metrics.chunk_count").alias("n_chunks"), F.sum("metrics.map_call_count").alias("n_map"), F.sum("metrics.reduce_call_count").alias("n_reduce"))


def run_events(s: SparkSession, d: str) -> DataFrame:
    chain = _chain("adaptive")
    return events(chain.run(documents(s, d), MAP_TASK, REDUCE_TASK, STUFF_TASK), chain.backend).groupBy("doc_id", "type", "phase").agg(F.count(F.lit(1)).alias("n"))


def json_extract(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("kind", StringType(), False), StructField("user", LongType(), False), StructField("note", StringType())])
    cleaned = json_text(s, d).select("event_id", extract_json("text").alias("cleaned"))
    value, error = decoded_clean(F.col("cleaned"), schema)
    return cleaned.select("event_id", value.alias("v"), error.alias("error")).select("event_id", F.col("v.kind").alias("kind"), F.col("v.user").alias("user"), "error")


def coverage_check(s: SparkSession, d: str) -> DataFrame:
    """Words of each document and words of its chunks: they must be the same number, and the missing none."""
    text = T.normalised(F.col("text"))
    docs = documents(s, d).select("doc_id", T.word_count(text).alias("n_words"), windows(text, 128).alias("w"))
    return docs.select("doc_id", "n_words", F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.size(x["w"])).alias("n_chunked"), F.coalesce(F.element_at("w", -1)["s"] + F.size(F.element_at("w", -1)["w"]), F.lit(0).cast("long")).alias("last_word"))


def _structure(chunker: object) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = chunk(structure_text(s, d), chunker, "page_id")
        place = F.col("document_location")
        return rows.select("page_id", "chunk_index", "text", "word_count", F.array_join(place["heading_path"], " > ").alias("headings"), place["primary_block_type"].alias("block"), F.array_join(place["block_types"], ",").alias("blocks"), place["page_range"]["start"].alias("first_page"), place["page_range"]["end"].alias("last_page"))

    return run


def crash_chunks(s: SparkSession, d: str) -> DataFrame:
    rows = chunk(crash_text(s, d), D.CrashReportChunker(2000), "supp_id")
    log = F.col("log_metadata")
    return rows.select("supp_id", "chunk_index", log["kind"].alias("kind"), "word_count", log["process"].alias("process"), log["crash_report"]["signal"].alias("signal"), log["crash_report"]["crashed_thread"].alias("crashed_thread"), log["crash_report"]["symbolication_status"].alias("symbolication"))


def prompt_budget(s: SparkSession, d: str) -> DataFrame:
    """Whether each document fits, by words and by estimated tokens, and how it counts."""
    text = T.normalised(F.col("text"))
    by_words, by_tokens = Budgeter.of(ExtractiveBackend(), ContextBudget.words(900)), Budgeter.of(ExtractiveBackend(), ContextBudget.tokens(1500))
    return documents(s, d).select("doc_id", by_words.fits(None, STUFF_TASK, text, 512).alias("fits_words"), by_tokens.fits(None, STUFF_TASK, text, 512).alias("fits_tokens"), by_tokens.count(text).alias("n_tokens"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "word_token_counts": word_token_counts,
    "fixed_chunks": lambda s, d: _flat(fixed_chunks(documents(s, d), 128)),
    "fixed_chunks_overlap": lambda s, d: _flat(fixed_chunks(documents(s, d), 128, 32)),
    "sentence_chunks": lambda s, d: _flat(sentence_chunks(documents(s, d), TARGET)),
    "turn_packing": turn_packing,
    "budget_route": budget_route,
    "prompt_budget": prompt_budget,
    "route_summary": route_summary,
    "transcript_mode": transcript_mode,
    "transcript_speaker_chunks": lambda s, d: _transcript(s, d, "auto"),
    "transcript_temporal_chunks": lambda s, d: _transcript(s, d, "temporal"),
    "transcript_overlap_chunks": lambda s, d: _flat(chunk(transcript_text(s, d), TranscriptChunker(TARGET, 1), "conv_id"), "conv_id"),
    "log_blocks": log_blocks,
    "log_kind_severity": log_kinds,
    "log_chunks": log_chunks,
    "diagnostic_labels": diagnostic_labels,
    "markdown_sections": markdown_sections,
    "markdown_chunks": lambda s, d: _flat(chunk(markdown_text(s, d), MarkdownChunker(TARGET), "page_id"), "page_id"),
    "sentence_overlap_chunks": lambda s, d: _flat(chunk(documents(s, d), SentenceChunker(TARGET, 1))),
    "docstructure_chunks": _structure(DocumentStructureChunker(10)),
    "docstructure_overlap": _structure(DocumentStructureChunker(40, 1)),
    "codeblock_chunks": _structure(CodeBlockChunker(40)),
    "crash_sections": crash_chunks,
    "map_prompts_raw": _prompts("raw"),
    "map_prompts_delimited": _prompts("delimited"),
    "stuff_summary": _summary("stuff", None),
    "map_reduce_summary": _summary("mapReduce", None),
    "adaptive_summary": _summary("adaptive"),
    "hierarchical_labels": hierarchical_labels,
    "chain_metrics": chain_metrics,
    "run_events": run_events,
    "json_extract": json_extract,
    "coverage_check": coverage_check,
    "prompt_templates": lambda s, d: P.template_table(s),
}
QUERIES |= more_queries.QUERIES
