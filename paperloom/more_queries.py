"""Further registered queries of the engine: detectors, kinds of logs, topics, split reports, budgets, events, retries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from paperloom.functions import text as T
from paperloom.operators import diagnostics as D
from paperloom.operators.documents import SentenceChunker
from paperloom.operators.tables import chunk, with_lines
from paperloom.operators.transcript import TranscriptChunker
from paperloom.plans import prompts as P
from paperloom.plans import single
from paperloom.plans.backends import Backend, CannedBackend, ExtractiveBackend, PythonBackend, StreamingBackend, TokenAwareBackend
from paperloom.plans.budget import Budgeter, ChainOptions, ContextBudget, RetryPolicy, TokenizerCounter, fallback_word_target
from paperloom.plans.chains import Chain
from paperloom.plans.events import events
from paperloom.plans.structured import run_json
from paperloom.sources import readers
from paperloom.sources.stored import shared_folder
from paperloom.streaming.runs import memory_level
from paperloom.views import crash_text, json_report_text, kind_log_text, topic_text, transcript_text

MAP_TASK, REDUCE_TASK, STUFF_TASK = "Summarise this part: ", "Merge the notes: ", "Summarise: "
TARGET, BUDGET, KIND_TARGET = 120, ContextBudget.words(900), 14


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def kind_blocks(s: SparkSession, d: str) -> DataFrame:
    """Kind, process, subsystem, category and severity of each log block, in Column form."""
    lines = with_lines(kind_log_text(s, d), "supp_id")
    numbered = lines.withColumn("block", F.sum(D.starts_block(F.col("line")).cast("long")).over(Window.partitionBy("supp_id").orderBy("line_no")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return numbered.groupBy("supp_id", "block").agg(joined.alias("text")).select("supp_id", "block", D.block_kind(T.trimmed(F.col("text"))).alias("k")).select("supp_id", "block", "k.*")


def kind_chunks(s: SparkSession, d: str) -> DataFrame:
    """Blocks packed with a cut where the kind changes, and the facts of each chunk."""
    rows = chunk(kind_log_text(s, d), D.LogChunker(KIND_TARGET), "supp_id")
    log = F.col("log_metadata")
    return rows.select("supp_id", "chunk_index", "word_count", F.col("source_word_range.start").alias("start_word"), *[log[c].alias(c) for c in ("kind", "process", "subsystem", "category", "severity")], log["timestamp_range"]["start"].alias("first_time"), log["timestamp_range"]["end"].alias("last_time"))


def kind_labels(s: SparkSession, d: str) -> DataFrame:
    rows = chunk(kind_log_text(s, d), D.LogChunker(KIND_TARGET), "supp_id")
    whole = F.struct(*[c for c in rows.columns if c != "supp_id"])
    return rows.select("supp_id", "chunk_index", D.source_label(whole).alias("label"), D.labelled_text(whole).alias("labelled"))


def topics(s: SparkSession, d: str) -> DataFrame:
    """Sections by topics; texts without two sections go by times, empty ones give nothing."""
    rows = chunk(topic_text(s, d), TranscriptChunker(8, 0, "topical"), "supp_id")
    return rows.select("supp_id", "chunk_index", "text", "word_count", F.col("source_word_range.start").alias("start_word"), "topic_label", "attribution_type", F.array_join("timestamps", ",").alias("times"))


def time_ranges(s: SparkSession, d: str) -> DataFrame:
    rows = chunk(transcript_text(s, d), TranscriptChunker(TARGET, 0, "temporal"), "conv_id")
    return rows.select("conv_id", "chunk_index", F.col("timestamp_range.start").alias("first_time"), F.col("timestamp_range.end").alias("last_time"), T.first_and_last(F.col("timestamps"))["end"].alias("last_of_column"))


def detectors(s: SparkSession, d: str) -> DataFrame:
    """What the detectors say of crash reports, JSON reports and topical texts."""
    one = lambda kind, view: view.select("supp_id", F.lit(kind).alias("given"), "text")
    every = one("crash", crash_text(s, d)).unionByName(one("json", json_report_text(s, d))).unionByName(one("topics", topic_text(s, d)))
    return every.select("supp_id", "given", T.is_crash_report(F.col("text")).alias("is_crash"), T.is_ips(F.col("text")).alias("is_json"), T.has_topics(F.col("text")).alias("has_topics"))


def line_facts(s: SparkSession, d: str) -> DataFrame:
    """The scalars of single lines: build command, test name, topic headings without their marks."""
    logs = with_lines(kind_log_text(s, d), "supp_id").select("supp_id", F.lit("log").alias("given"), "line_no", "line")
    heads = with_lines(topic_text(s, d), "supp_id").where(T.has_topics(F.col("line"))).select("supp_id", F.lit("topic").alias("given"), "line_no", "line")
    line = F.col("line")
    return logs.unionByName(heads).select("supp_id", "given", "line_no", T.build_command(line).alias("command"), T.test_name(line).alias("test"), F.when(F.col("given") == "topic", T.clean_heading(line)).alias("heading"))


def split_reports(s: SparkSession, d: str) -> DataFrame:
    """Sections over the target cut before stack frames, without images, the crashed thread whole or not."""
    made = []
    for whole in (True, False):
        rows = chunk(crash_text(s, d), D.CrashReportChunker(10, preserve_crashed_thread=whole, include_binary_images=False), "supp_id")
        made.append(rows.select("supp_id", F.lit(whole).alias("whole_thread"), "chunk_index", F.col("log_metadata.kind").alias("kind"), "word_count", F.col("source_word_range.start").alias("start_word")))
    return made[0].unionByName(made[1])


def json_reports(s: SparkSession, d: str) -> DataFrame:
    rows = chunk(json_report_text(s, d), D.CrashReportChunker(1), "supp_id")
    return rows.select("supp_id", "chunk_index", "text", F.col("log_metadata.kind").alias("kind"), "word_count", F.col("log_metadata.crash_report").isNull().alias("bare"))


def budget_numbers(s: SparkSession, d: str) -> DataFrame:
    """What fits, what is left for a text, and the words of a chunk that surely fits, by words, tokens and a token-aware backend."""
    by_words, by_tokens = ContextBudget.words(300), ContextBudget.tokens(400)
    aware = TokenAwareBackend(context_window_tokens=350)
    left = {"words": Budgeter.of(CannedBackend(), by_words), "tokens": Budgeter.of(CannedBackend(), by_tokens), "aware": Budgeter.of(aware, by_words)}
    free = {k: b.available("be brief", MAP_TASK, 64) for k, b in left.items()}
    targets = {"words": fallback_word_target(free["words"], by_words, False), "tokens": fallback_word_target(free["tokens"], by_tokens, False), "aware": fallback_word_target(free["aware"], by_tokens, True)}
    text = T.normalised(F.col("text"))
    return documents(s, d).select("doc_id", by_words.fits_in_budget(text, 5, 20).alias("fits_words"), by_tokens.fits_in_budget(text, 5).alias("fits_tokens"), *[F.lit(v).alias(f"free_{k}") for k, v in free.items()], *[F.lit(v).alias(f"target_{k}") for k, v in targets.items()])


def rechunked(s: SparkSession, d: str) -> DataFrame:
    """The default chunker's sentences, cut again where a chunk does not fit beside the prompt."""
    results = Chain(ExtractiveBackend(20), "mapReduce", None, BUDGET).run(documents(s, d), MAP_TASK, REDUCE_TASK)
    made = results.select("doc_id", F.explode("source_chunks").alias("c"))
    return made.select("doc_id", F.col("c.chunk_index").alias("chunk_index"), F.col("c.word_count").alias("word_count"), F.col("c.source_word_range.start").alias("start_word"))


def template_summary(s: SparkSession, d: str) -> DataFrame:
    results = Chain(ExtractiveBackend(60), "mapReduce", SentenceChunker(TARGET), None).run(documents(s, d), template=P.TEMPLATES["transcriptSummary"])
    return results.select("doc_id", "text", F.size("source_chunks").cast("long").alias("n_chunks"))


def reduce_depth(s: SparkSession, d: str) -> DataFrame:
    """Two levels at most: documents that need more end with an error."""
    chain = Chain(ExtractiveBackend(12), "mapReduce", SentenceChunker(60), ContextBudget.words(160))
    results = chain.run(documents(s, d), MAP_TASK, REDUCE_TASK, options=ChainOptions(reserved_output_tokens=0, max_reduce_group_size=4, max_reduce_depth=2))
    return results.select("doc_id", "text", "error", F.array_join(F.transform("levels", lambda x: x.cast("string")), ",").alias("levels"))


def token_aware(s: SparkSession, d: str) -> DataFrame:
    """Route and token counts of a backend that counts tokens itself; counts of the documents that take one call."""
    chain = Chain(TokenAwareBackend(words=20, context_window_tokens=1500), "adaptive", SentenceChunker(TARGET), BUDGET)
    results = chain.run(documents(s, d), MAP_TASK, REDUCE_TASK, STUFF_TASK)
    one = F.col("route") == "stuff"
    m = F.col("metrics")
    return results.select("doc_id", "route", F.when(one, m["estimated_input_tokens"]).alias("tokens_in"), F.when(one, m["estimated_output_tokens"]).alias("tokens_out"), (m["estimated_input_tokens"] > m["estimated_output_tokens"]).alias("more_in"))


def exact_tokens(s: SparkSession, d: str) -> DataFrame:
    """A chain whose backend counts with a real tokenizer: routes, groups and token sums are exact."""
    import public_tokenizers

    counter = TokenizerCounter(public_tokenizers.path("word_bpe_49k.json"))
    chain = Chain(TokenAwareBackend(words=30, context_window_tokens=600, counter=counter), "adaptive", SentenceChunker(TARGET), BUDGET)
    results = chain.run(documents(s, d), MAP_TASK, REDUCE_TASK, STUFF_TASK, options=ChainOptions(reserved_output_tokens=64, max_reduce_group_size=4, max_reduce_depth=8))
    return results.select("doc_id", "route", "text", "error", F.size("source_chunks").cast("long").alias("n_chunks"), F.array_join(F.transform("levels", lambda x: x.cast("string")), ",").alias("levels"), F.col("metrics.estimated_input_tokens").alias("tokens_in"), F.col("metrics.estimated_output_tokens").alias("tokens_out"))


def stuff_prompts(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select("doc_id", P.stuff_prompt(STUFF_TASK, T.normalised(F.col("text")), "delimited").alias("prompt"))


def streamed(s: SparkSession, d: str) -> DataFrame:
    """The events of one call a document with a backend that streams word by word."""
    chain = Chain(StreamingBackend("three short words"), "stuff")
    return events(chain.run(documents(s, d), reduce_prompt=REDUCE_TASK, stuff_prompt=STUFF_TASK), chain.backend).select("doc_id", "seq", "type", "text", "phase")


def one_text(s: SparkSession, d: str) -> DataFrame:
    """The events of a run over a single text, the names of all nations: a backend without streaming, then a live call."""
    names = [r.n_name for r in s.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").select("n_name").collect()]
    chain = Chain(ExtractiveBackend(6), "stuff")
    rows = [("run", k, e["type"], e["text"], e["phase"]) for k, e in enumerate(single.stream(s, chain, " ".join(names), reduce_prompt=REDUCE_TASK, stuff_prompt=STUFF_TASK))]
    rows.append(("metadata", 0, "result", single.run(s, chain, " ".join(names), reduce_prompt=REDUCE_TASK, stuff_prompt=STUFF_TASK), None))
    live = single.stream_call(lambda prompt, system: iter(prompt.split(" ")[:4]), " ".join(names), STUFF_TASK)
    rows += [("live", k, e["type"], e["text"], e["phase"]) for k, e in enumerate(live)]
    return s.createDataFrame(rows, "source string, seq bigint, type string, text string, phase string")


def _flaky() -> Callable[[str, str | None], str]:
    """A model that is busy whenever a prompt comes for the first time."""
    seen: set[str] = set()

    def generate(prompt: str, system: str | None) -> str:
        if prompt not in seen:
            seen.add(prompt)
            raise RuntimeError("busy")
        return " ".join(T.WORD.findall(prompt)[:20])

    return generate


def retried_calls(s: SparkSession, d: str) -> DataFrame:
    """Four calls in flight, each tried again, results in order of the chunks."""
    options = ChainOptions(retry=RetryPolicy(3), max_concurrent_map_tasks=4)
    results = Chain(PythonBackend(_flaky()), "mapReduce", SentenceChunker(TARGET), None).run(documents(s, d), MAP_TASK, REDUCE_TASK, options=options)
    return results.select("doc_id", "route", "text", "error", F.col("metrics.chunk_count").alias("n_chunks"), F.col("metrics.reduce_call_count").alias("n_reduce"))


def completion_order(s: SparkSession, d: str) -> DataFrame:
    """Results in the order in which calls come back still carry the number of their chunk."""
    options = ChainOptions(max_concurrent_map_tasks=4, preserve_order=False)
    model = PythonBackend(lambda prompt, system: " ".join(T.WORD.findall(prompt)[:6]))
    results = Chain(model, "mapReduce", SentenceChunker(TARGET), None).run(documents(s, d), MAP_TASK, REDUCE_TASK, options=options)
    return results.select("doc_id", F.array_join(F.array_sort("summaries"), "\n").alias("summaries"))


class _Careless(Backend):
    """Answers with broken JSON until it is told so, and to one kind of text with nothing of use."""

    def response(self, prompt: Column, system: str | None = None) -> Column:
        told = F.contains(prompt, F.lit("not usable JSON"))
        return F.when(F.endswith(prompt, F.lit("purchase")), "nothing").when(told, F.concat(F.lit('```json\n{"kind": "'), F.regexp_extract(prompt, r"(\w+)$", 1), F.lit('"}\n```'))).otherwise('{"kind": ')


def json_retries(s: SparkSession, d: str) -> DataFrame:
    """Typed answers with a second try after the error was told; what fails again is an error of its row."""
    asked = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("doc_id"), F.col("event_type").alias("text"))
    schema = StructType([StructField("kind", StringType(), False)])
    rows = run_json(Chain(_Careless(), "stuff"), asked, schema, "", "Give JSON for: ", options=ChainOptions(retry=RetryPolicy(2)))
    return rows.select(F.col("doc_id").alias("event_id"), F.col("value.kind").alias("kind"), "error", "raw_text")


def written(s: SparkSession, d: str) -> DataFrame:
    """Documents written and read again as Parquet with other names, as JSON lines, and as a file each."""
    folder = f"{shared_folder(s)}/formats-{uuid.uuid4().hex}"
    docs = documents(s, d).select("doc_id", T.normalised(F.col("text")).alias("text"))
    readers.write(docs.toDF("number", "body"), f"{folder}/table")
    docs.write.json(f"{folder}/lines")
    names = s.read.parquet(f"{d}/region.parquet").select(F.concat_ws(" ", "r_name", "r_name").alias("value"))
    names.repartition(5, "value").write.text(f"{folder}/files")
    count = lambda df, kind: df.select(F.lit(kind).alias("format"), F.col("doc_id").cast("string").alias("doc_id"), T.word_count(F.coalesce("text", F.lit(""))).alias("n_words"))
    files = count(readers.read_texts(s, f"{folder}/files"), "files").agg(F.sum("n_words").alias("n_words")).select(F.lit("files").alias("format"), F.lit("all").alias("doc_id"), "n_words")
    return count(readers.read_table(s, f"{folder}/table", "number", "body"), "table").unionByName(count(readers.read_json(s, f"{folder}/lines"), "json")).unionByName(files)


def memory_gate(s: SparkSession, d: str) -> DataFrame:
    free = F.abs(F.col("s_acctbal")) / 10
    return s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("supp_id"), memory_level(free).alias("level"), (memory_level(free) != "critical").alias("proceed"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "log_kinds": kind_blocks,
    "log_kind_chunks": kind_chunks,
    "kind_labels": kind_labels,
    "topic_chunks": topics,
    "time_ranges": time_ranges,
    "report_detectors": detectors,
    "line_facts": line_facts,
    "split_reports": split_reports,
    "json_reports": json_reports,
    "budget_numbers": budget_numbers,
    "rechunked_sentences": rechunked,
    "template_summary": template_summary,
    "reduce_depth": reduce_depth,
    "token_aware": token_aware,
    "exact_tokens": exact_tokens,
    "stuff_prompts": stuff_prompts,
    "streamed_events": streamed,
    "one_text": one_text,
    "retried_calls": retried_calls,
    "completion_order": completion_order,
    "json_retries": json_retries,
    "written_formats": written,
    "memory_gate": memory_gate,
}
