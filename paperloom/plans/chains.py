"""Chains: one call for a document, or map-reduce with a hierarchical reduce, or whichever its size asks for.

Every document stays one row from its text to its result: chunks, prompts, responses and summaries are arrays in
that row, and the reduce levels are steps of the same projection. A whole run is therefore one narrow stage
without a shuffle, driver action or checkpoint, at any number of documents; the depth is bounded by the options.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.schema import ARROW_CHUNK, CHUNK_STRUCT, chunk_row
from paperloom.operators.documents import SentenceChunker
from paperloom.operators.tables import BATCH_ROWS, Chunker
from paperloom.plans import prompts as P
from paperloom.plans.backends import Backend
from paperloom.plans.budget import Budgeter, ChainOptions, ContextBudget, fallback_word_target
from paperloom.plans.one_pass import DEPTH_EXCEEDED, FIELDS, NO_RESPONSE, WholeRun, exact_cut


class ReduceDepthExceeded(RuntimeError):
    pass


@dataclass(frozen=True)
class BudgetedChunker:
    """``chunker``, or sentences of ``target`` words if one of its chunks counts more than ``available``."""

    chunker: Chunker
    budgeter: Budgeter
    available: int
    target: int

    def chunks(self, text: str) -> Iterator[dict]:
        rows = list(self.chunker.chunks(text))
        if rows and max(self.budgeter.count_text(r["text"]) for r in rows) > self.available:
            rows = list(SentenceChunker(self.target).chunks(text))
        yield from rows


def with_chunks(docs: DataFrame, chunker: Chunker, text: Column, name: str = "chunks") -> DataFrame:
    """Adds the array of chunk structs of ``text``, empty for a text without content."""
    given = docs.withColumn("__text", text)
    keep = docs.columns
    kind = pa.list_(pa.struct(list(ARROW_CHUNK.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                found = [list(chunker.chunks(t)) if t else [] for t in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(found, kind)], names=[*keep, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"{name} {CHUNK_STRUCT}".replace(" struct<", " array<struct<", 1) + ">"])
    return given.mapInArrow(run, schema)


def _whole_chunk(text: Column) -> Column:
    """A text as its own single chunk."""
    n = T.word_count(text)
    fields = {"chunk_index": F.lit(0), "text": text, "word_count": n, "source_word_range": F.struct(F.lit(0).cast("long").alias("start"), n.alias("end")), "timestamps": F.array(), "speaker_labels": F.array()}
    names = list(chunk_row(0, "", 0, 0))
    return F.array(F.struct(*[fields.get(k, F.lit(None)).alias(k) for k in names]).cast(CHUNK_STRUCT))


def chunk_range(label: Column) -> Column:
    """What a summary's label says of its chunks, ``?`` without one."""
    found = F.regexp_extract(label, r"\[Chunks? ([\d\-]+)\]", 1)
    return F.when(found == "", F.lit("?")).otherwise(found)


#: Words of the line that stands before each summary.
HEADER_WORDS = 6


def reduce_groups(summaries: Column, most: int, fits: Callable[[Column], Column] | None) -> Column:
    """Summaries in order, in groups of ``most`` at most of which ``fits(words)`` accepts the words; a lone one always goes.

    The words of a group are those of its summaries and of the line before each, so a running sum is enough.
    """
    if fits is None:
        return F.transform(F.sequence(F.lit(1), F.size(summaries), F.lit(most)), lambda a: F.slice(summaries, a, most))
    whole = lambda x: F.lit(x).cast("long")
    first = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"), whole(0).alias("words"))
    sized = F.transform(summaries, lambda x: F.struct(x.alias("text"), (T.word_count(x) + HEADER_WORDS).alias("words")))

    def step(s: Column, x: Column) -> Column:
        words = s["words"] + x["words"]
        joins = (F.size(s["now"]) == 0) | ((F.size(s["now"]) < most) & fits(words))
        return F.struct(
            F.when(joins, s["done"]).otherwise(F.array_append(s["done"], s["now"])).alias("done"),
            F.when(joins, F.array_append(s["now"], x["text"])).otherwise(F.array(x["text"])).alias("now"),
            F.when(joins, words).otherwise(x["words"]).alias("words"),
        )

    return F.aggregate(sized, first, step, lambda s: F.array_append(s["done"], s["now"]))


def exact_groups(summaries: Column, most: int, fits: Callable[[str], bool]) -> Column:
    """``reduce_groups`` for counts that only a tokenizer knows, which need the whole text of each candidate group.

    A struct of whether all summaries fit one call, and of the groups, from one function over Arrow batches.
    """

    def cut(texts: list[str]) -> dict:
        return {"last": fits(P.format_texts(texts)), "groups": exact_cut(texts, most, fits)}

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch, _ in batches:
            yield pd.DataFrame([{"last": False, "groups": []} if ts is None or not len(ts) else cut(list(ts)) for ts in batch], columns=["last", "groups"])

    return F.pandas_udf(run, "last boolean, groups array<array<string>>").asNondeterministic()(summaries, F.size(summaries))


@dataclass(frozen=True)
class Chain:
    """``strategy``: stuff, mapReduce or adaptive (stuff where the whole prompt fits the budget).

    Without a budget map-reduce takes the chunks as they are and reduces once.
    """

    backend: Backend
    strategy: str = "adaptive"
    chunker: Chunker | None = None
    budget: ContextBudget | None = None

    def __post_init__(self) -> None:
        if self.strategy == "adaptive" and self.budget is None:
            object.__setattr__(self, "budget", ContextBudget.words(1500))
        if self.chunker is None:
            object.__setattr__(self, "chunker", SentenceChunker((self.budget or ContextBudget.words(1500)).word_limit))

    def _chunker(self, map_prompt: str, system: str | None, options: ChainOptions) -> Chunker:
        if self.budget is None:
            return self.chunker
        budgeter = Budgeter.of(self.backend, self.budget)
        available = budgeter.available(system, map_prompt, options.reserved_output_tokens)
        return BudgetedChunker(self.chunker, budgeter, available, fallback_word_target(available, self.budget, self.backend.context_window_tokens is not None))

    def route(self, text: Column, task: str, system: str | None, options: ChainOptions) -> Column:
        if self.strategy != "adaptive":
            return F.lit(self.strategy)
        fits = Budgeter.of(self.backend, self.budget).fits(system, task, text, options.reserved_output_tokens)
        return F.when(fits, F.lit("stuff")).otherwise(F.lit("mapReduce"))

    def run(self, docs: DataFrame, map_prompt: str = "", reduce_prompt: str = "", stuff_prompt: str | None = None, system: str | None = None, options: ChainOptions | None = None, template: P.Template | None = None, hint: Column | None = None, strict: bool = False) -> DataFrame:
        """``docs(doc_id, text, ...)`` -> ``(doc_id, route, text, error, source_chunks, summaries, metrics, levels)``.

        A null text is empty. Map-reduce of a text without chunks gives ``''`` without a call. ``hint`` is appended
        to the reduce prompt. ``error`` names what went wrong with a document; ``strict`` raises instead. ``levels``
        has the number of calls of each reduce level.
        """
        if template is not None:
            map_prompt, reduce_prompt, stuff_prompt = template.map_prompt, template.reduce_prompt, template.stuff_prompt
        options = options or ChainOptions()
        task = reduce_prompt if stuff_prompt is None else stuff_prompt
        reduce_task = F.lit(reduce_prompt) if hint is None else F.concat(F.lit(reduce_prompt), hint)
        stuff_task = F.lit(task) if hint is None or stuff_prompt is not None else reduce_task
        frame = docs.select("doc_id", T.normalised(F.col("text")).alias("__doc"), stuff_task.alias("__stuff"), reduce_task.alias("__reduce"))
        if self._counts_in_python() and self.backend.asker(system) is not None:
            frame = self._in_one_pass(frame, map_prompt, reduce_prompt, task, system, options)
        else:
            frame = frame.withColumn("route", self.route(F.col("__doc"), task, system, options))
            frame = self._stuffed(frame, system, options)
            if self.strategy == "stuff":
                frame = frame.withColumns({"chunks": F.array().cast(f"array<{CHUNK_STRUCT}>")})
            else:
                frame = with_chunks(frame, self._chunker(map_prompt, system, options), F.when(F.col("route") == "mapReduce", F.col("__doc")))
            frame = self._mapped(frame, map_prompt, system, options)
            frame = self._reduced(frame, reduce_prompt, system, options)
        stuffed = F.col("route") == "stuff"
        error = F.when(stuffed, F.when(F.col("__said").isNull(), NO_RESPONSE)).otherwise(F.col("__error"))
        if strict:
            error = F.when(error.isNull(), error).otherwise(F.raise_error(error))
        n = lambda c: F.when(stuffed, F.lit(0)).otherwise(c).cast("long")
        metrics = F.struct(
            n(F.size("chunks")).alias("chunk_count"), n(F.size("chunks")).alias("map_call_count"), n(F.aggregate("levels", F.lit(0), lambda a, x: a + x)).alias("reduce_call_count"),
            F.nullif(F.col("__in"), F.lit(0)).alias("estimated_input_tokens"), F.nullif(F.col("__out"), F.lit(0)).alias("estimated_output_tokens"),
        )
        return frame.select(
            "doc_id", "route", F.when(stuffed, F.col("__said")).otherwise(F.col("__result")).alias("text"), error.alias("error"),
            F.when(stuffed, _whole_chunk(F.col("__doc"))).otherwise(F.col("chunks")).alias("source_chunks"), F.when(stuffed, F.array().cast("array<string>")).otherwise(F.col("__first")).alias("summaries"), metrics.alias("metrics"), "levels",
        )

    def _counts_in_python(self) -> bool:
        return self.backend.context_window_tokens is not None and not self.backend.counter.by_words

    def _in_one_pass(self, frame: DataFrame, map_prompt: str, reduce_prompt: str, task: str, system: str | None, options: ChainOptions) -> DataFrame:
        """All steps of a run as one Python function, where each step would need functions, and so workers, of its own."""
        budgeter = Budgeter.of(self.backend, self.budget) if self.budget is not None else None
        run = WholeRun(self.strategy, self.backend, self._chunker(map_prompt, system, options), budgeter, map_prompt, reduce_prompt, task, system, options)
        kinds = {"__in": "bigint", "__out": "bigint", "chunks": f"array<{CHUNK_STRUCT}>", "__first": "array<string>", "levels": "array<int>"}
        schema = ", ".join([f"doc_id {frame.schema['doc_id'].dataType.simpleString()}", *(f"{c} {kinds.get(c, 'string')}" for c in FIELDS)])
        return frame.mapInArrow(run.batches, schema)

    def _tokens(self, texts: Column) -> Column:
        """Tokens of an array of texts, as a token-aware backend counts them, else 0."""
        if self.backend.context_window_tokens is None:
            return F.lit(0).cast("long")
        return F.aggregate(self.backend.counter.arrays(texts), F.lit(0).cast("long"), lambda a, x: a + x)

    def _stuffed(self, frame: DataFrame, system: str | None, options: ChainOptions) -> DataFrame:
        """One call where the route says so; it is never tried again."""
        if self.strategy == "mapReduce":
            return frame.withColumns({"__said": F.lit(None).cast("string"), "__in": F.lit(0).cast("long"), "__out": F.lit(0).cast("long")})
        asked = F.when(F.col("route") == "stuff", F.array(P.stuff_prompt(F.col("__stuff"), F.col("__doc"), options.prompt_style))).otherwise(F.array().cast("array<string>"))
        frame = frame.withColumn("__asked", asked).withColumn("__answers", self.backend.responses(F.col("__asked"), system))
        return frame.withColumns({"__said": F.get("__answers", 0), "__in": self._tokens(F.col("__asked")), "__out": self._tokens(F.col("__answers"))}).drop("__asked", "__answers")

    def _mapped(self, frame: DataFrame, map_prompt: str, system: str | None, options: ChainOptions) -> DataFrame:
        asked = F.transform("chunks", lambda c: P.map_prompt(map_prompt, c, F.size("chunks"), options.prompt_style))
        frame = frame.withColumn("__asked", asked)
        numbered = lambda at, s: F.concat(F.lit("[Chunk "), (at + 1).cast("string"), F.lit("] "), s)
        if options.preserve_order:
            frame = frame.withColumn("__answers", self.backend.responses(F.col("__asked"), system, options.retry, options.max_concurrent_map_tasks))
            label = F.transform("__answers", lambda s, i: numbered(i, s))
        else:
            frame = frame.withColumn("__came", self.backend.completed(F.col("__asked"), system, options.retry, options.max_concurrent_map_tasks)).withColumn("__answers", F.transform("__came", lambda c: c["text"]))
            label = F.transform("__came", lambda c: numbered(c["at"], c["text"]))
        frame = frame.withColumn("__first", label)
        return frame.withColumns({"__in": F.col("__in") + self._tokens(F.col("__asked")), "__out": F.col("__out") + self._tokens(F.col("__answers"))}).drop("__asked", "__answers", "__came")

    def _reduced(self, frame: DataFrame, reduce_prompt: str, system: str | None, options: ChainOptions) -> DataFrame:
        """Level after level until one call holds all summaries; rows that are done ask nothing more."""
        budgeter = Budgeter.of(self.backend, self.budget) if self.budget is not None else None
        reserved, most = options.reserved_output_tokens, max(2, options.max_reduce_group_size)
        exact = budgeter is not None and not budgeter.counter.by_words
        fits = None if budgeter is None or exact else lambda words: budgeter.fits_words(system, reduce_prompt, words, reserved)
        none = F.array().cast("array<string>")
        failed = F.exists("__first", lambda s: s.isNull())
        frame = frame.withColumns({
            "__now": F.when(failed, none).otherwise(F.col("__first")), "levels": F.array().cast("array<int>"),
            "__result": F.when((F.size("chunks") == 0) & (F.col("route") == "mapReduce"), F.lit("")), "__error": F.when(failed, F.lit(NO_RESPONSE)),
        })
        for _ in range(options.max_reduce_depth if self.strategy != "stuff" else 0):
            waits = F.size("__now") > 0
            if exact:
                frame = frame.withColumn("__cut", exact_groups(F.col("__now"), most, lambda text: budgeter.fits_text(system, reduce_prompt, text, reserved)))
                last, cut = F.col("__cut.last"), F.col("__cut.groups")
            else:
                words = F.aggregate("__now", F.lit(0).cast("long"), lambda a, x: a + T.word_count(x) + HEADER_WORDS)
                last, cut = F.lit(True) if fits is None else fits(words), reduce_groups(F.col("__now"), most, fits)
            frame = frame.withColumn("__last", waits & last)
            groups = F.when(~waits, F.array().cast("array<array<string>>")).when(F.col("__last"), F.array("__now")).otherwise(cut)
            frame = frame.withColumn("__groups", groups)
            frame = frame.withColumn("__asked", F.transform("__groups", lambda g: P.reduce_prompt(F.col("__reduce"), g, options.prompt_style)))
            frame = frame.withColumn("__answers", self.backend.responses(F.col("__asked"), system, options.retry))
            failed = F.exists("__answers", lambda s: s.isNull())
            named = F.zip_with("__groups", "__answers", lambda g, s: F.concat(F.lit("[Chunks "), chunk_range(F.element_at(g, 1)), F.lit("-"), chunk_range(F.element_at(g, -1)), F.lit("] "), s))
            frame = frame.withColumns({
                "__result": F.coalesce("__result", F.when(F.col("__last"), F.get("__answers", 0))), "__error": F.coalesce("__error", F.when(failed, F.lit(NO_RESPONSE))),
                "__now": F.when(F.col("__last") | failed, none).otherwise(named), "levels": F.when(F.size("__groups") > 0, F.array_append("levels", F.size("__groups"))).otherwise(F.col("levels")),
                "__in": F.col("__in") + self._tokens(F.col("__asked")), "__out": F.col("__out") + self._tokens(F.col("__answers")),
            }).drop("__last", "__groups", "__asked", "__answers", "__cut")
        return frame.withColumn("__error", F.coalesce("__error", F.when(F.size("__now") > 0, F.lit(DEPTH_EXCEEDED))))

    def without_retry(self, options: ChainOptions) -> ChainOptions:
        return replace(options, retry=type(options.retry)())


@dataclass
class MetricsAccumulator:
    """Run totals on the driver; token sums of zero and a rate without time are unknown."""

    chunk_count: int = 0
    map_call_count: int = 0
    reduce_call_count: int = 0
    input_tokens: int = 0
    output_tokens: int = 0
    elapsed_seconds: float = field(default=0.0)

    def finalize(self, elapsed_seconds: float) -> dict:
        rate = self.output_tokens / elapsed_seconds if elapsed_seconds > 0 and self.output_tokens else None
        return {
            "chunk_count": self.chunk_count, "map_call_count": self.map_call_count, "reduce_call_count": self.reduce_call_count, "elapsed_seconds": elapsed_seconds,
            "estimated_input_tokens": self.input_tokens or None, "estimated_output_tokens": self.output_tokens or None, "tokens_per_second": rate,
        }


def corpus_metrics(results: DataFrame) -> DataFrame:
    """One row with the sums over all documents; partial sums are taken before the exchange."""
    m = F.col("metrics")
    total = lambda c: F.coalesce(F.sum(m[c]), F.lit(0)).alias(c)
    return results.agg(F.count(F.lit(1)).alias("documents"), *[total(c) for c in ("chunk_count", "map_call_count", "reduce_call_count", "estimated_input_tokens", "estimated_output_tokens")])
