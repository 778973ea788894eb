"""Exact token budgets, streams of live calls, completion order, cancellation, metrics, and the SQL of the queries."""

import threading
import time

import duckdb
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from paperloom import more_oracles, more_queries
from paperloom.functions.text import Py
from paperloom.operators.documents import SentenceChunker
from paperloom.operators.prose import FixedChunker
from paperloom.plans import single
from paperloom.plans.backends import Cancelled, CannedBackend, ExtractiveBackend, PythonBackend, TokenAwareBackend
from paperloom.plans.budget import Budgeter, ChainOptions, ContextBudget, TokenizerCounter
from paperloom.plans.chains import Chain, reduce_groups
from paperloom.plans.prompts import format_texts
from paperloom.streaming.runs import Runner

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
TOKENIZER = Tokenizer.from_file(PATH)


def tokens(text):
    return len(TOKENIZER.encode(text, add_special_tokens=False).ids) if text else 0


def test_exact_counts_as_columns(spark):
    texts = ["", "one two", "Straße 日本 don't", None, "word " * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    counter = TokenizerCounter(PATH)
    assert {r.i: r.n for r in rows.select("i", counter.column(F.col("text")).alias("n")).collect()} == {i: tokens(t) for i, t in enumerate(texts)}
    both = rows.select("i", counter.arrays(F.array("text", F.lit("a b"))).alias("n")).collect()
    assert all(list(r.n) == [tokens(texts[r.i]), tokens("a b")] for r in both)
    budgeter = Budgeter.of(TokenAwareBackend(context_window_tokens=20, counter=counter), ContextBudget.words(5))
    got = rows.select("i", budgeter.fits("sys", "do ", F.col("text"), 3).alias("f")).collect()
    assert all(r.f == (tokens("sys") + 3 + tokens("do ") + tokens(texts[r.i]) <= 20) for r in got if texts[r.i] is not None)


def brute_exact(text, window=600, reserved=64, most=4, depth=8):
    """The chain of ``exact_tokens`` for one text, call by call."""
    first = lambda prompt, n=30: " ".join(prompt.split()[:n])
    used = {"in": 0, "out": 0}

    def ask(prompt):
        answer = first(prompt)
        used["in"] += tokens(prompt)
        used["out"] += tokens(answer)
        return answer

    task, map_task, reduce_task = more_queries.STUFF_TASK, more_queries.MAP_TASK, more_queries.REDUCE_TASK
    if tokens(task) + tokens(text) + reserved <= window:
        said = ask(task + text)
        return "stuff", said, None, 1, "", used["in"] or None, used["out"] or None
    free = max(1, window - tokens(map_task) - reserved - 128)
    chunks = [c["text"] for c in SentenceChunker(more_queries.TARGET).chunks(text)]
    if chunks and max(map(tokens, chunks)) > free:
        chunks = [c["text"] for c in SentenceChunker(free).chunks(text)]
    now = [f"[Chunk {i}] {ask(map_task + c)}" for i, c in enumerate(chunks, 1)]
    fits = lambda xs: tokens(reduce_task) + tokens(format_texts(xs)) + reserved <= window
    label = lambda s: s[s.index(" ") + 1 : s.index("]")]
    levels, result = [], None
    for _ in range(depth):
        if not now or result is not None:
            break
        if fits(now):
            levels.append(1)
            result = ask(reduce_task + format_texts(now))
            break
        groups = []
        for s in now:
            if groups and len(groups[-1]) < most and fits([*groups[-1], s]):
                groups[-1].append(s)
            else:
                groups.append([s])
        levels.append(len(groups))
        now = [f"[Chunks {label(g[0])}-{label(g[-1])}] {ask(reduce_task + format_texts(g))}" for g in groups]
    return "mapReduce", result if chunks else "", None if result is not None or not chunks else "reduceDepthExceeded", len(chunks), ",".join(map(str, levels)), used["in"] or None, used["out"] or None


def test_exact_token_query_equals_brute_force(spark):
    texts = {r.doc_id: (r.text or "").replace("\r\n", "\n") for r in more_queries.documents(spark, SF).collect()}
    got = {r.doc_id: (r.route, r.text, r.error, r.n_chunks, r.levels, r.tokens_in, r.tokens_out) for r in more_queries.exact_tokens(spark, SF).collect()}
    want = {i: brute_exact(t) for i, t in texts.items()}
    assert got == want
    assert {w[0] for w in want.values()} == {"stuff", "mapReduce"} and any("," in w[4] for w in want.values())


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=12), st.integers(10, 90), st.integers(2, 5))
def test_running_sums_give_the_groups_of_whole_prompts(spark, sizes, limit, most):
    texts = [" ".join(["w"] * n) for n in sizes]
    groups = []
    for t in texts:
        if groups and len(groups[-1]) < most and Py.count(format_texts([*groups[-1], t])) + 2 <= limit:
            groups[-1].append(t)
        else:
            groups.append([t])
    budgeter = Budgeter.of(CannedBackend(), ContextBudget.words(limit))
    column = reduce_groups(F.array(*map(F.lit, texts)), most, lambda n: budgeter.fits_words(None, "a b", n, 0))
    assert [list(g) for g in spark.range(1).select(column.alias("g")).first().g] == groups


def one(spark, text="a b c d e f"):
    return spark.createDataFrame([(0, text)], "doc_id bigint, text string")


def test_completion_order(spark):
    def slow(prompt, system):
        time.sleep(0.5 if "a" in prompt.split() else 0.0)
        return prompt

    chain = Chain(PythonBackend(slow), "mapReduce", FixedChunker(1))
    options = ChainOptions(max_concurrent_map_tasks=3, preserve_order=False)
    assert chain.run(one(spark, "a b c"), "m ", "r ", options=options).first().summaries[-1] == "[Chunk 1] m a"
    kept = ChainOptions(max_concurrent_map_tasks=3)
    assert chain.run(one(spark, "a b c"), "m ", "r ", options=kept).first().summaries == ["[Chunk 1] m a", "[Chunk 2] m b", "[Chunk 3] m c"]


def test_cancelled_before_a_call(spark):
    chain = Chain(PythonBackend(lambda p, s: p, on_error="null", cancelled=lambda: True), "stuff")
    with pytest.raises(Exception, match="Cancelled"):
        chain.run(one(spark), reduce_prompt="r ").collect()
    asked = []
    with pytest.raises(Cancelled):
        list(single.stream_call(lambda p, s: iter(asked.append(p) or "ab"), "x", cancelled=lambda: True))
    assert not asked


def test_fragments_come_while_the_call_runs():
    made = []

    def generate(prompt, system):
        for part in prompt.split():
            made.append(part)
            yield part

    events = single.stream_call(generate, "x\r\ny", "do ", style="delimited")
    assert next(events)["phase"] == "stuffing" and not made
    assert next(events)["text"] == "do" and made == ["do"]
    rest = list(events)
    assert rest[-1]["type"] == "result" and rest[-1]["text"] == "".join(made) and rest[-2]["phase"] == "complete"
    assert 'words="0-2">' in made


def test_runner_follows_a_live_call(spark):
    runner, go = Runner(spark), threading.Event()

    def generate(prompt, system):
        yield "one "
        go.wait(20)
        yield "two"

    runner.follow(lambda: single.stream_call(generate, "x"))
    for _ in range(200):
        if runner.partial_text == "one ":
            break
        time.sleep(0.05)
    assert (runner.phase, runner.partial_text, runner.result, runner.is_running) == ("stuffing", "one ", None, True)
    go.set()
    runner.wait(20)
    assert (runner.phase, runner.partial_text, runner.result) == ("complete", "one two", "one two")
    again = threading.Event()
    runner.follow(lambda: single.stream_call(lambda p, s: iter(["a" if again.wait(0.2) else "b"] * 50), "x"))
    runner.cancel()
    assert runner.phase == "cancelled" and runner.result is None

    def broken(prompt, system):
        yield "a"
        raise ValueError("no model")

    runner.follow(lambda: single.stream_call(broken, "x"))
    runner.wait(20)
    assert runner.phase == "failed" and "no model" in str(runner.error) and runner.partial_text == "a"
    runner.follow(lambda: single.stream(spark, Chain(CannedBackend("said"), "stuff"), "text", reduce_prompt="r "))
    runner.wait(60)
    assert (runner.phase, runner.partial_text, runner.result) == ("complete", "said", "said")


def test_metrics_of_one_run(spark):
    chain = Chain(TokenAwareBackend(words=5, context_window_tokens=4096), "stuff")
    row, metrics = single.run_with_metrics(spark, chain, "a b c d e f", reduce_prompt="r ")
    assert row.text == "r a b c d" and metrics["elapsed_seconds"] > 0 and metrics["estimated_output_tokens"] == 6
    assert metrics["tokens_per_second"] == pytest.approx(6 / metrics["elapsed_seconds"])
    assert single.run_with_metrics(spark, Chain(ExtractiveBackend(2), "stuff"), "a", reduce_prompt="r ")[1]["tokens_per_second"] is None


@pytest.mark.parametrize("name", sorted(set(more_queries.QUERIES) & set(more_oracles.ORACLES)))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "events", "documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = more_queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({more_oracles.ORACLES[name]})").fetchall()
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want, key=key) and want


class Columns(TokenAwareBackend):
    """Answers as TokenAwareBackend does, but only as a Column, so that every step of a run is a step of the plan."""

    def response(self, prompt, system=None):
        return super().response(prompt, system)


@pytest.mark.parametrize(("strategy", "style", "budget"), [("adaptive", "raw", ContextBudget.words(900)), ("mapReduce", "delimited", ContextBudget.tokens(200)), ("mapReduce", "raw", None), ("stuff", "delimited", None)])
def test_one_function_counts_a_whole_run(spark, strategy, style, budget):
    """A plan has one Python function, whatever its levels, and the results of the plan with a function for each step."""
    long = " ".join(f"Ana: word{i} sagt {'.' if i % 9 == 0 else 'so'} N{i}" for i in range(700))
    given = spark.createDataFrame(list(enumerate(["", None, "one two", " ̈x y\r\nz", "un broken " * 90, long, long.replace(".", "x")])), "doc_id bigint, text string")
    options = ChainOptions(reserved_output_tokens=16, max_reduce_group_size=3, max_reduce_depth=3, prompt_style=style)
    made = []
    for kind in (Columns, TokenAwareBackend):
        chain = Chain(kind(words=12, context_window_tokens=150, counter=TokenizerCounter(PATH)), strategy, SentenceChunker(40), budget)
        made.append(chain.run(given, "Part: ", "Merge: ", "Whole: ", "sys", options, hint=F.concat(F.lit("of "), F.col("doc_id").cast("string"))))
    plan = made[1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 0 and plan.count("MapInArrow") == 1
    rows = [{r.doc_id: r for r in m.collect()} for m in made]
    assert rows[0] == rows[1] and made[0].schema.simpleString() == made[1].schema.simpleString()


def test_one_function_asks_a_python_model(spark):
    """Failures, null answers and the order of arrival are the same for a model in Python."""
    def model(prompt, system):
        if "bad" in prompt:
            raise ValueError(prompt)
        time.sleep(0.3 if "slow" in prompt else 0.0)
        return " ".join(prompt.split()[:4])

    given = spark.createDataFrame([(0, "slow one. Two two. Three three."), (1, "a. B bad. C c."), (2, "")], "doc_id bigint, text string")
    backend = PythonBackend(model, "null", context_window_tokens=90, counter=TokenizerCounter(PATH))
    run = lambda kept: {r.doc_id: r for r in Chain(backend, "mapReduce", SentenceChunker(2)).run(given, "m ", "r ", options=ChainOptions(max_concurrent_map_tasks=3, preserve_order=kept)).collect()}
    kept, came = run(True), run(False)
    assert list(kept[0].summaries) == ["[Chunk 1] m slow one.", "[Chunk 2] m Two two.", "[Chunk 3] m Three three."] and sorted(came[0].summaries) == list(kept[0].summaries)
    assert came[0].summaries[-1] == "[Chunk 1] m slow one."
    assert (kept[1].text, kept[1].error, list(kept[1].summaries)) == (None, "generationFailed", ["[Chunk 1] m a.", None, "[Chunk 3] m C c."]) and (kept[2].text, kept[2].error) == ("", None)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "Str", "Σ", "ß", "̈", "'s", "'", "!", "7", " ", "\n", "\t", " ", " ", "\x1c", "\x85", "日", "İ", "é", "<|endoftext|>", "<|", "x" * 300]), max_size=30).map("".join))
def test_words_counted_apart_are_the_whole_count(text):
    counter = COUNTER
    assert counter.python(text) == tokens(text) and counter._apart


COUNTER = TokenizerCounter(PATH)


def test_known_words_are_bounded(monkeypatch):
    monkeypatch.setattr("paperloom.plans.budget.KNOWN_WORDS", 20)
    counter = TokenizerCounter(PATH)
    text = " ".join(f"w{i % 90}x" for i in range(500))
    assert all(counter.python(part) == tokens(part) for part in [text[a : a + 200] for a in range(0, 2000, 37)]) and len(counter._known) <= 20 + 90
    assert counter.python("y" * 5000) == tokens("y" * 5000) and "y" * 5000 not in counter._known


def test_other_tokenizers_count_whole_texts(tmp_path):
    other = Tokenizer.from_file(PATH)
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    other.save(str(tmp_path / "t.json"))
    counter = TokenizerCounter(str(tmp_path / "t.json"))
    text = "One  two\nthree, don't 12  "
    assert counter.python(text) == len(other.encode(text, add_special_tokens=False).ids) and not counter._apart
