"""Budgets, prompts, chains, JSON, events, streams and the runner."""

import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from paperloom import queries as Q
from paperloom.functions import text as T
from paperloom.functions.schema import CHUNK_STRUCT
from paperloom.operators.documents import SentenceChunker
from paperloom.operators.prose import FixedChunker
from paperloom.plans import prompts as P
from paperloom.plans.backends import Backend, CannedBackend, ExtractiveBackend, PythonBackend, StreamingBackend, TokenAwareBackend, with_retry
from paperloom.plans.budget import Budgeter, ChainOptions, ContextBudget, RetryPolicy, TokenCounter, fallback_word_target
from paperloom.plans.chains import Chain, MetricsAccumulator, corpus_metrics
from paperloom.plans.events import events
from paperloom.plans.structured import EXHAUSTED, INVALID, MISMATCH, outermost_json, run_json
from paperloom.streaming.runs import Runner, chain_stream, chunk_stream, memory_pressure, should_proceed


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def words(n, word="w"):
    return " ".join(f"{word}{i}" for i in range(n))


def test_budget_numbers(spark):
    assert ContextBudget.tokens(4096).word_limit == 3079 and ContextBudget.words(0).word_limit == 1
    by_words = Budgeter.of(CannedBackend(), ContextBudget.words(1000))
    assert by_words.units(512) == 384 and by_words.units(128) == 96
    assert by_words.available(None, "a b", 512) == 1000 - 2 - 384 - 96
    assert Budgeter.of(CannedBackend(), ContextBudget.words(10)).available("s", "t", 512) == 1
    aware = Budgeter.of(TokenAwareBackend(context_window_tokens=77), ContextBudget.words(1000))
    assert (aware.limit, aware.in_words) == (77, False)
    assert fallback_word_target(150, ContextBudget.tokens(9, 1.0), True) == 100 and fallback_word_target(150, ContextBudget.tokens(9, 2.0), False) == 75
    blank = F.lit("  ")
    assert value(spark, by_words.count(blank)) == 0 and value(spark, Budgeter.of(CannedBackend(), ContextBudget.tokens(9)).count(blank)) == 1
    assert value(spark, by_words.fits(None, "a b", F.lit(words(614)), 512)) is True
    assert value(spark, by_words.fits(None, "a b", F.lit(words(615)), 512)) is False
    assert value(spark, ContextBudget.words(5).fits_in_budget(F.lit("a b c"), 1, 1)) is True
    assert TokenCounter().python(words(3)) == 3 == value(spark, TokenCounter().column(F.lit(words(3))))


def test_prompts(spark):
    chunk = F.from_json(F.lit('{"chunk_index":1,"text":"body","word_count":1,"source_word_range":{"start":3,"end":4},"timestamps":[],"speaker_labels":["A","B"],"timestamp_range":{"start":"00:01","end":"00:02"},"document_location":{"page_range":{"start":1,"end":2},"heading_path":["X","Y"],"primary_block_type":"table","block_types":[]},"log_metadata":{"kind":"unknown","severity":"info"}}'), CHUNK_STRUCT)
    want = 'do\n\n<source index="1" of="9" words="3-4" speaker="A, B" time="00:01-00:02" heading="X > Y" block="table" pages="1-2" logKind="unknown" severity="info">\nbody\n</source>'
    assert value(spark, P.map_prompt("do", chunk, F.lit(9), "delimited")) == want
    assert value(spark, P.map_prompt("do ", chunk, F.lit(9))) == "do body"
    two = F.array(F.lit("a"), F.lit("b"))
    assert value(spark, P.reduce_prompt("r ", two)) == "r --- Section 1 of 2 ---\na\n\n--- Section 2 of 2 ---\nb"
    assert value(spark, P.reduce_prompt("r", two, "delimited")) == 'r\n\n<summaries count="2">\n--- Section 1 of 2 ---\na\n\n--- Section 2 of 2 ---\nb\n</summaries>'
    assert value(spark, P.stuff_prompt("s", F.lit("x y"), "delimited")) == 's\n\n<source words="0-2">\nx y\n</source>'
    assert len(P.TEMPLATES) == 11 and all(t.stuff_prompt for t in P.TEMPLATES.values())


def test_stuff_and_empty(spark):
    rows = Chain(ExtractiveBackend(3), "stuff").run(docs(spark, "a b c d", "", None), reduce_prompt="R ", stuff_prompt="S ").orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["S a b", "S", "S"] and all(r.metrics.chunk_count == 0 for r in rows)
    assert rows[0].source_chunks[0].text == "a b c d" and rows[0].source_chunks[0].source_word_range.end == 4
    assert Chain(ExtractiveBackend(2), "stuff").run(docs(spark, "a b"), reduce_prompt="R ").first().text == "R a"


def test_map_reduce_calls(spark):
    rows = Chain(CannedBackend("s"), "mapReduce", FixedChunker(3)).run(docs(spark, words(9), ""), "m ", "r ").orderBy("doc_id").collect()
    assert (rows[0].metrics.map_call_count, rows[0].metrics.reduce_call_count, rows[0].levels) == (3, 1, [1])
    assert rows[0].summaries == ["[Chunk 1] s", "[Chunk 2] s", "[Chunk 3] s"]
    assert (rows[1].text, rows[1].error, rows[1].metrics.map_call_count, rows[1].source_chunks) == ("", None, 0, [])


class Recorder(Backend):
    """Answers map prompts with a fixed text and reduce prompts with themselves."""

    def __init__(self, answer):
        self.answer = answer

    def response(self, prompt, system=None):
        return F.when(F.startswith(prompt, F.lit("map ")), F.lit(self.answer)).otherwise(prompt)


def run_levels(spark, n, size, answer_words, limit, **options):
    chain = Chain(CannedBackend(words(answer_words)), "mapReduce", FixedChunker(size), ContextBudget.words(limit))
    return chain.run(docs(spark, words(n)), "map ", "reduce ", options=ChainOptions(reserved_output_tokens=0, **options)).first()


def test_hierarchical_reduce(spark):
    row = run_levels(spark, 50, 5, 20, 200)
    assert (row.metrics.map_call_count, row.levels, row.error) == (10, [2, 1], None)
    assert run_levels(spark, 18, 3, 15, 120, max_reduce_group_size=8).levels == [2, 1]
    assert run_levels(spark, 30, 3, 15, 200, max_reduce_group_size=3).levels == [4, 1]
    assert run_levels(spark, 30, 3, 20, 10, max_reduce_depth=2).error == "reduceDepthExceeded"
    chain = Chain(Recorder(words(20)), "mapReduce", FixedChunker(5), ContextBudget.words(200))
    text = chain.run(docs(spark, words(50)), "map ", "reduce ", options=ChainOptions(reserved_output_tokens=0, max_reduce_depth=9)).first().text
    assert text is None or "[Chunks 1-7]" in text


def test_labels_join_over_levels(spark):
    chain = Chain(CannedBackend("x y z"), "mapReduce", FixedChunker(1), ContextBudget.words(40))
    options = ChainOptions(reserved_output_tokens=0, max_reduce_group_size=3, max_reduce_depth=9)
    tail = Recorder("x y z")
    tail.response = lambda p, system=None: F.when(F.startswith(p, F.lit("map ")), F.lit("x y z")).when(F.contains(p, F.lit("[Chunks 1-3-7-9]")), p).otherwise(F.lit("x y z"))
    assert chain.run(docs(spark, words(12)), "map ", "reduce ", options=options).first().levels == [4, 2, 1]
    text = Chain(tail, "mapReduce", FixedChunker(1), ContextBudget.words(40)).run(docs(spark, words(12)), "map ", "reduce ", options=options).first().text
    assert "[Chunks 1-3-7-9] x y z" in text


def test_strict_raises(spark):
    chain = Chain(CannedBackend(words(20)), "mapReduce", FixedChunker(3), ContextBudget.words(10))
    with pytest.raises(Exception, match="reduceDepthExceeded"):
        chain.run(docs(spark, words(30)), "m ", "r ", options=ChainOptions(max_reduce_depth=2), strict=True).collect()


def test_rechunk_to_the_budget(spark):
    text = " ".join(f"W{i}." for i in range(200))
    chain = Chain(CannedBackend("s"), "mapReduce", FixedChunker(1000), ContextBudget.tokens(300, 2.0))
    row = chain.run(docs(spark, text), "Map this: ", "Reduce: ", options=ChainOptions(reserved_output_tokens=0)).first()
    assert len(row.source_chunks) >= 3 and all(len(c.text.split()) <= 110 for c in row.source_chunks)


def test_adaptive_route(spark):
    chain = Chain(ExtractiveBackend(), budget=ContextBudget.words(6))
    options = ChainOptions(reserved_output_tokens=0)
    rows = chain.run(docs(spark, words(5), words(6)), "m ", "r ", "s ", options=options).orderBy("doc_id").collect()
    assert [r.route for r in rows] == ["stuff", "mapReduce"]


def test_every_marker_is_seen(spark):
    tokens = words(400).split(" ")
    for k in (99, 199, 299, 399):
        tokens[k] = f"MARK{k}"
    row = Chain(CannedBackend("s"), "mapReduce", FixedChunker(32, 8)).run(docs(spark, " ".join(tokens)), "m ", "r ").first()
    assert row.metrics.map_call_count == 17 and row.levels == [1]
    assert all(any(f"MARK{k}" in c.text for c in row.source_chunks) for k in (99, 199, 299, 399))


def test_tokens_only_with_an_aware_backend(spark):
    plain = Chain(CannedBackend("s"), "mapReduce", FixedChunker(3)).run(docs(spark, words(6)), "m ", "r ").first().metrics
    assert plain.estimated_input_tokens is None
    aware = Chain(TokenAwareBackend(2, context_window_tokens=10_000), "mapReduce", FixedChunker(3)).run(docs(spark, words(6)), "m ", "r ").first().metrics
    assert aware.estimated_input_tokens > 0 and aware.estimated_output_tokens > 0
    total = corpus_metrics(Chain(CannedBackend("s"), "mapReduce", FixedChunker(3)).run(docs(spark, words(6), words(3)), "m ", "r ")).first()
    assert (total.documents, total.chunk_count, total.reduce_call_count) == (2, 3, 2)


def test_metrics_accumulator():
    assert MetricsAccumulator(input_tokens=1000, output_tokens=200).finalize(10)["tokens_per_second"] == 20.0
    none = MetricsAccumulator().finalize(0)
    assert none["estimated_input_tokens"] is None and none["tokens_per_second"] is None


def flaky(fails, path):
    """Fails that many times, counted in a file that all workers see."""

    def generate(prompt, system):
        with open(path, "a+") as f:
            f.seek(0)
            n = len(f.read())
            f.write(".")
        if n < fails:
            raise RuntimeError("not yet")
        return "fine"

    return generate


def test_retry(spark, tmp_path):
    options = ChainOptions(retry=RetryPolicy(3, 1))
    one = Chain(PythonBackend(flaky(1, f"{tmp_path}/a")), "mapReduce", FixedChunker(9)).run(docs(spark, "a b"), "m ", "r ", options=options).first()
    assert one.text == "fine"
    lost = Chain(PythonBackend(flaky(10, f"{tmp_path}/b"), "null"), "mapReduce", FixedChunker(9)).run(docs(spark, "a b"), "m ", "r ", options=ChainOptions(retry=RetryPolicy(2))).first()
    assert (lost.text, lost.error) == (None, "generationFailed")
    # a single call for a document is never tried again
    stuffed = Chain(PythonBackend(flaky(1, f"{tmp_path}/c"), "null"), "stuff").run(docs(spark, "a b"), reduce_prompt="r ", options=options).first()
    assert stuffed.error == "generationFailed"
    with pytest.raises(Exception, match="not yet"):
        Chain(PythonBackend(flaky(9, f"{tmp_path}/d")), "stuff").run(docs(spark, "a b"), reduce_prompt="r ").collect()
    tries = []
    with pytest.raises(ValueError):
        with_retry(lambda: tries.append(1) or int("x"), RetryPolicy(4))
    assert len(tries) == 4


def test_calls_are_made_once(spark, tmp_path):
    path = f"{tmp_path}/calls"

    def generate(prompt, system):
        with open(path, "a") as f:
            f.write(".")
        return "s"

    rows = Chain(PythonBackend(generate), "mapReduce", FixedChunker(2)).run(docs(spark, words(8), words(4)), "m ", "r ", options=ChainOptions(max_concurrent_map_tasks=3)).collect()
    assert len(open(path).read()) == sum(r.metrics.map_call_count + r.metrics.reduce_call_count for r in rows) == 8


JSON_CASES = [
    ('{"name":"a","count":1}', '{"name":"a","count":1}'), ('x\n```json\n{"a":1}\n```', '{"a":1}'), ("Sure! [1,2] ok {", "[1,2]"), ('a {"b":{"c":[1]}} d', '{"b":{"c":[1]}}'),
    ('{"s":"} ] \\" {"} tail', '{"s":"} ] \\" {"}'), ("nothing", "nothing"), ('{"open": [1, 2]', "[1, 2]"), ("", ""),
]


@pytest.mark.parametrize(("raw", "want"), JSON_CASES)
def test_outermost_json(raw, want):
    assert outermost_json(raw) == want


ITEM = StructType([StructField("name", StringType(), False), StructField("count", LongType(), False), StructField("more", StringType())])


def test_run_json(spark, tmp_path):
    ok = run_json(Chain(CannedBackend('```json\n{"name":"a","count":2}\n```'), "stuff"), docs(spark, "x"), ITEM, "m", "r").first()
    assert (ok.value["name"], ok.value["count"], ok.error) == ("a", 2, None)
    assert run_json(Chain(CannedBackend("no json"), "stuff"), docs(spark, "x"), ITEM, "m", "r").first().error == INVALID
    assert run_json(Chain(CannedBackend('{"name":"a"}'), "stuff"), docs(spark, "x"), ITEM, "m", "r").first().error == MISMATCH
    many = run_json(Chain(CannedBackend('[{"name":"a","count":1},{"name":"b","count":2}]'), "stuff"), docs(spark, "x"), ArrayType(ITEM), "m", "r").first()
    assert [v.name for v in many.value] == ["a", "b"]

    class Hinted(Backend):
        def response(self, prompt, system=None):
            return F.when(F.contains(prompt, F.lit("valid JSON only")) | F.contains(prompt, F.lit("good")), F.lit('{"name":"a","count":1}')).otherwise(F.lit("oops"))

    options = ChainOptions(retry=RetryPolicy(2))
    rows = run_json(Chain(Hinted(), "stuff"), docs(spark, "x", "good"), ITEM, "m", "r ", options=options).orderBy("doc_id").collect()
    assert [r.error for r in rows] == [None, None] and rows[0].raw_text.startswith("{")
    blind = run_json(Chain(Hinted(), "stuff"), docs(spark, "x"), ITEM, "m", "r ", stuff_prompt="s ", options=options).first()
    assert blind.error == f"{EXHAUSTED}: {INVALID}"


def test_events(spark):
    backend = StreamingBackend("one two three")
    rows = events(Chain(backend, "stuff").run(docs(spark, "a"), reduce_prompt="r "), backend).orderBy("seq").collect()
    assert [(r.type, r.phase) for r in rows] == [("progress", "stuffing"), ("chunk", None), ("chunk", None), ("chunk", None), ("progress", "complete"), ("result", None)]
    assert "".join(r.text for r in rows if r.type == "chunk") == rows[-1].text == "one two three"
    chain = Chain(CannedBackend("s"), "mapReduce", FixedChunker(1))
    rows = events(chain.run(docs(spark, "a b"), "m ", "r "), chain.backend).orderBy("seq").collect()
    assert [(r.type, r.phase, r.step, r.total) for r in rows] == [("progress", "mapping", 1, 2), ("progress", "mapping", 2, 2), ("progress", "reducing", None, None), ("progress", "complete", None, None), ("chunk", None, None, None), ("result", None, None, None)]


def test_streams(spark, tmp_path):
    docs(spark, "One two. Three four.", "Five six.").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(f"{tmp_path}/in")
    for name, chunker in (("fixed", FixedChunker(2)), ("overlap", SentenceChunker(2, 1))):
        query = chunk_stream(stream, chunker).writeStream.format("memory").queryName(f"chunks_{name}").trigger(availableNow=True).start()
        query.awaitTermination(60)
        assert spark.table(f"chunks_{name}").count() == 3
    got = []
    query = chain_stream(stream, Chain(CannedBackend("s"), "mapReduce", FixedChunker(1)), lambda df, k: got.extend(df.collect()), f"{tmp_path}/cp", map_prompt="m ", reduce_prompt="r ")
    query.awaitTermination(60)
    assert sorted(r.doc_id for r in got) == [0, 1] and all(r.text == "s" for r in got)


def test_runner(spark):
    runner = Runner(spark)
    runner.run(lambda: spark.range(3))
    runner.wait(60)
    assert (runner.phase, len(runner.result)) == ("complete", 3)
    runner.run(lambda: spark.range(1).select(F.raise_error(F.lit("no"))))
    runner.wait(60)
    assert runner.phase == "failed" and runner.error is not None
    runner.run(lambda: spark.range(10**12).selectExpr("sum(id % 7)"))
    time.sleep(1)
    runner.cancel()
    assert runner.phase == "cancelled" and not runner.is_running


def test_memory_gate():
    assert memory_pressure(50)[0] == "critical" and memory_pressure(200)[0] == "warning" and memory_pressure(500)[0] == "ok"
    assert not should_proceed(50) and should_proceed(200)
    assert memory_pressure()[1] > 0


def test_scalar_columns(spark):
    line = F.lit("  Key name :  va:lue ")
    assert value(spark, T.key_value(line)).asDict() == {"key": "Key name", "value": "va:lue"}
    assert value(spark, T.key_value(F.lit(": x"))) is None and value(spark, T.key_value(F.lit("a:"))).value == ""
    assert value(spark, T.signal(F.lit("EXC (SIGABRT)"))) == "SIGABRT" and value(spark, T.page_number(F.lit("=== Page 12 ==="))) == 12
    assert value(spark, T.clean_heading(F.lit("## **Topic: Food**"))) == "Food" and value(spark, T.atx_level(F.lit("### x"))) == 3
    assert value(spark, T.mark_level(F.lit("#tag"))) == 1 and value(spark, T.atx_level(F.lit("#tag"))) is None
    assert value(spark, T.word_count(F.lit("a b c d"))) == 4 and value(spark, T.is_ips(F.lit('"app_name" "bundleID"'))) is True
    assert value(spark, T.test_name(F.lit("Test Case '-[A]' failed"))) == "A" and value(spark, T.test_name(F.lit("Test Case '-[A b]' failed"))) is None
    assert value(spark, T.sentences(F.lit("Hi there. Yes! no. \"Ok.\" Then\nnext"))) == ["Hi there.", "Yes! no.", '"Ok."', "Then", "next"]
    assert value(spark, T.has_topics(F.lit("x\nALL CAPS LINE\ny"))) is True
    assert value(spark, T.speaker_labels(F.lit("Bob: x\nAnn: y\nBob: z"))) == ["Ann", "Bob"]


def test_one_text(spark):
    from paperloom.plans.chains import ReduceDepthExceeded
    from paperloom.plans.single import GenerationFailed, run, run_with_metadata, stream

    chain = Chain(ExtractiveBackend(4), "adaptive", SentenceChunker(3), ContextBudget.words(1000))
    assert run(spark, chain, "a b c", reduce_prompt="R ") == "R a b c"
    assert run_with_metadata(spark, chain, "a b c", template=P.TEMPLATES["actionItems"]).route == "stuff"
    assert [r.type for r in stream(spark, chain, "a", reduce_prompt="R ")][-1] == "result"
    deep = Chain(CannedBackend(words(20)), "mapReduce", FixedChunker(3), ContextBudget.words(10))
    with pytest.raises(ReduceDepthExceeded):
        run(spark, deep, words(30), options=ChainOptions(max_reduce_depth=2))

    def broken(prompt, system):
        raise RuntimeError

    with pytest.raises(GenerationFailed):
        run(spark, Chain(PythonBackend(broken, "null"), "stuff"), "x")


def test_readers(spark, tmp_path):
    from paperloom.sources import readers as R

    (tmp_path / "a.txt").write_text("one\ntwo")
    assert R.read_texts(spark, f"{tmp_path}/*.txt").first().text == "one\ntwo"
    (tmp_path / "b.json").write_text('{"id":"7","body":"x"}\n')
    assert tuple(R.read_json(spark, f"{tmp_path}/b.json", "id", "body").first()) == ("7", "x")
    R.write(R.from_strings(spark, ["p", "q"]), f"{tmp_path}/t")
    assert R.read_table(spark, f"{tmp_path}/t").count() == 2


def brute_adaptive(text):
    """Route, text, chunks, calls of each level of ``adaptive_summary`` for one text, as the reference's MapReduceChain goes."""
    count, first, task = (lambda t: len(t.split())), (lambda t: " ".join(t.split()[:20])), Q.REDUCE_TASK
    shown = lambda g: "\n\n".join(f"--- Section {i} of {len(g)} ---\n{s}" for i, s in enumerate(g, 1))
    fits = lambda g: 3 + 384 + count(shown(g)) <= 900
    label = lambda s: s[s.index(" ") + 1 : s.index("]")]

    def packed(target):
        groups = []
        for sentence in text.replace(". ", ".\n").split("\n"):
            if groups and count(" ".join([*groups[-1], sentence])) <= target:
                groups[-1].append(sentence)
            else:
                groups.append([sentence])
        return [" ".join(g) for g in groups]

    if 1 + 384 + count(text) <= 900:
        return "stuff", first(Q.STUFF_TASK + text), 0, []
    chunks = packed(120)
    if max(map(count, chunks)) > 900 - 3 - 384 - 96:
        chunks = packed(900 - 3 - 384 - 96)
    now, calls = [f"[Chunk {i}] {first(Q.MAP_TASK + c)}" for i, c in enumerate(chunks, 1)], []
    while not fits(now):
        groups = []
        for s in now:
            if groups and len(groups[-1]) < 8 and fits([*groups[-1], s]):
                groups[-1].append(s)
            else:
                groups.append([s])
        calls.append(len(groups))
        now = [f"[Chunks {label(g[0])}-{label(g[-1])}] {first(task + shown(g))}" for g in groups]
    return "mapReduce", first(task + shown(now)), len(chunks), [*calls, 1]


def test_adaptive_queries_cut_anew_and_reduce_as_deep_as_needed(spark, tmp_path):
    """A sentence too long for a map prompt has the whole text cut anew, and 150 chunks take three levels."""
    texts = [words(20) + ".", " ".join([words(60, "N") + "."] * 5 + [words(430, "N") + "."] + [words(60, "N") + "."] * 5), " ".join([words(110, "N") + "."] * 160)]
    docs(spark, *texts).write.parquet(f"{tmp_path}/documents.parquet")
    want = [brute_adaptive(t) for t in texts]
    assert [(w[0], w[2], w[3]) for w in want] == [("stuff", 0, []), ("mapReduce", 3, [1]), ("mapReduce", 160, [20, 3, 1])]
    rows = Q.QUERIES["adaptive_summary"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.route, r.text, r.n_chunks, r.n_reduce, r.error) for r in rows] == [(w[0], w[1], w[2], sum(w[3]), None) for w in want]
    metrics = {r.route: (r.n_docs, r.n_chunks, r.n_map, r.n_reduce) for r in Q.QUERIES["chain_metrics"](spark, str(tmp_path)).collect()}
    assert metrics == {"stuff": (1, 0, 0, 0), "mapReduce": (2, 163, 163, 25)}
    steps = {(r.doc_id, r.phase): r.n for r in Q.QUERIES["run_events"](spark, str(tmp_path)).where("type = 'progress'").collect()}
    assert steps == {(0, "stuffing"): 1, (1, "mapping"): 3, (1, "reducing"): 1, (2, "mapping"): 160, (2, "reducing"): 24} | {(i, "complete"): 1 for i in range(3)}
