"""Chunkers: the expectations of the fixtures, Column forms against Python forms, and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions.text import WORD, Py
from paperloom.operators.diagnostics import CrashReportChunker, LogChunker, block_kind, classify, crash_sections, source_label
from paperloom.operators.documents import CodeBlockChunker, DocumentStructureChunker, MarkdownChunker, SentenceChunker
from paperloom.operators.packing import spans
from paperloom.operators.prose import FixedChunker
from paperloom.operators.tables import CHUNKERS, chunk, register
from paperloom.operators.transcript import TranscriptChunker


def texts(chunker, text):
    return [c["text"] for c in chunker.chunks(text)]


SEVEN = "one two three four five six seven"


def test_fixed_windows():
    assert texts(FixedChunker(3), SEVEN) == ["one two three", "four five six", "seven"]
    assert texts(FixedChunker(4, 1), SEVEN) == ["one two three four", "four five six seven", "seven"]
    assert texts(FixedChunker(2), "one\ttwo\n three") == ["one two", "three"]
    assert len(texts(FixedChunker(500), " ".join(["w"] * 5000))) == 10
    first = next(FixedChunker(6).chunks("00:05 Alex: we start the meeting now okay"))
    assert first["timestamps"] == ["00:05"] and first["speaker_labels"] == ["Alex"] and first["source_word_range"] == {"start": 0, "end": 6}
    assert texts(FixedChunker(0, 9), "a b") == ["a", "b"]


def test_sentences_with_overlap():
    text = "One two. Three four. Five six. Seven eight."
    assert texts(SentenceChunker(4, 1), text) == ["One two. Three four.", "Three four. Five six.", "Five six. Seven eight."]
    assert list(spans([2, 8, 8], 10, 1)) == [(0, 2), (1, 2), (2, 3)]


def greedy(widths, target):
    groups, total = [], 0
    for i, w in enumerate(widths):
        if not groups or (total + w > target and total > 0):
            groups.append([i, i + 1])
            total = w
        else:
            groups[-1][1] = i + 1
            total += w
    return [tuple(g) for g in groups]


@given(st.lists(st.integers(0, 9), max_size=40), st.integers(1, 20), st.integers(0, 4))
def test_spans_pack_greedily_and_cover(widths, target, overlap):
    assert list(spans(widths, target)) == greedy(widths, target)
    found = list(spans(widths, target, overlap))
    assert {i for a, b in found for i in range(a, b)} == set(range(len(widths)))
    assert all(a < b for a, b in found) and all(x[0] < y[0] for x, y in zip(found, found[1:], strict=False))


TALK = "00:01 Ann: hello there all\n00:05 Bob: hi Ann\nmore words 00:06 here\n00:09 Ann: bye now"


def test_transcript_by_speaker():
    rows = list(TranscriptChunker(8).chunks(TALK))
    assert {r["attribution_type"] for r in rows} == {"speaker"}
    assert [r["speaker_labels"] for r in rows] == [["Ann"], ["Bob"], ["Ann"]]
    assert rows[1]["timestamps"] == ["00:05", "00:06"] and rows[1]["source_word_range"] == {"start": 5, "end": 13}
    assert rows[1]["timestamp_range"] == {"start": "00:05", "end": "00:06"}
    assert texts(TranscriptChunker(14, 1), TALK)[1].startswith("00:05 Bob")
    assert [r["speaker_labels"] for r in TranscriptChunker(1000).chunks(TALK)] == [["Ann", "Bob"]]


def test_transcript_modes():
    notes = "00:01 first thought about this\n00:10 second thought\n\n[00:20] third one"
    rows = list(TranscriptChunker(5).chunks(notes))
    assert [r["attribution_type"] for r in rows] == ["temporal"] * 3 and all(r["speaker_labels"] == [] for r in rows)
    topics = "# Plans\nwe will go\n# Topic: Food\nwe will eat\n# Rest\nwe sleep"
    rows = list(TranscriptChunker(6, mode="topical").chunks(topics))
    assert [r["topic_label"] for r in rows] == ["Plans", "Food", "Rest"]
    assert {r["attribution_type"] for r in TranscriptChunker(6, mode="topical").chunks(notes)} == {"temporal"}
    assert next(TranscriptChunker().chunks(topics))["attribution_type"] == "topical"
    one = list(TranscriptChunker(1000).chunks("Note to self: buy milk\nAnn: hello"))
    assert one[0]["attribution_type"] == "speaker" and one[0]["speaker_labels"] == ["Ann", "Note to self"]
    assert [r["attribution_type"] for r in TranscriptChunker().chunks("[00:12] Alice: hi there")] == ["temporal"]


LOG = "\n".join(f"2024-01-15T10:30:0{i} INFO service step {i} {'more words here' if i in (1, 3) else 'x'}" for i in range(5))
TRACE = "2024-01-15 10:30:00 INFO start\n2024-01-15 10:30:01 ERROR boom happened\n\tat a.b(c)\n\tat d.e(f)\n\tat g.h(i)\n2024-01-15 10:30:02 INFO end"


def test_log_blocks_and_severity():
    rows = list(LogChunker(15).chunks(LOG))
    assert len(rows) == 3 and sum(r["word_count"] for r in rows) == Py.count(LOG)
    rows = list(LogChunker(50).chunks(TRACE))
    assert len(rows) == 1 and rows[0]["log_metadata"]["severity"] == "info" and rows[0]["timestamps"] == ["2024-01-15 10:30:00", "2024-01-15 10:30:01", "2024-01-15 10:30:02"]
    assert rows[0]["timestamp_range"] is None and rows[0]["log_metadata"]["timestamp_range"]["end"].endswith("02")
    assert any("\tat a.b(c)\n\tat d.e(f)" in t for t in texts(LogChunker(3), TRACE))


DIAGNOSTICS = [
    ("/x/A.swift:10:5: error: cannot find y", "swiftCompilerError", "error"),
    ("/x/A.swift:10: warning: unused", "swiftCompilerError", "warning"),
    ("/x/A.swift:10:5: error: cannot find testValue", "testFailure", "error"),
    ("Command CompileSwiftSources failed with a nonzero exit code", "xcodeBuildError", "error"),
    ("Undefined symbols for architecture arm64", "linkerError", "error"),
    ("Test Case '-[Suite testIt]' failed (0.1 seconds)", "testFailure", "error"),
    ("Main Thread Checker: UI API called app[12:34]", "runtimeWarning", "warning"),
    ("Fatal error: index out of range", "runtimeWarning", "fatal"),
    ("2024-01-15 10:30:00.123456+0000 app[12:34] [com.x.y] hello info", "simulatorLog", "info"),
    ("10:30:00.123+0000 app[12:34] [net] hello", "consoleLog", None),
    ("0 a 0x1\n1 b 0x2\n2 c 0x3", "stackTrace", None),
    ("just words", "unknown", None),
]


@pytest.mark.parametrize(("text", "kind", "severity"), DIAGNOSTICS)
def test_classification(text, kind, severity):
    got = classify(text)
    assert (got["kind"], got["severity"]) == (kind, severity)


def test_classification_columns_agree(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(DIAGNOSTICS)], "i int, t string").select("i", block_kind(F.col("t")).alias("k")).collect()
    for r in rows:
        assert r.k.asDict() == classify(DIAGNOSTICS[r.i][0])
    by = {r.i: r.k for r in rows}
    assert (by[8].process, by[8].subsystem, by[8].category) == ("app", "com.x.y", None) and by[9].category == "net" and by[6].process == "app"


def test_kind_change_cuts():
    text = "2024-01-15 10:00:00 Fatal error: a\n2024-01-15 10:00:01 x\n2024-01-15 10:00:02 Undefined symbols for architecture z"
    assert [r["log_metadata"]["kind"] for r in LogChunker(100).chunks(text)] == ["runtimeWarning", "linkerError"]


CRASH = """Incident Identifier: 1
Hardware Model: B9
Process: App [1]
Identifier: org.x
Version: 2
OS Version: 9

Exception Type: EXC_BAD_ACCESS (SIGSEGV)
Exception Codes: 0x1
Termination Reason:
Triggered by Thread: 0

Application Specific Information: told you

VM Region Info: 0x0

Thread 0 Crashed:
0   App   0x0000000100000001 main + 1
1   lib   0x0000000100000002 go + 2
2   lib   0x0000000100000003 on + 3

Thread 1:
0   lib   0x0000000100000004 wait + 4

Thread 0 crashed with ARM Thread State (64-bit):
  x0: 0x0

Binary Images:
0x1 - 0x2 App"""


def test_crash_report():
    rows = list(CrashReportChunker(2000).chunks(CRASH))
    assert [r["log_metadata"]["kind"] for r in rows] == ["crashHeader", "exceptionInfo", "diagnosticMessage", "diagnosticMessage", "crashedThread", "registers", "binaryImages"]
    fields = rows[0]["log_metadata"]["crash_report"]
    assert fields["signal"] == "SIGSEGV" and fields["crashed_thread"] == "0" and fields["termination_reason"] == "" and fields["hardware_model"] == "B9"
    assert fields["application_specific_information"] == "told you" and fields["symbolication_status"] == "fullySymbolicated"
    assert all(r["log_metadata"]["crash_report"] == fields and r["log_metadata"]["process"] == "App [1]" for r in rows)
    assert "Thread 1:" in rows[4]["text"]
    assert len(list(CrashReportChunker(2000, include_binary_images=False).chunks(CRASH))) == 6
    small = list(CrashReportChunker(5, preserve_crashed_thread=False).chunks(CRASH))
    assert sum(r["log_metadata"]["kind"] == "crashedThread" for r in small) > 1
    assert sum(r["log_metadata"]["kind"] == "crashedThread" for r in CrashReportChunker(5).chunks(CRASH)) == 1


def test_crash_variants():
    bare = CRASH.replace("main + 1", "0x100000000 + 1").replace("go + 2", "0x100000000 + 2").replace("on + 3", "0x100000000 + 3").replace("wait + 4", "0x100000000 + 4")
    assert next(CrashReportChunker().chunks(bare))["log_metadata"]["crash_report"]["symbolication_status"] == "unsymbolicated"
    assert [s.kind for s in crash_sections("plain words\nonly")] == ["crashHeader"]
    ips = '{\n"app_name": "x",\n"bundleID": "y",\n"exception": {},\n"threads": [\n1 ],\n"usedImages": []\n}'
    assert [r["log_metadata"]["kind"] for r in CrashReportChunker(500).chunks(ips)] == ["crashHeader", "exceptionInfo", "threadBacktrace", "binaryImages"]
    assert len(list(CrashReportChunker(500, include_binary_images=False).chunks(ips))) == 3


def test_markdown():
    three = "# A\na one\n# B\nb two\n# C\nc three"
    assert texts(MarkdownChunker(), three) == ["# A\n\na one", "# B\n\nb two", "# C\n\nc three"]
    deep = "# A\nx\n## B\ny\n### C\nz"
    assert len(texts(MarkdownChunker(max_heading_level=2), deep)) == 2
    assert texts(MarkdownChunker(), "intro\n#tag here") == ["intro", "#tag here"]
    long = list(MarkdownChunker(6).chunks("# Head\nOne two three. Four five six. Seven eight nine."))
    assert all(r["text"].startswith("# Head\n\n") for r in long) and len(long) > 1
    assert long[1]["source_word_range"]["start"] == long[0]["word_count"]


def located(chunker, text):
    return [(r["text"], r["document_location"]) for r in chunker.chunks(text)]


def test_document_structure():
    pages = "[page 1]\nfirst words\n--- page 2 ---\nsecond words\n=== page 3 ===\nthird\nPage 4:\nfourth\n[Page 5]\nfifth"
    (text, place), *rest = located(DocumentStructureChunker(1000), pages)
    assert not rest and "page" not in text.lower() and place["page_range"] == {"start": 1, "end": 5}
    code = "```\n# no heading\n[page 9]\n```\n# Real\nwords"
    text, place = located(DocumentStructureChunker(1000), code)[0]
    assert place["block_types"] == ["codeBlock", "heading", "paragraph"] and place["page_range"] is None
    mixed = "# T\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- x\n- y\n  more\n\n> q\n\n![c](u)\n\n[^1]: note\n\nSet\n===\ntext\n\n---\n\nSub\n---\nend"
    (_, place), *_ = located(DocumentStructureChunker(1000), mixed)
    assert place["block_types"] == ["heading", "table", "list", "blockQuote", "figureCaption", "footnote", "paragraph", "thematicBreak"]
    rows = located(DocumentStructureChunker(10), mixed)
    assert any("| a | b |\n|---|---|\n| 1 | 2 |" in t for t, _ in rows)
    assert rows[-1][1]["heading_path"][0] == "Set"


def test_document_headings_and_overlap():
    text = "# A\n\none two three four\n\n## B\n\nfive six seven eight"
    rows = located(DocumentStructureChunker(8), text)
    assert [p["heading_path"] for _, p in rows] == [["A"], ["A", "B"]] and rows[1][0].startswith("## B")
    over = list(DocumentStructureChunker(8, overlap_blocks=1).chunks(text))
    assert over[1]["text"].startswith("one two three four\n\n## B") and over[1]["document_location"]["heading_path"] == ["A"]
    listed = located(DocumentStructureChunker(1000), "- item\n===\nafter")
    assert listed[0][1]["block_types"][0] == "heading" and "list" in listed[0][1]["block_types"]
    assert located(DocumentStructureChunker(1000), "~~~\nopen fence")[0][1]["primary_block_type"] == "codeBlock"


def test_code_blocks():
    text = "intro words\n\n```\na b c d e f g h\n```\nafter\n~~~\nx\n~~~"
    rows = list(CodeBlockChunker(3).chunks(text))
    assert [r["document_location"]["primary_block_type"] for r in rows] == [None, "codeBlock", None, "codeBlock"]
    assert rows[1]["text"] == "```\na b c d e f g h\n```"
    assert texts(CodeBlockChunker(20), "a b\n\nc d") == ["a b\nc d"]
    assert [r["document_location"]["primary_block_type"] for r in CodeBlockChunker(20).chunks("  ```\nx\n  ```")] == [None]


@pytest.mark.parametrize("name", CHUNKERS)
def test_empty_text_gives_nothing(name, spark):
    assert list(CHUNKERS[name]().chunks("")) == []
    rows = spark.createDataFrame([(1, ""), (2, None), (3, " \n\t ")], "doc_id bigint, text string")
    assert chunk(rows, CHUNKERS[name]()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# H", "Ann: hi", "Bob: yo you", "00:12 x", "2024-01-15 10:30:00 ERROR e", "```", "", "- item", "plain words go on", "| a |", "> q", "---", "\tat a.b(c)", "Thread 0 Crashed:", "Process: x"]), max_size=25), st.integers(1, 12))
def test_every_word_is_in_a_chunk(lines, target):
    text = "\n".join(lines)
    for name in ("fixed", "sentence", "transcript", "log", "crash", "code"):
        rows = list(CHUNKERS[name](target).chunks(text))
        assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
        assert all(r["word_count"] == Py.count(r["text"]) for r in rows)
        assert [w for r in rows for w in WORD.findall(r["text"])] == WORD.findall(text), name


def test_columns_agree_with_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    for chunker in (FixedChunker(50, 7), SentenceChunker(40), SentenceChunker(40, 2), TranscriptChunker(60)):
        want = sorted((i, c["chunk_index"], c["text"], c["word_count"], c["source_word_range"]["start"], tuple(c["speaker_labels"])) for i, t in plain for c in chunker.chunks(t))
        got = sorted((r.doc_id, r.chunk_index, r.text, r.word_count, r.source_word_range.start, tuple(r.speaker_labels)) for r in chunk(docs, chunker).collect())
        assert got == want


def test_table_functions_in_sql(spark):
    register(spark)
    spark.createDataFrame([(1, "# A\na\n# B\nb"), (2, "")], "doc_id bigint, text string").createOrReplaceTempView("sql_docs")
    rows = spark.sql("SELECT d.doc_id, c.text FROM sql_docs d LEFT JOIN LATERAL chunk_markdown(d.text, '{\"target_words\": 50}') c ON true ORDER BY 1, c.chunk_index").collect()
    assert [tuple(r) for r in rows] == [(1, "# A\n\na"), (1, "# B\n\nb"), (2, None)]


def test_source_labels(spark):
    text = "2024-01-15 10:00:00 Command Ld failed\n"
    rows = chunk(spark.createDataFrame([(1, text), (2, CRASH), (3, "2024-01-15 10:30:00.1 app[1:2] hi")], "doc_id bigint, text string"), LogChunker())
    crash = chunk(spark.createDataFrame([(2, CRASH)], "doc_id bigint, text string"), CrashReportChunker())
    label = lambda df: [r.label for r in df.orderBy("doc_id", "chunk_index").select(source_label(F.struct(*df.columns)).alias("label")).collect()]
    found = label(rows)
    assert found[0] == "[Chunk 1, xcodeBuildError, Ld, error]" and found[-1] == "[Chunk 1, simulatorLog, app]"
    assert label(crash)[:2] == ["[Chunk 1, crashHeader, EXC_BAD_ACCESS (SIGSEGV)]", "[Chunk 2, exceptionInfo, EXC_BAD_ACCESS (SIGSEGV)]"]
    assert label(crash)[4] == "[Chunk 5, crashedThread, Thread 0]"
