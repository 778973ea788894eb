"""Structured texts made from the test tables: transcripts, logs, Markdown, JSON, crash reports, mixed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _ordered(lines: Column, *order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, lines.alias("line")))), lambda x: x["line"]), "\n")


def transcript_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text for each conversation: ``MM:00 Role: words`` for each turn."""
    line = F.concat(F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit(":00 "), F.initcap("role"), F.lit(": "), F.replace("text", F.lit("\n"), F.lit(" ")))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(_ordered(line, "turn").alias("text"))


def log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log for each user, with a stack frame under each error."""
    failed = F.col("event_type") == "error"
    frame = F.when(failed, F.concat(F.lit("\n\tat app.handler("), F.col("event_id").cast("string"), F.lit(")"))).otherwise("")
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(failed, " ERROR ").otherwise(" INFO "), F.col("event_type"), F.lit(" value="), (F.col("value") * 100).cast("long").cast("string"), frame,
    )
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(_ordered(line, "ts", "event_id").alias("text"))


def _title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<h1>(.*?)</h1>", 1)


def _paragraphs(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1)), lambda p: F.regexp_replace(p, "<[^>]+>", ""))


def markdown_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(F.lit("# "), _title(html), F.lit("\n\n"), F.array_join(_paragraphs(html), "\n\n")).alias("text"))


def structure_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a document with page marks, headings, a table, code, a list, a quote, a rule, a figure and a note."""
    body = F.array_join(F.transform(_paragraphs(F.col("html")), lambda p, i: F.concat(F.lit("[page "), (i + 1).cast("string"), F.lit("]\n## Part "), (i + 1).cast("string"), F.lit("\n"), p)), "\n\n")
    more = "\n\n| key | value |\n|---|---|\n| page | here |\n\n```\n# not a heading\nrun()\n```\n\n- first item\n- second item\n\n> quoted words\n\n---\n\n![a figure](f.png)\n\n[^1]: a note\n\nTitle\n=====\nlast words"
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(F.lit("# "), _title(F.col("html")), F.lit("\n\n"), body, F.lit(more)).alias("text"))


def json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each event: prose around fenced JSON; every fifth lacks a field, every seventh is cut."""
    number = F.col("event_id")
    user = F.when(number % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(', "user": '), F.col("user_id").cast("string")))
    close = F.when(number % 7 == 0, F.lit("")).otherwise(F.lit(', "note": "a } in a string"}\n```\nDone.'))
    answer = F.concat(F.lit('Here it is:\n```json\n{"kind": "'), F.col("event_type"), F.lit('"'), user, close)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", answer.alias("text"))


def crash_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crash report for each supplier."""
    number = F.col("s_suppkey").cast("string")
    parts = [
        F.lit("Incident Identifier: 00-"), number, F.lit("\nHardware Model: Board9,1\nProcess: app"), number, F.lit(" [12]\nIdentifier: org.example.app\nVersion: 1.0\nOS Version: 9.1\n\nException Type: EXC_BAD_ACCESS (SIGSEGV)\nException Codes: 0x1\nTriggered by Thread: 0\n\nApplication Specific Information: note "), number,
        F.lit("\n\nThread 0 Crashed:\n0   app   0x0000000100000001 main + 1\n1   lib   0x0000000100000002 start + 2\n2   lib   0x0000000100000003 0x100000000 + 3\n\nThread 1:\n0   lib   0x0000000100000004 wait + 4\n\nThread 0 crashed with ARM Thread State (64-bit):\n    x0: 0x1   x1: 0x2\n\nBinary Images:\n0x100000000 - 0x100001000 app"), number,
    ]
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("supp_id"), F.concat(*parts).alias("text"))


#: A log block of each kind; @ is the number of the supplier whose log it is.
KIND_BLOCKS = (
    "2024-01-02 03:04:01 Test Case 'AppTests.testLogin@' failed (0.1 seconds).",
    "2024-01-02 03:04:02 Undefined symbols for architecture arm64",
    "2024-01-02 03:04:03 Command SwiftCompile failed with a nonzero exit code",
    "2024-01-02 03:04:04 compile\n/src/File@.swift:12:5: warning: unused value",
    "2024-01-02 03:04:05 app@[12:34] Main Thread Checker: interface call",
    "2024-01-02 03:04:06 Fatal error: index out of range",
    "2024-01-02 03:04:07.123+0100 board@[55:66] [com.example.ui] debug layout",
    "2024-01-02 03:04:08.5 board@[5:6] [layout] info pass",
    "2024-01-02 03:04:09 console\n03:04:09.1+0000 netd[7:8] [net.example] fatal drop",
    "2024-01-02 03:04:10 trace\n0   app   0x0000000100000001 main\n1   lib   0x0000000100000002 start\n2   lib   0x0000000100000003 wait",
    "2024-01-02 03:04:11 info started @",
    "2024-01-02 03:04:12 debug stopped",
)


def _of_supplier(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    number = F.col("s_suppkey").cast("string")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("supp_id"), F.replace(F.lit(text), F.lit("@"), number).alias("text"))


def kind_log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each supplier with a block of each kind."""
    return _of_supplier(spark, sf_dir, "\n".join(KIND_BLOCKS))


#: The lines of a JSON crash report.
JSON_REPORT = ('{"app_name":"app@",', '"bundleID": "org.example",', '"exception":"EXC @",', '"faultingThread":0,', '"threads":[', '{"frame": 1}],', '"usedImages":[1]}')


def json_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_supplier(spark, sf_dir, "\n".join(JSON_REPORT))


def topic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each supplier: with headings of every kind, by fives one without headings and one that is empty."""
    number, key = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 5
    topics = "# Intro @\nfirst words here\n**Bold Part**\nmore and more\nPLAIN CAPS\nx y\nTopic: Last one\nz at 10:30 z"
    text = F.when(key == 3, F.lit("")).when(key == 4, F.lit("just one line @\n01:02 another line")).otherwise(F.lit(topics))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("supp_id"), F.replace(text, F.lit("@"), number).alias("text"))
