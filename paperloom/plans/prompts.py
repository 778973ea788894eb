"""Prompt text as Column expressions, and the built-in templates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T


def _lit(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def _attribute(name: str, value: Column) -> Column:
    """`` name="value"``, or null; values are put in as they are."""
    return F.concat(F.lit(f'{name}="'), value, F.lit('"'))


def _pair(range_: Column) -> Column:
    return F.concat(range_["start"].cast("string"), F.lit("-"), range_["end"].cast("string"))


def attributes(chunk: Column) -> Column:
    """The metadata of a chunk that are there, in their fixed order, separated by blanks."""
    place, log = chunk["document_location"], chunk["log_metadata"]
    listed = lambda c, sep: F.when(F.size(c) > 0, F.array_join(c, sep))
    return F.concat_ws(
        " ",
        _attribute("speaker", listed(chunk["speaker_labels"], ", ")),
        _attribute("time", _pair(chunk["timestamp_range"])),
        _attribute("heading", listed(place["heading_path"], " > ")),
        _attribute("block", place["primary_block_type"]),
        _attribute("pages", _pair(place["page_range"])),
        _attribute("logKind", log["kind"]),
        _attribute("severity", log["severity"]),
    )


def map_prompt(task: Column | str, chunk: Column, total: Column, style: str = "raw") -> Column:
    if style == "raw":
        return F.concat(_lit(task), chunk["text"])
    head = F.concat(_attribute("index", chunk["chunk_index"].cast("string")), F.lit(" "), _attribute("of", total.cast("string")), F.lit(" "), _attribute("words", _pair(chunk["source_word_range"])))
    more = attributes(chunk)
    return F.concat(_lit(task), F.lit("\n\n<source "), head, F.when(more != "", F.concat(F.lit(" "), more)).otherwise(F.lit("")), F.lit(">\n"), chunk["text"], F.lit("\n</source>"))


def format_summaries(summaries: Column) -> Column:
    total = F.size(summaries).cast("string")
    each = F.transform(summaries, lambda s, i: F.concat(F.lit("--- Section "), (i + 1).cast("string"), F.lit(" of "), total, F.lit(" ---\n"), s))
    return F.array_join(each, "\n\n")


def format_texts(summaries: list[str]) -> str:
    """``format_summaries`` in Python."""
    return "\n\n".join(f"--- Section {i} of {len(summaries)} ---\n{s}" for i, s in enumerate(summaries, 1))


def map_text(task: str, chunk: dict, total: int, style: str = "raw") -> str:
    """``map_prompt`` in Python."""
    if style == "raw":
        return task + chunk["text"]
    place, log, words = chunk["document_location"] or {}, chunk["log_metadata"] or {}, chunk["source_word_range"]
    pair = lambda r: f"{r['start']}-{r['end']}" if r and r["start"] is not None and r["end"] is not None else None
    known = {
        "speaker": ", ".join(chunk["speaker_labels"]) if chunk["speaker_labels"] else None, "time": pair(chunk["timestamp_range"]), "heading": " > ".join(place["heading_path"]) if place.get("heading_path") else None,
        "block": place.get("primary_block_type"), "pages": pair(place.get("page_range")), "logKind": log.get("kind"), "severity": log.get("severity"),
    }
    more = "".join(f' {k}="{v}"' for k, v in known.items() if v is not None)
    return f'{task}\n\n<source index="{chunk["chunk_index"]}" of="{total}" words="{pair(words)}"{more}>\n{chunk["text"]}\n</source>'


def reduce_text(task: str, summaries: list[str], style: str = "raw") -> str:
    """``reduce_prompt`` in Python."""
    combined = format_texts(summaries)
    return task + combined if style == "raw" else f'{task}\n\n<summaries count="{len(summaries)}">\n{combined}\n</summaries>'


def reduce_prompt(task: Column | str, summaries: Column, style: str = "raw") -> Column:
    combined = format_summaries(summaries)
    if style == "raw":
        return F.concat(_lit(task), combined)
    return F.concat(_lit(task), F.lit('\n\n<summaries count="'), F.size(summaries).cast("string"), F.lit('">\n'), combined, F.lit("\n</summaries>"))


def stuff_prompt(task: Column | str, text: Column, style: str = "raw", chunk: Column | None = None) -> Column:
    if style == "raw":
        return F.concat(_lit(task), text)
    more = F.lit("") if chunk is None else attributes(chunk)
    return F.concat(_lit(task), F.lit('\n\n<source words="0-'), T.word_count(text).cast("string"), F.lit('"'), F.when(more != "", F.concat(F.lit(" "), more)).otherwise(F.lit("")), F.lit(">\n"), text, F.lit("\n</source>"))


def stuff_text(task: str, text: str, style: str = "raw") -> str:
    """``stuff_prompt`` in Python."""
    return task + text if style == "raw" else f'{task}\n\n<source words="0-{T.Py.count(text)}">\n{text}\n</source>'


@dataclass(frozen=True)
class Template:
    map_prompt: str
    reduce_prompt: str
    stuff_prompt: str | None = None


_CITE = "Cite the chunk labels, such as [Chunk 3], that support each point.\n\n"


def _template(part: str, whole: str) -> Template:
    """Asks for ``part`` of one chunk, and for ``whole`` of all summaries or of the text at once."""
    return Template(f"{part} This is one part of a longer text; report only what it says.\n\n", f"{whole} Below are notes on the parts, in order. {_CITE}", f"{whole} The whole text follows.\n\n")


TEMPLATES: dict[str, Template] = {
    "transcriptSummary": _template("Note who said what, decisions and open questions.", "Write a summary of the conversation by topic."),
    "actionItems": _template("List each task with its owner and date, if given.", "Merge the tasks into one list without repeats."),
    "logRootCause": _template("List errors and warnings with their times and likely causes.", "Name the most likely root cause and the events that led to it."),
    "markdownBrief": _template("Note the main statements under each heading.", "Write a brief that follows the document's headings."),
    "voiceNoteSummary": _template("Note ideas, plans and reminders.", "Summarise the voice note in the speaker's order."),
    "lectureBrief": _template("Note concepts, definitions and examples.", "Write study notes of the lecture."),
    "appleCrashTriage": _template("Note the exception, the crashed thread's top frames and messages.", "Triage the crash: what failed, where, and what to look at first."),
    "simulatorLogRootCause": _template("Note faults by process and subsystem with their times.", "Name the likely root cause in the simulator's log."),
    "xcodeBuildFailure": _template("Note compiler and linker errors with file and line.", "Say which error broke the build and how to mend it."),
    "testFailureAnalysis": _template("Note failed tests with their assertions.", "Group the failures by likely cause."),
    "personalMemoActions": _template("Note things to do, people and dates.", "Write the to-do list of the memo."),
}


def template_table(spark: SparkSession) -> DataFrame:
    rows = [(k, t.map_prompt, t.reduce_prompt, t.stuff_prompt) for k, t in TEMPLATES.items()]
    return spark.createDataFrame(rows, "name string, map_prompt string, reduce_prompt string, stuff_prompt string")
