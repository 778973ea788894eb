"""Text primitives: Column expressions, and the same rules in Python for the table functions.

Patterns avoid look-around and name their character classes, so that they mean the same in Java, Python and RE2.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, the members of a character class.
SPACES = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NEWLINES = r"\n-\r\x{85}\x{2028}\x{2029}"
#: White space within a line.
BLANKS = r"\t \x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"

# Fixed patterns.
CLOCK = r"\b\d{1,2}:\d{2}(?::\d{2})?\b"
ISO_TIME = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
SPEAKER = r"(?m)^\s*(?:\d{1,2}:\d{2}(?::\d{2})?\s+)?([A-Za-z][A-Za-z\s]{0,30}):"
SENTENCE_END = r"([.!?]+[)\"]*)[ \t]+([^a-z \t\n])"
PAGE_MARKS = (r"(?i)^\[page\s+(\d+)\]$", r"(?i)^-{3,}\s*page\s+(\d+)\s*-{3,}$", r"(?i)^={3,}\s*page\s+(\d+)\s*={3,}$", r"(?i)^page\s+(\d+)\s*:$")
SIGNAL = r"\((\w+)\)"
PROCESS = r"(\S+)\[\d+:\d+\]"
SUBSYSTEM = r"\S+\[\d+:\d+\]\s+\[([^\]]+)\]"
BUILD_COMMAND = r"Command (\w+) failed"
TEST_NAME = r"Test Case '(?:-\[)?(\S+?)(?:\])?' failed"
ATX_HEADING = r"^(#{1,6})\s+(.+)$"
#: Any of these makes a text topical and a line a heading.
TOPIC_HEADINGS = (r"(?m)^#{1,3}\s+.+", r"(?m)^\*\*.+\*\*\s*$", r"(?m)^[A-Z][A-Z\s]{2,40}$", r"(?m)^(?:Topic|Section|Chapter|Part)\s*:\s*.+")
LABEL_PREFIXES = ("Topic", "Section", "Chapter", "Part")
#: A severity and the words that mean it, most severe first.
SEVERITIES = (("fatal", ("fatal",)), ("error", ("error",)), ("warning", ("warning", "warn")), ("info", ("info",)), ("debug", ("debug",)))
CRASH_MARKERS = ("Process:", "Identifier:", "Exception Type:", "Termination Reason:", "Triggered by Thread:", "Binary Images:", "Incident Identifier:", "Hardware Model:", "OS Version:")
IPS_KEYS = ('"app_name"', '"bundleID"', '"os_version"', '"exception"', '"termination"', '"incident"', '"crashReporterKey"')
TOKENS_PER_WORD = 1.33
LEAST_TOKENS_PER_WORD = 0.1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once however often it is named, wherever the optimizer moves it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalised(text: Column) -> Column:
    """Line ends as a single newline; a null text as an empty one. Done once where texts come in."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n")


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^[{SPACES}]+", ""), f"[{SPACES}]+$", "")


def clock_times(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CLOCK), F.lit(0))


def block_times(text: Column) -> Column:
    """ISO times, or clock times where there are none."""
    return let(F.regexp_extract_all(text, F.lit(ISO_TIME), F.lit(0)), lambda iso: F.when(F.size(iso) > 0, iso).otherwise(clock_times(text)))


def speaker_labels(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(SPEAKER), F.lit(1)), trimmed)))


def first_and_last(times: Column) -> Column:
    return F.when(F.size(times) > 0, F.struct(F.element_at(times, 1).alias("start"), F.element_at(times, -1).alias("end")))


def sentences(text: Column) -> Column:
    """Sentences of a text: a documented subset of what a locale's segmenter does.

    A sentence ends at a newline, or at ``.!?`` with closing brackets or quotes and blanks if no lower-case letter
    follows. "Dr. Smith" is therefore cut.
    """
    marked = F.regexp_replace(text, SENTENCE_END, "$1\x01$2")
    found = F.filter(F.transform(F.split(marked, "[\x01\n]"), trimmed), lambda s: s != "")
    return let(found, lambda x: F.when((F.size(x) == 0) & (trimmed(text) != ""), F.array(trimmed(text))).otherwise(x))


def estimated_tokens(n_words: Column, tokens_per_word: float = TOKENS_PER_WORD) -> Column:
    return F.greatest(F.lit(1).cast("long"), (n_words.cast("double") * F.lit(max(LEAST_TOKENS_PER_WORD, tokens_per_word))).cast("long"))


def severity(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for name, marks in reversed(SEVERITIES):
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.contains(low, F.lit(mark))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def _first_group(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def signal(exception_type: Column) -> Column:
    return _first_group(exception_type, SIGNAL)


def process_name(text: Column) -> Column:
    return _first_group(text, PROCESS)


def subsystem_or_category(text: Column) -> tuple[Column, Column]:
    """What stands in brackets after the first process: a subsystem if it has a dot, else a category."""
    found = _first_group(F.regexp_extract(text, PROCESS + r"(?:\s+\[[^\]]+\])?", 0), SUBSYSTEM)
    dotted = F.contains(found, F.lit("."))
    return F.when(dotted, found), F.when(~dotted, found)


def build_command(text: Column) -> Column:
    return _first_group(text, BUILD_COMMAND)


def test_name(text: Column) -> Column:
    return _first_group(text, TEST_NAME)


def page_number(line: Column) -> Column:
    return F.coalesce(*[_first_group(line, p).cast("long") for p in PAGE_MARKS])


def atx_level(line: Column) -> Column:
    """Level of a heading with a blank after its marks, else null."""
    return F.nullif(F.length(F.regexp_extract(line, ATX_HEADING, 1)), F.lit(0)).cast("long")


def mark_level(line: Column) -> Column:
    """Level of a line that starts with 1 to 6 marks, with or without a blank, else null."""
    n = F.length(F.regexp_extract(trimmed(line), "^#+", 0))
    return F.when(n.between(1, 6), n.cast("long"))


def has_topics(text: Column) -> Column:
    out = F.lit(False)
    for pattern in TOPIC_HEADINGS:
        out = out | text.rlike(pattern)
    return out


def clean_heading(line: Column) -> Column:
    bare = trimmed(F.regexp_replace(line, "^#+", ""))
    bold = F.regexp_replace(bare, r"(?s)^\*\*(.*)\*\*$", "$1")
    return trimmed(F.regexp_replace(bold, rf"(?s)^\s*(?:{'|'.join(LABEL_PREFIXES)})\s*:(.*)$", "$1"))


def key_value(line: Column) -> Column:
    """Key and value around the first colon, null without a key; an empty value stays empty."""
    bare = trimmed(line)
    at = F.locate(":", bare)
    key = trimmed(F.substring(bare, F.lit(1), at - 1))
    return F.when((at > 0) & (key != ""), F.struct(key.alias("key"), trimmed(F.substring(bare, at + 1, F.length(bare))).alias("value")))


def marker_count(text: Column, markers: tuple[str, ...]) -> Column:
    return sum((F.contains(text, F.lit(m)).cast("int") for m in markers), F.lit(0))


def is_crash_report(text: Column) -> Column:
    return marker_count(text, CRASH_MARKERS) >= 3


def is_ips(text: Column) -> Column:
    return marker_count(text, IPS_KEYS) >= 2


# ---------------------------------------------------------------- the same rules for Python table functions


def python_class(members: str) -> str:
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", members)


WORD = re.compile(f"[^{python_class(SPACES)}]+")
_LINE_END = re.compile(f"[{python_class(NEWLINES)}]")
_EDGES = "".join(c for c in map(chr, range(0x3001)) if not WORD.match(c))
_BLANK_EDGES = re.compile(f"^[{python_class(BLANKS)}]+|[{python_class(BLANKS)}]+\\Z")
_CLOCK, _ISO, _SPEAKER = re.compile(CLOCK, re.A), re.compile(ISO_TIME, re.A), re.compile(SPEAKER)
_TOPICS = tuple(map(re.compile, TOPIC_HEADINGS))
_SENTENCE_END = re.compile(SENTENCE_END)


class Py:
    """The Column rules above on Python strings."""

    @staticmethod
    def count(text: str) -> int:
        return len(WORD.findall(text))

    @staticmethod
    def lines(text: str) -> list[str]:
        return _LINE_END.split(text)

    @staticmethod
    def strip(text: str) -> str:
        return text.strip(_EDGES)

    @staticmethod
    def strip_blanks(text: str) -> str:
        return _BLANK_EDGES.sub("", text)

    @staticmethod
    def clock_times(text: str) -> list[str]:
        return _CLOCK.findall(text)

    @staticmethod
    def block_times(text: str) -> list[str]:
        return _ISO.findall(text) or _CLOCK.findall(text)

    @staticmethod
    def speakers(text: str) -> list[str]:
        return sorted({Py.strip(s) for s in _SPEAKER.findall(text)})

    @staticmethod
    def topical(text: str) -> bool:
        return any(p.search(text) for p in _TOPICS)

    @staticmethod
    def sentences(text: str) -> list[str]:
        parts = re.split("[\x01\n]", _SENTENCE_END.sub("\\1\x01\\2", text))
        found = [s for s in map(Py.strip, parts) if s]
        return found or [s for s in [Py.strip(text)] if s]

    @staticmethod
    def severity(text: str) -> str | None:
        low = text.lower()
        return next((name for name, marks in SEVERITIES if any(m in low for m in marks)), None)

    @staticmethod
    def heading(line: str) -> str:
        bare = Py.strip_blanks(line.lstrip("#"))
        if len(bare) >= 2 and bare.startswith("**") and bare.endswith("**"):
            bare = bare[2:-2]
        label, colon, rest = bare.partition(":")
        return Py.strip(rest if colon and Py.strip_blanks(label) in LABEL_PREFIXES else bare)

    @staticmethod
    def key_value(line: str) -> tuple[str, str] | None:
        key, colon, value = Py.strip_blanks(line).partition(":")
        return (Py.strip_blanks(key), Py.strip_blanks(value)) if colon and Py.strip_blanks(key) else None
