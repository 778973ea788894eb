"""Log and crash-report chunkers, and the classification of log blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.schema import CRASH_FIELDS, chunk_row, time_range
from paperloom.functions.text import Py

# ------------------------------------------------------------------------------------------------ fixed values
#: Lines that continue a stack trace.
FRAME_LINE = r"^[\t ]+(?:at |frame #|\d+\s+0x|[\w.]+\()"
#: Kind, pattern and severity (None: from the words of the block), the first that fits counts.
KINDS = (
    ("testFailure", r"(?i)(?:Test Case '.*' failed|XCTAssert\w+\s+failed|Executed \d+ tests?,|\.swift:\d+(?::\d+)?:\s*error:.*(?:XCT|test|assert))", "error"),
    ("linkerError", r"(?:Undefined symbols? for architecture|ld: symbol\(s\) not found|clang: error: linker command failed|duplicate symbol)", "error"),
    ("xcodeBuildError", r"(?:Command (?:SwiftCompile|CompileSwiftSources|PhaseScriptExecution|CodeSign|Ld) failed|BUILD FAILED|The following build commands failed)", "error"),
    ("swiftCompilerError", r"(?m)(?:^|\s)\S+\.swift:\d+(?::\d+)?:\s*(?:error|warning|note):", None),
    ("runtimeWarning", r"(?:Main Thread Checker:|Thread Sanitizer:|Address Sanitizer:|Undefined Behavior Sanitizer:|Publishing changes from background threads|Simultaneous accesses|Modifying state during view update|Could not cast value)", "warning"),
    ("fatal", r"(?:Fatal error:|assertionFailure|preconditionFailure)", "fatal"),
    ("simulatorLog", r"(?m)^\s*(?:default\s+)?\d{2,4}[-/]\d{2}[-/]\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+(?:[+-]\d{4})?\s+\S+\[\d+:\d+\]", None),
    ("consoleLog", r"(?m)^\s*\d{2}:\d{2}:\d{2}\.\d+[+-]\d{4}\s+\S+\[\d+:\d+\]", None),
)
APPLE_FRAME = r"(?m)^\d+\s+\S+\s+0x[0-9a-fA-F]+"
#: A crash report's section starts, in order of test: kind, pattern, whether the header ends there.
SECTION_STARTS = (
    ("binaryImages", r"^Binary Images:", False),
    ("registers", r"^Thread \d+\s+crashed with (?:ARM|[Xx]86)", False),
    ("lastExceptionBacktrace", r"^Last Exception Backtrace:", True),
    ("diagnosticMessage", r"^(?:Application Specific (?:Information|Backtrace|Signatures)|VM Region Info|Dyld Error Message|Crashing on exception):", True),
    ("crashedThread", r"^Thread \d+\s+Crashed", True),
    ("threadBacktrace", r"^Thread \d+(?:\s+name:|\s*:)", True),
)
HEADER_KEYS = frozenset((
    "Process", "Path", "Identifier", "Version", "Code Type", "Role", "Parent Process", "Coalition", "Date/Time", "Launch Time", "OS Version",
    "Release Type", "Report Version", "Hardware Model", "Baseband Version", "Incident Identifier", "CrashReporter Key",
))
EXCEPTION_KEYS = frozenset(("Exception Type", "Exception Subtype", "Exception Codes", "Exception Note", "Termination Reason", "Termination Description", "Triggered by Thread"))
SYMBOLICATED = r"\d+\s+\S+\s+0x[0-9a-fA-F]+\s+[A-Za-z_]"
UNSYMBOLICATED = r"\d+\s+\S+\s+0x[0-9a-fA-F]+\s+0x[0-9a-fA-F]+\s*\+"
THREAD_KINDS = ("crashedThread", "threadBacktrace", "lastExceptionBacktrace")
FRAME_START = r"^\d+\s+"
#: A key of a JSON report and the kind of section that it starts.
IPS_SECTIONS = (
    ('"app_name"', "crashHeader"), ('"bundleID"', "crashHeader"), ('"build_version"', "crashHeader"), ('"os_version"', "crashHeader"), ('"incident"', "crashHeader"),
    ('"crashReporterKey"', "crashHeader"), ('"exception"', "exceptionInfo"), ('"termination"', "diagnosticMessage"), ('"threads"', "threadBacktrace"),
    ('"usedImages"', "binaryImages"), ('"asi"', "diagnosticMessage"), ('"lastExceptionBacktrace"', "lastExceptionBacktrace"), ('"faultingThread"', "crashedThread"),
)
#: Crash fields that come from a header key and from an exception key.
FROM_HEADER = {"process": "Process", "identifier": "Identifier", "version": "Version", "hardware_model": "Hardware Model", "os_version": "OS Version"}
FROM_EXCEPTION = {
    "exception_type": "Exception Type", "exception_codes": "Exception Codes", "exception_subtype": "Exception Subtype", "termination_reason": "Termination Reason",
    "termination_description": "Termination Description", "application_specific_information": "Application Specific Information", "crashed_thread": "Triggered by Thread",
}
# ------------------------------------------------------------------------------------------------

_FRAME, _ISO = re.compile(FRAME_LINE), re.compile(T.ISO_TIME, re.A)
_KINDS = tuple((kind, re.compile(pattern), severity) for kind, pattern, severity in KINDS)
_APPLE_FRAME, _PROCESS, _SUBSYSTEM, _SIGNAL = (re.compile(p) for p in (APPLE_FRAME, T.PROCESS, T.PROCESS + r"(?:\s+\[([^\]]+)\])?", T.SIGNAL))
_SECTIONS = tuple((kind, re.compile(pattern), ends) for kind, pattern, ends in SECTION_STARTS)
_SYMBOLICATED, _UNSYMBOLICATED, _FRAME_START = map(re.compile, (SYMBOLICATED, UNSYMBOLICATED, FRAME_START))


def starts_block(line: Column) -> Column:
    """A log block starts at a line with an ISO time that is no stack frame."""
    return line.rlike(T.ISO_TIME) & ~line.rlike(FRAME_LINE)


def block_kind(text: Column) -> Column:
    """Kind, process, subsystem, category and severity of a log block as one struct."""
    nothing = F.lit(None).cast("string")
    subsystem, category = T.subsystem_or_category(text)
    frames = F.size(F.regexp_extract_all(text, F.lit(APPLE_FRAME), F.lit(0)))

    def row(kind: str, process: Column, sub: Column, cat: Column, severity: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), process.alias("process"), sub.alias("subsystem"), cat.alias("category"), severity.alias("severity"))

    out = F.when(frames >= 3, row("stackTrace", nothing, nothing, nothing, nothing)).otherwise(row("unknown", nothing, nothing, nothing, T.severity(text)))
    for kind, pattern, severity in reversed(KINDS):
        level = F.lit(severity) if severity else T.severity(text)
        logged = kind in ("simulatorLog", "consoleLog")
        process = T.process_name(text) if logged or kind == "runtimeWarning" else nothing
        out = F.when(text.rlike(pattern), row("runtimeWarning" if kind == "fatal" else kind, process, subsystem if logged else nothing, category if logged else nothing, level)).otherwise(out)
    return out


def classify(text: str) -> dict:
    """``block_kind`` for Python table functions."""
    out = dict.fromkeys(("kind", "process", "subsystem", "category", "severity"))
    kind, severity = next(((k, s) for k, p, s in _KINDS if p.search(text)), ("unknown", None))
    if kind == "unknown" and sum(1 for _ in _APPLE_FRAME.finditer(text)) >= 3:
        return out | {"kind": "stackTrace"}
    out |= {"kind": "runtimeWarning" if kind == "fatal" else kind, "severity": severity or Py.severity(text)}
    if kind in ("simulatorLog", "consoleLog", "runtimeWarning") and (m := _PROCESS.search(text)):
        out["process"] = m[1]
        if kind != "runtimeWarning" and (inside := _SUBSYSTEM.search(text)[2]):
            out["subsystem" if "." in inside else "category"] = inside
    return out


def log_blocks(text: str) -> list[str]:
    lines, runs = Py.lines(text), []
    for line in lines:
        if not runs or (_ISO.search(line) and not _FRAME.search(line) and Py.strip("\n".join(runs[-1]))):
            runs.append([])
        runs[-1].append(line)
    return [t for t in (Py.strip("\n".join(r)) for r in runs) if t]


@dataclass(frozen=True)
class LogChunker:
    """Blocks packed by words; a chunk holds one known kind at most. Its severity is its first block's that has one."""

    target_words: int = 1500

    def chunks(self, text: str) -> Iterator[dict]:
        blocks = log_blocks(text)
        facts = [classify(b) for b in blocks]
        sizes = [Py.count(b) for b in blocks]
        target, groups, total, known = max(1, self.target_words), [], 0, "unknown"
        for k, (fact, size) in enumerate(zip(facts, sizes, strict=True)):
            other = "unknown" not in (fact["kind"], known) and fact["kind"] != known
            if not groups or other or (total and total + size > target):
                groups.append([])
                total, known = 0, "unknown"
            groups[-1].append(k)
            total += size
            known = fact["kind"] if known == "unknown" else known
        offset = 0
        for index, group in enumerate(groups):
            times = [t for k in group for t in Py.block_times(blocks[k])]
            words = sum(sizes[k] for k in group)
            first = {f: next((facts[k][f] for k in group if facts[k][f] is not None), None) for f in ("process", "subsystem", "category", "severity")}
            kind = next((facts[k]["kind"] for k in group if facts[k]["kind"] != "unknown"), "unknown")
            yield chunk_row(index, "\n".join(blocks[k] for k in group), words, offset, timestamps=times, log_metadata={"kind": kind} | first | {"timestamp_range": time_range(times), "crash_report": None})
            offset += words


@dataclass
class Section:
    kind: str
    lines: list[str]


def _key(line: str) -> str | None:
    pair = Py.strip_blanks(line).partition(":")
    return Py.strip_blanks(pair[0]) if pair[1] else None


def crash_sections(text: str) -> list[Section]:
    """A line's section follows from its start, its key, and whether the header is still open.

    Once a crashed thread has begun, ``Thread N:`` lines belong to it.
    """
    out, header = [Section("crashHeader", [])], True

    def begin(kind: str) -> None:
        if any(map(Py.strip_blanks, out[-1].lines)):
            out.append(Section(kind, []))
        else:  # nothing but blank lines so far: they go
            out[-1] = Section(kind, [])

    for line in Py.lines(text):
        start = next(((kind, ends) for kind, pattern, ends in _SECTIONS if pattern.search(line) and not (kind == "threadBacktrace" and out[-1].kind == "crashedThread")), None)
        key = _key(line)
        if start:
            begin(start[0])
            header = header and not start[1]
        elif key in EXCEPTION_KEYS:
            if out[-1].kind != "exceptionInfo":
                begin("exceptionInfo")
            header = False
        elif header and not Py.strip_blanks(line) and out[-1].kind == "crashHeader" and any(_key(x) in HEADER_KEYS for x in out[-1].lines):
            begin("crashHeader")
            header = False
        out[-1].lines.append(line)
    return [s for s in out if any(map(Py.strip_blanks, s.lines))]


def crash_fields(sections: list[Section]) -> dict:
    pairs = lambda *kinds: [p for s in sections if s.kind in kinds for p in map(Py.key_value, s.lines) if p]
    header = {k: v for k, v in pairs("crashHeader") if k in HEADER_KEYS}
    note = "Application Specific Information"
    exception = dict(pairs("exceptionInfo")) | {k: v for k, v in pairs("diagnosticMessage") if k == note}
    out = dict.fromkeys(CRASH_FIELDS)
    out |= {f: header.get(k) for f, k in FROM_HEADER.items()} | {f: exception.get(k) for f, k in FROM_EXCEPTION.items()}
    found = _SIGNAL.search(out["exception_type"] or "")
    frames = [x for s in sections if s.kind in THREAD_KINDS for x in s.lines]
    named = sum(_SYMBOLICATED.search(x) is not None for x in frames)
    bare = sum(_SYMBOLICATED.search(x) is None and _UNSYMBOLICATED.search(x) is not None for x in frames)
    share = named / (named + bare) if named + bare >= 3 else None
    status = "unknown" if share is None else "fullySymbolicated" if share >= 0.8 else "partiallySymbolicated" if share >= 0.3 else "unsymbolicated"
    return out | {"signal": found[1] if found else None, "symbolication_status": status}


def _frame_groups(lines: list[str], target: int) -> Iterator[list[str]]:
    """Lines packed by words, cut only before stack frames."""
    group, total = [], 0
    for line in lines:
        size = Py.count(line)
        if total and total + size > target and _FRAME_START.search(line):
            yield group
            group, total = [], 0
        group.append(line)
        total += size
    yield group


@dataclass(frozen=True)
class CrashReportChunker:
    """Sections of a crash report; each chunk carries the report's fields.

    A JSON report is cut where the kind of its keys changes and only carries the kind.
    """

    target_words: int = 1500
    preserve_crashed_thread: bool = True
    include_binary_images: bool = True

    def chunks(self, text: str) -> Iterator[dict]:
        ips = sum(k in text for k in T.IPS_KEYS) >= 2
        sections = self._ips_sections(text) if ips else crash_sections(text)
        fields = None if ips else crash_fields(sections)
        index = offset = 0
        for section in sections:
            if section.kind == "binaryImages" and not self.include_binary_images:
                continue
            whole = ips or section.kind == "lastExceptionBacktrace" or (section.kind == "crashedThread" and self.preserve_crashed_thread)
            target = max(1, self.target_words)
            groups = [section.lines] if whole or Py.count("\n".join(section.lines)) <= target else _frame_groups(section.lines, target)
            for lines in groups:
                body = Py.strip("\n".join(lines))
                if body:
                    words = Py.count(body)
                    log = dict.fromkeys(("process", "subsystem", "category", "severity", "timestamp_range")) | {"kind": section.kind, "process": fields and fields["process"], "crash_report": fields}
                    yield chunk_row(index, body, words, offset, log_metadata=log)
                    index, offset = index + 1, offset + words

    @staticmethod
    def _ips_sections(text: str) -> list[Section]:
        kind, marked = "crashHeader", []
        for line in Py.lines(text):
            kind = next((k for key, k in IPS_SECTIONS if key in line), kind)
            marked.append((kind, line))
        return [Section(k, [x for _, x in run]) for k, run in groupby(marked, key=lambda m: m[0])]


def source_label(chunk: Column) -> Column:
    """``[Chunk N, kind, detail, severity]`` of a chunk struct; what repeats an earlier part is left out."""
    log, number = chunk["log_metadata"], F.concat(F.lit("Chunk "), (chunk["chunk_index"] + 1).cast("string"))
    kind = log["kind"]
    some = lambda c: F.nullif(c, F.lit(""))
    crash = log["crash_report"]
    detail = F.when(kind.isin("exceptionInfo", "crashHeader"), some(crash["exception_type"])).when(kind == "crashedThread", F.concat(F.lit("Thread "), some(crash["crashed_thread"])))
    process = F.when(kind.isin("simulatorLog", "consoleLog", "runtimeWarning"), some(log["process"]))
    build = F.when(kind == "xcodeBuildError", T.build_command(chunk["text"])).when(kind == "testFailure", T.test_name(chunk["text"]))
    level = F.when(kind.isin("xcodeBuildError", "swiftCompilerError", "testFailure"), some(log["severity"]))
    before = lambda c, *seen: F.when(~F.array_contains(F.filter(F.array(*seen), lambda x: x.isNotNull()), c), c)
    named = F.when(kind != "unknown", kind)
    parts = [number, named, detail, before(process, number, named, detail), build, before(level, number, named, detail, process, build)]
    return F.concat(F.lit("["), F.when(log.isNull(), number).otherwise(F.concat_ws(", ", *parts)), F.lit("]"))


def labelled_text(chunk: Column) -> Column:
    return F.concat(source_label(chunk), F.lit("\n"), chunk["text"])


__all__ = ["CrashReportChunker", "LogChunker", "block_kind", "classify", "crash_sections", "labelled_text", "log_blocks", "source_label", "starts_block"]
