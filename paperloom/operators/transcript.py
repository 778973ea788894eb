"""Transcript chunker: by speaker turns, by times, or by topics."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from paperloom.functions.schema import chunk_row, time_range
from paperloom.functions.text import SPEAKER, Py
from paperloom.operators.packing import spans

# Fixed patterns.
TURN = re.compile(r"^(?:(\d{1,2}:\d{2}(?::\d{2})?)\s+)?([A-Za-z][A-Za-z\s]{0,30}):\s", re.A)
BRACKETED_TIME = re.compile(r"^[\[\(]\d{1,2}:\d{2}(?::\d{2})?[\]\)]", re.A)
MODES = ("auto", "speaker", "temporal", "topical")
_SPEAKER = re.compile(SPEAKER)


@dataclass(frozen=True)
class Part:
    """A turn, a timed segment or a topic section."""

    text: str
    words: int
    times: list[str]
    speakers: list[str]
    topic: str | None = None


def _joined(lines: list[str]) -> tuple[str, int]:
    text = Py.strip("\n".join(lines))
    return text, Py.count(text)


def _runs(lines: list[str], starts: list[bool]) -> Iterator[list[str]]:
    """The lines cut before each line that starts a run; a run of blank lines joins the next one."""
    run: list[str] = []
    for line, begins in zip(lines, starts, strict=True):
        if begins and any(map(Py.strip, run)):
            yield run
            run = []
        run.append(line)
    if any(map(Py.strip, run)):
        yield run


def turns(text: str) -> list[Part]:
    lines = Py.lines(text)
    out = []
    for run in _runs(lines, [TURN.match(x) is not None for x in lines]):
        heads = [TURN.match(x) for x in run]
        head = next((m for m in heads if m), None)
        times = [t for line, m in zip(run, heads, strict=True) for t in ([m[1]] if m and m[1] else [] if m else Py.clock_times(line))]
        out.append(Part(*_joined(run), times, [Py.strip_blanks(head[2])] if head else []))
    return out


def segments(text: str) -> list[Part]:
    """Paragraphs, cut again at lines that start with a time; blank lines do not count."""
    out = []
    for paragraph in text.split("\n\n"):
        lines = [x for x in Py.lines(paragraph) if Py.strip_blanks(x)]
        found = [Py.clock_times(x) for x in lines]
        timed = [bool(t and Py.strip_blanks(x).startswith(t[0])) or BRACKETED_TIME.match(Py.strip_blanks(x)) is not None for x, t in zip(lines, found, strict=True)]
        for run in _runs(lines, timed):
            speakers = [m[2] for m in map(TURN.match, run) if m]
            out.append(Part(*_joined(run), [t for x in run for t in Py.clock_times(x)], list(map(Py.strip_blanks, speakers))))
    return out


def sections(text: str) -> list[Part]:
    """Lines from each heading on; the heading stays in the text."""
    lines = Py.lines(text)
    flags = [Py.topical(Py.strip_blanks(x)) for x in lines]
    out = []
    for run in _runs(lines, flags):
        head = next((x for x in run if Py.topical(Py.strip_blanks(x))), None)
        body, words = _joined(run)
        speakers = [Py.strip_blanks(s) for s in _SPEAKER.findall(body)]
        out.append(Part(body, words, Py.clock_times(body), speakers, Py.heading(Py.strip_blanks(head)) if head is not None else None))
    return out


@dataclass(frozen=True)
class TranscriptChunker:
    """``mode``: auto takes speakers if there are two, else topics if there are headings, else times.

    ``overlap_turns`` only holds between turns. Topics need two sections, or times are taken. Speakers are only
    named by times and topics if there are two in the whole text.
    """

    target_words: int = 1500
    overlap_turns: int = 0
    mode: str = "auto"

    def resolved(self, text: str, said: list[Part]) -> str:
        if self.mode != "auto":
            return self.mode
        if len({s for p in said for s in p.speakers}) >= 2:
            return "speaker"
        return "topical" if Py.topical(text) else "temporal"

    def chunks(self, text: str) -> Iterator[dict]:
        said = turns(text)
        if not said:
            return
        many = len({s for p in said for s in p.speakers}) >= 2
        mode, parts = self.resolved(text, said), said
        if mode == "topical":
            parts = sections(text)
            if len(parts) < 2:
                mode = "temporal"
        if mode == "temporal":
            parts = segments(text)
        offsets = [0]
        for p in parts:
            offsets.append(offsets[-1] + p.words)
        by_turn = mode == "speaker"
        for index, (a, b) in enumerate(spans([p.words for p in parts], max(1, self.target_words), max(0, self.overlap_turns) if by_turn else 0)):
            some = parts[a:b]
            times = [t for p in some for t in p.times]
            yield chunk_row(
                index, ("\n" if by_turn else "\n\n").join(p.text for p in some), offsets[b] - offsets[a], offsets[a],
                timestamps=times, timestamp_range=time_range(times), attribution_type=mode, topic_label=some[0].topic if mode == "topical" else None,
                speaker_labels=sorted({s for p in some for s in p.speakers}) if by_turn or many else [],
            )
