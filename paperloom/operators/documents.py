"""Chunkers for Markdown, page-marked documents and code-heavy notes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from paperloom.functions import text as T
from paperloom.functions.schema import chunk_row
from paperloom.functions.text import Py
from paperloom.operators.packing import spans

# ------------------------------------------------------------------------------------------------ fixed values
FENCE = r"^(`{3,}|~{3,})"
SETEXT = {"=": 1, "-": 2}
SETEXT_LINE = r"^(?:={3,}|-{3,})\s*$"
RULE_LINE = r"^(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$"
TABLE_ROW = r"^\|.+\|$"
QUOTE = r"^>\s?"
LIST_ITEM = r"^\s*(?:[-*+]|\d+[.)])\s"
LIST_MORE = r"^\s{2,}\S"
#: Lines that are blocks by themselves.
SINGLE = (("figureCaption", r"^!\[.+\]\(.+\)$"), ("footnote", r"^\[\^.+\]:\s"))
#: Block types that never name a chunk.
PLAIN = ("paragraph", "unknown", "thematicBreak")
# ------------------------------------------------------------------------------------------------

_FENCE, _SETEXT, _RULE, _ROW, _QUOTE, _ITEM, _MORE, _ATX = (re.compile(p) for p in (FENCE, SETEXT_LINE, RULE_LINE, TABLE_ROW, QUOTE, LIST_ITEM, LIST_MORE, T.ATX_HEADING))
_SINGLE = tuple((kind, re.compile(p)) for kind, p in SINGLE)
_PAGES = tuple(map(re.compile, T.PAGE_MARKS))


def page_number(line: str) -> int | None:
    return next((int(m[1]) for m in (p.search(line) for p in _PAGES) if m), None)


@dataclass
class Block:
    kind: str
    text: str
    words: int
    page: int | None
    path: list[str]
    start: int


@dataclass
class _Open:
    """A block whose lines are being gathered. A paragraph's place is where it ends, others' where they begin."""

    kind: str
    lines: list[str]
    page: int | None
    path: list[str]
    start: int


@dataclass
class BlockScanner:
    """Reads lines into blocks. One block is open at a time; a fence suppresses everything until it closes."""

    blocks: list[Block] = field(default_factory=list)
    headings: list[tuple[int, str]] = field(default_factory=list)
    page: int | None = None
    at: int = 0
    open: _Open | None = None
    fence: tuple[str, int] | None = None
    #: The line before, unless it was blank, a heading, a rule, a page mark or a fence.
    before: str | None = None

    def path(self) -> list[str]:
        return [t for _, t in self.headings]

    def emit(self, kind: str, text: str, words: int | None = None) -> None:
        words = Py.count(text) if words is None else words
        self.blocks.append(Block(kind, text, words, self.page, self.path(), self.at))
        self.at += words

    def begin(self, kind: str, line: str) -> None:
        self.open = _Open(kind, [line], self.page, self.path(), self.at)

    def close(self) -> None:
        if self.open is None:
            return
        o, self.open = self.open, None
        text = "\n".join(o.lines)
        if o.kind == "paragraph":
            if Py.strip(text):
                self.emit("paragraph", Py.strip(text))
            return
        words = Py.count(text)
        self.blocks.append(Block(o.kind, text, words, o.page, o.path, o.start))
        self.at = o.start + words

    def heading(self, level: int, title: str, text: str) -> None:
        while self.headings and self.headings[-1][0] >= level:
            self.headings.pop()
        self.headings.append((level, title))
        self.emit("heading", text)

    def gather(self, kind: str, line: str, bare: str) -> None:
        if self.open is not None and self.open.kind == kind:
            self.open.lines.append(line)
        else:
            self.close()
            self.begin(kind, line)
        self.before = bare

    def read(self, line: str) -> None:
        bare = Py.strip_blanks(line)
        fence = _FENCE.match(bare)
        if self.fence:
            self.open.lines.append(line)
            if fence and len(fence[1]) >= self.fence[1] and not bare.strip(self.fence[0]):
                self.fence = None
                self.close()
            return
        if fence:
            self.close()
            self.fence = fence[1][0], len(fence[1])
            self.begin("codeBlock", line)
            self.before = None
        elif not bare:
            self.close()
            self.before = None
        elif (page := page_number(bare)) is not None:
            self.close()
            self.page, self.before = page, None
        elif atx := _ATX.match(bare):
            self.close()
            self.heading(len(atx[1]), Py.strip_blanks(atx[2]), bare)
            self.before = None
        elif self.before is not None and _SETEXT.match(bare):
            self._underlined(bare)
        elif self.before is None and _RULE.match(bare):
            if self.open is not None and self.open.kind == "paragraph":
                self.close()
            self.emit("thematicBreak", bare, 0)
        elif _ROW.match(bare):
            self.gather("table", line, bare)
        elif _QUOTE.match(bare):
            self.gather("blockQuote", line, bare)
        elif _ITEM.match(bare) or (self.open is not None and self.open.kind == "list" and _MORE.match(line)):
            self.gather("list", line, bare)
        elif kind := next((k for k, p in _SINGLE if p.match(bare)), None):
            self.close()
            self.emit(kind, bare)
            self.before = bare
        else:
            self.gather("paragraph", line, bare)

    def _underlined(self, bare: str) -> None:
        """An underline turns the line before into a heading, even one of a list or table, which stays open."""
        title, self.before = Py.strip(self.before), None
        if self.open is not None and self.open.kind == "paragraph":
            self.open.lines.pop()
            self.close()
        self.heading(SETEXT[bare[0]], title, f"{title}\n{bare}")


def document_blocks(text: str) -> list[Block]:
    scanner = BlockScanner()
    for line in text.split("\n"):
        scanner.read(line)
    scanner.close()
    return scanner.blocks


@dataclass(frozen=True)
class DocumentStructureChunker:
    """Blocks packed by words. A larger code block or table stays whole; a heading goes with what follows it.

    With ``overlap_blocks`` a chunk starts with the last blocks of the one before, which also sets its heading path.
    """

    target_words: int = 1500
    overlap_blocks: int = 0
    preserve_tables: bool = True
    preserve_code_blocks: bool = True

    def _groups(self, blocks: list[Block]) -> list[list[Block]]:
        target = max(1, self.target_words)
        whole = {kind for kind, on in (("codeBlock", self.preserve_code_blocks), ("table", self.preserve_tables)) if on}
        groups: list[list[Block]] = [[]]
        for block in blocks:
            total = sum(b.words for b in groups[-1])
            if block.kind in whole and block.words > target:
                groups += [[block], []]
                continue
            if total and total + block.words > target:
                last = groups[-1]
                carried = [last.pop()] if len(last) > 1 and last[-1].kind == "heading" else []
                groups.append(carried)
            groups[-1].append(block)
        merged: list[list[Block]] = []
        for group in filter(None, groups):
            if merged and all(b.kind == "heading" for b in merged[-1]):
                merged[-1] = merged[-1] + group
            else:
                merged.append(group)
        k = max(0, self.overlap_blocks)
        return [(merged[i - 1][-k:] if k and i else []) + group for i, group in enumerate(merged)]

    def chunks(self, text: str) -> Iterator[dict]:
        for index, group in enumerate(self._groups(document_blocks(text))):
            pages = [b.page for b in group if b.page is not None]
            kinds = list(dict.fromkeys(b.kind for b in group))
            location = {
                "page_range": {"start": min(pages), "end": max(pages)} if pages else None,
                "heading_path": group[0].path,
                "primary_block_type": next((k for k in kinds if k not in PLAIN), "paragraph"),
                "block_types": kinds,
            }
            last = group[-1]
            yield chunk_row(
                index, "\n\n".join(b.text for b in group), sum(b.words for b in group), 0,
                source_word_range={"start": group[0].start, "end": last.start + last.words}, document_location=location,
            )


def sentence_groups(text: str, target: int, overlap: int = 0) -> Iterator[tuple[str, int, int]]:
    """Text, words and word offset of sentences packed by words."""
    parts = Py.sentences(text)
    sizes = list(map(Py.count, parts))
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    for a, b in spans(sizes, max(1, target), max(0, overlap)):
        yield " ".join(parts[a:b]), sums[b] - sums[a], sums[a]


@dataclass(frozen=True)
class SentenceChunker:
    """Sentences packed by words, with an overlap in sentences; see ``prose.sentence_chunks`` for the Column form."""

    target_words: int = 1500
    overlap_sentences: int = 0

    def chunks(self, text: str) -> Iterator[dict]:
        for index, (body, words, start) in enumerate(sentence_groups(text, self.target_words, self.overlap_sentences)):
            yield chunk_row(index, body, words, start, timestamps=Py.clock_times(body), speaker_labels=Py.speakers(body))


@dataclass(frozen=True)
class MarkdownChunker:
    """Sections from heading to heading, with or without a blank after the marks, fences not heeded.

    A larger section is cut by sentences, its heading among them, and each piece gets the heading in front.
    """

    target_words: int = 1500
    max_heading_level: int = 3

    def sections(self, text: str) -> list[tuple[str | None, str]]:
        deepest = max(1, min(6, self.max_heading_level))
        runs: list[tuple[str | None, list[str]]] = [(None, [])]
        for line in Py.lines(text):
            bare = Py.strip_blanks(line)
            level = len(bare) - len(bare.lstrip("#"))
            if 1 <= level <= deepest:
                runs.append((Py.strip(line), []))
            else:
                runs[-1][1].append(line)
        bodies = [(head, Py.strip("\n".join(lines))) for head, lines in runs]
        return [(head, "\n\n".join(filter(None, (head, body)))) for head, body in bodies if head or body]

    def chunks(self, text: str) -> Iterator[dict]:
        index = start = 0
        for head, body in self.sections(text):
            words = Py.count(body)
            pieces = [body] if words <= max(1, self.target_words) else [(f"{head}\n\n" if head else "") + piece for piece, _, _ in sentence_groups(body, self.target_words)]
            for piece in pieces:
                words = Py.count(piece)
                yield chunk_row(index, piece, words, start)
                index, start = index + 1, start + words


@dataclass(frozen=True)
class CodeBlockChunker:
    """Code and prose never share a chunk; a code block is never cut; prose is packed by paragraphs."""

    target_words: int = 1500

    @staticmethod
    def blocks(text: str) -> Iterator[tuple[bool, str]]:
        """Whether it is code, and the text of each block. Only fences at the very start of a line open one."""
        lines: list[str] = []
        fence = ""
        for line in text.split("\n"):
            if fence:
                lines.append(line)
                if Py.strip_blanks(line).startswith(fence) and len(Py.strip(line)) <= len(fence) + 1:
                    yield True, "\n".join(lines)
                    lines, fence = [], ""
            elif m := _FENCE.match(line):
                if lines:
                    yield False, "\n".join(lines)
                lines, fence = [line], m[1]
            else:
                lines.append(line)
        if lines:
            yield bool(fence), "\n".join(lines)

    def chunks(self, text: str) -> Iterator[dict]:
        target = max(1, self.target_words)
        groups: list[tuple[bool, list[str]]] = []
        total, full = 0, True
        for code, block in self.blocks(text) if text else ():
            for part in [block] if code else block.split("\n\n"):
                words = Py.count(part)
                if not words and not code:
                    continue
                if full or (total and (groups[-1][0] != code or total + words > target)):
                    groups.append((code, []))
                    total = 0
                groups[-1][1].append(part)
                total += words
                full = code and total >= target
        start = 0
        for index, (code, parts) in enumerate(groups):
            body = "\n".join(parts)
            words = Py.count(body)
            location = {"page_range": None, "heading_path": [], "primary_block_type": "codeBlock" if code else None, "block_types": []}
            yield chunk_row(index, body, words, start, document_location=location)
            start += words
