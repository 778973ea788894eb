"""A chain's whole run over a document in Python, for counts that only a tokenizer knows.

Every Python function of a plan is a worker process of its own in each task, and with a tokenizer's counts each level
of a run needs some. Here one function takes a document from its text to its result, so a task has one worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa

from paperloom.functions.schema import ARROW_CHUNK
from paperloom.operators.tables import Chunker
from paperloom.plans import prompts as P
from paperloom.plans.backends import Backend
from paperloom.plans.budget import Budgeter, ChainOptions, TokenCounter

DEPTH_EXCEEDED = "reduceDepthExceeded"
NO_RESPONSE = "generationFailed"
_RANGE = re.compile(r"\[Chunks? ([\d\-]+)\]", re.A)
#: Documents that are read at once, and documents or letters of a batch that is given back.
READ_ROWS, MOST_ROWS, MOST_LETTERS = 64, 256, 4 << 20
#: What a run gives for each document, after its ``doc_id``.
FIELDS = {
    "route": pa.string(), "__doc": pa.string(), "__said": pa.string(), "__in": pa.int64(), "__out": pa.int64(), "chunks": pa.list_(pa.struct(list(ARROW_CHUNK.items()))),
    "__first": pa.list_(pa.string()), "__result": pa.string(), "__error": pa.string(), "levels": pa.list_(pa.int32()),
}


def chunk_label(summary: str) -> str:
    """``chains.chunk_range`` in Python."""
    found = _RANGE.search(summary)
    return found[1] if found else "?"


def exact_cut(texts: list[str], most: int, fits: Callable[[str], bool]) -> list[list[str]]:
    """Summaries in order, in groups of ``most`` at most whose whole text ``fits``; a lone one always goes."""
    groups: list[list[str]] = []
    for t in texts:
        if groups and len(groups[-1]) < most and fits(P.format_texts([*groups[-1], t])):
            groups[-1].append(t)
        else:
            groups.append([t])
    return groups


@dataclass(frozen=True)
class WholeRun:
    """``Chain.run`` of one text; ``budgeter`` is None without a budget."""

    strategy: str
    backend: Backend
    chunker: Chunker
    budgeter: Budgeter | None
    map_prompt: str
    reduce_prompt: str
    task: str
    system: str | None
    options: ChainOptions

    def _fits(self, text: str) -> bool:
        return self.budgeter is None or self.budgeter.fits_text(self.system, self.reduce_prompt, text, self.options.reserved_output_tokens)

    def route(self, text: str) -> str:
        if self.strategy != "adaptive":
            return self.strategy
        return "stuff" if self.budgeter.fits_text(self.system, self.task, text, self.options.reserved_output_tokens) else "mapReduce"

    def run(self, text: str, stuff_task: str, reduce_task: str) -> dict:
        options, counter = self.options, self.backend.counter
        once, mapped, again = self.backend.asker(self.system), self.backend.asker(self.system, options.retry, options.max_concurrent_map_tasks), self.backend.asker(self.system, options.retry)
        out = dict.fromkeys(FIELDS) | {"route": self.route(text), "__in": 0, "__out": 0, "chunks": [], "__first": [], "levels": []}

        def ask(asker: Callable, prompts: list[str], n_tokens: int | None = None) -> list[tuple[int, str | None]]:
            came = asker(prompts)
            out["__in"] += _total(counter, prompts) if n_tokens is None else n_tokens
            out["__out"] += _total(counter, [s for _, s in came])
            return came

        if out["route"] == "stuff":
            return out | {"__doc": text, "__said": ask(once, [P.stuff_text(stuff_task, text, options.prompt_style)])[0][1]}
        chunks = out["chunks"] = list(self.chunker.chunks(text)) if text else []
        came = ask(mapped, [P.map_text(self.map_prompt, c, len(chunks), options.prompt_style) for c in chunks], sum(counter.after(self.map_prompt, c["text"]) for c in chunks) if options.prompt_style == "raw" else None)
        if options.preserve_order:
            came = sorted(came, key=lambda c: c[0])
        now = out["__first"] = [None if s is None else f"[Chunk {at + 1}] {s}" for at, s in came]
        if not chunks:
            out["__result"] = ""
        if None in now:
            return out | {"__error": NO_RESPONSE}
        for _ in range(options.max_reduce_depth):
            if not now:
                return out
            last = self._fits(P.format_texts(now))
            groups = [now] if last else exact_cut(now, max(2, options.max_reduce_group_size), self._fits)
            out["levels"].append(len(groups))
            answers = [s for _, s in sorted(ask(again, [P.reduce_text(reduce_task, g, options.prompt_style) for g in groups]), key=lambda c: c[0])]
            if None in answers:
                return out | {"__error": NO_RESPONSE}
            if last:
                return out | {"__result": answers[0]}
            now = [f"[Chunks {chunk_label(g[0])}-{chunk_label(g[-1])}] {s}" for g, s in zip(groups, answers, strict=True)]
        return out | {"__error": DEPTH_EXCEEDED if now else None}

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``(doc_id, __doc, __stuff, __reduce)`` -> ``doc_id`` and ``FIELDS``."""
        for batch in batches:
            first, letters, rows = 0, 0, []
            for at in range(0, batch.num_rows, READ_ROWS):
                part = batch.slice(at, READ_ROWS)
                for text, stuff_task, reduce_task in zip(*[part.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                    rows.append(self.run(text, stuff_task, reduce_task))
                    letters += len(text)
                    if len(rows) >= MOST_ROWS or letters >= MOST_LETTERS:
                        yield _batch(batch.column(0).slice(first, len(rows)), rows)
                        first, letters, rows = first + len(rows), 0, []
            if rows:
                yield _batch(batch.column(0).slice(first, len(rows)), rows)


def _total(counter: TokenCounter, texts: list[str | None]) -> int:
    return sum(counter.python(t) for t in texts if t)


def _batch(ids: pa.Array, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *[pa.array([r[c] for r in rows], t) for c, t in FIELDS.items()]], names=["doc_id", *FIELDS])
