"""Packing of documents into sequences of at most 4096 tokens by minimum bin slack.

Each partition is packed by itself in one pass over its documents, so nothing is dealt out or collected. Whole
sequences are cut off a long document at once. The remainders wait in a window; for each sequence a subset-sum
over their lengths, kept as bits of an integer, picks the multiset that comes closest to the capacity, and the
counts are traced back from the reached length. Slack that stays is filled with a cut of the longest waiting
remainder. What a partition has left at its end is cut into sequences of power-of-two sizes, which need no
padding.
"""

from __future__ import annotations

import gc
import os
import unicodedata
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import parts

CAPACITY = 4096
END_ID = 2
#: Remainders that wait for a fitting partner.
WAITING = 256
#: A generation of words whose ids are kept at hand: so many words, or so many bytes of letters and ids. Longer words
#: than LONG are encoded each time.
CACHED_WORDS, CACHED_BYTES, LONG = 300_000, 48 << 20, 1000
#: ASCII signs, which after a letter are split off as one run.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
NAMES = tuple(x.split()[0] for x in SCHEMA.split(", "))


def closest_subset(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to take each length so that the sum is as large as ``room`` allows (subset-sum over bits).

    ``counts`` says how often each length is there. Ties go to the longer lengths.
    """
    mask = (1 << (room + 1)) - 1
    reached, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = counts[length], 1
        while left:  # a count as powers of two: as many shifts as it has bits
            take = min(part, left)
            if take * length > room:
                take = room // length
                if not take:
                    break
            steps.append((length, take, reached))
            reached |= (reached << (take * length)) & mask
            left -= min(part, left)
            part *= 2
        if reached >> room & 1:
            break
    at, taken = reached.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + take
            at -= take * length
    return taken


def _byte_signs() -> dict[int, str]:
    """How byte-level tokenizers write bytes: printable ones as they are, the others from U+0100 on in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + k) for k, b in enumerate(others)}


@lru_cache(2)
def tokenizer_ids(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Ids of texts by the tokenizer file, equal to encoding each text whole; one for each worker process.

    The tokenizer splits at white space before it merges, so texts are cut at blanks and newlines and the ids of
    a word are taken from a bounded cache of two generations. Its normaliser (NFC, letters lowered one by one) and
    its splitter (runs of letters; runs of signs) leave a word of letters whole, so such words go straight to its
    merges, a capital at the start and signs at the end taken off before; all others go through the whole tokenizer.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, signs = tokenizer.model, _byte_signs()
    whole = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    young: dict[str, bytes] = {}
    old: dict[str, bytes] = {}
    ends: dict[str, bytes] = {}
    held = 0

    def merged(plain: list[str]) -> Iterator[bytes]:
        """Ids of words of letters that are lowered and written in the tokenizer's signs."""
        for text in plain:
            yield array("I", [t.id for t in model.tokenize(text)]).tobytes()

    def encoded(words: list[str]) -> None:
        """Makes words known: those of letters together, as one text with a word on each line, others one by one."""
        ascii_, other = [], []
        for w in words:
            if w.isalpha():
                (ascii_ if w.isascii() else other).append(w)
            else:
                young[w] = whole(w)
        young.update(zip(ascii_, merged("\n".join(ascii_).lower().split("\n") if ascii_ else []), strict=True))
        if other:
            lines = unicodedata.normalize("NFC", "\n".join(other))
            lines = "".join(map(str.lower, lines)) if "Σ" in lines else lines.lower()
            written = lines.encode().decode("latin-1").translate(signs).split(signs[10])
            for w, line, text in zip(other, lines.split("\n"), written, strict=True):
                young[w] = next(merged([text])) if line.isalpha() else whole(w)

    def learn(words: set[str]) -> None:
        """Makes every one of ``words`` known in the young generation."""
        nonlocal held
        parted, fresh = [], set()
        for w in words:
            if (known := old.get(w)) is not None:
                young[w] = known
                held += 2 * len(w) + len(known)
                continue
            stem = w.rstrip(SIGNS)
            end = w[len(stem) :]
            if not stem[-1:].isalpha():  # signs beside anything but a letter may belong together
                stem, end = w, ""
            if "A" <= stem[:1] <= "Z":
                stem = stem[0].lower() + stem[1:]
            if stem is not w and stem != w:
                parted.append((w, stem, end))
            if stem not in young:
                if (known := old.get(stem)) is not None:
                    young[stem] = known
                else:
                    fresh.add(stem)
        encoded(list(fresh))
        for w, stem, end in parted:
            if end not in ends:
                if len(ends) > 10_000:
                    ends.clear()
                ends[end] = whole(end) if end else b""
            young[w] = young[stem] + ends[end]
        held += sum(2 * len(w) + len(young[w]) for w in fresh) + sum(2 * len(p[0]) + len(young[p[0]]) for p in parted)

    def encode(texts: list[str]) -> list[np.ndarray]:
        nonlocal young, old, held
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split).difference(young)
        long = {w: whole(w) for w in new if len(w) > LONG}
        learn(new.difference(long))
        known = (lambda w: long[w] if w in long else young[w]) if long else young.__getitem__
        out = [np.frombuffer(b"".join(map(known, words)), "<u4") for words in split]
        if len(young) > CACHED_WORDS or held > CACHED_BYTES:
            old, young, held = young, {}, 0
        return out

    return encode


class Packer:
    """Takes documents one after the other and gives finished pieces; ``end`` gives the rest."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, waiting: int = WAITING):
        self.sequence, self.capacity, self.waiting = first_sequence, capacity, waiting
        self.by_length: dict[int, deque] = {}
        self.count = self.tokens = 0

    def piece(self, item: tuple, length: int, offset: int) -> tuple:
        doc_id, ids, start, total = item
        return doc_id, start, length, zlib.crc32(ids[:length].tobytes()), total, self.sequence, offset

    def wait(self, item: tuple) -> None:
        self.by_length.setdefault(len(item[1]), deque()).append(item)
        self.count += 1
        self.tokens += len(item[1])

    def take(self, length: int) -> tuple:
        line = self.by_length[length]
        item = line.popleft()
        if not line:
            del self.by_length[length]
        self.count -= 1
        self.tokens -= length
        return item

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        total, start = len(ids), 0
        while total - start >= self.capacity:
            yield self.piece((doc_id, ids[start:], start, total), self.capacity, 0)
            self.sequence += 1
            start += self.capacity
        if start < total:
            self.wait((doc_id, ids[start:].copy() if start else ids, start, total))
        while self.count > self.waiting and self.tokens >= self.capacity:  # else a sequence could not be filled
            yield from self.fill()

    def fill(self) -> Iterator[tuple]:
        """One sequence: the longest remainder, the multiset closest to the room it leaves, then a cut."""
        first = self.take(max(self.by_length))
        yield self.piece(first, len(first[1]), 0)
        at = len(first[1])
        for length, times in closest_subset({k: len(v) for k, v in self.by_length.items()}, self.capacity - at).items():
            for _ in range(times):
                yield self.piece(self.take(length), length, at)
                at += length
        if at < self.capacity and self.by_length:
            room = self.capacity - at
            doc_id, ids, start, total = self.take(max(self.by_length))
            yield self.piece((doc_id, ids, start, total), room, at)
            self.wait((doc_id, ids[room:], start + room, total))
        self.sequence += 1

    def end(self) -> Iterator[tuple]:
        while self.tokens >= self.capacity:
            yield from self.fill()
        left = self.tokens
        items = [self.take(length) for length in sorted(self.by_length, reverse=True) for _ in range(len(self.by_length[length]))]
        size = 1 << max(left.bit_length() - 1, 0)
        while left:
            while size > left:
                size //= 2
            at = 0
            while at < size:
                doc_id, ids, start, total = items.pop()
                cut = min(len(ids), size - at)
                yield self.piece((doc_id, ids, start, total), cut, at)
                if cut < len(ids):
                    items.append((doc_id, ids[cut:], start + cut, total))
                at += cut
            self.sequence += 1
            left -= size


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, waiting: int = WAITING) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> the pieces of all documents, see SCHEMA.

    A document is its token ids and END_ID, so a null or empty text is one token. A sequence id is the partition's
    number and a running number. Repeated rows are packed each by itself; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer_ids(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 32, capacity, waiting)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=NAMES)

        gc.disable()  # nothing here is cyclic, and the collector would walk millions of words again and again
        try:
            for batch in parts(batches):
                ids = batch.column(0).to_pylist()
                texts = batch.column(1).to_pylist()
                rows = []
                for i in range(0, len(ids), 64):
                    for doc_id, tokens in zip(ids[i : i + 64], encode([t or "" for t in texts[i : i + 64]]), strict=True):
                        rows += packer.add(doc_id, np.append(tokens, np.uint32(END_ID)).astype("<u4"))
                if rows:
                    yield made(rows)
            if rows := list(packer.end()):
                yield made(rows)
        finally:
            gc.enable()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
