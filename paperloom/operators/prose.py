"""Fixed word windows and sentence chunks as Column expressions: no Python and no shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.schema import CHUNK_COLUMNS, chunk_row
from paperloom.functions.text import WORD, Py
from paperloom.operators.packing import groups


def _row(keys: list[str], index: Column, text: Column, words: Column, start: Column) -> list[Column]:
    """A chunk's columns with times and speakers taken from its text."""
    known = {
        "chunk_index": index, "text": text, "word_count": words, "source_word_range": F.struct(start.alias("start"), (start + words).alias("end")),
        "timestamps": T.clock_times(text), "speaker_labels": T.speaker_labels(text),
    }
    return [*map(F.col, keys), *[(known[c] if c in known else F.lit(None)).cast(t).alias(c) for c, t in CHUNK_COLUMNS.items()]]


def windows(text: Column, max_words: int, overlap_words: int = 0) -> Column:
    """The windows of a text as structs ``(i, s, w)``: number, start and words; none for a text without words."""
    size = max(1, max_words)
    step = size - min(max(0, overlap_words), size - 1)

    def cut(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(step))
        made = F.transform(starts, lambda s, i: F.struct(i.cast("long").alias("i"), s.cast("long").alias("s"), F.slice(words, s + 1, size).alias("w")))
        return F.filter(made, lambda x: F.size(x["w"]) > 0)

    return T.let(T.words(text), cut)


def fixed_chunks(docs: DataFrame, max_words: int = 1500, overlap_words: int = 0, *keys: str) -> DataFrame:
    """Windows of ``max_words`` words, each starting ``max_words - overlap_words`` after the one before.

    The last window may lie wholly within the one before it. Words are joined by one blank, so line starts are
    lost and a chunk has one speaker at most.
    """
    names = list(keys or ("doc_id",))
    # slices are made in the row, so that no row carries all words of its document
    placed = docs.select(*names, F.inline(windows(T.normalised(F.col("text")), max_words, overlap_words)))
    made = placed.select(*names, "i", "s", F.size("w").cast("long").alias("n"), F.array_join("w", " ").alias("t"))
    return made.select(*_row(names, F.col("i"), F.col("t"), F.col("n"), F.col("s")))


def sentence_chunks(docs: DataFrame, target_words: int = 1500, *keys: str) -> DataFrame:
    """Sentences packed greedily by words, by a fold over each document's array of sentences."""
    names = list(keys or ("doc_id",))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)

    def packed(parts: Column) -> Column:
        made = lambda g: F.struct(
            g["index"].alias("i"), F.array_join(F.transform(g["items"], lambda x: x["s"]), " ").alias("t"), total(g["items"]["n"]).alias("n"), total(F.slice(parts["n"], 1, g["first"].cast("int"))).alias("s")
        )
        return F.transform(groups(parts, parts["n"], max(1, target_words)), made)

    sized = F.transform(T.sentences(T.normalised(F.col("text"))), lambda s: F.struct(s.alias("s"), F.size(T.words(s)).alias("n")))
    made = docs.select(*names, F.inline(T.let(sized, packed)))
    return made.select(*_row(names, F.col("i"), F.col("t"), F.col("n"), F.col("s")))


@dataclass(frozen=True)
class FixedChunker:
    """``fixed_chunks`` as a chunker that can be handed around; ``chunks`` is the same rule in Python."""

    max_words: int = 1500
    overlap_words: int = 0

    def chunks(self, text: str) -> Iterator[dict]:
        words = WORD.findall(text)
        size = max(1, self.max_words)
        step = size - min(max(0, self.overlap_words), size - 1)
        for index, start in enumerate(range(0, len(words), step)):
            some = words[start : start + size]
            body = " ".join(some)
            yield chunk_row(index, body, len(some), start, timestamps=Py.clock_times(body), speaker_labels=Py.speakers(body))
