"""Chunkers as table operators: documents in, chunk rows out, without a shuffle.

``chunk`` picks the plan: fixed windows and sentences without overlap are Column expressions; the line-structured
chunkers run one pass in Arrow batches (``mapInArrow``). ``register`` makes every chunker callable from SQL as a
lateral table function.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.schema import ARROW_CHUNK, CHUNK, CHUNK_COLUMNS
from paperloom.operators.diagnostics import CrashReportChunker, LogChunker
from paperloom.operators.documents import CodeBlockChunker, DocumentStructureChunker, MarkdownChunker, SentenceChunker
from paperloom.operators.prose import FixedChunker, fixed_chunks, sentence_chunks
from paperloom.operators.transcript import TranscriptChunker


class Chunker(Protocol):
    """What a chunker of your own must offer; a frozen dataclass of plain values is sent to the workers."""

    def chunks(self, text: str) -> Iterator[dict]: ...


CHUNKERS: dict[str, type] = {
    "fixed": FixedChunker, "sentence": SentenceChunker, "transcript": TranscriptChunker, "log": LogChunker, "crash": CrashReportChunker,
    "markdown": MarkdownChunker, "document": DocumentStructureChunker, "code": CodeBlockChunker,
}
#: Documents in one Arrow batch.
BATCH_ROWS = 512


def _mapped(docs: DataFrame, chunker: Chunker, keys: list[str]) -> DataFrame:
    names = [*keys, *CHUNK_COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                rows: list[dict] = []
                source: list[int] = []
                for k, text in enumerate(part.column(len(keys)).to_pylist()):
                    for row in chunker.chunks(text):
                        rows.append(row)
                        source.append(k)
                if rows:
                    taken = [part.column(i).take(pa.array(source)) for i in range(len(keys))]
                    made = [pa.array([r[c] for r in rows], t) for c, t in ARROW_CHUNK.items()]
                    yield pa.RecordBatch.from_arrays([*taken, *made], names=names)

    given = docs.select(*[F.col(f"`{k}`") for k in keys], T.normalised(F.col("text")).alias("text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]), CHUNK])
    return given.mapInArrow(run, schema)


def chunk(docs: DataFrame, chunker: Chunker, *keys: str) -> DataFrame:
    """``docs(keys..., text)`` -> the keys and a chunk's columns; a text without content gives no rows.

    ``keys`` defaults to ``doc_id``. A null text is empty. Line ends are made single newlines first.
    """
    names = list(keys or ("doc_id",))
    if isinstance(chunker, FixedChunker):
        return fixed_chunks(docs, chunker.max_words, chunker.overlap_words, *names)
    if isinstance(chunker, SentenceChunker) and chunker.overlap_sentences <= 0:
        return sentence_chunks(docs, chunker.target_words, *names)
    return _mapped(docs, chunker, names)


def with_lines(docs: DataFrame, *keys: str) -> DataFrame:
    """``docs(keys..., text)`` -> the keys, ``line_no`` from 0 and ``line``."""
    names = list(keys or ("doc_id",))
    lines = F.split(T.normalised(F.col("text")), f"[{T.NEWLINES}]")
    return docs.select(*names, F.posexplode(lines).alias("line_no", "line"))


def register(spark: SparkSession, prefix: str = "chunk_") -> list[str]:
    """Table functions ``chunk_<name>(text, options)`` for SQL; options is JSON, such as ``'{"target_words": 50}'``.

    ``SELECT d.doc_id, c.* FROM docs d LEFT JOIN LATERAL chunk_log(d.text, '{}') c ON true`` keeps documents
    without chunks.
    """
    from pyspark.sql.functions import udtf

    made = []
    for name, kind in CHUNKERS.items():

        class Table:
            def eval(self, text: str, options: str, kind: type = kind) -> Iterator[tuple]:
                body = (text or "").replace("\r\n", "\n")
                for row in kind(**json.loads(options or "{}")).chunks(body):
                    yield tuple(row[c] for c in CHUNK_COLUMNS)

        spark.udtf.register(prefix + name, udtf(Table, returnType=CHUNK))
        made.append(prefix + name)
    return made
