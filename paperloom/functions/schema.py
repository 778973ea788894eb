"""Row types of chunks, results and events, as DDL and as Arrow types."""

from __future__ import annotations

import pyarrow as pa

CRASH_FIELDS = (
    "process", "identifier", "version", "hardware_model", "os_version", "exception_type", "exception_codes", "exception_subtype",
    "termination_reason", "termination_description", "application_specific_information", "crashed_thread", "signal", "symbolication_status",
)
TIMES = "struct<start: string, end: string>"
RANGE = "struct<start: bigint, end: bigint>"
LOCATION = f"struct<page_range: {RANGE}, heading_path: array<string>, primary_block_type: string, block_types: array<string>>"
CRASH = f"struct<{', '.join(f'{f}: string' for f in CRASH_FIELDS)}>"
LOG = f"struct<kind: string, process: string, subsystem: string, category: string, severity: string, timestamp_range: {TIMES}, crash_report: {CRASH}>"
#: Columns of a chunk, in order. Lists are never null.
CHUNK_COLUMNS = {
    "chunk_index": "bigint", "text": "string", "word_count": "bigint", "source_word_range": RANGE, "timestamps": "array<string>", "speaker_labels": "array<string>",
    "attribution_type": "string", "topic_label": "string", "timestamp_range": TIMES, "document_location": LOCATION, "log_metadata": LOG,
}
CHUNK = ", ".join(f"{k} {v}" for k, v in CHUNK_COLUMNS.items())
CHUNK_STRUCT = "struct<" + ", ".join(f"{k}: {v}" for k, v in CHUNK_COLUMNS.items()) + ">"

_text, _whole, _texts = pa.string(), pa.int64(), pa.list_(pa.string())
_times = pa.struct([("start", _text), ("end", _text)])
_range = pa.struct([("start", _whole), ("end", _whole)])
_location = pa.struct([("page_range", _range), ("heading_path", _texts), ("primary_block_type", _text), ("block_types", _texts)])
_crash = pa.struct([(f, _text) for f in CRASH_FIELDS])
_log = pa.struct([("kind", _text), ("process", _text), ("subsystem", _text), ("category", _text), ("severity", _text), ("timestamp_range", _times), ("crash_report", _crash)])
ARROW_CHUNK = {
    "chunk_index": _whole, "text": _text, "word_count": _whole, "source_word_range": _range, "timestamps": _texts, "speaker_labels": _texts,
    "attribution_type": _text, "topic_label": _text, "timestamp_range": _times, "document_location": _location, "log_metadata": _log,
}


def chunk_row(index: int, text: str, words: int, start: int, **more: object) -> dict:
    """A chunk as a dictionary; what is not given is empty or null."""
    row = dict.fromkeys(CHUNK_COLUMNS) | {"chunk_index": index, "text": text, "word_count": words, "source_word_range": {"start": start, "end": start + words}, "timestamps": [], "speaker_labels": []}
    return row | more


def time_range(times: list[str]) -> dict | None:
    return {"start": times[0], "end": times[-1]} if times else None
