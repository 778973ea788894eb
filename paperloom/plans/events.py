"""Progress and output events of a run, as ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.plans.backends import Backend

EVENT = "struct<type: string, text: string, phase: string, step: bigint, total: bigint>"


def _event(kind: str, text: Column | None = None, phase: str | None = None, step: Column | None = None, total: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(kind).alias("type"), (none if text is None else text).alias("text"), F.lit(phase).alias("phase"), (none if step is None else step).alias("step"), (none if total is None else total).alias("total")).cast(EVENT)


def events(results: DataFrame, backend: Backend) -> DataFrame:
    """``Chain.run`` results -> ``(doc_id, seq, type, text, phase, step, total)`` in order of ``seq``.

    One call: stuffing, the response's fragments, complete, result. Map-reduce: a step for each chunk, one for each
    reduce call, complete, then the final text as one chunk, and the result.
    """
    n = F.size("source_chunks").cast("long")
    fragments = F.transform(backend.fragments(F.col("text")), lambda t: _event("chunk", t))
    stuffed = F.concat(F.array(_event("progress", phase="stuffing")), fragments, F.array(_event("progress", phase="complete"), _event("result", F.col("text"))))
    steps = F.transform("source_chunks", lambda c: _event("progress", phase="mapping", step=c["chunk_index"] + 1, total=n))
    calls = F.flatten(F.transform("levels", lambda k: F.array_repeat(_event("progress", phase="reducing"), k)))
    reduced = F.concat(steps, calls, F.array(_event("progress", phase="complete"), _event("chunk", F.col("text")), _event("result", F.col("text"))))
    made = results.select("doc_id", F.posexplode(F.when(F.col("route") == "stuff", stuffed).otherwise(reduced)).alias("seq", "e"))
    return made.select("doc_id", F.col("seq").cast("long").alias("seq"), "e.*")
