"""Chunking streams of documents, and runs that can be watched and cancelled."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators.tables import Chunker, chunk
from paperloom.plans.chains import Chain


def chunk_stream(docs: DataFrame, chunker: Chunker, *keys: str) -> DataFrame:
    """``chunk`` on a streaming DataFrame: chunkers hold no state across documents."""
    return chunk(docs, chunker, *keys)


def chain_stream(docs: DataFrame, chain: Chain, sink: Callable[[DataFrame, int], None], checkpoint: str, **run: object) -> StreamingQuery:
    """Runs the chain on each micro-batch and hands the results to ``sink(results, batch_id)``."""
    return docs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, k: sink(chain.run(batch, **run), k)).start()


@dataclass
class Runner:
    """A run in the background with its state. A new run cancels the one before.

    ``run`` makes a table; ``follow`` goes through events, such as those of ``single.stream`` or ``stream_call``: the
    phase is that of the last progress, ``partial_text`` what has come so far.
    """

    spark: SparkSession
    phase: str = "idle"
    result: list | str | None = None
    partial_text: str = ""
    error: BaseException | None = None
    _tag: str | None = None
    _thread: threading.Thread | None = field(default=None, repr=False)

    @property
    def is_running(self) -> bool:
        return self._thread is not None and self._thread.is_alive()

    def run(self, make: Callable[[], DataFrame]) -> None:
        """``make`` gives the results, which are collected: for the few documents of an interactive run."""
        self.cancel()
        tag = f"run-{uuid.uuid4().hex}"
        self._start(tag)

        def work() -> None:
            self.spark.sparkContext.setJobGroup(tag, "a watched run", interruptOnCancel=True)
            try:
                rows = make().collect()
                if self._tag == tag:
                    self.result, self.phase = rows, "complete"
            except Exception as e:
                if self._tag == tag:
                    self.error, self.phase = e, "failed"

        self._go(work)

    def _start(self, tag: str) -> None:
        self._tag = tag
        self.phase, self.result, self.error, self.partial_text = "running", None, None, ""

    def _go(self, work: Callable[[], None]) -> None:
        self._thread = threading.Thread(target=work, daemon=True)
        self._thread.start()

    def follow(self, make: Callable[[], Iterator]) -> None:
        """``make`` gives events in order; a cancelled run takes no further one."""
        self.cancel()
        tag = f"run-{uuid.uuid4().hex}"
        self._start(tag)

        def work() -> None:
            self.spark.sparkContext.setJobGroup(tag, "a watched run", interruptOnCancel=True)
            try:
                for e in make():
                    if self._tag != tag:
                        return
                    if e["type"] == "progress":
                        self.phase = e["phase"]
                    elif e["type"] == "chunk":
                        self.partial_text += e["text"] or ""
                    else:
                        self.result = e["text"]
                if self._tag == tag:
                    self.phase = "complete"
            except Exception as e:
                if self._tag == tag:
                    self.error, self.phase = e, "failed"

        self._go(work)

    def cancel(self) -> None:
        if self.is_running:
            tag, self._tag = self._tag, None
            while self.is_running:  # again and again: its next job may only just begin
                self.spark.sparkContext.cancelJobGroup(tag)
                self._thread.join(0.2)
            self.phase = "cancelled"

    def wait(self, seconds: float | None = None) -> None:
        if self._thread is not None:
            self._thread.join(seconds)


#: Free memory in MB below which it is critical, and below which it is a warning.
CRITICAL_MB, WARNING_MB = 100, 300


def memory_pressure(free_mb: float | None = None) -> tuple[str, int]:
    """ok, warning or critical, and the free MB of the driver's machine."""
    if free_mb is None:
        free_mb = os.sysconf("SC_AVPHYS_PAGES") * os.sysconf("SC_PAGE_SIZE") / 1e6
    return ("critical" if free_mb < CRITICAL_MB else "warning" if free_mb < WARNING_MB else "ok"), int(free_mb)


def memory_level(free_mb: Column) -> Column:
    """``memory_pressure`` of a column of free MB."""
    return F.when(free_mb < CRITICAL_MB, "critical").when(free_mb < WARNING_MB, "warning").otherwise("ok")


def should_proceed(free_mb: float | None = None) -> bool:
    return memory_pressure(free_mb)[0] != "critical"
