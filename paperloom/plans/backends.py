"""Model backends: a prompt Column in, a response Column out.

A backend offers ``responses(prompts, system, retry)`` for arrays of prompts, so that all calls of a document stay
in its row and nothing is dealt out. Column backends are deterministic stand-ins that Catalyst sees through; a
Python backend runs a function in Arrow batches, with its own retries and a bounded number of calls in flight.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.text import WORD
from paperloom.plans.budget import RetryPolicy, TokenCounter


#: Prompts -> pairs of a prompt's number and its response, in the order in which the calls come back.
Asker = Callable[[Sequence[str]], list[tuple[int, str | None]]]


class Backend:
    """``context_window_tokens`` and ``counter`` make a backend token-aware."""

    context_window_tokens: int | None = None
    counter: TokenCounter | None = None

    def response(self, prompt: Column, system: str | None = None) -> Column:
        raise NotImplementedError

    def responses(self, prompts: Column, system: str | None = None, retry: RetryPolicy | None = None, in_flight: int = 1) -> Column:
        return F.transform(prompts, lambda p: self.response(p, system))

    def completed(self, prompts: Column, system: str | None = None, retry: RetryPolicy | None = None, in_flight: int = 1) -> Column:
        """``responses`` as structs ``(at, text)`` in the order in which the calls come back; here that of the prompts."""
        return F.transform(self.responses(prompts, system, retry, in_flight), lambda s, i: F.struct(i.alias("at"), s.alias("text")))

    def asker(self, system: str | None = None, retry: RetryPolicy | None = None, in_flight: int = 1) -> Asker | None:
        """``completed`` for a list of prompts in Python, as pairs ``(at, text)``; None for a backend of Columns alone."""
        return None

    def _answers_as(self, kind: type[Backend]) -> bool:
        """Whether no subclass of ``kind`` has put Columns of its own in the place of its answers."""
        return all(getattr(type(self), name) is getattr(kind, name) for name in ("response", "responses", "completed"))

    def fragments(self, response: Column) -> Column:
        """The pieces in which a response would arrive; one for a backend that does not stream."""
        return F.array(response)


@dataclass
class ExtractiveBackend(Backend):
    """The first words of the prompt: a model that always quotes."""

    words: int = 20

    def response(self, prompt: Column, system: str | None = None) -> Column:
        return F.array_join(F.slice(T.words(prompt), 1, self.words), " ")

    def asker(self, system: str | None = None, retry: RetryPolicy | None = None, in_flight: int = 1) -> Asker | None:
        most = self.words
        return (lambda prompts: [(at, " ".join(w[0] for w in islice(WORD.finditer(p), most))) for at, p in enumerate(prompts)]) if self._answers_as(ExtractiveBackend) else None


@dataclass
class CannedBackend(Backend):
    text: str = "summary"

    def response(self, prompt: Column, system: str | None = None) -> Column:
        return F.lit(self.text)

    def asker(self, system: str | None = None, retry: RetryPolicy | None = None, in_flight: int = 1) -> Asker | None:
        text = self.text
        return (lambda prompts: [(at, text) for at in range(len(prompts))]) if self._answers_as(CannedBackend) else None


@dataclass
class StreamingBackend(CannedBackend):
    """Streams its text word by word."""

    def fragments(self, response: Column) -> Column:
        words = T.words(response)
        return F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.lit(" "), w)))


@dataclass
class TokenAwareBackend(ExtractiveBackend):
    context_window_tokens: int = 4096
    counter: TokenCounter = field(default_factory=TokenCounter)


class Cancelled(RuntimeError):
    """A run was given up before a call."""


def with_retry(call: Callable[[], str], policy: RetryPolicy) -> str:
    """``call`` again until it succeeds or the attempts are used up; then its last error."""
    for attempt in range(1, policy.max_attempts + 1):
        try:
            return call()
        except Cancelled:
            raise
        except Exception:
            if attempt == policy.max_attempts:
                raise
            time.sleep(policy.delay_milliseconds / 1000)
    raise AssertionError


@dataclass
class PythonBackend(Backend):
    """``generate(prompt, system)`` in the workers. Calls are never made twice by the planner.

    ``on_error`` raise fails the job; null gives a null response, which the chain reports for its document.
    ``cancelled`` is asked before each call, and no call is made once it says so: the job then fails with Cancelled.
    """

    generate: Callable[[str, str | None], str]
    on_error: str = "raise"
    context_window_tokens: int | None = None
    counter: TokenCounter | None = None
    cancelled: Callable[[], bool] | None = None

    def _one(self, system: str | None, retry: RetryPolicy | None) -> Callable[[str], str | None]:
        """One call with its further tries."""
        generate, policy, quiet, cancelled = self.generate, retry or RetryPolicy(), self.on_error == "null", self.cancelled

        def call(prompt: str) -> str:
            if cancelled is not None and cancelled():
                raise Cancelled
            return generate(prompt, system)

        def one(prompt: str) -> str | None:
            try:
                return with_retry(lambda: call(prompt), policy)
            except Cancelled:
                raise
            except Exception:
                if quiet:
                    return None
                raise

        return one

    def asker(self, system: str | None = None, retry: RetryPolicy | None = None, in_flight: int = 1) -> Asker | None:
        if not self._answers_as(PythonBackend):
            return None
        one = self._one(system, retry)

        def ask(prompts: Sequence[str]) -> list[tuple[int, str | None]]:
            came: list[tuple[int, str | None]] = []
            with ThreadPoolExecutor(max(1, in_flight)) as pool:
                list(pool.map(lambda p: came.append((p[0], one(p[1]))), enumerate(prompts)))
            return came

        return ask

    def _column(self, prompts: Column, system: str | None, retry: RetryPolicy | None, in_flight: int, in_order: bool = True) -> Column:
        one = self._one(system, retry)

        def ask(pool: ThreadPoolExecutor, prompts: Sequence[str]) -> list:
            if in_order:
                return list(pool.map(one, prompts))
            came: list[dict] = []
            # the threads append as they finish; an append is one step
            list(pool.map(lambda p: came.append({"at": p[0], "text": one(p[1])}), enumerate(prompts)))
            return came

        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            with ThreadPoolExecutor(max(1, in_flight)) as pool:
                for batch, _ in batches:
                    yield pd.Series([None if ps is None else ask(pool, ps) for ps in batch], dtype=object)

        # the prompts are named twice so that they stay a column of their own: Spark does not evaluate a Python
        # function whose argument holds nested lambdas
        run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
        kind = "array<string>" if in_order else "array<struct<at: int, text: string>>"
        return F.pandas_udf(run, kind).asNondeterministic()(prompts, F.size(prompts))

    def completed(self, prompts: Column, system: str | None = None, retry: RetryPolicy | None = None, in_flight: int = 1) -> Column:
        return self._column(prompts, system, retry, in_flight, in_order=False)

    def responses(self, prompts: Column, system: str | None = None, retry: RetryPolicy | None = None, in_flight: int = 1) -> Column:
        return self._column(prompts, system, retry, in_flight)

    def response(self, prompt: Column, system: str | None = None) -> Column:
        return F.get(self._column(F.array(prompt), system, None, 1), 0)
