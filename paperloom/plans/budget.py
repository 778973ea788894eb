"""Context budgets and options: how much text a model call may hold, and which strategy a document gets."""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.text import Py

SAFETY_TOKENS = 128


@dataclass(frozen=True)
class RetryPolicy:
    max_attempts: int = 1
    delay_milliseconds: int = 0

    def __post_init__(self) -> None:
        object.__setattr__(self, "max_attempts", max(1, self.max_attempts))
        object.__setattr__(self, "delay_milliseconds", max(0, self.delay_milliseconds))


@dataclass(frozen=True)
class ChainOptions:
    """``max_concurrent_map_tasks`` bounds the calls in flight of one document.

    Without ``preserve_order`` the map results of a document stand in the order in which its calls came back, each
    with the label of its chunk; with one call at a time that is the order of its chunks.
    """

    reserved_output_tokens: int = 512
    max_reduce_group_size: int = 8
    max_reduce_depth: int = 5
    max_concurrent_map_tasks: int = 1
    preserve_order: bool = True
    retry: RetryPolicy = field(default_factory=RetryPolicy)
    prompt_style: str = "raw"


@dataclass(frozen=True)
class ContextBudget:
    """A number of words, or of tokens with a ratio of tokens to words."""

    kind: str
    limit: int
    tokens_per_word: float = T.TOKENS_PER_WORD

    @staticmethod
    def words(n: int) -> ContextBudget:
        return ContextBudget("words", n)

    @staticmethod
    def tokens(n: int, tokens_per_word: float = T.TOKENS_PER_WORD) -> ContextBudget:
        return ContextBudget("tokens", n, tokens_per_word)

    @property
    def ratio(self) -> float:
        return max(T.LEAST_TOKENS_PER_WORD, self.tokens_per_word)

    @property
    def word_limit(self) -> int:
        return max(1, self.limit if self.kind == "words" else int(self.limit / self.ratio))

    def fits_in_budget(self, text: Column, overhead_words: int = 0, reserved_words: int = 0) -> Column:
        return T.word_count(text) + overhead_words + reserved_words <= self.word_limit


class TokenCounter:
    """Counts texts as a Column and in Python. This one estimates from words, so it can count sums of words too."""

    by_words = True

    def __init__(self, tokens_per_word: float = T.TOKENS_PER_WORD):
        self.ratio = max(T.LEAST_TOKENS_PER_WORD, tokens_per_word)

    def of_words(self, n: Column) -> Column:
        """The count of a text of ``n`` words."""
        return T.estimated_tokens(n, self.ratio)

    def column(self, text: Column) -> Column:
        return self.of_words(T.word_count(text))

    def arrays(self, texts: Column) -> Column:
        """The counts of an array of texts, 0 for an empty or missing one."""
        return F.transform(texts, lambda t: F.when(F.coalesce(t, F.lit("")) == "", F.lit(0).cast("long")).otherwise(self.column(t)))

    def python(self, text: str) -> int:
        return max(1, int(Py.count(text) * self.ratio))

    def at_most(self, text: str, most: int) -> bool:
        """Whether a text that is not empty counts ``most`` at most."""
        return self.python(text) <= most

    def after(self, task: str, text: str) -> int:
        """The count of ``task + text``."""
        return self.python(task + text) if task + text else 0


class WordCounter(TokenCounter):
    def of_words(self, n: Column) -> Column:
        return n

    def python(self, text: str) -> int:
        return Py.count(text)


#: Words whose counts are kept in a worker, their letters, and the letters of a word that is not kept.
KNOWN_WORDS, KNOWN_LETTERS, LONG_WORD = 300_000, 8 << 20, 200
#: Texts whose counts are kept, and letters from which on one is not.
KNOWN_TEXTS, KNOWN_TEXT = 400, 10_000
#: Steps that leave no token across white space: normalisers that act on letters one by one or on white space, and a
#: splitter whose matches are letters alone, a digit or signs without white space.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: How byte-level tokenizers write the bytes that are no printable signs: from U+0100 on in order.
_WRITTEN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def counts_words_apart(tokenizer: object) -> bool:
    """Whether the tokenizer is known to count a text as the sum of what stands between its blanks and newlines."""
    if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None or tokenizer.truncation or tokenizer.padding or getattr(tokenizer.model, "dropout", None):
        return False
    if any(t.lstrip or t.rstrip or t.single_word or any(map(str.isspace, t.content)) for t in tokenizer.get_added_tokens_decoder().values()):
        return False
    return json.loads(tokenizer.normalizer.__getstate__()) == _NORMALIZER and json.loads(tokenizer.pre_tokenizer.__getstate__()) == _SPLITTER


class TokenizerCounter(TokenCounter):
    """Exact counts by a tokenizer file, loaded once in each worker. Whole arrays of texts are counted in Arrow batches.

    A tokenizer that drops white space before it merges counts a text as the sum of its words, whose counts are kept
    within bounds; any other one counts each text whole.
    """

    by_words = False

    def __init__(self, path: str):
        super().__init__()
        self.path = path
        self._tokenizer = None
        self._known: dict[str, int] = {}
        self._texts: dict[str, int] = {}
        self._held, self._apart, self._model = 0, False, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "ratio": self.ratio, "_tokenizer": None, "_model": None, "_known": {}, "_texts": {}, "_held": 0, "_apart": False}

    def _load(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(self.path)
        self._model, self._apart = self._tokenizer.model, counts_words_apart(self._tokenizer)

    def _whole(self, text: str) -> int:
        return len(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> int:
        """The count of a word. One of letters goes straight to the merges, without ASCII signs at its end."""
        stem = word.rstrip(_SIGNS)
        if not stem[-1:].isalpha() or len(stem) > LONG_WORD:
            return self._whole(word)
        if stem.isascii():
            low = written = stem.lower()
        else:
            low = "".join(map(str.lower, unicodedata.normalize("NFC", stem)))
            written = low.encode().decode("latin-1").translate(_WRITTEN)
        if not low.isalpha():
            return self._whole(word)
        end = word[len(stem) :]
        if end and end not in self._known:
            self._known[end] = self._whole(end)
            self._held += len(end)
        return len(self._model.tokenize(written)) + (self._known[end] if end else 0)

    def _sum(self, words: list[str]) -> int:
        """The counts of words, some of which may not be known; all but long ones are kept."""
        if len(self._known) > KNOWN_WORDS or self._held > KNOWN_LETTERS:
            self._known.clear()
            self._held = 0
        known, long = self._known, {}
        for w in set(words).difference(known):
            n = self._word(w)
            if len(w) <= LONG_WORD:
                known[w] = n
                self._held += len(w)
            else:
                long[w] = n
        return sum(long[w] if w in long else known[w] for w in words) if long else sum(map(known.__getitem__, words))

    def python(self, text: str) -> int:
        if self._tokenizer is None:
            self._load()
        if not text or not self._apart:
            return self._whole(text) if text else 0
        if (found := self._texts.get(text)) is not None:
            return found
        words = text.replace("\n", " ").split(" ")
        try:
            found = sum(map(self._known.__getitem__, words))
        except KeyError:
            found = self._sum(words)
        if len(text) < KNOWN_TEXT:
            if len(self._texts) >= KNOWN_TEXTS:
                self._texts.clear()
            self._texts[text] = found
        return found

    def at_most(self, text: str, most: int) -> bool:
        """Of a long text the first words are enough if they are too many already."""
        if self._tokenizer is None:
            self._load()
        end = max(text.find(" ", 8 * max(0, most) + 1000), 0) if self._apart else 0
        return not (end and self.python(text[:end]) > most) and self.python(text) <= most

    def after(self, task: str, text: str) -> int:
        """A task that ends with a blank or newline is counted by itself, so that the text's own count serves again."""
        if self._tokenizer is None:
            self._load()
        return self.python(task) + self.python(text) if self._apart and task[-1:] in (" ", "\n") else self.python(task + text)

    def of_words(self, n: Column) -> Column:
        raise TypeError("tokens do not follow from words")

    def arrays(self, texts: Column) -> Column:
        python = self.python

        def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for batch, _ in batches:
                yield pd.Series([None if ts is None else [python(t or "") for t in ts] for ts in batch], dtype=object)

        # named twice, and marked so that plans never repeat it, for the same reasons as a Python backend
        return F.pandas_udf(count, "array<bigint>").asNondeterministic()(texts, F.size(texts))

    def column(self, text: Column) -> Column:
        return F.get(self.arrays(F.array(text)), 0)


@dataclass(frozen=True)
class Budgeter:
    """Counts in the unit that fits best: a token-aware backend's own, else the budget's."""

    counter: TokenCounter
    limit: int
    in_words: bool

    @staticmethod
    def of(backend: object, budget: ContextBudget) -> Budgeter:
        window = getattr(backend, "context_window_tokens", None)
        if window is not None:
            return Budgeter(backend.counter, window, False)
        if budget.kind == "tokens":
            return Budgeter(TokenCounter(budget.tokens_per_word), budget.limit, False)
        return Budgeter(WordCounter(), budget.limit, True)

    def units(self, tokens: int) -> int:
        return int(tokens / T.TOKENS_PER_WORD) if self.in_words else tokens

    def count(self, text: Column) -> Column:
        return F.when(text == "", F.lit(0).cast("long")).otherwise(self.counter.column(text))

    def count_text(self, text: str) -> int:
        return self.counter.python(text) if text else 0

    def fits(self, system_prompt: str | None, task: Column | str, text: Column, reserved_tokens: int) -> Column:
        """No safety margin here."""
        fixed = self.count_text(system_prompt or "") + self.units(reserved_tokens)
        asked = F.lit(self.count_text(task)) if isinstance(task, str) else self.count(task)
        return asked + self.count(text) + fixed <= self.limit

    def fits_words(self, system_prompt: str | None, task: str, n_words: Column, reserved_tokens: int) -> Column:
        """``fits`` of a text that is not empty and has ``n_words`` words, where words are what counts."""
        fixed = self.count_text(system_prompt or "") + self.units(reserved_tokens) + self.count_text(task)
        return self.counter.of_words(n_words) + fixed <= self.limit

    def fits_text(self, system_prompt: str | None, task: str, text: str, reserved_tokens: int) -> bool:
        """``fits`` in Python."""
        left = self.limit - self.count_text(system_prompt or "") - self.units(reserved_tokens) - self.count_text(task)
        return self.counter.at_most(text, left) if text else left >= 0

    def available(self, system_prompt: str | None, task: str, reserved_tokens: int, safety_tokens: int = SAFETY_TOKENS) -> int:
        used = self.count_text(system_prompt or "") + self.count_text(task) + self.units(reserved_tokens) + self.units(safety_tokens)
        return max(1, self.limit - used)


def fallback_word_target(available: int, budget: ContextBudget, token_aware: bool) -> int:
    """Words of a chunk so that it surely fits; with exact tokens a ratio of 1.5 at least is assumed."""
    if budget.kind == "words":
        return max(1, available)
    return max(1, int(available / (max(budget.ratio, 1.5) if token_aware else budget.ratio)))
