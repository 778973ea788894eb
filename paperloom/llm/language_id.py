"""Language ID by rank-order n-gram profiles (Cavnar and Trenkle, "N-Gram-Based Text Categorization", 1994).

A profile is the ranked list of the most frequent letter n-grams, 1 to 3 long with a mark at word ends, of a
sample of documents of a language. A text's own most frequent n-grams are compared with each profile: the
out-of-place distance sums how far each n-gram's rank is from its rank in the profile.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.common import hashed_below, parts

#: Ranks of a profile and of a text; an n-gram outside the profile counts as PROFILE ranks away.
PROFILE, TOP = 400, 300
#: About so many documents of each language, chosen by a hash of their ids, make its profile.
SAMPLE = 2000
#: Languages at most; their profiles are held on the driver and by every task.
MOST_LANGUAGES = 500
UNKNOWN = "und"
_PART = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of the whole text; three code points of 21 bits make a code."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points] if len(points) else np.zeros(0, bool)
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = np.full(len(points) + 2, 32, np.int64)
    marked[1:-1][letter] = points[letter]
    marked = marked[np.r_[True, (marked[1:] != 32) | (marked[:-1] != 32)]]
    found = []
    for i in range(0, len(marked), _PART):
        one = marked[i : i + _PART + 2]
        two = (one[:-1] << 21) | one[1:]
        three = ((two[:-1] << 21) | one[2:])[one[1:-1] != 32]
        last = i + _PART + 2 >= len(marked)
        single = one if last else one[:_PART]
        pairs = two if last else two[:_PART]
        found.append(np.unique(np.concatenate([single[single != 32], pairs, three]), return_counts=True))
        if last:
            break
    if len(found) == 1:
        return found[0]
    codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent codes, in order; ties go to the smaller code."""
    if len(codes) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")][:top]


class Profiles:
    """Ranks of each n-gram in each language's profile."""

    def __init__(self, ranks: dict[str, list[int]], size: int = PROFILE):
        self.size = size
        self.languages = sorted(ranks)
        self.codes = np.unique(np.array([c for codes in ranks.values() for c in codes], np.int64))
        self.rank = np.full((len(self.codes) + 1, len(self.languages)), -1, np.int32)
        for k, name in enumerate(self.languages):
            self.rank[np.searchsorted(self.codes, np.array(ranks[name], np.int64)), k] = np.arange(len(ranks[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and one less the share of the largest distance; ties go to the first name."""
        own = ranked(*ngrams(text))
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        ranks = np.where((self.codes[at] == own)[:, None], self.rank[at], -1)
        away = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - np.arange(len(own))[:, None]), self.size)).sum(axis=0)
        best = int(np.argmin(away))
        return self.languages[best], round(1 - float(away[best]) / (self.size * len(own)), 6)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE, size: int = PROFILE) -> Profiles:
    """Profiles from ``docs(doc_id, text, lang)``: rows with a language and an id that is not held out."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    there = known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(there) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not there:
        return Profiles({}, size)
    share = F.lit(1.0)
    for row in there:
        if row["count"] > sample:
            share = F.when(F.col("lang") == row["lang"], F.lit(sample / row["count"])).otherwise(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for name in dict.fromkeys(langs):
                found = [ngrams(t) for t, x in zip(texts, langs, strict=True) if x == name]
                codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])

    counted = known.where(hashed_below(F.col("doc_id"), share)).select("text", "lang").mapInArrow(run, "lang string, code bigint, n bigint")
    summed = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    ranks: dict[str, list[int]] = {row["lang"]: [] for row in there}
    for row in sorted(summed.withColumn("place", place).where(F.col("place") <= size).collect(), key=lambda r: r["place"]):
        ranks[row["lang"]].append(row["code"])
    return Profiles({k: v for k, v in ranks.items() if v}, size)


def _predict(docs: DataFrame, profiles: Profiles, names: list[str], schema: str) -> DataFrame:
    """Adds the prediction to columns that are handed through as they are; ``text`` must be the last of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            found = [profiles.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=names)

    return docs.mapInArrow(run, schema)


def language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` -> ``(doc_id, held_out, lang_pred, score)`` for each row of ``docs``.

    ``lang`` is only learned from, never an input of a prediction. A null text or one without letters is UNKNOWN
    with score 0, as is everything if there is nothing to learn from. Repeated rows keep a row each; a null id is
    neither held out nor learned from. Other columns are ignored.
    """
    profiles = learn(docs, sample)
    return _predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), profiles, ["doc_id", "held_out", "lang_pred", "score"], "doc_id bigint, held_out boolean, lang_pred string, score double")


#: A text below this score resembles no language.
LEAST_SCORE = 0.15


def language_filter(docs: DataFrame, least_score: float = LEAST_SCORE, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that resemble one of the learned languages, with the columns of ``docs``.

    Texts without letters, null texts and those below ``least_score`` go.
    """
    profiles = learn(docs, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            scores = [profiles.predict(t.as_py()) for t in b.column("text")]
            stay = b.filter(pa.array([x != UNKNOWN and s >= least_score for x, s in scores], pa.bool_()))
            if stay.num_rows:
                yield stay

    return docs.mapInArrow(run, docs.schema)
