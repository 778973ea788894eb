"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, intent, target, negation, report or other. Five transducers rewrite them from
left to right over a clause: the insult transducer marks insults that follow another, the threat transducer threats
that someone intends, the negation transducer weakens both in its scope, the reporting one sets apart what someone is
said to have uttered, and the target one marks what is aimed at somebody. They are composed into one table. A last
transducer reads the result from right to left and marks what is aimed at somebody named after it. What is written
for an insult or threat is the pattern that its clause matched; a text's score is a logistic function of how much it
holds of each pattern. Which words insult, and how much, and what each pattern counts, is learned from labelled
texts; before learning a lone insult counts little.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import hashed_below, parts, settled, share_of, small_or_shuffled, stored

#: Fixed word lists of the grammar's languages (English, French, German, Spanish).
TARGETS = frozenset("you your yourself he she they him her them his their everyone nobody people du dich dir ihr euch er sie tu te toi vous il elle ils elles ellos ellas usted ustedes él ella".split())
NEGATIONS = frozenset("not no never isn aren wasn don doesn nicht kein keine nie pas jamais aucun ni nunca tampoco".split())
REPORTS = frozenset("said says say told claimed wrote quoted called reported allegedly sagte sagt behauptete schrieb dit disait écrit déclaré dijo dice escribió declaró".split())
INTENTS = frozenset("i we ll will gonna going shall ich wir werde werden je nous vais allons yo nosotros voy vamos".split())
#: Verbs of threats: stems with the endings of their kind of verb, and forms that no rule makes.
ENDINGS = {
    "en": " s ed ing".split(" "),
    "de": "e st t en te ten et ete eten end".split(),
    "fr": "er e es ons ez ent ai a é ée és ées ait aient erai era ant".split(),
    "es": "ar o as a amos an é aste ó aron aré ará ado ando".split(),
}
STEMS = {"en": "kill hurt burn stab beat murder shoot destroy", "de": "töt verletz schlag schläg umbring erschieß", "fr": "frapp bless poignard", "es": "mat golpe quem"}
IRREGULAR = "shot burnt stabbed stabbing beaten tuer tue tues tuons tuez tuent tuerai tuera tué tuée umgebracht erschossen détruire détruis détruit destruir destruyo destruye destruyen"
THREATS = frozenset(stem + end for kind, stems in STEMS.items() for stem in stems.split() for end in ENDINGS[kind]) | frozenset(IRREGULAR.split())
#: Labelled rows that are learned from, chosen by a hash of their ids; rows a term must be found in.
SAMPLE, SUPPORT = 20_000, 3
#: Letters of word beginnings that are terms; longer words than LONGEST are terms by their beginnings only.
PREFIXES, LONGEST = (4, 5, 6), 40
#: Terms that may get in by chance, as expected over all that are tested; the standard errors that a weight lies below
#: the term's log odds.
BY_CHANCE, ERRORS = 0.1, 1.64
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n\r()\"]+")
OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT = "OIHVTNR"
#: The patterns that the transducers write and what each counts before anything is learned.
PATTERNS = {
    "I": 0.3,  # an insult by itself
    "C": 0.8,  # an insult after an insult
    "A": 1.0,  # an insult aimed at somebody
    "B": 1.2,  # insults aimed at somebody
    "i": 0.05,  # a negated insult
    "J": 0.1,  # a reported insult
    "j": 0.2,  # a reported insult aimed at somebody
    "H": 0.1,  # a threat's verb by itself
    "G": 0.5,  # an intended threat
    "Q": 0.4,  # a threat's verb with somebody
    "P": 1.2,  # an intended threat against somebody
    "h": 0.0,  # a negated threat
    "K": 0.05,  # a reported threat
}
NAMES = tuple(PATTERNS)
#: How strongly what is learned is pulled to what the patterns count before, and the offset to START.
PULL, START = 1.0, -3.0

Machine = dict[tuple[int, str], tuple[int, str]]


def _scope(opens: str, span: int, rewrites: dict[str, str], alphabet: str) -> Machine:
    """A transducer that rewrites symbols for ``span`` symbols after ``opens``; a span of 0 lasts to the clause's end."""
    machine: Machine = {}
    for state in range((span or 1) + 1):
        for symbol in alphabet:
            left = state if not span else max(state - 1, 0)
            machine[state, symbol] = ((span or 1) if symbol == opens else left, rewrites.get(symbol, symbol) if state else symbol)
    return machine


def compose(first: Machine, second: Machine) -> Machine:
    """The machine that gives what ``second`` writes on what ``first`` writes; states are numbered from 0."""
    numbers, todo, out = {(0, 0): 0}, [(0, 0)], {}
    symbols = sorted({s for _, s in first})
    while todo:
        p, q = todo.pop()
        for symbol in symbols:
            p2, middle = first[p, symbol]
            q2, written = second[q, middle]
            if (p2, q2) not in numbers:
                numbers[p2, q2] = len(numbers)
                todo.append((p2, q2))
            out[numbers[p, q], symbol] = numbers[p2, q2], written
    return out


AIMED = {"I": "A", "C": "B", "J": "j", "H": "Q", "G": "P"}


def grammar() -> tuple[Machine, Machine]:
    """The composed transducers from left to right, and the one from right to left."""
    read = OTHER + INSULT + THREAT + INTENT + TARGET + NEGATION + REPORT
    written = read + "CG" + "ih" + "JK" + "ABjQP"
    out = _scope(INSULT, 5, {"I": "C"}, read)
    for machine in (
        _scope(INTENT, 5, {"H": "G"}, written),
        _scope(NEGATION, 3, {"I": "i", "C": "i", "H": "h", "G": "h"}, written),
        _scope(REPORT, 0, {"I": "J", "C": "J", "H": "K", "G": "K"}, written),
        _scope(TARGET, 4, AIMED, written),
    ):
        out = compose(out, machine)
    return out, _scope(TARGET, 3, AIMED, written)


FORWARD, BACKWARD = grammar()


class Scorer:
    """``weights``: term to weight; a word beginning ends with ``*``. ``counts``: what each pattern counts; ``offset``."""

    def __init__(self, weights: dict[str, float], counts: dict[str, float] = PATTERNS, offset: float = START):
        self.words = {k: v for k, v in weights.items() if not k.endswith("*")}
        self.starts = {n: {k[:-1]: v for k, v in weights.items() if len(k) == n + 1 and k.endswith("*")} for n in PREFIXES}
        self.counts, self.offset = counts, offset

    def weight(self, word: str) -> float:
        """The weight of the word itself or else of its longest known beginning."""
        if word in self.words:
            return self.words[word]
        for n in reversed(PREFIXES):
            if (w := self.starts[n].get(word[:n])) is not None and len(word) >= n:
                return w
        return 0.0

    def patterns(self, text: str | None) -> dict[str, float]:
        """The sum of the weights of what matched each pattern; a threat's verb weighs 1."""
        text = (text or "").lower()
        vocabulary = set(WORD.findall(text))
        insults = {w: x for w in vocabulary if (x := self.weight(w))}
        out: dict[str, float] = {}
        if not insults and not vocabulary & THREATS:
            return out
        for clause in CLAUSE.split(text):
            words = WORD.findall(clause)
            if not any(w in insults or w in THREATS for w in words):
                continue
            state, line = 0, []
            for w in words:
                symbol = INSULT if w in insults else THREAT if w in THREATS else NEGATION if w in NEGATIONS else REPORT if w in REPORTS else TARGET if w in TARGETS else INTENT if w in INTENTS else OTHER
                state, written = FORWARD[state, symbol]
                line.append(written)
            state = 0
            for w, symbol in zip(reversed(words), reversed(line), strict=True):
                state, written = BACKWARD[state, symbol]
                if written in PATTERNS:
                    out[written] = out.get(written, 0.0) + insults.get(w, 1.0)
        return out

    def score(self, text: str | None) -> float:
        x = self.offset + math.fsum(self.counts[k] * math.log1p(v) for k, v in self.patterns(text).items())
        return round(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))), 9)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _terms(text: str | None) -> set[str]:
    words = set(WORD.findall((text or "").lower()))
    return {w for w in words if len(w) <= LONGEST} | {w[:n] + "*" for n in PREFIXES for w in words if len(w) >= n}


def family(text: str | None, words: int = 5) -> int:
    """A min-hash over the text's word shingles: near copies mostly have the same, so they are learned from once."""
    found = (text or "").lower().split()
    return min((zlib.crc32(" ".join(found[i : i + words]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(found) - words + 1))), default=0)


def term_weight(bad: int, good: int, all_bad: int, all_good: int) -> float:
    """How much a term found in ``bad`` toxic and ``good`` other texts speaks for toxicity: its log odds, at the least."""
    odds = math.log((bad + 0.5) / (all_bad + 1)) - math.log((good + 0.5) / (all_good + 1))
    return odds - ERRORS * math.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))


def _cover(found: dict[str, list[int]], weights: dict[str, float], times: int = 3) -> set[str]:
    """All whole words, and the word beginnings needed so that each toxic text has ``times`` words.

    Beginnings are taken by how many texts they add. Terms with the same first letters are forms of one word and
    count once for a text.
    """
    form = {t: t.rstrip("*")[: PREFIXES[0]] for t in found}
    need = Counter({d: times for ids in found.values() for d in ids})
    has: set[tuple[int, str]] = set()

    def take(term: str) -> None:
        for d in found[term]:
            if (d, form[term]) not in has:
                has.add((d, form[term]))
                need[d] -= need[d] > 0

    words = {t for t in found if not t.endswith("*")}
    for t in sorted(words):
        take(t)
    gain = {t: len(ids) for t, ids in found.items() if t not in words}
    chosen: set[str] = set()
    while gain:
        best = max(gain, key=lambda t: (gain[t] * weights[t], t))
        now = sum(need[d] > 0 and (d, form[best]) not in has for d in found[best])
        if now < gain[best]:  # stale: the others may be better by now
            gain[best] = now
            if now < SUPPORT:
                del gain[best]
            continue
        chosen.add(best)
        del gain[best]
        take(best)
    return words | chosen


def fit_counts(rows: Iterable[dict[str, float]], labels: Iterable[int]) -> tuple[dict[str, float], float]:
    """Logistic regression on the patterns by Newton steps, pulled to PATTERNS; no pattern counts less than nothing."""
    x = np.array([[1.0, *(math.log1p(r.get(k, 0.0)) for k in NAMES)] for r in rows])
    y = np.array(list(labels), float)
    start = np.array([START, *PATTERNS.values()])
    pull = np.array([0.01, *[PULL] * len(NAMES)])
    beta = start.copy()
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - pull * (beta - start)
        free = np.ones(len(beta), bool)
        free[1:] = (beta[1:] > 0) | (slope[1:] > 0)
        hessian = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(pull)
        step = np.zeros(len(beta))
        step[free] = np.linalg.solve(hessian[np.ix_(free, free)], slope[free])
        step = np.clip(step, -2, 2)
        after = beta + step
        after[1:] = np.maximum(after[1:], 0)
        moved = np.abs(after - beta).max()
        beta = after
        if moved < 1e-9:
            break
    return {k: round(float(b), 9) for k, b in zip(NAMES, beta[1:], strict=True)}, round(float(beta[0]), 9)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """A scorer from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; held-out rows are not looked at.

    An id or a text that is labelled both ways counts as toxic. Of near copies of one label one is learned from.
    """
    rows = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    one = stored(rows.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    ids = small_or_shuffled(stored(one.where(hashed_below(F.col("doc_id"), share_of(sample, one.count())))))
    given = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([family(t) for t in b.column(0).to_pylist()], pa.int64())], names=["text", "toxic", "family"])

    texts = stored(given.mapInArrow(families, "text string, toxic int, family bigint").groupBy("family", "toxic").agg(F.min("text").alias("text")))
    n = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad:
        return Scorer({})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for t in _terms(text):
                    seen.setdefault(t, [0, 0])[toxic] += 1
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["term", "good", "bad"])

    counted = texts.select("text", "toxic").mapInArrow(count, "term string, good bigint, bad bigint").groupBy("term").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    tested = settled(lambda: counted.where(F.col("bad") + F.col("good") >= SUPPORT))
    share, texts_with = bad / (bad + good), F.col("bad") + F.col("good")
    # Chernoff's bound of the chance that so many of a term's texts are toxic if it says nothing about them
    surprise = F.col("bad") * F.log(F.col("bad") / (texts_with * share)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (texts_with * max(1 - share, 1e-9)))).otherwise(0.0)
    telling = tested.where((F.col("bad") >= SUPPORT) & (F.col("bad") > texts_with * share) & (surprise > math.log(max(tested.count(), 1) / BY_CHANCE)))
    weights = {r["term"]: w for r in telling.collect() if (w := term_weight(r["bad"], r["good"], bad, good)) > 0}
    known = set(weights)

    def point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            found = [sorted(known & _terms(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["terms"])

    found: dict[str, list[int]] = {}
    for d, row in enumerate(texts.where("toxic = 1").select("text").mapInArrow(point, "terms array<string>").collect()):
        for t in row["terms"]:
            found.setdefault(t, []).append(d)
    scorer = Scorer({t: round(weights[t], 6) for t in sorted(_cover(found, weights))})

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            made = [scorer.patterns(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([[m.get(k, 0.0) for k in NAMES] for m in made], pa.list_(pa.float64())), b.column(1).cast(pa.int32())], names=["x", "y"])

    points = sorted((tuple(r["x"]), r["y"]) for r in texts.select("text", "toxic").mapInArrow(matched, "x array<double>, y int").collect())
    scorer.counts, scorer.offset = fit_counts([dict(zip(NAMES, x, strict=True)) for x, _ in points], [y for _, y in points])
    return scorer


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    A null or empty text has the score of a text without matches. Without labels everything scores below 0.5.
    Repeated rows keep a row each, repeated texts are learned from once; a null id is never learned from. Texts of
    any length are read whole; other columns are ignored, and an empty table gives none.
    """
    scorer = learn(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            scores = [scorer.score(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
