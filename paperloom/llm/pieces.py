"""SentencePiece encoding and decoding with N-best segmentations.

A text is a lattice of pieces with scores; its N best segmentations are found by a backward A* search for which
the forward Viterbi scores are exact heuristics. Pieces never cross the start of a word, so the lattice of a text
is the chain of its words' lattices: each distinct word is searched once and kept in a bounded cache, and the
search over the chain only opens the words whose second best segmentation costs least.
"""

from __future__ import annotations

import gc
import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.llm.common import parts

SPACE = "▁"
BEST = 4
#: A generation of words that are kept: so many, or so many bytes of letters and ids. Words
#: longer than LONG are searched in typed arrays.
CACHED_WORDS, CACHED_BYTES, LONG = 400_000, 96 << 20, 1000
SCHEMA = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, best_score double, nbest_scores array<double>, nbest_pieces array<bigint>, decoded boolean"
#: A word is its leading blanks and what follows them; lines are apart.
WORDS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


class Lattice:
    """Pieces of a model file with their scores as the weights of a lattice."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = {i: model.get_score(i) for i in plain}
        #: A letter without a piece costs more than any merged piece and becomes its bytes; so do pieces that no merge makes.
        self.missing = min(s for s in scores.values() if s > -1e8) - 10.0
        self.scores = {model.id_to_piece(i): (max(s, self.missing), i) for i, s in scores.items()}
        self.names = {i: model.id_to_piece(i) for i in plain}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.of_byte = {i: b for b, i in enumerate(self.bytes)}
        assert not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.scores), "a piece crosses words"
        self.longest = max(map(len, self.scores))
        #: Score of each piece, None for what is only the beginning of pieces.
        self.prefixes: dict[str, float | None] = {p[:n]: None for p in self.scores for n in range(1, len(p))}
        self.prefixes |= {p: s for p, (s, _) in self.scores.items()}
        #: Neighbours within pieces; between letters that are none, every segmentation has a cut.
        self.pairs = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        self._trie()
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.held = 0
        #: The last long word and its forward pass.
        self.last: tuple[str, tuple] = ("", ([0.0], float("inf"), [0]))
        self.lists: dict[tuple[str, int], list] = {}

    def _trie(self) -> None:
        """The prefixes as numbered nodes: a node's child by a letter is found by search in one sorted array."""
        number = {p: k for k, p in enumerate(sorted(self.prefixes, key=len), 1)}
        keys = np.array([number.get(p[:-1], 0) << 21 | ord(p[-1]) for p in number], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(number.values()), np.int32)[order]
        self.node_score = np.full(len(number) + 1, np.nan)
        self.node_id = np.full(len(number) + 1, -1, np.int32)
        for p, (score, i) in self.scores.items():
            self.node_score[number[p]], self.node_id[number[p]] = score, i

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Children of nodes by letters, 0 where there is none."""
        key = node.astype(np.int64) << 21 | letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.child[at], 0)

    @staticmethod
    def normal(text: str | None) -> str:
        """The text with blanks as SPACE and one put before it; an empty text stays empty."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def edges(self, word: str, end: int) -> Iterator[tuple[int, float]]:
        """Starts and scores of the pieces of ``word`` that end at ``end``."""
        for start in range(max(0, end - self.longest), end):
            if (x := self.scores.get(word[start:end])) is not None:
                yield start, x[0]
            elif start == end - 1:
                yield start, self.missing

    def forward(self, word: str) -> tuple[list[float], float]:
        """The Viterbi score of each prefix, and how much less the second best segmentation of the word scores."""
        best, gap, _ = self.viterbi(word)
        return best, gap

    def viterbi(self, word: str) -> tuple[list[float], float, list[int]]:
        """``forward`` and the start of the last piece of the best segmentation of each prefix."""
        if len(word) > LONG and self.last[0] == word:
            return self.last[1]
        size, low = len(word), float("-inf")
        if size > LONG:
            best, second, start = array("d", [low]) * (size + 1), array("d", [low]) * (size + 1), array("i", [0]) * (size + 1)
        else:
            best, second, start = [low] * (size + 1), [low] * (size + 1), [0] * (size + 1)
        best[0] = 0.0
        prefixes, missing = self.prefixes, self.missing
        for a in range(size):
            one, two = best[a], second[a]
            single = prefixes.get(word[a])
            if single is None:
                single = missing
            for b in range(a + 1, size + 1):
                if b == a + 1:
                    s = single
                else:
                    s = prefixes.get(word[a:b], 1.0)  # scores are never positive
                    if s is None:
                        continue
                    if s > 0.0:
                        break
                x = one + s
                if x > best[b]:
                    second[b] = max(best[b], two + s)
                    best[b] = x
                    start[b] = a
                else:
                    y = two + s
                    if x > second[b]:
                        second[b] = x
                    if y > second[b]:
                        second[b] = y
        if size > LONG:
            self.last = word, (best, best[-1] - second[-1], start)
        return best, best[-1] - second[-1], start

    def search(self, word: str, most: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``most`` best segmentations of a word by A*, from its end back.

        The forward scores are exact heuristics: from any place the best way on is the Viterbi way, so a segmentation
        that is taken up is walked to the word's start at once, and what could have been done otherwise on the way
        waits with its exact cost. An open entry stands for a set of segmentations of its own, so no more than
        ``most`` entries are ever needed. An entry is only where it leaves the Viterbi way; ties: the first found.
        """
        best, _, before = self.viterbi(word)
        heap: list[tuple[float, int, tuple]] = [(0.0, 0, ())]
        found, number = [], 0
        while heap and len(found) < most:
            lost, _, turns = heapq.heappop(heap)
            found.append((best[-1] - lost, self._cuts(before, len(word), turns)))
            if len(found) == most:
                break
            end = turns[-1][1] if turns else len(word)
            limit = max([x[0] for x in heap], default=0.0) if len(heap) >= most - len(found) else float("inf")
            fresh = []
            while end and limit > lost:  # nothing that comes can be better than ``lost``
                for start, s in self.edges(word, end):
                    if start != before[end]:
                        gap = lost + best[end] - (best[start] + s)
                        if gap < limit:
                            number += 1
                            fresh.append((gap, number, (*turns, (end, start))))
                if len(fresh) > 64:
                    fresh = heapq.nsmallest(most - len(found), fresh)
                    limit = min(limit, fresh[-1][0])
                end = before[end]
            heap = heapq.nsmallest(most - len(found), [*heap, *fresh])  # sorted, and so a heap
        return found

    @staticmethod
    def _cuts(before: list[int], size: int, turns: tuple) -> tuple[int, ...]:
        """The cuts of the way from the end that leaves the Viterbi way where ``turns`` say."""
        leave, out, at = dict(turns), [size], size
        while at:
            at = leave.get(at, before[at])
            out.append(at)
        return tuple(reversed(out))

    def ids(self, word: str, cuts: tuple[int, ...]) -> tuple[int, ...]:
        out: list[int] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if (x := self.scores.get(word[a:b])) is not None:
                out.append(x[1])
            else:
                out += [self.bytes[c] for c in word[a:b].encode("utf-8", "surrogatepass")]
        return tuple(out)

    def first(self, words: list[str]) -> list[tuple[float, float, bytes, str]]:
        """Of each word the best score, its lead over the second best, the best ids and the text that they give back."""
        try:
            return list(map(self.young.__getitem__, words))
        except KeyError:
            self._learn(set(words).difference(self.young))
            return list(map(self.young.__getitem__, words))

    def trim(self) -> None:
        """Lets the old generation go when the young one is full."""
        if len(self.young) > CACHED_WORDS or self.held > CACHED_BYTES:
            self.old, self.young, self.held = self.young, {}, 0

    def _learn(self, words: set[str]) -> None:
        """Makes words known: each is the chain of what lies between its sure cuts, searched and kept by itself."""
        young, old, pairs = self.young, self.old, self.pairs
        parted, fresh = {}, set()
        for w in words:
            if (x := old.get(w)) is not None:
                young[w] = x
                continue
            if w[1:].isascii():  # letters of this kind follow each other in some piece, all but a sign at the end
                cuts = [len(w) - 1] if len(w) > 1 and w[-2:] not in pairs else []
            else:
                cuts = [i for i in range(1, len(w)) if w[i - 1 : i + 1] not in pairs]
            if not cuts:
                fresh.add(w)
                continue
            parts = parted[w] = [w[a:b] for a, b in zip([0, *cuts], [*cuts, len(w)], strict=True)]
            for p in parts:
                if p not in young:
                    if (x := old.get(p)) is not None:
                        young[p] = x
                    else:
                        fresh.add(p)
        short = [p for p in fresh if len(p) <= 40]
        for i in range(0, len(short), 20_000):
            self._together(short[i : i + 20_000])
        for p in fresh:
            if p not in young:
                young[p] = self._alone(p)
        self.held += sum(3 * len(w) + len(young[w][2]) for w in fresh)
        for w, parts in parted.items():
            found = [young[p] for p in parts]
            self.held += 6 * len(w)
            young[w] = sum([f[0] for f in found]), min([f[1] for f in found]), b"".join([f[2] for f in found]), "".join([f[3] for f in found])

    def _alone(self, word: str) -> tuple[float, float, bytes, str]:
        best, gap, start = self.viterbi(word)
        cuts, end = [len(word)], len(word)
        while end:  # the way back over exact scores is A* with nothing to choose
            end = start[end]
            cuts.append(end)
        ids = self.ids(word, tuple(reversed(cuts)))
        return best[-1], gap, array("I", ids).tobytes(), self.plain(ids)

    def _together(self, words: list[str]) -> None:
        """``_alone`` for many words at once; those with letters that have no piece are left out.

        Places are numbered through all words, with one more for each word's end. The pieces from every place are
        found by walking the trie from all places together; then the places are relaxed from left to right.
        """
        size = np.array([len(w) for w in words])
        first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        letters = np.frombuffer("\x00".join([*words, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        place = np.arange(len(letters)) - np.repeat(first, size + 1)
        rest = np.repeat(size, size + 1) - place
        at = np.flatnonzero(rest > 0)
        node = self.step(np.zeros(len(at), np.int32), letters[at])
        froms, lengths, nodes = [], [], []
        for length in range(1, self.longest + 1):
            score = self.node_score[node]
            hit = ~np.isnan(score) if length > 1 else np.ones(len(at), bool)
            froms.append(at[hit])
            lengths.append(np.full(hit.sum(), length))
            nodes.append(node[hit])
            on = (node > 0) & (rest[at] > length)
            at, node = at[on], node[on]
            node = self.step(node, letters[at + length])
            at, node = at[node > 0], node[node > 0]
            if not len(at):
                break
        source, piece = np.concatenate(froms), np.concatenate(nodes)
        target = source + np.concatenate(lengths)
        score = np.where(np.isnan(self.node_score[piece]), self.missing, self.node_score[piece])
        order = np.argsort(place[source], kind="stable")
        ends = np.cumsum(np.bincount(place[source]))
        best, second, by = np.full(len(letters), -np.inf), np.full(len(letters), -np.inf), np.zeros(len(letters), np.int64)
        best[first] = 0.0
        for a, b in zip([0, *ends], ends, strict=False):
            e = order[a:b]  # pieces from the same place of their words: no two of them end at the same place
            t = target[e]
            one, two, now = best[source[e]] + score[e], second[source[e]] + score[e], best[t]
            better = one > now
            second[t] = np.maximum(np.where(better, now, np.maximum(one, second[t])), two)
            best[t] = np.where(better, one, now)
            by[t] = np.where(better, e, by[t])
        last = first + size
        ways, owner, now, whose = [], [], last.copy(), np.arange(len(words))
        while len(now):
            e = by[now]
            ways.append(self.node_id[piece[e]])
            owner.append(whose)
            now = source[e]
            on = now > first[whose]
            now, whose = now[on], whose[on]
        ways, owner = np.concatenate(ways[::-1]), np.concatenate(owner[::-1])
        order = np.argsort(owner, kind="stable")
        ids = ways[order].astype("<u4")
        ends = np.cumsum(np.bincount(owner, minlength=len(words))).tolist()
        raw, names = ids.tobytes(), [self.names.get(i, "") for i in ways[order].tolist()]
        lacks = np.zeros(len(words), bool)
        lacks[owner[ways < 0]] = True
        a = 0
        for w, b, s, g, bad in zip(words, ends, best[last].tolist(), (best[last] - second[last]).tolist(), lacks.tolist(), strict=True):
            if not bad:
                self.young[w] = s, g, raw[4 * a : 4 * b], "".join(names[a:b])
            a = b

    def nbest(self, text: str | None, most: int = BEST) -> tuple[bytes, list[tuple[float, int]], str]:
        """The best ids of a text, score and number of pieces of its ``most`` best segmentations, and the text back."""
        return self.nbest_words(WORDS.findall(self.normal(text)), most)

    def nbest_words(self, words: list[str], most: int = BEST) -> tuple[bytes, list[tuple[float, int]], str]:
        """``nbest`` of a text that is already cut into words."""
        known = self.first(words)
        ids = b"".join([x[2] for x in known])
        score = math.fsum([x[0] for x in known])
        opened = np.argsort(np.array([x[1] for x in known]), kind="stable")[: most - 1].tolist()
        lists = []
        for k in opened:
            key = (words[k], most)
            if (known_list := self.lists.get(key)) is None:
                known_list = [(s, len(self.ids(words[k], cuts))) for s, cuts in self.search(words[k], most)]
                if len(words[k]) <= LONG:
                    if len(self.lists) >= CACHED_WORDS // 10:
                        self.lists.clear()
                    self.lists[key] = known_list
            lists.append(known_list)
        heap, seen, found = [(-score, (0,) * len(lists))], {(0,) * len(lists)}, []
        while heap and len(found) < most:
            cost, choice = heapq.heappop(heap)
            count = len(ids) // 4 + sum(x[c][1] - x[0][1] for x, c in zip(lists, choice, strict=True))
            found.append((-cost, count))
            for k, x in enumerate(lists):
                after = (*choice[:k], choice[k] + 1, *choice[k + 1 :])
                if after[k] < len(x) and after not in seen:
                    seen.add(after)
                    heapq.heappush(heap, (cost + x[choice[k]][0] - x[after[k]][0], after))
        return ids, found, "".join([x[3] for x in known])[1:].replace(SPACE, " ")

    def plain(self, ids: Sequence[int]) -> str:
        """What ids stand for: pieces, and runs of bytes as UTF-8."""
        out, pending = [], bytearray()
        for i in ids:
            if i in self.of_byte:
                pending.append(self.of_byte[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "surrogatepass"))
                pending = bytearray()
            out.append(self.names[i])
        out.append(pending.decode("utf-8", "surrogatepass"))
        return "".join(out)

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids, blanks back and the one put before it gone."""
        return self.plain(ids)[1:].replace(SPACE, " ")


@lru_cache(2)
def lattice_of(path: str) -> Lattice:
    """One lattice for each worker process."""
    return Lattice(path)


def encode(docs: DataFrame, model_path: str, most: int = BEST) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> SCHEMA for each row of ``docs``.

    ``decoded`` says whether the ids give the text back, with the character U+2581 as a blank. A null or empty text
    has no pieces, one segmentation with score 0 and is decoded. Fewer segmentations than ``most`` are returned
    where there are no more. Repeated rows keep a row each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(model_path)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_())
        gc.disable()  # nothing here is cyclic, and the collector would walk the cached words again and again
        try:
            for b in parts(batches):
                rows = []
                texts = b.column(1).to_pylist()
                # the words of the batch are learned together, so that each text finds its own
                lattice.trim()
                split = [WORDS.findall(lattice.normal(t)) for t in texts]
                lattice.first(list(set().union(*split)))
                for doc_id, text, words in zip(b.column(0).to_pylist(), texts, split, strict=True):
                    ids, found, back = lattice.nbest_words(words, most)
                    rows.append((doc_id, len(ids) // 4, zlib.crc32(ids), found[0][0], [s for s, _ in found], [n for _, n in found], back == (text or "").replace(SPACE, " ")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])
        finally:
            gc.enable()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
