"""Packing, pieces, language ID, chat formatting and toxicity."""

import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paperloom.llm import chat_format as C
from paperloom.llm import language_id as L
from paperloom.llm import packing as K
from paperloom.llm import toxicity as X
from paperloom.llm.pieces import Lattice, encode
from paperloom.llm.queries import chat

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = ["", "a<|endoftext|>b <|startoftext|>x", "É é é İi Σας ΣΑΣ", "tab\there nb x", "don't 's we'll.\n\n", "a.,b,. c, D. É,", "日本語 x1y2 ½", "\x00\x1f", "Ab.. I'M,", "ß ﬁ Å", "a‐b ‐ 😂", "word" * 3000]


def test_word_cache_gives_the_tokenizers_ids():
    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = ODD + [" ".join(ODD), *ODD]
    got = K.tokenizer_ids(WORD_BPE)(texts)
    assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text())
def test_word_cache_on_any_text(text):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    assert K.tokenizer_ids(WORD_BPE)([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_closest_subset_equals_brute_force(counts, room):
    taken = K.closest_subset(counts, room)
    assert all(0 < n <= counts[k] for k, n in taken.items())
    total = sum(k * n for k, n in taken.items())
    items = [k for k, n in counts.items() for _ in range(n)]
    sums = {0}
    for x in items:
        sums |= {s + x for s in sums if s + x <= room}
    assert total == max(sums)


def check_pieces(rows, docs, capacity=K.CAPACITY):
    """Every id once, sequences gapless and within the capacity; returns the padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r[0], []).append(r)
        by_sequence.setdefault(r[5], []).append(r)
    assert set(by_doc) == set(docs)
    for doc, pieces in by_doc.items():
        at = 0
        for _, start, length, crc, total, _, _ in sorted(pieces, key=lambda r: r[1]):
            assert start == at and total == len(docs[doc]) and length > 0
            assert crc == zlib.crc32(docs[doc][start : start + length].astype("<u4").tobytes())
            at += length
        assert at == len(docs[doc])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r[6]):
            assert r[6] == at
            at += r[2]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 150), max_size=60), st.sampled_from([1, 5, 20]))
def test_packer_keeps_every_token(lengths, waiting):
    docs = {i: np.arange(n, dtype="<u4") + i for i, n in enumerate(lengths)}
    packer = K.Packer(7, 64, waiting)
    rows = [p for i, ids in docs.items() for p in packer.add(i, ids)] + list(packer.end())
    assert check_pieces(rows, docs, 64) == 0


def test_pack_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x " * 9000)], "doc_id bigint, text string")
    given_ = docs.unionByName(extra)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in given_.collect()}
    rows = [tuple(r) for r in K.pack(given_, WORD_BPE).collect()]
    assert check_pieces(rows, want) == 0
    assert K.pack(given_.limit(0), WORD_BPE).count() == 0


def test_pack_odd_rows(spark):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = ["a b", "a b", None, "y" * 3000 + " z", "é " * 20000]
    rows = [(k if k != 3 else None, t, "x", 5, "z") for k, t in enumerate(texts)] + [(0, "a b", "x", 5, "z")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, start int, sequence_id string")
    got = K.pack(frame, WORD_BPE)
    assert got.columns == list(K.NAMES)
    rows_ = [tuple(r) for r in got.collect()]
    total = {}
    for r in rows_:
        total[r[0]] = total.get(r[0], 0) + r[2]
    size = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert total == {0: 2 * size("a b"), 1: size("a b"), 2: 1, None: size(texts[3]), 4: size(texts[4])}


def test_subset_sums_lower_the_number_of_cuts():
    lengths = [int(x) for x in np.random.default_rng(5).lognormal(6, 1.2, 3000).clip(1, 4000)]
    docs = {i: np.arange(n, dtype="<u4") for i, n in enumerate(lengths)}

    def pieces(waiting):
        packer = K.Packer(0, K.CAPACITY, waiting)
        return len([p for i, ids in docs.items() for p in packer.add(i, ids)] + list(packer.end()))

    assert pieces(K.WAITING) < 1.1 * len(docs) < pieces(1)


def test_long_words_are_not_kept(monkeypatch):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    monkeypatch.setattr(K, "CACHED_BYTES", 200)
    encode_ = K.tokenizer_ids.__wrapped__(WORD_BPE)
    for texts in (["ab cd", "x" * 1500 + " y"], ["ab", "z" * 2000 + "," + " ab", "some more words and more"]):
        assert [x.tolist() for x in encode_(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


LATTICE = Lattice(PIECES)


def all_segmentations(word):
    """Scores of all ways to cut a word into pieces, best first."""
    out = []
    for cuts in itertools.product((0, 1), repeat=max(len(word) - 1, 0)):
        parts, now = [], word[:1]
        for c, ch in zip(cuts, word[1:], strict=True):
            if c:
                parts.append(now)
                now = ""
            now += ch
        parts.append(now)
        score = 0.0
        for p in parts:
            if p in LATTICE.scores:
                score += LATTICE.scores[p][0]
            elif len(p) == 1:
                score += LATTICE.missing
            else:
                break
        else:
            out.append(score)
    return sorted(out, reverse=True)


@pytest.mark.parametrize("word", ["▁the", "▁and", "▁Straße", "▁ab", "▁x日本", "▁oooo", "▁", "▁▁a", "ing", "🙂a", "▁reading"])
def test_nbest_of_a_word_equals_brute_force(word):
    want = all_segmentations(word)
    got = [s for s, _ in LATTICE.search(word, 6)]
    assert got == pytest.approx(want[:6])
    best, gap = LATTICE.forward(word)
    assert best[-1] == pytest.approx(want[0])
    assert gap == (pytest.approx(want[0] - want[1]) if len(want) > 1 else float("inf"))


@pytest.mark.parametrize("text", ["a b", "is it so", "to be or", "x y z", "an ox\nis", ""])
def test_nbest_of_a_text_equals_brute_force(text):
    words = __import__("re").findall("\n|▁*[^▁\n]+|▁+", LATTICE.normal(text))
    want = sorted((sum(x) for x in itertools.product(*map(all_segmentations, words))), reverse=True)[:5]
    ids, found, back = LATTICE.nbest(text, 5)
    assert [s for s, _ in found] == pytest.approx(want)
    assert len(ids) == 4 * found[0][1] and back == text


@settings(max_examples=80, deadline=None)
@given(st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="▁")))
def test_decoding_gives_the_text_back(text):
    ids, _, back = LATTICE.nbest(text)
    assert LATTICE.decode(np.frombuffer(ids, "<u4").tolist()) == text == back


def test_encode_query_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "日本 🙂\n\n x"), (4, "w" * 20000), (5, "a▁b")]
    got = encode(spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, ids string"), PIECES).collect()
    assert len(got) == 7 and all(r.decoded for r in got)
    assert [r.n_pieces for r in got if r.doc_id in (1, 2)] == [0, 0]
    assert all(list(r.nbest_scores) == sorted(r.nbest_scores, reverse=True) and r.nbest_scores[0] == r.best_score for r in got)
    assert encode(spark.createDataFrame([], "doc_id bigint, text string"), PIECES).count() == 0


def test_a_very_long_word_takes_time_and_memory_in_proportion():
    import random
    import time
    import tracemalloc

    letters = random.Random(3)
    word = "".join(letters.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    began = time.time()
    ids, found, back = LATTICE.nbest(word)
    assert time.time() - began < 30 and back == word and len(found) == 4 and len(ids) == 4 * found[0][1]
    tracemalloc.start()
    LATTICE.nbest("b" + word[:200_000])
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


def brute_nbest(text, most):
    """Scores and numbers of pieces of the best segmentations of a whole text, over all of them."""
    best = [(0.0, 0)]
    for w in __import__("re").findall("\n|▁*[^▁\n]+|▁+", LATTICE.normal(text)):
        ways = []
        for cuts in itertools.product((0, 1), repeat=len(w) - 1):
            ends = [0, *[i for i, c in enumerate(cuts, 1) if c], len(w)]
            pieces = [w[a:b] for a, b in itertools.pairwise(ends)]
            if all(p in LATTICE.scores or len(p) == 1 for p in pieces):
                ways.append((sum(LATTICE.scores[p][0] if p in LATTICE.scores else LATTICE.missing for p in pieces), pieces))
        ways.sort(key=lambda x: -x[0])
        best = sorted(((s + x, [*p, *q] if p else q) for s, p in best for x, q in ways[: 2 * most]), key=lambda x: -x[0])[: 4 * most]
    return best


def test_encode_query_equals_brute_force(spark):
    texts = ["a b", "is it so", "to be or not", "x y z", "an ox\nis", "日本 x", "é ü", "hello you", "", "oooo aaaa"]
    got = {r.doc_id: r for r in encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), PIECES).collect()}
    for i, t in enumerate(texts):
        want = brute_nbest(t, 4)
        assert list(got[i].nbest_scores) == pytest.approx([s for s, _ in want][:4]) and got[i].best_score == pytest.approx(want[0][0])
        crcs = set()
        for s, pieces in want:
            if s == pytest.approx(want[0][0]):
                ids = [x for p in pieces or [] for x in ([LATTICE.scores[p][1]] if p in LATTICE.scores else [LATTICE.bytes[c] for c in p.encode()])]
                crcs.add((zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)))
        assert (got[i].ids_crc32, got[i].n_pieces) in crcs


def brute_language(text, ranks, size, top):
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    marked = " " + " ".join(letters.split()) + " "
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(marked) - n + 1):
            g = marked[i : i + n]
            if g.strip() and not (n == 3 and g[1] == " ") and not (n == 1 and g == " "):
                counts[g] = counts.get(g, 0) + 1
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    own = sorted(counts, key=lambda g: (-counts[g], code(g)))[:top]
    away = {}
    for lang, codes in ranks.items():
        place = {c: i for i, c in enumerate(codes)}
        away[lang] = sum(min(abs(place[code(g)] - i), size) if code(g) in place else size for i, g in enumerate(own))
    best = min(sorted(away), key=lambda x: away[x])
    return best, round(1 - away[best] / (size * len(own)), 6)


def test_language_profiles_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = L.learn(docs)
    ranks = {name: [int(c) for c in profiles.codes[np.argsort(np.where(profiles.rank[:-1, k] < 0, 10**6, profiles.rank[:-1, k]), kind="stable")][: int((profiles.rank[:-1, k] >= 0).sum())]] for k, name in enumerate(profiles.languages)}
    for r in docs.limit(40).collect():
        assert profiles.predict(r.text) == brute_language(r.text, ranks, profiles.size, L.TOP)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.language_id(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_language_does_not_look_at_lang_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from pyspark.sql import functions as F

    wrong = docs.withColumn("lang", F.when(L.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(map(tuple, L.language_id(wrong).collect())) == sorted(map(tuple, L.language_id(docs).collect()))


def test_language_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, score string"
    rows = [(1, "the cat and the dog", "en", ""), (3, None, "en", ""), (4, "123 !?", None, ""), (4, "123 !?", None, ""), (None, "the", "en", ""), (5, "le chat et la", "fr", ""), (7, "", "fr", "")]
    got = L.language_id(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 7
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (3, 4, 7))
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und") for r in got)
    empty = spark.createDataFrame([], schema)
    assert L.language_id(empty).count() == 0 and L.language_filter(empty).count() == 0
    kept = L.language_filter(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "lang", "score"] and {r.doc_id for r in kept.collect()} <= {1, None, 5}


def test_language_of_very_long_texts(spark):
    rows = [(i, ("the cat and the dog are here " if i % 2 else "le chat et le chien sont ici ") * n, "en" if i % 2 else "fr") for i, n in enumerate([5] * 20 + [60_000] * 2)]
    rows += [(100, "x" * 2_000_000, "en")]
    got = {r.doc_id: r.lang_pred for r in L.language_id(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[i] == lang for i, _, lang in rows[:22])


def test_ngrams_do_not_depend_on_parts(monkeypatch):
    text = "Der schnelle braune Fuchs springt über den faulen Hund. " * 20
    whole = L.ngrams(text)
    monkeypatch.setattr(L, "_PART", 7)
    parts = L.ngrams(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def expected_chat(turns):
    said = [t or "" for r, t in turns if r == "assistant"]
    return len(turns), sha(*[f"{r or ''}\n{t or ''}\n" for r, t in turns]), sum(map(len, said)), sha(*said)


def test_chat_query_round_trip(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {}
    for r in rows:
        want.setdefault(r.conv_id, []).append((r.role, r.text))
    tricky = r"\### Assistant: </turn> ok"
    want[-7] = [("user", tricky), ("assistant", tricky)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat(spark, SF).collect()}
    assert got == {k: expected_chat(v) for k, v in want.items()}


def test_chat_odd_rows(spark):
    turns = [(1, 0, "assistant", None, "x"), (1, 0, "assistant", None, "x"), (1, None, None, "<turn user>\\)</turn>", "x"), (None, 1, "user", "a", "x"), (2, 1, "assistant", "a" * 50000, "x"), (2, 2, "assistant", "b", "x")]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, n_turns string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.format_conversations(frame).collect()}
    assert got[1] == expected_chat([(None, "<turn user>\\)</turn>"), ("assistant", None), ("assistant", None)])
    assert got[None] == expected_chat([("user", "a")])
    assert got[2] == expected_chat([("assistant", "a" * 50000), ("assistant", "b")])
    assert C.format_conversations(frame.limit(0)).count() == 0
    texts = {r.conv_id: r for r in C.format_conversations(frame, digest=False).collect()}
    r = texts[2]
    assert [r.formatted[s.start : s.end] for s in r.loss_spans] == ["a" * 50000, "b"]


@given(st.text())
def test_escape_is_reversible_and_hides_marks(text):
    assert C.unescape(C.escape(text)) == text
    assert "<" not in C.escape(text) and ">" not in C.escape(text)


def render(source, messages):
    return "".join(t for t, _ in C.compile_template(source)(messages))


def test_template_language():
    m = [{"role": "user", "text": " Hi "}, {"role": "assistant", "text": "yo"}]
    assert render("{% for m in messages %}{{ loop.index }}{{ m['role'] }}{% if not loop.last %}, {% endif %}{% endfor %}", m) == "1user, 2assistant"
    assert render("{% for m in messages %}{% if m.role == 'user' and loop.first %}U{% elif m.role != 'tool' or true %}A{% else %}T{% endif %}{{ m.text|trim|upper }}{% endfor %}", m) == "UHIAYO"
    assert render("{# note #}{{ ('a' + 'b')|upper }}{{ missing }}{{ 'x\\n' + 1 }}", m) == "ABx\n1"


def test_messages_can_be_gone_through_twice():
    m = [{"role": "user", "text": "a"}, {"role": "assistant", "text": "b"}]
    source = "{% for m in messages %}{{ m.role }}{% endfor %}{% for m in messages %}{{ m.text }}{% endfor %}"
    assert render(source, iter(m)) == "userassistantab"
    nested = "{% for m in messages %}{% for n in messages %}{{ n.text }}{% endfor %};{% endfor %}"
    assert render(nested, iter(m)) == "ab;ab;"


@pytest.mark.parametrize("source", ["{% for m in messages %}{{ m.rol }}{% endfor %}", "{% for m in messages %}{% if m.txt == 'a' %}x{% endif %}{% endfor %}", "{% for m in messages %}{{ loop.frist }}{% endfor %}"])
def test_misspelt_attributes_are_errors(source):
    with pytest.raises(C.TemplateError):
        C.compile_template(source)


def test_constants_are_folded():
    assert C.fold_body(C.parse("a{{ 'b' + 'c'|upper }}{% if 'x' == 'y' %}no{% elif true %}d{% else %}e{% endif %}")) == (C.Node("text", "abCd"),)


@pytest.mark.parametrize("source", ["{% for x %}{% endfor %}", "{{ a( }}", "{{ m.__class__ }}", "{{ m|eval }}", "{% if a %}", "{% endif %}", "{% import os %}", "{{ 'a }}", "{{ }}", "{% else %}"])
def test_template_errors(source):
    with pytest.raises(C.TemplateError):
        C.compile_template(source)


def brute_patterns(weight, text):
    """The grammar's rules without machines, word by word."""
    out = {}
    for clause in X.CLAUSE.split((text or "").lower()):
        words = X.WORD.findall(clause)
        kind = ["I" if weight(w) else "H" if w in X.THREATS else "N" if w in X.NEGATIONS else "R" if w in X.REPORTS else "T" if w in X.TARGETS else "V" if w in X.INTENTS else "O" for w in words]
        for k, w in enumerate(words):
            if kind[k] not in "IH":
                continue
            near = lambda what, span, k=k, kind=kind: what in kind[max(0, k - span) : k]
            if kind[k] == "I":
                p = "C" if near("I", 5) else "I"
            else:
                p = "G" if near("V", 5) else "H"
            if near("N", 3):
                p = {"I": "i", "C": "i", "H": "h", "G": "h"}[p]
            elif near("R", len(words)):
                p = {"I": "J", "C": "J", "H": "K", "G": "K"}[p]
            if near("T", 4) or "T" in kind[k + 1 : k + 4]:
                p = X.AIMED.get(p, p)
            out[p] = out.get(p, 0.0) + (weight(w) or 1.0)
    return out


@settings(max_examples=300)
@given(st.lists(st.sampled_from("you are idiot not said kill killed stupidly we will the . no he and idio".split()), max_size=25))
def test_grammar_equals_its_rules(words):
    scorer = X.Scorer({"idiot": 3.0, "stup*": 2.0})
    text = " ".join(words)
    want = brute_patterns(scorer.weight, text)
    got = scorer.patterns(text)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_patterns_decide_before_learning():
    score = X.Scorer({"idiot": 3.0}).score
    assert score("an idiot") < score("you are an idiot") < score("you idiot and we will kill you")
    assert score("you are no idiot") < score("an idiot") and score("he said idiot") < score("idiot") < 0.5
    assert score("we will kill you") > score("they kill time") and score(None) == score("") == score("kind words")


def test_threats_are_known_in_their_forms():
    assert {"killed", "killing", "tue", "schlage", "schlägt", "töten", "frappe", "matar", "mato", "shot"} <= X.THREATS and not {"tu", "the", "mate"} & X.TARGETS & X.THREATS


def brute_learn(rows, labels):
    """The lexicon and the patterns' counts from ``rows(doc_id, text)`` and ``labels(doc_id, toxic)`` by the definitions."""
    label = {}
    for i, toxic in labels:
        if i is not None and toxic is not None and zlib.crc32(str(i).encode()) % 5:
            label[i] = max(label.get(i, 0), int(toxic == 1))
    texts = {}
    for i, t in rows:
        if i in label:
            texts[t] = max(texts.get(t, 0), label[i])
    one = {}
    for t, toxic in texts.items():
        key = (X.family(t), toxic)
        one[key] = min(one.get(key, t), t)
    sample = [(t, toxic) for (_, toxic), t in one.items()]
    bad, good = sum(y for _, y in sample), sum(1 - y for _, y in sample)
    count = {}
    for t, y in sample:
        words = set(X.WORD.findall(t.lower()))
        for term in {w for w in words if len(w) <= X.LONGEST} | {w[:n] + "*" for w in words for n in X.PREFIXES if len(w) >= n}:
            count.setdefault(term, [0, 0])[y] += 1
    tested = {t: c for t, c in count.items() if sum(c) >= X.SUPPORT}
    share, weights = bad / (bad + good), {}
    for t, (g, b) in tested.items():
        n = g + b
        if b < X.SUPPORT or b <= n * share:
            continue
        surprise = b * np.log(b / (n * share)) + (g * np.log(g / (n * (1 - share))) if g else 0.0)
        if surprise > np.log(len(tested) / X.BY_CHANCE) and X.term_weight(b, g, bad, good) > 0:
            weights[t] = X.term_weight(b, g, bad, good)
    return weights, sample


def test_toxicity_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    weights, sample = brute_learn(rows, [(r.doc_id, r.toxic) for r in labels.collect()])
    scorer = X.learn(docs, labels)
    assert {w: x for w, x in weights.items() if not w.endswith("*")} == pytest.approx(scorer.words, abs=1e-5)
    assert all(weights[k + "*"] == pytest.approx(v, abs=1e-5) for n in X.PREFIXES for k, v in scorer.starts[n].items())
    # the counts are where the penalised likelihood is largest: no slope in a free one, none upwards at the bound
    x = np.array([[1.0, *(np.log1p(brute_patterns(scorer.weight, t).get(k, 0.0)) for k in X.NAMES)] for t, _ in sample])
    beta = np.array([scorer.offset, *(scorer.counts[k] for k in X.NAMES)])
    pull = np.array([0.01, *[X.PULL] * len(X.NAMES)]) * (beta - np.array([X.START, *X.PATTERNS.values()]))
    slope = x.T @ (np.array([y for _, y in sample]) - 1 / (1 + np.exp(-x @ beta))) - pull
    assert all(abs(g) < 1e-4 or (i and b == 0 and g < 0) for i, (g, b) in enumerate(zip(slope, beta, strict=True)))
    got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in X.toxicity(docs, labels).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        z = scorer.offset + sum(scorer.counts[k] * np.log1p(v) for k, v in brute_patterns(scorer.weight, t).items())
        score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        assert got[i] == (zlib.crc32(str(i).encode()) % 5 == 0, pytest.approx(score, abs=2e-9), int(round(score, 9) >= 0.5))


def test_toxicity_words_shared_by_near_copies_are_not_learned(spark):
    text = "some rare passage of quaint old words that stands in many copies "
    rng = np.random.default_rng(2)
    any_ = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(8))
    rows = [(i, text + any_()[:4]) for i in range(60)] + [(100 + i, any_()) for i in range(300)] + [(1000 + i, f"{any_()} moron{'' if i % 2 else 's'} {any_()}") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, int(i < 100 or i >= 1000)) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    scorer = X.learn(spark.createDataFrame(rows, "doc_id bigint, text string"), labels)
    assert scorer.weight("moron") and scorer.weight("morons") and not scorer.weight("quaint")


def test_toxicity_held_out(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = X.toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in rows if r.toxic == 1]
    clean = [r for r in rows if r.toxic != 1]
    # 7 of the 97 held-out toxic labels stand on texts without any insult (repeated or shouted words)
    assert toxic and sum(r.predicted for r in toxic) / len(toxic) > 0.9
    assert sum(r.predicted for r in clean) / len(clean) < 0.02


def test_other_insults_stay_beside_forms_of_one_word(spark):
    texts = {"worthless": list(range(20)), "worth*": list(range(20)), "worthl*": list(range(20)), "idiot": list(range(12)), "scum": list(range(5, 15)), "moron": [1, 2, 30], "moro*": [1, 2, 30, 31, 32, 33]}
    chosen = X._cover(texts, dict.fromkeys(texts, 5.0))
    assert {"worthless", "idiot", "scum", "moron", "moro*"} <= chosen and not {"worth*", "worthl*"} & chosen
    path = "/root/testdata/sf0.01"
    scorer = X.learn(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    assert all(scorer.weight(w) for w in "clown disgusting idiot loser moron pathetic scum stupid trash worthless".split())


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello", "x"), (3, "hello", "x"), (None, "you idiot", "x")], "doc_id bigint, text string, score string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = X.toxicity(docs, none).collect()
    assert len(got) == 5 and all(r.predicted == 0 for r in got)
    some = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(1, 60)] + [(None, None, None), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    many = spark.createDataFrame([(i, f"text {i} " + ("you idiot fool" if i % 2 else "nice day")) for i in range(1, 60)], "doc_id bigint, text string")
    got = X.toxicity(many, some).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)
    assert X.toxicity(many.limit(0), some).count() == 0
    # labelled both ways, very long, of one unbroken word
    both = some.unionByName(spark.createDataFrame([(5, 1, 0), (7, 1, 0)], some.schema))
    extra = many.unionByName(spark.createDataFrame([(-1, "you idiot fool " + "word " * 400_000), (-2, "w" * 500_000), (-3, None)], many.schema))
    first = {r.doc_id: r.predicted for r in X.toxicity(extra, both).collect()}
    assert first == {r.doc_id: r.predicted for r in X.toxicity(extra.repartition(5), both.repartition(3)).collect()}
    assert (first[-1], first[-2], first[-3]) == (1, 0, 0)
