"""License scans, quality rules and URL filters against brute force, with edge cases."""

import random
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from paperloom.llm import license_scan as L
from paperloom.llm import url_filter as U
from paperloom.llm.license_scan import BASE, NOTICES, license_scan
from paperloom.llm.quality_rules import quality_filter, quality_rules, repeated_words
from paperloom.llm.sql import ORACLES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns whose names the operators use inside.
CLASH = ", row string, words string, template string, host string, m_text string, document string, n_words string, fp string, kept string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], schema)


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, *["x"] * 9) for i, t, s in rows], SCHEMA + CLASH)


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    at = [(i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


LICENSE_TEXTS = [
    None, "", "!!!", "word", "MIT License", "mit license mit license mit-LICENSE", "gnu general public license", "gnu general public gnu general public license",
    "GNU General\nPublic, License; apache license cc by cc by-nc", "é mit é license mit license", "Licensed under CC BY-NC 4.0.", "mit", "apache 2 license",
    "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "x " * 3000 + "apache license " + "y " * 3000,
]


def test_license_base_equals_brute_force(spark):
    rows = [(i, t, "s") for i, t in enumerate(LICENSE_TEXTS)]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan(clashing(spark, rows)).collect()}
    assert got == {i: brute_license(t) for i, t, _ in rows}


def test_license_labels_and_scores(spark):
    got = {r.doc_id: r for r in license_scan(frame(spark, [(i, t, "s") for i, t in enumerate(LICENSE_TEXTS)])).collect()}
    assert got[10].labels == "cc-by,cc-by-nc"
    assert got[14].labels == "all-rights-reserved" and got[14].base_labels == ""
    assert got[13].labels == "gpl" and 0.5 < got[13].score <= 1
    assert got[0].labels == "" and got[0].score == 0


def test_license_gap_is_bridged_by_neighbouring_diagonals(spark):
    text = "permission is hereby granted free of charge to any other person obtaining a copy of this software"
    assert license_scan(frame(spark, [(1, text, "s")])).first().labels == "mit"


MIT = next(p for p, label in NOTICES if label == "mit-text")


def brute_notices(text):
    """Labels of the notices by the definition: votes of k-grams, merged diagonals, words in order."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    labels = set()
    for phrase, label in NOTICES:
        t = phrase.split()
        k, slack = L.gram_size(len(t)), L.slack(len(t))
        votes = sorted((p - q, q) for q in range(len(t) - k + 1) for p in range(len(words) - k + 1) if words[p : p + k] == t[q : q + k])
        spans = []
        for d, q in votes:
            if not spans or d - spans[-1][-1][0] > slack:
                spans.append([])
            spans[-1].append((d, q))
        for span in spans:
            count = Counter(d for d, _ in span)
            main = min(count, key=lambda d: (-count[d], d))
            at = {}
            for d, q in span:
                for x in range(q, q + k):
                    at[x] = min(at.get(x, (10**9, 0)), (abs(d - main), d))
            place = [x + at[x][1] for x in sorted(at)]
            kept = [p for i, p in enumerate(place) if p > max(place[:i], default=-1)]
            cover = L.SHORT_COVER if len(t) < L.LONG else L.COVER
            if len(kept) / len(t) >= cover and kept[-1] - kept[0] + 1 <= len(t) + slack:
                labels.add(label)
    return labels


def license_bodies():
    words = MIT.split()
    mixed = words[len(words) // 2 :] + words[: len(words) // 2]
    return [
        MIT, "so " + MIT.upper() + " end", " ".join(words[:10] + ["put", "in"] + words[10:]), " ".join(w for i, w in enumerate(words) if i % 12), " ".join(w for i, w in enumerate(words) if i % 3),
        " ".join(mixed), " ".join(reversed(words)), " ".join(words[:40]), "x ".join(words), " ".join(words + words), " ".join(p for p, _ in NOTICES), "K mit license İ apache license",
    ]


def test_license_texts_equal_brute_force(spark):
    texts = license_bodies()
    got = {r.doc_id: r for r in license_scan(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        base = set(filter(None, brute_license(t)[4].split(",")))
        assert set(filter(None, got[i].labels.split(","))) == brute_notices(t) | base, i
        assert (got[i].n_words, got[i].n_base) == brute_license(t)[:2]
    assert "mit-text" in got[0].labels and "mit-text" in got[2].labels and "mit-text" not in got[6].labels and "mit-text" not in got[5].labels


def test_license_hashes_are_sparks(spark):
    from pyspark.sql import functions as F

    rows = L.templates(spark).select("t_gram", F.xxhash64("t_gram").alias("h")).collect()
    assert all(L.gram_hash(r.t_gram) == r.h for r in rows)


def test_license_sql_gives_the_same_rows(spark, tmp_path):
    import duckdb

    rows = [(i, t, "s") for i, t in enumerate([*license_bodies(), *LICENSE_TEXTS])]
    docs = frame(spark, rows)
    docs.coalesce(1).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({ORACLES['op1_license_scan']}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in license_scan(docs).select(*names).orderBy("doc_id").collect()] == want


def test_license_repeated_rows_ids_and_empty_table(spark):
    rows = [(1, "mit license", "s"), (1, "mit license", "s"), (1, "apache license", "s"), (None, "cc by", "s")]
    got = sorted((str(r.doc_id), r.base_labels) for r in license_scan(frame(spark, rows)).collect())
    assert got == [("1", "apache"), ("1", "mit"), ("1", "mit"), ("None", "cc-by")]
    assert license_scan(frame(spark, [])).count() == 0


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


QUALITY_TEXTS = [
    None, "", "  \n\t", "a b c d e f g h", "a b c d e f g h i", "a a a a a a a a a", "one two three four five six seven eight nine ten " * 3,
    "x\ny\nx\n\n \n \ny", "# | $ <é>", " ".join(map(str, range(50))), " ".join(map(str, range(50))) + " " + " ".join(map(str, range(10))), "w" * 5000, "a\x0bb\x0cc\rd é f", "😀 " * 30,
    " ".join(map(str, range(20000))) + " " + " ".join(map(str, range(100))),
]


def test_quality_measures_equal_brute_force(spark):
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(QUALITY_TEXTS)]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(clashing(spark, rows)).collect()}
    assert got == {i: brute_quality(t) for i, t, _ in rows}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=20))
def test_quality_repeats_equal_brute_force(spark, docs):
    rows = [(i, " ".join(w), "s") for i, w in enumerate(docs)]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules(frame(spark, rows)).collect()}
    assert got == {i: brute_quality(t)[4] for i, t, _ in rows}


def test_quality_repeats_with_hashes_that_share_upper_bits(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    docs = []
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(450)]
        for _ in range(20):
            a, b = sorted(rng.sample(range(430), 2))
            words[b : b + 10] = words[a : a + 10]
        docs.append((i, " ".join(words)))
    weak = lambda a: F.pmod(F.xxhash64(a), F.lit(1 << 26))
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").select("doc_id", F.split("text", " ").alias("w"))
    got = {r.doc_id: (r.weak, r.strong) for r in rows.select("doc_id", repeated_words(F.col("w"), hashed=weak).alias("weak"), repeated_words(F.col("w")).alias("strong")).collect()}
    want = {i: brute_quality(t)[4] for i, t in docs}
    assert {i: strong for i, (_, strong) in got.items()} == want
    assert sum(weak == want[i] for i, (weak, _) in got.items()) >= 38  # whole hashes of 26 bits may be equal by chance


GOOD = " ".join(f"word{i}" for i in range(40))
SOFT = " ".join(f"word{i}" for i in range(40)) + " " + " ".join(f"word{i}" for i in range(4)) + " $$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$"
BAD = "too short"


def test_quality_hosts_decide_over_soft_failures(spark):
    rows = [(i, BAD, "bad") for i in range(60)] + [(100, SOFT, "bad"), (101, GOOD, "bad"), (102, SOFT, "fine"), (103, None, None)]
    rows += [(1000 + i, GOOD, f"host{i % 7}") for i in range(300)]
    got = {r.doc_id: r.kept for r in quality_rules(frame(spark, rows)).collect()}
    assert (got[100], got[101], got[102], got[103]) == (False, True, True, False)
    assert all(got[1000 + i] for i in range(300))


def test_quality_filter_agrees_and_keeps_columns(spark):
    rows = [(i, t, f"s{i % 2}") for i, t in enumerate(QUALITY_TEXTS)] + [(50, GOOD, None), (50, GOOD, None), (None, GOOD, "s1")]
    docs = clashing(spark, rows)
    out = quality_filter(docs)
    assert out.columns == docs.columns
    want = sorted(str(r.doc_id) for r in quality_rules(docs).where("kept").collect())
    assert sorted(str(r.doc_id) for r in out.collect()) == want
    assert quality_filter(frame(spark, [])).count() == 0 and quality_rules(frame(spark, [])).count() == 0


URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/es/1?x", "https://a.example.org/en/12", "https://a.example.org/en/2", "https://example.org", "https://example.org?x=/es/",
    "http://b.com/fr/1", "http://b.com/de/1#f", "http://b.com/en/1", "http://notcom/fr/1", "http://x.org/a/b?u=http://y.com/de/", "ftp://q.net/a.html", "http://É.Com/de/É", "a\nb://c.com/de/\nd", "http://com/fr/",
]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = ascii_lower(rest[:cut]), rest[cut:]
        path = re.split(r"[?#]", rest)[0]
    fit = [(rule, kind) for kind, rule in U.RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith("/" + rule.split("/", 1)[1])]
    return (host, path, *max(fit, key=lambda x: len(x[0]), default=(None, None)))


def test_url_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "x", "y") for i, u in enumerate(URLS)], "page_id bigint, url string, html string, host string, purity string")
    got = {r.page_id: r for r in U.url_filter(pages).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict in ("allow", "block") and verdict in (None, got[i].verdict)


def brute_tree(rows):
    """``(host, flat, ruled)`` rows -> template and purity of each path, by the definition."""
    total = [sum(r is not None for _, _, r in rows), sum(r == "block" for _, _, r in rows)]
    prior = min(total[1] / total[0], U.MOST_PRIOR) if total[0] else 0.0
    paths = {(h, f): (f.split("/", U.DEPTH - 1) if f else []) for h, f, _ in rows}
    t = dict.fromkeys(paths, "")
    for level in range(U.DEPTH):
        count = {}
        for h, f, r in rows:
            if len(paths[h, f]) > level:
                c = count.setdefault((h, t[h, f]), {}).setdefault(paths[h, f][level], [0, 0, 0])
                c[0] += 1
                c[1] += r is not None
                c[2] += r == "block"
        branch = {}
        for node, kids in count.items():
            n = sum(c[0] for c in kids.values())
            name = {k: "*" if len(kids) > U.FAN_OUT and c[0] * U.FAN_OUT <= n else "=" + k for k, c in kids.items()}
            for k in kids:
                mine = [sum(c[x] for j, c in kids.items() if name[j] == name[k]) for x in (1, 2)]
                rest = [sum(c[x] for j, c in kids.items() if name[j] != name[k]) for x in (1, 2)]
                apart = False
                if mine[0] and rest[0]:
                    pooled = (mine[1] + rest[1]) / (mine[0] + rest[0])
                    if 0 < pooled < 1:
                        apart = abs(mine[1] / mine[0] - rest[1] / rest[0]) / (pooled * (1 - pooled) * (1 / mine[0] + 1 / rest[0])) ** 0.5 > U.DIFFERENT_Z
                branch[*node, k] = name[k] if apart else "~"
        t = {p: t[p] + "/" + branch[p[0], t[p], paths[p][level]] if len(paths[p]) > level else t[p] for p in paths}
    sums = {}
    for h, f, r in rows:
        s = sums.setdefault((h, t[h, f]), [0, 0])
        s[0] += r is not None
        s[1] += r == "block"
    return {p: (x or "/", round((sums[p[0], x][1] + U.PRIOR_WEIGHT * prior) / (sums[p[0], x][0] + U.PRIOR_WEIGHT), 9)) for p, x in t.items()}


def tree_rows():
    rng = random.Random(4)
    rows = [("h", f"a/{i}", "block") for i in range(12)] + [("h", f"b/{i}", "allow") for i in range(12)] + [("h", f"c/{i}", None) for i in range(4)]
    rows += [("h", f"news/{i % 3}/story-{i}-{w}", "block" if w == "x" else "allow") for i in range(30) for w in "xy"]
    rows += [("g", "", None), ("g", "", "allow"), ("", "", None), ("k", "one", None), ("k", "a/b/c/d/e/f", "block"), ("k", "a/b/c/d/e/g", None)]
    return rows + [("r", "/".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(1, 6))), rng.choice(["block", "allow", None])) for _ in range(400)]


def test_url_tree_equals_brute_force(spark):
    rows = tree_rows()
    got = {(r.host, r.flat): (r.template, r.purity) for r in U.tree(spark.createDataFrame(rows, "host string, flat string, ruled string")).collect()}
    want = brute_tree(rows)
    assert {k: t for k, (t, _) in got.items()} == {k: t for k, (t, _) in want.items()}
    assert all(got[k][1] == pytest.approx(p, abs=2e-9) for k, (_, p) in want.items())


def test_url_slugs_of_words_become_a_wildcard_by_fan_out():
    rows = [("h", f"{kind}/{a}{b}", ruled) for kind, ruled in (("ads", "block"), ("blog", "allow")) for a in "abcdef" for b in ("story", "tale", "post")]
    got = brute_tree(rows + [("h", "ads/never-seen", None)])
    assert got["h", "ads/never-seen"][0] == got["h", "ads/astory"][0] and got["h", "ads/never-seen"][1] >= U.BLOCK_PURITY


def test_url_host_without_labels_is_allowed(spark):
    pages = [(i, f"http://bad.net/x/1{i}") for i in range(30)] + [(100 + i, f"http://other.net/x/{i}") for i in range(30)]
    got = U.url_filter(spark.createDataFrame(pages, "page_id bigint, url string"), (("block", "bad.net/x/1"),)).collect()
    assert {r.verdict for r in got if r.page_id >= 100} == {"allow"} and {r.verdict for r in got if r.page_id < 30} == {"block"}


def test_url_sql_gives_the_same_rows(spark, tmp_path):
    import duckdb

    pages = [(i, u) for i, u in enumerate(URLS)]
    pages += [(100 + i, f"http://{h}.example.{('com', 'org', 'net')[i % 3]}/{('de', 'fr', 'en', 'es')[i % 4]}/{f.replace('/', '//')}{('', '/', '.html')[i % 3]}") for i, (h, f, _) in enumerate(tree_rows())]
    frame_ = spark.createDataFrame(pages, "page_id bigint, url string")
    frame_.coalesce(1).write.parquet(f"{tmp_path}/p")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/p/*.parquet'")
    names = ["page_id", "host", "path", "rule", "verdict", "template", "purity"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({ORACLES['op10_url_filter']}) ORDER BY page_id").fetchall()
    got = [tuple(r) for r in U.url_filter(frame_).select(*names).orderBy("page_id").collect()]
    assert got == want and len({r[5] for r in got}) > 10


def test_url_method_blocks_pure_templates(spark):
    rules = (("block", "bad.net/x/1"),)
    pages = [(i, f"http://bad.net/x/1{i}") for i in range(30)] + [(100, "http://bad.net/x/77"), (101, "http://good.net/x/77")]
    got = {r.page_id: (r.rule, r.verdict) for r in U.url_filter(spark.createDataFrame(pages, "page_id bigint, url string"), rules).collect()}
    assert got[0] == ("bad.net/x/1", "block") and got[100] == (None, "block")
    assert U.url_filter(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_url_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None)], "page_id bigint, url string")
    assert U.url_filter(pages).count() == 3
