"""SimHash and embedding near-duplicates, components, and the pipeline, against brute force."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import embedding_dedup as E
from paperloom.llm import simhash as S
from paperloom.llm import components as G
from paperloom.llm.common import is_small, stored
from paperloom.llm.components import components

SF = "/root/testdata/sf0.001"


def union(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 201 + i) for i in range(20)] + [(300 + 37 * i % 50, 300 + 37 * (i + 1) % 50) for i in range(49)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == union(nodes, [x for x in links if x[0] != x[1]])


def test_components_without_links(spark):
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
    assert components(spark.createDataFrame([(1, 1)], "u bigint, v bigint")).count() == 0


def test_marks_of_many_links_do_not_overflow(spark):
    links = spark.range(40_000_000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    n, one, two = G._mark(links)
    assert n == 40_000_000 and (one, two) != G._mark(links.where("u <> 5"))[1:]


def test_least_of_a_hot_root(spark, monkeypatch):
    monkeypatch.setattr(G, "HOT_NODES", 5)
    rows = [(i, i % 3 if i % 2 else 7, 100 - i) for i in range(60)]
    nodes = stored(spark.createDataFrame(rows, "fp bigint, root bigint, least bigint"))
    want = {root: min(x for _, r, x in rows if r == root) for _, root, _ in rows}
    assert {r.fp: r.component_id for r in G.with_least(nodes, "least", "component_id").collect()} == {i: want[root] for i, root, _ in rows}


def test_small_tables_are_told_by_bytes(spark):
    assert is_small(spark.range(1000)) and not is_small(spark.createDataFrame([("x" * 1000,)] * 50, "s string"), 40_000)


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", " \n", "a", "A", "a b c", "a b c d", "a b c d e", "É x\x0by z w", "the same words again " * 50, "one two " * 3]


def test_fingerprints_equal_brute_force():
    for t in TEXTS:
        assert S.fingerprint(t) % (1 << 64) == brute_fingerprint(t)


def test_fingerprint_hash_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] == np.uint64(xxhash.xxh64_intdigest("a b c d", 42)).astype(np.int64)


@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1), st.sampled_from([10, 10**9]))
def test_points_that_are_near_are_two_steps_apart_in_some_plane(a, b, n):
    flips = random.Random(a).sample(range(64), 4)
    near = a
    for f in flips[: b % 5]:
        near ^= 1 << f
    count = lambda x: [bin(x >> 2 * s & 3).count("1") for s in range(32)]
    away = [abs(p - q) for p, q in zip(count(a), count(near), strict=True)]
    assert any(sum(away[s] for s in plane) <= S.REACH for plane in S.planes(n))


def test_cells_are_the_point_and_one_step_away(spark):
    fps = [0, -1, 0x0123456789ABCDEF, 1 << 62]
    got = {}
    for r in S.cells(spark.createDataFrame([(f,) for f in fps], "fp bigint"), 10).collect():
        got.setdefault((r.fp, r.plane), []).append((r.cell % (1 << 64), r.moved))
    for f in fps:
        for plane, coordinates in enumerate(S.planes(10)):
            count = [bin((f % (1 << 64)) >> 2 * s & 3).count("1") for s in coordinates]
            unary = lambda c, at=coordinates: sum((0, 1, 3)[x] << 2 * s for x, s in zip(c, at, strict=True))
            moved = [count[:i] + [count[i] + d] + count[i + 1 :] for i in range(len(count)) for d in (-1, 1) if 0 <= count[i] + d <= 2]
            assert sorted(got[f, plane]) == sorted([(unary(count), False)] + [(unary(m), True) for m in moved])


def near_words(rng, base, changes):
    words = base.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(1000)}"
    return " ".join(words)


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for f in list(fps)[:60]:
        for _ in range(3):
            g = f
            for k in rng.sample(range(64), rng.randrange(1, 7)):
                g ^= 1 << k
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % (1 << 64)).count("1") <= 4}
    frame = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    for n in (10, 10**6, 10**9):
        assert {(r.u, r.v) for r in S.near_pairs(frame, n).collect()} == want


def brute_classes(rows):
    fps = {i: brute_fingerprint(t) for i, t in rows}
    links = [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 4]
    return {i: (f"{fps[i]:016x}", r) for i, r in union(list(fps), links).items()}


def corpus(spark):
    rng = random.Random(3)
    base = [" ".join(f"v{rng.randrange(300)}" for _ in range(200)) for _ in range(12)]
    texts = base + [near_words(rng, b, 1) for b in base for _ in range(8)] + [base[0]] * 20 + TEXTS
    return list(enumerate(texts))


def test_simhash_query_equals_brute_force(spark):
    rows = corpus(spark)
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash(frame).collect()}
    assert got == brute_classes(rows)


def test_simhash_on_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash(docs).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_simhash_filter_keeps_one_of_each_group(spark):
    rows = corpus(spark)
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, row string, document string")
    out = S.simhash_filter(frame)
    assert out.columns == frame.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, c in brute_classes(rows).values()})
    same = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e")], "doc_id bigint, text string")
    assert [r.doc_id for r in S.simhash_filter(same).collect()] == [1]
    assert S.simhash_filter(frame.limit(0)).count() == 0 and S.simhash(frame.limit(0)).count() == 0


def test_simhash_filter_of_a_coalesced_shuffle(spark):
    """Rows keep their numbers however the plans that read them are cut into partitions."""
    rng = random.Random(8)
    base = [" ".join(f"v{rng.randrange(3000)}" for _ in range(30)) for _ in range(1000)]
    rows = [(k, base[k % 1000], f"{k}-" * 200) for k in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, wide string").repartition(40, "doc_id")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        assert sorted(r.doc_id for r in S.simhash_filter(frame.repartition("doc_id")).collect()) == list(range(1000))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)


def test_simhash_of_long_texts(spark):
    words = [f"w{i % 5000}" for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, "x" * 1_000_000), (4, "x" * 1_000_000)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_classes(rows)


def brute_embedding(rows, cosine=E.COSINE):
    fine = {i: np.array(v, float) for i, v, l in rows if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: l for i, _, l in rows}
    links = []
    for a in fine:
        for b in fine:
            if a < b and label[a] == label[b] and fine[a] @ fine[b] / np.linalg.norm(fine[a]) / np.linalg.norm(fine[b]) >= cosine:
                links.append((a, b))
    root = union([i for i, _, _ in rows], links)
    count = {i: 0 for i, _, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {i: (count[i], root[i], root[i] == i) for i, _, _ in rows}


def vectors(n, seed=0, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 3)) for i, v in enumerate(base)]
    for i in range(n // 3):
        noise = base[i] + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.3])
        rows.append((n + i, [float(np.float32(x)) for x in noise], int(i % 3)))
    rows += [(10_000 + k, rows[0][1], 0) for k in range(30)]
    rows += [(20_000, None, 1), (20_001, [0.0] * dim, 1), (20_002, [float("nan")] * dim, 1), (20_003, [None] * dim, 1), (20_004, rows[1][1], None), (20_005, [float("inf")] * dim, 1), (20_006, [2 * x for x in rows[0][1]], 0), (20_007, [], 1)]
    return rows


def test_embedding_query_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)  # several blocks in a cell
    rows = vectors(150)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, unit string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.embedding_dedup(frame).collect()}
    assert got == brute_embedding(rows)


def test_embedding_recall_on_the_test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = {(r.u, r.v) for r in E.brute_force(spark, table).collect()}
    got = sum(r.n_links for r in E.embedding_dedup(table).collect())
    assert 0.99 * 2 * len(want) <= got <= 2 * len(want)


def crowd(rows=1200, hot=600, pairs=300, dim=64, seed=1):
    """Unlike vectors of one label, one group of near copies that all differ, and pairs on both sides of the bound."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.normal(size=(rows, dim)))
    near = unit(base[:1] + 0.02 * rng.normal(size=(hot, dim)))
    side = unit(rng.normal(size=(pairs, dim)))
    side = unit(side - (side * base[1 : pairs + 1]).sum(axis=1, keepdims=True) * base[1 : pairs + 1])
    cos = rng.uniform(0.92, 0.99, size=(pairs, 1))
    copies = cos * base[1 : pairs + 1] + np.sqrt(1 - cos**2) * side
    return [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([base, near, copies]))]


def test_embedding_links_outside_a_large_group_are_found(spark):
    rows = crowd()
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    links = [(r.u, r.v) for r in E.brute_force(spark, frame).collect()]
    assert len(links) > 100_000 and sum(max(x) >= 1800 and min(x) > 0 for x in links) > 200
    count = dict.fromkeys(range(len(rows)), 0)
    for u, v in links:
        count[u] += 1
        count[v] += 1
    root = union(range(len(rows)), links)
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.embedding_dedup(frame).collect()}
    assert got == {i: (count[i], root[i]) for i in count}


def test_embedding_recall_by_pair_and_by_component_with_cells_left_out(spark):
    rows = crowd(2000, 700, 700, seed=2)
    unit = np.array([v for _, v, _ in rows])
    index = E.Index(unit)
    assert np.mean([len(v) for v in index.visit(unit)]) < 0.95 * index.cells
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    links = [(r.u, r.v) for r in E.brute_force(spark, frame).collect()]
    root = union(range(len(rows)), links)
    groups = {}
    for i, r in root.items():
        groups.setdefault(r, set()).add(i)
    got = E.embedding_dedup(frame).collect()
    found = {}
    for r in got:
        found.setdefault(r.component_id, set()).add(r.vec_id)
    several = [r for r, g in groups.items() if len(g) > 1]
    by_pair = sum(r.n_links for r in got) / 2 / len(links)
    by_component = sum(found.get(r) == groups[r] for r in several) / len(several)
    assert len(links) > 200_000 and len(several) > 400
    assert (by_pair, by_component) == (1.0, 1.0)


def test_embedding_empty_and_repeated_rows(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert E.embedding_dedup(spark.createDataFrame([], schema)).count() == 0
    got = E.embedding_dedup(spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], schema)).collect()
    assert len(got) == 3 and all(r.n_links == 1 for r in got if r.vec_id == 1)


def test_embedding_exact_finds_every_link(spark):
    rows = crowd(700, 200, 200, seed=5)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    unit = np.array([v for _, v, _ in rows])
    assert E.Index(unit, exact=True).reach == E.Index(unit).bound >= E.Index(unit).reach
    links = E.brute_force(spark, frame).count()
    assert sum(r.n_links for r in E.embedding_dedup(frame, exact=True).collect()) == 2 * links > 20_000


def test_embedding_grid_grows_and_cuts_the_traversal(spark):
    """Many unlike vectors of one label: few of the cells are visited, and recall by vector stays."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6000, 64))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(base)
    side = rng.normal(size=(2000, 64))
    side = unit(side - (side * base[:2000]).sum(axis=1, keepdims=True) * base[:2000])
    cos = rng.uniform(0.931, 0.97, size=(2000, 1))
    every = np.concatenate([base, cos * base[:2000] + np.sqrt(1 - cos**2) * side])
    index = E.Index(every, codewords=32)
    assert np.mean([len(v) for v in index.visit(every[:500])]) < 0.2 * index.cells
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(every)], "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in E.embedding_dedup(frame).collect()}
    want = dict.fromkeys(range(len(every)), 0)
    for r in E.brute_force(spark, frame).collect():
        want[r.u] += 1
        want[r.v] += 1
    linked = [i for i, n in want.items() if n]
    assert all(got[i] <= want[i] for i in got) and sum(got[i] == want[i] for i in linked) / len(linked) > 0.99


def test_embedding_lengths_of_one_and_mixed(spark):
    schema = "vec_id bigint, embedding array<double>, label string, base string"
    rows = [(1, [2.0], "a", ""), (2, [3.0], "a", ""), (3, [-1.0], "a", ""), (4, [1.0, 0.0], "a", ""), (5, [1.0, 0.01], "a", ""), (6, [1.0, 0.0, 0.0], "a", ""), (7, [1e-200, 0.0], "a", ""), (8, [1e200, 0.0], "a", ""), (9, [2.0], "b", ""), (10, [], "a", "")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.embedding_dedup(spark.createDataFrame(rows, schema)).collect()}
    # lengths that the sample does not hold have one cell
    few = E.embedding_dedup(spark.createDataFrame(rows, schema), sample=2)
    assert {r.vec_id: (r.n_links, r.component_id) for r in few.collect()} == got
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (3, 4), 5: (3, 4), 6: (0, 6), 7: (3, 4), 8: (3, 4), 9: (0, 9), 10: (0, 10)}


def test_embedding_null_ids_and_ids_of_several_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    rows = [(None, [1.0, 0.0], 1), (None, None, 1), (5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (6, [0.0, 1.0], 1), (7, [1.0, 0.0], 1)]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in E.embedding_dedup(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0, 0, True), (0, 0, 0, True), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False)]


@given(st.lists(st.floats(0, 9), min_size=1, max_size=6), st.lists(st.floats(0, 9), min_size=1, max_size=6))
def test_multi_sequence_visits_nearest_first(one, two):
    order = E.multi_sequence(np.array(one), np.array(two), 100)
    sums = [one[c // len(two)] + two[c % len(two)] for c in order]
    assert sorted(order) == list(range(len(one) * len(two))) and sums == sorted(sums)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    junk = [(-1, "12345 !!! 67890", "en", "s", 0), (-2, None, "en", "s", 0), (-3, "Ωψξ ζθχ Ωψξ ζθχ", None, "s", 0), (-4, "too short", "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        path = f"{tmp_path}/{k}"
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if k < 3:
            assert docs.columns == columns and docs.count() < before.count()
    ran = corpus_pipeline.run(spark, SF)
    key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    total = lambda df: df.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert set(key) <= set(ran.columns) and sorted(map(tuple, total(ran).collect())) == sorted(map(tuple, total(docs).collect()))


def test_pipeline_on_odd_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, document string, host string, base_failed string, fp string"
    good = " ".join(f"the word{i} and" for i in range(30))
    rows = [(1, good, "en", "s", 1, *"abcde"), (1, good, "en", "s", 1, *"abcde"), (None, good + " more", None, None, None, *"abcde"), (2, None, "en", "s", 1, *"abcde"), (3, good.replace("and", "or"), "en", "s", 1, *"abcde")]
    for k, given_ in enumerate((rows, [])):
        docs = spark.createDataFrame(given_, schema)
        for j, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            path = f"{tmp_path}/{k}-{j}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            assert j == 3 or docs.columns == [x.split()[0] for x in schema.split(", ")]
        assert bool(docs.count()) == bool(given_)
    docs.limit(0).write.parquet(f"{tmp_path}/sf/x")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/sf/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/sf").count() == 0
