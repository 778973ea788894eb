"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut into two halves, each half has its own k-means codebook, and the product of the codebooks is
a grid of cells (Babenko and Lempitsky, "The Inverted Multi-Index", 2012). Every vector lies in one cell. For each
vector a multi-sequence traversal visits the cells in order of how near a vector in them can be, up to a distance
that is fitted so that RECALL of the linked pairs are met; what meets is checked exactly. With ``exact`` the
traversal goes on until that distance rules a link out, and no pair can be missed whatever the data.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from paperloom.llm.common import drop, hashed_below, parts, settled, share_of, small_or_shuffled, stored
from paperloom.llm.components import components, with_least

COSINE = 0.93
#: Share of linked vectors whose links the traversal is fitted to find all of; 1 is not reached by fitting, see ``exact``.
RECALL = 0.999
#: Room for rounding in squared distances; it can only add cells.
ROOM = 1e-9
#: Vectors that codebooks and the traversal are fitted on, by hash of the id; those that are held against all rows
#: to learn how far real links reach; numbers in the sample at most, so that long vectors are sampled less.
SAMPLE, PROBES, MOST_NUMBERS = 8000, 1000, 16_000_000
#: Codewords for each half: least, most, and rows of a label in a cell from which on there are more.
CODEWORDS, MOST_CODEWORDS, CELL_ROWS = 16, 512, 4096
#: Rows of a block of a cell, and about how many rows may query it in one task.
BLOCK, QUERIES = 1024, 8192


def _kmeans(points: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Codewords by Lloyd's rounds, started from points that lie far apart."""
    chosen = [0]
    near = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(points)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    centers = points[chosen].copy()
    for _ in range(rounds):
        own = _distances(points, centers).argmin(axis=1)
        for c in np.unique(own):
            centers[c] = points[own == c].mean(axis=0)
    return centers


def _distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(axis=1)[:, None] - 2 * points @ centers.T + (centers**2).sum(axis=1)[None, :], 0)


def multi_sequence(one: np.ndarray, two: np.ndarray, most: int, bound: float = float("inf")) -> list[int]:
    """At most ``most`` cells ``i * len(two) + j`` with the smallest ``one[i] + two[j]`` up to ``bound``, nearest first."""
    a, b = np.argsort(one, kind="stable").tolist(), np.argsort(two, kind="stable").tolist()
    x, y = [float(one[i]) for i in a], [float(two[j]) for j in b]
    heap, out = [(x[0] + y[0], 0, 0)], []
    while heap and len(out) < most:
        total, i, j = heapq.heappop(heap)
        if total > bound:
            break
        out.append(a[i] * len(b) + b[j])
        # a row of the grid begins after the first cell of the row before it
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
    return out


def _least(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each codeword's region at least.

    The region of c lies behind the plane halfway between c and each other codeword k, so the furthest of these
    planes is a lower bound. A point is in its own region, with distance 0.
    """
    away = _distances(points, centers)
    gap = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(axis=2))
    gap[gap < 1e-4] = np.inf  # planes that rounding could move are left out
    out = np.zeros_like(away)
    for k in range(len(centers)):
        out = np.maximum(out, (away - away[:, k : k + 1]) / (2 * gap[:, k]))
    return out**2


class Index:
    """Codebooks of both halves, and how far the traversal goes: up to ``reach`` in squared distance."""

    def __init__(self, sample: np.ndarray, cosine: float = COSINE, codewords: int = CODEWORDS, exact: bool = False):
        self.half = sample.shape[1] // 2
        self.books = [_kmeans(sample[:, : self.half], codewords), _kmeans(sample[:, self.half :], codewords)]
        self.cells = len(self.books[0]) * len(self.books[1])
        self.bound = 2 - 2 * cosine + ROOM
        self.reach = self.bound if exact else self._partners(sample, cosine)

    def own(self, vectors: np.ndarray) -> np.ndarray:
        """The cell that each vector lies in."""
        one, two = _distances(vectors[:, : self.half], self.books[0]), _distances(vectors[:, self.half :], self.books[1])
        return one.argmin(axis=1) * len(self.books[1]) + two.argmin(axis=1)

    def _sides(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _least(vectors[:, : self.half], self.books[0]), _least(vectors[:, self.half :], self.books[1])

    def visit(self, vectors: np.ndarray) -> list[list[int]]:
        """The cells that are visited for each vector, nearest first."""
        one, two = self._sides(vectors)
        return [multi_sequence(a, b, self.cells, self.reach) for a, b in zip(one, two, strict=True)]

    def needed(self, vectors: np.ndarray, others: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How far the traversal from ``vectors[x]`` has to go to come to the cells of ``others[y]``."""
        one, two = self._sides(vectors)
        cell = self.own(others)[y]
        return one[x, cell // len(self.books[1])] + two[x, cell % len(self.books[1])]

    def _partners(self, sample: np.ndarray, cosine: float, times: int = 2) -> float:
        """How far partners lie that differ as much as a link may, in any direction."""
        noise = np.random.default_rng(7)
        need = []
        for _ in range(times):
            side = noise.normal(size=sample.shape)
            side -= (side * sample).sum(axis=1, keepdims=True) * sample
            size = np.sqrt((side**2).sum(axis=1, keepdims=True))
            partner = cosine * sample + np.sqrt(1 - cosine**2) * side / np.where(size > 0, size, 1)
            need.append(self.needed(sample, partner, np.arange(len(sample)), np.arange(len(sample))))
        return min(float(np.quantile(np.concatenate(need), RECALL, method="higher")) + ROOM, self.bound)

    def widen(self, need: list[float]) -> None:
        """Goes far enough for RECALL of sampled vectors too, of each of which ``need`` has its furthest link."""
        if need:
            self.reach = min(max(self.reach, float(np.quantile(need, RECALL, method="higher")) + ROOM), self.bound)


def _unit(values: pa.Array) -> np.ndarray:
    """Unit vectors, in double precision, of arrays of one length."""
    matrix = np.asarray(values.flatten().cast(pa.float64())).reshape(len(values), -1)
    # scaled first, so that no square under- or overflows
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix**2).sum(axis=1))[:, None]


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each length of vectors."""
    sizes = np.diff(np.asarray(batch.column("embedding").offsets))
    for n in np.unique(sizes):
        yield int(n), batch if (sizes == n).all() else batch.take(pa.array(np.flatnonzero(sizes == n)))


def _union(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest member's number for each of ``n`` nodes linked by x, y."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, x, root[y])
        np.minimum.at(root, y, root[x])
        root = root[root]
        if (root == before).all():
            return root


LINKS = "rep bigint, other bigint, linked bigint"


def _compare(rows: pa.Table, cosine: float) -> pa.Table:
    """Links between a block of base rows and the rows that query it.

    Each pair is counted once: of two blocks the one with the smaller number queries the other, and within a block
    the row with the smaller number queries. Rows of the result: ``linked`` others for each row, each a group's
    number of copies, and a link to its component's first row for each row that has a link.
    """
    rows = rows.combine_chunks()
    base = np.asarray(rows["is_base"].to_numpy(zero_copy_only=False), bool)
    none = pa.table({k: pa.array([], pa.int64()) for k in ("rep", "other", "linked")})
    if not base.any() or base.all():
        return none
    rep, copies, block = (rows[c].to_numpy() for c in ("rep", "copies", "block"))
    units = _unit(rows["embedding"].chunk(0))
    b = units[base]
    found_x, found_y = [], []
    at_base, at_query = np.flatnonzero(base), np.flatnonzero(~base)
    for k in range(0, len(at_query), BLOCK):
        some = at_query[k : k + BLOCK]
        near = (units[some] @ b.T) >= cosine
        near &= (block[some][:, None] != block[at_base][None, :]) | (rep[some][:, None] < rep[at_base][None, :])
        x, y = np.nonzero(near)
        found_x.append(some[x])
        found_y.append(at_base[y])
    x, y = np.concatenate(found_x), np.concatenate(found_y)
    ids, at = np.unique(np.concatenate([rep[x], rep[y]]), return_inverse=True)
    linked = np.bincount(at, np.concatenate([copies[y], copies[x]]), len(ids)).astype(np.int64)
    first = _union(len(ids), at[: len(x)], at[len(x) :])
    return pa.table({"rep": pa.array(ids, pa.int64()), "other": pa.array(ids[first], pa.int64()), "linked": pa.array(linked)}) if len(ids) else none


def _fit(groups: DataFrame, cosine: float, sample: int, exact: bool) -> dict[int, Index]:
    """An index for each length of vectors that the sample holds."""
    row = groups.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    sizes = groups.groupBy("label", F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).groupBy("d").agg(F.max("n").alias("n"))
    # of tables with very many lengths those with the largest labels; the others have the least number of codewords
    largest = {r["d"]: r["n"] for r in sizes.orderBy(F.desc("n"), "d").limit(1000).collect()}
    codewords = {d: min(max(CODEWORDS, int(np.ceil(np.sqrt(n / CELL_ROWS)))), MOST_CODEWORDS) for d, n in largest.items()}
    wanted = min(max(sample, 16 * max(codewords.values(), default=0)), max(MOST_NUMBERS // (row[1] or 1), 100))
    some = groups.where(hashed_below(F.col("rep"), share_of(wanted, row[0]))).select("rep", "embedding").toArrow()
    indices, probes = {}, {}
    for d, part in _by_length(some.combine_chunks().to_batches()[0]) if some.num_rows else ():
        unit = _unit(part.column("embedding"))
        indices[d] = Index(unit, cosine, codewords.get(d, CODEWORDS), exact)
        probes[d] = part.column("rep").to_numpy()[:PROBES], unit[:PROBES]
    if exact or not indices:
        return indices

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The furthest link, within a batch, of each probe that has one."""
        for batch in parts(batches, 4 * BLOCK):
            for d, b in _by_length(batch):
                if d not in probes:
                    continue
                (ids, queries), units = probes[d], _unit(b.column("embedding"))
                x, y = np.nonzero((queries @ units.T >= cosine) & (ids[:, None] != b.column("rep").to_numpy()[None, :]))
                if len(x):
                    far = np.zeros(len(ids))
                    np.maximum.at(far, x, indices[d].needed(queries, units, x, y))
                    hit = np.unique(x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), d), pa.int32()), pa.array(ids[hit]), pa.array(far[hit])], names=["d", "rep", "far"])

    # links are only those between vectors of one label, but how far partners lie does not depend on labels
    furthest = groups.select("rep", "embedding").mapInArrow(reach, "d int, rep bigint, far double").groupBy("d", "rep").agg(F.max("far").alias("far")).collect()
    for d, index in indices.items():
        index.widen([r["far"] for r in furthest if r["d"] == d])
    return indices


def links(groups: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, exact: bool = False) -> DataFrame:
    """``groups(rep, label, embedding, copies)`` of unlike valid vectors -> ``(rep, other, linked)``, see _compare."""
    indices = _fit(groups, cosine, sample, exact)
    vector = groups.schema["embedding"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 4 * BLOCK):
            for d, b in _by_length(batch):
                own = indices[d].own(_unit(b.column("embedding"))) if d in indices else np.zeros(b.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(np.full(b.num_rows, d), pa.int32()), pa.array(own, pa.int32())], names=["label", "d", "cell"])

    counts = groups.select("label", "embedding").mapInArrow(place, "label string, d int, cell int").groupBy("label", "d", "cell").agg(F.count(F.lit(1)).alias("n"))
    filled = stored(counts.groupBy("label", "d").agg(F.collect_list(F.struct("cell", "n")).alias("c")).select("label", "d", F.col("c.cell").alias("cells"), F.col("c.n").alias("ns")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A cell's rows are cut into blocks; a row queries the blocks of all cells that it visits, from its own on."""
        spans: dict[tuple, tuple] = {}
        for batch in parts(batches, BLOCK):
            for d, b in _by_length(batch):
                vectors, index = _unit(b.column("embedding")), indices.get(d)
                own = index.own(vectors) if index else np.zeros(len(vectors), int)
                visits = index.visit(vectors) if index else [[0]] * len(vectors)
                labels, salt = b.column("label").to_pylist(), b.column("salt").to_pylist()
                block, part, blocks = [], [], []
                for k, label in enumerate(labels):
                    if (label, d) not in spans:
                        rows = np.zeros(index.cells if index else 1, np.int64)
                        rows[b.column("cells")[k].as_py()] = b.column("ns")[k].as_py()
                        cut = np.maximum(-(-rows // BLOCK), 1)  # rounding may put a row into a cell where none was counted
                        if len(spans) > 64:
                            spans.clear()
                        spans[label, d] = cut, cut.cumsum() - cut, rows.cumsum() - rows
                    cut, first, start = spans[label, d]
                    cell = own[k]
                    j = salt[k] % int(cut[cell])
                    block.append(int(first[cell]) + j)
                    part.append(int(start[cell] + j * BLOCK) // QUERIES)
                    seen = np.array(visits[k] or [cell])
                    to = first[seen] if cut[seen].max() == 1 else np.concatenate([np.arange(first[c], first[c] + cut[c]) for c in seen])
                    to = to[to > block[-1]]
                    blocks.append(np.concatenate([[block[-1]], to]))
                kept = [b.column(c) for c in ("rep", "label", "copies", "embedding")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(len(block), d), pa.int32()), pa.array(block, pa.int32()), pa.array(part, pa.int32()), pa.array(blocks, pa.list_(pa.int32()))], names=["rep", "label", "copies", "embedding", "d", "block", "part", "blocks"])

    placed = groups.withColumn("d", F.size("embedding")).join(small_or_shuffled(filled.select("label", "d", "cells", "ns")), ["label", "d"])
    dealt = stored(placed.select("rep", "label", "copies", "embedding", F.abs(F.xxhash64("rep") % 1_000_003).alias("salt"), "cells", "ns").mapInArrow(deal, f"rep bigint, label string, copies bigint, embedding {vector}, d int, block int, part int, blocks array<int>"))
    key = ["label", "d", "base", "part"]
    tiles = small_or_shuffled(stored(dealt.select("label", "d", F.explode("blocks").alias("base"), "part").distinct()))
    base = dealt.drop("part", "blocks").withColumn("base", F.col("block")).join(tiles, ["label", "d", "base"]).select(*key, "block", "rep", "copies", "embedding", F.lit(True).alias("is_base"))
    query = dealt.select("label", "d", F.explode("blocks").alias("base"), "part", "block", "rep", "copies", "embedding", F.lit(False).alias("is_base"))
    return base.unionByName(query).groupBy(*key).applyInArrow(lambda rows: _compare(rows, cosine), LINKS)


def embedding_dedup(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, exact: bool = False) -> DataFrame:
    """``vectors(vec_id, embedding, label, ...)`` -> ``(vec_id, n_links, component_id, kept)`` for each row.

    Only vectors of one label and one length are compared, of any length from one number on. Null labels, null, empty
    or zero vectors and those with null or non-finite components have no links and are their own component, kept. A
    vector with a null id links with nothing and counts for nobody; its component is null and it is kept. Equal
    vectors of a label are compared once and counted as often as they are there, rows with the same id too. Other
    columns are ignored; an empty table gives none. ``exact`` finds every link, at a cost that grows faster with the
    table.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType in (ArrayType(FloatType(), True), ArrayType(FloatType(), False)) else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("string").alias("label"))
    fine = F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.withColumn("fine", F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    # a group has a number of its own: ids may be repeated
    grouped = rows.where("fine").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    groups = stored(grouped.withColumn("rep", F.monotonically_increasing_id()))
    found = settled(lambda: links(groups.drop("least"), cosine, sample, exact))
    roots = settled(lambda: components(found.select(F.col("rep").alias("u"), F.col("other").alias("v"))))
    counts = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    named = stored(groups.select("rep", "least", "copies").join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select("rep", "least", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")))
    joint = settled(lambda: with_least(named, "least", "component_id").select("rep", "n_links", "component_id"))
    known = small_or_shuffled(stored(groups.select("rep", "label", "embedding").join(joint, "rep").drop("rep")))
    drop(found, roots, named, joint, groups)
    joined = rows.where("fine").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def brute_force(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """All links ``(u, v)``, u < v, of a small table; what recall is measured against."""
    rows = vectors.select("vec_id", "label", "embedding").toPandas()
    unit = np.array(rows["embedding"].tolist(), np.float64)
    unit /= np.sqrt((unit**2).sum(axis=1))[:, None]
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    out = []
    for i in range(0, len(unit), 1024):
        x, y = np.nonzero(unit[i : i + 1024] @ unit.T >= cosine)
        ok = (labels[x + i] == labels[y]) & (ids[x + i] < ids[y])
        out += list(zip(ids[x[ok] + i].tolist(), ids[y[ok]].tolist(), strict=True))
    return spark.createDataFrame(out, "u bigint, v bigint")
