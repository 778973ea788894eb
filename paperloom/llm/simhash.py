"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact check, components.

A fingerprint's 64 bits are cut into 32 segments of two bits; the bit counts of the segments are a point with 32
coordinates. The Manhattan distance of two points never exceeds the Hamming distance of their fingerprints. The
coordinates are dealt to planes, each of a share of them, so that points within RADIUS are within REACH in one plane
at least. In a plane a point lies in the cell of its coordinates and reaches the cells one step away; points that
meet in a cell are range-joined by Manhattan distance, and pairs that pass are verified by Hamming distance inside
the join. Equal fingerprints are one node, however many documents share them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import drop, parts, settled, small_or_shuffled, stored, whole_row
from paperloom.llm.components import components, with_least

#: The planes are made for this radius.
SHINGLE, SEED, RADIUS = 4, 42, 4
SEGMENTS = 32
#: How far apart points may be in a plane: one step from each to the cell where they meet.
REACH = 2
#: Up to so many unlike fingerprints the planes are halves of the coordinates, which meet at about 2,000 others each;
#: beyond it they are two thirds, at twice the rows but a seventieth of the meetings.
COARSE = 25_000_000


def fingerprint(text: str | None) -> int:
    """64-bit SimHash as a signed integer; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b"%b %b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:], words[3:], strict=False)]
    over = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        over += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * over > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *carried: str) -> DataFrame:
    """``docs(text, ...)`` -> the columns ``carried``, which must be long, and ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            n = b.num_columns - 1
            fps = [fingerprint(x.as_py()) for x in b.column(n)]
            yield pa.RecordBatch.from_arrays([*(b.column(i).cast(pa.int64()) for i in range(n)), pa.array(fps, pa.int64())], names=[*carried, "fp"])

    return docs.select(*[F.col(c).cast("long").alias(c) for c in carried], "text").mapInArrow(run, ", ".join(f"{c} bigint" for c in (*carried, "fp")))


def counts(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments in unary code: 00, 01 and 11 for none, one and two bits."""
    odd = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two points whose coordinates are in unary code."""
    return F.bit_count(a.bitwiseXOR(b))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def planes(n: int) -> list[list[int]]:
    """The coordinates of each plane of the grid for ``n`` fingerprints.

    Of two points within Manhattan distance RADIUS, some plane has them within REACH: of two halves one has half of
    the distance at most, and of three thirds the worst one left out leaves at most two thirds of it, rounded down.
    """
    part = lambda k, of: [s for s in range(SEGMENTS) if s * of // SEGMENTS == k]
    if n <= COARSE:
        return [part(0, 2), part(1, 2)]
    return [[*part(0, 3), *part(1, 3)], [*part(0, 3), *part(2, 3)], [*part(1, 3), *part(2, 3)]]


def cells(fps: DataFrame, n: int) -> DataFrame:
    """``(fp)`` -> ``(fp, plane, mask, cell, moved)``: the cell of each point in each plane, and all cells one step away.

    In unary code a step changes one bit of a coordinate: its low bit while the high one is 0, its high bit while
    the low one is 1.
    """
    steps = []
    for plane, coordinates in enumerate(planes(n)):
        mask = _signed(sum(3 << 2 * s for s in coordinates))
        steps.append((plane, mask, 0, 0, 0))
        for s in coordinates:
            steps += [(plane, mask, _signed(1 << 2 * s), _signed(2 << 2 * s), 0), (plane, mask, _signed(2 << 2 * s), _signed(1 << 2 * s), _signed(1 << 2 * s))]
    known = F.array(*[F.struct(*[F.lit(x).cast("long").alias(k) for k, x in zip(("plane", "mask", "step", "seen", "wanted"), row, strict=True)]) for row in steps])
    dealt = fps.select("fp", counts(F.col("fp")).alias("point"), F.explode(known).alias("s")).where(F.col("point").bitwiseAND(F.col("s.seen")) == F.col("s.wanted"))
    return dealt.select("fp", "s.plane", "s.mask", F.col("point").bitwiseAND(F.col("s.mask")).bitwiseXOR(F.col("s.step")).alias("cell"), (F.col("s.step") != 0).alias("moved"))


def near_pairs(fps: DataFrame, n: int) -> DataFrame:
    """Distinct ``fps(fp)``, ``n`` of them -> all pairs ``(u, v)`` with at most RADIUS unlike bits, each once.

    A grid range-join: points within REACH steps in a plane meet in a cell that is at most one step from both. Of
    the cells in which a pair meets, it counts in that of u if they are less than two steps apart, else in those
    halfway.
    """
    made = cells(fps, n)
    a, b = made.alias("a"), made.select("fp", "plane", "cell", "moved").alias("b")
    x, y, mask = counts(F.col("a.fp")), counts(F.col("b.fp")), F.col("a.mask")
    apart = F.bit_count(x.bitwiseXOR(y).bitwiseAND(mask))
    here = (F.col("a.moved") == (apart == 2)) & (F.col("b.moved") == (apart >= 1))
    near = here & (manhattan(x, y) <= RADIUS) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS)
    met = (F.col("a.plane") == F.col("b.plane")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp"))
    return a.join(b.hint("merge"), met & near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()


def classes(nodes: DataFrame) -> DataFrame:
    """Stored ``nodes(fp, least)`` of distinct fingerprints -> ``(fp, component_id)``, the least of each component."""
    roots = stored(components(near_pairs(nodes.select("fp"), nodes.count())))
    linked = stored(nodes.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "least"))
    alone = nodes.join(roots, F.col("fp") == F.col("node"), "left_anti").select("fp", F.col("least").alias("component_id"))
    return alone.unionByName(with_least(linked, "least", "component_id").select("fp", "component_id"))


def simhash(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, fingerprint, component_id)`` for each row of ``docs``.

    Null and wordless texts have fingerprint 0 and link like any other. Repeated rows keep a row each. A null
    doc_id is no candidate for a component's smallest id. Texts of any length are hashed whole. Other columns are
    ignored, whatever their names; an empty table gives none.
    """
    fps = stored(fingerprints(docs, "doc_id"))
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = small_or_shuffled(settled(lambda: classes(nodes)))
    return fps.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the first row, by doc_id, stays.

    Rows are known by hashes of their id and text, which any plan finds again, and not by numbers, which another plan
    might give to other rows. Of rows with one id and one text one stays, as they are near copies of each other; rows
    with a null doc_id come last. An empty table stays empty, and columns of any names are handed through. No text
    is written or dealt out, but for those of repeated rows, and where ids of the rows that go are too many to be
    broadcast.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = [F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, "doc_id", F.lit(1)).alias("k2")]
    fps = stored(fingerprints(docs.select("doc_id", *key, "text"), "doc_id", "k1", "k2"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("k1"), F.col("k2"))
    nodes = stored(fps.groupBy("fp").agg(F.min(order).alias("least")))
    first = settled(lambda: classes(nodes).select("component_id.k1", "component_id.k2").distinct())
    rows = fps.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    gone = stored(rows.join(first, ["k1", "k2"], "left_anti").select("k1", "k2"))
    again = stored(rows.where("n > 1").join(first, ["k1", "k2"], "left_semi").select("k1", "k2"))
    repeats = not again.isEmpty()
    drop(fps, nodes, first)
    left = docs.select(whole_row(docs).alias("document"), *key).join(small_or_shuffled(gone), ["k1", "k2"], "left_anti")
    if not repeats:
        return left.select("document.*")
    once, several = (left.join(small_or_shuffled(again), ["k1", "k2"], how) for how in ("left_anti", "left_semi"))
    return once.unionByName(several.dropDuplicates(["k1", "k2"])).select("document.*")
