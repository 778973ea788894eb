"""Quality rules with host-level verdicts, in DataFrame operations only.

Each document is measured by itself. Rule failures are summed by host (the column ``source``), each host's
failure rate is shrunk with a beta prior fitted to all hosts by moments, and hosts whose shrunk rate stands out
are marked. Documents of marked hosts must also pass the stricter rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import let, settled, small_or_shuffled, stored, whole_row

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
#: A host is marked when its shrunk rate is at least this and this many times the mean of all hosts.
HOST_RATE, HOST_TIMES = 0.3, 2.0


def repeated_words(words: Column, window: int = WINDOW, hashed: Callable[[Column], Column] = F.xxhash64) -> Column:
    """Words that stand in a window of ``window`` words found twice or more in the array, the first find included.

    Each window's 64-bit hash keeps its upper bits and gets its position in the lower ones; after sorting, equal
    windows are neighbours. Where unlike windows share upper bits, and so could part equal ones, the row is sorted
    again by whole hashes. Neighbours are compared word by word. All in one row: no rows are dealt out and nothing is
    collected across documents.
    """
    size = F.size(words)

    def count(hashes: Column) -> Column:
        low = F.pow(F.lit(2.0), F.ceil(F.log2(size))).cast("long") - 1
        return let(low, lambda low: let(F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))), lambda packed: sorted_(hashes, packed, low)))

    def sorted_(hashes: Column, packed: Column, low: Column) -> Column:
        upper = lambda p: p.bitwiseAND(F.bitwise_not(low))
        at = lambda p: F.get(hashes, p.bitwiseAND(low).cast("int"))
        mixed = F.exists(F.transform(packed, lambda p, j: (upper(p) == upper(F.get(packed, j - 1))) & (at(p) != at(F.get(packed, j - 1)))), lambda x: F.coalesce(x, F.lit(False)))
        by_hash = F.transform(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))), lambda x: x["i"])
        return let(F.when(mixed, by_hash).otherwise(F.transform(packed, lambda p: p.bitwiseAND(low))), lambda order: among(hashes, order))

    def among(hashes: Column, order: Column) -> Column:
        at = lambda p: F.get(hashes, p.cast("int"))
        text = lambda p: F.slice(words, p.cast("int") + 1, window)
        same = lambda p, q: q.isNotNull() & (at(p) == at(q)) & (text(p) == text(q))
        again = F.filter(order, lambda p, j: F.coalesce(same(p, F.get(order, j - 1)), F.lit(False)) | F.coalesce(same(p, F.get(order, j + 1)), F.lit(False)))
        start = F.struct(F.lit(-window).cast("long").alias("last"), F.lit(0).cast("long").alias("total"))
        step = lambda s, p: F.struct(p.alias("last"), (s["total"] + F.least(F.lit(window).cast("long"), p - s["last"])).alias("total"))
        return F.aggregate(F.sort_array(again), start, step, lambda s: s["total"])

    windows = F.transform(F.sequence(F.lit(1), size - (window - 1)), lambda i: hashed(F.slice(words, i, window)))
    return F.when(size > window, let(windows, count)).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, *carried: str) -> DataFrame:
    """``docs(text, ...)`` -> the columns ``carried`` and the measures of each text; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("m_text", "\n"), lambda x: x.rlike(WORD))

    def row(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length("m_text") - F.length(F.regexp_replace("m_text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
        )

    # a generated row: filters on the measures stay above it, so the measures are taken once
    taken = let(F.regexp_extract_all("m_text", F.lit(WORD), F.lit(0)), row)
    return docs.select(*carried, text.alias("m_text")).select(*carried, F.inline(F.array(taken)))


def _judged(measured: DataFrame) -> DataFrame:
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    base = (n < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n)
    strict = base | (200 * repeats > MOST_REPEATED * n) | (5 * F.col("n_symbols") > F.col("word_chars")) | (10 * F.col("n_dup_lines") > n)
    return measured.withColumns({"base_failed": base, "strict_failed": strict})


def host_verdicts(judged: DataFrame) -> DataFrame:
    """``(host, base_failed)`` rows -> ``(host, host_rate, host_bad)``, one row for each host.

    Prior a, b by the method of moments over the hosts' rates; with fewer than two hosts or no spread it is the
    mean with the weight of 20 documents.
    """
    hosts = stored(judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")))
    row = hosts.agg(F.sum("failed"), F.sum("n"), F.var_samp(F.col("failed") / F.col("n")), F.avg(1 / F.col("n"))).first()
    mean = row[0] / row[1] if row[1] else 0.0
    noise = mean * (1 - mean) * (row[3] or 0.0)
    spread = (row[2] or 0.0) - noise
    weight = min(max(mean * (1 - mean) / spread - 1, 2.0), 1000.0) if spread > 0 else 20.0
    rate = (F.col("failed") + weight * mean) / (F.col("n") + weight)
    return hosts.select("host", F.round(rate, 9).alias("host_rate")).withColumn("host_bad", (F.col("host_rate") >= HOST_RATE) & (F.col("host_rate") >= HOST_TIMES * mean))


def quality_rules(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` -> one row for each row of ``docs`` with its measures and verdict.

    A null text has no words and fails; documents with a null source share one host of their own. Repeated rows
    keep a row each and count each time for their host; other columns are ignored. An empty table gives none.
    """
    plain = docs.select("doc_id", "text", F.coalesce(F.col("source"), F.lit("")).alias("host"))
    judged = stored(_judged(measures(plain, "doc_id", "host")))
    hosts = small_or_shuffled(settled(lambda: host_verdicts(judged)))
    return judged.join(hosts, "host").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~(F.col("host_bad") & F.col("strict_failed"))).alias("kept"), "host_rate")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with the columns of ``docs``.

    Each text is measured once: the rows are stored beside their verdicts, and the hosts are read from those alone.
    Only rows that the hosts decide about, those that fail the stricter rules, meet the marked hosts in a join.
    Columns of any names are handed through; an empty table stays empty.
    """
    packed = docs.select(whole_row(docs).alias("document"), "text", F.coalesce(F.col("source"), F.lit("")).alias("host"))
    judged = _judged(measures(packed, "document", "host"))
    base = stored(judged.select("host", "base_failed", "strict_failed", F.when(~F.col("base_failed"), F.col("document")).alias("document")))
    bad = small_or_shuffled(settled(lambda: host_verdicts(base).where("host_bad").select("host")))
    sure = base.where(~F.col("strict_failed"))
    asked = base.where(F.col("strict_failed") & ~F.col("base_failed")).join(bad, "host", "left_anti")
    return sure.select("document").unionByName(asked.select("document")).select("document.*")
