"""License scans by diagonal voting, in DataFrame operations only.

All rolling word k-grams of a text are joined by hash to the positions of the same k-grams in the license templates.
A match of text position p with template position t votes for the diagonal p - t, the place where the template would
start. Votes are summed by diagonal and neighbouring diagonals (words put in or left out) are merged into a span.
Each span is then verified word by word: the template's words must stand in it in their order, enough of them, and
within a stretch not much longer than the template.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.common import ascii_lower, let

#: A word: letters, with A-Z lower-cased, digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that are counted wherever their words stand one after the other.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Short notices and the parts of license texts that are found with gaps: of a template's words the share
#: COVER must be there, of short ones SHORT_COVER, as one word can make another license.
NOTICES = (
    ("this work is licensed under the gnu general public license version", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("free and unencumbered software released into the public domain", "public-domain"),
    ("all rights reserved", "all-rights-reserved"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even "
        "the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gpl-notice",
    ),
    (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software "
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific "
        "language governing permissions and limitations under the license",
        "apache-notice",
    ),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom "
        "the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software",
        "mit-text",
    ),
    (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the "
        "above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd-text",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "mpl-notice",
    ),
    (
        "you are free to share copy and redistribute the material in any medium or format under the following terms attribution you must give appropriate credit provide a link to the "
        "license and indicate if changes were made",
        "cc-by-summary",
    ),
)
COVER, SHORT_COVER = 0.8, 0.9
#: Words of a k-gram of templates of fewer than LONG words, and of longer ones.
SHORT_GRAM, LONG_GRAM, LONG = 2, 4, 12


def gram_size(words: int) -> int:
    return SHORT_GRAM if words < LONG else LONG_GRAM


def slack(words: int) -> int:
    """How far apart the diagonals of one span may be, and by how many words it may be longer than its template."""
    return min(2, words // 4) if words < LONG else words // 8


def template_rows(notices: tuple = NOTICES) -> list[tuple]:
    """``(template, base, label, t_words, slack, k, t_pos, gram)`` for each k-gram position of each template."""
    rows = []
    for number, (phrase, label) in enumerate((*BASE, *notices)):
        words = phrase.split(" ")
        k = SHORT_GRAM if number < len(BASE) else gram_size(len(words))
        rows += [(number, number < len(BASE), label, len(words), slack(len(words)), k, t, words[t : t + k]) for t in range(len(words) - k + 1)]
    return rows


def gram_hash(words: list[str]) -> int:
    """What ``xxhash64`` gives for an array of strings."""
    value = 42
    for w in words:
        value = xxhash.xxh64_intdigest(w.encode(), value)
    return value - (1 << 64) if value >> 63 else value


def templates(spark: SparkSession, notices: tuple = NOTICES) -> DataFrame:
    """``template_rows`` with hashes; as many rows as the templates have words at most."""
    schema = "template int, base boolean, label string, t_words int, slack int, k int, t_pos int, t_gram array<string>"
    return spark.createDataFrame(template_rows(notices), schema).withColumn("t_hash", F.xxhash64("t_gram"))


def _hits(words: Column, notices: tuple) -> Column:
    """The k-grams of an array of words whose hash some template has, as ``(pos, k, gram)``."""

    def of(k: int) -> Column:
        grams = [r[7] for r in template_rows(notices) if r[5] == k]
        firsts, hashes = sorted({g[0] for g in grams}), sorted({gram_hash(g) for g in grams})
        gram = lambda p: F.slice(words, p + 1, k)
        known = lambda p: F.element_at(words, p + 1).isin(firsts) & F.xxhash64(gram(p)).isin(hashes)
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0))), known)
        found = F.transform(places, lambda p: F.struct(p.alias("pos"), F.lit(k).alias("k"), gram(p).alias("gram")))
        return F.when(F.size(words) >= k, found).otherwise(F.array().cast("array<struct<pos: int, k: int, gram: array<string>>>"))

    return F.concat(of(SHORT_GRAM), of(LONG_GRAM))


def _verified(lines: Column, size: Column, k: Column) -> Column:
    """The words of a template that stand in a span in order, and the stretch that they take.

    ``lines`` are the span's diagonals with the template positions found on each. A word that several diagonals have
    is taken from the one nearest to the diagonal with most votes, smaller ones first; it is in order if it comes
    after all words before it.
    """
    best = F.array_max(F.transform(lines, lambda x: F.struct(F.size(x["found"]).alias("n"), (-x["diagonal"]).alias("d"))))

    def placed(main: Column) -> Column:
        def word(t: Column) -> Column:
            on = F.filter(lines, lambda x: F.exists(x["found"], lambda f: (f <= t) & (t < f + k)))
            return F.struct(t.alias("t"), F.array_min(F.transform(on, lambda x: F.struct(F.abs(x["diagonal"] - main).alias("away"), x["diagonal"].alias("d"))))["d"].alias("d"))

        return F.filter(F.transform(F.sequence(F.lit(0), size - 1), word), lambda w: w["d"].isNotNull())

    none = F.struct(F.lit(0).alias("n"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def step(s: Column, w: Column) -> Column:
        p = (w["t"] + w["d"]).cast("int")
        later = s["last"].isNull() | (p > s["last"])
        return F.struct((s["n"] + later.cast("int")).alias("n"), F.coalesce(s["first"], p).alias("first"), F.when(later, p).otherwise(s["last"]).alias("last"))

    return F.aggregate(let(-best["d"], placed), none, step)


def license_scan(docs: DataFrame, notices: tuple = NOTICES, cover: float = COVER) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row for each row of ``docs`` with counts, labels and a score.

    A null text counts as empty; a text without words has n_words 0, no labels ('') and score 0. Texts of any length
    are scanned whole. Repeated rows and repeated ids each keep a row of their own; other columns are ignored,
    whatever their names; an empty table gives none. All places count, overlapping ones too. The score is the best
    verified share of a template's words, less for short templates.
    """
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    row = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _hits(w, notices).alias("hits")))
    scanned = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.inline(F.array(row)))
    grams = scanned.select("doc_id", "row", "n_words", F.explode_outer("hits").alias("hit")).select("doc_id", "row", "n_words", "hit.pos", F.col("hit.k").alias("g_k"), "hit.gram")
    known = F.broadcast(templates(docs.sparkSession, notices))
    # the words are compared too; a text without a match keeps one row
    same = (F.xxhash64("gram") == F.col("t_hash")) & (F.col("g_k") == F.col("k")) & (F.col("gram") == F.col("t_gram"))
    votes = grams.join(known, same, "left").where(F.col("template").isNotNull() | F.col("pos").isNull())
    facts = lambda *names: [F.first(c).alias(c) for c in ("doc_id", "n_words", "base", "label", "t_words", "slack", "k", *names)]
    lines = votes.withColumn("diagonal", F.col("pos") - F.col("t_pos")).repartition("row").groupBy("row", "template", "diagonal").agg(*facts(), F.array_sort(F.collect_set("t_pos")).alias("found"))
    by_place = Window.partitionBy("row", "template").orderBy("diagonal")
    lines = lines.withColumn("starts", F.when(F.col("diagonal") - F.lag("diagonal").over(by_place) <= F.col("slack"), 0).otherwise(1))
    full = F.size("found") == F.col("t_words") - F.col("k") + 1
    spans = lines.withColumn("span", F.sum("starts").over(by_place)).groupBy("row", "template", "span").agg(
        *facts(),
        F.collect_list(F.when(F.col("template").isNotNull() & ~F.col("base"), F.struct("diagonal", "found"))).alias("lines"),
        F.sum(full.cast("int")).alias("whole"), F.min(F.when(full, F.col("diagonal"))).alias("first_whole"), F.max(F.when(full, F.col("diagonal"))).alias("last_whole"),
    )
    checked = spans.withColumn("v", F.when(~F.col("base"), _verified(F.col("lines"), F.col("t_words"), F.col("k"))))
    is_base = F.col("base") & (F.col("whole") > 0)
    share = F.when(F.col("base"), 1.0).otherwise(F.col("v.n") / F.col("t_words"))
    tight = F.col("v.last") - F.col("v.first") + 1 <= F.col("t_words") + F.col("slack")
    sure = F.when(F.col("base"), F.col("whole") > 0).otherwise((share >= F.when(F.col("t_words") < LONG, max(cover, SHORT_COVER)).otherwise(cover)) & tight)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        checked.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.coalesce(F.sum(F.when(is_base, F.col("whole"))), F.lit(0)).cast("long").alias("n_base"),
            F.min(F.when(is_base, F.col("first_whole"))).cast("long").alias("first_word"),
            F.max(F.when(is_base, F.col("last_whole"))).cast("long").alias("last_word"),
            joined(F.when(is_base, F.col("label"))).alias("base_labels"),
            joined(F.when(sure, F.col("label"))).alias("labels"),
            F.round(F.coalesce(F.max(F.when(sure, share * (1 - F.lit(0.5) / F.col("t_words")))), F.lit(0.0)), 6).alias("score"),
        )
        .drop("row")
    )
