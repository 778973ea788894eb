"""URL filters: longest-prefix rules first, then a path-template tree learned from the ruled urls.

Each host has a tree of its paths, grown level by level from the root. Below a node, segments that vary
(there are many, and each is rare) become one wildcard; then the branches whose labelled rates are statistically alike are merged into one, and
branches that stand apart stay by themselves. A template is a way through the merged tree, and it is rejected when
the smoothed share of blocked urls among its labelled ones is high. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import ascii_lower, settled, small_or_shuffled, stored

#: (verdict, host and path prefix)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Labelled urls that the prior counts for, the purity from which a template is rejected, and the z of a difference.
PRIOR_WEIGHT, BLOCK_PURITY, DIFFERENT_Z = 4.0, 0.7, 1.96
#: The prior is the share of blocked urls in all, but not over this: what nothing is known of is not rejected.
MOST_PRIOR = 0.5
#: Levels of the tree; what a path has below the last one is one segment. Segments below a node vary if there are more
#: than FAN_OUT of them, those of them that have at most one FAN_OUT-th of the node's urls.
DEPTH, FAN_OUT = 4, 8
#: The names of a wildcard and of merged branches.
WILDCARD, MERGED = "*", "~"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null if none fits."""
    rule = verdict = None
    for kind, prefix in sorted(rules, key=lambda r: (-len(r[1]), r)):
        name, start = prefix.split("/", 1)[0], "/" + prefix.split("/", 1)[1]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(prefix)) if rule is None else rule.when(fits, F.lit(prefix))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def flat_path(path: Column) -> Column:
    """The segments of a path that are not empty, joined by /, without a file's ending."""
    joined = F.array_join(F.filter(F.split(path, "/"), lambda x: x != ""), "/")
    return F.regexp_replace(joined, r"\.[A-Za-z]{1,5}\z", "")


def _apart(lab: Column, bad: Column, all_lab: Column, all_bad: Column) -> Column:
    """Whether a branch's share of blocked urls differs from its siblings'; not where one side has no labels."""
    share = lambda a, b: F.try_divide(a.cast("double"), b)
    rest, pooled = all_lab - lab, share(all_bad, all_lab)
    gap = share(bad, lab) - share(all_bad - bad, rest)
    z = F.try_divide(F.abs(gap), F.sqrt(pooled * (1 - pooled) * (share(F.lit(1), lab) + share(F.lit(1), rest))))
    return F.coalesce(z > DIFFERENT_Z, F.lit(False))


def _level(now: DataFrame) -> DataFrame:
    """The tree one level deeper: ``now(host, flat, left, t, n, labelled, blocked)``, stored, with the first segment
    of ``left``, what of the path is still to come, gone over into the template ``t``."""
    sums = lambda: [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    children = stored(now.where(F.size("left") > 0).groupBy("host", "t", F.col("left")[0].alias("segment")).agg(*sums()))
    nodes = small_or_shuffled(stored(children.groupBy("host", "t").agg(F.count(F.lit(1)).alias("kids"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))))
    varies = (F.col("kids") > FAN_OUT) & (F.col("n") * FAN_OUT <= F.col("all_n"))
    named = children.join(nodes, ["host", "t"]).select("host", "t", "segment", F.when(varies, F.lit(WILDCARD)).otherwise(F.concat(F.lit("="), "segment")).alias("name"), "n", "labelled", "blocked")
    named = stored(named)
    branches = named.groupBy("host", "t", "name").agg(*sums()).join(nodes, ["host", "t"])
    apart = _apart(F.col("labelled"), F.col("blocked"), F.col("all_labelled"), F.col("all_blocked"))
    kept = stored(branches.select("host", "t", "name", F.when(apart, F.col("name")).otherwise(F.lit(MERGED)).alias("branch")))
    way = small_or_shuffled(stored(named.select("host", "t", "segment", "name").join(small_or_shuffled(kept), ["host", "t", "name"]).select("host", "t", "segment", "branch")))
    keyed = now.withColumn("segment", F.when(F.size("left") > 0, F.col("left")[0]))
    gone = keyed.join(way, ["host", "t", "segment"], "left")
    more = F.size("left") > 0
    return gone.select("host", "flat", F.when(more, F.slice("left", 2, DEPTH)).otherwise(F.col("left")).alias("left"), F.when(more, F.concat("t", F.lit("/"), "branch")).otherwise(F.col("t")).alias("t"), "n", "labelled", "blocked")


def tree(urls: DataFrame) -> DataFrame:
    """``urls(host, flat, ruled)`` -> ``(host, flat, template, purity)``, one row for each path of a host."""
    left = F.when(F.col("flat") == "", F.array().cast("array<string>")).otherwise(F.split("flat", "/", DEPTH))
    counted = urls.groupBy("host", "flat").agg(F.count(F.lit(1)).alias("n"), F.count("ruled").alias("labelled"), F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("blocked"))
    now = stored(counted.select("host", "flat", left.alias("left"), F.lit("").alias("t"), "n", "labelled", "blocked"))
    total = now.agg(F.sum("labelled"), F.sum("blocked"), F.max(F.size("left"))).first()
    prior = min(total[1] / total[0], MOST_PRIOR) if total[0] else 0.0
    for _ in range(total[2] or 0):
        now = settled(lambda now=now: _level(now))
    sums = stored(now.groupBy("host", "t").agg(F.sum("labelled").alias("n_labelled"), F.sum("blocked").alias("n_blocked")))
    purity = (F.col("n_blocked") + PRIOR_WEIGHT * prior) / (F.col("n_labelled") + PRIOR_WEIGHT)
    template = F.when(F.col("t") == "", F.lit("/")).otherwise(F.col("t"))
    return now.join(small_or_shuffled(sums), ["host", "t"]).select("host", "flat", template.alias("template"), F.round(purity, 9).alias("purity"))


def url_filter(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``pages(page_id, url, ...)`` -> one row for each row of ``pages`` with host, path, rule and verdict.

    A null url, or one without ``://``, has an empty host and path and template ``/``. Templates without labels have
    the prior as their purity and are allowed. Urls of any length are judged whole. Repeated rows keep a row each;
    other columns are ignored, and an empty table gives none.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": rule, "ruled": verdict, "flat": flat_path(F.col("path"))})
    purity = small_or_shuffled(settled(lambda: tree(ruled)))
    judged = ruled.join(purity, ["host", "flat"])
    own = F.when(F.col("purity") >= BLOCK_PURITY, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", "purity")
