"""URL filtering by a path-template tree.

Templates. A path's segments are generalised: one that is a number (with or without
an extension), a long hexadecimal string or a date becomes ``*``. Every segment of a
path is a level; slashes at its end are not.

Merging. A branch whose labelled share of bad pages differs from its parent's by more than
``MERGE_Z`` standard errors keeps a node of its own. Its other siblings are one branch
(``~``), unless their shares differ among each other by more than chance (the chi-square
of their counts lies ``MERGE_Z`` deviations above its mean): then those with at least their common
share are one branch (``~+``) and the others another (``~-``), so that many small bad
directories do not take as many clean ones along. Each segment is tested by
its own labelled pages, however many siblings it has. A path that ends at a
node is a branch of it too (an empty segment), at every level.

Purity. A node's share of bad pages is smoothed towards its parent's smoothed share,
the host's towards the whole table's, with a weight of ``PRIOR`` pages. A node with all the
labelled pages of its parent has its parent's share: the same pages are not counted again
at each level of a long path. The tree is built level
by level until no node has labelled paths that still differ. A page whose node reaches
``BLOCK_AT`` is blocked. Pages are bad when labelled quality 0 or toxic 1.

Explicit rules (host suffix, path prefix) come first; the longest that fits decides.

All of it is DataFrame functions. Counts are aggregated map side before they are
shuffled by (host, branch); the nodes that end up blocking are joined back behind a
size check.

Null urls and urls without ``://`` have an empty host and path and form a node like
any other. Repeated rows count as often as they occur. Without labels every share is
zero and only rules block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import maybe_broadcast, setup, stage_table

MERGE_Z = 3.0
PRIOR = 20.0
BLOCK_AT = 0.5

#: (rule, verdict); a rule is a host, with its subdomains, and a path prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VARIABLE = r"^([0-9]+(\.[A-Za-z]+)?|[0-9a-fA-F-]{16,}|[0-9]{4}-[0-9]{2}(-[0-9]{2})?)$"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # a longer one overrides
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def pattern_of(path: Column) -> Column:
    """The path's segments, generalised by their form, without slashes at its ends."""
    segments = F.slice(F.split(F.rtrim(path, F.lit("/")), "/"), 2, 1 << 30)
    return F.array_join(F.transform(segments, lambda s: F.when(s.rlike(_VARIABLE), F.lit("*")).otherwise(s)), "/")


def _segment(level: int) -> Column:
    """The pattern's segment at ``level``, from 1; empty if there is none."""
    return F.coalesce(F.get(F.split("pattern", "/"), F.lit(level - 1)), F.lit(""))


def templates(pages: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with host, path, pattern; labelled and bad pages of each host and pattern)."""
    setup(pages.sparkSession)
    seen = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("pattern", pattern_of(F.col("path")))
    counted = stage_table(p.join(seen, F.col("page_id") == F.col("_id"), "left").groupBy("host", "pattern")
                          .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "leaves")
    return p, counted


def _descend(leaves: DataFrame, level: int) -> DataFrame:
    """``leaves`` with ``node`` and ``purity`` of the branch at ``level`` below their node:
    the segment there, or ``~`` where its share is like the node's."""
    t = leaves.withColumn("seg", _segment(level))
    by = t.groupBy("node", "seg").agg(F.sum("n").alias("_n"), F.sum("bad").alias("_b"), F.first("purity").alias("_prior"))
    up = by.groupBy("node").agg(F.sum("_n").alias("_pn"), F.sum("_b").alias("_pb"))
    share = F.col("_pb") / F.greatest(F.col("_pn"), F.lit(1))
    error = F.sqrt((share * (1 - share) + F.lit(1e-9)) / F.greatest(F.col("_n"), F.lit(1)))
    z = F.abs(F.col("_b") / F.greatest(F.col("_n"), F.lit(1)) - share) / error
    by = by.join(up, "node").withColumn("_alone", (F.col("_n") > 0) & (z > MERGE_Z))
    like = by.where("not _alone and _n > 0").groupBy("node").agg(
        F.sum("_n").alias("_rn"), F.sum("_b").alias("_rb"), F.count("*").alias("_k"), F.sum(F.col("_b") * F.col("_b") / F.col("_n")).alias("_sq"))
    mean = F.col("_rb") / F.col("_rn")
    spread = (F.col("_sq") - mean * F.col("_rb")) / F.nullif(mean * (1 - mean), F.lit(0.0)) - (F.col("_k") - 1)
    mixed = F.coalesce((F.col("_k") > 1) & (spread > MERGE_Z * F.sqrt(2.0 * (F.col("_k") - 1))), F.lit(False))
    side = F.when(F.col("_b") / F.col("_n") >= F.col("_mean"), F.lit("~+")).otherwise(F.lit("~-"))
    by = (by.join(like.select("node", mean.alias("_mean"), mixed.alias("_mixed")), "node", "left")
          .withColumn("branch", F.when(F.col("_alone"), F.col("seg")).when((F.col("_n") > 0) & F.col("_mixed"), side).otherwise(F.lit("~"))))
    sums = by.groupBy("node", "branch").agg(F.sum("_n").alias("_n"), F.sum("_b").alias("_b"), F.first("_prior").alias("_prior"),
                                            F.first("_pn").alias("_pn"))
    smooth = (F.col("_b") + F.lit(PRIOR) * F.col("_prior")) / (F.col("_n") + F.lit(PRIOR))
    whole = F.col("_n") == F.col("_pn")
    sums = sums.select("node", "branch", F.when(whole, F.col("_prior")).otherwise(smooth).alias("_purity"))
    named = by.select("node", "seg", "branch").join(sums, ["node", "branch"])
    return (t.drop("purity").join(named, ["node", "seg"])
            .select("host", "pattern", "n", "bad", F.concat("node", F.lit("/"), "branch").alias("node"), F.col("_purity").alias("purity")))


def _open(leaves: DataFrame, level: int) -> bool:
    """Whether a node at ``level`` has labelled pages whose paths differ below it."""
    rest = F.array_join(F.slice(F.split("pattern", "/"), level + 1, 1 << 30), "/")
    below = leaves.where("n > 0").groupBy("node").agg(F.min(rest).alias("lo"), F.max(rest).alias("hi"))
    return not below.where("lo <> hi").isEmpty()


def tree(leaves: DataFrame) -> DataFrame:
    """(host, pattern, node, purity) for every pattern seen: the node it falls into
    and the node's smoothed share of bad pages."""
    whole = leaves.agg(F.sum("n").alias("_n0"), F.sum("bad").alias("_b0")).select(
        (F.coalesce(F.col("_b0"), F.lit(0)) / F.greatest(F.coalesce("_n0", F.lit(0)), F.lit(1))).alias("share"))
    hosts = leaves.groupBy("host").agg(F.sum("n").alias("_n"), F.sum("bad").alias("_b")).select(
        "host", F.col("host").alias("node"), ((F.col("_b") + F.lit(PRIOR) * whole.scalar()) / (F.col("_n") + F.lit(PRIOR))).alias("purity"))
    t, level = stage_table(_descend(leaves.join(hosts, "host"), 1), "level"), 2
    t = stage_table(_descend(t, level), "level")
    while _open(t, level):
        level += 1
        t = stage_table(_descend(t, level), "level")
    return t.select("host", "pattern", "node", "purity")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    p, leaves = templates(pages, labels)
    bad = stage_table(tree(leaves).where(F.col("purity") >= BLOCK_AT).select("host", "pattern", F.lit("block").alias("_bad")), "blocked")
    rule, decided = rule_for(F.col("host"), F.col("path"), rules)
    return (p.join(maybe_broadcast(bad), ["host", "pattern"], "left")
            .select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(decided, F.col("_bad"), F.lit("allow")).alias("verdict")))
