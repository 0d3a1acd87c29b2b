"""URL filters: rules first, then trust and distrust that spread over links between hosts.

Hosts are seeded by the share of their pages that a rule allows or blocks. Trust follows links as a
personalised PageRank; distrust follows them backwards, to those who link to what is blocked. A page
without a rule is blocked if its host is distrusted more than it is trusted.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwright.llm.common import settle

#: (verdict, host and path); a rule fits the host and its subdomains, the longest that fits wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING = 0.85
#: Ranks are final once a round adds to no host more than this share of its own rank.
STILL = 1e-4
#: How much more distrust than trust blocks a host.
MARGIN = 1e-9
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """The part after the first :// in lower case (A-Z only); empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; both null if none does."""
    text = verdict = F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(f"/{start}"))
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """Links between different hosts: columns source, target, n. A link may be //host without a scheme."""
    found = F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1))
    links = pages.select(host_of(F.col("url").cast("string")).alias("source"), F.explode(found).alias("link"))
    target = host_of(F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link")))
    ends = links.select("source", target.alias("target")).where("source != '' and target != '' and source != target")
    return ends.groupBy("source", "target").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Personalised PageRank: columns host and rank, from seeds (host, weight) over links.

    Weight follows a host's links in proportion to their number; what a host without links has is not
    passed on. Each round passes on what hosts were given by the one before. The rounds stop once one adds
    to no host more than ``STILL`` of the host's own rank, which also means that it reached no new host, or
    once all that is still to come is far below what tells a verdict. So a host's rank does not depend on
    what else the table holds. Ranks are written to the checkpoint folder each round; a host with very many
    links is split by adaptive execution, since it joins with one row of its own.
    """
    sums = links.groupBy("source").agg(F.sum("n").alias("all"))
    shares = settle(links.join(sums, "source").select("source", "target", (F.col("n") / F.col("all")).alias("share")))
    base = F.col("weight") * (1 - DAMPING)
    ranks = settle(seeds.select("host", base.alias("rank"), base.alias("given")))
    if shares.isEmpty():
        return ranks.select("host", "rank")
    while True:
        passed = ranks.where("given > 0").join(shares, ranks.host == shares.source)
        passed = passed.groupBy("target").agg((F.sum(F.col("given") * F.col("share")) * DAMPING).alias("given"))
        passed = passed.select(F.col("target").alias("host"), F.col("given").alias("rank"), "given")
        both = ranks.select("host", "rank", F.lit(0.0).alias("given")).unionByName(passed)
        ranks = settle(both.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("given").alias("given")))
        # A host reached for the first time has been given all of its rank.
        moving, given = ranks.agg(F.max(F.col("given") > F.lit(STILL) * F.col("rank")), F.sum("given")).first()
        if not moving or given * DAMPING < (1 - DAMPING) * STILL * MARGIN:
            return ranks.select("host", "rank")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, trust and distrust of its host.

    A null url, or one without ://, has an empty host and path; without a rule or evidence the verdict
    is allow. Null pages have no links. Rows repeat where pages do and count each time.
    """
    url = F.col("url").cast("string")
    split = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = settle(split.withColumn("rule", rule).withColumn("by_rule", verdict))
    share = lambda kind: F.avg(F.when(F.col("by_rule") == kind, 1.0).otherwise(0.0))
    hosts = settle(judged.where("host != ''").groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block")))
    links = settle(host_links(pages))
    back = links.select(F.col("target").alias("source"), F.col("source").alias("target"), "n")
    trust = spread(hosts.where("allow > 0").select("host", F.col("allow").alias("weight")), links)
    distrust = spread(hosts.where("block > 0").select("host", F.col("block").alias("weight")), back)
    ranks = trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(
        distrust.select("host", F.lit(0.0).alias("trust"), F.col("rank").alias("distrust"))
    )
    ranks = ranks.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    found = judged.join(ranks, "host", "left").fillna(0.0, ["trust", "distrust"])
    by_host = F.when(F.col("distrust") - F.col("trust") > MARGIN, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), "trust", "distrust")
