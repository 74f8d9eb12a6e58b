"""URL filter by rules and link-graph propagation, in DataFrame operations only.

Rules of (host, path) decide pages that they fit. Hosts of allowed pages are trusted seeds and hosts of blocked pages
distrusted ones, each by its number of such pages. Trust flows along the links between hosts, distrust against them,
both as personalised PageRank; a host is blocked if the distrust that reaches it exceeds its trust by a factor. Links
are counted per pair of hosts before anything else, so that what iterates is the graph of hosts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardflow.plans.staging import staged

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING = 0.85
ROUNDS = 8
FACTOR = 2.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(kind, host, score) after ``rounds`` of personalised PageRank.

    seeds: (kind, host, seed); edges: (kind, src, dst, share) with shares of a source that sum to 1 at most. Kinds
    don't mix. Mass that reaches a host without links on ends there. Lineage is cut every fourth round.
    """
    base = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("add"))
    ranks = seeds.select("kind", "host", F.col("seed").alias("score"))
    for i in range(rounds):
        sent = edges.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("add"))
        ranks = base.unionByName(sent).groupBy("kind", "host").agg(F.sum("add").alias("score"))
        if i % 4 == 3:
            ranks = staged(ranks, f"round{i}")
    return ranks


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, rounds: int = ROUNDS, damping: float = DAMPING, factor: float = FACTOR, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    A rule fits its host and all below it if the path starts with the rule's; the longest rule wins. Pages that no
    rule fits take their host's verdict: block if distrust exceeds ``factor`` times trust, else allow. A null url, or
    one without ``://``, has an empty host and path, which no link reaches: allow. Links within a host don't count;
    a null page has none. Repeated rows come back as often and count as often. An empty table gives no rows.
    """
    url = F.col(url_col).cast("string")
    plain = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    plain = plain.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("given"))
    links = pages.select(host_of(url).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col).cast("string"), F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst and src <> ''")
    links = staged(links.groupBy("src", "dst").agg(F.count("*").alias("n")), "links")
    seeds = plain.where("given is not null and host <> ''").groupBy(F.col("given").alias("kind"), "host").agg(F.count("*").cast("double").alias("seed"))
    if not links.isEmpty():
        ways = links.select(F.lit("allow").alias("kind"), "src", "dst", "n").unionByName(links.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
        of = ways.groupBy("kind", "src").agg(F.sum("n").alias("of"))
        edges = staged(ways.join(of, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("of")).alias("share")), "edges")
        ranks = propagate(staged(seeds, "seeds"), edges, rounds, damping)
    else:  # nothing flows: all scores are their seeds' alike
        ranks = seeds.withColumnRenamed("seed", "score")
    bad = ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "allow", F.col("score")).otherwise(0)).alias("trust"), F.sum(F.when(F.col("kind") == "block", F.col("score")).otherwise(0)).alias("distrust"))
    # written first, so that its size is known when the join is planned: few hosts are broadcast, pages stay where they are
    bad = staged(bad.where(F.col("distrust") > factor * F.col("trust")).select("host", F.lit("block").alias("by_host")), "blocked")
    return plain.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("given", "by_host", F.lit("allow")).alias("verdict"))
