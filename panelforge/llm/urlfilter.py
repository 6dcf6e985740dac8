"""URL verdicts: rules first, then trust and distrust propagated over the link graph of hosts.

Hosts are linked by the links of their pages, to themselves too, and every host and its parent domain, whether
or not a page is on it, link to each other: so hosts of one owner meet. Personalised PageRank spreads trust
from the hosts whose pages the rules allow, along links, and distrust from those whose pages the rules block,
against them (Gyongyi, Garcia-Molina and Pedersen, "Combating web spam with TrustRank", 2004; Krishnan and
Raj, "Web spam detection with Anti-Trust Rank", 2006). Ranks are in pages: a kind's ranks sum to its seed pages at
most. A host is blocked if distrust is more than ``THRESHOLD`` of both together; all others are allowed.

Scale. Only DataFrame functions. Links are aggregated to weighted host pairs before they are shuffled,
and ranks move until ``STEP`` rounds change them by less than ``CHANGE`` of all seeds; each round is one join of
the links with one row per host and one grouped sum with partial aggregation. Rounds are written to the shared
folder now and then. A hub's links lie on the join's other side, which adaptive execution can split.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import join_grouped, release, staged

DAMPING, THRESHOLD, STEP, CHANGE = 0.85, 0.5, 5, 1e-3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://"."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end; empty without "://"."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (host, path, verdict) that fits, else null; of rules of one
    length, the first of the list. A rule fits its host and all subdomains of it."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(reversed(rules), key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def parent_domains(host: Column) -> Column:
    """The host's name without its port, and the domains above it, nearest first: of two labels at least, of three
    under a two-letter domain whose second label has at most three letters ("co.uk"). A numeric address has none."""
    name = F.regexp_replace(host, r":\d*$", "")
    labels = F.split(name, r"\.")
    least = F.when(name.rlike(r"(^|\.)[^.]{1,3}\.[a-z]{2}$"), 3).otherwise(2)
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - least)), lambda k: F.concat_ws(".", F.slice(labels, k + 1, F.size(labels))))
    return F.when(name.rlike(r"^[0-9.]*$|^\[") | (F.size(labels) <= least), F.array(host)).otherwise(F.concat(F.array(host), above))


def host_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(source, target, weight): host pairs and how many links make them; a link without a host is one to the
    page's own. A host and its parent domain are linked both ways with weight 1."""
    src = pages.select(host_of(F.col(url_col)).alias("source"), F.col(html_col).alias("html")).where("source <> ''")
    links = src.select("source", F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("u"))
    absolute = F.when(F.col("u").startswith("//"), host_of(F.concat(F.lit("x:"), "u"))).when(F.col("u").rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), host_of(F.col("u")))
    target = F.coalesce(absolute, F.when(~F.col("u").rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.col("source")))
    links = links.select("source", target.alias("target")).where("target <> ''").groupBy("source", "target").agg(F.count("*").cast("double").alias("weight"))
    hosts = src.select("source").union(links.select("target")).distinct()
    chain = hosts.select(parent_domains(F.col("source")).alias("c"))
    up = chain.select(F.explode(F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("host"), F.slice("c", 2, F.size("c") - 1).alias("parent"))).alias("p")).select("p.*").distinct()
    owned = up.select(F.col("host").alias("source"), F.col("parent").alias("target")).union(up.select("parent", "host"))
    both = links.unionByName(owned.withColumn("weight", F.lit(1.0)))
    return both.groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def propagate(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """links: (source, target, weight); seeds: (host, trust, distrust), counts. (host, trust, distrust):
    personalised PageRank of the seeds, each kind summing to at most its seeds' total; trust along the
    links, distrust against them. Without seeds of a kind its ranks are 0."""
    forward = links.select(F.lit(0).alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), "weight")
    both = forward.union(links.select(F.lit(1), F.col("target"), F.col("source"), "weight"))
    out = both.groupBy("kind", "a").agg(F.sum("weight").alias("total"))
    edges = staged(join_grouped(both, out, ["kind", "a"]).select("kind", "a", "b", (F.col("weight") / F.col("total")).alias("share")), "links")
    start = seeds.select(F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("host").alias("a"), F.col("trust").alias("rank")),
        F.struct(F.lit(1).alias("kind"), F.col("host").alias("a"), F.col("distrust").alias("rank")),
    )).alias("s")).select("s.*").where("rank > 0")
    start = staged(start, "seeds")
    total = start.agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
    old = start
    for k in count(1):
        rank = old
        for _ in range(STEP):
            moved = join_grouped(edges, rank, ["kind", "a"]).select("kind", F.col("b").alias("a"), (F.col("rank") * F.col("share") * DAMPING).alias("rank"))
            moved = moved.union(start.select("kind", "a", (F.col("rank") * (1 - DAMPING)).alias("rank")))
            rank = moved.groupBy("kind", "a").agg(F.sum("rank").alias("rank"))
        rank = staged(rank, f"rank-{k}")
        apart = rank.union(old.select("kind", "a", -F.col("rank"))).groupBy("kind", "a").agg(F.sum("rank").alias("d"))
        change = apart.agg(F.coalesce(F.sum(F.abs("d")), F.lit(0.0))).first()[0]
        if old is not start:
            release(old)
        old = rank
        if change <= CHANGE * total:
            break
    by = [F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(n) for kind, n in ((0, "trust"), (1, "distrust"))]
    return old.groupBy(F.col("a").alias("host")).agg(*by)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id_col, host, path, rule (null if none fits), verdict, trust, distrust.

    A null url, or one without "://", has an empty host and path, no rule, and is allowed. A null or empty html
    has no links; a very long one is read whole. Of rules of equal length that fit, the first of the list counts.
    Null ids stay null. Repeated rows are judged as often as they come, and count as often as seeds; other
    columns of pages, whatever their names, are not touched. Without pages the result is empty."""
    seen = pages.select(F.col(id_col).alias("__id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    seen = seen.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    counted = [F.sum(F.when(F.col("hit.verdict") == v, 1).otherwise(0)).cast("double").alias(n) for v, n in (("allow", "trust"), ("block", "distrust"))]
    seeds = staged(seen.where("host <> '' and hit is not null").groupBy("host").agg(*counted), "rule-hosts")
    ranks = propagate(host_links(pages, url_col, html_col), seeds)
    out = join_grouped(seen, ranks, ["host"], "left")
    block = F.coalesce(F.col("distrust") > THRESHOLD * (F.col("trust") + F.col("distrust")), F.lit(False))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(block, "block").otherwise("allow"))
    return out.select(F.col("__id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
