"""URL filters: host and path rules, and link-graph propagation for what no rule fits, in DataFrame functions only.

Hosts with pages that rules allow are trusted seeds, hosts with pages that they block are blocked seeds, each by their
number of such pages. Trust is personalised PageRank from the trusted seeds along links between hosts; distrust is the
same from the blocked seeds along reversed links, so a host that links to blocked ones is distrusted. A host is
blocked if its distrust exceeds both its trust and a floor, which is relative to the least seed's share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, table

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Ranks are iterated until less than REST of their mass is on its way, which ROUNDS rounds always reach.
DAMPING, ROUNDS, REST = 0.85, 128, 1e-9
#: Distrust below this part of the least blocked seed's share doesn't block.
FLOOR = 1e-4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, of equals the one that blocks; null if none fits."""
    fits = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fit = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits = F.when(fit, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(fits)
    return fits


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links of ``html`` from each host to others; links without a host stay on theirs and don't count."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), 1)
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(found).alias("link"))
    whole = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    return links.select("src", host_of(whole).alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(
        F.count("*").alias("n")
    )


def page_rank(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, rank): personalised PageRank over ``links`` (src, dst, n) from ``seeds`` (host, n), summing to at most 1.

    What reaches hosts without links leaves the graph, as it does in a walk that ends there. No seeds give no rows.
    """
    total = seeds.agg(F.sum("n").alias("all"))
    start = checkpointed(seeds.crossJoin(F.broadcast(total)).select("host", (F.col("n") / F.col("all")).alias("share")))
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    edges = checkpointed(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("part")))
    rank = start.select("host", (F.col("share") * (1 - DAMPING)).alias("rank"))
    wave = rank
    if edges.isEmpty():
        return rank
    ranks = rank
    for k in range(1, rounds + 1):
        wave = wave.join(edges, wave["host"] == edges["src"]).groupBy(F.col("dst").alias("host")).agg(
            (DAMPING * F.sum(F.col("rank") * F.col("part"))).alias("rank")
        )
        wave = checkpointed(wave)
        ranks = ranks.unionByName(wave)
        if k % 4 == 0:
            ranks = checkpointed(ranks.groupBy("host").agg(F.sum("rank").alias("rank")))
            if (wave.agg(F.sum("rank")).first()[0] or 0.0) < REST:
                break
    return ranks.groupBy("host").agg(F.sum("rank").alias("rank"))


def filter_urls(pages: DataFrame, links: DataFrame | None = None, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of each row of ``pages`` (page_id, url, html).

    ``links`` (src, dst, n) are read from ``html`` if not given. Where no rule fits, the host's ranks decide; a host
    without either, and the empty host, is allowed. Null urls have an empty host and path; repeated rows each get a row.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("_fit", rule_of(F.col("host"), F.col("path"), rules))
    links = checkpointed(host_links(pages) if links is None else links)
    judged = checkpointed(rows.where("_fit is not null").groupBy("host", F.col("_fit.verdict").alias("v")).agg(F.count("*").alias("n")))
    trust = page_rank(links, judged.where("v = 'allow'").select("host", "n"))
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = page_rank(back, judged.where("v = 'block'").select("host", "n"))
    both = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full")
    ranks = checkpointed(both.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    least = judged.where("v = 'block'").agg((F.min("n") / F.sum("n")).alias("least"))
    out = rows.join(ranks, "host", "left").crossJoin(F.broadcast(least))
    bad = F.coalesce((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= FLOOR * F.col("least")), F.lit(False))
    verdict = F.coalesce(F.col("_fit.verdict"), F.when(bad, "block").otherwise("allow"))
    return out.select(
        "page_id", "host", "path", F.col("_fit.rule").alias("rule"), verdict.alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return filter_urls(table(spark, sf_dir, "pages"))
