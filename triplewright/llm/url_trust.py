"""URL verdicts from rules and from trust that spreads over a graph of hosts.

Rules judge the URLs that they fit. Hosts with URLs that rules allow or block are the seeds of two
personalised PageRanks: trust follows the links from the allowed seeds, distrust follows them backwards
from the blocked ones. A URL without a rule gets the verdict of its host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import Workspace

#: (verdict, host and path)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/"))
DAMPING = 0.85
ROUNDS = 12
#: A host is blocked when its share of trust in trust plus distrust is below this.
TRUSTED_FROM = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), "^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_name: Column, path_name: Column, rules=RULES) -> Column:
    """The longest rule that fits, as written; null if none does."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = (host_name == name) | host_name.endswith("." + name)
        found = F.when(fits & path_name.startswith(slash + rest), F.lit(rule)).otherwise(found)
    return found


def rule_verdict(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, name in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def host_edges(pages: DataFrame, ws: Workspace) -> DataFrame:
    """(src, dst, weight): links between hosts, and a host with the domains that it is a part of.

    ``pages`` has host and html. Links are the absolute ones in the markup; a host and each name above it
    down to two labels are linked both ways, with the weight of one link.
    """
    pattern = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
    links = pages.select(F.col("host").alias("src"),
                         F.explode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    counted = ws.save(links.where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight")),
                      ws.unique("links"))
    names = pages.select("host").unionByName(counted.select(F.col("dst").alias("host"))).where("host <> ''").distinct()
    labels = F.split("host", "\\.")
    above = F.transform(F.sequence(F.lit(2), F.size(labels) - 1),
                        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    chain = names.where(F.size(labels) > 2).select("host", F.explode(F.slice(above, 1, F.size(labels) - 2)).alias("up"))
    kin = chain.select(F.col("host").alias("src"), F.col("up").alias("dst")).unionByName(
        chain.select(F.col("up").alias("src"), F.col("host").alias("dst"))).distinct()
    both = counted.unionByName(kin.withColumn("weight", F.lit(1).cast("long")))
    return ws.save(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), ws.unique("edges"))


def page_rank(edges: DataFrame, seeds: DataFrame, ws: Workspace, rounds: int = ROUNDS,
              damping: float = DAMPING) -> DataFrame:
    """(host, rank): PageRank over (src, dst, weight) that jumps to (host, seed), whose seeds are shares.

    What hosts without links out hold goes back to the seeds. Each round is a table of its own.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    moves = ws.save(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")),
                    ws.unique("moves"))
    start = ws.save(seeds.select("host", "seed"), ws.unique("seeds"))
    rank = start.withColumnRenamed("seed", "rank")
    for _ in range(rounds):
        sent = rank.join(moves, rank.host == moves.src).groupBy(F.col("dst").alias("host")).agg(
            F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = ws.save(
            start.join(sent, "host", "full").select(
                "host", F.coalesce("seed", F.lit(0.0)).alias("seed"), F.coalesce("got", F.lit(0.0)).alias("got")),
            ws.unique("sent"))
        kept = rank.agg(F.sum("got")).first()[0] or 0.0
        back = 1 - damping * min(1.0, kept)
        rank = rank.select("host", (F.lit(damping) * F.col("got") + F.lit(back) * F.col("seed")).alias("rank"))
    return rank


def judge(pages: DataFrame, ws: Workspace, rules=RULES, threshold: float = TRUSTED_FROM) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust) of rows (page_id, url, html).

    Without a rule the verdict is that of the host: block if its trust share is below ``threshold``, else
    allow; a host that neither rank reaches, or an empty one, has a null trust share and is allowed. A null
    url has an empty host and path. Every row gives one row, repeated or not.
    """
    named = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "html")
    found = named.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    found = found.withColumn("ruled", rule_verdict(F.col("rule"), rules))
    votes = ws.save(
        found.where("host <> ''").groupBy("host").agg(F.count(F.when(F.col("ruled") == "allow", 1)).alias("good"),
                                                      F.count(F.when(F.col("ruled") == "block", 1)).alias("bad")),
        ws.unique("votes"))
    edges = host_edges(found, ws)
    good, bad = votes.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    trust = page_rank(edges, votes.where("good > 0").select("host", (F.col("good") / F.lit(good or 1)).alias("seed")),
                      ws)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = page_rank(back, votes.where("bad > 0").select("host", (F.col("bad") / F.lit(bad or 1)).alias("seed")),
                         ws)
    # Ranks are shares of one; hosts are compared by the pages that stand behind each rank.
    scored = trust.withColumnRenamed("rank", "good").join(distrust.withColumnRenamed("rank", "bad"), "host", "full")
    t = F.coalesce("good", F.lit(0.0)) * F.lit(float(good))
    d = F.coalesce("bad", F.lit(0.0)) * F.lit(float(bad))
    hosts = ws.save(scored.select("host", F.round(t / (t + d), 9).alias("trust")), ws.unique("hosts"))
    host_verdict = F.when(F.col("trust") < threshold, "block").otherwise("allow")
    return found.drop("html").join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", host_verdict).alias("verdict"), "trust")
