"""URL filter: host and path rules first, then trust and distrust propagated over the host graph.

Hosts are vertices and links between pages of different hosts are edges, weighted by the number of
links, with each host's out-weights summing to 1. Trusted seeds are all hosts of which the rules
allow more pages than they block, blocked seeds those of which they block more; a seed's mass is
that difference as a share of the host's pages, so it does not depend on how many pages a host has.
Trust is personalised PageRank from the trusted seeds along links; distrust is the same from the
blocked seeds against them (who links to bad hosts is suspect). A page without a rule is blocked if
its host's distrust exceeds its trust by more than ``margin``, and else allowed. There, a blocked
seed's own mass counts only if most of the host's pages are blocked: rules that block one path of a
host have left its other pages alone, and what speaks against those has to come from other hosts.

Everything is a DataFrame operation: edges and seeds are pre-aggregated before they are shuffled,
rank steps are joins and sums, and tables are cut from lineage every few steps. Only blocked hosts
are joined back to the pages, on a key that lets a hot host be split.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule and no
links; null html has no links; rows that repeat are judged each; only ``page_id``, ``url`` and
``html`` are read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import runtime
from millrace.operators import components

#: (verdict, host, path): fixed values of the production rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?i)\bhref\s*+=\s*+["']?+\s*+(?:[a-z][a-z0-9+.-]*+:)?//([^/?#"'\s<>]++)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as host + path, verdict) of the longest rule that fits; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, action).otherwise(verdict)
    return name, verdict


def rank(edges: DataFrame, seeds: DataFrame, work: runtime.Workspace, *, damping: float = 0.85, tolerance: float = 1e-6, most_rounds: int = 100) -> DataFrame:
    """Personalised PageRank (host, score) over edges (src, dst, share) from seeds (host, mass)."""
    share = seeds.select("host", (F.col("mass") * (1 - damping)).alias("score"))
    now = work.save(share)
    before = 0.0
    for k in range(1, most_rounds + 1):
        sent = components.joined(edges, now.select(F.col("host").alias("src"), "score"), "src").select(F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        now = share.unionByName(sent).groupBy("host").agg(F.sum("score").alias("score"))
        if k % 5 == 0:
            now = work.save(now)
            mass = now.agg(F.sum("score")).first()[0] or 0.0
            if abs(mass - before) < tolerance * max(mass, 1e-300):
                break
            before = mass
    return now


def judge(pages: DataFrame, *, rules: list[tuple[str, str, str]] = RULES, margin: float = 0.0, damping: float = 0.85) -> DataFrame:
    """Every page: page_id, host, path, rule (null if none fits), verdict (allow or block)."""
    work = runtime.Workspace(pages.sparkSession, "urls")
    rows = runtime.pick(pages, page_id="long", url="string", html="string")
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = rows.withColumn("rule", name).withColumn("by_rule", verdict)

    linked = rows.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("dst"))
    linked = linked.withColumn("dst", F.translate("dst", _UPPER, _LOWER)).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    links = work.save(linked)
    judged = ruled.select("page_id", "host", "path", "rule", "by_rule")
    totals = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("by_rule") == "allow").alias("good"), F.count_if(F.col("by_rule") == "block").alias("bad"))
    totals = work.save(totals.where("good <> bad"))

    def spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
        out = edges.groupBy("src").agg(F.sum("n").alias("out"))
        shares = components.joined(edges, out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share"))
        total = seeds.agg(F.sum("mass")).first()[0]
        start = seeds.withColumn("mass", F.col("mass") / F.lit(total or 1.0))
        found = rank(work.save(shares), start, work, damping=damping) if total and not links.isEmpty() else start.select("host", (F.col("mass") * (1 - damping)).alias("score"))
        own = start.where("not most").select("host", (F.col("mass") * (damping - 1)).alias("score"))
        return found.unionByName(own)

    trust = spread(links, totals.where("good > bad").select("host", ((F.col("good") - F.col("bad")) / F.col("n")).alias("mass"), F.lit(True).alias("most")))
    distrust = spread(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), totals.where("bad > good").select("host", ((F.col("bad") - F.col("good")) / F.col("n")).alias("mass"), (2 * F.col("bad") > F.col("n")).alias("most")))
    scores = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust")))
    bad = scores.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).where(F.col("distrust") > F.col("trust") + margin)
    bad = work.save(bad)
    out = components.joined(judged, bad.select("host", "trust", "distrust"), "host", "left")
    zero = lambda c: F.when(F.col("distrust").isNotNull(), F.col(c)).alias(f"host_{c}")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("distrust").isNotNull(), "block").otherwise("allow")).alias("verdict"), zero("trust"), zero("distrust"))
