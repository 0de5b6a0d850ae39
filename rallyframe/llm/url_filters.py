"""URL filters: listed rules by longest match, and trust spread over the host graph for all other hosts.

Host edges come from absolute links in the pages. Trust is a personalised PageRank that starts at hosts with an allowed
page and follows links; distrust starts at hosts with a blocked page and follows links backwards (who links to blocked
hosts is suspect). A host's standing is trust / (trust + distrust) of its shares; below ``threshold`` it is blocked. Hosts
that neither reaches are allowed. Edges are summed per pair of hosts before anything is joined, each round is written to
the shared scratch folder, and all steps are DataFrame functions.

Defined cases: a null url or one without ``://`` has empty host and path, no rule, and is allowed; null or empty html has
no links; links to the own host are no edges; dangling hosts give their rank back to the seeds; rows that repeat a page
count their links again; without edges only the seeds carry rank; an empty table gives an empty table; input columns other
than id, url and html are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.plans.scratch import stash, unstash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)\b(?:href|src)\s*=\s*[\"']?(?:https?:)?//([^\"'\s/?#>]+)"
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-4, 0.5
#: Rounds after which the ranks are written and their lineage cut.
CUT = 4


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds rule and rule_verdict to rows with host and path: of the rules that fit, the longest."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.text)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return pages.withColumn("rule", name).withColumn("rule_verdict", verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, share): links from host to host as shares of the source's links. pages: host, html."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    return links.withColumn("dst", F.translate("dst", UPPER, LOWER)).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("links"))


def _shared(edges: DataFrame, a: str, b: str) -> DataFrame:
    total = edges.groupBy(a).agg(F.sum("links").alias("all"))
    return edges.join(total, a).select(F.col(a).alias("src"), F.col(b).alias("dst"), (F.col("links") / F.col("all")).alias("share"))


def spread(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): a personalised PageRank. edges: (src, dst, share); seeds: (host, start) that sum to 1.

    What dangling hosts would give back to the seeds only scales the ranks, so it is left out of the rounds and the sum is
    made 1 in the end. The sum of the ranks grows from round to round; rounds end when ``CUT`` of them add less than
    ``tolerance``.
    """
    home = seeds.select("host", ((1 - DAMPING) * F.col("start")).alias("rank"))
    rank, mass, old = home, 0.0, None
    while True:
        for _ in range(CUT):
            sent = rank.join(edges, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (DAMPING * F.col("rank") * F.col("share")).alias("rank"))
            rank = sent.union(home).groupBy("host").agg(F.sum("rank").alias("rank"))
        rank = stash(rank, "ranks")
        before, mass = mass, rank.agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        if old is not None:
            unstash(old)
        old = rank
        if mass - before < tolerance:
            return rank.select("host", (F.col("rank") / mass).alias("rank")) if mass else rank


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Per page: the id, host, path, rule (the longest that fits, else null), trust (the host's standing; null if nothing reaches it) and verdict."""
    named = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    rows = ruled(named.drop("html"), rules)
    per_host = rows.groupBy("host").agg(F.max(F.col("rule_verdict") == "allow").alias("good"), F.max(F.col("rule_verdict") == "block").alias("bad")).where("good or bad")
    seeds = stash(per_host.where("host <> ''"), "seeds")
    edges = stash(host_edges(named), "edges")
    total = lambda which: seeds.where(which).agg(F.count("*")).scalar()
    even = lambda which: seeds.where(which).select("host", (1.0 / total(which)).alias("start"))
    start_good, start_bad = even("good"), even("bad")
    if edges.isEmpty():
        trust, distrust = start_good.withColumnRenamed("start", "rank"), start_bad.withColumnRenamed("start", "rank")
    else:
        shared = lambda a, b: stash(_shared(edges, a, b), "shares")
        trust, distrust = spread(shared("src", "dst"), stash(start_good, "seeds"), tolerance), spread(shared("dst", "src"), stash(start_bad, "seeds"), tolerance)
    standing = (
        trust.select("host", F.col("rank").alias("t")).join(distrust.select("host", F.col("rank").alias("d")), "host", "full")
        .select("host", (F.coalesce("t", F.lit(0.0)) / (F.coalesce("t", F.lit(0.0)) + F.coalesce("d", F.lit(0.0)))).alias("trust"))
    )
    verdict = F.coalesce("rule_verdict", F.when(F.col("trust") < threshold, F.lit("block")).otherwise(F.lit("allow")))
    # pages that a rule decides need no host lookup
    open_rows = rows.where("rule is null").join(standing, "host", "left")
    return (
        open_rows.select(id_col, "host", "path", "rule", "trust", verdict.alias("verdict"))
        .union(rows.where("rule is not null").select(id_col, "host", "path", "rule", F.lit(None).cast("double").alias("trust"), F.col("rule_verdict").alias("verdict")))
    )
