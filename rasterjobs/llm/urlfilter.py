"""URL filter: longest-match rules, and trust that spreads over links between hosts.

Pages that a rule fits are judged by it. The other pages are judged by host:
personalised PageRank runs from hosts with allowed pages along links (trust) and
from hosts with blocked pages against them (distrust, since who links to a
blocked host is suspect). A host with more distrust than trust is blocked.

Scores are whole numbers of 1e-9 seed pages, rounded down at each step, so the
result does not depend on the order in which partitions are summed. They only
grow from round to round and are bounded by the seeds, so the rounds end when
nothing changes any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stage

UNIT = 1_000_000_000
#: Share of a score that links pass on, in hundredths.
DAMPING = 85

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A link that names a host: its scheme is optional, its host ends at ``/?#``.
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^\s"'<>/?#]+)"""


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column, most: int) -> Column:
    """A host and its parent domains, as far as they have at most ``most`` labels: a.b.c, b.c, c."""
    parts = F.slice(F.reverse(F.split(host, r"\.")), 1, most)
    parts = F.reverse(parts)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def with_rule(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (with host, path) and ``rule``, ``action`` of the longest rule that fits.

    Rules (host, path, action) are looked up once for each distinct host and its
    parent domains; a page then only compares paths with the rules of its host.
    Equal lengths: the longer path, then the greater text wins.
    """
    hosts = pages.select("host").distinct()
    most = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    by = hosts.select("host", F.explode(suffixes(F.col("host"), most)).alias("rhost"))
    r = rules.select(F.col("host").alias("rhost"), F.col("path").alias("rpath"), F.col("action"))
    r = by.join(small(r), "rhost").groupBy("host").agg(F.collect_list(F.struct("rhost", "rpath", "action")).alias("_rules"))
    best = F.array_max(
        F.transform(
            F.filter("_rules", lambda x: F.startswith(F.col("path"), x.rpath)),
            lambda x: F.struct((F.length(x.rhost) + F.length(x.rpath)).alias("n"), F.length(x.rpath).alias("m"), F.concat(x.rhost, x.rpath).alias("rule"), x.action.alias("action")),
        )
    )
    return pages.join(small(stage(r, "host-rules")), "host", "left").withColumn("_best", best).withColumn("rule", F.col("_best.rule")).withColumn("action", F.col("_best.action")).drop("_best", "_rules")


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """``src, dst, n``: pages of a host that link to another host. Links without a host stay inside and don't count."""
    links = pages.select("host", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(LINK), 1), lambda x: F.translate(x, UPPER, LOWER)))).alias("dst"))
    return links.filter("host <> dst and host <> ''").groupBy(F.col("host").alias("src"), "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: int = DAMPING) -> DataFrame:
    """``host, trust, distrust`` when a further round changes nothing.

    ``seeds``: host, allowed, blocked (pages). Each round is one join of the
    scores with the edges and one sum, for trust and reversed distrust at once;
    its result is written down, so a lost executor never repeats earlier rounds.
    """
    way = [edges.select(F.lit(kind).alias("kind"), F.col(a).alias("u"), F.col(b).alias("v"), "n") for kind, a, b in (("trust", "src", "dst"), ("distrust", "dst", "src"))]
    e = way[0].unionByName(way[1])
    e = stage(e.join(e.groupBy("kind", "u").agg(F.sum("n").alias("out")), ["kind", "u"]), "host-edges")
    both = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), (F.col(c).cast("long") * UNIT).alias("seed")) for k, c in (("trust", "allowed"), ("distrust", "blocked")))))
    start = stage(seeds.select("host", both.alias("x")).select("host", "x.kind", "x.seed").filter("seed > 0"), "seeds")
    base = start.select("host", "kind", F.expr(f"seed * {100 - damping} div 100").alias("score"))
    score = base
    if not e.isEmpty():
        while True:
            sent = e.join(score.withColumnRenamed("host", "u"), ["kind", "u"]).groupBy(F.col("v").alias("host"), "kind").agg(
                F.sum(F.expr(f"cast((cast(score as decimal(20,0)) * cast(n as decimal(12,0)) * {damping}) div (cast(out as decimal(12,0)) * 100) as bigint)")).alias("score")
            )
            new = stage(base.unionByName(sent).groupBy("host", "kind").agg(F.sum("score").alias("score")), "scores")
            same = new.exceptAll(score).isEmpty()
            score = new
            if same:
                break
    return score.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0)).alias(k) for k in ("trust", "distrust")))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", threshold: int = 0) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every page.

    ``rules`` are (host, path, "allow" or "block"); a rule fits its host and all
    subdomains if the page's path starts with the rule's. Without a rule a page is
    blocked if its host's distrust exceeds its trust by more than ``threshold``.

    A null url, or one without ``://``, has an empty host and path; no rule with a
    host fits it and it is allowed. A null html has no links. Repeated rows repeat
    and count as further pages. Scores of hosts that nothing reaches are 0.
    """
    spark = pages.sparkSession
    if isinstance(rules, list):
        rules = spark.createDataFrame(rules, "host string, path string, action string")
    u = F.col(url).cast("string")
    p = pages.select(F.col(page_id).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"), F.col(html).cast("string").alias("html"))
    narrow = with_rule(p.select("page_id", "host", "path"), rules)
    seeds = narrow.groupBy("host").agg(F.count_if(F.col("action") == "allow").alias("allowed"), F.count_if(F.col("action") == "block").alias("blocked"))
    scores = propagate(host_edges(p), seeds.filter("host <> ''"))
    out = narrow.join(small(stage(scores, "host-scores")), "host", "left")
    trust, distrust = (F.coalesce(c, F.lit(0)) for c in ("trust", "distrust"))
    verdict = F.coalesce("action", F.when(distrust - trust > threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
