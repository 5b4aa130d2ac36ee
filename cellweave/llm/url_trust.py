"""URL filter: prefix rules, and for other urls trust and distrust propagated over links.

Hosts with allowed pages seed trust, which follows links (personalised PageRank); hosts
with blocked pages seed distrust, which follows links backwards: who links to a blocked
host is suspect. Pages without a rule seed nothing. A page that no rule fits takes its
host's verdict: blocked where distrust exceeds `threshold` times trust by more than
`tolerated` times what a host gets whose pages are all blocked. A host that neither
trust nor distrust reaches is allowed: nothing speaks against it.

Ranks are not scaled to a sum of one: seeds are shares of a host's own pages, so that trust
and distrust compare. Rank that hosts without links would pass on is not dealt out again;
giving it back to the seeds would multiply all ranks by one number.

Nothing but built-in expressions. Links are summed per pair of hosts before anything is
joined. Trust and distrust move together: a step joins one table of edges with one of
ranks on the host and sums with map-side combining; a hub's edges can be split by adaptive
execution. Each `STEPS` steps are cut off by a reliable checkpoint, and only two numbers
for each reach the driver. Steps go on until ranks stand still to `tolerance`: each
shrinks what moves by `damping` at least, so they end.

Cases: a null url or one without `://` has empty host and path; null html has no links;
repeated pages count each time; a null page_id is kept; very long urls are matched whole;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint, pin

# The rules (verdict, rule).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Steps from one checkpoint to the next.
STEPS = 8
LINK = r"""(?i)(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^/?#"'\s>]+)"""


def host_of(url):
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host, path, rules=RULES):
    """The longest rule that fits, or null."""
    fitting = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        fitting = F.when(fits, F.lit(rule)).otherwise(fitting)
    return fitting


def verdict_of(rule, rules=RULES):
    verdict = F.lit(None).cast("string")
    for kind, name in rules:
        verdict = F.when(rule == name, F.lit(kind)).otherwise(verdict)
    return verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts; relative links stay on their host."""
    target = F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1))).alias("link")
    dst = F.translate(F.regexp_extract("link", r"//(.*)$", 1), UPPER, LOWER)
    return (
        pages.select("host", target)
        .select(F.col("host").alias("src"), dst.alias("dst"))
        .where("src <> '' and dst <> '' and src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )


def propagate(hosts: DataFrame, edges: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """(host, trust, distrust): (1 - damping) * seed + damping * what neighbours pass on.

    hosts: (host, good, bad), the seeds of every host; edges: (a, b, forth, back), a passes
    the share `forth` of its trust and `back` of its distrust to b. Ends when a step moves
    the ranks by no more than `tolerance` of their sums.
    """
    seeded = hosts.select("host", ((1 - damping) * F.col("good")).alias("trust"), ((1 - damping) * F.col("bad")).alias("distrust"))

    def step(ranks: DataFrame) -> DataFrame:
        passed = edges.join(ranks, edges["a"] == ranks["host"]).select(
            F.col("b").alias("host"),
            (damping * F.col("forth") * F.col("trust")).alias("trust"),
            (damping * F.col("back") * F.col("distrust")).alias("distrust"),
        )
        return seeded.union(passed).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))

    ranks = seeded
    while True:
        for _ in range(STEPS - 1):
            ranks = step(ranks)
        last = ranks.select("host", F.col("trust").alias("trust_before"), F.col("distrust").alias("distrust_before"))
        both = checkpoint(step(ranks).join(last, "host"))
        moved, total = both.agg(
            F.sum(F.abs(F.col("trust") - F.col("trust_before")) + F.abs(F.col("distrust") - F.col("distrust_before"))),
            F.sum(F.col("trust") + F.col("distrust")),
        ).first()
        ranks = both.select("host", "trust", "distrust")
        if (moved or 0.0) <= tolerance * (total or 0.0):
            return ranks


def judge(
    pages: DataFrame,
    rules=RULES,
    damping: float = 0.85,
    tolerance: float = 1e-6,
    threshold: float = 1.0,
    tolerated: float = 0.5,
) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of each page (page_id, url, html).

    A host's trust seed is its share of allowed pages, its distrust seed the share of
    blocked pages; hosts only linked to seed nothing.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    named = pages.select("page_id", "html", host.alias("host"), path.alias("path")).withColumn("rule", rule)
    own = pin(named.select("page_id", "host", "path", "rule", verdict_of(F.col("rule"), rules).alias("given")))
    edges = checkpoint(host_edges(named))
    seeds = own.groupBy("host").agg(
        F.avg(F.when(F.col("given") == "allow", 1.0).otherwise(0.0)).alias("good"),
        F.avg(F.when(F.col("given") == "block", 1.0).otherwise(0.0)).alias("bad"),
    )
    linked = edges.select(F.col("src").alias("host")).union(edges.select(F.col("dst").alias("host"))).distinct()
    zero = F.lit(0.0)
    hosts = checkpoint(
        linked.join(seeds, "host", "full").select("host", F.coalesce("good", zero).alias("good"), F.coalesce("bad", zero).alias("bad"))
    )
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("all"))
    share = F.col("n") / F.col("all")
    forth = edges.join(out, "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), share.alias("forth"), zero.alias("back"))
    back = edges.join(into, "dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), zero.alias("forth"), share.alias("back"))
    scores = propagate(hosts, checkpoint(forth.union(back)), damping, tolerance)
    blocked = F.col("distrust") > threshold * F.col("trust") + tolerated * (1 - damping)
    return own.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("given", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        "trust",
        "distrust",
    )


def query(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
