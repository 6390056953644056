"""Link-graph propagation of trust and distrust over hosts.

Hosts of allowed urls seed a personalised PageRank along host links; hosts of blocked urls seed
the same walk against the links, so that those who link to blocked hosts inherit distrust. The
two scores of a host decide, by a threshold, urls that no rule covers.

Link rows are counted by host pair before anything else; the walks move host rows only, both at
once, with one join and one aggregation a round, and their lineage is cut every few rounds. The
rows of hub hosts are split.

Edge cases: null urls and urls without ``://`` have empty host and path and are allowed (no
scores); null html has no links; links without a host stay on the host of their page or of its
<base> and move no score on the page's own; repeated pages count again in link weights and give repeated rows; empty tables
give empty results; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import delete, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the url query.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    rest = F.coalesce(_rest(url), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.coalesce(_rest(url), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


HREF = r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
BASE_HREF = r"""(?i)<base\b[^>]*?\bhref\s*=\s*["']?\s*([^"'\s>]+)"""


def _absolute(href: Column) -> Column:
    """An href with a host of its own as ``scheme://host...``, else null."""
    return F.when(href.startswith("//"), F.concat(F.lit("x:"), href)).when(href.rlike(r"^(?i)[a-z][a-z0-9+.-]*://"), href)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted. Relative links follow a page's <base>."""
    html = F.coalesce("html", F.lit(""))
    base = host_of(_absolute(F.regexp_extract(html, BASE_HREF, 1)))
    links = pages.select(host_of(F.col("url")).alias("src"), base.alias("base"), F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(HREF), 1))).alias("href"))
    relative = ~F.col("href").rlike(r"^(?i)(#|[a-z][a-z0-9+.-]*:)")
    dst = F.coalesce(host_of(_absolute(F.col("href"))), F.lit(""))
    ends = links.select("src", F.when((dst == "") & relative, F.coalesce("base", F.lit(""))).otherwise(dst).alias("dst"))
    return ends.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _steps(edges: DataFrame, damping: float, hub: int) -> DataFrame:
    """(kind, src, part, dst, p): both walks' moves; ``part`` splits the rows of hosts with more than
    ``hub`` partners."""
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("total"), F.ceil(F.count(F.lit(1)) / hub).alias("parts"))
    part = F.pmod(F.xxhash64("dst"), F.col("parts"))
    return materialize(both.join(out, ["kind", "src"]).select("kind", "src", part.alias("part"), "dst", (F.col("n") / F.col("total") * damping).alias("p")), "host-steps")


def propagate(
    edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, cut_every: int = 5, rounds: int = 400, hub: int = 100_000
) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust) over edges (src, dst, n).

    Scores start from the seeds' shares and only grow; rounds go on until all that a walk can still
    add is below ``tolerance``. What ends at hosts without links goes back to the seeds: that
    multiplies all scores of a walk by one number, so it is done once, at the end, and the scores
    of a walk always add up to its seeds, with links or without.
    """
    steps = _steps(edges, damping, hub)
    start = materialize(
        seeds.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col("host"), F.col(k).alias("score")) for k in ("trust", "distrust")])).alias("e"))
        .select("e.*")
        .where("score > 0"),
        "host-seeds",
    )
    base = start.withColumn("score", F.col("score") * (1 - damping))
    now, made, seen = base, [steps, start], 0.0
    if not steps.isEmpty():
        fans = steps.select("kind", "src", "part").distinct()
        for i in range(rounds):
            at = now.withColumnRenamed("host", "src").join(fans, ["kind", "src"])
            moved = steps.join(at, ["kind", "src", "part"]).select("kind", F.col("dst").alias("host"), (F.col("p") * F.col("score")).alias("score"))
            now = moved.unionByName(base).groupBy("kind", "host").agg(F.sum("score").alias("score"))
            if (i + 1) % cut_every == 0:
                now = materialize(now, f"host-walk{i}")
                made.append(now)
                # each round adds at most ``damping`` times what the one before did
                total = now.agg(F.sum("score")).first()[0] or 0.0
                last, seen = (total - seen) / cut_every, total
                if i >= cut_every and last * damping / (1 - damping) ** 2 <= tolerance:
                    break
        else:
            raise RuntimeError("scores did not settle")
    seeded = start.groupBy("kind").agg(F.sum("score").alias("whole"))
    scale = now.groupBy("kind").agg(F.sum("score").alias("got")).join(seeded, "kind").select("kind", (F.col("whole") / F.col("got")).alias("scale"))
    pick = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score") * F.col("scale"))), F.lit(0.0)).alias(k)
    found = materialize(now.join(scale, "kind").groupBy("host").agg(pick("trust"), pick("distrust")), "host-scores")
    for df in made:
        delete(df.sparkSession, df._stored_at)
    return found


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, threshold: float = 1e-6, damping: float = 0.85) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page.

    A url without a rule is blocked if its host's distrust exceeds its trust by more than
    ``threshold``, up to which the scores are exact. A host's seeds are the shares of its pages that
    rules allow and block.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = urls.withColumn("_m", match(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg(F.when(F.col("_m.verdict") == v, 1.0).otherwise(0.0))
    seeds = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = propagate(materialize(host_edges(pages), "host-edges"), seeds, damping, threshold)
    named = ruled.alias("u").join(scores.alias("s"), F.col("u.host") == F.col("s.host"), "left")
    bad = F.coalesce(F.col("s.distrust") - F.col("s.trust"), F.lit(0.0)) > F.lit(threshold)
    own = F.when(bad, F.lit("block")).otherwise(F.lit("allow"))
    return named.select(
        "u.page_id", "u.host", "u.path", F.col("u._m.rule").alias("rule"), F.coalesce(F.col("u._m.verdict"), own).alias("verdict"),
        F.coalesce("s.trust", F.lit(0.0)).alias("trust"), F.coalesce("s.distrust", F.lit(0.0)).alias("distrust"),
    )
