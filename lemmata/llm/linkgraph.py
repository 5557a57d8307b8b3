"""URL filters: rules for hosts and paths, and link-graph propagation for the urls that no rule fits.

Trust starts at hosts whose urls the rules allow and follows links; distrust starts at hosts whose urls they block and goes
against links, to those who link there. Both are personalised PageRank over the distinct edges between hosts, by rounds of
a join and a sum. Masses are whole numbers, so sums do not depend on their order and reruns agree. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmata.llm.common import forget, keep

#: Mass of a host whose urls are all allowed, or all blocked; rounds of propagation; share of its mass that a host passes on.
UNIT, ROUNDS, PASSED = 10**9, 20, (17, 20)
#: A host is blocked from this share of UNIT on, if its distrust is above its trust.
THRESHOLD = (1, 2)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The target of a link: an absolute one, or one that only leaves out the scheme. Others stay on their host.
LINK = r"""(?i)\bhref[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?[\x20\x09-\x0D]*((?:[a-z][a-z0-9+.-]*:)?//[^"'<>\x20\x09-\x0D]+)"""


@dataclass(frozen=True)
class Rule:
    """Fits urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"


RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null; of equally long ones that with the longer host."""
    told = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host), r.host)):  # the last that is set is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        told = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(told)
    return told


def links(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """src, dst, verdict, n: links between hosts, counted by what the rules say of the url that they lead to."""
    url = F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    x = pages.select(host_of(F.col("url")).alias("src"), url.alias("link")).withColumn("link", F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link")))
    x = x.select("src", host_of(F.col("link")).alias("dst"), path_of(F.col("link")).alias("path"))
    x = x.select("src", "dst", best_rule(F.col("dst"), F.col("path"), rules)["verdict"].alias("verdict"))
    return x.filter("dst <> ''").groupBy("src", "dst", "verdict").agg(F.count(F.lit(1)).alias("n"))


def propagated(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, passed: tuple[int, int] = PASSED) -> DataFrame:
    """kind, host, mass: the sum of all masses that reach a host, its seed included.

    ``seeds``: kind, host, mass (whole numbers); ``edges``: kind, src, dst, each once. In each round a host's new mass goes,
    in equal parts, to all hosts that its edges lead to, less what is not passed on; parts are rounded down. Every round is
    written down, so none is made twice and a lost executor costs one round. A hub's edges are one key of a join, which is
    split where it is skewed; sums are made before the shuffle.
    """
    degree = edges.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("degree"))
    ways = keep(edges.join(degree, ["kind", "src"]), "host-edges")
    top, whole = passed
    now = keep(seeds.filter("mass > 0"), "host-mass")
    seen = [now]
    if not ways.isEmpty():
        for _ in range(rounds):
            part = F.expr(f"mass div ({whole} * degree) * {top}")
            step = now.withColumnRenamed("host", "src").join(ways, ["kind", "src"]).select("kind", F.col("dst").alias("host"), part.alias("mass")).filter("mass > 0")
            now = keep(step.groupBy("kind", "host").agg(F.sum("mass").alias("mass")), "host-mass")
            seen.append(now)
            if now.isEmpty():
                break
    out = keep(reduce(DataFrame.unionByName, seen).groupBy("kind", "host").agg(F.sum("mass").alias("mass")), "host-scores")
    for x in (ways, *seen):
        forget(x)
    return out


def host_scores(pages: DataFrame, rules: Sequence[Rule] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust of every host that has some, in parts of UNIT.

    A host's own trust is the share of its urls, of pages and of links to it, that the rules allow; its distrust that of
    those that they block. Links within a host are no edges, nor are those from pages without a host.
    """
    seen = keep(links(pages, rules), "links")
    host = host_of(F.col("url"))
    own = pages.select(host.alias("host"), best_rule(host, path_of(F.col("url")), rules)["verdict"].alias("verdict")).filter("host <> ''").groupBy("host", "verdict").agg(F.count(F.lit(1)).alias("n"))
    told = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v)
    urls = own.unionByName(seen.select(F.col("dst").alias("host"), "verdict", "n")).groupBy("host").agg(F.sum("n").alias("n"), told("allow"), told("block"))
    share = lambda v, kind: F.struct(F.lit(kind).alias("kind"), F.expr(f"cast({v} as decimal(20,0)) * {UNIT} div n").alias("mass"))
    seeds = urls.select("host", F.explode(F.array(share("allow", "trust"), share("block", "distrust"))).alias("s")).select("s.kind", "host", "s.mass")
    ends = seen.filter("src <> '' and src <> dst").select("src", "dst").distinct()
    way = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("src"), F.col(b).alias("dst"))
    edges = ends.select(F.explode(F.array(way("trust", "src", "dst"), way("distrust", "dst", "src"))).alias("e")).select("e.*")
    mass = propagated(seeds, edges, rounds)
    forget(seen)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0)).alias(kind)
    return mass.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, *, rounds: int = ROUNDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url, html).

    Where no rule fits, the host is judged: block if its distrust is above its trust and at least ``threshold`` of that of a
    host of which all urls are blocked; else allow. Null urls and those without ``://`` have an empty host and path, fit no
    rule and are allowed; a null html has no links. Repeated rows are judged each and count each. Extra columns are ignored,
    an empty table gives an empty one. A host with very many pages is one key of the last join, which is split where it is
    skewed; only its verdict comes from the other side.
    """
    top, whole = threshold
    bad = host_scores(pages, rules, rounds).filter((F.col("distrust") > F.col("trust")) & (F.col("distrust") * whole >= UNIT * top)).select(F.col("host").alias("bad_host"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    x = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("told", best_rule(F.col("host"), F.col("path"), rules))
    x = x.join(bad, F.col("host") == F.col("bad_host"), "left")
    by_host = F.when(F.col("bad_host").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return x.select("page_id", "host", "path", F.col("told.rule").alias("rule"), F.coalesce("told.verdict", by_host).alias("verdict"))
