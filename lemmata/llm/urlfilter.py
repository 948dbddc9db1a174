"""URL filters by rules and by trust that flows over host links.

1. A rule (host, path prefix, allow or block) fits its host and all subdomains, if the
   url's path starts with the rule's; of those that fit the longest wins (host, then path).
2. Hosts form a graph.  Its edges are the pages' absolute links to other hosts, one for each
   link.  Apart from them, a host and its parent domain are tied both ways with weight
   ``tie`` (0: no ties), up to the domain that its owner registered and never to a public
   suffix above it; this carries what is known of a site's other hosts.
3. Pages that rules allow seed trust at their hosts, pages that rules block seed distrust.
   Trust flows along the edges (personalised PageRank from the trusted seeds); distrust
   flows against them (who links to bad hosts is suspect), from the blocked seeds.  Both go
   on until all later rounds together can change less than ``tolerance`` of their total.  What
   arrives at a host without edges in the flow's direction goes back to the seeds: that scales
   all scores alike, so it is done once, by dividing each flow by its total at the end.
4. A host is blocked where its distrust is more than ``ratio`` times its trust, both
   so normalised to a total of one, by more than MARGIN of itself: the scores of small hosts are
   compared like those of large ones.  Pages without a rule get their host's verdict; a host
   that neither reaches is allowed.

DataFrame functions only.  Every page is counted; hosts are aggregated with map-side
combining, and pages find their host's verdict by a join that Spark may split where one
host holds many pages.

Null url or url without ``://``: host and path are empty, no rule fits, and the verdict is
that of the empty host, ``allow`` (it has no seeds and no links).  Null html has no links; a
very long one is searched whole.  Repeated rows are judged alike, and each counts.  Equal
scores (ties) allow.  An empty table gives an empty result.  A caller's columns come back
unchanged, whatever their names: a result whose name is taken is named with an underscore
after it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, read, row_of, stage, unfolded, unstage

#: Of an absolute link: what follows :// up to the host's end.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
#: Public suffixes of two labels; all others are taken to have one.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "ac.jp", "co.kr", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.za", "github.io")
#: By how much of itself a score must be greater; above what the tolerance leaves open.
MARGIN = 1e-3


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The winning rule's name and verdict, or nulls.  Longest: by the host, then the path."""
    order = sorted(rules, key=lambda r: (len(r.host), len(r.path)), reverse=True)
    name, verdict = None, None
    for r in order:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    if name is None:
        name = verdict = F.lit(None).cast("string")
    return name, verdict


def judged(pages: DataFrame, keep: list[str], url: str = "url", rules=RULES) -> DataFrame:
    """_row (a struct of ``keep``), host, path, rule and the rule's verdict as ``said``."""
    parts = pages.select(row_of(keep), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    name, verdict = matched(F.col("host"), F.col("path"), rules)
    return parts.select("*", name.alias("rule"), verdict.alias("said"))


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, w): how many links a host's pages have to another host."""
    seen = pages.select(host_of(F.col(url)).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1))).alias("raw"))
    named = seen.select("src", F.translate(F.regexp_replace("raw", r"^[^@]*@", ""), UPPER, LOWER).alias("dst")).where("src <> dst and src <> '' and dst <> ''")
    return named.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def ties(hosts: DataFrame, weight: float = 1.0) -> DataFrame:
    """hosts(host) -> (src, dst, w): each host and its parent domain, both ways, up to the
    registered domain.  Numeric addresses have no parent."""
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffix = F.when(F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".").isin(*SUFFIXES), 2).otherwise(1)
    # a.b.c.org has the chain a.b.c.org, b.c.org, c.org
    steps = n - suffix - 1
    at = lambda i: F.array_join(F.slice(labels, i, n), ".")
    pairs = F.transform(F.sequence(F.lit(1), steps), lambda i: F.struct(at(i).alias("a"), at(i + 1).alias("b")))
    up = hosts.where((steps > 0) & ~F.col("host").rlike(r"^[0-9.:\[\]]*$")).select(F.explode(pairs).alias("s")).select("s.a", "s.b").where("a <> '' and b <> ''").distinct()
    both = up.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"))
    return both.select("e.src", "e.dst", F.lit(float(weight)).alias("w"))


def host_links(pages: DataFrame, tie: float = 1.0, **names) -> DataFrame:
    """edges (src, dst, w): links between different hosts and, if ``tie`` isn't 0, the ties."""
    found = links(pages, **names)
    if not tie:
        return found
    own = pages.select(host_of(F.col(names.get("url", "url"))).alias("host"))
    hosts = own.union(found.select("src")).union(found.select("dst")).distinct()
    return found.unionByName(ties(hosts, tie)).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, at_once: int = 4) -> DataFrame:
    """edges(src, dst, w), seeds(host, trust, distrust) -> (host, trust, distrust), each with the
    total 1, or 0 if it has no seeds.

    Both flows run in one pass a round: each edge carries trust forward and distrust
    backward, as shares of the sender's weight in that direction.  ``at_once`` rounds are one
    job, whose result is written to the shared folder.  A round shrinks what is left to
    change by ``damping`` at least, so the rounds end by themselves."""
    total = seeds.agg(F.sum("trust"), F.sum("distrust")).first()
    t, d = float(total[0] or 0) or 1.0, float(total[1] or 0) or 1.0
    start = stage(seeds.where("trust > 0 or distrust > 0").select("host", (F.col("trust") / t).alias("trust"), (F.col("distrust") / d).alias("distrust")), "seeds")
    ahead = edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), F.col("w").alias("fw"), F.lit(0.0).alias("bw"))
    back = edges.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("fw"), F.col("w").alias("bw"))
    arcs = ahead.unionByName(back)
    out = arcs.groupBy("host").agg(F.sum("fw").alias("of"), F.sum("bw").alias("ob"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    arcs = stage(arcs.join(out, "host").groupBy("host", "to").agg(F.sum(share("fw", "of")).alias("fw"), F.sum(share("bw", "ob")).alias("bw")), "arcs")
    fresh = start.select("host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust"))

    def step(now: DataFrame) -> DataFrame:
        moved = now.join(arcs, "host").select(F.col("to").alias("host"), (damping * F.col("trust") * F.col("fw")).alias("trust"), (damping * F.col("distrust") * F.col("bw")).alias("distrust"))
        return moved.unionByName(fresh).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))

    now = start
    while True:
        new = now
        for _ in range(at_once):
            new = step(new)
        new = stage(new, "ranks")
        both = new.select("host", F.col("trust").alias("t1"), F.col("distrust").alias("d1")).join(now.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0")), "host", "full")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        change = lambda a: F.sum(F.abs(zero(f"{a}1") - zero(f"{a}0")))
        t_moved, t_all, d_moved, d_all = (x or 0.0 for x in both.agg(change("t"), F.sum("t1"), change("d"), F.sum("d1")).first())
        if now is not start:
            unstage(now)
        now = new
        # what these rounds changed bounds what all later ones can still change
        rest = damping**at_once / (1 - damping**at_once)
        if all(x * rest <= tolerance * total for x, total in ((t_moved, t_all), (d_moved, d_all))):
            unstage(arcs)
            return now.select("host", (F.col("trust") / (t_all or 1.0)).alias("trust"), (F.col("distrust") / (d_all or 1.0)).alias("distrust"))


MADE = ["host", "path", "rule", "verdict", "trust", "distrust"]


def verdicts(pages: DataFrame, keep: list[str], ratio: float = 1.0, rules=RULES, tie: float = 1.0, tolerance: float = 1e-4, **names) -> DataFrame:
    """``keep``, host, path, rule, verdict, trust and distrust (of the host)."""
    known = judged(pages, keep, names.get("url", "url"), rules)
    seeds = known.groupBy("host").agg(F.count_if(F.col("said") == "allow").cast("double").alias("trust"), F.count_if(F.col("said") == "block").cast("double").alias("distrust"))
    edges, own = stage(host_links(pages, tie, **names), "host-links"), stage(seeds, "host-seeds")
    ranks = propagate(edges, own, tolerance=tolerance)
    unstage(edges, own)
    scored = known.join(ranks, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    flow = F.when((F.col("host") != "") & (distrust > ratio * (1 + MARGIN) * trust), "block").otherwise("allow")
    out = scored.select(ROW, "host", "path", "rule", F.coalesce("said", flow).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
    return unfolded(out, keep, MADE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return verdicts(pages, ["page_id"])
