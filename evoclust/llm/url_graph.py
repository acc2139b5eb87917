"""URL filter by link-graph propagation.

Rules ``(host, path, verdict)`` fit a host with all its subdomains and every
path that starts with theirs; the longest rule wins.  Urls without a rule are
judged by their host: personalised PageRank flows from hosts with allowed
urls along links (trust), and from hosts with blocked urls against them
(distrust: who links to a bad host is doubtful).  A host is blocked if its
distrust is above ``ratio`` times its trust.

Host edges are the absolute links of the pages (``href="http://host/..."``
or ``href="//host/..."``), counted per pair of hosts, and, with
``structural`` weight, an edge each way between a host and the domain above
it, which is all the evidence there is where pages link only within their
host.  A host's seed mass is its share of allowed (blocked) urls among its
ruled urls.

Everything is keyed by host: links are counted before they are shuffled, so
a host with a third of all pages is one row, and the ranks live in tables
written to the shared folder every few steps.  Verdicts go back to the urls
by one join on the host; only hosts that are blocked are in it.

Null url, or one without ``://``: host and path empty, no rule, no edges;
the empty host is allowed.  Null html has no links.  Repeated rows are judged
alike.  Other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoclust.llm.common import ascii_lower
from evoclust.session import cut

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow"))
_LINK = "(?i)href\\s*=\\s*[\"']?\\s*(?:https?:)?//([^/?#\"'\\s>]+)"


def host_path(url: str = "url") -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as text, and its verdict (else null)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, hosts: DataFrame, structural: float = 1.0) -> DataFrame:
    """``src, dst, w``: links between different hosts, with the domain edges
    of the hosts in ``hosts``."""
    host, _ = host_path()
    links = (pages.select(host.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("d"))
             .select("src", ascii_lower(F.col("d")).alias("dst"))
             .filter((F.col("src") != "") & (F.col("src") != F.col("dst")))
             .groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w")))
    # a.b.c -> (a.b.c, b.c), (b.c, c)
    parts = F.split("host", "[.]")
    up = (hosts.filter(F.col("host") != "").select(parts.alias("p"))
          .select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k")).filter(F.col("k") < F.size("p"))
          .select(F.array_join(F.slice("p", F.col("k"), F.size("p")), ".").alias("src"),
                  F.array_join(F.slice("p", F.col("k") + 1, F.size("p")), ".").alias("dst")).distinct())
    both = up.union(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return (links.union(both.withColumn("w", F.lit(float(structural))))
            .groupBy("src", "dst").agg(F.sum("w").alias("w")))


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, every: int = 6) -> DataFrame:
    """``kind, host, rank``: personalised PageRank from ``seeds(kind, host,
    mass)`` over ``edges(kind, src, dst, w)``, a graph of its own for each
    ``kind``, all in one series ``(1 - d) sum_k (d P')^k s`` up to where less
    than ``tolerance`` of a kind's seed mass is still to come; mass that
    reaches a host without links ends there."""
    total = {r.kind: r.m for r in seeds.groupBy("kind").agg(F.sum("mass").alias("m")).collect() if r.m}  # a row a kind
    if not total:
        return seeds.select("kind", "host", F.lit(0.0).alias("rank")).limit(0)
    share = F.create_map(*[F.lit(x) for k, m in total.items() for x in (k, (1 - damping) / m)])
    start = seeds.select("kind", "host", (F.col("mass") * share[F.col("kind")]).alias("x")).filter("x is not null")
    out = edges.groupBy("kind", "src").agg(F.sum("w").alias("t"))
    step = cut(edges.join(out, ["kind", "src"]).select(F.col("kind").alias("of"), "src", "dst", (F.col("w") / F.col("t")).alias("p")), "rank-edges")
    rank, sums = start.withColumnRenamed("x", "rank"), dict.fromkeys(total, 1 - damping)
    while True:
        for _ in range(every):
            moved = (rank.join(step, (rank.kind == step.of) & (rank.host == step.src))
                     .select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("p") * F.lit(damping)).alias("x")))
            # one sum a host: what came along edges, and its part of the seeds
            rank = moved.union(start).groupBy("kind", "host").agg(F.sum("x").alias("rank"))
        rank = cut(rank, "rank")
        now = {r.kind: r.s for r in rank.groupBy("kind").agg(F.sum("rank").alias("s")).collect()}
        # each term is at most ``damping`` times the one before it
        far = damping ** every
        if all((now[k] - sums[k]) * far / (1 - far) < tolerance for k in total):
            return rank
        sums = now


def host_verdicts(pages: DataFrame, rules=RULES, ratio: float = 1.0, structural: float = 1.0, **params) -> DataFrame:
    """``host, trust, distrust, blocked`` for every host of the graph that
    either rank reaches."""
    host, path = host_path()
    _, verdict = rule_of(F.col("host"), F.col("path"), rules)
    hosts = cut(pages.select(host.alias("host"), path.alias("path"))
                .select("host", verdict.alias("v")).groupBy("host")
                .agg(F.count(F.when(F.col("v") == "allow", 1)).alias("good"),
                     F.count(F.when(F.col("v") == "block", 1)).alias("bad")), "hosts")
    share = lambda c: (F.col(c) / (F.col("good") + F.col("bad"))).alias("mass")
    edges = cut(host_edges(pages, hosts, structural), "host-edges")
    # trust along the links, distrust against them
    both = edges.withColumn("kind", F.lit(0)).unionByName(
        edges.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    seeds = (hosts.filter("good > 0").select(F.lit(0).alias("kind"), "host", share("good"))
             .unionByName(hosts.filter("bad > 0").select(F.lit(1).alias("kind"), "host", share("bad"))))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0))
    return (pagerank(both, seeds, **params).groupBy("host").agg(of(0).alias("trust"), of(1).alias("distrust"))
            .withColumn("blocked", F.col("distrust") > F.lit(ratio) * F.col("trust")))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", **params) -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every url."""
    host, path = host_path()
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    blocked = cut(host_verdicts(pages, rules, **params).filter("blocked").select("host"), "blocked-hosts")
    rows = (pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
            .select(id_col, "host", "path", name.alias("rule"), verdict.alias("__v")))
    return (rows.join(blocked.withColumn("__b", F.lit("block")), "host", "left")
            .select(id_col, "host", "path", "rule", F.coalesce("__v", "__b", F.lit("allow")).alias("verdict")))
