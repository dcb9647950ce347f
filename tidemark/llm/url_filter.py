"""URL filters by link-graph propagation.

Pages that a rule fits are judged by it. For the others, trust spreads by personalised PageRank from the hosts of
allowed pages along links, and distrust from the hosts of blocked pages against them: who links to bad hosts is bad.
A host where distrust weighs more, against all of it, than trust does is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ascii_lower, materialize, scratch, table

#: Verdicts and rules; a rule is a host and a path.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-4, 0.5
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]*)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url; both empty if it is null or has no ://."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3))
    part = lambda pattern: F.coalesce(F.regexp_extract(rest, pattern, 1), F.lit(""))
    return ascii_lower(part("^([^/?#]*)")), part("^[^/?#]*([^?#]*)")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, else null."""
    out = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        out.append(F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*out)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between hosts and, once each way, edges between a host and the domain above it.

    pages: host, html. Links to a page's own host, as all relative ones are, say nothing about others and don't count.
    Domains of one label are no hosts. Counts combine before the shuffle, so that it carries host pairs, not links.
    """
    target = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)))
    links = pages.select(F.col("host").alias("src"), target.alias("link")).select("src", ascii_lower(F.col("link")).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    links = links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    hosts = pages.select("host").union(links.select("dst")).where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    levels = F.transform(F.sequence(F.lit(0), F.size(labels) - 2), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    chain = hosts.where(F.size(labels) > 2).select(F.posexplode(levels).alias("i", "up"), levels.alias("all"))
    steps = chain.where("i > 0").select(F.element_at("all", F.col("i")).alias("low"), "up").distinct()
    family = steps.select(F.col("low").alias("src"), F.col("up").alias("dst")).union(steps.select("up", "low")).withColumn("n", F.lit(1.0))
    return links.union(family).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust), each summing to what its seeds sum to. edges: src, dst, n; seeds: host, trust, distrust.

    Both scores travel in one join and one sum a step: an edge carries trust forward by its share of what leaves src,
    and distrust back by its share of what enters dst. What reaches a host without further edges goes back to the seeds
    in their proportions; as that only scales the result, it is done once, at the end. Every fifth step is written, so
    that lineage stays short, and the steps end when five of them change all scores by less than tolerance together,
    which is after log(tolerance / 2) / log(damping) at the latest. Sums combine before the shuffle.
    """
    out_of = edges.groupBy("src").agg(F.sum("n").alias("total"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("total"))
    ahead = edges.join(out_of, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("n") / F.col("total")).alias("share"))
    back = edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("at"), F.col("src").alias("to"), (F.col("n") / F.col("total")).alias("share"))
    moves = materialize(ahead.union(back), "host-moves")
    source = materialize(seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "score")).where("score > 0"), "host-seeds")
    now, change = source, None
    while change is None or change > tolerance:
        before = now
        for _ in range(5):
            came = moves.join(now.select("kind", F.col("host").alias("at"), "score"), ["kind", "at"]).select(F.col("to").alias("host"), "kind", (F.lit(damping) * F.col("score") * F.col("share")).alias("score"))
            now = came.union(source.select("host", "kind", (1 - damping) * F.col("score"))).groupBy("host", "kind").agg(F.sum("score").alias("score"))
        now = materialize(now, "host-scores")
        both = now.select("host", "kind", "score").union(before.select("host", "kind", -F.col("score"))).groupBy("host", "kind").agg(F.sum("score").alias("d"))
        change = both.agg(F.coalesce(F.sum(F.abs("d")), F.lit(0.0))).first()[0]
    given, got = ({r.kind: r.t for r in x.groupBy("kind").agg(F.sum("score").alias("t")).collect()} for x in (source, now))
    kind = lambda k: (F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)) * F.lit(given.get(k, 0.0) / got.get(k, 1.0))).alias(k)
    return now.groupBy("host").agg(kind("trust"), kind("distrust"))


def host_scores(edges: DataFrame, votes: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, distrust) of every host that a score reaches. votes: host, trust, distrust (numbers of its ruled pages).

    Trust and distrust each sum to 1, and a host's distrust is its part of both: 0.5 where blocked pages weigh there as
    much as among all votes, more where they weigh more. With votes of one kind alone it is 0 or 1.
    """
    total = votes.agg(F.sum("trust"), F.sum("distrust")).first()
    share = lambda c, n: (F.col(c) / F.lit(float(max(n or 0, 1)))).alias(c)
    scores = propagate(edges, votes.select("host", share("trust", total[0]), share("distrust", total[1])), tolerance)
    return scores.select("host", F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), 9).alias("distrust"))


def _known(pages: DataFrame, rules) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pages with host, path, rule and ruled; edges; votes."""
    host, path = host_and_path(F.col("url"))
    known = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("ruled"))
    edges = materialize(host_edges(pages.select(host.alias("host"), "html")), "host-edges")
    votes = known.where("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("trust"), F.count_if(F.col("ruled") == "block").alias("distrust"))
    return known, edges, materialize(votes.where("trust > 0 OR distrust > 0"), "host-votes")


def judge_pages(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict, distrust (see host_scores; null without any score) of every row of pages.

    A page without a rule is blocked if its host's distrust is above threshold: as blocked pages are compared with their
    part of all votes, a host that trust and distrust reach alike is allowed, however many votes are for blocking.
    Null urls and those without :// have no host; no rule fits them and they are allowed, as are hosts that no score
    reaches. Null html has no links. Rows that repeat a page_id are judged each and count each as a page of their host:
    every ruled page is one vote. Further columns of pages are not looked at.
    """
    known, edges, votes = _known(pages, rules)
    scores = materialize(host_scores(edges, votes, tolerance), "host-verdicts")
    return known.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("distrust") > threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "distrust",
    )


def held_out(pages: DataFrame, rules=RULES, folds: int = 5, fold: int = 0, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """ruled, verdict (null where no score reaches), pages: how the method judges the ruled pages of hosts left out of
    the seeds, those whose crc32(host) mod folds is fold. All links and domains stay. Empty without such hosts."""
    known, edges, votes = _known(pages, rules)
    out = F.crc32(F.col("host").cast("binary")) % folds == fold
    scores = host_scores(edges, votes.where(~out), tolerance)
    judged = known.where(out & F.col("ruled").isNotNull()).join(scores, "host", "left")
    verdict = F.when(F.col("distrust") > threshold, F.lit("block")).when(F.col("distrust").isNotNull(), F.lit("allow"))
    return judged.groupBy("ruled", verdict.alias("verdict")).agg(F.count("*").alias("pages"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    with scratch(spark) as kept:
        return kept(judge_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")), "url-verdicts")
