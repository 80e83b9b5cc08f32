"""URL verdicts from rules and from trust that spreads over the host graph.

A rule names a host (with all its subdomains) and a path prefix; the longest fitting rule
decides.  For the other pages the link graph decides: personalised PageRank starts at hosts with
allowed pages and follows the links (trust), a second one starts at hosts with blocked pages and
follows them backwards (distrust: who links to a bad host).  A host is blocked where its distrust
exceeds its trust, or where distrust alone reaches it.  The steps have no fixed number: they go on
until the mass still to come cannot change a verdict.  Built-in functions only.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and
takes the verdict of the empty host; null or empty html has no links; a host without any mass, and one whose
trust and distrust differ by no more than rounding, is allowed; repeated page rows are judged alike; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlease.llm.shared import checkpointed, stage_table

#: Share of a host's mass below which a difference is rounding.
EVEN = 1e-9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The production rules of the query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def url_rest(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; nulls where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host))):  # the last one wins
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): pages of host ``src`` that link to host ``dst``, relative links included."""
    href = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))

    def target(link: Column, own: Column) -> Column:
        absolute = F.when(link.startswith("//"), F.concat(F.lit("http:"), link)).otherwise(link)
        return F.when(absolute.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), url_host(absolute)).otherwise(own)

    linked = pages.select(url_host(F.col("url")).alias("src"), href.alias("links"))
    targets = linked.select("src", F.explode(F.array_distinct(F.transform("links", lambda x: target(x, F.col("src"))))).alias("dst"))
    return targets.where("src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float, cut_every: int = 5) -> DataFrame:
    """Personalised PageRank of both kinds at once, run until no later step can change a verdict.

    ``seeds``: (kind, host, seed), each kind summing to 1.  ``trust`` follows links, ``distrust``
    follows them backwards; rank a host passes on is shared by link weight, and what has nowhere
    to go is lost.  After ``n`` steps the ranks are those of all walks of up to ``n`` links, so both kinds
    together can still grow by ``2 * damping ** (n + 1)``; ``links`` is a host's distance from the
    seeds.  The steps end when the last one has reached no new host and the mass still to come is
    below the difference of every host that both kinds reach, or below ``EVEN`` of its mass (then
    the kinds count as even).  Every ``cut_every`` steps are one stage table.
    Returns (host, trust, distrust), null for a kind that does not reach the host.
    """
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("out_weight"))
    edges = checkpointed(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("out_weight")).alias("share")))
    start = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"), F.lit(0).alias("links"))
    ranks, steps = start, 0
    while True:
        for _ in range(cut_every):
            steps += 1
            passed = (
                edges.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"])
                .groupBy("kind", "dst")
                .agg((F.sum(F.col("rank") * F.col("share")) * damping).alias("rank"), (F.min("links") + 1).alias("links"))
                .withColumnRenamed("dst", "host")
            )
            ranks = passed.unionByName(start).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.min("links").alias("links"))
        ranks = stage_table(ranks, "url-ranks")
        by_host = ranks.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("rank"))).alias(k) for k in ("trust", "distrust")], F.max("links").alias("links"))
        to_come = 2 * damping ** (steps + 1)
        gap, mass = F.abs(F.col("distrust") - F.col("trust")), F.col("distrust") + F.col("trust")
        still_open = (gap <= to_come) & (F.lit(to_come) > mass * EVEN)
        furthest, undecided = by_host.agg(F.max("links"), F.count_if(still_open)).collect()[0]
        if furthest is None or furthest < steps and not undecided:
            return by_host.select("host", "trust", "distrust")


def judge_pages(pages: DataFrame, rules: Sequence[Rule] = RULES, damping: float = 0.5) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = checkpointed(pages.select("page_id", host.alias("host"), path.alias("path")).select("*", name.alias("rule"), verdict.alias("ruled")))
    counts = (
        judged.where("ruled is not null")
        .groupBy(F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"), "host")
        .agg(F.count(F.lit(1)).alias("pages"))
    )
    totals = counts.groupBy("kind").agg(F.sum("pages").alias("total"))
    seeds = checkpointed(counts.join(totals, "kind").select("kind", "host", (F.col("pages") / F.col("total")).alias("seed")))
    margin = propagate(host_links(pages), seeds, damping)
    # a host that distrust alone reaches is blocked, however far it is from the seed
    more = F.coalesce(F.col("distrust") - F.col("trust") > EVEN * (F.col("distrust") + F.col("trust")), F.col("distrust").isNotNull())
    blocked = margin.select("host", more.alias("blocked"))
    return judged.join(blocked, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict")
    )
