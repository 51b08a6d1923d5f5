"""URL filter: rules by host and path, and trust and distrust carried over the link graph.

Trust starts at the hosts that a rule allows and follows links; distrust starts at the hosts
that a rule blocks and follows links backwards (who links to a blocked host shares its blame).
Both are personalised PageRank over host edges, as joins and sums. A host is judged by the two
scores against thresholds; where a rule fits, the rule decides.

Only column functions and joins are used. Cases: a NULL url, or one without "://", has host and
path ''; a NULL html has no links; repeated links between two hosts count once, links within a
host not at all; equal rows give equal rows; with no edges or no seeds all scores stay with the
seeds; an empty table gives no rows; further columns are not carried.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.words import ascii_lower
from framewise.session import cut_lineage, discard

HREF = "(?i)<a\\s[^>]*?href\\s*=\\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\\s>]+)"


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` (allow or block) for a host, its subdomains and a start of the path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# fixed values: the rules of the production list
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both '' without "://"."""
    known = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = "^(?s:.*?)://([^/?#]*)([^?#]*)"
    host = F.when(known, ascii_lower(F.regexp_extract(url, rest, 1))).otherwise(F.lit(""))
    path = F.when(known, F.regexp_extract(url, rest, 2)).otherwise(F.lit(""))
    return host, path


def fitting_rule(host: Column, path: Column, rules: Sequence[UrlRule] = RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, else NULL."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(
            fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        ).otherwise(out)
    return out


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """Distinct links (``src``, ``dst``) between different hosts."""
    links = pages.select(
        F.col(host).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(HREF), 1)).alias("_url")
    )
    target = F.when(F.startswith("_url", F.lit("//")), F.concat(F.lit("http:"), F.col("_url"))).otherwise(F.col("_url"))
    return (
        links.select("src", host_and_path(target)[0].alias("dst"))
        .filter((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != ""))
        .distinct()
    )


def spread(
    edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6
) -> DataFrame:
    """Personalised PageRank: (``host``, ``score``) from seed weights (``host``, ``weight``).

    Each round a host hands ``damping`` of its score to the hosts it links to, in equal parts,
    and the seeds get the rest; scores of hosts without links return to the seeds. Ends after
    ``rounds`` or when the scores change by less than ``tolerance`` in all. Rounds are written
    to the shared folder. A popular target is summed on the map side before the shuffle; the
    edges of a hub are split by AQE, as the join has nothing above it that needs them together.
    """
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n_out"))
    total = seeds.agg(F.sum("weight").alias("w")).first()["w"]
    if not total:
        return seeds.select("host", F.lit(0.0).alias("score")).limit(0)
    base = cut_lineage(seeds.groupBy("host").agg((F.sum("weight") / F.lit(total)).alias("base")))
    if edges.isEmpty():
        return base.select("host", F.col("base").alias("score"))
    score = base.select("host", F.col("base").alias("score"))
    degree, rows = cut_lineage(degree), None
    for _ in range(rounds):
        handed = score.join(degree, F.col("host") == F.col("src")).select(
            "src", (F.col("score") * damping / F.col("n_out")).alias("part")
        )
        # written, as the total below and the new scores both read it
        got = cut_lineage(
            handed.join(edges, "src").groupBy(F.col("dst").alias("host")).agg(F.sum("part").alias("got"))
        )
        kept = got.agg(F.coalesce(F.sum("got"), F.lit(0.0)).alias("s")).first()["s"]
        new = base.join(got, "host", "full").select(
            "host",
            (F.coalesce("got", F.lit(0.0)) + F.coalesce("base", F.lit(0.0)) * (1.0 - kept)).alias("new"),
        )
        both = cut_lineage(
            new.join(score, "host", "full").select(
                "host", F.coalesce("new", F.lit(0.0)).alias("new"), F.coalesce("score", F.lit(0.0)).alias("old")
            )
        )
        moved = both.agg(F.coalesce(F.sum(F.abs(F.col("new") - F.col("old"))), F.lit(0.0)).alias("d")).first()["d"]
        score = both.select("host", F.col("new").alias("score"))
        discard(got)
        if rows is not None:
            discard(rows)
        rows = both
        if moved < tolerance:
            break
    discard(degree)
    return score


def judge(
    pages: DataFrame, rules: Sequence[UrlRule] = RULES, key: str = "page_id", url: str = "url",
    html: str = "html", min_distrust: float = 0.0, damping: float = 0.85, rounds: int = 20,
) -> DataFrame:
    """Per page: key, host, path, rule, verdict, and the scores of its host.

    Seeds weigh as many pages as rules allow or block on a host. Both scores are divided by the
    average of their seeds, so that thresholds do not depend on the number of hosts. A page no
    rule fits is blocked if its host's distrust is above both ``min_distrust`` and its trust.
    """
    host, path = host_and_path(F.col("_url"))
    base = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html"))
    base = base.select("_key", host.alias("host"), path.alias("path"), "_html")
    edges = cut_lineage(host_edges(base, "host", "_html"))
    ruled = base.select(
        "_key", "host", "path", fitting_rule(F.col("host"), F.col("path"), rules).alias("_rule")
    )
    votes = cut_lineage(
        ruled.groupBy("host").agg(
            F.count_if(F.col("_rule.verdict") == "allow").alias("allowed"),
            F.count_if(F.col("_rule.verdict") == "block").alias("blocked"),
        )
    )
    scores = votes.select("host")
    for name, seed, links in (
        ("trust", "allowed", edges),
        ("distrust", "blocked", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))),
    ):
        seeds = votes.filter(F.col(seed) > 0).select("host", F.col(seed).alias("weight"))
        n = seeds.count()
        found = spread(links, seeds, damping, rounds).select("host", (F.col("score") * n).alias(name))
        scores = scores.join(found, "host", "left")
    scores = scores.fillna(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") > min_distrust) & (F.col("distrust") > F.col("trust"))
    return ruled.join(scores, "host", "left").select(
        F.col("_key").alias(key), "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "trust", "distrust",
    )
