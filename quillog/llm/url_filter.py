"""URL filter: host and path rules, then trust propagated over the host link graph.

Pages that a rule fits take the rule's verdict and seed the propagation. Trust and neutral mass run
forward along links by personalised PageRank; distrust runs backward, from blocked pages to the
hosts that link to them. A host is blocked where distrust makes up more than ``threshold`` of the
mass that it has gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillog.session import durable, written

from .line_dedup import ascii_lower

#: What may look like a link but is none: comments, and the raw text of scripts and the like.
NO_LINKS = r"(?is)<!--.*?(?:-->|\z)|<(script|style|noscript|template|textarea|xmp)\b.*?(?:</\1|\z)"
LINK_HOST = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        own = (host == self.host) | host.endswith("." + self.host)
        return own & path.startswith(self.path)


# The rules of the contract.
RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits as struct(rule, verdict), else null."""
    fits = [
        F.when(r.fits(host, path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in sorted(rules, key=lambda r: -len(r.text))
    ]
    return F.coalesce(*fits)


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(_src, _dst, _w): links between different hosts with their counts."""
    links = pages.where(F.col("_host") != "").select(
        F.col("_host").alias("_src"),
        F.explode(F.regexp_extract_all(F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), F.lit(NO_LINKS), F.lit(" ")), F.lit(LINK_HOST), F.lit(1))).alias("_dst"),
    )
    links = links.withColumn("_dst", ascii_lower(F.col("_dst"))).where(F.col("_src") != F.col("_dst"))
    return links.groupBy("_src", "_dst").agg(F.count("*").cast("double").alias("_w"))


def propagate(hosts: DataFrame, edges: DataFrame, *, damping: float, iterations: int, checkpoint_every: int, tolerance: float = 0.0) -> DataFrame:
    """(_host, _trust, _neutral, _distrust) after ``iterations`` steps of power iteration, or fewer where
    ``checkpoint_every`` steps have moved less than ``tolerance`` of the seed mass.

    ``hosts`` has _host and the seed masses _allow, _none, _block. Mass at hosts without links is
    dropped instead of being dealt out anew, which keeps each step to two joins on host.
    """
    out = edges.groupBy("_src").agg(F.sum("_w").alias("_out"))
    back = edges.groupBy("_dst").agg(F.sum("_w").alias("_in"))
    shares = durable(
        edges.join(out, "_src").join(back, "_dst").select("_src", "_dst", (F.col("_w") / F.col("_out")).alias("_fwd"), (F.col("_w") / F.col("_in")).alias("_bwd"))
    )
    ends = shares.select(F.col("_src").alias("_host")).union(shares.select(F.col("_dst").alias("_host"))).distinct()
    seeds = durable(
        ends.join(hosts, "_host", "full_outer").select("_host", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("_allow", "_none", "_block")])
    )
    state = seeds.select("_host", F.col("_allow").alias("_trust"), F.col("_none").alias("_neutral"), F.col("_block").alias("_distrust"))
    masses = ("_trust", "_neutral", "_distrust")
    whole = seeds.agg(F.coalesce(F.sum(F.col("_allow") + F.col("_none") + F.col("_block")), F.lit(0.0))).first()[0]
    settled = state
    for step in range(1, iterations + 1):
        zero = F.lit(0.0)
        forward = shares.join(state, shares["_src"] == state["_host"]).select(
            F.col("_dst").alias("_to"), (F.col("_fwd") * F.col("_trust")).alias("_t"), (F.col("_fwd") * F.col("_neutral")).alias("_n"), zero.alias("_d")
        )
        backward = shares.join(state, shares["_dst"] == state["_host"]).select(
            F.col("_src").alias("_to"), zero.alias("_t"), zero.alias("_n"), (F.col("_bwd") * F.col("_distrust")).alias("_d")
        )
        got = forward.union(backward).groupBy("_to").agg(*[F.sum(c).alias(c) for c in ("_t", "_n", "_d")])
        gain = lambda seed, c: (1 - damping) * F.col(seed) + damping * F.coalesce(c, F.lit(0.0))
        state = seeds.join(got, seeds["_host"] == got["_to"], "left").select(
            "_host", gain("_allow", "_t").alias("_trust"), gain("_none", "_n").alias("_neutral"), gain("_block", "_d").alias("_distrust")
        )
        if step % checkpoint_every == 0:
            state = written(state)
            change = sum((F.abs(F.col(f"n.{c}") - F.col(f"o.{c}")) for c in masses), F.lit(0.0))
            moved = state.alias("n").join(settled.alias("o"), "_host").agg(F.coalesce(F.sum(change), F.lit(0.0))).first()[0]
            settled = state
            if moved <= tolerance * whole:
                break
    return state


def judge(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rules: list[Rule] = RULES,
    threshold: float = 0.5,
    damping: float = 0.85,
    iterations: int = 100,
    checkpoint_every: int = 5,
    tolerance: float = 1e-3,
    broadcast_hosts: int = 1_000_000,
) -> DataFrame:
    """Per row of ``pages``: id, host, path, rule, verdict, distrust.

    Null urls and urls without ``://`` have an empty host and path; hosts without mass are allowed.
    Null html has no links. Repeated rows count as often as they occur. Other columns are ignored;
    an empty table gives an empty result. ``distrust`` is the host's share of distrust in its mass.
    Mass is propagated until a few steps move less than ``tolerance`` of it, or ``iterations`` times.

    The hosts are counted and broadcast up to ``broadcast_hosts``, so the pages of one host aren't dealt
    to one task; beyond that Spark joins by shuffle and splits the partitions of hot hosts.
    """
    own = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html"), url_host(F.col(url_col)).alias("_host"), url_path(F.col(url_col)).alias("_path"))
    own = own.withColumn("_rule", matched_rule(F.col("_host"), F.col("_path"), rules))
    verdict = F.col("_rule.verdict")
    hosts = own.groupBy("_host").agg(
        F.count_if(verdict == "allow").cast("double").alias("_allow"),
        F.count_if(verdict.isNull()).cast("double").alias("_none"),
        F.count_if(verdict == "block").cast("double").alias("_block"),
    )
    edges = durable(host_edges(own, "_html"))
    if edges.isEmpty():
        state = hosts.select("_host", F.col("_allow").alias("_trust"), F.col("_none").alias("_neutral"), F.col("_block").alias("_distrust"))
    else:
        state = propagate(hosts, edges, damping=damping, iterations=iterations, checkpoint_every=checkpoint_every, tolerance=tolerance)
    mass = F.col("_trust") + F.col("_neutral") + F.col("_distrust")
    share = state.select("_host", F.when((mass > 0) & (F.col("_host") != ""), F.col("_distrust") / mass).otherwise(F.lit(0.0)).alias("_share"))
    share = durable(share.where("_share > 0"))
    judged = own.drop("_html").join(F.broadcast(share) if share.count() <= broadcast_hosts else share, "_host", "left")
    share = F.coalesce("_share", F.lit(0.0))
    return judged.select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule.rule").alias("rule"),
        F.coalesce(verdict, F.when(share > threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        share.alias("distrust"),
    )
