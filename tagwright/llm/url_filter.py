"""URL filter with trust and distrust spread over the host graph (operator 6).

Rules allow or block a host, its subdomains and a path prefix; the longest
rule that fits decides a page. Pages without a rule are judged by their host:
trust starts at hosts with allowed pages and follows their links
(personalised PageRank); distrust starts at hosts with blocked pages and
follows links backwards, to the hosts that link there. A host is blocked if
its distrust exceeds its trust by more than ``threshold`` times its share of
all pages. Everything is DataFrame expressions, joins and grouped sums.

Edges are the ``href`` links of the pages' HTML; relative links lead to the
page's own host, and links of other schemes (mail and scripts) are none.
Mass at hosts without links is not passed on.

Defined results: a null URL, or one without ``://``, has an empty host and
path; an empty host fits no rule, is no node of the graph, and is allowed; a
null page has no links; without seeds of a kind that mass is 0 everywhere;
repeated rows are repeated in the result and count as pages; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, materialize, others

#: (verdict, host, path prefix); hosts without scheme, paths begin with a slash.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
DAMPING = 0.85
ROUNDS = 20
THRESHOLD = 1.0
DIGITS = 9          # sums of doubles are compared after rounding, whatever their order
_WRITE_EVERY = 5    # rounds between two written rank tables

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)\shref\s*=\s*["']?([^"'\s>]*)"""
ABSOLUTE = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)"
SCHEME = r"(?i)^[a-z][a-z0-9+.-]*:"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and path of a URL, empty if it has none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The fitting rule of most characters as ``struct(verdict, rule)``, or null."""
    chosen = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):   # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        chosen = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(chosen)
    return chosen


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: how many links of pages (``host, html``) go from host to host."""
    href = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1))).alias("href")
    links = pages.where("host <> ''").select("host", href)
    target = F.translate(F.regexp_extract("href", ABSOLUTE, 1), _UPPER, _LOWER)
    dst = (F.when(F.col("href").rlike(ABSOLUTE), target)
           .when(F.col("href").rlike(SCHEME), F.lit(None)).otherwise(F.col("host")))
    return (links.select(F.col("host").alias("src"), dst.alias("dst")).where("dst <> ''")
            .groupBy("src", "dst").agg(F.count("*").alias("n")))


def spread(seeds: DataFrame, links: DataFrame, *, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Ranks ``host, trust, distrust`` from seed shares of the same names over
    ``links`` (``src, dst, n``): trust along links, distrust against them."""
    out = links.groupBy("src").agg(F.sum("n").alias("total"))
    back = links.groupBy("dst").agg(F.sum("n").alias("total"))
    none = F.lit(0.0)
    moves = (links.join(out, "src").select(F.col("src").alias("here"), F.col("dst").alias("there"),
                                           (F.col("n") / F.col("total")).alias("along"), none.alias("against"))
             .unionByName(links.join(back, "dst").select(F.col("dst").alias("here"), F.col("src").alias("there"),
                                                         none.alias("along"), (F.col("n") / F.col("total")).alias("against")))
             .groupBy("here", "there").agg(F.sum("along").alias("along"), F.sum("against").alias("against")))
    moves = materialize(moves, "host-moves")
    start = seeds.select("host", *[(F.col(c) * (1 - damping)).alias(c) for c in ("trust", "distrust")])
    ranks = seeds
    for k in range(1, rounds + 1):
        moved = ranks.join(moves, F.col("host") == F.col("here")).select(
            F.col("there").alias("host"), (F.col("trust") * F.col("along") * damping).alias("trust"),
            (F.col("distrust") * F.col("against") * damping).alias("distrust"))
        ranks = start.unionByName(moved).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if k % _WRITE_EVERY == 0 or k == rounds:
            ranks = materialize(ranks, "host-ranks")
    return ranks


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, *, url_col: str = "url",
                html_col: str = "html", threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int = ROUNDS,
                keep: Sequence[str] | None = None) -> DataFrame:
    """The input columns (or ``keep``) and ``host, path, rule, verdict``."""
    host, path = host_and_path(col(url_col))
    kept = others(pages, ["host", "path", "rule", "verdict"], keep)
    chosen = free_name(kept, "chosen")
    judged = (pages.select(*[col(c) for c in kept], host.alias("host"), path.alias("path"))
              .withColumn(chosen, longest_rule(F.col("host"), F.col("path"), rules)))
    per_host = (pages.select(host.alias("host"), path.alias("path")).where("host <> ''")
                .withColumn("verdict", longest_rule(F.col("host"), F.col("path"), rules)["verdict"])
                .groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("verdict") == "allow").alias("allowed"),
                                     F.count_if(F.col("verdict") == "block").alias("blocked")))
    per_host = materialize(per_host, "hosts")
    total = per_host.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pages", "allowed", "blocked")]).first()
    seeds = per_host.select("host", (F.col("allowed") / max(1, total["allowed"])).alias("trust"),
                            (F.col("blocked") / max(1, total["blocked"])).alias("distrust"))
    links = materialize(host_links(pages.select(host.alias("host"), col(html_col).alias("html"))), "host-links")
    ranks = spread(seeds, links, damping=damping, rounds=rounds)
    excess = F.col("distrust") - F.col("trust") - F.col("pages") * (threshold / max(1, total["pages"]))
    bad = (per_host.join(ranks, "host").where(F.round(excess, DIGITS) > 0)
           .select(F.col("host").alias("_bad_host")))
    by_host = F.when(F.col("_bad_host").isNull(), "allow").otherwise("block")
    return (judged.join(bad, judged["host"] == bad["_bad_host"], "left")
            .select(*[judged[f"`{c}`"] for c in kept], "host", "path", judged[chosen]["rule"].alias("rule"),
                    F.coalesce(judged[chosen]["verdict"], by_host).alias("verdict")))
