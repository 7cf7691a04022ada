"""robots.txt rules and which URLs they allow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelume.functions import urls

from . import filters


def parse(content: str, agent: str = "SEO-Crawler") -> dict[str, list[str]]:
    """Rules of the groups that name `agent` by a prefix of it, or all agents."""
    rules: dict[str, list[str]] = {"disallow": [], "allow": [], "sitemaps": []}
    named: list[str] = []
    closed = True
    for raw in content.splitlines():
        key, colon, value = raw.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon or not key:
            continue
        if key == "sitemap":
            rules["sitemaps"] += [value] if value else []
        elif key == "user-agent":
            named = [value.lower()] if closed else [*named, value.lower()]
            closed = False
        else:
            closed = True
            ours = any(n == "*" or (n and agent.lower().startswith(n)) for n in named)
            if ours and value and key in ("allow", "disallow"):
                rules[key].append(value)
    return rules


def rules_table(robots: DataFrame, agent: str = "SEO-Crawler") -> DataFrame:
    """Rules of `robots` (domain, body) as rows: domain, kind (allow, disallow or sitemap), pattern."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (domain, kind.removesuffix("s"), pattern)
                for domain, body in zip(batch["domain"], batch["body"], strict=True)
                for kind, patterns in parse(body or "", agent).items()
                for pattern in patterns
            ]
            yield pd.DataFrame(rows, columns=["domain", "kind", "pattern"])

    return robots.select("domain", "body").mapInPandas(run, "domain string, kind string, pattern string")


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """`pages` (url, domain) with is_allowed: the longest rule that is a prefix of path and query wins, disallow on ties.

    Rules are found by equal keys (domain and prefix, `filters.prefix_matches`),
    once for each distinct path of a domain, so neither many rules of a domain
    nor many pages of one make a large row.
    """
    kind = F.col("kind")
    patterns = rules.where("kind <> 'sitemap'").groupBy("domain", "pattern").agg(
        F.max(F.when(kind == "allow", F.length("pattern"))).alias("allow"), F.max(F.when(kind == "disallow", F.length("pattern"))).alias("disallow")
    )
    told = pages.withColumn("_target", F.concat(urls.path(F.col("url")), urls.query(F.col("url"))))
    targets = told.select("domain", F.col("_target").alias("target")).distinct()
    found = filters.prefix_matches(targets, patterns).groupBy("domain", "target").agg(F.max("allow").alias("_allow"), F.max("disallow").alias("_disallow"))
    found = found.withColumnRenamed("target", "_target")
    free = F.col("_disallow").isNull() | (F.coalesce("_allow", F.lit(-1)) > F.col("_disallow"))
    return told.join(found, ["domain", "_target"], "left").select(*pages.columns, free.alias("is_allowed"))
