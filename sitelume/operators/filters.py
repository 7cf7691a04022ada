"""Lists of domains and path prefixes as tables: each host, path or URL meets its matches by equal keys, however long the lists are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bare(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def suffixes(name: Column) -> Column:
    """What stands after each dot of a name."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def _own_suffixes(name: Column) -> Column:
    """`suffixes`; none of a name without a dot."""
    return F.when(F.contains(name, F.lit(".")), suffixes(name)).otherwise(F.array().cast("array<string>"))


def _keys(kinds: list[tuple[str, Column]]) -> Column:
    """Arrays of names by kind, as one array of keys."""
    return F.concat(*[_marked(kind, names) for kind, names in kinds])


def _marked(kind: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit(kind + ":"), n))


def allowed_hosts(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """Those of `hosts` (host) that `urls.allows` allows by `domains` (domain): one of them but for `www.`, or one a subdomain of the other.

    A host and its label suffixes are keys of an equi-join with the domains and theirs.
    """
    d, h = F.col("domain"), F.col("host")
    index = _keys([("is", F.array(bare(d))), ("host", F.array(d)), ("over", _own_suffixes(bare(d)))])
    asked = _keys([("is", F.concat(F.array(bare(h)), _own_suffixes(bare(h)))), ("host", F.array(h)), ("over", F.array(bare(h)))])
    return _met(hosts, asked, domains, index, "host")


def excluded_hosts(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """Those of `hosts` (host) that `urls.excludes` excludes by `domains` (domain): as `allowed_hosts`, with `www.` kept where one is a subdomain of the other."""
    d, h = F.col("domain"), F.col("host")
    index = _keys([("bare", F.array(bare(d))), ("is", F.array(d)), ("over", _own_suffixes(d))])
    asked = _keys([("bare", F.array(bare(h))), ("is", F.concat(F.array(h), _own_suffixes(h))), ("over", F.array(h))])
    return _met(hosts, asked, domains, index, "host")


def paths_under(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Those of `paths` (path) that begin with one of `prefixes` (prefix)."""
    told = prefixes.where("prefix IS NOT NULL").select(F.lit("").alias("domain"), F.col("prefix").alias("pattern")).distinct()
    found = prefix_matches(paths.distinct().select(F.lit("").alias("domain"), F.col("path").alias("target")), told)
    return found.select(F.col("target").alias("path")).distinct()


def prefix_matches(targets: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pairs of `targets` (domain, target) and `patterns` (domain, pattern, each once) where the pattern begins the target.

    A target's prefixes of the lengths that its domain's patterns have meet the
    patterns by equal keys; a target is never beside all patterns of its domain.
    """
    lengths = patterns.groupBy("domain").agg(F.collect_set(F.length("pattern")).alias("lengths"))
    tries = targets.join(lengths, "domain")
    fits = F.filter("lengths", lambda n: n <= F.length("target"))
    tries = tries.select("domain", "target", F.explode(F.transform(fits, lambda n: F.substring(F.col("target"), F.lit(1), n))).alias("pattern"))
    return tries.join(patterns, ["domain", "pattern"])


def _met(rows: DataFrame, asked: Column, others: DataFrame, index: Column, name: str) -> DataFrame:
    keys = others.where("domain IS NOT NULL").select(F.explode(index).alias("key")).distinct()
    told = rows.select(name).distinct().where(F.col(name).isNotNull()).select(name, F.explode(F.array_distinct(asked)).alias("key"))
    return told.join(keys, "key", "left_semi").select(name).distinct()
