"""URL expressions.

`parts` parses any URL as browsers do: those already in normal form by SQL
functions, the rest in Arrow batches. The short expressions above it read
absolute http(s) URLs in normal form only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import weburl

_PARTS = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^?#]*)(\?[^#]*)?(#.*)?$"
#: What parsing would not change: lower-case host of letters, no port, no dot segments, nothing to encode.
_NORMAL = r"^https?://[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z][a-z0-9-]*/(?![^?#]*(?:/|%2[eE])\.{0,2}(?:%2[eE]|/|$|[?#]))(?!\.{1,2}(?:[/?#]|$))[A-Za-z0-9._~/-]*(?:\?[A-Za-z0-9._~/=&+-]+)?(?:#[A-Za-z0-9._~/=&+-]+)?$"
PARTS_TYPE = T.StructType([T.StructField(name, T.StringType()) for name in weburl.Parts._fields])


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 2))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    found = F.regexp_extract(url, _PARTS, 4)
    return F.when(found == "", "/").otherwise(found)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 5)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 6)


def is_absolute(url: Column) -> Column:
    return url.rlike(_PARTS) & (F.regexp_extract(url, _PARTS, 2) != "")


def is_homepage(url: Column) -> Column:
    plain = scheme(url).isin("http", "https") & (query(url) == "") & fragment(url).isin("", "#")
    return plain & F.regexp_replace(path(url), r"^(/\.{1,2})*/?\.{0,2}$", "/").isin("/", "")


def logical_key(url: Column) -> Column:
    """The URL without port and fragment."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"^([a-zA-Z]+://[^/?#:]+):\d+", "$1")


def short(url: Column) -> Column:
    left = F.regexp_replace(url, r"^https?://[^/]+", "")
    return F.when(left == "", "/").otherwise(left)


def storage_domain(url: Column) -> Column:
    """Host without `www.`, as crawls are stored by; `default` where there is none."""
    return F.when(is_absolute(url), bare_host(url)).otherwise("default")


def first_segment(url: Column) -> Column:
    return F.split(path(url), "/")[1]


def x_forwarded_last(header: Column) -> Column:
    """The last hop that is not blank, which the nearest proxy saw itself."""
    hops = F.filter(F.transform(F.split(header, ","), lambda hop: F.trim(hop)), lambda hop: hop != "")
    return F.when(F.size(hops) > 0, F.element_at(hops, -1))


# --- any URL -------------------------------------------------------------------


@F.pandas_udf(PARTS_TYPE)
def _parse(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    names, none = list(weburl.Parts._fields), (None,) * len(weburl.Parts._fields)
    for raw, base in pairs:
        yield pd.DataFrame([weburl.parse(r, b) or none for r, b in zip(raw, base, strict=True)], columns=names)


def parts(url: Column, base: Column | None = None) -> Column:
    """href (normal form), scheme, host, port (not the default one), path, query and fragment; fields are null if invalid.

    A relative URL is resolved against `base`, and is invalid without one.
    """
    normal = F.coalesce(url.rlike(_NORMAL), F.lit(False))
    told = F.regexp_extract
    read = F.struct(
        url.alias("href"),
        told(url, _PARTS, 1).alias("scheme"),
        told(url, _PARTS, 2).alias("host"),
        F.lit("").alias("port"),
        told(url, _PARTS, 4).alias("path"),
        told(url, _PARTS, 5).alias("query"),
        told(url, _PARTS, 6).alias("fragment"),
    )
    # rows in normal form go to Python as nulls
    rest = _parse(F.when(~normal, url), F.when(~normal, base) if base is not None else F.lit(None).cast("string"))
    return F.when(normal, read).otherwise(rest)


def normalize(url: Column, base: Column | None = None) -> Column:
    """The http(s) URL in normal form without its fragment; null if invalid or of another scheme."""
    found = parts(url, base)
    return F.when(found["scheme"].isin("http", "https"), F.regexp_replace(found["href"], "#.*$", ""))


def resolve(url: Column | str, base: Column | str) -> Column:
    """The URL in normal form, of any scheme, with its fragment; null if invalid."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return parts(col(url), col(base))["href"]


def _bare(name: Column | str) -> Column:
    return F.regexp_replace(F.lit(name) if isinstance(name, str) else name, r"^www\.", "")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def allows(link_host: Column, domains: list[str]) -> Column:
    """Whether a host is one of `domains` but for `www.`, or one a subdomain of the other."""
    own = _bare(link_host)
    return _any(
        [(own == _bare(d)) | (link_host == d) | own.endswith(F.concat(F.lit("."), _bare(d))) | _bare(d).endswith(F.concat(F.lit("."), own)) for d in domains]
    )


def excludes(link_host: Column, domains: list[str]) -> Column:
    """As `allows`, with `www.` kept where one is a subdomain of the other."""
    own = _bare(link_host)
    return _any(
        [(own == _bare(d)) | (link_host == d) | link_host.endswith("." + d) | F.lit(d).endswith(F.concat(F.lit("."), link_host)) for d in domains]
    )


def under(link_path: Column, prefixes: list[str]) -> Column:
    return _any([link_path.startswith(p) for p in prefixes])


def categorize(href: Column, allowed: list[str], excluded: list[str] = (), excluded_paths: list[str] = ()) -> Column:
    """internal or external; what is no valid absolute URL is internal, as a relative link is."""
    found = parts(href)
    outside = excludes(found["host"], list(excluded)) | under(found["path"], list(excluded_paths))
    inside = allows(found["host"], list(allowed)) & ~outside
    return F.when(found["href"].isNull() | inside, "internal").otherwise("external")


# --- what must not be requested --------------------------------------------------

# Blocks of IPv4 addresses that are not public.
PRIVATE_IPV4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "100.64.0.0/10", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16",
    "198.18.0.0/15", "224.0.0.0/3",
)
# Verdicts on a URL.
INVALID, SCHEME, PRIVATE, UNRESOLVED = (
    "Invalid URL format", "Only http(s) URLs are allowed", "Target resolves to a private address", "Cannot resolve hostname: ",
)


def private_ipv4(ip: Column) -> Column:
    """Whether an address is in one of the blocks; null if it is no IPv4 address."""
    numbers = [F.split(ip, r"\.")[k].try_cast("long") for k in range(4)]
    value = reduce(lambda a, b: a * 256 + b, numbers)
    tests = []
    for block in PRIVATE_IPV4:
        first, _, bits = block.partition("/")
        low = reduce(lambda a, b: a * 256 + int(b), first.split("."), 0)
        tests.append(value.between(low, low + (1 << 32 - int(bits)) - 1))
    is_ip = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & _all([n <= 255 for n in numbers])
    return F.when(is_ip, _any(tests))


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def private_ip(ip: Column) -> Column:
    """`private_ipv4`, and for IPv6: loopback, unspecified, mapped private, unique local and link-local."""
    low = F.lower(ip)
    mapped = F.regexp_extract(low, r"^::ffff:(.*)$", 1)
    six = (
        F.when(low.isin("::", "::1"), True)
        .when(mapped != "", F.coalesce(private_ipv4(mapped), F.lit(True)))
        .otherwise(low.rlike("^f[cd]") | low.rlike("^fe[89ab]"))
    )
    return F.coalesce(private_ipv4(ip), six)


def request_verdicts(targets: DataFrame, dns: DataFrame, url: str = "url", denied: list[str] = ()) -> DataFrame:
    """`targets` with verdict: why a URL must not be requested, or null.

    Names are judged by all their addresses in `dns` (host, address): one
    private address refuses the name, and so does having none.
    """
    private = F.coalesce(private_ip(F.col("address")), F.lit(True))
    hosts = dns.where("host IS NOT NULL AND address IS NOT NULL").groupBy(F.lower("host").alias("dns_host")).agg(F.bool_or(private).alias("dns_private"))
    told = targets.withColumn("_parts", parts(F.col(url)))
    name = F.regexp_replace("_parts.host", r"^\[|\]$", "")
    told = told.withColumn("_host", name).join(hosts, name == F.col("dns_host"), "left")
    is_ip = name.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | name.contains(":")
    verdict = (
        F.when(F.col("_parts.href").isNull(), INVALID)
        .when(~F.col("_parts.scheme").isin("http", "https"), SCHEME)
        .when(F.col("_host").isin(list(denied)) if denied else F.lit(False), "Host is denied")
        .when(is_ip, F.when(private_ip(name), PRIVATE))
        .when(F.col("dns_private").isNull(), F.concat(F.lit(UNRESOLVED), "_host"))
        .when(F.col("dns_private"), PRIVATE)
    )
    return told.withColumn("verdict", verdict).drop("_parts", "_host", "dns_host", "dns_private")
