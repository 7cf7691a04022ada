"""What a crawl records and follows: record assembly, the queue's filter, and statistics of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelume.config import Config
from sitelume.functions import ids, urls

from . import filters, robots

#: Entries of a list that a plan holds as values.
SHORT = 16


def followed(links: DataFrame, config: Config, rules: DataFrame | None = None, url: str = "url") -> DataFrame:
    """Links that a crawl queues: http(s), of an allowed domain, not of an excluded domain or path, allowed by robots.

    An invalid URL is not followed. `rules` are the rows of `robots.rules_table`.
    A list of more than `SHORT` entries is a table that hosts or paths are
    looked up in, so the plan does not grow with it.
    """
    told = links.withColumn("_p", urls.parts(F.col(url)))
    host, targets = F.col("_p.host"), config.targets
    told = told.where(F.col("_p.scheme").isin("http", "https")).withColumns({"_host": host, "_path": F.col("_p.path")})
    domains, banned, paths = config.allowed_domains(), targets["excludedDomains"], targets["excludedPaths"]
    table = lambda values, name: links.sparkSession.createDataFrame([(v,) for v in values], f"{name} string")
    if len(domains) > SHORT:
        told = told.join(filters.allowed_hosts(told.select(F.col("_host").alias("host")), table(domains, "domain")), F.col("_host") == F.col("host"), "left_semi")
    else:
        told = told.where(F.coalesce(urls.allows(F.col("_host"), domains), F.lit(False)))
    if len(banned) > SHORT:
        told = told.join(filters.excluded_hosts(told.select(F.col("_host").alias("host")), table(banned, "domain")), F.col("_host") == F.col("host"), "left_anti")
    else:
        told = told.where(F.coalesce(~urls.excludes(F.col("_host"), banned), F.lit(False)))
    if len(paths) > SHORT:
        told = told.join(filters.paths_under(told.select(F.col("_path").alias("path")), table(paths, "prefix")), F.col("_path") == F.col("path"), "left_anti")
    else:
        told = told.where(F.coalesce(~urls.under(F.col("_path"), paths), F.lit(False)))
    told = told.drop("_host", "_path")
    host = F.col("_p.host")
    if rules is None:
        return told.drop("_p")
    told = told.withColumn("domain", host).withColumn("_url", F.col(url))
    judged = robots.allowed(told.withColumn("url", F.col("_p.href")), rules).where("is_allowed")
    return judged.withColumn(url, F.col("_url")).drop("_p", "_url", "domain", "is_allowed")


def seeds_allowed(seeds: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds (url) that robots rules allow, and how many they do not: skipped."""
    told = robots.allowed(seeds.select("url", urls.host(F.col("url")).alias("domain")), rules)
    return told.where("is_allowed").select("url"), told.agg(F.count_if(~F.col("is_allowed")).alias("skipped"))


def with_credentials(requests: DataFrame, config: Config, url: str = "url") -> DataFrame:
    """`requests` with sends_credentials: only requests to the crawled domains carry them; an invalid URL none."""
    host = urls.parts(F.col(url))["host"]
    bare = F.regexp_replace(host, r"^www\.", "")
    own = F.lit(False)
    for d in config.allowed_domains():
        own = own | (host == d) | (bare == d.removeprefix("www.")) | host.endswith("." + d) | F.lit(d).endswith(F.concat(F.lit("."), host))
    return requests.withColumn("sends_credentials", F.coalesce((host != "") & own, F.lit(False)))


def assemble(parsed: DataFrame, responses: DataFrame, config: Config) -> DataFrame:
    """Page records of parsed pages (`html.page_records`) and their responses (url, timestamp, status, status_text, headers, final_url).

    Sections follow the configuration's modules; one that is off is not in the
    record. A response's ID needs a timestamp, a content ID text besides.
    """
    on, out = config.extraction["modules"], {}
    stamped = config.output["formatting"]["includeTimestamp"] and on["basicData"]
    told = parsed.join(responses, "url", "left")
    stamp = F.col("timestamp")
    if on["basicData"]:
        out |= {"title": F.col("title"), "url": F.col("url"), "fullText": F.col("full_text")}
    if stamped:
        out["timestamp"] = stamp
    header = lambda name: F.col("headers")[name]
    if on["responseData"]:
        got = F.col("status").isNotNull()
        response = F.struct(F.col("status"), F.col("status_text").alias("statusText"), "headers", F.col("final_url").alias("url"))
        out["response"] = F.when(got, response)
        out["etag"] = F.when(header("etag") != "", header("etag"))
        if stamped:
            key = ids.response_id(F.col("final_url"), F.col("status"), stamp, header("content-type"), header("last-modified"), header("etag"))
            out["response_id"] = F.when(got & stamp.isNotNull(), key)
    if stamped:
        out["content_id"] = F.when(stamp.isNotNull() & (F.col("full_text") != ""), ids.content_id(F.col("full_text"), stamp))
    seo = [F.col("meta").alias("metaTags")] if on["seoTags"] else []
    if on["specialLinks"]:
        special = F.struct("canonical", "alternate", F.col("single_rels").alias("single"), F.col("multi_rels").alias("multi"))
        seo += [special.alias("specialLinks"), F.col("no_snippet").alias("hasDataNoSnippet")]
    if seo:
        out["seo"] = F.struct(*seo)
    ai = []
    if on["structuredData"]:
        ai.append(F.struct(F.col("json_ld").alias("jsonLd"), "microdata").alias("structuredData"))
    if on["aiMetadata"]:
        metrics = [F.col("words").alias("wordCount"), F.col("reading_time").alias("readingTime"), F.col("headings").alias("headingStructure")]
        ai.append(F.struct(F.col("custom"), "tags", "rating", "boost", *(metrics if on["contentMetrics"] else [])).alias("customMetadata"))
    if on["pageMap"]:
        ai.append(F.struct(F.col("page_map").alias("attributes")).alias("pageMap"))
    if ai:
        out["aiMetadata"] = F.struct(*ai)
    if on["links"]:
        of_kind = lambda kind: F.filter("links", lambda x: link_kind(x, config) == kind).alias(kind)
        sides = [of_kind("internal"), of_kind("external")] if config.extraction["links"]["categorizeByDomain"] else []
        out["links"] = F.when(F.size("links") > 0, F.struct(*sides, F.size("links").alias("total")))
    if on["htmlContent"]:
        out["htmlContent"] = F.struct(F.col("full_html").alias("full"), F.col("main_html").alias("main"), F.col("main_selector").alias("mainSelector"))
    if on["images"]:
        out["images"] = F.when(F.size("images") > 0, F.col("images"))
    return told.select(*[column.alias(name) for name, column in out.items()])


def link_kind(link: Column, config: Config) -> Column:
    """internal or external for a parsed link (its href is in normal form or no URL at all)."""
    href, targets = link["href"], config.targets
    host, path = urls.host(href), urls.path(href)
    outside = urls.excludes(host, targets["excludedDomains"]) | urls.under(path, targets["excludedPaths"])
    inside = urls.allows(host, config.allowed_domains()) & ~outside
    return F.when(~href.rlike("^[a-z][a-z0-9+.-]*:") | inside, "internal").otherwise("external")


def visits(log: DataFrame) -> DataFrame:
    """Each URL of a crawl log (url, ts, seq, status): its last status and how often it was crawled."""
    return log.groupBy("url").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.count("*").alias("crawl_count"))


def status_distribution(visits_: DataFrame) -> DataFrame:
    return visits_.where("coalesce(status, 0) <> 0").groupBy("status").agg(F.count("*").alias("urls"))


def run_statistics(visits_: DataFrame, records: DataFrame) -> DataFrame:
    """Totals of a run, one row: URLs crawled, those crawled again, and what its records (parsed pages) hold."""
    seen = visits_.agg(F.count("*").alias("unique_urls"), F.count_if(F.col("crawl_count") > 1).alias("duplicate_urls"))
    sums = records.agg(
        F.count("*").alias("pages"),
        F.coalesce(F.sum(F.size("meta")), F.lit(0)).alias("meta_tags"),
        F.coalesce(F.sum(F.size("json_ld") + F.size("microdata")), F.lit(0)).alias("structured_data"),
        F.coalesce(F.sum("internal_links"), F.lit(0)).alias("internal_links"),
        F.coalesce(F.sum("external_links"), F.lit(0)).alias("external_links"),
    )
    return seen.join(sums)  # one row each
