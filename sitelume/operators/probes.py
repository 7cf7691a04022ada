"""Checked link targets: what is to be probed, what came back, what is broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelume.functions import urls


def target_rows(*kinds: tuple[str, DataFrame]) -> DataFrame:
    """Every reference to a link target: url, kind, src_url, from frames of (src_url, url)."""
    every = None
    for kind, df in kinds:
        rows = df.select("url", F.lit(kind).alias("kind"), "src_url")
        every = rows if every is None else every.unionByName(rows)
    return every.where("url <> ''")


def targets(*kinds: tuple[str, DataFrame]) -> DataFrame:
    """Fan-in of link targets: url, kinds, referrers (how many pages name it), first_referrer. `target_rows` has them all."""
    return target_rows(*kinds).groupBy("url").agg(
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"),
        F.countDistinct("src_url").alias("referrers"),
        F.min("src_url").alias("first_referrer"),
    )


def resolve_attempts(attempts: DataFrame, probe: tuple[str, ...] = ()) -> DataFrame:
    """One result for each URL from attempts (url, method, status, error).

    A URL that is probed several times has a result for each probe, where the
    columns `probe` tell whose an attempt is. GET counts where HEAD failed or was refused (no status, 403, 405, 501),
    unless GET itself had a network error.
    """
    one = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    told = attempts.groupBy("url", *probe).agg(
        one("HEAD", "status").alias("head"), one("GET", "status").alias("get"),
        one("HEAD", "error").alias("head_error"), one("GET", "error").alias("get_error"),
    )
    use_get = (F.col("head").isNull() | F.col("head").isin(403, 405, 501)) & F.col("get").isNotNull()
    return told.select(
        "url",
        F.when(use_get, F.col("get")).otherwise(F.col("head")).alias("status"),
        F.when(use_get, F.lit("GET")).otherwise("HEAD").alias("method"),
        F.when(~use_get & F.col("head").isNull(), F.coalesce("get_error", "head_error")).alias("error"),
    )


def reverify(probes: DataFrame, again: DataFrame) -> DataFrame:
    """Results of `probes` with those of a second, calm round `again` where there was no status at first."""
    second = again.where("status IS NOT NULL").select("url", F.col("status").alias("status_2"), F.col("method").alias("method_2"))
    told = probes.join(second, "url", "left")
    better = F.col("status").isNull() & F.col("status_2").isNotNull()
    return told.select(
        "url",
        F.coalesce("status", "status_2").alias("status"),
        F.when(better, F.concat("method_2", F.lit("(reverify)"))).otherwise(F.col("method")).alias("method"),
        F.when(~better, F.col("error")).alias("error"),
        better.alias("is_reverified"),
    )


def broken(targets_: DataFrame, probes: DataFrame, site: str) -> DataFrame:
    """Targets without a status or with one of 400 or more, with the classes they count in, worst status first.

    Classes overlap: an image may also be an internal link. URLs of a status
    are in the order of a language, not of code points: a before B, e before é.
    """
    bad = probes.where("status IS NULL OR status >= 400").select("url", "status")
    names = F.split("kinds", ",")
    inside = same_site(F.col("url"), F.lit(f"https://{site}/"))
    image = F.array_contains(names, "image")
    told = targets_.join(bad, "url").select(
        "url",
        "status",
        "referrers",
        (F.array_contains(names, "internal-link") & inside).alias("is_internal_link"),
        image.alias("is_image"),
        (~inside & ~image).alias("is_external"),
    )
    return told.orderBy(F.desc(F.coalesce("status", F.lit(999))), F.collate("url", "UNICODE"), "url")


def broken_summary(broken_: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.col(c)).alias(c.replace("is_", "") + "s")
    return broken_.agg(F.count("*").alias("broken"), n("is_internal_link"), n("is_image"), n("is_external"))


def status_label(status: Column, error: Column) -> Column:
    return F.coalesce(status.cast("string"), F.concat(F.lit("ERR:"), F.split_part(F.coalesce(error, F.lit("unknown")), F.lit(":"), F.lit(1))))


def distribution(probes: DataFrame) -> DataFrame:
    return probes.groupBy(status_label(F.col("status"), F.col("error")).alias("label")).agg(F.count("*").alias("targets"))


def fold_in(reported: DataFrame, index: DataFrame, status: int, site: str, internal_only: bool = False) -> DataFrame:
    """Targets with a wanted status: those of `reported` (url, status), and pages that only the crawl itself hit with it.

    `index` (url, error) tells the code in its messages; its URLs are
    normalised and count once.
    """
    code = F.regexp_extract("error", r"received (\d+) status code", 1).try_cast("int")
    wanted = reported.where(F.col("status") == status).select("url", F.lit("probe").alias("method"))
    extra = index.where(code == status).select(urls.normalize(F.col("url"), F.lit(f"https://{site}")).alias("url"))
    extra = extra.where("url IS NOT NULL").distinct()
    if internal_only:
        extra = extra.where(same_site(F.col("url"), F.lit(f"https://{site}/")))
    extra = extra.join(wanted.select("url"), "url", "left_anti").withColumn("method", F.lit("crawl-record"))
    return wanted.unionByName(extra).select("url", F.lit(status).alias("status"), "method")


def same_site(target: Column, page: Column) -> Column:
    return urls.bare_host(target) == urls.bare_host(page)


def srcset_urls(srcset: Column) -> Column:
    """Candidates of a srcset attribute, their URLs."""
    return F.filter(F.transform(F.split(srcset, ","), lambda x: F.split(F.trim(x), r"\s+")[0]), lambda x: x != "")
