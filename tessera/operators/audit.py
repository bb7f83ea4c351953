"""Accounting of a crawl: every URL is a board's, of no platform of ours, or rejected for a reason that has a name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import slugs

TOP = 15
#: Hosts of the platforms whose tokens have parts.
STRUCTURED = (r"^[a-z0-9-]+\.wd\d+\.myworkdayjobs\.com$", r"^wd\d+\.myworkdaysite\.com$", r"\.oraclecloud\.com$", r"(^|\.)comeet\.com$", r"^[a-z0-9-]+\.csod\.com$")
#: Files of a site that are no boards.
SITE_FILES = (("robots.txt", r"(?i)/robots\.txt$"), ("favicon", r"(?i)/favicon\.[a-z]+$"), ("sitemap", r"(?i)/sitemap[^/]*\.(xml|txt)(\.gz)?$"))


def ours(host: Column, patterns=slugs.PATTERNS) -> Column:
    """Whether a host belongs to a platform: one of its hosts, below one of its suffixes, or of its form."""
    names = {h for p in patterns if p.kind in ("path", "query") for h in p.hosts}
    ends = {h for p in patterns if p.kind == "label" for h in p.hosts}
    out = host.isin(sorted(names))
    out = reduce(lambda a, h: a | (host == h) | host.endswith("." + h), sorted(ends), out)
    return F.coalesce(reduce(lambda a, form: a | host.rlike(form), STRUCTURED, out), F.lit(False))


def classified(urls: DataFrame, url: str = "url", patterns=slugs.PATTERNS) -> DataFrame:
    """(url, bucket, platform, token, region, segment) of every URL. bucket: matched, foreign, the name of a rejection, or UNEXPLAINED."""
    host = F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    rows = urls.select(F.col(url).alias("url"), slugs.board_of(F.col(url), patterns).alias("hit"), host.alias("host"), path.alias("path"))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    first = F.get(segments, F.lit(0))
    labels = sorted({h for p in patterns if p.kind == "label" for h in p.hosts})
    label = reduce(lambda a, h: F.when(F.col("host").endswith("." + h), F.regexp_replace("host", rf"\.{h}$".replace(".", r"\.").replace(r"\\.", r"\."), "")).otherwise(a), labels, F.lit(None).cast("string"))
    by_path = F.col("host").isin(sorted({h for p in patterns if p.kind == "path" for h in p.hosts}))
    decoded = F.try_url_decode(first)
    bucket = F.when(F.col("hit").isNotNull(), "matched").when(F.col("host") == "", "unparseable").when(~ours(F.col("host"), patterns), "foreign")
    for name, form in SITE_FILES:
        bucket = bucket.when(F.col("path").rlike(form), name)
    bucket = (
        bucket.when(by_path & first.isNull(), "root").when(by_path & F.lower(first).isin(*slugs.NO_SEGMENTS, *slugs.WEB_FILES), "denied segment").when(by_path & first.rlike(r"(?i)^v\d+$"), "version")
        .when(by_path & first.contains("%") & decoded.isNull(), "bad encoding").when(by_path & ~F.lower(F.coalesce(decoded, first)).rlike(slugs.RULE), "bad token")
        .when(F.col("host").isin(*labels), "apex").when(label.contains("."), "nested label").when(label.isin(*slugs.NO_LABELS, *slugs.WORKABLE_LABELS), "denied label").otherwise("UNEXPLAINED")
    )
    return rows.select("url", bucket.alias("bucket"), "hit.platform", "hit.token", "hit.region", F.coalesce(first, F.lit("(root)")).alias("segment"))


def accounting(found: DataFrame) -> DataFrame:
    """(bucket, n): how many URLs went where; the counts add up to all of them."""
    return found.groupBy("bucket").agg(F.count("*").alias("n"))


def unique_boards(found: DataFrame) -> DataFrame:
    return found.where("bucket = 'matched'").groupBy("platform").agg(F.count_distinct(F.struct("token", "region")).alias("boards"))


def offending_segments(found: DataFrame, most: int = TOP) -> DataFrame:
    """The first segments of the unexplained URLs, the commonest first: gaps of the patterns show there."""
    return found.where("bucket = 'UNEXPLAINED'").groupBy("segment").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "segment").limit(most)
