"""URL allow and block rules by a sort-merge range join, in DataFrame operations only.

A host is written with its labels reversed and each ended by a dot
(``net.example.www.``), so that a rule for a host and all its subdomains is
an interval of keys, and the intervals of all rules nest. One sweep over keys
in order meets events (an interval opens or closes) and URLs. Each event
carries the stack of rules that are active after it, so a URL's active rules
are those of the last event before it. Among them the longest whose path
starts the URL's path decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that one group of lanes may hold; beyond it rules are dealt over more groups.
RULES_A_GROUP = 10_000
#: host, path, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """``www.example.net`` as ``net.example.www.``; the empty host as the empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def top_group(key: Column, groups: int) -> Column:
    """Group of a key by its first two labels."""
    return F.pmod(F.xxhash64(F.substring_index(key, ".", 2)), F.lit(groups)).cast("int")


def rule_events(rules: DataFrame) -> DataFrame:
    """key, stack: two rows for each host that has rules. rules: host, path, verdict."""
    rules = rules.dropDuplicates(["host", "path"])
    own = rules.select(host_key(F.col("host")).alias("key"), F.struct(F.length(F.concat("host", "path")).alias("n"), F.concat("host", "path").alias("rule"), "path", "verdict").alias("r")).groupBy("key").agg(F.collect_list("r").alias("own"))
    labels = F.size(F.split("key", r"\.")) - 1
    above = own.select("key", F.explode(F.sequence(F.lit(1), labels)).alias("k")).select("key", F.expr("concat(substring_index(key, '.', k), '.')").alias("up"))
    chain = above.join(own.select(F.col("key").alias("up"), "own"), "up").groupBy("key").agg(F.flatten(F.collect_list("own")).alias("stack"), F.flatten(F.collect_list(F.when(F.col("up") != F.col("key"), F.col("own")))).alias("rest"))
    opens = chain.select("key", "stack")
    closes = chain.select(F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")).alias("key"), F.col("rest").alias("stack"))
    return opens.unionByName(closes)


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow", lanes: int | None = None) -> DataFrame:
    """``df`` with host, path, rule (host + path, or null) and verdict.

    rules: host, path, verdict, no nulls; a rule fits its host and all
    subdomains where the URL's path starts with the rule's; the longest rule
    text wins, of equal ones the smallest. Without a rule the verdict is
    ``otherwise``. A null URL, or one without ``://``, has an empty host and
    path and fits no rule. Repeated rows stay; columns named like an added one
    are replaced.

    URLs are dealt over ``lanes`` by a hash of the whole row, so a host that a
    third of all rows share is swept in many tasks; each lane gets the events.
    Above RULES_A_GROUP rules, lanes come in groups by the first two host
    labels, and an event goes only to its own group's lanes; only rules with a
    one-label host go to all groups.
    """
    spark = df.sparkSession
    added = ("host", "path", "rule", "verdict")
    lanes = lanes or max(64, 4 * partitions(spark))
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").where(F.col("host") != "")
    groups = 1 + rules.count() // RULES_A_GROUP
    clean = df.drop(*added)
    names = clean.columns
    rows = clean.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("key", host_key(F.col("host")))
    lane = F.pmod(F.xxhash64("row"), F.lit(lanes)).cast("int")
    rows = rows.select("row", "host", "path", "key", top_group(F.col("key"), groups).alias("group"), lane.alias("lane"), F.lit(1).alias("kind"))
    events = rule_events(rules)
    one_label = F.regexp_count("key", F.lit(r"[./]")) == 1
    all_groups = F.sequence(F.lit(0), F.lit(groups - 1))
    event_key = F.regexp_replace("key", "/$", ".")
    events = (
        events.withColumn("group", F.explode(F.when(one_label, all_groups).otherwise(F.array(top_group(event_key, groups)))))
        .withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        .withColumn("kind", F.lit(0))
    )
    swept = rows.unionByName(events, allowMissingColumns=True)
    order = Window.partitionBy("group", "lane").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = swept.withColumn("active", F.last("stack", ignorenulls=True).over(order)).where(F.col("kind") == 1)
    fitting = F.filter("active", lambda r: F.col("path").startswith(r["path"]))
    best = F.reduce(fitting, F.lit(None).cast("struct<n:int,rule:string,path:string,verdict:string>"), lambda a, r: F.when(a.isNull() | (r["n"] > a["n"]) | ((r["n"] == a["n"]) & (r["rule"] < a["rule"])), r).otherwise(a))
    return swept.select("row", "host", "path", best.alias("best")).select("row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(otherwise)).alias("verdict"))
