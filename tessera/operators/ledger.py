"""Writes that never overwrite, histories that only grow, and joins that fill or flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import detect, predicates
from tessera.functions.text import is_direct
from tessera.operators.relational import first_wins

RAISED, DROPPED, NOTE, LEAST_KEY = 15, -20, 500, 4


# ------------------------------------------------------------------- writes


def insert_absent(target: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    """``target`` and the rows of ``source`` whose key it lacks; a key that is there is never touched."""
    fresh = first_wins(source.select(*target.columns), on, [F.col(c) for c in target.columns if c not in on] or [F.lit(1)])
    return target.unionByName(fresh.join(target.select(*on).distinct(), on, "left_anti").select(*target.columns))


def upsert(target: DataFrame, source: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``target`` with the rows of ``source`` in place of those of the same key; of several the first in ``order``."""
    fresh = first_wins(source.select(*target.columns), [key], order)
    return target.join(fresh.select(key), key, "left_anti").select(*target.columns).unionByName(fresh)


def known_counts(target: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    """One row: how many of the distinct keys of ``source`` are created and how many are known."""
    keys = source.select(*on).distinct().join(target.select(*on).distinct().withColumn("there__", F.lit(True)), on, "left")
    return keys.agg(F.count_if(F.col("there__").isNull()).alias("created"), F.count_if(F.col("there__").isNotNull()).alias("known"))


def new_postings(incoming: DataFrame, stored: DataFrame, at: Column, key: str = "dedupe_key") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, contents, events) of the incoming rows that the pool lacks, each to be appended.

    A posting goes without its description, which is its content (8000
    characters at most); its event says that it is listed.
    """
    fresh = first_wins(incoming, [key], [F.col(key)]).join(stored.select(key).distinct(), key, "left_anti")
    contents = fresh.select(key, F.substring(F.coalesce("description", F.lit("")), 1, 8000).alias("description"))
    events = fresh.select(key, "source", F.lit("listed").alias("event"), at.alias("at"))
    return fresh.drop("description"), contents, events


def seed_boards(boards: DataFrame, curated: DataFrame) -> DataFrame:
    """Boards with the curated ones that they lack, as candidates. Both: platform, token, region, company_name, status, discovered_via."""
    rows = curated.select("platform", F.lower("token").alias("token"), F.coalesce("region", F.lit("")).alias("region"), F.col("name").alias("company_name"), F.lit("candidate").alias("status"), F.lit("seed").alias("discovered_via"))
    return insert_absent(boards.select(*rows.columns), rows, ["platform", "token", "region"])


def histories(jobs: DataFrame) -> dict[str, DataFrame]:
    """What the layered tables are first filled with, one frame a table; insert_absent() makes the filling safe to repeat."""
    applied = jobs.where("applied_at is not null").select("id", F.lit("applied").alias("type"), F.lit(None).cast("string").alias("payload"), F.col("applied_at").alias("at"))
    reason = F.when(F.col("dismiss_reason").isNotNull(), F.concat(F.lit('{"reason":"'), "dismiss_reason", F.lit('"}')))
    gone = jobs.where("status = 'ignored'").select("id", F.lit("dismissed").alias("type"), reason.alias("payload"), F.col("updated_at").alias("at"))
    listed = jobs.select("id", "source", F.lit("listed").alias("event"), F.col("first_seen_at").alias("at"))
    delisted = jobs.where("delisted_at is not null").select("id", "source", F.lit("delisted").alias("event"), F.col("delisted_at").alias("at"))
    judged = jobs.where("fit_score is not null").select("id", F.coalesce("fit_by", F.lit("8b-era")).alias("model"), F.lit("pre-v3").alias("prompt_version"), "fit_score", F.coalesce("fit_verdict", F.lit("weak")).alias("verdict"), F.col("updated_at").alias("at"))
    scored = jobs.select("id", F.lit("pre-migration").alias("scorer_version"), "score", "track", "disqualified", F.col("updated_at").alias("at"))
    return {"actions": applied.unionByName(gone), "listings": listed.unionByName(delisted), "judgments": judged, "scores": scored}


def snapshot(jobs: DataFrame) -> DataFrame:
    """One row, stats: JSON of total, by_status and by_verdict (qualified rows; no verdict counts as unscored), from one pass over the pool."""
    counts = jobs.groupBy("status", F.coalesce("fit_verdict", F.lit("unscored")).alias("verdict"), "disqualified").agg(F.count("*").alias("n"))
    kept = counts.where("not disqualified")

    def entries(column: str, out: str) -> DataFrame:
        sums = kept.groupBy(column).agg(F.sum("n").alias("n"))
        return sums.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(column).alias("key"), "n")))).alias(out))  # a handful of values

    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    joined = total.join(F.broadcast(entries("status", "by_status"))).join(F.broadcast(entries("verdict", "by_verdict")))
    return joined.select(F.to_json(F.struct("total", "by_status", "by_verdict")).alias("stats"))


# --------------------------------------------------------------------- joins


def sponsor_flag(jobs: DataFrame, register: DataFrame, flag: str = "sponsor_reg") -> DataFrame:
    """``jobs`` with a boolean: the register of the posting's country holds its company's collapsed name, of four letters at least. register: country, name."""
    names = register.select("country", detect.collapsed_name(F.col("name")).alias("name__")).where(F.length("name__") >= LEAST_KEY).distinct().withColumn("in__", F.lit(True))
    out = jobs.withColumn("name__", detect.collapsed_name(F.col("company"))).join(names, ["country", "name__"], "left")
    return out.select(*(F.col(c) for c in jobs.columns if c != flag), F.col("in__").isNotNull().alias(flag))


def with_content(jobs: DataFrame, contents: DataFrame, on: str = "id") -> DataFrame:
    """``jobs`` with their description, the title where there is none."""
    return jobs.join(contents.select(on, F.col("description").alias("text__")), on, "left").withColumn("description", F.coalesce("text__", "title")).drop("text__")


def with_similarity(jobs: DataFrame, vectors: DataFrame, similarity: Column, on: str = "id") -> DataFrame:
    """``jobs`` with sim, null for those without a vector. ``similarity`` reads the column ``vector``."""
    return jobs.join(vectors.select(on, similarity.alias("sim")), on, "left")


def without(jobs: DataFrame, other: DataFrame, on: str, condition: Column | None = None) -> DataFrame:
    """Rows that have no row in ``other``, or none that meets the condition: no vector, no history row of this version."""
    rows = other if condition is None else other.where(condition)
    return jobs.join(rows.select(on).distinct(), on, "left_anti")


def feed_diff(stored: DataFrame, feed: DataFrame, fetched: DataFrame, at: Column) -> DataFrame:
    """Live stored rows of the fetched sources with last_seen_at or delisted_at set to ``at``, by whether their feed still holds them; rows of other sources as they are.

    feed: source, external_id. fetched: source, those whose feed was read; an
    empty feed that was read closes all its rows.
    """
    held = feed.select("source", "external_id").distinct().withColumn("held__", F.lit(True))
    read = fetched.select("source").distinct().withColumn("read__", F.lit(True))
    rows = stored.join(held, ["source", "external_id"], "left").join(read, "source", "left")
    checked = F.col("read__").isNotNull() & F.col("delisted_at").isNull()
    seen = F.when(checked & F.col("held__").isNotNull(), at).otherwise(F.col("last_seen_at"))
    gone = F.when(checked & F.col("held__").isNull(), at).otherwise(F.col("delisted_at"))
    return rows.withColumns({"last_seen_at": seen, "delisted_at": gone}).select(*stored.columns)


def with_cache(jobs: DataFrame, cache: DataFrame, direct: Column, key: Column) -> DataFrame:
    """``jobs`` with country and cache_hit: what the gazetteer says (``direct``), else what was learned; a learned null is a hit, not a miss. cache: raw, country."""
    learned = cache.select("raw", F.col("country").alias("learned__"), F.lit(True).alias("hit__"))
    rows = jobs.withColumn("direct__", direct).withColumn("raw", key).join(learned, "raw", "left")
    return rows.withColumns({"country": F.coalesce("direct__", "learned__"), "cache_hit": F.col("hit__").isNotNull()}).drop("raw", "direct__", "learned__", "hit__")


def fill_null(rows: DataFrame, answers: DataFrame, on: list[str], column: str) -> DataFrame:
    """``rows`` with ``column`` taken from ``answers`` where it is null; one answer a key, the smallest."""
    one = answers.where(F.col(column).isNotNull()).groupBy(*on).agg(F.min(column).alias("answer__"))
    return rows.join(one, on, "left").withColumn(column, F.coalesce(column, "answer__")).select(*rows.columns)


def fetch_plan(sources: DataFrame, states: DataFrame, fetched: DataFrame, now: Column, days: dict[str, int] | None = None) -> DataFrame:
    """(source, n): rows fetched from each planned source; -1 for one on cooldown, 0 for one that gave nothing or failed.

    sources: source. states: source, last_fetched_at. fetched: a row each.
    """
    counts = fetched.groupBy("source").agg(F.count("*").alias("n__"))
    rows = sources.select("source").join(states.select("source", "last_fetched_at"), "source", "left").join(counts, "source", "left")
    return rows.select("source", F.when(predicates.on_cooldown(F.col("source"), F.col("last_fetched_at"), now, days), -1).otherwise(F.coalesce("n__", F.lit(0))).cast("long").alias("n"))


def dismiss_company(jobs: DataFrame, company: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(jobs, log rows): a company's postings that await a decision become ignored, its others stay."""
    hit = predicates._true((F.col("company") == company) & F.col("status").isin(*predicates.OPEN))
    reason = "company-applied"
    log = jobs.where(hit).select("id", F.lit("dismissed").alias("type"), F.lit('{"reason":"company-applied","bulk":true}').alias("payload"), at.alias("at"))
    return jobs.withColumns({"dismiss_reason": F.when(hit, reason).otherwise(F.col("dismiss_reason")), "status": F.when(hit, "ignored").otherwise(F.col("status"))}), log


def judge_deltas(judgments: DataFrame, first: str, second: str, ident: str = "id") -> DataFrame:
    """(id, first_score, second_score, delta) of postings that two models judged, by each one's latest judgment. judgments: id, model, fit_score, at."""
    last = judgments.where(F.col("model").isin(first, second)).groupBy(ident).agg(*(F.max_by(F.when(F.col("model") == m, F.col("fit_score")), F.when(F.col("model") == m, F.struct("at", "fit_score"))).alias(n) for m, n in ((first, "first_score"), (second, "second_score"))))
    return last.where("first_score is not null and second_score is not null").withColumn("delta", F.col("second_score") - F.col("first_score"))


def delta_report(deltas: DataFrame) -> DataFrame:
    """One row: postings judged twice, raised by 15 or more, dropped by 20 or more, and the share that the first model saw too well."""
    return deltas.agg(F.count("*").alias("n"), F.count_if(F.col("delta") >= RAISED).alias("raised"), F.count_if(F.col("delta") <= DROPPED).alias("dropped"), F.round(F.avg((F.col("delta") < 0).cast("double")), 6).alias("optimistic"))


# --------------------------------------------------------------------- state


def validated(boards: DataFrame, outcomes: DataFrame, at: Column) -> DataFrame:
    """Boards after their probes: active or dead with the time and a name; an error, or no probe, leaves a board as it is.

    outcomes: platform, token, region, result (active, dead, error),
    company_name. A given name wins, a known one is never blanked, else the
    token names the board.
    """
    got = outcomes.select("platform", "token", "region", F.col("result").alias("result__"), F.col("company_name").alias("name__"))
    rows = boards.join(got, ["platform", "token", "region"], "left")
    settled = predicates._true(F.col("result__").isin("active", "dead"))
    name = F.coalesce("name__", "company_name", detect.titled_token(F.col("token")))
    return rows.withColumns({"status": F.when(settled, F.col("result__")).otherwise(F.col("status")), "validated_at": F.when(settled, at).otherwise(F.col("validated_at")), "company_name": F.when(settled, name).otherwise(F.col("company_name"))}).select(*boards.columns)


def validation_report(boards: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: checked, active, dead, revived (dead before) and errors."""
    rows = boards.select("platform", "token", "region", "status").join(outcomes.select("platform", "token", "region", "result"), ["platform", "token", "region"])
    alive = F.col("result") == "active"
    return rows.agg(F.count("*").alias("checked"), F.count_if(alive).alias("active"), F.count_if(F.col("result") == "dead").alias("dead"), F.count_if(alive & (F.col("status") == "dead")).alias("revived"), F.count_if(F.col("result") == "error").alias("errors"))


def unstamped(boards: DataFrame, slice_keys: DataFrame, errors: int, share: float = 0.9) -> DataFrame:
    """Boards after a slice of a sweep: where ``share`` of its boards or more failed, those of the slice count as never fetched, to be tried again. slice_keys: platform, token, region."""
    tried = slice_keys.distinct()
    n = tried.count()
    if n == 0 or errors < n * share:
        return boards
    mark = tried.withColumn("undo__", F.lit(True))
    rows = boards.join(mark, ["platform", "token", "region"], "left")
    undo = F.col("undo__").isNotNull()
    return rows.withColumns({"last_fetched_at": F.when(~undo, F.col("last_fetched_at")), "interval_days": F.when(undo, 1).otherwise(F.col("interval_days")), "hit_rate": F.when(undo, 0.0).otherwise(F.col("hit_rate"))}).select(*boards.columns)


def follow_ups(actions: DataFrame, ident: str = "id") -> DataFrame:
    """(id, follow_up_at, note) after each posting's last setting of either. actions: id, type (follow-up or note), value, at.

    A follow-up's value is a number of days after its action, or ``clear``; a
    note is cut at 500 characters, an empty one removes it.
    """
    order = F.struct("at", "value")
    due = F.timestamp_micros(F.unix_micros(F.col("at").cast("timestamp")) + F.col("value").try_cast("long") * 86_400_000_000)
    follow, note = F.col("type") == "follow-up", F.col("type") == "note"
    return actions.groupBy(ident).agg(
        F.max_by(F.when(follow & (F.col("value") != "clear"), due), F.when(follow, order)).alias("follow_up_at"),
        F.max_by(F.nullif(F.substring("value", 1, NOTE), F.lit("")), F.when(note, order)).alias("note"),
    )


def spellings(jobs: DataFrame, key: Column) -> DataFrame:
    """(raw, spellings): each location key with all ways in which it is written."""
    return jobs.where("location is not null and location <> ''").select(key.alias("raw"), "location").distinct().groupBy("raw").agg(F.array_sort(F.collect_list("location")).alias("spellings"))


def seen_ids(jobs: DataFrame) -> DataFrame:
    """(source, ids): how many distinct postings each direct source gave."""
    return jobs.where(is_direct(F.col("source"))).groupBy("source").agg(F.count_distinct("external_id").alias("ids"))


def pursued_companies(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(*predicates.PURSUED)).select("company").distinct()


def sweep_totals(slices: DataFrame) -> DataFrame:
    """One row: the sums over a sweep's slices. slices: boards, stored, updated, delisted, errors."""
    return slices.agg(F.count("*").alias("slices"), *(F.sum(c).alias(c) for c in ("boards", "stored", "updated", "delisted", "errors")))


def stalest_sources(jobs: DataFrame, now: Column, days: int = 2, most: int = 15) -> DataFrame:
    """Direct sources with live rows unseen for ``days``, by their oldest sight, the first fifteen."""
    old = jobs.where(predicates._true(predicates.live() & is_direct(F.col("source")) & (predicates.days_between(now, F.col("last_seen_at")) > days)))
    return old.groupBy("source").agg(F.min("last_seen_at").alias("oldest")).orderBy("oldest", "source").limit(most)


def country_facets(jobs: DataFrame, allowed, by_region: bool, top: int = 10) -> DataFrame:
    """(bucket, n): the ``top`` allowed countries, other, remote and unknown. The last two count whatever region is chosen."""
    counts = jobs.select(predicates.country_bucket(allowed).alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))
    special = F.col("bucket").isin("remote", "unknown")
    first = counts.where(~special).orderBy(F.desc("n"), "bucket").limit(top).select("bucket", F.col("bucket").alias("name__"))
    named = counts.join(F.broadcast(first), "bucket", "left").select(F.when(special, F.col("bucket")).otherwise(F.coalesce("name__", F.lit("other"))).alias("bucket"), "n")
    return named.groupBy("bucket").agg(F.sum("n").alias("n"))
