"""Predicates over postings and boards, each one a native column.

They read columns by the names of a stored posting: id, company, title, url,
source, location, country, work_mode, track, score, disqualified, status,
visa, sponsor_reg, posted_at, first_seen_at, last_seen_at, delisted_at,
duplicate_of, fit_score, fit_verdict, fit_category, fit_comment, fit_by,
follow_up_at; of a board: status, last_fetched_at, interval_days,
validated_at. Times are columns too, so that a run's clock is given and never
read from the machine. A predicate is never null.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.lifecycle import CLOCK_DAYS, FRESH_DAYS, days_between
from tessera.functions.text import host_in, host_of, is_direct
from tessera.operators.models import WALL_SITES

#: Work modes, states of pursuit, stages of an application, in order.
WORK_MODES, PURSUED, VISAS = ("remote", "hybrid", "onsite"), ("applied", "interview", "offer"), ("yes", "unknown", "no")
STAGES, OPEN = ("applied", "interview", "offer", "rejected", "ghosted"), ("new", "interested")
#: Countries of the wide queue, sources whose descriptions are filled later, words of a place in a comment.
TARGETS = ("de", "nl", "es", "ch", "dk", "se", "be", "pl", "fr", "pt", "at", "ie", "gb", "no", "fi")
FILLED_LATER = ("sr:", "workday:", "workable:", "bamboohr:", "breezy:", "join:")
LOCATION_TERMS = ("locat", "reloc", "izmir", "turkey", "based in", "on-site presence", "logistic", "time zone", "timezone", "geograph", "residence", "must be in")
REVIEWED = "qwen27b-review"
#: Days between fetches of sources that are fetched rarely.
COOLDOWN_DAYS = {"linkedin": 5}
RECHECK_DAYS, SWEEP_DAYS, GHOST_DAYS, REGISTER_DAYS, TITLE_ONLY = 30, 10, 14, 14, 60


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def chosen(raw: str | None, known: Iterable[str]) -> list[str]:
    """The known entries of a comma list, sorted, each once; others are dropped without a word."""
    known = set(known)
    return sorted({x.strip() for x in (raw or "").split(",")} & known)


def live() -> Column:
    return F.col("delisted_at").isNull()


def on_radar() -> Column:
    """New, live, no duplicate, not disqualified."""
    return _true(F.col("duplicate_of").isNull() & (F.col("status") == "new") & live() & ~F.col("disqualified"))


def facets(tracks=(), verdict: str = "all", modes=(), visas=()) -> Column:
    """The chosen values of each facet; an empty choice lets all pass, null too."""
    parts = [_true(F.col(c).isin(list(values))) for c, values in (("track", tracks), ("work_mode", modes), ("visa", visas)) if values]
    parts += [] if verdict == "all" else [_true(F.col("fit_verdict") == verdict)]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def holds_text(query: str) -> Column:
    """The title or the company holds the query, A-Z in any case; an empty query passes all."""
    if not query.strip():
        return F.lit(True)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    needle = query.strip().translate(str.maketrans(upper, lower))
    return _any(_true(F.contains(F.translate(c, upper, lower), F.lit(needle))) for c in ("title", "company"))


def in_fresh_window(now: Column, newest: Column) -> Column:
    """Posted (else first seen) within 45 days, live, and for a direct source seen within 14 days of the pool's own clock; pursued ones whatever their age."""
    age = days_between(now, F.coalesce("posted_at", "first_seen_at"))
    left_behind = is_direct(F.col("source")) & (days_between(newest, F.col("last_seen_at")) > CLOCK_DAYS)
    return _true(live() & (age <= FRESH_DAYS) & ~_true(left_behind)) | _true(F.col("status").isin(*PURSUED))


def country_bucket(allowed) -> Column:
    """The country where it is an allowed one, ``remote`` or ``unknown`` without a country; null for the rest."""
    mode = F.when(_true(F.col("work_mode") == "remote"), "remote").otherwise("unknown")
    return F.when(F.col("country").isNull(), mode).when(F.col("country").isin(list(allowed)), F.col("country"))


def in_countries(choice, top, allowed, by_region: bool) -> Column:
    """The chosen codes among the ``top`` ones, and other, remote and unknown; without a choice the allowed ones where a region is chosen, else all."""
    picked = [c for c in choice if c in top or c in ("other", "remote", "unknown")]
    if not picked:
        return _true(F.col("country").isin(list(allowed))) if by_region else F.lit(True)
    codes = [c for c in picked if c in top] + ([c for c in allowed if c not in top] if "other" in picked else [])
    bucket = country_bucket(allowed)
    return _true(F.col("country").isin(codes)) | _true(bucket.isin([c for c in picked if c in ("remote", "unknown")]))


def on_cooldown(source: Column, last_fetched: Column, now: Column, days: dict[str, int] | None = None) -> Column:
    """Whether a rarely fetched source was fetched too lately; one never fetched, or not listed, never is."""
    days = COOLDOWN_DAYS if days is None else days
    return _any(_true((source == name) & (days_between(now, last_fetched) < n)) for name, n in days.items())


def is_due(now: Column) -> Column:
    """A board that was never fetched, or whose interval has passed."""
    return F.col("last_fetched_at").isNull() | _true(days_between(now, F.col("last_fetched_at")) >= F.col("interval_days"))


def validation_due(now: Column) -> Column:
    return _true(F.col("status") == "candidate") | F.col("validated_at").isNull() | _true(days_between(now, F.col("validated_at")) > RECHECK_DAYS)


def _unjudged() -> Column:
    return F.col("fit_score").isNull() & live() & F.col("duplicate_of").isNull() & ~F.col("disqualified") & F.col("status").isin(*OPEN)


def visa_wave() -> Column:
    """Unjudged, above 50 points, and of a registered sponsor or with a visa offered."""
    return _true(_unjudged() & (F.col("score") > 50) & (_true(F.col("sponsor_reg")) | _true(F.col("visa") == "yes")))


def wide_wave(now: Column) -> Column:
    """Unjudged, 40 points or more, dated within 45 days, and of a target country or remote; undated ones are out."""
    return _true(_unjudged() & (F.col("score") >= 40) & (days_between(now, F.col("posted_at")) <= FRESH_DAYS) & (_true(F.col("country").isin(*TARGETS)) | _true(F.col("work_mode") == "remote")))


def title_only(title: Column, description: Column) -> Column:
    """Nothing to read beyond the title."""
    return F.length(F.coalesce(description, F.lit(""))) < F.length(title) + TITLE_ONLY


def fills_later() -> Column:
    """Live, qualified, no duplicate, from a source whose list gives no descriptions."""
    return _true(_any(F.col("source").startswith(p) for p in FILLED_LATER) & live() & F.col("duplicate_of").isNull() & ~F.col("disqualified"))


def awaits_review() -> Column:
    return _true((F.col("fit_score") >= 40) & F.col("fit_by").isNull() & live() & F.col("duplicate_of").isNull() & F.col("status").isin(*OPEN))


def awaits_second_review() -> Column:
    """Reviewed, live, not refused for a visa, and judged by its place; without a category it is not compared, so it is out."""
    comment = F.lower(F.coalesce("fit_comment", F.lit("")))
    return _true((F.col("fit_by") == REVIEWED) & live() & (F.col("fit_category") != "NO_VISA") & _any(F.contains(comment, F.lit(t)) for t in LOCATION_TERMS))


def sweep_due(now: Column) -> Column:
    """A live aggregator's posting, unseen for ten days, on a site that lets visitors in."""
    walled = host_in(host_of(F.col("url")), WALL_SITES)
    return _true(live() & ~is_direct(F.col("source")) & (days_between(now, F.col("last_seen_at")) > SWEEP_DAYS) & F.col("url").isNotNull() & (F.col("url") != "") & ~walled)


def follow_up_due(now: Column) -> Column:
    return _true((F.col("follow_up_at") <= now) & F.col("status").isin("applied", "interview"))


def seems_ghosted(now: Column) -> Column:
    return _true((F.col("status") == "applied") & (days_between(now, F.col("follow_up_at")) > GHOST_DAYS))


def unresolved_places(jobs: DataFrame, cache: DataFrame, key: Column) -> DataFrame:
    """Live rows with a location but no country, whose location key nobody has asked about. cache: raw."""
    open_ = jobs.where(F.col("country").isNull() & F.col("location").isNotNull() & (F.col("location") != "") & live()).withColumn("raw", key)
    return open_.join(cache.select("raw").distinct(), "raw", "left_anti")


def register_stale(register: DataFrame, now: Column) -> DataFrame:
    """One row, stale: the register is empty, or its last change is older than 14 days."""
    return register.agg(F.coalesce(days_between(now, F.max("updated_at")) > REGISTER_DAYS, F.lit(True)).alias("stale"))


def due_estimate(boards: DataFrame, now: Column) -> DataFrame:
    """One row, due: active boards never fetched or not within a day."""
    due = _true(F.col("status") == "active") & (F.col("last_fetched_at").isNull() | _true(days_between(now, F.col("last_fetched_at")) > 1))
    return boards.agg(F.count_if(due).alias("due"))


def reason_label(key: Column) -> Column:
    """What a reason of dismissal is called."""
    found = F.when(key == next(iter(REASONS)), REASONS[next(iter(REASONS))])
    return reduce(lambda c, item: c.when(key == item[0], item[1]), list(REASONS.items())[1:], found).otherwise("No reason")


#: Reasons of dismissal.
REASONS = {
    "language": "Language requirement", "seniority": "Seniority mismatch", "stack": "Not my stack", "company-applied": "Already applied to company", "company": "Not this company",
    "terms": "Weak terms / salary", "no-visa": "No visa sponsorship", "ghost": "Ghost / suspicious",
}
