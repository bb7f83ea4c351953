"""Age, freshness and cadence of postings as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRESH_DAYS, EVERGREEN_DAYS, CLOCK_DAYS = 45, 180, 14


def days_between(late: Column, early: Column) -> Column:
    """Days as a double."""
    return (F.unix_micros(late.cast("timestamp")) - F.unix_micros(early.cast("timestamp"))) / F.lit(86_400_000_000.0)


def freshness(posted: Column, first_seen: Column, last_seen: Column, direct: Column, delisted: Column, now: Column, newest: Column) -> Column:
    """delisted, evergreen, aging or fresh; a direct source's row is delisted when the pool's own clock has left it behind."""
    age = days_between(now, F.coalesce(posted, first_seen))
    return F.when(delisted.isNotNull(), "delisted").when(direct & (days_between(newest, last_seen) > CLOCK_DAYS), "delisted").when(age > EVERGREEN_DAYS, "evergreen").when(age > FRESH_DAYS, "aging").otherwise("fresh")


def age_label(posted: Column, now: Column) -> Column:
    days = F.floor(days_between(now, posted))
    return F.when(days < 1, "today").when(days < 30, F.concat(days.cast("string"), F.lit("d"))).when(days < 365, F.concat(F.floor(days / 30).cast("string"), F.lit("mo"))).otherwise("1y+")


def too_old(posted: Column, direct: Column, now: Column) -> Column:
    return F.coalesce(~direct & (days_between(now, posted) > FRESH_DAYS), F.lit(False))


def next_interval(interval: Column, hit: Column) -> Column:
    """One day after a hit; else twice as long, from 2 to 30 days."""
    return F.when(hit, 1).otherwise(F.least(F.lit(30), F.greatest(F.lit(2), interval * 2)))


def blend_rate(old: Column, rate: Column) -> Column:
    return F.floor((old * 0.7 + rate * 0.3) * 1000 + 0.5) / 1000
