"""Addresses and bodies of searches, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_query(address: str, pairs) -> Column:
    """``address`` with (name, value) pairs, form-encoded in their order; a null value leaves its pair out."""
    parts = [F.concat(F.lit(name + "="), F.url_encode(value.cast("string"))) for name, value in pairs]
    return F.concat(F.lit(address + "?"), F.concat_ws("&", *parts))


def guest_search(address: str, keywords: Column, location: Column, page: Column, days: int, work_types: Column | None = None) -> Column:
    """Ten cards a page of the last ``days`` days; work types as one comma list."""
    types = F.nullif(F.array_join(work_types, ","), F.lit("")) if work_types is not None else F.lit(None).cast("string")
    return with_query(address, [("keywords", keywords), ("location", location), ("f_TPR", F.lit(f"r{days * 86_400}")), ("f_WT", types), ("start", page * 10)])


def agency_search(address: str, query: Column, page: Column, days: int, size: int = 100) -> Column:
    return with_query(address, [("was", query), ("angebotsart", F.lit("1")), ("veroeffentlichtseit", F.lit(days)), ("size", F.lit(size)), ("page", page)])


def free_search(address: str, query: Column, page: Column, days: int, limit: int = 50, remote: bool = False, countries=("de", "nl", "es", "pt", "fr")) -> Column:
    """A keyword search; remote ones ask for a region, others for each country."""
    where = [("work_mode", F.lit("remote")), ("regions", F.lit("eu"))] if remote else [("countries", F.lit(c)) for c in countries]
    return with_query(address, [("q", query), ("limit", F.lit(limit)), ("offset", page * limit), ("semantic_ratio", F.lit(0)), ("include_description", F.lit("true")), ("description_format", F.lit("text")), ("posted_within_days", F.lit(days)), *where])


def room_search(title: Column) -> Column:
    """The body of a search by title, whatever the workload."""
    return F.to_json(F.struct(F.array(title).alias("keywords"), F.lit(0).alias("workloadPercentageMin"), F.lit(100).alias("workloadPercentageMax")))


def listed(value: str | None, otherwise) -> list[str]:
    """A comma list from the configuration in lower case, or what stands in for it."""
    found = [x.strip().lower() for x in (value or "").split(",") if x.strip()]
    return found or list(otherwise)


def any_of(columns) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
