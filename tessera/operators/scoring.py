"""The keyword scorer: ordered gates on the title, then the best track."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import detect
from tessera.functions.text import count_hits, word_hits

STORE_THRESHOLD = 20


@dataclass(frozen=True)
class Track:
    """One kind of role. ``variants`` are titles in other languages; ``boost`` and ``avoid`` stand in for the profile's where they are given."""

    key: str
    label: str
    title: tuple[str, ...]
    body: tuple[str, ...] = ()
    variants: tuple[str, ...] = ()
    boost: tuple[str, ...] | None = None
    avoid: tuple[str, ...] | None = None

    @property
    def titles(self) -> tuple[str, ...]:
        return self.title + self.variants


@dataclass(frozen=True)
class Profile:
    tracks: tuple[Track, ...]
    negative: tuple[str, ...] = ()
    role_negative: tuple[str, ...] = ()
    signals: tuple[str, ...] = ()
    boost: tuple[str, ...] = ()
    avoid: tuple[str, ...] = ()
    accept: tuple[str, ...] = ()
    languages: tuple[str, ...] = ("en",)
    general: frozenset[str] = field(default_factory=frozenset)

    def appetite(self, key: str | None) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """(boost, avoid) of a track: its own, each list by itself, else the profile's."""
        track = next((t for t in self.tracks if t.key == key), None)
        boost = self.boost if track is None or track.boost is None else track.boost
        return boost, self.avoid if track is None or track.avoid is None else track.avoid

    def is_general(self, track: Track) -> bool:
        return track.key in self.general or track.key.startswith("general-")


@dataclass(frozen=True)
class Places:
    """What is known of places: names of country codes, regions, other names of regions, codes by place name."""

    names: dict[str, str]
    regions: dict[str, list[str]]
    synonyms: dict[str, str]
    gazetteer: dict[str, str]


def region_ok(remote: Column, location: Column, accept, places: Places | None = None) -> Column:
    """Remote, unknown, accepted by its text, of a country that nobody knows, or of an accepted country."""
    low = F.lower(F.coalesce(location, F.lit("")))
    ok = F.coalesce(remote, F.lit(False)) | (low == "")
    ok = reduce(lambda a, r: a | F.contains(low, F.lit(r)), accept, ok)
    if places is None:
        return ok
    country = detect.country_of(low, places.gazetteer, places.names)
    return ok | country.isNull() | detect.country_passes(country, accept, places.names, places.regions, places.synonyms, places.gazetteer)


def seniority_adjust(low: Column, boost, avoid) -> Column:
    """8 up for a boosted word of the title, 8 down for an avoided one; both may apply."""
    return F.when(F.size(word_hits(low, boost)) > 0, 8).otherwise(0) - F.when(F.size(word_hits(low, avoid)) > 0, 8).otherwise(0)


_ENTRY = "struct<score:int,matched:int,place:int,track:string,reason:string>"


def score_postings(df: DataFrame, profile: Profile, title: str = "title", description: str = "description", remote: str = "remote", location: str | None = None, places: Places | None = None, extras: bool = True) -> DataFrame:
    """``df`` with score, track, reason, scored_by, disqualified and, with ``extras``, seniority_level and lang_req.

    Gates look at the title alone, in order: an excluded word, a word of
    another role unless a specific track's title fits, no role signal, the
    region. Then each track scores 40 a title hit and 5 a body hit (five at
    most; the title counts as body), body-only tracks at most 22, 8 for remote,
    at most 100, and then 8 up or down by the title's seniority words, 8 down
    by a blocked level where they don't. The best score wins, of equal ones a
    title match, then the earlier track. Without ``extras`` levels are unknown.
    Each set of hits is one column, so it is computed once a row.
    """
    level = detect.seniority(F.col(title), F.col(description))["level"] if extras else F.lit("unknown")
    languages = F.array_join(detect.language_requirements(F.col(description)), ",") if extras else F.lit("")
    whole = F.concat(F.col(title), F.lit("\n"), F.coalesce(description, F.lit("")))
    place = F.col(location) if location else F.lit(None).cast("string")
    rows = df.withColumns({"low__": F.lower(F.col(title)), "text__": F.lower(whole), "level__": level, "lang__": languages})
    low, text = F.col("low__"), F.col("text__")
    hits = {"neg__": word_hits(low, profile.negative), "role__": word_hits(low, profile.role_negative), "signal__": F.size(count_hits(low, profile.signals)) > 0}
    for i, t in enumerate(profile.tracks):
        hits |= {f"title{i}__": count_hits(low, t.titles), f"body{i}__": count_hits(text, t.body)}
    rows = rows.withColumns(hits)
    specific = reduce(lambda a, i: a | (F.size(f"title{i}__") > 0), [i for i, t in enumerate(profile.tracks) if not profile.is_general(t)], F.lit(False))
    entries = {}
    for i, t in enumerate(profile.tracks):
        in_title, in_body = F.col(f"title{i}__"), F.col(f"body{i}__")
        matched = F.size(in_title) > 0
        raw = 40 * F.size(in_title) + 5 * F.least(F.size(in_body), F.lit(5))
        value = F.least(F.when(matched, raw).otherwise(F.least(raw, F.lit(22))) + F.when(F.coalesce(F.col(remote), F.lit(False)), 8).otherwise(0), F.lit(100))
        boost, avoid = profile.appetite(t.key)
        adjust = seniority_adjust(low, boost, avoid)
        adjust = adjust - F.when((adjust >= 0) & detect.level_blocked(F.col("level__"), avoid), 8).otherwise(0)
        value = F.greatest(F.lit(0), F.least(F.lit(100), value + adjust)).cast("int")
        words = F.array_join(F.slice(F.array_distinct(F.concat(in_title, in_body)), 1, 5), ", ")
        reason = F.concat(F.lit(t.label), F.when(matched, ": ").otherwise(" (body-only): "), words)
        entry = F.struct(value.alias("score"), matched.cast("int").alias("matched"), F.lit(-i).alias("place"), F.lit(t.key).alias("track"), reason.alias("reason"))
        entries[f"entry{i}__"] = F.when((raw > 0) & (matched | (value > 0)), entry).otherwise(F.lit(None).cast(_ENTRY))
    rows = rows.withColumns(entries)
    best = F.array_max(F.array(*(F.col(c) for c in entries)))
    ok = region_ok(F.col(remote), place, profile.accept, places) if location else F.lit(True)
    gate = (
        F.when(F.size("neg__") > 0, F.concat(F.lit("Excluded ("), F.get("neg__", F.lit(0)), F.lit(")")))
        .when((F.size("role__") > 0) & ~specific, F.concat(F.lit("Non-eng role ("), F.get("role__", F.lit(0)), F.lit(")")))
        .when(~F.col("signal__"), "No engineering role signal in title")
        .when(~ok, F.concat(F.lit("Region mismatch ("), F.coalesce(place, F.lit("")), F.lit(")")))
    )
    rows = rows.withColumns({"gate__": gate, "best__": best})
    let_in = F.col("gate__").isNull()
    score = F.when(let_in, F.coalesce(F.col("best__.score"), F.lit(0))).otherwise(0)
    out = {
        "score": score, "track": F.when(let_in, F.coalesce(F.col("best__.track"), F.lit("other"))).otherwise("other"),
        "reason": F.coalesce("gate__", "best__.reason", F.lit("No track match")), "scored_by": F.lit("keyword"), "disqualified": score == 0,
    }
    if extras:
        out |= {"seniority_level": F.col("level__"), "lang_req": F.col("lang__")}
    names = [c for c in df.columns if c not in out]
    return rows.select(*(F.col(f"`{c}`") for c in names), *(v.alias(k) for k, v in out.items()))


def gate_label(reason: Column, points: Column, threshold: int = STORE_THRESHOLD) -> Column:
    """Which step let a posting go; null if none did. Storing asks for ``threshold``, scoring anew for 0: both are modes of one pool."""
    return (
        F.when(reason.startswith("Excluded"), "negative").when(reason.startswith("Non-eng"), "roleNegative").when(reason.startswith("No engineering"), "noSignal")
        .when(reason.startswith("Region"), "region").when(reason.startswith("No track"), "noMatch").when(points < threshold, "belowThreshold")
    )
