"""What a candidate looks for: families of roles, tracks, search words, and their checks. Plain values of one profile, made on the driver."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, replace

from tessera.operators.scoring import Profile, Track

#: Languages of search words, and bounds of a profile's parts.
LANGUAGES = ("en", "de", "nl", "fr", "es", "it", "pl", "pt", "cs", "sk", "ro", "hu", "el", "sv", "da", "no", "fi", "bg", "hr", "sl", "lt", "lv", "et")
FAMILIES, TRACKS, TITLES, BODIES, QUERIES, WORD, VARIANT, VARIANTS, LABEL = (1, 3), (2, 8), (2, 12), (3, 18), (1, 8), (2, 40), (3, 50), 3, 40


@dataclass(frozen=True)
class Family:
    key: str
    label: str
    titles: tuple[str, ...]


def role_signals(families: Sequence[Family], selected) -> list[str]:
    """The titles of the selected families."""
    return [t for f in families if f.key in set(selected) for t in f.titles]


def role_negatives(families: Sequence[Family], selected) -> list[str]:
    """The mirror: the titles of all families that were not selected."""
    return [t for f in families if f.key not in set(selected) for t in f.titles]


def cv_hash(cv: str, target: str = "") -> str:
    return hashlib.sha1(f"{cv}\n---\n{target}".encode()).hexdigest()


def _words(raw, bounds: tuple[int, int], size: tuple[int, int], what: str) -> list[str]:
    if not isinstance(raw, list):
        raise ValueError(f"{what} is no list")
    clean = [w.lower().strip() for w in raw if isinstance(w, str)]
    found = list(dict.fromkeys(w for w in clean if size[0] <= len(w) <= size[1]))
    if len(found) < bounds[0]:
        raise ValueError(f"{what} has {len(found)} usable words, not {bounds[0]}")
    return found[: bounds[1]]


def clean_variants(raw) -> dict[str, list[str]]:
    """Search words by known language, at most three each; what can't be used is left out, never a fault."""
    out = {}
    for language in LANGUAGES if isinstance(raw, dict) else ():
        words = raw.get(language)
        if isinstance(words, list):
            plain = [re.sub("[‐-―−]", "-", unicodedata.normalize("NFC", w)).lower().strip() for w in words if isinstance(w, str)]
            if kept := list(dict.fromkeys(w for w in plain if VARIANT[0] <= len(w) <= VARIANT[1]))[:VARIANTS]:
                out[language] = kept
    return out


def with_general_tracks(families: Sequence[Family], selected, tracks: Sequence[Track]) -> list[Track]:
    """The tracks, and last one general track for each selected family that has titles which no track covers."""
    covered, keys = {t for track in tracks for t in track.title}, {t.key for t in tracks}
    body = tuple(dict.fromkeys(w for track in tracks for w in track.body))[: BODIES[1]]
    general = [Track(f"general-{f.key}", f"General {f.label}", tuple(t for t in f.titles if t not in covered), body) for f in families if f.key in set(selected) and f"general-{f.key}" not in keys]
    return [*tracks, *(t for t in general if t.title)]


def parse_profile(raw: str, families: Sequence[Family]) -> tuple[Profile, list[str]]:
    """(profile, search queries) of a model's answer; ValueError where it can't be a configuration."""
    found = re.search(r"\{.*\}", raw, re.S)
    if not found:
        raise ValueError("no JSON object in the answer")
    given = json.loads(found[0])
    known = {f.key for f in families}
    chosen = list(dict.fromkeys(k for k in given.get("families") or () if k in known)) if isinstance(given.get("families"), list) else []
    if not FAMILIES[0] <= len(chosen) <= FAMILIES[1]:
        raise ValueError("one to three known families are needed")
    listed = given.get("tracks")
    if not isinstance(listed, list) or not TRACKS[0] <= len(listed) <= TRACKS[1]:
        raise ValueError("two to eight tracks are needed")
    tracks: dict[str, Track] = {}
    for one in listed:
        one = one if isinstance(one, dict) else {}
        key = re.sub("^-+|-+$", "", re.sub("[^a-z0-9-]+", "-", str(one.get("key") or "").lower().strip()))
        if not key or key in tracks:
            raise ValueError(f"a bad or repeated track key: {one.get('key')!r}")
        variants = tuple(w for words in clean_variants(one.get("searchVariants")).values() for w in words)
        tracks[key] = Track(key, str(one.get("label") or key)[:LABEL], tuple(_words(one.get("titleKeywords"), TITLES, WORD, f"titles of {key}")), tuple(_words(one.get("bodyKeywords"), BODIES, WORD, f"words of {key}")), variants)
    queries = _words(given.get("searchQueries") or [], QUERIES, WORD, "searchQueries")
    seniority = given.get("seniority") if isinstance(given.get("seniority"), dict) else {}
    profile = Profile(tuple(with_general_tracks(families, chosen, list(tracks.values()))), role_negative=tuple(role_negatives(families, chosen)), signals=tuple(role_signals(families, chosen)))
    return replace(profile, boost=tuple(seniority.get("boost") or ()), avoid=tuple(seniority.get("avoid") or ()), languages=tuple(given.get("languages") or ("en",))), queries


def search_groups(profile: Profile, most: int = 4) -> list[dict[str, list[str]]]:
    """Search words of the first specific tracks, by language; English begins with the track's own first title."""
    specific = [t for t in profile.tracks if not profile.is_general(t) and t.title]
    return [{"en": list(dict.fromkeys([t.title[0], *t.variants]))} for t in specific[:most]]
