"""What a posting's text says about work mode, visa, languages, seniority and whether it is still open.

All of them are native column expressions. A null text counts as empty.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases by which a posting rules sponsorship out.
VISA_NO = (
    "no visa sponsorship",
    "visa sponsorship (?:is )?not (?:available|provided|offered|possible)",
    "(?:unable|not able) to (?:provide|offer|support) (?:visa )?sponsorship",
    "cannot (?:provide|offer|support) (?:visa )?sponsorship",
    "we (?:do|can) ?not (?:currently )?(?:offer|provide|sponsor)[^.]{0,30}visa",
    "without (?:visa )?sponsorship",
    "no (?:work permit|visa) (?:support|sponsorship)",
    "must (?:already )?(?:have|hold|possess) (?:the )?(?:legal )?right to work",
    "right to work in [^.]{0,30}(?:is )?required",
    "(?:authorized|authorised|eligible) to work[^.]{0,40}(?:required|without sponsorship)",
    "valid work (?:permit|authori[sz]ation) (?:is )?required",
)
#: Phrases by which it offers sponsorship or relocation.
VISA_YES = (
    "visa sponsorship(?: is)? (?:available|provided|offered|possible)",
    "we (?:can |do |will |also )?(?:offer|provide|sponsor)[^.]{0,30}visa",
    "visa (?:and|&) relocation",
    "relocation (?:and|&) visa",
    "relocation (?:package|support|assistance|budget|bonus)",
    "we support (?:your )?relocation",
    "work permit (?:support|assistance|sponsorship)",
    "visa (?:support|assistance)",
    "sponsorship (?:is )?(?:available|provided|offered)",
)
VISA_WORDS = ("visa", "sponsor", "to work", "work permit", "work authori", "relocat")
#: How a posting demands a language, by language code.
LANGUAGES = {
    "de": "flie(ß|ss)end(e[sn]?)? deutsch|deutschkenntnisse|verhandlungssicher(e[sn]?)? deutsch|sehr gute deutsch|deutsch (auf )?(mindestens )?[bc][12]|german (at )?([bc][12]|native|fluen(t|cy)|business|professional)|fluent (in )?german|native german",
    "fr": "fran(ç|c)ais courant|ma(î|i)trise du fran(ç|c)ais|french (native|fluen(t|cy)|[bc][12])|fluent (in )?french|bilingue fran(ç|c)ais",
    "nl": "vloeiend nederlands|nederlands (als moedertaal|op [bc][12])|dutch (native|fluen(t|cy)|[bc][12])|fluent (in )?dutch",
    "es": "espa(ñ|n)ol (nativo|fluido|avanzado)|spanish (native|fluen(t|cy)|[bc][12])|fluent (in )?spanish",
    "it": "italiano (madrelingua|fluente)|italian (native|fluen(t|cy)|[bc][12])|fluent (in )?italian",
    "pl": "j(ę|e)zyk polski|polish (native|fluen(t|cy)|[bc][12])|fluent (in )?polish",
    "sv": "flytande svenska|swedish (native|fluen(t|cy)|[bc][12])|fluent (in )?swedish",
    "da": "flydende dansk|danish (native|fluen(t|cy)|[bc][12])|fluent (in )?danish",
    "fi": "sujuva suomi|finnish (native|fluen(t|cy)|[bc][12])|fluent (in )?finnish",
    "no": "flytende norsk|norwegian (native|fluen(t|cy)|[bc][12])|fluent (in )?norwegian",
}
#: Words near a demand that make it a wish.
HEDGE = "(nice to have|a plus|ist ein plus|von vorteil|w(ü|u)nschenswert|preferred but not|not required|optional)"
#: Title words by level, the first level that fits wins.
TITLE_LEVELS = (
    ("management", r"\b(head of|director|vp |vice president|chief |engineering manager|manager,? (software|engineering)|leiter(in)? )"),
    ("staff", r"\b(staff|principal|distinguished|fellow|expert engineer)\b"),
    ("intern", r"\b(intern(ship)?|werkstudent|working student|praktikant|praktikum|trainee|stagiair)\b"),
    ("junior", r"\b(junior|jr\.?|graduate|entry[ -]level|associate software|einsteiger|absolvent)\b"),
    ("senior", r"\b(senior|sr\.?|starszy|erfahrene[rn]?)\b"),
    ("mid", r"\b(mid[ -]?level|intermediate|medior)\b"),
)
#: Lead titles, signs of management in a text, and years of experience.
LEAD = r"\b(tech lead|lead\b|teamlead|team lead)"
MANAGES = r"\b(direct reports?|people management|manage (a|the|our) team|lead a team of \d|hiring and (firing|performance)|performance reviews|budget responsibility|f(ü|u)hrungsverantwortung|personalverantwortung)\b"
YEARS = r"(\d{1,2})\s*\+?\s*(?:years?|yrs|jahren?|jaar|lat|ans|años|anni)\b"
#: What a page says, without accents, when its posting is closed.
CLOSED = (
    r"\bjob (is )?no longer (available|open|active)\b",
    r"no longer accepting applications",
    r"\b(?:position|role|posting|opening|vacancy|requisition)\b[\s\S]{0,60}?has been filled\b(?!\s+out)",
    r"this (?:job|posting|position) has (?:expired|closed|been closed|been removed)",
    r"\bjob (?:posting )?(?:has )?expired\b",
    r"posting (?:is )?(?:closed|inactive|not found)",
    r"stellenanzeige ist (?:nicht mehr|leider nicht mehr) (?:verfugbar|aktiv|online)",
    r"stelle (?:ist |wurde )?(?:bereits |inzwischen )?besetzt",
    r"anzeige ist abgelaufen",
    r"vacature is (?:niet meer|helaas niet meer) beschikbaar",
    r"vacature is (?:vervuld|verlopen|gesloten)",
    r"offre n'est plus (?:disponible|en ligne)",
    r"offre a (?:ete )?pourvue",
    r"cette offre (?:d'emploi )?(?:a expire|est expiree|est cloturee)",
    r"oferta ya no esta disponible",
    r"oferta (?:ha )?(?:expirado|caducado|finalizado)",
    r"(?:vaga|oferta) (?:ja )?nao esta (?:mais )?disponivel",
    r"siden eksisterer ikke",
    r"annoncen er udl.bet",
    r"stillingen er (?:besat|nedlagt)",
    r"jobbet er ikke l.ngere tilg.ngeligt",
    r"annonsen (?:ar|er) inte l.ngre tillg.nglig",
    r"tj.nsten (?:ar|er) tillsatt",
)
#: Company forms that carry no identity.
COMPANY_FORMS = r"\b(gmbh|inc|ltd|llc|ag|plc|corp|corporation|limited|b\.?v\.?|n\.?v\.?|s\.?a\.?|s\.?l\.?|s\.?a\.?s|sarl|a/s|aps|ab|oy|kft|sp\.? z ?o\.?o\.?)\b\.?"
#: Locations that name no place.
NO_PLACE = r"(?i)^(remote|worldwide|global|anywhere|distributed|fully remote|work from home|home office|emea|europe|european union|apac|latam|americas|international|flexible|hybrid|onsite|multiple locations?|various(?: locations?)?|n/a|-|—)$"
HEDGE_REACH, MODE_REACH, EVIDENCE = 80, 2000, 40

_ANY_CASE = "(?iu)"


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _any(patterns) -> str:
    return _ANY_CASE + "|".join(f"(?:{p})" for p in patterns)


def _accents() -> tuple[str, str]:
    """Letters with accents and their bases, from the Unicode decomposition of U+00C0 to U+024F and U+1E00 to U+1EFF."""
    letters, bases = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(p) for p in parts[1:]):
            letters.append(chr(code))
            bases.append(parts[0])
    return "".join(letters), "".join(bases)


def fold_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, *_accents()), "[̀-ͯ]", "")


def work_mode(explicit: Column, title: Column, location: Column, description: Column, remote: Column) -> Column:
    """The source's own word, else ``hybrid`` in the text, else remote by flag, else onsite."""
    head = F.concat_ws(" ", _text(title), _text(location), F.substring(_text(description), 1, MODE_REACH))
    return F.coalesce(F.nullif(explicit, F.lit("")), F.when(head.rlike(r"(?i)\bhybrid\b"), "hybrid").when(F.coalesce(remote, F.lit(False)), "remote").otherwise("onsite"))


def visa(title: Column, description: Column) -> Column:
    """no where a refusal stands anywhere, else yes where an offer does, else unknown.

    Every phrase holds one of VISA_WORDS, so most texts need no pattern.
    """
    text = F.concat(_text(title), F.lit("\n"), _text(description))
    hint = reduce(lambda a, w: a | F.contains(F.lower(text), F.lit(w)), VISA_WORDS, F.lit(False))
    return F.when(~hint, "unknown").when(text.rlike(_any(VISA_NO)), "no").when(text.rlike(_any(VISA_YES)), "yes").otherwise("unknown")


def language_requirements(text: Column, patterns: dict[str, str] | None = None, hedge: str = HEDGE) -> Column:
    """Codes of the languages that ``text`` demands; a hedge within 80 characters of a language's first mention cancels it."""
    text, codes = _text(text), []
    for code, pattern in (patterns or LANGUAGES).items():
        found = F.regexp_extract(text, _ANY_CASE + "(?:" + pattern + ")", 0)
        at = F.position(found, text)
        before = F.substring(text, F.greatest(at - HEDGE_REACH, F.lit(1)), F.least(at - 1, F.lit(HEDGE_REACH)))
        near = F.concat(before, F.substring(text, at, F.length(found) + HEDGE_REACH))
        codes.append(F.when((found != "") & ~near.rlike(_ANY_CASE + hedge), F.lit(code)))
    return F.array_compact(F.array(*codes))


def language_barrier(required: Column, spoken) -> Column:
    return F.array_except(required, F.array(*map(F.lit, spoken)).cast("array<string>"))


def seniority(title: Column, description: Column) -> Column:
    """struct<level, evidence>: an explicit title level, a lead title, signs of management, years of experience, else unknown."""
    title, body = _text(title), _text(description)

    def out(level, evidence) -> Column:
        return F.struct((F.lit(level) if isinstance(level, str) else level).alias("level"), evidence.alias("evidence"))

    def quoted(kind: str, found: Column) -> Column:
        return F.concat(F.lit(kind + ': "'), found, F.lit('"'))

    manages = F.regexp_extract(body, _ANY_CASE + MANAGES, 0)
    lead, years = title.rlike(_ANY_CASE + LEAD), F.regexp_extract(body, _ANY_CASE + YEARS, 1)
    n = F.nullif(years, F.lit("")).cast("int")
    result = None
    for level, pattern in TITLE_LEVELS:
        found = F.regexp_extract(title, _ANY_CASE + pattern, 0)
        entry = (found != "", out(level, quoted("title", F.trim(found))))
        result = F.when(*entry) if result is None else result.when(*entry)
    return (
        result.when(lead & (manages != ""), out("management", quoted("title lead + body", F.substring(manages, 1, EVIDENCE))))
        .when(lead, out("senior", F.lit("title: lead (IC by default)")))
        .when(manages != "", out("management", quoted("body", F.substring(manages, 1, EVIDENCE))))
        .when(n.isNotNull(), out(F.when(n >= 8, "staff").when(n >= 5, "senior").when(n >= 2, "mid").otherwise("junior"), quoted("body", F.trim(F.regexp_extract(body, _ANY_CASE + YEARS, 0)))))
        .otherwise(out("unknown", F.lit("")))
    )


def level_blocked(level: Column, avoid) -> Column:
    """Whether a profile's avoided title words rule the level out; interns always are."""
    words = F.lit(" ".join(avoid))
    rules = {"staff": "staff|principal", "management": "head of|engineering manager|director|vp", "senior": r"\bsenior\b"}
    blocked = F.when(level == "intern", True)
    for name, pattern in rules.items():
        blocked = blocked.when(level == name, words.rlike(pattern))
    return F.coalesce(blocked, F.lit(False))


def matchable(text: Column) -> Column:
    """Typographic quotes as ASCII, no accents, white space collapsed."""
    plain = F.translate(_text(text), "‘’ʼ′´`“”″", "''''''\"\"\"")
    return F.regexp_replace(fold_accents(plain), r"[\s ]+", " ")


def liveness(status: Column, html: Column) -> Column:
    """expired, active or uncertain, from a page's status and text."""
    return F.when(status.isin(404, 410), "expired").when(~status.eqNullSafe(F.lit(200)), "uncertain").when(matchable(html).rlike(_any(CLOSED)), "expired").otherwise("active")


def company_name(name: Column) -> Column:
    """A company's name without accents, company forms and anything but a-z and 0-9."""
    plain = F.regexp_replace(F.lower(fold_accents(_text(name))), COMPANY_FORMS, " ")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def collapsed_name(name: Column) -> Column:
    return F.replace(company_name(name), F.lit(" "), F.lit(""))


def slug_candidates(name: Column) -> Column:
    """The board names a company may have: its words joined, and hyphenated where there are several; none under four characters."""
    words = F.filter(F.split(company_name(name), " "), lambda w: w != "")
    joined = F.array_join(words, "")
    both = F.when(F.size(words) > 1, F.array(joined, F.array_join(words, "-"))).otherwise(F.array(joined))
    return F.when(F.length(joined) >= 4, both).otherwise(F.array().cast("array<string>"))


def names_match(a: Column, b: Column) -> Column:
    """Equal, or one within the other; an empty name matches nothing."""
    a, b = collapsed_name(a), collapsed_name(b)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def titled_token(token: Column) -> Column:
    """A board's token as a name: what stands before ``@``, separators to spaces, each word's first letter in upper case."""
    words = F.filter(F.split(F.substring_index(token, "@", 1), "[-_. ]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def location_key(location: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(location), r"[\s ]+", " "))


def country_of(location: Column, gazetteer: dict[str, str], codes) -> Column:
    """The country code of a location, null where none is known.

    The last segment that the gazetteer (place name to code, in order) or
    ``codes`` knows wins; else the first gazetteer name of four letters or
    more that the text holds.
    """
    plain = F.regexp_replace(location_key(location), r"\(.*?\)", " ")
    entries = [x for name, code in gazetteer.items() for x in (F.lit(name), F.lit(code))]
    places = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    known = sorted(set(codes) | {"us"})
    parts = F.reverse(F.transform(F.split(plain, "[,;/|·–—-]"), lambda s: F.trim(s)))
    hits = F.transform(parts, lambda s: F.coalesce(F.try_element_at(places, s), F.when(s.isin(known), s)))
    names = [n for n in gazetteer if len(n) >= 4]
    inside = F.coalesce(*(F.when(F.contains(plain, F.lit(n)), F.lit(gazetteer[n])) for n in names)) if names else F.lit(None).cast("string")
    return F.when(location.isNull() | F.trim(plain).rlike(NO_PLACE), F.lit(None).cast("string")).otherwise(F.coalesce(F.try_element_at(F.array_compact(hits), F.lit(1)), inside))


def country_passes(country: Column, accept, names: dict[str, str], regions: dict[str, list[str]], synonyms: dict[str, str], gazetteer: dict[str, str]) -> Column:
    """Whether an accept list of codes, names, regions and places grants a country; the list becomes a set of codes first."""
    granted = set()
    for entry in (a.lower().strip() for a in accept):
        granted |= {entry} if entry in names or len(entry) == 2 else set()
        granted |= {code for code, name in names.items() if name.lower() == entry}
        granted |= set(regions.get(entry, ())) | set(regions.get(synonyms.get(entry, ""), ()))
        granted |= {gazetteer[entry]} if entry in gazetteer else set()
    return F.coalesce(country.isin(sorted(granted)), F.lit(False)) if granted else F.lit(False)


def moment(value: Column) -> Column:
    """A timestamp from epoch seconds, epoch milliseconds or text; null where it is none."""
    number = value.try_cast("double")
    plain = F.regexp_replace(value, "^[A-Za-z]{3}, ", "")  # a weekday says nothing that the date doesn't
    text = F.coalesce(F.try_to_timestamp(value), *(F.try_to_timestamp(plain, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy")))
    return F.when(number.isNull(), text).when(number < 1e12, F.timestamp_micros((number * 1e6).cast("long"))).otherwise(F.timestamp_micros((number * 1e3).cast("long")))


def first_of(columns) -> Column:
    """The first value that is neither null nor empty."""
    return reduce(lambda a, b: F.coalesce(a, b), [F.nullif(c, F.lit("")) for c in columns])
