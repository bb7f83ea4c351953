"""Which board of which platform a URL belongs to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Path segments and host labels that are never boards.
NO_SEGMENTS = ("embed", "api", "static", "assets", "images", "img", "js", "css", "fonts", "sitemap", "cdn-cgi")
NO_LABELS = ("www", "api", "app", "auth", "blog", "careers", "cdn", "docs", "help", "mail", "email", "static", "assets", "status", "support", "jobs")
WEB_FILES = ("robots.txt", "favicon.ico", "sitemap.xml", "sitemap.txt", "ads.txt", "security.txt", "humans.txt", "manifest.json")
WORKABLE_LABELS = ("www", "apply", "jobs", "careers", "help", "support", "resources", "status", "api", "developers", "blog", "app", "auth", "id", "connect", "mail", "marketplace", "partners", "press", "learning")
GREENHOUSE_HOSTS = ("boards.greenhouse.io", "job-boards.greenhouse.io", "boards.eu.greenhouse.io", "job-boards.eu.greenhouse.io")
RULE = "^[a-z0-9][a-z0-9_-]{0,62}$"
#: Hosts that smell of a board, addresses in a text, words of a careers page.
SMELL = r"(?i)(^|\.)(jobs?|careers?|apply|recruiting|talent)\.|greenhouse|lever|ashby|workday|recruitee|personio|smartrecruiters|workable|bamboohr|breezy|teamtailor"
IN_TEXT = r"(?i)(?:https?:)?//[a-z0-9.-]+\.[a-z]{2,}[^\s\"'<>\\)]*"
CAREERS = r"(?i)career|jobs|join[-_]?us|vacanc|work[-_]?with|open[-_]?positions|stellen"
_LOCALE = "(?:[a-z]{2}-[a-z]{2,4}/)?"


@dataclass(frozen=True)
class Pattern:
    """``path``: a segment after ``prefix`` on one of ``hosts``. ``query``: the value of ``param``. ``label``: the single label before one of ``hosts``. ``whole``: groups of ``match`` on host/path put into ``form``."""

    platform: str
    kind: str
    hosts: tuple[str, ...] = ()
    deny: tuple[str, ...] = NO_SEGMENTS
    prefix: str = ""
    param: str = ""
    match: str = ""
    form: str = ""
    rule: str = RULE


def _labels(platform: str, *hosts: str, deny: tuple[str, ...] = ()) -> Pattern:
    return Pattern(platform, "label", hosts, NO_LABELS + deny)


#: In order: the first pattern that fits a URL wins.
PATTERNS = (
    Pattern("greenhouse", "path", GREENHOUSE_HOSTS),
    Pattern("greenhouse", "query", GREENHOUSE_HOSTS, param="for"),
    Pattern("lever", "path", ("jobs.lever.co", "jobs.eu.lever.co")),
    Pattern("ashby", "path", ("jobs.ashbyhq.com",), NO_SEGMENTS + WEB_FILES, rule="^[a-z0-9][a-z0-9 ._&'-]{0,80}$"),
    Pattern("smartrecruiters", "path", ("jobs.smartrecruiters.com", "careers.smartrecruiters.com")),
    Pattern("workable", "path", ("apply.workable.com",), NO_SEGMENTS + WEB_FILES + ("j",)),
    Pattern("workable", "label", ("workable.com",), WORKABLE_LABELS),
    _labels("recruitee", "recruitee.com"),
    _labels("personio", "jobs.personio.de", "jobs.personio.com"),
    Pattern("workday", "whole", match=rf"^([a-z0-9-]+)\.(wd\d+)\.myworkdayjobs\.com/(?i:{_LOCALE})(?!(?:wday|job)(?:/|$))([^/]+)", form="$1@$2/$3", rule=r"^[a-z0-9][a-z0-9-]*@wd\d+/[a-z0-9_.-]+$"),
    Pattern("workday", "whole", match=rf"^(wd\d+)\.myworkdaysite\.com/(?i:{_LOCALE})recruiting/([^/]+)/(?!(?:wday|job)(?:/|$))([^/]+)", form="$2@$1/$3", rule=r"^[a-z0-9][a-z0-9-]*@wd\d+/[a-z0-9_.-]+$"),
    _labels("bamboohr", "bamboohr.com", deny=("documentation",)),
    _labels("breezy", "breezy.hr"),
    _labels("pinpoint", "pinpointhq.com"),
    _labels("teamtailor", "teamtailor.com", deny=("integrations",)),
    Pattern("join", "path", ("join.com", "www.join.com"), prefix="companies"),
    Pattern("oracle", "whole", match=r"^((?:[a-z0-9-]+\.)*[a-z0-9-]+)\.oraclecloud\.com/(?i:hcmui)/(?:[^/]+/)*?(?i:sites)/([^/]+)", form="$1@$2", rule="^[a-z0-9][a-z0-9.-]*@[a-z0-9_-]+$"),
    _labels("eightfold", "eightfold.ai", deny=("app", "apply", "developer")),
    _labels("jibe", "jibeapply.com"),
    _labels("beesite", "app.beesite.de"),
    Pattern("rippling", "path", ("ats.rippling.com",)),
    Pattern("jobvite", "path", ("jobs.jobvite.com",)),
    _labels("softgarden", "softgarden.io"),
    Pattern("comeet", "whole", match=r"^(?:[^/]+\.)?comeet\.com/jobs/([^/]+)/(\d+\.[0-9A-Za-z]+)(?:/|$)", form="$1/$2", rule=r"^[a-z0-9][a-z0-9._-]*/\d+\.[0-9a-z]+$"),
    Pattern("csod", "whole", match=r"^([a-z0-9-]+)\.csod\.com/(?:[^/]*/)*?(?i:ux/ats/careersite)/(\d+)(?:/|$)", form="$1@$2", rule=r"^[a-z0-9][a-z0-9-]*@\d+$"),
)

HIT = "struct<platform:string,token:string,region:string,host:string>"


def _decoded(raw: Column) -> Column:
    """Percent-decoded; null where that fails. A plus stays a plus."""
    return F.when(raw.contains("%"), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))).otherwise(raw)


def _raw_token(p: Pattern, host: Column, path: Column, query: Column) -> Column:
    if p.kind == "path":
        segments = F.filter(F.split(path, "/"), lambda s: s != "")
        at = 1 if p.prefix else 0
        fits = host.isin(*p.hosts) & ((F.lower(F.get(segments, F.lit(0))) == p.prefix) if p.prefix else F.lit(True))
        raw = F.get(segments, F.lit(at))
        return F.when(fits & ~F.lower(raw).isin(*p.deny), raw)
    if p.kind == "query":
        found = F.regexp_extract(F.concat(F.lit("&"), query), f"&{p.param}=([^&]*)", 1)
        return F.when(host.isin(*p.hosts) & (found != ""), found)
    if p.kind == "label":
        ends = "|".join(h.replace(".", r"\.") for h in p.hosts)
        label = F.regexp_extract(host, rf"^([^.]+)\.(?:{ends})$", 1)
        return F.when((label != "") & ~label.isin(*p.deny), label)
    place = F.concat(host, F.regexp_replace(path, "/+", "/"))
    return F.when(place.rlike(p.match), F.regexp_replace(place, p.match + ".*$", p.form))


def board_of(url: Column, patterns: tuple[Pattern, ...] = PATTERNS) -> Column:
    """struct<platform, token, region, host> of the first pattern that fits; null for others and for what is no http URL.

    A token is percent-decoded, lower-cased, obeys its platform's rule, and is no version such as v1.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    path = F.regexp_extract(bare, r"^[^:]+://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    parts = F.struct(host.alias("host"), path.alias("path"), query.alias("query"))

    def first_hit(u: Column) -> Column:
        hits = []
        for p in patterns:
            token = F.lower(_decoded(_raw_token(p, u["host"], u["path"], u["query"])))
            entry = F.struct(F.lit(p.platform).alias("platform"), token.alias("token"), F.regexp_extract(u["host"], r"\.(eu)\.", 1).alias("region"), u["host"].alias("host"))
            hits.append(F.when(token.rlike(p.rule) & ~token.rlike(r"^v\d+$"), entry))
        return F.when(u["host"] != "", F.coalesce(*hits))

    # in a lambda the URL's parts are computed once, not once a pattern
    return F.get(F.transform(F.array(parts), first_hit), F.lit(0))


def smells_like_board(host: Column) -> Column:
    return F.coalesce(host.rlike(SMELL), F.lit(False))


def urls_in(text: Column) -> Column:
    """The distinct absolute URLs in a text, those without a scheme as https."""
    found = F.regexp_extract_all(text, F.lit(IN_TEXT), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)))


def scan(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, url, platform, token, region, host, smells) for every URL in ``text`` that is a board's, or smells like one."""
    from tessera.functions.text import host_of

    urls = df.select(ident, F.explode(urls_in(F.col(text))).alias("url"))
    rows = urls.select(ident, "url", board_of(F.col("url")).alias("hit"), host_of(F.col("url")).alias("at"))
    rows = rows.select(ident, "url", "hit.platform", "hit.token", "hit.region", F.coalesce("hit.host", "at").alias("host"), (F.col("hit").isNull() & smells_like_board(F.col("at"))).alias("smells"))
    return rows.where(F.col("platform").isNotNull() | F.col("smells"))


def career_links(html: Column, domain: Column, most: int = 2) -> Column:
    """The first distinct links of a page that stay on its site and look like a careers page."""
    found = F.regexp_extract_all(html, F.lit('(?i)href="([^"]+)"'), F.lit(1))

    def absolute(href: Column) -> Column:
        href = F.replace(href, F.lit("&amp;"), F.lit("&"))
        full = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(F.lit("https://"), domain, href)).otherwise(href)
        return F.regexp_replace(full, "#.*$", "")

    def wanted(link: Column) -> Column:
        host = F.lower(F.regexp_extract(link, r"^https?://([^/?#:]+)", 1))
        path = F.regexp_extract(link, r"^https?://[^/?]*([^?]*)", 1)
        own = (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))
        return (host != "") & own & F.concat(path, F.replace(host, F.concat(F.lit("."), domain), F.lit(""))).rlike(CAREERS)

    return F.slice(F.array_distinct(F.filter(F.transform(found, absolute), wanted)), 1, most)


def board_name(name: Column) -> Column:
    """struct<platform, token, region> of ``board:platform:token|region``; null for other names."""
    pattern = r"^board:([^:]+):(.+?)(?:\|([^|]*))?$"
    return F.when(name.rlike(pattern), F.struct(*(F.regexp_extract(name, pattern, i).alias(n) for i, n in ((1, "platform"), (2, "token"), (3, "region")))))


def host_collisions(df: DataFrame, host: str = "host", platform: str = "platform") -> DataFrame:
    """Hosts that more than one platform claims."""
    return df.groupBy(host).agg(F.count_distinct(platform).alias("platforms")).where("platforms > 1")


def probe_result(platform: Column, status: Column, body: Column) -> Column:
    """active or dead, from the answer of a board's own address.

    Some platforms answer 200 for boards that don't exist, so there a count decides.
    """
    counted = F.get_json_object(body, "$.totalFound").try_cast("long") > 0
    listed = F.get_json_object(body, "$.items[0].requisitionList[0]").isNotNull()
    open_ = F.get_json_object(body, "$.positions[0]").isNotNull()
    alive = F.when(platform == "smartrecruiters", counted).when(platform == "oracle", listed).when(platform == "eightfold", open_).otherwise(True)
    return F.when((status == 200) & F.coalesce(alive, F.lit(False)), "active").otherwise("dead")


#: Where a board's answer lists its postings and names its company; personio's is XML.
_LISTS = {"lever": "$", "ashby": "$.jobs", "workable": "$.jobs", "recruitee": "$.offers"}
_NAMES = {"greenhouse": "$.name", "workable": "$.name", "recruitee": "$.offers[0].company_name", "smartrecruiters": "$.content[0].company.name"}


def probe_count(platform: Column, status: Column, body: Column) -> Column:
    """How many postings a living board's answer holds; null where it doesn't say."""
    counts = F.when(platform == "smartrecruiters", F.get_json_object(body, "$.totalFound").try_cast("int")).when(platform == "personio", F.regexp_count(body, F.lit("<position>")))
    for name, path in _LISTS.items():
        counts = counts.when(platform == name, F.size(F.from_json(F.get_json_object(body, path), "array<string>")))
    return F.when((probe_result(platform, status, body) == "active") & (counts >= 0), counts)


def probe_name(platform: Column, status: Column, body: Column) -> Column:
    """The company's name in a living board's answer, where its platform gives one."""
    named = F.when(platform == "personio", F.nullif(F.trim(F.regexp_extract(body, "<subcompany>([^<]*)</subcompany>", 1)), F.lit("")))
    for name, path in _NAMES.items():
        named = named.when(platform == name, F.get_json_object(body, path))
    return F.when(probe_result(platform, status, body) == "active", named)
