"""Feeds of aggregators, by source. The page's ``region`` is the country code that was asked for, where one was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.detect import moment
from tessera.sources.boards import Board, blocks, joined, kept, plain, says, tag, truthy

#: Names of countries that a feed leaves to its own site.
COUNTRY_NAMES = {"at": "Austria", "be": "Belgium", "ch": "Switzerland", "cz": "Czechia", "de": "Germany", "dk": "Denmark", "es": "Spain", "fi": "Finland", "fr": "France", "ie": "Ireland", "it": "Italy", "lu": "Luxembourg", "nl": "Netherlands", "no": "Norway", "pl": "Poland", "pt": "Portugal", "se": "Sweden"}
_MODES = "'remote', 'hybrid', 'onsite'"
_URL = r"r'^https?://'"


def _span(low: str, high: str, unit: str = "''") -> str:
    """SQL for ``low–high unit``; null without a lower bound."""
    return f"case when {low} is not null then trim(concat({low}, '–', coalesce({high}, {low}), ' ', coalesce({unit}, ''))) end"


def _both(low: str, high: str, before: str, after: str) -> str:
    return f"case when {truthy(low)} and {truthy(high)} then concat({before}, {low}, '-', {high}, {after}) end"


def _in(city: str, country: str) -> str:
    return f"case when {city} <> '' then concat({city}, ', {country}') else '{country}' end"


def _mode(value: str) -> str:
    return f"case when lower({value}) in ({_MODES}) then lower({value}) end"


def _last(url: str) -> str:
    return f"element_at(filter(split({url}, '/'), x -> x <> ''), -1)"


def _titled_words(text: str) -> str:
    return f"array_join(transform(split(replace({text}, '-', ' '), ' '), w -> concat(upper(substring(w, 1, 1)), substring(w, 2))), ' ')"


def _visa_board(country: str, site: str, currency: str) -> dict:
    """Two boards run on one engine."""
    says_visa = "case j.hasVisaSponsorship when 'Yes' then 'yes' when 'No' then 'no' end"
    return {
        "rows": "b", "wanted": f"j._id <> '' and j.name <> '' and not {truthy('j.isPaused')} and (j.redirectJobUrl <> '' or j.jobUrl <> '')", "html": (), "titled": False,
        "schema": "array<struct<_id:string,name:string,isPaused:string,annualSalaryFrom:string,annualSalaryTo:string,workplace:string,hasVisaSponsorship:string,expLevel:string,company:string,actualCity:string,technologies:array<string>,jobType:string,language:string,redirectJobUrl:string,jobUrl:string,activeFrom:string>>",
        "fields": {
            "external_id": "j._id", "url": f"coalesce(nullif(j.redirectJobUrl, ''), concat('{site}/jobs/', j.jobUrl))", "title": "j.name", "company": "j.company", "location": _in("j.actualCity", country), "remote": "lower(j.workplace) = 'remote'", "work_mode": _mode("j.workplace"),
            "salary_text": _span("j.annualSalaryFrom", "j.annualSalaryTo", f"'{currency}'"), "posted_at": "j.activeFrom", "visa": says_visa,
            "description": f"concat_ws(' ', concat(coalesce(j.expLevel, ''), ' ', j.name, ' at ', coalesce(j.company, '?'), ' (', coalesce(j.actualCity, '{country}'), ').'), case when size(j.technologies) > 0 then concat('Technologies: ', array_join(j.technologies, ', '), '.') end, "
            f"concat(nullif(j.jobType, ''), '.'), concat('Working language: ', nullif(j.language, ''), '.'), case when {says_visa} = 'yes' then 'Visa sponsorship for non-EU residents.' end)",
        },
    }


def _board(name: str, rows: str, fields: dict, schema: str | None = None, **more) -> Board:
    return Board(name, rows, fields, schema, **({"keep": "first", "titled": False, "tokened": False} | more))


_ITEMS = blocks("item")
_LINKED = f"{tag('link')} <> '' and {tag('title')} <> ''"
_TITLE = plain(tag("title"))
_NET = plain(plain(tag("description")))
_ADDRESS = "get(j.stellenlokationen, 0).adresse"
_HN = plain("replace(replace(replace(replace(replace(replace(replace(replace(j.text, '&#x2F;', '/'), '&#x2f;', '/'), '&#x27;', '\\''), '&quot;', '\"'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&'), '<p>', ' <p>')")
_PARTS = f"filter(transform(split({_HN}, '[|]'), x -> trim(x)), x -> x <> '')"
_DUTCH = "coalesce(get_json_object(j.vacaturefunctie, '$.naam'), j.vacaturefunctie)"
_GREEN = rf"regexp_replace({_TITLE}, r' - (?!.* - ).*$', '')"
_PAREN = rf"regexp_extract({_GREEN}, r'\(([^()]+)\)\s*$', 1)"
_PLACED = rf"({_PAREN} <> '' and not {_PAREN} rlike r'(?i)^[mwfdx/\s]+$')"
_GREENLINK = r"""replace(regexp_extract(j, r'(?i)<link[^>]+href="([^"]+)"', 1), '&amp;', '&')"""
_INDEED_PLACE = "coalesce(get_json_object(j.location, '$.formattedAddressShort'), case when j.location like '{%' then concat_ws(', ', nullif(get_json_object(j.location, '$.city'), ''), nullif(get_json_object(j.location, '$.countryCode'), '')) else j.location end)"
_EMPLOYER = f"get(filter(array(j.originalApplyUrl, j.externalApplyUrl, j.thirdPartyApplyUrl, j.applyUrl), u -> u rlike {_URL} and not u rlike r'(?i)indeed[.]com'), 0)"
_SHORT = 8000

FEEDS: dict[str, Board] = {
    "arbeitnow": _board("arbeitnow", "b.data", {"external_id": "j.slug", "url": "j.url", "title": "j.title", "company": "j.company_name", "location": "j.location", "remote": truthy("j.remote"), "description": "j.description", "posted_at": "j.created_at"},
        "data array<struct<slug:string,url:string,title:string,company_name:string,location:string,remote:string,description:string,created_at:string>>", wanted="j.slug <> '' and j.url <> '' and j.title <> ''"),
    "remotive": _board("remotive", "b.jobs", {"external_id": "j.id", "url": "j.url", "title": "j.title", "company": "j.company_name", "location": "j.candidate_required_location", "remote": "true", "salary_text": "j.salary", "description": "j.description", "posted_at": "j.publication_date"},
        "jobs array<struct<id:string,url:string,title:string,company_name:string,candidate_required_location:string,salary:string,description:string,publication_date:string>>", keep="all"),
    "remoteok": _board("remoteok", "slice(b, 2, greatest(size(b) - 1, 0))", {"external_id": "coalesce(j.id, j.slug)", "url": "coalesce(j.url, j.apply_url)", "title": "coalesce(j.position, j.title)", "company": "j.company", "location": "coalesce(j.location, 'Remote')", "remote": "true",
        "salary_text": _both("j.salary_min", "j.salary_max", "'$'", "''"), "description": "j.description", "posted_at": "j.date"},
        "array<struct<id:string,slug:string,url:string,apply_url:string,position:string,title:string,company:string,location:string,salary_min:string,salary_max:string,description:string,date:string>>", keep="all"),
    "jobicy": _board("jobicy", "b.jobs", {"external_id": "j.id", "url": "j.url", "title": "j.jobTitle", "company": "j.companyName", "location": "j.jobGeo", "remote": "true", "salary_text": _both("j.salaryMin", "j.salaryMax", "coalesce(j.salaryCurrency, '')", "concat('/', coalesce(j.salaryPeriod, ''))"),
        "description": "coalesce(nullif(j.jobDescription, ''), j.jobExcerpt)", "posted_at": "j.pubDate"},
        "jobs array<struct<id:string,url:string,jobTitle:string,companyName:string,jobGeo:string,salaryMin:string,salaryMax:string,salaryCurrency:string,salaryPeriod:string,jobDescription:string,jobExcerpt:string,pubDate:string>>"),
    "himalayas": _board("himalayas", "b.jobs", {"external_id": "j.guid", "url": "coalesce(nullif(j.applicationLink, ''), j.guid)", "title": "j.title", "company": "j.companyName", "location": "coalesce(nullif(array_join(j.locationRestrictions, ', '), ''), 'Remote')", "remote": "true",
        "salary_text": _both("j.minSalary", "j.maxSalary", "coalesce(j.currency, '')", "concat('/', coalesce(j.salaryPeriod, ''))"), "description": "coalesce(nullif(j.description, ''), j.excerpt)", "posted_at": "j.pubDate"},
        "jobs array<struct<guid:string,applicationLink:string,title:string,companyName:string,locationRestrictions:array<string>,minSalary:string,maxSalary:string,currency:string,salaryPeriod:string,description:string,excerpt:string,pubDate:string>>", wanted="j.guid <> '' and j.title <> ''"),
    "weworkremotely": _board("weworkremotely", _ITEMS, {"external_id": _last(tag("link")), "url": tag("link"), "title": f"case when {_TITLE} like '%:%' then substring({_TITLE}, instr({_TITLE}, ':') + 1) else {_TITLE} end", "company": f"case when {_TITLE} like '%:%' then trim(substring_index({_TITLE}, ':', 1)) end",
        "location": f"coalesce(nullif({tag('region')}, ''), 'Remote')", "remote": "true", "description": tag("description"), "posted_at": tag("pubDate")}, wanted=f"{tag('link')} <> ''"),
    "freehire": _board("freehire", "b.data", {"external_id": "j.public_slug", "url": "j.url", "title": "j.title", "company": "coalesce(j.company, j.company_slug)", "location": "j.location", "remote": "j.work_mode = 'remote'", "work_mode": f"case when j.work_mode in ({_MODES}) then j.work_mode end",
        "salary_text": _span("j.enrichment.salary_min", "j.enrichment.salary_max", "j.enrichment.salary_currency"), "description": "j.description", "posted_at": "j.posted_at"},
        "data array<struct<public_slug:string,url:string,title:string,company:string,company_slug:string,location:string,work_mode:string,enrichment:struct<salary_min:string,salary_max:string,salary_currency:string>,description:string,posted_at:string>>", wanted="j.public_slug <> '' and j.url <> '' and j.title <> ''", html=("description", "title")),
    "arbeitsagentur": _board("arbeitsagentur", "b.ergebnisliste", {"external_id": "j.referenznummer", "url": "concat('https://www.arbeitsagentur.de/jobsuche/jobdetail/', url_encode(j.referenznummer))", "title": "j.stellenangebotsTitel", "company": "j.firma",
        "location": f"concat_ws(', ', nullif({_ADDRESS}.ort, ''), case when coalesce({_ADDRESS}.land, '') in ('', 'DEUTSCHLAND') then 'Germany' else {_ADDRESS}.land end)", "salary_text": _span("j.gehaltsspanneVon", "j.gehaltsspanneBis", "'EUR'"), "posted_at": "coalesce(j.datumErsteVeroeffentlichung, j.aenderungsdatum)"},
        "ergebnisliste array<struct<referenznummer:string,stellenangebotsTitel:string,firma:string,stellenlokationen:array<struct<adresse:struct<ort:string,land:string>>>,gehaltsspanneVon:string,gehaltsspanneBis:string,datumErsteVeroeffentlichung:string,aenderungsdatum:string>>", wanted="j.referenznummer <> '' and j.stellenangebotsTitel <> ''"),
    "eures": _board("eures", "b.jvs", {"external_id": "j.id", "url": "concat('https://europa.eu/eures/portal/jv-se/jv-details/', url_encode(j.id), '?lang=en')", "title": "j.title", "company": "j.employer.name",
        "location": "coalesce(try_element_at(map(" + ", ".join(f"'{c}', '{n}'" for c, n in COUNTRY_NAMES.items()) + "), region), upper(region))", "description": "j.description", "posted_at": "coalesce(j.creationDate, j.lastModificationDate)"},
        "jvs array<struct<id:string,title:string,employer:struct<name:string>,description:string,creationDate:string,lastModificationDate:string>>", wanted="j.id <> '' and j.title <> ''", html=("description", "title")),
    "sweden-jobtech": _board("sweden-jobtech", "b.hits", {"external_id": "j.id", "url": "coalesce(nullif(j.application_details.url, ''), j.webpage_url)", "title": "j.headline", "company": "j.employer.name", "location": _in("j.workplace_address.municipality", "Sweden"), "description": "j.description.text", "posted_at": "j.publication_date"},
        "hits array<struct<id:string,headline:string,application_details:struct<url:string>,webpage_url:string,employer:struct<name:string>,workplace_address:struct<municipality:string>,description:struct<text:string>,publication_date:string>>", wanted="j.id <> '' and j.headline <> '' and coalesce(nullif(j.application_details.url, ''), j.webpage_url) <> ''"),
    "denmark-jobnet": _board("denmark-jobnet", "b.jobAds", {"external_id": "j.jobAdId", "url": "concat('https://jobnet.dk/find-job/', j.jobAdId)", "title": "j.title", "company": "j.hiringOrgName", "location": _in("coalesce(nullif(j.postalDistrictName, ''), j.municipality)", "Denmark"), "description": "j.description", "posted_at": "j.publicationDate"},
        "jobAds array<struct<jobAdId:string,title:string,hiringOrgName:string,postalDistrictName:string,municipality:string,description:string,publicationDate:string>>", wanted="j.jobAdId <> '' and j.title <> ''"),
    "hn-whoishiring": _board("hn-whoishiring", "b.children", {"external_id": "j.id", "url": rf"""coalesce(get(filter(transform(regexp_extract_all(j.text, r'(?i)<a href="([^"]+)"', 1), u -> replace(replace(u, '&#x2F;', '/'), '&amp;', '&')), u -> u rlike {_URL} and not u rlike r'^https?://(news[.]ycombinator|hn[.]algolia)'), 0), concat('https://news.ycombinator.com/item?id=', j.id))""",
        "title": f"substring(case when size({_PARTS}) > 1 then array_join(slice({_PARTS}, 2, size({_PARTS})), ' | ') else {_HN} end, 1, 200)", "company": f"substring({_PARTS}[0], 1, 80)", "remote": rf"{_HN} rlike r'(?i)\bremote\b'", "description": f"substring({_HN}, 1, {_SHORT})", "posted_at": "j.created_at"},
        "children array<struct<id:string,text:string,created_at:string>>", wanted=f"j.id <> '' and length(j.text) >= 60 and size({_PARTS}) > 0", html=()),
    "landingjobs": _board("landingjobs", "b", {"external_id": "j.id", "url": "j.url", "title": "j.title", "company": _titled_words("regexp_extract(j.url, '/at/([^/]+)/', 1)"), "location": "coalesce(nullif(array_join(filter(transform(j.locations, l -> case when l like '{%' then concat_ws(', ', nullif(get_json_object(l, '$.city'), ''), nullif(upper(get_json_object(l, '$.country_code')), '')) else l end), x -> x <> ''), '; '), ''), 'Portugal')",
        "remote": truthy("j.remote"), "salary_text": _span("j.gross_salary_low", "j.gross_salary_high", "j.currency_code"), "description": joined("j.role_description", "j.main_requirements", "j.nice_to_have", "j.perks", by="\\n"), "posted_at": "j.published_at", "visa": "case when j.relocation_paid = 'true' then 'yes' end"},
        "array<struct<id:string,url:string,title:string,locations:array<string>,remote:string,gross_salary_low:string,gross_salary_high:string,currency_code:string,role_description:string,main_requirements:string,nice_to_have:string,perks:string,published_at:string,relocation_paid:string>>", wanted="j.id <> '' and j.title <> '' and j.url <> ''"),
    "swissdevjobs": Board("swissdevjobs", **_visa_board("Switzerland", "https://swissdevjobs.ch", "CHF"), tokened=False),
    "germantechjobs": Board("germantechjobs", **_visa_board("Germany", "https://germantechjobs.de", "EUR"), tokened=False),
    "berlinstartupjobs": _board("berlinstartupjobs", _ITEMS, {"external_id": _last(tag("link")), "url": tag("link"), "title": f"substring_index({_TITLE}, '//', 1)", "company": rf"trim(coalesce(get(split({_TITLE}, r'\s*//\s*'), 1), ''))", "location": "'Berlin, Germany'", "description": tag("content:encoded", "description"), "posted_at": tag("pubDate")}, wanted=_LINKED, keep="all"),
    "manfred": _board("manfred", "b", {"external_id": "j.id", "url": "concat('https://www.getmanfred.com/en/job-offers/', j.id, '/', coalesce(j.slug, ''))", "title": "j.position", "company": "j.company.name", "location": "coalesce(nullif(array_join(filter(j.locations, x -> x <> ''), '; '), ''), 'Spain')", "remote": "coalesce(j.remotePercentage, 0) >= 100",
        "work_mode": "case when coalesce(j.remotePercentage, 0) >= 100 then 'remote' when coalesce(j.remotePercentage, 0) > 0 then 'hybrid' else 'onsite' end", "salary_text": f"case when {truthy('j.salaryTo')} then concat(case when {truthy('j.salaryFrom')} then j.salaryFrom else '?' end, '–', j.salaryTo, ' ', coalesce(j.currency, '€')) end", "posted_at": "j.updatedAt"},
        "array<struct<id:string,slug:string,position:string,status:string,company:struct<name:string>,locations:array<string>,remotePercentage:double,salaryFrom:string,salaryTo:string,currency:string,updatedAt:string>>", wanted="j.id <> '' and j.position <> '' and j.status = 'ACTIVE'"),
    "netempregos": _board("netempregos", _ITEMS, {"external_id": rf"coalesce(nullif(regexp_extract({tag('link')}, r'/(\d+)/', 1), ''), {tag('link')})", "url": tag("link"), "title": _TITLE, "company": rf"trim(regexp_extract({_NET}, r'(?s)Empresa:\s*(.*?)(?:Categoria:|Zona:|Data:|$)', 1))",
        "location": _in(rf"trim(regexp_extract({_NET}, r'(?s)Zona:\s*(.*?)(?:Empresa:|Categoria:|Data:|$)', 1))", "Portugal"), "remote": says(_TITLE, _NET, word="teletrabalho|remoto|remote"), "description": _NET, "posted_at": tag("pubDate")},
        wanted=_LINKED + f" and {_NET} rlike '(?i)inform.tica|programa..o|tecnolog|telecomunica|internet|multim.dia|engenharia'", html=(), keep="all"),
    "wttj": _board("wttj", "b.hits", {"external_id": "concat(j.organization.slug, '/', j.slug)", "url": "concat('https://www.welcometothejungle.com/en/companies/', j.organization.slug, '/jobs/', j.slug)", "title": "j.name", "company": "trim(j.organization.name)", "location": "concat_ws(', ', nullif(get(j.offices, 0).city, ''), nullif(get(j.offices, 0).country, ''))",
        "remote": "j.remote = 'fulltime'", "work_mode": "case j.remote when 'fulltime' then 'remote' when 'partial' then 'hybrid' end", "salary_text": "case when j.salary_yearly_minimum > 0 then concat(cast(j.salary_yearly_minimum as bigint), case when j.salary_period = 'yearly' and j.salary_maximum > 0 then concat('–', cast(j.salary_maximum as bigint)) else '+' end, ' ', upper(coalesce(j.salary_currency, ''))) end",
        "description": "j.profile", "posted_at": "case when cast(j.published_at_timestamp as double) > 0 then j.published_at_timestamp end"},
        "hits array<struct<name:string,slug:string,organization:struct<slug:string,name:string>,offices:array<struct<city:string,country:string>>,remote:string,salary_yearly_minimum:double,salary_maximum:double,salary_period:string,salary_currency:string,profile:string,published_at_timestamp:string>>",
        wanted="trim(j.name) <> '' and j.slug rlike '(?i)^[a-z0-9_-]+$' and j.organization.slug rlike '(?i)^[a-z0-9_-]+$'", html=()),
    "vdab": _board("vdab", "b.resultaten", {"external_id": "coalesce(get_json_object(j.id, '$.id'), j.id)", "url": "concat('https://www.vdab.be/vindeenjob/vacatures/', coalesce(get_json_object(j.id, '$.id'), j.id))", "title": _DUTCH, "company": "trim(j.vacatureBedrijfsnaam)",
        "location": _in("coalesce(get_json_object(coalesce(j.tewerkstellingsLocatieRegioOfAdres, j.locatie), '$.naam'), j.tewerkstellingsLocatieRegioOfAdres, j.locatie)", "Belgium"), "posted_at": "j.eerstePublicatieDatum"},
        "resultaten array<struct<id:string,vacaturefunctie:string,gesloten:string,vacatureBedrijfsnaam:string,tewerkstellingsLocatieRegioOfAdres:string,locatie:string,eerstePublicatieDatum:string>>", wanted=f"j.id <> '' and trim({_DUTCH}) <> '' and not {_DUTCH} like '{{%' and not coalesce(j.gesloten = 'true', false)", titled=True, html=()),
    "justjoin": _board("justjoin", "b.data", {"external_id": "j.slug", "url": "concat('https://justjoin.it/job-offer/', j.slug)", "title": "j.title", "company": "trim(j.companyName)", "location": _in("j.city", "Poland"), "remote": "j.workplaceType = 'remote'", "work_mode": "case j.workplaceType when 'remote' then 'remote' when 'hybrid' then 'hybrid' when 'office' then 'onsite' end",
        "description": "concat_ws(', ', trim(j.title), j.requiredSkills)", "posted_at": "j.publishedAt"}, "data array<struct<slug:string,title:string,companyName:string,city:string,workplaceType:string,requiredSkills:array<string>,publishedAt:string>>", wanted="trim(j.slug) <> '' and trim(j.title) <> ''", keep="all", html=()),
    "nofluffjobs": _board("nofluffjobs", "b.postings", {"external_id": "coalesce(j.url, j.id)", "url": "concat('https://nofluffjobs.com/pl/job/', coalesce(j.url, j.id))", "title": "j.title", "company": "trim(j.name)", "location": _in("case when not get(j.location.places, 0).city rlike '(?i)remote' then get(j.location.places, 0).city end", "Poland"),
        "remote": f"{truthy('j.fullyRemote')} or {says('get(j.location.places, 0).city')}", "salary_text": "case when j.salary.from > 0 then concat(cast(j.salary.from as bigint), '–', cast(coalesce(j.salary.to, j.salary.from) as bigint), ' ', coalesce(j.salary.currency, 'PLN'), '/', coalesce(j.salary.type, 'month')) end",
        "description": "concat_ws(', ', trim(j.title), j.tiles.values.value)", "posted_at": "j.posted"},
        "postings array<struct<id:string,url:string,title:string,name:string,location:struct<places:array<struct<city:string>>>,fullyRemote:string,salary:struct<`from`:double,`to`:double,currency:string,type:string>,tiles:struct<`values`:array<struct<value:string>>>,posted:string>>", wanted="trim(j.title) <> '' and trim(coalesce(j.url, j.id)) <> ''", html=()),
    "thehub": _board("thehub", "b.jobs.docs", {"external_id": "coalesce(j.id, j.key)", "url": "concat('https://thehub.io/jobs/', url_encode(coalesce(j.id, j.key)))", "title": "j.title", "company": "trim(j.company.name)", "location": f"coalesce(nullif(trim(j.location.address), ''), {joined('j.location.locality', 'j.location.country')})", "remote": truthy("j.isRemote")},
        "jobs struct<docs:array<struct<id:string,key:string,title:string,company:struct<name:string>,location:struct<address:string,locality:string,country:string>,isRemote:string>>>", wanted="trim(j.title) <> '' and coalesce(j.id, j.key) <> ''", titled=True, html=()),
    "agenticjobs": _board("agenticjobs", "b.data", {"external_id": "j.slug", "url": "concat('https://agentic-engineering-jobs.com/jobs/', j.slug)", "title": "j.title", "company": "trim(j.companyName)", "location": "trim(coalesce(j.location, j.city))", "remote": "lower(j.locationType) = 'remote'", "work_mode": _mode("j.locationType"),
        "salary_text": f"case when {truthy('j.salaryMin')} then {_span('j.salaryMin', 'j.salaryMax', 'j.salaryCurrency')} end", "description": "j.description", "posted_at": "j.postedAt", "visa": "case when j.visaSponsorship = 'true' then 'yes' end"},
        "data array<struct<slug:string,title:string,companyName:string,location:string,city:string,locationType:string,salaryMin:string,salaryMax:string,salaryCurrency:string,description:string,postedAt:string,visaSponsorship:string>>", wanted="trim(j.title) <> '' and j.slug rlike '^[A-Za-z0-9_-]+$'", titled=True),
    "a16z-speedrun": _board("a16z-speedrun", "b.jobs", {"external_id": "coalesce(j.id, j.url)", "url": "j.url", "title": "j.title", "company": "coalesce(nullif(trim(coalesce(j.company, j.company_slug)), ''), 'SPEEDRUN portfolio (stealth)')", "location": "trim(j.location)", "remote": f"{truthy('j.remote')} or coalesce(lower(j.workplace_type) = 'remote', false)",
        "work_mode": _mode("j.workplace_type"), "salary_text": f"case when {truthy('j.comp_min')} then trim(concat(j.comp_min, '–', coalesce(j.comp_max, j.comp_min), ' ', coalesce(j.comp_currency, ''), '/', coalesce(j.comp_period, 'year'))) end", "description": "j.description", "posted_at": "j.posted_at"},
        "jobs array<struct<id:string,url:string,title:string,company:string,company_slug:string,location:string,remote:string,workplace_type:string,comp_min:string,comp_max:string,comp_currency:string,comp_period:string,description:string,posted_at:string>>", wanted="trim(j.title) <> '' and j.url like 'https://%'", titled=True),
    "workingnomads": _board("workingnomads", "transform(b.hits.hits, x -> x._source)", {"external_id": "coalesce(j.id, j.slug)", "url": "case when j.apply_url like 'http%' then j.apply_url else concat('https://www.workingnomads.com/jobs/', j.slug) end", "title": "j.title", "company": "trim(j.company)", "location": "coalesce(nullif(coalesce(j.location_base, j.locations), ''), 'Remote')", "remote": "true",
        "work_mode": "'remote'", "salary_text": "j.salary_range", "description": "j.description", "posted_at": "j.pub_date"},
        "hits struct<hits:array<struct<_source:struct<id:string,slug:string,title:string,company:string,apply_url:string,location_base:string,locations:string,salary_range:string,description:string,pub_date:string>>>>", wanted="trim(j.title) <> '' and trim(j.slug) <> ''"),
    "jobindexdk": _board("jobindexdk", _ITEMS, {"external_id": rf"coalesce(nullif(regexp_extract({tag('link')}, '(?i)/vis-job/([a-z0-9]+)', 1), ''), {tag('link')})", "url": tag("link"), "title": _TITLE, "company": f"case when {_TITLE} like '%,%' then trim(element_at(split({_TITLE}, ','), -1)) end", "location": "'Denmark'", "description": plain(tag("description")), "posted_at": tag("pubDate")}, wanted=_LINKED),
    "greenjobsde": _board("greenjobsde", blocks("entry"), {"external_id": rf"coalesce(nullif(regexp_extract({_GREENLINK}, r'id=(\d+)', 1), ''), {_GREENLINK})", "url": _GREENLINK, "title": rf"case when {_PLACED} then regexp_replace({_GREEN}, r'\s*\([^()]+\)\s*$', '') else {_GREEN} end",
        "company": f"case when {_TITLE} like '% - %' then trim(element_at(split({_TITLE}, ' - '), -1)) else 'greenjobs.de' end", "location": f"case when {_PLACED} then trim({_PAREN}) end", "remote": says(_TITLE, word=r"remote|home\s*office|bundesweit"), "description": _TITLE, "posted_at": tag("updated")}, wanted=f"{_TITLE} <> '' and {_GREENLINK} <> ''", html=()),
    "themuse": _board("themuse", "b.results", {"external_id": "j.id", "url": "j.refs.landing_page", "title": "j.name", "company": "j.company.name", "location": "array_join(slice(filter(j.locations.name, x -> x <> ''), 1, 4), '; ')", "remote": says("array_join(j.locations.name, '; ')", word="flexible|remote"), "description": f"substring({plain('j.contents')}, 1, {_SHORT})", "posted_at": "j.publication_date"},
        "results array<struct<id:string,name:string,refs:struct<landing_page:string>,company:struct<name:string>,locations:array<struct<name:string>>,contents:string,publication_date:string>>", wanted="j.id <> '' and j.name <> '' and j.refs.landing_page <> ''", titled=True, html=()),
    "duunitori": _board("duunitori", "b.results", {"external_id": "j.slug", "url": "concat('https://duunitori.fi/tyopaikat/tyo/', j.slug)", "title": "j.heading", "company": "coalesce(j.company_name, j.company.name)", "location": "concat_ws(', ', nullif(j.municipality_name, ''), 'Finland')", "remote": says("j.heading", "j.descr", word="etätyö|remote"), "description": f"substring({plain('j.descr')}, 1, {_SHORT})", "posted_at": "j.date_posted"},
        "results array<struct<slug:string,heading:string,company_name:string,company:struct<name:string>,municipality_name:string,descr:string,date_posted:string>>", wanted="j.slug <> '' and j.heading <> ''", titled=True, html=()),
    "warpjobs": _board("warpjobs", "b.jobs", {"external_id": "coalesce(j.id, j.url, j.apply_url, j.link)", "url": "coalesce(j.url, j.apply_url, j.link)", "title": "j.title", "company": "coalesce(j.company, j.company_name)", "location": "coalesce(j.location, j.region)", "remote": f"{truthy('j.remote')} or {says('j.location')}", "salary_text": "j.salary",
        "description": f"substring({plain('j.description')}, 1, {_SHORT})", "posted_at": "coalesce(j.posted_at, j.date)", "visa": "case when j.visa_sponsor in ('true', 'yes') then 'yes' end"},
        "jobs array<struct<id:string,url:string,apply_url:string,link:string,title:string,company:string,company_name:string,location:string,region:string,remote:string,salary:string,description:string,posted_at:string,date:string,visa_sponsor:string>>", wanted="j.title <> '' and coalesce(j.url, j.apply_url, j.link) <> ''", titled=True, html=(), keep="all"),
    "aidevjobs": _board("aidevjobs", "coalesce(b.jobs, b.results, b.data)", {"external_id": "coalesce(j.id, j.apply_url, j.url, j.link)", "url": "coalesce(j.apply_url, j.url, j.link)", "title": "j.title", "company": "coalesce(j.company, j.company_name)", "location": "j.location", "remote": f"{truthy('j.remote')} or {says('j.location')}", "salary_text": "j.salary",
        "description": f"substring({plain('j.description')}, 1, {_SHORT})", "posted_at": "coalesce(j.posted_at, j.published_at)"},
        ", ".join(f"{k} array<struct<id:string,url:string,apply_url:string,link:string,title:string,company:string,company_name:string,location:string,remote:string,salary:string,description:string,posted_at:string,published_at:string>>" for k in ("jobs", "results", "data")), wanted="j.title <> '' and coalesce(j.apply_url, j.url, j.link) <> ''", titled=True, html=(), keep="all"),
    "wejob": _board("wejob", "b.data", {"external_id": "j.id", "url": "concat('https://wejob.ch', coalesce(j.links.self, concat('/jobs/', j.id)))", "title": "j.title", "company": "coalesce(j.company.name, j.company_name)", "location": "coalesce(j.location, j.city, 'Switzerland')", "remote": says("j.title", "j.description", word="remote|télétravail"),
        "description": f"substring({plain('j.description')}, 1, {_SHORT})", "posted_at": "coalesce(j.published_at, j.created_at)"},
        "data array<struct<id:string,title:string,links:struct<self:string>,company:struct<name:string>,company_name:string,location:string,city:string,description:string,published_at:string,created_at:string>>", wanted="j.id <> '' and j.title <> ''", titled=True, html=(), keep="all"),
    "adzuna": _board("adzuna", "b.results", {"external_id": "j.id", "url": "j.redirect_url", "title": "j.title", "company": "j.company.display_name", "location": "coalesce(j.location.display_name, upper(region))", "remote": says("j.title", "j.description", word="remote|work from home|home office"),
        "salary_text": "case when j.salary_min is not null then concat(cast(floor(j.salary_min + 0.5) as bigint), '–', cast(floor(coalesce(j.salary_max, j.salary_min) + 0.5) as bigint)) end", "description": "j.description", "posted_at": "j.created"},
        "results array<struct<id:string,redirect_url:string,title:string,company:struct<display_name:string>,location:struct<display_name:string>,salary_min:double,salary_max:double,description:string,created:string>>", html=("description", "title")),
    "jsearch": _board("jsearch", "b.data.jobs", {"external_id": "j.job_id", "url": "j.job_apply_link", "title": "j.job_title", "company": "j.employer_name", "location": f"coalesce(nullif({joined('j.job_city', 'j.job_country')}, ''), case when {truthy('j.job_is_remote')} then 'Remote' end)", "remote": truthy("j.job_is_remote"),
        "salary_text": "case when j.job_min_salary is not null then concat(cast(floor(j.job_min_salary + 0.5) as bigint), '–', cast(floor(coalesce(j.job_max_salary, j.job_min_salary) + 0.5) as bigint)) end", "description": "j.job_description", "posted_at": "j.job_posted_at_datetime_utc"},
        "data struct<jobs:array<struct<job_id:string,job_apply_link:string,job_title:string,employer_name:string,job_city:string,job_country:string,job_is_remote:string,job_min_salary:double,job_max_salary:double,job_description:string,job_posted_at_datetime_utc:string>>>", html=("description", "title")),
    "indeed": _board("indeed", "b", {"external_id": "coalesce(j.jobId, j.id, j.jobKey)", "url": f"coalesce({_EMPLOYER}, j.url, j.jobUrl, j.link)", "title": "j.title", "company": "coalesce(j.companyName, get_json_object(j.company, '$.name'), j.company)", "location": f"coalesce(nullif({_INDEED_PLACE}, ''), upper(region))", "remote": f"{truthy('coalesce(j.isRemote, j.remote)')} or {says(_INDEED_PLACE)}",
        "salary_text": "substring(coalesce(get_json_object(j.salary, '$.text'), case when not j.salary like '{%' then j.salary end), 1, 100)", "description": "coalesce(j.descriptionHtml, j.description, j.jobDescription)", "posted_at": "coalesce(j.postedAt, j.datePosted, j.pubDate)"},
        "array<struct<jobId:string,id:string,jobKey:string,url:string,jobUrl:string,link:string,originalApplyUrl:string,externalApplyUrl:string,thirdPartyApplyUrl:string,applyUrl:string,title:string,company:string,companyName:string,location:string,isRemote:string,remote:string,salary:string,descriptionHtml:string,description:string,jobDescription:string,postedAt:string,datePosted:string,pubDate:string>>",
        wanted=f"coalesce(j.jobId, j.id, j.jobKey) <> '' and j.title <> '' and coalesce({_EMPLOYER}, j.url, j.jobUrl, j.link) <> ''"),
}


def search_plan(groups: DataFrame, places: DataFrame) -> DataFrame:
    """Every search once: ``groups`` (keywords, lang) at ``places`` (location, lang, tier), English everywhere and a language where it is spoken."""
    spoken = places.withColumn("lang", F.explode(F.array_distinct(F.array(F.lit("en"), F.coalesce("lang", F.lit("en"))))))
    return groups.join(spoken, "lang").select("keywords", "location", "tier").distinct()


def feed_items(pages: DataFrame, label: Column, company_from: Column) -> DataFrame:
    """Postings of RSS or Atom feeds. ``company_from``: author, dash, or anything else for ``Title at Company`` first.

    The first posting of each link in a feed stays; items without a title or a link go.
    """
    kind = F.when(F.contains("body", F.lit("<entry")), "entry").otherwise("item")
    rows = pages.select("token", "page", label.alias("label"), company_from.alias("mode"), kind.alias("kind"), F.col("body").alias("b"))
    rows = rows.select("*", F.posexplode(F.expr(f"case when kind = 'entry' then {blocks('entry')} else {blocks('item')} end")).alias("i", "j")).drop("b")
    link = rf"""replace(coalesce(nullif(trim(regexp_extract(j, r'(?is)<link[^>]*>\s*(?:<!\[CDATA\[)?([^<]*?)(?:\]\]>)?\s*</link>', 1)), ''), regexp_extract(j, r'(?i)<link[^>]*href="([^"]+)"', 1)), '&amp;', '&')"""
    author = plain(tag("dc:creator", "author", "name"))
    rows = rows.select("token", "page", "i", "label", "mode", F.expr(_TITLE).alias("raw"), F.expr(link).alias("url"), F.expr(author).alias("author"), F.expr(plain(tag("description", "summary", "content", "content:encoded"))).alias("text"), F.expr(tag("pubDate", "published", "updated", "dc:date")).alias("date"))
    rows = rows.where((F.col("raw") != "") & F.col("url").startswith("http")).select("*", split_company(F.col("raw"), F.col("mode") == "dash").alias("s"))
    company = F.coalesce(F.nullif("s.company", F.lit("")), F.nullif("author", F.lit("")), F.col("label"))
    text = F.substring("text", 1, 4000)
    out = rows.select(
        F.col("token").alias("source"), F.substring(F.regexp_replace("url", "^https?://", ""), 1, 240).alias("external_id"), "url", F.col("s.title").alias("title"), company.alias("company"), F.lit("").alias("location"), F.col("raw").rlike("(?i)remote").alias("remote"),
        F.lit(None).cast("string").alias("work_mode"), F.lit(None).cast("string").alias("salary_text"), F.when(text != "", text).otherwise(F.col("raw")).alias("description"), moment(F.col("date")).alias("posted_at"), F.lit(None).cast("string").alias("visa"), F.struct("page", "i").alias("pos"),
    )
    return kept(out, "first")


def split_company(title: Column, dash_first: Column) -> Column:
    """struct<title, company> of ``Title at Company`` or ``Title - Company``; a tail that reads like a job is no company."""
    title = F.trim(title)
    at = r"(?i)^(.{3,}?)\s+at\s+(.{2,60})$"
    tail, head = F.trim(F.substring_index(title, " - ", -1)), F.trim(F.regexp_replace(title, " - (?!.* - ).*$", ""))
    dashed = F.contains(title, F.lit(" - ")) & (F.length(head) >= 3) & (F.length(tail) <= 60) & ~tail.rlike(r"(?i)\b(remote|engineer|developer|manager|senior|junior)\b")
    by_at = F.struct(F.trim(F.regexp_extract(title, at, 1)).alias("title"), F.trim(F.regexp_extract(title, at, 2)).alias("company"))
    by_dash, whole = F.struct(head.alias("title"), tail.alias("company")), F.struct(title.alias("title"), F.lit("").alias("company"))
    return F.when(dash_first & dashed, by_dash).when(title.rlike(at), by_at).when(dashed, by_dash).otherwise(whole)
