"""One query a connector: pages made of the suppliers, a posting each, and in SQL what must come out.

``<i>`` in a page is the supplier's number, ``<c>`` a city (Oslo, Remote or
none), ``<b>`` true or false; in the SQL they are the columns i, c and b. The
SQL is written from what the connectors promise, not from their expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import query, read
from tessera.sources import aggregators, ats, boards

_CITY = "CASE s_suppkey % 3 WHEN 0 THEN 'Oslo' WHEN 1 THEN 'Remote' ELSE '' END"
_SQL = f"WITH v AS (SELECT CAST(s_suppkey AS VARCHAR) AS i, {_CITY} AS c, s_suppkey % 2 = 0 AS b FROM supplier)"


def _pages(spark: SparkSession, sf_dir: str, opening: str, item: str, closing: str, token: str, region: str) -> DataFrame:
    fills = {"<i>": F.col("s_suppkey").cast("string"), "<c>": F.expr(_CITY), "<b>": F.when(F.col("s_suppkey") % 2 == 0, "true").otherwise("false")}
    parts = [fills.get(p, F.lit(p)) for p in re.split("(<[icb]>)", item) if p]
    rows = read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.concat(*parts).alias("item"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "item"))), lambda s: s["item"])
    body = F.concat(F.lit(opening), F.array_join(items, ","), F.lit(closing))
    return rows.groupBy("s_nationkey").agg(body.alias("body")).select(F.lit(token).alias("token"), F.lit("Acme").alias("company"), F.lit(region).alias("region"), F.col("s_nationkey").cast("int").alias("page"), "body")


def _connector(kind: str, name: str, opening: str, item: str, closing: str, want: str, token: str = "acme") -> None:
    """``want``: the SQL of the columns that are compared."""
    columns = re.findall(r" AS (\w+)(?:,|$)", want)

    def run(spark, sf_dir):
        pages = _pages(spark, sf_dir, opening, item, closing, token, "" if kind == "ats" else "de")
        out = ats.fetched(pages, name, F.lit("2024-01-10").cast("timestamp")) if kind == "ats" else boards.postings(pages, aggregators.FEEDS[name])
        return out.select(*columns)

    run.__name__ = f"{kind}_{name.replace('-', '_')}"
    query(f"{_SQL} SELECT {want} FROM v")(run)


def _ats(*args, **more) -> None:
    _connector("ats", *args, **more)


def _feed(*args, **more) -> None:
    _connector("feed", *args, **more)


def _with(more: str) -> str:
    """A city and what follows it."""
    return f"CASE WHEN c = '' THEN '{more}' ELSE c || ', {more}' END AS location"


def _and(more: str) -> str:
    return f"CASE WHEN c = '' THEN '{more}' ELSE c || '; {more}' END AS location"


_DEV, _SAID = "'Dev ' || i AS title", "c = 'Remote' AS remote"

_ats("lever", "[", '{"id":"L<i>","hostedUrl":"u<i>","text":"Dev <i>","categories":{"location":"<c>"},"workplaceType":"hybrid","description":"<p>hi</p>"}', "]", f"'L' || i AS external_id, 'u' || i AS url, {_DEV}, c AS location, {_SAID}, 'hybrid' AS work_mode, 'hi' AS description")
_ats("ashby", '{"jobs":[', '{"jobUrl":"u<i>","title":"Dev <i>","location":"<c>","isRemote":<b>,"descriptionPlain":"d"}', "]}", f"'u' || i AS external_id, {_DEV}, c AS location, b OR c = 'Remote' AS remote, 'd' AS description")
_ats("smartrecruiters", '{"content":[', '{"id":"<i>","name":"Dev <i>","location":{"city":"<c>","country":"no","remote":<b>}}', "]}", f"i AS external_id, 'https://jobs.smartrecruiters.com/acme/' || i AS url, {_DEV}, {_with('no')}, b AS remote, 'Dev ' || i AS description")
_ats("workable", '{"name":"Real","jobs":[', '{"shortcode":"S<i>","url":"u<i>","title":"Dev <i>","city":"<c>","country":"Spain","telecommuting":<b>}', "]}", f"'S' || i AS external_id, 'u' || i AS url, {_DEV}, 'Real' AS company, {_with('Spain')}, b AS remote")
_ats("recruitee", '{"offers":[', '{"id":<i>,"careers_url":"u<i>","title":"Dev <i>","company_name":"","city":"<c>","country":"BE","remote":<b>,"hybrid":true,"description":"<p>x</p>"}', "]}", f"i AS external_id, 'u' || i AS url, 'Acme' AS company, {_with('BE')}, b AS remote, CASE WHEN b THEN 'remote' ELSE 'hybrid' END AS work_mode, 'x' AS description")
_ats("personio", "<x>", "<position><id><i></id><office><c></office><name>Dev <i></name><jobDescriptions><jobDescription><value><![CDATA[<p>one</p>]]></value></jobDescription></jobDescriptions></position>", "</x>", f"i AS external_id, 'https://acme.jobs.personio.com/job/' || i AS url, {_DEV}, c AS location, {_SAID}, 'one' AS description")
_ats("workday", '{"total":1,"jobPostings":[', '{"bulletFields":["R<i>"],"externalPath":"/job/<i>","title":"Dev <i>","locationsText":"<c>","postedOn":"Posted 3 Days Ago"}', "]}", f"'R' || i AS external_id, 'https://t.wd5.myworkdayjobs.com/site/job/' || i AS url, {_DEV}, c AS location, {_SAID}", token="t@wd5/site")
_ats("teamtailor", "<rss>", "<item><title><![CDATA[Dev <i>]]></title><link>https://a.b/jobs/<i>-dev</link><tt:city><c></tt:city><description>hey</description></item>", "</rss>", f"i || '-dev' AS external_id, 'https://a.b/jobs/' || i || '-dev' AS url, {_DEV}, c AS location, false AS remote, 'hey' AS description")
_ats("bamboohr", '{"result":[', '{"id":"<i>","jobOpeningName":"Dev <i>","location":{"city":"<c>","state":"BW"},"isRemote":<b>}', "]}", f"i AS external_id, 'https://acme.bamboohr.com/careers/' || i AS url, {_DEV}, {_with('BW')}, b AS remote")
_ats("breezy", "[", '{"name":"Dev <i>","url":"https://a.breezy.hr/p/z<i>","location":{"city":"<c>","country":{"name":"DE"},"is_remote":<b>}}', "]", f"'z' || i AS external_id, {_DEV}, {_with('DE')}, b AS remote")
_ats("join", '<script id="__NEXT_DATA__" type="x">{"props":{"pageProps":{"initialState":{"company":{"domain":"acme2"},"jobs":{"items":[', '{"title":"Dev <i>","idParam":"<i>","city":{"cityName":"<c>"}}', "]}}}}}</script>", f"i AS external_id, 'https://join.com/companies/acme2/jobs/' || i AS url, {_DEV}, c AS location, false AS remote")
_ats("pinpoint", '{"data":[', '{"id":<i>,"url":"https://p/<i>","title":" Dev <i> ","location":{"city":"<c>","province":"QC"},"workplace_type":"onsite","compensation":"1k","description":"<em>b</em>"}', "]}", f"i AS external_id, {_DEV}, {_with('QC')}, false AS remote, '1k' AS salary_text, 'b' AS description")
_ats("oracle", '{"items":[{"requisitionList":[', '{"Id":"<i>","Title":"Dev <i>","PrimaryLocation":"<c>","secondaryLocations":[{"Name":"Rome"},{"Name":""}],"ShortDescriptionStr":"<p>s</p>","ExternalQualificationsStr":"q"}', "]}]}", f"i AS external_id, 'https://eu1.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX/job/' || i AS url, {_DEV}, {_and('Rome')}, {_SAID}, 's' || chr(10) || 'q' AS description", token="eu1@CX")
_ats("beesite", '{"SearchResult":{"SearchResultItems":[', '{"MatchedObjectDescriptor":{"PositionID":"B<i>","PositionTitle":"Dev <i>","PositionURI":"u<i>","PositionLocation":[{"CityName":"<c>","CountryName":"DE"},{"CityName":"Ulm","CountryName":""}]}}', "]}}", f"'B' || i AS external_id, 'u' || i AS url, {_DEV}, {_with('DE; Ulm')}, {_SAID}")
_ats("successfactors", '{"jobSearchResult":[', '{"response":{"id":"<i>","unifiedUrlTitle":"dev-<i>","unifiedStandardTitle":"Dev <i>","jobLocationShort":["<c>","Ulm"]}}', "]}", f"i AS external_id, 'https://acme/job/dev-' || i || '/' || i || '-' AS url, {_DEV}, {_and('Ulm')}, {_SAID}")
_ats("eightfold", '{"positions":[', '{"id":<i>,"name":"Dev <i>","location":"<c>","locations":["<c>","Ulm"],"job_description":"<p>j</p>"}', "]}", f"i AS external_id, 'https://acme.eightfold.ai/careers/job/' || i AS url, {_DEV}, {_and('Ulm')}, {_SAID}, 'j' AS description")
_ats("jibe", '{"jobs":[', '{"data":{"req_id":"J<i>","slug":"s<i>","title":"Dev <i>","full_location":"<c>","description":"x"}}', "]}", f"'J' || i AS external_id, 'https://acme.jibeapply.com/jobs/s' || i AS url, {_DEV}, c AS location, {_SAID}")
_ats("phenom", '{"refineSearch":{"data":{"jobs":[', '{"jobId":"P<i>","applyUrl":"u<i>","title":"Dev <i>","city":"<c>","multi_location":["<c>","Ulm"],"type":"Office","remote":"<b>","descriptionTeaser":"t"}', "]}}}", f"'P' || i AS external_id, 'u' || i AS url, {_DEV}, {_and('Ulm')}, b AS remote, 't' AS description")
_ats("gem", '[{"data":{"oatsExternalJobPostings":{"jobPostings":[', '{"extId":"G<i>","title":"Dev <i>","locations":[{"city":"<c>","isoCountry":"PL","isRemote":<b>}]}', "]}}}]", f"'G' || i AS external_id, 'https://jobs.gem.com/acme/G' || i AS url, {_DEV}, {_with('PL')}, b AS remote")
_ats("comeet", "[", '{"uid":"C<i>","name":"Dev <i>","location":{"city":"<c>","country":"IL"},"workplace_type":"Hybrid","url_active_page":"u<i>","details":{"description":"<p>d</p>","requirements":"r"}}', "]", f"'C' || i AS external_id, 'u' || i AS url, {_DEV}, {_with('IL')}, false AS remote, 'd r' AS description")
_ats("getro", '{"results":{"jobs":[', '{"id":<i>,"url":"u<i>","title":"Dev <i>","organization":{"name":"Org <i>"},"locations":["<c>","Ulm"],"work_mode":"on_site"}', "]}}", f"i AS external_id, {_DEV}, 'Org ' || i AS company, {_and('Ulm')}, false AS remote")
_ats("avature", "<r>", "<item><title>Dev <i></title><link>https://a/job/<i></link><description>Peru - <i></description></item>", "</r>", f"i AS external_id, 'https://a/job/' || i AS url, {_DEV}, 'Peru' AS location, 'Peru - ' || i AS description")
_ats("radancy", '{"results":"', '<a class=\\"q\\" href=\\"/en/job/x/<i>\\"><h2>Dev <i></h2></a>', '"}', f"i AS external_id, 'https://acme/en/job/x/' || i AS url, {_DEV}, false AS remote")
_ats("csod", '{"data":{"requisitions":[', '{"requisitionId":<i>,"displayJobTitle":"Dev <i>","locations":[{"city":"<c>","state":"","country":"DE"}]}', "]}}", f"i AS external_id, 'https://sub.csod.com/ux/ats/careersite/4/home/requisition/' || i || '?c=sub' AS url, {_DEV}, {_with('DE')}, {_SAID}", token="sub@4")
_ats("jobvite", "<r>", "<job><id>V<i></id><title>Dev <i></title><region>EU</region><location><c></location><detail-url>u<i></detail-url></job>", "</r>", f"'V' || i AS external_id, 'u' || i AS url, {_DEV}, {_with('EU')}, {_SAID}")
_ats("softgarden", "<div>", '<a href="/job/<i>/dev?x"><h3>Dev <i></h3></a>', "</div>", f"i AS external_id, 'https://acme.softgarden.io/job/' || i || '/dev' AS url, {_DEV}, false AS remote")

_CO = "'Co' AS company"
_feed("arbeitnow", '{"data":[', '{"slug":"s<i>","url":"u<i>","title":"Dev <i>","company_name":"Co","location":"<c>","remote":<b>,"description":"<p>x</p>"}', "]}", f"'s' || i AS external_id, 'u' || i AS url, {_DEV}, {_CO}, c AS location, b AS remote, 'x' AS description")
_feed("remotive", '{"jobs":[', '{"id":<i>,"url":"u<i>","title":"Dev <i>","company_name":"Co","candidate_required_location":"<c>","salary":"<i>k","description":"x"}', "]}", f"i AS external_id, {_DEV}, {_CO}, c AS location, true AS remote, i || 'k' AS salary_text")
_feed("remoteok", '[{"legal":"x"},', '{"id":<i>,"url":"u<i>","position":"Dev <i>","company":"Co","location":"<c>","salary_min":1<i>,"salary_max":2<i>}', "]", f"i AS external_id, {_DEV}, c AS location, true AS remote, '$1' || i || '-2' || i AS salary_text")
_feed("jobicy", '{"jobs":[', '{"id":<i>,"url":"u<i>","jobTitle":"Dev <i>","companyName":"Co","jobGeo":"<c>","salaryMin":1,"salaryMax":2,"salaryCurrency":"EUR","salaryPeriod":"year","jobDescription":"","jobExcerpt":"e"}', "]}", f"i AS external_id, {_DEV}, c AS location, 'EUR1-2/year' AS salary_text, 'e' AS description")
_feed("himalayas", '{"jobs":[', '{"guid":"g<i>","title":"Dev <i>","companyName":"Co","locationRestrictions":["A","<c>"]}', "]}", f"'g' || i AS external_id, 'g' || i AS url, {_DEV}, 'A, ' || c AS location, true AS remote")
_feed("weworkremotely", "<rss>", "<item><title>Acme: Dev <i></title><link>https://w/x/<i></link><region><c></region></item>", "</rss>", f"i AS external_id, {_DEV}, 'Acme' AS company, CASE WHEN c = '' THEN 'Remote' ELSE c END AS location")
_feed("freehire", '{"data":[', '{"public_slug":"p<i>","url":"u<i>","title":"Dev <i>","company_slug":"co","location":"<c>","work_mode":"hybrid","enrichment":{"salary_min":5,"salary_currency":"EUR"}}', "]}", f"'p' || i AS external_id, {_DEV}, 'co' AS company, 'hybrid' AS work_mode, false AS remote, '5–5 EUR' AS salary_text")
_feed("arbeitsagentur", '{"ergebnisliste":[', '{"referenznummer":"r<i>","stellenangebotsTitel":"Dev <i>","firma":"Co","stellenlokationen":[{"adresse":{"ort":"<c>","land":"DEUTSCHLAND"}}],"gehaltsspanneVon":"1"}', "]}", f"'r' || i AS external_id, 'https://www.arbeitsagentur.de/jobsuche/jobdetail/r' || i AS url, {_DEV}, {_with('Germany')}, '1–1 EUR' AS salary_text")
_feed("eures", '{"jvs":[', '{"id":"e<i>","title":"<em>Dev</em> <i>","employer":{"name":"Co"}}', "]}", f"'e' || i AS external_id, {_DEV}, {_CO}, 'Germany' AS location")
_feed("sweden-jobtech", '{"hits":[', '{"id":<i>,"headline":"Dev <i>","webpage_url":"w<i>","employer":{"name":"Co"},"workplace_address":{"municipality":"<c>"},"description":{"text":"x"}}', "]}", f"i AS external_id, 'w' || i AS url, {_DEV}, {_with('Sweden')}")
_feed("denmark-jobnet", '{"jobAds":[', '{"jobAdId":"a<i>","title":"Dev <i>","hiringOrgName":"Co","postalDistrictName":"","municipality":"<c>"}', "]}", f"'a' || i AS external_id, 'https://jobnet.dk/find-job/a' || i AS url, {_DEV}, {_CO}, {_with('Denmark')}")
_feed("hn-whoishiring", '{"children":[', '{"id":<i>,"text":"Acme | Dev <i> | REMOTE | <a href=\\"https:&#x2F;&#x2F;acme.io&#x2F;<i>\\">apply</a> and a good deal more text for it"}', "]}", "i AS external_id, 'https://acme.io/' || i AS url, 'Acme' AS company, true AS remote")
_feed("landingjobs", "[", '{"id":<i>,"url":"https://l/at/big-co/<i>","title":"Dev <i>","locations":[{"city":"<c>","country_code":"pt"}],"remote":<b>,"gross_salary_low":1,"currency_code":"EUR","relocation_paid":<b>}', "]", f"i AS external_id, {_DEV}, 'Big Co' AS company, {_with('PT')}, b AS remote, '1–1 EUR' AS salary_text, CASE WHEN b THEN 'yes' END AS visa")
_feed("swissdevjobs", "[", '{"_id":"<i>","name":"Dev <i>","jobUrl":"j<i>","company":"Co","workplace":"Remote","hasVisaSponsorship":"Yes","actualCity":"<c>"}', "]", f"i AS external_id, 'https://swissdevjobs.ch/jobs/j' || i AS url, {_DEV}, {_with('Switzerland')}, true AS remote, 'remote' AS work_mode, 'yes' AS visa")
_feed("germantechjobs", "[", '{"_id":"<i>","name":"Dev <i>","redirectJobUrl":"r<i>","annualSalaryFrom":5,"annualSalaryTo":7,"hasVisaSponsorship":"No","actualCity":"<c>"}', "]", f"i AS external_id, 'r' || i AS url, {_with('Germany')}, '5–7 EUR' AS salary_text, 'no' AS visa")
_feed("berlinstartupjobs", "<rss>", "<item><title>Dev <i> // Acme</title><link>https://b/jobs/dev-<i>/</link></item>", "</rss>", f"'dev-' || i AS external_id, {_DEV}, 'Acme' AS company, 'Berlin, Germany' AS location")
_feed("manfred", "[", '{"id":<i>,"slug":"s","position":"Dev <i>","status":"ACTIVE","company":{"name":"Co"},"locations":["<c>"],"remotePercentage":40,"salaryTo":9}', "]", f"i AS external_id, 'https://www.getmanfred.com/en/job-offers/' || i || '/s' AS url, {_DEV}, CASE WHEN c = '' THEN 'Spain' ELSE c END AS location, 'hybrid' AS work_mode, '?–9 €' AS salary_text")
_feed("netempregos", "<rss>", "<item><title>Dev <i></title><link>https://n/<i>/dev</link><description>Empresa: Acme Categoria: Informatica Zona: Faro</description></item>", "</rss>", f"i AS external_id, {_DEV}, 'Acme' AS company, 'Faro, Portugal' AS location, false AS remote")
_feed("wttj", '{"hits":[', '{"name":"Dev <i>","slug":"dev-<i>","organization":{"slug":"acme","name":"Acme"},"offices":[{"city":"<c>","country":"FR"}],"remote":"partial","salary_yearly_minimum":40000,"salary_currency":"eur"}', "]}", f"'acme/dev-' || i AS external_id, {_DEV}, {_with('FR')}, 'hybrid' AS work_mode, '40000+ EUR' AS salary_text")
_feed("vdab", '{"resultaten":[', '{"id":{"id":<i>},"vacaturefunctie":{"naam":"Dev <i>"},"vacatureBedrijfsnaam":"Co","locatie":"<c>"}', "]}", f"i AS external_id, 'https://www.vdab.be/vindeenjob/vacatures/' || i AS url, {_DEV}, {_CO}, {_with('Belgium')}")
_feed("justjoin", '{"data":[', '{"slug":"s<i>","title":"Dev <i>","companyName":"Co","city":"<c>","workplaceType":"office","requiredSkills":["Go","C"]}', "]}", f"'s' || i AS external_id, 'https://justjoin.it/job-offer/s' || i AS url, {_DEV}, {_with('Poland')}, 'onsite' AS work_mode, 'Dev ' || i || ', Go, C' AS description")
_feed("nofluffjobs", '{"postings":[', '{"url":"u<i>","title":"Dev <i>","name":"Co","location":{"places":[{"city":"<c>"}]},"salary":{"from":10,"type":"b2b"}}', "]}", f"'u' || i AS external_id, {_DEV}, CASE WHEN c = 'Oslo' THEN 'Oslo, Poland' ELSE 'Poland' END AS location, {_SAID}, '10–10 PLN/b2b' AS salary_text")
_feed("thehub", '{"jobs":{"docs":[', '{"id":"h<i>","title":"Dev <i>","company":{"name":"Co"},"location":{"address":" ","locality":"<c>","country":"NO"},"isRemote":<b>}', "]}}", f"'h' || i AS external_id, 'https://thehub.io/jobs/h' || i AS url, {_DEV}, {_with('NO')}, b AS remote")
_feed("agenticjobs", '{"data":[', '{"slug":"s<i>","title":"Dev <i>","companyName":"Co","location":"<c>","locationType":"Onsite","visaSponsorship":<b>}', "]}", f"'s' || i AS external_id, {_DEV}, c AS location, 'onsite' AS work_mode, CASE WHEN b THEN 'yes' END AS visa")
_feed("a16z-speedrun", '{"jobs":[', '{"id":"z<i>","url":"https://s/<i>","title":"Dev <i>","company":" ","location":"<c>","workplace_type":"remote","comp_min":1,"comp_currency":"USD"}', "]}", f"'z' || i AS external_id, {_DEV}, 'SPEEDRUN portfolio (stealth)' AS company, c AS location, true AS remote, '1–1 USD/year' AS salary_text")
_feed("workingnomads", '{"hits":{"hits":[', '{"_source":{"slug":"s<i>","title":"Dev <i>","company":"Co","apply_url":"mailto:x","locations":"<c>"}}', "]}}", f"'s' || i AS external_id, 'https://www.workingnomads.com/jobs/s' || i AS url, {_DEV}, CASE WHEN c = '' THEN 'Remote' ELSE c END AS location, 'remote' AS work_mode")
_feed("jobindexdk", "<rss>", "<item><title>Dev <i>, Acme</title><link>https://j/vis-job/h<i></link></item>", "</rss>", "'h' || i AS external_id, 'Dev ' || i || ', Acme' AS title, 'Acme' AS company, 'Denmark' AS location")
_feed("greenjobsde", "<feed>", '<entry><title>Dev <i> (m/w/d) (Ulm) - Wind AG</title><link rel="x" href="https://g/?a=1&amp;id=7<i>"/></entry>', "</feed>", "'7' || i AS external_id, 'Dev ' || i || ' (m/w/d)' AS title, 'Wind AG' AS company, 'Ulm' AS location")
_feed("themuse", '{"results":[', '{"id":<i>,"name":"Dev <i>","refs":{"landing_page":"u<i>"},"company":{"name":"Co"},"locations":[{"name":"<c>"},{"name":"Ulm"}]}', "]}", f"i AS external_id, 'u' || i AS url, {_DEV}, {_CO}, {_and('Ulm')}, {_SAID}")
_feed("duunitori", '{"results":[', '{"slug":"s<i>","heading":"Dev <i>","company_name":"Co","municipality_name":"<c>"}', "]}", f"'s' || i AS external_id, 'https://duunitori.fi/tyopaikat/tyo/s' || i AS url, {_DEV}, {_with('Finland')}")
_feed("warpjobs", '{"jobs":[', '{"apply_url":"u<i>","title":"Dev <i>","company":"Co","location":"<c>","visa_sponsor":<b>}', "]}", f"'u' || i AS external_id, {_DEV}, c AS location, {_SAID}, CASE WHEN b THEN 'yes' END AS visa")
_feed("aidevjobs", '{"results":[', '{"id":<i>,"link":"u<i>","title":"Dev <i>","company_name":"Co","location":"<c>"}', "]}", f"i AS external_id, 'u' || i AS url, {_DEV}, {_CO}, c AS location, {_SAID}")
_feed("wejob", '{"data":[', '{"id":<i>,"title":"Dev <i>","company_name":"Co","city":"<c>"}', "]}", f"i AS external_id, 'https://wejob.ch/jobs/' || i AS url, {_DEV}, {_CO}, c AS location")
_feed("adzuna", '{"results":[', '{"id":"<i>","redirect_url":"u<i>","title":"Dev <i>","company":{"display_name":"Co"},"salary_min":10.5,"description":"home office"}', "]}", f"i AS external_id, {_DEV}, {_CO}, 'DE' AS location, true AS remote, '11–11' AS salary_text")
_feed("jsearch", '{"data":{"jobs":[', '{"job_id":"<i>","job_apply_link":"u<i>","job_title":"Dev <i>","employer_name":"Co","job_city":"<c>","job_country":"","job_is_remote":<b>}', "]}}", f"i AS external_id, {_DEV}, CASE WHEN c <> '' THEN c WHEN b THEN 'Remote' ELSE '' END AS location, b AS remote")
_feed("indeed", "[", '{"jobId":"<i>","title":"Dev <i>","url":"https://indeed.com/<i>","externalApplyUrl":"https://acme.io/<i>","company":{"name":"Acme"},"location":{"city":"<c>","countryCode":"DE"},"salary":{"text":"5k"}}', "]", f"i AS external_id, 'https://acme.io/' || i AS url, {_DEV}, 'Acme' AS company, {_with('DE')}, '5k' AS salary_text")
