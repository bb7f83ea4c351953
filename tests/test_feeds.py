import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import aggregators, boards

# source: body, then what some of the first posting's columns hold
CASES = {
    "arbeitnow": ({"data": [{"slug": "s", "url": "u", "title": "Dev", "remote": True, "created_at": 1704067200, "description": "<b>x</b>"}, {"slug": "", "url": "u", "title": "no"}]}, {"external_id": "s", "remote": True, "posted_at": dt.datetime(2024, 1, 1), "description": "x"}),
    "remotive": ({"jobs": [{"id": 1, "url": "u", "title": "Dev", "salary": ""}]}, {"remote": True, "salary_text": None}),
    "remoteok": ([{"legal": "x"}, {"id": 2, "position": "Dev", "salary_min": 10, "salary_max": 20}], {"external_id": "2", "location": "Remote", "salary_text": "$10-20"}),
    "jobicy": ({"jobs": [{"id": 3, "jobTitle": "Dev", "salaryMin": 1, "salaryMax": 2, "salaryCurrency": "EUR", "salaryPeriod": "year", "jobDescription": "", "jobExcerpt": "e"}]}, {"salary_text": "EUR1-2/year", "description": "e"}),
    "himalayas": ({"jobs": [{"guid": "g", "title": "Dev", "locationRestrictions": ["A", "B"], "pubDate": 1704067200}]}, {"url": "g", "location": "A, B", "posted_at": dt.datetime(2024, 1, 1)}),
    "weworkremotely": ("<item><title>Acme: Dev: Ops</title><link>https://w/x/9</link></item>", {"external_id": "9", "title": "Dev: Ops", "company": "Acme", "location": "Remote"}),
    "freehire": ({"data": [{"public_slug": "p", "url": "u", "title": "Dev", "work_mode": "hybrid", "enrichment": {"salary_min": 5, "salary_currency": "EUR"}}]}, {"work_mode": "hybrid", "salary_text": "5–5 EUR"}),
    "arbeitsagentur": ({"ergebnisliste": [{"referenznummer": "r", "stellenangebotsTitel": "Dev", "stellenlokationen": [{"adresse": {"ort": "Ulm", "land": "DEUTSCHLAND"}}]}]}, {"location": "Ulm, Germany"}),
    "eures": ({"jvs": [{"id": "e", "title": "<em>Dev</em>", "creationDate": 1704067200000}]}, {"title": "Dev", "location": "Germany", "posted_at": dt.datetime(2024, 1, 1)}),
    "sweden-jobtech": ({"hits": [{"id": 1, "headline": "Dev", "webpage_url": "w", "workplace_address": {"municipality": "Lund"}}, {"id": 2, "headline": "no url"}]}, {"url": "w", "location": "Lund, Sweden"}),
    "denmark-jobnet": ({"jobAds": [{"jobAdId": "a", "title": "Dev", "postalDistrictName": "", "municipality": "Aarhus"}]}, {"location": "Aarhus, Denmark"}),
    "hn-whoishiring": ({"children": [{"id": 1, "text": 'Acme | Dev | REMOTE | <a href="https:&#x2F;&#x2F;acme.io&#x2F;jobs">apply</a> and a good deal more text'}, {"id": 2, "text": "short"}]}, {"company": "Acme", "url": "https://acme.io/jobs", "remote": True}),
    "landingjobs": ([{"id": 1, "url": "https://l/at/big-co/x", "title": "Dev", "locations": [{"city": "Faro", "country_code": "pt"}], "gross_salary_low": 1, "relocation_paid": True}], {"company": "Big Co", "location": "Faro, PT", "salary_text": "1–1", "visa": "yes"}),
    "swissdevjobs": ([{"_id": "1", "name": "Dev", "jobUrl": "j", "workplace": "Remote", "hasVisaSponsorship": "Yes", "technologies": ["Go"]}, {"_id": "2", "name": "x", "isPaused": True, "jobUrl": "k"}], {"visa": "yes", "work_mode": "remote", "url": "https://swissdevjobs.ch/jobs/j", "location": "Switzerland"}),
    "germantechjobs": ([{"_id": "1", "name": "Dev", "redirectJobUrl": "r", "annualSalaryFrom": 5, "annualSalaryTo": 7, "hasVisaSponsorship": "No", "actualCity": "Ulm"}], {"salary_text": "5–7 EUR", "visa": "no", "location": "Ulm, Germany"}),
    "berlinstartupjobs": ("<item><title>Dev // Acme</title><link>https://b/jobs/dev/</link></item>", {"external_id": "dev", "title": "Dev", "company": "Acme"}),
    "manfred": ([{"id": 1, "position": "Dev", "status": "ACTIVE", "remotePercentage": 40, "salaryTo": 9}, {"id": 2, "position": "x", "status": "CLOSED"}], {"work_mode": "hybrid", "salary_text": "?–9 €", "location": "Spain"}),
    "netempregos": ("<item><title>Dev</title><link>https://n/12/dev</link><description>&amp;lt;b&amp;gt;Empresa: Acme Categoria: Informatica Zona: Faro</description></item><item><title>Cook</title><link>https://n/13/x</link><description>Categoria: Hotel</description></item>", {"external_id": "12", "company": "Acme", "location": "Faro, Portugal"}),
    "wttj": ({"hits": [{"name": "Dev", "slug": "dev", "organization": {"slug": "acme", "name": "Acme"}, "offices": [{"city": "Paris", "country": "FR"}], "remote": "partial", "salary_yearly_minimum": 40000, "salary_currency": "eur"}, {"name": "x", "slug": "b/ad", "organization": {"slug": "a"}}]}, {"external_id": "acme/dev", "work_mode": "hybrid", "salary_text": "40000+ EUR"}),
    "vdab": ({"resultaten": [{"id": {"id": 5}, "vacaturefunctie": {"naam": "Dev"}, "locatie": "Gent"}, {"id": 6, "vacaturefunctie": "x", "gesloten": True}]}, {"external_id": "5", "title": "Dev", "location": "Gent, Belgium", "description": "Dev"}),
    "justjoin": ({"data": [{"slug": "s", "title": "Dev", "city": "Opole", "workplaceType": "office", "requiredSkills": ["Go", "C"]}]}, {"work_mode": "onsite", "description": "Dev, Go, C"}),
    "nofluffjobs": ({"postings": [{"url": "u", "title": "Dev", "location": {"places": [{"city": "Remote"}]}, "salary": {"from": 10, "type": "b2b"}, "posted": 1704067200000}]}, {"remote": True, "location": "Poland", "salary_text": "10–10 PLN/b2b"}),
    "thehub": ({"jobs": {"docs": [{"id": "h", "title": "Dev", "location": {"address": " ", "locality": "Oslo", "country": "NO"}}]}}, {"location": "Oslo, NO", "description": "Dev"}),
    "agenticjobs": ({"data": [{"slug": "s", "title": "Dev", "locationType": "Onsite", "visaSponsorship": True}]}, {"work_mode": "onsite", "visa": "yes"}),
    "a16z-speedrun": ({"jobs": [{"url": "https://s", "title": "Dev", "company": " ", "workplace_type": "remote", "comp_min": 1, "comp_currency": "USD"}]}, {"company": "SPEEDRUN portfolio (stealth)", "remote": True, "salary_text": "1–1 USD/year"}),
    "workingnomads": ({"hits": {"hits": [{"_source": {"slug": "s", "title": "Dev", "apply_url": "mailto:x"}}]}}, {"url": "https://www.workingnomads.com/jobs/s", "location": "Remote"}),
    "jobindexdk": ("<rss><item><title>Dev, Acme</title><link>https://j/vis-job/h12</link></item></rss>", {"external_id": "h12", "company": "Acme", "title": "Dev, Acme"}),
    "greenjobsde": ('<entry><title>Dev (m/w/d) (Ulm) - Wind AG</title><link rel="x" href="https://g/?a=1&amp;id=77"/></entry>', {"external_id": "77", "company": "Wind AG", "location": "Ulm", "title": "Dev (m/w/d)"}),
    "themuse": ({"results": [{"id": 1, "name": "Dev", "refs": {"landing_page": "u"}, "locations": [{"name": "Flexible / Remote"}]}]}, {"remote": True, "description": "Dev"}),
    "duunitori": ({"results": [{"slug": "s", "heading": "Dev", "municipality_name": "Espoo"}]}, {"location": "Espoo, Finland"}),
    "warpjobs": ({"jobs": [{"apply_url": "u", "title": "Dev", "visa_sponsor": True}]}, {"external_id": "u", "visa": "yes"}),
    "aidevjobs": ({"results": [{"id": 1, "link": "u", "title": "Dev", "location": "Remote"}]}, {"url": "u", "remote": True}),
    "wejob": ({"data": [{"id": 1, "title": "Dev"}]}, {"url": "https://wejob.ch/jobs/1", "location": "Switzerland"}),
    "adzuna": ({"results": [{"id": "1", "title": "Dev", "salary_min": 10.5, "description": "home office"}]}, {"location": "DE", "remote": True, "salary_text": "11–11"}),
    "jsearch": ({"data": {"jobs": [{"job_id": "1", "job_title": "Dev", "job_is_remote": True}]}}, {"location": "Remote", "remote": True}),
    "indeed": ([{"jobId": "1", "title": "Dev", "url": "https://indeed.com/1", "externalApplyUrl": "https://acme.io/1", "company": {"name": "Acme"}, "location": {"city": "Ulm", "countryCode": "DE"}, "salary": {"text": "5k"}, "postedAt": 1704067200}], {"url": "https://acme.io/1", "company": "Acme", "location": "Ulm, DE", "salary_text": "5k", "posted_at": dt.datetime(2024, 1, 1)}),
}


def test_every_feed_has_a_case():
    assert set(CASES) == set(aggregators.FEEDS)


@pytest.mark.parametrize("name", sorted(CASES))
def test_feed(spark, name):
    body, want = CASES[name]
    raw = body if isinstance(body, str) else json.dumps(body)
    pages = spark.createDataFrame([("t", "c", "de", 0, raw), ("t", "c", "de", 1, None), ("t", "c", "de", 2, "not a page")], boards.PAGES)
    (row,) = boards.postings(pages, aggregators.FEEDS[name]).collect()
    assert {k: row[k] for k in want} == want and row["source"] == name


def test_feed_items(spark):
    rss = "<rss><item><title>Dev at Acme</title><link>https://f/1</link><description>&lt;p&gt;x</description></item><item><title>again at B</title><link>https://f/1</link></item><item><title>Cook - Remote</title><link>https://f/2</link></item></rss>"
    atom = '<feed><entry><title>Dev - Acme</title><link href="https://f/3?a&amp;b"/><author><name>Ann</name></author></entry></feed>'
    pages = spark.createDataFrame([("one", "", "", 0, rss), ("two", "", "", 0, atom)], boards.PAGES)
    got = {r["external_id"]: (r["source"], r["title"], r["company"], r["remote"]) for r in aggregators.feed_items(pages, F.lit("Label"), F.when(F.col("token") == "two", "dash").otherwise("at")).collect()}
    assert got == {"f/1": ("one", "Dev", "Acme", False), "f/2": ("one", "Cook - Remote", "Label", True), "f/3?a&b": ("two", "Dev", "Acme", False)}


def test_search_plan(spark):
    groups = spark.createDataFrame([("dev", "en"), ("entwickler", "de")], "keywords string, lang string")
    places = spark.createDataFrame([("Berlin", "de", "city"), ("Oslo", None, "city")], "location string, lang string, tier string")
    assert sorted(map(tuple, aggregators.search_plan(groups, places).collect())) == [("dev", "Berlin", "city"), ("dev", "Oslo", "city"), ("entwickler", "Berlin", "city")]
