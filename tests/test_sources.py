import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import ats, boards


def pages(spark, *bodies, token="acme", region="", company="Acme"):
    rows = [(token, company, region, i, b if isinstance(b, str) or b is None else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, boards.PAGES)


def read(spark, platform, *bodies, **kw):
    return [r.asDict() for r in ats.fetched(pages(spark, *bodies, **kw), platform).orderBy("pos").collect()]


CASES = {
    "greenhouse": ({"jobs": [{"id": 7, "absolute_url": "u", "title": "Dev", "location": {"name": "Remote, PL"}, "content": "<p>a&amp;b</p>", "updated_at": "2024-01-02T03:04:05Z"}]}, "7", "Remote, PL", True, "a&b"),
    "lever": ([{"id": "x", "hostedUrl": "u", "text": "Dev", "categories": {"location": "Oslo"}, "workplaceType": "hybrid", "description": "<b>hi</b>", "createdAt": 1704067200000}], "x", "Oslo", False, "hi"),
    "ashby": ({"jobs": [{"jobUrl": "u", "title": "Dev", "location": "Rome", "isRemote": True, "descriptionPlain": "d"}]}, "u", "Rome", True, "d"),
    "smartrecruiters": ({"content": [{"id": "1", "name": "Dev", "location": {"city": "Rome", "country": "it", "remote": False}}]}, "1", "Rome, it", False, "Dev"),
    "workable": ({"name": "Real", "jobs": [{"shortcode": "S", "url": "u", "title": "Dev", "city": "", "country": "Spain", "telecommuting": True}]}, "S", "Spain", True, "Dev"),
    "recruitee": ({"offers": [{"id": 3, "careers_url": "u", "title": "Dev", "city": "Gent", "country": "BE", "hybrid": True, "description": ""}]}, "3", "Gent, BE", False, "Dev"),
    "personio": ("<x><position><id>5</id><office>Home Office</office><name>Dev &amp; Ops</name><jobDescriptions><value><![CDATA[<p>one</p>]]></value><value>two</value></jobDescriptions></position></x>", "5", "Home Office", True, "one two"),
    "workday": ({"total": 1, "jobPostings": [{"bulletFields": ["R1"], "externalPath": "/job/1", "title": "Dev", "locationsText": "Paris", "postedOn": "Posted 3 Days Ago"}]}, "R1", "Paris", False, "Dev"),
    "teamtailor": ("<rss><item><title><![CDATA[Dev Remote]]></title><link>https://a.b/jobs/9-dev</link><tt:city>Lund</tt:city><description>&lt;p&gt;hey</description><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item></rss>", "9-dev", "Lund", True, "<p>hey"),
    "bamboohr": ({"result": [{"id": "4", "jobOpeningName": "Dev", "location": {"city": "Ulm", "state": None}}, {"id": "", "jobOpeningName": "x"}]}, "4", "Ulm", False, "Dev"),
    "breezy": ([{"name": "Dev", "url": "https://a.breezy.hr/p/z1", "location": {"city": "Ulm", "country": {"name": "DE"}}, "published_date": "nonsense"}, {"name": "no", "url": "http://x"}], "z1", "Ulm, DE", False, "Dev"),
    "join": ('<script id="__NEXT_DATA__" type="x">{"props":{"pageProps":{"initialState":{"company":{"domain":"acme2"},"jobs":{"items":[{"title":"Dev","idParam":"77","city":{"cityName":"Bonn"}}]}}}}}</script>', "77", "Bonn", False, "Dev"),
    "pinpoint": ({"data": [{"id": 2, "url": "https://p", "title": " Dev ", "location": {"city": "York", "province": ""}, "workplace_type": "Remote", "compensation": "1k", "description": "<i>b</i>"}]}, "2", "York", True, "b"),
    "oracle": ({"items": [{"requisitionList": [{"Id": "8", "Title": "Dev", "PrimaryLocation": "Oslo", "secondaryLocations": [{"Name": "Rome"}, {"Name": ""}], "ShortDescriptionStr": "<p>s</p>", "ExternalQualificationsStr": "q"}]}]}, "8", "Oslo; Rome", False, "s\nq"),
    "beesite": ({"SearchResult": {"SearchResultItems": [{"MatchedObjectDescriptor": {"PositionID": "B", "PositionTitle": "Dev", "PositionLocation": {"CityName": "Ulm", "CountryName": "DE"}}}]}}, "B", "Ulm, DE", False, "Dev"),
    "eightfold": ({"positions": [{"id": 1, "name": "Dev", "location": "A", "locations": ["A", "B Remote"], "t_create": 1704067200}]}, "1", "A; B Remote", True, "Dev"),
    "jibe": ({"jobs": [{"data": {"req_id": "J", "title": "Dev", "full_location": "Rome", "description": "x"}}]}, "J", "Rome", False, "x"),
    "rippling": ([{"uuid": "u1", "name": "Dev", "workLocation": {"label": "Rome"}}, {"uuid": "u1", "name": "Dev", "workLocation": {"label": "Oslo"}}, {"uuid": "u1", "name": "Dev", "workLocation": {"label": "Rome"}}], "u1", "Rome; Oslo", False, "Dev"),
    "phenom": ({"refineSearch": {"data": {"jobs": [{"jobId": "P", "title": "Dev", "city": "A", "multi_location": ["A", "B"], "type": "Remote"}]}}}, "P", "A; B", True, "Dev"),
    "gem": ([{"data": {"oatsExternalJobPostings": {"jobPostings": [{"extId": "G", "title": "Dev", "locations": [{"city": "A", "isoCountry": "PL", "isRemote": True}]}]}}}], "G", "A, PL", True, "Dev"),
    "comeet": ([{"uid": "C", "name": "Dev", "location": {"city": "A", "country": "IL"}, "workplace_type": "Hybrid", "details": {"description": "<p>d</p>", "requirements": "r"}}], "C", "A, IL", False, "d r"),
    "getro": ({"results": {"jobs": [{"id": 6, "title": "Dev", "organization": {"name": "Org"}, "locations": ["A", "", "B"], "work_mode": "remote", "created_at": 1704067200}]}}, "6", "A; B", True, "Dev"),
    "avature": ("<item><title>Dev</title><link>https://a/job/123</link><description>Peru - 7221</description></item>", "123", "Peru", False, "Peru - 7221"),
    "radancy": ({"results": '<a class="q" href="/en/job/x/55"><h2>Dev</h2></a><a href="/en/job/x/55"><h2>Dev two</h2></a>'}, "55", "", False, "Dev two"),
    "csod": ({"data": {"requisitions": [{"requisitionId": 9, "displayJobTitle": "Dev", "locations": [{"city": "A", "state": "", "country": "DE"}]}]}}, "9", "A, DE", False, "Dev"),
    "jobvite": ("<r><job><id>V</id><title>Dev</title><region>EU</region><location>Rome</location><detail-url>u</detail-url></job></r>", "V", "Rome, EU", False, "Dev"),
    "softgarden": ('<a href="/job/31/dev?x"><b>Dev</b></a><a href="/job/31/dev">again</a>', "31", "", False, "Dev"),
}


def test_every_platform_has_a_case():
    assert set(CASES) | {"successfactors"} == set(ats.BOARDS)


@pytest.mark.parametrize("platform", sorted(CASES))
def test_platform(spark, platform):
    body, ident, location, remote, description = CASES[platform]
    (row,) = read(spark, platform, body, None, "not a page", token={"workday": "t@wd5/site", "oracle": "eu1@CX", "csod": "sub@4"}.get(platform, "acme"))
    assert (row["external_id"], row["location"], row["remote"], row["description"]) == (ident, location, remote, description)
    assert row["source"].startswith(ats.BOARDS[platform].source + ":")


def test_details(spark):
    assert read(spark, "greenhouse", CASES["greenhouse"][0])[0]["posted_at"] == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert read(spark, "teamtailor", CASES["teamtailor"][0])[0]["posted_at"] == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert (read(spark, "lever", CASES["lever"][0])[0]["posted_at"], read(spark, "lever", CASES["lever"][0])[0]["work_mode"]) == (dt.datetime(2024, 1, 1), "hybrid")
    assert read(spark, "eightfold", CASES["eightfold"][0])[0]["posted_at"] == dt.datetime(2024, 1, 1)
    assert read(spark, "join", CASES["join"][0])[0]["url"] == "https://join.com/companies/acme2/jobs/77"
    assert read(spark, "workday", CASES["workday"][0], token="t@wd5/site")[0]["url"] == "https://t.wd5.myworkdayjobs.com/site/job/1"
    assert read(spark, "workable", CASES["workable"][0])[0]["company"] == "Real"
    assert read(spark, "csod", CASES["csod"][0], token="sub@4")[0]["url"].endswith("/careersite/4/home/requisition/9?c=sub")


def test_english_wins(spark):
    rows = [("h", "A", "de_DE", 0, json.dumps({"jobSearchResult": [{"response": {"id": 1, "unifiedStandardTitle": "Entwickler"}}, {"response": {"id": 2, "unifiedStandardTitle": "Koch"}}]})),
            ("h", "A", "en_US", 0, json.dumps({"jobSearchResult": [{"id": 1, "unifiedStandardTitle": "Developer"}]}))]
    got = {r["external_id"]: r["title"] for r in ats.fetched(spark.createDataFrame(rows, boards.PAGES), "successfactors").collect()}
    assert got == {"1": "Developer", "2": "Koch"}


@pytest.mark.parametrize("far", [(1 << 20) + 1, (1 << 31) - 1])
def test_english_wins_on_pages_of_any_number(spark, far):
    body = lambda title: json.dumps({"jobSearchResult": [{"id": 1, "unifiedStandardTitle": title}]})
    rows = [("h", "A", "de_DE", 0, body("Entwickler")), ("h", "A", "en_US", far, body("Developer")), ("i", "A", None, 3, body("Cuoco")), ("i", "A", "de_DE", far, body("Koch"))]
    got = {r["source"]: r["title"] for r in ats.fetched(spark.createDataFrame(rows, boards.PAGES), "successfactors").collect()}
    assert got == {"sf:h": "Developer", "sf:i": "Cuoco"}


def test_workday_dates(spark):
    now = F.lit(dt.datetime(2024, 5, 10))
    ask = lambda s: spark.range(1).select(ats.workday_posted(F.lit(s), now).alias("x")).first()[0]
    assert ask("Posted Today") == dt.datetime(2024, 5, 10) and ask("Posted Yesterday") == dt.datetime(2024, 5, 9)
    assert ask("Posted 3 Days Ago") == dt.datetime(2024, 5, 7) and ask("Posted 30+ Days Ago") is None


def test_detail_plan(spark):
    cards = spark.createDataFrame([("s", str(i), i) for i in range(6)], "source string, external_id string, score int")
    best = boards.detail_plan(cards, "score", 2, 2, [F.desc("score")])
    assert sorted(r["external_id"] for r in best.collect()) == ["4", "5"]
    kept = {r["external_id"]: r["detail"] for r in boards.detail_plan(cards, "score", 2, 2, [F.col("external_id")], keep_rest=True).collect()}
    assert kept == {"2": True, "3": True, "4": False, "5": False}
