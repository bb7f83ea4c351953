import io
import zipfile

from pyspark.sql import functions as F

from tessera.functions import detect, slugs
from tessera.sources import registers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


BOARDS = [
    ("https://boards.greenhouse.io/Acme/jobs/1", ("greenhouse", "acme", "")), ("https://boards.eu.greenhouse.io/embed/job_app?for=acme", ("greenhouse", "acme", "eu")),
    ("https://boards.greenhouse.io/v1/x", None), ("https://jobs.eu.lever.co/acme", ("lever", "acme", "eu")), ("https://jobs.ashbyhq.com/Acme%20Labs", ("ashby", "acme labs", "")),
    ("https://jobs.ashbyhq.com/robots.txt", None), ("https://apply.workable.com/j/ABC", None), ("https://acme.workable.com/x", ("workable", "acme", "")), ("https://cdn.acme.recruitee.com", None), ("https://acme.jobs.personio.de", ("personio", "acme", "")),
    ("https://acme.wd5.myworkdayjobs.com/en-US/Ext/job/1", ("workday", "acme@wd5/ext", "")), ("https://acme.wd5.myworkdayjobs.com/wday/x", None), ("https://wd3.myworkdaysite.com/recruiting/acme/Site", ("workday", "acme@wd3/site", "")),
    ("https://join.com/companies/acme", ("join", "acme", "")), ("https://join.com/about", None), ("https://eu.fa.us2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/job/3", ("oracle", "eu.fa.us2@cx_1", "")),
    ("https://www.comeet.com/jobs/acme/61.003/x", ("comeet", "acme/61.003", "")), ("https://acme.csod.com/ux/ats/careersite/4/home", ("csod", "acme@4", "")), ("ftp://jobs.lever.co/acme", None), ("https://jobs.lever.co/%zz", None), (None, None), ("", None),
]


def test_boards(spark):
    rows = spark.createDataFrame([(i, url) for i, (url, _) in enumerate(BOARDS)], "i int, url string")
    got = {r["i"]: r["b"] for r in rows.select("i", slugs.board_of(F.col("url")).alias("b")).collect()}
    for i, (url, want) in enumerate(BOARDS):
        assert (got[i] and tuple(got[i])[:3]) == want, url


def test_scan_and_links(spark):
    pages = spark.createDataFrame([(1, '<a href="https://jobs.lever.co/acme">x</a> //jobs.lever.co/acme https://careers.foo.com/x https://plain.org'), (2, None)], "i int, t string")
    rows = {(r["platform"], r["host"], r["smells"]) for r in slugs.scan(pages, "i", "t").collect()}
    assert rows == {("lever", "jobs.lever.co", False), (None, "careers.foo.com", True)}
    html = '<a href="/careers#x">a</a><a href="//jobs.ex.com/">b</a><a href="https://other.com/jobs">c</a><a href="/careers">d</a><a href="/about">e</a>'
    assert one(spark, slugs.career_links(F.lit(html), F.lit("ex.com"))) == ["https://ex.com/careers", "https://jobs.ex.com/"]
    assert tuple(one(spark, slugs.board_name(F.lit("board:lever:a:b|eu")))) == ("lever", "a:b", "eu")
    assert one(spark, slugs.board_name(F.lit("indeed"))) is None
    assert one(spark, slugs.probe_result(F.lit("smartrecruiters"), F.lit(200), F.lit('{"totalFound": 0}'))) == "dead"
    assert one(spark, slugs.probe_result(F.lit("lever"), F.lit(200), F.lit("[]"))) == "active"


def test_detectors(spark):
    visa = lambda d: one(spark, detect.visa(F.lit(""), F.lit(d).cast("string")))
    assert [visa(d) for d in ("Visa sponsorship is not available", "relocation package", "hello", None)] == ["no", "yes", "unknown", "unknown"]
    lang = lambda t: one(spark, detect.language_requirements(F.lit(t).cast("string")))
    assert lang("😀 Fließend Deutsch." + " " * 90 + "Fluent French is a plus") == ["de"] and lang("fluent french" + " " * 90 + "optional") == ["fr"] and lang(None) == []
    level = lambda t, d="": tuple(one(spark, detect.seniority(F.lit(t), F.lit(d))))
    assert level("Senior Staff Engineer") == ("staff", 'title: "Staff"') and level("Engineering Manager")[0] == "management"
    assert level("Tech Lead") == ("senior", "title: lead (IC by default)") and level("Tech Lead", "You have direct reports")[0] == "management"
    assert level("Dev", "min. 5 lat") == ("senior", 'body: "5 lat"') and level("Dev", "1 year")[0] == "junior" and level("Dev") == ("unknown", "")
    mode = lambda e, t, d, r: one(spark, detect.work_mode(F.lit(e).cast("string"), F.lit(t), F.lit(None), F.lit(d), F.lit(r)))
    assert [mode("onsite", "x", "", True), mode(None, "Hybrid dev", "", True), mode(None, "x", "", True), mode(None, "x", "", False)] == ["onsite", "hybrid", "remote", "onsite"]
    live = lambda s, h: one(spark, detect.liveness(F.lit(s).cast("int"), F.lit(h).cast("string")))
    assert [live(404, ""), live(503, ""), live(200, "Cette offre a expiré"), live(200, "The role has been filled out"), live(200, None), live(None, "")] == ["expired", "uncertain", "expired", "active", "active", "uncertain"]
    assert one(spark, detect.slug_candidates(F.lit("Müller Games GmbH"))) == ["mullergames", "muller-games"] and one(spark, detect.slug_candidates(F.lit("EY"))) == []
    assert one(spark, detect.names_match(F.lit("Azumo"), F.lit("Azumo Inc"))) and not one(spark, detect.names_match(F.lit("Peak Therapy"), F.lit("Peak Games")))
    assert one(spark, detect.titled_token(F.lit("big-co_x.y@wd1"))) == "Big Co X Y"
    places = {"germany": "de", "berlin": "de", "istanbul": "tr", "warsaw": "pl"}
    at = lambda s: one(spark, detect.country_of(F.lit(s).cast("string"), places, ["pl", "de"]))
    assert [at(x) for x in ("Sarıyer, Istanbul", "PL - Somewhere", "Remote", "Greater Berlin Area", "Berlin (hybrid)", None, "")] == ["tr", "pl", None, "de", "de", None, None]
    ok = detect.country_passes(F.col("c"), ["DACH", "france"], {"fr": "France"}, {"dach": ["de", "at"]}, {}, {})
    assert [r[0] for r in spark.createDataFrame([("de",), ("fr",), ("pl",), (None,)], "c string").select(ok).collect()] == [True, True, False, False]


def test_registers(spark, tmp_path):
    page = lambda s: spark.createDataFrame([(s,), (None,)], "body string")
    assert [tuple(r) for r in registers.dutch(page('<th scope="row">A &amp; B</th> <td> 12 </td><th scope="row"></th><td>3</td>')).collect()] == [("A & B", "IND recognised sponsor (KvK 12)")]
    assert [tuple(r) for r in registers.danish(page("<tr><td>Name</td><td>CVR</td></tr><tr><td>Lego</td><td>54562519</td></tr>")).collect()] == [("Lego", "SIRI fast-track certified (CVR 54562519)")]
    (tmp_path / "gb.csv").write_text('Organisation Name,Town,County,Type & Rating,Route\n"Big ""A"", Ltd",X,Y,Worker (A),Skilled\nBIG A,X,Y,Other,Route2\n,,,,\n')
    assert [tuple(r) for r in registers.british(spark, str(tmp_path / "gb.csv")).collect()] == [('Big "A", Ltd', "Worker (A) — Skilled")]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<t>Employer Name</t><t>A &amp; B</t>")
        z.writestr("xl/worksheets/sheet1.xml", '<c r="A1" t="s"><v>0</v></c><c r="A2" t="s"><v>1</v></c><c r="B2" t="s"><v>0</v></c>')
    files = spark.createDataFrame([(data.getvalue(),), (b"no",), (None,)], "content binary")
    assert [r["name"] for r in registers.irish(files).collect()] == ["A & B"]
    yaml = "companies:\n  - name: 'A'\n    website: https://a\n    geo:\n      - country: DE\n      - country: FR\n    jobs: https://a/j\n  - name: B\njobportals:\n  - name: C\n"
    rows = spark.createDataFrame([(yaml,)], "value string")
    assert [tuple(r) for r in registers.company_list(rows).collect()] == [("A", "https://a", "https://a/j", ["DE", "FR"]), ("B", None, None, [])]
    lines = spark.createDataFrame([('{"url": "https://a"}',), ("https://b",), ("junk",), ("",), (None,)], "value string")
    assert [r[0] for r in registers.crawl_lines(lines).collect()] == ["https://a", "https://b"]
    listed = spark.createDataFrame([("# c",), ("A\thttps://a",), ("B",), ("",)], "value string")
    assert [tuple(r) for r in registers.named_urls(listed).collect()] == [("A", "https://a")]
    answers = spark.createDataFrame([('{"custom_id":"1","result":{"type":"succeeded","message":{"content":[{"text":"ok"}]}}}',), ('{"custom_id":"2","result":{"type":"errored"}}',), ("x",)], "value string")
    assert [tuple(r) for r in registers.batch_results(answers).collect()] == [("1", "ok"), ("2", None)]
