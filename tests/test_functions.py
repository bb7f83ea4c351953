import datetime as dt

from pyspark.sql import functions as F

from tessera.functions import lifecycle, text
from tessera.operators import ranking, relational, scoring


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_urls(spark):
    canonical = lambda u: one(spark, text.canonical_url(F.lit(u)))
    assert canonical("HTTPS://Ex.COM/a/?utm_source=x&b=2&a=1#f") == "https://ex.com/a/?a=1&b=2"
    assert canonical("https://ex.com/a/") == "https://ex.com/a"
    assert canonical("https://ex.com/") == "https://ex.com/"
    assert canonical("mailto:x") == "mailto:x"
    assert one(spark, text.host_in(text.host_of(F.lit("https://a.ex.com/x")), ["ex.com"])) is True
    assert one(spark, text.host_in(text.host_of(F.lit("nope")), ["ex.com"])) is False


def test_text(spark):
    assert one(spark, text.strip_html(F.lit("<p>a&amp;lt; b</p>\n c"))) == "a< b c"
    assert one(spark, text.norm(F.lit("Dev (m/f) – Ops!"))) == "dev ops"
    assert one(spark, text.word_hits(F.lit("team lead, süd"), ["lead", "tea", "d"])) == ["lead"]
    assert one(spark, text.model_json(F.lit('say {"k": 3} ok'), "k int"))["k"] == 3
    assert one(spark, text.model_json(F.lit("no"), "k int")) is None


def test_freshness_edges(spark):
    now = F.lit(dt.datetime(2024, 7, 1))
    for days, want in ((44, "fresh"), (60, "aging"), (179, "aging"), (200, "evergreen")):
        day = F.lit(dt.datetime(2024, 7, 1) - dt.timedelta(days=days))
        assert one(spark, lifecycle.freshness(day, day, now, F.lit(True), F.lit(None), now, now)) == want
    old = F.lit(dt.datetime(2024, 6, 1))
    assert one(spark, lifecycle.freshness(now, now, old, F.lit(True), F.lit(None), now, now)) == "delisted"
    assert one(spark, lifecycle.freshness(now, now, old, F.lit(False), F.lit(None), now, now)) == "fresh"


def test_canonical_urls_keep_names_that_may_matter(spark):
    canonical = lambda u: one(spark, text.canonical_url(F.lit(u)))
    assert canonical("https://ex.com/j?src=a&ref=b&source=c&_hsmi=1&igshid=2&WT_mc=3") == "https://ex.com/j?ref=b&source=c&src=a"
    assert canonical("https://ex.com/j?b=1&a-b=2&a=3&a=1") == "https://ex.com/j?a=3&a=1&a-b=2&b=1"
    assert canonical(" http://Ex.com:80?q=a%20b#x ") == "http://ex.com/?q=a+b"
    assert canonical("https://ex.com/a/?x") == "https://ex.com/a/?x="


def test_boilerplate_is_cut_at_the_first_match_of_a_marker(spark):
    cut = lambda t: one(spark, text.trim_boilerplate(F.lit(t)))
    body = "word " * 150
    assert cut(body + "We are an equal opportunity employer.") == (body + "We are an").rstrip()
    early = "equal opportunity employer " + body + "equal opportunity employer"
    assert cut(early + " \n\u00a0") == early  # the first match lies before 600: the marker says nothing
    assert cut("x" * 700 + "\nbenefits:\n" + "y" * 9000) == "x" * 700 + "\nbenefits:\n" + "y" * 9000  # under 30 %


def test_language_demands_of_the_shipped_table(spark):
    from tessera.functions import detect

    demands = lambda t: one(spark, detect.language_requirements(F.lit(t)))
    assert demands("Flytende norsk og engelsk") == ["no"]
    assert demands("Verhandlungssichere Deutsch, fluent in French") == ["de", "fr"]
    assert demands("Sehr gute Deutschkenntnisse erforderlich") == ["de"]
    assert demands("German B2 would be nice to have") == []
    assert demands("fluent Dutch; " + "x" * 90 + " a plus") == ["nl"]


def scored(spark, profile, *rows, places=None):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, description string, remote boolean, location string")
    got = scoring.score_postings(frame, profile, location="location", places=places).collect()
    return [r for r in sorted(got, key=lambda r: r["i"])]


def test_score_gates_and_ties(spark):
    profile = scoring.Profile((scoring.Track("a", "A", ("data",), ("sql",)), scoring.Track("b", "B", ("Cloud",), ("sql",), variants=("wolke",))), negative=("Intern",), role_negative=("sales",), signals=("engineer",))
    rows = scored(
        spark, profile, ("Data engineer", "", False, None), ("Data intern engineer", "", False, None), ("Cook", "", False, None), ("Engineer", "sql", False, None), ("Cloud data engineer", None, False, None),
        ("Sales engineer", "", False, None), ("Sales data engineer", "", False, None), ("Salesforce engineer", "sql", True, None), ("Wolke engineer", "", False, None),
    )
    assert (rows[0]["score"], rows[0]["track"]) == (40, "a")
    assert rows[1]["reason"] == "Excluded (Intern)" and rows[1]["disqualified"]
    assert rows[2]["reason"] == "No engineering role signal in title"
    assert (rows[3]["score"], rows[3]["track"], rows[3]["reason"]) == (5, "a", "A (body-only): sql")
    assert rows[4]["track"] == "a"
    assert rows[5]["reason"] == "Non-eng role (sales)" and rows[6]["track"] == "a"
    assert (rows[7]["score"], rows[7]["track"]) == (13, "a") and rows[8]["reason"] == "B: wolke"


def test_score_seniority_regions_and_languages(spark):
    tracks = (scoring.Track("a", "A", ("developer",)), scoring.Track("b", "B", ("unity",), avoid=("senior",)))
    profile = scoring.Profile(tracks, signals=("developer",), boost=("senior",), avoid=("principal", "head of"), accept=("europe", "berlin"))
    places = scoring.Places({"de": "Germany", "us": "United States"}, {"europe": ["de"]}, {}, {"germany": "de", "allemagne": "de", "usa": "us"})
    rows = scored(
        spark, profile, ("Senior developer", "", False, "Berlin"), ("Principal developer", "", False, None), ("Developer", "10+ years", False, ""), ("Leading developer", "", True, "Tokyo, USA"),
        ("Senior unity developer", "", False, "Frankfurt, Allemagne"), ("Developer", "Deutschkenntnisse", False, "Austin, USA"), ("Developer", "", False, "Darmstadt"), ("Headcount developer", "", False, None), places=places,
    )
    assert [r["score"] for r in rows] == [48, 32, 32, 48, 48, 0, 40, 40]
    assert rows[4]["track"] == "a" and rows[2]["seniority_level"] == "staff"
    assert rows[5]["reason"] == "Region mismatch (Austin, USA)" and rows[5]["lang_req"] == "de" and rows[5]["scored_by"] == "keyword"


def test_merge_keeps_what_is_not_refreshed(spark):
    old = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "k int, note string, v int")
    new = spark.createDataFrame([(2, "z", 5), (3, "w", 6)], "k int, note string, v int")
    assert sorted(map(tuple, relational.merge(old, new, "k", ["v"]).collect())) == [(1, "x", 1), (2, "y", 5), (3, "w", 6)]


def test_blend_inherits_keyword_rank(spark):
    rows = spark.createDataFrame([("a", 9, None), ("b", 5, 0.1), ("c", 1, 0.9)], "i string, s int, m double")
    got = {r["i"]: (r["kw_rank"], r["sim_rank"]) for r in ranking.blend(rows, "s", "m", "i").collect()}
    assert got == {"a": (0, 0.0), "b": (1, 2.0), "c": (2, 0.0)}
