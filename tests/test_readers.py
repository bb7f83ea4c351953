"""Pages over HTTP from a server of our own, profiles and prompts."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tessera.functions import places, profiles, prompts
from tessera.sources import feeds, http, requests


@pytest.fixture(scope="module")
def site():
    seen = {}

    class Pages(BaseHTTPRequestHandler):
        def _answer(self, status, body=b"", **headers):
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            seen[self.path] = seen.get(self.path, 0) + 1
            if self.path == "/busy" and seen[self.path] < 3:
                return self._answer(429)
            if self.path.startswith("/go"):
                n = int(self.path[3:] or 0)
                return self._answer(302, Location=f"/go{n + 1}" if n < 3 else "/end")
            if self.path == "/lost":
                return self._answer(404, b"no")
            return self._answer(200, f"page {self.path}".encode())

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            self._answer(200, json.dumps({"got": body.decode(), "as": self.headers.get("X-Kind")}).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_pages(spark, site):
    base, seen = site
    urls = [f"{base}/a", f"{base}/a", f"{base}/busy", f"{base}/go", f"{base}/lost", "http://127.0.0.1:9/none", "nonsense", None]
    rows = {r["url"]: r for r in http.pages(spark.createDataFrame([(u,) for u in urls], "url string"), tasks=2, wait=0.01, tries=3).collect()}
    assert len(rows) == 6 and (rows[f"{base}/a"]["status"], rows[f"{base}/a"]["body"]) == (200, "page /a") and seen["/a"] == 1
    assert rows[f"{base}/busy"]["status"] == 200 and seen["/busy"] == 3
    assert rows[f"{base}/go"]["final"] == f"{base}/end" and rows[f"{base}/lost"]["status"] == 404
    assert rows["http://127.0.0.1:9/none"]["status"] is None and rows["nonsense"]["error"]
    assert http.fetch(f"{base}/go", hops=0)[0] == 302 and http.fetch(f"{base}/go", hops=2)[0] == 302
    assert http.client()()([f"{base}/a", "nonsense"]) == ["200\npage /a", None]


def test_data_source(spark, site):
    base, _ = site
    spark.dataSource.register(http.HttpPages)
    got = spark.read.format("http_pages").option("urls", f"{base}/p{{page}}\n{base}/one").option("pages", "2-4").load()
    assert sorted(r["body"] for r in got.collect()) == ["page /one", "page /p2", "page /p3", "page /p4"]
    posted = spark.read.format("http_pages").option("urls", f"{base}/x").option("method", "POST").option("body", "hi").option("header.X-Kind", "k").load()
    assert json.loads(posted.first()["body"]) == {"got": "hi", "as": "k"}
    assert spark.read.format("http_pages").option("urls", f"{base}/go").option("redirect", "manual").load().first()["status"] == 302


FAMILIES = (profiles.Family("eng", "Engineering", ("engineer", "developer")), profiles.Family("qa", "Quality", ("qa engineer",)))
GOOD = {"families": ["eng"], "tracks": [{"key": k, "titleKeywords": [f"{k} one", f"{k} two", "x"], "bodyKeywords": ["aa", "bb", "cc", "AA "]} for k in ("one", "two")], "searchQueries": ["find"]}


def test_profiles():
    profile, queries = profiles.parse_profile("sure: " + json.dumps(GOOD) + " bye", FAMILIES)
    assert [t.key for t in profile.tracks] == ["one", "two", "general-eng"] and profile.tracks[0].body == ("aa", "bb", "cc") and queries == ["find"]
    assert profile.signals == ("engineer", "developer") and profile.role_negative == ("qa engineer",)
    for broken in ({"families": []}, {"families": ["moon"]}, {"tracks": GOOD["tracks"][:1]}, {"tracks": [GOOD["tracks"][0]] * 2}, {"searchQueries": []}, {"tracks": [{**GOOD["tracks"][0], "titleKeywords": ["x"]}, GOOD["tracks"][1]]}):
        with pytest.raises(ValueError):
            profiles.parse_profile(json.dumps({**GOOD, **broken}), FAMILIES)
    with pytest.raises(ValueError):
        profiles.parse_profile("no idea", FAMILIES)
    assert profiles.clean_variants({"de": ["Ent\u2011wickler", "ab", 3, "Entwickler", "entwickler", "Koch", "Bäcker"], "xx": ["word"], "fr": "no"}) == {"de": ["ent-wickler", "entwickler", "koch"]}
    assert profiles.cv_hash("a") != profiles.cv_hash("a", "b") and len(profiles.cv_hash("")) == 40
    assert profiles.search_groups(profile) == [{"en": ["one one"]}, {"en": ["two one"]}]
    assert profile.appetite("one") == profile.appetite(None) == profile.appetite("nope")


def test_prompts_and_requests(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    asked = one(prompts.fit_prompt("CV", F.lit("T"), F.lit("C"), F.lit(None).cast("string"), F.lit("text"), F.lit("yes"), F.lit(True), F.array(F.lit("de"))))
    assert "register of sponsors" in asked and "offers sponsorship" not in asked and "n/a" in asked and asked.index("<JOB_POSTING>") < asked.index("text") < asked.index("</JOB_POSTING>")
    assert "2. b" in one(prompts.places_prompt(F.array(F.lit("a"), F.lit("b")))) and "B: y" in one(prompts.compare_prompt(F.lit("x"), F.lit(None), F.lit("y"), F.lit("d")))
    assert prompts.FIT_SHAPE in prompts.fit_system("Ann", ["en"])
    url = one(requests.free_search("https://s/", F.lit("a b"), F.lit(2), 7, remote=True))
    assert url == "https://s/?q=a+b&limit=50&offset=100&semantic_ratio=0&include_description=true&description_format=text&posted_within_days=7&work_mode=remote&regions=eu"
    assert requests.listed(" DE, ,fr", ["x"]) == ["de", "fr"] and requests.listed("", ["x"]) == ["x"]
    assert len(feeds.FEEDS) == 66 and places.countries_in(["tr", "uk-ie", "x"]) == ["tr", "gb", "ie"]
    assert one(feeds.guest_detail(F.lit('<div class="show-more-less-html__markup x"><p>a</p><div>b</div></div>'))) == "a b"
