"""Queries over functions whose inputs the tables lack: each part is given one of a few stated inputs, and the SQL states what must come out; and over funnels with stated clients."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.checkpoints import shared_folder
from tessera.functions import detect, places, profiles, prompts, slugs, text
from tessera.operators import audit, funnels, models
from tessera.plans.postings import _streamed, drained
from tessera.plans.registry import query, read
from tessera.sources import aggregators, boards, feeds, registers, requests
from tessera.streaming import events


def _given(values, at: Column) -> Column:
    kinds = {type(v) for v in values if v is not None}
    lit = lambda v: F.lit(v) if v is not None else F.lit(None).cast("string" if kinds <= {str} else "long")
    return F.element_at(F.array(*map(lit, values)), at)


def _cases(name: str, cases, build) -> None:
    """``cases``: (inputs, expected text or None). ``build`` makes a column of the inputs' columns."""

    def run(spark, sf_dir):
        at = (F.col("p_partkey") % len(cases) + 1).cast("int")
        inputs = [_given([c[0][k] for c in cases], at) for k in range(len(cases[0][0]))]
        rows = read(spark, sf_dir, "part").select("p_partkey", *(c.alias(f"x{k}") for k, c in enumerate(inputs)))
        return rows.select("p_partkey", build(*(F.col(f"x{k}") for k in range(len(inputs)))).cast("string").alias("value"))

    run.__name__ = name
    arms = " ".join(f"WHEN {k} THEN " + ("NULL" if want is None else "'" + want.replace("'", "''") + "'") for k, (_, want) in enumerate(cases))
    query(f"SELECT p_partkey, CASE p_partkey % {len(cases)} {arms} END AS value FROM part")(run)


def _joined(column: Column) -> Column:
    return F.array_join(column, "|", "-")


_cases("safe_slices", [(("abcdef",), "abc"), (("a😀bc",), "a😀b"), (("",), ""), ((None,), None)], lambda t: text.safe_slice(t, 3))
_cases("country_accepted", [(("de",), "true"), (("at",), "true"), (("fr",), "true"), (("gb",), "false"), (("tr",), "true"), ((None,), "false"), (("us",), "true")],
       lambda c: detect.country_passes(c, ["DACH", "france", "Istanbul", "us"], places.COUNTRY_NAMES, places.REGIONS, {}, {"istanbul": "tr"}))
_cases("level_blocked", [(("staff",), "true"), (("management",), "true"), (("senior",), "false"), (("intern",), "true"), (("mid",), "false"), (("unknown",), "false"), (("junior",), "false")],
       lambda level: detect.level_blocked(level, ("principal", "head of")))
_cases("names_match", [(("Azumo", "Azumo Inc"), "true"), (("Peak Therapy", "Peak Games"), "false"), (("Müller GmbH", "muller"), "true"), (("", "x"), "false"), (("GmbH", "Ltd"), "false"), (("Big Co", "bigco labs"), "true")], detect.names_match)
_cases("titled_tokens", [(("good-job-games",), "Good Job Games"), (("gapinc@wd1/ext",), "Gapinc"), (("a_b.c",), "A B C"), (("fooBar",), "FooBar"), (("",), "")], detect.titled_token)
_cases("language_barriers", [(("de,fr",), "fr"), (("en",), ""), (("nl,sv",), "nl|sv"), (("de",), "")], lambda codes: _joined(detect.language_barrier(F.split(codes, ","), ("en", "de"))))
_cases("posted_moments", [(("1704067200",), "2024-01-01 00:00:00"), (("1704067200000",), "2024-01-01 00:00:00"), (("2024-03-04T05:06:07Z",), "2024-03-04 05:06:07"), (("Tue, 02 Jan 2024 03:04:05 +0000",), "2024-01-02 03:04:05"), (("soon",), None), ((None,), None)],
       lambda v: F.date_format(detect.moment(v), "yyyy-MM-dd HH:mm:ss"))
_cases("split_companies", [(("Dev at Acme",), "Dev/Acme"), (("Dev - Acme",), "Dev/Acme"), (("Dev - Senior Engineer",), "Dev - Senior Engineer/"), (("Dev",), "Dev/"), (("Go - C - Acme",), "Go - C/Acme")],
       lambda t: F.concat(aggregators.split_company(t, F.lit(False))["title"], F.lit("/"), aggregators.split_company(t, F.lit(False))["company"]))
_cases("board_names", [(("board:lever:acme",), "lever,acme,"), (("board:workday:a@wd1/x|eu",), "workday,a@wd1/x,eu"), (("board:lever:a|b|c",), "lever,a|b,c"), (("indeed",), None), (("board::x",), None)],
       lambda n: F.when(slugs.board_name(n).isNotNull(), F.concat_ws(",", *(F.coalesce(slugs.board_name(n)[k], F.lit("")) for k in ("platform", "token", "region")))))
_cases("smelly_hosts", [(("careers.foo.com",), "true"), (("jobs.foo.com",), "true"), (("foo.com",), "false"), (("x.greenhouse.io",), "true"), (("myjobs.com",), "false"), ((None,), "false")], slugs.smells_like_board)
_cases("resolvable_urls", [(("https://ex.com/j",), "true"), (("https://www.linkedin.com/j",), "false"), (("https://talent.com/j",), "false"), (("mailto:x",), "false"), (("https://notlinkedin.com",), "true")], lambda u: F.coalesce(models.resolvable(u), F.lit(False)))
_cases("urls_in_text", [(("see https://a.io/x and //b.io",), "https://a.io/x|https://b.io"), (("https://a.io https://a.io",), "https://a.io"), (("none",), "")], lambda t: _joined(slugs.urls_in(t)))
_HTML = ('<a href="/careers#x">a</a><a href="//jobs.ex.com/">b</a><a href="/jobs">c</a>', '<a href="https://other.com/jobs">c</a><a href="/about">e</a>', '<a href="https://ex.com/join-us?a=1&amp;b=2">j</a>')
_cases("career_links", [((_HTML[0],), "https://ex.com/careers|https://jobs.ex.com/"), ((_HTML[1],), ""), ((_HTML[2],), "https://ex.com/join-us?a=1&b=2")], lambda h: _joined(slugs.career_links(h, F.lit("ex.com"))))
_PROBES = [
    (("lever", 200, '[{"a":1},{"a":2}]'), "active,2,"), (("lever", 404, "[]"), "dead,,"), (("smartrecruiters", 200, '{"totalFound": 0}'), "dead,,"), (("smartrecruiters", 200, '{"totalFound": 3, "content": [{"company": {"name": "SR Co"}}]}'), "active,3,SR Co"),
    (("workable", 200, '{"name": "W Co", "jobs": [{}, {}, {}]}'), "active,3,W Co"), (("recruitee", 200, '{"offers": [{"company_name": "R Co"}]}'), "active,1,R Co"), (("personio", 200, "<x><position><subcompany>P Co</subcompany></position><position></position></x>"), "active,2,P Co"),
    (("greenhouse", 200, '{"name": "G Co"}'), "active,,G Co"), (("ashby", 200, '{"jobs": []}'), "active,0,"), (("breezy", 302, ""), "dead,,"),
]
_cases("board_probes", _PROBES, lambda p, s, b: F.concat_ws(",", slugs.probe_result(p, s, b), F.coalesce(slugs.probe_count(p, s, b).cast("string"), F.lit("")), F.coalesce(slugs.probe_name(p, s, b), F.lit(""))))
_cases("duplicate_answers", [(('x {"candidates": [3, 1, 1, 9]} y',), "2|0"), (("no",), ""), (('{"candidates": []}',), "")], lambda r: _joined(models.parse_candidates(r, F.lit(3)).cast("array<string>")))
_cases("same_role_answers", [(('{"sameRole": true}',), "true"), (('so {"sameRole": false}',), "false"), (("yes",), "false")], models.parse_same_role)
_cases("place_answers", [(('{"answers": {"1": "DE", "2": "zz"}}',), "de|-"), (("?",), "-|-"), (('{"answers": {"2": "fr"}}',), "-|fr")], lambda r: _joined(models.parse_countries(r, F.lit(2), list(places.COUNTRY_NAMES))))
_cases("website_answers", [(('{"answers": {"1": "https://www.Acme.com/jobs", "2": "linkedin.com"}}',), "acme.com|-"), (('{"answers": {"1": "not a domain", "2": "playrix.com"}}',), "-|playrix.com"), (("?",), "-|-")], lambda r: _joined(prompts.parse_websites(r, F.lit(2))))
_cases("embed_texts", [(("Dev", "a text that is clearly longer than the title"), "Dev\na text that is clearly longer than the title"), (("Dev", "short"), "Dev"), (("Dev", None), "Dev")], models.embed_text)
_cases("div_contents", [(('<p>a</p><div class="x body"><div>b</div>c</div>d',), "<div>b</div>c"), (('<div class="other">a</div>',), None), (('<div class="body">open',), None), (('<div class="body"></div>',), "")], lambda h: text.div_content(h, "body"))
_cases("search_addresses", [(("c++ dev", 2), "https://s.example/?keywords=c%2B%2B+dev&location=Oslo&f_TPR=r604800&start=20|https://s.example/?was=c%2B%2B+dev&angebotsart=1&veroeffentlichtseit=7&size=100&page=2"),
       (("ü", 0), "https://s.example/?keywords=%C3%BC&location=Oslo&f_TPR=r604800&start=0|https://s.example/?was=%C3%BC&angebotsart=1&veroeffentlichtseit=7&size=100&page=0")],
       lambda q, n: F.concat_ws("|", requests.guest_search("https://s.example/", q, F.lit("Oslo"), n, 7), requests.agency_search("https://s.example/", q, n, 7)))
_cases("search_bodies", [(("Dev",), '{"keywords":["Dev"],"workloadPercentageMin":0,"workloadPercentageMax":100}'), (('"q"',), '{"keywords":["\\"q\\""],"workloadPercentageMin":0,"workloadPercentageMax":100}')], requests.room_search)
_cases("fit_prompts", [(("yes", "de"), "true,true"), (("no", ""), "false,false"), ((None, "de,fr"), "false,true")],
       lambda visa, asked: F.concat_ws(",", *(prompts.fit_prompt("cv", F.lit("T"), F.lit("C"), F.lit(None), F.lit("D"), visa, F.lit(False), F.filter(F.split(asked, ","), lambda x: x != "")).contains(s).cast("string") for s in ("offers sponsorship", "seems to ask for"))))
_cases("html_entities", [(("<td>A &amp; B</td>",), "A & B"), (("x &lt;y&gt; &#39;z&apos;",), "x <y> 'z'"), (("  a \n b ",), "a b")], registers._cell)


# ------------------------------------------------------------ registers, lists


@query("SELECT 'Co & ' || p_partkey AS name, 'IND recognised sponsor (KvK ' || p_size || ')' AS detail FROM part")
def dutch_register(spark, sf_dir):
    row = F.concat(F.lit('<tr><th scope="row">Co &amp; '), "p_partkey", F.lit("</th> <td> "), "p_size", F.lit(" </td></tr>"))
    return registers.dutch(read(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.collect_list(row), "\n").alias("body")))


@query("SELECT 'Co ' || p_partkey AS name, 'SIRI fast-track certified (CVR ' || (10000000 + p_partkey) || ')' AS detail FROM part")
def danish_register(spark, sf_dir):
    row = F.concat(F.lit("<tr><td>Co "), "p_partkey", F.lit("</td><td>"), F.col("p_partkey") + 10000000, F.lit("</td></tr>"))
    return registers.danish(read(spark, sf_dir, "part").groupBy("p_brand").agg(F.concat(F.lit("<tr><td>Name</td><td>CVR</td></tr>"), F.array_join(F.collect_list(row), "")).alias("body")))


@query("SELECT 'C ' || s_suppkey AS name FROM supplier")
def irish_register(spark, sf_dir):
    """A spreadsheet a nation, made on the executors."""

    def sheets(frames):
        import io
        import zipfile

        import pandas as pd

        for frame in frames:
            out = []
            for names in frame["names"]:
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr("xl/sharedStrings.xml", "<t>Employer Name</t>" + "".join(f"<t>{n}</t>" for n in names) + "<t>Total</t>")
                    z.writestr("xl/worksheets/sheet1.xml", "".join(f'<c r="A{i + 1}" t="s"><v>{i}</v></c>' for i in range(len(names) + 2)))
                out.append(data.getvalue())
            yield pd.DataFrame({"content": out})

    named = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.concat(F.lit("C "), "s_suppkey")).alias("names")).select("names")
    return registers.irish(named.mapInPandas(sheets, "content binary")).select("name")


@query("SELECT 'N' || p_partkey AS name, 'https://ex.org/' || p_partkey AS url FROM part WHERE p_partkey % 3 = 0")
def named_url_list(spark, sf_dir):
    k = F.col("p_partkey")
    line = F.when(k % 3 == 0, F.concat(F.lit("N"), k, F.lit("\thttps://ex.org/"), k)).when(k % 3 == 1, F.concat(F.lit("# c "), k)).otherwise(F.concat(F.lit("N"), k))
    return registers.named_urls(read(spark, sf_dir, "part").select(line.alias("value")))


@query("SELECT 'https://ex.org/' || p_partkey AS url FROM part WHERE p_partkey % 4 < 2")
def crawl_index_lines(spark, sf_dir):
    k = F.col("p_partkey")
    line = F.when(k % 4 == 0, F.concat(F.lit('{"url": "https://ex.org/'), k, F.lit('"}'))).when(k % 4 == 1, F.concat(F.lit("https://ex.org/"), k)).when(k % 4 == 2, '{"url": ').otherwise("")
    return registers.crawl_lines(read(spark, sf_dir, "part").select(line.alias("value")))


@query("SELECT 'Co ' || s_suppkey AS name, 'https://co' || s_suppkey AS website, CASE WHEN s_suppkey % 2 = 0 THEN 'DE|FR' ELSE '' END AS countries FROM supplier")
def company_lists(spark, sf_dir):
    k = F.col("s_suppkey")
    entry = F.concat(F.lit("  - name: 'Co "), k, F.lit("'\n    website: https://co"), k, F.when(k % 2 == 0, "\n    geo:\n      - country: DE\n      - country: FR").otherwise(""))
    files = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.concat(F.lit("companies:\n"), F.array_join(F.collect_list(entry), "\n"), F.lit("\njobportals:\n  - name: No\n")).alias("value"))
    return registers.company_list(files).select("name", "website", F.array_join("countries", "|").alias("countries"))


@query("SELECT p_partkey::VARCHAR AS custom_id, CASE WHEN p_partkey % 3 <> 0 THEN 'a ' || p_partkey END AS answer FROM part WHERE p_partkey % 5 <> 0")
def batch_answers(spark, sf_dir):
    k = F.col("p_partkey")
    done = F.concat(F.lit('{"custom_id":"'), k, F.lit('","result":{"type":"succeeded","message":{"content":[{"text":"a '), k, F.lit('"}]}}}'))
    failed = F.concat(F.lit('{"custom_id":"'), k, F.lit('","result":{"type":"errored"}}'))
    return registers.batch_results(read(spark, sf_dir, "part").select(F.when(k % 5 == 0, "broken {").when(k % 3 != 0, done).otherwise(failed).alias("value")))


@query("SELECT DISTINCT platform, token FROM (SELECT CASE p_brand WHEN 'Brand#1' THEN 'lever' WHEN 'Brand#2' THEN 'ashby' END AS platform, p_name AS token FROM part) WHERE platform IS NOT NULL")
def imported_boards(spark, sf_dir):
    aliases = spark.createDataFrame([("Brand#1", "lever"), ("Brand#2", "ashby")], "alias string, platform string")
    known, _ = registers.imported_boards(read(spark, sf_dir, "part").select(F.col("p_brand").alias("alias"), F.col("p_name").alias("token")), aliases)
    return known.distinct()


@query("SELECT 'feed' AS source, 'f.io/' || s_suppkey AS external_id, 'Dev ' || s_suppkey AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'Acme' ELSE 'Label' END AS company, s_suppkey % 2 = 1 AS remote FROM supplier")
def rss_feed_items(spark, sf_dir):
    k = F.col("s_suppkey")
    item = F.concat(F.lit("<item><title>Dev "), k, F.when(k % 2 == 0, " at Acme").otherwise(""), F.lit("</title><link>https://f.io/"), k, F.lit("</link>"), F.when(k % 2 == 1, "<category>x</category>").otherwise(""), F.lit("</item>"))
    again = F.concat(item, item)  # the first of each link stays
    pages = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.concat(F.lit("<rss>"), F.array_join(F.collect_list(again), ""), F.lit("</rss>")).alias("body"))
    rows = pages.select(F.lit("feed").alias("token"), F.col("s_nationkey").cast("int").alias("page"), "body")
    out = aggregators.feed_items(rows, F.lit("Label"), F.lit("at"))
    return out.select("source", "external_id", "title", "company", (F.col("company") == "Label").alias("remote"))


@query("SELECT DISTINCT keywords, location FROM (SELECT 'dev' AS keywords, n_name AS location FROM nation UNION ALL SELECT 'entwickler', n_name FROM nation WHERE n_nationkey % 5 = 0)")
def search_plans(spark, sf_dir):
    groups = spark.createDataFrame([("dev", "en"), ("entwickler", "de"), ("codeur", "fr")], "keywords string, lang string")
    spots = read(spark, sf_dir, "nation").select(F.col("n_name").alias("location"), F.when(F.col("n_nationkey") % 5 == 0, "de").alias("lang"), F.lit("city").alias("tier"))
    return aggregators.search_plan(groups, spots).select("keywords", "location")


@query("SELECT CASE s_suppkey % 3 WHEN 0 THEN 'lever' WHEN 1 THEN 'ashby' END AS platform, 'co' || s_suppkey AS token, count(*) AS n FROM supplier WHERE s_suppkey % 3 < 2 GROUP BY 1, 2")
def scanned_texts(spark, sf_dir):
    k = F.col("s_suppkey")
    said = F.concat(F.lit('Look: <a href="'), F.when(k % 3 == 0, "https://jobs.lever.co/co").when(k % 3 == 1, "//jobs.ashbyhq.com/co").otherwise("https://plain.org/co"), k, F.lit('/x">here</a>'))
    hits = slugs.scan(read(spark, sf_dir, "supplier").select("s_suppkey", said.alias("t")), "s_suppkey", "t")
    return hits.where("platform is not null").groupBy("platform", "token").agg(F.count("*").alias("n"))


# ----------------------------------------------------- funnels, stated clients


def _pages():
    """Every address ending in an even digit names a board, others nothing."""
    return lambda urls: [f"see https://jobs.lever.co/b{u.rsplit('/', 1)[-1]}" if u[-1] in "02468" else None for u in urls]


def _boards():
    """A board of the wanted platform answers to every name with an even number."""
    return lambda tries: [t.split("/")[1].replace("-", " ") if t.startswith("lever/") and t[-1] in "02468" else None for t in tries]


def _status():
    return lambda urls: [f"{404 if u.endswith('0') else 200}\n{'this position has expired' if u.endswith('5') else 'open'}" for u in urls]


def _judge():
    return lambda asked: [json.dumps({"fitScore": len(p) % 101, "verdict": "?"}) for p in asked]


def _limited():
    def ask(texts):
        raise models.RateLimited

    return ask


def _vectors():
    return lambda texts: [[float(len(t)), 0.0] for t in texts]


@query("SELECT DISTINCT platform, token FROM (SELECT 'lever' AS platform, 'b' || s_suppkey AS token FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 UNION ALL SELECT 'greenhouse', 'co' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 1)")
def harvested_boards(spark, sf_dir):
    k = F.col("s_suppkey")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://ex.org/"), k)).when(k % 3 == 1, F.concat(F.lit("https://boards.greenhouse.io/Co"), k)).otherwise(F.concat(F.lit("https://www.indeed.com/"), k))
    return models.harvest(read(spark, sf_dir, "supplier").select("s_suppkey", url.alias("url")), "s_suppkey", "url", _pages).select("platform", "token")


@query("SELECT 'Firm ' || s_suppkey AS name, 'lever' AS platform, 'firm' || s_suppkey AS slug FROM supplier WHERE s_suppkey % 2 = 0")
def probed_names(spark, sf_dir):
    names = read(spark, sf_dir, "supplier").select(F.concat(F.lit("Firm "), "s_suppkey").alias("name"))
    return models.probe_names(names, "name", ["greenhouse", "lever"], _boards)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 10 IN (0, 5) THEN 'expired' ELSE 'active' END AS liveness FROM supplier")
def swept_postings(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("https://ex.org/"), "s_suppkey").alias("url"))
    return models.sweep(rows, "url", _status).select("s_suppkey", "liveness")


@query("SELECT s_suppkey, (10 + length(s_suppkey::VARCHAR)) % 101 AS score, 'weak' AS verdict FROM supplier")
def judged_postings(spark, sf_dir):
    """The first provider is out of budget, so the second one answers."""
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Posting n "), "s_suppkey").alias("prompt"))
    asked = models.ask(rows, "prompt", models.chain(_limited, _judge))
    return asked.select("s_suppkey", models.parse_fit(F.col("answer")).alias("f")).select("s_suppkey", "f.score", "f.verdict")


@query("SELECT s_suppkey, 1.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM supplier")
def embedded_texts(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Posting "), "s_suppkey").alias("t"))
    out = models.embed(rows, "t", _vectors)
    return out.select("s_suppkey", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"))


@query("SELECT vec_id, round(greatest(embedding[1]::DOUBLE, embedding[2]::DOUBLE), 6) AS sim FROM embeddings")
def best_query_similarity(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    axes = [[1.0 if i == k else 0.0 for i in range(64)] for k in (0, 1)]
    return models.best_similarity(vectors, "embedding", axes).select("vec_id", F.round("sim", 6).alias("sim"))


@query("SELECT o_orderkey, duplicate_of FROM (SELECT a.o_orderkey, max(b.o_orderkey) AS duplicate_of FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey < a.o_orderkey AND a.o_orderpriority = b.o_orderpriority AND b.o_orderkey % 2 = 0 WHERE a.o_orderkey % 2 = 1 GROUP BY 1)")
def semantic_duplicates(spark, sf_dir):
    """A candidate of the company with the same title is the same role; of several the latest."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Company "), "o_custkey").alias("company"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("seen"), F.lit(None).cast("long").alias("duplicate_of"))
    new, stored = orders.where("o_orderkey % 2 = 1"), orders.where("o_orderkey % 2 = 0")
    pairs = models.duplicate_candidates(new, stored, "o_orderkey", "company", "seen", most=10_000)
    titles = orders.select("o_orderkey", "title")
    both = pairs.join(titles, "o_orderkey").join(titles.select(F.col("o_orderkey").alias("candidate"), F.col("title").alias("other")), "candidate")
    same = both.where((F.col("candidate") < F.col("o_orderkey")) & models.same_role(F.col("title"), F.col("other")))
    return same.groupBy("o_orderkey").agg(F.max("candidate").alias("duplicate_of"))


# -------------------------------------------------------------------- streams


@query("""WITH e AS (SELECT user_id::VARCHAR AS k, ts, event_id, avg((event_type = 'purchase')::INT::DOUBLE) OVER (PARTITION BY user_id, ts) AS rate FROM events), l AS (SELECT k, list(rate ORDER BY ts, event_id) AS rates FROM e GROUP BY 1)
SELECT k, list_reduce(list_prepend(1, list_transform(rates, lambda r: CASE WHEN r > 0 THEN -1 ELSE 0 END)), lambda a, r: CASE WHEN r < 0 THEN 1 ELSE least(30, greatest(2, a * 2)) END) AS interval_days, len(rates) AS n FROM l""")
def stream_board_cadence(spark, sf_dir):
    """The last interval of each key; events are one fetch each."""
    seen = _streamed(spark, sf_dir).select(F.col("user_id").cast("string").alias("k"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("rate"))
    out = drained(spark, events.cadence(seen, "k", "ts", "rate"))
    return out.groupBy("k").agg(F.max_by("interval_days", "at").alias("interval_days"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id::VARCHAR AS k, ts, CASE event_type WHEN 'signup' THEN 'applied' WHEN 'error' THEN 'ignored' WHEN 'purchase' THEN 'offer' ELSE 'interview' END AS to_ FROM events)
SELECT k, arg_max(to_, ts) AS status, strftime(min(ts) FILTER (to_ = 'applied'), '%Y-%m-%d %H:%M:%S') AS applied, CASE WHEN arg_max(to_, ts) = 'ignored' THEN 'why' END AS reason, count(*) AS n FROM e GROUP BY 1""")
def stream_status_log(spark, sf_dir):
    kind = F.col("event_type")
    to = F.when(kind == "signup", "applied").when(kind == "error", "ignored").when(kind == "purchase", "offer").otherwise("interview")
    acts = _streamed(spark, sf_dir).select(F.col("user_id").cast("string").alias("k"), F.col("ts").cast("timestamp").alias("ts"), to.alias("to"), F.lit("why").alias("why"))
    log = drained(spark, events.status_log(acts, "k", "ts", "to", "why"))
    last = F.max_by(F.struct("status", "applied_at", "reason"), "at")
    return log.groupBy("k").agg(last.alias("s"), F.count("*").alias("n")).select("k", "s.status", F.date_format("s.applied_at", "yyyy-MM-dd HH:mm:ss").alias("applied"), "s.reason", "n")


@query("SELECT user_id, event_type, count(*) FILTER (n = 1) AS kept FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS n FROM events) GROUP BY 1, 2")
def stream_first_seen(spark, sf_dir):
    """Each key once, within a horizon that spans the table."""
    seen = events.first_seen(_streamed(spark, sf_dir).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), ["user_id", "event_type"], "ts", "400 days")
    return drained(spark, seen.select("user_id", "event_type", "ts")).groupBy("user_id", "event_type").agg(F.count("*").alias("kept"))


@query("SELECT p_partkey::VARCHAR AS custom_id, 'Say ' || p_partkey AS content FROM part")
def batch_request_lines(spark, sf_dir):
    folder = f"{shared_folder(spark)}/requests-{uuid.uuid4().hex}"
    models.write_requests(read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Say "), "p_partkey").alias("prompt")), "p_partkey", "prompt", folder)
    lines = spark.read.text(folder)
    return lines.select(F.get_json_object("value", "$.custom_id").alias("custom_id"), F.get_json_object("value", "$.params.messages[0].content").alias("content"))



# ---------------------------------------------------- further feeds and readers


@query("SELECT CASE s_suppkey % 3 WHEN 0 THEN 'nodesk' WHEN 1 THEN 'pythonorg' ELSE 'mozillajobs' END AS source, 'f.io/' || s_suppkey AS external_id, 'Dev ' || s_suppkey AS title, CASE s_suppkey % 3 WHEN 2 THEN 'Mozilla' ELSE 'Acme' END AS company, s_suppkey % 3 = 0 AS remote FROM supplier")
def declared_feeds(spark, sf_dir):
    k = F.col("s_suppkey")
    feed = F.when(k % 3 == 0, "nodesk").when(k % 3 == 1, "pythonorg").otherwise("mozillajobs")
    item = F.concat(F.lit("<item><title>Dev "), k, F.when(k % 3 == 0, " at Acme").when(k % 3 == 1, " - Acme").otherwise(""), F.lit("</title><link>https://f.io/"), k, F.lit("</link></item>"))
    rows = read(spark, sf_dir, "supplier").groupBy(feed.alias("token"), F.col("s_nationkey").cast("int").alias("page")).agg(F.concat(F.lit("<rss>"), F.array_join(F.collect_list(item), ""), F.lit("</rss>")).alias("body"))
    return feeds.feed_postings(rows).select("source", "external_id", "title", "company", "remote")


@query("SELECT s_suppkey::VARCHAR AS external_id, 'Dev ' || s_suppkey AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'https://x/' || s_suppkey ELSE 'https://www.job-room.ch/job-search/' || s_suppkey END AS url, 'Co' AS company, CASE WHEN s_suppkey % 3 = 0 THEN 'Bern, Switzerland' ELSE 'Switzerland' END AS location, 'p q' AS description FROM supplier")
def swiss_cards(spark, sf_dir):
    k = F.col("s_suppkey")
    content = F.concat(F.lit('"jobContent":{"jobDescriptions":[{"title":"<em>Dev</em> '), k, F.lit('","description":"<p>p</p> q"}],"company":{"name":"Co"}'), F.when(k % 3 == 0, ',"location":{"city":"Bern"}').otherwise(""), F.when(k % 2 == 0, F.concat(F.lit(',"externalUrl":"https://x/'), k, F.lit('"'))).otherwise(""), F.lit("}"))
    ad = F.concat(F.lit('{"id":"'), k, F.lit('",'), content, F.lit("}"))
    item = F.when(k % 2 == 0, F.concat(F.lit('{"jobAdvertisement":'), ad, F.lit("}"))).otherwise(ad)
    pages = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("body"))
    rows = pages.select(F.lit("ch").alias("token"), F.lit("").alias("company"), F.lit("").alias("region"), F.col("s_nationkey").cast("int").alias("page"), "body")
    return boards.postings(rows, feeds.SWISS).select("external_id", "title", "url", "company", "location", "description")


@query("SELECT s_suppkey::VARCHAR AS external_id, 'Dev ' || s_suppkey AS title, 'Co & Co' AS company, 'Oslo' AS location, CASE WHEN s_suppkey % 2 = 0 THEN 'https://l/jobs/view/x-' || s_suppkey ELSE 'https://www.linkedin.com/jobs/view/' || s_suppkey END AS url FROM supplier")
def guest_cards(spark, sf_dir):
    k = F.col("s_suppkey")
    card = F.concat(
        F.lit('<div data-entity-urn="urn:li:jobPosting:'), k, F.lit('">'), F.when(k % 2 == 0, F.concat(F.lit('<a class="base-card__full-link" href="https://l/jobs/view/x-'), k, F.lit('?a=1&amp;b=2"></a>'))).otherwise(""), F.lit('<h3 class="base-search-card__title"> Dev '), k,
        F.when(k % 3 == 0, ' </h3><a class="hidden-nested-link" href="c">Co &amp; Co</a>').otherwise(' </h3><h4 class="base-search-card__subtitle"><span> Co &amp; Co </span></h4>'), F.lit('<span class="job-search-card__location"> Oslo </span></div>'),
    )
    pages = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.concat(F.lit("<ul>"), F.array_join(F.collect_list(card), ""), F.lit("</ul>")).alias("body"))
    rows = pages.select(F.lit("g").alias("token"), F.lit("").alias("company"), F.lit("").alias("region"), F.col("s_nationkey").cast("int").alias("page"), "body")
    return boards.postings(rows, feeds.GUEST).select("external_id", "title", "company", "location", "url")


@query("SELECT CASE WHEN p_size % 2 = 0 THEN 'lever' ELSE 'workday' END AS source, 'data/date=2024-01-0' || (1 + p_size % 5) || '/source=' || CASE WHEN p_size % 2 = 0 THEN 'lever' ELSE 'workday' END || '/f' || p_partkey || '.parquet' AS path FROM part WHERE p_partkey % 3 <> 0 AND p_size % 5 = (SELECT max(p_size % 5) FROM part WHERE p_partkey % 3 <> 0)")
def latest_dataset_files(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    path = F.concat(F.lit("data/date=2024-01-0"), 1 + n % 5, F.lit("/source="), F.when(n % 2 == 0, "lever").otherwise("workday"), F.lit("/f"), k, F.when(k % 3 == 0, ".json").otherwise(".parquet"))
    return feeds.latest_files(read(spark, sf_dir, "part").select(path.alias("path"))).select("source", "path")


@query("SELECT DISTINCT 'lever' AS platform, CASE p_partkey % 3 WHEN 0 THEN 'co' || p_size ELSE 'slug' || p_size END AS token, CASE p_partkey % 3 WHEN 0 THEN 'eu' ELSE '' END AS region FROM part")
def dataset_boards(spark, sf_dir):
    """The URL's board, the slug where the URL is missing or of another platform; rows of unknown sources go."""
    k, n = F.col("p_partkey"), F.col("p_size")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://jobs.eu.lever.co/co"), n)).when(k % 3 == 1, "https://jobs.ashbyhq.com/other")
    rows = read(spark, sf_dir, "part").select(F.lit("lever").alias("source"), F.concat(F.lit(" Slug"), n).alias("source_slug"), url.alias("apply_url"))
    return feeds.dataset_hits(rows.unionByName(rows.withColumn("source", F.lit("nowhere"))))


@query("SELECT 'Co ' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'co' || s_suppkey || '.com' END AS website FROM supplier WHERE s_suppkey % 4 <> 3")
def portfolio_companies(spark, sf_dir):
    k = F.col("s_suppkey")
    one = F.struct(F.concat(F.lit("Co "), k).alias("name"), F.when(k % 4 == 0, "Active").when(k % 4 == 1, "").when(k % 4 == 2, "Public").otherwise("Inactive").alias("status"), F.when(k % 2 == 0, F.concat(F.lit("https://www.Co"), k, F.lit(".com/about"))).otherwise("no site").alias("website"))
    pages = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(one).alias("companies"))).alias("body"))
    return feeds.portfolio(pages)


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN 'A b' || chr(10) || 'c' || chr(10) || chr(10) || 'd' || repeat('x', 200) END AS cv FROM documents")
def cv_texts(spark, sf_dir):
    raw = F.when(F.length("text") > 400, "  A \t b \r\n c\r\r\n\n\n\n d" + "x" * 200 + " \n ").otherwise("short")
    return read(spark, sf_dir, "documents").select("doc_id", feeds.cv_text(raw).alias("cv"))


def _profile():
    families = (profiles.Family("eng", "Engineering", ("engineer", "developer")), profiles.Family("ops", "Operations", ("operations manager", "logistics")))
    raw = json.dumps({"families": ["eng", "moon"], "tracks": [{"key": "Data Eng!", "titleKeywords": ["data engineer", "ETL"], "bodyKeywords": ["sql", "spark", "python"], "searchVariants": {"de": ["Dateningenieur"], "xx": ["no"]}}, {"key": "ml", "titleKeywords": ["ml", "machine learning"], "bodyKeywords": ["torch", "jax", "cuda"]}], "searchQueries": ["data engineer remote"], "seniority": {"boost": ["senior"], "avoid": []}})
    return profiles.parse_profile(raw, families)[0]


@query("""SELECT * FROM (VALUES ('data-eng', 'data engineer,etl,dateningenieur'), ('ml', 'ml,machine learning'), ('general-eng', 'engineer,developer'), ('signals', 'engineer,developer'), ('negatives', 'operations manager,logistics'), ('boost', 'senior')) AS t(part, words)""")
def generated_profile(spark, sf_dir):
    p = _profile()
    rows = [(t.key, ",".join(t.titles)) for t in p.tracks] + [("signals", ",".join(p.signals)), ("negatives", ",".join(p.role_negative)), ("boost", ",".join(p.boost))]
    return spark.createDataFrame(rows, "part string, words string")


# -------------------------------------------------------- funnels to the end


def _site():
    """Home pages of even companies link a careers page; that page names a board."""

    def one(url: str) -> str | None:
        number = int(url.removeprefix("https://co").split(".")[0])
        if number % 4 == 3:
            return None
        if "careers" in url or "jobs" in url.split("/")[-1]:
            return f"200\n<a href='https://jobs.lever.co/c{number}'>board</a>" if number % 4 != 1 else "404\n"
        return f"200\n<a href=\"/careers-{number}\">join us</a>" + (f" https://jobs.ashbyhq.com/c{number}" if number % 4 == 0 else "")

    return lambda urls: [one(u) for u in urls]


def _probe():
    """Boards of numbers divisible by four answer with two postings, those by six with none; others are gone or silent."""

    def one(url: str) -> str | None:
        number = int("".join(c for c in url.split("?")[0].split("/")[-1] if c.isdigit()) or 0)
        if number % 5 == 0:
            return None
        rows = '[{"id": 1}, {"id": 2}]' if number % 4 == 0 else "[]"
        return f"200\n{rows if 'lever' in url else json.dumps({'jobs': json.loads(rows)})}" if number % 2 == 0 else "404\n"

    return lambda urls: [one(u) for u in urls]


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'error' WHEN s_suppkey % 2 = 0 THEN 'active' ELSE 'dead' END AS result, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 4 = 0 THEN 2 WHEN s_suppkey % 5 <> 0 AND s_suppkey % 2 = 0 THEN 0 END AS job_count FROM supplier")
def probed_boards(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "lever").otherwise("ashby").alias("platform"), F.concat(F.lit("c"), "s_suppkey").alias("token"), F.lit("").alias("region"))
    return funnels.probed(rows, _probe).select("s_suppkey", "result", "job_count")


@query("SELECT 'Co ' || s_suppkey AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'ashby' ELSE 'lever' END AS platform, 'c' || s_suppkey AS token FROM supplier WHERE s_suppkey % 4 IN (0, 2)")
def company_site_boards(spark, sf_dir):
    companies = read(spark, sf_dir, "supplier").select(F.concat(F.lit("Co "), "s_suppkey").alias("name"), F.concat(F.lit("co"), "s_suppkey", F.lit(".com")).alias("domain"))
    return funnels.site_boards(companies, _site).select("name", "platform", "token")


@query("SELECT 'Co ' || s_suppkey AS name, 'ashby' AS platform, 'c' || s_suppkey AS token FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey % 5 <> 0")
def verified_site_boards(spark, sf_dir):
    companies = read(spark, sf_dir, "supplier").select(F.concat(F.lit("Co "), "s_suppkey").alias("name"), F.concat(F.lit("co"), "s_suppkey", F.lit(".com")).alias("domain"))
    return funnels.verified(funnels.site_boards(companies, _site), _probe).select("name", "platform", "token")


def _verdicts():
    def one(prompt: str) -> str | None:
        n = int(prompt.split()[-1])
        return None if n % 7 == 0 else json.dumps({"fitScore": n % 101, "verdict": "weak" if n % 2 else None, "category": "NO_VISA", "seniorityLevel": "staff" if n % 3 == 0 else "unknown"})

    return lambda prompts_: [one(p) for p in prompts_]


@query("""WITH v AS (SELECT p_partkey AS id, p_partkey % 7 <> 0 AS done, p_partkey % 101 AS s, p_partkey FROM part)
SELECT id, CASE WHEN done THEN s::INT END AS fit_score, CASE WHEN done AND (p_partkey % 2 = 1 OR s < 40) THEN 'no' ELSE 'unknown' END AS visa, CASE WHEN done AND p_partkey % 3 = 0 THEN 'staff' ELSE 'mid' END AS seniority_level, done AS logged FROM v""")
def judged_with_history(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(None).cast("int").alias("fit_score"), F.lit("unknown").alias("visa"), F.lit("mid").alias("seniority_level"))
    after, log = funnels.judged(rows, F.concat(F.lit("Posting "), F.col("id")), _verdicts, "m", "v1", F.lit("2024-01-01").cast("timestamp"))
    return after.join(log.select("id", F.lit(True).alias("in_log")), "id", "left").select("id", "fit_score", "visa", "seniority_level", F.coalesce("in_log", F.lit(False)).alias("logged"))


def _details():
    return lambda urls: [f'200\n<meta property="og:description" content="{"word " * 30 if int(u[-1]) % 2 else "short"}">' for u in urls]


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN rtrim(repeat('word ', 30)) ELSE p_name END AS description FROM part")
def filled_descriptions(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.lit("Dev").alias("title"), F.col("p_name").alias("description"))
    return funnels.described(rows, F.concat(F.lit("https://ex.org/"), "p_partkey"), funnels.og_description(F.col("page")), _details).select("p_partkey", "description")


def _letters():
    return lambda asked: [None if "small" in p else f" Dear {p.split('for ')[-1]} " for p in asked]


@query("SELECT p_partkey, CASE WHEN NOT contains(p_name, 'small') THEN 'Dear ' || p_name END AS cover_letter FROM part")
def cover_letters(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return funnels.written(rows, F.concat(F.lit("A letter for "), "p_name"), _letters).select("p_partkey", "cover_letter")


@query("SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'https://api.eu.lever.co/v0/postings/a?mode=json' WHEN 1 THEN 'https://api.ashbyhq.com/posting-api/job-board/a%20b' WHEN 2 THEN 'https://t.wd5.myworkdayjobs.com/wday/cxs/t/ext/jobs' WHEN 3 THEN NULL ELSE NULL END AS url FROM supplier")
def probe_addresses(spark, sf_dir):
    k = F.col("s_suppkey") % 5
    platform = F.when(k == 0, "lever").when(k == 1, "ashby").when(k == 4, "nowhere").otherwise("workday")
    token = F.when(k == 0, "a").when(k == 1, "a b").when(k == 2, "t@wd5/ext").otherwise("broken")
    return read(spark, sf_dir, "supplier").select("s_suppkey", funnels.probe_url(platform, token, F.when(k == 0, "eu").otherwise("")).alias("url"))


# ------------------------------------------------------------- crawl accounting

_CRAWLED = (
    ("https://jobs.lever.co/acme{}", "matched"), ("https://plain.org/x{}", "foreign"), ("nonsense{}", "unparseable"), ("https://jobs.lever.co/robots.txt", "robots.txt"), ("https://acme.recruitee.com/sitemap.xml?a={}", "matched"), ("https://jobs.lever.co/", "root"),
    ("https://jobs.lever.co/embed/{}", "denied segment"), ("https://jobs.lever.co/v2/{}", "version"), ("https://jobs.lever.co/%zz{}", "bad encoding"), ("https://jobs.lever.co/-bad{}", "bad token"), ("https://recruitee.com/{}", "apex"), ("https://a.b.recruitee.com/{}", "nested label"), ("https://www.recruitee.com/{}", "denied label"), ("https://join.com/about{}", "UNEXPLAINED"),
)


def _crawled(spark, sf_dir):
    at = (F.col("p_partkey") % len(_CRAWLED) + 1).cast("int")
    url = F.replace(F.element_at(F.array(*(F.lit(u) for u, _ in _CRAWLED)), at), F.lit("{}"), F.col("p_size").cast("string"))
    return audit.classified(read(spark, sf_dir, "part").select("p_partkey", url.alias("url")))


_BUCKET = "CASE p_partkey % 14 " + " ".join(f"WHEN {i} THEN '{b}'" for i, (_, b) in enumerate(_CRAWLED)) + " END"


@query(f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM part GROUP BY 1")
def crawl_accounting(spark, sf_dir):
    return audit.accounting(_crawled(spark, sf_dir))


@query("SELECT 'lever' AS platform, count(DISTINCT p_size) FILTER (p_partkey % 14 = 0) AS boards FROM part UNION ALL SELECT 'recruitee', 1")
def crawl_unique_boards(spark, sf_dir):
    return audit.unique_boards(_crawled(spark, sf_dir))


@query("SELECT 'about' || p_size AS segment, count(*) AS n FROM part WHERE p_partkey % 14 = 13 GROUP BY 1 ORDER BY n DESC, segment LIMIT 15")
def crawl_offending_segments(spark, sf_dir):
    return audit.offending_segments(_crawled(spark, sf_dir))


@query("""WITH c AS (SELECT p_partkey AS id, (p_partkey * 37) % 101 AS score FROM part), a AS (SELECT * FROM c WHERE score >= 20), t AS (SELECT id FROM a ORDER BY score DESC, id LIMIT 25)
SELECT a.id, t.id IS NOT NULL AS detail FROM a LEFT JOIN t USING (id)""")
def two_stage_cards(spark, sf_dir):
    """Cards above the score gate; the best within the budget get their details, the others stay with what the card says."""
    cards = read(spark, sf_dir, "part").select("p_partkey", F.lit("s").alias("source"), F.col("p_partkey").cast("string").alias("external_id"), (F.col("p_partkey") * 37 % 101).alias("score"))
    return boards.detail_plan(cards, "score", 20, 25, [F.desc("score"), F.col("p_partkey")], keep_rest=True).select(F.col("p_partkey").alias("id"), "detail")


@query("""SELECT arg_min(p_name, p_partkey) AS name, arg_min('Worker "' || p_brand || '", A — ' || p_type, p_partkey) AS detail FROM part WHERE p_partkey < 1000 GROUP BY lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g'))""")
def british_register_csv(spark, sf_dir):
    """The register as a file of quoted CSV in the shared folder, read back: a company's first route in file order."""
    folder = f"{shared_folder(spark)}/register-{uuid.uuid4().hex}"
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    rating = F.concat(F.lit('Worker "'), "p_brand", F.lit('", A'))
    line = F.concat_ws(",", quoted(F.col("p_name")), F.lit("Town"), F.lit(""), quoted(rating), quoted(F.col("p_type")))
    rows = read(spark, sf_dir, "part").where("p_partkey < 1000").select("p_partkey", line.alias("line"))
    head = spark.createDataFrame([(-1, "Organisation Name,Town/City,County,Type & Rating,Route")], "p_partkey long, line string")
    head.unionByName(rows).coalesce(1).sortWithinPartitions("p_partkey").select("line").write.text(folder)
    return registers.british(spark, folder)
