"""The registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import lifecycle, text
from tessera.operators import ledger, ranking, relational, scoring

FLAGSHIP = "keyword_score_documents"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NOW = "2024-02-01 00:00:00"
PROFILE = scoring.Profile(
    tracks=(scoring.Track("alpha", "Alpha", ("the", "der"), ("with", "und", "que")), scoring.Track("beta", "Beta", ("of", "la"), ("this", "est", "von"))),
    negative=("idiot", "nd"),
    role_negative=("ea", "ti"),
    signals=("th", "er", "la", "de"),
    boost=("the",),
    avoid=("of", "und"),
)


def _titled(docs: DataFrame) -> DataFrame:
    cut = F.substring_index("text", "\n", 1)
    return docs.select("doc_id", cut.alias("title"), F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("body"), (F.col("doc_id") % 3 == 0).alias("remote"))


def _sql_hits(column: str, words) -> str:
    return "(" + " + ".join(f"(contains({column}, '{w}'))::INT" for w in words) + ")"


def _sql_word(column: str, words) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '(^|[^a-zà-ü]){w}($|[^a-zà-ü])') THEN '{w}'" for w in words) + " END"


def _sql_listed(column: str, words) -> str:
    return "[x for x in [" + ", ".join(f"CASE WHEN contains({column}, '{w}') THEN '{w}' END" for w in words) + "] if x is not null]"


def _sql_track(t: scoring.Track, place: int) -> str:
    n, b = _sql_hits("low", t.title), _sql_hits("txt", t.body)
    names = f"array_to_string(list_distinct_ordered({_sql_listed('low', t.title)} || {_sql_listed('txt', t.body)})[1:5], ', ')".replace("list_distinct_ordered(", "(")
    return (
        f"{n} AS n{place}, 40 * {n} + 5 * least({b}, 5) AS raw{place}, "
        f"greatest(0, least(100, least(CASE WHEN {n} > 0 THEN 40 * {n} + 5 * least({b}, 5) ELSE least(5 * least({b}, 5), 22) END + CASE WHEN remote THEN 8 ELSE 0 END, 100) + adj)) AS s{place}, "
        f"'{t.label}' || CASE WHEN {n} > 0 THEN ': ' ELSE ' (body-only): ' END || {names} AS r{place}"
    )


_SCORED = f"""
WITH d AS (
  SELECT doc_id, string_split(text, chr(10))[1] AS title, substr(text, length(string_split(text, chr(10))[1]) + 2) AS body, doc_id % 3 = 0 AS remote FROM documents
), t AS (
  SELECT doc_id, remote, lower(title) AS low, lower(title || chr(10) || body) AS txt FROM d
), a AS (
  SELECT *, CASE WHEN regexp_matches(low, '(^|[^a-zà-ü])the($|[^a-zà-ü])') THEN 8 ELSE 0 END - CASE WHEN regexp_matches(low, '(^|[^a-zà-ü])(of|und)($|[^a-zà-ü])') THEN 8 ELSE 0 END AS adj FROM t
), b AS (
  SELECT *, {_sql_word("low", PROFILE.negative)} AS neg, {_sql_word("low", PROFILE.role_negative)} AS role, {_sql_track(PROFILE.tracks[0], 0)}, {_sql_track(PROFILE.tracks[1], 1)} FROM a
), c AS (
  SELECT *, raw0 > 0 AND (n0 > 0 OR s0 > 0) AS ok0, raw1 > 0 AND (n1 > 0 OR s1 > 0) AS ok1 FROM b
), p AS (
  SELECT *, CASE WHEN ok0 AND (NOT ok1 OR s0 > s1 OR (s0 = s1 AND (n0 > 0)::INT >= (n1 > 0)::INT)) THEN 0 WHEN ok1 THEN 1 END AS pick FROM c
), e AS (
  SELECT doc_id,
    CASE WHEN neg IS NOT NULL THEN 'Excluded (' || neg || ')'
      WHEN role IS NOT NULL AND n0 + n1 = 0 THEN 'Non-eng role (' || role || ')'
      WHEN {_sql_hits("low", PROFILE.signals)} = 0 THEN 'No engineering role signal in title' END AS gate,
    pick, s0, s1, r0, r1 FROM p
), scored AS (
  SELECT doc_id,
    CASE WHEN gate IS NOT NULL OR pick IS NULL THEN 0 WHEN pick = 0 THEN s0 ELSE s1 END AS score,
    CASE WHEN gate IS NOT NULL OR pick IS NULL THEN 'other' WHEN pick = 0 THEN 'alpha' ELSE 'beta' END AS track,
    CASE WHEN gate IS NOT NULL THEN gate WHEN pick IS NULL THEN 'No track match' WHEN pick = 0 THEN r0 ELSE r1 END AS reason
  FROM e
)
"""


def _scored(spark, sf_dir):
    docs = _titled(read(spark, sf_dir, "documents"))
    return scoring.score_postings(docs, PROFILE, description="body", extras=False).select("doc_id", "score", "track", "reason", "disqualified")


@query(_SCORED + "SELECT doc_id, score, track, reason, score = 0 AS disqualified FROM scored")
def keyword_score_documents(spark, sf_dir):
    return _scored(spark, sf_dir)


@query(_SCORED + """SELECT coalesce(CASE WHEN starts_with(reason, 'Excluded') THEN 'negative' WHEN starts_with(reason, 'Non-eng') THEN 'roleNegative' WHEN starts_with(reason, 'No engineering') THEN 'noSignal'
  WHEN starts_with(reason, 'No track') THEN 'noMatch' WHEN score < 20 THEN 'belowThreshold' END, 'kept') AS gate, count(*) AS n FROM scored GROUP BY 1""")
def gate_elimination_counts(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy(F.coalesce(scoring.gate_label(F.col("reason"), F.col("score")), F.lit("kept")).alias("gate")).agg(F.count("*").alias("n"))


@query(_SCORED + "SELECT track, count(*) AS n FROM scored GROUP BY track")
def track_distribution(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("track").agg(F.count("*").alias("n"))


_NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '\([^)]*\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query("SELECT p_partkey, sha1(" + _NORM.format("p_name") + " || '|' || " + _NORM.format("p_brand") + ") AS content_key FROM part QUALIFY row_number() OVER (PARTITION BY content_key ORDER BY p_partkey) = 1")
def content_key_dedupe(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", text.content_key(F.col("p_name"), F.col("p_brand")).alias("content_key"))
    return relational.first_wins(parts, ["content_key"], [F.col("p_partkey")])


@query("SELECT o_orderkey, sha1(o_orderpriority || ':' || o_orderkey::VARCHAR) AS dedupe_key FROM orders")
def dedupe_key_hash(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", text.dedupe_key(F.col("o_orderpriority"), F.col("o_orderkey")).alias("dedupe_key"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '[ \t\r\n\f]+', ' ', 'g')) AS plain FROM pages""")
def strip_html_pages(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("plain"))


@query(r"""WITH a AS (SELECT page_id, url, split_part(url, '#', 1) AS bare FROM pages),
b AS (SELECT *, split_part(bare, '?', 1) AS head, CASE WHEN contains(bare, '?') THEN substr(bare, strpos(bare, '?') + 1) ELSE '' END AS q FROM a),
c AS (SELECT *, unnest(string_split(q, '&')) AS pair, generate_subscripts(string_split(q, '&'), 1) AS place FROM b),
d AS (SELECT page_id, string_agg(CASE WHEN contains(pair, '=') THEN pair ELSE pair || '=' END, '&' ORDER BY lower(split_part(pair, '=', 1)), place) AS kept FROM c
  WHERE pair <> '' AND NOT (starts_with(lower(pair), 'utm_') OR list_contains(['gh_src', 'fbclid', 'gclid', 'msclkid', 'mc_cid', 'mc_eid', 'igshid', '_hsenc', '_hsmi', 'trk', 'trackingid', 'wt_mc'], lower(split_part(pair, '=', 1)))) GROUP BY page_id),
e AS (SELECT b.page_id, url, lower(split_part(head, '://', 1)) AS scheme, lower(split_part(split_part(head, '://', 2), '/', 1)) AS host, regexp_extract(head, '^[^/]*//[^/]*(/.*)$', 1) AS path, coalesce(kept, '') AS kept FROM b LEFT JOIN d USING (page_id))
SELECT page_id, CASE WHEN scheme IN ('http', 'https') THEN scheme || '://' || host || CASE WHEN path IN ('', '/') THEN '/' WHEN kept = '' THEN regexp_replace(path, '/$', '') ELSE path END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END ELSE url END AS canonical FROM e""")
def canonical_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical"))


@query(r"""WITH h AS (SELECT page_id, lower(nullif(regexp_extract(url, '^[hH][tT][tT][pP][sS]?://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '')) AS host FROM pages)
SELECT page_id, host, coalesce(host = 'example.org' OR ends_with(host, '.example.org'), false) AS junk FROM h""")
def url_host_guard(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", text.host_of(F.col("url")).alias("host"))
    return pages.withColumn("junk", text.host_in(F.col("host"), ["example.org"]))


@query("SELECT DISTINCT source, CASE WHEN contains(source, ':') THEN 2 WHEN source IN ('adzuna', 'jsearch', 'indeed') THEN 0 ELSE 1 END AS trust FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'board:' || source WHEN 1 THEN 'indeed' ELSE source END AS source FROM documents)")
def source_trust(spark, sf_dir):
    source = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("board:"), "source")).when(F.col("doc_id") % 3 == 1, "indeed").otherwise(F.col("source"))
    return read(spark, sf_dir, "documents").select(source.alias("source")).distinct().withColumn("trust", text.source_trust(F.col("source")))


@query("""SELECT page_id, link FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"#]+)"', 1))) AS link FROM pages)""")
def links_in_html(spark, sf_dir):
    found = F.expr("""regexp_extract_all(html, 'href="([^"#]+)"', 1)""")
    return read(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(found)).alias("link"))


@query(r"""WITH h AS (SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host FROM pages)
SELECT CASE WHEN starts_with(host, 'm.') OR starts_with(host, 'blog.') THEN 'deny' WHEN len(string_split(host, '.')) > 2 THEN 'matched' ELSE 'foreign' END AS bucket, count(*) AS n, count(DISTINCT host) AS hosts FROM h GROUP BY 1""")
def corpus_accounting(spark, sf_dir):
    host = F.lower(F.regexp_extract("url", r"^https?://([^/?#]+)", 1))
    bucket = F.when(F.col("host").startswith("m.") | F.col("host").startswith("blog."), "deny").when(F.size(F.split("host", r"\.")) > 2, "matched").otherwise("foreign")
    return read(spark, sf_dir, "pages").select(host.alias("host")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"))


#: A marker and where it is planted, by doc_id % 8; the rest of the text follows it.
_PLANTED = ("Equal Opportunity Employer.", "hired without regard to race", "We celebrate our diversity", "\nBenefits:\n", "reasonable accommodation", "\n  What we offer\n", "unequal opportunity employers", "")


@query("""WITH p AS (SELECT doc_id, text, CASE doc_id % 8 WHEN 0 THEN 'Equal Opportunity Employer.' WHEN 1 THEN 'hired without regard to race' WHEN 2 THEN 'We celebrate our diversity' WHEN 3 THEN chr(10) || 'Benefits:' || chr(10)
  WHEN 4 THEN 'reasonable accommodation' WHEN 5 THEN chr(10) || '  What we offer' || chr(10) WHEN 6 THEN 'unequal opportunity employers' ELSE '' END AS mark, 500 + doc_id % 5 * 100 AS place FROM documents),
x AS (SELECT *, rtrim(substr(text, 1, place), ' ' || chr(9) || chr(10) || chr(13)) AS head, ltrim(substr(text, place + 1), ' ' || chr(9) || chr(10) || chr(13)) AS tail FROM p WHERE length(text) > 1200),
w AS (SELECT doc_id, head, head || ' ' || mark || ' ' || tail || ' ' AS whole, CASE doc_id % 8 WHEN 1 THEN length(head) + 7 WHEN 3 THEN length(head) + 1 WHEN 5 THEN length(head) + 1 WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE length(head) + 1 END AS cutoff, length(mark) AS n FROM x)
SELECT doc_id, sha1(rtrim(CASE WHEN cutoff >= 600 AND cutoff >= 0.3 * length(whole) THEN substr(whole, 1, cutoff) ELSE whole END, ' ' || chr(9) || chr(10) || chr(13))) AS trimmed FROM w""")
def trim_boilerplate(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("length(text) > 1200")
    blank, mark = " \t\n\r", F.element_at(F.array(*map(F.lit, _PLANTED)), (F.col("doc_id") % 8 + 1).cast("int"))
    place = 500 + F.col("doc_id") % 5 * 100
    head = F.rtrim(F.substring("text", F.lit(1), place.cast("int")), F.lit(blank))
    tail = F.ltrim(F.substring("text", (place + 1).cast("int"), F.length("text")), F.lit(blank))
    whole = F.concat(head, F.lit(" "), mark, F.lit(" "), tail, F.lit(" "))
    return docs.select("doc_id", whole.alias("whole")).select("doc_id", F.sha1(text.trim_boilerplate(F.col("whole"))).alias("trimmed"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, greatest(0, least(100, json_extract(props, '$.k')::BIGINT + 20)) AS fit FROM events")
def parse_model_json(spark, sf_dir):
    raw = F.concat(F.lit("Sure, here it is: "), "props", F.lit(" - done"))
    k = text.model_json(raw, "k bigint")["k"]
    return read(spark, sf_dir, "events").select("event_id", k.alias("k"), F.greatest(F.lit(0), F.least(F.lit(100), k + 20)).alias("fit"))


@query("""SELECT o_custkey, o_orderkey, source_prio FROM (SELECT o_custkey, o_orderkey, o_orderdate, 0 AS source_prio FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, o_orderdate, 1 FROM orders WHERE o_orderstatus = 'O')
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY source_prio, o_orderkey) = 1""")
def priority_union_dedupe(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    both = relational.union_by_priority([orders.where(f"o_orderstatus = '{s}'").drop("o_orderstatus") for s in "FO"])
    return relational.first_wins(both, ["o_custkey"], [F.col("source_prio"), F.col("o_orderkey")])


@query("""WITH r AS (SELECT s_suppkey, s_suppkey * 7 AS k1, s_nationkey AS k2 FROM supplier)
SELECT c_custkey, coalesce(a.m, b.m) AS match FROM customer c LEFT JOIN (SELECT k1, min(s_suppkey) AS m FROM r GROUP BY k1) a ON a.k1 = c.c_custkey LEFT JOIN (SELECT k2, min(s_suppkey) AS m FROM r GROUP BY k2) b ON b.k2 = c.c_nationkey""")
def two_key_match(spark, sf_dir):
    left = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("k1"), F.col("c_nationkey").alias("k2"))
    right = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 7).alias("k1"), F.col("s_nationkey").alias("k2"))
    return relational.two_key_match(left, right, "k1", "k2", "s_suppkey").select("c_custkey", "match")


@query("SELECT c_custkey, c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) AS registered FROM customer")
def register_semi_flag(spark, sf_dir):
    keys = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey"))
    return relational.flag_if_in(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), keys, ["c_nationkey"], "registered").select("c_custkey", "registered")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def anti_join_unembedded(spark, sf_dir):
    return ledger.without(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def version_stale_anti(spark, sf_dir):
    return ledger.without(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id", F.col("quality") == 1)


_DAYS = "WITH a AS (SELECT DISTINCT event_type, user_id FROM events WHERE ts::DATE = DATE '2024-01-10'), b AS (SELECT DISTINCT event_type, user_id FROM events WHERE ts::DATE = DATE '2024-01-11')"


@query(_DAYS + " SELECT event_type, user_id FROM a WHERE event_type IN (SELECT event_type FROM b) AND NOT EXISTS (SELECT 1 FROM b WHERE b.event_type = a.event_type AND b.user_id = a.user_id)")
def snapshot_diff_delist(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_type", "user_id", F.to_date("ts").alias("day"))
    stored, fetched = (events.where(F.col("day") == F.lit(d).cast("date")).drop("day").distinct() for d in ("2024-01-10", "2024-01-11"))
    return relational.absent(stored, fetched, "event_type", ["event_type", "user_id"])


@query("""WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events), u AS (SELECT DISTINCT user_id FROM events), e AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events),
g AS (SELECT u.user_id, d.day, e.day IS NOT NULL AS present FROM u CROSS JOIN d LEFT JOIN e ON e.user_id = u.user_id AND e.day = d.day),
w AS (SELECT *, lag(present) OVER o AS before, max(present::INT) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ever FROM g WINDOW o AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, day::VARCHAR AS day, CASE WHEN present AND coalesce(ever, 0) = 0 THEN 'listed' WHEN present AND NOT before THEN 'relisted' WHEN NOT present AND before THEN 'delisted' END AS event FROM w
WHERE (present AND coalesce(ever, 0) = 0) OR (present AND NOT before) OR (NOT present AND before)""")
def listing_transitions(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    first = events.agg(F.min("day").alias("a"), F.max("day").alias("b"))  # one row; a run a day
    found = relational.presence_events(events.join(F.broadcast(first)).select("user_id", F.datediff("day", "a").alias("run"), F.datediff("b", "a").alias("last")), "user_id", "run", F.col("last"))
    return found.join(F.broadcast(first.select("a"))).select("user_id", F.date_add("a", F.col("run")).cast("string").alias("day"), "event")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 12")
def topk_per_group(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return relational.top_per_group(orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")], 12).select("o_custkey", "o_orderkey", "rank")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_projection(spark, sf_dir):
    return relational.latest(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type"])


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, avg((event_type = 'purchase')::INT::DOUBLE) AS rate FROM events GROUP BY ALL),
l AS (SELECT user_id, list(rate ORDER BY day) AS rates FROM d GROUP BY user_id)
SELECT user_id, round(list_reduce(list_prepend(0.5::DOUBLE, rates), lambda a, r: floor((a * 0.7 + r * 0.3) * 1000 + 0.5) / 1000), 3) AS hit_rate FROM l""")
def ema_hit_rate(spark, sf_dir):
    events = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg((F.col("event_type") == "purchase").cast("double")).alias("rate"))
    folded = relational.fold(events, "user_id", ["day"], "rate", F.lit(0.5), lifecycle.blend_rate, "hit_rate")
    return folded.withColumn("hit_rate", F.round("hit_rate", 3))


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, max((event_type = 'purchase')::INT) AS hit FROM events GROUP BY ALL),
l AS (SELECT user_id, list(hit ORDER BY day) AS hits FROM d GROUP BY user_id)
SELECT user_id, list_reduce(list_prepend(1, hits), lambda a, h: CASE WHEN h = 1 THEN 1 ELSE least(30, greatest(2, a * 2)) END) AS interval_days FROM l""")
def backoff_interval(spark, sf_dir):
    events = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max((F.col("event_type") == "purchase").cast("int")).alias("hit"))
    return relational.fold(events, "user_id", ["day"], "hit", F.lit(1), lambda a, h: lifecycle.next_interval(a, h == 1), "interval_days")



@query("""WITH c AS (SELECT max(o_orderdate) AS newest FROM orders), o AS (SELECT o_orderkey, o_orderdate, o_orderpriority LIKE '1%' AS direct, newest, date_diff('microsecond', o_orderdate, newest) / 86400000000.0 AS age FROM orders, c)
SELECT o_orderkey, CASE WHEN direct AND age > 14 THEN 'delisted' WHEN age > 180 THEN 'evergreen' WHEN age > 45 THEN 'aging' ELSE 'fresh' END AS freshness,
CASE WHEN floor(age) < 1 THEN 'today' WHEN floor(age) < 30 THEN floor(age)::BIGINT || 'd' WHEN floor(age) < 365 THEN floor(floor(age) / 30)::BIGINT || 'mo' ELSE '1y+' END AS label, NOT direct AND age > 45 AS too_old FROM o""")
def freshness_class(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderpriority").startswith("1").alias("direct"))
    clock = orders.agg(F.max("o_orderdate").alias("newest"))  # one row
    day, newest = F.col("o_orderdate"), F.col("newest")
    fresh = lifecycle.freshness(day, day, day, F.col("direct"), F.lit(None), newest, newest)
    return orders.join(F.broadcast(clock)).select("o_orderkey", fresh.alias("freshness"), lifecycle.age_label(day, newest).alias("label"), lifecycle.too_old(day, F.col("direct"), newest).alias("too_old"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS verdict, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def status_verdict_snapshot(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return orders.groupingSets([[orders.o_orderstatus], [orders.o_orderpriority], []], orders.o_orderstatus, orders.o_orderpriority).agg(F.count("*").alias("n")).select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("verdict"), "n")


@query("""WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), r AS (SELECT c_nationkey, n, row_number() OVER (ORDER BY n DESC, c_nationkey) AS k FROM c)
SELECT CASE WHEN k <= 10 THEN c_nationkey::VARCHAR ELSE 'other' END AS bucket, sum(n)::BIGINT AS n FROM r GROUP BY 1""")
def facet_counts_topn_other(spark, sf_dir):
    counts = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.col("n").desc(), "c_nationkey").limit(10).select("c_nationkey", F.col("c_nationkey").cast("string").alias("name"))
    return counts.join(F.broadcast(top), "c_nationkey", "left").groupBy(F.coalesce("name", F.lit("other")).alias("bucket")).agg(F.sum("n").alias("n"))


@query("SELECT n_name, r_name, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def region_bridge_union(spark, sf_dir):
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    counts = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    named = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return named.join(counts, named.n_nationkey == counts.c_nationkey, "left").select("n_name", "r_name", F.coalesce("c", F.lit(0)).alias("customers"))


@query("SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 30 OFFSET 30")
def radar_page(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = read(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select("o_orderkey", "c_mktsegment", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").offset(30).limit(30)


@query("SELECT c_custkey, max(o_orderdate) AS last_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY last_order NULLS FIRST, c_custkey LIMIT 50")
def stalest_first_nulls(spark, sf_dir):
    last = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_order"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left").orderBy(F.asc_nulls_first("last_order"), "c_custkey").limit(50)


_COSINE = "list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q::DOUBLE[], q::DOUBLE[]))"
_POOL = f"WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, label, (vec_id * 37) % 101 AS score, CASE WHEN vec_id % 7 <> 0 THEN round({_COSINE}, 9) END AS sim FROM embeddings, q)"
_BLENDED = _POOL + """, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS kw_rank FROM e), n AS (SELECT count(*) AS n, count(sim) AS k FROM e),
s AS (SELECT vec_id, row_number() OVER (ORDER BY sim DESC, kw_rank) - 1 AS place FROM k WHERE sim IS NOT NULL), b AS (SELECT k.vec_id, label, kw_rank, CASE WHEN sim IS NULL THEN kw_rank::DOUBLE ELSE place * ((n.n - 1)::DOUBLE / (n.k - 1)) END AS sim_rank FROM k LEFT JOIN s USING (vec_id), n)"""


def _pool(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    target = F.broadcast(vectors.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1))  # one query vector
    sim = F.when(F.col("vec_id") % 7 != 0, F.round(ranking.cosine(F.col("embedding"), F.col("q")), 9))
    return vectors.join(target).select("vec_id", "label", (F.col("vec_id") * 37 % 101).alias("score"), sim.alias("sim"))


@query(_BLENDED + " SELECT vec_id, kw_rank, round(0.4 * kw_rank + 0.6 * sim_rank, 6) AS blended FROM b")
def fit_queue_blend(spark, sf_dir):
    out = ranking.blend(_pool(spark, sf_dir), "score", "sim", "vec_id")
    return out.select("vec_id", "kw_rank", F.round("blended", 6).alias("blended"))


@query(_POOL + " SELECT vec_id, round(sim, 6) AS sim FROM e WHERE sim IS NOT NULL ORDER BY sim DESC, vec_id LIMIT 20")
def cosine_topk(spark, sf_dir):
    return _pool(spark, sf_dir).where("sim is not null").select("vec_id", "sim").orderBy(F.desc("sim"), "vec_id").limit(20).withColumn("sim", F.round("sim", 6))


@query(_POOL + " SELECT round(avg((label = 3)::INT::DOUBLE), 6) AS precision_at_k FROM (SELECT label FROM e ORDER BY score DESC, vec_id LIMIT 100)")
def precision_at_100(spark, sf_dir):
    return ranking.precision_at(_pool(spark, sf_dir), [F.desc("score"), F.col("vec_id")], F.col("label") == 3)


@query(_POOL + """, k AS (SELECT label, row_number() OVER (ORDER BY score DESC, vec_id) AS p, count(*) OVER () AS n FROM e)
SELECT round(coalesce(sum((label = 3 AND p <= ceil(n * 0.2))::INT)::DOUBLE / nullif(sum((label = 3)::INT), 0), 0), 6) AS gem_recall FROM k""")
def gem_recall(spark, sf_dir):
    pool = _pool(spark, sf_dir).select("vec_id", "score", "label")
    return ranking.gem_recall(pool, [F.desc("score"), F.col("vec_id")], F.col("label") == 3).withColumn("gem_recall", F.round("gem_recall", 6))


@query(_POOL + """, r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a, rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2.0 AS b FROM e) SELECT round(corr(a, b), 6) AS rho FROM r""")
def spearman(spark, sf_dir):
    ranked = ranking.average_rank(ranking.average_rank(_pool(spark, sf_dir).select("score", "label"), "score", "a"), "label", "b")
    return ranked.agg(F.round(F.corr("a", "b"), 6).alias("rho"))


@query(_BLENDED + """, w AS (SELECT unnest([0.0, 0.4, 1.0]) AS weight), o AS (SELECT weight, label, row_number() OVER (PARTITION BY weight ORDER BY round(weight * kw_rank + (1 - weight) * sim_rank, 6), vec_id) AS p FROM b, w)
SELECT weight::DOUBLE AS weight, round(avg((label = 3)::INT::DOUBLE), 6) AS precision_at_k FROM o WHERE p <= 100 GROUP BY 1""")
def weight_sweep(spark, sf_dir):
    ranked = ranking.blend(_pool(spark, sf_dir), "score", "sim", "vec_id").select("vec_id", "label", "kw_rank", "sim_rank")
    out = None
    for w in (0.0, 0.4, 1.0):  # one top-k a weight, no task holds all rows
        mixed = ranked.withColumn("key", F.round(F.lit(w) * F.col("kw_rank") + F.lit(1 - w) * F.col("sim_rank"), 6))
        one = ranking.precision_at(mixed, [F.col("key"), F.col("vec_id")], F.col("label") == 3).select(F.lit(w).alias("weight"), "precision_at_k")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH s AS (SELECT quality, toxic, CASE WHEN list_sum(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c))) % 997 % 2 = 0 THEN 'tune' ELSE 'confirm' END AS slice FROM labels JOIN documents USING (doc_id))
SELECT slice, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM s GROUP BY slice""")
def slice_metrics(spark, sf_dir):
    joined = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return joined.groupBy(text.hash_half(F.col("doc_id")).alias("slice")).agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"))


@query("SELECT json_extract(props, '$.k')::BIGINT % 5 AS reason, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def dismiss_reason_hist(spark, sf_dir):
    return read(spark, sf_dir, "events").where("event_type = 'error'").groupBy((F.get_json_object("props", "$.k").cast("long") % 5).alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS types FROM events GROUP BY user_id)
SELECT user_id, list_reduce(list_prepend('new', types), lambda a, t: CASE WHEN a = 'offer' THEN a WHEN t = 'purchase' AND a = 'applied' THEN 'offer' WHEN t = 'signup' THEN 'applied' WHEN t = 'error' THEN 'ignored' ELSE a END) AS status FROM l""")
def status_machine_fold(spark, sf_dir):
    def step(a, t):
        return F.when(a == "offer", a).when((t == "purchase") & (a == "applied"), "offer").when(t == "signup", "applied").when(t == "error", "ignored").otherwise(a)

    return relational.fold(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", F.lit("new"), step, "status")


@query("""WITH o AS (SELECT o_custkey, min(o_orderkey) AS first_key, sum(o_totalprice) AS spent FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), i AS (SELECT o_custkey, min(o_orderkey) AS first_key, sum(o_totalprice) AS spent FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT coalesce(o.o_custkey, i.o_custkey) AS o_custkey, coalesce(o.first_key, i.first_key) AS first_key, round(CASE WHEN i.o_custkey IS NOT NULL THEN i.spent ELSE o.spent END, 2) AS spent FROM o FULL JOIN i ON o.o_custkey = i.o_custkey""")
def merge_upsert(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    old, new = (orders.where(f"o_orderstatus = '{s}'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_key"), F.sum("o_totalprice").alias("spent")) for s in "FO")
    return relational.merge(old, new, "o_custkey", ["spent"]).withColumn("spent", F.round("spent", 2))


@query("""WITH n AS (SELECT s_suppkey + 1000000 AS s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 2000), ok AS (SELECT s_nationkey FROM n GROUP BY 1 HAVING count(*) >= 4)
SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT s_nationkey FROM ok) UNION ALL SELECT s_suppkey, s_nationkey FROM n WHERE s_nationkey IN (SELECT s_nationkey FROM ok)""")
def partition_replace_guard(spark, sf_dir):
    stored = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    incoming = stored.where("s_acctbal > 2000").select((F.col("s_suppkey") + 1000000).alias("s_suppkey"), "s_nationkey")
    return relational.replace_partitions(stored.select("s_suppkey", "s_nationkey"), incoming, "s_nationkey", 4)


@query("SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ' / ' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey")
def string_agg_merge(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), " / ").alias("flags"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)")
def latest_partition_scan(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    newest = orders.agg(F.max("y")).first()[0]  # one value
    return orders.where(F.col("y") == newest).select("o_orderkey", "o_custkey")
