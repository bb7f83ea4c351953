"""Queries over a pool of postings and boards made from the tables, each with its SQL.

``JOBS`` and ``BOARDS`` are written in what Spark and DuckDB have in common,
and only make the rows; the operators under test are the library's, and their
SQL is written from the operators' definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import detect, places, predicates
from tessera.functions.text import canonical_url, hash_half
from tessera.operators import evaluation, ledger, queues, ranking, relational, scoring
from tessera.plans.registry import query, read

NOW = "2001-08-01 00:00:00"
_CODES = ("de", "fr", "us", "gb", "in", "tr", "nl", "jp", "br", "se", "pl", "ie", "zz", "ch", "at", "es", "it", "ca", "mx", "no", "dk", "fi", "pt", "be", "au")


def _case(key: str, values) -> str:
    arms = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values))
    return f"CASE {key} {arms} END"


_POSTING = f"""
  o_orderkey AS id, 'Company ' || CAST(c_nationkey AS VARCHAR(9)) AS company,
  {_case('o_orderkey % 6', ('Senior Data Engineer', 'Cloud Developer', 'Sales Lead', 'data analyst', 'Head of Platform', 'Engineer'))} AS title,
  {_case('o_orderkey % 10', ('new', 'new', 'new', 'interested', 'applied', 'interview', 'ignored', 'offer', 'rejected', 'new'))} AS status,
  {_case('o_orderkey % 7', ('gh:acme', 'adzuna', 'workday:x@wd1/y', 'remotive', 'sr:beta', 'indeed', 'workable:z'))} AS source,
  CAST(o_orderkey AS VARCHAR(20)) AS external_id,
  {_case('o_orderkey % 5', ('https://www.linkedin.com/jobs/1', 'https://ex.org/a', 'https://uk.indeed.com/x', '', 'https://jobs.ex.com/b'))} AS url,
  {_case('c_nationkey', [None if i % 6 == 5 else c for i, c in enumerate(_CODES)])} AS country,
  {_case('c_nationkey % 8', ('Berlin', ' PARIS ', 'paris', None, '', 'New   York', 'berlin', 'Oslo'))} AS location,
  {_case('o_orderkey % 4', ('remote', 'hybrid', 'onsite', 'remote'))} AS work_mode, {_case('o_orderkey % 3', ('alpha', 'beta', 'other'))} AS track,
  {_case('o_orderkey % 11 % 3', ('yes', 'no', 'unknown'))} AS visa, CAST(o_orderkey * 37 % 101 AS INT) AS score, o_orderkey % 13 = 0 AS disqualified, o_orderkey % 17 < 5 AS sponsor_reg,
  CASE WHEN o_orderkey % 19 = 3 THEN o_orderkey - 1 END AS duplicate_of, CASE WHEN o_orderkey % 8 < 5 THEN CAST(o_orderkey * 53 % 101 AS INT) END AS fit_score,
  CASE WHEN o_orderkey % 8 < 5 THEN CASE WHEN o_orderkey * 53 % 101 >= 70 THEN 'strong' WHEN o_orderkey * 53 % 101 >= 40 THEN 'possible' ELSE 'weak' END END AS fit_verdict,
  {_case('o_orderkey % 4', ('NONE', 'NO_VISA', None, 'OTHER'))} AS fit_category, {_case('o_orderkey % 5', ('must be in the office', 'a Relocation is asked', 'good', None, 'TIME ZONE of Asia'))} AS fit_comment,
  {_case('o_orderkey % 3', (None, 'qwen27b-review', 'qwen27b'))} AS fit_by, {_case('o_orderkey % 9', ('stack', None, 'language', 'ghost', 'terms', 'nope', None, 'no-visa', 'company'))} AS dismiss_reason,
  CASE WHEN o_orderkey % 6 <> 4 THEN o_orderdate END AS posted_at, o_orderdate + INTERVAL '3' DAY AS first_seen_at, o_orderdate + INTERVAL '20' DAY AS last_seen_at, o_orderdate AS created_at, o_orderdate + INTERVAL '9' DAY AS updated_at,
  CASE WHEN o_orderkey % 10 = 6 THEN o_orderdate + INTERVAL '40' DAY END AS delisted_at, CASE WHEN o_orderkey % 10 IN (4, 5, 7, 8) THEN o_orderdate + INTERVAL '5' DAY END AS applied_at, CASE WHEN o_orderkey % 10 IN (4, 5) THEN o_orderdate + INTERVAL '15' DAY END AS follow_up_at,
  CASE WHEN o_orderkey % 3 = 0 THEN 'short' WHEN o_orderkey % 3 = 1 THEN 'a description that is long enough to be read by anybody who looks for some work in {'x' * 20}' END AS description
"""
JOBS = f"WITH jobs AS (SELECT {_POSTING} FROM orders JOIN customer ON o_custkey = c_custkey)"
_BOARD = f"""
  s_suppkey AS board_id, {_case('s_suppkey % 5', ('greenhouse', 'lever', 'parked', 'workable', 'ashby'))} AS platform, 'Acme-' || CAST(s_suppkey AS VARCHAR(9)) AS token, CASE WHEN s_suppkey % 4 = 0 THEN 'eu' ELSE '' END AS region,
  {_case('s_suppkey % 4', ('active', 'active', 'candidate', 'dead'))} AS status, CASE WHEN s_suppkey % 3 = 0 THEN 'Known ' || CAST(s_suppkey AS VARCHAR(9)) END AS company_name, CAST(1 + s_suppkey % 9 AS INT) AS interval_days, s_acctbal AS hit_rate,
  {_case('s_suppkey % 6', ('2001-07-31 12:00:00', None, '2001-07-25 00:00:00', '2001-06-01 00:00:00', '2001-07-31 00:00:00', '2001-07-28 06:00:00'))} AS fetched_text, {_case('s_suppkey % 7', ('2001-07-20 00:00:00', '2001-05-01 00:00:00', None, '2001-07-02 00:00:00', '2001-07-01 00:00:00', '2001-07-30 00:00:00', '2001-01-01 00:00:00'))} AS validated_text
"""
BOARDS = f"WITH boards AS (SELECT *, CAST(fetched_text AS TIMESTAMP) AS last_fetched_at, CAST(validated_text AS TIMESTAMP) AS validated_at FROM (SELECT {_BOARD} FROM supplier))"
_NOW = f"TIMESTAMP '{NOW}'"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey)
    rows.createOrReplaceTempView("pool_rows__")
    return spark.sql(f"SELECT {_POSTING} FROM pool_rows__")


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "supplier").createOrReplaceTempView("board_rows__")
    return spark.sql(f"SELECT *, CAST(fetched_text AS TIMESTAMP_NTZ) AS last_fetched_at, CAST(validated_text AS TIMESTAMP_NTZ) AS validated_at FROM (SELECT {_BOARD} FROM board_rows__)")


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def _ids(df: DataFrame) -> DataFrame:
    return df.select("id")


def _predicate(name: str, condition: str, column, prefix: str = ""):
    """Registers the ids of the jobs that meet a predicate, with the condition's own SQL."""

    def run(spark, sf_dir):
        return _ids(jobs(spark, sf_dir).where(column()))

    run.__name__ = name
    query(f"{JOBS}{prefix} SELECT id FROM jobs WHERE {condition}")(run)


_OPEN_SQL = "delisted_at IS NULL AND duplicate_of IS NULL AND status IN ('new', 'interested')"
_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_WALL = "(" + " OR ".join(f"{_HOST} = '{d}' OR {_HOST} LIKE '%.{d}'" for d in ("linkedin.com", "indeed.com", "glassdoor.com", "glassdoor.co.uk", "ziprecruiter.com")) + ")"

_predicate("filter_radar_base", "duplicate_of IS NULL AND status = 'new' AND delisted_at IS NULL AND NOT disqualified", predicates.on_radar)
_predicate("filter_facet_sets", "track IN ('alpha', 'beta') AND fit_verdict = 'strong' AND work_mode IN ('remote') AND visa IN ('yes', 'unknown')",
           lambda: predicates.facets(predicates.chosen("beta, alpha,nope", ("alpha", "beta", "gamma")), "strong", predicates.chosen("remote,moon", predicates.WORK_MODES), predicates.chosen("yes,unknown", predicates.VISAS)))
_predicate("filter_text_search", "title ILIKE '%DATA%' OR company ILIKE '%DATA%'", lambda: predicates.holds_text(" DATA "))
_predicate("filter_visa_wave", f"fit_score IS NULL AND NOT disqualified AND {_OPEN_SQL} AND score > 50 AND (sponsor_reg OR visa = 'yes')", predicates.visa_wave)
_predicate("filter_wide_wave", f"fit_score IS NULL AND NOT disqualified AND {_OPEN_SQL} AND score >= 40 AND posted_at >= {_NOW} - INTERVAL 45 DAY AND (country IN ('de', 'nl', 'es', 'ch', 'dk', 'se', 'be', 'pl', 'fr', 'pt', 'at', 'ie', 'gb', 'no', 'fi') OR work_mode = 'remote')", lambda: predicates.wide_wave(now()))
_predicate("filter_title_only", "length(coalesce(description, '')) < length(title) + 60", lambda: predicates.title_only(F.col("title"), F.col("description")))
_predicate("filter_description_backfill", "(starts_with(source, 'sr:') OR starts_with(source, 'workday:') OR starts_with(source, 'workable:')) AND delisted_at IS NULL AND duplicate_of IS NULL AND NOT disqualified", predicates.fills_later)
_predicate("filter_review_queue", f"fit_score >= 40 AND fit_by IS NULL AND {_OPEN_SQL}", predicates.awaits_review)
_predicate("filter_second_review", "fit_by = 'qwen27b-review' AND delisted_at IS NULL AND fit_category <> 'NO_VISA' AND (lower(fit_comment) LIKE '%locat%' OR lower(fit_comment) LIKE '%reloc%' OR lower(fit_comment) LIKE '%time zone%' OR lower(fit_comment) LIKE '%must be in%')", predicates.awaits_second_review)
_predicate("filter_sweep_due", f"delisted_at IS NULL AND NOT contains(source, ':') AND last_seen_at < {_NOW} - INTERVAL 10 DAY AND url <> '' AND NOT {_WALL}", lambda: predicates.sweep_due(now()))
_predicate("filter_follow_up_due", f"follow_up_at <= {_NOW} AND status IN ('applied', 'interview')", lambda: predicates.follow_up_due(now()))
_predicate("filter_ghost_suggestion", f"status = 'applied' AND {_NOW} - follow_up_at > INTERVAL 14 DAY", lambda: predicates.seems_ghosted(now()))
_predicate("filter_wall_url", f"url <> '' AND {_WALL}", lambda: predicates.host_in(predicates.host_of(F.col("url")), predicates.WALL_SITES))


@query(f"{JOBS}, c AS (SELECT max(last_seen_at) AS newest FROM jobs) SELECT id FROM jobs, c WHERE (delisted_at IS NULL AND coalesce(posted_at, first_seen_at) >= {_NOW} - INTERVAL 45 DAY AND NOT (contains(source, ':') AND last_seen_at < newest - INTERVAL 14 DAY)) OR status IN ('applied', 'interview', 'offer')")
def filter_fresh_window(spark, sf_dir):
    rows = jobs(spark, sf_dir)
    clock = rows.agg(F.max("last_seen_at").alias("newest"))  # one row
    return _ids(rows.join(F.broadcast(clock)).where(predicates.in_fresh_window(now(), F.col("newest"))))


@query(f"{JOBS} SELECT id FROM jobs WHERE country IN ('de', 'at') OR (country IS NULL AND work_mode = 'remote') OR country IN ('ch')")
def filter_country_buckets(spark, sf_dir):
    allowed = places.countries_in(["dach"])
    return _ids(jobs(spark, sf_dir).where(predicates.in_countries(["de", "at", "other", "remote", "nl"], ["de", "at"], allowed, True)))


@query(f"""{JOBS}, k AS (SELECT *, CASE WHEN country IS NULL THEN CASE WHEN work_mode = 'remote' THEN 'remote' ELSE 'unknown' END WHEN country <> 'zz' THEN country END AS b FROM jobs),
c AS (SELECT b, count(*) AS n FROM k WHERE b IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY b IN ('remote', 'unknown') ORDER BY n DESC, b) AS p FROM c)
SELECT CASE WHEN b IN ('remote', 'unknown') OR p <= 10 THEN b ELSE 'other' END AS bucket, sum(n)::BIGINT AS n FROM r GROUP BY 1""")
def facet_countries(spark, sf_dir):
    return ledger.country_facets(jobs(spark, sf_dir), places.countries_in([]), False)


@query(f"{JOBS}, s AS (SELECT id, CASE WHEN source IN ('adzuna', 'remotive') THEN source ELSE 'linkedin' END AS s, last_seen_at FROM jobs) SELECT id, s = 'linkedin' AND {_NOW} - last_seen_at < INTERVAL 5 DAY AS resting FROM s")
def source_cooldown(spark, sf_dir):
    name = F.when(F.col("source").isin("adzuna", "remotive"), F.col("source")).otherwise("linkedin")
    return jobs(spark, sf_dir).select("id", predicates.on_cooldown(name, F.col("last_seen_at"), now()).alias("resting"))


@query(f"{BOARDS} SELECT board_id, last_fetched_at IS NULL OR {_NOW} - last_fetched_at >= to_days(interval_days) AS due, status = 'candidate' OR validated_at IS NULL OR validated_at < {_NOW} - INTERVAL 30 DAY AS validate FROM boards")
def boards_due(spark, sf_dir):
    return boards(spark, sf_dir).select("board_id", predicates.is_due(now()).alias("due"), predicates.validation_due(now()).alias("validate"))


@query(f"{BOARDS} SELECT count(*) AS due FROM boards WHERE status = 'active' AND (last_fetched_at IS NULL OR last_fetched_at < {_NOW} - INTERVAL 1 DAY)")
def board_due_estimate(spark, sf_dir):
    return predicates.due_estimate(boards(spark, sf_dir), now())


@query(f"{JOBS} SELECT coalesce({_NOW} - max(updated_at) > INTERVAL 14 DAY, true) AS stale, true AS empty_is_stale FROM jobs")
def register_staleness(spark, sf_dir):
    rows = jobs(spark, sf_dir).select("updated_at")
    empty = predicates.register_stale(rows.where("false"), now()).withColumnRenamed("stale", "empty_is_stale")
    return predicates.register_stale(rows, now()).join(F.broadcast(empty))


_KEY = r"trim(regexp_replace(lower(location), '\s+', ' ', 'g'))"


@query(f"{JOBS} SELECT id, {_KEY} AS raw FROM jobs WHERE country IS NULL AND location <> '' AND delisted_at IS NULL AND {_KEY} NOT IN ('berlin', 'oslo')")
def unresolved_locations(spark, sf_dir):
    cache = spark.createDataFrame([("berlin",), ("oslo",), ("oslo",)], "raw string")
    return predicates.unresolved_places(jobs(spark, sf_dir), cache, detect.location_key(F.col("location"))).select("id", "raw")


@query(f"{JOBS} SELECT {_KEY} AS raw, array_to_string(list_sort(list_distinct(list(location))), '|') AS spellings FROM jobs WHERE location <> '' GROUP BY 1")
def location_spellings(spark, sf_dir):
    return ledger.spellings(jobs(spark, sf_dir), detect.location_key(F.col("location"))).select("raw", F.array_join("spellings", "|").alias("spellings"))


@query(f"""{JOBS} SELECT id, CASE dismiss_reason WHEN 'language' THEN 'Language requirement' WHEN 'stack' THEN 'Not my stack' WHEN 'company' THEN 'Not this company' WHEN 'terms' THEN 'Weak terms / salary' WHEN 'no-visa' THEN 'No visa sponsorship' WHEN 'ghost' THEN 'Ghost / suspicious' ELSE 'No reason' END AS label FROM jobs""")
def dismiss_reason_labels(spark, sf_dir):
    return jobs(spark, sf_dir).select("id", predicates.reason_label(F.col("dismiss_reason")).alias("label"))


@query(f"""{JOBS}, r(c, region) AS (VALUES {', '.join(f"('{c}', '{r}')" for r, cs in (('eu', ('at', 'be', 'dk', 'fi', 'fr', 'de', 'ie', 'it', 'nl', 'pl', 'pt', 'es', 'se')), ('emea', ('at', 'be', 'dk', 'fi', 'fr', 'de', 'ie', 'it', 'nl', 'pl', 'pt', 'es', 'se', 'gb', 'ch', 'no', 'tr')), ('tr', ('tr',)), ('uk-ie', ('gb', 'ie')), ('dach', ('de', 'at', 'ch')), ('nordics', ('se', 'no', 'dk', 'fi')), ('americas', ('us', 'ca', 'mx', 'br')), ('apac', ('in', 'jp', 'au'))) for c in cs)})
SELECT region, count(*) AS n FROM jobs JOIN r ON r.c = country GROUP BY 1""")
def regions_of_countries(spark, sf_dir):
    return jobs(spark, sf_dir).select(F.explode(places.regions_of(F.col("country"))).alias("region")).groupBy("region").agg(F.count("*").alias("n"))


@query(f"{JOBS} SELECT id FROM jobs WHERE country IN ('de', 'at', 'ch', 'gb', 'ie')")
def region_union(spark, sf_dir):
    chosen = predicates.in_countries([], [], places.countries_in(["dach", "uk-ie", "moon"]), True)
    return _ids(jobs(spark, sf_dir).where(chosen))


# ------------------------------------------------------------------- queues

_TRUST = "CASE WHEN contains(source, ':') THEN 2 WHEN source IN ('adzuna', 'jsearch', 'indeed') THEN 0 ELSE 1 END"


@query(f"{JOBS} SELECT id FROM jobs WHERE duplicate_of IS NULL AND status = 'new' AND delisted_at IS NULL AND NOT disqualified ORDER BY fit_score DESC NULLS LAST, {_TRUST} DESC, score DESC, created_at DESC, id LIMIT 30 OFFSET 60")
def radar_order_page(spark, sf_dir):
    return _ids(queues.page(jobs(spark, sf_dir).where(predicates.on_radar()), queues.radar_order(), 3))


@query(f"{JOBS} SELECT count(*) AS n, greatest(1, ceil(count(*) / 30))::BIGINT AS last_page FROM jobs WHERE duplicate_of IS NULL AND status = 'new' AND delisted_at IS NULL AND NOT disqualified")
def radar_last_page(spark, sf_dir):
    return queues.last_page(jobs(spark, sf_dir).where(predicates.on_radar()))


@query(f"{JOBS} SELECT id, row_number() OVER (ORDER BY fit_score DESC NULLS LAST, score DESC, id) - 1 AS place FROM jobs WHERE status = 'interested' AND delisted_at IS NULL AND duplicate_of IS NULL AND NOT disqualified")
def starred_strip(spark, sf_dir):
    return ranking.global_rank(queues.starred(jobs(spark, sf_dir)), [F.desc_nulls_last("fit_score"), F.desc("score"), F.col("id")], "place").select("id", "place")


@query(f"{JOBS} SELECT id, stage, row_number() OVER (ORDER BY stage, applied_at DESC NULLS LAST, id) - 1 AS place FROM (SELECT *, CASE status WHEN 'applied' THEN 0 WHEN 'interview' THEN 1 WHEN 'offer' THEN 2 WHEN 'rejected' THEN 3 WHEN 'ghosted' THEN 4 END AS stage FROM jobs) WHERE stage IS NOT NULL")
def application_stages(spark, sf_dir):
    rows = queues.applications(jobs(spark, sf_dir))
    return ranking.global_rank(rows, [F.col("stage"), F.desc_nulls_last("applied_at"), F.col("id")], "place").select("id", "stage", "place")


@query(f"{JOBS} SELECT id FROM jobs WHERE status = 'ignored' ORDER BY last_seen_at DESC, id LIMIT 300")
def dismissed_top(spark, sf_dir):
    return _ids(queues.dismissed(jobs(spark, sf_dir)))


@query(f"{JOBS} SELECT id FROM jobs WHERE fit_score IS NULL AND status IN ('new', 'interested') AND duplicate_of IS NULL AND NOT disqualified ORDER BY score DESC, id LIMIT 25")
def auto_fit_top(spark, sf_dir):
    return _ids(queues.auto_fit(jobs(spark, sf_dir)))


@query(f"""{JOBS} SELECT id FROM jobs WHERE (starts_with(source, 'sr:') OR starts_with(source, 'workday:') OR starts_with(source, 'workable:')) AND delisted_at IS NULL AND duplicate_of IS NULL AND NOT disqualified AND length(coalesce(description, '')) < length(title) + 60
ORDER BY sponsor_reg DESC, score DESC, last_seen_at DESC, id LIMIT 120""")
def description_fill_queue(spark, sf_dir):
    return _ids(queues.fill_queue(jobs(spark, sf_dir), 120))


@query(f"""{JOBS}, h AS (SELECT * FROM jobs WHERE delisted_at IS NULL AND NOT contains(source, ':') AND last_seen_at < {_NOW} - INTERVAL 10 DAY ORDER BY last_seen_at, id LIMIT 80) SELECT id FROM h WHERE url <> '' AND NOT {_WALL} ORDER BY last_seen_at, id LIMIT 40""")
def liveness_queue(spark, sf_dir):
    return _ids(queues.sweep_queue(jobs(spark, sf_dir), now(), 40))


@query(f"{JOBS} (SELECT id, 0 AS phase FROM jobs WHERE NOT disqualified AND id > 100 ORDER BY id LIMIT 50) UNION ALL (SELECT id, 1 AS phase FROM jobs WHERE disqualified ORDER BY id LIMIT 50)")
def keyset_pages(spark, sf_dir):
    rows = jobs(spark, sf_dir).select("id", "disqualified")
    first, second = queues.next_keys(rows, 0, 100, 50), queues.next_keys(rows, 1, None, 50)
    return first.select("id", F.lit(0).alias("phase")).unionByName(second.select("id", F.lit(1).alias("phase")))


@query(f"{JOBS} SELECT id, disqualified::INT AS phase FROM jobs WHERE delisted_at IS NULL AND duplicate_of IS NULL AND id NOT IN (SELECT vec_id FROM embeddings)")
def embedding_queue(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return queues.embed_queue(jobs(spark, sf_dir), vectors).select("id", "phase")


@query(f"{JOBS} SELECT id FROM jobs ORDER BY score DESC, id LIMIT 10")
def top_matches_report(spark, sf_dir):
    return _ids(queues.report(jobs(spark, sf_dir)))


@query("SELECT s_suppkey FROM supplier")
def shuffled_sources(spark, sf_dir):
    return queues.shuffled(read(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", 7)


@query(f"{JOBS} SELECT id FROM jobs WHERE fit_score >= 40 AND fit_by IS NULL AND {_OPEN_SQL} ORDER BY fit_score DESC, score DESC, id LIMIT 10")
def review_batch(spark, sf_dir):
    return _ids(queues.review_batch(jobs(spark, sf_dir)))


@query(f"""{BOARDS} SELECT board_id FROM boards WHERE status = 'active' AND platform <> 'parked' AND NOT (platform = 'lever' AND lower(token) IN ('acme-1', 'acme-21')) AND (last_fetched_at IS NULL OR {_NOW} - last_fetched_at >= to_days(interval_days))
ORDER BY last_fetched_at NULLS FIRST, platform, token, region LIMIT 20""")
def stalest_due_boards(spark, sf_dir):
    curated = spark.createDataFrame([("lever", "ACME-1"), ("lever", "acme-21"), ("gone", "x")], "platform string, token string")
    return queues.stalest_boards(boards(spark, sf_dir), ["greenhouse", "lever", "workable", "ashby"], curated, now(), 20).select("board_id")


@query(f"""WITH e AS (SELECT vec_id, (vec_id * 37) % 101 AS score, vec_id % 3 = 0 AS tier, CASE WHEN vec_id % 7 <> 0 THEN ((vec_id * 71) % 997)::DOUBLE END AS sim FROM embeddings),
k AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY score DESC, vec_id) - 1 AS kw, count(*) OVER (PARTITION BY tier) AS n, count(sim) OVER (PARTITION BY tier) AS m FROM e),
s AS (SELECT vec_id, row_number() OVER (PARTITION BY tier ORDER BY sim DESC, kw) - 1 AS p FROM k WHERE sim IS NOT NULL),
b AS (SELECT vec_id, tier, round(0.4 * kw + 0.6 * CASE WHEN sim IS NULL THEN kw ELSE p * (n - 1)::DOUBLE / (m - 1) END, 6) AS blended FROM k LEFT JOIN s USING (vec_id))
SELECT vec_id, tier, blended, row_number() OVER (ORDER BY tier DESC, blended, vec_id) - 1 AS place FROM b""")
def tiered_blend(spark, sf_dir):
    v = F.col("vec_id")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", (v * 37 % 101).alias("score"), (v % 3 == 0).alias("tier"), F.when(v % 7 != 0, (v * 71 % 997).cast("double")).alias("sim"))
    out = queues.tiered_blend(rows, "tier", "score", "sim", "vec_id").select("vec_id", "tier", F.round("blended", 6).alias("blended"))
    return ranking.global_rank(out, [F.desc("tier"), F.col("blended"), F.col("vec_id")], "place")


# ------------------------------------------------------ writes and histories


def _split(spark, sf_dir):
    rows = jobs(spark, sf_dir).withColumn("dedupe_key", F.concat_ws(":", "source", "external_id"))
    return rows.where("id % 3 <> 0"), rows.where("id % 2 = 0")


_SPLIT = f"{JOBS}, k AS (SELECT *, source || ':' || external_id AS dedupe_key FROM jobs), stored AS (SELECT * FROM k WHERE id % 3 <> 0), incoming AS (SELECT * FROM k WHERE id % 2 = 0)"


@query(f"{_SPLIT} SELECT i.dedupe_key, source, substr(coalesce(description, ''), 1, 8000) AS description, 'listed' AS event FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.dedupe_key = i.dedupe_key)")
def append_new_postings(spark, sf_dir):
    stored, incoming = _split(spark, sf_dir)
    fresh, contents, events = ledger.new_postings(incoming, stored, now())
    return fresh.select("dedupe_key").join(contents, "dedupe_key").join(events, "dedupe_key").select("dedupe_key", "source", "description", "event")


@query(f"{_SPLIT} SELECT count(*) FILTER (s.dedupe_key IS NULL) AS created, count(*) FILTER (s.dedupe_key IS NOT NULL) AS known FROM incoming i LEFT JOIN stored s USING (dedupe_key)")
def candidate_counts(spark, sf_dir):
    stored, incoming = _split(spark, sf_dir)
    return ledger.known_counts(stored, incoming, ["dedupe_key"])


@query("""WITH n AS (SELECT vec_id, label + 100 AS label, vec_id % 5 AS at FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, label + 200, 3 FROM embeddings WHERE vec_id % 4 = 0)
SELECT e.vec_id, coalesce((SELECT arg_max(n.label, n.at * 1000 + n.label) FROM n WHERE n.vec_id = e.vec_id), e.label) AS label FROM embeddings e""")
def vector_upsert(spark, sf_dir):
    stored = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit(0).cast("long").alias("at"))
    a = stored.where("vec_id % 2 = 0").select("vec_id", (F.col("label") + 100).alias("label"), (F.col("vec_id") % 5).alias("at"))
    b = stored.where("vec_id % 4 = 0").select("vec_id", (F.col("label") + 200).alias("label"), F.lit(3).cast("long").alias("at"))
    return ledger.upsert(stored, a.unionByName(b), "vec_id", [F.desc("at"), F.desc("label")]).select("vec_id", "label")


@query(f"""{JOBS}, a AS (SELECT id, 'applied' AS type, NULL AS payload FROM jobs WHERE applied_at IS NOT NULL UNION ALL SELECT id, 'dismissed', CASE WHEN dismiss_reason IS NOT NULL THEN '{{"reason":"' || dismiss_reason || '"}}' END FROM jobs WHERE status = 'ignored')
SELECT id, type, CASE WHEN id % 4 = 0 THEN 'kept' ELSE payload END AS payload FROM a""")
def layered_actions(spark, sf_dir):
    filled = ledger.histories(jobs(spark, sf_dir))["actions"]
    there = filled.where("id % 4 = 0").withColumn("payload", F.lit("kept"))
    once = ledger.insert_absent(there, filled, ["id", "type"])
    return ledger.insert_absent(once, filled, ["id", "type"]).select("id", "type", "payload")  # a second filling changes nothing


@query(f"""{JOBS} SELECT 'listed' AS event, count(*) AS n FROM jobs UNION ALL SELECT 'delisted', count(*) FROM jobs WHERE delisted_at IS NOT NULL
UNION ALL SELECT coalesce(fit_by, '8b-era'), count(*) FROM jobs WHERE fit_score IS NOT NULL GROUP BY 1 UNION ALL SELECT 'pre-migration', count(*) FROM jobs""")
def layered_histories(spark, sf_dir):
    h = ledger.histories(jobs(spark, sf_dir))
    count = lambda name, column: h[name].groupBy(F.col(column).alias("event")).agg(F.count("*").alias("n"))
    return count("listings", "event").unionByName(count("judgments", "model")).unionByName(count("scores", "scorer_version"))


@query(f"{BOARDS}, c AS (SELECT platform, lower(token) AS token, region FROM boards WHERE board_id % 2 = 0) SELECT status, count(*) AS n FROM (SELECT platform, token, region, status FROM boards WHERE board_id % 4 = 1 UNION ALL SELECT platform, token, region, 'candidate' FROM c) GROUP BY 1")
def seed_curated_boards(spark, sf_dir):
    rows = boards(spark, sf_dir).withColumn("discovered_via", F.lit("crawl"))
    curated = rows.where("board_id % 2 = 0").select("platform", F.upper("token").alias("token"), "region", F.col("company_name").alias("name"))
    seeded = ledger.seed_boards(rows.where("board_id % 4 = 1"), curated.unionByName(curated))
    return seeded.groupBy("status").agg(F.count("*").alias("n"))


@query(f"""{JOBS} SELECT (SELECT count(*) FROM jobs) AS total, status AS name, count(*) AS n FROM jobs WHERE NOT disqualified GROUP BY 2 UNION ALL SELECT (SELECT count(*) FROM jobs), coalesce(fit_verdict, 'unscored'), count(*) FROM jobs WHERE NOT disqualified GROUP BY 2""")
def dashboard_snapshot(spark, sf_dir):
    stats = ledger.snapshot(jobs(spark, sf_dir)).select(F.from_json("stats", "total long, by_status map<string,long>, by_verdict map<string,long>").alias("s"))
    both = stats.select("s.total", F.explode(F.map_concat("s.by_status", "s.by_verdict")).alias("name", "n"))
    return both


# --------------------------------------------------------------------- joins


@query(f"""{JOBS}, r AS (SELECT DISTINCT country, lower(regexp_replace(company, '[^A-Za-z0-9]', '', 'g')) AS k FROM jobs WHERE id % 50 = 0 AND country IN ('de', 'gb')) SELECT id, coalesce(country IN ('de', 'gb'), false) AND EXISTS (SELECT 1 FROM r WHERE r.country = jobs.country AND r.k = lower(regexp_replace(company, '[^A-Za-z0-9]', '', 'g'))) AS registered FROM jobs""")
def sponsor_register_match(spark, sf_dir):
    rows = jobs(spark, sf_dir)
    register = rows.where("id % 50 = 0 and country in ('de', 'gb')").select("country", F.concat(F.upper("company"), F.lit(" GmbH")).alias("name"))
    return ledger.sponsor_flag(rows.select("id", "country", "company"), register, "registered").select("id", "registered")


@query(f"{JOBS} SELECT id, CASE WHEN id % 4 = 0 THEN title ELSE coalesce(description, title) END AS description FROM jobs")
def job_with_content(spark, sf_dir):
    rows = jobs(spark, sf_dir)
    return ledger.with_content(rows.select("id", "title"), rows.where("id % 4 <> 0").select("id", "description")).select("id", "description")


@query(f"{JOBS} SELECT id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS sim FROM jobs LEFT JOIN embeddings ON vec_id = id")
def job_with_vector(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    dot = F.aggregate(F.transform("vector", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return ledger.with_similarity(jobs(spark, sf_dir).select("id"), vectors, F.round(dot, 4))


@query(f"{JOBS} SELECT id FROM jobs WHERE NOT (id % 5 = 0) ")
def stale_score_version(spark, sf_dir):
    rows = jobs(spark, sf_dir)
    history = rows.where("id % 5 = 0").select("id", F.lit("v6").alias("version")).unionByName(rows.where("id % 3 = 0").select("id", F.lit("v5").alias("version")))
    return _ids(ledger.without(rows, history, "id", F.col("version") == "v6"))


@query(f"""{JOBS} SELECT id, CASE WHEN delisted_at IS NULL AND source IN ('gh:acme', 'sr:beta') AND id % 3 = 0 AND source <> 'sr:beta' THEN 'refreshed' WHEN delisted_at IS NULL AND source IN ('gh:acme', 'sr:beta') THEN 'delisted' ELSE 'kept' END AS outcome FROM jobs""")
def feed_diff(spark, sf_dir):
    rows = jobs(spark, sf_dir)
    feed = rows.where("id % 3 = 0 and source in ('gh:acme', 'adzuna')").select("source", "external_id")
    fetched = spark.createDataFrame([("gh:acme",), ("sr:beta",)], "source string")  # the second one's feed was empty
    at = F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")
    out = ledger.feed_diff(rows, feed, fetched, at)
    return out.select("id", F.when(F.coalesce(F.col("delisted_at") == at, F.lit(False)), "delisted").when(F.col("last_seen_at") == at, "refreshed").otherwise("kept").alias("outcome"))


@query(f"""{JOBS} SELECT id, CASE WHEN {_KEY} = 'oslo' THEN 'no' WHEN {_KEY} = 'berlin' THEN 'de' END AS country, coalesce({_KEY} IN ('berlin', 'paris'), false) AS cache_hit FROM jobs""")
def location_cache_join(spark, sf_dir):
    cache = spark.createDataFrame([("berlin", "de"), ("paris", None)], "raw string, country string")
    direct = F.when(F.lower("location") == "oslo", "no")
    rows = jobs(spark, sf_dir).select("id", "location")
    return ledger.with_cache(rows, cache, direct, detect.location_key(F.col("location"))).select("id", "country", "cache_hit")


@query(f"{JOBS} SELECT id, coalesce(country, CASE location WHEN 'Berlin' THEN 'de' WHEN ' PARIS ' THEN 'fr' END) AS country FROM jobs")
def backfill_country(spark, sf_dir):
    answers = spark.createDataFrame([("Berlin", "de"), (" PARIS ", "fr"), ("Oslo", None)], "location string, country string")
    return ledger.fill_null(jobs(spark, sf_dir).select("id", "location", "country"), answers, ["location"], "country").select("id", "country")


@query(f"{JOBS}, w AS (SELECT CASE WHEN id % 3 = 0 THEN 'site' END AS website, company, id FROM jobs) SELECT id, coalesce(website, CASE WHEN company = 'Company 3' THEN 'three.example' WHEN company = 'Company 4' THEN 'four.example' END) AS website FROM w")
def fill_websites(spark, sf_dir):
    rows = jobs(spark, sf_dir).select("id", detect.company_name(F.col("company")).alias("name"), F.when(F.col("id") % 3 == 0, "site").alias("website"))
    seeds = spark.createDataFrame([("Company 3 GmbH", "three.example"), ("COMPANY-4", "four.example"), ("company 5", None)], "name string, website string")
    answers = seeds.select(detect.company_name(F.col("name")).alias("name"), "website")
    return ledger.fill_null(rows, answers, ["name"], "website").select("id", "website")


@query(f"""{JOBS} SELECT source, CASE WHEN source = 'adzuna' THEN -1 WHEN source = 'indeed' THEN 0 ELSE count(*) END AS n FROM jobs GROUP BY 1""")
def per_source_counts(spark, sf_dir):
    rows = jobs(spark, sf_dir).select("source")
    states = spark.createDataFrame([("adzuna", "2001-07-30 00:00:00"), ("remotive", "2001-01-01 00:00:00")], "source string, t string").select("source", F.col("t").cast("timestamp_ntz").alias("last_fetched_at"))
    return ledger.fetch_plan(rows.distinct(), states, rows.where("source not in ('indeed')"), now(), {"adzuna": 5, "remotive": 5})


@query(f"{JOBS} SELECT id, EXISTS (SELECT 1 FROM jobs p WHERE p.company = j.company AND p.status = 'offer' AND p.id % 50 = 7) AS pursued FROM jobs j")
def pursued_company_flag(spark, sf_dir):
    rows = jobs(spark, sf_dir)
    companies = ledger.pursued_companies(rows.where("status = 'offer' and id % 50 = 7"))
    return relational.flag_if_in(rows.select("id", "company"), companies, ["company"], "pursued").select("id", "pursued")


@query(f"{JOBS} SELECT DISTINCT company FROM jobs WHERE status IN ('applied', 'interview', 'offer')")
def companies_pursued(spark, sf_dir):
    return ledger.pursued_companies(jobs(spark, sf_dir))


_JUDGED = f"{JOBS}, j AS (SELECT id, fit_score AS a, (fit_score * 3 + id) % 101 AS b FROM jobs WHERE fit_score IS NOT NULL AND id % 2 = 0)"


def _judgments(spark, sf_dir):
    rows = jobs(spark, sf_dir).where("fit_score is not null")
    first = rows.select("id", F.lit("8b").alias("model"), "fit_score", F.col("updated_at").alias("at"))
    old = first.withColumns({"fit_score": F.lit(1), "at": F.col("at") - F.expr("interval '2' day")})
    second = rows.where("id % 2 = 0").select("id", F.lit("27b").alias("model"), ((F.col("fit_score") * 3 + F.col("id")) % 101).cast("int").alias("fit_score"), F.col("updated_at").alias("at"))
    return old.unionByName(first).unionByName(second)


@query(f"{_JUDGED} SELECT id, (b - a)::INT AS delta FROM j")
def judge_delta(spark, sf_dir):
    return ledger.judge_deltas(_judgments(spark, sf_dir), "8b", "27b").select("id", "delta")


@query(f"{_JUDGED} SELECT count(*) AS n, count(*) FILTER (b - a >= 15) AS raised, count(*) FILTER (b - a <= -20) AS dropped, round(avg((b < a)::INT), 6) AS optimistic FROM j")
def judge_delta_report(spark, sf_dir):
    return ledger.delta_report(ledger.judge_deltas(_judgments(spark, sf_dir), "8b", "27b"))


@query(f"""{JOBS}, n AS (SELECT id, CASE WHEN company = 'Company 7' AND status IN ('new', 'interested') THEN 'ignored' ELSE status END AS status, company = 'Company 7' AND status IN ('new', 'interested') AS logged FROM jobs) SELECT id, status, logged FROM n""")
def dismiss_company(spark, sf_dir):
    after, log = ledger.dismiss_company(jobs(spark, sf_dir), "Company 7", now())
    return relational.flag_if_in(after.select("id", "status"), log.select("id"), ["id"], "logged")


# ---------------------------------------------------------- counts and state


@query(f"{BOARDS} SELECT status, count(*) AS n FROM boards GROUP BY 1")
def board_status_counts(spark, sf_dir):
    return boards(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"{JOBS} SELECT source, count(DISTINCT external_id) AS ids FROM jobs WHERE contains(source, ':') GROUP BY 1")
def seen_ids_per_source(spark, sf_dir):
    return ledger.seen_ids(jobs(spark, sf_dir))


@query(f"{JOBS}, s AS (SELECT CASE WHEN contains(source, ':') THEN source || (id % 40) ELSE source END AS source, last_seen_at, delisted_at FROM jobs) SELECT source, min(last_seen_at)::VARCHAR AS oldest FROM s WHERE contains(source, ':') AND delisted_at IS NULL AND last_seen_at < {_NOW} - INTERVAL 2 DAY GROUP BY 1 ORDER BY min(last_seen_at), source LIMIT 15")
def stalest_direct_sources(spark, sf_dir):
    rows = jobs(spark, sf_dir).withColumn("source", F.when(F.col("source").contains(":"), F.concat("source", F.col("id") % 40)).otherwise(F.col("source")))
    return ledger.stalest_sources(rows, now()).select("source", F.col("oldest").cast("string").alias("oldest"))


@query(f"{JOBS} SELECT id % 9 AS slice, count(*) AS n, round(avg((score >= 20 AND NOT disqualified)::INT), 6) AS pass_rate FROM jobs GROUP BY 1")
def board_pass_rate(spark, sf_dir):
    passed = (F.col("score") >= scoring.STORE_THRESHOLD) & ~F.col("disqualified")
    return jobs(spark, sf_dir).groupBy((F.col("id") % 9).alias("slice")).agg(F.count("*").alias("n"), F.round(F.avg(passed.cast("double")), 6).alias("pass_rate"))


@query(f"{JOBS}, s AS (SELECT c_nationkey AS k FROM customer) SELECT 25::BIGINT AS slices, sum(k)::BIGINT AS boards, count(*)::BIGINT AS stored, sum(k % 3)::BIGINT AS updated, sum(k % 2)::BIGINT AS delisted, 0::BIGINT AS errors FROM s")
def sweep_totals(spark, sf_dir):
    k = F.col("c_nationkey")
    slices = read(spark, sf_dir, "customer").groupBy(k).agg(F.sum(k).alias("boards"), F.count("*").alias("stored"), F.sum(k % 3).alias("updated"), F.sum(k % 2).alias("delisted"), F.lit(0).cast("long").alias("errors"))
    return ledger.sweep_totals(slices)


def _outcomes(spark, sf_dir):
    kind = F.col("board_id") % 8
    result = F.when(kind < 4, "active").when(kind < 6, "dead").when(kind == 6, "error")
    return boards(spark, sf_dir).select("platform", "token", "region", result.alias("result"), F.when(kind == 1, "Probed").alias("company_name")).where("result is not null")


@query(f"""{BOARDS}, o AS (SELECT *, CASE WHEN board_id % 8 < 4 THEN 'active' WHEN board_id % 8 < 6 THEN 'dead' END AS result FROM boards)
SELECT board_id, coalesce(result, status) AS status, CASE WHEN result IS NOT NULL THEN coalesce(CASE WHEN board_id % 8 = 1 THEN 'Probed' END, company_name, 'Acme ' || board_id) ELSE company_name END AS company_name, result IS NOT NULL AS stamped FROM o""")
def board_status_machine(spark, sf_dir):
    at = F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")
    out = ledger.validated(boards(spark, sf_dir), _outcomes(spark, sf_dir), at)
    return out.select("board_id", "status", "company_name", F.coalesce(F.col("validated_at") == at, F.lit(False)).alias("stamped"))


@query(f"{BOARDS} SELECT count(*) FILTER (board_id % 8 < 7) AS checked, count(*) FILTER (board_id % 8 < 4) AS active, count(*) FILTER (board_id % 8 IN (4, 5)) AS dead, count(*) FILTER (board_id % 8 < 4 AND status = 'dead') AS revived, count(*) FILTER (board_id % 8 = 6) AS errors FROM boards")
def validation_report(spark, sf_dir):
    return ledger.validation_report(boards(spark, sf_dir), _outcomes(spark, sf_dir))


@query(f"{BOARDS} SELECT board_id, CASE WHEN board_id % 3 = 0 THEN NULL ELSE last_fetched_at::VARCHAR END AS last_fetched_at, CASE WHEN board_id % 3 = 0 THEN 1 ELSE interval_days END AS interval_days FROM boards")
def sweep_rollback(spark, sf_dir):
    rows = boards(spark, sf_dir)
    tried = rows.where("board_id % 3 = 0").select("platform", "token", "region")
    undone = ledger.unstamped(rows, tried, tried.count())
    same = ledger.unstamped(undone, tried, 0)  # a slice without errors stays as it is
    return same.select("board_id", F.col("last_fetched_at").cast("string").alias("last_fetched_at"), "interval_days")


@query("""WITH a AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'follow-up' ELSE 'note' END AS type, CASE WHEN event_type = 'view' THEN 'clear' WHEN event_type = 'click' THEN '3' WHEN event_id % 5 = 0 THEN '' ELSE 'note ' || event_id END AS value FROM events)
SELECT user_id, (SELECT CASE WHEN arg_max(f.value, (f.ts, f.value)) = '3' THEN strftime(max(f.ts) + INTERVAL 3 DAY, '%Y-%m-%d %H:%M:%S') END FROM a f WHERE f.user_id = a.user_id AND f.type = 'follow-up') AS follow_up_at, nullif((SELECT arg_max(n.value, (n.ts, n.value)) FROM a n WHERE n.user_id = a.user_id AND n.type = 'note'), '') AS note FROM a GROUP BY user_id""")
def follow_ups_and_notes(spark, sf_dir):
    kind = F.col("event_type")
    value = F.when(kind == "view", "clear").when(kind == "click", "3").when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("note "), "event_id"))
    rows = read(spark, sf_dir, "events").select("user_id", F.when(kind.isin("click", "view"), "follow-up").otherwise("note").alias("type"), value.alias("value"), F.col("ts").alias("at"))
    return ledger.follow_ups(rows, "user_id").select("user_id", F.date_format("follow_up_at", "yyyy-MM-dd HH:mm:ss").alias("follow_up_at"), "note")


@query("SELECT DISTINCT lower(p_name) AS raw FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey % 40 = 0)")
def asked_once(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select(F.lower("p_name").alias("raw"), "p_partkey")
    return ledger.without(parts.select("raw").distinct(), parts.where("p_partkey % 40 = 0"), "raw")


# --------------------------------------------------------------- evaluation

_RATED = """WITH e AS (SELECT vec_id AS id, (vec_id * 37) % 101 AS fit, ((vec_id * 71) % 997)::DOUBLE AS sim1, ((vec_id * 37) % 101 + (vec_id * 13) % 29)::DOUBLE AS sim2, (vec_id * 11) % 97 AS keyword FROM embeddings),
x AS (SELECT *, list_sum(list_transform(string_split(id::VARCHAR, ''), lambda c: ascii(c))) % 997 % 2 = 0 AS tune FROM e),
c AS (SELECT 'one' AS config, id, fit, sim1 AS sim, tune FROM x UNION ALL SELECT 'two', id, fit, sim2, tune FROM x UNION ALL SELECT 'KEYWORD-BASELINE', id, fit, keyword::DOUBLE, tune FROM x),
s AS (SELECT *, 'tune' AS slice FROM c WHERE tune UNION ALL SELECT *, 'confirm' FROM c WHERE NOT tune UNION ALL SELECT *, 'gold' FROM c WHERE id % 3 = 0 UNION ALL SELECT *, 'nonEN' FROM c WHERE id % 7 = 0),
r AS (SELECT *, row_number() OVER w AS p, count(*) OVER (PARTITION BY config, slice) AS n, rank() OVER (PARTITION BY config, slice ORDER BY sim) + (count(*) OVER (PARTITION BY config, slice, sim) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY config, slice ORDER BY fit) + (count(*) OVER (PARTITION BY config, slice, fit) - 1) / 2.0 AS rb FROM s WINDOW w AS (PARTITION BY config, slice ORDER BY sim DESC, id)),
m AS (SELECT config, slice, n, count(*) FILTER (p <= 100 AND fit >= 70) / least(100, n) AS p100, coalesce(count(*) FILTER (p <= ceil(n * 0.2) AND fit >= 80) / nullif(count(*) FILTER (fit >= 80), 0), 0) AS gem_recall, corr(ra, rb) AS rho FROM r GROUP BY config, slice, n)"""


def _rated(spark, sf_dir):
    v = F.col("vec_id")
    base = read(spark, sf_dir, "embeddings").select(v.alias("id"), (v * 37 % 101).alias("fit"), (v * 71 % 997).cast("double").alias("s1"), (v * 37 % 101 + v * 13 % 29).cast("double").alias("s2"), (v * 11 % 97).alias("keyword"))
    one, two = base.withColumns({"config": F.lit("one"), "sim": F.col("s1")}), base.withColumns({"config": F.lit("two"), "sim": F.col("s2")})
    rows = evaluation.with_baseline(one.unionByName(two))
    tune = hash_half(F.col("id")) == "tune"
    return evaluation.metrics(evaluation.sliced(rows, {"tune": tune, "confirm": ~tune, "gold": F.col("id") % 3 == 0, "nonEN": F.col("id") % 7 == 0}))


@query(_RATED + " SELECT config, slice, n, round(p100, 6) AS p100, round(gem_recall, 6) AS gem_recall, round(rho, 6) AS rho FROM m")
def config_slice_metrics(spark, sf_dir):
    return _rated(spark, sf_dir).select("config", "slice", "n", *(F.round(c, 6).alias(c) for c in ("p100", "gem_recall", "rho")))


@query(_RATED + " SELECT config, max(round(p100, 6)) FILTER (slice = 'tune') AS tune_p100, max(round(p100, 6)) FILTER (slice = 'gold') AS gold_p100, max(round(rho, 6)) FILTER (slice = 'confirm') AS confirm_rho FROM m GROUP BY 1")
def ranked_configs(spark, sf_dir):
    return evaluation.ranked_configs(_rated(spark, sf_dir)).select("config", *(F.round(c, 6).alias(c) for c in ("tune_p100", "gold_p100", "confirm_rho")))


# ------------------------------------------------------------------- scoring

_FULL = scoring.Profile(
    tracks=(scoring.Track("data", "Data", ("data",), ("read", "work"), variants=("analyst",)), scoring.Track("cloud", "Cloud", ("cloud", "platform"), ("description",), avoid=("head of", "developer"))),
    negative=("Lead",), role_negative=("head",), signals=("engineer", "developer", "analyst", "platform"), boost=("senior",), avoid=("junior",), accept=("berlin", "dach"),
)
_PLACES = scoring.Places({"de": "Germany", "fr": "France", "no": "Norway"}, {"dach": ["de", "at", "ch"]}, {}, {"paris": "fr", "oslo": "no", "berlin": "de"})


@query(f"""{JOBS}, t AS (SELECT id, lower(title) AS low, title, lower(title || chr(10) || coalesce(description, '')) AS txt, work_mode = 'remote' AS remote, coalesce(location, '') AS loc FROM jobs),
a AS (SELECT *, contains(low, 'data')::INT + contains(low, 'analyst')::INT AS n0, contains(txt, 'read')::INT + contains(txt, 'work')::INT AS b0, contains(low, 'cloud')::INT + contains(low, 'platform')::INT AS n1, contains(txt, 'description')::INT AS b1 FROM t),
g AS (SELECT *, CASE WHEN title = 'Sales Lead' THEN 'Excluded (Lead)' WHEN title = 'Head of Platform' AND n0 + n1 = 0 THEN 'Non-eng role (head)' WHEN NOT (contains(low, 'engineer') OR contains(low, 'developer') OR contains(low, 'analyst') OR contains(low, 'platform')) THEN 'No engineering role signal in title'
  WHEN NOT remote AND lower(trim(loc)) IN ('paris', 'oslo') THEN 'Region mismatch (' || loc || ')' END AS gate FROM a),
s AS (SELECT *, CASE WHEN 40 * n0 + 5 * b0 > 0 THEN greatest(0, least(100, least(100, CASE WHEN n0 > 0 THEN 40 * n0 + 5 * b0 ELSE least(22, 5 * b0) END + remote::INT * 8) + CASE WHEN title LIKE 'Senior%' THEN 8 ELSE 0 END)) END AS s0,
  CASE WHEN 40 * n1 + 5 * b1 > 0 THEN greatest(0, least(100, least(100, CASE WHEN n1 > 0 THEN 40 * n1 + 5 * b1 ELSE 5 * b1 END + remote::INT * 8) + CASE WHEN title LIKE 'Senior%' THEN 8 WHEN title IN ('Head of Platform', 'Cloud Developer') THEN -8 ELSE 0 END)) END AS s1 FROM g),
p AS (SELECT *, CASE WHEN s0 IS NOT NULL AND (s1 IS NULL OR s0 > s1 OR (s0 = s1 AND NOT (n1 > 0 AND n0 = 0))) THEN 'data' WHEN s1 IS NOT NULL THEN 'cloud' END AS pick FROM s)
SELECT id, CASE WHEN gate IS NULL AND pick IS NOT NULL THEN CASE pick WHEN 'data' THEN s0 ELSE s1 END ELSE 0 END AS score, CASE WHEN gate IS NULL AND pick IS NOT NULL THEN pick ELSE 'other' END AS track, coalesce(gate, CASE WHEN pick IS NULL THEN 'No track match' END, 'x') AS gate,
  CASE title WHEN 'Senior Data Engineer' THEN 'senior' WHEN 'Head of Platform' THEN 'management' WHEN 'Sales Lead' THEN 'senior' ELSE 'unknown' END AS seniority_level FROM p""")
def score_postings(spark, sf_dir):
    rows = jobs(spark, sf_dir).select("id", "title", "description", "location", (F.col("work_mode") == "remote").alias("remote"))
    out = scoring.score_postings(rows, _FULL, location="location", places=_PLACES)
    gate = F.when(F.col("reason").rlike("^(Excluded|Non-eng|No |Region)"), F.col("reason")).otherwise("x")
    return out.select("id", "score", "track", gate.alias("gate"), "seniority_level")


@query(f"{JOBS} SELECT id, 'https://ex.org/j?ref=' || id || CASE WHEN id % 2 = 0 THEN '&source=x' ELSE '' END AS canonical FROM jobs")
def canonical_urls_keep_ids(spark, sf_dir):
    raw = F.concat(F.lit("HTTPS://Ex.ORG/j?utm_source=a&"), F.when(F.col("id") % 2 == 0, "source=x&").otherwise(""), F.lit("ref="), "id", F.lit("&_hsmi=2#top"))
    return jobs(spark, sf_dir).select("id", canonical_url(raw).alias("canonical"))


_SAYS = (
    ("Flytende norsk kreves.", "no"), ("Fluent German needed.", "de"), ("Fluent in French, Dutch B2.", "fr,nl"), ("Italiano madrelingua", "it"), ("Spanish native; fluent Polish would be a plus.", ""), ("Flydende dansk", "da"),
    ("Sujuva suomi", "fi"), ("flytande svenska", "sv"), ("język polski", "pl"), ("Nothing asked.", ""), ("German is nice", ""), ("español avanzado", "es"),
)


@query(f"{JOBS} SELECT id, {_case('id % 12', [c for _, c in _SAYS])} AS languages FROM jobs")
def language_phrases(spark, sf_dir):
    said = F.element_at(F.array(*(F.lit(s) for s, _ in _SAYS)), (F.col("id") % 12 + 1).cast("int"))
    return jobs(spark, sf_dir).select("id", F.array_join(detect.language_requirements(said), ",").alias("languages"))


_VISA = (
    ("We offer visa sponsorship.", "yes"), ("No visa sponsorship, sadly.", "no"), ("Relocation package included", "yes"), ("You must have the legal right to work here.", "no"), ("visa sponsorship is not available", "no"), ("Great team", "unknown"),
    ("We can sponsor your visa. But: unable to provide sponsorship for juniors.", "no"), ("Work permit assistance", "yes"), ("Eligible to work in the EU required", "no"), ("a relocated office", "unknown"),
)


@query(f"{JOBS} SELECT id, {_case('id % 10', [v for _, v in _VISA])} AS visa FROM jobs")
def visa_phrases(spark, sf_dir):
    said = F.element_at(F.array(*(F.lit(s) for s, _ in _VISA)), (F.col("id") % 10 + 1).cast("int"))
    return jobs(spark, sf_dir).select("id", detect.visa(F.lit("Dev"), said).alias("visa"))


_TITLES = (
    ("Head of Data", "", "management"), ("Staff Engineer", "", "staff"), ("Junior Dev", "10 years", "junior"), ("Tech Lead", "", "senior"), ("Team Lead", "with direct reports", "management"), ("Engineer", "8+ years of it", "staff"), ("Engineer", "5 years", "senior"),
    ("Engineer", "2 Jahre", "mid"), ("Engineer", "1 year", "junior"), ("Engineer", "", "unknown"), ("Werkstudent IT", "", "intern"), ("Sr. Engineer", "", "senior"), ("Engineer", "people management", "management"), ("Medior Dev", "", "mid"),
)


@query(f"{JOBS} SELECT id, {_case('id % 14', [v for *_, v in _TITLES])} AS level FROM jobs")
def seniority_titles(spark, sf_dir):
    at = (F.col("id") % 14 + 1).cast("int")
    title, body = (F.element_at(F.array(*(F.lit(t[i]) for t in _TITLES)), at) for i in (0, 1))
    return jobs(spark, sf_dir).select("id", detect.seniority(title, body)["level"].alias("level"))
