"""Queries over detectors, connectors, registers, boards and streams, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.checkpoints import shared_folder
from tessera.functions import detect, slugs
from tessera.operators import models, relational
from tessera.plans.registry import query, read
from tessera.sources import ats, boards, registers
from tessera.streaming import events

_HEAD = "string_split(text, chr(10))[1]"


def _docs(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", "text", F.substring_index("text", "\n", 1).alias("title"))


def _quoted(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


def _alternation(patterns) -> str:
    return _quoted("|".join(f"(?:{p})" for p in patterns))


@query(f"SELECT doc_id, CASE WHEN regexp_matches({_HEAD} || chr(10) || text, {_alternation(detect.VISA_NO)}) THEN 'no' WHEN regexp_matches({_HEAD} || chr(10) || text, {_alternation(detect.VISA_YES)}) THEN 'yes' ELSE 'unknown' END AS visa FROM documents")
def visa_signal(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", detect.visa(F.col("title"), F.col("text")).alias("visa"))


#: The corpus is no postings, so two of its own words stand in as demands.
_DEMANDS = {"en": "th(e|is) \\w+", "de": "d(er|ie|as) \\w+", "fr": "les \\w+"}
_WISH = "(with|und|est)"


def _sql_demand(code: str, pattern: str) -> str:
    found = f"regexp_extract(text, {_quoted(pattern)})"
    near = f"substr(text, greatest(strpos(text, {found}) - 80, 1), least(strpos(text, {found}) - 1, 80) + length({found}) + 80)"
    return f"CASE WHEN {found} <> '' AND NOT regexp_matches({near}, {_quoted(_WISH)}) THEN '{code}' END"


@query(f"SELECT doc_id, array_to_string(list_filter([{', '.join(_sql_demand(c, p) for c, p in _DEMANDS.items())}], lambda x: x IS NOT NULL), ',') AS languages FROM documents")
def language_requirements(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(detect.language_requirements(F.col("text"), _DEMANDS, _WISH), ",").alias("languages"))


_LEVELS = " ".join(f"WHEN regexp_matches({_HEAD}, {_quoted(p)}) THEN '{level}'" for level, p in detect.TITLE_LEVELS)


@query(f"""SELECT doc_id, CASE {_LEVELS} WHEN regexp_matches({_HEAD}, {_quoted(detect.LEAD)}) THEN CASE WHEN regexp_matches(text, {_quoted(detect.MANAGES)}) THEN 'management' ELSE 'senior' END WHEN regexp_matches(text, {_quoted(detect.MANAGES)}) THEN 'management'
WHEN y >= 8 THEN 'staff' WHEN y >= 5 THEN 'senior' WHEN y >= 2 THEN 'mid' WHEN y IS NOT NULL THEN 'junior' ELSE 'unknown' END AS level FROM (SELECT *, nullif(regexp_extract(text, {_quoted(detect.YEARS)}, 1), '')::INT AS y FROM documents)""")
def seniority_level(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", detect.seniority(F.col("title"), F.col("text"))["level"].alias("level"))


@query(rf"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'onsite' WHEN regexp_matches({_HEAD} || ' ' || lang || ' ' || substr(text, 1, 2000), '(?i)\bhybrid\b') THEN 'hybrid' WHEN doc_id % 3 = 0 THEN 'remote' ELSE 'onsite' END AS work_mode FROM documents")
def work_mode(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    mode = detect.work_mode(F.when(F.col("doc_id") % 7 == 0, "onsite"), F.substring_index("text", "\n", 1), F.col("lang"), F.col("text"), F.col("doc_id") % 3 == 0)
    return docs.select("doc_id", mode.alias("work_mode"))


@query(f"""WITH p AS (SELECT page_id, CASE page_id % 10 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END AS status, regexp_replace(regexp_replace(strip_accents(html), '[\\s ]+', ' ', 'g'), '(?i)has been filled out', ' ', 'g') AS t FROM pages)
SELECT page_id, CASE WHEN status = 404 THEN 'expired' WHEN status <> 200 THEN 'uncertain' WHEN regexp_matches(t, {_alternation(p.replace('(?!\\s+out)', '') for p in detect.CLOSED)}) THEN 'expired' ELSE 'active' END AS liveness FROM p""")
def page_liveness(spark, sf_dir):
    status = F.when(F.col("page_id") % 10 == 0, 404).when(F.col("page_id") % 10 == 1, 503).otherwise(200)
    return read(spark, sf_dir, "pages").select("page_id", detect.liveness(status, F.col("html")).alias("liveness"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'supplier ' ELSE 'supplier gmbh ' END AS dirty, 'supplier ' || lpad(s_suppkey::VARCHAR, 9, '0') AS name, 'supplier' || lpad(s_suppkey::VARCHAR, 9, '0') || ',' || 'supplier-' || lpad(s_suppkey::VARCHAR, 9, '0') AS slugs FROM supplier")
def company_slugs(spark, sf_dir):
    suppliers = read(spark, sf_dir, "supplier")
    dirty = F.when(F.col("s_suppkey") % 2 == 0, "supplier ").otherwise("supplier gmbh ")
    name = F.concat(dirty, F.regexp_extract("s_name", r"(\d+)", 1), F.lit(" GmbH"))
    return suppliers.select("s_suppkey", dirty.alias("dirty"), detect.company_name(name).alias("name"), F.array_join(detect.slug_candidates(name), ",").alias("slugs"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'c' || c_nationkey END AS country FROM customer")
def resolve_country(spark, sf_dir):
    places = {f"nation_{i}": f"c{i}" for i in range(25)}
    named = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    location = F.when(F.col("c_custkey") % 5 == 0, "Remote").otherwise(F.concat(F.lit("Some City ("), "c_mktsegment", F.lit("), "), "n_name"))
    return named.select("c_custkey", detect.country_of(location, places, []).alias("country"))


def _bodies(rows: DataFrame, keys: list[str], item, wrap: str | None = None) -> DataFrame:
    """One page a board, its items in order."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(*keys, item.alias("item")))), lambda s: s["item"])
    body = F.to_json(F.struct(items.alias(wrap))) if wrap else F.to_json(items)
    return rows.groupBy("token").agg(body.alias("body")).select("token", F.lit("Acme").alias("company"), F.lit("").alias("region"), F.lit(0).alias("page"), "body")


@query("SELECT 'gh:c' || o_custkey AS source, o_orderkey::VARCHAR AS external_id, o_orderpriority AS title, o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN ' Remote' ELSE '' END AS location, o_orderkey % 2 = 0 AS remote, 'a & b' AS description, o_orderdate::DATE::VARCHAR AS day FROM orders")
def ats_greenhouse(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("token", F.concat(F.lit("c"), "o_custkey"))
    place = F.struct(F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, " Remote").otherwise("")).alias("name"))
    job = F.struct(F.col("o_orderkey").alias("id"), F.lit("u").alias("absolute_url"), F.col("o_orderpriority").alias("title"), place.alias("location"), F.lit("<p>a &amp;<br> b</p>").alias("content"), F.col("o_orderdate").alias("updated_at"))
    out = ats.fetched(_bodies(orders, ["o_orderkey"], job, "jobs"), "greenhouse")
    return out.select("source", "external_id", "title", "location", "remote", "description", F.to_date("posted_at").cast("string").alias("day"))


@query("""WITH l AS (SELECT l_orderkey, list(CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag || l_linestatus ELSE l_linestatus END ORDER BY l_linenumber, l_partkey, l_suppkey) AS places FROM lineitem GROUP BY 1)
SELECT l_orderkey::VARCHAR AS external_id, list_reduce(list_prepend('', places), lambda a, p: CASE WHEN contains(a, p) THEN a WHEN a = '' THEN p ELSE a || '; ' || p END) AS location FROM l""")
def ats_rippling_merge(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").withColumn("token", (F.col("l_orderkey") % 97).cast("string"))
    label = F.when(F.col("l_linenumber") % 2 == 0, F.concat("l_returnflag", "l_linestatus")).otherwise(F.col("l_linestatus"))
    job = F.struct(F.col("l_orderkey").alias("uuid"), F.lit("Dev").alias("name"), F.struct(label.alias("label")).alias("workLocation"))
    return ats.fetched(_bodies(lines, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], job), "rippling").select("external_id", "location")


@query("SELECT o_custkey::VARCHAR AS external_id, arg_min(o_orderpriority, (CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey)) AS title FROM orders GROUP BY 1")
def english_first_dedupe(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("token", F.lit("jobs.example.org"))
    job = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("unifiedStandardTitle")).alias("response"))).alias("jobSearchResult")))
    locale = F.when(F.col("o_orderstatus") == "F", "en_US").otherwise("de_DE")
    pages = orders.select("token", F.lit("Acme").alias("company"), locale.alias("region"), F.col("o_orderkey").alias("page"), job.alias("body"))
    return ats.fetched(pages, "successfactors").select("external_id", "title")


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate IS NULL OR o_orderkey % 11 = 0 OR o_orderdate >= TIMESTAMP '1997-01-01'""")
def window_filter_undated(spark, sf_dir):
    dated = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")).alias("posted_at")
    return boards.within_window(read(spark, sf_dir, "orders").select("o_orderkey", dated), F.lit("1997-01-01").cast("timestamp")).select("o_orderkey")


@query("""SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'lever' WHEN 1 THEN 'greenhouse' WHEN 2 THEN 'workday' WHEN 3 THEN 'recruitee' WHEN 4 THEN 'comeet' END AS platform,
CASE s_suppkey % 6 WHEN 0 THEN 'co-' || s_suppkey WHEN 1 THEN 'co-' || s_suppkey WHEN 2 THEN 'co-' || s_suppkey || '@wd5/ext' WHEN 3 THEN 'co-' || s_suppkey WHEN 4 THEN 'co-' || s_suppkey || '/61.003' END AS token, CASE WHEN s_suppkey % 6 = 0 THEN 'eu' WHEN s_suppkey % 6 < 5 THEN '' END AS region FROM supplier""")
def board_extraction(spark, sf_dir):
    name, kind = F.concat(F.lit("Co-"), "s_suppkey"), F.col("s_suppkey") % 6
    url = (
        F.when(kind == 0, F.concat(F.lit("https://jobs.eu.lever.co/"), name, F.lit("/x?y#z"))).when(kind == 1, F.concat(F.lit("http://boards.greenhouse.io/embed/job_app?a=b&for="), name))
        .when(kind == 2, F.concat(F.lit("https://"), name, F.lit(".wd5.myworkdayjobs.com/en-US/Ext"))).when(kind == 3, F.concat(F.lit("https://"), name, F.lit(".recruitee.com/o/dev")))
        .when(kind == 4, F.concat(F.lit("https://www.comeet.com/jobs/"), name, F.lit("/61.003/dev"))).otherwise("https://www.recruitee.com/pricing")
    )
    return read(spark, sf_dir, "supplier").select("s_suppkey", slugs.board_of(url).alias("b")).select("s_suppkey", "b.platform", "b.token", "b.region")


@query("SELECT p_brand AS host, count(DISTINCT p_type) AS platforms FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def host_collisions(spark, sf_dir):
    return slugs.host_collisions(read(spark, sf_dir, "part").select(F.col("p_brand").alias("host"), F.col("p_type").alias("platform")))


@query("""WITH c AS (SELECT a.o_orderkey, b.o_orderkey AS candidate, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate DESC, b.o_orderkey) AS place FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey WHERE a.o_orderstatus = 'P')
SELECT o_orderkey, candidate, place FROM c WHERE place <= 12""")
def duplicate_candidates(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Company "), "o_custkey").alias("company"), "o_orderdate", "o_orderstatus", F.lit(None).cast("long").alias("duplicate_of"))
    return models.duplicate_candidates(orders.where("o_orderstatus = 'P'"), orders, "o_orderkey", "company", "o_orderdate")


@query("""WITH t AS (SELECT DISTINCT regexp_replace(lower(p_type), '[^a-z0-9]+', '', 'g') AS t FROM part), n AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS k FROM part)
SELECT p_partkey FROM n WHERE length(k) >= 4 AND NOT EXISTS (SELECT 1 FROM t WHERE length(t) >= 4 AND (contains(k, substr(t, 1, 4)) OR contains(substr(t, 1, 4), k)))""")
def name_containment_anti(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    tokens = part.select(F.substring(detect.collapsed_name(F.col("p_type")), 1, 4).alias("token")).distinct()
    return models.unknown_names(part.select("p_partkey", "p_name"), tokens, "p_name", "token").select("p_partkey")


@query("""WITH e AS (SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events)
SELECT event_id, k AS score, CASE WHEN k % 4 = 0 THEN 'possible' WHEN k >= 70 THEN 'strong' WHEN k >= 40 THEN 'possible' ELSE 'weak' END AS verdict, CASE WHEN k % 4 = 0 OR k >= 40 THEN 'NONE' WHEN k % 3 = 0 THEN 'LANGUAGE' ELSE 'OTHER' END AS category FROM e""")
def fit_judgments(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    raw = F.concat(F.lit('Here: {"fitScore": '), k.cast("string"), F.when(k % 4 == 0, ', "verdict": "possible"').otherwise(', "verdict": "?"'), F.when(k % 3 == 0, ', "category": "LANGUAGE"}').otherwise("}"), F.lit(" - bye"))
    return read(spark, sf_dir, "events").select("event_id", models.parse_fit(raw).alias("f")).select("event_id", "f.score", "f.verdict", "f.category")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part) SELECT p_name AS name, p_brand || ' — ' || p_type AS detail FROM r WHERE n = 1""")
def register_first_route(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("rating"), F.col("p_type").alias("route"))
    return registers.british_rows(rows, [F.col("p_partkey")])


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type NOT IN ('error') GROUP BY 1 HAVING min(ts) < TIMESTAMP '2024-01-20'")
def stalest_sources(spark, sf_dir):
    kept = read(spark, sf_dir, "events").where("event_type not in ('error')")
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first")).where(F.col("first") < F.lit("2024-01-20").cast("timestamp")).drop("first")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")  # a pattern: a stream takes no single file by name


def drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream gives once all its input is read, written to a folder of its own in the cluster's shared one."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("""WITH e AS (SELECT user_id::VARCHAR AS user_id, ts, event_type <> 'error' AS present FROM events), w AS (SELECT *, lag(present) OVER o AS before, coalesce(max(present::INT) OVER (PARTITION BY user_id ORDER BY ts, present ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ever FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts, present))
SELECT user_id, ts::VARCHAR AS at, CASE WHEN present AND ever = 0 THEN 'listed' WHEN present THEN 'relisted' ELSE 'delisted' END AS event FROM w WHERE (present AND NOT coalesce(before, false)) OR (NOT present AND before)""")
def stream_listing_events(spark, sf_dir):
    seen = _streamed(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("present"))
    return drained(spark, events.listing_events(seen, "user_id", "ts", "present")).select("user_id", F.col("at").cast("string").alias("at"), "event")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_merge_counts(spark, sf_dir):
    """Counts kept by merging each micro-batch into a versioned table."""
    folder = f"{shared_folder(spark)}/merge-{uuid.uuid4().hex}"
    keys = ["user_id", "event_type"]

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        events.merge_into(f"{folder}/t", merge)(batch.groupBy(*keys).agg(F.count("*").alias("n")), number)

    _streamed(spark, sf_dir).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/t/v={events.versions(spark, f'{folder}/t')[-1]}")


@query("SELECT s_nationkey, s_suppkey, place FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier WHERE s_acctbal >= 1000) WHERE place <= 3")
def detail_budget(spark, sf_dir):
    cards = read(spark, sf_dir, "supplier").where("s_acctbal >= 1000").select("s_nationkey", "s_suppkey", "s_acctbal")
    return relational.top_per_group(cards, ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], 3, "place").drop("s_acctbal")
