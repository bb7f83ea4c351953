"""The registered queries of this subpackage, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, embedding_dedup, html_text, jaccard_join, line_dedup, packing, quality, sharding, toxicity, url_filter
from tessera.llm.common import crc_mod

VOCABULARY = "word_bpe_49k.json"
SHARDS = 16


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontamination.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "n_tokens", "covered", "coverage", F.size("tiles").cast("long").alias("n_tiles"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade(docs.select("doc_id", "text"), model).select("doc_id", "severity", "grade", "is_toxic")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages.select("page_id", "url", "html"), html_text.learn(pages)).select("page_id", "url", "text", "n_chars")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_mod("doc_id", quality.FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def queries() -> dict:
    import corpus_pipeline

    own = {f.__name__: f for f in (op1_embedding_dedup, op2_sharding, op3_packing, op4_decontamination, op5_url_filter, op6_jaccard_join, op7_toxicity, op8_line_dedup, op9_html_text, op10_quality)}
    return own | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": OP1, "op5_url_filter": OP5, "op6_jaccard_join": OP6, "op8_line_dedup": OP8}


OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND list_count(e) = len(e) AND len(list_filter(e, lambda x: NOT isfinite(x))) = 0
), ok AS (
  SELECT vec_id, e, norm FROM u WHERE norm > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), low AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
), n AS (
  SELECT x, count(*) AS n_links FROM links GROUP BY x
)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, low.component_id, e.vec_id = low.component_id AS kept
FROM embeddings e JOIN low ON low.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id
"""

OP5 = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rh, rp, rv) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT p.page_id, p.host, p.path, rh || rp AS rule, rv, length(rh || rp) AS n
  FROM parts p LEFT JOIN rules ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)
)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict
FROM fits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC NULLS LAST, rule) = 1
"""

OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
    ELSE array_to_string(words[i : i + 4], ' ') END AS shingle
  FROM w, LATERAL (SELECT unnest(range(1, greatest(2, len(words) - 3))) AS i) WHERE len(words) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM met JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * m >= 80 * (na.n + nb.n - m)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), low AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, low.component_id
FROM documents d JOIN low ON low.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP8 = r"""
WITH lines AS (
  SELECT doc_id, line, pos FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), keyed AS (
  SELECT doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), often AS (
  SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.doc_id, line, pos, often.k IS NOT NULL AND keyed.doc_id <> often.owner AS gone FROM keyed LEFT JOIN often ON often.k = keyed.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
