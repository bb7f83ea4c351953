"""A pipeline over ``documents``: each stage works on all that its predecessor kept.

Every stage takes the columns of ``documents`` and any others, whatever they
are named, and all but the last give back the same columns. An empty table
goes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, jaccard_join, line_dedup, packing, quality
from tessera.llm.common import cut, free, let_go
from tessera.llm.queries import table, vocabulary_path

#: The first stage learns from data and the last one packs tokens, so no SQL gives run()'s rows; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. The model learns from the labelled documents among the input."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    (score,) = free(docs.columns, "score__")
    return quality.score_quality(docs, model, column=score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; every document stays, and n_chars follows its text where it counted code points."""
    own = [c for c in docs.columns if c.lower() in ("n_lines", "n_dropped", "keep_bitmap")]
    aside = dict(zip(own, free([*docs.columns, "n_lines", "n_dropped", "keep_bitmap"], *own), strict=True))  # the operator's columns replace those
    kept = line_dedup.dedup_lines(docs.withColumnsRenamed(aside))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return kept.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of token sequences."""
    return packing.pack_documents(docs, vocabulary_path())


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is computed once, into the shared folder; its rows go when the next stage is done."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
            let_go(before)
    return docs
