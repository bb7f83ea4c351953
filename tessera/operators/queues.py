"""Orders, pages and work queues over stored postings; every order ends in the id, so it is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import predicates
from tessera.functions.text import host_in, host_of, is_direct, source_trust
from tessera.operators.models import WALL_SITES
from tessera.operators.ranking import blend

PAGE, DISMISSED, AUTO_FIT, REVIEWS, REPORT = 30, 300, 25, 10, 10


def radar_order() -> list[Column]:
    """Judged ones first by their fit, then by trust in the source, keyword score and age."""
    return [F.desc_nulls_last("fit_score"), source_trust(F.col("source")).desc(), F.desc("score"), F.desc("created_at"), F.col("id")]


def page(df: DataFrame, order: list[Column], number: int, size: int = PAGE) -> DataFrame:
    """The rows of page ``number``, counted from 1; smaller numbers mean the first."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def last_page(df: DataFrame, size: int = PAGE) -> DataFrame:
    """One row: how many rows there are, and the last page's number, 1 at least."""
    return df.agg(F.count("*").alias("n")).select("n", F.greatest(F.lit(1), F.ceil(F.col("n") / size)).cast("long").alias("last_page"))


def starred(df: DataFrame) -> DataFrame:
    """Postings marked as interesting, live, no duplicates, qualified; best fit first, unjudged ones last."""
    kept = df.where(predicates._true((F.col("status") == "interested") & predicates.live() & F.col("duplicate_of").isNull() & ~F.col("disqualified")))
    return kept.orderBy(F.desc_nulls_last("fit_score"), F.desc("score"), "id")


def applications(df: DataFrame) -> DataFrame:
    """Applied postings in their five stages, in the order of the stages, the latest application first; ``stage`` numbers them from 0."""
    stage = F.array_position(F.array(*map(F.lit, predicates.STAGES)), F.col("status")).cast("int") - 1
    return df.where(F.col("status").isin(*predicates.STAGES)).withColumn("stage", stage).orderBy("stage", F.desc_nulls_last("applied_at"), "id")


def dismissed(df: DataFrame, most: int = DISMISSED) -> DataFrame:
    return df.where("status = 'ignored'").orderBy(F.desc("last_seen_at"), "id").limit(most)


def auto_fit(df: DataFrame, most: int = AUTO_FIT) -> DataFrame:
    """The best scored unjudged postings that are still open to a decision."""
    kept = df.where(predicates._true(F.col("fit_score").isNull() & F.col("status").isin(*predicates.OPEN) & F.col("duplicate_of").isNull() & ~F.col("disqualified")))
    return kept.orderBy(F.desc("score"), "id").limit(most)


def fill_queue(df: DataFrame, budget: int, description: str = "description") -> DataFrame:
    """Postings whose description is to be fetched: registered sponsors first, then by score and last sight; the budget counts attempts."""
    kept = df.where(predicates.fills_later() & predicates.title_only(F.col("title"), F.col(description)))
    return kept.orderBy(F.desc("sponsor_reg"), F.desc("score"), F.desc("last_seen_at"), "id").limit(budget)


def sweep_queue(df: DataFrame, now: Column, budget: int) -> DataFrame:
    """Aggregators' live postings unseen for long, stalest first: of the first two budgets those outside of walls, one budget of them."""
    old = predicates._true(predicates.live() & ~is_direct(F.col("source")) & (predicates.days_between(now, F.col("last_seen_at")) > predicates.SWEEP_DAYS))
    order = [F.col("last_seen_at"), F.col("id")]
    head = df.where(old).orderBy(*order).limit(2 * budget)
    return head.where(predicates._true((F.col("url") != "") & ~host_in(host_of(F.col("url")), WALL_SITES))).orderBy(*order).limit(budget)


def next_keys(df: DataFrame, phase: int, after: int | str | None, n: int) -> DataFrame:
    """A page by key: rows of a phase (0 qualified, 1 disqualified) after the last key, in order of the key."""
    rows = df.where(F.col("disqualified") == F.lit(phase == 1))
    return (rows if after is None else rows.where(F.col("id") > F.lit(after))).orderBy("id").limit(n)


def embed_queue(df: DataFrame, vectors: DataFrame) -> DataFrame:
    """Live postings without a vector, the qualified first, with their phase. vectors: id."""
    return df.where(predicates.live() & F.col("duplicate_of").isNull()).join(vectors.select("id").distinct(), "id", "left_anti").withColumn("phase", F.col("disqualified").cast("int")).orderBy("phase", "id")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """All rows in an order that only the seed and the keys decide."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def review_batch(df: DataFrame, most: int = REVIEWS) -> DataFrame:
    return df.where(predicates.awaits_review()).orderBy(F.desc("fit_score"), F.desc("score"), "id").limit(most)


def report(df: DataFrame, most: int = REPORT) -> DataFrame:
    return df.orderBy(F.desc("score"), "id").limit(most)


def stalest_boards(boards: DataFrame, fetched, curated: DataFrame, now: Column, most: int) -> DataFrame:
    """Active boards of fetched platforms, not curated and due, never fetched ones first. curated: platform, token."""
    keys = curated.select("platform", F.lower("token").alias("key__")).distinct()
    open_ = boards.where(predicates._true((F.col("status") == "active") & F.col("platform").isin(list(fetched)))).withColumn("key__", F.lower("token")).join(keys, ["platform", "key__"], "left_anti").drop("key__")
    return open_.where(predicates.is_due(now)).orderBy(F.asc_nulls_first("last_fetched_at"), "platform", "token", "region").limit(most)


def tiered_blend(df: DataFrame, tier: str, score: str, sim: str, ident: str, weight: float = 0.4) -> DataFrame:
    """``df`` with kw_rank, sim_rank and blended, ranked within each tier (true and false) by itself; order by the tier, then ``blended``."""
    flag = F.coalesce(F.col(tier), F.lit(False))
    return blend(df.where(flag), score, sim, ident, weight).unionByName(blend(df.where(~flag), score, sim, ident, weight))
