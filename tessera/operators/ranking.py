"""Global ranks, rank blending and offline ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.checkpoints import checkpointed

ROW_BITS = (1 << 33) - 1


def global_rank(df: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """``df`` with each row's 0-based place in ``order`` (a total order).

    Sorted by ranges, counted by partition; only one count a partition comes
    to the driver, so no task sorts all rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("id__", F.monotonically_increasing_id())
    rows = checkpointed(rows).withColumn("part__", F.shiftright("id__", 33).cast("int"))
    counts, firsts = {r["part__"]: r["count"] for r in rows.groupBy("part__").count().collect()}, []
    for p in range(max(counts, default=-1) + 1):
        firsts.append(firsts[-1] + counts.get(p - 1, 0) if p else 0)
    first = F.element_at(F.array(*(F.lit(n).cast("long") for n in firsts or [0])), F.col("part__") + 1)
    return rows.withColumn(rank, first + F.col("id__").bitwiseAND(F.lit(ROW_BITS))).drop("id__", "part__")


def blend(df: DataFrame, score: str, sim: str, ident: str, weight: float = 0.4, out: str = "blended") -> DataFrame:
    """``df`` with kw_rank, sim_rank and their weighted sum.

    Ranks by similarity go over rows that have one, stretched to the full
    range; rows without take their keyword rank.
    """
    ranked = global_rank(df, [F.col(score).desc(), F.col(ident)], "kw_rank")
    n, k = ranked.agg(F.count("*"), F.count(sim)).first()
    known = global_rank(ranked.where(F.col(sim).isNotNull()), [F.col(sim).desc(), F.col("kw_rank")], "place__")
    scale = (n - 1) / (k - 1) if k > 1 else 1.0
    known = known.withColumn("sim_rank", F.col("place__") * F.lit(float(scale))).drop("place__")
    rest = ranked.where(F.col(sim).isNull()).withColumn("sim_rank", F.col("kw_rank").cast("double"))
    return known.unionByName(rest).withColumn(out, F.col("kw_rank") * F.lit(weight) + F.col("sim_rank") * F.lit(1 - weight))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def precision_at(df: DataFrame, order: list[Column], good: Column, k: int = 100) -> DataFrame:
    top = df.withColumn("good__", good.cast("double")).orderBy(*order).limit(k)
    return top.agg(F.round(F.avg("good__"), 6).alias("precision_at_k"))


def average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """1-based ranks, ties at their mean; rows are placed by ranges, so no task holds all values."""
    placed = global_rank(df.select(column), [F.col(column)], "place__")
    means = placed.groupBy(column).agg((F.avg("place__") + 1).alias(out))
    return df.join(means, column)


def gem_recall(df: DataFrame, order: list[Column], gem: Column, share: float = 0.2) -> DataFrame:
    """One row, gem_recall: how many of the gems stand in the first ``share`` of the rows; 0 without gems."""
    ranked = global_rank(df.withColumn("gem__", F.coalesce(gem, F.lit(False))), order, "place__")
    size = ranked.agg(F.count("*").alias("n__"))
    hits = ranked.join(F.broadcast(size)).agg(F.count_if(F.col("gem__") & (F.col("place__") < F.ceil(F.col("n__") * share))).alias("hit"), F.count_if("gem__").alias("all"))
    return hits.select(F.coalesce(F.col("hit") / F.nullif("all", F.lit(0)), F.lit(0.0)).alias("gem_recall"))
