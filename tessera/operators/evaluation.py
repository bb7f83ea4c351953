"""Offline metrics of rankings, by configuration and slice, without a task that sorts all rows.

``rows`` have config, id, sim (the ranking's value) and fit, and whatever
columns the slices' conditions read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import global_rank

GOOD, GEM, SHARE, TOP = 70, 80, 0.2, 100
BY = ["config", "slice"]
#: Signs of a title that is not English.
NOT_ENGLISH = "(?iu)[äöüßàâçéèêëîïñóôûåøæłśżčğışİ]|entwickler|ontwikkelaar|développeur|desarrollador|programista|sviluppatore|utvecklare|ingenieur|udvikler"


def sliced(rows: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """A row for each slice that a row belongs to."""
    names = F.array_compact(F.array(*(F.when(F.coalesce(condition, F.lit(False)), F.lit(name)) for name, condition in slices.items())))
    return rows.withColumn("slice", F.explode(names))


def grouped_rank(rows: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    """``rows`` with the 0-based place within each group: the place among all rows less that of the group's first."""
    ranked = global_rank(rows, [*(F.col(c) for c in by), *order], out)
    firsts = ranked.groupBy(*by).agg(F.min(out).alias("first__"))
    return ranked.join(F.broadcast(firsts), by).withColumn(out, F.col(out) - F.col("first__")).drop("first__")


def average_ranks(rows: DataFrame, by: list[str], column: str, out: str) -> DataFrame:
    """``rows`` with 1-based ranks within each group, ties at their mean."""
    counts = rows.groupBy(*by, column).agg(F.count("*").alias("n__"))
    ranked = grouped_rank(rows.select(*by, column), by, [F.col(column)], "place__")
    means = ranked.groupBy(*by, column).agg((F.avg("place__") + 1).alias(out))
    return rows.join(means.join(counts, [*by, column]).drop("n__"), [*by, column])


def metrics(rows: DataFrame) -> DataFrame:
    """(config, slice, n, p100, gem_recall, rho) of sliced rows.

    p100: share of fit 70 or more among the first 100. gem_recall: share of
    fit 80 or more that stands in the first fifth, 0 without any. rho:
    Spearman's, 0 where one side has one value only.
    """
    ranked = grouped_rank(rows, BY, [F.desc("sim"), F.col("id")], "place__")
    size = ranked.groupBy(*BY).agg(F.count("*").alias("n"))
    good, gem = F.col("fit") >= GOOD, F.col("fit") >= GEM
    fifth = F.ceil(F.col("n") * SHARE)
    tops = ranked.join(F.broadcast(size), BY).groupBy(*BY, "n").agg(
        (F.count_if(good & (F.col("place__") < TOP)) / F.least(F.lit(TOP), F.col("n"))).alias("p100"),
        F.coalesce(F.count_if(gem & (F.col("place__") < fifth)) / F.nullif(F.count_if(gem), F.lit(0)), F.lit(0.0)).alias("gem_recall"),
    )
    both = average_ranks(average_ranks(rows.select(*BY, "sim", "fit"), BY, "sim", "a__"), BY, "fit", "b__")
    rho = both.groupBy(*BY).agg(F.coalesce(F.nanvl(F.corr("a__", "b__"), F.lit(0.0)), F.lit(0.0)).alias("rho"))
    return tops.join(rho, BY)


def with_baseline(rows: DataFrame, keyword: str = "keyword") -> DataFrame:
    """``rows`` and, as one more configuration, each posting once ranked by its keyword score."""
    once = rows.dropDuplicates(["id"])
    return rows.unionByName(once.withColumns({"config": F.lit("KEYWORD-BASELINE"), "sim": F.col(keyword).cast("double")}))


def ranked_configs(found: DataFrame, slices=("tune", "confirm", "gold", "nonEN")) -> DataFrame:
    """A row a configuration, the best on the tuning slice first: p100 of each slice, rho and gem_recall of the confirming one."""
    wide = found.groupBy("config").pivot("slice", list(slices)).agg(F.first("p100").alias("p100"), F.first("rho").alias("rho"), F.first("gem_recall").alias("gem_recall"))
    out = wide.select("config", *(F.col(f"{s}_p100").alias(f"{s}_p100") for s in slices), F.col("confirm_rho").alias("confirm_rho"), F.col("confirm_gem_recall").alias("confirm_gem_recall"))
    return out.orderBy(F.desc_nulls_last("tune_p100"), "config")
