"""Dedupe, matching, merging and diffing as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def free(taken, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``taken`` has it, in any case of its letters."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; a null key is a key."""
    (rank,) = free(df.columns, "rank__")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, first).where(F.col(rank) == 1).drop(rank)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def union_by_priority(frames: list[DataFrame], priority: str = "source_prio") -> DataFrame:
    """All rows, with their source's place in the list."""
    out = None
    for i, df in enumerate(frames):
        df = df.withColumn(priority, F.lit(i))
        out = df if out is None else out.unionByName(df)
    return out


def two_key_match(left: DataFrame, right: DataFrame, first: str, second: str, key: str, found: str = "match") -> DataFrame:
    """``left`` with the smallest ``key`` of ``right`` that agrees on ``first``, or else on ``second``."""
    m1, m2 = free(left.columns, "m1__", "m2__")
    one = right.groupBy(first).agg(F.min(key).alias(m1))
    two = right.groupBy(second).agg(F.min(key).alias(m2))
    return left.join(one, first, "left").join(two, second, "left").withColumn(found, F.coalesce(m1, m2)).drop(m1, m2)


def flag_if_in(df: DataFrame, keys: DataFrame, on: list[str], flag: str) -> DataFrame:
    """``df`` with a boolean: whether its key is among ``keys``."""
    (mark,) = free(df.columns, flag + "__")
    marks = keys.select(*on).distinct().withColumn(mark, F.lit(True))
    return df.join(marks, on, "left").withColumn(flag, F.coalesce(mark, F.lit(False))).drop(mark)


def absent(stored: DataFrame, fetched: DataFrame, source: str, on: list[str]) -> DataFrame:
    """Stored rows that today's feed lacks, only for sources that returned anything."""
    return stored.join(fetched.select(source).distinct(), source, "left_semi").join(fetched.select(*on).distinct(), on, "left_anti")


def merge(stored: DataFrame, incoming: DataFrame, key: str, refreshed: list[str]) -> DataFrame:
    """Upsert: new keys come in whole, known keys take only the ``refreshed`` columns."""
    rest = [c for c in stored.columns if c != key]
    here, there, *fresh = free(stored.columns, "in__", "old__", *(f"{c}__new" for c in rest))
    named = dict(zip(rest, fresh, strict=True))
    new = incoming.select(F.col(key), *(F.col(c).alias(named[c]) for c in rest), F.lit(True).alias(here))
    both = stored.withColumn(there, F.lit(True)).join(new, key, "full_outer")
    take = lambda c: F.when(F.col(here).isNotNull() & (F.lit(c in refreshed) | F.col(there).isNull()), F.col(named[c])).otherwise(F.col(c)).alias(c)
    return both.select(key, *(take(c) for c in rest))


def replace_partitions(stored: DataFrame, incoming: DataFrame, part: str, least: int) -> DataFrame:
    """Parts of ``incoming`` with at least ``least`` rows replace the stored ones; all others stay."""
    ok = incoming.groupBy(part).count().where(F.col("count") >= least).select(part)
    return stored.join(ok, part, "left_anti").unionByName(incoming.join(ok, part, "left_semi").select(*stored.columns))


def transitions(df: DataFrame, key: str, run: str, present: str) -> DataFrame:
    """(key, run, event) where presence changes: listed, delisted, relisted."""
    order = Window.partitionBy(key).orderBy(run)
    ever = F.max(F.col(present).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    before = F.lag(present).over(order)
    event = F.when(F.col(present) & F.coalesce(ever, F.lit(0)).eqNullSafe(F.lit(0)), "listed").when(F.col(present) & ~before, "relisted").when(~F.col(present) & before, "delisted")
    return df.withColumn("event", event).where(F.col("event").isNotNull()).select(key, run, "event")


def presence_events(df: DataFrame, key: str, run: str, last: Column) -> DataFrame:
    """(key, run, event) where presence changes, from the runs in which a key was seen: listed, relisted after a gap, delisted in the run after its last sight.

    Runs are whole numbers up to ``last``; keys that are absent have no rows,
    so nothing is made for each key and run.
    """
    order = Window.partitionBy(key).orderBy(run)
    rows = df.select(key, run, last.alias("last__"), F.lag(run).over(order).alias("before__"), F.lead(run).over(order).alias("after__"))
    here = F.when(F.col("before__").isNull(), "listed").when(F.col(run) - F.col("before__") > 1, "relisted")
    gone = (F.col(run) < F.col("last__")) & (F.col("after__").isNull() | (F.col("after__") - F.col(run) > 1))
    changes = F.array_compact(F.array(F.when(here.isNotNull(), F.struct(F.col(run).alias("run"), here.alias("event"))), F.when(gone, F.struct((F.col(run) + 1).alias("run"), F.lit("delisted").alias("event")))))
    return rows.select(key, F.explode(changes).alias("c__")).select(key, F.col("c__.run").alias(run), "c__.event")


def latest(df: DataFrame, keys: list[str], order: list[str], value: list[str]) -> DataFrame:
    """The values of each key's last row in ``order``, in one aggregation."""
    last = F.max_by(F.struct(*value), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("v__")).select(*keys, *(F.col(f"v__.{c}").alias(c) for c in value))


def fold(df: DataFrame, key: str, order: list[str], value: str, start: Column, step, out: str) -> DataFrame:
    """An ordered fold over a key's rows. A key's rows meet in one array: for keys with bounded histories."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("value__"))))
    return df.groupBy(key).agg(F.aggregate(rows, start, lambda a, r: step(a, r["value__"])).alias(out))
