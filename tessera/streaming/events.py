"""Keyed state over streams: listing events, user status, cadence, and dedupe across runs.

State of one key is a few values, so it never grows with the stream. Every
function also takes a batch DataFrame's rows through ``foreachBatch``; the
state survives in the query's checkpoint folder, which must be shared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLLOW_UP_DAYS = 10
FAILED_SHARE = 0.9
_STATUS = "status string, applied_at timestamp, follow_up_at timestamp, reason string"


def _stateful(df: DataFrame, key: str, kind: str, out: str, state: str, step: Callable[[pd.DataFrame, tuple | None], tuple[list[tuple], tuple]]) -> DataFrame:
    """One call of ``step`` a key and micro-batch: (rows, state or None) to (output tuples, new state)."""
    names = [c.split()[0] for c in out.split(", ")]

    def run(keys, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        found, new = step(pd.concat(frames) if frames else pd.DataFrame(), held.get if held.exists else None)
        held.update(new)
        yield pd.DataFrame([(keys[0], *row) for row in found], columns=[key, *names])

    return df.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {out}", state, "append", "NoTimeout")


def _in_time(rows: pd.DataFrame, at: str, *columns: str):
    """The rows by time, those of one time in the order of their values; rows without a time are passed over."""
    if not len(rows):
        return []
    kept = rows[rows[at].notna()].sort_values([at, *columns], kind="stable")
    return list(zip(kept[at], *(kept[c] for c in columns), strict=True))


def listing_events(df: DataFrame, key: str, at: str, present: str) -> DataFrame:
    """(key, at, event) where a posting's presence changes: listed, delisted, relisted. The key is text."""

    def step(rows: pd.DataFrame, held):
        was, found = (held[0] if held else None), []
        for when, now in _in_time(rows, at, present):
            if now and was != "in":
                found.append((when, "listed" if was is None else "relisted"))
                was = "in"
            elif not now and was == "in":
                found.append((when, "delisted"))
                was = "out"
        return found, (was,)

    return _stateful(df.select(F.col(key).cast("string").alias(key), at, present), key, "string", "at timestamp, event string", "was string", step)


def status_after(held: tuple | None, at: pd.Timestamp, to: str, reason: str | None) -> tuple:
    """(status, applied_at, follow_up_at, reason) after one action.

    The first application stamps its time and a follow-up in ten days; an end
    state clears the follow-up; a reason belongs to ignored ones alone.
    """
    _, applied, follow, _ = held or ("new", None, None, None)
    if to == "applied" and applied is None:
        applied, follow = at, at + pd.Timedelta(days=FOLLOW_UP_DAYS)
    if to in ("rejected", "ghosted", "offer"):
        follow = None
    return to, applied, follow, (reason or None) if to == "ignored" else None


def status_log(df: DataFrame, key: str, at: str, to: str, reason: str) -> DataFrame:
    """One row an action with the state it leads to, in order of time within each micro-batch."""

    def step(rows: pd.DataFrame, held):
        found = []
        for when, status, why in _in_time(rows, at, to, reason):
            held = status_after(held, when, status, why if isinstance(why, str) else None)
            found.append((when, *held))
        return found, tuple(held)

    return _stateful(df.select(F.col(key).cast("string").alias(key), at, to, reason), key, "string", f"at timestamp, {_STATUS}", _STATUS, step)


def cadence(df: DataFrame, key: str, at: str, rate: str) -> DataFrame:
    """(key, at, interval_days, hit_rate) after each fetch of a board: daily after a hit, else twice as long up to 30 days; rates decay by 0.7."""

    def step(rows: pd.DataFrame, held):
        interval, hit_rate = held or (1, 0.5)
        found = []
        for when, share in _in_time(rows, at, rate):
            interval = 1 if share > 0 else min(30, max(2, interval * 2))
            hit_rate = int((hit_rate * 0.7 + share * 0.3) * 1000 + 0.5) / 1000
            found.append((when, interval, hit_rate))
        return found, (interval, hit_rate)

    return _stateful(df.select(F.col(key).cast("string").alias(key), at, rate), key, "string", "at timestamp, interval_days int, hit_rate double", "interval_days int, hit_rate double", step)


def first_seen(df: DataFrame, keys: list[str], at: str, horizon: str) -> DataFrame:
    """Each key's first row within ``horizon``; the state of older keys is let go."""
    return df.withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


def windowed_counts(df: DataFrame, at: str, keys: list[str], size: str, late: str) -> DataFrame:
    return df.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def merge_into(path: str, merge: Callable[[DataFrame, DataFrame], DataFrame], ok: str = "true", keep: int | None = 3) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer: each batch's merge with the last version is the next version under ``path``.

    A version is named after its batch and written whole, so a repeated batch
    writes the same again; the last ``keep`` versions stay. Rows that break
    ``ok`` are not merged but kept under ``path``/failed, a folder a batch, to
    be tried again (retries()). A batch where FAILED_SHARE or more of the rows
    break it is taken for an outage: none of its rows is merged, all are kept.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            good = F.coalesce(F.expr(ok), F.lit(False))
            n, fine = batch.agg(F.count("*"), F.count_if(good)).first()
            outage = n > 0 and (n - fine) / n >= FAILED_SHARE
            failed = batch if outage else batch.where(~good)
            if n > fine:
                failed.write.mode("overwrite").parquet(f"{path}/failed/b={number}")
            if n == 0 or outage:
                return
            known = [v for v in versions(spark, path) if v < number]
            out = merge(spark.read.parquet(f"{path}/v={known[-1]}"), batch.where(good)) if known else batch.where(good)
            out.write.mode("overwrite").parquet(f"{path}/v={number}")
            for old in known[: 1 - keep] if keep and keep > 1 else ():
                _remove(spark, f"{path}/v={old}")
        finally:
            batch.unpersist()

    return write


def retries(spark, path: str) -> DataFrame | None:
    """The rows that batches kept for a retry, with their batch; None where there are none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/failed")
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.parquet(f"{path}/failed").withColumnRenamed("b", "batch") if there else None


def _remove(spark, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def versions(spark, path: str) -> list[int]:
    """The written versions under ``path``, oldest first; a version without its success mark doesn't count."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder)]
    done = [p.getName() for p in names if p.getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n[2:]) for n in done)
