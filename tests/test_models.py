import datetime as dt
import sys

import pytest
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from tessera.operators import models
from tessera.streaming import events

register_pickle_by_value(sys.modules[__name__])


def upper():
    return lambda texts: [t.upper() for t in texts]


def limited():
    def go(texts):
        raise models.RateLimited

    return go


def broken():
    def go(texts):
        raise OSError

    return go


def short():
    return lambda texts: texts[:-1]


def test_ask(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "i int, p string")
    assert sorted((r["i"], r["answer"]) for r in models.ask(df, "p", upper, batch=2).collect()) == [(1, "A"), (2, None), (3, "C")]
    with pytest.raises(Exception, match="answers to"):
        models.ask(df, "p", short).collect()
    assert models.chain(limited, broken, upper)()(["x"]) == ["X"] and models.chain(broken)()(["x"]) == [None]
    with pytest.raises(models.RateLimited):
        models.chain(limited, limited)()(["x"])


def test_chain_hands_on_what_is_open():
    calls = []

    def half():
        return lambda texts: calls.append(("half", len(texts))) or [t if t < "c" else None for t in texts]

    def rest():
        return lambda texts: calls.append(("rest", len(texts))) or [t.upper() for t in texts]

    def broke():
        def go(texts):
            calls.append(("broke", len(texts)))
            raise models.OutOfCredit

        return go

    client = models.chain(broke, half, rest)()
    assert client(["a", "c", "d"]) == ["a", "C", "D"] and client(["a"]) == ["a"]
    assert calls == [("broke", 3), ("half", 3), ("rest", 2), ("half", 1)]
    with pytest.raises(KeyError):  # a fault of the program is no provider's fault
        models.chain(lambda: lambda texts: {}["x"], rest)()(["a"])
    assert models.tiers(half, rest)["strong"]()(["c"]) == ["C"]


def test_parsers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    fit = lambda s: one(models.parse_fit(F.lit(s).cast("string")))
    got = fit('so: {"fitScore": 140.2, "verdict": "great", "category": "LANGUAGE", "ghostRisk": true, "seniorityLevel": "senior"}')
    assert (got["score"], got["verdict"], got["category"], got["ghost_risk"], got["level"]) == (100, "strong", "NONE", True, "senior")
    assert tuple(fit('{"fitScore": 12, "category": "??"}')) == (12, "weak", "OTHER", "", False, None)
    assert tuple(fit("no idea")) == (0, "weak", "OTHER", "no idea", False, None) and fit(None)["verdict"] == "weak"
    assert one(models.parse_candidates(F.lit('{"candidates": [3, 1, 1, 9, "x"]}'), F.lit(3))) == [2, 0]
    assert one(models.parse_candidates(F.lit("none"), F.lit(3))) == []
    assert one(models.parse_same_role(F.lit('{"sameRole": true}'))) is True and one(models.parse_same_role(F.lit("yes"))) is False
    assert one(models.parse_countries(F.lit('{"answers": {"1": "DE", "2": "zz"}}'), F.lit(3), ["de"])) == ["de", None, None]
    assert one(models.same_role(F.lit("Dev Ops (m/f)"), F.lit("dev ops"))) and not one(models.same_role(F.lit(""), F.lit("")))
    assert one(models.normalized(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8] and one(models.normalized(F.array(F.lit(0.0)))) == [0.0]


def pages():
    known = {"https://ex.org/a": "see https://jobs.lever.co/acme", "https://ex.org/b": None, "lever/acme": "Acme Inc", "greenhouse/acme": "Other"}
    return lambda texts: [known.get(t) for t in texts]


def test_funnels(spark):
    rows = spark.createDataFrame([(1, "https://ex.org/a"), (2, "https://boards.greenhouse.io/foo"), (3, "https://www.linkedin.com/x"), (4, "https://ex.org/b"), (5, None)], "i int, u string")
    assert sorted(map(tuple, models.harvest(rows, "i", "u", pages).collect())) == [("greenhouse", "foo", ""), ("lever", "acme", "")]
    names = spark.createDataFrame([("Acme",), ("EY",)], "n string")
    assert [tuple(r) for r in models.probe_names(names, "n", ["greenhouse", "lever"], pages).collect()] == [("Acme", "lever", "acme")]
    boards = spark.createDataFrame([("acmegames",), ("inc",), ("lego",)], "t string")
    names = spark.createDataFrame([("Acme",), ("Lego Toys",), ("Brand New",), ("EY",)], "n string")
    assert [r["n"] for r in models.unknown_names(names, boards, "n", "t").collect()] == ["Brand New"]
    day = lambda d: dt.datetime(2024, 1, d)
    stored = spark.createDataFrame([(i, "Acme", day(i), None) for i in range(1, 20)] + [(99, "Acme", day(30), 1)], "i int, c string, s timestamp, duplicate_of int")
    got = sorted((r["place"], r["candidate"]) for r in models.duplicate_candidates(stored.where("i = 19"), stored, "i", "c", "s").collect())
    assert got == [(k + 1, 18 - k) for k in range(12)]


def test_status(spark):
    import pandas as pd

    at = pd.Timestamp("2024-01-01")
    applied = events.status_after(None, at, "applied", None)
    assert applied == ("applied", at, at + pd.Timedelta(days=10), None)
    again = events.status_after(applied, at + pd.Timedelta(days=3), "applied", None)
    assert again[1:3] == applied[1:3]
    assert events.status_after(again, at, "ignored", "salary")[3] == "salary" and events.status_after(again, at, "offer", "x") == ("offer", at, None, None)


def _drain(spark, stream, tmp_path, name):
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.read.schema(stream.schema).parquet(str(tmp_path / name))


def test_streams_keep_state_over_runs(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "k string, at timestamp, present boolean, rate double, to string, why string"
    day = lambda d: dt.datetime(2024, 1, d)
    def append(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
    def run(make, name):
        return _drain(spark, make(spark.readStream.schema(schema).parquet(source)), tmp_path, name)
    append(("a", day(1), True, 0.0, "applied", None), ("b", day(1), False, 1.0, "ignored", "far"))
    listing = lambda df: events.listing_events(df, "k", "at", "present")
    status = lambda df: events.status_log(df, "k", "at", "to", "why")
    pace = lambda df: events.cadence(df, "k", "at", "rate")
    for make, name in ((listing, "l"), (status, "s"), (pace, "p")):
        run(make, name)
    append(("a", day(2), False, 0.0, "offer", None), ("a", day(3), True, 0.5, "offer", None), ("b", day(2), True, 0.0, "new", "x"))
    got = sorted((r["k"], r["at"].day, r["event"]) for r in run(listing, "l").collect())
    assert got == [("a", 1, "listed"), ("a", 2, "delisted"), ("a", 3, "relisted"), ("b", 2, "listed")]
    states = {(r["k"], r["at"].day): (r["status"], r["applied_at"], r["follow_up_at"], r["reason"]) for r in run(status, "s").collect()}
    assert states["a", 1] == ("applied", day(1), day(11), None) and states["a", 3] == ("offer", day(1), None, None)
    assert states["b", 1] == ("ignored", None, None, "far") and states["b", 2] == ("new", None, None, None)
    paces = {(r["k"], r["at"].day): (r["interval_days"], r["hit_rate"]) for r in run(pace, "p").collect()}
    assert paces == {("a", 1): (2, 0.35), ("a", 2): (4, 0.245), ("a", 3): (1, 0.322), ("b", 1): (1, 0.65), ("b", 2): (2, 0.455)}


def test_merge_into(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, v int"
    write = events.merge_into(path, lambda old, new: old.join(new, "k", "left_anti").unionByName(new), "v >= 0")
    write(spark.createDataFrame([(1, 1), (2, 2)], schema), 0)
    write(spark.createDataFrame([(2, 5), (3, -1)], schema), 1)
    write(spark.createDataFrame([(2, 5), (3, -1)], schema), 1)
    write(spark.createDataFrame([(9, -1)], schema), 2)  # all failed: an outage
    write(spark.createDataFrame([], schema), 3)
    kept = sorted(map(tuple, events.retries(spark, path).select("k", "v", "batch").collect()))
    assert kept == [(3, -1, 1), (9, -1, 2)]  # to be tried again
    assert events.versions(spark, path) == [0, 1] and sorted(map(tuple, spark.read.parquet(f"{path}/v=1").collect())) == [(1, 1), (2, 5)]
