"""Injected models and clients over batches of rows.

A client is any picklable factory: it is called once a partition and gives a
function from a list of inputs to a list of answers (text, or None where it
failed). Nothing here talks to a network by itself.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import detect, slugs
from tessera.functions.text import host_in, host_of, let, model_json, norm
from tessera.operators.relational import top_per_group

Answers = Callable[[list[str]], list[str | None]]
FIT_SCHEMA = "fitScore string, verdict string, category string, comment string, ghostRisk boolean, seniorityLevel string"
#: What a judgment may say.
VERDICTS, CATEGORIES = ("strong", "possible", "weak"), ("NONE", "NO_VISA", "LANGUAGE", "PROFILE", "SENIORITY", "OTHER")
LEVELS = ("intern", "junior", "mid", "senior", "staff", "management", "unknown")
#: Sites that are never a posting's own page, and sites that let no visitor in.
JUNK_SITES = ("whatjobs.com", "mysmartpros.com", "jobtome.com", "learn4good.com", "bebee.com", "jooble.org", "talent.com", "expertini.com", "jobrapido.com", "upwork.com")
WALL_SITES = ("linkedin.com", "indeed.com", "glassdoor.com", "glassdoor.co.uk", "ziprecruiter.com")
CANDIDATES, EMBED_CHARS = 12, 1500


class RateLimited(Exception):
    """A provider that asks to be left alone for now."""


class OutOfCredit(Exception):
    """A provider that answers nothing more until it is paid; a task doesn't ask it again."""


#: What a provider may fail with; any other exception is a fault of the program and goes out.
FAULTS = (OSError, TimeoutError, ConnectionError)


def chain(*providers: Callable[[], Answers]) -> Callable[[], Answers]:
    """A factory that hands a whole batch to the providers in order, each the inputs that are still open.

    RateLimited goes out only if every provider asked raised it; other faults
    leave the inputs to the next provider, and None where none is left.
    """

    def make() -> Answers:
        ready = [p() for p in providers]

        def answer(texts: list[str]) -> list[str | None]:
            out: list[str | None] = [None] * len(texts)
            open_, asked, limited = list(range(len(texts))), 0, 0
            for client in list(ready):
                if not open_:
                    break
                asked += 1
                try:
                    got = client([texts[i] for i in open_])
                except RateLimited:
                    limited += 1
                    continue
                except OutOfCredit:
                    ready.remove(client)
                    continue
                except FAULTS:
                    continue
                for i, value in zip(open_, got, strict=True):
                    out[i] = value
                open_ = [i for i in open_ if out[i] is None]
            if asked and limited == asked:
                raise RateLimited
            return out

        return answer

    return make


def tiers(fast: Callable[[], Answers], strong: Callable[[], Answers]) -> dict[str, Callable[[], Answers]]:
    """Both tiers by name; either falls back on the other one."""
    return {"fast": chain(fast, strong), "strong": chain(strong, fast)}


def ask(df: DataFrame, prompt: str, factory: Callable[[], Answers], answer: str = "answer", batch: int = 256) -> DataFrame:
    """``df`` with the client's answers to ``prompt``, in batches; a null prompt isn't asked."""
    schema = df.withColumn(answer, F.lit(None).cast("string")).schema

    def run(frames):
        client = factory()
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch].copy()
                asked = part[prompt].notna()
                texts = part.loc[asked, prompt].tolist()
                got = client(texts) if texts else []
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} answers to {len(texts)} prompts")
                part[answer] = pd.Series([None] * len(part), index=part.index, dtype="object")
                part.loc[asked, answer] = pd.Series(got, index=part.index[asked], dtype="object")
                yield part

    return df.mapInPandas(run, schema)


def parse_fit(raw: Column) -> Column:
    """struct<score, verdict, category, comment, ghost_risk, level> of a judgment.

    The score goes from 0 to 100, an unknown verdict falls back on it (70, 40),
    only weak ones have a category, an unknown level is null. An answer without
    JSON is weak and carries its own head as the comment.
    """
    def fields(x: Column) -> Column:
        j, whole = x["j"], x["raw"]
        score = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.coalesce(j["fitScore"].try_cast("double"), F.lit(0.0)) + 0.5))).cast("int")
        verdict = F.when(j["verdict"].isin(*VERDICTS), j["verdict"]).when(score >= 70, "strong").when(score >= 40, "possible").otherwise("weak")
        category = F.when(verdict != "weak", "NONE").when(j["category"].isin(*CATEGORIES), j["category"]).otherwise("OTHER")
        comment = F.when(x["readable"], F.substring(F.coalesce(j["comment"], F.lit("")), 1, 600)).otherwise(F.substring(F.coalesce(whole, F.lit("")), 1, 300))
        level = F.when(j["seniorityLevel"].isin(*LEVELS), j["seniorityLevel"])
        return F.struct(score.alias("score"), verdict.alias("verdict"), category.alias("category"), comment.alias("comment"), F.coalesce(j["ghostRisk"], F.lit(False)).alias("ghost_risk"), level.alias("level"))

    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    found = lambda b: F.struct(F.when(b != "", F.from_json(b, FIT_SCHEMA)).alias("j"), F.coalesce(F.get_json_object(b, "$").isNotNull(), F.lit(False)).alias("readable"), raw.alias("raw"))
    return let(let(braces, found), fields)


def parse_candidates(raw: Column, n: Column) -> Column:
    """The distinct places, counted from 0, of the numbers from 1 to n that an answer's ``candidates`` lists."""
    found = F.transform(model_json(raw, "candidates array<string>")["candidates"], lambda v: F.floor(v.try_cast("double") + 0.5).cast("int"))
    inside = F.filter(found, lambda i: (i >= 1) & (i <= n))
    return F.coalesce(F.array_distinct(F.transform(inside, lambda i: i - 1)), F.array().cast("array<int>"))


def parse_same_role(raw: Column) -> Column:
    return F.coalesce(model_json(raw, "sameRole boolean")["sameRole"], F.lit(False))


def parse_countries(raw: Column, n: Column, codes) -> Column:
    """The n country codes of an answer's numbered ``answers``; null where it gives none of ``codes``."""
    answers = model_json(raw, "answers map<string,string>")["answers"]
    code = lambda i: F.lower(F.try_element_at(answers, i.cast("string")))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.when(code(i).isin(list(codes)), code(i)))).otherwise(F.array().cast("array<string>"))


def embed_text(title: Column, description: Column) -> Column:
    """The title, and the description's head where that says more than the title."""
    return F.when(F.length(description) > F.length(title) + 20, F.concat(title, F.lit("\n"), F.substring(description, 1, EMBED_CHARS))).otherwise(title)


def normalized(vector: Column) -> Column:
    """A vector of length one; the zero vector stays."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when(size == 0, F.transform(vector, lambda v: v.cast("double"))).otherwise(F.transform(vector, lambda v: v.cast("double") / size))


def best_similarity(df: DataFrame, vector: str, queries: list[list[float]], out: str = "sim") -> DataFrame:
    """The greatest dot product with one of a few stated query vectors."""
    dots = [F.aggregate(F.zip_with(vector, F.array(*map(F.lit, q)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for q in queries]
    return df.withColumn(out, F.array_max(F.array(*dots)))


def embed(df: DataFrame, text: str, factory, vector: str = "vector", batch: int = 256) -> DataFrame:
    """``df`` with the model's normalised vectors of ``text``, in batches; a null text has none. An answer of another length than its batch is a fault."""
    schema = df.withColumn(vector, F.lit(None).cast("array<double>")).schema

    def run(frames):
        client = factory()
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch].copy()
                asked = part[text].notna()
                texts = part.loc[asked, text].tolist()
                got = client(texts) if texts else []
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} vectors of {len(texts)} texts")
                part[vector] = pd.Series([None] * len(part), index=part.index, dtype="object")
                part.loc[asked, vector] = pd.Series([list(map(float, v)) for v in got], index=part.index[asked], dtype="object")
                yield part

    return df.mapInPandas(run, schema).withColumn(vector, normalized(F.col(vector)))


def duplicate_candidates(new: DataFrame, stored: DataFrame, ident: str, company: str, seen: str, most: int = CANDIDATES) -> DataFrame:
    """(ident, candidate, place): up to ``most`` stored rows of the same company for each new row, latest first."""
    left = new.select(F.col(ident), norm(F.col(company)).alias("k__"))
    right = stored.where("duplicate_of is null").select(F.col(ident).alias("candidate"), norm(F.col(company)).alias("k__"), F.col(seen).alias("seen__"))
    # one company may hold many rows: its latest ones are found before the join
    right = top_per_group(right, ["k__"], [F.desc("seen__"), F.col("candidate")], most + 1, "r__").drop("r__")
    pairs = left.where("k__ <> ''").join(right, "k__").where(F.col(ident) != F.col("candidate"))
    return top_per_group(pairs, [ident], [F.desc("seen__"), F.col("candidate")], most, "place").select(ident, "candidate", "place")


def same_role(a: Column, b: Column, least: float = 0.8) -> Column:
    """Whether two titles share most of their words; stands in for a model where there is none."""
    x, y = (F.array_distinct(F.filter(F.split(norm(c), " "), lambda w: w != "")) for c in (a, b))
    both = F.size(F.array_union(x, y))
    return (both > 0) & (F.size(F.array_intersect(x, y)) >= least * both)


def resolvable(url: Column) -> Column:
    host = host_of(url)
    return host.isNotNull() & ~host_in(host, (*JUNK_SITES, *WALL_SITES))


def harvest(df: DataFrame, ident: str, url: str, fetch: Callable[[], Answers]) -> DataFrame:
    """Boards behind postings: those a URL names, and for the other resolvable ones those their pages name, each board once."""
    direct = df.select(ident, slugs.board_of(F.col(url)).alias("h"), F.col(url).alias("u__"))
    pages = ask(direct.where(F.col("h").isNull() & resolvable(F.col("u__"))).select(ident, "u__"), "u__", fetch, "body__")
    found = direct.where("h is not null").select("h.platform", "h.token", "h.region").unionByName(slugs.scan(pages, ident, "body__").where("platform is not null").select("platform", "token", "region"))
    return found.distinct()


def sweep(df: DataFrame, url: str, fetch: Callable[[], Answers]) -> DataFrame:
    """``df`` with ``liveness``; the client answers ``status`` and page as ``200\\npage``."""
    asked = ask(df, url, fetch, "page__")
    status = F.substring_index("page__", "\n", 1).try_cast("int")
    body = F.regexp_replace("page__", r"(?s)^[^\n]*\n?", "")
    return asked.withColumn("liveness", detect.liveness(status, body)).drop("page__")


def probe_names(names: DataFrame, name: str, platforms: list[str], fetch: Callable[[], Answers]) -> DataFrame:
    """The first board a company answers to, in the order of ``platforms`` and of its likely slugs, by its own name.

    The client gets ``platform/slug`` and answers the board's company name, or None.
    """
    tries = names.select(name, F.posexplode(detect.slug_candidates(F.col(name))).alias("s__", "slug"))
    tries = tries.select("*", F.posexplode(F.array(*map(F.lit, platforms))).alias("p__", "platform"))
    got = ask(tries.withColumn("try__", F.concat_ws("/", "platform", "slug")), "try__", fetch, "found__")
    good = got.where(detect.names_match(F.col("found__"), F.col(name)))
    return good.groupBy(name).agg(F.min_by(F.struct("platform", "slug"), F.struct("p__", "s__")).alias("b__")).select(name, "b__.*")


def unknown_names(names: DataFrame, boards: DataFrame, name: str, token: str, least: int = 4) -> DataFrame:
    """Names that no known board holds and that hold no known board, from four letters on.

    Containment becomes equality: a name's substrings meet the tokens, and a
    token's substrings meet the names; a name has few, so no pairs are tried.
    """
    def pieces(text: Column) -> Column:
        n = F.length(text)
        lengths = F.sequence(F.lit(least), F.greatest(n, F.lit(least)))
        all_ = F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(text, i, k))))
        return F.array_distinct(F.filter(all_, lambda x: F.length(x) >= least))

    keyed = names.withColumn("k__", detect.collapsed_name(F.col(name))).where(F.length("k__") >= least)
    known = boards.select(detect.collapsed_name(F.col(token)).alias("t__")).where(F.length("t__") >= least).distinct()
    held = keyed.select("k__", F.explode(pieces(F.col("k__"))).alias("t__")).join(known, "t__").select("k__")
    holding = known.select(F.explode(pieces(F.col("t__"))).alias("k__")).join(keyed.select("k__").distinct(), "k__").select("k__")
    return keyed.join(held.union(holding).distinct(), "k__", "left_anti").drop("k__")


def write_requests(df: DataFrame, ident: str, prompt: str, path: str) -> None:
    """One request a line, for a batch service."""
    body = F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content"))
    df.select(F.to_json(F.struct(F.col(ident).cast("string").alias("custom_id"), F.struct(F.array(body).alias("messages")).alias("params"))).alias("value")).write.mode("overwrite").text(path)
