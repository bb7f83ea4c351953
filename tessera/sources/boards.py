"""Boards as data: a schema, where the rows are, and one SQL expression a column.

A board's pages come as rows (token, company, region, page, body); bodies are
parsed by ``from_json`` or split by a pattern, so a connector is a projection
that Catalyst sees through. Fetching is not part of it: readers hand in bodies.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import detect
from tessera.functions.text import strip_html

PAGES = "token string, company string, region string, page int, body string"
COLUMNS = ("source", "external_id", "url", "title", "company", "location", "remote", "work_mode", "salary_text", "description", "posted_at", "visa")


@dataclass(frozen=True)
class Board:
    """``rows`` over ``b`` (the parsed body, or the body itself without a schema) gives an array; each ``fields`` entry is SQL over j (a row), token, company and region.

    ``keep``: all rows; the first or last of each external_id; or ``merge``,
    the first with the locations of all. ``html`` names fields that hold
    markup. An empty description takes the title where ``titled``.
    """

    source: str
    rows: str
    fields: dict[str, str] = field(default_factory=dict)
    schema: str | None = None
    wanted: str = "true"
    keep: str = "all"
    html: tuple[str, ...] = ("description",)
    titled: bool = True
    tokened: bool = True


def tag(*names: str) -> str:
    """SQL for the first of these elements of ``j`` that has text, without CDATA marks."""
    found = [rf"""nullif(trim(regexp_extract(j, r'(?is)<{n}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{n}>', 1)), '')""" for n in names]
    return f"coalesce({', '.join(found)}, '')"


def blocks(name: str) -> str:
    return rf"regexp_extract_all(b, r'(?is)<{name}\b[^>]*>(.*?)</{name}>', 1)"


def says(*texts: str, word: str = "remote") -> str:
    return rf"concat_ws(' ', {', '.join(texts)}) rlike r'(?i){word}'"


def joined(*parts: str, by: str = ", ") -> str:
    return f"concat_ws('{by}', {', '.join(f'nullif({p}, {chr(39) * 2})' for p in parts)})"


def truthy(value: str) -> str:
    return f"coalesce({value} not in ('', 'false', '0'), false)"


def few(array: str, n: int = 4) -> str:
    return f"array_join(slice(array_distinct(filter({array}, x -> x <> '')), 1, {n}), '; ')"


def plain(html: str) -> str:
    """SQL for the text of a piece of markup."""
    bare = f"regexp_replace({html}, '<[^>]*>', ' ')"
    for entity, char in (("&nbsp;", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", '"\'"')):
        bare = f"replace({bare}, '{entity}', {char})"
    return rf"trim(regexp_replace({bare}, r'\s+', ' '))"


def postings(pages: DataFrame, board: Board, moment: Callable[[Column], Column] = detect.moment) -> DataFrame:
    """The postings of a board's pages as COLUMNS, with ``pos`` (page, row) in the order they came.

    A body that doesn't parse, or is null, gives none.
    """
    body = F.from_json("body", board.schema) if board.schema else F.col("body")
    rows = pages.select("token", "company", "region", "page", body.alias("b"))
    rows = rows.select("token", "company", "region", "page", F.posexplode(F.expr(board.rows)).alias("i", "j")).where(board.wanted)
    asked = {"company": "company", "location": "''", "remote": "false", "work_mode": "null", "salary_text": "null", "description": "''", "posted_at": "null", "visa": "null"} | board.fields
    source = F.concat(F.lit(board.source + ":"), "token") if board.tokened else F.lit(board.source)
    out = rows.select(source.alias("source"), *(F.expr(sql).cast("boolean" if name == "remote" else "string").alias(name) for name, sql in asked.items()), F.struct("page", "i").alias("pos"))
    for name in board.html:
        out = out.withColumn(name, strip_html(F.coalesce(name, F.lit(""))))
    shown = F.when(F.coalesce("description", F.lit("")) == "", F.coalesce("title", F.lit(""))).otherwise(F.col("description")) if board.titled else F.coalesce("description", F.lit(""))
    out = out.select(
        "source", "external_id", F.coalesce("url", F.lit("")).alias("url"), F.trim(F.coalesce("title", F.lit(""))).alias("title"), F.coalesce("company", F.lit("")).alias("company"),
        F.coalesce("location", F.lit("")).alias("location"), F.coalesce("remote", F.lit(False)).alias("remote"), F.nullif("work_mode", F.lit("")).alias("work_mode"),
        F.nullif("salary_text", F.lit("")).alias("salary_text"), shown.alias("description"), moment(F.col("posted_at")).alias("posted_at"), "visa", "pos",
    )
    return kept(out, board.keep)


def kept(out: DataFrame, keep: str) -> DataFrame:
    if keep == "all":
        return out
    if keep == "merge":
        rest = [F.min_by(c, "pos").alias(c) for c in (*COLUMNS[2:], "pos") if c not in ("location", "pos")]
        places = F.transform(F.array_sort(F.collect_list(F.struct("pos", "location"))), lambda s: s["location"])
        return out.groupBy("source", "external_id").agg(*rest, F.min("pos").alias("pos"), merged_places(places).alias("location")).select(*COLUMNS, "pos")
    order = F.col("pos").asc() if keep == "first" else F.col("pos").desc()
    return out.withColumn("n__", F.row_number().over(Window.partitionBy("source", "external_id").orderBy(order))).where("n__ = 1").drop("n__")


def merged_places(places: Column) -> Column:
    """Places joined by ``; ``, leaving out those that what came before holds already."""
    return F.aggregate(places, F.lit(""), lambda a, p: F.when((p == "") | F.contains(a, p), a).when(a == "", p).otherwise(F.concat(a, F.lit("; "), p)))


def within_window(df: DataFrame, cutoff: Column) -> DataFrame:
    """Postings from ``cutoff`` on; undated ones stay."""
    return df.where(F.col("posted_at").isNull() | (F.col("posted_at") >= cutoff))


def detail_plan(cards: DataFrame, score: str, least: int, budget: int, order: list[Column], keep_rest: bool = False) -> DataFrame:
    """The cards whose details are worth a fetch: ``score`` at least ``least``, the best ``budget`` of them.

    With ``keep_rest`` all approved cards stay and ``detail`` marks the chosen.
    """
    approved = cards.where(F.col(score) >= least)
    chosen = approved.orderBy(*order).limit(budget)
    if not keep_rest:
        return chosen.withColumn("detail", F.lit(True))
    keys = chosen.select("source", "external_id", F.lit(True).alias("d__"))
    return approved.join(keys, ["source", "external_id"], "left").withColumn("detail", F.coalesce("d__", F.lit(False))).drop("d__")
