"""Company registers, lists and crawl lines as DataFrames of (name, detail) or the like.

Pages are columns of text or bytes, so files of any number are parsed by the
executors. Null and unreadable inputs give no rows.
"""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.detect import collapsed_name

LEAST_ROWS = 50
#: What a register's entry says of a company.
DUTCH, DANISH, IRISH = "IND recognised sponsor", "SIRI fast-track certified", "IE employment permit issued this year"


def _cell(cell: Column) -> Column:
    out = F.regexp_replace(cell, "<[^>]*>", "")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&apos;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def dutch(pages: DataFrame, html: str = "body") -> DataFrame:
    """Rows of ``<th scope="row">name</th><td>number</td>``."""
    row = r"""(?is)<th[^>]*scope=["']row["'][^>]*>.*?</th>\s*<td[^>]*>.*?</td>"""
    rows = pages.select(F.explode(F.regexp_extract_all(html, F.lit(row), F.lit(0))).alias("r"))
    cells = rows.select(_cell(F.regexp_extract("r", "(?is)<th[^>]*>(.*?)</th>", 1)).alias("name"), _cell(F.regexp_extract("r", "(?is)<td[^>]*>(.*?)</td>", 1)).alias("n"))
    return cells.where("name <> ''").select("name", F.when(F.col("n") != "", F.concat(F.lit(f"{DUTCH} (KvK "), "n", F.lit(")"))).otherwise(DUTCH).alias("detail"))


def danish(pages: DataFrame, html: str = "body") -> DataFrame:
    """Table rows whose second cell holds a number of six digits or more."""
    row = r"(?is)<tr[^>]*>\s*<td[^>]*>.*?</td>\s*<td[^>]*>.*?</td>"
    rows = pages.select(F.explode(F.regexp_extract_all(html, F.lit(row), F.lit(0))).alias("r"))
    pair = r"(?is)<td[^>]*>(.*?)</td>\s*<td[^>]*>(.*?)</td>"
    cells = rows.select(_cell(F.regexp_extract("r", pair, 1)).alias("name"), _cell(F.regexp_extract("r", pair, 2)).alias("n"))
    return cells.where((F.col("name") != "") & F.col("n").rlike(r"\d{6,}")).select("name", F.concat(F.lit(f"{DANISH} (CVR "), "n", F.lit(")")).alias("detail"))


def british(spark: SparkSession, path: str) -> DataFrame:
    """The register's CSV: one row a company, its first route in file order."""
    names = "name string, town string, county string, rating string, route string"
    rows = spark.read.csv(path, schema=names, header=True, quote='"', escape='"').select(F.trim("name").alias("name"), "rating", "route", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    return british_rows(rows, [F.col("f"), F.col("i")])


def british_rows(rows: DataFrame, order: list[Column]) -> DataFrame:
    """(name, rating, route) to one (name, detail) a collapsed name, the first in ``order``."""
    rows = rows.withColumn("key", collapsed_name(F.col("name"))).where("name <> '' and key <> ''")
    first = rows.withColumn("n__", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where("n__ = 1")
    return first.select("name", F.nullif(F.concat_ws(" — ", F.nullif("rating", F.lit("")), F.nullif("route", F.lit(""))), F.lit("")).alias("detail"))


def irish(files: DataFrame, content: str = "content") -> DataFrame:
    """Names in column A of spreadsheets, headers and totals left out; a file that is no spreadsheet gives none."""

    def names(data) -> list[str]:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                shared, sheet = z.read("xl/sharedStrings.xml").decode(), z.read("xl/worksheets/sheet1.xml").decode()
        except (zipfile.BadZipFile, KeyError, TypeError, UnicodeDecodeError):
            return []
        strings = re.findall("<t[^>]*>([^<]*)</t>", shared)
        places = (int(i) for i in re.findall(r'<c r="A\d+"[^>]*t="s"[^>]*><v>(\d+)</v></c>', sheet))
        return [strings[i] for i in places if i < len(strings)]

    def parse(batches):
        for batch in batches:
            yield pd.DataFrame({"name": [n for data in batch[content] for n in names(data)]}, dtype="object")

    rows = files.select(content).mapInPandas(parse, "name string").select(_cell(F.col("name")).alias("name"))
    return rows.where((F.col("name") != "") & ~F.col("name").rlike("(?i)^(employer name|total)$")).withColumn("detail", F.lit(IRISH))


def replace_register(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Countries with at least LEAST_ROWS incoming rows are replaced; a smaller delivery is taken for a fault."""
    from tessera.operators.relational import replace_partitions

    return replace_partitions(stored, incoming, "country", LEAST_ROWS)


def named_urls(lines: DataFrame, line: str = "value") -> DataFrame:
    """``name<TAB>url`` lines; comments, blanks and lines without a URL go."""
    parts = F.split(line, "\t")
    return lines.where(~F.trim(line).startswith("#") & (F.trim(line) != "")).select(F.trim(parts[0]).alias("name"), F.trim(F.get(parts, F.lit(1))).alias("url")).where("url rlike '^https?://'")


def crawl_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """URLs of crawl-index lines, each a JSON object with a url or a bare URL; other lines go."""
    text = F.trim(line)
    url = F.coalesce(F.when(text.startswith("{"), F.get_json_object(text, "$.url")), F.when(text.rlike("^https?://"), text))
    return lines.select(url.alias("url")).where("url is not null")


def company_list(files: DataFrame, text: str = "value") -> DataFrame:
    """(name, website, jobs, countries) of the companies in YAML lists; what follows ``jobportals:`` is another list."""
    part = F.regexp_replace(text, r"(?ms)^jobportals:.*", "")
    items = files.select(F.explode(F.regexp_extract_all(F.concat(F.lit("\n"), part), F.lit(r"(?s)\n {2}- name:[^\n]*(?:\n(?! {2}- name:)[^\n]*)*"), F.lit(0))).alias("b"))
    name = F.trim(F.regexp_extract("b", r" {2}- name:\s*([^\n]+)", 1))
    geo = F.regexp_extract("b", r"(?s)\n {4}geo:[^\n]*((?:\n(?! {4}(?:website|jobs):)[^\n]*)*)", 1)
    pick = lambda key: F.nullif(F.regexp_extract("b", rf"\n {{4}}{key}:\s*(\S+)", 1), F.lit(""))
    countries = F.transform(F.regexp_extract_all(geo, F.lit(r"\n\s+-\s*country:\s*([^\n]+)"), F.lit(1)), lambda c: F.trim(c))
    return items.select(F.regexp_replace(name, r"""^["']|["']$""", "").alias("name"), pick("website").alias("website"), pick("jobs").alias("jobs"), countries.alias("countries"))


def batch_results(lines: DataFrame, line: str = "value") -> DataFrame:
    """(custom_id, answer) of batch-result lines; a failed request's answer is null, a line that is no JSON goes."""
    ident = F.get_json_object(line, "$.custom_id")
    done = F.get_json_object(line, "$.result.type") == "succeeded"
    return lines.select(ident.alias("custom_id"), F.when(done, F.get_json_object(line, "$.result.message.content[0].text")).alias("answer")).where("custom_id is not null")


def imported_boards(rows: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listed companies under our platform names, and how many rows name each platform unknown to us."""
    known = rows.join(aliases, "alias").select("platform", "token")
    return known, rows.join(aliases, "alias", "left_anti").groupBy("alias").count()
