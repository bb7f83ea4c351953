"""Funnels that end in models and pages: probes of boards, companies' own sites, judgments, descriptions and letters.

Clients are injected (operators/models.py, sources/http.py) and asked once a
partition, in batches; a client of pages answers ``status\\npage`` or None.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import detect, predicates, slugs
from tessera.functions.text import let
from tessera.operators.models import ask, parse_fit

#: A platform's address for probes; the parts of a structured token are {0}, {1} and so on.
PROBES = {
    "lever": "https://api.lever.co/v0/postings/{0}?mode=json", "ashby": "https://api.ashbyhq.com/posting-api/job-board/{0}", "smartrecruiters": "https://api.smartrecruiters.com/v1/companies/{0}/postings?limit=1",
    "greenhouse": "https://boards-api.greenhouse.io/v1/boards/{0}", "workable": "https://apply.workable.com/api/v1/widget/accounts/{0}", "recruitee": "https://{0}.recruitee.com/api/offers/", "personio": "https://{0}.jobs.personio.com/xml",
    "workday": "https://{0}.{1}.myworkdayjobs.com/wday/cxs/{0}/{2}/jobs", "bamboohr": "https://{0}.bamboohr.com/careers/list", "breezy": "https://{0}.breezy.hr/json", "teamtailor": "https://{0}.teamtailor.com/jobs", "join": "https://join.com/companies/{0}",
    "pinpoint": "https://{0}.pinpointhq.com/postings.json", "eightfold": "https://{0}.eightfold.ai/api/apply/v2/jobs?start=0&num=1", "jibe": "https://{0}.jibeapply.com/api/jobs?page=1",
}
PAGES = 2


def probe_url(platform: Column, token: Column, region: Column) -> Column:
    """The address that tells whether a board lives; null for platforms without one, and for a token that breaks its platform's form."""
    parts = F.split(token, "[@/]")
    out = F.lit(None).cast("string")
    for name, form in PROBES.items():
        url, whole = F.lit(form), F.lit(True)
        for i in range(3):
            if f"{{{i}}}" in form:
                part = F.get(parts, F.lit(i)) if "{1}" in form else F.replace(F.url_encode(token), F.lit("+"), F.lit("%20"))
                url, whole = F.replace(url, F.lit(f"{{{i}}}"), F.coalesce(part, F.lit(""))), whole & F.coalesce(part != "", F.lit(False))
        if name == "lever":
            url = F.when(region == "eu", F.replace(url, F.lit("api.lever"), F.lit("api.eu.lever"))).otherwise(url)
        out = F.when((platform == name) & whole, url).otherwise(out)
    return out


def probed(boards: DataFrame, client) -> DataFrame:
    """Boards (platform, token, region) with result (active, dead, or error where nothing came), company_name and job_count."""
    asked = ask(boards.withColumn("probe__", probe_url(F.col("platform"), F.col("token"), F.col("region"))), "probe__", client, "page__")
    status, body = F.substring_index("page__", "\n", 1).try_cast("int"), F.regexp_replace("page__", r"(?s)^[^\n]*\n?", "")
    error = F.col("page__").isNull() | (status == 429)
    p = F.col("platform")
    found = asked.withColumns({"result": F.when(error, "error").otherwise(slugs.probe_result(p, status, body)), "company_name": slugs.probe_name(p, status, body), "job_count": slugs.probe_count(p, status, body)})
    return found.drop("probe__", "page__")


def site_boards(companies: DataFrame, client) -> DataFrame:
    """(name, platform, token, region): boards that a company's own site names: its home page, else the pages it links as careers, else /careers and /jobs. companies: name, domain."""
    body = lambda c: F.coalesce(F.regexp_replace(c, r"(?s)^[^\n]*\n?", ""), F.lit(""))
    home = ask(companies.select("name", "domain", F.concat(F.lit("https://"), "domain").alias("at__")), "at__", client, "page__").select("name", "domain", body("page__").alias("t"))
    first = slugs.scan(home, "name", "t").where("platform is not null").select("name", "platform", "token", "region").distinct()
    links = slugs.career_links(F.col("t"), F.col("domain"), PAGES)
    usual = F.array(*(F.concat(F.lit("https://"), "domain", F.lit(p)) for p in ("/careers", "/jobs")))
    further = home.join(first.select("name").distinct(), "name", "left_anti").select("name", F.posexplode(F.when(F.size(links) > 0, links).otherwise(usual)).alias("place", "at__"))
    pages = ask(further, "at__", client, "page__").select("name", "place", body("page__").alias("t"))
    hits = slugs.scan(pages.withColumn("key__", F.struct("name", "place")), "key__", "t").where("platform is not null")
    hits = hits.select(F.col("key__.name").alias("name"), F.col("key__.place").alias("place"), "platform", "token", "region")
    earliest = hits.groupBy("name").agg(F.min("place").alias("place"))  # the first page that names any
    return first.unionByName(hits.join(earliest, ["name", "place"]).select("name", "platform", "token", "region").distinct())


def verified(found: DataFrame, client) -> DataFrame:
    """Boards of site_boards() that live, hold a posting and bear the company's name where their platform tells one."""
    rows = probed(found, client).where("result = 'active' and job_count >= 1")
    return rows.where(F.col("company_name").isNull() | detect.names_match(F.col("name"), F.col("company_name"))).select("name", "platform", "token", "region", F.coalesce("company_name", "name").alias("company_name"))


def judged(jobs: DataFrame, prompt: Column, client, model: str, version: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(jobs with their judgment, judgment rows to append); a posting without an answer stays as it is.

    A refused visa is the posting's visa then; a level that the model tells
    outranks the detected one.
    """
    asked = ask(jobs.withColumn("prompt__", prompt), "prompt__", client, "answer__").withColumn("f__", F.when(F.col("answer__").isNotNull(), parse_fit(F.col("answer__"))))
    done, told = F.col("f__").isNotNull(), F.coalesce(F.col("f__.level") != "unknown", F.lit(False))
    new = {"fit_score": F.col("f__.score"), "fit_verdict": F.col("f__.verdict"), "fit_category": F.col("f__.category"), "fit_comment": F.col("f__.comment"), "ghost_risk": F.col("f__.ghost_risk"), "fit_by": F.lit(model)}
    out = {c: F.when(done, v).otherwise(F.col(c)) for c, v in new.items() if c in jobs.columns}
    for c, value, when in (("visa", F.lit("no"), F.coalesce(F.col("f__.category") == "NO_VISA", F.lit(False))), ("seniority_level", F.col("f__.level"), told), ("seniority_by", F.lit("llm"), told)):
        if c in jobs.columns:
            out[c] = F.when(done & when, value).otherwise(F.col(c))
    rows = asked.where(done).select("id", F.lit(model).alias("model"), F.lit(version).alias("prompt_version"), F.col("f__.score").alias("fit_score"), F.col("f__.verdict").alias("verdict"), F.col("f__.category").alias("category"), F.col("f__.level").alias("seniority_level"), F.col("f__.ghost_risk").alias("ghost_risk"), F.col("f__.comment").alias("comment"), at.alias("at"))
    return asked.withColumns(out).select(*jobs.columns), rows


def described(jobs: DataFrame, url: Column, text: Column, client) -> DataFrame:
    """``jobs`` with the description that their page gives, where it says more than the title. ``text`` reads the page from the column ``page``."""
    asked = ask(jobs.withColumn("at__", url), "at__", client, "page__").withColumn("page", F.regexp_replace("page__", r"(?s)^[^\n]*\n?", ""))
    found = asked.withColumn("new__", F.substring(text, 1, 8000))
    says = F.col("new__").isNotNull() & ~predicates.title_only(F.col("title"), F.col("new__"))
    return found.withColumn("description", F.when(says, F.col("new__")).otherwise(F.col("description"))).select(*jobs.columns)


def written(jobs: DataFrame, prompt: Column, client, letter: str = "cover_letter") -> DataFrame:
    """``jobs`` with a letter from the model, null where it gave none."""
    asked = ask(jobs.withColumn("prompt__", prompt), "prompt__", client, "letter__")
    return asked.select(*(F.col(c) for c in jobs.columns if c != letter), F.nullif(F.trim("letter__"), F.lit("")).alias(letter))


def og_description(html: Column) -> Column:
    """The og:description of a page, entities decoded."""
    from tessera.functions.text import strip_html

    found = F.regexp_extract(html, r"""(?is)<meta[^>]+property=["']og:description["'][^>]+content="([^"]*)""", 1)
    return let(found, lambda t: F.when(t != "", strip_html(t)))
