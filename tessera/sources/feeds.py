"""Job feeds that need no connector of their own, guest cards, a two-stage board, portfolios, dataset rows and CVs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import slugs
from tessera.functions.text import div_content, strip_html
from tessera.sources import aggregators, boards
from tessera.sources.boards import Board, plain

#: Feeds by id: label, address, how a title names its company (at, dash or neither), whether the board is remote only.
FEEDS = {
    "huntukvisa": ("Hunt UK Visa Sponsors", "https://huntukvisasponsors.com/jobs/feed.xml", "at", False),
    "solidjobs": ("SOLID.Jobs", "https://solid.jobs/rss/job-offers", "dash", False),
    "impjieg": ("Impjieg", "https://impjieg.work/api/jobs/rss", "at", False),
    "ziprecruiterie": ("ZipRecruiter IE", "https://www.ziprecruiter.ie/jobs.rss", "at", False),
    "definitejobs": ("DefiniteJobs UK", "https://definitejobs.co.uk/feed/", "at", False),
    "agenticjobs2": ("Agentic Engineering Jobs", "https://agentic-engineering-jobs.com/rss", "at", False),
    "pyjobs": ("pyJobs", "https://www.pyjobs.com/rss", "at", False),
    "qajobsco": ("QA Jobs", "https://www.qajobs.co/rss", "at", False),
    "typescriptjobs": ("TypeScriptJobs", "https://typescriptjobs.net/feed.xml", "at", False),
    "devtooljobs": ("devtooljobs", "https://devtooljobs.com/rss.xml", "at", False),
    "pycoders": ("Pycoder's Jobs", "https://www.pythonjobshq.com/jobs.rss", "at", False),
    "pythonorg": ("Python.org Jobs", "https://www.python.org/jobs/feed/rss/", "dash", False),
    "remotepython": ("Remote Python", "https://www.remotepython.com/latest/jobs/feed/", "at", True),
    "findadatajob": ("FindADataJob", "https://findadatajob.com/rss", "at", False),
    "odscjobs": ("ODSC Jobs", "https://jobs.opendatascience.com/feed/", "at", False),
    "jobsbyculture": ("JobsByCulture", "https://jobsbyculture.com/feed.xml", "at", False),
    "jobyap": ("JobYap", "https://jobyap.com/feed.xml", "at", False),
    "fossjobs": ("fossjobs", "https://www.fossjobs.net/rss/all/", "dash", False),
    "fossfox": ("Fossfox", "https://fossfox.com/feed/", "at", False),
    "rejobs": ("Rejobs", "https://rejobs.org/en/rss/renewable-energy-jobs", "at", False),
    "fourdayweek": ("4dayweek", "https://4dayweek.io/feed", "at", False),
    "mozillajobs": ("Mozilla", "https://www.mozilla.org/en-US/careers/feed/", "", False),
    "golangprojects": ("Golangprojects", "https://www.golangprojects.com/rss.xml", "dash", False),
    "elixirjobs": ("Elixir Jobs", "https://elixirjobs.net/rss", "at", False),
    "larajobs": ("LaraJobs", "https://larajobs.com/feed", "at", False),
    "wpjobs": ("WordPress Jobs", "https://jobs.wordpress.net/feed/", "dash", False),
    "clojurejobs": ("ClojureJobboard", "https://clojurejobboard.com/rss.xml", "at", False),
    "rusers": ("R-users", "https://feeds.feedburner.com/RJobs", "at", False),
    "jobbsy": ("Jobbsy", "https://jobbsy.dev/rss.xml", "at", False),
    "softwaretechjobs": ("Software Tech Jobs", "https://softwaretechjobs.com/rss.xml", "at", False),
    "nodesk": ("NODESK", "https://nodesk.co/remote-jobs/index.xml", "at", True),
    "iloveremote": ("iloveremote", "https://iloveremote.io/rss/jobs/city/remote.rss", "at", True),
    "remote1st": ("Remote1stJobs", "https://www.remote1stjobs.com/rss.xml", "at", True),
    "jobspresso": ("Jobspresso", "https://jobspresso.co/feed/?post_type=job_listing", "at", True),
    "virtualvocations": ("Virtual Vocations", "https://www.virtualvocations.com/rss", "at", True),
    "dynamitejobs": ("DynamiteJobs", "https://dynamitejobs.com/feed/rss.xml", "at", True),
    "trulyremote": ("TrulyRemote", "https://trulyremote.co/rss.xml", "at", True),
    "realwfa": ("RealWorkFromAnywhere", "https://www.realworkfromanywhere.com/rss.xml", "at", True),
    "letswork": ("letsworkremotely", "https://www.letsworkremotely.com/feed/", "at", True),
    "remoteyeah": ("RemoteYeah", "https://remoteyeah.com/rss.xml", "at", True),
    "workew": ("Workew", "https://workew.com/feed/", "at", True),
    "benture": ("Benture", "https://benture.io/rss", "at", True),
    "hasjob": ("HasJob", "https://hasjob.co/feed", "at", False),
    "redditremotejobs": ("r/RemoteJobs", "https://www.reddit.com/r/RemoteJobs/.rss", "", True),
    "redditremotejs": ("r/remotejs", "https://www.reddit.com/r/remotejs/.rss", "", True),
    "redditremotepy": ("r/remotepython", "https://www.reddit.com/r/remotepython/.rss", "", True),
    "cryptojobslist": ("CryptoJobsList", "https://api.cryptojobslist.com/jobs.rss?jobLocation=Remote", "at", True),
    "cryptojobs": ("CryptoJobs", "https://crypto.jobs/feed/rss", "at", False),
    "chainjobs": ("ChainJobs", "https://chainjobs.io/feed.xml", "at", False),
    "jobsinblockchain": ("JobsInBlockchain", "https://jobsinblockchain.com/rss", "at", False),
    "remote3": ("Remote3", "https://www.remote3.co/api/rss", "at", True),
    "blockchainjb": ("Blockchain Jobs Board", "https://www.blockchainjobsboard.com/feed/", "at", False),
    "predictionjobs": ("PredictionJobs", "https://predictionjobs.co/feed.xml", "at", False),
    "dribbble": ("Dribbble", "https://dribbble.com/jobs.rss?anywhere=true", "at", False),
    "coroflot": ("Coroflot", "https://feeds.feedburner.com/coroflot/AllJobs", "at", False),
    "smashingjobs": ("Smashing Jobs", "https://www.smashingmagazine.com/jobs/feed/", "at", False),
    "designjb": ("Design Jobs Board", "https://www.designjobsboard.com/feed", "at", False),
    "osdesign": ("Open Source Design", "https://opensourcedesign.net/feed", "at", False),
    "cybersecjobs": ("CyberSecurityJobs", "https://www.cybersecurityjobs.com/feed", "at", False),
    "ntenjobs": ("NTEN", "https://www.nten.org/feed/?post_type=job", "at", False),
    "skolljobs": ("Skoll", "https://skoll.org/?feed=job_feed", "at", False),
    "itjobpro": ("IT Job Pro", "https://itjobpro.com/feed/", "at", False),
    "jobfound": ("JobFound", "https://jobfound.org/feed.xml", "at", False),
    "hiddenjobs": ("Hidden Jobs", "https://hidden-jobs.com/feed/", "at", False),
    "entryleveljobs": ("Entry Level Jobs", "https://entryleveljobs.me/rss.xml", "at", False),
    "bestpmjobs": ("Best PM Jobs", "https://www.bestpmjobs.com/jobs.rss", "at", False),
}
#: Sources of the postings dataset that are platforms of ours.
DATASET_PLATFORMS = ("ashby", "greenhouse", "lever")
LEAST_CV = 200


def table(spark: SparkSession) -> DataFrame:
    """(token, label, url, mode, only_remote): one row a feed."""
    return spark.createDataFrame([(k, *v) for k, v in FEEDS.items()], "token string, label string, url string, mode string, only_remote boolean")


def feed_postings(pages: DataFrame) -> DataFrame:
    """Postings of the feeds' pages (token, page, body); pages of unknown feeds give none."""
    known = F.broadcast(table(pages.sparkSession).select("token", "label", "mode", "only_remote"))  # 66 rows
    out = aggregators.feed_items(pages.join(known, "token"), F.col("label"), F.col("mode"))
    remote = F.broadcast(table(pages.sparkSession).select(F.col("token").alias("source"), "only_remote"))
    return out.join(remote, "source").withColumn("remote", F.col("remote") | F.col("only_remote")).select(*boards.COLUMNS, "pos")


#: A board that is read in two stages: cards first, details of the best of them.
SWISS = Board(
    "ch-jobroom", "transform(b, x -> coalesce(x.jobAdvertisement, struct(x.id, x.jobContent, x.publication)))",
    {"external_id": "j.id", "url": "coalesce(nullif(j.jobContent.externalUrl, ''), concat('https://www.job-room.ch/job-search/', j.id))", "title": "get(j.jobContent.jobDescriptions, 0).title", "company": "j.jobContent.company.name",
     "location": "case when j.jobContent.location.city <> '' then concat(j.jobContent.location.city, ', Switzerland') else 'Switzerland' end", "description": "get(j.jobContent.jobDescriptions, 0).description", "posted_at": "j.publication.startDate"},
    (lambda ad: f"array<struct<jobAdvertisement:struct<{ad}>,{ad}>>")("id:string,jobContent:struct<jobDescriptions:array<struct<title:string,description:string>>,company:struct<name:string>,location:struct<city:string>,externalUrl:string>,publication:struct<startDate:string>"),
    wanted="j.id <> '' and get(j.jobContent.jobDescriptions, 0).title <> ''", keep="first", html=("description", "title"), titled=False, tokened=False,
)


def _shown(name: str) -> str:
    return plain(rf"regexp_extract(j, r'(?s){name}[^>]*>\s*(.*?)\s*</', 1)")


_NESTED = _shown("hidden-nested-link")
#: Cards of the guest search, each after its own mark; the first company that a card shows counts.
GUEST = Board(
    "linkedin", "slice(split(b, 'data-entity-urn=\"urn:li:jobPosting:'), 2, greatest(size(split(b, 'data-entity-urn=\"urn:li:jobPosting:')) - 1, 0))",
    {"external_id": r"regexp_extract(j, r'^(\d+)', 1)", "url": r"""coalesce(nullif(substring_index(replace(regexp_extract(j, r'base-card__full-link[^>]*href="([^"]+)"', 1), '&amp;', '&'), '?', 1), ''), concat('https://www.linkedin.com/jobs/view/', regexp_extract(j, r'^(\d+)', 1)))""",
     "title": _shown("base-search-card__title"), "company": f"coalesce(nullif({_NESTED}, ''), " + plain(r"regexp_extract(j, r'(?s)base-search-card__subtitle[^>]*>.*?>\s*(.*?)\s*</', 1)") + ")", "location": _shown("job-search-card__location"), "posted_at": r"""regexp_extract(j, r'datetime="([^"]+)"', 1)"""},
    wanted=rf"j rlike r'^\d+' and {_shown('base-search-card__title')} <> ''", keep="first", html=(), titled=True, tokened=False,
)


def guest_detail(html: Column) -> Column:
    """The description on a guest posting's page, empty where there is none."""
    return F.coalesce(strip_html(div_content(html, "show-more-less-html__markup")), F.lit(""))


def latest_files(files: DataFrame, path: str = "path") -> DataFrame:
    """(date, source, path) of the files of a listing that lie in the newest ``data/date=D/source=S/``."""
    pattern = r"^data/date=(\d{4}-\d{2}-\d{2})/source=([^/]+)/.+\.parquet$"
    rows = files.where(F.col(path).rlike(pattern)).select(F.regexp_extract(path, pattern, 1).alias("date"), F.regexp_extract(path, pattern, 2).alias("source"), F.col(path).alias("path"))
    return rows.join(F.broadcast(rows.agg(F.max("date").alias("date"))), "date")  # one row


def dataset_hits(rows: DataFrame) -> DataFrame:
    """Distinct (platform, token, region) of a postings dataset (source, source_slug, apply_url): what the URL says if it is of the source's platform, else the slug."""
    hit, slug = slugs.board_of(F.col("apply_url")), F.lower(F.trim("source_slug"))
    rows = rows.where(F.col("source").isin(*DATASET_PLATFORMS)).select("source", hit.alias("h"), F.when(slug.rlike("^[a-z0-9][a-z0-9 ._&'-]{0,80}$"), slug).alias("slug"))
    own = F.coalesce(F.col("h.platform") == F.col("source"), F.lit(False))
    found = rows.select(F.col("source").alias("platform"), F.when(own, F.col("h.token")).otherwise(F.col("slug")).alias("token"), F.when(own, F.col("h.region")).otherwise("").alias("region"))
    return found.where("token is not null").distinct()


def portfolio(pages: DataFrame, body: str = "body") -> DataFrame:
    """(name, website) of a portfolio's pages: companies that are active, public or of no stated status; the website as its host."""
    schema = "companies array<struct<name:string,status:string,website:string>>"
    rows = pages.select(F.explode(F.from_json(body, schema)["companies"]).alias("c")).select("c.*")
    kept = rows.where((F.col("name") != "") & F.lower(F.coalesce("status", F.lit(""))).isin("", "active", "public"))
    host = F.regexp_replace(F.lower(F.regexp_extract("website", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")
    return kept.select("name", F.nullif(host, F.lit("")).alias("website"))


def cv_text(raw: Column) -> Column:
    """A CV's text with its lines kept: one kind of line end, single blanks, no more than one empty line; null under 200 characters."""
    for pattern, with_ in (("\r\n?", "\n"), ("[ \t]+", " "), (" ?\n ?", "\n"), ("\n{3,}", "\n\n"), (r"^\s+|\s+\z", "")):
        raw = F.regexp_replace(raw, pattern, with_)
    return F.when(F.length(raw) >= LEAST_CV, raw)
