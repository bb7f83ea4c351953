"""Pages over HTTP, a batch of addresses at a time, on the executors.

``client`` is a factory for operators/models.ask(); ``pages`` reads the
addresses of a DataFrame, however many; ``HttpPages`` is a data source for a
short list of them. A page that fails is a row with its fault, so one dead
site costs one row and not the job.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, status int, final string, body string, error string"
AGAIN, HOPS, LARGEST = (429, 500, 502, 503, 504), 5, 500_000
AGENT = "tessera/1.0"


class _Still(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def fetch(url: str, method: str = "GET", body: str | None = None, headers: dict[str, str] | None = None, timeout: float = 30, tries: int = 3, wait: float = 1, hops: int = HOPS, largest: int = LARGEST) -> tuple[int | None, str, str, str | None]:
    """(status, last address, text, fault). Throttled and failing servers are asked again after doubled waits; at most ``hops`` redirections are followed, none where it is 0."""
    opener, at, left, attempt = urllib.request.build_opener(_Still), url, hops, 0
    while True:
        attempt += 1
        try:
            request = urllib.request.Request(at, data=None if body is None else body.encode(), method=method, headers={"User-Agent": AGENT, **(headers or {})})
            with opener.open(request, timeout=timeout) as answer:
                return answer.status, at, answer.read(largest).decode(answer.headers.get_content_charset() or "utf-8", "replace"), None
        except urllib.error.HTTPError as e:
            if e.code in (301, 302, 303, 307, 308) and left > 0 and e.headers.get("Location"):
                at, left, attempt = urljoin(at, e.headers["Location"]), left - 1, 0
                continue
            if e.code in AGAIN and attempt < tries:
                time.sleep(wait * 2 ** (attempt - 1))
                continue
            return e.code, at, e.read(largest).decode("utf-8", "replace"), None
        except (OSError, ValueError) as e:  # no such host, refused, timed out, no address
            if isinstance(e, OSError) and attempt < tries:
                time.sleep(wait * 2 ** (attempt - 1))
                continue
            return None, at, "", f"{type(e).__name__}: {e}"[:200]


def client(pause: float = 0, **options) -> Callable[[], Callable[[list[str]], list[str | None]]]:
    """A factory of clients that answer ``status\\npage``, or None where nothing came; ``pause`` seconds lie between two requests of a task."""

    def make():
        def ask(urls: list[str]) -> list[str | None]:
            out: list[str | None] = []
            for i, url in enumerate(urls):
                if i and pause:
                    time.sleep(pause)
                status, _, text, fault = fetch(url, **options)
                out.append(None if fault else f"{status}\n{text}")
            return out

        return ask

    return make


def _rows(urls: list[str], options: dict) -> Iterator[tuple]:
    for url in urls:
        status, final, text, fault = fetch(url, **options)
        yield url, status, final, text, fault


def pages(df: DataFrame, url: str = "url", tasks: int = 64, **options) -> DataFrame:
    """One row for each distinct address; a site's addresses go to one task, so that it is asked one page at a time."""
    host = F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1)
    urls = df.select(F.col(url).alias("url")).where("url is not null").distinct().repartition(tasks, host)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = list(_rows(batch.column(0).to_pylist(), options))
            columns = list(zip(*found, strict=True)) or [()] * 5
            types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["url", "status", "final", "body", "error"])

    return urls.mapInArrow(run, SCHEMA)


class HttpPages(DataSource):
    """``spark.read.format("http_pages")``. Options: urls (one a line), method, body, timeout, tries, wait, redirect (follow or manual), header.<name>; ``{page}`` in an address stands for each of pages (from-to)."""

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options):
        first, last = (int(x) for x in options.get("pages", "1-1").split("-"))
        lines = [u.strip() for u in options.get("urls", "").splitlines() if u.strip()]
        self.urls = [u.replace("{page}", str(p)) for u in lines for p in (range(first, last + 1) if "{page}" in u else (first,))]
        self.tasks = int(options.get("tasks", "8"))
        self.how = {
            "method": options.get("method", "GET"), "body": options.get("body"), "timeout": float(options.get("timeout", "30")), "tries": int(options.get("tries", "3")), "wait": float(options.get("wait", "1")),
            "hops": 0 if options.get("redirect") == "manual" else HOPS, "headers": {k[7:]: v for k, v in options.items() if k.lower().startswith("header.")},
        }

    def partitions(self) -> list[InputPartition]:
        n = max(1, min(self.tasks, len(self.urls)))
        return [_Part(self.urls[i::n]) for i in range(n)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from _rows(partition.urls, self.how)
