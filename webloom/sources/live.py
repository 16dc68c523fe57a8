"""Pages from the web: a table of URLs becomes a corpus, fetched by tasks. URLs of a host are fetched by one task, some at once."""

from __future__ import annotations

import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.pages import host
from ..settings import DEFAULTS, Settings

SCHEMA = "url string, html string, status int, headers map<string,string>, error string, request_start double, response_end double"
AGAIN = (500, 502, 503, 504)


class _Unmoved(urllib.request.HTTPRedirectHandler):
    """Redirects are answers like others: crawls decide on them."""

    def redirect_request(self, *_):
        return None


class Session:
    """What a task fetches with: a connection factory for each proxy, headers, certificates checked or not, pauses by host."""

    def __init__(self, settings: Settings, headers: dict | None = None, delay: float = 0.0, retries: int = 3):
        self.settings, self.headers, self.delay, self.retries = settings, settings.merged_headers(headers), delay, retries
        self.context = ssl.create_default_context() if settings.verify_ssl else ssl._create_unverified_context()
        self.openers: dict[str | None, urllib.request.OpenerDirector] = {}
        self.next: dict[str, float] = {}
        self.lock = Lock()

    def opener(self, proxy: str | None) -> urllib.request.OpenerDirector:
        if proxy not in self.openers:
            proxies = urllib.request.ProxyHandler({"http": proxy, "https": proxy} if proxy else {})
            self.openers[proxy] = urllib.request.build_opener(proxies, urllib.request.HTTPSHandler(context=self.context), _Unmoved())
        return self.openers[proxy]

    def wait(self, name: str) -> None:
        with self.lock:
            now = time.monotonic()
            at = max(now, self.next.get(name, 0.0))
            self.next[name] = at + self.delay
        time.sleep(max(0.0, at - now))

    def get(self, url: str) -> tuple:
        """A row of SCHEMA. Failures of the network are rows with an error; some codes and failures are tried again after growing pauses."""
        name = urlsplit(url).netloc
        row: tuple = ()
        for attempt in range(self.retries + 1):
            self.wait(name)
            start = time.time()
            try:
                request = urllib.request.Request(url, headers=self.headers)
                try:
                    with self.opener(self.settings.proxies.get(name)).open(request, timeout=self.settings.timeout) as r:
                        body, status, head = r.read(), r.status, r.headers
                except urllib.error.HTTPError as e:
                    body, status, head = e.read(), e.code, e.headers
                text = body.decode(head.get_content_charset() or "utf-8", "replace")
                row = (url, text, status, list(head.items()), None, start, time.time())
                if status not in AGAIN:
                    break
            except (OSError, ValueError, LookupError) as e:
                row = (url, None, 0, [], f"{type(e).__name__}: {e}", start, time.time())
                if isinstance(e, (ValueError, LookupError)):
                    break
            if attempt < self.retries:
                time.sleep(min(30.0, 0.05 * 2**attempt))
        return row


def fetch(urls: DataFrame, settings: Settings = DEFAULTS, headers: dict | None = None, delay: float = 0.0, retries: int = 3) -> DataFrame:
    """A corpus (SCHEMA) of a table of URLs (url), a row each: best written before it is used twice, as each use fetches again. Hosts are
    spread over settings.concurrency / settings.per_host tasks, each of which has settings.per_host requests on their way at once."""

    kind = pa.schema([("url", pa.string()), ("html", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("error", pa.string()), ("request_start", pa.float64()), ("response_end", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session = Session(settings, headers, delay, retries)
        with ThreadPoolExecutor(settings.per_host) as pool:
            for b in batches:
                names = b.column(0).to_pylist()
                for k in range(0, len(names), 64):
                    rows = list(pool.map(session.get, names[k : k + 64]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    tasks = max(1, settings.concurrency // settings.per_host)
    once = urls.where("url is not null").select("url").distinct().repartition(tasks, host(F.col("url")))
    return once.mapInArrow(run, StructType.fromDDL(SCHEMA))
