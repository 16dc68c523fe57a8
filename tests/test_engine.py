"""Limits, plans, hooks, errors, settings, the cache and live pages."""

import io
import json
import logging
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from webloom import cli
from webloom.functions.xpath import XPathError
from webloom.operators import crawl as crawls
from webloom.operators import politeness, records
from webloom.operators.crawl import Hooks, crawl, crawl_levels, edges, extract
from webloom.settings import DEFAULTS, Settings, load, log, save
from webloom.sources.live import fetch
from webloom.sources.tables import corpus, fresh, store, through_cache

SITE = {"": ["a", "b"], "a": ["a1"], "b": ["b1", "none"], "a1": [], "b1": []}


def page(name):
    return f"<h1>{name}</h1>" + "".join(f"<a href='http://s/{x}'>{x}</a>" for x in SITE[name])


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(f"http://s/{k}", page(k)) for k in SITE], "url string, html string")


PROGRAM = "url('http://s/')///url(//a/@href)//h1/string()"


def values(df):
    return [r.value for r in df.orderBy("depth", "path").collect()]


def test_limit_stops_the_levels(spark, pages):
    told = []
    assert values(crawl(spark, PROGRAM, pages, 5, limit=2, progress=told.append)) == ["a", "b"]
    assert [x["depth"] for x in told] == [0, 1] and told[1]["data"] == 2 and told[1]["link"] == 3
    assert values(crawl(spark, PROGRAM, pages, 5, limit=3)) == ["a", "b", "a1"]
    assert values(crawl(spark, PROGRAM, pages, 5)) == ["a", "b", "a1", "b1"]


def test_the_corpus_is_neither_broadcast_nor_shuffled(spark, pages, tmp_path, monkeypatch):
    pages.write.parquet(str(tmp_path / "pages"))
    plans = []
    plain = crawls.written

    def seen(df, what):
        if what == "level":
            plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return plain(df, what)

    monkeypatch.setattr(crawls, "written", seen)
    assert len(list(crawl_levels(spark, PROGRAM, spark.read.parquet(str(tmp_path / "pages")), 1))) == 2
    for p in plans:
        assert "BroadcastHashJoin" in p and "BuildLeft" not in p and "RightOuter" not in p and "SortMergeJoin" not in p
        with_html = [line for line in p.splitlines() if "Exchange" in line and "html" in line]
        assert not with_html


def test_rows_of_one_url_count_once(spark, pages):
    more = pages.unionByName(spark.createDataFrame([("http://s/a", "<h1>A0</h1>"), ("http://s/a", None), ("http://s/a", "<h1>A0</h1>")], pages.schema))
    assert corpus(more).count() == len(SITE) and values(crawl(spark, PROGRAM, more, 1)) == ["A0", "b"]
    assert corpus(more).where("url = 'http://s/a'").first().html == min(page("a"), "<h1>A0</h1>")


def test_unexpected_response(spark, pages):
    moved = pages.withColumn("request_url", F.col("url")).withColumn("url", F.when(F.col("url") == "http://s/a", "http://other/").otherwise(F.col("url")))
    got = crawl(spark, PROGRAM, moved, 3, yield_errors=True).orderBy("depth", "path").collect()
    assert [(r.url, r.reason) for r in got if r.reason] == [("http://other/", "unexpected_response"), ("http://s/none", "network_error")]
    assert [r.value for r in got if r.value] == ["b", "b1"]


def test_expressions_fail_at_once_and_pages_as_rows(spark, pages):
    for f in (lambda: extract(pages, "//a["), lambda: edges(pages, "//a[")):
        with pytest.raises(XPathError):
            f()
    found = extract(pages, "if (count(//a) = 2) then error() else 1", yield_errors=True).collect()
    assert sorted((r.url, r.value, r.error is None) for r in found if r.error) == [("http://s/", None, False), ("http://s/b", None, False)]
    assert extract(pages, "if (count(//a) = 2) then error() else 1").count() == 3
    assert edges(pages, "//a/@href[if (count(//a) = 2) then error() else true()]").count() == 1


def test_registered_hooks(spark, pages, monkeypatch):
    monkeypatch.setattr(crawls, "REGISTERED", {})

    @crawls.register
    class Marked(Hooks):
        def post_extract(self, value):
            return f"{value}!"

    crawls.register(Marked)
    crawls.register(Marked())
    crawls.pipe_post_extract(lambda v: None if v.startswith("b") else v.upper())
    assert len(crawls.REGISTERED) == 2
    assert values(crawl(spark, PROGRAM, pages, 1)) == ["A!"]
    assert values(crawl(spark, PROGRAM, pages, 1, hooks=[])) == ["a", "b"]
    assert crawls.Piped(lambda v: v + 1, lambda v: None, lambda v: v + 1).post_extract(1) is None


def test_strategies(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", None)], "host string, latency double")
    each = [politeness.AutoThrottle(), politeness.FixedDelay(3.0, (("a", 1.0),)), politeness.NoDelay()]
    got = df.select(*(s.delay(F.col("host"), F.col("latency")).alias(f"d{k}") for k, s in enumerate(each))).collect()
    assert [tuple(r) for r in got] == [(0.5, 1.0, 0.0), (0.25, 3.0, 0.0)]
    r = politeness.Retry(2, (503,))
    got = spark.range(1).select(r.again(F.lit(503), F.lit(False), F.lit(1)).alias("a"), r.again(F.lit(500), F.lit(False), F.lit(0)).alias("b"), r.again(F.lit(200), F.lit(True), F.lit(2)).alias("c"), r.wait(F.lit(3)).alias("w")).first()
    assert tuple(got) == (True, False, False, 4.0)


def test_smoothing_and_numbering(spark):
    rows = [(k % 2, k, float(k * 7 % 5)) for k in range(40)]
    df = spark.createDataFrame(rows, "g int, at int, v double")
    for start in (None, 0.0, 2.5):
        got = {r.g: r.smoothed for r in politeness.smoothed_by(df, "g", ["at"], "v", 0.7, start).collect()}
        for g in (0, 1):
            s = start
            for _, _, v in (r for r in rows if r[0] == g):
                s = v if s is None else 0.7 * s + 0.3 * v
            assert got[g] == pytest.approx(s)
    got = records.numbered(df.repartition(5), "n", "v", "at").orderBy("n").collect()
    assert [(r.v, r.at) for r in got] == sorted((v, at) for _, at, v in rows) and [r.n for r in got] == list(range(1, 41))
    t = spark.createDataFrame([("10",), ("9",), ("x",), (None,)], "c string")
    assert [r.c for r in records.sorted_by(t, "c").collect()] == ["9", "10", None, "x"]
    assert [r.c for r in records.sorted_by(t, "c", again="c").collect()] == ["x", None, "10", "9"]


def test_settings(tmp_path):
    at = tmp_path / "x" / "settings.json"
    assert load(at) == DEFAULTS and not DEFAULTS.problems() and DEFAULTS.target() == 4.0
    save(Settings(concurrency=3), at)
    assert load(at).concurrency == 3
    at.write_text(json.dumps({"concurrency": 0, "per_host": 5, "verify_ssl": "no", "timeout": True, "unknown": 1, "headers": {"A": "b"}}))
    assert load(at) == Settings(per_host=5, headers={"A": "b"})
    for bad in ("no json", "[1]"):
        at.write_text(bad)
        assert load(at) == DEFAULTS
    with pytest.raises(ValueError, match="concurrency"):
        save(Settings(concurrency=999), at)
    assert Settings().merged_headers({"user-agent": "x"}, {"B": "1"}) == {"user-agent": "x", "B": "1"}


def test_log_lines(caplog):
    with caplog.at_level(logging.INFO):
        log("webloom.test", depth=1).bound(url="http://s/").info("done", text="two words", n=3)
    assert caplog.messages == ['done depth=1 url=http://s/ text="two words" n=3']


def test_cache(spark, pages, tmp_path):
    at = str(tmp_path / "cache")
    store(pages.where("url like '%/a%'").select("url", F.lit("<h1>kept</h1>").alias("html"), F.lit(200).alias("status"), F.lit("GET").alias("method")), at, F.timestamp_seconds(F.lit(1000)))
    store(pages.limit(1).select(F.lit("http://s/b").alias("url"), F.lit("<h1>posted</h1>").alias("html"), F.lit(200).alias("status"), F.lit("POST").alias("method")), at, F.timestamp_seconds(F.lit(1000)))
    cache = spark.read.parquet(at)
    got = {r.url: (r.html, r.cached) for r in through_cache(pages, cache, F.timestamp_seconds(F.lit(2000))).collect()}
    assert got["http://s/a"] == got["http://s/a1"] == ("<h1>kept</h1>", True) and got["http://s/b"] == (page("b"), False)
    assert fresh(cache, F.timestamp_seconds(F.lit(10_000_000))).count() == 0


class Answers(BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):
        Answers.asked.append((self.path, self.headers.get("X-Test")))
        name = self.path[1:]
        code = 404 if name not in SITE else 503 if name == "b1" and sum(p == "/b1" for p, _ in Answers.asked) == 1 else 200
        body = page(name).replace("http://s/", "/").encode() if code == 200 else b""
        self.send_response(code)
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    Answers.asked = []
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_live_pages(spark, server, tmp_path):
    urls = spark.createDataFrame([(f"{server}/a",), (f"{server}/a",), (f"{server}/x",), ("http://127.0.0.1:9/",), (None,)], "url string")
    got = {r.url.removeprefix(server): r for r in fetch(urls, headers={"X-Test": "1"}, retries=1).collect()}
    assert got["/a"].html == page("a").replace("http://s/", "/") and got["/a"].status == 200 and got["/a"].response_end >= got["/a"].request_start
    assert got["/x"].status == 404 and got["http://127.0.0.1:9/"].error and {t for _, t in Answers.asked} == {"1"}
    program = f"url('{server}/')///url(//a/@href)//h1/string()"
    rows = crawl(spark, program, fetch, 3, yield_errors=True).orderBy("depth", "path").collect()
    assert [r.value or r.reason for r in rows] == ["a", "b", "a1", "b1", "bad_status"]
    Answers.asked = []
    args = [program, "--depth", "3", "--header", "X-Test: cli", "--concurrency", "4", "--concurrency-per-host", "2", "--insecure", "--cache", str(tmp_path / "cache"), "--progress", "--limit", "3"]
    out = io.StringIO()
    assert cli.main(args, spark, out) == 0
    assert [json.loads(x)["value"] for x in out.getvalue().splitlines()] == ["a", "b", "a1"] and {t for _, t in Answers.asked} == {"cli"}
    before = len(Answers.asked)
    assert cli.main(args, spark, io.StringIO()) == 0
    assert {p for p, _ in Answers.asked[before:]} <= {"/none"}  # all else is in the cache
    with pytest.raises(SystemExit):
        cli.settings_of(cli.arguments(["x", "--concurrency", "0"]))
