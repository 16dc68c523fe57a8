import io
import json

import pytest
from pyspark.sql import functions as F

from webloom import cli
from webloom.functions.pages import is_internal, is_internal_column, root_domain, root_domain_column
from webloom.operators import politeness, records
from webloom.operators.crawl import extract
from webloom.sources.tables import cache_key, fresh
from webloom.streaming import live

URLS = ["http://a.b.example.com/x", "http://www.ex.co.uk/?a=1", "http://localhost:80/", "nope", "https://x.travel.de#f", ""]


def test_domains_as_columns(spark):
    df = spark.createDataFrame([(u, h) for u in URLS for h in ("/x", "http://ex.co.uk/", "https://other.org", "http://sub.example.com/")], "url string, href string")
    for r in df.select("url", "href", root_domain_column(F.col("url")).alias("d"), is_internal_column(F.col("href"), F.col("url")).alias("i")).collect():
        assert r.d == root_domain(r.url) and r.i == is_internal(r.href, r.url), r


@pytest.mark.parametrize(
    "text,agent,url,ok",
    [("User-agent: *\nDisallow: /p", "x", "http://h/p/1", False), ("User-agent: *\nDisallow: /p", "x", "http://h/q", True), (None, "x", "http://h/q", True), ("", "x", "http://h/q", True), ("User-agent: bad\nDisallow: /", "bad", "http://h/", False), ("User-agent: bad\nDisallow: /", "good", "http://h/", True), (None, "x", "no host", False)],
)
def test_robots(text, agent, url, ok):
    assert politeness.allowed(text, agent, url) is ok


def test_delays(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert [get(politeness.backoff(F.lit(n))) for n in (0, 1, 3, 10)] == [0.5, 1.0, 4.0, 30.0]
    assert get(politeness.backoff(F.lit(2), jitter=F.lit(0.7))) == pytest.approx(1.4)
    assert [get(politeness.throttle_delay(F.lit(x))) for x in (-1.0, 2.0, 400.0)] == [0.0, 0.5, 10.0]
    samples = F.array(F.lit(1.0), F.lit(2.0))
    assert get(politeness.smoothed(samples, 0.7, 0.0)) == pytest.approx(0.7 * 0.3 + 0.3 * 2)
    assert get(politeness.smoothed(samples, 0.7)) == pytest.approx(0.7 + 0.3 * 2)
    assert get(politeness.smoothed(F.array().cast("array<double>"), 0.7)) is None
    retry = lambda status, failed, n: get(politeness.should_retry(F.lit(status), F.lit(failed), F.lit(n)))
    assert [retry(503, False, 0), retry(404, False, 0), retry(None, True, 2), retry(503, False, 3)] == [True, False, True, False]


def test_cache(spark):
    rows = [("http://h/p?utm_source=x&a=1&fbclid=2#f", "http://h/p?a=1#f"), ("http://h/p?fbclid=2", "http://h/p"), ("http://h/p?a=1&utm_medium=m", "http://h/p?a=1"), ("http://h/p?x_utm_a=1", "http://h/p?x_utm_a=1"), ("http://h/", "http://h/")]
    for r in spark.createDataFrame(rows, "url string, want string").withColumn("key", cache_key(F.col("url"))).collect():
        assert r.key == r.want
    cache = spark.createDataFrame([("http://h/a", "2020-01-08 12:00:00", 200, "new"), ("http://h/a?fbclid=1", "2020-01-07", 200, "old"), ("http://h/b", "2020-01-01", 200, "stale"), ("http://h/c", "2020-01-08", 404, "bad")], "url string, at string, status int, html string")
    got = fresh(cache.withColumn("fetched_at", F.to_timestamp("at")), F.to_timestamp(F.lit("2020-01-09"))).collect()
    assert [(r.key, r.html) for r in got] == [("http://h/a", "new")]


def test_records(spark, tmp_path):
    df = spark.createDataFrame([("t", "u", 1), (None, "v", 2)], "text string, source string, n int")
    got = [(r.page_content, r.metadata) for r in records.documents(df).collect()]
    assert got[0] == ("t", {"source": "u", "n": "1"}) and json.loads(got[1][0]) == {"source": "v", "n": 2}
    docs = spark.createDataFrame([(1, "x" * 2500), (2, ""), (3, None), (4, "y" * 200), (5, "z" * 1000), (6, "z" * 1001)], "id int, text string")
    pieces = {}
    for r in records.chunks(docs).orderBy("id", "chunk_no").collect():
        pieces.setdefault(r.id, []).append(len(r.chunk))
    assert pieces == {1: [1000, 1000, 900], 4: [200], 5: [1000], 6: [1000, 201]}
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 3, "new"), ("b", 2, "b"), ("c", 1, "c")], "url string, at int, text string")
    assert [(r.url, r.text) for r in records.rolling_latest(rows, "url", "at", 2).orderBy(F.desc("at")).collect()] == [("a", "new"), ("b", "b")]
    cells = spark.createDataFrame([(v,) for v in ("10", "9", "x", None, "1e1", "a")], "v string")
    assert [r.v for r in cells.orderBy(*records.numeric_order(F.col("v")), "v").collect()] in (["9", "10", "1e1", None, "a", "x"], ["9", "1e1", "10", None, "a", "x"])
    assert records.is_numeric(["1", "x", None]) and not records.is_numeric(["x", "y", "1"]) and not records.is_numeric([])
    for _ in range(2):
        records.write_ndjson(df, str(tmp_path / "nd"))
    assert spark.read.json(str(tmp_path / "nd")).count() == 4
    nested = df.withColumn("l", F.array("n"))
    records.write_csv(nested, str(tmp_path / "csv"))
    assert {r.l for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"[1]", "[2]"}
    records.write_json_cells(df, str(tmp_path / "cells"))
    assert dict(spark.read.json(str(tmp_path / "cells")).dtypes)["n"] == "string"


PAGES = [("http://s/", "<a href='a'>A</a>"), ("http://s/a", "<h1>x</h1><a href='/'>home</a>")]


def test_cli(spark, tmp_path):
    spark.createDataFrame(PAGES, "url string, html string").write.parquet(str(tmp_path / "pages"))
    out = io.StringIO()
    assert cli.main(["url('http://s/')///url(//a/@href)/map{'t': string(//h1)}", "--pages", str(tmp_path / "pages"), "--depth", "3"], spark, out) == 0
    assert [json.loads(x) for x in out.getvalue().splitlines()] == [{"depth": 1, "url": "http://s/a", "backlink": "http://s/", "value": {"t": "x"}}]


def test_streams(spark, tmp_path):
    pages = spark.createDataFrame([*PAGES, PAGES[0]], "url string, html string")
    pages.write.parquet(str(tmp_path / "pages"))
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "pages"))
    live.extract_stream(stream, "//a/@href").writeStream.format("memory").queryName("hrefs").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination(120)
    want = sorted(map(tuple, extract(pages.distinct(), "//a/@href").collect()))
    assert sorted(map(tuple, spark.table("hrefs").collect())) == want
    spark.createDataFrame([("http://s/",)], "url string").write.parquet(str(tmp_path / "seeds"))
    seeds = spark.readStream.schema("url string").parquet(str(tmp_path / "seeds"))
    live.crawl_stream(spark, seeds, "url('.')//url(//a/@href)//h1/text()", pages, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination(120)
    assert [(r.url, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("http://s/a", "x")]


def test_throttle_stream(spark, tmp_path):
    spark.createDataFrame([("http://h/1", 1, 8.0), ("http://h/2", 2, 4.0), ("http://k/", 1, 100.0)], "url string, at int, latency double").write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema("url string, at int, latency double").parquet(str(tmp_path / "log"))
    live.throttle_stream(log).writeStream.format("memory").queryName("delays").outputMode("update").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination(120)
    got = {r.host: (r.latency, r.delay) for r in spark.table("delays").collect()}
    assert got["h"] == (pytest.approx(6.8), pytest.approx(1.7)) and got["k"] == (100.0, 10.0)
