import pytest
from pyspark.sql import functions as F

from webloom.functions.xpath import ContextRequired, XPathError
from webloom.operators.crawl import Hooks, crawl, crawl_levels, edges, extract

T = "http://test/"


def web(spark, pages, **columns):
    rows = [(u if u.startswith("http") else T + u, h) for u, h in pages.items()]
    return spark.createDataFrame(rows, "url string, html string")


def links(*hrefs, main=False):
    inner = "".join(f"<a href='{h}'>{h[:1].upper()}{h[1:2].strip('.')}</a>" for h in hrefs)
    return f"<html><body>{'<main>' if main else ''}{inner}{'</main>' if main else ''}</body></html>"


LEAF = "<html><body><p>leaf</p></body></html>"
F10 = {"": links("a.html", "b.html"), "a.html": links("a1.html"), "b.html": links("b1.html"), "a1.html": LEAF, "b1.html": LEAF}
F11 = F10 | {"a1.html": links("a2.html"), "b1.html": links("b2.html")}


def run(spark, program, pages, depth=1, **kw):
    table = web(spark, pages) if isinstance(pages, dict) else pages
    return crawl(spark, program, table, max_depth=depth, **kw).orderBy("depth", "path").collect()


def reached(rows):
    return [(r.depth, r.url.removeprefix(T)) for r in rows]


def test_seed(spark):
    rows = run(spark, f"url('{T}')", {"": LEAF}, 2)
    assert reached(rows) == [(0, "")] and rows[0].value == LEAF and rows[0].backlink is None


def test_one_hop_and_backlink(spark):
    rows = run(spark, f"url('{T}')//url(//@href)", F10)
    assert reached(rows) == [(1, "a.html"), (1, "b.html")] and {r.backlink for r in rows} == {T}


@pytest.mark.parametrize("slashes", ["", "/", "//", " / ", "//\t"])
def test_all_single_hops_are_alike(spark, slashes):
    assert reached(run(spark, f"url('{T}'){slashes}url(//@href)", F10)) == [(1, "a.html"), (1, "b.html")]


def test_follow_emits_the_seed(spark):
    nxt = lambda h: f"<html><body><a class='next' href='{h}'>n</a><a href='x.html'>x</a></body></html>"
    pages = {"": nxt("a.html"), "a.html": nxt("b.html"), "b.html": "<html><body><a href='x.html'>x</a></body></html>", "x.html": LEAF}
    want = [(0, ""), (1, "a.html"), (2, "b.html")]
    assert reached(run(spark, f"url('{T}', follow=//a[@class='next']/@href)", pages, 2)) == want
    assert reached(run(spark, f"url('{T}', depth=1, follow=//a[@class='next']/@href)", pages, 9)) == want[:2]
    assert reached(run(spark, f"url('{T}', follow=//a[@class='next']/@href, depth=2)", pages, 0)) == want


def test_scoped_links(spark):
    pages = {"": "<html><body><main><a href='a1.html'>1</a><a href='a2.html'>2</a><a href='http://different/a3.html'>3</a></main><a href='b.html'>b</a></body></html>", "a1.html": LEAF, "a2.html": LEAF, "b.html": LEAF, "http://different/a3.html": LEAF}
    want = [(1, "a1.html"), (1, "a2.html"), (1, "http://different/a3.html")]
    for program in ("//url(//main//a/@href)", "//main//a/url(@href)", "//main//a/@href/url(.)"):
        assert reached(run(spark, f"url('{T}'){program}", pages)) == want


def test_two_hops_and_raw_values(spark):
    pages = {"": links("lvl1.html"), "lvl1.html": links("lvl2.html"), "lvl2.html": links("lvl3.html"), "lvl3.html": LEAF}
    assert reached(run(spark, f"url('{T}')//url(//@href)//url(//@href)", pages, 2)) == [(2, "lvl2.html")]
    assert [r.value for r in run(spark, f"url('{T}')//url(//@href)//url(//@href)//a/@href", pages, 2)] == ["lvl3.html"]
    assert run(spark, f"url('{T}')//url(//@href)//url(//@href)//a/@href", pages, 1) == []
    assert [r.value for r in run(spark, f"url('{T}')//url(//@href)//a/@href", F10)] == ["a1.html", "b1.html"]


def test_filtered_hop(spark):
    pages = {"": links("lvl1a.html", "lvl1b.html"), "lvl1a.html": links("lvl2.html"), "lvl1b.html": links("lvl99999.html"), "lvl2.html": links("lvl3.html"), "lvl99999.html": LEAF}
    assert reached(run(spark, f"url('{T}')//url(//@href[starts-with(., 'lvl1a')])//url(//@href)", pages, 2)) == [(2, "lvl2.html")]


def test_closure(spark):
    want = [(1, "a.html"), (1, "b.html"), (2, "a1.html"), (2, "b1.html")]
    assert reached(run(spark, f"url('{T}')///url(//@href)", F10, 9999)) == want
    assert reached(run(spark, f"url('{T}')///url(//@href)", F10, 1)) == want[:2]
    assert run(spark, f"url('{T}')///url(//@href)", F10, 0) == []
    values = [r.value for r in run(spark, f"url('{T}')///url(//@href)//a/@href", F11, 2)]
    assert values == ["a1.html", "b1.html", "a2.html", "b2.html"]
    assert [r.value for r in run(spark, f"url('{T}')///url(//@href)//a/@href", F11, 1)] == values[:2]


def test_cycles_and_repeated_links(spark):
    pages = {"": links("a.html", "a.html", "", "b.html"), "a.html": links("a.html", T, "b.html"), "b.html": links("a.html")}
    assert reached(run(spark, f"url('{T}')///url(//@href)", pages, 50)) == [(1, "a.html"), (1, "b.html")]


def test_records(spark):
    rows = run(spark, f"url('{T}')///url(//@href)/map{{'link_text': string((//a/text())[1]), 'n': count(//a), 'none': //h9/text()}}", F11, 2, schema="link_text string, n int, none array<string>")
    assert [(r.value.link_text, r.value.n, r.value.none) for r in rows] == [("A1", 1, []), ("B1", 1, []), ("A2", 1, []), ("B2", 1, [])]
    assert run(spark, f"url('{T}')/map{{'a': array{{1, 'x'}}, 'b': ()}}", F11)[0].value == '{"a": [1, "x"], "b": []}'


def test_generated_seeds(spark):
    pages = {"1": LEAF, "2": LEAF, "3": LEAF}
    assert reached(run(spark, f"(1 to 3) ! ('{T}' || .) ! url(.)", pages)) == [(0, "1"), (0, "2"), (0, "3")]
    assert reached(run(spark, f"('{T}3', '{T}1', '{T}3') ! url(.)", pages)) == [(0, "3"), (0, "1")]


def test_scoped_closure(spark):
    pages = {"": links("a.html", main=True), "a.html": links("a1.html", main=True), "a1.html": links("a2.html")}
    assert reached(run(spark, f"url('{T}')///url(//main/a/@href)", pages, 2)) == [(1, "a.html"), (2, "a1.html")]


def test_first_claim_wins(spark):
    # b.html is claimed by the hop after the page's tail, so the closure doesn't go on through it
    pages = {"": links("a.html"), "a.html": links("b.html"), "b.html": links("c.html"), "c.html": LEAF}
    rows = run(spark, f"url('{T}')///url(//@href)//url(//@href)", pages, 9)
    assert reached(rows) == [(2, "b.html")]


def test_redirects(spark):
    pages = spark.createDataFrame([(T, LEAF, 301)], "url string, html string, status int")
    assert len(run(spark, f"url('{T}')", pages)) == 1
    assert run(spark, f"url('{T}')", pages, allow_redirects=False) == []
    assert len(run(spark, f"url('{T}')", pages.withColumn("status", F.lit(418)), allowed_codes=(418,))) == 1


def test_errors(spark):
    rows = [(T, links("n.html", "s.html", "e.html", "m.html", "ok.html"), 200, None), (T + "n.html", None, 0, "ConnectionError"), (T + "s.html", "x", 404, None), (T + "e.html", "", 200, None), (T + "ok.html", LEAF, 200, None)]
    pages = spark.createDataFrame(rows, "url string, html string, status int, error string")
    got = {r.url.removeprefix(T): (r.reason, r.status, r.exception) for r in run(spark, f"url('{T}')//url(//@href)", pages, yield_errors=True)}
    assert got == {"n.html": ("network_error", 0, "ConnectionError"), "s.html": ("bad_status", 404, None), "e.html": ("bad_status", 200, None), "m.html": ("network_error", 0, "not in the corpus"), "ok.html": (None, 200, None)}
    assert reached(run(spark, f"url('{T}')//url(//@href)", pages)) == [(1, "ok.html")]
    bad = run(spark, f"url('{T}')/error('boom')", pages, yield_errors=True)
    assert bad[0].reason == "page_error" and "boom" in bad[0].exception


class _Shout(Hooks):
    def post_extract(self, value):
        return value.upper() if "1" in value else None


class _OnlyA(Hooks):
    def post_fetch(self, page, html):
        return html if page.depth == 0 or "/a" in page.url else None

    def post_parse(self, page, document):
        return document if document.named("body") else None


def test_hooks(spark):
    assert [r.value for r in run(spark, f"url('{T}')///url(//@href)//a/@href", F11, 2, hooks=[_OnlyA(), _Shout()])] == ["A1.HTML"]


def test_robots_and_seen(spark):
    rules = spark.createDataFrame([("test", "User-agent: *\nDisallow: /a")], "host string, robots_txt string")
    rows = run(spark, f"url('{T}')//url(//@href)", F10, robots=rules, yield_errors=True)
    assert [(r.url.removeprefix(T), r.reason, r.status) for r in rows] == [("a.html", "network_error", 403), ("b.html", None, 200)]
    seen = spark.createDataFrame([(T + "b.html",)], "url string")
    assert reached(run(spark, f"url('{T}')//url(//@href)", F10, seen=seen)) == [(1, "a.html")]
    assert run(spark, f"url('{T}b.html')", F10, seen=seen) == []


def test_levels_and_partitions(spark):
    pages = web(spark, F11)
    levels = list(crawl_levels(spark, f"url('{T}')///url(//@href)", pages, 2))
    assert [x.where("kind = 'data'").count() for x in levels] == [0, 2, 2]
    once = [(r.depth, r.url, r.path) for r in run(spark, f"url('{T}')///url(//@href)", pages, 2)]
    again = [(r.depth, r.url, r.path) for r in run(spark, f"url('{T}')///url(//@href)", pages.repartition(7), 2)]
    assert once == again


def test_extract_and_edges(spark):
    pages = web(spark, F10 | {"empty": "", "null": None})
    assert sorted((r.url.removeprefix(T), r.pos, r.value) for r in extract(pages, "//a/@href").collect()) == [("", 0, "a.html"), ("", 1, "b.html"), ("a.html", 0, "a1.html"), ("b.html", 0, "b1.html")]
    assert {r.dst for r in edges(pages).collect()} == {T + x for x in ("a.html", "b.html", "a1.html", "b1.html")}
    plan = extract(pages, "//a/@href")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan
    assert issubclass(ContextRequired, XPathError)
