"""What lets a crawl grow: pages are parsed fast, dealt out evenly and joined once."""

from pyspark.sql import functions as F

from webloom import queries as engine
from webloom.functions.html_tree import _Builder, _scan, parse_html
from webloom.operators.crawl import crawl
from webloom.sources import tables
from webloom.sources.site import HOST

PAGE = "<html><head><title>T &amp; t</title></head><body class='b'><h1>T</h1><!-- c --><p>one<p>two<a class='down' href='/x'>X</a><a class='next' href=\"/y\">Y</a><ul><li>1<li>2</ul></body></html>"


def nodes(document):
    return [(n.kind, n.name, n.value, n.order, [(a.name, a.value, a.order) for a in n.attributes]) for n in document.walk()]


def test_the_fast_tree_is_the_tree():
    for html in (PAGE, PAGE[:59], PAGE.replace("</h1>", "</h1><html lang='en'>"), PAGE.replace("</p>", "") + "end"):
        slow = _Builder()
        slow.feed(html)
        slow.close()
        assert _scan(html) is not None
        assert [x[:3] for x in nodes(parse_html(html))] == [x[:3] for x in nodes(slow.document)]
        assert [x[3] for x in nodes(parse_html(html))] == sorted({x[3] for x in nodes(parse_html(html))})
    assert _scan("<script>a < b</script>") is None and _scan("<p") is None


def test_texts_and_attributes_hold_no_lists():
    kinds = {n.kind: n for n in parse_html(PAGE).walk()}
    assert kinds["text"].children == () and kinds["element"].children != ()


def test_pages_of_a_kind_are_dealt_out(spark):
    nations = engine.site(spark, "/root/testdata/sf0.001").where(F.col("url").startswith(f"{HOST}/nation/"))
    assert nations.count() == 25 and nations.select(F.input_file_name()).distinct().count() > 1


def test_a_large_frontier_is_joined_once(spark, monkeypatch):
    pages = spark.createDataFrame([("http://s/", "<a href='/a'>a</a><a href='/none'>n</a>"), ("http://s/a", "<h1>A</h1>")], "url string, html string")
    got = lambda: [tuple(r) for r in crawl(spark, "url('http://s/')///url(//a/@href)//h1/string()", pages, 1, yield_errors=True).orderBy("depth", "path").collect()]
    want = got()
    monkeypatch.setattr(tables, "BROADCAST_ROWS", -1)
    assert got() == want and [(r[2], r[5]) for r in want] == [("http://s/a", None), ("http://s/none", "network_error")]
