"""Queries on pages of which several have one URL, or text that is cut within a character reference, against their SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from webloom import queries as engine
from webloom.functions.html_tree import parse_html

PAGES = [
    (0, "http://h.example.org/a", "<html><head><title>A &amp; b</title></head><body><h1>A &amp; b</h1><nav><a href=\"/one\">1</a><a href=\"/two\">2</a></nav></body></html>"),
    (1, "http://h.example.org/a", "<html><head><title>C d</title></head><body><h1>C d</h1><nav><a href=\"/one\">1</a><a href=\"/three-and-more\">3</a></nav></body></html>"),
    (2, "http://h.example.org/b#top", "<html><head><title>E &copy; f&amp</title></head><body><h1>E &copy; f&amp</h1><nav><a href=\"/x\">x</a></nav></body></html>"),
    (3, "http://h.example.org/b#top", "<html><head><title>G</title></head><body><h1>G</h1><nav><a href=\"/x\">x</a></nav></body></html>"),
    (4, "http://h.example.org/c", "<html><head><title>None</title></head><body><h1>None</h1></body></html>"),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("pages")
    ids, urls, html = zip(*PAGES)
    pq.write_table(pa.table({"page_id": pa.array(ids, pa.int64()), "url": urls, "html": html}), at / "pages.parquet")
    return at


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{folder}/pages.parquet')")
    want = con.execute(engine.ORACLE_SQL[name]).to_arrow_table()
    got = engine.QUERIES[name](spark, str(folder)).toArrow()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    rows = lambda t: sorted((tuple(r[c] for c in columns) for r in t.to_pylist()), key=repr)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["fetch_times", "redirects_refused", "status_filter", "hooked", "page_link_lengths", "page_link_some", "page_link_sorted", "page_links_distinct"])
def test_rows_of_one_url(spark, folder, name):
    same_as_sql(spark, folder, name)


@pytest.mark.parametrize("name", ["loader_documents", "page_headings", "page_title_masked", "page_title_parts", "page_title_tokens", "page_titles"])
def test_references_that_are_cut(spark, folder, name):
    same_as_sql(spark, folder, name)


def test_what_is_a_reference():
    text = lambda html: parse_html(html).text()
    assert text("<p>&amp &am &a &copy= &notit; &amp;amp &quot;&lt;&#38;&#x41;") == "&amp &am &a &copy= &notit; &amp \"<&A"
    assert parse_html("<a href='/x?a=1&copy=2&amp;b=&amp'>").named("a")[0].get("href") == "/x?a=1&copy=2&b=&amp"
    assert text("<script>a&b && c&amp</script><p>﷐&am") == "a&b && c&amp﷐&am"
