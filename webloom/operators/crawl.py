"""Programs over a corpus of pages: extraction of each page, and traversal along links.

A crawl is a breadth-first loop. The pages to visit at a depth are a table of URLs; they are joined to the corpus, each page is
parsed once and yields values and links, and the links that no earlier page claimed are the next table. All tables are written to
the shared folder, so that lineage is one level deep and a lost executor costs one level at most.

The order of a row is its path: at which place on each page, from the seed on, the link that led here stood. Paths of one depth compare
like the queue of a single crawler, so the first to claim a URL is the same on any cluster.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.html_tree import Node, parse_html
from ..functions.xpath import Page, XArray, XMap, compiled, evaluate, text_of
from ..functions.xpath_functions import plain
from ..plans.language import Closure, Extract, Hop, Program, Seed, parse
from ..sources import tables
from ..sources.tables import corpus as corpus_of
from ..sources.tables import written

REDIRECTS = (301, 302, 303, 307, 308)


class Hooks:
    """What may look at or change pages and values on their way. None (or nothing) drops them."""

    def post_fetch(self, page: Page, html: str) -> str | None:
        return html

    def post_parse(self, page: Page, document: Node) -> Node | None:
        return document

    def post_extract(self, value: object) -> object | None:
        return value


#: Hooks that crawl() uses when it is given none, by name, in the order in which they came.
REGISTERED: dict[str, Hooks] = {}


def register(hook: Hooks | type[Hooks]):
    """Adds a hook, or an instance of a class of hooks, unless one of that name is there. Returns what it was given, so that it decorates."""
    REGISTERED.setdefault(getattr(hook, "__name__", type(hook).__name__), hook() if isinstance(hook, type) else hook)
    return hook


class Piped(Hooks):
    """Values through functions, one after the other; None drops a value."""

    def __init__(self, *functions: Callable[[object], object | None]):
        self.functions = functions

    def post_extract(self, value: object) -> object | None:
        for f in self.functions:
            if value is None:
                return None
            value = f(value)
        return value


def pipe_post_extract(f: Callable[[object], object | None]) -> Callable[[object], object | None]:
    """Registers a function of values as a hook under the function's name."""
    REGISTERED.setdefault(f.__name__, Piped(f))
    return f


def as_text(x: object) -> str | None:
    """An item as it stands in a column: elements as markup, maps and arrays as JSON, all else as text."""
    if isinstance(x, Node):
        return x.html() if x.kind in ("element", "document") else x.text()
    if isinstance(x, (XMap, XArray, dict, list)):
        return json.dumps(plain([x]) if isinstance(x, (XMap, XArray)) else x, ensure_ascii=False)
    return None if x is None else text_of(x)


@dataclass(slots=True)
class _Row:
    kind: str
    value: str | None = None
    link: str | None = None
    pc: int = 0
    expand: int = -1


#: A URL and a path of it that urljoin() would only put together.
_SITE = re.compile(r"(https?://[A-Za-z0-9.-]+(?::[0-9]+)?)(?:[/?#]|$)").match
_PATH = re.compile(r"(?:/[A-Za-z0-9_-]+)+").fullmatch


def _links(scope: str | None, links: str, item: Node, page: Page, memo: dict) -> Iterator[str]:
    """Absolute URLs that an operator selects, each once, in order. Empty ones are left out."""
    seen, site = set(), _SITE(page.url)
    for at in evaluate(scope, item, page, memo=memo) if scope else [item]:
        for x in evaluate(links, at, page, memo=memo) if links != "." else [at]:
            href = text_of(x)
            if href and href not in seen:
                seen.add(href)
                if site and _PATH(href):
                    yield site[1] + href
                    continue
                try:
                    yield urljoin(page.url, href)
                except ValueError:  # a link that can't be resolved leads nowhere
                    continue


def run_page(program: Program, pc: int, expand: int, page: Page, document: Node, follow: bool = True) -> list[_Row]:
    """Values and links of a page that was reached at step pc; expand is the closure (its step, or -2 for the seed's follow) that
    goes on from here, -1 for none. Without follow no links are looked for. What follows a page comes before what extends the closure."""
    memo: dict = {}
    out: list[_Row] = []
    steps = program.steps
    root = next((n for n in document.children if n.kind == "element"), document)
    if pc == len(steps):
        out.append(_Row("data", as_text(root)))
    else:
        step = steps[pc]
        if isinstance(step, Extract):
            out += [_Row("data", as_text(x)) for x in evaluate(step.expression, root, page, memo=memo)]
        elif follow:
            again = pc if isinstance(step, Closure) else -1
            out += [_Row("link", link=u, pc=pc + 1, expand=again) for u in dict.fromkeys(_links(step.scope, step.links, root, page, memo))]
    if expand != -1 and follow:
        xp = program.start.follow if expand == -2 else steps[expand].links
        out += [_Row("link", link=u, pc=pc, expand=expand) for u in dict.fromkeys(_links(None, xp, root, page, memo))]
    return out


_OUT = "kind string, url string, depth int, backlink string, path array<int>, value string, link string, pc int, expand int, reason string, status int, exception string"
_IN = ["url", "html", "depth", "backlink", "path", "pc", "expand", "status", "latency", "reason", "exception"]


def _page_function(program: Program, hooks: Sequence[Hooks], max_depth: int) -> Callable:
    needs_tree = program.needs_tree() or bool(hooks)

    def rows(r: dict) -> Iterator[tuple]:
        if r["reason"] is not None:  # the page couldn't be had
            yield ("error", r["url"], r["depth"], r["backlink"], r["path"], None, None, 0, -1, r["reason"], r["status"] or 0, r["exception"])
            return
        page = Page(r["url"], r["depth"], r["backlink"], r["status"], r["latency"])
        base = (page.url, page.depth, page.backlink)
        html = r["html"]
        try:
            for h in hooks:
                html = h.post_fetch(page, html)
                if not html:
                    return
            document = parse_html(html) if needs_tree else Node("document")
            for h in hooks:
                document = h.post_parse(page, document)
                if document is None:
                    return
            k = 0
            for x in run_page(program, r["pc"], r["expand"], page, document, page.depth < max_depth):
                value = x.value
                if x.kind == "data":
                    for h in hooks:
                        value = h.post_extract(value)
                        if value is None:
                            break
                    if value is None:
                        continue
                yield (x.kind, *base, [*r["path"], k], value if value is None or isinstance(value, str) else as_text(value), x.link, x.pc, x.expand, None, page.status, None)
                k += 1
        except Exception as e:  # a page that can't be read is an error row, not the end of the job
            yield ("error", *base, r["path"], None, None, 0, -1, "page_error", page.status, f"{type(e).__name__}: {e}")

    return rows


def _in_arrow(rows: Callable, schema: StructType) -> Callable:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[tuple] = []
            # one page's text at a time: a few may be as large as all others
            for r, html in zip(b.drop_columns("html").to_pylist(), b.column("html")):
                r["html"] = html.as_py()
                for x in rows(r):
                    held.append(x)
                    if len(held) >= 10_000:
                        yield _batch(held, arrow)
                        held = []
            if held:
                yield _batch(held, arrow)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def extract(pages: DataFrame, expression: str, schema: str | None = None, yield_errors: bool = False) -> DataFrame:
    """url, pos, value: what an XPath expression yields on each page, one row an item. With schema (DDL), value is a record of it.

    Only url and html of pages are read. An expression that can't be parsed is an error at once. Null or empty pages yield nothing, and so
    do pages on which the expression fails, unless yield_errors asks for a column error, with a row (null pos and value) for each.
    """
    compiled(expression)
    kind = StructType.fromDDL("url string, pos int, value string, error string")

    def rows(r: dict) -> Iterator[tuple]:
        if not r["html"]:
            return
        try:
            items = evaluate(expression, parse_html(r["html"]), Page(r["url"] or ""), memo={})
            yield from [(r["url"], k, as_text(x), None) for k, x in enumerate(items)]
        except Exception as e:
            if yield_errors:
                yield (r["url"], None, None, f"{type(e).__name__}: {e}")

    out = pages.select("url", "html").mapInArrow(_in_arrow(rows, kind), kind)
    out = out.withColumn("value", F.from_json("value", schema)) if schema else out
    return out if yield_errors else out.drop("error")


def crawl(
    spark: SparkSession,
    expression: str | Program,
    pages: DataFrame | Callable[[DataFrame], DataFrame],
    max_depth: int = 1,
    schema: str | None = None,
    yield_errors: bool = False,
    hooks: Sequence[Hooks] | None = None,
    allowed_codes: Sequence[int] = (200,),
    allow_redirects: bool = True,
    robots: DataFrame | None = None,
    user_agent: str = "*",
    seen: DataFrame | None = None,
    seeds: DataFrame | None = None,
    limit: int | None = None,
    progress: Callable[[dict], None] | None = None,
) -> DataFrame:
    """depth, path, url, backlink, value of everything that the program yields (with schema, value is a record); order by depth and path.

    pages: url and html, and optionally status, headers, error, request_start, response_end and request_url; or a function that makes such a
    table of a table of URLs, as sources.live.fetch does: it is called once a level. A depth in the program goes before
    max_depth. With yield_errors also reason, status and exception, and rows for pages that couldn't be had: network_error (not in
    the corpus, or with an error), bad_status (a code not allowed, or no body), unexpected_response (a row that answers a request by
    another URL, see corpus()), page_error. robots: host and robots_txt; seen: a table of URLs that count as visited before. seeds: a
    table of URLs to start from instead of the program's own. hooks: without any given, the registered ones. limit: so many values at
    most, the first in order; no level is visited after the one that makes them up. progress: is called after each level with its depth and
    how many values, links and errors it had.
    """
    levels, left = [], limit
    for level in crawl_levels(spark, expression, pages, max_depth, list(REGISTERED.values()) if hooks is None else hooks, allowed_codes, allow_redirects, robots, user_agent, seen, seeds):
        levels.append(level)
        if left is not None or progress:
            n = {r["kind"]: r["count"] for r in level.groupBy("kind").count().collect()}
            if progress:
                progress({"depth": len(levels) - 1, **{k: n.get(k, 0) for k in ("data", "link", "error")}})
            if left is not None:
                left -= n.get("data", 0)
                if left <= 0:
                    break
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    columns = ["depth", "path", "url", "backlink", "value"] + (["reason", "status", "exception"] if yield_errors else [])
    out = out.where(F.col("kind") == "data" if not yield_errors else F.col("kind").isin("data", "error")).select(columns)
    if limit is not None:
        out = out.orderBy("depth", "path").limit(limit)
    return out.withColumn("value", F.from_json("value", schema)) if schema else out


def crawl_levels(spark, expression, pages, max_depth=1, hooks=(), allowed_codes=(200,), allow_redirects=True, robots=None, user_agent="*", seen=None, seeds=None) -> Iterator[DataFrame]:
    """The rows of each depth, as soon as it is done, with links and errors (kind)."""
    program = expression if isinstance(expression, Program) else parse(expression)
    most = program.max_depth if program.max_depth is not None else max_depth
    codes = sorted({*allowed_codes, *(REDIRECTS if allow_redirects else ())})
    web = None if callable(pages) else corpus_of(pages)
    kind = StructType.fromDDL(_OUT)
    run = _in_arrow(_page_function(program, hooks, most), kind)
    expand = -2 if isinstance(program.start, Seed) and program.start.follow else -1
    if seeds is None:
        start = [(u, k) for k, u in enumerate(dict.fromkeys(program.seeds()))]
        seeds = spark.createDataFrame(start, "url string, k int")
    else:
        seeds = seeds.where("url is not null").select("url", F.hash("url").alias("k")).distinct()
    frontier = seeds.select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("backlink"), F.array("k").alias("path"), F.lit(0).alias("pc"), F.lit(expand).alias("expand"))
    if seen is not None:
        frontier = frontier.join(seen.select("url"), "url", "left_anti")
    frontier = written(frontier, "frontier")
    visited = frontier.select("url") if seen is None else frontier.select("url").unionByName(seen.select("url"))
    for depth in range(most + 1):
        # a small frontier goes to the corpus; which of its URLs have no page is told by URLs alone, so that no page is shuffled or broadcast
        if callable(pages):
            web = corpus_of(written(pages(frontier.select("url")), "fetched"))
        asked = frontier.withColumnRenamed("url", "asked")
        if asked.count() <= tables.BROADCAST_ROWS:
            asked = F.broadcast(asked)
            there = web.select("asked").join(asked.select("asked"), "asked", "left_semi").distinct()
            found = web.join(asked, "asked").unionByName(asked.join(there, "asked", "left_anti").withColumn("url", F.col("asked")), allowMissingColumns=True)
        else:  # pages and frontier meet by URL, once
            found = asked.join(web.withColumn("there", F.lit(True)), "asked", "left").withColumn("url", F.when(F.col("there"), F.col("url")).otherwise(F.col("asked"))).drop("there")
        if robots is not None:
            from .politeness import with_permission

            found = with_permission(found, robots, user_agent).withColumn("error", F.when(F.col("allowed"), F.col("error")).otherwise("robots.txt")).withColumn("status", F.when(F.col("allowed"), F.col("status")).otherwise(403)).drop("allowed")
        missing, empty = F.col("status").isNull(), F.coalesce(F.length("html"), F.lit(0)) == 0
        reason = F.when(F.col("url") != F.col("asked"), "unexpected_response").when(missing | F.col("error").isNotNull(), "network_error").when(~F.col("status").isin(*codes) | empty, "bad_status")
        found = found.withColumn("reason", reason).withColumn("latency", F.col("response_end") - F.col("request_start")).withColumn("exception", F.when(missing, "not in the corpus").otherwise(F.col("error")))
        found = found.withColumn("html", F.when(F.col("reason").isNull(), F.col("html")))
        level = written(found.select(_IN).mapInArrow(run, kind), "level")  # in one pass, so that pages are joined once
        yield level
        if depth == most:
            return
        first = level.where("kind = 'link'").groupBy(F.col("link")).agg(F.min(F.struct("path", F.col("url").alias("backlink"), "pc", "expand")).alias("claim"))
        new = first.select(F.col("link").alias("url"), F.lit(depth + 1).alias("depth"), "claim.backlink", "claim.path", "claim.pc", "claim.expand")
        frontier = written(new.join(visited, "url", "left_anti"), "frontier")
        if frontier.isEmpty():
            return
        visited = visited.unionByName(frontier.select("url"))


def edges(pages: DataFrame, links: str = "//a/@href") -> DataFrame:
    """src, pos, href, dst: the links of each page, resolved (null where that fails). A page that can't be read has none."""
    compiled(links)
    kind = StructType.fromDDL("src string, pos int, href string, dst string")

    def rows(r: dict) -> Iterator[tuple]:
        if not r["html"]:
            return
        try:
            hrefs = [text_of(x) for x in evaluate(links, parse_html(r["html"]), Page(r["url"] or ""), memo={})]
        except Exception:  # as extract() does
            return
        for k, href in enumerate(hrefs):
            try:
                yield (r["url"], k, href, urljoin(r["url"] or "", href))
            except ValueError:
                yield (r["url"], k, href, None)

    return pages.select("url", "html").mapInArrow(_in_arrow(rows, kind), kind)
