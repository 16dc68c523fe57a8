import pytest

from webloom.functions.html_tree import parse_html
from webloom.functions.pages import root_domain
from webloom.functions.xpath import ContextRequired, Page, XPathError, evaluate
from webloom.functions.xpath_functions import plain

DOC = parse_html(
    "<!DOCTYPE html><html lang=en><head><title>T &amp; t</title><script>if (a < b) x = '</p>';</script></head><body><!-- c --><ul id=m><li><a href=a.html class='k'>A</a><li><a href='http://ex.co.uk/b'>B x</a><li><a href='https://sub.ex.co.uk/'>C</a><li><a href='http://other.org/'>D</a></ul>"
    "<p>one <b>two<p>three<h1>H</h1><table><tr><td>1<td>2<tr><td>3</table><div class=x>k<span>l</span> m</div>"
)
PAGE = Page("http://www.ex.co.uk/p", 2, "http://back/", 200, 0.5)

CASES = {
    "//a/@href": ["a.html", "http://ex.co.uk/b", "https://sub.ex.co.uk/", "http://other.org/"],
    "(//a/@href)[1]": "a.html", "//li[2]/a/string()": "B x", "//li[last()]/a/string()": "D", "count(//li)": 4, "//li[position() > 2]/a/text()": ["C", "D"],
    "//p/string()": ["one two", "three"], "count(//tr)": 2, "//tr/count(td)": [2, 1], "//title/text()": "T & t", "/html/@lang": "en", "@lang": "en", "name(/html)": "html",
    "string(//script)": "if (a < b) x = '</p>';", "//comment()": " c ", "//a[@class = 'k']/../name()": "li", "//*[self::h1 or self::title]/name()": ["title", "h1"], "//h1 | //title": ["T & t", "H"],
    "(//h1, //title)/name()": ["h1", "title"], "//h1/preceding-sibling::p[1]/string()": "three", "//ul/following-sibling::p[1]/b/string()": "two", "//span/ancestor::*/name()": ["html", "body", "div"],
    "//li except //li[1] ! a/string()": None, "(//li except //li[1])/a/string()": ["B x", "C", "D"], "(//li intersect //li[2])/a/string()": "B x", "//div//text()": ["k", "l", " m"], "//@id": "m", "//node-not-here": [],
    "//a[contains(@href, 'ex') and not(contains(@href, 'sub'))]/text()": "B x", "//a/@href[starts-with(., 'http')][2]": [], "//a = 'C'": True, "//a/@href != 'zzz'": True, "//nothing = 1": False, "//td = 2": True, "//td[. > 1]": ["2", "3"],
    "(1 to 3) ! ('x' || .)": ["x1", "x2", "x3"], "for $x in 1 to 2, $y in ('a', 'b') return $x || $y": ["1a", "1b", "2a", "2b"], "let $a := 3, $b := $a * 2 return $b - 1": 5, "if (//a) then 'y' else 'n'": "y",
    "some $x in (1, 2) satisfies $x = 2": True, "every $x in (1, 2) satisfies $x = 2": False, "7 idiv 2": 3, "-7 mod 3": -1, "1 div 4": 0.25, "2 * 3 + 4": 10, "10 - 2 - 3": 5, "2 eq 2": True, "() eq 2": [], "'b' gt 'a'": True, "3 to 1": [],
    "abs(-2)": 2, "round(2.5)": 3, "round(-2.5)": -2, "round-half-to-even(2.5)": 2, "floor(1.7)": 1, "ceiling(1.2)": 2, "number('x') = number('x')": False, "math:pow(2, 10)": 1024.0, "math:sqrt(9)": 3.0, "format-number(1234.5, '#,##0.00')": "1,234.50", "format-integer(7, '001')": "007", "format-integer(4, 'I')": "IV",
    "concat('a', 1, true())": "a1true", "substring('abcdef', 2, 3)": "bcd", "substring('12345', 1.5, 2.6)": "234", "substring-before('a-b', '-')": "a", "substring-after('a-b', '-')": "b", "translate('bar', 'abc', 'AB')": "BAr", "normalize-space('  a  b ')": "a b", "upper-case('é')": "É",
    "string-join(('a', 'b'), '-')": "a-b", "tokenize('a, b', ',\\s*')": ["a", "b"], "replace('abc', '(b)', '[$1]')": "a[b]c", "matches('Abc', '^a', 'i')": True, "analyze-string('a1b', '\\d')/match/string()": "1", "contains-token('a b', 'b')": True, "string-to-codepoints('A')": 65, "codepoints-to-string((72, 105))": "Hi",
    "encode-for-uri('a b/c')": "a%20b%2Fc", "resolve-uri('x?y', 'http://h/a/b')": "http://h/a/x?y", "compare('a', 'b')": -1,
    "head((1, 2))": 1, "tail((1, 2, 3))": [2, 3], "reverse((1, 2))": [2, 1], "insert-before((1, 3), 2, 2)": [1, 2, 3], "remove((1, 2, 3), 2)": [1, 3], "subsequence((1, 2, 3, 4), 2, 2)": [2, 3], "index-of((1, 2, 1), 1)": [1, 3], "distinct-values((1, 1.0, 'a', 'a'))": [1, "a"], "deep-equal((1, 'a'), (1, 'a'))": True, "empty(())": True, "exists(//a)": True,
    "sum((1, 2, 3))": 6, "sum(())": 0, "avg((1, 2))": 1.5, "max((1, 3, 2))": 3, "min(('b', 'a'))": "a", "sum(//td)": 6.0, "max(//td)": 3.0, "count(())": 0,
    "for-each(1 to 3, function($x) { $x * $x })": [1, 4, 9], "filter(1 to 4, function($x) { $x mod 2 = 0 })": [2, 4], "fold-left(1 to 4, 0, function($a, $b) { $a + $b })": 10, "fold-right(('a', 'b'), '', concat#2)": "ab", "for-each-pair((1, 2), (3, 4), function($a, $b) { $a * $b })": [3, 8], "sort((3, 1, 2))": [1, 2, 3], "sort(('bb', 'a'), (), string-length#1)": ["a", "bb"], "apply(concat#2, ['a', 'b'])": "ab", "'a' => upper-case() => concat('b')": "Ab",
    "map{'a': 1, 'b': (1, 2)}": {"a": 1, "b": [1, 2]}, "map{'a': 1}?a": 1, "map{'a': ()}": {"a": []}, "map:keys(map:merge((map{'a': 1}, map{'b': 2})))": ["a", "b"], "map:get(map:put(map{}, 'k', 5), 'k')": 5, "map:size(map:remove(map{'a': 1}, 'a'))": 0, "map:contains(map{'a': 1}, 'a')": True, "map:for-each(map{'a': 1}, function($k, $v) { $k || $v })": "a1",
    "array{1, 2, 3}?2": 2, "[1, (2, 3)]": [1, [2, 3]], "array:size([1, (2, 3)])": 2, "array:get([4, 5], 2)": 5, "array:flatten([1, [2, 3]])": [1, 2, 3], "array:reverse([1, 2])": [2, 1], "array:append([1], 2)": [1, 2], "array:subarray([1, 2, 3], 2)": [2, 3], "array:for-each([1, 2], function($x) { $x + 1 })": [2, 3], "array:join(([1], [2]))": [1, 2], "[1, 2](1)": 1, "array:sort([2, 1])": [1, 2],
    "parse-json('{\"a\": [1, null, true]}')?a?3": True, "serialize(map{'a': (1)}, map{'method': 'json'})": '{"a":1}', "xml-to-json(json-to-xml('{\"a\":[1,\"x\"]}'))": '{"a":[1,"x"]}',
    "xs:date('2020-02-28') + xs:dayTimeDuration('P2D')": "2020-03-01", "xs:date('2020-01-31') + xs:yearMonthDuration('P1M')": "2020-02-29", "xs:date('2020-03-01') - xs:date('2020-02-01')": "P29D", "month-from-date(xs:date('2020-03-01'))": 3, "hours-from-dateTime(xs:dateTime('2020-01-01T05:06:07Z'))": 5, "xs:date('2020-01-01') lt xs:date('2020-01-02')": True,
    "format-date(xs:date('2020-03-01'), '[D01]/[M01]/[Y0001]')": "01/03/2020", "format-date(xs:date('2020-03-01'), '[MNn] [D]')": "March 1", "adjust-dateTime-to-timezone(xs:dateTime('2020-01-01T00:00:00Z'), xs:dayTimeDuration('PT2H'))": "2020-01-01T02:00:00+02:00", "xs:dayTimeDuration('PT90M')": "PT1H30M", "parse-ietf-date('Wed, 06 Jun 1994 07:29:35 GMT')": "1994-06-06T07:29:35Z", "days-from-duration(xs:dayTimeDuration('P3DT2H'))": 3,
    "'5' castable as xs:integer": True, "'x' castable as xs:integer": False, "'5' cast as xs:integer": 5, "5 instance of xs:integer": True, "(1, 2) instance of xs:integer+": True, "'a' instance of xs:integer": False, "xs:integer('12') + 1": 13, "xs:boolean('true')": True,
    "path(//h1)": "/html[1]/body[1]/h1[1]", "local-name(//h1)": "h1", "has-children(//h1)": True, "root(//h1)/html/name()": "html", "id('m')/name()": "ul", "//h1[lang('en')]/name()": "h1", "innermost((//div, //span))/name()": "span", "outermost((//div, //span))/name()": "div",
    "wx:depth()": 2, "wx:backlink()": "http://back/", "wx:current-url()": "http://www.ex.co.uk/p", "wx:fetch-time()": 0.5, "wx:elapsed()": 0.5, "wx:status-code()": 200, "//h1/wx:elem()/name()": "h1", "string(base-uri(.))": "http://www.ex.co.uk/p",
    "wx:internal-links()": ["a.html", "http://ex.co.uk/b", "https://sub.ex.co.uk/"], "wx:external-links()": "http://other.org/", "(: a (: b :) c :) 1": 1, "//li/a[@href='a.html']/text()": "A", "//div/*/name()": "span", "//div/node()[2]/name()": "span", "//body/child::h1/string()": "H", "//a/attribute::class": "k", "//ul/descendant::a[2]/string()": "B x", "data(//td[1])": ["1", "3"],
}


@pytest.mark.parametrize("expression", [e for e, v in CASES.items() if v is not None])
def test_expression(expression):
    got = plain(evaluate(expression, DOC, PAGE, memo={}))
    assert got == CASES[expression] and type(got) is type(CASES[expression])


@pytest.mark.parametrize("expression", ["1 +", "//a[", "foo(", "unknown-function()", "wx:depth(.)", "wx:backlink(.)", "$x", "'a' + 1 = ", "substring('a')", "doc('x')", "exactly-one(())", "error('x')", "'x' cast as xs:integer", "map{'a': 1, 'a': 2}", "[1](5)", "string((1, 2))", "xs:date('nope')", "1 idiv 0"])
def test_errors(expression):
    with pytest.raises(XPathError):
        evaluate(expression, DOC, PAGE)


def test_page_functions_need_a_page():
    for f in ("wx:depth()", "wx:current-url()", "wx:main-article-text()", "wx:elem()"):
        with pytest.raises(ContextRequired):
            evaluate(f, DOC)


def test_backlink_of_a_seed():
    assert evaluate("wx:backlink()", DOC, Page("u")) == [""] and evaluate("wx:fetch-time()", DOC, Page("u")) == []


@pytest.mark.parametrize("url,domain", [("http://a.b.example.com/x", "example.com"), ("http://www.ex.co.uk/", "ex.co.uk"), ("http://localhost:80/", "localhost:80"), ("http://x.travel.de/", "travel.de"), ("nope", "")])
def test_root_domain(url, domain):
    assert root_domain(url) == domain


def test_main_text():
    long = "this sentence is long enough to count"
    d = parse_html(f"<body><div><p>{long} 1</p><p>{long} 2</p><script>{long}</script></div><footer><p>{long} 3</p></footer></body>")
    assert evaluate("wx:main-article-text()", d, PAGE) == [f"{long} 1 {long} 2"]
    assert evaluate("wx:main-article-text()", parse_html("<p>short</p>"), PAGE) == [""]


def test_tree():
    assert parse_html("").html() == "<html></html>"
    assert parse_html("x").html() == "<html><body>x</body></html>"
    assert parse_html("<p>a<br>b<p>c</div></p>").html() == "<html><body><p>a<br>b</p><p>c</p></body></html>"
    assert parse_html("<title>t</title><ul><li>1<ul><li>2</ul><li>3</ul>").html() == "<html><head><title>t</title></head><body><ul><li>1<ul><li>2</li></ul></li><li>3</li></ul></body></html>"
    assert parse_html(b"<p a=1 a=2 B='&lt;'>\xff&amp;").html() == '<html><body><p a="1" b="&lt;">\ufffd&amp;</p></body></html>'
    again = parse_html(DOC.html())
    assert again.html() == DOC.html()
