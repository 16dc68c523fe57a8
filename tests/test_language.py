import pytest

from webloom.plans.language import Closure, Extract, Hop, Program, Seed, SeedGenerator, parse, tokenize


def test_programs():
    assert parse("url('http://a/')") == Program(Seed("http://a/"))
    assert parse("url( \"http://a/\" )///url(//a/@href)//h1") == Program(Seed("http://a/"), (Closure("//a/@href"), Extract("//h1")))
    assert parse("url('u', follow=//a[@x=','], depth=3)").start == Seed("u", "//a[@x=',']", 3)
    assert parse("url('u', depth=3)").max_depth == 3
    assert parse("url('u')//main/a/url(@href)/url(//@href)").steps == (Hop("@href", "//main/a"), Hop("//@href"))
    assert parse("url('u')//a/@href/url(.)").steps == (Hop(".", "//a/@href/"),) or parse("url('u')//a/@href/url(.)").steps == (Hop(".", "//a/@href"),)
    assert parse("(1 to 2) ! url(.)//p") == Program(SeedGenerator("(1 to 2)"), (Extract("//p"),))
    assert parse("(1 to 2) ! url(., depth=2)").max_depth == 2
    assert parse("url('u')/map{'url': string(base-uri(.)), 'data-url': //div[@data-url]}").steps[0].expression.startswith("/map{")
    assert parse("url('u')//div[@data-url]/wx:current-url()").steps == (Extract("//div[@data-url]/wx:current-url()"),)
    assert parse("url('u')//p[contains(., 'url(')]").steps == (Extract("//p[contains(., 'url(')]"),)


@pytest.mark.parametrize("text", ["url('u'", "url('u)", "url('u')//a[", "url('u'))"])
def test_unreadable(text):
    with pytest.raises(SyntaxError):
        parse(text)


@pytest.mark.parametrize(
    "text",
    ["//a/@href", "url(//a)", "///url('u')", "url('u')//url('v')", "url('u')//url(//a, depth=2)", "url('u')//url(//a, follow=//b)", "url('u')///url(.)", "url('u')//main/url(//a/@href)", "url('u') + url(.)", "(1 to 2) + url(.)",
     "url('u')///url(//a)///url(//b)", "url('u', follow=//a)///url(//b)", "url('u', depth=x)", "url('u', depth=1, depth=2)", "url('u')//url()", "url('u')//url(url(//a))", "url('u')//url(.)", "url('u')//a[1", "url('u')//p[]"],
)
def test_meaningless(text):
    with pytest.raises((ValueError, SyntaxError)):
        parse(text)


def test_tokens():
    got = [(t.type, t.value) for t in tokenize("url('u', depth=2)///url(//a)")]
    assert got[:7] == [("URL", "url"), ("LPAREN", "("), ("STRING", "'u'"), ("COMMA", ","), ("WS", " "), ("DEPTH", "depth"), ("OP", "=")]
    assert ("PATH_URL", "///url") in got and got[-1] == ("EOF", "")
    assert "".join(t.value for t in tokenize("a ! url(.) || 'x y'")) == "a ! url(.) || 'x y'"


def test_metadata_programs_need_no_tree():
    assert not parse("url('u')/map{'u': string(base-uri(.)), 'd': wx:depth()}").needs_tree()
    assert not parse("url('u')/wx:current-url()").needs_tree()
    assert parse("url('u')/map{'u': string(//h1)}").needs_tree() and parse("url('u')").needs_tree()
