"""The path language: a program says which pages to start from, which links to follow and what to extract.

    program   := [xpath '!'] call (call | xpath)*
    call      := slashes? 'url' '(' argument ')'
    argument  := 'literal' (',' ('follow' '=' xpath | 'depth' '=' integer))*  |  xpath  |  '.'

url('literal') is the seed. url(x), /url(x) and //url(x) follow the links that x selects, ///url(x) follows them again and again,
and anything else is an XPath 3.1 expression over the page. x ! url(.) takes the seeds from an expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.xpath import compiled, evaluate, text_of


@dataclass(frozen=True)
class Token:
    type: str
    value: str
    start: int
    end: int


@dataclass(frozen=True)
class Seed:
    """url('literal', follow=..., depth=...)"""

    url: str
    follow: str | None = None
    depth: int | None = None


@dataclass(frozen=True)
class SeedGenerator:
    """expression ! url(.)"""

    expression: str
    depth: int | None = None

    def urls(self) -> list[str]:
        return [text_of(x) for x in evaluate(self.expression)]


@dataclass(frozen=True)
class Hop:
    """url(links): one step along the links, selected from each item that scope yields, or from the page."""

    links: str
    scope: str | None = None


@dataclass(frozen=True)
class Closure:
    """///url(links): all pages within reach of the links; scope only counts for the first page."""

    links: str
    scope: str | None = None


@dataclass(frozen=True)
class Extract:
    """An XPath expression over the page."""

    expression: str


@dataclass(frozen=True)
class Program:
    start: Seed | SeedGenerator
    steps: tuple[Hop | Closure | Extract, ...] = field(default=())

    @property
    def max_depth(self) -> int | None:
        return self.start.depth

    def seeds(self) -> list[str]:
        return [self.start.url] if isinstance(self.start, Seed) else self.start.urls()

    def needs_tree(self) -> bool:
        """Whether any page has to be parsed: metadata alone doesn't need the markup."""
        follow = isinstance(self.start, Seed) and self.start.follow
        return bool(follow) or not self.steps or any(not (isinstance(s, Extract) and METADATA.fullmatch(s.expression)) for s in self.steps)


_WORD = r"(?:string\(base-uri\(\.\)\)|wx:(?:depth|backlink|current-url|status-code|fetch-time|elapsed)\(\))"
METADATA = re.compile(rf"/?(?:{_WORD}|map\{{\s*(?:'[^']*'\s*:\s*{_WORD}\s*,?\s*)+\}})")
_CALL = re.compile(r"(?P<slashes>/{0,3})\s*(?<![\w\-:$@.])url\s*\(")
_LEXER = re.compile(
    r"""(?P<STRING>'(?:[^'])*'|"(?:[^"])*")|(?P<NUMBER>\d+\.\d+)|(?P<INTEGER>\d+)|(?P<PATH_URL>/{1,3}\s*url(?=\s*\())|(?P<URL>(?<![\w\-:$@.])url(?=\s*\())
    |(?P<FOLLOW>follow(?=\s*=))|(?P<DEPTH>depth(?=\s*=))|(?P<OP>\|\||<=|>=|!=|[-+*/=<>!])|(?P<LPAREN>\()|(?P<RPAREN>\))|(?P<LBRACE>\{)|(?P<RBRACE>\})
    |(?P<COLON>:)|(?P<COMMA>,)|(?P<WS>\s+)|(?P<DOT>\.)|(?P<OTHER>[^\s'"(){}:,.|<>=!+*/-]+|.)""",
    re.X,
)


def tokenize(source: str) -> list[Token]:
    """All signs of a program, spaces kept, ended by EOF."""
    out = [Token(m.lastgroup or "OTHER", m[0], m.start(), m.end()) for m in _LEXER.finditer(source)]
    return [*out, Token("EOF", "", len(source), len(source))]


def _skip(source: str, at: int) -> int:
    """Past a string that begins at `at`."""
    end = source.find(source[at], at + 1)
    if end < 0:
        raise SyntaxError(f"a string isn't closed: {source[at:]!r}")
    return end + 1


def _closing(source: str, at: int) -> int:
    """Where the bracket at `at` is closed."""
    stack, pairs = [], {"(": ")", "[": "]", "{": "}"}
    while at < len(source):
        c = source[at]
        if c in "'\"":
            at = _skip(source, at)
            continue
        if c in pairs:
            stack.append(pairs[c])
        elif c in ")]}":
            if not stack or stack.pop() != c:
                raise SyntaxError(f"{c!r} at {at} closes nothing")
            if not stack:
                return at
        at += 1
    raise SyntaxError("a bracket isn't closed")


def _calls(source: str) -> list[tuple[int, str, int, int]]:
    """The calls outside brackets and strings: where each begins, its slashes, and where its argument begins and ends."""
    out, at = [], 0
    while at < len(source):
        m = _CALL.match(source, at)
        if m:
            end = _closing(source, m.end() - 1)
            out.append((at, m["slashes"], m.end(), end))
            at = end + 1
        elif source[at] in "'\"":
            at = _skip(source, at)
        elif source[at] in "([{":
            at = _closing(source, at) + 1
        elif source[at] in ")]}":
            raise SyntaxError(f"{source[at]!r} at {at} closes nothing")
        else:
            at += 1
    return out


def _arguments(source: str) -> list[str]:
    """Cut at the commas outside brackets and strings."""
    out, begin, at = [], 0, 0
    while at < len(source):
        if source[at] in "'\"":
            at = _skip(source, at)
        elif source[at] in "([{":
            at = _closing(source, at) + 1
        else:
            if source[at] == ",":
                out.append(source[begin:at].strip())
                begin = at + 1
            at += 1
    return [*out, source[begin:].strip()]


_LITERAL = re.compile(r"'([^']*)'|\"([^\"]*)\"")
_OPTION = re.compile(r"(follow|depth)\s*=\s*(.+)", re.S)


def _seed(argument: str) -> Seed | None:
    """The seed of a call with a literal; None where the argument is an expression."""
    parts = _arguments(argument)
    m = _LITERAL.fullmatch(parts[0])
    if not m:
        return None
    options: dict[str, str] = {}
    for p in parts[1:]:
        o = _OPTION.fullmatch(p)
        if not o or o[1] in options:
            raise ValueError(f"url() doesn't take {p!r} here")
        options[o[1]] = o[2].strip()
    if "depth" in options and not options["depth"].isdigit():
        raise ValueError("depth is a whole number")
    if "follow" in options:
        compiled(options["follow"])
    url = m[1] if m[1] is not None else m[2]
    return Seed(url, options.get("follow"), int(options["depth"]) if "depth" in options else None)


def _expression(text: str) -> str:
    compiled(text)
    return text


def parse(source: str) -> Program:
    """The program of a text. SyntaxError for what can't be read, ValueError for what has no meaning."""
    source = source.strip()
    calls = _calls(source)
    if not calls:
        compiled(source)
        raise ValueError("a program begins with url('...') or with seeds ! url(.); to run a lone expression on every page of a corpus, use extract()")
    begin, slashes, a, b = calls[0]
    before = source[:begin].strip()
    argument = source[a:b].strip()
    start: Seed | SeedGenerator
    if before:
        if not before.endswith("!"):
            raise ValueError("only ! connects seeds and url()")
        parts = _arguments(argument)
        depth = None
        if len(parts) == 2 and (o := _OPTION.fullmatch(parts[1])) and o[1] == "depth" and o[2].strip().isdigit():
            depth = int(o[2])
        elif len(parts) > 1:
            raise ValueError(f"url() doesn't take {parts[1]!r} here")
        if slashes or parts[0] != ".":
            raise ValueError("seeds are taken by url(.)")
        start = SeedGenerator(_expression(before[:-1].strip()), depth)
    else:
        seed = _seed(argument)
        if slashes or seed is None:
            raise ValueError("a program begins with url('...')")
        start = seed
    steps: list[Hop | Closure | Extract] = []
    at = b + 1
    for begin, slashes, a, b in calls[1:]:
        scope = source[at:begin].strip() or None
        argument = source[a:b].strip()
        if not argument:
            raise ValueError("url() needs an argument")
        if _calls(argument):
            raise ValueError("url() inside url() isn't supported")
        if _seed(argument) is not None:
            raise ValueError("only the first url() takes a literal")
        if len(parts := _arguments(argument)) > 1 and any(_OPTION.fullmatch(p) for p in parts[1:]):
            raise ValueError("follow and depth belong to the first url()")
        if scope is not None:
            _expression(scope)
            if argument.startswith("/"):
                raise ValueError("after an expression, the links of url() are relative to what it selects")
        elif argument == ".":
            raise ValueError("url(.) needs an expression before it")
        if slashes == "///":
            if argument == ".":
                raise ValueError("///url(.) has no meaning")
            if any(isinstance(s, Closure) for s in steps) or (isinstance(start, Seed) and start.follow):
                raise ValueError("a program follows links again and again only once")
            steps.append(Closure(_expression(argument), scope))
        else:
            steps.append(Hop(_expression(argument), scope))
        at = b + 1
    if rest := source[at:].strip():
        steps.append(Extract(_expression(rest)))
    return Program(start, tuple(steps))
