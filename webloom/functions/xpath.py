"""XPath 3.1 over html_tree nodes: expressions are compiled once to closures and run on many pages."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from decimal import Decimal
from functools import cmp_to_key, lru_cache
from itertools import pairwise
from typing import Any

from .html_tree import Node

Items = list[Any]


class XPathError(ValueError):
    """A static or dynamic error of an expression."""


class ContextRequired(XPathError):
    """A function that needs a page was called without one."""


@dataclass(frozen=True)
class Page:
    """Where a document comes from."""

    url: str = ""
    depth: int = 0
    backlink: str | None = None
    status: int = 200
    latency: float | None = None


@dataclass(slots=True)
class Context:
    """Never changed once made."""

    item: Any = None
    position: int = 1
    size: int = 1
    variables: dict[str, Items] = field(default_factory=dict)
    page: Page | None = None
    memo: dict[int, Items] | None = None

    def on(self, item: Any, position: int = 1, size: int = 1) -> Context:
        return Context(item, position, size, self.variables, self.page, self.memo)


class XMap(dict):
    """A map item; values are sequences."""


class XArray(list):
    """An array item; members are sequences."""


@dataclass(frozen=True)
class Function:
    arity: int
    call: Callable[..., Items]


Compiled = Callable[[Context], Items]

_TOKEN = re.compile(
    r"""\s+|(?P<comment>\(:)|(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<string>"(?:[^"]|"")*"|'(?:[^']|'')*')
    |(?P<op>\|\||=>|!=|<=|>=|<<|>>|//|::|:=|\.\.|[-+*/=<>!|,.()\[\]{}@$?\#:])
    |(?P<name>[^\W\d][\w.-]*(?::[^\W\d][\w.-]*)?)""",
    re.X,
)


def tokens(source: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise XPathError(f"unexpected {source[at]!r} at {at} of {source!r}")
        if m["comment"]:
            depth, k = 1, m.end()
            while depth:
                if k >= len(source):
                    raise XPathError("a comment isn't closed")
                if source.startswith("(:", k):
                    depth, k = depth + 1, k + 2
                elif source.startswith(":)", k):
                    depth, k = depth - 1, k + 2
                else:
                    k += 1
            at = k
            continue
        kind = m.lastgroup
        if kind:
            out.append((kind, m[kind], at))
        at = m.end()
    out.append(("end", "", len(source)))
    return out


# ---------------------------------------------------------------- values


def atoms(items: Items) -> Items:
    """Nodes as their string values, arrays as their members."""
    out: Items = []
    for x in items:
        if isinstance(x, Node):
            out.append(x.text())
        elif isinstance(x, XArray):
            for member in x:
                out += atoms(member)
        elif isinstance(x, (XMap, Function)):
            raise XPathError("a map or function has no atomic value")
        else:
            out.append(x)
    return out


def number_text(x: float) -> str:
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "INF" if x > 0 else "-INF"
    if x == int(x) and abs(x) < 1e15:
        return ("-" if str(x).startswith("-") and x == 0 else "") + str(int(x))
    if 1e-6 <= abs(x) < 1e6:
        return format(Decimal(repr(x)), "f")
    mantissa, _, exponent = f"{x!r}".partition("e")
    if exponent:
        return f"{mantissa}{'' if '.' in mantissa else '.0'}E{int(exponent)}"
    d = Decimal(repr(x)).normalize()
    sign, digits, _ = d.as_tuple()
    return f"{'-' if sign else ''}{digits[0]}.{''.join(map(str, digits[1:])) or '0'}E{d.adjusted()}"


def text_of(x: Any) -> str:
    """The string of one item."""
    if isinstance(x, Node):
        return x.text()
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float):
        return number_text(x)
    if isinstance(x, Decimal):
        return format(x.normalize(), "f") if x else "0"
    if isinstance(x, (XMap, Function)):
        raise XPathError("a map or function has no string value")
    if isinstance(x, XArray):
        return " ".join(text_of(y) for y in atoms([x]))
    return lexical(x)


def lexical(x: Any) -> str:
    return x.lexical() if hasattr(x, "lexical") else str(x)


def string(items: Items) -> str:
    if len(items) > 1:
        raise XPathError("one item is wanted where there are several")
    return text_of(items[0]) if items else ""


def number(x: Any) -> float | int | Decimal:
    """The number of an atomic value; NaN where it is none."""
    if isinstance(x, bool):
        return float(x)
    if isinstance(x, (int, float, Decimal)):
        return x
    try:
        t = text_of(x).strip()
        return float(t.replace("INF", "inf")) if "_" not in t else float("nan")
    except ValueError:
        return float("nan")


def truth(items: Items) -> bool:
    """The effective boolean value."""
    if not items:
        return False
    x = items[0]
    if isinstance(x, Node):
        return True
    if len(items) > 1:
        raise XPathError("several items have no boolean value")
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float, Decimal)):
        return bool(x) and x == x
    if isinstance(x, str):
        return x != ""
    raise XPathError("the item has no boolean value")


def one(items: Items) -> Any:
    """The only atomic value, None for an empty sequence."""
    got = atoms(items)
    if len(got) > 1:
        raise XPathError("one value is wanted where there are several")
    return got[0] if got else None


def _pair(a: Any, b: Any) -> tuple[Any, Any]:
    """Two atomic values made comparable: an untyped string beside a number is a number."""
    num = (int, float, Decimal)
    if isinstance(a, bool) or isinstance(b, bool):
        return (a if isinstance(a, bool) else str(a) in ("true", "1")), (b if isinstance(b, bool) else str(b) in ("true", "1"))
    if isinstance(a, num) or isinstance(b, num):
        a, b = number(a), number(b)
        if isinstance(a, float) or isinstance(b, float):
            return float(a), float(b)
        return a, b
    if type(a) is not type(b):
        if isinstance(a, str) and hasattr(type(b), "parse"):
            return type(b).parse(a), b
        if isinstance(b, str) and hasattr(type(a), "parse"):
            return a, type(a).parse(b)
        raise XPathError("values of unlike types can't be compared")
    return a, b


_COMPARE: dict[str, Callable[[Any, Any], bool]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
_VALUE = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def compare(op: str, a: Any, b: Any) -> bool:
    return _COMPARE[op](*_pair(a, b))


def order_of(n: Node) -> int:
    return n.order


def in_order(items: Items) -> Items:
    """Distinct nodes in document order; other items as they are."""
    if len(items) < 2 or not all(isinstance(x, Node) for x in items):
        return items
    if all(a.order < b.order for a, b in pairwise(items)):
        return items
    seen: dict[int, Node] = {id(x): x for x in items}
    return sorted(seen.values(), key=order_of)


def deep_equal(a: Items, b: Items) -> bool:
    if len(a) != len(b):
        return False
    for x, y in zip(a, b):
        if isinstance(x, Node) or isinstance(y, Node):
            if not (isinstance(x, Node) and isinstance(y, Node) and x.kind == y.kind and x.html() == y.html()):
                return False
        elif isinstance(x, XMap) or isinstance(y, XMap):
            if not (isinstance(x, XMap) and isinstance(y, XMap) and x.keys() == y.keys() and all(deep_equal(x[k], y[k]) for k in x)):
                return False
        elif isinstance(x, XArray) or isinstance(y, XArray):
            if not (isinstance(x, XArray) and isinstance(y, XArray) and len(x) == len(y) and all(map(deep_equal, x, y))):
                return False
        else:
            try:
                if not compare("=", x, y) and not (x != x and y != y):
                    return False
            except (XPathError, TypeError):
                return False
    return True


def sort_items(items: Items, key: Callable[[Any], Items]) -> Items:
    def by(a: tuple, b: tuple) -> int:
        for x, y in zip(a[0], b[0]):
            if compare("<", x, y):
                return -1
            if compare("<", y, x):
                return 1
        return len(a[0]) - len(b[0])

    return [x for _, x in sorted(((atoms(key(x)), x) for x in items), key=cmp_to_key(by))]


# ---------------------------------------------------------------- axes


def _children(n: Node) -> Items:
    return n.children


def _following(n: Node) -> Items:
    out: Items = []
    while n.parent is not None:
        sib = n.parent.children
        if n.kind != "attribute":
            for s in sib[sib.index(n) + 1 :]:
                out += s.walk()
        n = n.parent
    return sorted(out, key=order_of)


def _ancestors(n: Node) -> Items:
    out: Items = []
    while n.parent is not None:
        n = n.parent
        out.append(n)
    return out


def _preceding(n: Node) -> Items:
    up = {id(x) for x in _ancestors(n)}
    return [x for x in reversed(list(n.top().walk())) if x.order < n.order and id(x) not in up and x is not n]


def _siblings(n: Node, after: bool) -> Items:
    if n.parent is None or n.kind == "attribute":
        return []
    sib = n.parent.children
    k = sib.index(n)
    return sib[k + 1 :] if after else sib[:k][::-1]


AXES: dict[str, Callable[[Node], Items]] = {
    "child": _children,
    "descendant": lambda n: list(n.walk())[1:],
    "descendant-or-self": lambda n: list(n.walk()),
    "self": lambda n: [n],
    "parent": lambda n: [n.parent] if n.parent is not None else [],
    "ancestor": _ancestors,
    "ancestor-or-self": lambda n: [n, *_ancestors(n)],
    "attribute": lambda n: n.attributes,
    "following": _following,
    "preceding": _preceding,
    "following-sibling": lambda n: _siblings(n, True),
    "preceding-sibling": lambda n: _siblings(n, False),
    "namespace": lambda n: [],
}
_KINDS = {"text": "text", "comment": "comment", "element": "element", "attribute": "attribute", "document-node": "document", "processing-instruction": "pi"}
_RESERVED = {*_KINDS, "node", "if", "switch", "typeswitch", "item", "empty-sequence", "function", "map", "array"}

#: name -> (least arguments, most arguments, function of the context and the arguments' sequences)
FUNCTIONS: dict[str, tuple[int, int, Callable[..., Items]]] = {}
#: type name -> cast of an atomic value
TYPES: dict[str, Callable[[Any], Any]] = {}


def register_function(name: str, least: int, most: int | None = None) -> Callable:
    """Makes a Python function of (context, *sequences) callable from expressions, under its name with prefix (fn: may be left out)."""

    def add(f: Callable[..., Items]) -> Callable[..., Items]:
        FUNCTIONS[name.removeprefix("fn:")] = (least, least if most is None else most, f)
        return f

    return add


# ---------------------------------------------------------------- compiler


class Compiler:
    def __init__(self, source: str):
        self.source, self.tokens, self.at = source, tokens(source), 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        t = self.tokens[min(self.at + k, len(self.tokens) - 1)]
        return t[0], t[1]

    def is_op(self, *values: str, k: int = 0) -> bool:
        kind, value = self.peek(k)
        return kind == "op" and value in values

    def is_word(self, *values: str, k: int = 0) -> bool:
        kind, value = self.peek(k)
        return kind == "name" and value in values

    def take(self) -> str:
        value = self.tokens[self.at][1]
        self.at += 1
        return value

    def eat(self, value: str) -> None:
        if self.peek()[1] != value or self.peek()[0] in ("string", "end"):
            raise XPathError(f"{value!r} is wanted at {self.tokens[self.at][2]} of {self.source!r}")
        self.at += 1

    def compile(self) -> Compiled:
        f = self.sequence()
        if self.peek()[0] != "end":
            raise XPathError(f"unexpected {self.peek()[1]!r} at {self.tokens[self.at][2]} of {self.source!r}")
        return f

    def sequence(self) -> Compiled:
        parts = [self.single()]
        while self.is_op(","):
            self.take()
            parts.append(self.single())
        if len(parts) == 1:
            return parts[0]
        return lambda c: [x for p in parts for x in p(c)]

    def variable(self) -> str:
        self.eat("$")
        return self.take()

    def single(self) -> Compiled:
        if self.is_word("for", "let", "some", "every") and self.is_op("$", k=1):
            return self.binding()
        if self.is_word("if") and self.is_op("(", k=1):
            self.take()
            self.eat("(")
            test = self.sequence()
            self.eat(")")
            self.eat("then")
            yes = self.single()
            self.eat("else")
            no = self.single()
            return lambda c: yes(c) if truth(test(c)) else no(c)
        return self.either()

    def binding(self) -> Compiled:
        word = self.take()
        bound: list[tuple[str, Compiled]] = []
        while True:
            name = self.variable()
            self.eat(":=" if word == "let" else "in")
            bound.append((name, self.single()))
            if not self.is_op(","):
                break
            self.take()
        self.eat("satisfies" if word in ("some", "every") else "return")
        body = self.single()

        def run(c: Context, k: int = 0) -> Items:
            if k == len(bound):
                return body(c) if word in ("for", "let") else [truth(body(c))]
            name, source = bound[k]
            each = [source(c)] if word == "let" else [[x] for x in source(c)]
            got = (run(replace(c, variables={**c.variables, name: x}), k + 1) for x in each)
            if word == "some":
                return [any(g[0] for g in got)]
            if word == "every":
                return [all(g[0] for g in got)]
            return [y for g in got for y in g]

        return run

    def either(self) -> Compiled:
        f = self.both()
        while self.is_word("or"):
            self.take()
            f = (lambda a, b: lambda c: [truth(a(c)) or truth(b(c))])(f, self.both())
        return f

    def both(self) -> Compiled:
        f = self.comparison()
        while self.is_word("and"):
            self.take()
            f = (lambda a, b: lambda c: [truth(a(c)) and truth(b(c))])(f, self.comparison())
        return f

    def comparison(self) -> Compiled:
        a = self.joined()
        if self.is_op(*_COMPARE):
            op = self.take()
            b = self.joined()

            def general(c: Context) -> Items:
                xs, ys = atoms(a(c)), atoms(b(c))
                if op == "=" and len(xs) == len(ys) == 1 and type(xs[0]) is type(ys[0]) is str:
                    return [xs[0] == ys[0]]
                return [any(compare(op, x, y) for x in xs for y in ys)]

            return general
        if self.is_word(*_VALUE):
            op = _VALUE[self.take()]
            b = self.joined()

            def value(c: Context) -> Items:
                x, y = one(a(c)), one(b(c))
                return [] if x is None or y is None else [compare(op, x, y)]

            return value
        if self.is_word("is") or self.is_op("<<", ">>"):
            op = self.take()
            b = self.joined()

            def nodes(c: Context) -> Items:
                x, y = a(c), b(c)
                if not x or not y:
                    return []
                return [x[0] is y[0] if op == "is" else x[0].order < y[0].order if op == "<<" else x[0].order > y[0].order]

            return nodes
        return a

    def joined(self) -> Compiled:
        parts = [self.span()]
        while self.is_op("||"):
            self.take()
            parts.append(self.span())
        return parts[0] if len(parts) == 1 else lambda c: ["".join(string(p(c)) for p in parts)]

    def span(self) -> Compiled:
        a = self.sum()
        if self.is_word("to"):
            self.take()
            b = self.sum()

            def run(c: Context) -> Items:
                x, y = one(a(c)), one(b(c))
                return [] if x is None or y is None else list(range(int(number(x)), int(number(y)) + 1))

            return run
        return a

    def sum(self) -> Compiled:
        f = self.product()
        while self.is_op("+", "-"):
            f = self.arithmetic(self.take(), f, self.product())
        return f

    def product(self) -> Compiled:
        f = self.union()
        while self.is_op("*") or self.is_word("div", "idiv", "mod"):
            f = self.arithmetic(self.take(), f, self.union())
        return f

    @staticmethod
    def arithmetic(op: str, a: Compiled, b: Compiled) -> Compiled:
        def run(c: Context) -> Items:
            x, y = one(a(c)), one(b(c))
            return [] if x is None or y is None else [calculate(op, x, y)]

        return run

    def union(self) -> Compiled:
        f = self.intersection()
        while self.is_op("|") or self.is_word("union"):
            self.take()
            f = (lambda a, b: lambda c: in_order(a(c) + b(c)))(f, self.intersection())
        return f

    def intersection(self) -> Compiled:
        f = self.typed()
        while self.is_word("intersect", "except"):
            keep = self.take() == "intersect"

            def run(c: Context, a=f, b=self.typed(), keep=keep) -> Items:
                have = {id(x) for x in b(c)}
                return in_order([x for x in a(c) if (id(x) in have) == keep])

            f = run
        return f

    def typed(self) -> Compiled:
        f = self.arrow()
        while True:
            if self.is_word("instance") and self.is_word("of", k=1):
                self.at += 2
                test = self.sequence_type()
                f = (lambda a, test: lambda c: [test(a(c))])(f, test)
            elif self.is_word("treat") and self.is_word("as", k=1):
                self.at += 2
                test = self.sequence_type()

                def treated(c: Context, a=f, test=test) -> Items:
                    got = a(c)
                    if not test(got):
                        raise XPathError("the value isn't of the type it is treated as")
                    return got

                f = treated
            elif self.is_word("cast", "castable") and self.is_word("as", k=1):
                able = self.take() == "castable"
                self.take()
                name = self.take()
                optional = self.is_op("?")
                if optional:
                    self.take()
                f = self.cast(f, name, optional, able)
            else:
                return f

    @staticmethod
    def cast(a: Compiled, name: str, optional: bool, able: bool) -> Compiled:
        if name not in TYPES:
            raise XPathError(f"unknown type {name}")

        def run(c: Context) -> Items:
            try:
                x = one(a(c))
                if x is None:
                    if not optional:
                        raise XPathError("an empty sequence can't be cast")
                    return [True] if able else []
                y = TYPES[name](x)
                return [True] if able else [y]
            except (XPathError, ValueError, ArithmeticError) as e:
                if able:
                    return [False]
                raise XPathError(f"can't be cast to {name}: {e}") from None

        return run

    def sequence_type(self) -> Callable[[Items], bool]:
        name = self.take()
        if self.is_op("("):
            depth = 0
            while True:
                depth += self.is_op("(") - self.is_op(")")
                self.take()
                if not depth:
                    break
        most, least = 1, 1
        if self.is_op("?", "*", "+"):
            mark = self.take()
            least, most = (0 if mark in "?*" else 1), (1 if mark == "?" else 1 << 62)
        if name == "empty-sequence":
            return lambda items: not items
        return lambda items: least <= len(items) <= most and all(is_type(x, name) for x in items)

    def arrow(self) -> Compiled:
        f = self.unary()
        while self.is_op("=>"):
            self.take()
            if self.is_op("$", "("):
                target = self.primary()
                args = self.arguments()

                def dynamic(c: Context, a=f, target=target, args=args) -> Items:
                    return call_item(target(c), [a(c), *(x(c) for x in args)])

                f = dynamic
            else:
                name = self.take()
                f = self.call(name, [f, *self.arguments()])
        return f

    def unary(self) -> Compiled:
        sign, signed = 1, False
        while self.is_op("+", "-"):
            signed = True
            if self.take() == "-":
                sign = -sign
        f = self.mapped()
        if not signed:
            return f

        def run(c: Context) -> Items:
            x = one(f(c))
            return [] if x is None else [sign * number(x)]

        return run

    def mapped(self) -> Compiled:
        f = self.path()
        while self.is_op("!"):
            self.take()
            f = (lambda a, b: lambda c: over(c, a(c), b))(f, self.path())
        return f

    def path(self) -> Compiled:
        begin = self.at
        if self.is_op("/", "//"):
            anywhere = self.take() == "//"
            if not anywhere and not self.starts_step():
                return lambda c: [_node(c).top()]
            steps = self.steps(None, anywhere)
            f: Compiled = lambda c: steps(c.on(_node(c).top(), c.position, c.size))
            key = hash(tuple(t[1] for t in self.tokens[begin : self.at]))
            if "$" in (t[1] for t in self.tokens[begin : self.at]):
                return f

            def remembered(c: Context) -> Items:
                if c.memo is None:
                    return f(c)
                k = hash((key, id(_node(c).top())))
                if k not in c.memo:
                    c.memo[k] = f(c)
                return c.memo[k]

            return remembered
        return self.steps(self.step(), False)

    def starts_step(self) -> bool:
        kind, value = self.peek()
        return kind in ("name", "number", "string") or value in ("@", ".", "..", "*", "(", "$", "[")

    def steps(self, first: Compiled | None, anywhere: bool) -> Compiled:
        f = first
        while True:
            if f is not None:
                if not self.is_op("/", "//"):
                    return f
                anywhere = self.take() == "//"
            if anywhere:
                f = self.below(f)
                continue
            nxt = self.step()
            f = nxt if f is None else (lambda a, b: lambda c: in_order(over(c, a(c), b)))(f, nxt)

    def below(self, before: Compiled | None) -> Compiled:
        """What follows a double slash."""
        kind, value = self.peek()
        if (kind == "name" or value == "*") and not self.is_op("(", "::", "{", k=1) and not (kind == "name" and self.is_op("[", k=1)) and not (value == "*" and self.is_op("[", k=1)):
            name = self.take().lower()

            def fast(c: Context) -> Items:
                out: Items = []
                for n in [_node(c)] if before is None else before(c):
                    if n.kind == "document":
                        out += n.named(name)
                    else:
                        out += [x for x in list(n.walk())[1:] if x.kind == "element" and (name == "*" or x.name == name)]
                return out if before is None else in_order(out)

            return fast
        children = value.lower() if kind == "name" and self.is_op("[", k=1) else ""
        step = self.step()

        def run(c: Context) -> Items:
            base = [_node(c)] if before is None else before(c)
            out: Items = []
            for n in in_order(base):
                # children of a name are looked for where some are
                out += [y for x in (n.parents_of(children) if children and n.kind == "document" else n.walk()) for y in step(c.on(x))]
            return in_order(out)

        return run

    def step(self) -> Compiled:
        if self.is_op("..") or self.is_op("@") or (self.peek()[0] == "name" and self.is_op("::", k=1)) or self.is_test():
            return self.axis_step()
        return self.postfix()

    def is_test(self) -> bool:
        kind, value = self.peek()
        if value == "*" and kind == "op":
            return True
        if kind != "name" or self.is_op("#", k=1):
            return False
        if self.is_op("(", k=1):
            return value in _KINDS or value == "node"
        return not (self.is_op("{", k=1) and value in ("map", "array", "function"))

    def axis_step(self) -> Compiled:
        axis = "child"
        if self.is_op(".."):
            self.take()
            axis, test = "parent", lambda n: True
        else:
            if self.is_op("@"):
                self.take()
                axis = "attribute"
            elif self.is_op("::", k=1):
                axis = self.take()
                self.take()
                if axis not in AXES:
                    raise XPathError(f"unknown axis {axis}")
            elif self.is_word("attribute") and self.is_op("(", k=1):
                axis = "attribute"
            test = self.node_test("attribute" if axis == "attribute" else "element")
        filters = self.predicates()
        walk = AXES[axis]

        def run(c: Context) -> Items:
            got = [n for n in walk(_node(c)) if test(n)]
            for p in filters:
                got = chosen(c, got, p)
            return in_order(got) if axis in ("ancestor", "ancestor-or-self", "preceding", "preceding-sibling") else got

        return run

    def node_test(self, kind: str) -> Callable[[Node], bool]:
        word = self.take()
        if self.is_op("(") and (word in _KINDS or word == "node"):
            self.take()
            name = self.take().lower() if not self.is_op(")") else "*"
            self.eat(")")
            if word == "node":
                return lambda n: True
            wanted = _KINDS[word]
            return lambda n: n.kind == wanted and name in ("*", n.name)
        if word == "*":
            if self.is_op(":"):
                self.take()
                word = self.take()
            else:
                return lambda n: n.kind == kind
        elif self.tokens[self.at - 1][0] != "name":
            raise XPathError(f"a step is wanted at {self.tokens[self.at - 1][2]} of {self.source!r}")
        if self.is_op(":") and self.is_op("*", k=1):
            self.at += 2
            return lambda n: False
        name = word.lower()
        return lambda n: n.name == name and n.kind == kind

    def predicates(self) -> list[Compiled]:
        out = []
        while self.is_op("["):
            self.take()
            out.append(self.sequence())
            self.eat("]")
        return out

    def arguments(self) -> list[Compiled]:
        self.eat("(")
        args = []
        while not self.is_op(")"):
            if self.is_op("?") and self.is_op(",", ")", k=1):
                raise XPathError("partial application isn't supported")
            args.append(self.single())
            if not self.is_op(")"):
                self.eat(",")
        self.eat(")")
        return args

    def postfix(self) -> Compiled:
        f = self.primary()
        while True:
            if self.is_op("["):
                f = (lambda a, ps: lambda c: [x for x in _filtered(c, a(c), ps)])(f, self.predicates())
            elif self.is_op("("):
                f = (lambda a, args: lambda c: call_item(a(c), [x(c) for x in args]))(f, self.arguments())
            elif self.is_op("?"):
                self.take()
                f = self.lookup(f)
            else:
                return f

    def lookup(self, a: Compiled | None) -> Compiled:
        kind, value = self.peek()
        if value == "*" and kind == "op":
            self.take()
            key: Compiled | None = None
        elif value == "(" and kind == "op":
            self.take()
            key = self.sequence()
            self.eat(")")
        else:
            self.take()
            fixed = int(value) if kind == "number" else value
            key = lambda c: [fixed]

        def run(c: Context) -> Items:
            out: Items = []
            for m in a(c) if a else [c.item]:
                keys = (list(m) if isinstance(m, XMap) else range(1, len(m) + 1)) if key is None else atoms(key(c))
                for k in keys:
                    out += call_item([m], [[k]])
            return out

        return run

    def primary(self) -> Compiled:
        kind, value = self.peek()
        if kind == "number":
            self.take()
            n: Any = float(value) if "e" in value.lower() else Decimal(value) if "." in value else int(value)
            return lambda c: [n]
        if kind == "string":
            self.take()
            s = value[1:-1].replace(value[0] * 2, value[0])
            return lambda c: [s]
        if value == "(":
            self.take()
            if self.is_op(")"):
                self.take()
                return lambda c: []
            f = self.sequence()
            self.eat(")")
            return f
        if value == ".":
            self.take()
            return lambda c: [c.item] if c.item is not None else _no_item()
        if value == "$":
            name = self.variable()

            def var(c: Context) -> Items:
                if name not in c.variables:
                    raise XPathError(f"${name} isn't bound")
                return c.variables[name]

            return var
        if value == "[":
            self.take()
            members = []
            while not self.is_op("]"):
                members.append(self.single())
                if not self.is_op("]"):
                    self.eat(",")
            self.eat("]")
            return lambda c: [XArray(m(c) for m in members)]
        if value == "?":
            self.take()
            return self.lookup(None)
        if kind == "name":
            if value == "map" and self.is_op("{", k=1):
                return self.map_of()
            if value == "array" and self.is_op("{", k=1):
                self.at += 2
                f = (lambda c: []) if self.is_op("}") else self.sequence()
                self.eat("}")
                return lambda c: [XArray([x] for x in f(c))]
            if value == "function" and self.is_op("(", k=1):
                return self.inline()
            if self.is_op("#", k=1):
                self.at += 2
                arity = int(self.take())
                least, most, g = self.known(value, arity)
                return lambda c: [Function(arity, lambda *args: g(c, *args))]
            if self.is_op("(", k=1):
                self.take()
                return self.call(value, self.arguments())
        raise XPathError(f"unexpected {value or 'end'!r} at {self.tokens[self.at][2]} of {self.source!r}")

    def map_of(self) -> Compiled:
        self.at += 2
        pairs = []
        while not self.is_op("}"):
            k = self.single()
            self.eat(":")
            pairs.append((k, self.single()))
            if not self.is_op("}"):
                self.eat(",")
        self.eat("}")

        def run(c: Context) -> Items:
            out = XMap()
            for k, v in pairs:
                key = one(k(c))
                if key is None or key in out:
                    raise XPathError("keys of a map are single and distinct")
                out[key] = v(c)
            return [out]

        return run

    def inline(self) -> Compiled:
        self.at += 2
        names = []
        while not self.is_op(")"):
            names.append(self.variable())
            if self.is_word("as"):
                self.take()
                self.sequence_type()
            if not self.is_op(")"):
                self.eat(",")
        self.eat(")")
        if self.is_word("as"):
            self.take()
            self.sequence_type()
        self.eat("{")
        body = (lambda c: []) if self.is_op("}") else self.sequence()
        self.eat("}")
        return lambda c: [Function(len(names), lambda *args: body(replace(c, variables={**c.variables, **dict(zip(names, args))})))]

    def known(self, name: str, arity: int) -> tuple[int, int, Callable[..., Items]]:
        plain = name.removeprefix("fn:")
        if plain in TYPES:
            return 1, 1, lambda c, a: [TYPES[plain](x) for x in atoms(a)]
        if plain not in FUNCTIONS:
            raise XPathError(f"unknown function {name}")
        least, most, f = FUNCTIONS[plain]
        if not least <= arity <= most:
            raise XPathError(f"{name} doesn't take {arity} arguments")
        return least, most, f

    def call(self, name: str, args: list[Compiled]) -> Compiled:
        least, most, f = self.known(name, len(args))
        if name in TYPES and len(args) != 1:
            raise XPathError(f"{name} takes one argument")
        return lambda c: f(c, *(a(c) for a in args))


def _no_item() -> Items:
    raise XPathError("there is no context item")


def _node(c: Context) -> Node:
    if not isinstance(c.item, Node):
        raise XPathError("a path needs a node")
    return c.item


def over(c: Context, items: Items, f: Compiled) -> Items:
    """f on each item."""
    size = len(items)
    return [y for k, x in enumerate(items, 1) for y in f(c.on(x, k, size))]


def chosen(c: Context, items: Items, predicate: Compiled) -> Items:
    size, out = len(items), []
    for k, x in enumerate(items, 1):
        got = predicate(c.on(x, k, size))
        if len(got) == 1 and isinstance(got[0], (int, float, Decimal)) and not isinstance(got[0], bool):
            if got[0] == k:
                out.append(x)
        elif truth(got):
            out.append(x)
    return out


def _filtered(c: Context, items: Items, predicates: list[Compiled]) -> Items:
    for p in predicates:
        items = chosen(c, items, p)
    return items


def call_item(f: Items, args: list[Items]) -> Items:
    if len(f) != 1:
        raise XPathError("one function is wanted")
    g = f[0]
    if isinstance(g, XMap):
        return g.get(one(args[0]), [])
    if isinstance(g, XArray):
        k = int(number(one(args[0])))
        if not 1 <= k <= len(g):
            raise XPathError("there is no such member of the array")
        return g[k - 1]
    if not isinstance(g, Function) or g.arity != len(args):
        raise XPathError("what is called isn't a function of so many arguments")
    return g.call(*args)


def calculate(op: str, x: Any, y: Any) -> Any:
    if hasattr(x, "arithmetic") or hasattr(y, "arithmetic"):
        return x.arithmetic(op, y) if hasattr(x, "arithmetic") else y.reflected(op, x)
    a, b = number(x), number(y)
    if isinstance(a, float) or isinstance(b, float):
        a, b = float(a), float(b)
    try:
        if op == "+":
            return a + b
        if op == "-":
            return a - b
        if op == "*":
            return a * b
        if op == "div":
            if isinstance(a, float):
                return a / b if b else float("nan") if not a or a != a else float("inf") * (1 if (a > 0) == (str(b)[0] != "-") else -1)
            q = Decimal(a) / Decimal(b)
            return int(q) if q == int(q) else q
        if op == "idiv":
            return int(Decimal(a) / Decimal(b)) if not isinstance(a, float) else int(a / b)
        if isinstance(a, float):
            import math

            return math.fmod(a, b) if b else float("nan")
        m = abs(a) % abs(b)
        return -m if a < 0 else m
    except ArithmeticError as e:
        raise XPathError(f"arithmetic: {type(e).__name__}") from None


def is_type(x: Any, name: str) -> bool:
    plain = name.removeprefix("xs:")
    if plain == "item":
        return True
    if isinstance(x, Node):
        return plain == "node" or _KINDS.get(plain) == x.kind
    kinds = {"integer": int, "int": int, "long": int, "double": float, "float": float, "boolean": bool, "string": str, "decimal": (Decimal, int), "numeric": (int, float, Decimal), "map": XMap, "array": XArray, "function": (Function, XMap, XArray)}
    if plain == "anyAtomicType":
        return not isinstance(x, (XMap, XArray, Function))
    if isinstance(x, bool):
        return plain == "boolean"
    if plain in kinds:
        return isinstance(x, kinds[plain])
    return type(x).__name__.lower() == plain.lower()


@lru_cache(1024)
def compiled(source: str) -> Compiled:
    """The expression as a function of a context."""
    from . import xpath_functions  # noqa: F401  (fills FUNCTIONS and TYPES)

    return Compiler(source).compile()


def evaluate(source: str, item: Any = None, page: Page | None = None, variables: dict[str, Items] | None = None, memo: dict | None = None) -> Items:
    """The items that the expression yields on a context item; a document stands for its html element."""
    if isinstance(item, Node) and item.kind == "document":
        item = next((n for n in item.children if n.kind == "element"), item)
    return compiled(source)(Context(item=item, page=page, variables=variables or {}, memo=memo))
