"""The function library of the XPath evaluator: strings, numbers, sequences, maps, arrays, JSON, dates, nodes, and those of pages."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from decimal import ROUND_CEILING, ROUND_FLOOR, ROUND_HALF_EVEN, Decimal
from typing import Any
from urllib.parse import quote, urljoin, urlsplit

from . import xpath as x
from .html_tree import Node
from .pages import is_internal, main_text
from .xpath import Context, ContextRequired, Function, Items, XArray, XMap, XPathError, atoms, number, one, register_function, string, truth

# ---------------------------------------------------------------- dates and durations


class Moment:
    """A date, time or dateTime. at: seconds and parts; zone in minutes or None."""

    name = ""
    pattern: re.Pattern[str]

    def __init__(self, at: dt.datetime, zone: int | None):
        self.at, self.zone = at, zone

    @classmethod
    def parse(cls, text: str) -> Moment:
        m = cls.pattern.fullmatch(text.strip())
        if not m:
            raise XPathError(f"{text!r} isn't a {cls.name}")
        zone = m["zone"]
        minutes = None if not zone else 0 if zone == "Z" else (1 if zone[0] == "+" else -1) * (int(zone[1:3]) * 60 + int(zone[4:6]))
        g = m.groupdict()
        second = Decimal(g.get("s") or "0")
        at = dt.datetime(int(g.get("y") or 1972), int(g.get("mo") or 1), int(g.get("d") or 1), int(g.get("h") or 0), int(g.get("mi") or 0), int(second), int(second % 1 * 1_000_000))
        return cls(at, minutes)

    def instant(self) -> dt.datetime:
        return self.at - dt.timedelta(minutes=self.zone or 0)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Moment) and self.instant() == other.instant()

    def __lt__(self, other: Moment) -> bool:
        return self.instant() < other.instant()

    def __le__(self, other: Moment) -> bool:
        return self.instant() <= other.instant()

    def __hash__(self) -> int:
        return hash(self.instant())

    def _zone(self) -> str:
        if self.zone is None:
            return ""
        return "Z" if not self.zone else f"{'+' if self.zone > 0 else '-'}{abs(self.zone) // 60:02}:{abs(self.zone) % 60:02}"

    def _clock(self) -> str:
        return self.at.strftime("%H:%M:%S") + (f".{self.at.microsecond:06}".rstrip("0") if self.at.microsecond else "")

    def lexical(self) -> str:
        parts = {"date": f"{self.at:%Y-%m-%d}".rjust(10, "0"), "time": self._clock()}
        return parts.get(self.name, f"{parts['date']}T{parts['time']}") + self._zone()

    def arithmetic(self, op: str, other: Any) -> Any:
        if isinstance(other, Duration):
            sign = {"+": 1, "-": -1}[op]
            months = self.at.year * 12 + self.at.month - 1 + sign * other.months
            year, month = divmod(months, 12)
            last = (dt.date(year + (month == 11), (month + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
            at = self.at.replace(year=year, month=month + 1, day=min(self.at.day, last)) + sign * dt.timedelta(seconds=float(other.seconds))
            return type(self)(at.replace(hour=0, minute=0, second=0, microsecond=0) if self.name == "date" else at, self.zone)
        if isinstance(other, Moment) and op == "-":
            gap = self.instant() - other.instant()
            return DayTimeDuration(0, Decimal(gap.days * 86400 + gap.seconds) + Decimal(gap.microseconds) / 1_000_000)
        raise XPathError("no such arithmetic on dates")


_DAY, _CLOCK, _ZONE = r"(?P<y>\d{4})-(?P<mo>\d\d)-(?P<d>\d\d)", r"(?P<h>\d\d):(?P<mi>\d\d):(?P<s>\d\d(?:\.\d+)?)", r"(?P<zone>Z|[+-]\d\d:\d\d)?"


class Date(Moment):
    name, pattern = "date", re.compile(_DAY + _ZONE)


class Time(Moment):
    name, pattern = "time", re.compile(_CLOCK + _ZONE)


class DateTime(Moment):
    name, pattern = "dateTime", re.compile(_DAY + "T" + _CLOCK + _ZONE)


class Duration:
    _pattern = re.compile(r"(?P<sign>-)?P(?:(?P<y>\d+)Y)?(?:(?P<mo>\d+)M)?(?:(?P<d>\d+)D)?(?:T(?=\d)(?:(?P<h>\d+)H)?(?:(?P<mi>\d+)M)?(?:(?P<s>\d+(?:\.\d+)?)S)?)?")

    def __init__(self, months: int, seconds: Decimal):
        self.months, self.seconds = months, seconds

    @classmethod
    def parse(cls, text: str) -> Duration:
        m = cls._pattern.fullmatch(text.strip())
        if not m or text.strip().endswith(("P", "T")):
            raise XPathError(f"{text!r} isn't a duration")
        g = {k: Decimal(v) if v and k != "sign" else Decimal(0) for k, v in m.groupdict().items()}
        sign = -1 if m["sign"] else 1
        months, seconds = sign * int(g["y"] * 12 + g["mo"]), sign * (((g["d"] * 24 + g["h"]) * 60 + g["mi"]) * 60 + g["s"])
        if cls is DayTimeDuration and (m["y"] or m["mo"]) or cls is YearMonthDuration and (m["d"] or m["h"] or m["mi"] or m["s"]):
            raise XPathError(f"{text!r} isn't a {cls.__name__}")
        return cls(months, seconds)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Duration) and (self.months, self.seconds) == (other.months, other.seconds)

    def __lt__(self, other: Duration) -> bool:
        return (self.months, self.seconds) < (other.months, other.seconds)

    def __le__(self, other: Duration) -> bool:
        return (self.months, self.seconds) <= (other.months, other.seconds)

    def __hash__(self) -> int:
        return hash((self.months, self.seconds))

    def lexical(self) -> str:
        months, seconds = abs(self.months), abs(self.seconds)
        d, rest = divmod(seconds, 86400)
        h, rest = divmod(rest, 3600)
        mi, s = divmod(rest, 60)
        day = "".join(f"{int(v)}{k}" for v, k in ((months // 12, "Y"), (months % 12, "M"), (d, "D")) if v)
        clock = "".join(f"{int(v)}{k}" for v, k in ((h, "H"), (mi, "M")) if v) + (f"{format(s.normalize(), 'f')}S" if s else "")
        text = ("-" if self.months < 0 or self.seconds < 0 else "") + "P" + day + ("T" + clock if clock else "")
        return text if day or clock else "P0M" if isinstance(self, YearMonthDuration) else "PT0S"

    def arithmetic(self, op: str, other: Any) -> Any:
        if isinstance(other, Duration) and op in "+-":
            sign = 1 if op == "+" else -1
            return type(self)(self.months + sign * other.months, self.seconds + sign * other.seconds)
        if isinstance(other, Moment) and op == "+":
            return other.arithmetic("+", self)
        if isinstance(other, Duration) and op == "div":
            return Decimal(self.seconds) / other.seconds if other.seconds else Decimal(self.months) / other.months
        if op in ("*", "div"):
            n = Decimal(str(number(other)))
            n = n if op == "*" else 1 / n
            return type(self)(math.floor(self.months * n + Decimal("0.5")), self.seconds * n)
        raise XPathError("no such arithmetic on durations")

    def reflected(self, op: str, other: Any) -> Any:
        if op == "*":
            return self.arithmetic("*", other)
        raise XPathError("no such arithmetic on durations")


class DayTimeDuration(Duration):
    pass


class YearMonthDuration(Duration):
    pass


def _cast(kind: type) -> Any:
    def cast(v: Any) -> Any:
        if isinstance(v, kind):
            return v
        if kind is Date and isinstance(v, DateTime):
            return Date(v.at.replace(hour=0, minute=0, second=0, microsecond=0), v.zone)
        if kind is Time and isinstance(v, DateTime):
            return Time(v.at.replace(year=1972, month=1, day=1), v.zone)
        if kind is DateTime and isinstance(v, Date):
            return DateTime(v.at, v.zone)
        return kind.parse(x.text_of(v))

    return cast


def _integer(v: Any) -> int:
    if isinstance(v, str):
        if not re.fullmatch(r"\s*[+-]?\d+\s*", v):
            raise XPathError(f"{v!r} isn't an integer")
        return int(v)
    return int(number(v))


def _decimal(v: Any) -> Decimal:
    if isinstance(v, str) and not re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)\s*", v):
        raise XPathError(f"{v!r} isn't a decimal")
    return Decimal(v.strip() if isinstance(v, str) else repr(number(v)) if isinstance(v, float) else number(v))


def _double(v: Any) -> float:
    n = number(v)
    if n != n and x.text_of(v).strip() != "NaN":
        raise XPathError(f"{v!r} isn't a number")
    return float(n)


def _boolean(v: Any) -> bool:
    if isinstance(v, str):
        if v.strip() not in ("true", "false", "1", "0"):
            raise XPathError(f"{v!r} isn't a boolean")
        return v.strip() in ("true", "1")
    return truth([v])


for _name, _to in {
    "integer": _integer, "int": _integer, "long": _integer, "short": _integer, "nonNegativeInteger": _integer, "positiveInteger": _integer, "decimal": _decimal, "double": _double, "float": _double, "boolean": _boolean,
    "string": x.text_of, "anyURI": x.text_of, "untypedAtomic": x.text_of, "token": lambda v: " ".join(x.text_of(v).split()), "normalizedString": lambda v: re.sub(r"[\t\n\r]", " ", x.text_of(v)), "NCName": x.text_of, "QName": x.text_of,
    "date": _cast(Date), "time": _cast(Time), "dateTime": _cast(DateTime), "duration": _cast(Duration), "dayTimeDuration": _cast(DayTimeDuration), "yearMonthDuration": _cast(YearMonthDuration),
}.items():
    x.TYPES[f"xs:{_name}"] = _to

# ---------------------------------------------------------------- helpers


def _on(c: Context, given: tuple[Items, ...]) -> Items:
    """The argument, or the context item where there is none."""
    if given:
        return given[0]
    if c.item is None:
        raise XPathError("there is no context item")
    return [c.item]


def _simple(name: str, arity: int | tuple[int, int], f: Any) -> None:
    least, most = (arity, arity) if isinstance(arity, int) else arity
    x.FUNCTIONS[name] = (least, most, lambda c, *a: f(*a))


def _num(name: str, f: Any) -> None:
    def run(a: Items, *more: Items) -> Items:
        v = one(a)
        return [] if v is None else [f(number(v), *(one(m) for m in more))]

    _simple(name, (1, 2) if name.startswith("round") else 1, run)


def _rounded(n: Any, places: Any, mode: str) -> Any:
    k = int(places or 0)
    if isinstance(n, float) and not math.isfinite(n):
        return n
    d = Decimal(repr(n)) if isinstance(n, float) else Decimal(n)
    unit = Decimal(1).scaleb(-k)
    r = (d / unit + Decimal("0.5")).to_integral_value(ROUND_FLOOR) * unit if mode == "up" else (d / unit).to_integral_value(ROUND_HALF_EVEN) * unit
    return type(n)(r) if not isinstance(n, Decimal) else r


def _whole(mode: str) -> Any:
    def run(n: Any) -> Any:
        if isinstance(n, int) or isinstance(n, float) and not math.isfinite(n):
            return n
        return float(math.floor(n) if mode == ROUND_FLOOR else math.ceil(n)) if isinstance(n, float) else n.to_integral_value(mode)

    return run


_num("abs", abs)
_num("ceiling", _whole(ROUND_CEILING))
_num("floor", _whole(ROUND_FLOOR))
_num("round", lambda n, p=0: _rounded(n, p, "up"))
_num("round-half-to-even", lambda n, p=0: _rounded(n, p, "even"))
for _name in ("exp", "log10", "sqrt", "sin", "cos", "tan", "asin", "acos", "atan", "log"):

    def _safe(n: Any, f: Any = getattr(math, _name), name: str = _name) -> float:
        try:
            return f(float(n))
        except ValueError:
            return float("-inf") if name.startswith("log") and n == 0 else float("nan")
        except OverflowError:
            return float("inf")

    _num(f"math:{_name}", _safe)
_num("math:exp10", lambda n: 10.0**n)
_simple("math:pi", 0, lambda: [math.pi])
_simple("math:pow", 2, lambda a, b: [] if one(a) is None else [math.pow(number(one(a)), number(one(b)))])
_simple("math:atan2", 2, lambda a, b: [math.atan2(number(one(a)), number(one(b)))])


@register_function("number", 0, 1)
def _number(c: Context, *a: Items) -> Items:
    v = one(_on(c, a))
    return [float("nan") if v is None else float(number(v))]


def _picture(n: Any, picture: str) -> str:
    positive, _, negative = picture.partition(";")
    m = re.fullmatch(r"([^#0,.]*)([#0,]*)(?:\.([0#]*))?([^#0,.]*)", positive)
    if not m:
        raise XPathError(f"{picture!r} isn't a number picture")
    before, whole, part, after = m[1], m[2], m[3] or "", m[4]
    scale = 100 if "%" in before + after else 1
    d = abs(Decimal(repr(n)) if isinstance(n, float) else Decimal(n)) * scale
    d = d.quantize(Decimal(1).scaleb(-len(part)), ROUND_HALF_EVEN)
    left, _, right = format(d, "f").partition(".")
    least = part.count("0")
    while len(right) > least and right.endswith("0"):
        right = right[:-1]
    left = left.lstrip("0").rjust(whole.count("0"), "0")
    if "," in whole:
        group = len(whole) - whole.rindex(",") - 1
        left = ",".join(left[max(0, i - group) : i] for i in range(len(left), 0, -group)[::-1])
    text = before + left + ("." + right if right else "") + after
    return (negative and text or "-" + text) if n < 0 else text


_simple("format-number", (2, 3), lambda a, p, *_: [_picture(number(one(a) if a else float("nan")), string(p))])


def _format_integer(a: Items, p: Items, *_: Items) -> Items:
    n, picture = one(a), string(p)
    if n is None:
        return [""]
    n = int(number(n))
    if picture in ("A", "a"):
        text, k = "", abs(n)
        while k:
            k, r = divmod(k - 1, 26)
            text = chr(65 + r) + text
        return [("-" if n < 0 else "") + (text if picture == "A" else text.lower())]
    if picture in ("I", "i"):
        text, k = "", abs(n)
        for v, s in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "M CM D CD C XC L XL X IX V IV I".split()):
            text, k = text + s * (k // v), k % v
        return [text if picture == "I" else text.lower()]
    return [_picture(n, picture.replace("1", "0"))]


_simple("format-integer", (2, 3), _format_integer)

# ---------------------------------------------------------------- strings

x.FUNCTIONS["string"] = (0, 1, lambda c, *a: [string(_on(c, a))])
x.FUNCTIONS["string-length"] = (0, 1, lambda c, *a: [len(string(_on(c, a)))])
x.FUNCTIONS["normalize-space"] = (0, 1, lambda c, *a: [" ".join(re.split(r"[ \t\r\n]+", string(_on(c, a)).strip(" \t\r\n")))])
x.FUNCTIONS["data"] = (0, 1, lambda c, *a: atoms(_on(c, a)))
_simple("concat", (2, 99), lambda *a: ["".join(string(v) for v in a)])
_simple("string-join", (1, 2), lambda a, sep=[""]: [string(sep).join(x.text_of(v) for v in atoms(a))])  # noqa: B006
_simple("contains", (2, 3), lambda a, b, *_: [string(b) in string(a)])
_simple("starts-with", (2, 3), lambda a, b, *_: [string(a).startswith(string(b))])
_simple("ends-with", (2, 3), lambda a, b, *_: [string(a).endswith(string(b))])
_simple("substring-before", (2, 3), lambda a, b, *_: [string(a).partition(string(b))[0] if string(b) and string(b) in string(a) else ""])
_simple("substring-after", (2, 3), lambda a, b, *_: [string(a).partition(string(b))[2] if string(b) else string(a)])
_simple("upper-case", 1, lambda a: [string(a).upper()])
_simple("lower-case", 1, lambda a: [string(a).lower()])
_simple("translate", 3, lambda a, b, to: [string(a).translate({ord(ch): (string(to)[k] if k < len(string(to)) else None) for k, ch in reversed(list(enumerate(string(b))))})])
_simple("compare", (2, 3), lambda a, b, *_: [] if not a or not b else [(string(a) > string(b)) - (string(a) < string(b))])
_simple("codepoint-equal", 2, lambda a, b: [] if not a or not b else [string(a) == string(b)])
_simple("codepoints-to-string", 1, lambda a: ["".join(chr(int(number(v))) for v in atoms(a))])
_simple("string-to-codepoints", 1, lambda a: [ord(ch) for ch in string(a)])
_simple("contains-token", (2, 3), lambda a, t, *_: [any(string(t).strip() in x.text_of(v).split() for v in atoms(a))])


def _substring(a: Items, start: Items, *length: Items) -> Items:
    s, begin = string(a), number(one(start))
    if begin != begin:
        return [""]
    first = _rounded(begin, 0, "up")
    last = first + _rounded(number(one(length[0])), 0, "up") if length else math.inf
    return ["".join(ch for k, ch in enumerate(s, 1) if first <= k < last)]


_simple("substring", (2, 3), _substring)


def _regex(pattern: str, flags: str) -> re.Pattern[str]:
    bits = 0
    for f in flags:
        bits |= {"i": re.I, "s": re.S, "m": re.M, "x": re.X, "q": 0}.get(f, 0)
    if "q" in flags:
        pattern = re.escape(pattern)
    else:
        pattern = pattern.replace(r"\i", "[A-Za-z_:]").replace(r"\c", "[-.0-9:A-Z_a-z]").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d").replace(r"\p{Lu}", "[A-Z]").replace(r"\p{Ll}", "[a-z]")
        if not bits & re.M:
            pattern = re.sub(r"(?<!\\)\$$", r"\\Z", pattern)
    try:
        return re.compile(pattern, bits)
    except re.error as e:
        raise XPathError(f"{pattern!r} isn't a regular expression: {e}") from None


_simple("matches", (2, 3), lambda a, p, f=(): [_regex(string(p), string(list(f))).search(string(a)) is not None])


def _replace(a: Items, p: Items, to: Items, f: Items = []) -> Items:  # noqa: B006
    r, by = _regex(string(p), string(f)), string(to)
    if "q" in string(f):
        return [r.sub(lambda m: by, string(a))]
    by = re.sub(r"\\([\\$])|\\|\$(\d)", lambda m: {"\\": r"\\", "$": "$"}.get(m[1] or "", "") if m[1] else rf"\g<{m[2]}>" if m[2] else m[0], by)
    return [r.sub(by, string(a))]


_simple("replace", (3, 4), _replace)


def _tokenize(a: Items, p: Items | None = None, f: Items = []) -> Items:  # noqa: B006
    s = string(a)
    if p is None:
        return s.split()
    if not s:
        return []
    out, at = [], 0
    for m in _regex(string(p), string(f)).finditer(s):
        out.append(s[at : m.start()])
        at = m.end()
    return [*out, s[at:]]


_simple("tokenize", (1, 3), _tokenize)


def _analyze(a: Items, p: Items, f: Items = []) -> Items:  # noqa: B006
    s, at = string(a), 0
    root = Node("element", "analyze-string-result")

    def put(name: str, text: str) -> None:
        n = Node("element", name, "", root)
        n.children.append(Node("text", "", text, n))
        root.children.append(n)

    for m in _regex(string(p), string(f)).finditer(s):
        if m.start() > at:
            put("non-match", s[at : m.start()])
        put("match", m[0])
        at = m.end()
    if at < len(s):
        put("non-match", s[at:])
    for k, n in enumerate(root.walk()):
        n.order = k
    return [root]


_simple("analyze-string", (2, 3), _analyze)
_simple("encode-for-uri", 1, lambda a: [quote(string(a), safe="-_.~")])
_simple("iri-to-uri", 1, lambda a: [quote(string(a), safe="!#$%&'()*+,/:;=?@[]~-_.")])
_simple("escape-html-uri", 1, lambda a: ["".join(ch if " " <= ch <= "~" else quote(ch) for ch in string(a))])


@register_function("resolve-uri", 1, 2)
def _resolve(c: Context, a: Items, base: Items | None = None) -> Items:
    if not a:
        return []
    return [urljoin(string(base) if base is not None else c.page.url if c.page else "", string(a))]


# ---------------------------------------------------------------- booleans and sequences

_simple("true", 0, lambda: [True])
_simple("false", 0, lambda: [False])
_simple("not", 1, lambda a: [not truth(a)])
_simple("boolean", 1, lambda a: [truth(a)])
_simple("exists", 1, lambda a: [bool(a)])
_simple("empty", 1, lambda a: [not a])
_simple("count", 1, lambda a: [len(a)])
_simple("head", 1, lambda a: a[:1])
_simple("tail", 1, lambda a: a[1:])
_simple("reverse", 1, lambda a: a[::-1])
_simple("unordered", 1, lambda a: a)
_simple("insert-before", 3, lambda a, p, b: a[: (k := max(0, int(number(one(p))) - 1))] + b + a[k:])
_simple("remove", 2, lambda a, p: [v for k, v in enumerate(a, 1) if k != int(number(one(p)))])
_simple("deep-equal", (2, 3), lambda a, b, *_: [x.deep_equal(a, b)])
x.FUNCTIONS["position"] = (0, 0, lambda c: [c.position])
x.FUNCTIONS["last"] = (0, 0, lambda c: [c.size])


def _count(name: str, ok: Any) -> None:
    def run(a: Items) -> Items:
        if not ok(len(a)):
            raise XPathError(f"{name} got {len(a)} items")
        return a

    _simple(name, 1, run)


_count("zero-or-one", lambda n: n < 2)
_count("one-or-more", lambda n: n > 0)
_count("exactly-one", lambda n: n == 1)


def _subsequence(a: Items, start: Items, *length: Items) -> Items:
    first = _rounded(float(number(one(start))), 0, "up")
    last = first + _rounded(float(number(one(length[0]))), 0, "up") if length else math.inf
    return [v for k, v in enumerate(a, 1) if first <= k < last]


_simple("subsequence", (2, 3), _subsequence)


def _same(a: Any, b: Any) -> bool:
    try:
        return x.compare("=", a, b) or (a != a and b != b)
    except (XPathError, TypeError):
        return False


def _distinct(a: Items, *_: Items) -> Items:
    out: Items = []
    seen: set[Any] = set()
    for v in atoms(a):
        k = (type(v) if isinstance(v, (bool, str)) else 0, "NaN" if v != v else v)
        if k not in seen:
            seen.add(k)
            out.append(v)
    return out


_simple("distinct-values", (1, 2), _distinct)
_simple("index-of", (2, 3), lambda a, v, *_: [k for k, y in enumerate(atoms(a), 1) if type(y) is type(one(v)) and _same(y, one(v)) or isinstance(y, (int, float, Decimal)) and isinstance(one(v), (int, float, Decimal)) and _same(y, one(v))])


def _total(values: Items) -> Any:
    out = values[0] if hasattr(values[0], "arithmetic") else number(values[0])
    for v in values[1:]:
        out = x.calculate("+", out, v)
    return out


_simple("sum", (1, 2), lambda a, zero=(0,): [_total(v)] if (v := atoms(a)) else list(zero))
_simple("avg", 1, lambda a: [x.calculate("div", _total(v), len(v))] if (v := atoms(a)) else [])


def _extreme(op: str) -> Any:
    def run(a: Items, *_: Items) -> Items:
        values = atoms(a)
        if values and all(isinstance(v, str) for v in values):  # node values are untyped: numbers where all are
            as_numbers = [number(v) for v in values]
            values = as_numbers if any(isinstance(v, Node) for v in a) and all(n == n for n in as_numbers) else values
        if any(v != v for v in values):
            return [float("nan")]
        best = values[:1]
        for v in values[1:]:
            if x.compare(op, v, best[0]):
                best = [v]
        return best

    return run


_simple("min", (1, 2), _extreme("<"))
_simple("max", (1, 2), _extreme(">"))

# ---------------------------------------------------------------- functions on functions

_simple("for-each", 2, lambda a, f: [y for v in a for y in x.call_item(f, [[v]])])
_simple("filter", 2, lambda a, f: [v for v in a if truth(x.call_item(f, [[v]]))])
_simple("for-each-pair", 3, lambda a, b, f: [y for v, w in zip(a, b) for y in x.call_item(f, [[v], [w]])])
_simple("apply", 2, lambda f, a: x.call_item(f, list(a[0])))
_simple("sort", (1, 3), lambda a, _=None, f=None: x.sort_items(a, (lambda v: x.call_item(f, [[v]])) if f else lambda v: [v]))
_simple("function-arity", 1, lambda f: [f[0].arity if isinstance(f[0], Function) else 1])


def _fold(items: Any, zero: Items, step: Any) -> Items:
    for v in items:
        zero = step(zero, v)
    return zero


_simple("fold-left", 3, lambda a, z, f: _fold(a, z, lambda acc, v: x.call_item(f, [acc, [v]])))
_simple("fold-right", 3, lambda a, z, f: _fold(a[::-1], z, lambda acc, v: x.call_item(f, [[v], acc])))

# ---------------------------------------------------------------- maps and arrays


def _merge(a: Items, options: Items = []) -> Items:  # noqa: B006
    out = XMap()
    how = string(options[0].get("duplicates", ["use-first"])) if options else "use-first"
    for m in a:
        for k, v in m.items():
            if k in out and how == "reject":
                raise XPathError("a key is in several maps")
            out[k] = out[k] + v if k in out and how == "combine" else out[k] if k in out and how == "use-first" else v
    return [out]


_simple("map:merge", (1, 2), _merge)
_simple("map:size", 1, lambda m: [len(m[0])])
_simple("map:keys", 1, lambda m: list(m[0]))
_simple("map:contains", 2, lambda m, k: [one(k) in m[0]])
_simple("map:get", 2, lambda m, k: m[0].get(one(k), []))
_simple("map:put", 3, lambda m, k, v: [XMap({**m[0], one(k): v})])
_simple("map:entry", 2, lambda k, v: [XMap({one(k): v})])
_simple("map:remove", 2, lambda m, k: [XMap({a: b for a, b in m[0].items() if a not in atoms(k)})])
_simple("map:for-each", 2, lambda m, f: [y for k, v in m[0].items() for y in x.call_item(f, [[k], v])])


def _find(a: Items, k: Items) -> Items:
    out = XArray()

    def look(items: Items) -> None:
        for v in items:
            if isinstance(v, XMap):
                if one(k) in v:
                    out.append(v[one(k)])
                for w in v.values():
                    look(w)
            elif isinstance(v, XArray):
                for w in v:
                    look(w)

    look(a)
    return [out]


_simple("map:find", 2, _find)


def _at(a: Items, k: Items, extra: int = 0) -> int:
    n = int(number(one(k)))
    if not 1 <= n <= len(a[0]) + extra:
        raise XPathError("there is no such member of the array")
    return n - 1


def _flat(items: Items) -> Items:
    return [y for v in items for y in (_flat([w for m in v for w in m]) if isinstance(v, XArray) else [v])]


_simple("array:size", 1, lambda a: [len(a[0])])
_simple("array:get", 2, lambda a, k: a[0][_at(a, k)])
_simple("array:put", 3, lambda a, k, v: [XArray([*a[0][: _at(a, k)], v, *a[0][_at(a, k) + 1 :]])])
_simple("array:append", 2, lambda a, v: [XArray([*a[0], v])])
_simple("array:subarray", (2, 3), lambda a, k, n=None: [XArray(a[0][_at(a, k, 1) :][: None if n is None else int(number(one(n)))])])
_simple("array:remove", 2, lambda a, k: [XArray(v for i, v in enumerate(a[0], 1) if i not in {int(number(n)) for n in atoms(k)})])
_simple("array:insert-before", 3, lambda a, k, v: [XArray([*a[0][: _at(a, k, 1)], v, *a[0][_at(a, k, 1) :]])])
_simple("array:head", 1, lambda a: a[0][0])
_simple("array:tail", 1, lambda a: [XArray(a[0][1:])])
_simple("array:reverse", 1, lambda a: [XArray(a[0][::-1])])
_simple("array:join", 1, lambda a: [XArray(v for m in a for v in m)])
_simple("array:for-each", 2, lambda a, f: [XArray(x.call_item(f, [v]) for v in a[0])])
_simple("array:filter", 2, lambda a, f: [XArray(v for v in a[0] if truth(x.call_item(f, [v])))])
_simple("array:for-each-pair", 3, lambda a, b, f: [XArray(x.call_item(f, [v, w]) for v, w in zip(a[0], b[0]))])
_simple("array:fold-left", 3, lambda a, z, f: _fold(a[0], z, lambda acc, v: x.call_item(f, [acc, v])))
_simple("array:fold-right", 3, lambda a, z, f: _fold(a[0][::-1], z, lambda acc, v: x.call_item(f, [v, acc])))
_simple("array:sort", (1, 3), lambda a, _=None, f=None: [XArray(x.sort_items(list(a[0]), (lambda v: x.call_item(f, [v])) if f else lambda v: v))])
_simple("array:flatten", 1, _flat)

# ---------------------------------------------------------------- JSON


def _from_json(v: Any) -> Items:
    if v is None:
        return []
    if isinstance(v, dict):
        return [XMap({k: _from_json(w) for k, w in v.items()})]
    if isinstance(v, list):
        return [XArray(_from_json(w) for w in v)]
    return [float(v) if isinstance(v, int) and not isinstance(v, bool) else v]


def plain(items: Items) -> Any:
    """A sequence as plain Python data: one item stands for itself, several are a list, none an empty list; nodes are their text."""
    if len(items) == 1:
        v = items[0]
        if isinstance(v, XMap):
            return {x.text_of(k): plain(w) for k, w in v.items()}
        if isinstance(v, XArray):
            return [plain(w) for w in v]
        if isinstance(v, Node):
            return v.text() if v.kind != "element" else v.text().strip()
        if isinstance(v, Decimal):
            return int(v) if v == int(v) else float(v)
        return v if isinstance(v, (str, bool, int, float)) else x.text_of(v)
    return [plain([v]) for v in items]


def _strict(items: Items) -> Any:
    return None if not items else plain(items)


def _parse_json(a: Items, *_: Items) -> Items:
    try:
        return _from_json(json.loads(string(a)))
    except ValueError as e:
        raise XPathError(f"not JSON: {e}") from None


_simple("parse-json", (1, 2), _parse_json)


def _serialize(a: Items, options: Items = []) -> Items:  # noqa: B006
    how = string(options[0].get("method", [""])) if options and isinstance(options[0], XMap) else ""
    if how == "json" or not how and any(isinstance(v, (XMap, XArray)) for v in a):
        return [json.dumps(_strict(a), ensure_ascii=False, separators=(",", ":"))]
    return [" ".join(v.html() if isinstance(v, Node) else x.text_of(v) for v in a)]


_simple("serialize", (1, 2), _serialize)


def _json_to_xml(a: Items, *_: Items) -> Items:
    def build(v: Any, key: str | None) -> Node:
        kind = "map" if isinstance(v, dict) else "array" if isinstance(v, list) else "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"
        n = Node("element", kind)
        if key is not None:
            n.attributes.append(Node("attribute", "key", key, n))
        if isinstance(v, (dict, list)):
            for k, w in v.items() if isinstance(v, dict) else ((None, w) for w in v):
                child = build(w, k)
                child.parent = n
                n.children.append(child)
        elif v is not None:
            n.children.append(Node("text", "", x.text_of(v), n))
        return n

    document = Node("document")
    root = build(json.loads(string(a)), None)
    root.parent = document
    document.children.append(root)
    for k, n in enumerate(document.walk()):
        n.order = k
    return [document]


def _xml_to_json(a: Items, *_: Items) -> Items:
    def read(n: Node) -> Any:
        inner = [c for c in n.children if c.kind == "element"]
        if n.name == "map":
            return {c.get("key"): read(c) for c in inner}
        if n.name == "array":
            return [read(c) for c in inner]
        return {"null": lambda t: None, "boolean": lambda t: t == "true", "number": lambda t: float(t) if "." in t else int(t)}.get(n.name, str)(n.text())

    n = a[0]
    return [json.dumps(read(n.children[0] if n.kind == "document" else n), ensure_ascii=False, separators=(",", ":"))]


_simple("json-to-xml", (1, 2), _json_to_xml)
_simple("xml-to-json", (1, 2), _xml_to_json)

# ---------------------------------------------------------------- dates


def _now() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)


_simple("current-date", 0, lambda: [Date(_now().replace(hour=0, minute=0, second=0, microsecond=0), 0)])
_simple("current-dateTime", 0, lambda: [DateTime(_now(), 0)])
_simple("current-time", 0, lambda: [Time(_now().replace(year=1972, month=1, day=1), 0)])
_simple("implicit-timezone", 0, lambda: [DayTimeDuration(0, Decimal(0))])


def _part(name: str, f: Any) -> None:
    def run(a: Items) -> Items:
        v = one(a)
        if v is None:
            return []
        if isinstance(v, str):
            v = DateTime.parse(v) if "T" in v else Time.parse(v) if ":" in v[:3] else Date.parse(v)
        r = f(v)
        return [] if r is None else [r]

    _simple(name, 1, run)


def _seconds(m: Moment) -> Any:
    return Decimal(m.at.second) + Decimal(m.at.microsecond) / 1_000_000


for _of, _parts in {"date": "year month day timezone", "time": "hours minutes seconds timezone", "dateTime": "year month day hours minutes seconds timezone"}.items():
    for _p in _parts.split():
        _part(f"{_p}-from-{_of}", {"year": lambda m: m.at.year, "month": lambda m: m.at.month, "day": lambda m: m.at.day, "hours": lambda m: m.at.hour, "minutes": lambda m: m.at.minute, "seconds": _seconds, "timezone": lambda m: None if m.zone is None else DayTimeDuration(0, Decimal(m.zone * 60))}[_p])
for _p, _f in {"years": lambda d: int(d.months / 12), "months": lambda d: int(math.fmod(d.months, 12)), "days": lambda d: int(d.seconds / 86400), "hours": lambda d: int(math.fmod(d.seconds, 86400) / 3600), "minutes": lambda d: int(math.fmod(d.seconds, 3600) / 60), "seconds": lambda d: d.seconds % 60 if d.seconds >= 0 else -(-d.seconds % 60)}.items():

    def _of_duration(a: Items, f: Any = _f) -> Items:
        v = one(a)
        return [] if v is None else [f(Duration.parse(v) if isinstance(v, str) else v)]

    _simple(f"{_p}-from-duration", 1, _of_duration)


def _adjust(a: Items, *zone: Items) -> Items:
    m = one(a)
    if m is None:
        return []
    to = int(one(zone[0]).seconds / 60) if zone and zone[0] else None if zone else 0
    if to is None or m.zone is None:
        return [type(m)(m.at, to)]
    at = m.at + dt.timedelta(minutes=to - m.zone)
    return [type(m)(at.replace(hour=0, minute=0, second=0, microsecond=0) if m.name == "date" else at, to)]


for _of in ("date", "dateTime", "time"):
    _simple(f"adjust-{_of}-to-timezone", (1, 2), _adjust)

_SIGNS = {"Y": "%Y", "M": "%m", "D": "%d", "d": "%j", "H": "%H", "h": "%I", "m": "%M", "s": "%S", "F": "%A", "P": "%p", "W": "%V"}


def _format(a: Items, picture: Items, *_: Items) -> Items:
    m = one(a)
    if m is None:
        return []

    def sign(g: re.Match[str]) -> str:
        k, how = g[1][0], g[1][1:].strip()
        if k == "Z":
            return m._zone().replace("Z", "+00:00")
        if k == "f":
            return f"{m.at.microsecond:06}"[: max(1, len(how))]
        if how.startswith(("Nn", "N", "n")):
            text = m.at.strftime({"M": "%B", "F": "%A", "P": "%p"}[k])
            limit = re.search(r",\*?-?(\d+)$", how)
            text = text[: int(limit[1])] if limit else text
            return text if how.startswith("Nn") else text.upper() if how[0] == "N" else text.lower()
        text = m.at.strftime(_SIGNS[k])
        if k == "P":
            return text.lower()
        if k == "F":
            return text
        if not text.isdigit():
            return text
        wide = len(re.match(r"\d*", how)[0]) or (2 if k in "ms" and not how else 1)
        return text.lstrip("0").rjust(wide, "0") if not (k == "Y" and wide == 2) else text[-2:]

    return [re.sub(r"\[([A-Za-z][^\]]*)\]", sign, string(picture))]


for _of in ("date", "dateTime", "time"):
    _simple(f"format-{_of}", (2, 5), _format)


def _ietf(a: Items) -> Items:
    from email.utils import parsedate_to_datetime

    if not a:
        return []
    try:
        at = parsedate_to_datetime(string(a))
    except ValueError as e:
        raise XPathError(str(e)) from None
    zone = int(at.utcoffset().total_seconds() / 60) if at.utcoffset() is not None else 0
    return [DateTime(at.replace(tzinfo=None), zone)]


_simple("parse-ietf-date", 1, _ietf)

# ---------------------------------------------------------------- nodes


def _of_node(name: str, f: Any) -> None:
    def run(c: Context, *a: Items) -> Items:
        got = _on(c, a)
        if not got:
            return [""] if name.endswith("name") and name != "node-name" else []
        if not isinstance(got[0], Node):
            raise XPathError(f"{name} needs a node")
        return f(got[0])

    x.FUNCTIONS[name] = (0, 1, run)


def _path(n: Node) -> str:
    steps = []
    while n.parent is not None:
        alike = [s for s in n.parent.children if (s.kind, s.name) == (n.kind, n.name)]
        steps.append(f"@{n.name}" if n.kind == "attribute" else f"{n.name if n.kind == 'element' else n.kind + '()'}[{next((k for k, s in enumerate(alike, 1) if s is n), 1)}]")
        n = n.parent
    return "/" + "/".join(reversed(steps))


_of_node("name", lambda n: [n.name])
_of_node("local-name", lambda n: [n.name.rpartition(":")[2]])
_of_node("node-name", lambda n: [n.name] if n.name else [])
_of_node("namespace-uri", lambda n: [""])
_of_node("root", lambda n: [n.top()])
_of_node("path", lambda n: [_path(n)])
_of_node("has-children", lambda n: [bool(n.children)])
_of_node("nilled", lambda n: [False] if n.kind == "element" else [])


@register_function("base-uri", 0, 1)
def _base_uri(c: Context, *a: Items) -> Items:
    return [c.page.url] if c.page and (not a or a[0]) else []


x.FUNCTIONS["document-uri"] = (0, 1, _base_uri)
x.FUNCTIONS["static-base-uri"] = (0, 0, _base_uri)
_simple("innermost", 1, lambda a: x.in_order([n for n in a if not any(m is not n and n in m_up for m, m_up in ((m, x.AXES["ancestor"](m)) for m in a))]))
_simple("outermost", 1, lambda a: x.in_order([n for n in a if not any(m is not n and m in x.AXES["ancestor"](n) for m in a)]))


@register_function("id", 1, 2)
def _id(c: Context, a: Items, *_: Items) -> Items:
    wanted = {t for v in atoms(a) for t in x.text_of(v).split()}
    return [n for n in x._node(c).top().walk() if n.kind == "element" and n.get("id") in wanted]


@register_function("lang", 1, 2)
def _lang(c: Context, a: Items, *n: Items) -> Items:
    at: Node | None = _on(c, n[:1])[0]
    while at is not None:
        have = at.get("xml:lang") or at.get("lang") if at.kind == "element" else None
        if have:
            return [have.lower() == string(a).lower() or have.lower().startswith(string(a).lower() + "-")]
        at = at.parent
    return [False]


def _refuse(name: str, arity: tuple[int, int]) -> None:
    def run(*_: Items) -> Items:
        raise XPathError(f"{name} reads what is outside the page, which expressions may not")

    _simple(name, arity, run)


for _name in ("doc", "collection", "unparsed-text", "environment-variable", "json-doc", "doc-available"):
    _refuse(_name, (0, 2))


@register_function("error", 0, 3)
def _error(c: Context, *a: Items) -> Items:
    raise XPathError(string(a[1]) if len(a) > 1 else string(a[0]) if a else "error()")


# ---------------------------------------------------------------- pages


def _page(c: Context) -> x.Page:
    if c.page is None:
        raise ContextRequired("the function needs a page")
    return c.page


def _hrefs(c: Context) -> list[Node]:
    return [a for n in x._node(c).top().named("a") for a in n.attributes if a.name == "href"]


_WX = {
    "depth": lambda c: [_page(c).depth],
    "backlink": lambda c: [_page(c).backlink or ""],
    "current-url": lambda c: [_page(c).url],
    "fetch-time": lambda c: [] if _page(c).latency is None else [_page(c).latency],
    "elapsed": lambda c: [] if _page(c).latency is None else [_page(c).latency],
    "status-code": lambda c: [_page(c).status],
    "elem": lambda c: [x._node(c)] if _page(c) else [],
    "internal-links": lambda c: [a for a in _hrefs(c) if is_internal(a.value, _page(c).url)],
    "external-links": lambda c: [a for a in _hrefs(c) if not is_internal(a.value, _page(c).url)],
    "main-article-text": lambda c: [main_text(x._node(c).top()) if _page(c) else ""],
}
for _name, _f in _WX.items():
    x.FUNCTIONS[f"wx:{_name}"] = (0, 0, _f)
    del _name


def host_of(url: str) -> str:
    return urlsplit(url).netloc
