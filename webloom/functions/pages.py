"""What a page's markup says of links and main text, on trees (for the evaluator) and as columns (for Catalyst)."""

from __future__ import annotations

from collections import Counter
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html_tree import Node

_NOT_MAIN = frozenset("script noscript style i b strong span a".split())
LEAST_TEXT = 20


def root_domain(url: str) -> str:
    """The registered part of a URL's host, by label lengths: a two-letter end behind a short label takes three labels."""
    host = urlsplit(url).netloc
    labels = host.split(".")
    if len(labels) <= 2:
        return host
    wide = len(labels[-1]) == 2 and len(labels[-2]) <= 3
    return ".".join(labels[-3 if wide else -2 :])


def is_internal(href: str, url: str) -> bool:
    """Relative links, and absolute ones whose host is the page's root domain or below it."""
    root = root_domain(url)
    return not href.startswith("http") or f"://{root}" in href or f".{root}" in href


def host(url: Column) -> Column:
    """Host and port of a URL, empty where it has none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def root_domain_column(url: Column) -> Column:
    """root_domain() as built-in expressions."""
    h = host(url)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    wide = (F.length(F.element_at(labels, -1)) == 2) & (F.length(F.try_element_at(labels, F.lit(-2))) <= 3)
    return F.when(n <= 2, h).when(wide, F.array_join(F.slice(labels, -3, 3), ".")).otherwise(F.array_join(F.slice(labels, -2, 2), "."))


def is_internal_column(href: Column, url: Column) -> Column:
    """is_internal() as built-in expressions."""
    root = root_domain_column(url)
    return ~href.startswith("http") | F.contains(href, F.concat(F.lit("://"), root)) | F.contains(href, F.concat(F.lit("."), root))


def _place(n: Node) -> str:
    steps = []
    while n.parent is not None:
        alike = [s for s in n.parent.children if s.kind == "element" and s.name == n.name]
        at = next(k for k, s in enumerate(alike, 1) if s is n)
        steps.append(n.name if len(alike) == 1 else f"{n.name}[{at}]")
        n = n.parent
    return "/" + "/".join(reversed(steps))


def main_text(document: Node) -> str:
    """The text of the page's main part: of the elements with own text of over LEAST_TEXT characters, those below the parent that
    most of them have (the first of several), joined by spaces. Empty where there are none."""
    found: list[tuple[str, Node]] = []
    for body in document.named("body"):
        for n in body.walk():
            if n is body or n.kind != "element" or n.name in _NOT_MAIN:
                continue
            if any(c.kind == "text" and len(" ".join(c.value.split())) > LEAST_TEXT for c in n.children):
                found.append((_place(n), n))
    if not found:
        return ""
    parents = Counter(p.rpartition("/")[0] for p, _ in found)
    best = parents.most_common(1)[0][0]
    return " ".join(n.text() for p, n in found if best in p)
