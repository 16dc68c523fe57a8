"""A tolerant HTML tree builder: always one html root with provenance kept outside the tree."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import escape, unescape
from html.entities import html5
from html.parser import HTMLParser
from sys import intern

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
_INLINE = frozenset("a b big code em font i s small span strike strong sub sup tt u".split())
_HEAD = frozenset("base link meta noscript script style template title".split())
#: Opening a tag ends an open element of these, looking outward no further than the second set.
_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody"]), frozenset(["table"])),
    "a": (frozenset(["a"]), _BLOCK | {"td", "th", "li"}),
}
_WALL = frozenset(["td", "th", "table", "body", "html"])
_TABLE = frozenset(["tr", "td", "th", "tbody", "tfoot"])
_ENDS = {tag: (ends, walls if tag in _TABLE else walls | _WALL) for tag, (ends, walls) in _ENDS.items()}
_ROOTS = frozenset(["html", "head", "body"])
_CLOSES_P = _BLOCK | {"td", "th"}


class Node:
    """kind: document, element, text, comment or attribute; order: place in document order (attributes after their element)."""

    __slots__ = ("kind", "name", "value", "parent", "children", "attributes", "order", "_names")

    def __init__(self, kind: str, name: str = "", value: str = "", parent: Node | None = None):
        self.kind, self.name, self.value, self.parent = kind, name, value, parent
        inner = kind in ("element", "document")  # of the others a page has the most; they need no lists
        self.children: Sequence[Node] = [] if inner else ()
        self.attributes: Sequence[Node] = [] if inner else ()
        self.order = 0
        self._names: dict[str, list[Node]] | None = None

    def get(self, name: str) -> str | None:
        return next((a.value for a in self.attributes if a.name == name), None)

    def walk(self) -> Iterator[Node]:
        """This node and its descendants, in document order."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(reversed(n.children))

    def text(self) -> str:
        """The string value."""
        if self.kind in ("text", "comment", "attribute"):
            return self.value
        return "".join(n.value for n in self.walk() if n.kind == "text")

    def top(self) -> Node:
        n = self
        while n.parent is not None:
            n = n.parent
        return n

    def named(self, name: str) -> list[Node]:
        """Descendant elements of that name (* for any) of a document, from an index that is made once."""
        if self._names is None:
            self._names = {"*": []}
            for n in self.walk():
                if n.kind == "element":
                    self._names["*"].append(n)
                    self._names.setdefault(n.name, []).append(n)
        return self._names.get(name, [])

    def parents_of(self, name: str) -> list[Node]:
        """Nodes of a document that have child elements of that name."""
        return list({id(n.parent): n.parent for n in self.named(name)}.values())

    def html(self) -> str:
        """Outer HTML."""
        out: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.kind == "text":
                raw = n.parent is not None and n.parent.name in ("script", "style")
                out.append(n.value if raw else escape(n.value, quote=False))
            elif n.kind == "comment":
                out.append(f"<!--{n.value}-->")
            elif n.kind == "attribute":
                out.append(f'{n.name}="{escape(n.value)}"')
            else:
                if n.kind == "element":
                    out.append("<" + n.name + "".join(f' {a.name}="{escape(a.value)}"' for a in n.attributes) + ">")
                    if n.name not in VOID:
                        todo.append(f"</{n.name}>")
                todo.extend(reversed(n.children))
        return "".join(out)


class _Tree:
    """Nodes are made in document order; late tells that an element got attributes after others were made."""

    def __init__(self) -> None:
        self.made, self.late = 1, False
        self.document = Node("document")
        self.root = self._append(self.document, Node("element", "html"))
        self.head: Node | None = None
        self.body: Node | None = None
        self.stack = [self.root]

    def _append(self, parent: Node, child: Node) -> Node:
        child.parent, child.order = parent, self.made
        self.made += 1
        parent.children.append(child)
        return child

    def _open(self, name: str) -> Node:
        n = self._append(self.stack[-1], Node("element", name))
        self.stack.append(n)
        return n

    def _attributes(self, n: Node, attrs: list[tuple[str, str | None]]) -> None:
        for k, v in attrs:
            if not n.attributes or n.get(k) is None:
                self.late |= n.order + len(n.attributes) + 1 != self.made
                a = Node("attribute", k, v if v is not None else "", n)
                a.order = self.made
                self.made += 1
                n.attributes.append(a)

    def _in_body(self) -> None:
        if self.body is None:
            del self.stack[1:]
            self.body = self._open("body")

    def _place(self, tag: str) -> None:
        """Opens head or body, as there is no body yet, where the tag needs one."""
        if tag not in _HEAD:
            self._in_body()
        elif self.head is None:
            self.head = self._open("head")
        elif self.head not in self.stack:
            self._in_body()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _ROOTS:
            if tag == "html":
                n = self.root
            elif tag == "body":
                self._in_body()
                n = self.body
            else:
                if self.head is None and self.body is None:
                    self.head = self._open("head")
                n = self.head
            if n is not None:
                self._attributes(n, attrs)
            return
        if self.body is None:
            self._place(tag)
        if tag in _CLOSES_P:
            while self.stack[-1].name in _INLINE and self._has_open("p"):
                self.stack.pop()
            if tag in _BLOCK and self._has_open("p"):
                self._close("p")
        if tag in _ENDS:
            ends, walls = _ENDS[tag]
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].name in ends:
                    del self.stack[k:]
                    break
                if self.stack[k].name in walls:
                    break
        n = self._open(tag)
        self._attributes(n, attrs)
        if tag in VOID:
            self.stack.pop()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].name == tag:
            self.stack.pop()

    def _has_open(self, tag: str) -> bool:
        for n in reversed(self.stack):
            if n.name == tag:
                return True
            if n.name in _WALL:
                return False
        return False

    def _close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].name == tag:
                del self.stack[k:]
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or tag in ("html", "body"):
            return
        if tag in _INLINE and not self._has_open(tag):
            return
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if not data:
            return
        at = self.stack[-1]
        if at is self.root or at is self.head:
            if not data.strip():
                return
            self._in_body()
        at = self.stack[-1]
        if at.children and at.children[-1].kind == "text":
            at.children[-1].value += data
        else:
            self._append(at, Node("text", "", data))

    def handle_comment(self, data: str) -> None:
        self._append(self.stack[-1], Node("comment", "", data))


class _Builder(_Tree, HTMLParser):
    def __init__(self) -> None:
        HTMLParser.__init__(self, convert_charrefs=True)
        _Tree.__init__(self)


#: Text, opening and closing tags and comments as they mostly are: on these HTMLParser and _scan() agree.
_PLAIN = re.compile(r"""([^<]+)|<([a-z][a-z0-9]*)((?:[ \n\t]+[a-z][a-z0-9-]*=(?:"[^"<>&]*"|'[^'<>&]*'))*)[ \n\t]*>|</([a-z][a-z0-9]*)>|<!--([^<>-]*)-->""")
_ATTRIBUTE = re.compile(r"""([a-z][a-z0-9-]*)=(?:"([^"]*)"|'([^']*)')""")
_TITLE = re.compile(r"[^<]*</title>")
#: Elements whose text is no markup.
_RAW = frozenset("iframe math noembed noframes noscript plaintext script style svg textarea xmp".split())


def _scan(source: str) -> _Tree | None:
    """The tree that _Builder makes, some times as fast; None for a source with anything but what _PLAIN has."""
    tree, at = _Tree(), 0
    for m in _PLAIN.finditer(source):
        if m.start() != at:
            return None
        at = m.end()
        text, tag, attributes, end, comment = m.groups()
        if text is not None:
            tree.handle_data(unescape(text) if "&" in text else text)
        elif tag is not None:
            if tag in _RAW or tag == "title" and not _TITLE.match(source, at):
                return None
            tree.handle_starttag(intern(tag), [(intern(k), v or w) for k, v, w in _ATTRIBUTE.findall(attributes)] if attributes else [])
        elif end is not None:
            tree.handle_endtag(end)
        else:
            tree.handle_comment(comment)
    return tree if at == len(source) else None


_REFERENCE = re.compile(r"&([A-Za-z][A-Za-z0-9]*)(;?)")
#: Characters that stand for the ampersands of what is no reference while a page is parsed.
_MARKS = [chr(x) for x in range(0xFDD0, 0xFDF0)]


def _marked(source: str) -> tuple[str, str]:
    """The source with a mark, which is returned too, for each ampersand before a name that is unknown or not ended by a semicolon: these
    stand for themselves, as libxml2 has it (before its 2.14)."""
    if all(m[2] and m[1] + ";" in html5 for m in _REFERENCE.finditer(source)):
        return source, ""
    mark = next((m for m in _MARKS if m not in source), "")
    return (_REFERENCE.sub(lambda m: m[0] if m[2] and m[1] + ";" in html5 else mark + m[0][1:], source) if mark else source), mark


def parse_html(source: str | bytes) -> Node:
    """The document node of a page; its only child is the html element."""
    if isinstance(source, bytes):
        source = source.decode("utf-8", "replace")
    source, mark = _marked(source) if "&" in source else (source, "")
    b = _scan(source)
    if b is None:
        b = _Builder()
        b.feed(source)
        b.close()
    if not b.late and not mark:
        return b.document
    order = 0
    for n in b.document.walk():
        n.order = order
        order += 1
        for a in n.attributes:
            a.order = order
            order += 1
        if mark:
            for x in (n, *n.attributes):
                x.name, x.value = x.name.replace(mark, "&"), x.value.replace(mark, "&")
    return b.document
