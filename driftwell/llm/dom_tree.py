"""HTML text as a tree of block elements with one leaf for each block of text.

Inline elements do not make nodes: a leaf is the text between two block boundaries, with the number of its characters
inside links.  End tags may be missing; a paragraph ends where another block starts, a list item at the next one.  Every
rule works in one pass, without recursion, and nesting beyond ``DEPTH`` is flattened, so no text is lost and time stays
linear in the page's length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

DEPTH = 512
_NAME = r"[A-Za-z][^\s/>\x00]*+"
_REST = r"""(?:=\s*+(?:"[^"]*+"?+|'[^']*+'?+|[^\s>"'][^\s>]*+|)|[^=>]++)*+"""
_TOKEN = re.compile(rf"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(?P<end>/?)(?P<name>{_NAME})(?P<rest>{_REST})(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>"']*+)))?""")

#: Fixed values of HTML: elements without content, with content that is no markup, inside a line, that end a paragraph,
#: and what each start tag ends (names, and the elements that the search does not leave).
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big blink cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
HEAD = frozenset("base basefont bgsound link meta title script style noscript template noframes".split())
_SCOPE = frozenset("html table td th caption button object marquee applet template".split())
_LISTS = _SCOPE | {"ul", "ol", "menu", "dir"}
_TABLE = frozenset({"html", "table", "template"})
ENDS = {
    "li": (("li",), _LISTS), "dd": (("dd", "dt"), _SCOPE | {"dl"}), "dt": (("dd", "dt"), _SCOPE | {"dl"}), "option": (("option",), _SCOPE | {"select"}),
    "td": (("td", "th"), _TABLE), "th": (("td", "th"), _TABLE), "tr": (("tr",), _TABLE),
    "thead": (("thead", "tbody", "tfoot"), _TABLE), "tbody": (("thead", "tbody", "tfoot"), _TABLE), "tfoot": (("thead", "tbody", "tfoot"), _TABLE),
}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_PARTS = frozenset("table caption thead tbody tfoot tr td th".split())
_CONTROLS = frozenset("html table td th caption template".split())


@dataclass
class Tree:
    """Nodes in page order, parents first; node 0 is the page.  ``tag`` is "" for leaves."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    hint: list[str] = field(default_factory=lambda: [""])
    text: list[str] = field(default_factory=lambda: [""])
    linked: list[int] = field(default_factory=lambda: [0])
    label: list[int] = field(default_factory=lambda: [-1])


def attributes(rest: str) -> dict[str, str]:
    """Attributes of a tag, the first of each name."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), unescape(values[0] or values[1] or values[2]))
    return found


def _hint(rest: str) -> tuple[str, int]:
    """What names an element (classes, id, role, and whether it is hidden), and its label if it has one."""
    if not rest.strip("/ \t\n\r\f"):
        return "", -1
    a = attributes(rest)
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    names = " ".join(filter(None, (a.get("class"), a.get("id"), a.get("role"), a.get("itemprop"))))
    return f"{names.lower()} {'hidden' if hidden else ''}".strip(), {"content": 1, "other": 0}.get(a.get("data-label", ""), -1)


class _Builder:
    def __init__(self):
        self.tree = Tree()
        self.open: list[tuple[str, int]] = [("html", 0)]  # name, and the node of it or of the block it is in
        self.count: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        """Ends the block of text that is open."""
        text = " ".join("".join(self.parts).split())
        if text:
            self.node("", self.open[-1][1], "", text, self.linked, -1)
        self.parts, self.linked = [], 0

    def node(self, tag: str, parent: int, hint: str = "", text: str = "", linked: int = 0, label: int = -1) -> int:
        t = self.tree
        for column, value in ((t.parent, parent), (t.tag, tag), (t.hint, hint), (t.text, text), (t.linked, linked), (t.label, label)):
            column.append(value)
        return len(t.tag) - 1

    def pop(self, size: int) -> None:
        """Closes elements until ``size`` are open."""
        if any(name not in INLINE for name, _ in self.open[size:]):
            self.flush()
        for name, _ in self.open[size:]:
            self.count[name] -= 1
        del self.open[size:]

    def close(self, names: tuple[str, ...] | frozenset[str], stop: frozenset[str]) -> None:
        """Closes the nearest open element of one of the names, if no element of ``stop`` is nearer."""
        if not any(self.count.get(n) for n in names):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in names:
                return self.pop(k)
            if self.open[k][0] in stop:
                return None

    def text(self, raw: str) -> None:
        if self.count.get("head") and not raw.isspace():
            self.close(("head",), frozenset())
        text = unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if self.count.get("a"):
            self.linked += len(text)

    def start(self, name: str, rest: str) -> None:
        if name in ("html", "body") and self.count.get("body") or name == "html":
            return
        if self.count.get("head") and name not in HEAD:
            self.close(("head",), frozenset())
        if name == "br" or name == "wbr":
            self.parts.append(" " if name == "br" else "")
            return
        if name in INLINE:
            if name == "a":
                self.close(("a",), _SCOPE)
            if name not in VOID:
                self.push(name, self.open[-1][1])
            return
        if name in ENDS_P:
            self.close(("p",), _SCOPE)
        if name in _HEADINGS and self.open[-1][0] in _HEADINGS:
            self.pop(len(self.open) - 1)
        if name in ENDS:
            self.close(*ENDS[name])
        self.flush()
        if name in VOID:
            return
        if len(self.open) >= DEPTH:
            self.pop(DEPTH - 1)
        hint, label = _hint(rest)
        self.push(name, self.node(name, self.open[-1][1], hint, label=label))

    def push(self, name: str, node: int) -> None:
        if len(self.open) >= DEPTH:
            self.pop(DEPTH - 1)
            node = self.open[-1][1] if name in INLINE else node
        self.open.append((name, node))
        self.count[name] = self.count.get(name, 0) + 1

    def end(self, name: str) -> None:
        if name == "br":
            self.parts.append(" ")
        elif name == "p" and not self.count.get("p"):
            self.flush()
        elif name in INLINE:
            if self.count.get(name):
                for k in range(len(self.open) - 1, 0, -1):
                    if self.open[k][0] == name:
                        return self.pop(k)
                    if self.open[k][0] not in INLINE:
                        return None
        elif name in ("html", "body"):
            self.flush()
        else:
            self.close(_HEADINGS if name in _HEADINGS else (name,), _TABLE - {name} if name in _PARTS else _CONTROLS)


def parse(html: str | None) -> Tree:
    """The tree of a page; a null or empty page is node 0 alone.  Comments, scripts, styles and titles are left out."""
    html, b, at = html or "", _Builder(), 0
    while at < len(html):
        found = _TOKEN.search(html, at)
        if found is None:
            break
        if found.start() > at:
            b.text(html[at : found.start()])
        at, name = found.end(), found["name"]
        if name is None:
            continue
        name = name.lower()
        if found["end"]:
            b.end(name)
        elif name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else len(html)
            if name not in HEAD:
                b.flush()
        elif name == "plaintext":
            break
        else:
            b.start(name, found["rest"])
    if at < len(html):
        b.text(html[at:])
    b.flush()
    return b.tree
