"""A page's tree of blocks: elements that form blocks, and the runs of text directly inside them as leaves.

The parser is lenient the way browsers are: optional end tags, unclosed and stray tags, quotes only after ``=``, cut-off
pages.  An svg or math ends at ``/>`` or at the tags that HTML lets leave it, and a form control or embedded object that
is never closed ends at the next block.  Inline elements are part of their block's text.  Scripts, styles, the head, form controls and embedded objects
have no text.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z][^>]*+\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I | re.S)

#: Elements of HTML by their part in a page (fixed values of the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset("head noscript template svg math canvas object audio video select button datalist map".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre search section summary table caption thead tbody tfoot tr td th ul".split()
)
#: Open elements that the start of an element closes, up to the nearest of the given holders.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
}
#: Elements that may stand in a head; any other start tag, and text, ends an open one.
_IN_HEAD = frozenset("title meta link base basefont bgsound script style noscript noframes template head".split())
#: Start tags that leave an open svg or math, and elements inside those where HTML goes on (fixed values of the HTML standard).
_BREAK_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
_POINTS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
_FONT = re.compile(r"(?:^|\s)(?:color|face|size)\s*(?:=|\s|$)", re.I)
#: Skipped elements that end with the next block where their own end tag is missing.
_LOOSE = frozenset("button select datalist map object audio video canvas noscript".split())
_ENDS = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])", re.I) for tag in _LOOSE}
#: Void elements that part words.
_INLINE_SPACE = frozenset("br hr img input".split())


@dataclass(slots=True)
class Node:
    """A block element, or (tag "") a leaf of text."""

    tag: str
    parent: int
    names: str = ""
    label: str = ""
    text: str = ""
    length: int = 0
    linked: int = 0
    depth: int = 0


@dataclass(slots=True)
class _Open:
    tag: str
    node: int
    skip: bool
    link: bool
    loose: bool = False


@dataclass(slots=True)
class _Run:
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def parse(page: str) -> list[Node]:
    """The nodes of a page in page order, parents before children; node 0 is the root."""
    nodes = [Node("root", -1)]
    stack = [_Open("root", 0, False, False)]
    run = _Run()

    def flush() -> None:
        if run.parts:
            text = "".join(run.parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                parent = stack[-1].node
                nodes.append(Node("", parent, text=text, length=len(text), linked=min(run.linked, len(text)), depth=nodes[parent].depth + 1))
            run.parts.clear()
            run.linked = 0

    def add(text: str) -> None:
        top = stack[-1]
        if not top.skip and text:
            run.parts.append(text)
            if top.link:
                run.linked += len(text)

    def pop_to(k: int) -> None:
        if any(o.tag in BLOCKS for o in stack[k:]):
            flush()
        del stack[k:]

    def end_head() -> None:
        """The head ends, closed or not, where something begins that cannot stand in it."""
        if stack[-1].tag == "head":
            stack.pop()

    def foreign() -> int:
        """The place of the open svg or math that text would be in just here; 0 if there is none."""
        for k in range(len(stack) - 1, 0, -1):
            if not stack[k].skip or stack[k].tag in _POINTS:
                break
            if stack[k].tag in ("svg", "math"):
                return k
        return 0

    def end_loose() -> None:
        """A block ends the skipped elements around it that have no end tag."""
        last = 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].loose:
                last = k
            elif not stack[k].skip or stack[k].tag in SKIPPED:
                break
        if last:
            pop_to(last)

    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        if m.start() > at:
            if not page[at : m.start()].isspace():
                end_head()
            add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in ("p", "br") and stack[-1].skip and (outer := foreign()):
                pop_to(outer)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    pop_to(k)
                    break
                if stack[k].tag in ("td", "th", "table") and tag not in BLOCKS:
                    break
            continue
        if stack[-1].skip and (outer := foreign()):
            if tag in _BREAK_OUT or tag == "font" and _FONT.search(m[3]):
                pop_to(outer)
            else:
                if not m[3].endswith("/"):
                    stack.append(_Open(tag, stack[-1].node, True, False))
                continue
        if tag not in _IN_HEAD:
            end_head()
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = len(page) if end is None else end.start()
            continue
        if tag in VOID:
            if tag in _INLINE_SPACE:
                add(" ")
            continue
        if tag in SKIPPED:
            if tag not in ("svg", "math") or not m[3].endswith("/"):
                own_end = _ENDS[tag].search(page, at) if tag in _LOOSE else None
                stack.append(_Open(tag, stack[-1].node, True, False, tag in _LOOSE and (own_end is None or not own_end[1])))
            continue
        if tag not in BLOCKS:
            if not m[3].endswith("/"):
                top = stack[-1]
                stack.append(_Open(tag, top.node, top.skip, top.link or tag == "a"))
            continue
        if stack[-1].skip:
            end_loose()
        if tag in ("html", "body"):
            flush()
            # The head ends where the body begins, closed or not.
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "head":
                    del stack[k:]
                    break
        closes, holders = CLOSES.get(tag, ((), ()))
        for k in range(len(stack) - 1, 0, -1) if closes else ():
            if k < len(stack) and stack[k].tag in closes:
                pop_to(k)
            elif k < len(stack) and stack[k].tag in holders:
                break
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p":
                pop_to(k)
                break
            if stack[k].tag in BLOCKS or stack[k].tag in SKIPPED:
                break
        flush()
        top = stack[-1]
        node = top.node
        if not top.skip:
            names, label = [], ""
            if "=" in m[3]:
                for a in _ATTRIBUTE.finditer(m[3]):
                    value = a[2] or a[3] or a[4] or ""
                    if a[1].lower() == "data-label":
                        label = value
                    else:
                        names.append(value)
            nodes.append(Node(tag, top.node, " ".join(names), label, depth=nodes[top.node].depth + 1))
            node = len(nodes) - 1
        stack.append(_Open(tag, node, top.skip, top.link))
    if page[at:].strip():
        end_head()
    add(page[at:])
    flush()
    if all(n.tag != "body" for n in nodes):
        nodes[0].tag = "body"  # left out in the page, as it may be
    for k in range(len(nodes) - 1, 0, -1):
        nodes[nodes[k].parent].length += nodes[k].length
        nodes[nodes[k].parent].linked += nodes[k].linked
    return nodes
