"""A small tolerant HTML reader: blocks and the runs of text in them.

Only block elements become nodes; inline elements leave their text in the run and are counted. Runs
are leaves. Scripts, styles, comments, buttons and other content that is no text is left out; character references are
decoded. End tags that HTML lets one leave out are supplied; stray ones are ignored. A script, style or comment that is
never closed reaches to the end of the page, as HTML has it; of other such elements only the tag is left out.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field

#: Elements whose content is not shown as text, without content, and inline.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "noembed", "noframes", "xmp", "template", "svg", "canvas", "audio", "video", "select", "button"}
TO_THE_END = {"script", "style"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "label", "picture", "nobr", "object",
    "math", "mi", "mn", "mo", "mrow", "mfrac", "msup", "msub", "mtext", "semantics", "annotation",
}
#: A start tag ends the open element of the key if it is one of the values (None: any block).
ENDED_BY = {
    "p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"},
}
#: An implied end does not reach beyond these.
FENCE = {"table", "ul", "ol", "dl", "td", "th", "body", "html", "article", "section", "div", "aside", "nav", "form"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)", re.S)
_LOWER = {c: c + 32 for c in range(65, 91)}
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass(slots=True)
class Node:
    tag: str  # "" for a run of text
    parent: int
    depth: int
    attributes: dict[str, str] = field(default_factory=dict)
    text: str = ""
    linked: int = 0  # characters within links
    bold: int = 0
    controls: int = 0


class _Builder:
    def __init__(self) -> None:
        self.nodes = [Node("#root", -1, 0)]
        self.stack = [0]
        self.parts: list[str] = []
        self.linked = self.controls = 0
        self.in_link = False

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                at = self.stack[-1]
                self.nodes.append(Node("", at, self.nodes[at].depth + 1, {}, text, self.linked, 0, self.controls))
            self.parts, self.linked, self.controls = [], 0, 0

    def text(self, raw: str) -> None:
        if raw:
            raw = _html.unescape(raw) if "&" in raw else raw
            self.parts.append(raw)
            if self.in_link:
                self.linked += len(raw.strip())

    def open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in ("input", "label"):
            self.controls += 1
        if tag == "a":
            self.in_link = True
        if tag in INLINE or tag in VOID:
            if tag == "hr":
                self.flush()
            return
        self.flush()
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.nodes[self.stack[k]].tag
            if name in ENDED_BY and (ENDED_BY[name] is None or tag in ENDED_BY[name]):
                del self.stack[k:]
                break
            if name in FENCE:
                break
        at = self.stack[-1]
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip(" /\n\t") else {}
        self.nodes.append(Node(tag, at, self.nodes[at].depth + 1, found))
        self.stack.append(len(self.nodes) - 1)

    def close(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        if tag in INLINE or tag in VOID:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.nodes[self.stack[k]].tag == tag:
                self.flush()
                self.in_link = False
                del self.stack[k:]
                return


def _lowered(html: str) -> str:
    """Lower-cased in A-Z, place by place."""
    return html.translate(_LOWER)


def parse(html: str) -> list[Node]:
    """Nodes in page order; a parent comes before its children, the root is the first."""
    b, at = _Builder(), 0
    lower, unclosed = None, set()
    while (m := _TOKEN.search(html, at)) is not None:
        b.text(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            b.close(tag)
        elif tag in RAW:
            if tag == "button":
                b.controls += 1
            if (m[3] or m[6] or "").endswith("/") and tag == "svg":
                continue
            lower = _lowered(html) if lower is None else lower
            k = -1 if tag in unclosed else lower.find(f"</{tag}", at)
            stop = html.find(">", k) if k >= 0 else -1
            if stop >= 0:
                at = stop + 1
            elif tag in TO_THE_END:
                at = len(html)
            else:
                unclosed.add(tag)  # not looked for again
        else:
            b.open(tag, m[3] or m[6] or "")
    b.text(html[at:])
    b.flush()
    return b.nodes
