"""HTML pages as sequences of text blocks with their tag paths."""

from __future__ import annotations

import html
import re

#: Elements whose content is never text of the page.
_RAW = "script|style|title|template"
_INSIDE = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
#: The first branches skip comments and raw elements with their content; a self-closed one (as in SVG) has none.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?:/>|(?=[\s/>]){_INSIDE}>(?:(?<=[\s\"']/>)|.*?(?:</\1(?=[\s/>])[^>]*>|\Z)))|<(/?)([a-zA-Z][^\s/>]*)({_INSIDE})>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Formulas and drawings stand within a line, with all that they hold.
_INLINE |= frozenset("math semantics annotation annotation-xml mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot munder mover munderover mmultiscripts mprescripts mtable mtr mtd mstyle mspace mpadded mphantom menclose merror".split())
_INLINE |= frozenset("svg g defs symbol use path rect circle ellipse line polyline polygon text tspan textpath desc image marker mask pattern clippath lineargradient radialgradient stop filter".split())
#: Inline, but apart from what is beside them.
_APART = frozenset("br text desc mtd annotation annotation-xml".split())
#: A tag that opens ends the open elements named here, up to the nearest of the second group.
_ENDS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"),
    "th": ("td th", "tr table"), "option": ("option", "select"),
}
_ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ENDS.items()}
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_STOPS_P = frozenset("article aside blockquote body button div footer form header li main nav section table td th".split())


class Block:
    """Text of a block, the names on its path (tags, and words of class, id and role), link share."""

    __slots__ = ("text", "path", "tags", "links")

    def __init__(self, text: str, path: list[tuple[str, ...]], links: float):
        self.text, self.links = text, links
        self.tags = [p[0] for p in path]
        self.path = path


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    return tuple(w.lower() for _, v in _ATTR.findall(attributes) for w in _NAME.findall(v))


def blocks_of(page: str | None) -> list[Block]:
    """Blocks in page order, white space as single spaces, character references decoded, none empty.

    Any tag but an inline one ends a block. Unclosed elements are ended as browsers do for
    paragraphs, list items and table cells; a closing tag without an open element is ignored.
    """
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, ...]] = []
    pieces: list[str] = []
    linked = anchors = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, [e for e in stack if e[0] not in _INLINE], linked / max(1, len(text))))
            pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if anchors:
            linked += len(text.strip())

    def cut(i: int) -> None:
        nonlocal anchors
        anchors -= sum(e[0] == "a" for e in stack[i:])
        del stack[i:]

    def end(names: frozenset, stops: frozenset) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                cut(i)
                return
            if stack[i][0] in stops:
                return

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag in _APART:
            pieces.append(" ")
        if tag == "br":
            continue
        inline = tag in _INLINE
        if not inline:
            flush()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    cut(i)
                    break
                if inline and stack[i][0] not in _INLINE:
                    break
        else:
            if tag in _CLOSES_P:
                end(frozenset(("p",)), _STOPS_P)
            if tag in _ENDS:
                end(*_ENDS[tag])
            if tag == "a":
                for i in range(len(stack) - 1, -1, -1):  # links do not nest: a new one ends the open one
                    if stack[i][0] == "a":
                        cut(i)
                        break
                    if stack[i][0] not in _INLINE:
                        break
            if tag not in _VOID and not m[4].endswith("/"):
                stack.append((tag, *_names(m[4])))
                anchors += tag == "a"
    if at < len(page):
        add(page[at:])
    flush()
    return out
