"""A small tolerant HTML reader: a tree of block elements whose leaves are runs of inline text.

Tags are read as browsers' tokenizers read them: quotes count only at the start of an attribute's value, and a tag or comment
that never ends holds the rest of the page. A quote that is never closed is an ordinary character. Every step looks at each
character a bounded number of times, so the time grows with the page alone, however it is malformed.
"""

from __future__ import annotations

import html
import re

#: Elements without content, elements whose content isn't markup, those of them whose content is shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext annotation annotation-xml".split())
SHOWN = frozenset("xmp plaintext".split())
#: Elements that stand in a line of text; all others begin and end a block. Foreign ones hold names of their own.
INLINE = frozenset("a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i ins kbd label map mark math nobr object picture q rb rp rt rtc ruby s samp slot small span strike strong sub sup svg time tt u var video".split())
FOREIGN = frozenset("svg math".split())
#: Start tags that end an open p; for other elements, the open ones that their start tag ends and where the search stops.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
}
_BARRIER = frozenset("table td th caption button object template html body".split())
#: What may stand in a head; a start tag of anything else ends it.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_BLOCKS = ENDS_P | ENDS.keys() | frozenset("html head body caption colgroup select optgroup button legend noscript template".split())
_CUTS_P, _CELLS, _PARTS = frozenset(["p"]), frozenset(["td", "th", "table"]), frozenset("table tr tbody thead tfoot body html".split())
#: An attribute: its name, then its value in double quotes, in single quotes, or bare.
_PAIR = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?+"""
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?+""")
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_PAIR})*+)>")
_NAMES = frozenset("class id role itemprop aria-label data-role".split())
_HIDE = re.compile(r"hidden|display", re.IGNORECASE)
_NONE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW}


def attributes(attrs: str):
    """Names in small letters, and values."""
    for m in _ATTR.finditer(attrs):
        yield m[1].lower(), m[2] or m[3] or m[4] or ""


def hides(attrs: str) -> bool:
    """Whether an element with these attributes isn't shown: by their names and values, not by words inside other values."""
    if not _HIDE.search(attrs):
        return False
    return any(name == "hidden" or name == "style" and _NONE.search(value) or name == "aria-hidden" and value.strip().lower() == "true" for name, value in attributes(attrs))


class Node:
    """A block element, or with tag #text a run of inline text (text, of which link characters stand in links)."""

    __slots__ = ("tag", "attrs", "parent", "children", "text", "link", "bold", "hidden")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.text, self.link, self.bold, self.hidden = "", 0, 0, False
        if parent is not None:
            parent.children.append(self)

    def tokens(self) -> list[str]:
        if "=" not in self.attrs:
            return []
        return [w.lower() for name, value in attributes(self.attrs) if name in _NAMES for w in _WORD.findall(value)]


class Reader:
    """The tree as it grows. Open blocks are a stack of frames, each with the inline elements that are open in it by number;
    where says at which places of the stack a tag is open."""

    def __init__(self):
        self.root = self.at = Node("#root")
        self.frames: list[tuple[str, Node, dict[str, int]]] = [("#root", self.root, {})]
        self.where: dict[str, list[int]] = {}
        self.hidden = self.links = self.bolds = 0
        self.run: list[str] = []
        self.link = self.bold = 0

    def flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                leaf = Node("#text", "", self.at)
                leaf.text, leaf.link, leaf.bold = text, self.link, self.bold
            self.run.clear()
        self.link = self.bold = 0

    def add(self, raw: str, plain: bool = False) -> None:
        if self.hidden or not raw:
            return
        text = html.unescape(raw) if "&" in raw and not plain else raw
        self.run.append(text)
        if self.links:
            self.link += len(text)
        if self.bolds:
            self.bold += len(text)

    def inline(self, tag: str, n: int) -> None:
        """Opens (1) or closes (-1) an inline element of the block at hand; one that isn't open can't be closed."""
        own = self.frames[-1][2]
        if n < 0 and not own.get(tag) or n > 0 and tag == "a" and own.get(tag):
            return
        own[tag] = own.get(tag, 0) + n
        self.links += n * (tag == "a")
        self.bolds += n * (tag in ("b", "strong"))

    def broken(self) -> None:
        """Ends all inline elements of the block at hand."""
        own = self.frames[-1][2]
        self.links -= own.get("a", 0)
        self.bolds -= own.get("b", 0) + own.get("strong", 0)
        own.clear()

    def foreign(self) -> bool:
        own = self.frames[-1][2]
        return bool(own) and any(own.get(t) for t in FOREIGN)

    def open(self, tag: str, attrs: str) -> None:
        self.flush()
        self.broken()
        node = Node(tag, attrs, self.at)
        node.hidden = tag == "template" or bool(attrs) and hides(attrs)
        self.where.setdefault(tag, []).append(len(self.frames))
        self.frames.append((tag, node, {}))
        self.hidden += node.hidden
        self.at = node

    def pop(self) -> None:
        self.flush()
        self.broken()
        tag, node, _ = self.frames.pop()
        self.where[tag].pop()
        self.hidden -= node.hidden
        self.at = node.parent

    def last(self, tags) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def close(self, tags, stop=()) -> None:
        """Ends the innermost open block of these tags, with all in it, unless one of stop stands between."""
        at = self.last(tags)
        if at and at > self.last(stop):
            while len(self.frames) > at:
                self.pop()

    def start(self, tag: str, attrs: str) -> None:
        if tag in ("html", "body") and self.where.get(tag):
            self.flush()
            return
        if self.where.get("head") and tag not in HEAD:
            self.close(("head",))
        if tag in ENDS_P:
            self.close(_CUTS_P, _BARRIER)
        if tag in ENDS:
            self.close(*ENDS[tag])
        self.open(tag, attrs)

    def end(self, tag: str) -> None:
        self.flush()
        self.close((tag,), () if tag in _PARTS else _CELLS - {tag})


def parse(source: str | None) -> Node:
    r = Reader()
    source = source or ""
    n, pos, look = len(source), 0, 0  # what precedes pos is read; look: where the next tag may begin
    while (at := source.find("<", look)) >= 0:
        m = _TAG.match(source, at)
        if m is None:
            kind, after = source[at + 1 : at + 2], source[at + 2 : at + 3]
            first = after if kind == "/" else kind
            if first.isascii() and first.isalpha():  # a tag that never ends is no text
                r.add(source[pos:at])
                pos = n
                break
            if kind not in ("!", "?", "/") or kind == "/" and not after:
                look = at + 1
                continue
            r.add(source[pos:at])
            comment = source.startswith("<!--", at)
            end = source.find("-->" if comment else ">", at + 2)
            pos = look = n if end < 0 else end + (3 if comment else 1)
            continue
        r.add(source[pos:at])
        pos = look = m.end()
        tag, attrs = m[2].lower(), m[3]
        if tag == "br":
            r.add(" ")
        elif m[1]:
            if tag in INLINE or tag not in _BLOCKS and r.foreign():
                r.inline(tag, -1)
            else:
                r.end(tag)
        elif tag in VOID:
            if tag in ("hr", "input"):
                r.flush()
        elif tag in RAW:
            end = None if tag == "plaintext" else _RAW_END[tag].search(source, pos)
            if tag in SHOWN:
                r.start(tag, attrs)
                r.add(source[pos : end.start() if end else n], plain=True)
                r.end(tag)
            elif tag == "textarea":
                r.flush()
            pos = look = n if end is None else source.find(">", end.end() - 1) + 1 or n
        elif tag in INLINE or tag not in _BLOCKS and r.foreign():
            if tag in INLINE and tag not in FOREIGN or not attrs.endswith("/"):
                r.inline(tag, 1)
        else:
            r.start(tag, attrs)
    r.add(source[pos:])
    r.flush()
    return r.root
