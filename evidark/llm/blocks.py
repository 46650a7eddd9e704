"""Leaf blocks of a web page: runs of text between block-level tags, each with the path of elements that hold it."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from html import unescape

# Fixed values of HTML: elements that break lines, that have no end, that hold raw text, and that end open ones.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes svg template".split())
DROPPED = frozenset("script style xmp iframe noembed noframes svg template".split())
FOREIGN = frozenset("svg math".split())  # empty where the tag ends in a slash; never the rest of a page
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "thead": {"tr", "td", "th", "thead", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
SCOPE = frozenset("table ul ol dl select button".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'">]|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


#: Bins of tags, tag pairs and names.
PATHS = 512

_bits: dict[str, int] = {}


def path_bit(token: str) -> int:
    """One bit out of PATHS, by the token's hash."""
    bit = _bits.get(token)
    if bit is None:
        if len(_bits) > 50_000:
            _bits.clear()
        bit = 1 << zlib.crc32(token.encode()) % PATHS
        if len(token) < 100:
            _bits[token] = bit
    return bit


class Node:
    """An open element. Elements share their ancestors' bits, so a deep page costs no more for each element than a flat one."""

    __slots__ = ("tag", "depth", "bits", "paragraph")

    def __init__(self, tag: str, names: tuple[str, ...], above: Node | None):
        self.tag = tag
        self.depth = above.depth + 1 if above else 1
        bits = path_bit("t:" + tag)
        if above:
            bits |= above.bits | path_bit(f"p:{above.tag}>{tag}")
        for n in names:
            bits |= path_bit("n:" + n)
        self.bits = bits  # tags and tag pairs from the root down, and the words of class, id and role on that path
        # depth of the open p that a block element ends, 0 if none does
        self.paragraph = self.depth if tag == "p" else above.paragraph if above and tag not in SCOPE else 0


@dataclass(slots=True)
class Block:
    leaf: Node | None  # the innermost open element
    text: str
    linked: int  # characters inside links


def names_of(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = [a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes)]
    return tuple(w.lower() for x in found for w in NAME.findall(x))


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with text, in page order, with white space and character references resolved."""
    out: list[Block] = []
    nodes: list[Node] = []
    open_tags: Counter[str] = Counter()
    endless: set[str] = set()  # raw elements whose end tag does not come again
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(nodes[-1] if nodes else None, text, linked))
            parts.clear()
        linked = 0

    def enter(tag: str, attributes: str) -> None:
        nodes.append(Node(tag, names_of(attributes), nodes[-1] if nodes else None))
        open_tags[tag] += 1

    def leave(depth: int) -> None:
        if any(n.tag in BLOCK for n in nodes[depth:]):
            flush()
        for n in nodes[depth:]:
            open_tags[n.tag] -= 1
        del nodes[depth:]

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if open_tags["a"]:
                linked += len(text)

    at = 0
    while True:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if open_tags[tag]:
                depth = len(nodes) - 1
                while nodes[depth].tag != tag:
                    depth -= 1
                leave(depth)
            elif tag in BLOCK:
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS_P and nodes and nodes[-1].paragraph:
                leave(nodes[-1].paragraph - 1)
        if tag in CLOSES and any(open_tags[t] for t in CLOSES[tag]):
            for depth in range(len(nodes) - 1, -1, -1):
                if nodes[depth].tag in CLOSES[tag]:
                    leave(depth)
                elif nodes[depth].tag in SCOPE:
                    break
        attributes = m[3] or m[6] or ""
        if tag in VOID or (tag in FOREIGN and attributes.endswith("/")):
            continue
        if tag in RAW:
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if end is None:
                endless.add(tag)
                if tag in FOREIGN:
                    continue
            inside, at = (page[at : end.start()], end.end()) if end else (page[at:], len(page))
            if tag not in DROPPED:
                enter(tag, attributes)
                add(inside)
                leave(len(nodes) - 1)
            continue
        enter(tag, attributes)
    leave(0)
    flush()
    return out
