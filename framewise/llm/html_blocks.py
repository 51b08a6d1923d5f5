"""Leaf blocks of a page: runs of text between block tags, with the tags around them."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
UNSEEN = frozenset(
    "script style template noscript iframe svg math canvas object audio video head title".split()
)
RAW = frozenset("script style title textarea template noscript iframe svg".split())
HEAD_PARTS = frozenset("title meta link script style base noscript template head html".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
MAIN_TAGS = frozenset("article main".split())
SCOPES = frozenset("ul ol dl table body html article main aside nav section div".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>?", re.S
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}


@dataclass(frozen=True, slots=True)
class Around:
    """The open tags at a place, however many: which tags and which class and id words are among them.

    ``inner`` and ``inner_names`` count from the innermost main tag on, and are None outside of one.
    """

    own: str = "none"
    parent: str = "none"
    tags: frozenset[str] = frozenset()
    names: frozenset[str] = frozenset()
    inner: frozenset[str] | None = None
    inner_names: frozenset[str] | None = None

    def within(self, tag: str, names: frozenset[str]) -> Around:
        """The same place inside one more tag; sets that stay the same are shared."""

        def more(old: frozenset[str], new: frozenset[str]) -> frozenset[str]:
            return old if new <= old else old | new

        one = frozenset([tag])
        tags, all_names = more(self.tags, one), more(self.names, names)
        if tag in MAIN_TAGS:
            return Around(tag, self.own, tags, all_names, one, names)
        if self.inner is None:
            return Around(tag, self.own, tags, all_names)
        return Around(tag, self.own, tags, all_names, more(self.inner, one), more(self.inner_names, names))


NOTHING = Around()


@dataclass(slots=True)
class Block:
    text: str
    around: Around
    linked: int  # characters inside links


def names_in(attributes: str) -> tuple[str, ...]:
    """The words of class, id and role, in lower case."""
    found = []
    for value in _NAMED.findall(attributes):
        found += [w.lower() for w in _PARTS.findall(value)]
    return tuple(found)


def blocks(html: str, known: frozenset[str] | None = None) -> list[Block]:
    """The blocks of a page in order; white space inside a block is one blank.

    Of the words of class, id and role only those in ``known`` are kept, if given: what a block carries is
    bounded then, whatever a page nests.
    """
    out: list[Block] = []
    path: list[Around] = []
    parts: list[str] = []
    opened: Counter = Counter()  # spares searching a deep path for tags that are not in it
    linked = unseen = links = at = 0

    def inside(tag: str, attributes: str) -> Around:
        names = frozenset(names_in(attributes))
        return (path[-1] if path else NOTHING).within(tag, names if known is None else names & known)

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, path[-1] if path else NOTHING, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal unseen, links
        for node in path[to:]:
            unseen -= node.own in UNSEEN
            links -= node.own == "a"
            opened[node.own] -= 1
        del path[to:]

    def find(tags, stop=frozenset()) -> int:
        if not any(opened[t] for t in tags):
            return -1
        for i in range(len(path) - 1, -1, -1):
            if path[i].own in tags:
                return i
            if path[i].own in stop:
                break
        return -1

    while at < len(html):
        m = _TOKEN.search(html, at)
        start = m.start() if m else len(html)
        if start > at and not unseen:
            parts.append(html[at:start])
            linked += (start - at) if links else 0
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            close()
        if m[1]:
            i = find((tag,))
            if i >= 0:
                pop(i)
            continue
        if tag not in HEAD_PARTS and (i := find(("head",))) >= 0:
            pop(i)
        if tag not in INLINE:
            if tag != "br" and (i := find(("p",), SCOPES)) >= 0:
                pop(i)
            if tag in CLOSES and (i := find(CLOSES[tag], SCOPES)) >= 0:
                pop(i)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = _ENDS[tag].search(html, at)
            if tag not in UNSEEN:
                path.append(inside(tag, m[3]))
                parts.append(html[at : end.start() if end else len(html)])
                close()
                path.pop()
            at = end.end() if end else len(html)
            continue
        path.append(inside(tag, m[3]))
        opened[tag] += 1
        unseen += tag in UNSEEN
        links += tag == "a"
    close()
    return out
