"""HTML pages as sequences of leaf blocks: text, tag path, and the share of it inside links.

A leaf is a run of text without a block boundary in it. Scripts, styles, comments, markup and what a browser
never shows as text make no leaf. Unclosed elements end where their parent ends, or where an element starts
that cannot lie inside them.
"""

from __future__ import annotations

import html as entities
import re
import sys
import zlib

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Elements within a line of text: they do not end a leaf.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select datalist noframes xmp plaintext".split())
HEAD_ONLY = frozenset("head title meta link base script style noscript template".split())
#: A start of the key ends an open element of the values, up to the nearest of LIMITS.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = frozenset("ul ol dl table tbody thead tfoot select article section nav aside header footer main body form".split())
TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
BUCKETS = 4096
#: Elements that lie deeper add nothing to a path.
DEPTH = 256


def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


def element_tokens(tag: str, attributes: str) -> tuple[int, ...]:
    """Buckets of an element: its name, the words of its class, id and role, and whether it is hidden."""
    out = [bucket(tag)]
    if attributes and not attributes.isspace():
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "role"):
                out += [bucket("." + w.lower()) for w in PARTS.findall(value)]
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
                out.append(bucket("hidden"))
    return tuple(dict.fromkeys(out))


class Leaves:
    """Parser of pages; the table of paths (number of each set of buckets) is shared by the pages it reads."""

    def __init__(self):
        self.paths: dict[tuple[int, ...], int] = {(): 0}
        self.buckets: list[tuple[int, ...]] = [()]
        self.below: dict[tuple[int, str, str], int] = {}
        self.closing = {t: re.compile(rf"</{t}\b[^>]*+(?:>|\Z)", re.I) for t in RAW}

    def number(self, path: tuple[int, ...]) -> int:
        found = self.paths.setdefault(path, len(self.paths))
        if found == len(self.buckets):
            self.buckets.append(path)
        return found

    def child(self, stack: list, tag: str, attributes: str) -> tuple[str, int]:
        """An element as it is kept on the stack: name and number of its path."""
        parent = stack[-1][1] if stack else 0
        if len(stack) >= DEPTH:
            return tag, parent
        key = (parent, tag, attributes)
        found = self.below.get(key)
        if found is None:
            if len(self.below) > 50_000:
                self.below.clear()
            found = self.below[key] = self.number(tuple(sorted({*self.buckets[parent], *element_tokens(tag, attributes)})))
        return tag, found

    def of(self, page: str | None) -> list[tuple[int, str, int]]:
        """(path, text, characters inside links) of every leaf of a page, in page order; null has none."""
        out, stack, pieces = [], [], []
        held = linked = links = at = 0
        page = page or ""

        def text(raw: str) -> None:
            nonlocal held, linked
            if raw and not raw.isspace():
                held += 1
                raw = entities.unescape(raw) if "&" in raw else raw
                if links:
                    linked += len(raw)
            if raw:
                pieces.append(raw)

        def flush() -> None:
            nonlocal held, linked
            if held:
                joined = " ".join("".join(pieces).split())
                if joined:
                    out.append((stack[-1][1] if stack else 0, joined, min(linked, len(joined))))
            pieces.clear()
            held = linked = 0

        def pop(to: int) -> None:
            nonlocal links
            if links:
                links -= sum(t == "a" for t, _ in stack[to:])
            del stack[to:]
        while True:
            m = TAG.search(page, at)
            if m is None:
                text(page[at:])
                break
            text(page[at:m.start()])
            at = m.end()
            slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if tag is None:
                continue
            tag = tag.lower()
            inline = tag in INLINE
            if slash:
                if not inline:
                    flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        pop(i)
                        break
                    if inline and stack[i][0] not in INLINE:
                        break
                continue
            if tag == "br":
                pieces.append(" ")
                continue
            if tag in RAW:
                if not attributes.rstrip().endswith("/") or tag not in ("svg", "math"):
                    end = self.closing[tag].search(page, at)
                    at = end.end() if end else len(page)
                if tag not in ("script", "style"):
                    pieces.append(" ")
                continue
            if inline:
                if tag not in VOID:
                    if tag == "a":
                        for i in range(len(stack) - 1, -1, -1):
                            if stack[i][0] == "a":
                                pop(i)
                                break
                            if stack[i][0] not in INLINE:
                                break
                        links += 1
                    stack.append(self.child(stack, tag, attributes))
                continue
            flush()
            if tag in VOID:
                continue
            if stack and stack[-1][0] == "head" and tag not in HEAD_ONLY:
                pop(len(stack) - 1)
            # a block ends an open paragraph and what is open inside it; list items and cells end their like
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if name == "p" or name in ENDS.get(tag, ()):
                    pop(i)
                    if name == "p" and tag in ENDS:
                        continue
                    break
                if name in LIMITS or (name not in INLINE and tag not in ENDS):
                    break
            stack.append(self.child(stack, tag, attributes))
        flush()
        return out
