"""Tolerant reading of one HTML string into the elements that rules can use.

Called once per page from the Arrow function in ``nodes``. It only tokenises,
closes what HTML leaves open and numbers elements; which element means what is
decided by column expressions.
"""

from __future__ import annotations

import re
from html import unescape

from .text import BREAK

# A tag, a comment, or a declaration. Possessive repetition: no backtracking.
_TOKEN = re.compile(
    r"<(?:(/?)([a-zA-Z][^\s/>]*)"
    r"((?:[^>=]++|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?)*+)>"
    r"|!--(?:-?>|.*?--!?>|(.*))|[!?][^>]*>)",
    re.S,
)
_BROKEN_TAIL = re.compile(r"<(?:/?[a-zA-Z]|[!?])")
_ATTR = re.compile(
    r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?"
)
# Element classes of the HTML standard.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
SKIPPED = frozenset("script style noscript template iframe noembed noframes xmp".split())
PLAIN_TEXT = frozenset(("title", "textarea"))
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend "
    "li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = (
    BLOCK - frozenset("body html optgroup option select caption tbody td tfoot th thead tr".split())
) - {"legend"}
SPECIAL = BLOCK | frozenset("button marquee object applet".split())
CELLS = frozenset(("td", "th"))
ROW_GROUPS = frozenset(("tbody", "thead", "tfoot"))
P_WALL = frozenset("table td th caption button html marquee object applet".split())
TABLE_WALL = frozenset("table td th caption html marquee object applet".split())
TABLE_ONLY = frozenset(("table", "html"))
ITEM_WALL = SPECIAL - frozenset(("address", "div", "p"))
# Opening the key closes an open element of the first set, unless one of the
# second set lies nearer.
IMPLIED_END = {
    "li": (frozenset(("li",)), ITEM_WALL),
    "dd": (frozenset(("dd", "dt")), ITEM_WALL),
    "dt": (frozenset(("dd", "dt")), ITEM_WALL),
    "option": (frozenset(("option",)), SPECIAL),
    "optgroup": (frozenset(("optgroup",)), SPECIAL - {"option"}),
    "td": (CELLS, TABLE_ONLY),
    "th": (CELLS, TABLE_ONLY),
    "tr": (frozenset(("tr",)), TABLE_ONLY),
    "tbody": (ROW_GROUPS, TABLE_ONLY),
    "thead": (ROW_GROUPS, TABLE_ONLY),
    "tfoot": (ROW_GROUPS, TABLE_ONLY),
    "a": (frozenset(("a",)), SPECIAL),
}
END_WALL = {t: TABLE_ONLY for t in CELLS | ROW_GROUPS | {"table", "tr", "caption"}}
END_WALL["li"] = TABLE_WALL | {"ul", "ol"}
_RAW_END = {
    t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in SKIPPED | PLAIN_TEXT
}


def read_attrs(raw: str) -> dict[str, str]:
    """Attributes with lower-case names; the first of equal names counts."""
    out: dict[str, str] = {}
    for name, dq, sq, bare in _ATTR.findall(raw):
        name = name.lower()
        if name not in out:
            value = dq or sq or bare
            out[name] = unescape(value) if "&" in value else value
    return out


def read_some_attrs(raw: str, names) -> dict[str, str]:
    """``read_attrs`` of some names only."""
    out: dict[str, str] = {}
    for name, dq, sq, bare in _ATTR.findall(raw):
        if name not in names:
            name = name.lower()
            if name not in names:
                continue
        if name not in out:
            value = dq or sq or bare
            out[name] = unescape(value) if "&" in value else value
    return out


#: tag -> (block?, void?, closes an open p?, implied end, raw-text end)
_TRAITS = {
    t: (t in BLOCK, t in VOID, t in CLOSES_P, IMPLIED_END.get(t), _RAW_END.get(t))
    for t in BLOCK | VOID | SPECIAL | SKIPPED | PLAIN_TEXT | {"a"}
}
_PLAIN = (False, False, False, None, None)
#: Tokens whose reading is remembered, and the characters of the longest.
MEMO_SIZE, MEMO_CHARS = 4096, 120


class _Tree:
    """Open elements of one page and the kept elements in document order."""

    def __init__(self):
        self.kept: list[list] = []
        self.index: dict[str, list[int]] = {}
        self.stack: list[tuple[str, int, list | None, int]] = []
        self.open_count: dict[str, int] = {}
        self.count = 0
        #: text pieces, collected while ``readers`` open elements want their text
        self.pieces: list[str] = []
        self.readers = 0

    def text(self, piece: str) -> None:
        if "&" in piece:
            piece = unescape(piece)
        if self.readers:
            self.pieces.append(piece)
        if self.stack:
            rec = self.stack[-1][2]
            if rec is not None and rec[7] is None:
                rec[7] = piece

    def wants_text(self) -> bool:
        return self.readers > 0 or (bool(self.stack) and self.stack[-1][2] is not None)

    def pop(self) -> None:
        tag, _, rec, start = self.stack.pop()
        self.open_count[tag] -= 1
        if self.readers and tag in BLOCK:
            self.pieces.append(BREAK)
        if rec is not None:
            rec[1] = self.count - 1
            if start >= 0:
                self.close(rec, start)

    def close(self, rec: list, start: int) -> None:
        """The text of an element that ends here."""
        rec[8] = "".join(self.pieces[start:])
        self.readers -= 1
        if not self.readers:
            self.pieces.clear()

    def pop_to(self, tags, wall) -> None:
        """Close down to the nearest of ``tags`` unless a ``wall`` element is nearer."""
        for t in tags:
            if self.open_count.get(t):
                break
        else:
            return
        stack = self.stack
        for i in range(len(stack) - 1, -1, -1):
            tag = stack[i][0]
            if tag in tags:
                while len(stack) > i:
                    self.pop()
                return
            if tag in wall:
                return

    def end(self, tag: str) -> None:
        if tag == "br":
            if self.readers:
                self.pieces.append(BREAK)
        elif self.open_count.get(tag):
            wall = END_WALL.get(tag, TABLE_WALL) if tag in BLOCK else SPECIAL
            self.pop_to((tag,), wall)


def _reading(wanted, closing: str, tag: str, raw: str) -> tuple:
    """All that a token says by itself: closing?, tag, its traits, self-closing?, what ``wanted`` keeps of it."""
    tag = tag.lower()
    traits = _TRAITS.get(tag, _PLAIN)
    if closing:
        return True, tag, *traits, False, None
    return False, tag, *traits, raw[-1:] == "/", wanted.decide(tag, raw)


def read_elements(html: str, wanted) -> tuple[list[list], dict[str, list[int]]]:
    """Kept elements ``[ord, end, parent, tag, id, classes, attrs, own, text]`` and their index.

    Every token ends at a ``>``, so scanning stops at the last one: each ``<`` before
    it starts a complete token, and reading takes linear time on any input. Tokens repeat a
    lot, so what one says by itself is looked up by its text; the common steps stand in this loop.
    """
    tree, memo = _Tree(), wanted.memo
    kept, index, stack, counts, pieces = tree.kept, tree.index, tree.stack, tree.open_count, tree.pieces
    pos, last = 0, html.rfind(">") + 1
    while pos < last:
        raw_end = None
        for m in _TOKEN.finditer(html, pos, last):
            at, after = m.span()
            if at > pos and (tree.readers or (stack and stack[-1][2] is not None)):
                tree.text(html[pos:at])
            pos = after
            token = m[0]
            known = memo.get(token)
            if known is None:
                closing, tag, raw, unclosed = m.groups()
                if tag is None:
                    if unclosed is not None:
                        pos = len(html)  # a comment without end
                        break
                    continue
                known = _reading(wanted, closing, tag, raw)
                if after - at <= MEMO_CHARS:
                    if len(memo) >= MEMO_SIZE:
                        memo.clear()
                    memo[token] = known
            closing, tag, block, void, closes_p, implied, raw_end, slashed, picked = known
            if closing:
                raw_end = None
                if stack and stack[-1][0] == tag:
                    _, _, rec, start = stack.pop()
                    counts[tag] -= 1
                    if block and tree.readers:
                        pieces.append(BREAK)
                    if rec is not None:
                        rec[1] = tree.count - 1
                        if start >= 0:
                            tree.close(rec, start)
                else:
                    tree.end(tag)
                continue
            if closes_p:
                if counts.get("p"):
                    tree.pop_to(("p",), P_WALL)
                if tag in HEADINGS and stack and stack[-1][0] in HEADINGS:
                    tree.pop()
            if implied:
                tree.pop_to(*implied)
            if tree.readers and (block or tag == "br" or tag == "hr"):
                pieces.append(BREAK)
            number = tree.count
            tree.count = number + 1
            rec, start = None, -1
            if picked is not None:
                ident, names, attrs, entries, needs_text = picked
                rec = [number, number, stack[-1][1] if stack else -1, tag, ident, names, attrs, None, None]
                at = len(kept)
                for entry in entries:
                    if entry in index:
                        index[entry].append(at)
                    else:
                        index[entry] = [at]
                kept.append(rec)
            if void or (slashed and (counts.get("svg") or counts.get("math"))):
                raw_end = None
                continue
            if rec is not None and needs_text:
                start = len(pieces)
                tree.readers += 1
            stack.append((tag, number, rec, start))
            counts[tag] = counts.get(tag, 0) + 1
            if raw_end is not None:
                break
        else:
            break
        if raw_end is not None:
            close = raw_end.search(html, pos)
            if tag in PLAIN_TEXT:
                tree.text(html[pos : close.start() if close else len(html)])
            pos = close.end() if close else len(html)
            tree.pop()
    if pos < len(html) and tree.wants_text():
        broken = _BROKEN_TAIL.search(html, max(pos, last))
        tree.text(html[pos : broken.start() if broken else len(html)])
    while stack:
        tree.pop()
    return kept, index
