"""Selectors as data, and the column expressions that evaluate them.

A ``Sel`` names elements by tag, id, classes, attributes and position. It is
used twice: to tell the page reader which elements can matter, and to build the
SQL expression that finds them in a parsed page (column ``dom``).

``dom.index`` maps the telling part of each selector (``h1``, ``#title``, ``.price``,
``[src]``) to positions in ``dom.nodes``. A selector therefore looks at its own
candidates only, not at the whole page.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import read_attrs, read_some_attrs
from .text import (
    sql_collapse,
    sql_literal,
    sql_non_blank,
    sql_strip,
    sql_text_content,
)

HAS, IS, PART = "has", "is", "part"


@dataclass(frozen=True)
class Sel:
    """One selector.

    ``attrs`` holds ``(name, HAS|IS|PART, value)``. ``own`` asks for a string in the
    element's first text node, ``holds`` in all its text, ``shows`` the same without
    regard to case and white space. ``under`` / ``child_of`` name an ancestor / the
    parent, and ``then`` moves on to a following sibling with that tag. ``suffix`` is
    an attribute step at the end of a path.
    """

    tag: str | None = None
    id: str | None = None
    classes: tuple[str, ...] = ()
    attrs: tuple[tuple[str, str, str], ...] = ()
    own: str | None = None
    holds: str | None = None
    shows: str | None = None
    under: "Sel | None" = None
    child_of: "Sel | None" = None
    then: str | None = None
    suffix: str | None = None

    def inside(self, other: "Sel") -> "Sel":
        return replace(self, under=other)

    def child(self, other: "Sel") -> "Sel":
        return replace(self, child_of=other)

    def followed_by(self, tag: str) -> "Sel":
        return replace(self, then=tag)

    def at(self, attribute: str) -> "Sel":
        return replace(self, suffix=attribute)


def tag(name: str, *, id: str | None = None, cls: str = "", own=None, holds=None, shows=None) -> Sel:
    return Sel(tag=name, id=id, classes=tuple(cls.split()), own=own, holds=holds, shows=shows)


def css_id(value: str) -> Sel:
    return Sel(id=value)


def css_class(names: str) -> Sel:
    return Sel(classes=tuple(names.split()))


def has(name: str, tag: str | None = None) -> Sel:
    return Sel(tag=tag, attrs=((name, HAS, ""),))


def attr_is(name: str, value: str, tag: str | None = None) -> Sel:
    return Sel(tag=tag, attrs=((name, IS, value),))


def attr_part(name: str, value: str, tag: str | None = None) -> Sel:
    return Sel(tag=tag, attrs=((name, PART, value),))


# ---------------------------------------------------------------- evaluation


def key_of(sel: Sel) -> str:
    """Index entry a selector starts from: id, class, id part, attribute or tag."""
    parts = [v for name, how, v in sel.attrs if name == "id" and how == PART]
    others = [name for name, _, _ in sel.attrs if name not in ("id", "class")]
    if sel.then is not None:
        return sel.then
    if sel.id is not None:
        return "#" + sel.id
    if sel.classes:
        return "." + sel.classes[0]
    if parts:
        return "#*" + parts[0]
    if others:
        return f"[{others[0]}]"
    if sel.tag is not None:
        return sel.tag
    raise ValueError("a selector needs a tag, id, class or attribute")


def sql_attr(n: str, name: str) -> str:
    return f"{n}.id" if name == "id" else f"try_element_at({n}.attrs, {sql_literal(name)})"


def sql_matches(n: str, sel: Sel) -> list[str]:
    """Tests on element ``n`` that the index entry does not already settle."""
    key = key_of(replace(sel, then=None))
    tests = []
    if sel.tag is not None and key != sel.tag:
        tests.append(f"{n}.tag = {sql_literal(sel.tag)}")
    if sel.id is not None and key != "#" + sel.id:
        tests.append(f"{n}.id = {sql_literal(sel.id)}")
    for c in sel.classes:
        if key != "." + c:
            tests.append(f"array_contains({n}.classes, {sql_literal(c)})")
    for name, how, value in sel.attrs:
        found = sql_attr(n, name)
        if how == HAS:
            if key != f"[{name}]":
                tests.append(f"{found} IS NOT NULL")
        elif how == IS:
            tests.append(f"{found} = {sql_literal(value)}")
        elif key != "#*" + value:
            tests.append(f"contains({found}, {sql_literal(value)})")
    if sel.own is not None:
        tests.append(f"contains({n}.own, {sql_literal(sel.own)})")
    if sel.holds is not None:
        tests.append(f"contains({sql_text_content(n + '.text')}, {sql_literal(sel.holds)})")
    if sel.shows is not None:
        text = f"lower({sql_collapse(n + '.text')})"
        tests.append(f"contains({text}, {sql_literal(sel.shows.lower())})")
    return tests


def sql_within(n: str, a: str) -> str:
    return f"{n}.ord > {a}.ord AND {n}.ord <= {a}.end"


def _candidates(dom: str, key: str) -> str:
    k = sql_literal(key)
    return f"transform(try_element_at({dom}.index, {k}), i -> {dom}.nodes[i])"


def _related(dom: str, anchors: str, pool: str, tests: list[str], how: str, depth: int) -> str:
    """``pool`` elements passing ``tests`` that stand in relation ``how`` to an anchor."""
    n, o, os = f"n{depth}", f"o{depth}", f"os{depth}"
    relation = {
        "under": sql_within(n, o),
        "child": f"{n}.parent = {o}.ord",
        "then": f"{n}.parent = {o}.parent AND {o}.ord < {n}.ord",
    }[how]
    cond = " AND ".join([*tests, f"exists({os}, {o} -> {relation})"])
    return f"get(transform(array({anchors}), {os} -> filter({pool}, {n} -> {cond})), 0)"


def sql_select(dom: str, sel: Sel, depth: int = 0) -> str:
    """All elements of the page that satisfy the selector, in document order."""
    n = f"n{depth}"
    if sel.then is not None:
        heads = sql_select(dom, replace(sel, then=None), depth + 1)
        return _related(dom, heads, _candidates(dom, sel.then), [], "then", depth)
    pool = _candidates(dom, key_of(sel))
    tests = sql_matches(n, sel)
    if sel.under is not None:
        return _related(dom, sql_select(dom, sel.under, depth + 1), pool, tests, "under", depth)
    if sel.child_of is not None:
        return _related(dom, sql_select(dom, sel.child_of, depth + 1), pool, tests, "child", depth)
    return f"filter({pool}, {n} -> {' AND '.join(tests)})" if tests else pool


def sql_first(dom: str, sel: Sel) -> str:
    """First matching element in document order, or NULL."""
    plain = sel.then is None and sel.under is None and sel.child_of is None
    if plain and not sql_matches("n", sel):
        at = f"get(try_element_at({dom}.index, {sql_literal(key_of(sel))}), 0)"
        return f"get({dom}.nodes, {at})"
    return f"get({sql_select(dom, sel)}, 0)"


def _coalesce(parts: list[str]) -> Column:
    if not parts:
        return F.lit(None).cast("string")
    return F.expr(f"coalesce({', '.join(parts)})")


def first_text(sels: Iterable[Sel], dom: str = "dom") -> Column:
    """Text of the first selector whose *first* match has any; NULL if none has."""
    return _coalesce(
        [sql_non_blank(sql_collapse(f"{sql_first(dom, s)}.text")) for s in sels]
    )


def first_attr(sels: Iterable[Sel], attribute: str, dom: str = "dom") -> Column:
    """First non-blank attribute over a selector list, stripped but not collapsed.

    A selector ending in another attribute's step names no element and is skipped.
    """
    usable = [s for s in sels if s.suffix in (None, attribute)]
    return _coalesce(
        [sql_non_blank(sql_strip(sql_attr(f"{sql_first(dom, s)}", attribute))) for s in usable]
    )


OG_IMAGE = attr_is("property", "og:image", tag="meta")


def _sql_image(x: str) -> str:
    """Accept ``http…`` and ``//…`` (made https) addresses, NULL for others."""
    good = f"get(filter(array({x}), u -> startswith(u, '//') OR startswith(u, 'http')), 0)"
    return sql_non_blank(sql_strip(f"regexp_replace({good}, '^//', 'https://')"))


def first_image(sels: Iterable[Sel], use_og: bool = False, dom: str = "dom") -> Column:
    """First valid image address: Open Graph (on request), then the selector list."""
    tries = []
    if use_og:
        tries.append(_sql_image(sql_attr(sql_first(dom, OG_IMAGE), "content")))
    for s in sels:
        names = ("src", "data-src", "data-lazy-src")
        picked = ", ".join(sql_non_blank(sql_attr("m", a)) for a in names)
        tries.append(
            _sql_image(f"get(transform(array({sql_first(dom, s)}), m -> coalesce({picked})), 0)")
        )
    return _coalesce(tries)


# ------------------------------------------------------- what the reader keeps


class Wanted:
    """Which elements a page reader has to keep, by index entry.

    A page element costs a few dictionary look-ups. ``everything`` keeps all
    elements with all attributes and files them under every entry.
    """

    def __init__(self, targets: Iterable[Sel] = (), attrs: Iterable[str] = (), everything=False):
        self.everything = everything
        self.names = {"id", "class", *attrs}
        #: index entry -> is the text of its elements needed?
        self.keys: dict[str, bool] = {}
        for s in targets:
            self._add(s, True)
        self.with_text = {k for k, text in self.keys.items() if text}
        self.id_parts = [k[2:] for k in self.keys if k.startswith("#*")]
        self.needs_attrs = everything or any(k[0] in "#.[" for k in self.keys)
        #: what the reader found in a token; tokens repeat a lot
        self.memo: dict[str, tuple] = {}

    def _file(self, key: str, text: bool) -> None:
        self.keys[key] = self.keys.get(key, False) or text

    def _add(self, s: Sel, text: bool) -> None:
        for outer in (s.under, s.child_of):
            if outer is not None:
                self._add(outer, False)
        self.names.update(name for name, _, _ in s.attrs)
        if s.then is not None:
            self._file(s.then, text)
            text = False
        text = text or s.holds is not None or s.shows is not None
        self._file(key_of(replace(s, then=None)), text)

    def entries(self, tag: str, attrs: dict[str, str]) -> list[str]:
        """Index entries an element belongs to."""
        keys = self.keys
        every = self.everything
        found = [tag] if every or tag in keys else []
        for name, value in attrs.items():
            entry = f"[{name}]"
            if every or entry in keys:
                found.append(entry)
            if name == "id":
                entry = "#" + value
                if every or entry in keys:
                    found.append(entry)
                found += ["#*" + p for p in self.id_parts if p in value]
            elif name == "class":
                of_class = ["." + c for c in dict.fromkeys(value.split())]
                found += of_class if every else [k for k in of_class if k in keys]
        return found

    def decide(self, tag: str, raw: str):
        """``(id, class names, attributes, entries, needs text)`` or None to pass over."""
        if not (raw and self.needs_attrs) and tag not in self.keys and not self.everything:
            return None
        read = read_attrs(raw) if self.everything else read_some_attrs(raw, self.names)
        entries = self.entries(tag, read)
        if not entries:
            return None
        text = self.everything or not self.with_text.isdisjoint(entries)
        names = read["class"].split() if "class" in read else None
        return read.get("id"), names, read, entries, text
